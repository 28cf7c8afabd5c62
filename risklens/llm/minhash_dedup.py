"""MinHash near-dedup with sequential Bayesian verification.

Documents are sets of word shingles; two link when ``100 * intersection >= percent *
union``. The result are the components of all links.

1. **Bands.** BANDS x ROWS minimum hashes of each set; sets that agree on all of a band
   are candidates. At similarity 0.8 a pair agrees on no band with a chance of 3e-6.
2. **Stars.** In each band's group a drawn set is compared with those that aren't in its
   component yet, and what links is joined. A group whose members are all in one
   component is finished, so thousands of copies cost a few comparisons each. The
   groups that are left get another pivot, TURNS times in all.
3. **Signature batches.** The members of the groups that remain are dealt into blocks of
   BLOCK. Every two blocks meet in a task of their own, which compares members of
   different components and returns the links that join them: never more than it has
   members, and never pairs.
4. **Sequential verification** of all pairs of 2 and 3: CHECKS further hashes of 8 bits are
   compared BATCH at a time. After each batch the posterior of the similarity (of a
   uniform prior) says how likely the threshold is still reached; a pair goes as soon
   as that is below ``miss``. Survivors are verified exactly on their full sets.

A set travels by a 128-bit name, and by a number of its own where it shares a band. A
task passes on only the least of its sets in a band, and marks the others itself, so
a hot band is spread over the tasks that found it.

Edge cases: no text and no words give an empty set, linked with nothing; fewer words
than a shingle make one shingle of all; equal sets are one item, whatever their
number; a null id is a row of its own and no name for a component (null where no other
row has an id); repeated ids are rows of their own; empty tables give empty results;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risklens.llm.common import batch_rows, bounded_batches, input_bytes, partitions_for, stored
from risklens.llm.components import components
from risklens.llm.shingles import mix, overlap, shingle_set

#: What the registered query takes.
WORDS, PERCENT = 2, 80
BANDS, ROWS = 32, 5
#: Hashes for verification, how many are compared at a time, and how likely it may be
#: that a pair that is dropped links.
CHECKS, BATCH, MISS = 128, 16, 1e-6
#: Members of a block, and signatures that a task holds before it writes them.
BLOCK = 2048
FLUSH = 1 << 20
#: Rounds of stars.
TURNS = 2
#: Shingles that are hashed at once.
CHUNK = 1024
#: Bytes of signatures for a byte of stored input; sizes partitions only.
SIGNATURE_RATIO = 0.5

_rng = np.random.default_rng(20_11)
_ODD = _rng.integers(0, 1 << 63, BANDS * ROWS + CHECKS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, BANDS * ROWS + CHECKS, dtype=np.uint64)
ENTRY = np.dtype([("sig", "<u8"), ("name", "V16")])


def set_name(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def minima(shingles: np.ndarray, first: int, upto: int) -> np.ndarray:
    """The least value of each hash function from ``first`` on, 32 bits each."""
    odd, plus = _ODD[first:upto, None], _PLUS[first:upto, None]
    out = np.full(upto - first, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), CHUNK):
        np.minimum(out, (mix(shingles[k:k + CHUNK])[None, :] * odd + plus).min(axis=1), out=out)
    return out >> np.uint64(32)


def band_signatures(shingles: np.ndarray) -> np.ndarray:
    least = minima(shingles, 0, BANDS * ROWS).reshape(BANDS, ROWS)
    h = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        h = mix(h * np.uint64(0x94D049BB133111EB) + least[:, k])
    return h


def check_signature(shingles: np.ndarray) -> bytes:
    return (minima(shingles, BANDS * ROWS, BANDS * ROWS + CHECKS) & np.uint64(0xFF)).astype(np.uint8).tobytes()


def least_matches(percent: int, miss: float) -> list[int]:
    """For each batch: the least number of equal hashes so far at which a similarity
    of ``percent`` or more is still as likely as ``miss``.

    Hashes of 8 bits agree with chance s + (1 - s) / 256. With a uniform prior the
    chance that this is t or more, after m of n agreed, is that of at most m
    successes in n + 1 trials of chance t.
    """
    t = percent / 100 + (1 - percent / 100) / 256
    out = []
    for n in range(BATCH, CHECKS + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def survivors(x: np.ndarray, y: np.ndarray, least: list[int]) -> np.ndarray:
    """Numbers of the rows of x and y (signatures) that no batch rules out."""
    left = np.arange(len(x))
    same = np.zeros(len(x), np.int64)
    for k, m in enumerate(least):
        cut = slice(k * BATCH, (k + 1) * BATCH)
        same = same + (x[left, cut] == y[left, cut]).sum(axis=1)
        keep = same >= m
        left, same = left[keep], same[keep]
        if not len(left):
            break
    return left


def document_sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, own, name, n_shingles) of each row; own: a hash of the text, name: null
    if the set is empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("own", pa.int64()), ("name", pa.binary()), ("n_shingles", pa.int64())])

    def run(batches) -> Iterator[dict]:
        for b in batches:
            sets = [shingle_set(t, size) for t in b.column(1).to_pylist()]
            yield {"doc_id": b.column(0), "own": b.column(2), "name": [set_name(s) if len(s) else None for s in sets], "n_shingles": [len(s) for s in sets]}

    return docs.mapInArrow(batch_rows(run, schema), "doc_id long, own long, name binary, n_shingles long")


def band_groups(spark: SparkSession, docs: DataFrame, size: int) -> DataFrame:
    """(sig, name): the sets that agree with another on a band, by band and value."""
    parts = partitions_for(spark, SIGNATURE_RATIO * input_bytes(docs))
    buckets = 4 * parts
    group = pa.schema([("sig", pa.int64()), ("name", pa.binary())])

    def runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows by signature, and where a signature starts."""
        rows = rows[np.argsort(rows["sig"], kind="stable")]
        return rows, np.r_[True, rows["sig"][1:] != rows["sig"][:-1]]

    def packed(held: list) -> Iterator[dict]:
        """Of a signature's sets the first goes on to meet those of other tasks, as
        one that has company already or as one that hasn't; the others are in a group."""
        if not held:
            return
        rows, first = runs(np.concatenate(held))
        shared = np.r_[rows["sig"][1:] == rows["sig"][:-1], False][first]
        for kind, part in ((0, rows[first][~shared]), (1, rows[first][shared]), (2, rows[~first])):
            if len(part):
                bucket = ((mix(part["sig"]) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                part, bucket = part[order], bucket[order]
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                # the third kind may be hot: it needs no bucket, so it stays where it is
                if kind == 2:
                    yield {"bucket": [-1 - int(bucket[0])], "kind": [kind], "entries": [part.tobytes()]}
                else:
                    yield {"bucket": bucket[np.r_[0, cuts]], "kind": [kind] * (len(cuts) + 1), "entries": [p.tobytes() for p in np.split(part, cuts)]}

    def sign(batches) -> Iterator[dict]:
        seen, held, n = set(), [], 0
        for b in batches:
            for t in b.column(1).to_pylist():
                s = shingle_set(t, size)
                name = set_name(s) if len(s) else None
                if name is None or name in seen:
                    continue  # a copy of a set of this task adds nothing
                if len(seen) < FLUSH:
                    seen.add(name)
                rows = np.empty(BANDS, ENTRY)
                rows["sig"], rows["name"] = band_signatures(s), np.void(name)
                held.append(rows)
                n += BANDS
                if n >= FLUSH:
                    yield from packed(held)
                    held, n = [], 0
        yield from packed(held)

    def meet(batches) -> Iterator[dict]:
        raw: dict[int, list] = {0: [], 1: []}
        for t in batches:
            for kind, x in zip(t.column(1).to_pylist(), t.column(2)):
                rows = np.frombuffer(x.as_py(), ENTRY)
                if kind == 2:
                    yield {"sig": rows["sig"].view(np.int64), "name": names(rows)}
                else:
                    raw[kind].append(rows)
        alone, shared = (np.concatenate(raw[k] or [np.empty(0, ENTRY)]) for k in (0, 1))
        rows = np.concatenate([alone, shared])
        if len(rows):
            order = np.argsort(rows["sig"], kind="stable")
            rows, company = rows[order], np.r_[np.zeros(len(alone), bool), np.ones(len(shared), bool)][order]
            same = rows["sig"][1:] == rows["sig"][:-1]
            rows = rows[company | np.r_[same, False] | np.r_[False, same]]
            for k in range(0, len(rows), 100_000):
                yield {"sig": rows["sig"][k:k + 100_000].view(np.int64), "name": names(rows[k:k + 100_000])}

    def names(rows: np.ndarray) -> pa.Array:
        flat = pa.py_buffer(np.ascontiguousarray(rows["name"]).tobytes())
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(rows), [None, flat]).cast(pa.binary())

    schema = pa.schema([("bucket", pa.int64()), ("kind", pa.int64()), ("entries", pa.binary())])
    blobs = docs.mapInArrow(batch_rows(sign, schema), "bucket long, kind long, entries binary")
    rows = blobs.repartition(parts, "bucket").mapInArrow(batch_rows(meet, group), "sig long, name binary")
    rows = rows.distinct()  # copies in several tasks are one set
    several = rows.groupBy("sig").agg(F.count("*").alias("held")).where("held > 1").select("sig")
    return rows.join(several, "sig", "left_semi")


def wanted_items(spark: SparkSession, docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(id, size, checks, payload) of the sets of ``wanted`` (id, name, doc_id, own),
    read anew from one document of each: the row has that id and text hash, and the
    set that is computed from it must have that name."""
    schema = pa.schema([("id", pa.int64()), ("size", pa.int64()), ("checks", pa.binary()), ("payload", pa.binary())])

    def run(batches) -> Iterator[dict]:
        for b in batches:
            kept = []
            for i, name, t in zip(*(b.column(k).to_pylist() for k in range(3))):
                s = shingle_set(t, size)
                if len(s) and set_name(s) == name:
                    kept.append((i, s))
            yield {"id": [i for i, _ in kept], "size": [len(s) for _, s in kept], "checks": [check_signature(s) for _, s in kept],
                   "payload": [s.tobytes() for _, s in kept]}

    w = wanted.select(F.col("id"), F.col("name"), F.col("doc_id").alias("_doc"), F.col("own").alias("_own"))
    texts = docs.join(w, (F.col("own") == F.col("_own")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).select("id", "name", "text")
    rows = texts.mapInArrow(batch_rows(run, schema), "id long, size long, checks binary, payload binary")
    return stored(spark, rows.dropDuplicates(["id"]), "items")


def verify(spark: SparkSession, pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the distinct ``pairs`` that link: signatures first, then the full sets."""
    least = least_matches(percent, MISS)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def batches_of(batches) -> Iterator[dict]:
        for t in batches:
            x, y = (np.frombuffer(b"".join(t.column(k).to_pylist()), np.uint8).reshape(-1, CHECKS) for k in (2, 3))
            left = pa.array(survivors(x, y, least))
            yield {"a": t.column(0).take(left), "b": t.column(1).take(left)}

    def exact(batches) -> Iterator[dict]:
        for t in batches:
            keep = []
            for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist()):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = overlap(a, b)
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            mask = pa.array(keep, pa.bool_())
            yield {"a": t.column(0).filter(mask), "b": t.column(1).filter(mask)}

    def with_(rows: DataFrame, column: str) -> DataFrame:
        x = items.select(F.col("id").alias("a"), F.col(column).alias("x"))
        y = items.select(F.col("id").alias("b"), F.col(column).alias("y"))
        return rows.join(x, "a").join(y, "b").select("a", "b", "x", "y")

    pairs = stored(spark, with_(pairs, "checks").mapInArrow(batch_rows(batches_of, schema), "a long, b long"), "checked")
    return stored(spark, with_(pairs, "payload").mapInArrow(batch_rows(exact, schema), "a long, b long"), "links")


def block_links(rows: DataFrame, percent: int, block: int) -> DataFrame:
    """(a, b): links between different components inside a group (sig, id, comp, held,
    checks, size, payload), as few as join them. Blocks of a group meet in pairs;
    what sizes and signatures don't rule out is verified there, on the full sets,
    unless the links so far join it already."""
    least = least_matches(percent, MISS)
    blocks = F.ceil(F.col("held") / block)
    rows = rows.withColumns({"blocks": blocks, "mine": F.pmod(F.xxhash64("id"), blocks)})
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

    def meet(t: pa.Table) -> pa.Table:
        ids, comp, mine, n = (t[c].to_numpy() for c in ("id", "comp", "mine", "size"))
        sig = np.frombuffer(b"".join(t["checks"].to_pylist()), np.uint8).reshape(-1, CHECKS)
        payload = t["payload"]
        apart = t["lo"][0] != t["hi"][0]
        parent: dict[int, int] = {}

        def find(c: int) -> int:
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        pairs = []
        for k in range(len(ids)):
            may = (comp != comp[k]) & (ids > ids[k]) & (100 * np.minimum(n, n[k]) >= percent * np.maximum(n, n[k]))
            if apart:
                may &= mine != mine[k]  # pairs inside a block meet in that block's own group
            at = np.flatnonzero(may)
            own = np.frombuffer(payload[k].as_py(), np.uint64) if len(at) else None
            for j in at[survivors(np.broadcast_to(sig[k], (len(at), CHECKS)), sig[at], least)].tolist() if len(at) else ():
                x, y = find(int(comp[k])), find(int(comp[j]))
                if x == y:
                    continue
                common = overlap(own, np.frombuffer(payload[j].as_py(), np.uint64))
                if 100 * common >= percent * (n[k] + n[j] - common):
                    parent[max(x, y)] = min(x, y)
                    pairs.append((ids[k], ids[j]))
        a, b = np.array(pairs, np.int64).reshape(-1, 2).T
        return pa.table({"a": a, "b": b})

    grouped = rows.withColumns({"lo": F.least("mine", "other"), "hi": F.greatest("mine", "other")}).groupBy("sig", "lo", "hi")
    return grouped.applyInArrow(meet, "a long, b long")


def near_components(spark: SparkSession, docs: DataFrame, size: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("own", F.xxhash64("text"))
    sets = stored(spark, document_sets(docs, size), "sets")
    groups = stored(spark, band_groups(spark, docs, size), "bands")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "own")).alias("first")
    named = sets.where("name is not null").groupBy("name").agg(first, F.min("doc_id").alias("least"))
    in_bands = groups.select("name").distinct()
    wanted = named.join(in_bands, "name").select(F.monotonically_increasing_id().alias("id"), "name", "first.doc_id", "first.own", "least")
    wanted = stored(spark, wanted, "wanted")
    items = wanted_items(spark, docs, wanted, size)
    # groups of the same members, whatever the band, are one group
    members = groups.join(wanted.select("name", "id"), "name").select("sig", "id")
    shape = members.groupBy("sig").agg(F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("shape"), F.count("*").alias("held"), F.min("id").alias("least"))
    once = shape.groupBy("shape", "held", "least").agg(F.min("sig").alias("sig"))
    members = stored(spark, members.join(once.select("sig", "held"), "sig"), "members")
    open_, links, comp = members.withColumn("comp", F.col("id")), None, None
    for turn in range(TURNS):
        draw = F.struct(F.xxhash64("id", F.lit(turn)), "id", "comp")
        pivot = open_.groupBy("sig").agg(F.min(draw).alias("pivot")).select("sig", F.col("pivot.id").alias("p"), F.col("pivot.comp").alias("own"))
        star = open_.join(pivot, "sig").where("comp <> own").select(F.least("p", "id").alias("a"), F.greatest("p", "id").alias("b")).distinct()
        found = verify(spark, star, items, percent)
        links = found if links is None else links.unionByName(found)
        comp = components(spark, links)
        sided = members.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        mixed = sided.groupBy("sig").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("sig")
        open_ = stored(spark, sided.join(mixed, "sig", "left_semi"), "open")
        if open_.isEmpty():
            break
    rest = stored(spark, block_links(open_.join(items, "id"), percent, block).distinct(), "links")
    if not rest.isEmpty():
        comp = components(spark, links.unionByName(rest))
    groups = wanted.join(comp, "id").select("name", "comp", "least")
    least = groups.groupBy("comp").agg(F.min("least").alias("component_id"))
    names = groups.join(least, "comp").select("name", F.lit(True).alias("linked"), "component_id")
    out = sets.join(names, "name", "left").join(named.select("name", F.col("least").alias("_least")), "name", "left")
    own = F.when(F.col("linked"), F.col("component_id")).when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("_least"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
