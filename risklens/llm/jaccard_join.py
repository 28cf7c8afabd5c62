"""N-gram Jaccard join in metric space: pivots, Voronoi regions, windows.

Documents are sets of word shingles; 1 - Jaccard is a metric. Two documents
link when ``100 * intersection >= percent * union``.

Unrelated texts share nothing, so their distance to any pivot is exactly 1 and
no triangle inequality tells them apart. Regions are therefore opened from the
sets themselves: a set is cut into classes by a hash of its shingles, with one
class more than linked sets can differ in, so linked sets have an equal class.
Sets with an equal class form a region around the one of least id, its pivot
(in two steps, first in a task, then over all), and ``metric_join`` works the
regions out (distances to pivots, Voronoi cells, windows, recursion). Boundary
documents, whose region holds several components, meet again in finer regions:
by the rarest of their shingles, of which two linked sets share one among their
first ``size - needed overlap + 1``. Nothing is dropped, capped or sampled.

Details of the classes: sizes lie in shells, each ``100 / percent`` wider than
the last; ends of a link are in the same or in adjacent shells, so a set writes
the classes of its own shell and of the one below. Linked sets of a shell differ
in at most k shingles; with k + 1 + e classes they agree in e + 1 or more, and
a set with at most e thin classes has a full one among them (full: 2 shingles; 1 in
small sets, and where the threshold leaves classes under 3 shingles on average). Only
full classes are written: a thin one may hold nothing but a piece of a passage that
many texts quote. Where classes are small, those of common shingles alone are thin
too; shingles are counted over all documents in a table of fixed size first. (What
is thin follows from a class's content and hash only, so both ends agree on it; sets
of little but common shingles fall back on sizes.) A set with more thin classes also writes the
classes of a further hash, until it has no more than e. (Of two linked sets,
the one that needs fewer hashes proves it.)

Edge cases: no text or no words gives an empty set, linked with nothing;
fewer words than a shingle make one shingle of all; equal sets (copies) are one
item; null ids are kept as rows and count as no name for a component; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from risklens.llm.classes import star_pairs
from risklens.llm.common import batch_rows, bounded_batches, fresh, lean, stored, stored_parts
from risklens.llm.components import components
from risklens.llm.metric_join import WIDE_BLOCK, connect, filtered
from risklens.llm.shingles import mix, overlap, set_id, shingle_set

#: What near-duplicate stages take: words of a shingle, least similarity in percent.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: What the registered query takes.
QUERY_WORDS, QUERY_PERCENT = 4, 85
#: Below, sets can differ in so many shingles that too many of their classes stay empty.
LEAST_PERCENT = 80
#: (least size of a shell, least mean size of its classes, shingles that a class needs
#: to be written, thin classes allowed for each possible difference): where classes
#: are large they can be asked for more.
FULL = ((12, 3.0, 2, 0.16), (12, 0.0, 1, 0.5), (1, 0.0, 1, 0.05))
#: Cells of the table of shingle counts, and how many times the mean cell a common
#: shingle's cell holds. Classes of common shingles alone are thin in the first
#: PATIENCE hashes of a set.
CELLS = 1 << 16
COMMON = 16
PATIENCE = 2
#: Parts in which stars are measured and shingles counted: bounds what is on disk at once.
PORTIONS = 4
#: Signatures that a task holds before it writes them.
HELD = 1 << 18
#: Bytes of signatures for a byte of stored input, seen on prose; sizes partitions only.
SIGNATURE_RATIO = 2.0


def shells(percent: int, upto: int) -> list[int]:
    """Least sizes of the shells up to the one that holds ``upto``, and three more."""
    out = [1]
    while out[-1] <= upto:
        out.append(out[-1] * 100 // percent + 1)
    for _ in range(3):
        out.append(out[-1] * 100 // percent + 1)
    return out


class Signer:
    """Class signatures of sets for one threshold. ``common``: for each cell of the
    table of shingle counts, whether it is a common shingle's."""

    def __init__(self, percent: int, common: np.ndarray | None = None):
        if not LEAST_PERCENT <= percent <= 100:
            raise ValueError(f"the classes serve similarities from {LEAST_PERCENT} to 100 percent, not {percent}")
        self.percent, self.bounds, self.common = percent, shells(percent, 1 << 12), common
        self.edges = np.array(self.bounds)

    def plan(self, shell: int) -> tuple[int, int, int]:
        """Classes of a shell, how many of them may be thin, and what isn't thin."""
        total = self.bounds[shell + 1] + self.bounds[shell + 2] - 2
        k = (100 - self.percent) * total // (100 + self.percent)
        for least, mean, need, rate in FULL:
            spare = 0 if k == 0 else 1 + int(k * rate)
            if self.bounds[shell] >= max(least, mean * (k + 1 + spare)):
                break
        return k + 1 + spare, spare, need if k else 1

    def signatures(self, s: np.ndarray) -> np.ndarray:
        n = len(s)
        if n >= self.bounds[-3]:
            self.bounds = shells(self.percent, 2 * n)
            self.edges = np.array(self.bounds)
        own = int(np.searchsorted(self.edges, n, "right")) - 1
        mixed, out = mix(s), []
        own_words = None if self.common is None else ~self.common[cells(s)]
        for shell in {max(own - 1, 0), own}:
            classes, spare, need = self.plan(shell)
            seed = 0
            while True:
                odd = np.uint64((0xD6E8FEB86659FD93 + 2 * seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
                at = (((s ^ (s >> np.uint64(31))) * odd) >> np.uint64(24)) % np.uint64(classes)
                at = at.astype(np.int64)
                sums = np.zeros(classes, np.uint64)
                np.add.at(sums, at, mixed)
                held = np.bincount(at, minlength=classes) >= need
                if own_words is not None and seed < PATIENCE:
                    held &= np.bincount(at[own_words], minlength=classes) > 0
                full = np.flatnonzero(held)
                salt = np.uint64(((shell << 40) ^ (seed << 32)) & 0xFFFFFFFFFFFFFFFF)
                out.append(mix(mix(sums[full]) + full.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt))
                if classes - len(full) <= spare:
                    break
                seed += 1
        return np.concatenate(out)


def document_sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, own, id, n_shingles) of docs (doc_id, text, own): the set's name (null if
    empty) and size."""
    schema = pa.schema([("doc_id", pa.int64()), ("own", pa.int64()), ("id", pa.int64()), ("n_shingles", pa.int64())])

    def run(batches) -> Iterator[dict]:
        for b in batches:
            sets = [shingle_set(t, size) for t in b.column(1).to_pylist()]
            yield {"doc_id": b.column(0), "own": b.column(2), "id": [set_id(s) if len(s) else None for s in sets], "n_shingles": [len(s) for s in sets]}

    return docs.mapInArrow(batch_rows(run, schema), "doc_id long, own long, id long, n_shingles long")


def cells(shingles: np.ndarray) -> np.ndarray:
    return ((shingles * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(CELLS)


def common_cells(docs: DataFrame, size: int) -> np.ndarray:
    """For each cell, whether it holds a common shingle. Every task sums its documents'
    shingles first, so a task sends at most CELLS rows and the driver gets as many."""
    schema = pa.schema([("cell", pa.int64()), ("held", pa.int64())])

    def run(batches) -> Iterator[dict]:
        held = np.zeros(CELLS, np.int64)
        for b in batches:
            for t in b.column(1).to_pylist():
                np.add.at(held, cells(shingle_set(t, size)).astype(np.int64), 1)
        at = np.flatnonzero(held)
        yield {"cell": at, "held": held[at]}

    rows = docs.mapInArrow(batch_rows(run, schema), "cell long, held long").groupBy("cell").agg(F.sum("held").alias("held"))
    held = np.zeros(CELLS, np.int64)
    for r in rows.collect():
        held[r["cell"]] = r["held"]
    return held > COMMON * max(held.mean(), 1)


def star_pairs_of_sets(spark: SparkSession, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): a set shares a class with the pivot a."""
    far = Signer(percent)
    small_classes = far.plan(len(far.bounds) - 4)[2] < 2
    shared = spark.sparkContext.broadcast(common_cells(docs, size) if small_classes else None)  # CELLS bytes

    def signer():
        own = Signer(percent, shared.value)

        def named(text: str | None):
            s = shingle_set(text, size)
            if len(s):
                yield set_id(s), lambda: own.signatures(s)
        return named

    return star_pairs(spark, docs, signer, SIGNATURE_RATIO, HELD)


def rare_regions(spark: SparkSession, items: DataFrame, ids: DataFrame, percent: int) -> DataFrame:
    """(region, id, rest, n): the items ``ids`` by the rarest shingles of each.

    In one order of all shingles (by how many of these items hold them, then by
    value), two sets that link share a shingle among the first ``n - needed + 1``
    of each, where needed is the least possible overlap. ``rest`` counts the
    shingles from this one on. Shingles that one item holds come first in the
    order and lead nowhere, so they count but aren't written. The few more items that
    a filter of ``ids`` lets through are treated like them: regions only gain members.
    """
    schema = pa.schema([("id", pa.int64()), ("region", pa.int64())])

    def rows_of(portion: int) -> DataFrame:
        def run(batches) -> Iterator[dict]:
            for b in batches:
                for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    s = np.frombuffer(raw, np.int64)
                    s = s[s % PORTIONS == portion]
                    for k in range(0, len(s), 100_000):
                        part = s[k:k + 100_000]
                        yield {"id": np.full(len(part), i), "region": part}

        return mine.select("id", "payload").mapInArrow(batch_rows(run, schema), "id long, region long")

    mine = filtered(spark, items.select("id", "payload"), ids)

    def shared_in(portion: int) -> DataFrame:
        rows = rows_of(portion)
        held = stored(spark, rows.groupBy("region").agg(F.count("*").alias("held")).where("held > 1"), "held")
        return rows.join(held, "region")

    shared = stored_parts(spark, (shared_in(k) for k in range(PORTIONS)), "shared")
    own = Window.partitionBy("id")
    ranked = shared.withColumns({
        "rank": F.row_number().over(own.orderBy("held", "region")), "shared": F.count("*").over(own)})
    sizes = items.select("id", (F.length("payload") / 8).cast("long").alias("n"))
    few = ranked.withColumn("rest", F.col("shared") - F.col("rank") + 1).select("region", "id", "rest")
    needed = F.floor((F.col("n") * percent + 99) / 100)  # of the smallest partner that can link
    return few.join(sizes, "id").where(F.col("rest") >= needed).select("region", "id", "rest", "n")


def overlap_possible(percent: int):
    """What is left from the shared shingle on reaches the overlap that sizes ask for."""
    needed = F.ceil((F.col("x_n") + F.col("y_n")) * percent / (100 + percent) - 1e-6)
    return F.least("x_rest", "y_rest") >= needed


def overlap_possible_in(percent: int):
    """The same for arrays: row k with all."""
    def may_meet(columns: dict, k: int) -> np.ndarray:
        n, rest = columns["n"], columns["rest"]
        return np.minimum(rest, rest[k]) >= np.ceil((n + n[k]) * percent / (100 + percent) - 1e-6)
    return may_meet


def jaccard_distance(percent: int):
    def distance(x: bytes, y: bytes) -> tuple[bool, float]:
        a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        common = overlap(a, b)
        union = len(a) + len(b) - common
        return 100 * common >= percent * union, 1 - common / max(union, 1)
    return distance


def sketch(s: np.ndarray) -> bytes:
    """A set's size and, for each cell of a hash, the parity of its shingles there: some
    cells a shingle, so a sketch is a small part of its set."""
    bits = max(64, 1 << (len(s) - 1).bit_length())
    parity = np.bincount((mix(s) >> np.uint64(20)) & np.uint64(bits - 1), minlength=bits) & 1
    return len(s).to_bytes(8, "little") + np.packbits(parity.astype(bool), bitorder="little").tobytes()


def may_link(percent: int):
    """Every cell of different parity holds a shingle that one of the sets lacks, so links
    have no more such cells than shingles in which they may differ."""
    def may(x: bytes, y: bytes) -> bool:
        total = int.from_bytes(x[:8], "little") + int.from_bytes(y[:8], "little")
        a, b, size = int.from_bytes(x[8:], "little"), int.from_bytes(y[8:], "little"), 8 * (max(len(x), len(y)) - 8)
        least = 8 * (min(len(x), len(y)) - 8)
        if len(x) < len(y):
            a, b = b, a
        while size > least:  # the larger sketch has the smaller one's cells: its halves add up
            size //= 2
            a = (a >> size) ^ (a & ((1 << size) - 1))
        return (a ^ b).bit_count() * (100 + percent) <= total * (100 - percent)
    return may


def jaccard_components(spark: SparkSession, docs: DataFrame, size: int = NEAR_WORDS, percent: int = NEAR_PERCENT, small: int = WIDE_BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    return jaccard_groups(spark, docs, size, percent, small).select("doc_id", "n_shingles", "component_id")


def jaccard_groups(spark: SparkSession, docs: DataFrame, size: int, percent: int, small: int = WIDE_BLOCK) -> DataFrame:
    """(doc_id, id, comp, n_shingles, component_id) of every row of ``docs``: with the
    names of its set and of its group (null where the set is empty). Regions that one
    block holds are compared there; those with more than ``small`` members outside are cut."""
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("own", F.xxhash64("text"))
    sets = stored(spark, document_sets(docs, size), "sets")
    stars = stored(spark, star_pairs_of_sets(spark, docs, size, percent), "stars")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "own")).alias("first")
    named = sets.where("id is not null").groupBy("id").agg(first).select("id", "first.doc_id", "first.own")
    ends = stars.select(F.col("a").alias("id")).union(stars.select(F.col("b").alias("id"))).distinct()
    wanted = named.join(ends, "id")
    items = set_items(spark, docs, wanted, size)
    links = connect(spark, stars, items, jaccard_distance(percent), (100 - percent) / 100, float(np.log(100 / percent)),
                    lambda ids: rare_regions(spark, items, ids, percent), lambda: overlap_possible(percent), small,
                    may_meet=overlap_possible_in(percent), portions=PORTIONS, may=may_link(percent))
    comp = components(spark, links)
    groups = named.join(comp, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"), "doc_id")
    least = groups.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    names = groups.join(least, "comp").select("id", "comp", "component_id")
    return sets.join(names, "id", "left").select("doc_id", "id", "comp", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def set_items(spark: SparkSession, docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(id, payload, size, sketch) of the sets named by ``wanted`` (id, doc_id, own), read anew
    from one document of each, by its id and the hash of its text (so repeated and
    null ids meet no other texts); size is the logarithm of the set's size. The set's
    name, computed again, must be the wanted one; one row per set stays."""
    schema = pa.schema([("id", pa.int64()), ("payload", pa.binary()), ("size", pa.float64()), ("sketch", pa.binary())])

    def run(batches) -> Iterator[dict]:
        for b in batches:
            kept = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = shingle_set(t, size)
                if len(s) and set_id(s) == i:
                    kept.append((i, s))
            yield {"id": [i for i, _ in kept], "payload": [s.tobytes() for _, s in kept], "size": [float(np.log(len(s))) for _, s in kept],
                   "sketch": [sketch(s) for _, s in kept]}

    place = wanted.select("id", F.col("doc_id").alias("_doc"), F.col("own").alias("_own"))
    texts = docs.join(place, (F.col("own") == F.col("_own")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).select("id", "text")
    rows = texts.mapInArrow(batch_rows(run, schema), "id long, payload binary, size double, sketch binary")
    return stored(spark, rows.dropDuplicates(["id"]), "items")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), QUERY_WORDS, QUERY_PERCENT)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of linked documents (NEAR_WORDS, NEAR_PERCENT) one row
    stays, that of least id (null ids last, then by the set's name); empty ones all stay. Of
    rows equal in id and set any one stays. All columns come back, whatever their names;
    an empty table stays empty."""
    groups = stored(spark, jaccard_groups(spark, docs, NEAR_WORDS, NEAR_PERCENT).select("doc_id", "id", "comp"), "groups")
    mark, _id, _name = fresh("set"), fresh("id"), fresh("name")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "id")
    first = groups.where("id is not null").groupBy("comp").agg(F.min(rank).alias("first")).select(F.col("first.doc_id").alias(_id), F.col("first.id").alias(_name))
    held = groups.where("id is not null").groupBy(F.col("doc_id").alias(_id), F.col("id").alias(_name)).count().where("count > 1")
    empty = groups.where("id is null").select(F.col("doc_id").alias(_id), F.col("id").alias(_name)).distinct()
    kept = first.unionByName(empty)
    schema = StructType([*docs.schema.fields, StructField(mark, LongType())])
    at = docs.columns.index("text")

    def name(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, NEAR_WORDS) for t in b.column(at).to_pylist()]
            yield b.append_column(mark, pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()))

    rows = docs.mapInArrow(lean(name), schema)
    rows = rows.join(kept, rows["doc_id"].cast("long").eqNullSafe(kept[_id]) & rows[mark].eqNullSafe(kept[_name]), "left_semi")
    if not held.isEmpty():  # rows equal in id and set: one of them, whatever else they hold
        rows = rows.where(F.col(mark).isNull()).unionByName(rows.where(F.col(mark).isNotNull()).dropDuplicates(["doc_id", mark]))
    return rows.select(docs.columns)
