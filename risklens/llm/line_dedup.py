"""Line deduplication by a segment-partition edit join.

Lines (without outer white space) are equal, or near if at most ``edits`` edits
turn one into the other. A line is split into ``edits + 1`` even segments; a line
within that distance holds one of them unchanged, at a place that the segment's
number and the difference of lengths narrow down. So a line writes its own
segments (by length, number and text), and, for each length that a shorter or
equal partner may have, the substrings at those places. Lines that share such a
key form a region; ``metric_join`` measures them with a banded bit-parallel
automaton and joins the regions, for edit distance is a metric as well.

Shorter lines may differ in fewer edits, at the same rate (``edits`` of ``min_chars``
characters: one from 12 on, two from 24 on), for in few characters two edits make
another line; keys of each number of edits are written by the lengths that it serves.
Lines that not even one edit is due to are merged where equal. Of a class of equal and
near lines (all that links reach) the first occurrence, by document id and
line number, stays.

Edge cases: null texts have no lines; blank lines are never repeats and stay;
documents without ids come last in the order; rows equal in id are told apart by
their texts, and wholly equal rows are one document with one result each; documents
without lines have counts of 0 in the query's result; empty tables give empty results; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risklens.llm.classes import star_pairs
from risklens.llm.common import batch_rows, bounded_batches, stored
from risklens.llm.components import components
from risklens.llm.metric_join import connect

EDITS = 2
#: Characters from which all EDITS are allowed.
MIN_CHARS = 24
#: Regions with more lines outside their largest class are compared in blocks.
DIRECT = 24
#: Regions with more lines outside are cut: up to here the blocks' comparison of counts
#: costs no more than the distances to a cut's pivots.
SMALL = 1024
#: Counters of a line's characters, by code point.
COUNTERS = 64
#: Bytes of keys for a byte of stored input, seen on prose; sizes partitions only.
KEY_RATIO = 1.5


def lines_of(text: str | None) -> list[str]:
    return [x.strip() for x in text.split("\n")] if text else []


def line_id(line: str) -> int:
    h = xxhash.xxh3_64_intdigest(line.encode("utf-8"))
    return h - (1 << 64) if h >> 63 else h


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of the even segments; the last ones are longer by one."""
    parts = edits + 1
    short, longer = length // parts, length % parts
    sizes = [short] * (parts - longer) + [short + 1] * longer
    starts = [sum(sizes[:k]) for k in range(parts)]
    return list(zip(starts, sizes))


_WINDOWS: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}


def windows(length: int, edits: int) -> list[tuple[int, int, int, int]]:
    """(partner's length, segment number, place, segment length) of the substrings
    that a line of ``length`` probes: a segment moved by edits before it must
    leave as many for what is behind it (both ways of counting hold)."""
    known = _WINDOWS.get((length, edits))
    if known is None:
        known = []
        for other in range(max(length - edits, 0), length + 1):
            shift = length - other
            for k, (start, size) in enumerate(segments(other, edits)):
                low = max(0, start - k, start + shift - (edits - k))
                high = min(length - size, start + k, start + shift + (edits - k))
                known += [(other, k, place, size) for place in range(low, high + 1)]
        if len(_WINDOWS) > 20_000:
            _WINDOWS.clear()
        _WINDOWS[(length, edits)] = known
    return known


def line_keys(line: str, edits: int) -> np.ndarray:
    """Keys of the line's own segments and of the substrings it probes."""
    n, digest = len(line), xxhash.xxh3_64_intdigest
    spots = {(n, k, start, size) for k, (start, size) in enumerate(segments(n, edits))}
    raw = line.encode("utf-8")
    plain = len(raw) == n
    keys = {digest(raw[at:at + size] if plain else line[at:at + size].encode("utf-8"), other * 16 + k)
            for other, k, at, size in spots.union(windows(n, edits))}
    return np.fromiter(keys, np.uint64, len(keys))


def allowed(length: int, edits: int, min_chars: int) -> int:
    """Edits that may part two lines, the shorter of which has ``length`` characters."""
    return edits if length >= min_chars else length * edits // min_chars


def keys_of_all(line: str, edits: int, min_chars: int) -> np.ndarray:
    """``line_keys`` for each number of edits that a pair with this line may have."""
    n, out = len(line), []
    for e in range(max(allowed(max(n - edits, 0), edits, min_chars), 1), allowed(n, edits, min_chars) + 1):
        # for e edits the shorter line is allowed e, the longer one may be allowed more
        if allowed(max(n - e, 0), edits, min_chars) <= e:
            own = line_keys(line, e)
            out.append(own if e == edits else own ^ np.uint64(e * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return np.concatenate([*out, np.empty(0, np.uint64)])


def near(x: str, y: str, edits: int, min_chars: int) -> bool:
    e = allowed(min(len(x), len(y)), edits, min_chars)
    return within(x, y, e) <= e


def char_counts(lines) -> np.ndarray:
    """Counters of each line's characters. One edit changes them by at most 2 in all."""
    return np.array([np.bincount(np.frombuffer(x.encode("utf-32-le"), "<u4") % COUNTERS, minlength=COUNTERS) for x in lines], np.int32).reshape(-1, COUNTERS)


def within(x: str, y: str, edits: int) -> int:
    """Edit distance, or ``edits + 1`` if it is larger. An automaton over the band:
    for each number of edits a word of bits, one for each diagonal."""
    if abs(len(x) - len(y)) > edits:
        return edits + 1
    lead = 0
    stop = min(len(x), len(y))
    if x[:stop] == y[:stop]:
        lead = stop
    else:
        low, high = 0, stop  # the first difference, by halves
        while low < high:
            mid = (low + high) // 2
            if x[:mid + 1] == y[:mid + 1]:
                low = mid + 1
            else:
                high = mid
        lead = low
    x, y = x[lead:], y[lead:]
    if not x or not y:
        return max(len(x), len(y))
    at: dict[str, int] = {}
    for k, c in enumerate(y):
        at[c] = at.get(c, 0) | (1 << (k + edits))
    width = 2 * edits + 1
    band = (1 << width) - 1
    # bit d of a state: diagonal d - edits; insertions move up, deletions down
    states = [((1 << (e + 1)) - 1) << edits & band for e in range(edits + 1)]
    for i, c in enumerate(x):
        equal = (at.get(c, 0) >> i) & band
        new, before, above = [], 0, 0
        for e, s in enumerate(states):
            now = s & equal
            if e:
                now |= before | (before >> 1) | (above << 1)
            now &= band
            new.append(now)
            before, above = s, now
        states = new
        if not states[-1]:
            return edits + 1
    last = 1 << (len(y) - len(x) + edits)
    return next((e for e, s in enumerate(states) if s & last), edits + 1)


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_id, line_no, id) of every line that isn't blank."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_id", pa.int64()), ("line_no", pa.int64()), ("id", pa.int64())])

    def run(batches) -> Iterator[dict]:
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                name = line_id(t or "")
                rows += [(d, name, k, line_id(x)) for k, x in enumerate(lines_of(t)) if x]
            yield dict(zip(schema.names, zip(*rows))) if rows else {c: [] for c in schema.names}

    return docs.mapInArrow(batch_rows(run, schema), "doc_id long, text_id long, line_no long, id long")


def line_stars(spark: SparkSession, docs: DataFrame, edits: int, min_chars: int) -> DataFrame:
    def signer():
        def named(text: str | None):
            for x in lines_of(text):
                if allowed(len(x), edits, min_chars):
                    yield line_id(x), lambda x=x: keys_of_all(x, edits, min_chars)
        return named

    return star_pairs(spark, docs, signer, KEY_RATIO)


def line_items(spark: SparkSession, docs: DataFrame, rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, payload, size): texts and lengths of the lines ``ids``, each read from one document."""
    schema = pa.schema([("id", pa.int64()), ("payload", pa.string()), ("size", pa.float64())])
    place = rows.join(ids, "id").groupBy("id").agg(F.min_by(F.struct("doc_id", "text_id", "line_no"), F.struct("doc_id", "text_id", "line_no")).alias("at"))
    wanted = place.groupBy("at.doc_id", "at.text_id").agg(F.collect_list(F.struct("id", "at.line_no")).alias("lines"))  # no more than a text has

    def run(batches) -> Iterator[dict]:
        for b in batches:
            out = []
            for t, name, lines in zip(*(c.to_pylist() for c in b.columns)):
                if line_id(t or "") == name:
                    own = lines_of(t)
                    out += [(w["id"], own[w["line_no"]], float(len(own[w["line_no"]]))) for w in lines]
            yield dict(zip(schema.names, zip(*out))) if out else {c: [] for c in schema.names}

    texts = docs.withColumnRenamed("doc_id", "_doc").join(wanted, F.col("_doc").eqNullSafe(F.col("doc_id"))).select("text", "text_id", "lines")
    found = texts.mapInArrow(batch_rows(run, schema), "id long, payload string, size double")
    return stored(spark, found.dropDuplicates(["id"]), "lines")


def key_regions(items: DataFrame, ids: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """(region, id): the lines ``ids`` by each of their keys."""
    schema = pa.schema([("region", pa.int64()), ("id", pa.int64())])

    def run(batches) -> Iterator[dict]:
        for b in batches:
            keys = [keys_of_all(x, edits, min_chars).view(np.int64) for x in b.column(1).to_pylist()]
            yield {"region": np.concatenate([*keys, np.empty(0, np.int64)]), "id": np.repeat(np.array(b.column(0).to_pylist(), np.int64), [len(k) for k in keys])}

    return items.join(ids, "id").select("id", "payload").mapInArrow(batch_rows(run, schema), "region long, id long")


def line_classes(spark: SparkSession, docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows as ``line_rows``; (id, comp) of the lines that have near ones."""
    rows = stored(spark, line_rows(docs).distinct(), "linerows")
    stars = stored(spark, line_stars(spark, docs, edits, min_chars), "linestars")
    ends = stars.select(F.col("a").alias("id")).union(stars.select(F.col("b").alias("id"))).distinct()
    items = line_items(spark, docs, rows, ends)

    def distance(x: str, y: str) -> tuple[bool, float]:
        d = within(x, y, 3 * edits)  # cut off above: a metric still, with the same links
        return d <= allowed(min(len(x), len(y)), edits, min_chars), d

    links = connect(spark, stars, items, distance, edits, edits, lambda ids: key_regions(items, ids, edits, min_chars), None, small,
                    direct=DIRECT, linked=lambda x, y: near(x, y, edits, min_chars), counts=char_counts, apart=2 * edits)
    return rows, components(spark, links)


def dropped_lines(spark: SparkSession, docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, small: int = SMALL) -> DataFrame:
    """(doc_id, text_id, line_no, keep, first_doc, first_line) of every line: does it
    stay, and where is the line of its class that does?"""
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows, comp = line_classes(spark, docs, edits, min_chars, small)
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "text_id", "line_no")
    first = rows.groupBy("id").agg(F.min(rank).alias("rank")).join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    least = first.groupBy("comp").agg(F.min("rank").alias("least"))
    kept = first.join(least, "comp").select("id", "least")
    return rows.join(kept, "id").select("doc_id", "text_id", "line_no", (rank == F.col("least")).alias("keep"),
                                        F.col("least.doc_id").alias("first_doc"), F.col("least.line_no").alias("first_line"))


def document_names(docs: DataFrame) -> DataFrame:
    """(doc_id, text_id) of every document, also of those without lines."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_id", pa.int64())])

    def run(batches) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b.column(0), "text_id": [line_id(t or "") for t in b.column(1).to_pylist()]}

    return docs.mapInArrow(batch_rows(run, schema), "doc_id long, text_id long")


def line_counts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, dropped, kept) of every row of ``docs``; ``kept``: for
    each dropped line the place (doc_id, line_no) of the line of its class that stays."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    gone = F.sort_array(F.collect_list(F.when(~F.col("keep"), F.struct("line_no", "first_doc", "first_line"))))
    per = dropped_lines(spark, docs).groupBy(F.col("doc_id").alias("_doc"), F.col("text_id").alias("_text")).agg(F.count("*").alias("n_lines"), gone.alias("gone"))
    every = document_names(docs).join(per, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_id") == F.col("_text")), "left")
    none = F.expr("cast(array() as array<struct<line_no: bigint, first_doc: bigint, first_line: bigint>>)")
    return every.withColumn("gone", F.coalesce("gone", none)).select(
        "doc_id", F.coalesce("n_lines", F.lit(0).cast("long")).alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"),
        F.col("gone.line_no").alias("dropped"),
        F.transform("gone", lambda g: F.struct(g["first_doc"].alias("doc_id"), g["first_line"].alias("line_no"))).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_counts(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
