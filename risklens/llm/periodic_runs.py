"""Periodic runs of words, solved on tiles by period octave and stitched.

A run is a stretch of consecutive words with smallest period q that no neighbour
extends keeping q, at least ``max(MIN_WORDS, MIN_REPEATS * q)`` words long. With
``e[i]`` true where word i equals word i + q, it is a stretch of true e of
``length - q`` places.

* The periods from 2**k to 2**(k+1) - 1 are octave k. A document of more than
  ``WHOLE`` words is exploded into tiles: those of octave k hold at least ``8 * 2**k``
  words of their own and the ``2 * 2**k`` that follow; octaves whose tiles would be
  shorter than ``WHOLE`` share one. Tiles travel as word numbers and are dealt over
  all tasks, so a very long document isn't one task's work.
* A tile is solved alone. A run that begins in it holds several of the boundaries
  that stand 2**k words apart, so the Z-functions of the text after and before each
  boundary, at the octave's periods, find it: most of these values are 0, and one
  comparison of the words at all boundaries and periods shows which aren't; what is
  left is extended word by word, or by the linear Z-algorithm at a boundary where
  more than ``DENSE`` periods are left.
* Stretches that end inside their tile are whole. Those that touch a tile's edge are
  fragments; they are shuffled by (document, period) and stitched where they touch
  or overlap. By the theorem of Fine and Wilf the smaller period of a stretch of four
  periods divides them and has the same interval, so of equal intervals the smallest
  period stays.
* A document of at most ``WHOLE`` words is its own tile in all octaves: its stretches
  have no edges to stitch, and it never leaves its task.

Edge cases: no text and no words give no runs and an empty collapsed text; rows with
null or repeated ids are rows of their own (equal rows get equal results); empty
tables give empty results; other columns are ignored. Words are compared as such,
not by hashes.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from risklens.llm.common import batch_rows, bounded_batches, input_bytes, partitions_for

MIN_WORDS = 6
MIN_REPEATS = 4
#: Words of a document that is one tile.
WHOLE = 4096
#: Periods left at a boundary from which on the linear algorithm takes over.
DENSE = 64
#: Boundary-period pairs that are compared at once.
SLAB = 1 << 20

RUNS = "array<struct<start:long,length:long,period:long>>"
RESULT = f"doc_id long, n_words long, runs {RUNS}, collapsed string"
#: Bytes of tiles for a byte of stored input; sizes partitions only.
TILE_RATIO = 2.0


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+``, in UTF-8."""
    return (text or "").encode("utf-8").split()


def numbered(words: list[bytes], numbers: Iterator[int] | None = None) -> np.ndarray:
    """A number for each word, equal for equal words."""
    seen: defaultdict = defaultdict((numbers or count()).__next__)
    return np.array(list(map(seen.__getitem__, words)), np.int32)


def z_function(x: list) -> list[int]:
    """z[i]: length of the longest common prefix of x and x[i:]."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _agree(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the common prefix of two arrays of one length."""
    at, step = 0, 64
    while at < len(x):
        odd = np.flatnonzero(x[at:at + step] != y[at:at + step])
        if len(odd):
            return at + int(odd[0])
        at, step = at + step, 8 * step
    return len(x)


def _dense(w: np.ndarray, m: int, periods: list[int], reach: int) -> Iterator[tuple[int, int, int]]:
    """(q, first, end) of the stretch around boundary m for each period, cut at
    ``reach`` words on either side, by two Z-functions."""
    top = min(max(periods), len(w) - m)
    ahead = w[m:m + reach + top].tolist()
    forward = z_function(ahead)
    behind = w[max(0, m - reach):m][::-1].tolist()
    back = z_function(behind + [-1] + w[max(0, m - reach):m + top][::-1].tolist())
    # the words before m + q, backwards, stand in `back` this far behind its separator
    for q in periods:
        yield q, m - min(back[len(behind) + 1 + top - q], len(behind)), m + forward[q]


def octave_stretches(w: np.ndarray, octave: int, core: int, first: bool, last: bool, limit: int) -> list[tuple[int, int, int]]:
    """(period, first place, end) of stretches of true e in a tile: whole ones that
    are long enough for a run, and fragments at the tile's edges.

    ``core``: the tile's own words, the rest are those that follow. ``first``,
    ``last``: whether the document begins and ends with the tile. ``limit``: the
    longest period that the document can repeat often enough.
    """
    step, n = 1 << octave, len(w)
    periods = np.arange(step, min(2 * step - 1, limit, n - 1) + 1)
    if not len(periods):
        return []
    bounds = np.arange(0, min(core, n - 1) + 1, step)
    if not last and core < n and bounds[-1] != core:
        bounds = np.append(bounds, core)
    x, y = (np.concatenate([w, np.full(4 * step + 8, odd, w.dtype)]) for odd in (-1, -2))
    found: dict[int, list[list[int]]] = {}
    slab = max(1, SLAB // len(periods))
    # a run's first boundary has at least 2 * step + 1 places of it ahead
    ahead = sorted({min(t, 2 * step) for t in (1, 2, 3, step, 2 * step)})
    for k in range(0, len(bounds), slab):
        own = bounds[k:k + slab]
        at, by = np.nonzero(y[own[:, None] + periods] == x[own][:, None])
        at, by = own[at], periods[by]
        edge = np.zeros(len(at), bool) if first else at == 0
        if not last:
            edge |= at == core
        for t in ahead:
            keep = edge | (x[at + t] == y[at + by + t])
            at, by, edge = at[keep], by[keep], edge[keep]
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
        for x0, x1 in zip(cuts[:-1], cuts[1:]) if len(at) else ():
            m = int(at[x0])
            # near the end that is known, for `_dense` may have cut the stretch there
            left = [q for q in by[x0:x1].tolist() if q not in found or found[q][-1][1] <= m + 2 * step]
            if len(left) > DENSE:
                spans = _dense(w, m, left, 8 * step)
            else:
                spans = ((q, m - _agree(w[:m][::-1], w[q:m + q][::-1]), m + _agree(w[m:n - q], w[m + q:n])) for q in left)
            for q, a, b in spans:
                mine = found.setdefault(q, [])
                if mine and a <= mine[-1][1]:
                    mine[-1] = [min(a, mine[-1][0]), max(b, mine[-1][1])]
                else:
                    mine.append([a, b])
    out = []
    for q, spans in found.items():
        for a, b in spans:
            cut = (a == 0 and not first) or (b == n - q and not last)
            if (b - a >= max((MIN_REPEATS - 1) * q, MIN_WORDS - q) or cut) and not _repeats(w[a:a + q] if b - a >= q else None):
                out.append((q, a, b))
    return out


def _repeats(block: np.ndarray | None) -> bool:
    """Is a period's block itself a repetition?"""
    if block is None:
        return False
    q, rest, f = len(block), len(block), 2
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f == 0:
            d = q // f
            if (block[d:] == block[:-d]).all():
                return True
            while rest % f == 0:
                rest //= f
        f += 1
    return False


def whole_runs(docs: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each document, every one a tile of its
    own. They lie one behind the other, longest first, with no number in common, so
    no run leaves its document and an octave reads only those that are long enough."""
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    numbers = count()
    w = np.concatenate([numbered(docs[i], numbers) for i in order] or [np.empty(0, np.int32)])
    sizes = [len(docs[i]) for i in order]
    starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    least: list[dict[tuple[int, int], int]] = [{} for _ in docs]
    for octave in range((max(sizes, default=0) // MIN_REPEATS).bit_length()):
        upto = int(starts[sum(n >= max(MIN_WORDS, MIN_REPEATS << octave) for n in sizes)])
        spans = octave_stretches(w[:upto], octave, upto, True, True, upto)
        for (q, a, b), own in zip(spans, np.searchsorted(starts, [a for _, a, _ in spans], "right") - 1):
            key = (a - int(starts[own]), b - a + q)
            mine = least[order[own]]
            mine[key] = min(q, mine.get(key, q))
    return [sorted((a, length, q) for (a, length), q in own.items()) for own in least]


def tiles(n: int, whole: int = WHOLE) -> Iterator[tuple[int, int, int, int, int]]:
    """(first octave, last octave, first word, own words, all words) of the tiles
    of a document of n words."""
    last = (n // MIN_REPEATS).bit_length() - 1
    shared = min(last, (whole >> 3).bit_length() - 1)
    for lo, hi in [(0, shared)] + [(k, k) for k in range(shared + 1, last + 1)]:
        own = max(whole, 8 << hi)
        for at in range(0, n, own):
            yield lo, hi, at, min(own, n - at), min(own + (2 << hi), n - at)


def collapse(words: list[bytes], runs: list) -> str:
    """The words joined by one space, without those that a run holds behind its
    first period."""
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist() if runs else range(len(words))
    return b" ".join([words[i] for i in kept]).decode("utf-8")


def periodic_runs(spark: SparkSession, docs: DataFrame, alter: Callable[[int | None, list], list] | None = None,
                  whole: int = WHOLE) -> DataFrame:
    """doc_id, n_words, runs (by start, then period), collapsed of every row of
    ``docs``. ``alter(doc_id, words)``: other words to take for a document's.
    ``whole``: words of a document that is one tile."""
    bounded_batches(spark)
    alter = alter or (lambda _, words: words)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # n words need at least 2 n - 1 bytes
    brief = F.coalesce(F.octet_length("text"), F.lit(0)) < 2 * whole
    short, long = docs.where(brief), docs.where(~brief)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()),
                        ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                        ("collapsed", pa.string())])

    def result(ids: list, each: list[tuple[list, list]]) -> dict:
        return {"doc_id": ids, "n_words": [len(w) for w, _ in each],
                "runs": [[{"start": s, "length": n, "period": q} for s, n, q in runs] for _, runs in each],
                "collapsed": [collapse(w, runs) for w, runs in each]}

    def alone(batches) -> Iterator[dict]:
        for b in batches:
            ids = b.column(0).to_pylist()
            words = [alter(i, words_of(t)) for i, t in zip(ids, b.column(1).to_pylist())]
            yield result(ids, list(zip(words, whole_runs(words))))

    name = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text"), 256)
    long = long.withColumn("key", name)
    tile = pa.schema([("key", pa.string()), ("n", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("at", pa.int64()), ("core", pa.int64()), ("words", pa.binary())])

    def explode(batches) -> Iterator[dict]:
        for b in batches:
            for i, t, key in zip(*(b.column(k).to_pylist() for k in range(3))):
                w = numbered(alter(i, words_of(t)))
                w = w.astype(np.uint16) if not len(w) or w.max() < 1 << 16 else w
                each = list(tiles(len(w), whole))
                for k in range(0, len(each), 64):
                    part = each[k:k + 64]
                    yield {"key": [key] * len(part), "n": [len(w)] * len(part), "lo": [x[0] for x in part], "hi": [x[1] for x in part],
                           "at": [x[2] for x in part], "core": [x[3] for x in part], "words": [w[x[2]:x[2] + x[4]].tobytes() for x in part]}

    piece = pa.schema([("key", pa.string()), ("period", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def solve(batches) -> Iterator[dict]:
        for b in batches:
            keys, spans = [], []
            for key, n, lo, hi, at, core, raw in zip(*(b.column(k).to_pylist() for k in range(7))):
                held = min(core + (2 << hi), n - at)
                w = np.frombuffer(raw, np.uint16 if len(raw) == 2 * held else np.int32).astype(np.int32)
                for k in range(lo, hi + 1):
                    own = octave_stretches(w, k, core, at == 0, at + held >= n, n // MIN_REPEATS)
                    spans += [(q, x + at, y + at) for q, x, y in own]
                    keys += [key] * len(own)
            yield {"key": keys, "period": [s[0] for s in spans], "a": [s[1] for s in spans], "b": [s[2] for s in spans]}

    exploded = long.select("doc_id", "text", "key").mapInArrow(batch_rows(explode, tile), "key string, n long, lo int, hi int, at long, core long, words binary")
    dealt = exploded.repartition(partitions_for(spark, TILE_RATIO * input_bytes(docs)), "key", "lo", "at")
    pieces = dealt.mapInArrow(batch_rows(solve, piece), "key string, period long, a long, b long")
    stitched = stitch(pieces)
    runs = stitched.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))

    def finish(batches) -> Iterator[dict]:
        for b in batches:
            ids = b.column(0).to_pylist()
            each = [(alter(i, words_of(t)), [(r["start"], r["length"], r["period"]) for r in own or []])
                    for i, t, own in zip(ids, b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield result(ids, each)

    out = short.mapInArrow(batch_rows(alone, schema), RESULT)
    return out.unionByName(long.join(runs, "key", "left").select("doc_id", "text", "runs").mapInArrow(batch_rows(finish, schema), RESULT))


def stitch(pieces: DataFrame) -> DataFrame:
    """(key, start, length, period) of runs from fragments (key, period, a, b): those
    of a document and period that touch or overlap are one."""
    mine = Window.partitionBy("key", "period").orderBy("a", "b")
    before = F.max("b").over(mine.rowsBetween(Window.unboundedPreceding, -1))
    cut = pieces.distinct().withColumn("new", (before.isNull() | (F.col("a") > before)).cast("int"))
    part = cut.withColumn("part", F.sum("new").over(mine.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = part.groupBy("key", "period", "part").agg(F.min("a").alias("start"), F.max("b").alias("end"))
    whole = whole.withColumn("length", F.col("end") - F.col("start") + F.col("period"))
    long = whole.where((F.col("length") >= MIN_WORDS) & (F.col("length") >= MIN_REPEATS * F.col("period")))
    return long.groupBy("key", "start", "length").agg(F.min("period").alias("period"))


def planted(doc_id: int | None, words: list) -> list:
    """The query's words: by a hash of its id, every tenth document repeats a piece of
    itself from some word on (a null id has no hash and changes nothing)."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def digests(found: DataFrame) -> DataFrame:
    """The query's columns: the run of greatest exponent (exactly compared; ties to
    the smallest start, then period) and digests of all runs and of the collapsed text."""
    def greater(x, y):
        left, right = x["length"] * y["period"], y["length"] * x["period"]
        return (F.when(left > right, -1).when(left < right, 1)
                .when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1)
                .when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0))

    best = F.get(F.array_sort("runs", greater), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), planted))
