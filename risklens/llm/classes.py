"""Regions of items that share a signature, as stars around pivots.

Signatures travel as packed blobs, some per task and bucket, not as rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from risklens.llm.common import batch_rows, input_bytes, partitions_for
from risklens.llm.shingles import mix

#: Signatures that a task holds before it writes blobs.
FLUSH = 1 << 20


def star_pairs(spark: SparkSession, docs: DataFrame, signer: Callable, ratio: float, flush: int = FLUSH) -> DataFrame:
    """(a, b): an item shares a signature with the pivot a, the least id that has it
    (or the least of its task, which in turn shares it with the least of all).

    ``signer()`` makes, once a task, a function from a text to its items' (id,
    function that gives the item's signatures). ``ratio``: bytes of signatures
    for a byte of input, to size partitions. ``flush``: signatures that a task holds before it writes them.
    """
    parts = partitions_for(spark, ratio * input_bytes(docs))
    buckets = 4 * parts
    entry = np.dtype([("sig", "<u8"), ("id", "<i8")])

    def star(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct (least id of the class, other id) of rows sorted by class and id."""
        pivot = rows["id"][np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))]
        pairs = np.stack([pivot, rows["id"]], axis=1)
        return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)

    def blobs_of(rows: np.ndarray, key: np.ndarray) -> Iterator[dict]:
        if len(rows):
            bucket = (mix(key) >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            yield {"bucket": bucket[np.r_[0, cuts]].astype(np.int64), "entries": [r.tobytes() for r in np.split(rows, cuts)]}

    def packed(sigs: list, ids: list) -> Iterator[dict]:
        """Of sets with an equal class only the least goes on to meet other tasks'
        sets; the others are its star here, so a hot class stays small."""
        if not sigs:
            return
        rows = np.empty(sum(map(len, sigs)), entry)
        rows["sig"], rows["id"] = np.concatenate(sigs), np.repeat(np.array(ids, np.int64), [len(s) for s in sigs])
        rows = rows[np.lexsort((rows["id"], rows["sig"]))]
        first = np.r_[True, rows["sig"][1:] != rows["sig"][:-1]]
        yield from blobs_of(rows[first], rows["sig"][first])
        pairs = star(rows, first)
        own = np.zeros(len(pairs), entry)
        own["sig"], own["id"] = pairs[:, 0].view(np.uint64), pairs[:, 1]
        for part in blobs_of(own, own["sig"]):
            yield part | {"bucket": -1 - part["bucket"]}  # pairs, not classes

    def sign(batches) -> Iterator[dict]:
        named, seen, sigs, ids, held = signer(), set(), [], [], 0
        for b in batches:
            for t in b.column(1).to_pylist():
                for name, signatures in named(t):
                    if name in seen:
                        continue  # a copy of an item of this task adds nothing
                    if len(seen) < FLUSH:
                        seen.add(name)
                    sigs.append(signatures())
                    ids.append(name)
                    held += len(sigs[-1])
                    if held >= flush:
                        yield from packed(sigs, ids)
                        sigs, ids, held = [], [], 0
        yield from packed(sigs, ids)

    def meet(batches) -> Iterator[dict]:
        raw: tuple[list, list] = ([], [])
        for t in batches:
            for bucket, x in zip(t.column(0).to_pylist(), t.column(1)):
                raw[bucket < 0].append(np.frombuffer(x.as_py(), entry))
        rows = np.concatenate(raw[0] or [np.empty(0, entry)])
        rows = rows[np.argsort(rows["sig"], kind="stable")]
        same = rows["sig"][1:] == rows["sig"][:-1]
        rows = rows[np.r_[same, False] | np.r_[False, same]] if len(rows) > 1 else rows[:0]
        rows = rows[np.lexsort((rows["id"], rows["sig"]))]
        pairs = star(rows, np.r_[True, rows["sig"][1:] != rows["sig"][:-1]]) if len(rows) else np.empty((0, 2), np.int64)
        local = np.concatenate(raw[1] or [np.empty(0, entry)])
        pairs = np.unique(np.concatenate([pairs, np.stack([local["sig"].view(np.int64), local["id"]], axis=1)]), axis=0)
        for k in range(0, len(pairs), 100_000):
            yield {"a": pairs[k:k + 100_000, 0], "b": pairs[k:k + 100_000, 1]}

    blobs = docs.mapInArrow(batch_rows(sign, pa.schema([("bucket", pa.int64()), ("entries", pa.binary())])), "bucket long, entries binary")
    pairs = blobs.repartition(parts, "bucket").mapInArrow(batch_rows(meet, pa.schema([("a", pa.int64()), ("b", pa.int64())])), "a long, b long")
    return pairs.distinct()
