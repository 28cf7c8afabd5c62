"""Sets of 64-bit hashes as Bloom filters of bounded size, built by tasks and broadcast."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risklens.llm.shingles import mix

#: Bits of a filter for each hash, and at most.
BITS_EACH = 16
FILTER_BITS = 1 << 27


class Filter:
    """A set of hashes that may hold a few more: two bits of ``bits`` for each."""

    def __init__(self, bits: int, words: np.ndarray | None = None):
        self.bits, self.words = bits, np.zeros(bits // 64, np.uint64) if words is None else words

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return h % np.uint64(self.bits), mix(h ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(self.bits)

    def add(self, h: np.ndarray) -> None:
        for at in self.places(h):
            np.bitwise_or.at(self.words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))

    def holds(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in self.places(h):
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def bits_for(n: int, most: int = FILTER_BITS) -> int:
    return min(most, max(1 << 16, 1 << math.ceil(math.log2(max(1, n * BITS_EACH)))))


def broadcast_filter(spark: SparkSession, rows: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], bits: int):
    """A broadcast Filter with the hashes of ``rows``. Tasks set bits of their own, which
    are combined by 64-bit word of the filter: at most ``bits / 64`` rows arrive."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        own = Filter(bits)
        for b in batches:
            own.add(hashes(b))
        at = np.flatnonzero(own.words)
        for k in range(0, len(at), 100_000):
            part = at[k:k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(own.words[part].view(np.int64))], ["at", "word"])

    found = rows.mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[found["at"].to_numpy()] = found["word"].to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(Filter(bits, words))


def id_filter(spark: SparkSession, ids: DataFrame):
    """A broadcast Filter of ``ids`` (id): ids are hashes themselves."""
    return broadcast_filter(spark, ids.select("id"), lambda b: b.column(0).to_numpy().view(np.uint64), bits_for(ids.count()))
