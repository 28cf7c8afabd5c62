"""Exact deduplication against a minimal perfect hash of historical digests.

``build_index`` groups the distinct historical digests into shards by their
first bytes and gives every shard a minimal perfect hash: level after level, a
digest whose position no other digest of the level takes is placed, and its
slot is the rank of its bit. Slots hold the full 32-byte digest, the winner's
locator and the group's size. ``lookup`` brings the distinct arriving digests
to their shard, computes the one possible slot and compares all 32 bytes;
members are repeats of history, the others group among themselves.

Skew: rows are reduced to one row per digest (map-side partial aggregates)
before any shard sees them, so a text that a third of all rows share is one
entry. The join of the result to the rows splits hot digests (AQE skew join).

Edge cases: a null text counts as empty; null ids never win against others and
a group of null ids alone keeps one row with a null ``keep_id``; of rows equal
in text and id exactly one is kept; empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risklens.llm.common import bounded_batches, fresh, stored

#: Mean number of digests in a shard; bounds the memory of a lookup group.
SHARD_DIGESTS = 8192
GAMMA = 2.0

INDEX_SCHEMA = "shard long, level_bits array<binary>, slots binary, winners array<long>, sizes array<long>"
FOUND_SCHEMA = "digest binary, slot long, keep_id long, group_size long"


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)


def _position(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where a level's hash puts each digest; digests are uniform already, a
    multiply and a shift per level make the levels independent."""
    odd = np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) & 0xFFFFFFFFFFFFFFFF)
    mixed = (words[:, level % 4] ^ (words[:, (level + 1) % 4] >> np.uint64(7 + level % 23))) * odd
    mixed ^= mixed >> np.uint64(32)
    return ((mixed * odd) >> np.uint64(20)) % np.uint64(size)


def build_levels(words: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays of the levels and the slot of every digest (a permutation)."""
    left, levels, slot, base = np.arange(len(words)), [], np.empty(len(words), np.int64), 0
    while len(left):
        size = max(int(GAMMA * len(left)), 2)
        at = _position(words[left], len(levels), size).astype(np.int64)
        bits = np.bincount(at, minlength=size) == 1
        alone = bits[at]
        rank = np.cumsum(bits) - 1
        slot[left[alone]] = base + rank[at[alone]]
        base += int(bits.sum())
        levels.append(bits)
        left = left[~alone]
    return levels, slot


def find_slots(words: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The only slot each digest could have, -1 where no level takes it."""
    slot, left, base = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    for n, bits in enumerate(levels):
        at = _position(words[left], n, len(bits)).astype(np.int64)
        hit = bits[at]
        slot[left[hit]] = base + (np.cumsum(bits) - 1)[at[hit]]
        base += int(bits.sum())
        left = left[~hit]
    return slot


def _pack(bits: np.ndarray) -> bytes:
    return len(bits).to_bytes(8, "little") + np.packbits(bits).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8, offset=8), count=int.from_bytes(raw[:8], "little")).astype(bool)


def _build_shard(table: pa.Table) -> pa.Table:
    words = _words(table["digest"].to_pylist())
    levels, slot = build_levels(words)
    order = np.argsort(slot)
    return pa.table({
        "shard": [table["shard"][0].as_py()],
        "level_bits": pa.array([[_pack(b) for b in levels]], pa.list_(pa.binary())),
        "slots": [words[order].tobytes()],
        "winners": pa.array([table["keep_id"].take(order).to_pylist()], pa.list_(pa.int64())),
        "sizes": pa.array([table["group_size"].take(order).to_pylist()], pa.list_(pa.int64()))})


def _lookup_shard(index: pa.Table, arriving: pa.Table) -> pa.Table:
    """History and arrivals of one shard, merged: one row per digest."""
    slots = np.frombuffer(index["slots"][0].as_py(), "<u8").reshape(-1, 4) if index.num_rows else np.empty((0, 4), "<u8")
    levels = [_unpack(b) for b in index["level_bits"][0].as_py()] if index.num_rows else []
    winners = index["winners"][0].as_py() if index.num_rows else []
    sizes = list(index["sizes"][0].as_py()) if index.num_rows else []
    digests = arriving["digest"].to_pylist()
    words = _words(digests)
    slot = find_slots(words, levels)
    sure = slot >= 0
    sure[sure] = (slots[slot[sure]] == words[sure]).all(axis=1)  # byte check: strangers share slots with members
    out = {"digest": [], "slot": [], "keep_id": [], "group_size": []}
    add = lambda *row: [c.append(v) for c, v in zip(out.values(), row)]
    for d, s, ok, k, n in zip(digests, slot.tolist(), sure.tolist(), arriving["keep_id"].to_pylist(), arriving["group_size"].to_pylist()):
        if ok:
            winners[s] = max((x for x in (winners[s], k) if x is not None), default=None)
            sizes[s] += n
        else:
            add(d, None, k, n)
    for s, (k, n) in enumerate(zip(winners, sizes)):
        add(slots[s].tobytes(), s, k, n)
    return pa.table({"digest": pa.array(out["digest"], pa.binary()), **{c: pa.array(out[c], pa.int64()) for c in ("slot", "keep_id", "group_size")}})


def with_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"))


def distinct_digests(rows: DataFrame) -> DataFrame:
    """One row per digest: the largest id and the number of rows."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def _sharded(distinct: DataFrame, shards: int) -> DataFrame:
    return distinct.withColumn("shard", F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long") % shards)


def build_index(spark: SparkSession, distinct: DataFrame, shards: int) -> DataFrame:
    """The index of ``distinct`` (digest, keep_id, group_size), written to the shared folder."""
    return stored(spark, _sharded(distinct, shards).groupBy("shard").applyInArrow(_build_shard, INDEX_SCHEMA), "mph")


def lookup(index: DataFrame, distinct: DataFrame, shards: int) -> DataFrame:
    """(digest, slot, keep_id, group_size) of every digest of the index or the
    arrivals; ``slot`` is null for nonmembers, which form groups of their own."""
    return _sharded(distinct, shards).groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(
        lambda a, i: _lookup_shard(i, a), FOUND_SCHEMA)


def exact_dedup(spark: SparkSession, history: DataFrame, arrivals: DataFrame) -> DataFrame:
    """One row per row of both: doc_id, digest, slot, keep_id, group_size, kept."""
    bounded_batches(spark)
    past = stored(spark, distinct_digests(with_digest(history)), "past")
    shards = max(1, -(-past.count() // SHARD_DIGESTS))
    index = build_index(spark, past, shards)
    found = lookup(index, distinct_digests(with_digest(arrivals)), shards)
    # rows equal in text and id are told apart by their number, so that one of them is kept
    rows = (with_digest(history).unionByName(with_digest(arrivals)).groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
            .select("digest", "doc_id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")))
    return rows.join(found, "digest").select(
        "doc_id", "digest", "slot", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"))


def split_history(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Older and newer rows of one table: ids up to the mean id are history,
    the rest (and null ids) arrive. Every row is in exactly one of them."""
    mean = docs.agg(F.avg("doc_id")).first()[0]
    old = F.coalesce(F.col("doc_id") <= F.lit(0.0 if mean is None else mean), F.lit(False))
    return docs.where(old), docs.where(~old)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(spark, *split_history(docs)).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       coalesce(row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1, false) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts the row with the largest id stays (of several
    rows with that id any one, of null ids one). Null counts as empty. All columns
    come back, whatever their names; an empty table stays empty."""
    history, arrivals = split_history(docs)
    own = fresh("key")
    key = lambda digest: F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), digest), 256)
    kept = exact_dedup(spark, history, arrivals).where("kept").select(key(F.lower(F.hex("digest"))).alias(own))
    keyed = docs.withColumn(own, key(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)))
    # rows equal in text and id: one of them, whatever their other columns
    return keyed.join(kept, own, "left_semi").dropDuplicates([own]).select(docs.columns)
