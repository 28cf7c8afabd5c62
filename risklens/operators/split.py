"""W7 stratified split and A18 class weights.

A row is in the test set when its rank inside its class, ordered by
md5(id || '-' || seed), is at most round(fraction * class size). That is the
same as ``row_number() over (partition by class order by hash)``, but a
window partitioned by class alone would put a whole class (a third of all
rows, say) into one task. Instead:

1. count rows per (class, bucket) where bucket = the first 16 bits of the
   hash (partial aggregate; at most 65,536 buckets per class),
2. prefix-sum the bucket counts inside each class (window over the bucket
   table, bounded by classes x 65,536 rows),
3. rank rows inside their (class, bucket) - hash-uniform, small groups -
   and add the bucket's offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from risklens import constants as C

BUCKET_HEX = 4  # 16-bit hash prefix


def split_hash(id_col: str, seed: int = C.SEED) -> F.Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"-{seed}")))


def stratified_split(df: DataFrame, label: str, id_col: str,
                     fraction: float = C.TEST_FRACTION, seed: int = C.SEED) -> DataFrame:
    """Adds ``is_test`` (boolean); exact per-class test size."""
    h = split_hash(id_col, seed)
    rows = df.withColumn("_h", h).withColumn(
        "_b", F.conv(F.substring("_h", 1, BUCKET_HEX), 16, 10).cast("int"))
    counts = rows.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    by_class = Window.partitionBy(label)
    cum = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        label, "_b",
        F.coalesce(F.sum("_cnt").over(cum), F.lit(0)).alias("_before"),
        F.round(F.sum("_cnt").over(by_class) * F.lit(float(fraction))).alias("_k"))
    # a student may sit in several modules
    ties = [c for c in ("code_module", "code_presentation") if c in df.columns and c != label]
    # classes x 65,536 rows at most: a proven bound for a broadcast
    ranked = rows.join(F.broadcast(offsets), [label, "_b"]).withColumn(
        "_rn", F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", id_col, *ties)))
    return ranked.withColumn("is_test", (F.col("_before") + F.col("_rn")) <= F.col("_k")).drop(
        "_h", "_b", "_before", "_k", "_rn")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, count, weight) with weight = n / (k * n_c) ("balanced")."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    all_ = Window.partitionBy()
    return counts.select(label, "count",
                         (F.sum("count").over(all_) /
                          (F.count(F.lit(1)).over(all_) * F.col("count"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str, weight_col: str = "weight") -> DataFrame:
    """Attach the balanced weight of each row's class (class table: one row
    per class, broadcast)."""
    w = class_weights(df, label).select(label, F.col("weight").alias(weight_col))
    return df.join(F.broadcast(w), label)
