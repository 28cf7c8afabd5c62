"""Spark session defaults and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC timestamps (state tables hold ISO times),
# AQE so joins re-plan on runtime sizes and skewed partitions are split,
# and an explicit broadcast limit so Spark only broadcasts a side whose
# measured size is below it (otherwise it falls back to a shuffle join).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "risklens", extra: dict | None = None) -> SparkSession:
    """A session with the defaults above. The master comes from spark-submit
    unless given (local[*] when neither says); the partition count stays with
    the cluster's own setting unless given."""
    master = master or SparkConf().get("spark.master", "local[*]")
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is. Only when it is unset (local tests) a scratch folder is created.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not current:
        current = tempfile.mkdtemp(prefix="risklens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def path_missing(error: Exception) -> bool:
    """Does the error say that a path isn't there? Any other read error must be raised."""
    get = getattr(error, "getCondition", None) or getattr(error, "getErrorClass", lambda: "")
    return (get() or "").startswith("PATH_NOT_FOUND")


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder (for written lineage cuts)."""
    return os.path.join(ensure_checkpoint_dir(spark), *parts)


def run_dir(spark: SparkSession, kind: str) -> str:
    """A new folder under the shared one, for one run."""
    return shared_path(spark, "risklens", "runs", f"{kind}-{uuid.uuid4().hex[:12]}")


def stored(df: DataFrame, kind: str = "stored") -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and a
    lineage cut that survives lost executors."""
    path = run_dir(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
