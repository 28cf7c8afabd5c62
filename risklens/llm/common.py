"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from risklens.session import shared_path

#: Rows and bytes of one Arrow batch: documents may be long, so a batch of the
#: default 10,000 rows could outgrow a Python worker.
BATCH_ROWS = 1024
BATCH_BYTES = 16 << 20
#: Spark's setting that removes a query's shuffle files at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded_batches(spark: SparkSession) -> None:
    """Hold Arrow batches of whole texts to BATCH_ROWS rows and BATCH_BYTES bytes,
    and let Python workers import this package from the driver's place (a local
    session or a shared installation; an installed package needs no path)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def fresh(name: str) -> str:
    """A column name that no input has."""
    return f"_{name}_{uuid.uuid4().hex}"


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder in the shared checkpoint folder."""
    return shared_path(spark, f"llm-{tag}-{uuid.uuid4().hex}")


def stored(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and
    every executor can read it after another one is lost. The shuffle files of the
    write go with its end, for nothing reads them again."""
    return stored_parts(spark, [df], tag)


def stored_parts(spark: SparkSession, parts: Iterable[DataFrame], tag: str) -> DataFrame:
    """``stored`` for the union of tables of one schema, written one after the other
    to one folder: the shuffle files of one part at a time are on disk, and what reads
    the result scans one table."""
    path, before, schema = new_path(spark, tag), spark.conf.get(SHUFFLE_CLEANUP, "false"), None
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        for df in parts:
            df.write.mode("append").parquet(path)
            schema = schema or df.schema
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size of what ``df`` reads (file sizes for scans; leaves of
    unknown size, such as rows of the driver, count as nothing)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)


def partitions_for(spark: SparkSession, nbytes: float, target: int = 32 << 20) -> int:
    """Enough partitions to hold each one under ``target`` bytes, and no fewer
    than the session's own setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(nbytes / target), 1)


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """Give what Arrow holds for later use back at a task's end: Python workers live on
    beside the next stages' tasks, and what idle ones hold counts for the executor."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
    return task


def batch_rows(fn: Callable[[Iterable[pa.RecordBatch]], Iterator[dict]], schema: pa.Schema):
    """Adapt a generator of column dicts to what ``mapInArrow`` expects."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in fn(batches):
            yield pa.RecordBatch.from_arrays(
                [v if isinstance(v, pa.Array) else pa.array(v, schema.field(k).type) for k, v in cols.items()],
                schema=schema)
    return lean(run)
