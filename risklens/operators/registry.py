"""Model registry: K7 metadata rows, M16 compare, M17 backup / rollback, S7.

Models live in immutable version folders; the registry is an append-only
table of events (trained, activated, rolled back). The active version is
the newest activation - rolling back appends a row, nothing is copied.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window

from risklens.session import path_missing

REGISTRY_SCHEMA = ("version int, event string, event_time timestamp, training_date timestamp, "
                   "accuracy double, f1_score double, num_samples bigint, num_features int, "
                   "feature_names array<string>, class_names array<string>, "
                   "confusion_matrix array<array<bigint>>, classification_report string, "
                   "data_source string, path string")


def compare_versions(evals: DataFrame, version: str = "version") -> DataFrame:
    """Each version against the previous one (lag over the registry,
    which has one row per trained version)."""
    w = Window.orderBy(version)
    return evals.select(
        version, "accuracy", "f1_score",
        F.lag("accuracy").over(w).alias("old_accuracy"),
        F.lag("f1_score").over(w).alias("old_f1_score"),
        (F.col("accuracy") - F.lag("accuracy").over(w)).alias("accuracy_delta"),
        (F.col("f1_score") - F.lag("f1_score").over(w)).alias("f1_delta"))


class Registry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = f"{self.root}/_registry"

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(REGISTRY_SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if not path_missing(e):  # unreadable isn't absent
                raise
            return self.spark.createDataFrame([], REGISTRY_SCHEMA)

    def next_version(self) -> int:
        row = self.read().agg(F.max("version").alias("v")).first()
        return (row.v or 0) + 1

    def model_path(self, version: int) -> str:
        return f"{self.root}/v{version:05d}"

    def append(self, version: int, event: str, meta: dict | None = None) -> None:
        meta = dict(meta or {})
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        row = {"version": version, "event": event, "event_time": now,
               "training_date": meta.get("training_date"),
               "accuracy": meta.get("accuracy"), "f1_score": meta.get("f1_score"),
               "num_samples": meta.get("num_samples"), "num_features": meta.get("num_features"),
               "feature_names": meta.get("feature_names"), "class_names": meta.get("class_names"),
               "confusion_matrix": meta.get("confusion_matrix"),
               "classification_report": meta.get("classification_report"),
               "data_source": meta.get("data_source"),
               "path": meta.get("path") or self.model_path(version)}
        df = self.spark.createDataFrame([row], REGISTRY_SCHEMA)
        df.coalesce(1).write.mode("append").parquet(self.path)

    def current(self) -> DataFrame:
        """The active version's metadata (missing metrics -> 0)."""
        reg = self.read()
        active = reg.where(F.col("event").isin("activated", "rolled_back")).agg(
            F.max_by("version", "event_time").alias("version"))
        trained = reg.where(F.col("event") == "trained")
        return trained.join(active, "version").select(
            "version", F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"),
            F.coalesce("f1_score", F.lit(0.0)).alias("f1_score"),
            F.coalesce("num_samples", F.lit(0)).alias("num_samples"),
            "training_date", "path")

    def active_version(self) -> int | None:
        row = self.current().select("version").first()
        return row.version if row else None

    def previous_version(self) -> int | None:
        """The version that was active before the current one."""
        reg = self.read().where(F.col("event").isin("activated", "rolled_back"))
        cur = reg.agg(F.max_by("version", "event_time").alias("v")).first().v
        if cur is None:
            return None
        # newest activation of any other version
        return reg.where(F.col("version") != cur).agg(
            F.max_by("version", "event_time").alias("v")).first().v

    def rollback(self) -> int | None:
        """Re-activate the previous version (appends an event)."""
        prev = self.previous_version()
        if prev is not None:
            self.append(prev, "rolled_back")
        return prev
