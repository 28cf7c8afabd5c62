"""Absent is told apart from unreadable; ids and codes keep their meaning."""

import uuid

import pytest
from pyspark.sql import functions as F

from risklens.operators.encode import apply_region_codes
from risklens.operators.registry import Registry
from risklens.session import shared_path
from risklens.sources.raw_csv import MissingSourceError, load_sources
from risklens.sources.state_store import StateStore


def test_unreadable_versions_raise_and_nothing_is_overwritten(spark):
    store = StateStore(spark, shared_path(spark, f"state-{uuid.uuid4().hex}"))
    assert store.current_version() is None
    store.init()
    path = store._versions_path()
    spark.range(1).selectExpr("'x' AS other").coalesce(1).write.mode("overwrite").text(path)
    with pytest.raises(Exception):
        store.current_version()
    with pytest.raises(Exception):
        store.init()


def test_absent_registry_is_empty(spark):
    assert Registry(spark, shared_path(spark, f"reg-{uuid.uuid4().hex}")).next_version() == 1


def test_history_ids_go_on(spark):
    store = StateStore(spark, shared_path(spark, f"state-{uuid.uuid4().hex}"))
    store.init()
    cols = {f.name: f.dataType for f in store.table("drift_log").schema if f.name != "id"}
    rows = spark.range(3).select(*[F.lit(None).cast(t).alias(c) for c, t in cols.items()])
    store.append("drift_log", rows)
    store.append("drift_log", rows)
    t = store.table("drift_log")
    assert t.count() == t.select("id").distinct().count() == 6


def test_absent_sources_raise(spark):
    with pytest.raises(MissingSourceError):
        load_sources(spark, shared_path(spark, f"none-{uuid.uuid4().hex}"))


def test_saved_region_codes_stay(spark):
    codes = spark.createDataFrame([("east", 0), ("north", 1), ("west", 2)], "region string, code int")
    for kind, values, want in (("string", ["2", "north", "9", None], [2, 1, 0, 0]), ("int", [1, 2, 9, None], [1, 2, 0, 0])):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"k int, region {kind}")
        got = [r.region for r in apply_region_codes(df, codes).orderBy("k").collect()]
        assert got == want
