"""Hand-computed feature cases."""

import pytest
from pyspark.sql import functions as F

from risklens.functions.expr import coerce_numeric, floor_week
from risklens.operators import features

SA = "id_assessment bigint, id_student bigint, score string"
AS = "id_assessment bigint, code_module string, code_presentation string, weight double"


def wavg(spark, scores, weights):
    sa = spark.createDataFrame(scores, SA)
    a = spark.createDataFrame(weights, AS)
    return {r.id_student: r.weighted_avg_score
            for r in features.weighted_avg_score(sa, a).collect()}


def test_weighted_score(spark):
    assert wavg(spark, [(1, 7, "80"), (2, 7, "60")],
                [(1, "M", "P", 50.0), (2, "M", "P", 50.0)]) == {7: 70.0}


def test_weighted_score_bad_score_counts_zero(spark):
    assert wavg(spark, [(1, 7, "80"), (2, 7, None)],
                [(1, "M", "P", 50.0), (2, "M", "P", 50.0)]) == {7: 40.0}
    assert wavg(spark, [(1, 7, "80"), (2, 7, "?")],
                [(1, "M", "P", 50.0), (2, "M", "P", 50.0)]) == {7: 40.0}


def test_weighted_score_zero_weight_and_unknown_assessment(spark):
    assert wavg(spark, [(1, 7, "90")], [(1, "M", "P", 0.0)]) == {7: 0.0}
    # an unknown assessment has no module: the row is dropped from grouping
    assert wavg(spark, [(9, 7, "90")], [(1, "M", "P", 10.0)]) == {}


VLE = "code_module string, code_presentation string, id_student bigint, date int, sum_click bigint"


def test_click_trend(spark):
    vle = spark.createDataFrame([("M", "P", 1, -14, 10), ("M", "P", 1, 0, 4), ("M", "P", 1, 35, 1),
                                 ("M", "P", 2, 3, 10), ("M", "P", 2, 5, 3)], VLE)
    got = {r.id_student: r.click_trend for r in features.click_trend(vle).collect()}
    assert got[1] == pytest.approx(-1.153846, abs=1e-6)
    assert got[2] == 0.0  # one active week


def test_week_number_floors_negative_days(spark):
    df = spark.createDataFrame([(d,) for d in (-8, -7, -1, 0, 6, 7)], "d int")
    assert [r.w for r in df.select(floor_week("d").alias("w")).collect()] == [-2, -1, -1, 0, 0, 1]


def test_vle_engagement_exact_distinct_days(spark):
    vle = spark.createDataFrame([("M", "P", 1, 5, 3), ("M", "P", 1, 5, 4), ("M", "P", 1, 9, 1),
                                 (None, "P", 1, 9, 100)], VLE).repartition(3)
    r = features.vle_engagement(vle).collect()
    assert len(r) == 1 and (r[0].sum_clicks, r[0].days_active, r[0].last_active_day) == (8, 2, 9)


def test_coerce_numeric(spark):
    vals = ["12.5", " 7 ", "5d", "nan", "abc", None, "1e2", "-3"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r.x for r in df.select(coerce_numeric("v").alias("x")).collect()]
    assert got == [12.5, 7.0, 0.0, 0.0, 0.0, 0.0, 100.0, -3.0]


def test_master_fills_missing_engagement(spark):
    info = spark.createDataFrame([("M", "P", 1, "F"), ("M", "P", 2, "M")],
                                 "code_module string, code_presentation string, id_student bigint, "
                                 "gender string")
    vle = spark.createDataFrame([("M", "P", 1, 0, 10), ("M", "P", 1, 1, 20)], VLE)
    m = {r.id_student: r for r in features.master_features(info, None, None, vle).collect()}
    assert m[1].avg_clicks_per_day == 15.0 and m[1].days_active == 2
    assert (m[2].sum_clicks, m[2].days_active, m[2].avg_clicks_per_day, m[2].click_trend,
            m[2].weighted_avg_score) == (0, 0, 0.0, 0.0, 0.0)
    assert F is not None
