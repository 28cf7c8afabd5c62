"""Encoding, label index, evaluation metrics, soft vote and top-3 ranking."""

import pytest
from pyspark.sql import functions as F

from risklens import constants as C
from risklens.operators import attribution, encode, metrics
from risklens.operators.ensemble import soft_vote


def test_encode_defaults(spark):
    df = spark.createDataFrame([("X", "?", None, "0-35", "Y", "East"),
                                ("F", "HE Qualification", "10-20", "55<=", "N", "West"),
                                ("1", "3", "7", "2", "1", "East")],
                               "gender string, highest_education string, imd_band string, "
                               "age_band string, disability string, region string")
    rows = encode.encode_demographics(df).collect()
    got = sorted((r.gender, r.highest_education, r.imd_band, r.age_band, r.disability, r.region)
                 for r in rows)
    assert got == sorted([(1, 3, 7, 2, 1, 0), (1, 3, 1, 2, 0, 1), (0, 1, 5, 0, 1, 0)])
    strict = encode.encode_demographics(df, accept_codes=False).where(F.col("age_band") == 0)
    assert strict.count() == 2  # "2" is not a text category when strict


def test_encode_target_drops_unknown(spark):
    df = spark.createDataFrame([(o,) for o in ("Distinction", "Pass", "Withdrawn", "Fail", "Unknown")],
                               "final_result string")
    got = [r.final_result for r in encode.encode_target(df).collect()]
    assert got == ["Excelling", "On Track", "Moderate Risk", "High Risk"]


def test_label_index_alphabetical(spark):
    df = spark.createDataFrame([(c,) for c in C.LABEL_ORDER], "final_result string")
    assert {r.final_result: r.label for r in encode.label_index(df).collect()} == {
        "Excelling": 0.0, "High Risk": 1.0, "Moderate Risk": 2.0, "On Track": 3.0}


def golden_rows(spark):
    """The stored evaluation: confusion matrix rows actual, cols predicted."""
    cm = [[59, 0, 0, 1], [0, 99, 1, 0], [0, 1, 99, 0], [0, 0, 1, 139]]
    rows = [(C.LABEL_ORDER[i], C.LABEL_ORDER[j]) for i in range(4) for j in range(4)
            for _ in range(cm[i][j])]
    return spark.createDataFrame(rows, "actual string, predicted string"), cm


def test_metrics_golden_case(spark):
    df, cm = golden_rows(spark)
    assert metrics.accuracy(df).first().accuracy == pytest.approx(0.99)
    assert round(metrics.macro_f1(df).first().macro_f1, 4) == 0.9899
    got = metrics.confusion_matrix(df).collect()
    for r in got:
        assert r["count"] == cm[r.row_idx][r.col_idx]
    rep = {r.row_label: r for r in metrics.classification_report(df).collect()}
    assert round(rep["Excelling"].precision, 2) == 1.00 and round(rep["Excelling"].recall, 2) == 0.98
    assert rep["accuracy"].support == 400 and rep["accuracy"].f1_score == pytest.approx(0.99)


def test_soft_vote(spark):
    df = spark.createDataFrame([([.6, .2, .1, .1], [.1, .7, .1, .1])],
                               "a array<double>, b array<double>")
    r = soft_vote(df, ["a", "b"]).first()
    assert r.prediction == 1 and r.risk_level == "High Risk"
    assert r.confidence_score == pytest.approx(0.45)


def test_top3_ties_by_feature_order(spark):
    vals = spark.createDataFrame([(1, 0, "sum_clicks", .2), (1, 1, "days_active", -.5),
                                  (1, 2, "click_trend", .2), (1, 3, "region", .1)],
                                 "id int, feature_idx int, feature string, value double")
    top = attribution.top_factors(vals, "id").orderBy("rank").collect()
    assert [r.feature for r in top] == ["days_active", "sum_clicks", "click_trend"]
    assert top[0].suggestion == C.SUGGESTIONS["days_active"][0]
    assert top[1].suggestion == C.SUGGESTIONS["sum_clicks"][1]


def test_suggestion_default_and_zero(spark):
    vals = spark.createDataFrame([("sum_clicks", 0.0), ("mystery", 1.0)], "feature string, value double")
    got = {r.feature: r.suggestion for r in attribution.with_suggestions(vals).collect()}
    assert got["sum_clicks"] == C.SUGGESTIONS["sum_clicks"][0]
    assert got["mystery"] == "Feature 'mystery' is influencing the prediction."
