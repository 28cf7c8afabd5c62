"""Hand-computed drift cases (z-score against the student's own baseline)."""

import pytest
from pyspark.sql import functions as F

from risklens import constants as C
from risklens.operators import drift, state


def log(spark, series):
    rows = [(sid, i, c, 1, None, i) for sid, cs in series.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "student_id string, week_number int, clicks bigint, "
                                       "days_active int, logged_at timestamp_ntz, seq bigint")


CASES = {
    "short": [10, 20],
    "one_row_base": [50, 50, 5],
    "two_row_base": [40, 60] + [50] * 7 + [10],
    "at_limit": [40, 60] + [50] * 7 + [30],
    "rise": [40, 60] + [50] * 7 + [90],
}


@pytest.fixture(scope="module")
def checks(spark):
    return {r.student_id: r for r in drift.drift_all(log(spark, CASES)).collect()}


def test_short_history(checks):
    r = checks["short"]
    assert not r.drift_detected and r.z_score == 0.0 and r.baseline_mean == 0.0
    assert r.alert_message == C.MSG_SHORT_HISTORY


def test_one_row_baseline_flat_std(checks):
    r = checks["one_row_base"]
    assert (r.baseline_mean, r.baseline_std, r.z_score) == (50.0, 1.0, -45.0)
    assert r.drift_detected and r.direction == "drop"
    assert r.alert_message.startswith("⚠️ Engagement dropped") and "Z-score: -45.00" in r.alert_message


def test_two_row_baseline(checks):
    r = checks["two_row_base"]
    assert (r.baseline_n, r.baseline_mean, r.baseline_std, r.z_score) == (2, 50.0, 10.0, -4.0)
    assert r.direction == "drop"


def test_exactly_at_threshold_is_not_drift(checks):
    r = checks["at_limit"]
    assert r.z_score == -2.0 and not r.drift_detected
    assert r.alert_message == "✅ Engagement is within normal range. Z-score: -2.00."


def test_rise_flagged_without_override(spark, checks):
    r = checks["rise"]
    assert r.z_score == 4.0 and r.drift_detected and r.direction == "rise"
    students = spark.createDataFrame(
        [(s, "", "", "", "", "On Track", 0.9, "Static", None) for s in CASES],
        "student_id string, name string, email string, teacher_email string, course_id string, "
        "risk_level string, confidence_score double, status string, last_updated timestamp_ntz")
    checks_df = drift.drift_scores(log(spark, CASES))
    out = {r.student_id: r for r in state.apply_drift_override(students, checks_df).collect()}
    assert out["rise"].status == "Static" and out["rise"].risk_level == "On Track"
    for s in ("one_row_base", "two_row_base"):
        assert (out[s].risk_level, out[s].confidence_score, out[s].status) == \
            ("High Risk", 0.0, "Dynamic Risk")


def test_override_on_absent_student_creates_nothing(spark):
    students = spark.createDataFrame(
        [("a", "", "", "", "", "On Track", 0.9, "Static", None)],
        "student_id string, name string, email string, teacher_email string, course_id string, "
        "risk_level string, confidence_score double, status string, last_updated timestamp_ntz")
    checks_df = drift.drift_scores(log(spark, {"ghost": [50, 50, 5]}))
    out = state.apply_drift_override(students, checks_df).collect()
    assert [r.student_id for r in out] == ["a"] and out[0].status == "Static"


def test_replay_last_row_equals_sweep(spark):
    series = {**CASES, "long": [float(x % 17 + x // 3) for x in range(40)]}
    lg = log(spark, {k: [int(v) for v in vs] for k, vs in series.items()})
    sweep = {r.student_id: r for r in drift.drift_scores(lg).collect()}
    w = drift.drift_replay(lg)
    last = (w.groupBy("student_id").agg(F.max_by(F.struct(*w.columns), "history_len").alias("r"))
            .select("r.*").collect())
    for r in last:
        s = sweep[r.student_id]
        assert r.history_len == s.history_len
        assert r.z_score == pytest.approx(s.z_score, abs=1e-9)
        assert r.drift_detected == s.drift_detected


def test_replay_matches_brute_force(spark):
    import numpy as np
    series = {"x": [3, 9, 4, 12, 7, 30, 1, 8, 8, 15, 2, 40, 6]}
    rows = {r.history_len: r for r in drift.drift_replay(log(spark, series)).collect()}
    cs = series["x"]
    for p in range(1, len(cs) + 1):
        hist = cs[:p]
        if p < 3:
            assert rows[p].z_score == 0.0 and not rows[p].drift_detected
            continue
        base = hist[:max(1, int(p * 0.2))]
        mean, std = np.mean(base), np.std(base)
        std = 1.0 if std < 1e-6 else std
        z = (hist[-1] - mean) / std
        assert rows[p].z_score == pytest.approx(z, abs=1e-9)
        assert rows[p].drift_detected == (abs(z) > 2.0)
