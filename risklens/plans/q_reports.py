"""State-table reports (S6, P2-P5, P12, A6-A9, O1-O4, O6, W4, W8, J8, F8,
F11, F16, D8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklens import constants as C
from risklens.functions.expr import sql_case_map, sql_fill_template, sql_fixed, sql_percent_text, sql_str
from risklens.operators import drift, reports
from risklens.plans.catalog import query
from risklens.plans.oracle_tables import with_tables
from risklens.plans.q_drift import drift_message_sql
from risklens.sources import testdata as T

TEACHER = "teacher3@example.edu"
NO_TEACHER = "nobody@example.edu"
STUDENT = "7"
RISK_FILTER = "High Risk"

S = with_tables("students")


@query("students_all", S + "SELECT * FROM students ORDER BY last_updated DESC")
def q_students_all(spark, sf_dir):
    """The state table, most recently updated first."""
    return reports.students_all(T.students(spark, sf_dir))


@query("student_lookup", S + f"SELECT * FROM students WHERE student_id = '{STUDENT}'")
def q_student_lookup(spark, sf_dir):
    """Point lookup of one student (filter pushed to the scan)."""
    return reports.student_lookup(T.students(spark, sf_dir), STUDENT)


@query("students_by_teacher", S + f"""
SELECT * FROM students WHERE teacher_email = '{TEACHER}' ORDER BY risk_level""")
def q_students_by_teacher(spark, sf_dir):
    """One teacher's class ordered by risk level."""
    return reports.students_by_teacher(T.students(spark, sf_dir), TEACHER)


@query("students_by_teacher_fallback", S + f"""
SELECT * FROM students
WHERE teacher_email = '{NO_TEACHER}'
   OR NOT EXISTS (SELECT 1 FROM students WHERE teacher_email = '{NO_TEACHER}')""")
def q_students_by_teacher_fallback(spark, sf_dir):
    """A teacher without students sees the whole table."""
    return reports.students_by_teacher_fallback(T.students(spark, sf_dir), NO_TEACHER)


@query("students_by_risk", S + f"SELECT * FROM students WHERE risk_level = '{RISK_FILTER}'")
def q_students_by_risk(spark, sf_dir):
    """P5: risk filter of the class view."""
    return reports.students_by_risk(T.students(spark, sf_dir), RISK_FILTER)


@query("student_count", S + "SELECT count(*) AS student_count FROM students")
def q_student_count(spark, sf_dir):
    """A6."""
    return reports.student_count(T.students(spark, sf_dir))


@query("risk_counts", S + "SELECT risk_level, count(*) AS cnt FROM students GROUP BY risk_level")
def q_risk_counts(spark, sf_dir):
    """A7."""
    return reports.risk_counts(T.students(spark, sf_dir))


@query("risk_kpis", S + """
SELECT count(*) AS total,
       count(*) FILTER (WHERE risk_level = 'High Risk') AS high_risk,
       count(*) FILTER (WHERE risk_level = 'Moderate Risk') AS moderate_risk,
       count(*) FILTER (WHERE risk_level = 'On Track') AS on_track,
       count(*) FILTER (WHERE risk_level = 'Excelling') AS excelling
FROM students""")
def q_risk_kpis(spark, sf_dir):
    """KPI strip with the real class names."""
    return reports.risk_kpis(T.students(spark, sf_dir))


@query("risk_distribution", S + """
SELECT risk_level, count(*) AS count FROM students GROUP BY risk_level ORDER BY count DESC, risk_level""")
def q_risk_distribution(spark, sf_dir):
    """Value counts, largest first."""
    return reports.risk_distribution(T.students(spark, sf_dir))


@query("class_overview", S + f"""
SELECT student_id AS "ID", name AS "Name", risk_level AS "Risk Level",
       {sql_percent_text('confidence_score')} AS "Confidence", status AS "Status",
       last_updated AS "Updated"
FROM students""")
def q_class_overview(spark, sf_dir):
    """The displayed class table."""
    return reports.class_overview(T.students(spark, sf_dir))


@query("latest_prediction", with_tables("latest_prediction") + "SELECT * FROM latest_prediction")
def q_latest_prediction(spark, sf_dir):
    """Newest prediction per student (skew-safe max_by aggregate)."""
    return reports.latest_prediction(T.predictions(spark, sf_dir))


@query("latest_factors", with_tables("latest_prediction") + """
SELECT student_id, slot,
       CASE WHEN instr(text, ':') > 0 THEN trim(substr(text, 1, instr(text, ':') - 1))
            ELSE trim(text) END AS feature,
       CASE WHEN instr(text, ':') > 0 THEN trim(substr(text, instr(text, ':') + 1))
            ELSE text END AS suggestion,
       CAST(1.0 AS DOUBLE) / slot AS impact
FROM (SELECT student_id, 1 AS slot, top_factor_1 AS text FROM latest_prediction
      UNION ALL SELECT student_id, 2, top_factor_2 FROM latest_prediction
      UNION ALL SELECT student_id, 3, top_factor_3 FROM latest_prediction)
WHERE text IS NOT NULL AND text <> ''""")
def q_latest_factors(spark, sf_dir):
    """Parsed factors of each student's newest prediction."""
    return reports.latest_factors(T.predictions(spark, sf_dir))


@query("risk_trajectory", with_tables("predictions") + f"""
SELECT student_id, prediction_date, risk_level, id,
       CAST({sql_case_map('risk_level', C.RISK_NUMERIC)} AS INTEGER) AS risk_numeric
FROM predictions ORDER BY student_id, prediction_date, id""")
def q_risk_trajectory(spark, sf_dir):
    """Risk 1..4 in prediction-date order."""
    return reports.risk_trajectory(T.predictions(spark, sf_dir))


_REPLAY_SQL = [
    ("r_rows", """
SELECT student_id, week_number, logged_at, CAST(clicks AS DOUBLE) AS clicks,
       row_number() OVER (PARTITION BY student_id ORDER BY week_number, logged_at, seq) AS p
FROM engagement_daily"""),
    ("r_base", f"""
SELECT c.student_id, c.p, c.week_number, c.logged_at, c.clicks,
       avg(h.clicks) AS mean_raw, stddev_pop(h.clicks) AS std_raw
FROM r_rows c JOIN r_rows h
  ON h.student_id = c.student_id
 AND h.p <= greatest(1, floor(c.p * CAST({C.BASELINE_FRACTION!r} AS DOUBLE)))
GROUP BY c.student_id, c.p, c.week_number, c.logged_at, c.clicks"""),
    ("r_z", f"""
SELECT *, p < {C.MIN_HISTORY} AS short,
       CASE WHEN std_raw < {C.FLAT_STD_EPSILON!r} THEN CAST(1.0 AS DOUBLE) ELSE std_raw END AS std
FROM r_base"""),
    ("r_scores", f"""
SELECT student_id, logged_at AS checked_at, CAST(p AS BIGINT) AS history_len,
       CAST(clicks AS BIGINT) AS current_clicks,
       CASE WHEN short THEN CAST(0.0 AS DOUBLE) ELSE mean_raw END AS baseline_mean,
       CASE WHEN short THEN CAST(0.0 AS DOUBLE) ELSE (clicks - mean_raw) / std END AS z_score,
       CASE WHEN short THEN false ELSE abs((clicks - mean_raw) / std) > {C.Z_SCORE_THRESHOLD!r} END
         AS drift_detected
FROM r_z"""),
]


@query("drift_history", with_tables("engagement_daily", extra=_REPLAY_SQL) + f"""
SELECT student_id, checked_at AS "Date", round_even(z_score, 4) AS "Z-Score",
       CASE WHEN drift_detected THEN '⚠️ Yes' ELSE '✅ No' END AS "Drift?",
       {drift_message_sql('history_len', 'current_clicks', 'baseline_mean', 'z_score', 'drift_detected')}
         AS "Details"
FROM r_scores ORDER BY student_id, checked_at DESC""")
def q_drift_history(spark, sf_dir):
    """Every check replayed at each arrival, newest first."""
    log = drift.drift_log_from_replay(drift.drift_replay(T.engagement_daily(spark, sf_dir)))
    log = log.withColumn("z_score", F.bround("z_score", 4))
    return reports.drift_history(log)


@query("batch_preview", with_tables("student_info") + """
SELECT CAST(id_student AS VARCHAR) AS student_id, code_module, gender, region, final_result
FROM student_info ORDER BY CAST(id_student AS VARCHAR) LIMIT 10""")
def q_batch_preview(spark, sf_dir):
    """First 10 rows of an upload under a total order (the preview is
    the feature; the limit is its definition)."""
    up = T.student_info(spark, sf_dir).select(
        F.col("id_student").cast("string").alias("student_id"), "code_module", "gender",
        "region", "final_result")
    return reports.batch_preview(up)


__all__ = ["sql_fill_template", "sql_fixed", "sql_str"]
