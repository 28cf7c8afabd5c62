"""Drift queries: D1-D6, W1-W3, A12, A17, F10."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklens import constants as C
from risklens.functions.expr import sql_fill_template, sql_fixed, sql_str
from risklens.operators import drift, reports
from risklens.plans.catalog import query
from risklens.plans.oracle_tables import with_tables
from risklens.sources import testdata as T

_FRAC = f"CAST({C.BASELINE_FRACTION!r} AS DOUBLE)"
_IN_BASE = f"rn <= greatest(1, floor(n * {_FRAC}))"


def drift_scores_sql(log: str) -> list[tuple[str, str]]:
    """CTEs computing the unrounded per-student drift scores from ``log``."""
    return [
        ("d_rows", f"""
SELECT student_id, CAST(clicks AS DOUBLE) AS clicks,
       row_number() OVER (PARTITION BY student_id ORDER BY week_number, logged_at, seq) AS rn,
       count(*) OVER (PARTITION BY student_id) AS n
FROM {log}"""),
        ("d_agg", f"""
SELECT student_id, max(n) AS history_len,
       count(*) FILTER (WHERE {_IN_BASE}) AS base_n,
       avg(clicks) FILTER (WHERE {_IN_BASE}) AS mean_raw,
       stddev_pop(clicks) FILTER (WHERE {_IN_BASE}) AS std_raw,
       arg_max(clicks, rn) AS cur
FROM d_rows GROUP BY student_id"""),
        ("d_z", f"""
SELECT *, history_len < {C.MIN_HISTORY} AS short,
       CASE WHEN std_raw < {C.FLAT_STD_EPSILON!r} THEN CAST(1.0 AS DOUBLE) ELSE std_raw END AS std,
       (cur - mean_raw) / CASE WHEN std_raw < {C.FLAT_STD_EPSILON!r} THEN CAST(1.0 AS DOUBLE)
                              ELSE std_raw END AS z
FROM d_agg"""),
        ("d_scores", f"""
SELECT student_id, history_len,
       CAST(CASE WHEN short THEN 0 ELSE base_n END AS BIGINT) AS baseline_n,
       CASE WHEN short THEN CAST(0.0 AS DOUBLE) ELSE mean_raw END AS baseline_mean,
       CASE WHEN short THEN CAST(0.0 AS DOUBLE) ELSE std END AS baseline_std,
       CAST(cur AS BIGINT) AS current_clicks,
       CASE WHEN short THEN CAST(0.0 AS DOUBLE) ELSE z END AS z_score,
       CASE WHEN short THEN false ELSE abs(z) > {C.Z_SCORE_THRESHOLD!r} END AS drift_detected
FROM d_z"""),
    ]


def drift_message_sql(hist: str, cur: str, mean: str, z: str, flag: str) -> str:
    vals = dict(current=f"CAST({cur} AS VARCHAR)", mean=sql_fixed(mean, 1), z=sql_fixed(z, 2),
                threshold=sql_str(str(C.Z_SCORE_THRESHOLD)))
    return (f"CASE WHEN {hist} < {C.MIN_HISTORY} THEN {sql_str(C.MSG_SHORT_HISTORY)} "
            f"WHEN {flag} AND {z} < 0 THEN {sql_fill_template(C.MSG_DROP, **vals)} "
            f"WHEN {flag} AND {z} > 0 THEN {sql_fill_template(C.MSG_RISE, **vals)} "
            f"ELSE {sql_fill_template(C.MSG_NORMAL, z=vals['z'])} END")


DIRECTION_SQL = ("CASE WHEN drift_detected AND z_score < 0 THEN 'drop' "
                 "WHEN drift_detected AND z_score > 0 THEN 'rise' ELSE 'none' END")


def drift_all_sql(log_table: str) -> str:
    return with_tables(log_table, extra=drift_scores_sql(log_table)) + f"""
SELECT student_id, history_len, baseline_n,
       round_even(baseline_mean, 2) AS baseline_mean, round_even(baseline_std, 2) AS baseline_std,
       current_clicks, round_even(z_score, 4) AS z_score, drift_detected,
       {DIRECTION_SQL} AS direction,
       {drift_message_sql('history_len', 'current_clicks', 'baseline_mean', 'z_score', 'drift_detected')}
         AS alert_message
FROM d_scores"""


@query("drift_all", drift_all_sql("engagement_daily"))
def q_drift_all(spark, sf_dir):
    """Flagship: whose daily engagement moved away from their own baseline?"""
    return drift.drift_all(T.engagement_daily(spark, sf_dir))


@query("drift_all_monthly", drift_all_sql("engagement_monthly"))
def q_drift_all_monthly(spark, sf_dir):
    """The same sweep over the monthly order log (many short histories)."""
    return drift.drift_all(T.engagement_monthly(spark, sf_dir))


@query("drift_baseline", with_tables("engagement_daily") + f"""
SELECT student_id, count(*) AS baseline_n, min(week_number) AS first_week,
       max(week_number) AS last_week, round(avg(clicks), 6) AS baseline_mean,
       round(stddev_pop(clicks), 6) AS baseline_std
FROM (SELECT student_id, week_number, CAST(clicks AS DOUBLE) AS clicks,
             row_number() OVER (PARTITION BY student_id ORDER BY week_number, logged_at, seq) AS rn,
             count(*) OVER (PARTITION BY student_id) AS n
      FROM engagement_daily)
WHERE {_IN_BASE}
GROUP BY student_id""")
def q_drift_baseline(spark, sf_dir):
    b = drift.drift_baseline(T.engagement_daily(spark, sf_dir))
    return b.select("student_id", "baseline_n", "first_week", "last_week",
                    F.round("baseline_mean", 6).alias("baseline_mean"),
                    F.round("baseline_std", 6).alias("baseline_std"))


@query("drift_messages", with_tables("engagement_daily", extra=drift_scores_sql("engagement_daily")) + f"""
SELECT student_id,
       {drift_message_sql('history_len', 'current_clicks', 'baseline_mean', 'z_score', 'drift_detected')}
         AS alert_message,
       CAST(drift_detected AS INTEGER) AS drift_detected
FROM d_scores""")
def q_drift_messages(spark, sf_dir):
    """The text logged with each check, from unrounded scores."""
    s = drift.drift_scores(T.engagement_daily(spark, sf_dir))
    return s.select("student_id",
                    drift.drift_message(F.col("history_len"), F.col("current_clicks"),
                                        F.col("baseline_mean"), F.col("z_score"),
                                        F.col("drift_detected")).alias("alert_message"),
                    F.col("drift_detected").cast("int").alias("drift_detected"))


@query("drift_summary", with_tables("engagement_daily", extra=drift_scores_sql("engagement_daily")) + f"""
SELECT count(*) AS checked, count(*) FILTER (WHERE drift_detected) AS flagged,
       count(*) FILTER (WHERE drift_detected AND z_score < 0) AS drops,
       count(*) FILTER (WHERE drift_detected AND z_score > 0) AS rises,
       count(*) FILTER (WHERE history_len < {C.MIN_HISTORY}) AS short_history
FROM d_scores""")
def q_drift_summary(spark, sf_dir):
    """Counts of one sweep (drops are the overrides)."""
    return drift.drift_summary(drift.drift_scores(T.engagement_daily(spark, sf_dir)))


@query("engagement_history", with_tables("engagement_daily") + """
SELECT student_id, week_number, clicks, days_active,
       CAST(row_number() OVER (PARTITION BY student_id ORDER BY week_number, logged_at, seq) AS INTEGER)
         AS position
FROM engagement_daily""")
def q_engagement_history(spark, sf_dir):
    """Each student's series in week order, with its 1-based position."""
    from pyspark.sql.window import Window
    log = T.engagement_daily(spark, sf_dir)
    w = Window.partitionBy("student_id").orderBy("week_number", "logged_at", "seq")
    return reports.engagement_history(log).select(
        "student_id", "week_number", "clicks", "days_active",
        F.row_number().over(w).alias("position"))
