"""State updates, alerts and evaluation (K4, K5, D5, D9-D12, A13-A16, M9,
M15, M16, W5, J6, F14, F15, F17, F18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklens import constants as C
from risklens.functions.expr import (sql_case_map, sql_fill_template, sql_fixed, sql_pick, sql_str)
from risklens.operators import alerts, attribution, drift, metrics, reports, state
from risklens.plans.catalog import query
from risklens.plans.oracle_tables import with_tables
from risklens.plans.q_drift import drift_scores_sql
from risklens.sources import testdata as T

SWEEP_TIME = "2024-02-01 00:00:00"
_COLS = ", ".join(state.STUDENT_COLUMNS)


# ───────────────────────────── state updates ─────────────────────────────

@query("students_upsert", with_tables("students") + f"""
, u AS (
  SELECT {_COLS}, 0 AS src, CAST(NULL AS TIMESTAMP) AS o0, CAST(NULL AS BIGINT) AS o1 FROM students
  UNION ALL
  SELECT student_id, '' AS name, '' AS email, '' AS teacher_email, '' AS course_id,
         risk_level, confidence_score, 'Static' AS status, prediction_date AS last_updated,
         1 AS src, prediction_date AS o0, id AS o1
  FROM predictions)
SELECT {_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY student_id
                               ORDER BY src DESC, o0 DESC NULLS LAST, o1 DESC NULLS LAST) AS rn
  FROM u) WHERE rn = 1""")
def q_students_upsert(spark, sf_dir):
    """Every prediction upserted as a whole row (absent fields reset
    to defaults); the later row of a student wins."""
    preds = T.predictions(spark, sf_dir)
    incoming = preds.select("student_id", "risk_level", "confidence_score",
                            F.col("prediction_date").alias("last_updated"),
                            "prediction_date", "id")
    return state.upsert_students(T.students(spark, sf_dir), incoming, ["prediction_date", "id"])


def _overridden(spark, sf_dir):
    checks = drift.drift_scores(T.engagement_daily(spark, sf_dir))
    return state.apply_drift_override(T.students(spark, sf_dir), checks,
                                      F.lit(SWEEP_TIME).cast("timestamp_ntz"))


_DROPS = ("drops", "SELECT DISTINCT student_id FROM d_scores WHERE drift_detected AND z_score < 0")
_OVERRIDDEN = ("overridden", f"""
SELECT s.student_id, s.name, s.email, s.teacher_email, s.course_id,
       CASE WHEN d.student_id IS NOT NULL THEN 'High Risk' ELSE s.risk_level END AS risk_level,
       CASE WHEN d.student_id IS NOT NULL THEN CAST(0.0 AS DOUBLE) ELSE s.confidence_score END
         AS confidence_score,
       CASE WHEN d.student_id IS NOT NULL THEN '{C.STATUS_DYNAMIC}' ELSE s.status END AS status,
       CASE WHEN d.student_id IS NOT NULL THEN TIMESTAMP '{SWEEP_TIME}' ELSE s.last_updated END
         AS last_updated
FROM students s LEFT JOIN drops d ON s.student_id = d.student_id""")


def _override_sql(extra=()):
    return with_tables("students", "engagement_daily",
                       extra=drift_scores_sql("engagement_daily") + [_DROPS, _OVERRIDDEN, *extra])


@query("students_apply_drift", _override_sql() + "SELECT * FROM overridden")
def q_students_apply_drift(spark, sf_dir):
    """Drops override the model (High Risk, 0.0, Dynamic Risk);
    drift keys without a student row create nothing."""
    return _overridden(spark, sf_dir)


@query("students_by_risk_dynamic", _override_sql() + f"""
SELECT * FROM overridden WHERE status = '{C.STATUS_DYNAMIC}'""")
def q_students_by_risk_dynamic(spark, sf_dir):
    """P5: the 'Dynamic Risk' filter tests the status, not the class."""
    return reports.students_by_risk(_overridden(spark, sf_dir), C.STATUS_DYNAMIC)


# ───────────────────────────── alerts ─────────────────────────────

@query("alerts_high_risk", _override_sql() + """
SELECT student_id, name, email, teacher_email, risk_level, status
FROM overridden WHERE risk_level = 'High Risk'""")
def q_alerts_high_risk(spark, sf_dir):
    """Who gets an alert."""
    return alerts.high_risk(_overridden(spark, sf_dir)).select(
        "student_id", "name", "email", "teacher_email", "risk_level", "status")


def _alert_inputs(spark, sf_dir):
    hr = alerts.high_risk(_overridden(spark, sf_dir))
    z = drift.drift_scores(T.engagement_daily(spark, sf_dir)).select("student_id", "z_score")
    hr = hr.join(z, "student_id", "left").withColumn("z_score", F.coalesce("z_score", F.lit(0.0)))
    return hr, reports.latest_factors(T.predictions(spark, sf_dir))


_FACTOR_ROWS = ("factor_rows", """
SELECT student_id, slot,
       CASE WHEN instr(text, ':') > 0 THEN trim(substr(text, 1, instr(text, ':') - 1)) ELSE trim(text) END
         AS feature,
       CASE WHEN instr(text, ':') > 0 THEN trim(substr(text, instr(text, ':') + 1)) ELSE text END
         AS suggestion
FROM (SELECT student_id, 1 AS slot, top_factor_1 AS text FROM latest_prediction
      UNION ALL SELECT student_id, 2, top_factor_2 FROM latest_prediction
      UNION ALL SELECT student_id, 3, top_factor_3 FROM latest_prediction)
WHERE text IS NOT NULL AND text <> ''""")
_FACTOR_LISTS = ("factor_lists", """
SELECT student_id,
       string_agg('  ' || CAST(k AS VARCHAR) || '. ' || feature || ': ' || suggestion || chr(10), ''
                  ORDER BY slot) AS factors_text,
       arg_min(suggestion, slot) AS top_suggestion
FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY slot) AS k FROM factor_rows)
GROUP BY student_id""")
_HR = ("hr", """
SELECT o.student_id, o.name, o.email, o.teacher_email, COALESCE(z.z_score, 0.0) AS z
FROM overridden o LEFT JOIN d_scores z ON o.student_id = z.student_id
WHERE o.risk_level = 'High Risk'""")


def _outbox_sql() -> str:
    name = "COALESCE(h.name, '')"
    teacher_body = sql_fill_template(
        alerts.TEACHER_BODY, name=name, z=sql_fixed("h.z", 2),
        threshold=sql_str(str(C.Z_SCORE_THRESHOLD)),
        factors=f"COALESCE(NULLIF(f.factors_text, ''), {sql_str(C.ALERT_NO_FACTORS)})")
    student_body = sql_fill_template(alerts.STUDENT_BODY, name=name,
                                     tip="COALESCE(f.top_suggestion, '')")
    subject = sql_fill_template(C.ALERT_TEACHER_SUBJECT, name=name)
    return f"""
SELECT h.student_id, 'teacher' AS role, h.teacher_email AS recipient, {subject} AS subject,
       {teacher_body} AS body
FROM hr h LEFT JOIN factor_lists f ON h.student_id = f.student_id
WHERE h.teacher_email IS NOT NULL AND trim(h.teacher_email) <> ''
UNION ALL
SELECT h.student_id, 'student', h.email, {sql_str(C.ALERT_STUDENT_SUBJECT)}, {student_body}
FROM hr h LEFT JOIN factor_lists f ON h.student_id = f.student_id
WHERE h.email IS NOT NULL AND trim(h.email) <> ''"""


_ALERT_SQL = with_tables("students", "engagement_daily", "latest_prediction",
                         extra=drift_scores_sql("engagement_daily")
                         + [_DROPS, _OVERRIDDEN, _FACTOR_ROWS, _FACTOR_LISTS, _HR])


@query("alert_outbox", _ALERT_SQL + _outbox_sql())
def q_alert_outbox(spark, sf_dir):
    """Teacher + student message per High Risk student; blank
    addresses produce none."""
    hr, factors = _alert_inputs(spark, sf_dir)
    return alerts.alert_outbox(hr, factors, F.col("z_score"))


@query("alert_summary", _ALERT_SQL + f"""
, outbox AS ({_outbox_sql()})
SELECT h.student_id, COALESCE(bool_or(o.role = 'teacher'), false) AS teacher_sent,
       COALESCE(bool_or(o.role = 'student'), false) AS student_sent,
       COALESCE(bool_or(o.role IS NOT NULL), false) AS success,
       CASE WHEN COALESCE(bool_or(o.role = 'teacher'), false) AND COALESCE(bool_or(o.role = 'student'), false)
              THEN 'Both messages queued.'
            WHEN COALESCE(bool_or(o.role = 'teacher'), false)
              THEN 'Teacher message queued. Student message not queued (no address).'
            WHEN COALESCE(bool_or(o.role = 'student'), false)
              THEN 'Student message queued. Teacher message not queued (no address).'
            ELSE 'No messages queued (no addresses).' END AS message
FROM hr h LEFT JOIN outbox o ON h.student_id = o.student_id
GROUP BY h.student_id""")
def q_alert_summary(spark, sf_dir):
    """Status line per alert."""
    hr, factors = _alert_inputs(spark, sf_dir)
    box = alerts.alert_outbox(hr, factors, F.col("z_score"))
    return alerts.alert_summary(hr, box)


def _motivation_sql() -> str:
    emoji = sql_case_map("risk_level", {k: v[0] for k, v in C.MOTIVATIONAL.items()},
                         sql_str(C.MOTIVATIONAL["On Track"][0]))
    text = sql_case_map("risk_level", {k: v[1] for k, v in C.MOTIVATIONAL.items()},
                        sql_str(C.MOTIVATIONAL["On Track"][1]))
    return f"""
SELECT student_id, risk_level, {emoji} AS emoji, {text} AS message,
       CASE WHEN status = '{C.STATUS_DYNAMIC}' THEN {sql_str(C.DRIFT_BANNER)} END AS banner
FROM overridden"""


@query("student_message", _override_sql() + _motivation_sql())
def q_student_message(spark, sf_dir):
    """Notice by class (default On Track) and the drift banner."""
    return alerts.student_message(_overridden(spark, sf_dir))


# ───────────────────────────── evaluation ─────────────────────────────

L = with_tables("labelled")
_PAIRS = "SELECT actual, predicted, count(*) AS count FROM labelled GROUP BY actual, predicted"
_GRID = " UNION ALL ".join(
    f"SELECT {sql_str(a)} AS actual, {sql_str(p)} AS predicted, {i} AS row_idx, {j} AS col_idx"
    for i, a in enumerate(C.LABEL_ORDER) for j, p in enumerate(C.LABEL_ORDER))
_PER_CLASS = f"""
per_class AS (
  SELECT cls, sum(tp) AS tp, sum(support) AS support, sum(pn) AS predicted_n FROM (
    SELECT actual AS cls, CASE WHEN actual = predicted THEN count ELSE 0 END AS tp,
           count AS support, 0 AS pn FROM ({_PAIRS})
    UNION ALL SELECT predicted, 0, 0, count FROM ({_PAIRS})) GROUP BY cls),
pc AS (
  SELECT *, CASE WHEN predicted_n > 0 THEN tp / predicted_n ELSE 0.0 END AS precision,
            CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM per_class),
pcf AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                 ELSE 0.0 END AS f1_score FROM pc)
"""


@query("confusion_matrix", L + f"""
SELECT g.actual, g.predicted, CAST(g.row_idx AS INTEGER) AS row_idx,
       CAST(g.col_idx AS INTEGER) AS col_idx, CAST(COALESCE(c.count, 0) AS BIGINT) AS count
FROM ({_GRID}) g LEFT JOIN ({_PAIRS}) c ON g.actual = c.actual AND g.predicted = c.predicted""")
def q_confusion_matrix(spark, sf_dir):
    """Zeros kept, rows actual, columns predicted."""
    return metrics.confusion_matrix(T.labelled_predictions(spark, sf_dir))


@query("eval_accuracy", L + """
SELECT round(avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       count(*) AS n FROM labelled""")
def q_eval_accuracy(spark, sf_dir):
    """A14."""
    return metrics.accuracy(T.labelled_predictions(spark, sf_dir)).withColumn(
        "accuracy", F.round("accuracy", 6))


@query("eval_macro_f1", L.rstrip() + ",\n" + _PER_CLASS + """
SELECT round(avg(f1_score), 6) AS macro_f1, count(*) AS classes FROM pcf""")
def q_eval_macro_f1(spark, sf_dir):
    """Unweighted class mean of F1."""
    return metrics.macro_f1(T.labelled_predictions(spark, sf_dir)).withColumn(
        "macro_f1", F.round("macro_f1", 6))


@query("classification_report", L.rstrip() + ",\n" + _PER_CLASS + """
SELECT cls AS row_label, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1_score, 6) AS f1_score, CAST(support AS BIGINT) AS support FROM pcf
UNION ALL
SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM pcf
UNION ALL
SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1_score), 6),
       CAST(sum(support) AS BIGINT) FROM pcf
UNION ALL
SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6),
       round(sum(f1_score * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM pcf""")
def q_classification_report(spark, sf_dir):
    """Per-class rows plus accuracy / macro / weighted rows."""
    rep = metrics.classification_report(T.labelled_predictions(spark, sf_dir))
    return rep.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1_score")})


# ───────────────────── soft vote and factor attribution ─────────────────────

def _member_probs(lab):
    """Two members' class probabilities derived per labelled row."""
    d = F.col("doc_id")
    raw_a = [F.lit(1.0) + ((d * (i + 1)) % 7).cast("double") for i in range(4)]
    raw_b = [F.lit(1.0) + ((d + 3 * i) % 5).cast("double") for i in range(4)]
    sa = raw_a[0] + raw_a[1] + raw_a[2] + raw_a[3]
    sb = raw_b[0] + raw_b[1] + raw_b[2] + raw_b[3]
    return lab.select("doc_id", F.array(*[x / sa for x in raw_a]).alias("p_a"),
                      F.array(*[x / sb for x in raw_b]).alias("p_b"))


def _member_probs_sql() -> str:
    a = [f"(1.0 + CAST((doc_id * {i + 1}) % 7 AS DOUBLE))" for i in range(4)]
    b = [f"(1.0 + CAST((doc_id + {3 * i}) % 5 AS DOUBLE))" for i in range(4)]
    sa, sb = " + ".join(a), " + ".join(b)
    cols = [f"(({a[i]}) / ({sa}) + ({b[i]}) / ({sb})) / 2 AS p{i}" for i in range(4)]
    return f"SELECT doc_id, {', '.join(cols)} FROM labels"


@query("vote_combine", f"""
WITH v AS ({_member_probs_sql()}),
m AS (SELECT *, greatest(p0, p1, p2, p3) AS mx FROM v)
SELECT doc_id,
       CAST(CASE WHEN p0 = mx THEN 0 WHEN p1 = mx THEN 1 WHEN p2 = mx THEN 2 ELSE 3 END AS INTEGER)
         AS prediction,
       {sql_pick(C.LABEL_ORDER, "CASE WHEN p0 = mx THEN 0 WHEN p1 = mx THEN 1 WHEN p2 = mx THEN 2 ELSE 3 END")}
         AS risk_level,
       round(mx, 6) AS confidence_score,
       round(p0, 6) AS p_excelling, round(p1, 6) AS p_high_risk,
       round(p2, 6) AS p_moderate_risk, round(p3, 6) AS p_on_track
FROM m""")
def q_vote_combine(spark, sf_dir):
    """Mean of member probabilities, first argmax, confidence."""
    from risklens.operators.ensemble import soft_vote
    probs = _member_probs(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    v = soft_vote(probs, ["p_a", "p_b"])
    names = ["p_excelling", "p_high_risk", "p_moderate_risk", "p_on_track"]
    return v.select("doc_id", "prediction", "risk_level",
                    F.round("confidence_score", 6).alias("confidence_score"),
                    *[F.round(F.col("probability")[i], 6).alias(n) for i, n in enumerate(names)])


EXTRA_FEATURE = "prior_course_gap"


def _attributions(spark, sf_dir):
    """Per-row attribution values derived from the labels table: 14 model
    features plus one feature without a suggestion entry."""
    lab = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id")
    feats = C.FEATURES + [EXTRA_FEATURE]
    rows = lab.select("doc_id", F.posexplode(F.array(*[F.lit(f) for f in feats])).alias("feature_idx", "feature"))
    val = (((F.col("doc_id") * 7 + F.col("feature_idx") * 3) % 11) - 5) / F.lit(10.0)
    return rows.withColumn("value", val.cast("double"))


def _attributions_sql() -> str:
    feats = C.FEATURES + [EXTRA_FEATURE]
    fl = "[" + ", ".join(sql_str(f) for f in feats) + "]"
    return f"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS feature_idx, {fl}[i] AS feature,
       CAST(((doc_id * 7 + (i - 1) * 3) % 11) - 5 AS DOUBLE) / 10.0 AS value
FROM labels CROSS JOIN range(1, {len(feats) + 1}) t(i)"""


def _suggestion_sql(feature: str, value: str) -> str:
    low = sql_case_map(feature, {f: t[0] for f, t in C.SUGGESTIONS.items()})
    high = sql_case_map(feature, {f: t[1] for f, t in C.SUGGESTIONS.items()})
    default = sql_fill_template(C.DEFAULT_SUGGESTION, feature=feature)
    return f"COALESCE(CASE WHEN {value} > 0 THEN {high} ELSE {low} END, {default})"


@query("factor_suggestions", f"""
WITH a AS ({_attributions_sql()})
SELECT doc_id, feature, value, CASE WHEN value > 0 THEN 'high' ELSE 'low' END AS direction,
       {_suggestion_sql('feature', 'value')} AS suggestion
FROM a""")
def q_factor_suggestions(spark, sf_dir):
    """Suggestion by the sign of the attribution, default text for
    features without an entry (28-row dimension, broadcast)."""
    a = _attributions(spark, sf_dir)
    return attribution.with_suggestions(a).select("doc_id", "feature", "value", "direction",
                                                  "suggestion")


@query("top3_factors", f"""
WITH a AS ({_attributions_sql()}),
r AS (SELECT *, round_even(value, 4) AS v4,
             row_number() OVER (PARTITION BY doc_id ORDER BY abs(round_even(value, 4)) DESC, feature_idx)
               AS rank FROM a)
SELECT doc_id, CAST(rank AS INTEGER) AS rank, feature, v4 AS shap_value,
       {_suggestion_sql('feature', 'v4')} AS suggestion
FROM r WHERE rank <= 3""")
def q_top3_factors(spark, sf_dir):
    """Three largest |value| per row after rounding to 4, ties by
    feature order, each with its suggestion."""
    return attribution.top_factors(_attributions(spark, sf_dir), "doc_id")


# ───────────────────────────── model compare ─────────────────────────────

_VERSIONS = [1, 2, 3]


def _versioned_predictions(spark, sf_dir):
    lab = T.labelled_predictions(spark, sf_dir)
    v = F.explode(F.array(*[F.lit(x) for x in _VERSIONS])).alias("version")
    rows = lab.select("doc_id", "label", v)
    pred = F.when(F.col("doc_id") % (F.col("version") + 4) == 0, (F.col("label") + 1) % 4) \
        .otherwise(F.col("label"))
    from risklens.functions.expr import pick
    return rows.select("version", pick(C.LABEL_ORDER, F.col("label")).alias("actual"),
                       pick(C.LABEL_ORDER, pred).alias("predicted"))


@query("model_compare", L.rstrip() + f""",
vp AS (
  SELECT v.version, actual,
         {sql_pick(C.LABEL_ORDER, "CASE WHEN doc_id % (v.version + 4) = 0 THEN (label + 1) % 4 ELSE label END")}
           AS predicted
  FROM labelled CROSS JOIN (SELECT unnest({_VERSIONS}) AS version) v),
pairs AS (SELECT version, actual, predicted, count(*) AS count FROM vp GROUP BY ALL),
sides AS (
  SELECT version, actual AS cls, CASE WHEN actual = predicted THEN count ELSE 0 END AS tp,
         count AS support, 0 AS pn FROM pairs
  UNION ALL SELECT version, predicted, 0, 0, count FROM pairs),
pc AS (SELECT version, cls, sum(tp) AS tp, sum(support) AS support, sum(pn) AS pn
       FROM sides GROUP BY version, cls),
f AS (SELECT version, tp, support,
             CASE WHEN pn > 0 THEN tp / pn ELSE 0.0 END AS p,
             CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r FROM pc),
m AS (SELECT version, sum(tp) / sum(support) AS accuracy,
             avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END) AS f1_score
      FROM f GROUP BY version)
SELECT version, round(accuracy, 6) AS accuracy, round(f1_score, 6) AS f1_score,
       round(lag(accuracy) OVER (ORDER BY version), 6) AS old_accuracy,
       round(lag(f1_score) OVER (ORDER BY version), 6) AS old_f1_score,
       round(accuracy - lag(accuracy) OVER (ORDER BY version), 6) AS accuracy_delta,
       round(f1_score - lag(f1_score) OVER (ORDER BY version), 6) AS f1_delta
FROM m""")
def q_model_compare(spark, sf_dir):
    """Each model version's accuracy and macro F1 against the
    previous version (registry rows compared with lag)."""
    from risklens.operators.registry import compare_versions
    vp = _versioned_predictions(spark, sf_dir)
    evals = metrics.version_metrics(vp, "version")
    out = compare_versions(evals)
    return out.withColumns({c: F.round(c, 6) for c in (
        "accuracy", "f1_score", "old_accuracy", "old_f1_score", "accuracy_delta", "f1_delta")})
