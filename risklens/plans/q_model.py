"""Model training and scoring, attribution, registry, state writes and
incremental ingest (S7, S9, S10, K1-K3, K6-K9, M7-M14, M17, D7, T1, T2). What
is written without a model has oracle SQL (ids and times of the write left
out); for the rest the tests check invariants.

Every query builds its inputs from the driver tables; artifacts and state
go under the shared ``spark.checkpoint.dir`` folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risklens import constants as C
from risklens.operators import attribution, drift, metrics, tree_paths
from risklens.operators.ensemble import EnsembleParams
from risklens.operators.registry import Registry
from risklens.plans import training
from risklens.plans.catalog import query
from risklens.plans.oracle_tables import with_tables
from risklens.plans.q_drift import drift_all_sql
from risklens.plans.q_features import encoded_master, feature_sql, master
from risklens.plans.scoring import ingest_scored, score_upload
from risklens.session import run_dir, shared_path
from risklens.sources import testdata as T
from risklens.sources.state_store import StateStore

PARAMS = EnsembleParams()


def _tag(sf_dir: str) -> str:
    return sf_dir.rstrip("/").replace("/", "_").strip("_")


def model_root(spark: SparkSession, sf_dir: str) -> str:
    return shared_path(spark, "risklens", "models", _tag(sf_dir))


def artifacts(spark: SparkSession, sf_dir: str, params: EnsembleParams = PARAMS,
              fit_on: str = "train") -> training.TrainResult:
    """The session's trained ensemble for these tables (fitted once)."""
    return training.train(spark, master(spark, sf_dir), model_root(spark, sf_dir), params,
                          fit_on=fit_on, data_source=f"tables:{sf_dir}", cache_key=sf_dir,
                          reuse=True)


def upload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class upload as read from CSV (every column text): identity from
    the students table, the 14 features with text categories."""
    m = master(spark, sf_dir).withColumn("student_id", F.col("id_student").cast("string"))
    ident = T.students(spark, sf_dir).select("student_id", "name", "email", "teacher_email",
                                             "course_id")
    return m.join(ident, "student_id", "left").select(
        "student_id", "name", "email", "teacher_email", "course_id",
        *[F.col(c).cast("string").alias(c) for c in C.FEATURES])


# ───────────────────────────── training ─────────────────────────────

@query("train_ensemble")
def q_train_ensemble(spark, sf_dir):
    """Fit, evaluate on the held-out 20%, save, register."""
    art = artifacts(spark, sf_dir)
    reg = Registry(spark, model_root(spark, sf_dir)).read()
    return reg.where((F.col("version") == art.version) & (F.col("event") == "trained")).select(
        "version", "accuracy", "f1_score", "num_samples", "num_features", "confusion_matrix",
        "classification_report", "path")


@query("eval_members")
def q_eval_members(spark, sf_dir):
    """Accuracy and macro F1 of the ensemble and of each member."""
    art = artifacts(spark, sf_dir)
    return metrics.version_metrics(training.member_predictions(art.test_scored), "member")


@query("model_registry")
def q_model_registry(spark, sf_dir):
    """K7: registry events (trained / activated / rolled back)."""
    artifacts(spark, sf_dir)
    return Registry(spark, model_root(spark, sf_dir)).read()


@query("model_current")
def q_model_current(spark, sf_dir):
    """Metadata of the active version (missing metrics -> 0)."""
    artifacts(spark, sf_dir)
    return Registry(spark, model_root(spark, sf_dir)).current()


@query("model_rollback")
def q_model_rollback(spark, sf_dir):
    """Retrain (scaler fitted on all rows, a second version), then roll
    back to the previous version; the registry keeps every event."""
    root = run_dir(spark, "rollback")
    base = artifacts(spark, sf_dir)
    reg = Registry(spark, root)
    meta = {k: v for k, v in base.metadata.items() if k not in ("version", "event", "event_time")}
    meta["path"] = base.path
    reg.append(base.version, "trained", meta)
    reg.append(base.version, "activated", {"path": base.path})
    m = master(spark, sf_dir)
    training.train(spark, m, root, PARAMS, fit_on="all", data_source=f"tables:{sf_dir}",
                   cache_key=(sf_dir, "all"))
    back_to = reg.rollback()
    return reg.read().select("version", "event", "event_time", "accuracy", "f1_score").withColumn(
        "active_after_rollback", F.lit(back_to))


# ───────────────────────────── scoring ─────────────────────────────

@query("score_batch")
def q_score_batch(spark, sf_dir):
    """Every uploaded row scored (class, confidence, Static)."""
    art = artifacts(spark, sf_dir)
    s = score_upload(upload_rows(spark, sf_dir), art, explain=False)
    return s.select("student_id", "name", "risk_level", "confidence_score", "status",
                    attribution_probability_map())


def attribution_probability_map():
    from risklens.operators.ensemble import probability_map
    return probability_map("probability").alias("prediction_probabilities")


@query("explain_batch")
def q_explain_batch(spark, sf_dir):
    """Exact Shapley values of the forest for the
    ensemble's class, top-3 factors with suggestions, for every row."""
    art = artifacts(spark, sf_dir)
    s = score_upload(upload_rows(spark, sf_dir), art, explain=True)
    return s.select("student_id", "risk_level", "confidence_score",
                    "top_factor_1", "top_factor_2", "top_factor_3")


#: A given forest of three trees: (tree, node, feature, threshold, left, right, value).
GIVEN_NODES = [
    (0, 0, 9, 120.5, 1, 2, None), (0, 1, 11, 6.5, 3, 4, None), (0, 2, -1, None, -1, -1, [0.05]), (0, 3, -1, None, -1, -1, [0.30]), (0, 4, 9, 40.5, 5, 6, None),
    (0, 5, -1, None, -1, -1, [0.20]), (0, 6, -1, None, -1, -1, [0.10]),
    (1, 0, 7, 75.5, 1, 2, None), (1, 1, 0, 0.5, 3, 4, None), (1, 2, 8, 55.25, 5, 6, None), (1, 3, -1, None, -1, -1, [0.02]), (1, 4, -1, None, -1, -1, [0.08]),
    (1, 5, -1, None, -1, -1, [0.33]), (1, 6, -1, None, -1, -1, [0.15]),
    (2, 0, 11, 9.5, 1, 2, None), (2, 1, -1, None, -1, -1, [0.25]), (2, 2, -1, None, -1, -1, [0.01])]
#: Background rows of the given forest: the first by key.
GIVEN_BACKGROUND = 8


@query("tree_attribution", feature_sql("encoded", f"""
SELECT code_module, code_presentation, id_student, feature, round(sum(phi) / {GIVEN_BACKGROUND}, 9) AS value FROM (
  WITH iv(tree, leaf, worth, feature, lo, hi) AS (VALUES
    (0, 2, 0.05, 'sum_clicks', 120.5, 1e300), (0, 3, 0.30, 'sum_clicks', -1e300, 120.5), (0, 3, 0.30, 'days_active', -1e300, 6.5),
    (0, 5, 0.20, 'sum_clicks', -1e300, 40.5), (0, 5, 0.20, 'days_active', 6.5, 1e300), (0, 6, 0.10, 'sum_clicks', 40.5, 120.5), (0, 6, 0.10, 'days_active', 6.5, 1e300),
    (1, 3, 0.02, 'studied_credits', -1e300, 75.5), (1, 3, 0.02, 'gender', -1e300, 0.5), (1, 4, 0.08, 'studied_credits', -1e300, 75.5), (1, 4, 0.08, 'gender', 0.5, 1e300),
    (1, 5, 0.33, 'studied_credits', 75.5, 1e300), (1, 5, 0.33, 'weighted_avg_score', -1e300, 55.25), (1, 6, 0.15, 'studied_credits', 75.5, 1e300),
    (1, 6, 0.15, 'weighted_avg_score', 55.25, 1e300), (2, 1, 0.25, 'days_active', -1e300, 9.5), (2, 2, 0.01, 'days_active', 9.5, 1e300)),
  v AS (SELECT code_module, code_presentation, id_student, feature, CAST(v AS DOUBLE) AS v FROM (
        SELECT code_module, code_presentation, id_student, unnest([{', '.join(f"'{c}'" for c in C.FEATURES)}]) AS feature,
               unnest([{', '.join(f'CAST({c} AS DOUBLE)' for c in C.FEATURES)}]) AS v FROM encoded)),
  z AS (SELECT dense_rank() OVER (ORDER BY code_module, code_presentation, id_student) AS z, feature, v FROM v),
  pairs AS (SELECT x.code_module, x.code_presentation, x.id_student, z.z, iv.tree, iv.leaf, iv.feature, iv.worth,
                   CAST(x.v > lo AND x.v <= hi AS INTEGER) AS a, CAST(z.v > lo AND z.v <= hi AS INTEGER) AS b
            FROM iv JOIN v x ON x.feature = iv.feature JOIN z ON z.feature = iv.feature AND z.z <= {GIVEN_BACKGROUND}),
  leaves AS (SELECT *, sum(a * (1 - b)) OVER w AS p, sum(b * (1 - a)) OVER w AS q, sum((1 - a) * (1 - b)) OVER w AS bad FROM pairs
             WINDOW w AS (PARTITION BY code_module, code_presentation, id_student, z, tree, leaf))
  SELECT code_module, code_presentation, id_student, feature,
         CASE WHEN bad > 0 OR a = b THEN 0.0 WHEN a = 1 THEN worth * CAST(factorial(CAST(p - 1 AS INTEGER)) * factorial(CAST(q AS INTEGER)) AS DOUBLE) / CAST(factorial(CAST(p + q AS INTEGER)) AS DOUBLE)
              ELSE -worth * CAST(factorial(CAST(p AS INTEGER)) * factorial(CAST(q - 1 AS INTEGER)) AS DOUBLE) / CAST(factorial(CAST(p + q AS INTEGER)) AS DOUBLE) END AS phi FROM leaves
  UNION ALL SELECT code_module, code_presentation, id_student, feature, 0.0 FROM v) GROUP BY ALL"""))
def q_tree_attribution(spark, sf_dir):
    """Exact Shapley values of a given forest for every student, against a
    background of the first rows by key."""
    rows = encoded_master(spark, sf_dir)
    key = F.struct(*C.STUDENT_KEYS)
    z = rows.orderBy(*C.STUDENT_KEYS).limit(GIVEN_BACKGROUND).select(*[F.col(c).cast("double") for c in C.FEATURES]).collect()
    background = np.array([[np.nan if v is None else v for v in r] for r in z], float).reshape(-1, len(C.FEATURES))
    nodes = spark.createDataFrame(GIVEN_NODES, tree_paths.NODES)
    patterns = tree_paths.with_background(tree_paths.leaf_paths(nodes), background)
    values = tree_paths.shapley_values(rows.withColumns({"key": key, "cls": F.lit(0)}), "key", "cls", C.FEATURES, patterns)
    return values.select("key.*", "feature", F.round("value", 9).alias("value"))


@query("explain_fallback")
def q_explain_fallback(spark, sf_dir):
    """Forest importances as the factor values when attribution fails."""
    art = artifacts(spark, sf_dir)
    s = score_upload(upload_rows(spark, sf_dir), art, explain=False)
    vals = attribution.importance_fallback(s.select("row_id").distinct(), "row_id", art.model.forest)
    top = attribution.top_factors(vals, "row_id")
    return s.select("row_id", "student_id").join(attribution.factor_texts(top, "row_id"), "row_id")


# ───────────────────────────── state tables ─────────────────────────────

@query("state_init", with_tables("students") + """
SELECT 'students' AS "table", count(DISTINCT student_id) AS rows FROM students
UNION ALL SELECT 'predictions', 0 UNION ALL SELECT 'engagement_log', 0 UNION ALL SELECT 'drift_log', 0""")
def q_state_init(spark, sf_dir):
    """Create the tables, fill and clear one, create again (idempotent), row counts."""
    store = StateStore(spark, run_dir(spark, "state"))
    store.init()
    store.append("drift_log", drift.drift_log_rows(drift.drift_all(T.engagement_daily(spark, sf_dir))))
    store.clear()
    store.init()
    store.upsert_students(T.students(spark, sf_dir).withColumn("o", F.lit(0)), ["o"])
    parts = [store.table(t).agg(F.lit(t).alias("table"), F.count(F.lit(1)).alias("rows"))
             for t in ("students", "predictions", "engagement_log", "drift_log")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("engagement_append", with_tables("engagement_daily") + "SELECT * EXCLUDE (seq) FROM engagement_daily")
def q_engagement_append(spark, sf_dir):
    """K1: append the daily engagement rows, read the table back."""
    store = StateStore(spark, run_dir(spark, "eng"))
    store.init()
    store.append("engagement_log", T.engagement_daily(spark, sf_dir).drop("seq"))
    return store.table("engagement_log").drop("id", "seq")


@query("predictions_append", with_tables("predictions") + "SELECT * EXCLUDE (id) FROM predictions")
def q_predictions_append(spark, sf_dir):
    """K2: append logged predictions (factors default to '')."""
    store = StateStore(spark, run_dir(spark, "pred"))
    store.init()
    store.append("predictions", T.predictions(spark, sf_dir).drop("id"))
    return store.table("predictions").drop("id")


@query("drift_log_append", "SELECT student_id, z_score, CAST(drift_detected AS INTEGER) AS drift_detected, "
       f"alert_message FROM ({drift_all_sql('engagement_daily')})")
def q_drift_log_append(spark, sf_dir):
    """K3: every check is logged, also the non-drift ones (flag 0/1)."""
    store = StateStore(spark, run_dir(spark, "drift"))
    store.init()
    checks = drift.drift_all(T.engagement_daily(spark, sf_dir))
    store.append("drift_log", drift.drift_log_rows(checks))
    return store.table("drift_log").drop("id", "checked_at")


@query("export_class_report", with_tables("students") + """
SELECT student_id, name, email, teacher_email, course_id, risk_level,
       CAST(confidence_score AS VARCHAR) AS confidence_score, status,
       strftime(last_updated, '%Y-%m-%dT%H:%M:%S.%g') AS last_updated FROM students""")
def q_export_class_report(spark, sf_dir):
    """K6: the class table written as CSV with a header, read back."""
    path = run_dir(spark, "export")
    StateStore.export_csv(T.students(spark, sf_dir), path)
    return spark.read.option("header", True).csv(path)


@query("batch_results")
def q_batch_results(spark, sf_dir):
    """Score an upload, then upsert, log engagement and predictions,
    check drift of the touched students and override drops."""
    art = artifacts(spark, sf_dir)
    store = StateStore(spark, run_dir(spark, "batch"))
    store.init()
    store.append("engagement_log", T.engagement_daily(spark, sf_dir).drop("seq"))
    return ingest_scored(store, score_upload(upload_rows(spark, sf_dir), art))


@query("ingest_batch")
def q_ingest_batch(spark, sf_dir):
    """T1/T2 streaming: upload files arriving in a folder are scored and
    ingested by foreachBatch (availableNow); returns the students table."""
    from risklens.streaming.ingest import start_ingest
    art = artifacts(spark, sf_dir)
    run = run_dir(spark, "stream")
    inbox = f"{run}/inbox"
    upload_rows(spark, sf_dir).repartition(4).write.option("header", True).csv(inbox)
    store = StateStore(spark, f"{run}/state")
    store.init()
    q = start_ingest(spark, inbox, store, art, f"{run}/_checkpoint")
    q.awaitTermination()
    return store.table("students")
