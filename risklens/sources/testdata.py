"""The driver's test tables, read as the learner-analytics schemas.

Each function takes ``(spark, sf_dir)`` and returns a lazy DataFrame with
the schema of one raw table or state table:

========================  ===============================================
student_info              customer LEFT JOIN nation
student_vle               events JOIN customer (relative day, clicks)
assessments               part
student_assessment        lineitem JOIN orders (score text, '?' is bad)
engagement_daily          events, one row per (student, day)
engagement_monthly        orders, one row per (student, month)
predictions               orders (one logged prediction per order)
students                  customer + the newest prediction of each student
labelled_predictions      labels (actual class, predicted class)
========================  ===============================================

The oracle module builds the same tables in SQL; keep both in step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risklens import constants as C
from risklens.functions.expr import pick

# TPC-H market segments, alphabetical: the course modules of the mapping.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRESENTATION = "2024J"
AGE_TEXT = ["0-35", "35-55", "55<="]
EDUCATION_TEXT = list(C.EDUCATION_CODES[0].keys()) + ["Unknown"]
VLE_START = "2024-01-08"
LOG_START = "2024-01-01"
PRIORITY_RISK = {"1": "High Risk", "2": "High Risk", "3": "Moderate Risk",
                 "4": "On Track", "5": "Excelling"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def student_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    # nation is the fixed 25-row TPC-H dimension: a proven broadcast bound
    n = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    k = F.col("c_custkey")
    m = k % 11
    imd = (F.when(m == 10, F.lit(None).cast("string"))
           .when(m == 0, F.lit("0-10%"))
           .when(m == 1, F.lit("10-20"))
           .otherwise(F.concat((m * 10 - 10).cast("string"), F.lit("-"),
                               (m * 10).cast("string"), F.lit("%"))))
    bal = F.col("c_acctbal")
    result = (F.when(bal < 0, "Fail").when(k % 50 == 0, "Unknown")
              .when(bal < 3000, "Withdrawn").when(bal < 8000, "Pass")
              .otherwise("Distinction"))
    return (c.join(n, c.c_nationkey == n.n_nationkey, "left")
            .select(F.col("c_mktsegment").alias("code_module"),
                    F.lit(PRESENTATION).alias("code_presentation"),
                    k.alias("id_student"),
                    F.when(k % 2 == 0, "M").otherwise("F").alias("gender"),
                    F.col("n_name").alias("region"),
                    pick(EDUCATION_TEXT, F.col("c_nationkey") % 6).alias("highest_education"),
                    imd.alias("imd_band"),
                    pick(AGE_TEXT, k % 3).alias("age_band"),
                    (k % 4).cast("int").alias("num_of_prev_attempts"),
                    (F.lit(30) * (k % 5 + 1)).cast("int").alias("studied_credits"),
                    F.when(k % 7 == 0, "Y").otherwise("N").alias("disability"),
                    result.alias("final_result")))


def student_vle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "value")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return (e.join(c, e.user_id == c.c_custkey)
            .select(F.col("c_mktsegment").alias("code_module"),
                    F.lit(PRESENTATION).alias("code_presentation"),
                    F.col("c_custkey").alias("id_student"),
                    F.datediff(F.col("ts"), F.lit(VLE_START).cast("date")).alias("date"),
                    F.floor(F.col("value")).cast("bigint").alias("sum_click")))


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    k = F.col("p_partkey")
    return p.select(k.alias("id_assessment"),
                    pick(SEGMENTS, k % 5).alias("code_module"),
                    F.lit(PRESENTATION).alias("code_presentation"),
                    F.when(k % 10 == 0, F.lit(None).cast("double"))
                    .otherwise(F.col("p_size").cast("double")).alias("weight"))


def student_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey",
                                                  "l_linenumber", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .select(F.col("l_partkey").alias("id_assessment"),
                    F.col("o_custkey").alias("id_student"),
                    F.when(F.col("l_linenumber") == 7, F.lit("?"))
                    .otherwise((F.col("l_quantity") * 2).cast("string")).alias("score")))


def engagement_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engagement log with one row per (student, day) of events.

    The group-by runs a map-side partial count, so a student owning a large
    share of the raw events still reaches the shuffle as one row per day.
    """
    e = table(spark, sf_dir, "events").select("user_id", "ts")
    day = F.datediff(F.col("ts"), F.lit(LOG_START).cast("date"))
    return (e.groupBy(F.col("user_id"), day.alias("week_number"))
            .agg(F.count(F.lit(1)).alias("clicks"), F.min("ts").alias("logged_at"))
            .select(F.col("user_id").cast("string").alias("student_id"),
                    "week_number", "clicks",
                    F.lit(1).alias("days_active"), "logged_at",
                    F.lit(0).cast("bigint").alias("seq")))


def engagement_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    d = F.col("o_orderdate")
    period = ((F.year(d) - 1995) * 12 + F.month(d)).cast("int")
    return (o.groupBy(F.col("o_custkey"), period.alias("week_number"))
            .agg(F.count(F.lit(1)).alias("clicks"),
                 F.countDistinct(F.dayofmonth(d)).cast("int").alias("days_active"),
                 F.min(d).alias("logged_at"))
            .select(F.col("o_custkey").cast("string").alias("student_id"),
                    "week_number", "clicks", "days_active", "logged_at",
                    F.lit(0).cast("bigint").alias("seq")))


def _factor(k, shift: int, flip: int):
    feat_idx = (k + shift) % len(C.FEATURES)
    name = pick(C.FEATURES, feat_idx)
    high = ((k + flip) % 2) == 0
    low_text = pick([C.SUGGESTIONS[f][0] for f in C.FEATURES], feat_idx)
    high_text = pick([C.SUGGESTIONS[f][1] for f in C.FEATURES], feat_idx)
    return F.concat(name, F.lit(": "), F.when(high, high_text).otherwise(low_text)), name


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey",
                                               "o_orderdate", "o_orderpriority")
    k = F.col("o_orderkey")
    f1, _ = _factor(k, 0, 0)
    f2, _ = _factor(k, 5, 1)
    f3, f3_name = _factor(k, 9, 0)
    risk = F.coalesce(*[F.when(F.substring("o_orderpriority", 1, 1) == d, F.lit(r))
                        for d, r in PRIORITY_RISK.items()], F.lit(C.UNKNOWN))
    return o.select(k.alias("id"),
                    F.col("o_custkey").cast("string").alias("student_id"),
                    F.col("o_orderdate").alias("prediction_date"),
                    risk.alias("risk_level"),
                    ((k % 100) / 100.0).alias("confidence_score"),
                    f1.alias("top_factor_1"),
                    f2.alias("top_factor_2"),
                    F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, f3_name)
                    .otherwise(f3).alias("top_factor_3"))


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current-state table: one row per customer, risk from the newest prediction."""
    from risklens.operators.reports import latest_prediction
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey",
                                                 "c_mktsegment")
    # only the columns the state row needs go into the latest-row aggregate
    preds = predictions(spark, sf_dir).select("id", "student_id", "prediction_date",
                                              "risk_level", "confidence_score")
    latest = latest_prediction(preds).select(
        "student_id", "risk_level", "confidence_score", "prediction_date")
    base = c.select(F.col("c_custkey").cast("string").alias("student_id"),
                    F.col("c_name").alias("name"),
                    F.concat(F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]", "")),
                             F.lit("@example.edu")).alias("email"),
                    F.concat(F.lit("teacher"), F.col("c_nationkey").cast("string"),
                             F.lit("@example.edu")).alias("teacher_email"),
                    F.col("c_mktsegment").alias("course_id"))
    return (base.join(latest, "student_id", "left")
            .select("student_id", "name", "email", "teacher_email", "course_id",
                    F.coalesce("risk_level", F.lit(C.UNKNOWN)).alias("risk_level"),
                    F.coalesce("confidence_score", F.lit(0.0)).alias("confidence_score"),
                    F.lit(C.STATUS_STATIC).alias("status"),
                    F.coalesce("prediction_date",
                               F.lit(LOG_START).cast("timestamp_ntz")).alias("last_updated")))


def labelled_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label, prediction, actual, predicted) from the labels table."""
    lab = table(spark, sf_dir, "labels")
    label = (F.col("quality") + F.col("toxic") * 2).cast("int")
    pred = F.when(F.col("doc_id") % 7 == 0, (label + 1) % 4).otherwise(label).cast("int")
    return lab.select("doc_id", label.alias("label"), pred.alias("prediction")).select(
        "doc_id", "label", "prediction",
        pick(C.LABEL_ORDER, F.col("label")).alias("actual"),
        pick(C.LABEL_ORDER, F.col("prediction")).alias("predicted"))


__all__ = [
    "SEGMENTS", "PRESENTATION", "table", "student_info", "student_vle", "assessments",
    "student_assessment", "engagement_daily", "engagement_monthly", "predictions",
    "students", "labelled_predictions",
]
