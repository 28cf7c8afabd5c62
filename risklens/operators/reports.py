"""Reports on the state tables (students, predictions, engagement, drift log).

Latest-row-per-key uses ``max_by`` over a struct ordering key: it is an
aggregate with a map-side partial step, so a student owning a large share of
the history collapses to one row per task before the shuffle, instead of
landing whole in one window partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklens import constants as C
from risklens.functions.expr import literal_map, percent_text


def latest_by_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Newest row of every key by ``order`` (descending, lexicographic)."""
    cols = [c for c in df.columns]
    packed = df.groupBy(key).agg(
        F.max_by(F.struct(*cols), F.struct(*order)).alias("_row"))
    return packed.select(*[F.col("_row")[c].alias(c) for c in cols])


def latest_prediction(predictions: DataFrame) -> DataFrame:
    """Newest prediction of every student (date, then id, breaks ties)."""
    order = ["prediction_date"] + (["id"] if "id" in predictions.columns else [])
    return latest_by_key(predictions, "student_id", order)


def students_all(students: DataFrame) -> DataFrame:
    """Every student, most recently updated first."""
    return students.orderBy(F.col("last_updated").desc(), F.col("student_id"))


def student_lookup(students: DataFrame, student_id) -> DataFrame:
    """One student by id (the id is compared as text)."""
    return students.where(F.col("student_id") == F.lit(str(student_id)))


def students_by_teacher(students: DataFrame, teacher_email: str) -> DataFrame:
    """One teacher's students ordered by risk level (alphabetical)."""
    return (students.where(F.col("teacher_email") == F.lit(teacher_email))
            .orderBy("risk_level", "student_id"))


def students_by_teacher_fallback(students: DataFrame, teacher_email: str) -> DataFrame:
    """The teacher's students, or every student when the teacher has none.

    The emptiness test is one scalar count (bounded), decided on the driver
    the same way the class view decides it.
    """
    mine = students.where(F.col("teacher_email") == F.lit(teacher_email))
    has_any = mine.limit(1).count() > 0
    return (mine if has_any else students).orderBy("risk_level", "student_id")


def students_by_risk(students: DataFrame, risk_filter: str) -> DataFrame:
    """P5: 'All' keeps every row, 'Dynamic Risk' tests the status, any other
    value tests the risk level."""
    if risk_filter == "All":
        return students
    if risk_filter == C.STATUS_DYNAMIC:
        return students.where(F.col("status") == F.lit(C.STATUS_DYNAMIC))
    return students.where(F.col("risk_level") == F.lit(risk_filter))


def student_count(students: DataFrame) -> DataFrame:
    """A6."""
    return students.agg(F.count(F.lit(1)).alias("student_count"))


def risk_counts(students: DataFrame) -> DataFrame:
    """Students per risk level."""
    return students.groupBy("risk_level").agg(F.count(F.lit(1)).alias("cnt"))


def risk_kpis(students: DataFrame) -> DataFrame:
    """Total and per-class counters (with the real class names)."""
    r = F.col("risk_level")
    return students.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(r == "High Risk").alias("high_risk"),
        F.count_if(r == "Moderate Risk").alias("moderate_risk"),
        F.count_if(r == "On Track").alias("on_track"),
        F.count_if(r == "Excelling").alias("excelling"))


def risk_distribution(students: DataFrame) -> DataFrame:
    """Value counts of the risk level, largest first."""
    return (students.groupBy(F.col("risk_level"))
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("risk_level")))


def class_overview(students: DataFrame) -> DataFrame:
    """The class table as displayed (renamed, confidence as percent)."""
    return students.select(
        F.col("student_id").alias("ID"), F.col("name").alias("Name"),
        F.col("risk_level").alias("Risk Level"),
        percent_text("confidence_score").alias("Confidence"),
        F.col("status").alias("Status"), F.col("last_updated").alias("Updated"))


def latest_factors(predictions: DataFrame) -> DataFrame:
    """Factors of each student's newest prediction, parsed.

    'feature: text' splits on the first ':' (both parts trimmed); a factor
    without ':' uses its whole text for both; empty factors are skipped.
    impact = 1 / position (1-based, counted over the three slots)."""
    latest = latest_prediction(predictions)
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), F.col(f"top_factor_{i}").alias("text"))
                      for i in (1, 2, 3)])
    rows = latest.select("student_id", F.explode(slots).alias("f")).where(
        F.col("f.text").isNotNull() & (F.col("f.text") != ""))
    parts = F.split(F.col("f.text"), ":", 2)
    has_colon = F.size(parts) > 1
    return rows.select(
        "student_id", F.col("f.slot").alias("slot"),
        F.trim(parts[0]).alias("feature"),
        F.when(has_colon, F.trim(parts[1])).otherwise(F.col("f.text")).alias("suggestion"),
        (F.lit(1.0) / F.col("f.slot")).alias("impact"))


def risk_trajectory(predictions: DataFrame) -> DataFrame:
    """Risk as 1..4 over prediction time, oldest first."""
    num = literal_map(C.RISK_NUMERIC)
    order = ["student_id", "prediction_date"] + (["id"] if "id" in predictions.columns else [])
    return (predictions.select("student_id", "prediction_date", "risk_level",
                               *(["id"] if "id" in predictions.columns else []),
                               num[F.col("risk_level")].alias("risk_numeric"))
            .orderBy(*order))


def engagement_history(log: DataFrame) -> DataFrame:
    """Engagement rows ordered by week per student (ties: logged_at, seq)."""
    order = ["student_id"] + [c for c in ("week_number", "logged_at", "seq") if c in log.columns]
    return log.orderBy(*order)


def drift_history(drift_log: DataFrame) -> DataFrame:
    """Drift checks newest first, displayed with Yes/No."""
    return (drift_log.select(
        "student_id", F.col("checked_at").alias("Date"), F.col("z_score").alias("Z-Score"),
        F.when(F.col("drift_detected") == 1, F.lit("⚠️ Yes")).otherwise(F.lit("✅ No")).alias("Drift?"),
        F.col("alert_message").alias("Details"))
        .orderBy(F.col("student_id"), F.col("Date").desc()))


def batch_preview(upload: DataFrame, order: str = "student_id", n: int = 10) -> DataFrame:
    """The first 10 rows of an upload, after a total order."""
    return upload.orderBy(order).limit(n)
