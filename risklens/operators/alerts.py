"""Alerts: D9 selection, D10 outbox, D11 outcome summary, D12 student notices.

Delivery (SMTP) is not built: the outbox table holds the messages that
would be sent. Factor lists come from at most three factors per student, so
the per-student list is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risklens import constants as C
from risklens.functions.expr import fill_template, fixed, literal_map

TEACHER_BODY = ("Student: {name}\nZ-Score: {z} (threshold: ±{threshold})\n\n"
                "Top Risk Factors & Recommended Actions:\n{factors}")
STUDENT_BODY = "Hi {name},\n\nTip: {tip}\n"


def high_risk(rows: DataFrame) -> DataFrame:
    """Rows whose class is High Risk."""
    return rows.where(F.col("risk_level") == F.lit("High Risk"))


def factor_lists(factors: DataFrame) -> DataFrame:
    """(student_id, factors_text, top_suggestion) from parsed factor rows
    (student_id, slot, feature, suggestion); numbered 1.. in slot order."""
    grouped = factors.groupBy("student_id").agg(
        F.array_sort(F.collect_list(F.struct("slot", "feature", "suggestion"))).alias("fs"))
    numbered = F.transform(
        "fs", lambda f, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "),
                                    f["feature"], F.lit(": "), f["suggestion"], F.lit("\n")))
    return grouped.select("student_id", F.array_join(numbered, "").alias("factors_text"),
                          F.col("fs")[0]["suggestion"].alias("top_suggestion"))


def alert_outbox(alerts: DataFrame, factors: DataFrame | None = None,
                 z: Column | None = None) -> DataFrame:
    """One teacher message and one student message per alert; a blank
    address produces no message. (student_id, role, recipient, subject, body)."""
    z = z if z is not None else F.lit(0.0)
    base = alerts.select("student_id", "name", "email", "teacher_email", z.alias("_z"))
    if factors is not None:
        base = base.join(factor_lists(factors), "student_id", "left")
    else:
        base = base.select("*", F.lit(None).cast("string").alias("factors_text"),
                           F.lit(None).cast("string").alias("top_suggestion"))
    name = F.coalesce(F.col("name"), F.lit(""))
    teacher = F.struct(
        F.lit("teacher").alias("role"), F.col("teacher_email").alias("recipient"),
        fill_template(C.ALERT_TEACHER_SUBJECT, name=name).alias("subject"),
        fill_template(TEACHER_BODY, name=name, z=fixed(F.col("_z"), 2),
                      threshold=F.lit(str(C.Z_SCORE_THRESHOLD)),
                      factors=F.coalesce(F.nullif(F.col("factors_text"), F.lit("")),
                                         F.lit(C.ALERT_NO_FACTORS))).alias("body"))
    student = F.struct(
        F.lit("student").alias("role"), F.col("email").alias("recipient"),
        F.lit(C.ALERT_STUDENT_SUBJECT).alias("subject"),
        fill_template(STUDENT_BODY, name=name,
                      tip=F.coalesce(F.col("top_suggestion"), F.lit(""))).alias("body"))
    out = base.select("student_id", F.explode(F.array(teacher, student)).alias("m")).select(
        "student_id", "m.*")
    return out.where(F.col("recipient").isNotNull() & (F.trim(F.col("recipient")) != ""))


def alert_summary(alerts: DataFrame, outbox: DataFrame) -> DataFrame:
    """Per alert, which messages were produced and the status line."""
    flags = outbox.groupBy("student_id").agg(
        F.max((F.col("role") == "teacher").cast("int")).alias("t"),
        F.max((F.col("role") == "student").cast("int")).alias("s"))
    j = alerts.select("student_id").join(flags, "student_id", "left")
    t = F.coalesce(F.col("t"), F.lit(0)) == 1
    s = F.coalesce(F.col("s"), F.lit(0)) == 1
    msg = (F.when(t & s, F.lit("Both messages queued."))
           .when(t, F.lit("Teacher message queued. Student message not queued (no address)."))
           .when(s, F.lit("Student message queued. Teacher message not queued (no address)."))
           .otherwise(F.lit("No messages queued (no addresses).")))
    return j.select("student_id", t.alias("teacher_sent"), s.alias("student_sent"),
                    (t | s).alias("success"), msg.alias("message"))


def student_message(students: DataFrame) -> DataFrame:
    """Motivational notice by class (unknown -> On Track) and the
    drift banner for Dynamic Risk."""
    emoji = literal_map({k: v[0] for k, v in C.MOTIVATIONAL.items()})
    text = literal_map({k: v[1] for k, v in C.MOTIVATIONAL.items()})
    r = F.col("risk_level")
    return students.select(
        "student_id", "risk_level",
        F.coalesce(emoji[r], F.lit(C.MOTIVATIONAL["On Track"][0])).alias("emoji"),
        F.coalesce(text[r], F.lit(C.MOTIVATIONAL["On Track"][1])).alias("message"),
        F.when(F.col("status") == C.STATUS_DYNAMIC, F.lit(C.DRIFT_BANNER)).alias("banner"))
