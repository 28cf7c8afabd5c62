"""Engagement drift: each student against their own early baseline.

For every student with engagement history the newest row is the "current"
week; the first ``max(1, floor(n * fraction))`` rows form the baseline.
z = (current - mean) / std (population std, 1.0 when flat); drift when
|z| > threshold (strict). Fewer than ``min_history`` rows: no drift, z 0.

Plan: a student's series is cut into pieces of ``PIECE_WEEKS`` weeks. A window
numbers the rows of a (student, piece) and sums them up; the pieces' totals,
one row each, carry what came before into every piece. So no task needs the
whole series of a student who owns a third of the log, and the window and the
totals share one exchange. Baselines are plain aggregates of the rows up to
the baseline's end, combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from risklens import constants as C
from risklens.functions.expr import fill_template, fixed

ORDER_COLUMNS = ("week_number", "logged_at", "seq")


def _order(log: DataFrame) -> list[str]:
    return [c for c in ORDER_COLUMNS if c in log.columns]


#: Weeks of a piece of a student's series.
PIECE_WEEKS = 16


def positions(log: DataFrame, *columns: str) -> DataFrame:
    """(student_id, *columns, clicks double, rn, n, s, q): the place of each row in its
    student's series, the length of the series, and the sums of clicks and of their
    squares up to the row. Rows without a week come first, as in any order."""
    rows = log.withColumns({"clicks": F.col("clicks").cast("double"),
                            "piece": F.coalesce(F.floor(F.col("week_number") / PIECE_WEEKS), F.lit(-(1 << 62)))})
    inside = Window.partitionBy("student_id", "piece").orderBy(*_order(log))
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = F.col("clicks")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    own = rows.select("student_id", "piece", *columns, x, F.row_number().over(inside).alias("rn"),
                      zero(F.sum(x).over(running)).alias("s"), zero(F.sum(x * x).over(running)).alias("q"))
    totals = rows.groupBy("student_id", "piece").agg(F.count(F.lit(1)).alias("n"), zero(F.sum(x)).alias("s"), zero(F.sum(x * x)).alias("q"))
    every = Window.partitionBy("student_id")
    before = every.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col("student_id").alias("_id"), F.col("piece").alias("_piece"), F.sum("n").over(every).alias("n"),
                            *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("n", "s", "q")])
    joined = own.join(carried, F.col("student_id").eqNullSafe(F.col("_id")) & (F.col("piece") == F.col("_piece")))
    return joined.select("student_id", *columns, "clicks", (F.col("rn") + F.col("n0")).alias("rn"), "n",
                         (F.col("s") + F.col("s0")).alias("s"), (F.col("q") + F.col("q0")).alias("q"))


def drift_scores(log: DataFrame, threshold: float = C.Z_SCORE_THRESHOLD,
                 fraction: float = C.BASELINE_FRACTION,
                 min_history: int = C.MIN_HISTORY) -> DataFrame:
    """(student_id, history_len, baseline_n, baseline_mean, baseline_std,
    current_clicks, z_score, drift_detected, direction) - unrounded."""
    rows = positions(log)
    base_len = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(float(fraction))))
    in_base = F.col("rn") <= base_len
    agg = rows.groupBy("student_id").agg(
        F.max("n").alias("history_len"),
        F.count(F.when(in_base, F.lit(1))).alias("base_n"),
        F.avg(F.when(in_base, F.col("clicks"))).alias("mean_raw"),
        F.stddev_pop(F.when(in_base, F.col("clicks"))).alias("std_raw"),
        F.max_by("clicks", "rn").alias("current"))
    short = F.col("history_len") < min_history
    std = F.when(F.col("std_raw") < C.FLAT_STD_EPSILON, F.lit(1.0)).otherwise(F.col("std_raw"))
    z = (F.col("current") - F.col("mean_raw")) / std
    drift = F.abs(z) > F.lit(float(threshold))
    return agg.select(
        "student_id", "history_len",
        F.when(short, F.lit(0)).otherwise(F.col("base_n")).cast("bigint").alias("baseline_n"),
        F.when(short, F.lit(0.0)).otherwise(F.col("mean_raw")).alias("baseline_mean"),
        F.when(short, F.lit(0.0)).otherwise(std).alias("baseline_std"),
        F.col("current").cast("bigint").alias("current_clicks"),
        F.when(short, F.lit(0.0)).otherwise(z).alias("z_score"),
        F.when(short, F.lit(False)).otherwise(drift).alias("drift_detected"))



def direction(z: Column, drift: Column) -> Column:
    return (F.when(drift & (z < 0), F.lit("drop"))
            .when(drift & (z > 0), F.lit("rise")).otherwise(F.lit("none")))


def drift_message(history_len: Column, current: Column, mean: Column, z: Column,
                  drift: Column, min_history: int = C.MIN_HISTORY,
                  threshold: float = C.Z_SCORE_THRESHOLD) -> Column:
    """The text logged with every check (short / drop / rise / normal)."""
    values = dict(current=current.cast("string"), mean=fixed(mean, 1),
                  z=fixed(z, 2), threshold=F.lit(str(threshold)))
    return (F.when(history_len < min_history, F.lit(C.MSG_SHORT_HISTORY))
            .when(drift & (z < 0), fill_template(C.MSG_DROP, **values))
            .when(drift & (z > 0), fill_template(C.MSG_RISE, **values))
            .otherwise(fill_template(C.MSG_NORMAL, z=values["z"])))


def drift_all(log: DataFrame, **kw) -> DataFrame:
    """Drift check of every student with history, as the sweep reports it:
    z rounded to 4, baseline mean and std to 2 (ties to even), plus the
    direction and the message that is logged."""
    s = drift_scores(log, **kw)
    threshold = kw.get("threshold", C.Z_SCORE_THRESHOLD)
    min_history = kw.get("min_history", C.MIN_HISTORY)
    return s.select(
        "student_id", "history_len", "baseline_n",
        F.bround("baseline_mean", 2).alias("baseline_mean"),
        F.bround("baseline_std", 2).alias("baseline_std"),
        "current_clicks",
        F.bround("z_score", 4).alias("z_score"),
        "drift_detected",
        direction(F.col("z_score"), F.col("drift_detected")).alias("direction"),
        drift_message(F.col("history_len"), F.col("current_clicks"), F.col("baseline_mean"),
                      F.col("z_score"), F.col("drift_detected"), min_history,
                      threshold).alias("alert_message"))


def drift_log_rows(checks: DataFrame, checked_at: Column | None = None) -> DataFrame:
    """Rows for the drift log: every check, also the non-drift ones (0/1 flag)."""
    checked_at = checked_at if checked_at is not None else F.localtimestamp()
    return checks.select("student_id", checked_at.alias("checked_at"),
                         F.col("z_score").cast("double").alias("z_score"),
                         F.col("drift_detected").cast("int").alias("drift_detected"),
                         "alert_message")


def drift_summary(checks: DataFrame) -> DataFrame:
    """Counts of one sweep: students checked, flagged, drops, rises, short."""
    return checks.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(F.col("drift_detected")).alias("flagged"),
        F.count_if(F.col("drift_detected") & (F.col("z_score") < 0)).alias("drops"),
        F.count_if(F.col("drift_detected") & (F.col("z_score") > 0)).alias("rises"),
        F.count_if(F.col("history_len") < C.MIN_HISTORY).alias("short_history"))


def drift_baseline(log: DataFrame, fraction: float = C.BASELINE_FRACTION) -> DataFrame:
    """Baseline rows of every student: the ordered prefix and its statistics."""
    rows = positions(log, "week_number")
    base_len = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(float(fraction))))
    return (rows.where(F.col("rn") <= base_len)
            .groupBy("student_id")
            .agg(F.count(F.lit(1)).alias("baseline_n"),
                 F.min("week_number").alias("first_week"),
                 F.max("week_number").alias("last_week"),
                 F.avg("clicks").alias("baseline_mean"),
                 F.stddev_pop("clicks").alias("baseline_std")))


def drift_replay(log: DataFrame, threshold: float = C.Z_SCORE_THRESHOLD,
                 fraction: float = C.BASELINE_FRACTION,
                 min_history: int = C.MIN_HISTORY) -> DataFrame:
    """The check that ran when each row arrived, for every row.

    Row p of a student's series is "current" with history rows 1..p; its
    baseline is rows 1..b, b = max(1, floor(p * fraction)). Running sums
    S and Q (sum of squares) over the ordered series give every prefix; the
    row at position b is found by an equi-join on (student, position), so
    there is no per-row scan of earlier rows. Variance = (b*Q - S^2) / b^2,
    exact for integer clicks.
    """
    when = ["logged_at"] if "logged_at" in log.columns else []
    rows = positions(log, "week_number", *when).withColumnRenamed("rn", "p")
    prefix = rows.select("student_id", F.col("p").alias("b"), F.col("s").alias("sb"),
                         F.col("q").alias("qb"))
    cur = rows.withColumn("b", F.greatest(F.lit(1), F.floor(F.col("p") * F.lit(float(fraction)))))
    j = cur.join(prefix, ["student_id", "b"])
    mean = F.col("sb") / F.col("b")
    var = F.greatest(F.lit(0.0), (F.col("b") * F.col("qb") - F.col("sb") * F.col("sb"))
                     / (F.col("b") * F.col("b")))
    std_raw = F.sqrt(var)
    std = F.when(std_raw < C.FLAT_STD_EPSILON, F.lit(1.0)).otherwise(std_raw)
    short = F.col("p") < min_history
    z = F.when(short, F.lit(0.0)).otherwise((F.col("clicks") - mean) / std)
    return j.select(
        "student_id", "week_number", *when,
        F.col("p").cast("bigint").alias("history_len"),
        F.col("clicks").cast("bigint").alias("current_clicks"),
        F.when(short, F.lit(0.0)).otherwise(mean).alias("baseline_mean"),
        F.when(short, F.lit(0.0)).otherwise(std).alias("baseline_std"),
        z.alias("z_score"),
        (~short & (F.abs(z) > F.lit(float(threshold)))).alias("drift_detected"))


def drift_log_from_replay(replay: DataFrame) -> DataFrame:
    """Drift-log rows (checked_at = arrival time of the row checked)."""
    msg = drift_message(F.col("history_len"), F.col("current_clicks"), F.col("baseline_mean"),
                        F.col("z_score"), F.col("drift_detected"))
    return replay.select("student_id", F.col("logged_at").alias("checked_at"),
                         F.col("z_score"), F.col("drift_detected").cast("int").alias("drift_detected"),
                         msg.alias("alert_message"))
