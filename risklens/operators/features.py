"""Per-student features: A1-A5, J1-J4, P9, P10.

The click log is the large input. It is reduced once to one row per
(student, day) - a partial aggregate, so a very active student is
collapsed map-side - and both the engagement totals and the weekly series
are computed from that daily table, so the log is scanned once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklens import constants as C
from risklens.functions.expr import coerce_numeric, floor_week, safe_div

KEYS = C.STUDENT_KEYS


def _keys_present(df: DataFrame) -> DataFrame:
    """Grouping drops rows with a null key (as the original groupby did)."""
    cond = None
    for k in KEYS:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.where(cond)


def vle_daily(vle: DataFrame) -> DataFrame:
    """(keys, date, clicks): clicks per student and relative day."""
    return (_keys_present(vle).groupBy(*KEYS, "date")
            .agg(F.sum("sum_click").alias("clicks")))


def engagement_from_daily(daily: DataFrame) -> DataFrame:
    return daily.groupBy(*KEYS).agg(
        F.sum("clicks").alias("sum_clicks"),
        F.count(F.lit(1)).alias("days_active"),
        F.max("date").alias("last_active_day"))


def weekly_from_daily(daily: DataFrame) -> DataFrame:
    return (daily.groupBy(*KEYS, floor_week("date").alias("week"))
            .agg(F.sum("clicks").alias("clicks")))


def trend_from_daily(daily: DataFrame) -> DataFrame:
    return weekly_from_daily(daily).groupBy(*KEYS).agg(
        F.when(F.count(F.lit(1)) >= 2,
               F.regr_slope(F.col("clicks").cast("double"), F.col("week").cast("double")))
        .otherwise(F.lit(0.0)).alias("click_trend"))


def vle_engagement(vle: DataFrame) -> DataFrame:
    """A1: total clicks, distinct active days and last active day per student
    (distinct days are exact; no double counting across input splits)."""
    return engagement_from_daily(vle_daily(vle))


def weekly_clicks(vle: DataFrame) -> DataFrame:
    """A3: clicks per student and week (week = floor(day / 7))."""
    return weekly_from_daily(vle_daily(vle))


def click_trend(vle: DataFrame) -> DataFrame:
    """A4: least-squares slope of weekly clicks over active weeks; 0 when
    fewer than 2 weeks are active."""
    return trend_from_daily(vle_daily(vle))


def weighted_avg_score(student_assessment: DataFrame, assessments: DataFrame) -> DataFrame:
    """sum(score * weight) / sum(weight) per student, 0 when the weight
    sum is not positive. Bad score text counts as 0; a missing weight as 0.
    Scores of unknown assessments carry no module and are dropped.

    The join is left on ``id_assessment``; Spark broadcasts the assessment
    table only when its measured size is under the broadcast limit, and AQE
    splits a skewed assessment partition otherwise."""
    a = assessments.select("id_assessment", "code_module", "code_presentation", "weight")
    rows = (student_assessment.join(a, "id_assessment", "left")
            .select(*KEYS,
                    coerce_numeric("score").alias("score"),
                    F.coalesce(F.col("weight"), F.lit(0.0)).alias("weight")))
    agg = (_keys_present(rows).groupBy(*KEYS)
           .agg(F.sum(F.col("score") * F.col("weight")).alias("total_weighted_score"),
                F.sum("weight").alias("total_weight")))
    return agg.select(*KEYS, safe_div("total_weighted_score", "total_weight")
                      .alias("weighted_avg_score"))


def master_features(student_info: DataFrame, student_assessment: DataFrame | None,
                    assessments: DataFrame | None, vle: DataFrame | None) -> DataFrame:
    """One row per (module, presentation, student) with the
    demographic columns, the target and the six engagement columns.
    An absent source gives zero columns."""
    master = student_info
    if student_assessment is not None and assessments is not None:
        master = master.join(weighted_avg_score(student_assessment, assessments), KEYS, "left")
    else:
        master = master.withColumn("weighted_avg_score", F.lit(0.0))
    if vle is not None:
        # one daily table feeds both aggregates: the click log is scanned and
        # shuffled once (the second use reuses the exchange)
        daily = vle_daily(vle)
        master = (master.join(engagement_from_daily(daily), KEYS, "left")
                  .join(trend_from_daily(daily), KEYS, "left"))
    else:
        master = master.select("*", F.lit(0).cast("bigint").alias("sum_clicks"),
                               F.lit(0).cast("bigint").alias("days_active"),
                               F.lit(0).alias("last_active_day"),
                               F.lit(0.0).alias("click_trend"))
    master = master.withColumn("avg_clicks_per_day", safe_div("sum_clicks", "days_active"))
    return master.na.fill(0, subset=C.ENGAGEMENT_FILL)


def source_profile(sources: dict[str, DataFrame], key: str = "id_student",
                   other_key: str = "id_assessment") -> DataFrame:
    """Rows, rows with a null key and distinct students per source. A source
    without students (assessments) is held against its own key and has 0 of them."""
    parts = []
    for name, df in sources.items():
        has = key in df.columns
        parts.append(df.agg(F.lit(name).alias("source"),
                            F.count(F.lit(1)).alias("rows"),
                            F.count_if(F.col(key if has else other_key).isNull()).alias("null_keys"),
                            (F.countDistinct(key) if has else F.lit(0).cast("bigint")).alias("students")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
