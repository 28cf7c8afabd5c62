"""Encoding: M1 demographics, W6 region codes, M2 target, M3/M18 label index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from risklens import constants as C
from risklens.functions.expr import code_lookup, literal_map, pick


def fit_region_codes(df: DataFrame, column: str = "region") -> DataFrame:
    """(region, code) with codes 0..k-1 in sorted order of the distinct
    regions. The window runs over the distinct list only (one row per
    region), never over the student rows. Persist the result with a model."""
    regions = df.select(F.col(column).alias("region")).where(F.col("region").isNotNull()).distinct()
    return regions.select("region",
                          (F.dense_rank().over(Window.orderBy("region")) - 1).cast("int").alias("code"))


def apply_region_codes(df: DataFrame, codes: DataFrame, column: str = "region") -> DataFrame:
    """Replace the region text with its code; a value that is a saved code already
    (as a number or its text) stays; unseen or null regions -> 0.
    The code table has one row per distinct region; Spark broadcasts it
    when its measured size allows."""
    text = codes.select(F.col("region").cast("string").alias("_region"), F.col("code").alias("_code"), F.lit(0).alias("_rank"))
    coded = codes.select(F.col("code").cast("string").alias("_region"), F.col("code").alias("_code"), F.lit(1).alias("_rank"))
    c = text.unionByName(coded).groupBy("_region").agg(F.min_by("_code", "_rank").alias("_code"))
    joined = df.join(c, df[column].cast("string") == c["_region"], "left")
    return joined.withColumn(column, F.coalesce(F.col("_code"), F.lit(0)).cast("int")).drop(
        "_region", "_code")


def encode_demographics(df: DataFrame, region_codes: DataFrame | None = None,
                        accept_codes: bool = True) -> DataFrame:
    """M1: text categories -> integer codes with the fixed defaults.
    ``accept_codes=False`` gives the strict behaviour where already-encoded
    integers fall back to the defaults."""
    out = df.withColumns({
        "gender": code_lookup("gender", C.GENDER_CODES, accept_codes),
        "age_band": code_lookup("age_band", C.AGE_CODES, accept_codes),
        "highest_education": code_lookup("highest_education", C.EDUCATION_CODES, accept_codes),
        "imd_band": code_lookup("imd_band", C.IMD_CODES, accept_codes),
        "disability": code_lookup("disability", C.DISABILITY_CODES, accept_codes),
    })
    if "region" in df.columns:
        if region_codes is None:
            region_codes = fit_region_codes(df)
        out = apply_region_codes(out, region_codes)
    return out


def encode_target(df: DataFrame, column: str = "final_result") -> DataFrame:
    """Course outcome -> risk class; rows with other outcomes dropped."""
    mapped = literal_map(C.TARGET_MAP)[F.col(column)]
    return df.withColumn(column, mapped).where(F.col(column).isNotNull())


def label_index(df: DataFrame, column: str = "final_result", out: str = "label") -> DataFrame:
    """M3: class -> index in alphabetical order (Excelling 0 ... On Track 3)."""
    idx = literal_map({c: float(i) for i, c in enumerate(C.LABEL_ORDER)})
    return df.withColumn(out, idx[F.col(column)])


def decode_label(index_col: str, out: str = "risk_level") -> F.Column:
    """Index -> class name; out-of-range -> 'Unknown'."""
    return F.coalesce(pick(C.LABEL_ORDER, F.col(index_col)), F.lit(C.UNKNOWN)).alias(out)


def class_distribution(df: DataFrame, column: str = "final_result") -> DataFrame:
    """A10: rows per class and their percentage (the window runs over the
    per-class counts only)."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    return counts.select(column, "count", (F.col("count") * 100.0 / total).alias("percent"))
