"""The four raw learning-analytics CSV tables, with explicit schemas.

studentInfo is mandatory (a clear error when absent); the other three are
optional and come back as ``None`` when absent, so the feature builder
fills their columns with zeros. Each is one distributed scan: input splits
replace the original chunked reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType)
from pyspark.sql.utils import AnalysisException

from risklens.session import path_missing

STUDENT_INFO = StructType([
    StructField("code_module", StringType()), StructField("code_presentation", StringType()),
    StructField("id_student", LongType()), StructField("gender", StringType()),
    StructField("region", StringType()), StructField("highest_education", StringType()),
    StructField("imd_band", StringType()), StructField("age_band", StringType()),
    StructField("num_of_prev_attempts", IntegerType()), StructField("studied_credits", IntegerType()),
    StructField("disability", StringType()), StructField("final_result", StringType()),
])
ASSESSMENTS = StructType([
    StructField("code_module", StringType()), StructField("code_presentation", StringType()),
    StructField("id_assessment", LongType()), StructField("assessment_type", StringType()),
    StructField("date", StringType()), StructField("weight", DoubleType()),
])
STUDENT_ASSESSMENT = StructType([
    StructField("id_assessment", LongType()), StructField("id_student", LongType()),
    StructField("date_submitted", StringType()), StructField("is_banked", StringType()),
    StructField("score", StringType()),  # text: may hold '?'
])
STUDENT_VLE = StructType([
    StructField("code_module", StringType()), StructField("code_presentation", StringType()),
    StructField("id_student", LongType()), StructField("id_site", LongType()),
    StructField("date", IntegerType()), StructField("sum_click", LongType()),
])

FILES = {
    "studentInfo": ("studentInfo.csv", STUDENT_INFO),
    "assessments": ("assessments.csv", ASSESSMENTS),
    "studentAssessment": ("studentAssessment.csv", STUDENT_ASSESSMENT),
    "studentVle": ("studentVle.csv", STUDENT_VLE),
}


class MissingSourceError(FileNotFoundError):
    pass


def read_table(spark: SparkSession, data_dir: str, name: str) -> DataFrame | None:
    fname, schema = FILES[name]
    path = f"{data_dir.rstrip('/')}/{fname}"
    try:
        df = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
              .option("enforceSchema", False).csv(path))
        df.schema  # resolve now so a missing path fails here
        return df
    except AnalysisException as e:
        if not path_missing(e):  # a broken source isn't an absent one
            raise
        return None


def load_sources(spark: SparkSession, data_dir: str) -> dict[str, DataFrame]:
    """All present sources keyed by table name; studentInfo is required."""
    out = {}
    for name in FILES:
        df = read_table(spark, data_dir, name)
        if df is not None:
            out[name] = df
    if "studentInfo" not in out:
        raise MissingSourceError(f"studentInfo.csv not found in {data_dir}")
    return out
