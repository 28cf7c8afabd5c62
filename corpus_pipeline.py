"""The corpus pipeline: documents to token ids in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared folder and reads it back as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from risklens.llm import decontaminate, exact_dedup, jaccard_join, language_id, pieces
from risklens.llm.common import stored

STAGES = [
    ("language_id", language_id.keep_known),
    ("exact_dedup", exact_dedup.keep_one),
    ("jaccard_join", jaccard_join.keep_one),
    ("decontaminate", decontaminate.keep_clean),
    ("sentencepiece", pieces.encode_stage),
]

#: SQL can express neither the network nor the pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(spark, stage(spark, docs, sf_dir), name)
    return docs
