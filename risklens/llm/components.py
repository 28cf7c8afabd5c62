"""Connected components of a link table, as rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risklens.llm.common import stored


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(id, comp) of every end of ``links`` (a, b); comp is the least id that
    links reach.

    Every round sends each node to its least neighbour (or itself), follows that
    pointer once more, and contracts the links; parents are never larger, so
    pointers form trees. A star around its least node is done in one round, and
    long chains shrink by a factor each round. Links of a hot node are reduced
    to a minimum map-side; every round is written to the shared folder.
    """
    links = stored(spark, links.select("a", "b").where("a <> b").distinct(), "links")
    labels = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stored(spark, both.groupBy("a").agg(F.min("b").alias("p"))
                        .select(F.col("a").alias("u"), F.least("a", "p").alias("p")), "parent")
        up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        jump = stored(spark, parent.join(up, "p").select("u", F.col("pp").alias("p")), "jump")
        if labels is None:
            labels = jump.select(F.col("u").alias("id"), F.col("p").alias("comp"))
        else:
            labels = stored(spark, labels.join(jump, labels["comp"] == jump["u"], "left")
                            .select("id", F.coalesce("p", "comp").alias("comp")), "labels")
        a, b = jump.select(F.col("u").alias("a"), F.col("p").alias("pa")), jump.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        links = stored(spark, links.join(a, "a").join(b, "b").where("pa <> pb")
                       .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
        if links.isEmpty():
            return labels
