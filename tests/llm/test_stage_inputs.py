"""Stages of the pipeline on odd columns, missing ids and empty tables."""

import pytest

from risklens.llm import decontaminate, exact_dedup, jaccard_join, language_id, pieces

SF = "/root/testdata/sf0.001"
NAMES = ["_key", "_set", "_id", "_name", "_doc", "_text", "_own", "own", "id", "size", "digest", "copy", "mark"]
BASE = " ".join(f"word{k}" for k in range(60))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, BASE), (2, BASE), (3, BASE + " end"), (None, BASE), (None, "something else that stays"), (4, None), (5, ""), (3, BASE + " end")]
    return spark.createDataFrame([(i, t, *[f"{n}{k}" for n in NAMES]) for k, (i, t) in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in NAMES))


@pytest.mark.parametrize("stage", [exact_dedup.keep_one, jaccard_join.keep_one])
def test_other_columns_come_back(spark, odd, stage):
    out = stage(spark, odd, SF)
    assert out.schema == odd.schema
    given = {tuple(r) for r in odd.collect()}
    got = out.collect()
    assert {tuple(r) for r in got} <= given
    texts = sorted(((r.doc_id, r.text) for r in got), key=repr)
    if stage is exact_dedup.keep_one:  # null and empty are equal texts
        assert texts == sorted([(2, BASE), (3, BASE + " end"), (None, "something else that stays"), (5, "")], key=repr)
    else:
        assert texts == sorted([(1, BASE), (None, "something else that stays"), (4, None), (5, "")], key=repr)


def test_many_rows_without_id(spark):
    """Rows without id meet their own text only: the join stays linear."""
    docs = spark.createDataFrame([(None, f"{BASE} number {k % 50}") for k in range(2000)], "doc_id long, text string")
    prepared = docs.selectExpr("doc_id", "text", "xxhash64(text) own")
    sets = jaccard_join.document_sets(prepared, 5)
    wanted = sets.where("id is not null").groupBy("id").agg({"own": "min"}).selectExpr("id", "cast(null as long) doc_id", "`min(own)` own")
    assert jaccard_join.set_items(spark, prepared, wanted, 5).count() == 50
    assert jaccard_join.keep_one(spark, docs, SF).count() == 1


@pytest.mark.parametrize("stage", [exact_dedup.keep_one, jaccard_join.keep_one, decontaminate.keep_clean, language_id.keep_known, pieces.encode_stage])
def test_empty_tables(spark, odd, stage):
    table = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    out = stage(spark, table, SF)
    assert out.count() == 0
    if stage is not pieces.encode_stage:
        assert out.columns == table.columns
