"""Ensemble, attribution, registry and ingest invariants (small tree counts;
the registered queries use the full 200 trees / 100 rounds)."""

import tempfile

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from risklens import constants as C
from risklens.operators import attribution, tree_paths
from risklens.operators.ensemble import EnsembleParams
from risklens.operators.registry import Registry
from risklens.plans import training
from risklens.plans.q_features import master
from risklens.plans.scoring import ingest_scored, score_upload
from risklens.sources.state_store import StateStore

SF = "/root/testdata/sf0.001"
SMALL = EnsembleParams(rf_trees=8, rf_depth=5, gbt_rounds=4, gbt_depth=3)


@pytest.fixture(scope="module")
def art(spark):
    root = tempfile.mkdtemp(prefix="rl-models-")
    return training.train(spark, master(spark, SF), root, SMALL), root


@pytest.fixture(scope="module")
def upload(spark):
    from risklens.plans.q_model import upload_rows
    return upload_rows(spark, SF)


def test_probabilities_and_confidence(spark, art, upload):
    a, _ = art
    s = score_upload(upload, a, explain=False)
    rows = s.select("probability", "confidence_score", "risk_level", "status").collect()
    assert len(rows) == upload.count()
    for r in rows:
        assert sum(r.probability) == pytest.approx(1.0, abs=1e-9)
        assert r.confidence_score == max(r.probability)
        assert r.risk_level in C.LABEL_ORDER and r.status == "Static"


def test_metadata(art):
    a, _ = art
    m = a.metadata
    assert 0 <= m["accuracy"] <= 1 and 0 <= m["f1_score"] <= 1
    assert sum(map(sum, m["confusion_matrix"])) == m["num_test"]


def test_attribution_is_additive(spark, art, upload):
    a, _ = art
    from risklens.plans.batch import batch_features
    from risklens.sources.upload import normalize_upload
    up, _ = normalize_upload(upload)
    feats = batch_features(up.withColumn("row_id", F.monotonically_increasing_id()),
                           a.region_codes, a.scaler).limit(5)
    feats = feats.cache()
    scored = a.model.predict(feats)
    bg = attribution.background_sample(feats, 3)
    z = np.array([list(r) for r in bg.orderBy("bg_k").select(*C.FEATURES).collect()], float)
    nodes = tree_paths.forest_nodes(spark.read.parquet(f"{a.path}/forest/data"))
    patterns = tree_paths.with_background(tree_paths.leaf_paths(nodes), z)
    vals = tree_paths.shapley_values(scored, "row_id", "prediction", C.FEATURES, patterns)
    total = {r.row_id: r.s for r in vals.groupBy("row_id").agg(F.sum("value").alias("s")).collect()}

    def forest_prob(df, cls_col):
        x = df.withColumn("features", array_to_vector(F.array(*[F.col(c).cast("double") for c in C.FEATURES])))
        return a.model.forest.transform(x.drop("prediction", "probability", "rawPrediction")) \
            .withColumn("p", vector_to_array("probability"))

    fx = {r.row_id: (r.p, r.cls) for r in forest_prob(
        scored.select("row_id", F.col("prediction").alias("cls"), *C.FEATURES), "cls").collect()}
    fz = [r.p for r in forest_prob(bg, None).collect()]
    for rid, (p, cls) in fx.items():
        expected = p[cls] - sum(z[cls] for z in fz) / len(fz)
        assert total[rid] == pytest.approx(expected, abs=1e-9)
    assert len(vals.where(F.col("row_id") == list(fx)[0]).collect()) == len(C.FEATURES)


def test_registry_rollback(spark):
    root = tempfile.mkdtemp(prefix="rl-reg-")
    reg = Registry(spark, root)
    reg.append(1, "trained", {"accuracy": 0.5})
    reg.append(1, "activated")
    reg.append(2, "trained", {"accuracy": 0.6})
    reg.append(2, "activated")
    assert reg.active_version() == 2
    assert reg.rollback() == 1 and reg.active_version() == 1


def test_ingest_overrides_drops(spark, art, upload):
    a, _ = art
    store = StateStore(spark, tempfile.mkdtemp(prefix="rl-state-"))
    store.init()
    store.init()  # idempotent
    scored = score_upload(upload, a, explain=False)
    res = ingest_scored(store, scored)
    assert res.count() == upload.count()
    assert store.table("students").count() == upload.select("student_id").distinct().count()
    assert store.table("engagement_log").count() == upload.count()
    assert store.table("drift_log").count() == upload.select("student_id").distinct().count()
    # second upload: engagement is logged as the next week per student
    ingest_scored(store, score_upload(upload, a, explain=False))
    weeks = store.table("engagement_log").groupBy("student_id").agg(F.max("week_number").alias("w"))
    assert {r.w for r in weeks.collect()} == {2}
    assert store.current_version() == 3  # init + one version per batch


def factors(spark, art, upload, student):
    s = score_upload(upload, art).where(F.col("student_id") == student)
    return [tuple(r) for r in s.select("top_factor_1", "top_factor_2", "top_factor_3").collect()]


def test_factors_depend_on_the_row_alone(spark, art, upload):
    a, _ = art
    student = upload.agg(F.min("student_id")).first()[0]
    one = upload.where(F.col("student_id") == student)
    alone = factors(spark, a, one, student)
    assert len(alone) == 1 and all(alone[0])
    assert factors(spark, a, upload.limit(30).unionByName(one).distinct(), student) == alone
    assert factors(spark, a, one.unionByName(one), student) == alone * 2


def test_a_batch_run_again_logs_nothing_twice(spark, art, upload, monkeypatch):
    a, _ = art
    few = upload.where(F.col("student_id").cast("long") < 40)
    stores = [StateStore(spark, tempfile.mkdtemp(prefix="rl-again-")) for _ in range(2)]
    for s in stores:
        s.init()
        ingest_scored(s, score_upload(few, a), "b0")
    clean, broken = stores
    ingest_scored(clean, score_upload(few, a), "b1")
    with monkeypatch.context() as m:  # fails after the engagement rows are written
        m.setattr("risklens.operators.drift.drift_log_rows", lambda *x: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ingest_scored(broken, score_upload(few, a), "b1")
    ingest_scored(broken, score_upload(few, a), "b1")
    times = ("logged_at", "prediction_date", "checked_at", "last_updated", "id")
    for t in ("students", "predictions", "engagement_log", "drift_log"):
        rows = [s.table(t) for s in stores]
        got = [sorted(map(str, r.drop(*times).collect())) for r in rows]
        assert got[0] == got[1] and got[0]
        if t != "students":
            assert rows[1].select("id").distinct().count() == rows[1].count()
    assert broken.table("predictions").where("top_factor_1 = ''").count() == 0


def test_last_row_of_a_file_wins_and_week_is_taken(spark, art, upload):
    a, _ = art
    one = upload.orderBy("student_id").limit(1).drop("name")
    rows = [r.asDict() | {"name": n, "week_number": w} for r in one.collect()
            for n, w in (("first", "3"), ("second", "4"), ("third", "7"))]
    folder = tempfile.mkdtemp(prefix="rl-last-")
    spark.createDataFrame(rows).coalesce(1).write.option("header", True).csv(f"{folder}/in")
    from risklens.sources.upload import read_upload
    store = StateStore(spark, f"{folder}/state")
    store.init()
    ingest_scored(store, score_upload(read_upload(spark, f"{folder}/in"), a, explain=False))
    assert [r.name for r in store.table("students").collect()] == ["third"]
    assert sorted(r.week_number for r in store.table("engagement_log").collect()) == [3, 4, 7]


def test_stream_reads_by_header_and_keeps_rejects(spark, art, upload):
    from risklens.streaming.ingest import start_ingest
    a, _ = art
    run = tempfile.mkdtemp(prefix="rl-header-")
    good = upload.drop("name", "email").select(*sorted(set(upload.columns) - {"name", "email"}, reverse=True))
    good.coalesce(1).write.option("header", True).csv(f"{run}/inbox")
    upload.drop("gender").limit(3).coalesce(1).write.mode("append").option("header", True).csv(f"{run}/inbox")
    store = StateStore(spark, f"{run}/state")
    store.init()
    start_ingest(spark, f"{run}/inbox", store, a, f"{run}/ckpt", explain=False).awaitTermination()
    want = {r.student_id: r.risk_level for r in score_upload(upload, a, explain=False).collect()}
    got = store.table("predictions").collect()
    assert {r.student_id: r.risk_level for r in got} == want and len(got) == upload.count()
    assert all(r.name == r.student_id for r in store.table("students").collect())
    assert [r.missing for r in store.table("rejected_uploads").collect()] == ["gender"]


def test_changed_files_train_anew(spark):
    path = tempfile.mkdtemp(prefix="rl-src-") + "/t"
    spark.range(5).write.parquet(path)
    before = training.source_state(spark.read.parquet(path))
    assert before == training.source_state(spark.read.parquet(path))
    spark.range(6).write.mode("overwrite").parquet(path)
    assert before != training.source_state(spark.read.parquet(path))


def test_streaming_ingest(spark, art, upload):
    from risklens.streaming.ingest import start_ingest
    a, _ = art
    run = tempfile.mkdtemp(prefix="rl-stream-")
    upload.repartition(2).write.option("header", True).csv(f"{run}/inbox")
    store = StateStore(spark, f"{run}/state")
    store.init()
    start_ingest(spark, f"{run}/inbox", store, a, f"{run}/ckpt", explain=False).awaitTermination()
    assert store.table("predictions").count() == upload.count()
    # a rerun over the same folder ingests nothing new (checkpointed)
    start_ingest(spark, f"{run}/inbox", store, a, f"{run}/ckpt", explain=False).awaitTermination()
    assert store.table("predictions").count() == upload.count()
