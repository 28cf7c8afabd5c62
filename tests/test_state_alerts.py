"""Upsert, factor parsing, alerts and the split."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from risklens import constants as C
from risklens.operators import alerts, reports, split, state

STUDENTS = ("student_id string, name string, email string, teacher_email string, course_id string, "
            "risk_level string, confidence_score double, status string, last_updated timestamp_ntz")


def test_upsert_latest_wins_and_resets_fields(spark):
    cur = spark.createDataFrame([("1", "Ann", "a@x", "t@x", "C1", "On Track", 0.8, "Dynamic Risk", None),
                                 ("2", "Bo", "b@x", "t@x", "C1", "Excelling", 0.9, "Static", None)], STUDENTS)
    inc = spark.createDataFrame([("1", "High Risk", 0.5, 1), ("1", "Moderate Risk", 0.6, 2)],
                                "student_id string, risk_level string, confidence_score double, n int")
    out = {r.student_id: r for r in state.upsert_students(cur, inc, ["n"]).collect()}
    assert len(out) == 2
    assert (out["1"].risk_level, out["1"].name, out["1"].status) == ("Moderate Risk", "", "Static")
    assert out["2"].name == "Bo"


def test_factor_parse(spark):
    preds = spark.createDataFrame(
        [(1, "7", None, "sum_clicks: text: more", "plain", "")],
        "id bigint, student_id string, prediction_date timestamp_ntz, top_factor_1 string, "
        "top_factor_2 string, top_factor_3 string")
    got = [(r.slot, r.feature, r.suggestion, r.impact) for r in
           reports.latest_factors(preds).orderBy("slot").collect()]
    assert got == [(1, "sum_clicks", "text: more", 1.0), (2, "plain", "plain", 0.5)]


def test_outbox_blank_student_address(spark):
    hr = spark.createDataFrame([("1", "Ann", "  ", "t@x", "High Risk", -3.0)],
                               "student_id string, name string, email string, teacher_email string, "
                               "risk_level string, z_score double")
    box = alerts.alert_outbox(hr, None, F.col("z_score")).collect()
    assert [(r.role, r.recipient) for r in box] == [("teacher", "t@x")]
    assert C.ALERT_NO_FACTORS in box[0].body and "Z-Score: -3.00" in box[0].body
    summ = alerts.alert_summary(hr, alerts.alert_outbox(hr, None, F.col("z_score"))).first()
    assert summ.teacher_sent and not summ.student_sent and summ.success


def test_stratified_split_matches_window_definition(spark):
    # one class holds most rows (a hot group); compare with the plain window
    rows = [(i, "big" if i % 10 else ("mid" if i % 20 else "small")) for i in range(5000)]
    df = spark.createDataFrame(rows, "id bigint, cls string")
    got = {r.id: r.is_test for r in split.stratified_split(df, "cls", "id").collect()}
    h = split.split_hash("id")
    w = Window.partitionBy("cls").orderBy(h, "id")
    ref = df.select("id", (F.row_number().over(w) <=
                           F.round(F.count(F.lit(1)).over(Window.partitionBy("cls")) * 0.2))
                    .alias("t")).collect()
    assert got == {r.id: r.t for r in ref}
    sizes = split.stratified_split(df, "cls", "id").groupBy("cls").agg(
        F.sum(F.col("is_test").cast("int")).alias("t"), F.count(F.lit(1)).alias("n")).collect()
    for r in sizes:
        assert r.t == round(r.n * 0.2)


def test_class_weights_balanced(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "cls string")
    w = {r.cls: r.weight for r in split.class_weights(df, "cls").collect()}
    assert w == {"a": 8 / (2 * 6), "b": 8 / (2 * 2)}
