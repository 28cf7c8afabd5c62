"""Feature, encoding, scaling and split queries (S1-S5, S8, P1, P6-P10,
A1-A5, A10, A11, A18, J1-J5, M1-M6, W6, W7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risklens import constants as C
from risklens.functions.expr import sql_case_map, sql_code_lookup, sql_coerce_numeric
from risklens.operators import encode, features, scaling, split
from risklens.plans.catalog import query
from risklens.plans.oracle_tables import with_tables
from risklens.session import run_dir, stored
from risklens.sources import raw_csv
from risklens.sources import testdata as T
from risklens.sources.upload import normalize_upload, read_upload

KEYS = ", ".join(C.STUDENT_KEYS)
R6 = 6


def r6(cols: list[str]) -> dict[str, F.Column]:
    return {c: F.round(F.col(c), R6) for c in cols}


# ───────────────────────────── Spark plans ─────────────────────────────

def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.master_features(T.student_info(spark, sf_dir),
                                     T.student_assessment(spark, sf_dir),
                                     T.assessments(spark, sf_dir),
                                     T.student_vle(spark, sf_dir))


def region_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region codes fitted on the demographics table (the master table has
    the same rows and regions, without its three aggregates)."""
    return encode.fit_region_codes(T.student_info(spark, sf_dir))


def encoded_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_demographics(master(spark, sf_dir), region_codes(spark, sf_dir))


def split_students(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Students with a risk class and the split flag; class and split need the
    demographics table alone."""
    return split.stratified_split(encode.encode_target(T.student_info(spark, sf_dir)),
                                  "final_result", "id_student")


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: encoded features, risk class, label index and the split flag."""
    df = features.master_features(split_students(spark, sf_dir), T.student_assessment(spark, sf_dir),
                                  T.assessments(spark, sf_dir), T.student_vle(spark, sf_dir))
    df = encode.label_index(encode.encode_demographics(df, region_codes(spark, sf_dir)))
    return df.select(*C.STUDENT_KEYS, *C.FEATURES, "final_result", "label", "is_test")


# ───────────────────────────── SQL twins ─────────────────────────────

SQL_CTES = [
    ("vle_daily", f"""
SELECT {KEYS}, date, sum(sum_click) AS clicks FROM student_vle
WHERE code_module IS NOT NULL AND code_presentation IS NOT NULL AND id_student IS NOT NULL
GROUP BY {KEYS}, date"""),
    ("vle_eng", f"""
SELECT {KEYS}, CAST(sum(clicks) AS BIGINT) AS sum_clicks, count(*) AS days_active,
       max(date) AS last_active_day FROM vle_daily GROUP BY {KEYS}"""),
    ("weekly", f"""
SELECT {KEYS}, CAST(floor(date / 7.0) AS INTEGER) AS week, CAST(sum(clicks) AS BIGINT) AS clicks
FROM vle_daily GROUP BY {KEYS}, floor(date / 7.0)"""),
    ("trend", f"""
SELECT {KEYS}, CASE WHEN count(*) >= 2
                    THEN regr_slope(CAST(clicks AS DOUBLE), CAST(week AS DOUBLE))
                    ELSE 0.0 END AS click_trend
FROM weekly GROUP BY {KEYS}"""),
    ("wavg", f"""
SELECT {KEYS}, CASE WHEN sum(weight) > 0 THEN sum(score * weight) / sum(weight)
                    ELSE 0.0 END AS weighted_avg_score
FROM (SELECT a.code_module, a.code_presentation, sa.id_student,
             {sql_coerce_numeric('sa.score')} AS score,
             COALESCE(a.weight, 0.0) AS weight
      FROM student_assessment sa LEFT JOIN assessments a ON sa.id_assessment = a.id_assessment)
WHERE code_module IS NOT NULL AND code_presentation IS NOT NULL AND id_student IS NOT NULL
GROUP BY {KEYS}"""),
    ("master", """
SELECT si.*, COALESCE(w.weighted_avg_score, 0.0) AS weighted_avg_score,
       COALESCE(v.sum_clicks, 0) AS sum_clicks, COALESCE(v.days_active, 0) AS days_active,
       COALESCE(v.last_active_day, 0) AS last_active_day,
       COALESCE(t.click_trend, 0.0) AS click_trend,
       CASE WHEN v.days_active > 0 THEN v.sum_clicks / v.days_active ELSE 0.0 END
         AS avg_clicks_per_day
FROM student_info si
LEFT JOIN wavg w USING (code_module, code_presentation, id_student)
LEFT JOIN vle_eng v USING (code_module, code_presentation, id_student)
LEFT JOIN trend t USING (code_module, code_presentation, id_student)"""),
    ("region_codes", """
SELECT region, CAST(dense_rank() OVER (ORDER BY region) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT region FROM master WHERE region IS NOT NULL)"""),
    ("encoded", f"""
SELECT m.* REPLACE (
         {sql_code_lookup('m.gender', C.GENDER_CODES)} AS gender,
         {sql_code_lookup('m.age_band', C.AGE_CODES)} AS age_band,
         {sql_code_lookup('m.highest_education', C.EDUCATION_CODES)} AS highest_education,
         {sql_code_lookup('m.imd_band', C.IMD_CODES)} AS imd_band,
         {sql_code_lookup('m.disability', C.DISABILITY_CODES)} AS disability,
         CAST(COALESCE(rc.code, 0) AS INTEGER) AS region)
FROM master m LEFT JOIN region_codes rc ON m.region = rc.region"""),
    ("targeted", f"""
SELECT * FROM (SELECT * REPLACE ({sql_case_map('final_result', C.TARGET_MAP)} AS final_result)
               FROM encoded) WHERE final_result IS NOT NULL"""),
    ("training", f"""
SELECT {KEYS}, {', '.join(C.FEATURES)}, final_result,
       {sql_case_map('final_result', {c: float(i) for i, c in enumerate(C.LABEL_ORDER)})}
         AS label,
       row_number() OVER (PARTITION BY final_result
                          ORDER BY md5(CAST(id_student AS VARCHAR) || '-{C.SEED}'), id_student,
                                   code_module, code_presentation)
         <= round(count(*) OVER (PARTITION BY final_result) * CAST({C.TEST_FRACTION!r} AS DOUBLE))
         AS is_test
FROM targeted"""),
]
BASE = ("student_info", "student_vle", "assessments", "student_assessment")


def feature_sql(upto: str, body: str) -> str:
    names = [n for n, _ in SQL_CTES]
    extra = SQL_CTES[: names.index(upto) + 1]
    return with_tables(*BASE, extra=extra) + body


def stats_sql(where: str = "NOT is_test") -> str:
    sel = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg(CAST({c} AS DOUBLE)) AS mean, "
        f"CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) = 0 THEN 1.0 "
        f"ELSE stddev_pop(CAST({c} AS DOUBLE)) END AS std, {i} AS position "
        f"FROM training WHERE {where}"
        for i, c in enumerate(C.SCALED_FEATURES))
    return sel


def wide_stats_sql(where: str = "NOT is_test") -> str:
    parts = []
    for c in C.SCALED_FEATURES:
        parts.append(f"avg(CAST({c} AS DOUBLE)) AS m_{c}")
        parts.append(f"CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) = 0 THEN 1.0 "
                     f"ELSE stddev_pop(CAST({c} AS DOUBLE)) END AS s_{c}")
    return f"SELECT {', '.join(parts)} FROM training WHERE {where}"


# ───────────────────────────── sources ─────────────────────────────

@query("src_student_info", with_tables("student_info") + "SELECT * FROM student_info")
def q_src_student_info(spark, sf_dir):
    """The demographics + outcome table (mandatory source)."""
    return T.student_info(spark, sf_dir)


@query("src_assessments", with_tables("assessments") + "SELECT * FROM assessments")
def q_src_assessments(spark, sf_dir):
    """S2."""
    return T.assessments(spark, sf_dir)


@query("src_student_assessment", with_tables("student_assessment") + "SELECT * FROM student_assessment")
def q_src_student_assessment(spark, sf_dir):
    """S3: score stays text."""
    return T.student_assessment(spark, sf_dir)


@query("src_student_vle", with_tables("student_vle") + "SELECT * FROM student_vle")
def q_src_student_vle(spark, sf_dir):
    """One distributed scan of the click log."""
    return T.student_vle(spark, sf_dir)


@query("source_profile", with_tables(*BASE) + " UNION ALL ".join(
    f"SELECT '{n}' AS source, count(*) AS rows, count(*) FILTER (WHERE id_student IS NULL) AS null_keys, "
    f"count(DISTINCT id_student) AS students FROM {n}"
    for n in ("student_info", "student_assessment", "student_vle"))
    + " UNION ALL SELECT 'assessments', count(*), count(*) FILTER (WHERE id_assessment IS NULL), "
      "CAST(0 AS BIGINT) FROM assessments")
def q_source_profile(spark, sf_dir):
    """Rows, null keys and distinct students per source."""
    return features.source_profile({
        "student_info": T.student_info(spark, sf_dir),
        "student_assessment": T.student_assessment(spark, sf_dir),
        "student_vle": T.student_vle(spark, sf_dir),
        "assessments": T.assessments(spark, sf_dir)})


def _csv_source(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    """A mapped table written as CSV and read by the engine's own reader; file
    columns that the mapping lacks are written empty."""
    folder = run_dir(spark, "csv")
    fname, schema = raw_csv.FILES[name]
    df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)
                for c in schema.names]).write.option("header", True).csv(f"{folder}/{fname}")
    return raw_csv.read_table(spark, folder, name).select(*[c for c in schema.names if c in df.columns])


@query("csv_student_info", with_tables("student_info") + "SELECT " + ", ".join(
    raw_csv.STUDENT_INFO.names) + " FROM student_info")
def q_csv_student_info(spark, sf_dir):
    """S1 through CSV."""
    return _csv_source(spark, "studentInfo", T.student_info(spark, sf_dir))


@query("csv_assessments", with_tables("assessments") + """
SELECT code_module, code_presentation, id_assessment, CAST(weight AS DOUBLE) AS weight FROM assessments""")
def q_csv_assessments(spark, sf_dir):
    """S2 through CSV."""
    return _csv_source(spark, "assessments", T.assessments(spark, sf_dir))


@query("csv_student_assessment", with_tables("student_assessment") + """
SELECT id_assessment, id_student, nullif(score, '') AS score FROM student_assessment""")
def q_csv_student_assessment(spark, sf_dir):
    """S3 through CSV: score stays text, an empty one is null."""
    return _csv_source(spark, "studentAssessment", T.student_assessment(spark, sf_dir))


@query("csv_student_vle", with_tables("student_vle") + """
SELECT code_module, code_presentation, id_student, date, sum_click FROM student_vle""")
def q_csv_student_vle(spark, sf_dir):
    """S4 through CSV."""
    return _csv_source(spark, "studentVle", T.student_vle(spark, sf_dir))


# ───────────────────────────── features ─────────────────────────────

@query("vle_engagement", feature_sql("vle_eng", "SELECT * FROM vle_eng"))
def q_vle_engagement(spark, sf_dir):
    """A1: clicks, exact distinct active days, last day per student."""
    return features.vle_engagement(T.student_vle(spark, sf_dir))


@query("weekly_clicks", feature_sql("weekly", "SELECT * FROM weekly"))
def q_weekly_clicks(spark, sf_dir):
    """A3/F1: clicks per student-week (negative days floor)."""
    return features.weekly_clicks(T.student_vle(spark, sf_dir))


@query("click_trend", feature_sql("trend", f"SELECT {KEYS}, round(click_trend, 6) AS click_trend FROM trend"))
def q_click_trend(spark, sf_dir):
    """A4: slope of weekly clicks."""
    return features.click_trend(T.student_vle(spark, sf_dir)).withColumns(r6(["click_trend"]))


@query("weighted_avg_score", feature_sql(
    "wavg", f"SELECT {KEYS}, round(weighted_avg_score, 6) AS weighted_avg_score FROM wavg"))
def q_weighted_avg_score(spark, sf_dir):
    """Weighted assessment average."""
    return features.weighted_avg_score(T.student_assessment(spark, sf_dir),
                                       T.assessments(spark, sf_dir)).withColumns(
        r6(["weighted_avg_score"]))


_R6_MASTER = ["weighted_avg_score", "avg_clicks_per_day", "click_trend"]


@query("master_features", feature_sql("master", "SELECT * REPLACE (" + ", ".join(
    f"round({c}, 6) AS {c}" for c in _R6_MASTER) + ") FROM master"))
def q_master_features(spark, sf_dir):
    """One row per student-course with every feature."""
    return master(spark, sf_dir).withColumns(r6(_R6_MASTER))


@query("features_select", feature_sql("encoded", "SELECT id_student, " + ", ".join(
    f"round({c}, 6) AS {c}" if c in _R6_MASTER else c for c in C.FEATURES) + " FROM encoded"))
def q_features_select(spark, sf_dir):
    """The 14 features in training order."""
    return encoded_master(spark, sf_dir).select("id_student", *C.FEATURES).withColumns(r6(_R6_MASTER))


@query("coerce_numeric", with_tables("student_assessment") + f"""
SELECT id_assessment, id_student, score AS score_text, {sql_coerce_numeric('score')} AS score
FROM student_assessment""")
def q_coerce_numeric(spark, sf_dir):
    """Score text -> number, unparseable -> 0."""
    from risklens.functions.expr import coerce_numeric
    sa = T.student_assessment(spark, sf_dir)
    return sa.select("id_assessment", "id_student", F.col("score").alias("score_text"),
                     coerce_numeric("score").alias("score"))


# ───────────────────────────── encoding ─────────────────────────────

@query("encode_region", feature_sql("region_codes", "SELECT * FROM region_codes"))
def q_encode_region(spark, sf_dir):
    """Region codes from the sorted distinct regions."""
    return region_codes(spark, sf_dir)


@query("encode_demographics", feature_sql("encoded", f"""
SELECT {KEYS}, {', '.join(C.CATEGORICAL_FEATURES)} FROM encoded"""))
def q_encode_demographics(spark, sf_dir):
    """Categorical codes with defaults."""
    info = encode.encode_demographics(T.student_info(spark, sf_dir), region_codes(spark, sf_dir))
    return info.select(*C.STUDENT_KEYS, *C.CATEGORICAL_FEATURES)


@query("encode_target", feature_sql("targeted", f"SELECT {KEYS}, final_result FROM targeted"))
def q_encode_target(spark, sf_dir):
    """Outcome -> class; unmapped outcomes dropped."""
    return encode.encode_target(T.student_info(spark, sf_dir)).select(*C.STUDENT_KEYS, "final_result")


@query("class_distribution", feature_sql("targeted", """
SELECT final_result, count, round(count * 100.0 / sum(count) OVER (), 6) AS percent
FROM (SELECT final_result, count(*) AS count FROM targeted GROUP BY final_result)"""))
def q_class_distribution(spark, sf_dir):
    """A10: class balance of the training target."""
    d = encode.class_distribution(encode.encode_target(T.student_info(spark, sf_dir)))
    return d.withColumns(r6(["percent"]))


@query("label_index", with_tables("labelled") + f"""
SELECT doc_id, actual,
       CAST({sql_case_map('actual', {c: i for i, c in enumerate(C.LABEL_ORDER)})} AS INTEGER) AS label,
       COALESCE({sql_case_map('CAST(prediction AS VARCHAR)', {str(i): c for i, c in enumerate(C.LABEL_ORDER)})},
                '{C.UNKNOWN}') AS decoded
FROM labelled""")
def q_label_index(spark, sf_dir):
    """Class -> alphabetical index, index -> class."""
    lab = T.labelled_predictions(spark, sf_dir)
    idx = encode.label_index(lab, "actual", "label")
    return idx.select("doc_id", "actual", F.col("label").cast("int").alias("label"),
                      encode.decode_label("prediction", "decoded"))


# ───────────────────────────── training set ─────────────────────────────

_TRAIN_COLS = [*C.STUDENT_KEYS, *C.FEATURES, "final_result", "label", "is_test"]


@query("training_set", feature_sql("training", "SELECT " + ", ".join(
    f"round({c}, 6) AS {c}" if c in _R6_MASTER else c for c in _TRAIN_COLS) + " FROM training"))
def q_training_set(spark, sf_dir):
    """M6: encoded features, class, label index and the split flag."""
    return training_rows(spark, sf_dir).select(*_TRAIN_COLS).withColumns(r6(_R6_MASTER))


@query("stratified_split", feature_sql("training", """
SELECT final_result, is_test, count(*) AS rows FROM training GROUP BY final_result, is_test"""))
def q_stratified_split(spark, sf_dir):
    """Exact per-class 80/20 split sizes."""
    return (split_students(spark, sf_dir).groupBy("final_result", "is_test")
            .agg(F.count(F.lit(1)).alias("rows")))


@query("class_weights", feature_sql("training", """
SELECT final_result, count, round(sum(count) OVER () / (count(*) OVER () * count), 6) AS weight
FROM (SELECT final_result, count(*) AS count FROM training WHERE NOT is_test GROUP BY final_result)"""))
def q_class_weights(spark, sf_dir):
    """Balanced class weights of the training rows."""
    train = split_students(spark, sf_dir).where(~F.col("is_test"))
    return split.class_weights(train, "final_result").withColumns(r6(["weight"]))


@query("scaler_fit", feature_sql("training", "SELECT feature, round(mean, 6) AS mean, "
                                 "round(std, 6) AS std, position FROM (" + stats_sql() + ")"))
def q_scaler_fit(spark, sf_dir):
    """Mean / population std of the 8 numeric features on train rows."""
    train = training_rows(spark, sf_dir).where(~F.col("is_test"))
    return scaling.scaler_stats(train).withColumns(r6(["mean", "std"]))


_SCALED_SQL = ", ".join(f"round(({c} - s.m_{c}) / s.s_{c}, 6) AS {c}" for c in C.SCALED_FEATURES)


@query("scale_features", feature_sql("training", f"""
SELECT id_student, {', '.join(C.CATEGORICAL_FEATURES)}, {_SCALED_SQL}, label, is_test
FROM training CROSS JOIN ({wide_stats_sql()}) s"""))
def q_scale_features(spark, sf_dir):
    """M4: scale with statistics fitted on the train rows only."""
    rows = stored(training_rows(spark, sf_dir), "training")
    model = scaling.ScalerModel.fit(rows.where(~F.col("is_test")))
    out = model.transform(rows)
    return out.select("id_student", *C.CATEGORICAL_FEATURES, *C.SCALED_FEATURES, "label",
                      "is_test").withColumns(r6(C.SCALED_FEATURES))


# ───────────────────────────── uploads ─────────────────────────────

_UPLOAD_DROP = ["last_active_day", "click_trend"]


def upload_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An uploaded class file as read from CSV: every column text, two
    feature columns missing, categories as text."""
    return as_upload(master(spark, sf_dir))


def as_upload(m: DataFrame) -> DataFrame:
    cols = [F.col("id_student").cast("string").alias("student_id")]
    cols += [F.col(c).cast("string").alias(c) for c in C.FEATURES if c not in _UPLOAD_DROP]
    return m.select(*cols)


_UPLOAD_SQL = ("SELECT CAST(id_student AS VARCHAR) AS student_id, " + ", ".join(
    f"CAST({c} AS VARCHAR) AS {c}" for c in C.FEATURES if c not in _UPLOAD_DROP) + " FROM master")


def _normalized_sql() -> str:
    cols = []
    for c in C.FEATURES:
        if c in _UPLOAD_DROP:
            cols.append(f"CAST(0.0 AS DOUBLE) AS {c}")
        elif c in C.CATEGORICAL_FEATURES:
            cols.append(f"{c}")
        else:
            cols.append(f"round({sql_coerce_numeric(c)}, 6) AS {c}")
    return "SELECT student_id, " + ", ".join(cols) + " FROM upload"


@query("batch_normalize", with_tables(*BASE, extra=SQL_CTES[:6] + [("upload", _UPLOAD_SQL)])
       + _normalized_sql())
def q_batch_normalize(spark, sf_dir):
    """All-text upload -> required columns checked, missing
    features added as 0, numbers coerced (categories stay text)."""
    up, missing = normalize_upload(upload_frame(spark, sf_dir), require=False)
    return up.select("student_id", *C.FEATURES).withColumns(
        r6([c for c in C.FEATURES if c not in C.CATEGORICAL_FEATURES]))


@query("csv_upload", with_tables(*BASE, extra=SQL_CTES[:6] + [("upload", _UPLOAD_SQL)])
       + _normalized_sql())
def q_csv_upload(spark, sf_dir):
    """The same upload through a CSV file with a header."""
    folder = run_dir(spark, "upload")
    upload_frame(spark, sf_dir).write.option("header", True).csv(folder)
    up, _ = normalize_upload(read_upload(spark, folder), require=False)
    return up.select("student_id", *C.FEATURES).withColumns(
        r6([c for c in C.FEATURES if c not in C.CATEGORICAL_FEATURES]))


def _batch_features_sql() -> str:
    enc = {
        "gender": sql_code_lookup("u.gender", C.GENDER_CODES),
        "age_band": sql_code_lookup("u.age_band", C.AGE_CODES),
        "highest_education": sql_code_lookup("u.highest_education", C.EDUCATION_CODES),
        "imd_band": sql_code_lookup("u.imd_band", C.IMD_CODES),
        "disability": sql_code_lookup("u.disability", C.DISABILITY_CODES),
        "region": "CAST(COALESCE(rc.code, 0) AS INTEGER)",
    }
    cols = [f"{enc[c]} AS {c}" for c in C.CATEGORICAL_FEATURES]
    for c in C.SCALED_FEATURES:
        x = "0.0" if c in _UPLOAD_DROP else sql_coerce_numeric(f"u.{c}")
        cols.append(f"round(({x} - s.m_{c}) / s.s_{c}, 6) AS {c}")
    return (f"SELECT u.student_id, {', '.join(cols)} FROM upload u "
            f"LEFT JOIN region_codes rc ON u.region = rc.region "
            f"CROSS JOIN ({wide_stats_sql()}) s")


@query("batch_features", with_tables(*BASE, extra=SQL_CTES + [("upload", _UPLOAD_SQL)])
       + _batch_features_sql())
def q_batch_features(spark, sf_dir):
    """M5: upload -> encoded with the training region codes, coerced, and
    scaled with the training statistics."""
    from risklens.plans.batch import batch_features
    flags = split_students(spark, sf_dir).select(*C.STUDENT_KEYS, "is_test")
    m = stored(master(spark, sf_dir).join(flags, C.STUDENT_KEYS, "left"), "master")
    scaler = scaling.ScalerModel.fit(m.where(~F.col("is_test")))  # null: no risk class
    codes = region_codes(spark, sf_dir)
    up, _ = normalize_upload(as_upload(m), require=False)
    return batch_features(up, codes, scaler).select("student_id", *C.FEATURES).withColumns(
        r6(C.SCALED_FEATURES))
