"""M6 + M11: training set -> split -> scale -> fit -> evaluate -> persist.

Artifacts of a version (ensemble, scaler statistics, region codes) are
written under ``<model_root>/vNNNNN``; the registry gets a ``trained`` and
an ``activated`` row. Results are cached per (sources, parameters) in the
session so several queries share one fit.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risklens import constants as C
from risklens.operators import attribution, encode, metrics, split
from risklens.operators.ensemble import (N_CLASSES, EnsembleModel, EnsembleParams, soft_vote,
                                         train_ensemble)
from risklens.operators.forest import Forest
from risklens.operators.registry import Registry
from risklens.operators.scaling import ScalerModel


@dataclass
class TrainResult:
    model: EnsembleModel
    scaler: ScalerModel
    region_codes: DataFrame
    version: int
    path: str
    metadata: dict
    test_scored: DataFrame
    patterns: DataFrame


def prepare(master: DataFrame, fit_on: str = "train", codes: DataFrame | None = None,
            scaler: ScalerModel | None = None):
    """Encoded + labelled + split rows, the region codes and scaler (fitted
    here unless saved ones are given)."""
    codes = codes if codes is not None else encode.fit_region_codes(master)
    rows = encode.label_index(encode.encode_target(encode.encode_demographics(master, codes)))
    rows = split.stratified_split(rows, "final_result", "id_student")
    if scaler is None:
        fit_rows = rows if fit_on == "all" else rows.where(~F.col("is_test"))
        scaler = ScalerModel.fit(fit_rows)
    return scaler.transform(rows), codes, scaler


def evaluate(test_scored: DataFrame) -> dict:
    """Accuracy, macro F1, report and matrix of the scored test rows (the
    collected results are bounded: 16 matrix cells, 7 report rows)."""
    df = test_scored.select(F.col("final_result").alias("actual"),
                            F.col("risk_level").alias("predicted")).persist()  # scored once for all four
    acc = metrics.accuracy(df).first()
    f1 = metrics.macro_f1(df).first()
    cm = metrics.confusion_matrix(df).orderBy("row_idx", "col_idx").collect()
    matrix = [[0] * N_CLASSES for _ in range(N_CLASSES)]
    for r in cm:
        matrix[r.row_idx][r.col_idx] = int(r["count"])
    report = metrics.classification_report(df).collect()
    df.unpersist()
    lines = [f"{r.row_label:>14} {r.precision if r.precision is not None else float('nan'):9.2f} "
             f"{r.recall if r.recall is not None else float('nan'):9.2f} {r.f1_score:9.2f} {r.support:9d}"
             for r in report]
    return {"accuracy": round(acc.accuracy or 0.0, 4), "f1_score": round(f1.macro_f1 or 0.0, 4),
            "num_test": int(acc.n), "confusion_matrix": matrix,
            "classification_report": "\n".join(lines)}


def member_predictions(test_scored: DataFrame) -> DataFrame:
    """(member, actual, predicted) for the ensemble and each member."""
    def argmax(col):
        return F.coalesce(F.element_at(F.array(*[F.lit(c) for c in C.LABEL_ORDER]),
                                       F.array_position(col, F.array_max(col)).cast("int")),
                          F.lit(C.UNKNOWN))
    members = F.array(
        F.struct(F.lit("ensemble").alias("member"), F.col("risk_level").alias("predicted")),
        F.struct(F.lit("random_forest").alias("member"), argmax(F.col("p_rf")).alias("predicted")),
        F.struct(F.lit("gradient_boosting").alias("member"), argmax(F.col("p_gbt")).alias("predicted")))
    return test_scored.select(F.col("final_result").alias("actual"),
                              F.explode(members).alias("m")).select("m.member", "actual", "m.predicted")


_CACHE: dict = {}

#: Training rows kept with a version as the background of its attributions.
BACKGROUND_ROWS = 50


def source_state(df: DataFrame) -> str:
    """A digest of the files behind ``df`` (paths, sizes, times); no content is read."""
    files = df.inputFiles()
    if not files:
        return ""
    listing = df.sparkSession.read.format("binaryFile").load(files)
    h = listing.agg(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()[0]
    return f"{len(files)}:{h}"


def train(spark: SparkSession, master: DataFrame, model_root: str,
          params: EnsembleParams | None = None, fit_on: str = "train",
          data_source: str = "driver tables", cache_key=None, reuse: bool = False) -> TrainResult:
    """Fit (or, with ``reuse``, load the registered version fitted on the
    same data with the same parameters), evaluate, save and register."""
    p = params or EnsembleParams()
    if cache_key is not None or reuse:
        data_source = f"{data_source}|{source_state(master)}"
    key = ((spark.sparkContext.applicationId, cache_key, data_source, astuple(p), fit_on, model_root)
           if cache_key is not None else None)
    if key is not None and key in _CACHE:
        return _CACHE[key]
    signature = f"{data_source}|{astuple(p)}|{fit_on}|{ARTIFACT_FORMAT}"
    if reuse:
        reg = Registry(spark, model_root)
        hit = reg.read().where((F.col("event") == "trained") & (F.col("data_source") == signature)) \
            .agg(F.max("version").alias("v")).first().v
        if hit is not None:
            result = load_version(spark, model_root, hit, master)
            if key is not None:
                _CACHE[key] = result
            return result
    rows, codes, scaler = prepare(master, fit_on)
    rows = rows.persist()
    train_rows = split.with_class_weight(rows.where(~F.col("is_test")), "final_result")
    model = train_ensemble(train_rows, p)
    test_scored = soft_vote(model.member_probabilities(rows.where(F.col("is_test"))),
                            ["p_rf", "p_gbt"])
    meta = evaluate(test_scored)
    n = rows.count()
    meta.update({"training_date": datetime.now(timezone.utc).replace(tzinfo=None),
                 "num_samples": n, "num_features": len(C.FEATURES),
                 "feature_names": list(C.FEATURES), "class_names": list(C.LABEL_ORDER),
                 "data_source": signature})
    reg = Registry(spark, model_root)
    version = reg.next_version()
    path = reg.model_path(version)
    model.save(path)
    scaler.to_df(spark).write.mode("overwrite").parquet(f"{path}/scaler")
    codes.write.mode("overwrite").parquet(f"{path}/region_codes")
    attribution.background_sample(train_rows, BACKGROUND_ROWS).write.mode("overwrite").parquet(
        f"{path}/background")
    save_patterns(spark, model.forest, path)
    reg.append(version, "trained", meta)
    reg.append(version, "activated", meta)
    rows.unpersist()
    codes_saved = spark.read.parquet(f"{path}/region_codes")
    result = TrainResult(model, scaler, codes_saved, version, path, meta, test_scored,
                         spark.read.parquet(f"{path}/patterns"))
    if key is not None:
        _CACHE[key] = result
    return result


ARTIFACT_FORMAT = "a5"


def save_patterns(spark: SparkSession, forest: Forest, path: str) -> None:
    """The forest's trees with the version's background rows that their nodes' intervals hold."""
    background = spark.read.parquet(f"{path}/background").orderBy("bg_k").select(*C.FEATURES).collect()
    z = np.array([[float("nan") if v is None else v for v in r] for r in background], float).reshape(-1, len(C.FEATURES))
    forest.packed(z).write.mode("overwrite").parquet(f"{path}/patterns")


def load_version(spark: SparkSession, model_root: str, version: int,
                 master: DataFrame | None = None) -> TrainResult:
    """Saved artifacts of a version; with ``master`` the held-out rows
    are re-scored for evaluation."""
    reg = Registry(spark, model_root)
    path = reg.model_path(version)
    model = EnsembleModel.load(path)
    scaler = ScalerModel.from_df(spark.read.parquet(f"{path}/scaler"))
    codes = spark.read.parquet(f"{path}/region_codes")
    meta = reg.read().where((F.col("version") == version) & (F.col("event") == "trained")).first()
    test_scored = None
    if master is not None:
        rows, _, _ = prepare(master, codes=codes, scaler=scaler)
        test_scored = soft_vote(model.member_probabilities(rows.where(F.col("is_test"))),
                                ["p_rf", "p_gbt"])
    return TrainResult(model, scaler, codes, version, path, meta.asDict() if meta else {},
                       test_scored, spark.read.parquet(f"{path}/patterns"))


def load_active(spark: SparkSession, model_root: str) -> TrainResult | None:
    """The active version's artifacts."""
    reg = Registry(spark, model_root)
    v = reg.active_version()
    if v is None:
        return None
    path = reg.model_path(v)
    return TrainResult(EnsembleModel.load(path),
                       ScalerModel.from_df(spark.read.parquet(f"{path}/scaler")),
                       spark.read.parquet(f"{path}/region_codes"), v, path, {}, None,
                       spark.read.parquet(f"{path}/patterns"))
