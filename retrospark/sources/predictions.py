"""Prediction-table sources.

* :func:`fixture_predictions` - two models' scores over ``labels x documents`` (ties on purpose).
* :func:`read_prediction_files` - all ``*_predictions.*`` files of a folder; the model name
  comes from the file name, files lacking the truth/prediction columns are skipped (SRC5).  Files
  may differ in their columns, so each keeps its own reader; they are one per model.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EvalConfig


def fixture_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    j = labels.join(docs, on="doc_id")
    base = j.select(
        F.col("doc_id").alias("patient_id"),
        (F.col("doc_id") % 5).alias("fold"),
        F.col("quality").alias("y_true"),
        "n_chars",
    )
    ss = base.select("patient_id", F.lit("single_shot").alias("model_name"), "fold", "y_true",
                     ((F.col("n_chars") % 100) / 100.0).cast("double").alias("y_prob"))
    s1 = base.select("patient_id", F.lit("extract_set_1").alias("model_name"), "fold", "y_true",
                     (((F.col("patient_id") * 37) % 100) / 100.0).cast("double").alias("y_prob"))
    both = ss.unionByName(s1)
    return both.withColumn("y_pred", (F.col("y_prob") >= 0.5).cast("int"))


def read_prediction_files(spark: SparkSession, directory: str, cfg: EvalConfig = EvalConfig(), suffix: str = "_predictions") -> DataFrame:
    """All ``<model>_predictions.{csv,parquet}`` files of a folder as one table with ``model_name``."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}.*").load(directory)  # paths only; works in any store
    paths = sorted(r.path for r in listing.select("path").collect() if not os.path.basename(r.path).startswith("all_model"))
    frames = []
    for p in paths:
        model = os.path.basename(p).split(suffix)[0]
        df = spark.read.parquet(p) if p.endswith(".parquet") else spark.read.option("header", True).option("inferSchema", True).csv(p)
        if any(c not in df.columns for c in (cfg.truth, cfg.pred)):
            continue
        frames.append(df.withColumn(cfg.model, F.lit(model)))
    if not frames:
        return spark.createDataFrame([], f"{cfg.entity} bigint, {cfg.model} string, {cfg.truth} int, {cfg.pred} int, {cfg.prob} double")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
