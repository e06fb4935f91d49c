"""DOC3: final models as a table, routing of entities by their history, scoring as an expression.

A final model is fitted on all rows of a feature table and stored as one row (:data:`FINAL_DDL`):
its features in order and, per feature, slope, offset and the value of a missing entry.  So a
model can be written with ``write_table``, read back and applied by a join on its name; no fitted
object is needed where it is used.

Routing: entities whose history covers every window are scored by the temporal model, others with a
baseline record by the baseline model, the rest get no score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ModelConfig
from ..functions.codes import q
from ..functions.profile import exact_quantiles
from ..session import ensure_checkpoint_dir
from . import foldfit as FF
from .folds import _unpivot, choose_cv, feature_columns, feature_matrix

FINAL_DDL = FF.MODEL_DDL + ", features array<string>, threshold double, n_rows bigint, positives bigint"


def fit_final(table: DataFrame, name: str, cfg: ModelConfig = ModelConfig()) -> DataFrame:
    """One row of :data:`FINAL_DDL` (no row if the table has a single class or no features)."""
    spark = table.sparkSession
    ensure_checkpoint_dir(spark)
    mat = feature_matrix(table, cfg).withColumn("fold", F.lit(0)).checkpoint()  # read by every step
    feats = [c for c in feature_columns(mat, cfg) if c != "fold"]
    policy = choose_cv(mat, cfg)
    if policy.skip_reason or not feats:
        return spark.createDataFrame([], FINAL_DDL)
    units = FF.units_of(mat, feats)
    found = exact_quantiles(_unpivot(mat, [], feats), ["feature"], "value", [0.5]).select("feature", "q0").collect()  # a row a feature
    middle = {r["feature"]: r["q0"] for r in found}
    medians = np.array([[np.nan] * len(feats), [middle.get(c, np.nan) for c in feats]])
    grams = FF.fold_grams(mat, units, 1, cfg)
    # a second, empty fold: its training set is the whole table
    train = FF.training_sets(np.concatenate([grams, np.zeros_like(grams)]), medians, units)[1]
    model = FF.model(name, train, train.ranking(units.features))
    FF.fit(mat, units, [model], cfg)
    row = FF.model_rows(units, [(name, -1, model.design @ model.coef)])[0]
    return spark.createDataFrame([(*row, list(feats), float(cfg.threshold), policy.n_rows, policy.positives)], FINAL_DDL)


def apply_model(rows: DataFrame, models: DataFrame, name: str, cfg: ModelConfig = ModelConfig()) -> DataFrame:
    """entity, model_name, y_prob, y_pred of every row by the stored model ``name``; a missing feature column counts as null."""
    chosen = models.where(F.col("model_name") == name)
    head = chosen.select("features").first()
    if head is None:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("model_name", "string"), ("y_prob", "double"), ("y_pred", "int"))]
        return rows.select(q(cfg.entity), *none)
    feats = head["features"]
    values = rows.select(q(cfg.entity), *[(q(c) if c in rows.columns else F.lit(None)).cast("double").alias(c) for c in feats])
    scored = values.crossJoin(F.broadcast(chosen.select("model_name", "intercept", "terms", "threshold")))  # one row
    prob = FF.probability(feats)
    return scored.select(q(cfg.entity), "model_name", prob.alias("y_prob"), (prob >= F.col("threshold")).cast("int").alias("y_pred"))


def routes(completeness: DataFrame, baseline: DataFrame, cfg: ModelConfig = ModelConfig(), known: DataFrame | None = None) -> DataFrame:
    """(entity, route): temporal, single_shot or insufficient_history for every entity of the tables (and of ``known``)."""
    e = cfg.entity
    each = completeness.select(e, F.coalesce("temporal_complete", F.lit(False)).alias("t"), F.lit(False).alias("s"))
    each = each.unionByName(baseline.select(e, F.lit(False).alias("t"), F.lit(True).alias("s")))
    if known is not None:
        each = each.unionByName(known.select(e, F.lit(False).alias("t"), F.lit(False).alias("s")))
    route = F.when(F.bool_or("t"), "temporal").when(F.bool_or("s"), "single_shot").otherwise("insufficient_history")
    return each.where(q(e).isNotNull()).groupBy(e).agg(route.alias("route"))


def route_and_score(
    completeness: DataFrame, baseline: DataFrame, temporal: DataFrame, models: DataFrame, baseline_model: str, temporal_model: str,
    cfg: ModelConfig = ModelConfig(), known: DataFrame | None = None,
) -> DataFrame:
    """entity, route, model_name, y_prob, y_pred: one row an entity; one shuffle by entity.

    A temporal entity without a row in ``temporal`` keeps its route and has no score.
    """
    e = cfg.entity
    parts = [apply_model(baseline, models, baseline_model, cfg).withColumn("route", F.lit("single_shot"))]
    parts.append(apply_model(temporal, models, temporal_model, cfg).withColumn("route", F.lit("temporal")))
    scores = parts[0].unionByName(parts[1])
    return routes(completeness, baseline, cfg, known).join(scores, [e, "route"], "left").select(e, "route", "model_name", "y_prob", "y_pred")
