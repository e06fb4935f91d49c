"""Stage 06 preparation: feature matrix, CV policy, entity-level folds, fold-local statistics.

* Folds are assigned per entity (one row per entity in a feature table), so train and
  test never share an entity.  Stratified folds rank entities inside each class by
  ``md5(id:seed)``; the rank is computed without a global sort: md5 prefixes give 4096
  uniform buckets, a tiny window over bucket totals gives offsets, and ``row_number``
  inside each bucket finishes the exact rank.
* Fold-local statistics (median imputation, standardisation) as tables, for a few folds: counts and
  moments by fold are merged to those of the training folds; no row is copied (:mod:`foldranks`).
  Leave-one-out and the fits work without copies, too (:mod:`foldfit`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ModelConfig
from ..functions.codes import q
from .foldranks import medians_of

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal", "boolean")


def feature_columns(table: DataFrame, cfg: ModelConfig = ModelConfig()) -> list[str]:
    """MOD1: numeric columns other than the entity and the label (schema driven)."""
    return [c for c, t in table.dtypes if c not in (cfg.entity, cfg.label) and t.startswith(NUMERIC)]


def feature_matrix(table: DataFrame, cfg: ModelConfig = ModelConfig()) -> DataFrame:
    """MOD1: entity, label (non-null) and numeric features cast to double."""
    feats = feature_columns(table, cfg)
    return table.where(q(cfg.label).isNotNull()).select(
        cfg.entity, q(cfg.label).cast("int").alias(cfg.label), *[q(c).cast("double").alias(c) for c in feats]
    )


@dataclass(frozen=True)
class CvPolicy:
    strategy: str  # "LOOCV", "StratifiedKFold_<k>", or "" when skipped
    folds: int
    skip_reason: str
    n_rows: int
    positives: int
    negatives: int


def choose_cv(table: DataFrame, cfg: ModelConfig = ModelConfig()) -> CvPolicy:
    """MOD2: decide the CV scheme from class counts (one tiny aggregate)."""
    counts = {r[0]: r[1] for r in table.groupBy(cfg.label).count().collect() if r[0] is not None}
    pos, neg = int(counts.get(1, 0)), int(counts.get(0, 0))
    n = pos + neg
    if len([v for v in counts.values() if v > 0]) < 2:
        return CvPolicy("", 0, "not_run_single_class", n, pos, neg)
    minority = min(pos, neg)
    if minority < 2:
        return CvPolicy("", 0, "not_run_min_class_lt_2", n, pos, neg)
    req = cfg.cv_strategy.lower()
    if req == "loocv" or (req == "auto" and n <= cfg.auto_loocv_max_rows):
        return CvPolicy("LOOCV", n, "", n, pos, neg)
    k = min(cfg.max_folds, minority)
    return CvPolicy(f"StratifiedKFold_{k}", k, "", n, pos, neg)


def exact_rank(df: DataFrame, partition: list[str], key: Column, buckets_hex: int = 3) -> DataFrame:
    """1-based rank of ``key`` (a hex digest string) within ``partition``, computed in two small steps."""
    d = df.withColumns({"__key": key, "__bk": F.substring(key, 1, buckets_hex)})
    totals = d.groupBy(*partition, "__bk").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*partition).orderBy("__bk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*partition, "__bk", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    wi = Window.partitionBy(*partition, "__bk").orderBy("__key")
    d = d.withColumn("__rn", F.row_number().over(wi)).join(offsets, on=[*partition, "__bk"])
    return d.withColumn("__rank", F.col("__off") + F.col("__rn")).drop("__bk", "__rn", "__off")


def assign_folds(table: DataFrame, policy: CvPolicy, cfg: ModelConfig = ModelConfig()) -> DataFrame:
    """MOD3: stratified k-fold (rank within class modulo k) or leave-one-out (global rank)."""
    key = F.md5(F.concat(q(cfg.entity).cast("string"), F.lit(f":{cfg.seed}")))
    if policy.strategy == "LOOCV":
        r = exact_rank(table.withColumn("__all", F.lit(0)), ["__all"], key).drop("__all")
        return r.withColumn("fold", (F.col("__rank") - 1).cast("int")).drop("__rank", "__key")
    r = exact_rank(table, [cfg.label], key)
    return r.withColumn("fold", ((F.col("__rank") - 1) % policy.folds).cast("int")).drop("__rank", "__key")


def overlap_guard(folded: DataFrame, cfg: ModelConfig = ModelConfig()) -> DataFrame:
    """MOD4: entities appearing in more than one fold (must be empty)."""
    return folded.groupBy(cfg.entity).agg(F.count_distinct("fold").alias("folds")).where(F.col("folds") > 1)


def training_copies(folded: DataFrame, k: int) -> DataFrame:
    """Each row once per training fold it belongs to (``train_fold`` != its own fold)."""
    folds = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold"))
    return folded.withColumn("train_fold", F.explode(folds))


def _unpivot(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), q(c).cast("double").alias("value")) for c in features])
    return df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.feature", "p.value")


def fold_medians(folded: DataFrame, features: list[str], k: int) -> DataFrame:
    """MOD5: exact median of every feature over each training fold (null when all-null; dropped downstream).

    Runs its jobs when built: the rows are read three times, none is copied (:mod:`foldranks`).
    """
    medians, rows = medians_of(folded, features, k)
    out = [(f, c, None if medians[f, j] != medians[f, j] else float(medians[f, j])) for f in range(k) if rows[f] for j, c in enumerate(features)]
    return folded.sparkSession.createDataFrame(out, "train_fold int, feature string, median double")


def column_moments(folded: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(keys..., feature, rows, n, mean, m2) of the values by ``keys`` (fold, class): one aggregate, no copies."""
    equal = lambda c: F.min(c) == F.max(c)  # noqa: E731  (equal values: their mean and deviation unrounded)
    aggs = [(F.count(q(c)), F.when(equal(q(c)), F.min(q(c))).otherwise(F.avg(q(c))), F.when(equal(q(c)), F.lit(0.0)).otherwise(F.var_pop(q(c)) * F.count(q(c)))) for c in features]
    g = folded.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[a.alias(f"__{x}{i}") for i, each in enumerate(aggs) for x, a in zip("nam", each)])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"__n{i}").alias("n"), F.col(f"__a{i}").alias("mean"), F.col(f"__m{i}").alias("m2")) for i, c in enumerate(features)])
    return g.select(*keys, "rows", F.explode(cells).alias("c")).select(*keys, "c.feature", "rows", "c.n", "c.mean", "c.m2")


def training_moments(folded: DataFrame, features: list[str], k: int, medians: DataFrame, by: list[str] = ()) -> DataFrame:
    """(train_fold, by..., feature, n, mean, m2) of the median-imputed values of every training fold.

    The folds' moments (a row a fold, class and feature) are merged by deviations; missing entries are
    a part of their own, all of them at the median.
    """
    by = list(by)
    cells = column_moments(folded, ["fold", *by], features)
    cells = training_copies(cells, k).join(medians.where(F.col("median").isNotNull()), on=["train_fold", "feature"])
    parts = F.array(
        F.struct(F.col("n").alias("n"), F.coalesce("mean", "median").alias("mean"), F.coalesce("m2", F.lit(0.0)).alias("m2")),
        F.struct((F.col("rows") - F.col("n")).alias("n"), F.col("median").alias("mean"), F.lit(0.0).alias("m2")),
    )
    parts = cells.select("train_fold", *by, "feature", F.explode(parts).alias("p")).select("train_fold", *by, "feature", "p.*").where(F.col("n") > 0)
    w = Window.partitionBy("train_fold", *by, "feature")
    off = F.col("mean") - F.first("mean").over(w)  # from a value of the group, so that large values don't cancel
    parts = parts.withColumns({"at": F.first("mean").over(w), "off": off})
    g = parts.groupBy("train_fold", *by, "feature").agg(
        F.first("at").alias("at"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("off")) / F.sum("n")).alias("shift"),
        F.sum("m2").alias("within"), F.sum(F.col("n") * F.col("off") ** 2).alias("square"))
    spread = F.greatest(F.col("square") - F.col("n") * F.col("shift") ** 2, F.lit(0.0))
    return g.select("train_fold", *by, "feature", "n", (F.col("at") + F.col("shift")).alias("mean"), (F.col("within") + spread).alias("m2"))


def fold_scaling(folded: DataFrame, features: list[str], k: int, medians: DataFrame) -> DataFrame:
    """MOD6: mean and population std of median-imputed values per training fold; std 0 -> scale 1."""
    g = training_moments(folded, features, k, medians).select("train_fold", "feature", "mean", F.sqrt(F.col("m2") / F.col("n")).alias("std"))
    return g.withColumn("scale", F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(1.0)))


def fold_statistics(folded: DataFrame, features: list[str], k: int) -> DataFrame:
    """Medians and scaling for every (training fold, feature): the fold-local preprocessing state."""
    med = fold_medians(folded, features, k)
    return fold_scaling(folded, features, k, med).join(med, on=["train_fold", "feature"])
