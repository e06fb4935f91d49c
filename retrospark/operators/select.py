"""Stage 07: ANOVA F ranking, fold-local top-k / PCA reduction, candidate grid by CV G-Mean.

ANOVA F for two classes comes from per-(feature, class) moments -- one aggregate over an
unpivot.  The grid of candidates is nested (:func:`candidate_models`): one ranking and one
eigen-decomposition per fold serve all candidates, which are fitted together (:mod:`foldfit`).
The p-value is the regularised incomplete beta as an expression on the per-feature table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..config import ANOVA_K_GRID, PCA_N_GRID, ModelConfig
from ..functions.codes import q
from ..functions.stats import f_pvalue
from . import evaluate as EV
from . import foldfit as FF
from .foldranks import medians_of
from .folds import assign_folds, choose_cv, column_moments, feature_columns, feature_matrix, fold_medians, training_moments

#: Gram matrices of single rows held at once when features are selected by leave-one-out (cells).
GRAM_CELLS = 1 << 23


def anova_scores(classes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., feature) -> F statistic from (n, mean, m2) per class; m2 = sum of squared deviations.

    Between-class sums use deviations from the grand mean, so large offsets don't cancel.
    """
    w = Window.partitionBy(*keys, "feature")  # a row per class
    c = classes.where(F.col("n") > 0).withColumn("__grand", F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w))
    t = c.groupBy(*keys, "feature").agg(
        F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"), F.sum("m2").alias("ssw"), F.sum(F.col("n") * (F.col("mean") - F.col("__grand")) ** 2).alias("ssb")
    )
    df1, df2 = F.col("k") - 1, F.col("N") - F.col("k")
    fstat = F.when((F.col("ssw") > 0) & (df1 > 0) & (df2 > 0), (F.col("ssb") / df1) / (F.col("ssw") / df2)).when(F.col("ssb") > 0, F.lit(float("inf")))
    return t.select(*keys, "feature", fstat.alias("f_score"), df1.alias("df1"), df2.alias("df2"))


def anova_moments(long: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys..., feature) -> F statistic from class moments of ``value`` (nulls already imputed)."""
    g = long.groupBy(*keys, "feature", label).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("m2")
    )
    return anova_scores(g, keys)


def ranked_scores(table: DataFrame, cfg: ModelConfig = ModelConfig()) -> DataFrame:
    """(feature, f_score, df1, df2, rank) over the whole table after global median imputation."""
    ensure_checkpoint_dir(table.sparkSession)
    mat = feature_matrix(table, cfg).checkpoint()  # one row per entity; read by the medians and the moments
    feats = feature_columns(mat, cfg)
    medians, _ = medians_of(mat, feats, 1, whole=True)
    known = {c: float(m) for c, m in zip(feats, medians[0]) if m == m}  # a feature without values has no score
    imputed = mat.select(cfg.label, *[F.coalesce(q(c), F.lit(m)).alias(c) for c, m in known.items()])
    classes = column_moments(imputed, [cfg.label], list(known)) if known else mat.sparkSession.createDataFrame([], f"{cfg.label} int, feature string, rows bigint, n bigint, mean double, m2 double")
    scores = anova_scores(classes, [])
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last(F.round("f_score", 6)), "feature")  # one row per feature
    return scores.withColumn("rank", F.row_number().over(w))


def anova_ranking(table: DataFrame, cfg: ModelConfig = ModelConfig(), with_p: bool = True) -> DataFrame:
    """IMP1: F, p and rank per feature over the whole table after global median imputation."""
    scores = ranked_scores(table, cfg)
    return with_p_values(scores) if with_p else scores.drop("df1", "df2")


def with_p_values(scores: DataFrame) -> DataFrame:
    """Scores with their p-value instead of the degrees of freedom."""
    return scores.withColumn("p_value", f_pvalue(F.col("f_score"), F.col("df1"), F.col("df2"))).drop("df1", "df2")


def fold_anova_topk(folded: DataFrame, features: list[str], k_folds: int, top_k: int, cfg: ModelConfig = ModelConfig()) -> DataFrame:
    """IMP3: per training fold, ANOVA on fold-median-imputed values and the top-k features (NaN F last).

    F scores equal to 6 decimals (e.g. proportional features) are ordered by feature name.
    """
    medians = fold_medians(folded, features, k_folds)
    scores = anova_scores(training_moments(folded, features, k_folds, medians, [cfg.label]), ["train_fold"])
    w = Window.partitionBy("train_fold").orderBy(F.desc_nulls_last(F.round("f_score", 6)), "feature")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).select("train_fold", "feature", "f_score", "rank")


def sanitize_candidates(limit: int, values: list[int]) -> list[int]:
    """IMP2: distinct candidates in 1..limit, ascending."""
    return sorted({int(v) for v in values if 0 < int(v) <= limit})


def candidate_models(set_name: str, units: FF.Units, trains: list[FF.TrainingSet], ks: list[int], ns: list[int]) -> list[FF.Model]:
    """IMP3-IMP7: a model of every fold for every candidate: [ANOVA top-k] -> [PCA n] -> balanced regression.

    Features are ranked once per fold, so every k is a prefix; components are computed once per
    fold and set of features, so every n is a prefix.
    """
    out = []
    for t in trains:
        ranking = t.ranking(units.features)
        sets = [("pca", 0, ranking)] + [("anova_pca", k, ranking[:k]) for k in ks]
        out += [FF.model(f"{set_name}|anova|k={k}|n=0", t, ranking[:k]) for k in ks]
        for mode, k, columns in sets:
            fitting = [n for n in ns if mode == "pca" or n <= k]
            if not fitting:
                continue
            if max(fitting) > len(columns):  # a fold has fewer usable features than components asked for
                raise ValueError(f"{set_name}: {max(fitting)} components of {len(columns)} features in fold {t.fold}")
            _, directions = FF.components(t, columns)
            out += [FF.model(f"{set_name}|{mode}|k={k}|n={n}", t, columns, directions[:, :n]) for n in fitting]
    return out


def fold_pca_variance(folded: DataFrame, features: list[str], k_folds: int, n: int, cfg: ModelConfig = ModelConfig()) -> DataFrame:
    """IMP4: share of the variance of the first ``n`` components of every training fold's standardised features."""
    _, trains = FF.prepare(folded, features, k_folds, cfg)
    rows = []
    for t in trains:
        variances, _ = FF.components(t, np.flatnonzero(t.used).tolist())
        rows += [(t.fold, i + 1, float(v)) for i, v in enumerate(variances[:n] / variances.sum())]
    return folded.sparkSession.createDataFrame(rows, "train_fold int, component int, explained_variance_ratio double")


def _preference():
    """Best candidate: highest G-Mean, then the fewest features and components."""
    return F.struct(F.coalesce("g_mean", F.lit(-1.0)), -F.col("anova_k"), -F.col("pca_n"))


def run_set_analysis(table: DataFrame, set_name: str, cfg: ModelConfig = ModelConfig(), k_grid: list[int] = ANOVA_K_GRID, n_grid: list[int] = PCA_N_GRID) -> dict[str, DataFrame]:
    """IMP8: grid over ANOVA k, PCA n and ANOVA+PCA (n <= k); metrics per candidate; best per method."""
    spark = table.sparkSession
    ensure_checkpoint_dir(spark)
    mat = feature_matrix(table, cfg).checkpoint()
    feats = feature_columns(mat, cfg)
    policy = choose_cv(mat, cfg)
    reason = policy.skip_reason or ("" if feats else "not_run_no_numeric_features")
    if reason:
        skipped = spark.createDataFrame([(set_name, reason)], "feature_set string, skip_reason string")
        return {"performance": spark.createDataFrame([], "feature_set string"), "best": spark.createDataFrame([], "feature_set string"), "skipped": skipped}
    folded = assign_folds(mat, policy, cfg).checkpoint()
    loo = policy.strategy == "LOOCV"
    if loo and policy.n_rows * (1 + 2 * len(feats)) ** 2 > GRAM_CELLS:
        raise ValueError(f"{set_name}: leave-one-out selection of {policy.n_rows} rows; use stratified folds")
    units, trains = FF.prepare(folded, feats, policy.folds, cfg, loo)
    min_train = min(t.positives + t.negatives for t in trains)
    ks = sanitize_candidates(len(feats), k_grid)
    ns = sanitize_candidates(min(min_train, *[int(t.used.sum()) for t in trains]), n_grid)  # components that every fold can give
    models = candidate_models(set_name, units, trains, ks, ns)
    FF.fit(folded, units, models, cfg)
    # written once: read by the confusion counts and by the ranking
    fitted = FF.model_table(spark, units, models)
    # a row a fold and candidate: dealt by fold, the rows would be scored by as many tasks as there are folds
    allp = FF.score(folded, fitted if loo else F.broadcast(fitted), feats, cfg).checkpoint()
    m = EV.metrics_table(allp)
    parts = F.split("model_name", r"\|")
    perf = m.select(
        F.lit(set_name).alias("feature_set"), parts[1].alias("method"),
        F.regexp_extract(parts[2], r"k=(\d+)", 1).cast("int").alias("anova_k"),
        F.regexp_extract(parts[3], r"n=(\d+)", 1).cast("int").alias("pca_n"),
        "sensitivity", "specificity", "g_mean", "roc_auc", "pr_auc",
    )
    best = perf.groupBy("feature_set", "method").agg(F.max_by(F.struct("anova_k", "pca_n", "g_mean", "sensitivity", "specificity"), _preference()).alias("b")).select("feature_set", "method", "b.*")
    return {"performance": perf, "best": best, "skipped": spark.createDataFrame([], "feature_set string, skip_reason string"), "predictions": allp}


def run_feature_importance(tables: dict[str, DataFrame], cfg: ModelConfig = ModelConfig(), k_grid: list[int] = ANOVA_K_GRID,
                           n_grid: list[int] = PCA_N_GRID) -> dict[str, DataFrame]:
    """IMP9: ranking, per-set performance grids and best choices for every temporal feature set."""
    perf, best, skipped, ranking = [], [], [], []
    for name, t in tables.items():
        ranking.append(ranked_scores(t, cfg).withColumn("feature_set", F.lit(name)))
        res = run_set_analysis(t, name, cfg, k_grid, n_grid)
        perf.append(res["performance"])
        best.append(res["best"])
        skipped.append(res["skipped"])

    def union(parts):
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    bests = union(best)
    summary = bests.groupBy("feature_set").agg(F.max_by(F.struct("method", "anova_k", "pca_n", "g_mean"), _preference()).alias("b")).select("feature_set", "b.*")
    return {
        "anova_feature_ranking": with_p_values(union(ranking)).select("feature", "f_score", "rank", "p_value", "feature_set"),  # one large expression, not one a set
        "performance_grid": union(perf),
        "best_choice_per_method": bests,
        "best_choice_per_set": summary,
        "skipped_sets": union(skipped),
    }
