"""Batched cross-validation against a plain numpy version, spark.ml, and leave-one-out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retrospark.config import ModelConfig
from retrospark.functions.profile import order_statistics
from retrospark.operators import evaluate as EV
from retrospark.operators import foldfit as FF
from retrospark.operators import folds as FO
from retrospark.operators import model as MO
from retrospark.operators import select as SE

CFG = ModelConfig(entity="patient_id", label="stroke", cv_strategy="stratified", max_folds=3)
FEATS = ["a", "b", "c", "flag", "same", "gone", "offset"]


def data(n=90, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, len(FEATS)))
    x[:, 2] = np.round(x[:, 2])  # ties
    x[:, 3] = 0.0
    x[7, 3] = 1.0  # constant without row 7
    x[:, 4] = 5.0
    x[:, 5] = np.nan
    x[3, 5] = 2.0  # no value without row 3
    x[:, 6] = 1e6 + x[:, 6]
    x[rng.random((n, len(FEATS))) < 0.15] = np.nan
    x[3, 5], x[7, 3] = 2.0, 1.0
    y = (np.nan_to_num(x[:, 0]) - np.nan_to_num(x[:, 1]) + rng.normal(size=n) > 0.6).astype(int)
    return x, y


def frame(spark, x, y):
    rows = [(i, int(t), *[None if np.isnan(v) else float(v) for v in r]) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "patient_id long, stroke int, " + ", ".join(f"{c} double" for c in FEATS)).repartition(3)


def newton(z, y, s, c=1.0):
    a, w = np.column_stack([np.ones(len(z)), z]), np.zeros(z.shape[1] + 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-a @ w))
        move = np.linalg.solve((a * (s * p * (1 - p))[:, None]).T @ a + np.eye(len(w)) / c, a.T @ (s * (p - y)) + w / c)
        w -= move
    return w


def preprocess(x, y, train):
    with np.errstate(all="ignore"):
        med = np.array([np.median(v[~np.isnan(v)]) if (~np.isnan(v)).any() else np.nan for v in x[train].T])
    full = np.where(np.isnan(x), med, x)
    mean, std = full[train].mean(axis=0), full[train].std(axis=0)
    std = np.where(std > 1e-9, std, 0.0)
    z = (full - mean) / np.where(std > 0, std, 1.0)
    return med, mean, std, z


def anova(z, y):
    f = []
    for v in z.T:
        groups = [v[y == c] for c in (0, 1)]
        within = sum(((g - g.mean()) ** 2).sum() for g in groups)
        between = sum(len(g) * (g.mean() - v.mean()) ** 2 for g in groups)
        f.append(between / (within / (len(v) - 2)) if within > 1e-9 else np.nan)
    return np.array(f)


def brute_scores(x, y, fold, mode="all", k=0, n=0):
    out = np.zeros(len(y))
    for f in np.unique(fold):
        train = fold != f
        med, _, _, z = preprocess(x, y, train)
        cols = [i for i in range(x.shape[1]) if not np.isnan(med[i])]
        if mode.startswith("anova"):
            score = anova(z[train], y[train])
            cols = sorted(cols, key=lambda i: (np.isnan(score[i]), -round(score[i], 6) if not np.isnan(score[i]) else 0, FEATS[i]))[:k]
        z = z[:, cols]
        if mode.endswith("pca"):
            values, vectors = np.linalg.eigh(np.cov(z[train].T, bias=True))
            z = z @ vectors[:, ::-1][:, :n]
        total, pos = train.sum(), y[train].sum()
        s = np.where(y == 1, total / (2.0 * pos), total / (2.0 * (total - pos)))
        w = newton(z[train], y[train], s[train])
        out[~train] = 1 / (1 + np.exp(-(w[0] + z[~train] @ w[1:])))
    return out


def folds_of(folded, n):
    out = np.zeros(n, int)
    for r in folded.select("patient_id", "fold").collect():
        out[r[0]] = r[1]
    return out


def probs(preds, n):
    out = np.full(n, np.nan)
    for r in preds.collect():
        out[r["patient_id"]] = r["y_prob"]
    return out


def test_stratified_predictions(spark):
    x, y = data()
    table = frame(spark, x, y)
    preds, result = MO.train_predict_cv(table, "m", CFG)
    fold = np.zeros(len(y), int)
    for r in preds.collect():
        fold[r["patient_id"]] = r["fold"]
    assert result["cv_strategy"] == "StratifiedKFold_3" and result["class_weight"] == "balanced"
    assert np.allclose(probs(preds, len(y)), brute_scores(x, y, fold), atol=1e-7)


def test_leave_one_out_predictions_and_statistics(spark, monkeypatch):
    x, y = data(60)
    cfg = ModelConfig(entity="patient_id", label="stroke", cv_strategy="loocv")
    table = frame(spark, x, y)
    folded = FO.assign_folds(FO.feature_matrix(table, cfg), FO.choose_cv(table, cfg), cfg).checkpoint()
    fold = folds_of(folded, len(y))
    got = {(r["train_fold"], r["feature"]): r for r in FF.loo_statistics(folded, FEATS, cfg).collect()}
    for i in range(len(y)):
        med, mean, std, _ = preprocess(x, y, np.arange(len(y)) != i)
        for j, c in enumerate(FEATS):
            r = got[fold[i], c]
            if np.isnan(med[j]):
                assert r["median"] is None and r["scale"] is None
                continue
            scale = std[j] if std[j] > 0 else 1.0
            assert np.allclose([r["median"], r["mean"], r["std"], r["scale"]], [med[j], mean[j], std[j], scale], rtol=1e-9, atol=1e-7), (i, c)
    want = brute_scores(x, y, fold)
    preds, _ = MO.train_predict_cv(table, "m", cfg)
    assert np.allclose(probs(preds, len(y)), want, atol=1e-6)
    monkeypatch.setattr(FF, "LOO_BLOCK", 17)  # several blocks of models
    preds, _ = MO.train_predict_cv(table, "m", cfg)
    assert np.allclose(probs(preds, len(y)), want, atol=1e-6)


def test_leave_one_out_copies_no_rows(spark):
    x, y = data(60)
    cfg = ModelConfig(entity="patient_id", label="stroke", cv_strategy="loocv")
    table = frame(spark, x, y)
    folded = FO.assign_folds(FO.feature_matrix(table, cfg), FO.choose_cv(table, cfg), cfg).checkpoint()
    plan = FF.loo_statistics(folded, FEATS, cfg)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1 and "SortMergeJoin" not in plan and "Exchange hash" not in plan  # the features of a row, and the facts of each by broadcast


@pytest.mark.parametrize("loo", [False, True])
def test_every_candidate_of_the_grid(spark, loo):
    x, y = data(45 if loo else 90)
    cfg = ModelConfig(entity="patient_id", label="stroke", cv_strategy="loocv" if loo else "stratified", max_folds=3)
    table = frame(spark, x, y).drop("gone")
    res = SE.run_set_analysis(table, "s", cfg, k_grid=[2, 4], n_grid=[1, 3])
    fold = folds_of(res["predictions"].select("patient_id", "fold").distinct(), len(y))
    keep = [i for i, c in enumerate(FEATS) if c != "gone"]
    names = {r[0] for r in res["predictions"].select("model_name").distinct().collect()}
    assert names == {"s|anova|k=2|n=0", "s|anova|k=4|n=0", "s|pca|k=0|n=1", "s|pca|k=0|n=3", "s|anova_pca|k=2|n=1", "s|anova_pca|k=4|n=1", "s|anova_pca|k=4|n=3"}
    saved = FEATS[:]
    try:
        FEATS[:] = [FEATS[i] for i in keep]
        for name in names:
            mode, k, n = name.split("|")[1], int(name.split("k=")[1].split("|")[0]), int(name.split("n=")[1])
            got = probs(res["predictions"].where(F.col("model_name") == name), len(y))
            assert np.allclose(got, brute_scores(x[:, keep], y, fold, mode, k, n), atol=1e-6), name
    finally:
        FEATS[:] = saved
    assert {r.method for r in res["best"].collect()} == {"anova", "pca", "anova_pca"}


def test_jobs_do_not_grow_with_folds_or_candidates(spark):
    x, y = data(120)
    sc = spark.sparkContext
    counts = []
    for k, ks in ((2, [3]), (6, [1, 2, 3, 4])):
        cfg = ModelConfig(entity="patient_id", label="stroke", cv_strategy="stratified", max_folds=k)
        table = frame(spark, x, y).drop("gone")
        folded = FO.assign_folds(FO.feature_matrix(table, cfg), FO.choose_cv(table, cfg), cfg).checkpoint()
        feats = [c for c in FEATS if c != "gone"]
        units, trains = FF.prepare(folded, feats, k, cfg)
        models = SE.candidate_models("s", units, trains, ks, [1])
        sc.setJobGroup(f"fit{k}", "fits")
        steps = FF.fit(folded, units, models, cfg)
        jobs = len(sc.statusTracker().getJobIdsForGroup(f"fit{k}"))
        sc.setJobGroup("rest", "")
        counts.append((len(models), jobs / steps))
    assert counts[0][0] < counts[1][0] and counts[0][1] == counts[1][1]


def test_fit_equals_spark_ml(spark):
    """spark.ml with the constant as a feature (half of the rows mirrored, so that it varies)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    x, y = data(150)
    x = np.nan_to_num(x[:, :3])
    n, pos = len(y), int(y.sum())
    rows = [(i, int(t), 0, *map(float, r)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "patient_id long, stroke int, fold int, a double, b double, c double").withColumn("one", F.lit(1.0))
    mirror = F.col("patient_id") % 2 == 1
    sides = df.withColumns({c: F.when(mirror, -F.col(c)).otherwise(F.col(c)) for c in ("one", "a", "b", "c")})
    sides = sides.withColumn("w", F.when(F.col("stroke") == 1, n / (2.0 * pos)).otherwise(n / (2.0 * (n - pos)))).withColumn("y", F.when(mirror, 1 - F.col("stroke")).otherwise(F.col("stroke")))
    train = VectorAssembler(inputCols=["one", "a", "b", "c"], outputCol="features").transform(sides)
    ml = LogisticRegression(labelCol="y", weightCol="w", regParam=1.0 / n, standardization=False, fitIntercept=False, maxIter=1000, tol=1e-14).fit(train)
    model = FF.Model("m", -1, np.eye(7)[:, :4], (n / (2.0 * (n - pos)), n / (2.0 * pos)), np.zeros(4))
    FF.fit(df, FF.Units(("a", "b", "c"), np.zeros(3), np.ones(3)), [model], CFG)
    assert np.allclose(model.coef, ml.coefficients.toArray(), atol=1e-6)


def test_order_statistics(spark):
    values = [3.0, 1.0, 1.0, None, 2.0, 9.0]
    df = spark.createDataFrame([("g", v) for v in values] + [("h", 4.0), ("i", None)], "k string, v double")
    out = order_statistics(df, ["k"], "v", [F.lit(0), F.floor(F.col("n") / 2), F.col("n") - 1, F.col("n")], values_per_bucket=2).collect()
    assert sorted((r["k"], r["place"], r["value"]) for r in out) == [("g", 0, 1.0), ("g", 2, 2.0), ("g", 4, 9.0), ("h", 0, 4.0)]


def test_metrics_of_the_grid_are_finite(spark):
    x, y = data()
    res = SE.run_set_analysis(frame(spark, x, y).drop("gone"), "s", CFG, k_grid=[3], n_grid=[2])
    assert all(0 <= r["g_mean"] <= 1 for r in res["performance"].collect())
    assert EV.metrics_table(res["predictions"]).count() == 3


def test_registered_run_has_the_whole_grid(spark, monkeypatch):
    from retrospark.config import ANOVA_K_GRID, FEATURE_TARGET_COUNTS, PCA_N_GRID
    from retrospark.plans import catalog as K
    from retrospark.plans import pipeline as P

    monkeypatch.setattr(K, "_memo", lambda kind, s, sf, build: build())
    monkeypatch.setattr(K, "fixture_visits", lambda s, sf: None)
    monkeypatch.setattr(P, "run_pipeline", lambda s, raw, cfg: cfg)
    cfg = K._full_run(spark, "")
    assert (list(cfg.anova_k), list(cfg.pca_n), cfg.importance, cfg.skip_modeling) == (ANOVA_K_GRID, PCA_N_GRID, True, False)
    made = []
    for n in FEATURE_TARGET_COUNTS.values():
        rng = np.random.default_rng(n)
        units = FF.Units(tuple(f"f{i:03d}" for i in range(n)), np.zeros(n), np.ones(n))
        u = units.u(rng.normal(size=(200, n)))
        y = np.arange(200) % 2
        grams = np.array([[u[(np.arange(200) // 100 == f) & (y == c)].T @ u[(np.arange(200) // 100 == f) & (y == c)] for c in (0, 1)] for f in (0, 1)])
        trains = FF.training_sets(grams, np.zeros((2, n)), units)
        models = SE.candidate_models("s", units, trains, SE.sanitize_candidates(n, ANOVA_K_GRID), SE.sanitize_candidates(n, PCA_N_GRID))
        made.append(len(models) // 2)
        assert made[-1] == K._candidates(n)
        # models of a fold whose columns are the same and whose directions are prefixes share their products with the rows
        sets = FF._nested(models, {i: m.coef for i, m in enumerate(models)})
        assert [len(s[2]) for s in sets] == [1 + 2 * sum(k <= n for k in ANOVA_K_GRID)] * 2 and sum(len(x[2]) for s in sets for x in s[2]) == len(models)
    assert f"candidates={sum(made)}" in K.ORACLES["val7_leakage_evidence"]
