"""Readers (CSV suffix dispatch, prediction files), LR parity with a Newton solver, selection grid."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001


def test_read_records_csv_and_unknown_suffix(spark):
    from retrospark.sources.visits import read_records

    d = tempfile.mkdtemp(prefix="retrospark-csv-")
    path = os.path.join(d, "visits.csv")
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write("hn,vstdate,PrincipleDiagnosis\n1,2020-01-01,I64\n2,2020-02-01,\n")
    df = read_records(spark, path, required=["hn", "vstdate"])
    assert df.columns[0] == "hn" and df.count() == 2
    with pytest.raises(ValueError):
        read_records(spark, os.path.join(d, "visits.xlsx"))
    with pytest.raises(KeyError):
        read_records(spark, path, required=["missing_col"])


def test_prediction_files(spark):
    from retrospark.sources.predictions import read_prediction_files

    d = tempfile.mkdtemp(prefix="retrospark-preds-")
    for name, cols in (("single_shot", "patient_id,y_true,y_pred,y_prob"), ("bad", "patient_id,y_prob")):
        with open(os.path.join(d, f"{name}_predictions.csv"), "w") as f:
            f.write(cols + "\n")
            f.write("1,1,1,0.9\n" if name == "single_shot" else "1,0.5\n")
    out = read_prediction_files(spark, d)
    assert [r.model_name for r in out.select("model_name").distinct().collect()] == ["single_shot"]


def _newton(X, y, w, lam, iters=100):
    """Weighted logistic loss / sum(w) + lam/2 |beta|^2 (intercept unpenalised)."""
    n, p = X.shape
    A = np.hstack([np.ones((n, 1)), X])
    beta = np.zeros(p + 1)
    W = w.sum()
    for _ in range(iters):
        mu = 1 / (1 + np.exp(-A @ beta))
        g = A.T @ (w * (mu - y)) / W
        g[1:] += lam * beta[1:]
        H = (A * (w * mu * (1 - mu))[:, None]).T @ A / W
        H[1:, 1:] += lam * np.eye(p)
        step = np.linalg.solve(H, g)
        beta -= step
        if np.abs(step).max() < 1e-12:
            break
    return beta


def test_logistic_regression_parity(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(3)
    n = 300
    X = rng.normal(size=(n, 3))
    y = (X @ np.array([1.0, -2.0, 0.5]) + rng.normal(size=n) > 1.0).astype(float)
    pos, neg = int(y.sum()), int(n - y.sum())
    w = np.where(y == 1, n / (2.0 * pos), n / (2.0 * neg))
    lam = 1.0 / n
    ref = _newton(X, y, w, lam)
    df = spark.createDataFrame([(float(a), float(b), float(c), int(t)) for (a, b, c), t in zip(X, y)], "a double, b double, c double, stroke int")
    data = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df.withColumn("__w", F.when(F.col("stroke") == 1, n / (2.0 * pos)).otherwise(n / (2.0 * neg))))
    m = LogisticRegression(labelCol="stroke", weightCol="__w", regParam=lam, elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-12).fit(data)
    got = np.concatenate([[m.intercept], m.coefficients.toArray()])
    assert np.allclose(got, ref, atol=1e-5)


def test_selection_grid_small(spark):
    from retrospark.config import ModelConfig
    from retrospark.operators import select as SE
    from retrospark.plans import catalog as K

    cfg = ModelConfig(entity="patient_id", label="stroke", cv_strategy="stratified", max_folds=3, max_iter=30)
    t = K.stage5(spark, SF001)["extract_set_1"]
    res = SE.run_set_analysis(t, "extract_set_1", cfg, k_grid=[5], n_grid=[2, 3])
    perf = res["performance"].collect()
    assert {(r.method, r.anova_k, r.pca_n) for r in perf} == {("anova", 5, 0), ("pca", 0, 2), ("pca", 0, 3), ("anova_pca", 5, 2), ("anova_pca", 5, 3)}
    best = {r.method for r in res["best"].collect()}
    assert best == {"anova", "pca", "anova_pca"}
    ranking = SE.anova_ranking(t, cfg).collect()
    assert all(r.p_value is None or 0.0 <= r.p_value <= 1.0 for r in ranking)


def test_f_pvalue_reference_points(spark):
    from retrospark.functions.stats import beta_inc, f_pvalue

    # P(F(1, 100) > 3.936) ~= 0.05 ; P(F(1, 10) > 4.965) ~= 0.05 ; F = 0 -> p = 1 ; F(2, d) has the closed form (1 + 2 f / d) ** (-d / 2)
    rows = [(3.936, 1, 100), (4.965, 1, 10), (0.0, 1, 10), (float("inf"), 1, 10), (None, 1, 10), (1.0, 1, 0)] + [(f, 2, d) for f in (0.1, 1.0, 7.0) for d in (4, 60, 5000, 400_000)]
    df = spark.createDataFrame(rows, "f double, a int, b int").repartition(1)
    got = [r[0] for r in df.select(f_pvalue(F.col("f"), F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - 0.05) < 5e-4 and abs(got[1] - 0.05) < 5e-4 and abs(got[2] - 1.0) < 1e-12 and got[3] == 0.0 and got[4] is None and got[5] is None
    for (f, _, d), p in zip(rows[6:], got[6:], strict=True):
        assert abs(p - (1 + 2 * f / d) ** (-d / 2)) < 1e-9  # 1 - x loses digits at 400,000 degrees of freedom
    # I_x(a, 1) = x ** a, and the symmetry of the two sides
    pairs = spark.createDataFrame([(a, x) for a in (0.5, 3.0, 40.0) for x in (0.01, 0.5, 0.99)], "a double, x double")
    for a, x, left, right in pairs.select("a", "x", beta_inc(F.col("a"), F.lit(1.0), F.col("x")), beta_inc(F.lit(1.0), F.col("a"), 1 - F.col("x"))).collect():
        assert abs(left - x**a) < 1e-11 and abs(left + right - 1) < 1e-11


def test_optional_catalog_context_and_sinks(spark):
    from retrospark.sources.files import feature_catalog, optional_table, read_context, write_report, write_table

    root = tempfile.mkdtemp(prefix="retrospark-files-")
    empty = optional_table(spark, os.path.join(root, "missing"), "a int, b string")
    assert empty.count() == 0 and empty.columns == ["a", "b"]
    df = spark.createDataFrame([(1, 0.5)], "patient_id long, x double")
    write_table(df, os.path.join(root, "single_shot"))
    cat = feature_catalog(spark, root)
    assert list(cat) == ["single_shot"] and cat["single_shot"].count() == 1
    with pytest.raises(FileNotFoundError):
        feature_catalog(spark, os.path.join(root, "nowhere"))
    write_report(spark.createDataFrame([("extract_set_1", 0.7)], "best string, g double"), os.path.join(root, "report"))
    ctx = read_context(spark, os.path.join(root, "report")).first()
    assert ctx.best == "extract_set_1"


def test_feature_importance_runner(spark):
    from retrospark.config import ModelConfig
    from retrospark.operators import select as SE
    from retrospark.plans import catalog as K

    cfg = ModelConfig(entity="patient_id", label="stroke", cv_strategy="stratified", max_folds=2, max_iter=10)
    t = K.stage5(spark, SF001)["extract_set_1"]
    out = SE.run_feature_importance({"extract_set_1": t}, cfg, k_grid=[5], n_grid=[2])
    assert out["best_choice_per_set"].count() == 1
    assert out["anova_feature_ranking"].count() == 35


def test_p_values_of_all_sets_are_one_expression(spark, monkeypatch):
    from retrospark.config import ModelConfig
    from retrospark.operators import select as SE

    cfg = ModelConfig(entity="patient_id", label="stroke")
    rows = [(i, i % 3 == 0, float(i * i % 11), None if i % 5 == 0 else float(i % 4)) for i in range(40)]
    one = spark.createDataFrame(rows, "patient_id int, stroke boolean, a double, b double").withColumn("stroke", F.col("stroke").cast("int"))
    tables = {"one": one, "two": one.withColumn("a", F.col("a") + F.col("stroke"))}
    want = sorted((n, r["feature"], r["rank"], r["f_score"], r["p_value"]) for n, t in tables.items() for r in SE.anova_ranking(t, cfg).collect())
    made = []
    best = spark.createDataFrame([], "feature_set string, method string, anova_k int, pca_n int, g_mean double")
    monkeypatch.setattr(SE, "run_set_analysis", lambda *a: {"performance": best, "best": best, "skipped": best})
    monkeypatch.setattr(SE, "f_pvalue", lambda *a, f=SE.f_pvalue: made.append(1) or f(*a))
    ranking = SE.run_feature_importance(tables, cfg)["anova_feature_ranking"]
    assert ranking.columns == ["feature", "f_score", "rank", "p_value", "feature_set"] and len(made) == 1
    assert sorted((r["feature_set"], r["feature"], r["rank"], r["f_score"], r["p_value"]) for r in ranking.collect()) == want
