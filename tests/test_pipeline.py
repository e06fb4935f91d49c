"""End-to-end run on sf0.001: every stage's acceptance checks pass; outputs land on disk."""

import os
import tempfile

from conftest import SF001


def test_pipeline_to_features(spark):
    from retrospark.plans.pipeline import PipelineConfig, run_pipeline
    from retrospark.sources.visits import FIXTURE_CLEAN, FIXTURE_RAW, fixture_visits

    root = tempfile.mkdtemp(prefix="retrospark-pipe-")
    out = run_pipeline(spark, fixture_visits(spark, SF001), PipelineConfig(raw=FIXTURE_RAW, clean=FIXTURE_CLEAN, output_root=root))
    acc = out["00"]["pipeline_acceptance"].collect()
    failed = [(r.stage, r.check) for r in acc if not r.passed]
    assert not failed, failed
    assert os.path.isdir(os.path.join(root, "feature_engineering_output", "extract_set_1"))
    assert spark.read.parquet(os.path.join(root, "feature_engineering_output", "extract_set_3")).columns.__len__() == 123


def test_modelling_and_validation(spark):
    from retrospark.config import ModelConfig
    from retrospark.operators import evaluate as EV
    from retrospark.operators import model as MO
    from retrospark.plans import catalog as K

    cfg = ModelConfig(entity="patient_id", label="stroke", cv_strategy="stratified", max_iter=50)
    st5 = K.stage5(spark, SF001)
    preds, res = MO.train_predict_cv(st5["extract_set_1"], "extract_set_1", cfg)
    n = st5["extract_set_1"].count()
    p = preds.toPandas()
    assert len(p) == n and p["patient_id"].is_unique
    assert p["y_prob"].between(0, 1).all()
    m = EV.metrics_table(preds).first()
    assert 0.0 <= m.g_mean <= 1.0 and m.roc_auc is not None


def test_input_manifest(spark):
    import hashlib

    from retrospark.sources.files import input_manifest

    rows = {r.file_name: r for r in input_manifest(spark, f"{SF001}/nation.parquet").collect()}
    data = open(f"{SF001}/nation.parquet", "rb").read()
    assert rows["nation.parquet"].sha256 == hashlib.sha256(data).hexdigest()
    assert rows["nation.parquet"].size_bytes == len(data)
    pieces = {r.file_name: r for r in input_manifest(spark, f"{SF001}/[nr]*.parquet", whole=100, chunk=1000).collect()}
    assert pieces["nation.parquet"] == rows["nation.parquet"] and len(pieces) == 2


def test_pipeline_with_models(spark):
    from retrospark.config import ModelConfig
    from retrospark.plans.pipeline import PipelineConfig, run_pipeline
    from retrospark.sources.visits import FIXTURE_CLEAN, FIXTURE_RAW, fixture_visits

    cfg = PipelineConfig(raw=FIXTURE_RAW, clean=FIXTURE_CLEAN, skip_modeling=False,
                         model=ModelConfig(entity="patient_id", label="stroke", cv_strategy="stratified", max_folds=2, max_iter=10), anova_k=(5,), pca_n=(2,))
    out = run_pipeline(spark, fixture_visits(spark, SF001), cfg)
    metrics = {r.model_name: r for r in out["08"]["validation_metrics"].collect()}
    assert set(metrics) == {"single_shot", "extract_set_1", "extract_set_2", "extract_set_3"}
    mc = out["08"]["mcnemar_test_report"].first()
    assert mc.baseline_model == "single_shot" and mc.challenger_model in metrics
    assert out["07"]["performance_grid"].count() == 9  # three sets: anova, pca, both
    assert {r.check: r.passed for r in out["08"]["leakage_audit_report"].collect()} == {
        "eda_no_post_reference_records": True, "feature_selection_and_pca_fold_local_fit": True
    }
    failed = [(r.stage, r.check) for r in out["00"]["pipeline_acceptance"].collect() if not r.passed]
    assert not failed, failed


def test_run_level_checks_can_fail(spark):
    from pyspark.sql import functions as F

    from retrospark.plans.pipeline import leakage_guards, pipeline_acceptance

    facts = lambda ok, windows: spark.createDataFrame([(ok, windows)], "no_post_reference_records boolean, observed_windows array<string>")
    passed = lambda ok: spark.createDataFrame([("c", ok)], "check string, passed boolean")
    log = lambda ok: spark.createDataFrame([(ok,)], "pre_reference_only boolean")
    steps = lambda n: spark.createDataFrame([("raw_input", n)], "step string, records_remaining bigint")
    stage = {"01": spark.createDataFrame([("x", True, "")], "check string, passed boolean, detail string")}
    shots = spark.range(2)

    def run(f, att, single, guards):
        rows = pipeline_acceptance(stage, f, att, single, guards, None, None).collect()
        return {r.check for r in rows if not r.passed}

    good = facts(True, ["FIRST", "MID", "LAST"])
    guards = leakage_guards(good, passed(True), passed(True), log(True))
    assert run(good, steps(5), shots, guards) == set()
    assert run(good, steps(0), shots, guards) == {"raw_input_exists"}
    assert run(good, steps(5), shots.limit(0), guards) == {"single_shot_baseline_available"}
    assert run(facts(True, ["FIRST"]), steps(5), shots, guards) == {"paper_default_temporal_windows_registered"}
    for bad in ([False, True, True, True], [True, False, True, True], [True, True, False, True], [True, True, True, False]):
        g = leakage_guards(facts(bad[0], []), passed(bad[1]), passed(bad[2]), log(bad[3]))
        assert run(good, steps(5), shots, g) == {"post_reference_leakage_guardrail"}
    assert F is not None


def test_modelling_checks_can_fail(spark):
    from retrospark.operators.model import RUN_DDL, modeling_acceptance

    def failed(overlap, weight):
        res = spark.createDataFrame([("single_shot", "completed", "", 10, 3, 4, 6, "LOOCV", overlap, weight)], RUN_DDL)
        metrics = spark.createDataFrame([("completed", 0.5, 0.5)], "status string, g_mean double, sensitivity double")
        return {r.check for r in modeling_acceptance(res, metrics).collect() if not r.passed}

    assert failed(False, "balanced") == set()
    assert failed(True, "balanced") == {"train_test_patient_overlap_prevented"}
    assert failed(False, "unbalanced") == {"logistic_regression_balanced_used"}


def test_string_ids_and_tables_without_features(spark):
    from retrospark.config import ModelConfig
    from retrospark.operators import model as MO

    cfg = ModelConfig(entity="patient_id", label="stroke", cv_strategy="stratified", max_folds=2)
    rows = [(f"P{i}", i % 2, float(i % 2) + i / 100) for i in range(40)]
    preds, res = MO.train_predict_cv(spark.createDataFrame(rows, "patient_id string, stroke int, x double"), "m", cfg)
    assert {r.patient_id for r in preds.collect()} == {f"P{i}" for i in range(40)}
    assert res["class_weight"] == "balanced" and res["patient_overlap_detected"] is False
    bare = spark.createDataFrame([(i, i % 2, "x") for i in range(10)], "patient_id long, stroke int, note string")
    preds, res = MO.train_predict_cv(bare, "m", cfg)
    assert preds.count() == 0 and res["skip_reason"] == "not_run_no_numeric_features"


def test_intercept_is_penalised(spark):
    import numpy as np

    from retrospark.config import ModelConfig
    from retrospark.operators import foldfit as FF

    rng = np.random.default_rng(3)
    n = 200
    x = rng.normal(size=(n, 2)) + 0.7
    y = (x @ np.array([1.0, -2.0]) + rng.normal(size=n) > 0.8).astype(float)
    pos, neg = int(y.sum()), int(n - y.sum())
    w = np.where(y == 1, n / (2.0 * pos), n / (2.0 * neg)) / n
    a = np.column_stack([x, np.ones(n)])
    beta = np.zeros(3)
    for _ in range(60):  # Newton steps on the weighted loss with a penalty on all three coefficients
        p = 1 / (1 + np.exp(-a @ beta))
        beta -= np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + np.eye(3) / n, a.T @ (w * (p - y)) + beta / n)
    df = spark.createDataFrame([(i, float(r[0]), float(r[1]), int(t), 0) for i, (r, t) in enumerate(zip(x, y, strict=True))], "patient_id long, a double, b double, stroke int, fold int")
    units = FF.Units(("a", "b"), np.zeros(2), np.ones(2))
    model = FF.Model("m", -1, np.eye(5)[:, :3], (n / (2.0 * neg), n / (2.0 * pos)), np.zeros(3))
    FF.fit(df, units, [model], ModelConfig(entity="patient_id", label="stroke"))
    assert np.allclose(model.coef, beta[[2, 0, 1]], atol=1e-8)
