"""Stage 06 modelling: balanced L2 logistic regression with entity-level CV, out-of-fold scores.

Per fold: impute (fold-local median) -> standardise (fold-local mean / population std)
-> class-balanced logistic regression.  All folds are prepared and fitted together
(:mod:`foldfit`); rows are scored by the models of their own fold in one expression.

Minimised is sum(s_i * loss_i) + |w|^2 / (2 C), C = ``reg_scale``, with balanced weights s_i =
n_train / (2 n_class); the intercept is penalised like a weight, as the reference solver does.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..config import ModelConfig
from . import foldfit as FF
from .folds import CvPolicy, assign_folds, choose_cv, feature_columns, feature_matrix, overlap_guard


def empty_predictions(spark, id_type: str) -> DataFrame:
    return spark.createDataFrame([], f"patient_id {id_type}, model_name string, fold int, y_true int, y_pred int, y_prob double")


def fit_cv(folded: DataFrame, features: list[str], name: str, policy: CvPolicy, cfg: ModelConfig = ModelConfig()) -> tuple[DataFrame, bool]:
    """MOD5-MOD7 for all folds: (model table, whether both classes weigh the same in every training set)."""
    if policy.strategy == "LOOCV":
        _, models, _ = FF.loo_models(folded, features, name, cfg, policy.positives, policy.negatives)
        return models, True  # by construction: n / (2 n_class) of each training set
    units, trains = FF.prepare(folded, features, policy.folds, cfg)
    models = [FF.model(name, t, t.ranking(units.features)) for t in trains]
    FF.fit(folded, units, models, cfg)
    balanced = all(abs(m.weight[0] * t.negatives - m.weight[1] * t.positives) < 1e-9 * policy.n_rows for m, t in zip(models, trains, strict=True))
    return FF.model_table(folded.sparkSession, units, models), balanced


def train_predict_cv(table: DataFrame, name: str, cfg: ModelConfig = ModelConfig(), policy: CvPolicy | None = None) -> tuple[DataFrame, dict]:
    """MOD8: out-of-fold predictions for one feature table plus a result record."""
    spark = table.sparkSession
    ensure_checkpoint_dir(spark)
    mat = feature_matrix(table, cfg).checkpoint()  # one row per entity; read by the policy, the ranks and every step
    feats = feature_columns(mat, cfg)
    policy = policy or choose_cv(mat, cfg)
    if not feats and not policy.skip_reason:
        policy = replace(policy, strategy="", folds=0, skip_reason="not_run_no_numeric_features")
    id_type = dict(mat.dtypes)[cfg.entity]
    result = {
        "patient_overlap_detected": False, "class_weight": "", "model_name": name, "status": "skipped" if policy.skip_reason else "completed", "skip_reason": policy.skip_reason,
        "n_patients": policy.n_rows, "n_features": len(feats), "target_positive_count": policy.positives,
        "target_negative_count": policy.negatives, "cv_strategy": policy.strategy or "not_run",
    }
    if policy.skip_reason:
        return empty_predictions(spark, id_type), result
    folded = assign_folds(mat, policy, cfg).checkpoint()  # lineage cut in the shared checkpoint folder
    result["patient_overlap_detected"] = overlap_guard(folded, cfg).limit(1).count() > 0
    models, weighted = fit_cv(folded, feats, name, policy, cfg)
    result["class_weight"] = "balanced" if weighted else "unbalanced"
    return FF.score(folded, models, feats, cfg), result


RESULT_DDL = "model_name string, status string, skip_reason string, n_patients bigint, n_features bigint, target_positive_count bigint, target_negative_count bigint, cv_strategy string"
RUN_DDL = RESULT_DDL + ", patient_overlap_detected boolean, class_weight string"


def policy_results(tables: dict[str, DataFrame], cfg: ModelConfig = ModelConfig()) -> DataFrame:
    """Per feature table: CV decision, status and class counts, before any fit (feeds MOD12/MOD13)."""
    rows = []
    for name, t in tables.items():
        mat = feature_matrix(t, cfg)
        pol = choose_cv(mat, cfg)
        rows.append((name, "skipped" if pol.skip_reason else "completed", pol.skip_reason, pol.n_rows, len(feature_columns(mat, cfg)),
                     pol.positives, pol.negatives, pol.strategy or "not_run"))
    return next(iter(tables.values())).sparkSession.createDataFrame(rows, RESULT_DDL)


def run_modeling(tables: dict[str, DataFrame], cfg: ModelConfig = ModelConfig()) -> dict[str, DataFrame]:
    """MOD16: CV for each feature table, union of predictions, metrics, reports."""
    from . import evaluate as EV

    if "single_shot" not in tables:
        raise KeyError("baseline feature table 'single_shot' is required")
    spark = next(iter(tables.values())).sparkSession
    preds, results = [], []
    for name, t in tables.items():
        p, r = train_predict_cv(t, name, cfg)
        preds.append(p)
        results.append(r)
    allp = preds[0]
    for p in preds[1:]:
        allp = allp.unionByName(p)
    fields = [f.split()[0] for f in RUN_DDL.split(", ")]
    res = spark.createDataFrame([tuple(r[f] for f in fields) for r in results], RUN_DDL)
    metrics = res.join(EV.metrics_table(allp), on="model_name", how="left")
    return {
        "all_model_predictions": allp,
        "model_results": res,
        "model_metrics": EV.ranked(metrics),
        "skipped_model_report": EV.skipped_models(res),
        "cv_policy_report": EV.cv_policy_report(res),
        "modeling_acceptance_checks": modeling_acceptance(res, metrics),
    }


def modeling_acceptance(results: DataFrame, metrics: DataFrame) -> DataFrame:
    """MOD15: the seven acceptance checks of the modelling stage."""
    from ..functions.profile import scalar_row

    r = results.agg(
        F.max(F.col("model_name") == "single_shot").alias("baseline"),
        F.coalesce(F.bool_and(F.when(F.col("status") == "skipped", F.col("skip_reason") != "")), F.lit(True)).alias("skips_ok"),
        F.count_if(F.col("status") == "completed").alias("done"),
        F.coalesce(F.bool_or("patient_overlap_detected"), F.lit(False)).alias("overlap"),
        F.coalesce(F.bool_and(F.when(F.col("status") == "completed", F.col("class_weight") == "balanced")), F.lit(True)).alias("balanced"),
    )
    m = metrics.agg(F.bool_and(F.when(F.col("status") == "completed", F.col("g_mean").isNotNull() & F.col("sensitivity").isNotNull())).alias("metrics_ok"))
    row = scalar_row(r, m)
    checks = [
        ("single_shot_baseline_attempted", F.col("baseline"), F.lit("single_shot")),
        ("skipped_temporal_models_reported_with_reason", F.col("skips_ok"), F.lit("skip_reason filled")),
        ("train_test_patient_overlap_prevented", ~F.col("overlap"), F.lit("no entity in two folds")),
        ("required_metrics_reported", F.coalesce(F.col("metrics_ok"), F.lit(True)), F.lit("sensitivity, specificity, g_mean, roc_auc, pr_auc")),
        ("best_model_selected_by_g_mean", F.col("done") > 0, F.concat(F.lit("completed_models="), F.col("done").cast("string"))),
        ("prediction_files_available_for_validation", F.col("done") > 0, F.lit("all_model_predictions")),
        ("logistic_regression_balanced_used", F.col("balanced"), F.lit("weightCol = n / (2 n_class)")),
    ]
    structs = [
        F.struct(F.lit(i).alias("check_order"), F.lit(n).alias("check"), F.coalesce(p, F.lit(False)).alias("passed"), d.cast("string").alias("detail"))
        for i, (n, p, d) in enumerate(checks, start=1)
    ]
    return row.select(F.explode(F.array(*structs)).alias("c")).select("c.*")
