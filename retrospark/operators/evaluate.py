"""Stages 06/08 evaluation on any prediction table (model_name, entity, truth, prediction, score).

Every model is evaluated in the same job: ``groupBy(model_name)`` for the confusion
matrix, and a shared ranking step for the exact ROC-AUC (ties averaged) and the step-wise
average precision.

Ranking without a global sort or an unpartitioned window: scores are first collapsed to
distinct values per model (map-side combine), then cut into equi-depth buckets by
approximate quantiles of the distinct values.  Cumulative class counts are a small
window over (model, bucket) totals plus a window inside each bucket; both are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EvalConfig
from ..functions.profile import in_parts, scalar_row
from ..functions.stats import erfc, g_mean
from ..session import ensure_checkpoint_dir

RANK_BUCKETS = 256


def score_table(preds: DataFrame, cfg: EvalConfig = EvalConfig()) -> DataFrame:
    """Distinct scores per model with positive / negative counts."""
    y = F.col(cfg.truth).cast("int")
    return preds.where(F.col(cfg.prob).isNotNull()).groupBy(cfg.model, F.col(cfg.prob).cast("double").alias("score")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")
    )


def cumulative_below(dist: DataFrame, by: list[str], buckets: int = RANK_BUCKETS) -> DataFrame:
    """Add ``pos_below``/``neg_below``: class counts at strictly lower scores within ``by``."""
    qs = [i / buckets for i in range(1, buckets)]
    # kept: approximate boundaries depend on the order in which parts are merged; totals and rows need the same ones
    ensure_checkpoint_dir(dist.sparkSession)
    bounds = dist.groupBy(*by).agg(F.percentile_approx("score", qs, 10000).alias("__b")).checkpoint()
    d = in_parts(dist, bounds, by, "score", buckets)  # a row a model
    bt = d.groupBy(*by, "__bk").agg(F.sum("pos").alias("__bp"), F.sum("neg").alias("__bn"))
    wb = Window.partitionBy(*by).orderBy("__bk").rowsBetween(Window.unboundedPreceding, -1)
    bt = bt.select(*by, "__bk", F.coalesce(F.sum("__bp").over(wb), F.lit(0)).alias("__pb"), F.coalesce(F.sum("__bn").over(wb), F.lit(0)).alias("__nb"))
    wi = Window.partitionBy(*by, "__bk").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({"__pi": F.coalesce(F.sum("pos").over(wi), F.lit(0)), "__ni": F.coalesce(F.sum("neg").over(wi), F.lit(0))})
    d = d.join(F.broadcast(bt), on=[*by, "__bk"])  # ``buckets`` rows a model
    return d.select(*by, "score", "pos", "neg", (F.col("__pb") + F.col("__pi")).alias("pos_below"), (F.col("__nb") + F.col("__ni")).alias("neg_below"))


def ranking_metrics(preds: DataFrame, cfg: EvalConfig = EvalConfig(), buckets: int = RANK_BUCKETS) -> DataFrame:
    """Per model exact ROC-AUC (Mann-Whitney, ties count one half) and average precision.

    AP = sum over distinct thresholds t (descending) of (positives at t / P) * precision(score >= t).
    Both are null unless the model has positives and negatives.
    """
    ranked = cumulative_below(score_table(preds, cfg), [cfg.model], buckets)
    tot = ranked.groupBy(cfg.model).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    r = ranked.join(F.broadcast(tot), on=cfg.model)
    tp = F.col("P") - F.col("pos_below")
    fp = F.col("N") - F.col("neg_below")
    agg = r.groupBy(cfg.model).agg(
        F.first("P").alias("P"),
        F.first("N").alias("N"),
        F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg"))).alias("__u"),
        F.sum(F.when(F.col("pos") > 0, F.col("pos") * tp / (tp + fp))).alias("__ap"),
    )
    ok = (F.col("P") > 0) & (F.col("N") > 0)
    return agg.select(
        cfg.model,
        F.when(ok, F.col("__u") / (F.col("P") * F.col("N"))).alias("roc_auc"),
        F.when(ok, F.col("__ap") / F.col("P")).alias("pr_auc"),
    )


def confusion_metrics(preds: DataFrame, cfg: EvalConfig = EvalConfig()) -> DataFrame:
    """MOD9: tn, fp, fn, tp, sensitivity, specificity, G-Mean per model (one aggregate)."""
    y, p = F.col(cfg.truth).cast("int"), F.col(cfg.pred).cast("int")
    g = preds.groupBy(cfg.model).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )
    sens = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(F.lit(0.0))
    spec = F.when(F.col("tn") + F.col("fp") > 0, F.col("tn") / (F.col("tn") + F.col("fp"))).otherwise(F.lit(0.0))
    return g.withColumns({"sensitivity": sens, "specificity": spec}).withColumn("g_mean", g_mean(F.col("sensitivity"), F.col("specificity")))


def metrics_table(preds: DataFrame, cfg: EvalConfig = EvalConfig()) -> DataFrame:
    """VAL1 / MOD9-11: confusion metrics and ranking metrics for every model."""
    return confusion_metrics(preds, cfg).join(ranking_metrics(preds, cfg), on=cfg.model, how="left")


def ranked(metrics: DataFrame) -> DataFrame:
    """MOD14: models by G-Mean descending, nulls last."""
    return metrics.orderBy(F.desc_nulls_last("g_mean"), "model_name")


def confusion_table(metrics: DataFrame, cfg: EvalConfig = EvalConfig()) -> DataFrame:
    """VAL2."""
    return metrics.select(cfg.model, "tn", "fp", "fn", "tp")


def roc_pr_table(metrics: DataFrame, cfg: EvalConfig = EvalConfig()) -> DataFrame:
    """VAL3."""
    return metrics.select(cfg.model, "roc_auc", "pr_auc")


def best_temporal_model(metrics: DataFrame, cfg: EvalConfig = EvalConfig()) -> DataFrame:
    """VAL4: best non-baseline model by G-Mean (ties: smaller name); null when none."""
    return metrics.where(F.col(cfg.model) != cfg.baseline).agg(
        F.min_by(cfg.model, F.struct(-F.coalesce(F.col("g_mean"), F.lit(-1.0)), F.col(cfg.model))).alias("best_temporal_model")
    )


def baseline_vs_temporal(metrics: DataFrame, cfg: EvalConfig = EvalConfig()) -> DataFrame:
    """VAL5: metrics tagged baseline / temporal."""
    return metrics.withColumn("model_group", F.when(F.col(cfg.model) == cfg.baseline, F.lit("baseline")).otherwise(F.lit("temporal")))


def mcnemar_pairs(base: DataFrame, chal: DataFrame, cfg: EvalConfig = EvalConfig()) -> DataFrame:
    """VAL6: McNemar on paired predictions (inner join on entity AND truth).

    chi2 = (|b - c| - 1)^2 / (b + c) without clamping; p = erfc(sqrt(chi2 / 2)).
    No overlap -> skipped; b + c = 0 -> skipped with chi2 0 and p 1.
    """
    e, y, p = cfg.entity, cfg.truth, cfg.pred
    a = base.select(e, y, F.col(p).cast("int").alias("__bp"))
    b = chal.select(e, y, F.col(p).cast("int").alias("__cp"))
    m = a.join(b, on=[e, y], how="inner")
    yy = F.col(y).cast("int")
    agg = m.agg(
        F.count(F.lit(1)).alias("overlap_patients"),
        F.count_if((F.col("__bp") == yy) & (F.col("__cp") != yy)).alias("b_baseline_correct_challenger_wrong"),
        F.count_if((F.col("__bp") != yy) & (F.col("__cp") == yy)).alias("c_baseline_wrong_challenger_correct"),
    )
    bb, cc, n = F.col("b_baseline_correct_challenger_wrong"), F.col("c_baseline_wrong_challenger_correct"), F.col("overlap_patients")
    tot = bb + cc
    chi = F.pow(F.abs(bb - cc) - 1.0, 2) / tot
    status = F.when(n == 0, F.lit("skipped")).when(tot == 0, F.lit("skipped")).otherwise(F.lit("completed"))
    reason = F.when(n == 0, F.lit("no_overlap_patients_between_models")).when(tot == 0, F.lit("no_disagreement")).otherwise(F.lit(""))
    chi_sq = F.when(n == 0, F.lit(None).cast("double")).when(tot == 0, F.lit(0.0)).otherwise(chi)
    pval = F.when(n == 0, F.lit(None).cast("double")).when(tot == 0, F.lit(1.0)).otherwise(erfc(F.sqrt(F.greatest(chi, F.lit(0.0)) / 2.0)))
    return agg.select(
        status.alias("status"), reason.alias("reason"), "overlap_patients", "b_baseline_correct_challenger_wrong",
        "c_baseline_wrong_challenger_correct", chi_sq.alias("chi_square"), pval.alias("p_value"),
    )


def mcnemar(preds: DataFrame, baseline: str, challenger: str, cfg: EvalConfig = EvalConfig()) -> DataFrame:
    """McNemar between two named models of one prediction table."""
    out = mcnemar_pairs(preds.where(F.col(cfg.model) == baseline), preds.where(F.col(cfg.model) == challenger), cfg)
    return out.withColumns({"baseline_model": F.lit(baseline), "challenger_model": F.lit(challenger)})


def mcnemar_vs_best(preds: DataFrame, metrics: DataFrame, cfg: EvalConfig = EvalConfig()) -> DataFrame:
    """McNemar of the baseline against the best temporal model, chosen inside the plan."""
    best = best_temporal_model(metrics, cfg)
    chal = preds.join(best, F.col(cfg.model) == F.col("best_temporal_model"), "left_semi")
    out = mcnemar_pairs(preds.where(F.col(cfg.model) == cfg.baseline), chal, cfg)
    return scalar_row(out, best.select(F.col("best_temporal_model").alias("challenger_model"))).withColumn("baseline_model", F.lit(cfg.baseline))


def skipped_models(results: DataFrame) -> DataFrame:
    """MOD12: models that were not run, with reasons."""
    return results.where(F.col("status") == "skipped").select(
        "model_name", "skip_reason", "n_patients", "n_features", "target_positive_count", "target_negative_count", "cv_strategy"
    )


def cv_policy_report(results: DataFrame, paper: str = "LOOCV") -> DataFrame:
    """MOD13: actual vs published CV strategy per model."""
    exact = F.col("cv_strategy") == paper
    return results.select(
        "model_name", F.lit(paper).alias("paper_cv_strategy"), F.col("cv_strategy").alias("actual_cv_strategy"),
        F.coalesce(exact, F.lit(False)).alias("paper_cv_exact_match"),
        F.when(exact, F.lit("")).otherwise(F.lit("requested non-LOOCV strategy or auto fallback due to runtime/class constraints")).alias("fallback_reason"),
        "n_patients", "target_positive_count", "target_negative_count",
    )


def leakage_evidence(eda_leakage: DataFrame | None, importance: DataFrame | None) -> DataFrame:
    """VAL7: leakage evidence from the EDA audit and from the importance stage's results.

    ``importance``: the performance grid, whose rows are scores of folds that selected features and
    components on their training part; without rows there is no such evidence.  A missing audit
    fails its check.
    """
    spark = SparkSession.active()
    if eda_leakage is None:
        audit = spark.range(1).select(F.lit(False).alias("ok"), F.lit("leakage_audit_not_found").alias("why"))
    else:
        n = F.coalesce(F.sum("failed_record_count"), F.lit(0))
        audit = eda_leakage.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("ok"), F.concat(F.lit("failed_record_count="), n.cast("string")).alias("why"))
    rows = importance.agg(F.count(F.lit(1)).alias("n")) if importance is not None else spark.range(1).select(F.lit(0).alias("n"))
    grid = rows.select((F.col("n") > 0).alias("ok"), F.when(F.col("n") > 0, F.concat(F.lit("candidates="), F.col("n").cast("string"))).otherwise(F.lit("feature importance outputs not found")).alias("why"))
    part = lambda df, name: df.select(F.lit(name).alias("check"), F.col("ok").alias("passed"), F.col("why").alias("detail"))
    return part(audit, "eda_no_post_reference_records").unionByName(part(grid, "feature_selection_and_pca_fold_local_fit"))


def attrition_view(attrition: DataFrame | None, spark=None) -> DataFrame:
    """VAL8: the cohort attrition table, or a one-row placeholder when it is missing."""
    if attrition is not None:
        return attrition
    return spark.createDataFrame([("missing", "cohort_attrition_report_not_found")], "step string, reason string")


def run_validation(preds: DataFrame, attrition: DataFrame | None = None, eda_leakage: DataFrame | None = None,
                   importance: DataFrame | None = None, cfg: EvalConfig = EvalConfig()) -> dict[str, DataFrame]:
    """VAL9: every validation table from one prediction table (all models in the same jobs)."""
    spark = preds.sparkSession
    metrics = metrics_table(preds, cfg)
    out = {
        "validation_metrics": ranked(metrics),
        "validation_confusion_matrices": confusion_table(metrics, cfg),
        "roc_pr_auc_table": roc_pr_table(metrics, cfg),
        "baseline_vs_temporal_comparison": baseline_vs_temporal(metrics, cfg),
        "best_temporal_model": best_temporal_model(metrics, cfg),
        "mcnemar_test_report": mcnemar_vs_best(preds, metrics, cfg),
        "cohort_attrition_validation_view": attrition_view(attrition, spark),
    }
    out["leakage_audit_report"] = leakage_evidence(eda_leakage, importance)
    return out
