"""End-to-end run (ORC1-ORC4): audit -> cohort -> cleaning -> EDA -> features [-> models -> validation].

Everything is one lazy plan until a table is written.  Three tables are reused by many
outputs and are materialised once: the prepared (deduplicated) records, the cleaned
long-format records and the entity-level feature aggregate.  When ``output_root`` is given each stage's tables are
written there (Parquet) and the next stage reads them back, so lineage is cut at stage
boundaries on shared storage (an executor loss re-runs one stage, not the whole chain), and a ledger
of finished stages lets a run that was cut off go on (:mod:`ledger`).
Without an output root, lineage is cut with ``checkpoint()`` into the session's
``spark.checkpoint.dir``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ANOVA_K_GRID, FEATURE_TARGET_COUNTS, PCA_N_GRID, WINDOWS, CleanSchema, CohortConfig, EvalConfig, FeatureConfig, ModelConfig, RawSchema
from ..operators import audit as AU
from ..operators import cleaning as CL
from ..operators import cohort as C
from ..operators import evaluate as EV
from ..operators import explore as EX
from ..operators import features as FE
from ..operators import model as MO
from ..operators import select as SE
from ..session import ensure_checkpoint_dir
from ..sources.files import write_table
from .ledger import RunLedger

STAGES = [
    ("01", "raw_data_output"),
    ("02", "target_cohort_output"),
    ("03", "data_cleaning_output"),
    ("04", "eda_output"),
    ("05", "feature_engineering_output"),
    ("06", "model_output"),
    ("07", "feature_importance_output"),
    ("08", "validation_output"),
]
PRIMARY_METRICS = ["sensitivity", "specificity", "g_mean", "roc_auc", "pr_auc", "mcnemar"]
GUARDRAILS = [
    "index event date or last visit date is the reference date",
    "records after the reference date are removed (visit_date <= reference_date)",
    "windows are look-back only and overlapping (FIRST/MID/LAST)",
    "folds are assigned per entity",
    "imputation and scaling are fitted inside each training fold",
]


@dataclass(frozen=True)
class PipelineConfig:
    raw: RawSchema = field(default_factory=RawSchema)
    clean: CleanSchema = field(default_factory=CleanSchema)
    model: ModelConfig = field(default_factory=lambda: ModelConfig(entity="patient_id", label="stroke", cv_strategy="auto"))
    eval: EvalConfig = field(default_factory=EvalConfig)
    output_root: str | None = None
    skip_modeling: bool = True
    importance: bool = True  # stage 07, when models are run
    anova_k: tuple[int, ...] = tuple(ANOVA_K_GRID)
    pca_n: tuple[int, ...] = tuple(PCA_N_GRID)


def stage_dirs(root: str) -> dict[str, str]:
    """ORC4: output folder per stage."""
    return {name: f"{root.rstrip('/')}/{name}" for _, name in STAGES}


def run_contract(spark: SparkSession, cfg: PipelineConfig) -> DataFrame:
    """ORC2: the run contract (windows, feature sets, metrics, guardrails, stage outputs) as rows."""
    rows = [("temporal_window", n, f"{int(hi)}-{int(lo)} months before reference date, inclusive") for n, (hi, lo) in WINDOWS.items()]
    rows += [("feature_set", k, f"{v} features") for k, v in FEATURE_TARGET_COUNTS.items()]
    rows += [("feature_set", "single_shot", "latest record inside the windows")]
    rows += [("primary_metric", m, "") for m in PRIMARY_METRICS]
    rows += [("leakage_guardrail", f"g{i}", g) for i, g in enumerate(GUARDRAILS, 1)]
    if cfg.output_root:
        rows += [("stage_output", s, p) for s, p in stage_dirs(cfg.output_root).items()]
    return spark.createDataFrame(rows, "kind string, name string, detail string")


def _cut(df: DataFrame, path: str | None, spark: SparkSession) -> DataFrame:
    """Materialise a reused table: written to shared storage when a root is given, else checkpointed."""
    if path:
        write_table(df, path)
        return spark.read.parquet(path)
    ensure_checkpoint_dir(spark)
    return df.checkpoint()


def pipeline_acceptance(
    checks: dict[str, DataFrame],
    facts: DataFrame,
    attrition: DataFrame,
    single_shot: DataFrame,
    guards: DataFrame,
    metrics: DataFrame | None,
    mcnemar: DataFrame | None,
) -> DataFrame:
    """ORC3: union of every stage's checks plus the run-level checks, each derived from the run's tables.

    ``guards``: rows (source, ok) of the leakage evidence of stages 02, 03, 04 and 05.  Without
    modelling the metric checks look at what the evaluation operators offer.
    """
    out = None
    for stage, df in checks.items():
        part = df.select(F.lit(stage).alias("stage"), "check", "passed", "detail")
        out = part if out is None else out.unionByName(part)
    spark = facts.sparkSession
    raw = attrition.agg(F.coalesce(F.max(F.when(F.col("step") == "raw_input", F.col("records_remaining"))), F.lit(0)).alias("n"))
    names = sorted(WINDOWS)
    windows = facts.select("observed_windows")
    shots = single_shot.agg(F.count(F.lit(1)).alias("n"))
    leak = guards.agg(F.coalesce(F.bool_and("ok"), F.lit(False)).alias("ok"), F.array_join(F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("source")))), ",").alias("bad"))
    offered = set(metrics.columns) if metrics is not None else set(EV.metrics_table(MO.empty_predictions(spark, "bigint")).columns)
    lacking = [m for m in PRIMARY_METRICS if m != "mcnemar" and m not in offered]
    row = lambda name, df, ok, detail: df.select(F.lit("00").alias("stage"), F.lit(name).alias("check"), ok.alias("passed"), detail.cast("string").alias("detail"))
    one = spark.range(1)
    if mcnemar is not None:
        tests = row("mcnemar_validation_supported", mcnemar.agg(F.count(F.lit(1)).alias("n")), F.col("n") > 0, F.concat(F.lit("rows="), F.col("n").cast("string")))
    else:
        tests = row("mcnemar_validation_supported", one, F.lit(callable(getattr(EV, "mcnemar_vs_best", None))), F.lit("models not run"))
    for part in (
        row("raw_input_exists", raw, F.col("n") > 0, F.concat(F.lit("records="), F.col("n").cast("string"))),
        row("paper_default_temporal_windows_registered", windows, F.array_sort("observed_windows") == F.array(*[F.lit(n) for n in names]), F.array_join("observed_windows", ",")),
        row("single_shot_baseline_available", shots, F.col("n") > 0, F.concat(F.lit("rows="), F.col("n").cast("string"))),
        row("primary_metrics_registered", one, F.lit(not lacking), F.lit("missing: " + ",".join(lacking) if lacking else ",".join(PRIMARY_METRICS))),
        tests,
        row("post_reference_leakage_guardrail", leak, F.col("ok"), F.when(F.col("ok"), F.lit("stages 02/03/04/05")).otherwise(F.concat(F.lit("failed: "), F.col("bad")))),
    ):
        out = out.unionByName(part)
    return out


def leakage_guards(facts: DataFrame, cleaning: DataFrame, eda: DataFrame, features: DataFrame) -> DataFrame:
    """(source, ok): what each stage found about records after the reference date."""
    flag = lambda df, name, col: df.agg(F.coalesce(F.bool_and(col), F.lit(False)).alias("ok")).select(F.lit(name).alias("source"), "ok")
    return (
        flag(facts, "02", F.col("no_post_reference_records"))
        .unionByName(flag(cleaning, "03", F.col("passed")))
        .unionByName(flag(eda, "04", F.col("passed")))
        .unionByName(flag(features, "05", F.col("pre_reference_only")))
    )


def run_pipeline(spark: SparkSession, raw: DataFrame, cfg: PipelineConfig = PipelineConfig()) -> dict[str, dict[str, DataFrame]]:
    """ORC1: every stage's tables; ``skip_modeling`` stops after features.

    With an ``output_root`` each stage is written and committed to the run's ledger, and the next one
    reads it back; a run that was cut off goes on after its last finished stage.
    """
    dirs = stage_dirs(cfg.output_root) if cfg.output_root else {}
    ledger = RunLedger(spark, cfg.output_root, cfg, raw.schema.json(), sorted(raw.inputFiles())) if cfg.output_root else None
    names, cohort_cfg = dict(STAGES), CohortConfig(schema=cfg.raw)
    out: dict[str, dict[str, DataFrame]] = {"00": {"run_contract": run_contract(spark, cfg)}}

    def stage(number: str, build, written: tuple[str, ...] = (), skip: tuple[str, ...] = ()) -> dict[str, DataFrame]:
        out[number] = ledger.run(number, build, dirs[names[number]], written, skip) if ledger else build()
        return out[number]

    def cohort() -> dict[str, DataFrame]:
        prepared = _cut(C.prepare_records(raw, cohort_cfg), dirs and f"{dirs['target_cohort_output']}/prepared_records", spark)
        return C.run_target_cohort(raw, cohort_cfg, prepared=prepared)

    def cleaning() -> dict[str, DataFrame]:
        path = dirs and f"{dirs['data_cleaning_output']}/cleaned_pre_reference_records"
        return CL.run_data_cleaning(st2["pre_reference_records_with_windows"], cfg.clean, write=lambda df: _cut(df, path, spark))

    st1 = stage("01", lambda: AU.run_raw_data_audit(raw, cfg.raw))
    st2 = stage("02", cohort, skip=("prepared",))
    st3 = stage("03", cleaning, written=("cleaned_pre_reference_records",))
    cleaned = st3["cleaned_pre_reference_records"]
    st4 = stage("04", lambda: EX.run_eda(cleaned, st2["patient_level_cohort"], st2["temporal_completeness_flags"], st2["cohort_attrition_report"], cfg.clean, cfg.raw.entity))
    st5 = stage("05", lambda: FE.run_feature_engineering(cleaned, FeatureConfig(schema=cfg.clean), persist=True), skip=("entity_aggregate",))
    checks = {
        "01": st1["raw_acceptance_checks"],
        "02": st2["target_cohort_acceptance_checks"],
        "03": st3["cleaning_acceptance_checks"],
        "04": st4["eda_acceptance_checks"],
        "05": st5["feature_acceptance_checks"],
    }
    metrics = mcnemar = None
    if not cfg.skip_modeling:
        tables = {k: st5[k] for k in ("single_shot", "extract_set_1", "extract_set_2", "extract_set_3")}

        def models() -> dict[str, DataFrame]:
            made = MO.run_modeling(tables, cfg.model)
            path = dirs and f"{dirs['model_output']}/all_model_predictions"
            return {**made, "all_model_predictions": _cut(made["all_model_predictions"], path, spark)}

        st6 = stage("06", models, written=("all_model_predictions",))
        checks["06"] = st6["modeling_acceptance_checks"]
        if cfg.importance:
            stage("07", lambda: SE.run_feature_importance({k: v for k, v in tables.items() if k != "single_shot"}, cfg.model, cfg.anova_k, cfg.pca_n))
        grid = out.get("07", {}).get("performance_grid")
        st8 = stage("08", lambda: EV.run_validation(st6["all_model_predictions"], st2["cohort_attrition_report"], st4["leakage_audit"], grid, cfg.eval))
        metrics, mcnemar = st8["validation_metrics"], st8["mcnemar_test_report"]
    guards = leakage_guards(st2["target_cohort_summary"], st3["leakage_audit_report"], st4["leakage_audit"], st5["generation_log"])
    out["00"]["pipeline_acceptance"] = pipeline_acceptance(
        checks, st2["target_cohort_summary"], st2["cohort_attrition_report"], st5["single_shot"], guards, metrics, mcnemar
    )
    if ledger:
        rows = [(n, n in ledger.reused) for n in out if n != "00"]
        out["00"]["run_ledger"] = spark.createDataFrame(rows, "stage string, taken_from_an_earlier_run boolean")
    return out
