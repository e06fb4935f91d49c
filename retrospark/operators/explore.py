"""Stage 04: exploratory analysis of the cleaned long-format records.

All summaries are aggregates.  Exact quantiles come from :func:`exact_quantiles` (distinct
values bucketed and ranked in parallel), never ``approx_percentile`` and never one buffer
holding a whole group.  The visit-gap summary never
sorts an entity's rows: it first collapses records to (entity, day) counts -- a bounded
number of days per entity -- and derives the gap multiset with frequencies from that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EDA_NUMERIC, HIGH_MISSING_THRESHOLD, MIN_COMPLETE_POSITIVES_FOR_MODELLING, CleanSchema
from ..functions.codes import q
from ..functions.dates import days_between
from ..functions.profile import exact_quantiles, missing_summary, scalar_row, stack_metrics
from ..session import ensure_checkpoint_dir

WINDOW_NAMES = ["FIRST", "MID", "LAST"]


def class_imbalance(cohort: DataFrame, label: str = "stroke") -> DataFrame:
    """EDA1: entities per label value with share of all entities."""
    counts = cohort.groupBy(label).agg(F.count(F.lit(1)).alias("patient_count"))
    total = cohort.agg(F.count(F.lit(1)).alias("__total"))
    name = F.when(F.col(label) == 0, F.lit("non_stroke")).when(F.col(label) == 1, F.lit("stroke")).otherwise(F.lit("missing"))
    return scalar_row(counts, total).select(label, name.alias("label"), "patient_count", (F.col("patient_count") / F.col("__total")).alias("percent"))


def visit_frequency(records: DataFrame, schema: CleanSchema = CleanSchema(), dedupe_source: bool = False) -> DataFrame:
    """EDA2: per entity visit count, first/last date, follow-up days.

    Default counts long-format rows (overlapping windows count several times, as the
    reference does); ``dedupe_source=True`` counts distinct source records instead.
    """
    e, d = schema.entity, schema.date
    cnt = F.count_distinct(schema.record_id) if dedupe_source else F.count(F.lit(1))
    g = records.groupBy(e).agg(cnt.alias("visit_count"), F.min(d).alias("first_visit_date"), F.max(d).alias("last_visit_date"))
    return g.withColumn("followup_days", days_between(F.col("last_visit_date"), F.col("first_visit_date")))


def visit_distribution(freq: DataFrame) -> DataFrame:
    """EDA3: n, mean, median, min, max, p25, p75 of visits per entity (exact quantiles)."""
    # entities by number of visits, kept: the table of entities is read once
    ensure_checkpoint_dir(freq.sparkSession)
    counts = freq.groupBy("visit_count").agg(F.count(F.lit(1)).alias("__n")).checkpoint()
    v, n = F.col("visit_count"), F.col("__n")
    base = counts.agg(
        F.coalesce(F.sum(n), F.lit(0).cast("bigint")).alias("patients"),
        F.coalesce(F.sum(v.cast("double") * n) / F.sum(F.when(v.isNotNull(), n)), F.lit(0.0)).alias("mean_visits"),
        F.coalesce(F.min(v), F.lit(0)).alias("min_visits"),
        F.coalesce(F.max(v), F.lit(0)).alias("max_visits"),
    )
    quart = exact_quantiles(counts, [], "visit_count", [0.25, 0.5, 0.75], weight="__n")
    # both sides hold at most one row; an empty input keeps the one-row summary with zeros
    row = base.join(quart, on=F.lit(True), how="left")
    return row.select(
        "patients", "mean_visits",
        F.coalesce(F.col("q1"), F.lit(0.0)).alias("median_visits"),
        "min_visits", "max_visits",
        F.coalesce(F.col("q0"), F.lit(0.0)).alias("p25_visits"),
        F.coalesce(F.col("q2"), F.lit(0.0)).alias("p75_visits"),
    )


def window_visit_counts(records: DataFrame, schema: CleanSchema = CleanSchema()) -> DataFrame:
    """EDA4: rows per (window, entity) for rows inside a window."""
    return records.where(q(schema.window).isNotNull()).groupBy(schema.window, schema.entity).agg(F.count(F.lit(1)).alias("visit_count"))


def visit_gaps(records: DataFrame, schema: CleanSchema = CleanSchema()) -> DataFrame:
    """Gap multiset between consecutive visits of each entity as (gap_days, frequency).

    Equal dates give zero gaps; distinct consecutive dates give their difference.  The
    only window function runs over (entity, distinct day) rows, bounded by the calendar.
    """
    e, d = schema.entity, schema.date
    per_day = records.groupBy(e, d).agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy(e).orderBy(d)
    steps = per_day.withColumn("__prev", F.lag(d).over(w))
    gap = lambda days, freq: F.struct(days.cast("bigint").alias("gap_days"), freq.cast("bigint").alias("freq"))
    both = F.array(gap(F.lit(0), F.col("m") - 1), gap(days_between(F.col(d), F.col("__prev")), F.lit(1)))
    return steps.select(F.explode(both).alias("g")).select("g.*").where(F.col("gap_days").isNotNull() & (F.col("freq") > 0))


def time_gap_summary(records: DataFrame, schema: CleanSchema = CleanSchema()) -> DataFrame:
    """EDA5: count, mean, median, p25, p75, max of days between consecutive visits."""
    g = visit_gaps(records, schema)
    # one pass: count, mean and max come with the quantiles from the collapsed gap table
    quart = exact_quantiles(g, [], "gap_days", [0.25, 0.5, 0.75], weight="freq")
    return quart.where(F.col("n") > 0).select(
        F.col("n").cast("bigint").alias("gap_count"), F.col("q_mean").alias("mean_days"),
        F.col("q1").alias("median_days"), F.col("q0").alias("p25_days"), F.col("q2").alias("p75_days"),
        F.col("q_max").cast("bigint").alias("max_days"),
    )


def missingness_by_variable(records: DataFrame) -> DataFrame:
    """EDA6: missing count/share per column (one aggregate)."""
    return missing_summary(records)


def missingness_by_group(records: DataFrame, group: str, columns: list[str] = EDA_NUMERIC) -> DataFrame:
    """EDA7: per group value (null kept) and numeric column: rows, missing count and share."""
    present = [c for c in columns if c in records.columns]
    g = records.groupBy(group).agg(F.count(F.lit(1)).alias("records"), *[F.count_if(q(c).isNull()).alias(f"m{i}") for i, c in enumerate(present)])
    structs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_count")) for i, c in enumerate(present)])
    return g.select(group, "records", F.explode(structs).alias("s")).select(
        group, "s.column", "records", "s.missing_count", (F.col("s.missing_count") / F.col("records")).alias("missing_percent")
    )


def temporal_coverage(completeness: DataFrame, attrition: DataFrame | None = None) -> DataFrame:
    """EDA8: completeness coverage rows plus the final attrition step."""
    agg = completeness.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("temporal_complete").alias("complete"),
        *[F.count_if(f"{w.lower()}_has_visit").alias(w.lower()) for w in WINDOW_NAMES],
    )
    share = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(F.lit(0.0))
    rows = [
        F.struct(F.lit(1).alias("ordinal"), F.lit("patients_with_temporal_completeness_row").alias("metric"), F.col("n").alias("patient_count"), F.lit(1.0).alias("percent")),
        F.struct(F.lit(2).alias("ordinal"), F.lit("temporal_complete_patients").alias("metric"), F.col("complete").alias("patient_count"), share("complete").alias("percent")),
    ] + [
        F.struct(F.lit(3 + i).alias("ordinal"), F.lit(f"{w.lower()}_has_visit").alias("metric"), F.col(w.lower()).alias("patient_count"), share(w.lower()).alias("percent"))
        for i, w in enumerate(WINDOW_NAMES)
    ]
    out = agg.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    if attrition is None:
        return out
    last = attrition.agg(F.max_by(F.struct("step", "patients_remaining"), F.col("step_order")).alias("l"))
    tail = last.select(
        F.lit(3 + len(WINDOW_NAMES)).alias("ordinal"),
        F.concat(F.lit("attrition_final_step_"), F.col("l.step")).alias("metric"),
        F.col("l.patients_remaining").alias("patient_count"),
        F.lit(None).cast("double").alias("percent"),
    )
    return out.unionByName(tail)


def window_coverage_by_label(records: DataFrame, schema: CleanSchema = CleanSchema()) -> DataFrame:
    """EDA9: rows and entities per window (+ OUTSIDE_WINDOWS), overall and per label."""
    e, lab = schema.entity, schema.label
    key = F.coalesce(q(schema.window), F.lit("OUTSIDE_WINDOWS")).alias("window")
    stats = records.groupBy(key).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_distinct(e).alias("patients"),
        F.count_if(q(lab) == 0).alias("nonstroke_records"),
        F.count_distinct(F.when(q(lab) == 0, q(e))).alias("nonstroke_patients"),
        F.count_if(q(lab) == 1).alias("stroke_records"),
        F.count_distinct(F.when(q(lab) == 1, q(e))).alias("stroke_patients"),
    )
    names = WINDOW_NAMES + ["OUTSIDE_WINDOWS"]
    cat = records.sparkSession.createDataFrame(list(enumerate(names, 1)), "window_order int, window string")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return cat.join(stats, on="window", how="left").select(
        "window_order", "window", z("records"), z("patients"), z("nonstroke_records"), z("nonstroke_patients"), z("stroke_records"), z("stroke_patients")
    )


def complete_case_summary(cohort: DataFrame, completeness: DataFrame, entity: str, label: str = "stroke") -> DataFrame:
    """EDA10: all entities vs temporally complete entities (left-semi join), with prevalence."""
    ids = completeness.where("temporal_complete").select(entity)
    complete = cohort.join(ids, on=entity, how="left_semi")

    def summ(df: DataFrame, name: str) -> DataFrame:
        return df.agg(
            F.count(F.lit(1)).alias("patients"),
            F.count_if(F.col(label) == 1).alias("stroke_patients"),
            F.count_if(F.col(label) == 0).alias("nonstroke_patients"),
        ).select(
            F.lit(name).alias("group"), "patients", "stroke_patients", "nonstroke_patients",
            F.when(F.col("patients") > 0, F.col("stroke_patients") / F.col("patients")).otherwise(F.lit(0.0)).alias("stroke_prevalence"),
        )

    return summ(cohort, "all_patient_level_cohort").unionByName(summ(complete, "temporal_complete"))


def descriptive_stats(records: DataFrame, label: str = "stroke", columns: list[str] = EDA_NUMERIC) -> DataFrame:
    """EDA11: n, mean, std (ddof=1), min, quartiles, max per column, per label and overall.

    One unpivot, collapsed once; the table is scanned a single time.
    """
    present = [c for c in columns if c in records.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), q(c).try_cast("double").alias("value")) for c in present])
    long = records.select(q(label).alias("__label"), F.explode(pairs).alias("p")).select("__label", "p.column", "p.value").where(F.col("value").isNotNull())
    # collapse to (column, label, value, count) once; the "all" level re-groups that small table, and
    # moments, extremes and quartiles all come from the collapsed values
    dv = long.groupBy("column", F.col("__label").cast("string").alias("stroke"), "value").agg(F.count(F.lit(1)).alias("__n"))
    both = dv.unionByName(dv.groupBy("column", "value").agg(F.sum("__n").alias("__n")).withColumn("stroke", F.lit("all")))
    # a label that is null is a level of its own
    both = both.withColumn("__group", F.struct("column", "stroke")).select("__group", "value", "__n")
    stats = exact_quantiles(both, ["__group"], "value", [0.25, 0.5, 0.75], weight="__n")
    return stats.select(
        "__group.column", "__group.stroke", F.col("n").cast("bigint").alias("count"), F.col("q_mean").alias("mean"),
        F.when(F.col("n") > 1, F.sqrt(F.col("q_m2") / (F.col("n") - 1))).alias("std"),
        F.col("q_min").alias("min"), F.col("q0").alias("p25"), F.col("q1").alias("median"), F.col("q2").alias("p75"), F.col("q_max").alias("max"),
    )


def leakage_audit(records: DataFrame, schema: CleanSchema = CleanSchema()) -> DataFrame:
    """EDA12: post-reference row count (must be zero)."""
    d, r = schema.date, schema.reference_date
    if d not in records.columns or r not in records.columns:
        return records.sparkSession.createDataFrame([("no_post_reference_records", False, None)], "check string, passed boolean, failed_record_count bigint")
    valid = q(d).isNotNull() & q(r).isNotNull()
    return records.agg(F.count_if(valid & (q(d) > q(r))).alias("failed_record_count")).select(
        F.lit("no_post_reference_records").alias("check"), (F.col("failed_record_count") == 0).alias("passed"), "failed_record_count"
    )


def high_missing_variables(missingness: DataFrame, threshold: float = HIGH_MISSING_THRESHOLD) -> DataFrame:
    """EDA13: variables whose missing share is at least ``threshold``."""
    return missingness.where(F.col("missing_percent") >= threshold)


def sensitivity_recommendation(case_summary: DataFrame) -> DataFrame:
    """EDA14: recommend alternative windows when fewer than two complete positives exist."""
    row = case_summary.where(F.col("group") == "temporal_complete")
    rec = F.col("stroke_patients") < MIN_COMPLETE_POSITIVES_FOR_MODELLING
    return row.select(
        rec.alias("recommend_sensitivity_analysis"),
        F.when(rec, F.lit("strict FIRST/MID/LAST temporal-complete cohort has too few stroke cases for reliable modeling")).otherwise(
            F.lit("strict FIRST/MID/LAST temporal-complete cohort has enough stroke cases for minimal modeling")
        ).alias("reason"),
        F.col("patients").alias("temporal_complete_patients"),
        F.col("stroke_patients").alias("temporal_complete_stroke_patients"),
        F.lit("90/180 days as sensitivity analysis; keep paper windows as primary baseline").alias("suggested_fallback_windows"),
    )


def eda_acceptance(imbalance: DataFrame, coverage: DataFrame, miss_window: DataFrame, leakage: DataFrame, case_summary: DataFrame, recommendation: DataFrame) -> DataFrame:
    """EDA15: the six acceptance checks of the exploratory stage."""
    a = imbalance.agg(F.count(F.lit(1)).alias("imb_n"))
    b = coverage.agg(F.max(F.when(F.col("metric") == "temporal_complete_patients", F.col("patient_count"))).alias("complete"))
    c = miss_window.agg(F.count_distinct(F.when(F.col("window").isin(*WINDOW_NAMES), F.col("window"))).alias("win_n"))
    d = leakage.agg(F.bool_and("passed").alias("leak_ok"), F.sum("failed_record_count").alias("leak_n"))
    e = case_summary.agg(F.max(F.when(F.col("group") == "temporal_complete", F.col("stroke_patients"))).alias("pos"))
    f = recommendation.agg(F.max("recommend_sensitivity_analysis").alias("rec"))
    row = scalar_row(a, b, c, d, e, f)
    checks = [
        ("class_imbalance_reported", F.col("imb_n") > 0, F.concat(F.lit("label_groups="), F.col("imb_n").cast("string"))),
        ("temporal_complete_patient_count_reported", F.col("complete").isNotNull(), F.concat(F.lit("temporal_complete_patients="), F.col("complete").cast("string"))),
        ("missingness_by_first_mid_last_reported", F.col("win_n") == len(WINDOW_NAMES), F.concat(F.lit("windows="), F.col("win_n").cast("string"))),
        ("no_post_reference_records_confirmed", F.col("leak_ok"), F.concat(F.lit("failed_record_count="), F.col("leak_n").cast("string"))),
        ("strict_completeness_stroke_case_count_identified", F.col("pos").isNotNull(), F.concat(F.lit("temporal_complete_stroke_patients="), F.col("pos").cast("string"))),
        ("sensitivity_analysis_recommended_if_needed", F.col("rec") == (F.col("pos") < MIN_COMPLETE_POSITIVES_FOR_MODELLING), F.concat(F.lit("recommend="), F.col("rec").cast("string"))),
    ]
    structs = [
        F.struct(F.lit(i).alias("check_order"), F.lit(n).alias("check"), F.coalesce(p, F.lit(False)).alias("passed"), dd.cast("string").alias("detail"))
        for i, (n, p, dd) in enumerate(checks, start=1)
    ]
    return row.select(F.explode(F.array(*structs)).alias("c")).select("c.*")


def run_eda(records: DataFrame, cohort: DataFrame, completeness: DataFrame, attrition: DataFrame, schema: CleanSchema = CleanSchema(), cohort_entity: str = "hn") -> dict[str, DataFrame]:
    """EDA16: every stage-04 table, lazily."""
    cohort_std = cohort.withColumnRenamed(cohort_entity, schema.entity) if cohort_entity != schema.entity else cohort
    comp_std = completeness.withColumnRenamed(cohort_entity, schema.entity) if cohort_entity in completeness.columns else completeness
    imbalance = class_imbalance(cohort_std, schema.label)
    freq = visit_frequency(records, schema)
    coverage = temporal_coverage(comp_std, attrition)
    miss_var = missingness_by_variable(records)
    miss_window = missingness_by_group(records, schema.window)
    leak = leakage_audit(records, schema)
    cases = complete_case_summary(cohort_std, comp_std, schema.entity, schema.label)
    rec = sensitivity_recommendation(cases)
    return {
        "class_imbalance": imbalance,
        "visit_frequency": freq,
        "visit_frequency_distribution": visit_distribution(freq),
        "window_visit_counts": window_visit_counts(records, schema),
        "time_gap_summary": time_gap_summary(records, schema),
        "missingness_by_variable": miss_var,
        "missingness_by_stroke": missingness_by_group(records, schema.label),
        "missingness_by_window": miss_window,
        "temporal_coverage": coverage,
        "window_coverage_by_label": window_coverage_by_label(records, schema),
        "temporal_complete_case_summary": cases,
        "clinical_descriptive_stats": descriptive_stats(records, schema.label),
        "leakage_audit": leak,
        "high_missing_variables": high_missing_variables(miss_var),
        "sensitivity_recommendation": rec,
        "eda_acceptance_checks": eda_acceptance(imbalance, coverage, miss_window, leak, cases, rec),
    }
