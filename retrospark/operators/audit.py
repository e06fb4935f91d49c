"""Stage 01: read-only profile of the raw visit table.

Each report is a single pass: one global aggregate reshaped into rows, or an unpivot
followed by a partially-aggregated group-by.  Example values come from a top-k
window (``row_number() <= k``) that Catalyst limits map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (
    EXPECTED_COLUMNS,
    EXPECTED_FIELD_DETAILS,
    INDEX_CODE_PATTERN,
    MONTH_DAYS,
    RAW_RANGE_CHECKS,
    RawSchema,
)
from ..functions.codes import code_match, q
from ..functions.dates import days_between
from ..functions.profile import exact_quantiles, first_k_per_group, scalar_row, stack_metrics


def _order(df: DataFrame, schema: RawSchema) -> list[str]:
    keys = list(schema.order_keys) or [c for c in df.columns if c not in (schema.entity, schema.date)]
    return [schema.entity, schema.date] + [k for k in keys if k in df.columns and k not in (schema.entity, schema.date)]


# ---------------------------------------------------------------- AUD1 - AUD5


def column_list(df: DataFrame) -> DataFrame:
    """AUD1: column names with 1-based ordinal (schema only)."""
    return df.sparkSession.createDataFrame(list(enumerate(df.columns, start=1)), "ordinal int, column string")


def _first_candidates(df: DataFrame, cols: list[str], leading: str, k: int) -> DataFrame:
    """The rows that may hold one of a column's first ``k`` values, with a flag ``__k<number>`` for each column.

    Rows are dealt into ``k`` classes by their content.  The smallest ``leading`` order column of each class are those of ``k``
    different rows, so a row beyond all of them is not among the first ``k``.  Where a class has no value, all rows stay.
    """
    own = F.pmod(F.xxhash64(*[q(c) for c in cols]), F.lit(k))
    low = df.groupBy(own.alias("__own")).agg(*[F.min(F.when(q(c).isNotNull(), q(leading))).alias(f"__l{i}") for i, c in enumerate(cols)])
    limits = low.agg(*[F.when(F.count(f"__l{i}") == k, F.max(f"__l{i}")).alias(f"__t{i}") for i in range(len(cols))])
    tops = F.array(*[F.col(f"__t{i}") for i in range(len(cols))])
    limits = limits.withColumn("__top", F.when(F.forall(tops, lambda x: x.isNotNull()), F.array_max(tops)))
    within = lambda limit: F.col(limit).isNull() | q(leading).isNull() | (q(leading) <= F.col(limit))
    joined = df.crossJoin(F.broadcast(limits)).where(within("__top"))  # one row of limits
    return joined.withColumns({f"__k{i}": q(c).isNotNull() & within(f"__t{i}") for i, c in enumerate(cols)})


def schema_summary(df: DataFrame, schema: RawSchema = RawSchema(), examples: int = 5) -> DataFrame:
    """AUD2: per column dtype, non-null / missing counts and share, exact distinct count, first examples.

    Distinct counts: unpivot to (column, value) and group twice; the first group-by
    combines duplicates map-side, so a value repeated in a third of all rows is cheap.
    """
    cols = df.columns
    n = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(q(c)).alias(f"__nn{i}") for i, c in enumerate(cols)])
    order = _order(df, schema)
    pairs = F.array(*[F.struct(F.lit(i).alias("ci"), q(c).cast("string").alias("value")) for i, c in enumerate(cols)])
    long = df.select(*[q(o).alias(f"__o{j}") for j, o in enumerate(order)], F.explode(pairs).alias("p")).select(
        *[f"__o{j}" for j in range(len(order))], "p.ci", "p.value"
    ).where(F.col("value").isNotNull())
    distinct = long.groupBy("ci", "value").agg(F.lit(1).alias("_")).groupBy("ci").agg(F.count(F.lit(1)).alias("unique_count"))
    pairs = F.filter(F.array(*[F.when(F.col(f"__k{i}"), F.struct(F.lit(i).alias("ci"), q(c).cast("string").alias("value"))) for i, c in enumerate(cols)]), lambda x: x.isNotNull())
    first = _first_candidates(df, cols, order[0], examples)
    first = first.select(*[q(o).alias(f"__o{j}") for j, o in enumerate(order)], F.explode(pairs).alias("p")).select(*[f"__o{j}" for j in range(len(order))], "p.ci", "p.value")
    ex = first_k_per_group(first, "ci", [F.col(f"__o{j}") for j in range(len(order))], examples)
    ex = ex.groupBy("ci").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__rn", "value"))), lambda x: x["value"]), "; ").alias("example_values")
    )
    meta = df.sparkSession.createDataFrame(
        [(i, c, t) for i, (c, t) in enumerate(df.dtypes)], "ci int, column string, dtype string"
    )
    structs = F.array(*[F.struct(F.lit(i).alias("ci"), F.col(f"__nn{i}").alias("non_null_count")) for i in range(len(cols))])
    counts = n.select("__n", F.explode(structs).alias("s")).select("__n", "s.*")
    out = meta.join(counts, on="ci").join(distinct, on="ci", how="left").join(ex, on="ci", how="left")
    return out.select(
        (F.col("ci") + 1).alias("ordinal"),
        "column",
        "dtype",
        F.col("non_null_count").cast("bigint").alias("non_null_count"),
        (F.col("__n") - F.col("non_null_count")).cast("bigint").alias("missing_count"),
        F.when(F.col("__n") > 0, (F.col("__n") - F.col("non_null_count")) / F.col("__n")).otherwise(F.lit(0.0)).alias("missing_percent"),
        F.coalesce(F.col("unique_count"), F.lit(0)).cast("bigint").alias("unique_count"),
        F.coalesce(F.col("example_values"), F.lit("")).alias("example_values"),
    )


def missing_from_summary(summary: DataFrame) -> DataFrame:
    """AUD3: missing summary (display order: share desc, count desc)."""
    return summary.select("column", "missing_count", "missing_percent").orderBy(F.desc("missing_percent"), F.desc("missing_count"))


def first_existing(columns: list[str], candidates: list[str]) -> str | None:
    for c in candidates:
        if c in columns:
            return c
    return None


def column_availability(df: DataFrame) -> DataFrame:
    """AUD4: logical field -> first matching physical column (schema only, driver side)."""
    rows = []
    for i, (field, candidates) in enumerate(EXPECTED_COLUMNS.items(), start=1):
        matched = first_existing(df.columns, candidates)
        cat, role, req = EXPECTED_FIELD_DETAILS.get(field, ("", "", ""))
        rows.append((i, field, cat, role, req, "available" if matched else "missing", matched or "", ", ".join(candidates)))
    return df.sparkSession.createDataFrame(
        rows,
        "ordinal int, required_field string, category string, paper_role string, required_for string, status string, matched_column string, candidate_columns string",
    )


def data_dictionary(df: DataFrame, availability: DataFrame, summary: DataFrame) -> DataFrame:
    """AUD5: availability left-joined with the schema summary on the matched column."""
    s = summary.select(
        F.col("column").alias("matched_column"), "dtype", "missing_percent", "unique_count", "example_values"
    )
    return availability.join(s, on="matched_column", how="left").select(
        "ordinal", "required_field", "matched_column", "status", "category", "paper_role", "required_for",
        "dtype", "missing_percent", "unique_count", "example_values",
    )


# ---------------------------------------------------------------- AUD6 - AUD8


def visit_coverage(df: DataFrame, schema: RawSchema = RawSchema()) -> DataFrame:
    """AUD6: per entity record count, first/last date and follow-up days (null id/date dropped)."""
    e, d = schema.entity, schema.date
    v = df.select(q(e).alias(e), q(d).alias(d)).where(q(e).isNotNull() & q(d).isNotNull())
    g = v.groupBy(e).agg(F.count(F.lit(1)).alias("record_count"), F.min(d).alias("first_visit_date"), F.max(d).alias("last_visit_date"))
    return g.withColumn("followup_days", days_between(F.col("last_visit_date"), F.col("first_visit_date")))


def coverage_overview(coverage: DataFrame) -> DataFrame:
    """AUD7: min/median/mean/max of records and follow-up per entity, plus two screens.

    Medians are exact and distributed (:func:`exact_quantiles`).
    """
    r, f = F.col("record_count"), F.col("followup_days")
    agg = coverage.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(r).alias("rmin"), F.avg(r).alias("rmean"), F.max(r).alias("rmax"),
        F.min(f).alias("fmin"), F.avg(f).alias("fmean"), F.max(f).alias("fmax"),
        F.count_if(f >= F.lit(21 * MONTH_DAYS)).alias("f21"),
        F.count_if(r >= 3).alias("r3"),
    )
    rmed = exact_quantiles(coverage, [], "record_count", [0.5], prefix="rmed").select(F.col("rmed0").alias("rmed"))
    fmed = exact_quantiles(coverage, [], "followup_days", [0.5], prefix="fmed").select(F.col("fmed0").alias("fmed"))
    agg = scalar_row(agg, rmed, fmed)
    c = F.col
    return stack_metrics(
        agg,
        [
            ("patients_with_visit_coverage", c("n"), ""),
            ("records_per_patient_min", c("rmin"), ""),
            ("records_per_patient_median", c("rmed"), ""),
            ("records_per_patient_mean", c("rmean"), ""),
            ("records_per_patient_max", c("rmax"), ""),
            ("followup_days_min", c("fmin"), ""),
            ("followup_days_median", c("fmed"), ""),
            ("followup_days_mean", c("fmean"), ""),
            ("followup_days_max", c("fmax"), ""),
            ("patients_with_followup_at_least_21_months", c("f21"), "rough screen for paper FIRST window reach"),
            ("patients_with_at_least_3_records", c("r3"), "rough screen for multi-window longitudinal data"),
        ],
    )


def range_summary(df: DataFrame, ranges: dict[str, tuple[float, float]] = RAW_RANGE_CHECKS) -> DataFrame:
    """AUD8: read-only range profile: non-null, min, max, below/above counts (one aggregate)."""
    present = [c for c in ranges if c in df.columns]
    if not present:
        return df.sparkSession.createDataFrame([], "column string")
    v = {c: q(c).try_cast("double") for c in present}
    row = df.agg(
        *[F.count(v[c]).alias(f"n{i}") for i, c in enumerate(present)],
        *[F.min(v[c]).alias(f"lo{i}") for i, c in enumerate(present)],
        *[F.max(v[c]).alias(f"hi{i}") for i, c in enumerate(present)],
        *[F.count_if(v[c] < ranges[c][0]).alias(f"b{i}") for i, c in enumerate(present)],
        *[F.count_if(v[c] > ranges[c][1]).alias(f"a{i}") for i, c in enumerate(present)],
    )
    structs = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"n{i}").alias("non_null_count"),
            F.col(f"lo{i}").alias("min"),
            F.col(f"hi{i}").alias("max"),
            F.col(f"b{i}").alias("below_expected_count"),
            F.col(f"a{i}").alias("above_expected_count"),
            F.lit(float(ranges[c][0])).alias("expected_min"),
            F.lit(float(ranges[c][1])).alias("expected_max"),
        )
        for i, c in enumerate(present)
    ]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


# ---------------------------------------------------------------- AUD9 - AUD12


def code_predicate(column: str) -> Column:
    """AUD9: index-code contains-test on one column (null -> false)."""
    return code_match(column, INDEX_CODE_PATTERN)


def code_availability(df: DataFrame, schema: RawSchema = RawSchema(), examples: int = 10) -> DataFrame:
    """AUD10: per code role: status, non-null count, index-code hits, first matching values."""
    roles = [("principal", schema.principal_code), ("comorbidity", schema.comorbidity_code)]
    spark = df.sparkSession
    present = [(r, c) for r, c in roles if c in df.columns]
    order = _order(df, schema)
    parts = []
    if present:
        row = df.agg(*[F.count(q(c)).alias(f"nn{i}") for i, (_, c) in enumerate(present)],
                     *[F.count_if(code_predicate(c)).alias(f"h{i}") for i, (_, c) in enumerate(present)])
        hits = df.select(
            *[q(o).alias(f"__o{j}") for j, o in enumerate(order)],
            F.explode(F.array(*[F.when(code_predicate(c), F.struct(F.lit(r).alias("role"), q(c).cast("string").alias("value"))) for r, c in present])).alias("h"),
        ).where(F.col("h").isNotNull()).select(*[f"__o{j}" for j in range(len(order))], "h.role", "h.value")
        top = first_k_per_group(hits, "role", [F.col(f"__o{j}") for j in range(len(order))], examples)
        ex = top.groupBy(F.col("role").alias("diagnosis_role")).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__rn", "value"))), lambda x: x["value"]), "; ").alias("example_stroke_codes")
        )
        structs = [
            F.struct(F.lit(r).alias("diagnosis_role"), F.lit(c).alias("column"), F.lit("available").alias("status"),
                     F.col(f"nn{i}").alias("non_null_count"), F.col(f"h{i}").alias("stroke_code_record_count"))
            for i, (r, c) in enumerate(present)
        ]
        avail = row.select(F.explode(F.array(*structs)).alias("s")).select("s.*").join(ex, on="diagnosis_role", how="left")
        parts.append(avail.withColumn("example_stroke_codes", F.coalesce("example_stroke_codes", F.lit(""))))
    missing = [(r, c, "missing", 0, 0, "") for r, c in roles if c not in df.columns]
    if missing or not parts:
        parts.append(spark.createDataFrame(missing, "diagnosis_role string, column string, status string, non_null_count bigint, stroke_code_record_count bigint, example_stroke_codes string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def audit_acceptance(df: DataFrame, availability: DataFrame, coverage: DataFrame, codes: DataFrame, schema: RawSchema = RawSchema()) -> DataFrame:
    """AUD11: the seven acceptance checks of the audit stage."""
    c = codes.agg(
        F.coalesce(F.bool_or(F.col("status") == "available"), F.lit(False)).alias("dx_ok"),
        F.coalesce(F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == "available", F.col("column")))), ", "), F.lit("")).alias("dx_cols"),
        F.coalesce(F.sum("stroke_code_record_count"), F.lit(0)).alias("hits"),
    )
    a = availability.agg(F.coalesce(F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == "missing", F.col("required_field")))), ","), F.lit("")).alias("miss"))
    v = coverage.agg(F.count(F.lit(1)).alias("cov"))
    row = scalar_row(c, a, v)
    checks = [
        ("raw_file_read_only_policy", F.lit(True), F.lit("Stage 01 reads raw data and writes audit artifacts only.")),
        ("patient_identifier_found", F.lit(schema.entity in df.columns), F.lit(schema.entity)),
        ("visit_date_found", F.lit(schema.date in df.columns), F.lit(schema.date)),
        ("diagnosis_column_found", F.col("dx_ok"), F.col("dx_cols")),
        ("icd10_i60_i68_checked", F.lit(True), F.concat(F.lit("stroke_code_record_hits="), F.col("hits").cast("string"))),
        ("expected_field_missingness_reported", F.lit(True), F.concat(F.lit("missing_expected_fields="), F.col("miss"))),
        ("visit_coverage_reported", F.col("cov") > 0, F.concat(F.lit("patients_with_visit_coverage="), F.col("cov").cast("string"))),
    ]
    structs = [
        F.struct(F.lit(i).alias("check_order"), F.lit(n).alias("check"), F.coalesce(p, F.lit(False)).alias("passed"), d.cast("string").alias("detail"))
        for i, (n, p, d) in enumerate(checks, start=1)
    ]
    return row.select(F.explode(F.array(*structs)).alias("c")).select("c.*")


def audit_summary(df: DataFrame, codes: DataFrame, schema: RawSchema = RawSchema()) -> DataFrame:
    """AUD12 summary record: rows, columns, entities, index-code hits."""
    return scalar_row(
        df.agg(F.count(F.lit(1)).alias("raw_rows"), F.count_distinct(q(schema.entity)).alias("patients")),
        codes.agg(F.coalesce(F.sum("stroke_code_record_count"), F.lit(0)).cast("bigint").alias("stroke_code_record_hits")),
    ).withColumn("raw_columns", F.lit(len(df.columns)))


def run_raw_data_audit(df: DataFrame, schema: RawSchema = RawSchema()) -> dict[str, DataFrame]:
    """AUD12: all stage-01 tables, lazily."""
    summary = schema_summary(df, schema)
    availability = column_availability(df)
    coverage = visit_coverage(df, schema)
    codes = code_availability(df, schema)
    return {
        "raw_column_list": column_list(df),
        "raw_schema_summary": summary,
        "raw_missing_summary": missing_from_summary(summary),
        "column_availability_checklist": availability,
        "raw_data_dictionary": data_dictionary(df, availability, summary),
        "visit_coverage": coverage,
        "visit_coverage_overview": coverage_overview(coverage),
        "raw_range_summary": range_summary(df),
        "icd10_availability_report": codes,
        "raw_acceptance_checks": audit_acceptance(df, availability, coverage, codes, schema),
        "raw_data_report": audit_summary(df, codes, schema),
    }
