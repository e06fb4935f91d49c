"""Stage 03: standardise, de-identify, coerce, dedupe, tokenise codes, enforce binaries and ranges.

Every transformation is a projection (``withColumns``) except the whole-row dedupe,
which is an aggregate with map-side combine (copies of a hot row collapse before the
shuffle).  Every report is one global aggregate over the table, reshaped to rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (
    BINARY_COLUMNS,
    CLEAN_INDEX_CODE_PATTERN,
    COLUMN_RENAME_MAP,
    DATE_COLUMNS,
    NUMERIC_COLUMNS,
    PLAUSIBLE_RANGES,
    REQUIRED_OUTPUT_COLUMNS,
    CleanSchema,
)
from ..functions.codes import code_match, normalized_codes, q
from ..functions.dates import to_timestamp_safe
from ..functions.profile import first_k_per_group, missing_columns, missing_rows, missing_summary, scalar_row, written_with_metrics
from .cohort import PLACE, with_record_ids

CODE_COLUMNS = ["principal_diagnosis", "comorbidity_diagnosis"]
NUMERIC_TYPES = ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")


class _LazyReport:
    """A schema-derived report that is only turned into a DataFrame when used."""

    def __init__(self, spark, rows, ddl):
        self._args = (spark, rows, ddl)
        self._df = None

    def __getattr__(self, item):
        if self._df is None:
            self._df = _small_df(*self._args)
        return getattr(self._df, item)


def _small_df(spark, rows: list[tuple], ddl: str) -> DataFrame:
    """Schema-derived report (a handful of rows computed from column names, not from data)."""
    return spark.createDataFrame(rows, ddl)


# ---------------------------------------------------------------- CLN1 - CLN3


def standardize_columns(df: DataFrame, rename_map: dict[str, str] = COLUMN_RENAME_MAP) -> tuple[DataFrame, DataFrame]:
    """CLN1: rename physical names to standard names; report the mapping applied."""
    mapping = {old: new for old, new in rename_map.items() if old in df.columns}
    out = df.withColumnsRenamed(mapping) if mapping else df
    return out, _LazyReport(df.sparkSession, list(mapping.items()), "original_column string, standardized_column string")


def deidentify(df: DataFrame, quasi_identifiers: tuple[str, ...] | list[str], drop: bool = True) -> tuple[DataFrame, DataFrame]:
    """CLN2: drop direct/quasi identifiers not needed for modelling."""
    dropped = [c for c in quasi_identifiers if c in df.columns] if drop else []
    report = _small_df(
        df.sparkSession,
        [(c, "dropped", "Direct or quasi identifier not needed for modeling") for c in dropped],
        "column string, action string, reason string",
    )
    return (df.drop(*dropped) if dropped else df), report


def coerce_types(df: DataFrame) -> DataFrame:
    """CLN3: dates -> timestamp, numerics -> double, binaries -> numeric; bad values become null."""
    types = dict(df.dtypes)
    fixes: dict[str, Column] = {}
    for c in DATE_COLUMNS:
        if c in types:
            fixes[c] = to_timestamp_safe(q(c), types[c])
    for c in NUMERIC_COLUMNS + BINARY_COLUMNS:
        if c in types and not types[c].startswith(NUMERIC_TYPES):
            fixes[c] = F.nanvl(q(c).try_cast("double"), F.lit(None).cast("double"))  # the text NaN is missing, too
    return df.withColumns(fixes) if fixes else df


# ---------------------------------------------------------------- CLN4 - CLN6


def with_normalized_codes(df: DataFrame) -> DataFrame:
    present = [c for c in CODE_COLUMNS if c in df.columns]
    return df.withColumns({f"{c}_normalized": normalized_codes(c) for c in present}) if present else df


def binary_nulling(df: DataFrame, columns: list[str] = BINARY_COLUMNS) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.when(_is_binary(c), q(c)) for c in present}) if present else df


def range_nulling(df: DataFrame, ranges: dict[str, tuple[float, float]] = PLAUSIBLE_RANGES) -> DataFrame:
    present = [c for c in ranges if c in df.columns]
    vals = {c: q(c).try_cast("double") for c in present}
    return df.withColumns({c: F.when(~(vals[c].isNotNull() & ~vals[c].between(*ranges[c])), q(c)) for c in present}) if present else df


def normalize_codes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CLN4 + CLN5: ``<col>_normalized`` = ordered distinct code tokens joined by ``;``.

    The report counts index-code hits before/after tokenisation (lost / added).
    """
    present = [c for c in CODE_COLUMNS if c in df.columns]
    out = with_normalized_codes(df)
    aggs = []
    for i, c in enumerate(present):
        before = code_match(c, CLEAN_INDEX_CODE_PATTERN)
        after = code_match(f"{c}_normalized", CLEAN_INDEX_CODE_PATTERN)
        aggs += [
            F.count(q(c)).alias(f"nb{i}"),
            F.count(q(f"{c}_normalized")).alias(f"na{i}"),
            F.count_if(before).alias(f"hb{i}"),
            F.count_if(after).alias(f"ha{i}"),
            F.count_if(before & ~after).alias(f"lost{i}"),
            F.count_if(~before & after).alias(f"add{i}"),
        ]
    if not present:
        return out, _small_df(df.sparkSession, [], "source_column string")
    row = out.agg(*aggs)
    structs = [
        F.struct(
            F.lit(c).alias("source_column"),
            F.lit(f"{c}_normalized").alias("normalized_column"),
            F.col(f"nb{i}").alias("non_null_before"),
            F.col(f"na{i}").alias("non_null_after"),
            F.col(f"hb{i}").alias("stroke_icd_hits_before"),
            F.col(f"ha{i}").alias("stroke_icd_hits_after"),
            F.col(f"lost{i}").alias("stroke_icd_lost_after_normalization"),
            F.col(f"add{i}").alias("stroke_icd_added_by_tokenization"),
            (F.col(f"lost{i}") == 0).alias("stroke_icd_signal_preserved"),
        )
        for i, c in enumerate(present)
    ]
    return out, row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def drop_exact_duplicates(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CLN6: whole-row dedupe (nulls compare equal) + before/after counts."""
    out = df.dropDuplicates()
    # copies are counted where they meet: one pass gives both counts
    copies = df.groupBy(*[q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__copies"))
    report = copies.agg(F.coalesce(F.sum("__copies"), F.lit(0).cast("bigint")).alias("rows_before"), F.count(F.lit(1)).alias("rows_after")).select(
        F.lit("drop_exact_duplicates").alias("rule"),
        "rows_before",
        "rows_after",
        (F.col("rows_before") - F.col("rows_after")).alias("rows_changed"),
    )
    return out, report


# ---------------------------------------------------------------- CLN7 / CLN8


def _is_binary(c: str) -> Column:
    return q(c).isin(0, 1)


def apply_binary_encoding(df: DataFrame, columns: list[str] = BINARY_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """CLN7: values outside {0, 1} become null; report invalid count and non-null after."""
    present = [c for c in columns if c in df.columns]
    invalid = {c: q(c).isNotNull() & ~_is_binary(c) for c in present}
    out = df.withColumns({c: F.when(_is_binary(c), q(c)) for c in present}) if present else df
    if not present:
        return out, _small_df(df.sparkSession, [], "column string")
    row = df.agg(*[F.count_if(invalid[c]).alias(f"i{i}") for i, c in enumerate(present)],
                 *[F.count_if(_is_binary(c)).alias(f"n{i}") for i, c in enumerate(present)])
    structs = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit("{0,1}").alias("encoding"),
            F.col(f"i{i}").alias("invalid_values_set_missing"),
            F.col(f"n{i}").alias("non_null_after"),
        )
        for i, c in enumerate(present)
    ]
    return out, row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def _fmt_bound(v: float) -> str:
    return str(v)


def apply_range_checks(
    df: DataFrame,
    schema: CleanSchema = CleanSchema(),
    ranges: dict[str, tuple[float, float]] = PLAUSIBLE_RANGES,
    log_examples: int = 10,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """CLN8: out-of-range values (bounds inclusive) become null.

    Returns (cleaned, summary per column, change log with the first ``log_examples``
    violations per column in record order).
    """
    present = [c for c in ranges if c in df.columns]
    vals = {c: q(c).try_cast("double") for c in present}
    bad = {c: vals[c].isNotNull() & ~vals[c].between(*ranges[c]) for c in present}
    out = df.withColumns({c: F.when(~bad[c], q(c)) for c in present}) if present else df
    spark = df.sparkSession
    if not present:
        empty = _small_df(spark, [], "column string")
        return out, empty, empty
    row = scalar_row(
        df.agg(*[F.count_if(bad[c]).alias(f"b{i}") for i, c in enumerate(present)]),
        out.agg(
            *[F.count_if(q(c).isNull()).alias(f"m{i}") for i, c in enumerate(present)],
            *[F.min(q(c)).cast("double").alias(f"lo{i}") for i, c in enumerate(present)],
            *[F.max(q(c)).cast("double").alias(f"hi{i}") for i, c in enumerate(present)],
        ),
    )
    structs = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(float(ranges[c][0])).alias("expected_min"),
            F.lit(float(ranges[c][1])).alias("expected_max"),
            F.col(f"b{i}").alias("invalid_values_set_missing"),
            F.col(f"m{i}").alias("missing_after"),
            F.col(f"lo{i}").alias("min_after"),
            F.col(f"hi{i}").alias("max_after"),
        )
        for i, c in enumerate(present)
    ]
    summary = row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
    log = range_change_log(df, schema, ranges, present, log_examples)
    return out, summary, log


def range_change_log(df: DataFrame, schema: CleanSchema, ranges: dict, present: list[str], k: int) -> DataFrame:
    """First ``k`` violations per column, ordered by (entity, date, order keys, window)."""
    keys = [schema.entity, schema.date] + [c for c in schema.order_keys if c in df.columns]
    if schema.window in df.columns:
        keys.append(schema.window)
    violations = F.filter(
        F.array(
            *[
                F.when(
                    q(c).try_cast("double").isNotNull() & ~q(c).try_cast("double").between(*ranges[c]),
                    F.struct(
                        F.lit(c).alias("column"),
                        q(c).try_cast("double").alias("original_value"),
                        F.lit(f"outside plausible range [{_fmt_bound(ranges[c][0])}, {_fmt_bound(ranges[c][1])}]").alias("reason"),
                    ),
                )
                for c in present
            ]
        ),
        lambda x: x.isNotNull(),
    )
    exploded = df.select(*[q(k_) for k_ in keys], F.explode(violations).alias("v")).select(*keys, "v.*")
    top = first_k_per_group(exploded, "column", [F.col(x).asc_nulls_first() for x in keys], k)
    return top.select(
        *keys,
        "column",
        "original_value",
        F.lit("set_missing").alias("action"),
        "reason",
    )


# ---------------------------------------------------------------- CLN9 - CLN15


def cleaned_missing_summary(df: DataFrame) -> DataFrame:
    """CLN9: missing count/share per column (sort by share, count desc when displaying)."""
    return missing_summary(df)


def _dated(df: DataFrame, schema: CleanSchema) -> bool:
    return schema.date in df.columns and schema.reference_date in df.columns


def date_columns(df: DataFrame, schema: CleanSchema = CleanSchema()) -> list[Column]:
    """Aggregates of CLN10 and CLN13 (none where a date column is missing)."""
    if not _dated(df, schema):
        return []
    d, r = q(schema.date), q(schema.reference_date)
    valid = d.isNotNull() & r.isNotNull()
    return [
        F.bool_and(F.when(valid, d <= r)).alias("no_post_reference_records"),
        F.count_if(valid & (d > r)).alias("post"),
        F.count_if(valid).alias("pairs"),
    ]


def no_post_reference(df: DataFrame, schema: CleanSchema = CleanSchema(), row: DataFrame | None = None) -> DataFrame:
    """CLN10: one row: true / false, or null when no (date, reference) pair exists (``row``: known aggregates)."""
    if not _dated(df, schema):
        return df.sparkSession.createDataFrame([(None,)], "no_post_reference_records boolean")
    row = df.agg(*date_columns(df, schema)) if row is None else row
    return row.select("no_post_reference_records")


def required_columns(df: DataFrame, required: list[str] = REQUIRED_OUTPUT_COLUMNS) -> list[Column]:
    """Aggregates of CLN11."""
    present = [c for c in required if c in df.columns]
    return [F.count(F.lit(1)).alias("__rows"), *[F.count(q(c)).alias(f"__r{i}") for i, c in enumerate(present)]]


def required_column_report(df: DataFrame, required: list[str] = REQUIRED_OUTPUT_COLUMNS, row: DataFrame | None = None) -> DataFrame:
    """CLN11: required output columns present, with non-null counts (one aggregate, or ``row``)."""
    present = [c for c in required if c in df.columns]
    row = df.agg(*required_columns(df, required)) if row is None else row
    structs = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(c).alias("required_column"),
            F.lit("available" if c in present else "missing").alias("status"),
            (F.col(f"__r{present.index(c)}") if c in present else F.lit(0)).cast("bigint").alias("non_null_count"),
        )
        for i, c in enumerate(required, start=1)
    ]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def binary_columns(df: DataFrame, columns: list[str] = BINARY_COLUMNS) -> list[Column]:
    """Aggregates of CLN12."""
    present = [c for c in columns if c in df.columns]
    return [
        *[F.count_if(q(c).isNotNull() & ~_is_binary(c)).alias(f"__i{i}") for i, c in enumerate(present)],
        *[F.count(q(c)).alias(f"__b{i}") for i, c in enumerate(present)],
    ]


def binary_validation_report(df: DataFrame, columns: list[str] = BINARY_COLUMNS, row: DataFrame | None = None) -> DataFrame:
    """CLN12: after cleaning, binaries hold only 0/1/null (one aggregate, or ``row``)."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return _small_df(df.sparkSession, [], "column string")
    row = df.agg(*binary_columns(df, columns)) if row is None else row
    structs = [
        F.struct(
            F.lit(c).alias("column"),
            (F.col(f"__i{i}") == 0).alias("valid_binary_or_missing"),
            F.col(f"__i{i}").alias("invalid_count_after_cleaning"),
            F.col(f"__b{i}").alias("non_null_after_cleaning"),
        )
        for i, c in enumerate(present)
    ]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def leakage_audit_report(df: DataFrame, schema: CleanSchema = CleanSchema(), row: DataFrame | None = None) -> DataFrame:
    """CLN13: post-reference row count and parseable (date, reference) pairs (one aggregate, or ``row``)."""
    if not _dated(df, schema):
        return df.sparkSession.createDataFrame(
            [("no_post_reference_records", False, "visit_date or reference_date missing")], "check string, passed boolean, detail string"
        )
    row = df.agg(*date_columns(df, schema)) if row is None else row
    structs = [
        F.struct(F.lit("no_post_reference_records").alias("check"), (F.col("post") == 0).alias("passed"),
                 F.concat(F.lit("post_reference_records="), F.col("post").cast("string")).alias("detail")),
        F.struct(F.lit("date_columns_parseable").alias("check"), (F.col("pairs") > 0).alias("passed"),
                 F.concat(F.lit("valid_visit_reference_pairs="), F.col("pairs").cast("string")).alias("detail")),
    ]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def cleaning_acceptance(
    cleaned: DataFrame,
    required_report: DataFrame,
    binary_report: DataFrame,
    range_summary: DataFrame,
    range_log: DataFrame,
    code_report: DataFrame,
    leakage: DataFrame,
    label: str = "stroke",
) -> DataFrame:
    """CLN14: the six acceptance checks of the cleaning stage."""
    req = required_report.agg(
        F.coalesce(F.bool_and(F.col("status") == "available"), F.lit(True)).alias("req_ok"),
        F.coalesce(F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == "missing", F.col("required_column")))), ", "), F.lit("")).alias("req_missing"),
    )
    leak = leakage.agg(
        F.coalesce(F.bool_and("passed"), F.lit(False)).alias("leak_ok"),
        F.array_join(F.array_sort(F.collect_list("detail")), "; ").alias("leak_detail"),
    )
    binr = binary_report.agg(F.coalesce(F.bool_and("valid_binary_or_missing"), F.lit(True)).alias("bin_ok"), F.count(F.lit(1)).alias("bin_n"))
    rng = range_summary.agg(F.coalesce(F.sum("invalid_values_set_missing"), F.lit(0)).alias("rng_bad"))
    logn = range_log.agg(F.count(F.lit(1)).alias("log_n"))
    codes = code_report.agg(F.coalesce(F.bool_and("stroke_icd_signal_preserved"), F.lit(False)).alias("codes_ok"))
    row = scalar_row(req, leak, binr, rng, logn, codes)
    has_label = F.lit(label in cleaned.columns)
    checks = [
        ("required_columns_kept", F.col("req_ok"), F.col("req_missing")),
        ("no_post_reference_records", F.col("leak_ok"), F.col("leak_detail")),
        ("binary_columns_only_0_1_missing", F.col("bin_ok"), F.concat(F.lit("columns_checked="), F.col("bin_n").cast("string"))),
        ("implausible_values_logged", (F.col("rng_bad") == 0) | (F.col("log_n") > 0), F.concat(F.lit("range_invalid_values="), F.col("rng_bad").cast("string"))),
        ("diagnosis_normalization_preserves_stroke_signal", F.col("codes_ok"), F.lit("ICD-10 I60-I68 hits before/after normalization match")),
        ("cleaning_does_not_create_new_target_leakage", F.col("leak_ok") & has_label, F.lit("stroke label retained; records remain pre-reference")),
    ]
    structs = [
        F.struct(F.lit(i).alias("check_order"), F.lit(n).alias("check"), F.coalesce(p, F.lit(False)).alias("passed"), d.cast("string").alias("detail"))
        for i, (n, p, d) in enumerate(checks, start=1)
    ]
    return row.select(F.explode(F.array(*structs)).alias("c")).select("c.*")


def unified_cleaning_log(range_log: DataFrame, duplicate_report: DataFrame) -> DataFrame:
    """CLN15: range log and duplicate report in one table (columns of both, nulls elsewhere)."""
    dup = duplicate_report.withColumns({"action": F.lit("drop_rows"), "column": F.lit(None).cast("string")})
    return range_log.unionByName(dup, allowMissingColumns=True)


def typed_records(long: DataFrame, schema: CleanSchema = CleanSchema()) -> DataFrame:
    """Renamed, de-identified and coerced (the input of the dedupe step)."""
    df, _ = standardize_columns(long)
    if schema.drop_quasi_identifiers:
        df = df.drop(*[c for c in schema.quasi_identifiers if c in df.columns])
    return coerce_types(df)


def distinct_records(long: DataFrame, schema: CleanSchema = CleanSchema(), source: list[str] | None = None) -> DataFrame:
    """The typed rows without copies (placed records are compared where they are).

    ``source`` names the source columns of a table that has no ``source_record_id`` yet.  Its rows are then compared by
    these columns, which are equal exactly where the id is, and get the id afterwards: it is computed once a
    row that is kept, and only by queries that read it.
    """
    if source is None:
        return typed_records(long, schema).dropDuplicates().drop(PLACE)
    return typed_records(with_record_ids(long.dropDuplicates().drop(PLACE), source), schema)


def clean_records(long: DataFrame, schema: CleanSchema = CleanSchema(), source: list[str] | None = None) -> DataFrame:
    """The cleaned table alone (same transformation order as :func:`run_data_cleaning`, no reports)."""
    return range_nulling(binary_nulling(with_normalized_codes(distinct_records(long, schema, source))))


def run_data_cleaning(
    long: DataFrame, schema: CleanSchema = CleanSchema(), write: Callable[[DataFrame], DataFrame] | None = None
) -> dict[str, DataFrame]:
    """CLN16: rename -> de-identify -> coerce -> dedupe -> codes -> binaries -> ranges.

    All lazy; with ``write``, which stores the cleaned table and gives it back, the reports on that table
    (CLN9 to CLN13) come from metrics taken during the write, without a scan of their own.
    """
    df, column_report = standardize_columns(long)
    df, deid_report = deidentify(df, schema.quasi_identifiers, schema.drop_quasi_identifiers)
    df = coerce_types(df)
    df, duplicate_report = drop_exact_duplicates(df)
    df, code_report = normalize_codes(df)
    df, binary_report = apply_binary_encoding(df)
    df, range_summary, range_log = apply_range_checks(df, schema)
    row = None
    if write is not None:
        metrics = [*missing_columns(df), *required_columns(df), *binary_columns(df), *date_columns(df, schema)]
        df, row = written_with_metrics(df, write, metrics)
    required = required_column_report(df, row=row)
    binval = binary_validation_report(df, row=row)
    leakage = leakage_audit_report(df, schema, row)
    return {
        "cleaned_pre_reference_records": df,
        "column_standardization_report": column_report,
        "deidentification_report": deid_report,
        "duplicate_report": duplicate_report,
        "diagnosis_normalization_report": code_report,
        "binary_encoding_report": binary_report,
        "range_check_summary": range_summary,
        "range_change_log": range_log,
        "missing_summary_after_cleaning": cleaned_missing_summary(df) if row is None else missing_rows(row, df.columns),
        "required_column_report": required,
        "binary_validation_report": binval,
        "leakage_audit_report": leakage,
        "no_post_reference": no_post_reference(df, schema, row),
        "cleaning_log": unified_cleaning_log(range_log, duplicate_report),
        "cleaning_acceptance_checks": cleaning_acceptance(df, required, binval, range_summary, range_log, code_report, leakage),
    }
