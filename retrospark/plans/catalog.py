"""Query catalogue: one Spark query per inventory operator, each with a DuckDB oracle.

Every query reads the test tables through the ``visits`` adapter (or the predictions
fixture) and runs over whole tables.  Doubles are rounded to 6 decimals so value
hashes agree across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..config import ANOVA_K_GRID, FEATURE_TARGET_COUNTS, PCA_N_GRID, FeatureConfig
from ..operators import cleaning as CL
from ..operators import cohort as C
from ..operators import features as FE
from ..sources.visits import FIXTURE_CLEAN, FIXTURE_COHORT, fixture_visits
from . import oracle as O

FEATURE_CFG = FeatureConfig(schema=FIXTURE_CLEAN)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column for cross-engine hashing (same nudge as the SQL side)."""
    fixes = {
        f.name: F.round(F.col(f"`{f.name}`") + F.lit(1e-9), digits)
        for f in df.schema.fields
        if f.dataType.typeName() in ("double", "float")
    }
    return df.withColumns(fixes) if fixes else df


# ---------------------------------------------------------------- stage builders (lazy)


class _Lazy(dict):
    """Stage outputs built on first access: a query only pays plan analysis for what it uses."""

    def __init__(self, builders):
        super().__init__()
        self._b = builders

    def __missing__(self, key):
        v = self._b[key]()
        self[key] = v
        return v


_MEMO: dict = {}


def _memo(kind: str, spark: SparkSession, sf: str, build):
    """Plan handles are immutable; reuse them across queries of one session (no data is cached)."""
    try:
        app = spark.conf.get("spark.app.id", "")
    except Exception:  # noqa: BLE001
        app = ""
    key = (kind, id(spark), app, sf)
    if key not in _MEMO:
        _MEMO[key] = build()
    return _MEMO[key]


def core2(spark: SparkSession, sf: str):
    return _memo("core2", spark, sf, lambda: _core2(spark, sf))


def _core2(spark: SparkSession, sf: str):
    raw = fixture_visits(spark, sf)
    prepared = C.prepare_records(raw, FIXTURE_COHORT, placed=True)
    cohort, pre, long = C.build_windowed_records(prepared, FIXTURE_COHORT)
    plain = C.build_windowed_records(prepared, FIXTURE_COHORT, identified=False)[2]
    return raw, prepared.drop(C.PLACE), cohort, pre.drop(C.PLACE), long.drop(C.PLACE), plain


def stage2(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    raw, prepared, cohort, pre, long, _ = core2(spark, sf)
    d: dict = {}
    b = {
        "prepared": lambda: prepared,
        "patient_level_cohort": lambda: cohort,
        "pre_reference_records": lambda: pre,
        "pre_reference_records_with_windows": lambda: long,
        "temporal_completeness_flags": lambda: C.cohort_completeness(long, FIXTURE_COHORT),
        "temporal_completeness_summary": lambda: C.completeness_summary(d["temporal_completeness_flags"], FIXTURE_COHORT),
        "cohort_attrition_report": lambda: C.attrition_report(raw, prepared, long, d["temporal_completeness_flags"], FIXTURE_COHORT),
        "reference_date_audit": lambda: C.reference_date_audit(prepared, cohort, long, FIXTURE_COHORT),
        "window_distribution_report": lambda: C.window_distribution(long, FIXTURE_COHORT),
        "window_membership_report": lambda: C.membership_report(pre),
        "target_cohort_acceptance_checks": lambda: C.cohort_acceptance(cohort, long, d["temporal_completeness_flags"], d["cohort_attrition_report"], FIXTURE_COHORT),
        "target_cohort_summary": lambda: C.cohort_facts(cohort, long, d["temporal_completeness_flags"], FIXTURE_COHORT),
    }
    d = _Lazy(b)
    return d


def cleaned_records(spark: SparkSession, sf: str) -> DataFrame:
    return _memo("cleaned", spark, sf, lambda: CL.clean_records(core2(spark, sf)[5], FIXTURE_CLEAN, core2(spark, sf)[0].columns))


def stage3(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    long = core2(spark, sf)[5]
    d: dict = {}
    b = {
        "_dedup": lambda: CL.distinct_records(long, FIXTURE_CLEAN, core2(spark, sf)[0].columns),
        "_codes": lambda: CL.with_normalized_codes(d["_dedup"]),
        "_binary": lambda: CL.binary_nulling(d["_codes"]),
        "cleaned_pre_reference_records": lambda: CL.range_nulling(d["_binary"]),
        "duplicate_report": lambda: CL.drop_exact_duplicates(long)[1],  # the source columns tell copies apart as the record id does
        "diagnosis_normalization_report": lambda: CL.normalize_codes(d["_dedup"])[1],
        "binary_encoding_report": lambda: CL.apply_binary_encoding(d["_codes"])[1],
        "range_check_summary": lambda: CL.apply_range_checks(d["_binary"], FIXTURE_CLEAN)[1],
        "range_change_log": lambda: CL.range_change_log(d["_binary"], FIXTURE_CLEAN, CL.PLAUSIBLE_RANGES, [c for c in CL.PLAUSIBLE_RANGES if c in d["_binary"].columns], 10),
        "required_column_report": lambda: CL.required_column_report(d["cleaned_pre_reference_records"]),
        "binary_validation_report": lambda: CL.binary_validation_report(d["cleaned_pre_reference_records"]),
        "leakage_audit_report": lambda: CL.leakage_audit_report(d["cleaned_pre_reference_records"], FIXTURE_CLEAN),
    }
    d = _Lazy(b)
    return d


def stage5(spark: SparkSession, sf: str, persist: bool = False) -> dict[str, DataFrame]:
    return _memo("stage5", spark, sf, lambda: _stage5(spark, sf))


def stored5(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Stage 05 on the entity aggregate written once: for queries that read several of its tables."""

    def build() -> dict[str, DataFrame]:
        ensure_checkpoint_dir(spark)
        return _stage5(spark, sf, stage5(spark, sf)["entity_aggregate"].checkpoint())

    return _memo("stored5", spark, sf, build)


def _stage5(spark: SparkSession, sf: str, aggregate: DataFrame | None = None) -> dict[str, DataFrame]:
    cleaned = cleaned_records(spark, sf)
    records = FE.ensure_ratio(cleaned)
    d: dict = {}
    b = {
        "entity_aggregate": lambda: FE.entity_features(records, FEATURE_CFG) if aggregate is None else aggregate,
        "_sets": lambda: FE.feature_sets(d["entity_aggregate"], FEATURE_CFG),
        "extract_set_1": lambda: d["_sets"]["extract_set_1"],
        "extract_set_2": lambda: d["_sets"]["extract_set_2"],
        "extract_set_3": lambda: d["_sets"]["extract_set_3"],
        "single_shot": lambda: FE.single_shot(d["entity_aggregate"], FEATURE_CFG),
        "single_shot_audit": lambda: FE.single_shot_audit(d["entity_aggregate"], FEATURE_CFG),
        "temporal_completeness": lambda: FE.completeness_from(d["entity_aggregate"], FEATURE_CFG),
        "tc_hdl_audit": lambda: FE.ratio_audit(cleaned, records),
        "exclusion_report": lambda: FE.exclusion_report(records, d["temporal_completeness"], FEATURE_CFG),
        "temporal_window_usage_report": lambda: FE.window_usage_report(records, FEATURE_CFG),
        "generation_log": lambda: FE.generation_log(
            {k: d[k] for k in ("single_shot", "extract_set_1", "extract_set_2", "extract_set_3")}, FE.validate_pre_reference(records, FEATURE_CFG), "patient_id"),
    }
    d = _Lazy(b)
    return d


KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]

# ---------------------------------------------------------------- stage 02

register(
    "coh2_prepared_records",
    O.with_base("SELECT hn, vstdate, count(*) AS records, count(DISTINCT l_orderkey) AS orders FROM prepared GROUP BY hn, vstdate"),
)(lambda s, sf: C.prepare_records(fixture_visits(s, sf), FIXTURE_COHORT).groupBy("hn", "vstdate").agg(
    F.count(F.lit(1)).alias("records"), F.count_distinct("l_orderkey").alias("orders")))

register(
    "coh3_index_event_flags",
    O.with_base(
        "SELECT hn, vstdate, " + O.KEYS + ", p_hit OR c_hit AS is_index_event, "
        "CASE WHEN p_hit AND c_hit THEN 'principal_and_comorbidity' WHEN p_hit THEN 'principal' WHEN c_hit THEN 'comorbidity' ELSE '' END AS index_event_source "
        "FROM flagged"
    ),
)(lambda s, sf: C.index_flags(C.prepare_records(fixture_visits(s, sf), FIXTURE_COHORT), FIXTURE_COHORT).select(
    "hn", "vstdate", *KEYS, "is_index_event", "index_event_source"))

register("coh5_patient_cohort", O.with_base("SELECT * EXCLUDE (stroke_event_count), CAST(stroke_event_count AS BIGINT) AS stroke_event_count FROM cohort"))(
    lambda s, sf: stage2(s, sf)["patient_level_cohort"]
)

register(
    "coh6_pre_reference_records",
    O.with_base(
        "SELECT hn, vstdate, " + O.KEYS + ", stroke, reference_date, reference_rule, days_before_reference, "
        + O.r6("months_before_reference", "months_before_reference")
        + ", CAST((months_before_reference BETWEEN 9 AND 21) AS INTEGER) + CAST((months_before_reference BETWEEN 6 AND 18) AS INTEGER)"
        " + CAST((months_before_reference BETWEEN 3 AND 15) AS INTEGER) AS window_membership_count FROM pre"
    ),
)(lambda s, sf: round_doubles(stage2(s, sf)["pre_reference_records"].select(
    "hn", "vstdate", *KEYS, "stroke", "reference_date", "reference_rule", "days_before_reference", "months_before_reference", "window_membership_count")))

register(
    "coh7_window_long",
    O.with_base(
        'SELECT hn, vstdate, ' + O.KEYS + ', "window", window_lower_months_before_reference, window_upper_months_before_reference, '
        "CAST(window_membership_count AS INTEGER) AS window_membership_count, is_paper_observation_window FROM long"
    ),
)(lambda s, sf: stage2(s, sf)["pre_reference_records_with_windows"].select(
    "hn", "vstdate", *KEYS, "window", "window_lower_months_before_reference", "window_upper_months_before_reference",
    "window_membership_count", "is_paper_observation_window"))

register("coh8_temporal_completeness", O.with_base("SELECT * FROM completeness"))(
    lambda s, sf: stage2(s, sf)["temporal_completeness_flags"]
)

register(
    "coh10_attrition_report",
    O.with_base(
        """SELECT * FROM (VALUES
  (1, 'raw_input', (SELECT count(DISTINCT hn) FROM visits), (SELECT count(*) FROM visits), 0, 0, 'Raw input before Stage 02 filtering'),
  (2, 'valid_patient_and_visit_date', (SELECT count(DISTINCT hn) FROM prepared), (SELECT count(*) FROM prepared),
      (SELECT count(DISTINCT hn) FROM visits) - (SELECT count(DISTINCT hn) FROM prepared), (SELECT count(*) FROM visits) - (SELECT count(*) FROM prepared),
      'Drop rows without patient id or valid visit date and exact duplicates'),
  (3, 'pre_reference_records_only', (SELECT count(DISTINCT hn) FROM pre), (SELECT count(*) FROM pre), 0,
      (SELECT count(*) FROM prepared) - (SELECT count(*) FROM pre), 'Remove records after reference date to prevent leakage'),
  (4, 'has_any_temporal_window_record', (SELECT count(DISTINCT hn) FROM long WHERE "window" IS NOT NULL),
      (SELECT count(DISTINCT source_record_id) FROM long WHERE "window" IS NOT NULL),
      (SELECT count(DISTINCT hn) FROM pre) - (SELECT count(DISTINCT hn) FROM long WHERE "window" IS NOT NULL),
      (SELECT count(*) FROM pre) - (SELECT count(DISTINCT source_record_id) FROM long WHERE "window" IS NOT NULL),
      'Keep source records assigned to at least one overlapping FIRST/MID/LAST window'),
  (5, 'overlapping_window_long_format', (SELECT count(DISTINCT hn) FROM long WHERE "window" IS NOT NULL),
      (SELECT count(*) FROM long WHERE "window" IS NOT NULL), 0, 0,
      'Expand eligible source records to one row per overlapping window membership'),
  (6, 'temporal_complete', (SELECT count(*) FROM completeness WHERE temporal_complete),
      (SELECT count(*) FROM long WHERE "window" IS NOT NULL AND hn IN (SELECT hn FROM completeness WHERE temporal_complete)),
      (SELECT count(DISTINCT hn) FROM long WHERE "window" IS NOT NULL) - (SELECT count(*) FROM completeness WHERE temporal_complete), 0,
      'Require visit and core clinical coverage in FIRST, MID, LAST')
) t(step_order, step, patients_remaining, records_remaining, patients_removed_at_step, records_removed_at_step, reason)"""
    ).replace("\nSELECT * FROM (VALUES", "\nSELECT step_order, step, CAST(patients_remaining AS BIGINT) AS patients_remaining, CAST(records_remaining AS BIGINT) AS records_remaining, CAST(patients_removed_at_step AS BIGINT) AS patients_removed_at_step, CAST(records_removed_at_step AS BIGINT) AS records_removed_at_step, reason FROM (VALUES", 1),
)(lambda s, sf: stage2(s, sf)["cohort_attrition_report"])

register(
    "coh11_reference_date_audit",
    O.with_base(
        """SELECT c.hn, c.stroke, c.first_visit_date, c.last_visit_date, c.first_stroke_date, c.reference_date, c.reference_rule,
  coalesce((c.stroke = 1 AND c.reference_date = c.first_stroke_date) OR (c.stroke = 0 AND c.reference_date = c.last_visit_date), false) AS reference_rule_valid,
  t.total_records, coalesce(p.n, 0) AS pre_reference_records, t.total_records - coalesce(p.n, 0) AS post_reference_records_removed,
  CAST(c.stroke_event_count AS BIGINT) AS stroke_event_count, c.stroke_event_sources, c.followup_days_before_reference
FROM cohort c
LEFT JOIN (SELECT hn, count(*) AS total_records FROM prepared GROUP BY hn) t ON c.hn = t.hn
LEFT JOIN (SELECT hn, count(DISTINCT source_record_id) AS n FROM long GROUP BY hn) p ON c.hn = p.hn"""
    ),
)(lambda s, sf: stage2(s, sf)["reference_date_audit"])

register(
    "coh12_window_distribution",
    O.with_base(
        """SELECT w.word AS window_order, w.wname AS "window", w.wlo AS lower_months_before_reference, w.whi AS upper_months_before_reference,
  coalesce(s.records, 0) AS records, coalesce(s.source_records, 0) AS source_records, coalesce(s.patients, 0) AS patients,
  coalesce(s.stroke_patients, 0) AS stroke_patients, coalesce(s.nonstroke_patients, 0) AS nonstroke_patients
FROM (SELECT * FROM win UNION ALL SELECT 'OUTSIDE_WINDOWS', NULL, NULL, 4) w
LEFT JOIN (SELECT coalesce("window", 'OUTSIDE_WINDOWS') AS k, count(*) AS records, count(DISTINCT source_record_id) AS source_records,
             count(DISTINCT hn) AS patients, count(DISTINCT hn) FILTER (WHERE stroke = 1) AS stroke_patients,
             count(DISTINCT hn) FILTER (WHERE stroke = 0) AS nonstroke_patients
           FROM long GROUP BY 1) s ON s.k = w.wname"""
    ),
)(lambda s, sf: stage2(s, sf)["window_distribution_report"])

register(
    "coh13_membership_report",
    O.with_base(
        """SELECT CAST(m AS BIGINT) AS window_membership_count, count(*) AS source_records,
  CASE m WHEN 0 THEN 'outside FIRST/MID/LAST observation windows' WHEN 1 THEN 'belongs to one paper window'
         WHEN 2 THEN 'belongs to two overlapping paper windows' WHEN 3 THEN 'belongs to all FIRST/MID/LAST windows' END AS meaning
FROM (SELECT DISTINCT source_record_id, window_membership_count AS m FROM long) GROUP BY m"""
    ),
)(lambda s, sf: stage2(s, sf)["window_membership_report"])

_cs_rows = ["(1, 'patients_checked', (SELECT count(*) FROM completeness), '')"]
_i = 2
for _n in ("first", "mid", "last"):
    _cs_rows.append(f"({_i}, '{_n}_has_visit_patients', (SELECT count(*) FROM completeness WHERE {_n}_has_visit), '')")
    _cs_rows.append(f"({_i + 1}, '{_n}_has_core_clinical_patients', (SELECT count(*) FROM completeness WHERE {_n}_has_core_clinical), '')")
    _i += 2
_cs_rows.append(f"({_i}, 'temporal_complete_patients', (SELECT count(*) FROM completeness WHERE temporal_complete), 'visit and core clinical coverage in FIRST, MID, LAST')")
register(
    "coh14_completeness_summary",
    O.with_base("SELECT ordinal, metric, CAST(value AS BIGINT) AS value, detail FROM (VALUES " + ", ".join(_cs_rows) + ") t(ordinal, metric, value, detail)"),
)(lambda s, sf: stage2(s, sf)["temporal_completeness_summary"])

register(
    "coh16_cohort_facts",
    O.with_base(
        """SELECT
  (SELECT count(*) FROM cohort) AS patients,
  (SELECT count(*) FROM cohort WHERE stroke = 1) AS stroke_patients,
  (SELECT count(*) FROM cohort WHERE stroke = 0) AS nonstroke_patients,
  (SELECT coalesce(bool_and(first_stroke_date = reference_date), true) FROM cohort WHERE stroke = 1) AS stroke_reference_is_first_stroke_date,
  (SELECT coalesce(bool_and(last_visit_date = reference_date), true) FROM cohort WHERE stroke = 0) AS nonstroke_reference_is_last_visit_date,
  (SELECT coalesce(bool_and(vstdate <= reference_date), true) FROM long) AS no_post_reference_records,
  (SELECT count(DISTINCT source_record_id) FROM long) AS pre_reference_source_records,
  (SELECT count(*) FROM long) AS pre_reference_rows_after_window_expansion,
  (SELECT count(*) FROM long WHERE "window" IS NOT NULL) AS paper_observation_window_rows,
  (SELECT count(DISTINCT source_record_id) FROM long WHERE "window" IS NOT NULL) AS source_records_in_any_paper_window,
  (SELECT count(DISTINCT source_record_id) FROM long WHERE window_membership_count > 1) AS source_records_with_multiple_window_memberships,
  (SELECT count(DISTINCT hn) FROM long WHERE "window" IS NOT NULL) AS patients_in_any_paper_window,
  (SELECT string_agg(DISTINCT "window", ',' ORDER BY "window") FROM long) AS observed_windows,
  (SELECT count(*) FROM completeness WHERE temporal_complete) AS temporal_complete_patients"""
    ),
)(lambda s, sf: stage2(s, sf)["target_cohort_summary"].withColumn("observed_windows", F.array_join("observed_windows", ",")))

register(
    "coh15_cohort_acceptance",
    O.with_base(
        """SELECT * FROM (VALUES
  (1, 'stroke_reference_is_first_stroke_date', (SELECT coalesce(bool_and(first_stroke_date = reference_date), true) FROM cohort WHERE stroke = 1), 'first stroke event date'),
  (2, 'nonstroke_reference_is_last_visit_date', (SELECT coalesce(bool_and(last_visit_date = reference_date), true) FROM cohort WHERE stroke = 0), 'last clinical visit date'),
  (3, 'no_post_reference_records', (SELECT coalesce(bool_and(vstdate <= reference_date), true) FROM long), 'all output records must have visit_date <= reference_date'),
  (4, 'paper_default_windows_used', (SELECT count(DISTINCT "window") = 3 FROM long WHERE "window" IN ('FIRST', 'MID', 'LAST')),
      'observed=' || (SELECT string_agg(DISTINCT "window", ',' ORDER BY "window") FROM long) || ' expected=FIRST,LAST,MID'),
  (5, 'overlapping_window_membership_supported', (SELECT count(*) > 0 FROM long WHERE window_membership_count > 1), 'one source medical record can appear in multiple FIRST/MID/LAST rows'),
  (6, 'attrition_reports_temporal_completeness', true, 'cohort_attrition_report includes temporal_complete step'),
  (7, 'temporal_complete_cohort_reported', true, 'temporal_complete_patients=' || CAST((SELECT count(*) FROM completeness WHERE temporal_complete) AS VARCHAR))
) t(check_order, "check", passed, detail)"""
    ),
)(lambda s, sf: stage2(s, sf)["target_cohort_acceptance_checks"])

# ---------------------------------------------------------------- stage 03

register(
    "cln4_normalized_codes",
    O.with_base('SELECT patient_id, visit_date, ' + O.KEYS + ', "window", principal_diagnosis_normalized, comorbidity_diagnosis_normalized FROM cleaned'),
)(lambda s, sf: stage3(s, sf)["cleaned_pre_reference_records"].select(
    "patient_id", "visit_date", *KEYS, "window", "principal_diagnosis_normalized", "comorbidity_diagnosis_normalized"))


def _code_report_sql() -> str:
    rows = []
    for c in ("principal_diagnosis", "comorbidity_diagnosis"):
        b = f"coalesce(regexp_matches({c}, {O.IDX}), false)"
        a = f"coalesce(regexp_matches({c}_normalized, {O.IDX}), false)"
        rows.append(
            f"SELECT '{c}' AS source_column, '{c}_normalized' AS normalized_column, count({c}) AS non_null_before, "
            f"count({c}_normalized) AS non_null_after, count(*) FILTER (WHERE {b}) AS stroke_icd_hits_before, "
            f"count(*) FILTER (WHERE {a}) AS stroke_icd_hits_after, count(*) FILTER (WHERE {b} AND NOT {a}) AS stroke_icd_lost_after_normalization, "
            f"count(*) FILTER (WHERE NOT {b} AND {a}) AS stroke_icd_added_by_tokenization, "
            f"count(*) FILTER (WHERE {b} AND NOT {a}) = 0 AS stroke_icd_signal_preserved FROM cleaned"
        )
    return O.with_base(" UNION ALL ".join(rows))


register("cln5_code_normalization_report", _code_report_sql())(lambda s, sf: stage3(s, sf)["diagnosis_normalization_report"])

register(
    "cln6_duplicate_report",
    O.with_base("SELECT 'drop_exact_duplicates' AS rule, (SELECT count(*) FROM long) AS rows_before, (SELECT count(*) FROM cleaned) AS rows_after, "
                "(SELECT count(*) FROM long) - (SELECT count(*) FROM cleaned) AS rows_changed"),
)(lambda s, sf: stage3(s, sf)["duplicate_report"])

_RAWNAME = {v: k for k, v in __import__("retrospark.config", fromlist=["COLUMN_RENAME_MAP"]).COLUMN_RENAME_MAP.items()}


def _binary_sql() -> str:
    from ..config import BINARY_COLUMNS

    rows = []
    for c in BINARY_COLUMNS:
        raw = _RAWNAME.get(c, c)
        rows.append(
            f"SELECT '{c}' AS column, '{{0,1}}' AS encoding, "
            f"(SELECT count(*) FROM long WHERE {raw} IS NOT NULL AND {raw} NOT IN (0, 1)) AS invalid_values_set_missing, "
            f"(SELECT count({c}) FROM cleaned) AS non_null_after"
        )
    return O.with_base(" UNION ALL ".join(rows))


register("cln7_binary_encoding_report", _binary_sql())(lambda s, sf: stage3(s, sf)["binary_encoding_report"])

_CLEAN_RANGE_COLS = ["age", "bmi", "bps", "bpd", "hdl", "ldl", "triglyceride", "cholesterol", "fbs", "egfr", "creatinine", "days_before_reference", "months_before_reference"]


def _range_summary_sql() -> str:
    from ..config import PLAUSIBLE_RANGES

    rows = []
    for c in _CLEAN_RANGE_COLS:
        raw = _RAWNAME.get(c, c)
        lo, hi = PLAUSIBLE_RANGES[c]
        rows.append(
            f"SELECT '{c}' AS column, CAST({lo} AS DOUBLE) AS expected_min, CAST({hi} AS DOUBLE) AS expected_max, "
            f"(SELECT count(*) FROM long WHERE {raw} IS NOT NULL AND NOT ({raw} BETWEEN {lo} AND {hi})) AS invalid_values_set_missing, "
            f"(SELECT count(*) - count({c}) FROM cleaned) AS missing_after, "
            f"(SELECT {O.r6(f"CAST(min({c}) AS DOUBLE)")} FROM cleaned) AS min_after, (SELECT {O.r6(f"CAST(max({c}) AS DOUBLE)")} FROM cleaned) AS max_after"
        )
    return O.with_base(" UNION ALL ".join(rows))


register("cln8_range_check_summary", _range_summary_sql())(lambda s, sf: round_doubles(stage3(s, sf)["range_check_summary"]))


def _range_log_sql() -> str:
    from ..config import PLAUSIBLE_RANGES

    parts = []
    for c in _CLEAN_RANGE_COLS:
        raw = _RAWNAME.get(c, c)
        lo, hi = PLAUSIBLE_RANGES[c]
        parts.append(
            f"SELECT hn AS patient_id, vstdate AS visit_date, {O.KEYS}, \"window\", '{c}' AS \"column\", CAST({raw} AS DOUBLE) AS original_value, "
            f"'outside plausible range [{lo}, {hi}]' AS reason FROM long WHERE {raw} IS NOT NULL AND NOT ({raw} BETWEEN {lo} AND {hi})"
        )
    v = " UNION ALL ".join(parts)
    return O.with_base(
        f"""SELECT patient_id, visit_date, {O.KEYS}, "window", "column", {O.r6("original_value")} AS original_value, 'set_missing' AS action, reason FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY patient_id, visit_date, {O.KEYS}, "window" NULLS FIRST) AS rn FROM ({v})) WHERE rn <= 10"""
    )


register("cln8_range_change_log", _range_log_sql())(lambda s, sf: round_doubles(stage3(s, sf)["range_change_log"]))

register(
    "cln11_required_columns",
    O.with_base(
        "SELECT * FROM (VALUES (1, 'patient_id', 'available', (SELECT count(patient_id) FROM cleaned)), (2, 'visit_date', 'available', (SELECT count(visit_date) FROM cleaned)), "
        "(3, 'reference_date', 'available', (SELECT count(reference_date) FROM cleaned)), (4, 'stroke', 'available', (SELECT count(stroke) FROM cleaned)), "
        "(5, 'window', 'available', (SELECT count(\"window\") FROM cleaned))) t(ordinal, required_column, status, non_null_count)"
    ),
)(lambda s, sf: stage3(s, sf)["required_column_report"])


def _binval_sql() -> str:
    from ..config import BINARY_COLUMNS

    rows = [
        f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} IS NOT NULL AND {c} NOT IN (0, 1)) = 0 AS valid_binary_or_missing, "
        f"count(*) FILTER (WHERE {c} IS NOT NULL AND {c} NOT IN (0, 1)) AS invalid_count_after_cleaning, count({c}) AS non_null_after_cleaning FROM cleaned"
        for c in BINARY_COLUMNS
    ]
    return O.with_base(" UNION ALL ".join(rows))


register("cln12_binary_validation", _binval_sql())(lambda s, sf: stage3(s, sf)["binary_validation_report"])

register(
    "cln13_leakage_audit",
    O.with_base(
        "SELECT 'no_post_reference_records' AS \"check\", count(*) FILTER (WHERE visit_date > reference_date) = 0 AS passed, "
        "'post_reference_records=' || CAST(count(*) FILTER (WHERE visit_date > reference_date) AS VARCHAR) AS detail FROM cleaned "
        "UNION ALL SELECT 'date_columns_parseable', count(*) FILTER (WHERE visit_date IS NOT NULL AND reference_date IS NOT NULL) > 0, "
        "'valid_visit_reference_pairs=' || CAST(count(*) FILTER (WHERE visit_date IS NOT NULL AND reference_date IS NOT NULL) AS VARCHAR) FROM cleaned"
    ),
)(lambda s, sf: stage3(s, sf)["leakage_audit_report"])

# ---------------------------------------------------------------- stage 05

register(
    "fea2_ratio_audit",
    O.with_base(
        "SELECT false AS had_tc_hdl_ratio_before, true AS tc_hdl_ratio_available_after, count(*) FILTER (WHERE hdl > 0) AS hdl_positive_records, "
        "count(tc_hdl_ratio) AS tc_hdl_ratio_non_null_after, count(*) FILTER (WHERE hdl = 0) AS hdl_zero_records, true AS divide_by_zero_prevented FROM frec"
    ),
)(lambda s, sf: stage5(s, sf)["tc_hdl_audit"])

_SS_COLS = ["stroke"] + list(O.FEATURE_NUMERIC) + list(O.FEATURE_STATIC) + list(O.FEATURE_RISK)
register(
    "fea5_single_shot",
    O.with_base(
        "SELECT patient_id, " + ", ".join(
            (f"{O.r6('s.' + c)} AS baseline_{c}" if c in O.FEATURE_NUMERIC or c == "tc_hdl_ratio" else (f"s.{c} AS {c}" if c == "stroke" else f"s.{c} AS baseline_{c}"))
            for c in _SS_COLS
        ) + f" FROM (SELECT patient_id, arg_max(struct_pack({', '.join(f'{c} := {c}' for c in _SS_COLS)}), {O.ORDER}) AS s FROM frec WHERE {O.IN_ANY} GROUP BY patient_id)"
    ),
)(lambda s, sf: round_doubles(stage5(s, sf)["single_shot"]))

register(
    "fea6_single_shot_audit",
    O.with_base(f"SELECT patient_id, max(visit_date) AS latest_observation_visit_date, true AS selected_latest_observation_record FROM frec WHERE {O.IN_ANY} GROUP BY patient_id"),
)(lambda s, sf: stage5(s, sf)["single_shot_audit"])

register(
    "fea7_cleaned_completeness",
    O.with_base(O._completeness("frec", "patient_id", list(O.FEATURE_NUMERIC), "has_core_numeric", False)),
)(lambda s, sf: stage5(s, sf)["temporal_completeness"])

register("fea9_extract_set_1", O.with_base("SELECT patient_id, label AS stroke, " + ", ".join(O.set1_columns()) + " FROM ent WHERE complete"))(
    lambda s, sf: round_doubles(stage5(s, sf)["extract_set_1"])
)
register("fea11_extract_set_2", O.with_base("SELECT patient_id, label AS stroke, " + ", ".join(O.set2_columns()) + " FROM ent WHERE complete"))(
    lambda s, sf: round_doubles(stage5(s, sf)["extract_set_2"])
)
register("fea12_extract_set_3", O.with_base("SELECT patient_id, label AS stroke, " + ", ".join(O.set3_columns()) + " FROM ent WHERE complete"))(
    lambda s, sf: round_doubles(stage5(s, sf)["extract_set_3"])
)


def _exclusion_sql() -> str:
    parts = []
    for n in ("first", "mid", "last"):
        parts.append(f"CASE WHEN NOT {n}_has_visit THEN 'missing_{n}_visit' WHEN NOT {n}_has_core_numeric THEN 'missing_{n}_core_numeric' END")
    arr = "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"
    comp = O._completeness("frec", "patient_id", list(O.FEATURE_NUMERIC), "has_core_numeric", False)
    return O.with_base(
        f"SELECT patient_id, CASE WHEN len({arr}) > 0 THEN array_to_string({arr}, ';') ELSE 'not_temporal_complete' END AS reason "
        f"FROM ({comp}) WHERE NOT temporal_complete"
    )


register("fea14_exclusion_report", _exclusion_sql())(lambda s, sf: stage5(s, sf)["exclusion_report"])

register(
    "fea16_window_usage",
    O.with_base(
        """SELECT w.word AS window_order, w.wname AS "window", coalesce(s.records, 0) AS records, coalesce(s.source_records, 0) AS source_records,
  coalesce(s.patients, 0) AS patients, w.wname <> 'OUTSIDE_WINDOWS' AS used_for_temporal_features
FROM (SELECT * FROM win UNION ALL SELECT 'OUTSIDE_WINDOWS', NULL, NULL, 4) w
LEFT JOIN (SELECT coalesce("window", 'OUTSIDE_WINDOWS') AS k, count(*) AS records, count(DISTINCT source_record_id) AS source_records,
             count(DISTINCT patient_id) AS patients FROM frec GROUP BY 1) s ON s.k = w.wname"""
    ),
)(lambda s, sf: stage5(s, sf)["temporal_window_usage_report"])

register(
    "fea15_generation_log",
    O.with_base(
        f"""SELECT * FROM (VALUES
  (1, 'single_shot', (SELECT count(DISTINCT patient_id) FROM frec WHERE {O.IN_ANY}), CAST(23 AS BIGINT), true),
  (2, 'extract_set_1', (SELECT count(*) FROM ent WHERE complete), CAST(37 AS BIGINT), true),
  (3, 'extract_set_2', (SELECT count(*) FROM ent WHERE complete), CAST(117 AS BIGINT), true),
  (4, 'extract_set_3', (SELECT count(*) FROM ent WHERE complete), CAST(123 AS BIGINT), true)
) t(ordinal, artifact, rows, columns, one_row_per_patient), (SELECT coalesce(bool_and(visit_date <= reference_date), true) AS pre_reference_only FROM frec)"""
    ),
)(lambda s, sf: stage5(s, sf)["generation_log"])

# ---------------------------------------------------------------- stage 01 (audit)

from ..operators import audit as AU  # noqa: E402
from ..operators import explore as EX  # noqa: E402

VISIT_TYPES = [
    ("hn", "bigint"), ("vstdate", "timestamp_ntz"), ("PrincipleDiagnosis", "string"), ("ComorbidityDiagnosis", "string"),
    ("sex", "bigint"), ("age", "bigint"), ("smoke", "int"), ("drinking", "bigint"), ("AF", "bigint"),
    ("bps", "double"), ("bpd", "double"), ("bmi", "double"), ("HDL", "double"), ("LDL", "double"),
    ("Triglyceride", "double"), ("FBS", "double"), ("Cholesterol", "double"), ("eGFR", "double"), ("Creatinine", "double"),
    ("heart_disease", "int"), ("hypertension", "int"), ("diabetes", "int"), ("Statin", "int"), ("Gemfibrozil", "int"),
    ("Antihypertensive_flag", "int"), ("subdistrict", "string"), ("medication", "string"),
    ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
]
_RAW_ORDER = f"hn, vstdate, {O.KEYS}"


def _vstr(c: str, t: str) -> str:
    if t == "timestamp_ntz":
        return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
    return f"CAST({c} AS VARCHAR)"


def audit_stage(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    from ..sources.visits import FIXTURE_RAW

    raw = fixture_visits(spark, sf)
    d: dict = {}
    b = {
        "raw_schema_summary": lambda: AU.schema_summary(raw, FIXTURE_RAW),
        "visit_coverage": lambda: AU.visit_coverage(raw, FIXTURE_RAW),
        "visit_coverage_overview": lambda: AU.coverage_overview(d["visit_coverage"]),
        "raw_range_summary": lambda: AU.range_summary(raw),
        "icd10_availability_report": lambda: AU.code_availability(raw, FIXTURE_RAW),
        "column_availability_checklist": lambda: AU.column_availability(raw),
        "raw_acceptance_checks": lambda: AU.audit_acceptance(raw, d["column_availability_checklist"], d["visit_coverage"], d["icd10_availability_report"], FIXTURE_RAW),
        "raw_data_report": lambda: AU.audit_summary(raw, d["icd10_availability_report"], FIXTURE_RAW),
    }
    d = _Lazy(b)
    return d


def _schema_summary_sql() -> str:
    parts = []
    for i, (c, t) in enumerate(VISIT_TYPES, start=1):
        ex = (
            f"(SELECT coalesce(string_agg(v, '; ' ORDER BY rn), '') FROM (SELECT {_vstr(c, t)} AS v, row_number() OVER (ORDER BY {_RAW_ORDER}) AS rn "
            f"FROM visits WHERE {c} IS NOT NULL ORDER BY {_RAW_ORDER} LIMIT 5))"
        )
        parts.append(
            f"SELECT {i} AS ordinal, '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null_count, count(*) - count({c}) AS missing_count, "
            f"{O.r6(f'(count(*) - count({c})) / count(*)')} AS missing_percent, count(DISTINCT {_vstr(c, t)}) AS unique_count, {ex} AS example_values FROM visits"
        )
    return O.with_base(" UNION ALL ".join(parts))


register("aud2_schema_summary", _schema_summary_sql())(lambda s, sf: round_doubles(audit_stage(s, sf)["raw_schema_summary"]))

register(
    "aud6_visit_coverage",
    O.with_base("SELECT hn, count(*) AS record_count, min(vstdate) AS first_visit_date, max(vstdate) AS last_visit_date, "
                "date_diff('day', min(vstdate), max(vstdate)) AS followup_days FROM visits WHERE hn IS NOT NULL AND vstdate IS NOT NULL GROUP BY hn"),
)(lambda s, sf: audit_stage(s, sf)["visit_coverage"])

_COV = "(SELECT hn, count(*) AS r, date_diff('day', min(vstdate), max(vstdate)) AS f FROM visits GROUP BY hn)"
register(
    "aud7_coverage_overview",
    O.with_base(
        f"""SELECT ordinal, metric, {O.r6('CAST(value AS DOUBLE)')} AS value, detail FROM (
  SELECT 1 AS ordinal, 'patients_with_visit_coverage' AS metric, count(*) AS value, '' AS detail FROM {_COV}
  UNION ALL SELECT 2, 'records_per_patient_min', min(r), '' FROM {_COV}
  UNION ALL SELECT 3, 'records_per_patient_median', quantile_cont(r, 0.5), '' FROM {_COV}
  UNION ALL SELECT 4, 'records_per_patient_mean', avg(r), '' FROM {_COV}
  UNION ALL SELECT 5, 'records_per_patient_max', max(r), '' FROM {_COV}
  UNION ALL SELECT 6, 'followup_days_min', min(f), '' FROM {_COV}
  UNION ALL SELECT 7, 'followup_days_median', quantile_cont(f, 0.5), '' FROM {_COV}
  UNION ALL SELECT 8, 'followup_days_mean', avg(f), '' FROM {_COV}
  UNION ALL SELECT 9, 'followup_days_max', max(f), '' FROM {_COV}
  UNION ALL SELECT 10, 'patients_with_followup_at_least_21_months', count(*) FILTER (WHERE f >= 21 * 30.4375), 'rough screen for paper FIRST window reach' FROM {_COV}
  UNION ALL SELECT 11, 'patients_with_at_least_3_records', count(*) FILTER (WHERE r >= 3), 'rough screen for multi-window longitudinal data' FROM {_COV})"""
    ),
)(lambda s, sf: round_doubles(audit_stage(s, sf)["visit_coverage_overview"]))


def _raw_range_sql() -> str:
    from ..config import RAW_RANGE_CHECKS

    present = dict(VISIT_TYPES)
    parts = []
    for c, (lo, hi) in RAW_RANGE_CHECKS.items():
        if c not in present:
            continue
        parts.append(
            f"SELECT '{c}' AS \"column\", count({c}) AS non_null_count, {O.r6(f'min({c})')} AS min, {O.r6(f'max({c})')} AS max, "
            f"count(*) FILTER (WHERE {c} < {lo}) AS below_expected_count, count(*) FILTER (WHERE {c} > {hi}) AS above_expected_count, "
            f"CAST({lo} AS DOUBLE) AS expected_min, CAST({hi} AS DOUBLE) AS expected_max FROM visits"
        )
    return O.with_base(" UNION ALL ".join(parts))


register("aud8_range_summary", _raw_range_sql())(lambda s, sf: round_doubles(audit_stage(s, sf)["raw_range_summary"]))


def _code_avail_sql() -> str:
    parts = []
    for role, c in (("principal", "PrincipleDiagnosis"), ("comorbidity", "ComorbidityDiagnosis")):
        hit = f"coalesce(regexp_matches({c}, {O.IDX}), false)"
        ex = (
            f"(SELECT coalesce(string_agg(v, '; ' ORDER BY rn), '') FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {_RAW_ORDER}) AS rn "
            f"FROM visits WHERE {hit} ORDER BY {_RAW_ORDER} LIMIT 10))"
        )
        parts.append(
            f"SELECT '{role}' AS diagnosis_role, '{c}' AS \"column\", 'available' AS status, count({c}) AS non_null_count, "
            f"count(*) FILTER (WHERE {hit}) AS stroke_code_record_count, {ex} AS example_stroke_codes FROM visits"
        )
    return O.with_base(" UNION ALL ".join(parts))


register("aud10_code_availability", _code_avail_sql())(lambda s, sf: audit_stage(s, sf)["icd10_availability_report"])

_HITS = f"(SELECT count(*) FILTER (WHERE coalesce(regexp_matches(PrincipleDiagnosis, {O.IDX}), false)) + count(*) FILTER (WHERE coalesce(regexp_matches(ComorbidityDiagnosis, {O.IDX}), false)) FROM visits)"
register(
    "aud11_audit_acceptance",
    O.with_base(
        f"""SELECT * FROM (VALUES
  (1, 'raw_file_read_only_policy', true, 'Stage 01 reads raw data and writes audit artifacts only.'),
  (2, 'patient_identifier_found', true, 'hn'),
  (3, 'visit_date_found', true, 'vstdate'),
  (4, 'diagnosis_column_found', true, 'ComorbidityDiagnosis, PrincipleDiagnosis'),
  (5, 'icd10_i60_i68_checked', true, 'stroke_code_record_hits=' || CAST({_HITS} AS VARCHAR)),
  (6, 'expected_field_missingness_reported', true, 'missing_expected_fields=body_weight,height,tc_hdl_ratio'),
  (7, 'visit_coverage_reported', (SELECT count(DISTINCT hn) FROM visits) > 0, 'patients_with_visit_coverage=' || CAST((SELECT count(DISTINCT hn) FROM visits) AS VARCHAR))
) t(check_order, "check", passed, detail)"""
    ),
)(lambda s, sf: audit_stage(s, sf)["raw_acceptance_checks"])

register(
    "aud12_audit_summary",
    O.with_base(f"SELECT count(*) AS raw_rows, count(DISTINCT hn) AS patients, CAST({_HITS} AS BIGINT) AS stroke_code_record_hits, 31 AS raw_columns FROM visits"),
)(lambda s, sf: audit_stage(s, sf)["raw_data_report"])

# ---------------------------------------------------------------- stage 04 (EDA)


def eda_stage(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    raw, prepared, cohort, pre, long, _ = core2(spark, sf)
    cleaned = cleaned_records(spark, sf)
    comp = C.cohort_completeness(long, FIXTURE_COHORT)
    cohort_std = cohort.withColumnRenamed("hn", "patient_id")
    comp_std = comp.withColumnRenamed("hn", "patient_id")
    d: dict = {}
    b = {
        "class_imbalance": lambda: EX.class_imbalance(cohort_std),
        "visit_frequency": lambda: EX.visit_frequency(cleaned, FIXTURE_CLEAN),
        "visit_frequency_distribution": lambda: EX.visit_distribution(d["visit_frequency"]),
        "window_visit_counts": lambda: EX.window_visit_counts(cleaned, FIXTURE_CLEAN),
        "time_gap_summary": lambda: EX.time_gap_summary(cleaned, FIXTURE_CLEAN),
        "missingness_by_variable": lambda: EX.missingness_by_variable(cleaned),
        "missingness_by_stroke": lambda: EX.missingness_by_group(cleaned, "stroke"),
        "missingness_by_window": lambda: EX.missingness_by_group(cleaned, "window"),
        "temporal_coverage": lambda: EX.temporal_coverage(comp_std, C.attrition_report(raw, prepared, long, comp, FIXTURE_COHORT)),
        "window_coverage_by_label": lambda: EX.window_coverage_by_label(cleaned, FIXTURE_CLEAN),
        "temporal_complete_case_summary": lambda: EX.complete_case_summary(cohort_std, comp_std, "patient_id"),
        "clinical_descriptive_stats": lambda: EX.descriptive_stats(cleaned),
        "leakage_audit": lambda: EX.leakage_audit(cleaned, FIXTURE_CLEAN),
        "high_missing_variables": lambda: EX.high_missing_variables(d["missingness_by_variable"]),
        "sensitivity_recommendation": lambda: EX.sensitivity_recommendation(d["temporal_complete_case_summary"]),
    }
    d = _Lazy(b)
    return d


register(
    "eda1_class_imbalance",
    O.with_base("SELECT stroke, CASE stroke WHEN 0 THEN 'non_stroke' WHEN 1 THEN 'stroke' ELSE 'missing' END AS label, count(*) AS patient_count, "
                f"{O.r6('count(*) / (SELECT count(*) FROM cohort)')} AS percent FROM cohort GROUP BY stroke"),
)(lambda s, sf: round_doubles(eda_stage(s, sf)["class_imbalance"]))

register(
    "eda2_visit_frequency",
    O.with_base("SELECT patient_id, count(*) AS visit_count, min(visit_date) AS first_visit_date, max(visit_date) AS last_visit_date, "
                "date_diff('day', min(visit_date), max(visit_date)) AS followup_days FROM cleaned GROUP BY patient_id"),
)(lambda s, sf: eda_stage(s, sf)["visit_frequency"])

register(
    "eda3_visit_distribution",
    O.with_base(
        f"SELECT count(*) AS patients, {O.r6('avg(n)')} AS mean_visits, {O.r6('quantile_cont(n, 0.5)')} AS median_visits, min(n) AS min_visits, max(n) AS max_visits, "
        f"{O.r6('quantile_cont(n, 0.25)')} AS p25_visits, {O.r6('quantile_cont(n, 0.75)')} AS p75_visits FROM (SELECT patient_id, count(*) AS n FROM cleaned GROUP BY patient_id)"
    ),
)(lambda s, sf: round_doubles(eda_stage(s, sf)["visit_frequency_distribution"]))

register(
    "eda4_window_visit_counts",
    O.with_base('SELECT "window", patient_id, count(*) AS visit_count FROM cleaned WHERE "window" IS NOT NULL GROUP BY "window", patient_id'),
)(lambda s, sf: eda_stage(s, sf)["window_visit_counts"])

register(
    "eda5_time_gap_summary",
    O.with_base(
        f"""SELECT count(g) AS gap_count, {O.r6('avg(g)')} AS mean_days, {O.r6('quantile_cont(g, 0.5)')} AS median_days,
  {O.r6('quantile_cont(g, 0.25)')} AS p25_days, {O.r6('quantile_cont(g, 0.75)')} AS p75_days, max(g) AS max_days
FROM (SELECT date_diff('day', lag(visit_date) OVER (PARTITION BY patient_id ORDER BY visit_date), visit_date) AS g FROM cleaned) WHERE g IS NOT NULL"""
    ),
)(lambda s, sf: round_doubles(eda_stage(s, sf)["time_gap_summary"]))


def _cleaned_columns() -> list[str]:
    ren = {k: v for k, v in __import__("retrospark.config", fromlist=["x"]).COLUMN_RENAME_MAP.items()}
    raw = [c for c, _ in VISIT_TYPES if c != "subdistrict"]
    cols = [ren.get(c, c) for c in raw] + [
        "stroke", "reference_date", "reference_rule", "source_record_id", "days_before_reference", "months_before_reference",
        "window_membership_count", "window", "window_lower_months_before_reference", "window_upper_months_before_reference",
        "is_paper_observation_window", "principal_diagnosis_normalized", "comorbidity_diagnosis_normalized",
    ]
    return cols


def _missing_by_var_sql() -> str:
    parts = [
        f"SELECT '{c}' AS \"column\", count(*) - count(\"{c}\") AS missing_count, {O.r6(f'(count(*) - count(\"{c}\")) / count(*)')} AS missing_percent FROM cleaned"
        for c in _cleaned_columns()
    ]
    return O.with_base(" UNION ALL ".join(parts))


register("eda6_missingness_by_variable", _missing_by_var_sql())(
    lambda s, sf: round_doubles(eda_stage(s, sf)["missingness_by_variable"].drop("ordinal"))
)


def _missing_by_group_sql(group: str) -> str:
    from ..config import EDA_NUMERIC

    present = [c for c in EDA_NUMERIC if c != "tc_hdl_ratio"]
    parts = [
        f"SELECT \"{group}\", '{c}' AS \"column\", count(*) AS records, count(*) - count({c}) AS missing_count, "
        f"{O.r6(f'(count(*) - count({c})) / count(*)')} AS missing_percent FROM cleaned GROUP BY \"{group}\""
        for c in present
    ]
    return O.with_base(" UNION ALL ".join(parts))


register("eda7_missingness_by_window", _missing_by_group_sql("window"))(lambda s, sf: round_doubles(eda_stage(s, sf)["missingness_by_window"]))
register("eda7_missingness_by_label", _missing_by_group_sql("stroke"))(lambda s, sf: round_doubles(eda_stage(s, sf)["missingness_by_stroke"]))

register(
    "eda8_temporal_coverage",
    O.with_base(
        f"""SELECT * FROM (VALUES
  (1, 'patients_with_temporal_completeness_row', (SELECT count(*) FROM completeness), 1.0),
  (2, 'temporal_complete_patients', (SELECT count(*) FROM completeness WHERE temporal_complete), (SELECT {O.r6('count(*) FILTER (WHERE temporal_complete) / count(*)')} FROM completeness)),
  (3, 'first_has_visit', (SELECT count(*) FROM completeness WHERE first_has_visit), (SELECT {O.r6('count(*) FILTER (WHERE first_has_visit) / count(*)')} FROM completeness)),
  (4, 'mid_has_visit', (SELECT count(*) FROM completeness WHERE mid_has_visit), (SELECT {O.r6('count(*) FILTER (WHERE mid_has_visit) / count(*)')} FROM completeness)),
  (5, 'last_has_visit', (SELECT count(*) FROM completeness WHERE last_has_visit), (SELECT {O.r6('count(*) FILTER (WHERE last_has_visit) / count(*)')} FROM completeness)),
  (6, 'attrition_final_step_temporal_complete', (SELECT count(*) FROM completeness WHERE temporal_complete), NULL)
) t(ordinal, metric, patient_count, percent)"""
    ).replace("SELECT * FROM (VALUES\n  (1, 'patients_with_temporal", "SELECT ordinal, metric, CAST(patient_count AS BIGINT) AS patient_count, CAST(percent AS DOUBLE) AS percent FROM (VALUES\n  (1, 'patients_with_temporal", 1),
)(lambda s, sf: round_doubles(eda_stage(s, sf)["temporal_coverage"]))

register(
    "eda9_window_coverage_by_label",
    O.with_base(
        """SELECT w.word AS window_order, w.wname AS "window", coalesce(records, 0) AS records, coalesce(patients, 0) AS patients,
  coalesce(nonstroke_records, 0) AS nonstroke_records, coalesce(nonstroke_patients, 0) AS nonstroke_patients,
  coalesce(stroke_records, 0) AS stroke_records, coalesce(stroke_patients, 0) AS stroke_patients
FROM (SELECT * FROM win UNION ALL SELECT 'OUTSIDE_WINDOWS', NULL, NULL, 4) w
LEFT JOIN (SELECT coalesce("window", 'OUTSIDE_WINDOWS') AS k, count(*) AS records, count(DISTINCT patient_id) AS patients,
  count(*) FILTER (WHERE stroke = 0) AS nonstroke_records, count(DISTINCT patient_id) FILTER (WHERE stroke = 0) AS nonstroke_patients,
  count(*) FILTER (WHERE stroke = 1) AS stroke_records, count(DISTINCT patient_id) FILTER (WHERE stroke = 1) AS stroke_patients
  FROM cleaned GROUP BY 1) s ON s.k = w.wname"""
    ),
)(lambda s, sf: eda_stage(s, sf)["window_coverage_by_label"])

_CASES = f"""SELECT 'all_patient_level_cohort' AS "group", count(*) AS patients, count(*) FILTER (WHERE stroke = 1) AS stroke_patients,
  count(*) FILTER (WHERE stroke = 0) AS nonstroke_patients, {O.r6('count(*) FILTER (WHERE stroke = 1) / count(*)')} AS stroke_prevalence FROM cohort
UNION ALL
SELECT 'temporal_complete', count(*), count(*) FILTER (WHERE stroke = 1), count(*) FILTER (WHERE stroke = 0),
  {O.r6('CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE stroke = 1) / count(*) ELSE 0.0 END')} FROM cohort WHERE hn IN (SELECT hn FROM completeness WHERE temporal_complete)"""
register("eda10_complete_case_summary", O.with_base(_CASES))(lambda s, sf: round_doubles(eda_stage(s, sf)["temporal_complete_case_summary"]))


def _describe_sql() -> str:
    from ..config import EDA_NUMERIC

    present = [c for c in EDA_NUMERIC if c != "tc_hdl_ratio"]
    unp = " UNION ALL ".join(f"SELECT '{c}' AS col, stroke, CAST({c} AS DOUBLE) AS v FROM cleaned WHERE {c} IS NOT NULL" for c in present)
    return O.with_base(
        f"""SELECT col AS "column", CASE WHEN grouping(stroke) = 1 THEN 'all' ELSE CAST(stroke AS VARCHAR) END AS stroke, count(v) AS count,
  {O.r6('avg(v)')} AS mean, {O.r6('CASE WHEN count(v) > 1 THEN stddev_samp(v) END')} AS std, {O.r6('min(v)')} AS min,
  {O.r6('quantile_cont(v, 0.25)')} AS p25, {O.r6('quantile_cont(v, 0.5)')} AS median, {O.r6('quantile_cont(v, 0.75)')} AS p75, {O.r6('max(v)')} AS max
FROM ({unp}) GROUP BY GROUPING SETS ((col, stroke), (col))"""
    )


register("eda11_descriptive_stats", _describe_sql())(lambda s, sf: round_doubles(eda_stage(s, sf)["clinical_descriptive_stats"]))

register(
    "eda12_leakage_audit",
    O.with_base("SELECT 'no_post_reference_records' AS \"check\", count(*) FILTER (WHERE visit_date > reference_date) = 0 AS passed, "
                "count(*) FILTER (WHERE visit_date > reference_date) AS failed_record_count FROM cleaned"),
)(lambda s, sf: eda_stage(s, sf)["leakage_audit"])

def _missing_union() -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count(\"{c}\") AS missing_count, {O.r6(f'(count(*) - count(\"{c}\")) / count(*)')} AS missing_percent FROM cleaned"
        for c in _cleaned_columns()
    )


register(
    "eda13_high_missing_variables",
    O.with_base("SELECT * FROM (" + _missing_union() + ") WHERE missing_percent >= 0.5"),
)(lambda s, sf: round_doubles(eda_stage(s, sf)["high_missing_variables"].drop("ordinal")))

register(
    "eda14_sensitivity_recommendation",
    O.with_base(
        f"""SELECT s < 2 AS recommend_sensitivity_analysis,
  CASE WHEN s < 2 THEN 'strict FIRST/MID/LAST temporal-complete cohort has too few stroke cases for reliable modeling'
       ELSE 'strict FIRST/MID/LAST temporal-complete cohort has enough stroke cases for minimal modeling' END AS reason,
  p AS temporal_complete_patients, s AS temporal_complete_stroke_patients,
  '90/180 days as sensitivity analysis; keep paper windows as primary baseline' AS suggested_fallback_windows
FROM (SELECT count(*) AS p, count(*) FILTER (WHERE stroke = 1) AS s FROM cohort WHERE hn IN (SELECT hn FROM completeness WHERE temporal_complete))"""
    ),
)(lambda s, sf: eda_stage(s, sf)["sensitivity_recommendation"])

# ---------------------------------------------------------------- stages 06/08 (evaluation on predictions)

from ..operators import evaluate as EV  # noqa: E402
from ..sources.predictions import fixture_predictions  # noqa: E402

PRED_CTE = """preds AS (
  SELECT l.doc_id AS patient_id, 'single_shot' AS model_name, l.doc_id % 5 AS fold, l.quality AS y_true,
         CAST((d.n_chars % 100) / 100.0 AS DOUBLE) AS y_prob FROM labels l JOIN documents d ON l.doc_id = d.doc_id
  UNION ALL
  SELECT l.doc_id, 'extract_set_1', l.doc_id % 5, l.quality, CAST(((l.doc_id * 37) % 100) / 100.0 AS DOUBLE)
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
p2 AS (SELECT *, CAST(y_prob >= 0.5 AS INTEGER) AS y_pred FROM preds),
conf AS (
  SELECT model_name, count(*) FILTER (WHERE y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS fp,
         count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp
  FROM p2 GROUP BY model_name),
conf2 AS (
  SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS sensitivity, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END AS specificity FROM conf),
dist AS (SELECT model_name, y_prob AS score, count(*) FILTER (WHERE y_true = 1) AS pos, count(*) FILTER (WHERE y_true = 0) AS neg FROM p2 GROUP BY model_name, y_prob),
cum AS (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY model_name ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
         sum(pos) OVER (PARTITION BY model_name ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp_ge,
         sum(neg) OVER (PARTITION BY model_name ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp_ge,
         sum(pos) OVER (PARTITION BY model_name) AS P, sum(neg) OVER (PARTITION BY model_name) AS N
  FROM dist),
rank_m AS (
  SELECT model_name,
    CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(pos * (neg_below + 0.5 * neg)) / (max(P) * max(N)) END AS roc_auc,
    CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(CASE WHEN pos > 0 THEN pos * tp_ge / (tp_ge + fp_ge) END) / max(P) END AS pr_auc
  FROM cum GROUP BY model_name),
metrics AS (
  SELECT c.model_name, c.tn, c.fp, c.fn, c.tp, c.sensitivity, c.specificity,
         sqrt(greatest(c.sensitivity, 0.0) * greatest(c.specificity, 0.0)) AS g_mean, r.roc_auc, r.pr_auc
  FROM conf2 c LEFT JOIN rank_m r ON c.model_name = r.model_name)"""


def _metrics_cols(prefix: str = "") -> str:
    return ("model_name, tn, fp, fn, tp, " + ", ".join(O.r6(c, c) for c in ("sensitivity", "specificity", "g_mean", "roc_auc", "pr_auc")))


def eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return EV.metrics_table(fixture_predictions(spark, sf))


register("mod9_val1_metrics", O.with_base(f"SELECT {_metrics_cols()} FROM metrics", PRED_CTE))(lambda s, sf: round_doubles(eval_metrics(s, sf)))
register("val2_confusion_table", O.with_base("SELECT model_name, tn, fp, fn, tp FROM metrics", PRED_CTE))(lambda s, sf: EV.confusion_table(eval_metrics(s, sf)))
register("val3_roc_pr_table", O.with_base(f"SELECT model_name, {O.r6('roc_auc', 'roc_auc')}, {O.r6('pr_auc', 'pr_auc')} FROM metrics", PRED_CTE))(
    lambda s, sf: round_doubles(EV.roc_pr_table(eval_metrics(s, sf)))
)
register(
    "val4_best_temporal_model",
    O.with_base("SELECT (SELECT model_name FROM metrics WHERE model_name <> 'single_shot' ORDER BY g_mean DESC NULLS LAST, model_name LIMIT 1) AS best_temporal_model", PRED_CTE),
)(lambda s, sf: EV.best_temporal_model(eval_metrics(s, sf)))
register(
    "val5_baseline_vs_temporal",
    O.with_base(f"SELECT {_metrics_cols()}, CASE WHEN model_name = 'single_shot' THEN 'baseline' ELSE 'temporal' END AS model_group FROM metrics", PRED_CTE),
)(lambda s, sf: round_doubles(EV.baseline_vs_temporal(eval_metrics(s, sf))))

_ERFC = "(t * exp(-z * z - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277))))))))))"
def _mcnemar_sql(challenger: str) -> str:
    return O.with_base(
        f"""SELECT CASE WHEN n = 0 OR b + c = 0 THEN 'skipped' ELSE 'completed' END AS status,
  CASE WHEN n = 0 THEN 'no_overlap_patients_between_models' WHEN b + c = 0 THEN 'no_disagreement' ELSE '' END AS reason,
  n AS overlap_patients, b AS b_baseline_correct_challenger_wrong, c AS c_baseline_wrong_challenger_correct,
  {O.r6('CASE WHEN n = 0 THEN NULL WHEN b + c = 0 THEN 0.0 ELSE chi END')} AS chi_square,
  {O.r6('CASE WHEN n = 0 THEN NULL WHEN b + c = 0 THEN 1.0 ELSE p END')} AS p_value,
  'single_shot' AS baseline_model, {challenger} AS challenger_model
FROM (SELECT *, {_ERFC} AS p FROM (SELECT *, 1.0 / (1.0 + 0.5 * z) AS t FROM (SELECT *, sqrt(greatest(chi, 0.0) / 2.0) AS z FROM (
  SELECT n, b, c, CASE WHEN b + c > 0 THEN power(abs(b - c) - 1.0, 2) / (b + c) END AS chi FROM (
    SELECT count(*) AS n, count(*) FILTER (WHERE x.y_pred = x.y_true AND y.y_pred <> y.y_true) AS b,
           count(*) FILTER (WHERE x.y_pred <> x.y_true AND y.y_pred = y.y_true) AS c
    FROM p2 x JOIN p2 y ON x.patient_id = y.patient_id AND x.y_true = y.y_true
    WHERE x.model_name = 'single_shot' AND y.model_name = {challenger})))))""",
        PRED_CTE,
    )


register("val6_mcnemar", _mcnemar_sql("'extract_set_1'"))(lambda s, sf: round_doubles(EV.mcnemar(fixture_predictions(s, sf), "single_shot", "extract_set_1")))
register(
    "val6_mcnemar_vs_best",
    _mcnemar_sql("(SELECT model_name FROM metrics WHERE model_name <> 'single_shot' ORDER BY g_mean DESC NULLS LAST, model_name LIMIT 1)"),
)(lambda s, sf: round_doubles(EV.mcnemar_vs_best(fixture_predictions(s, sf), eval_metrics(s, sf))))

# ---------------------------------------------------------------- stage 06/07 on the feature tables

from ..config import ModelConfig  # noqa: E402
from ..operators import foldfit as FF  # noqa: E402
from ..operators import folds as FO  # noqa: E402
from ..operators import inference as IN  # noqa: E402
from ..operators import model as MO  # noqa: E402
from ..operators import select as SE  # noqa: E402

MODEL_CFG = ModelConfig(entity="patient_id", label="stroke", cv_strategy="auto")
_S1_FEATS = [f"{w.lower()}_{c}_mean" for w in ("FIRST", "MID", "LAST") for c in O.FEATURE_NUMERIC] + [f"latest_{c}" for c in O.FEATURE_STATIC]
_S1_LIST = ", ".join(_S1_FEATS)
SET1_CTE = (
    "set1 AS (SELECT patient_id, label AS stroke, "
    + ", ".join([f"CAST({w.lower()}_{c}_mean AS DOUBLE) AS {w.lower()}_{c}_mean" for w in ("FIRST", "MID", "LAST") for c in O.FEATURE_NUMERIC]
                + [f"CAST(latest_{c} AS DOUBLE) AS latest_{c}" for c in O.FEATURE_STATIC])
    + " FROM ent WHERE complete),\n"
    "cvp AS (SELECT sum(c) AS n, least(5, min(c)) AS k FROM (SELECT stroke, count(*) AS c FROM set1 GROUP BY stroke)),\n"
    "folded AS (SELECT s.*, CAST(CASE WHEN (SELECT sum(n) FROM cvp) <= 200 THEN row_number() OVER (ORDER BY md5(CAST(patient_id AS VARCHAR) || ':42')) - 1\n"
    "  ELSE (row_number() OVER (PARTITION BY stroke ORDER BY md5(CAST(patient_id AS VARCHAR) || ':42')) - 1) % (SELECT max(k) FROM cvp) END AS INTEGER) AS fold FROM set1 s),\n"
    "tc AS (SELECT f.*, CAST(t.tf AS INTEGER) AS train_fold FROM folded f JOIN range((SELECT max(fold) + 1 FROM folded)) t(tf) ON t.tf <> f.fold),\n"
    "unp AS (" + " UNION ALL ".join(f"SELECT train_fold, stroke, '{c}' AS feature, {c} AS value FROM tc" for c in _S1_FEATS) + "),\n"
    "med AS (SELECT train_fold, feature, quantile_cont(value, 0.5) AS median FROM unp GROUP BY train_fold, feature)"
)


def set1_folded(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str], FO.CvPolicy]:
    return _memo("set1_folded", spark, sf, lambda: _set1_folded(spark, sf))


def _set1_folded(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str], FO.CvPolicy]:
    ensure_checkpoint_dir(spark)
    mat = FO.feature_matrix(stage5(spark, sf)["extract_set_1"], MODEL_CFG).checkpoint()
    policy = FO.choose_cv(mat, MODEL_CFG)
    folded = FO.assign_folds(mat, policy, MODEL_CFG).checkpoint()  # ranked once; the statistics read it several times
    return folded, FO.feature_columns(mat, MODEL_CFG), policy


register("mod3_stratified_folds", O.with_base("SELECT patient_id, stroke, fold FROM folded", SET1_CTE))(
    lambda s, sf: set1_folded(s, sf)[0].select("patient_id", "stroke", "fold")
)
register("mod4_fold_overlap_guard", O.with_base("SELECT patient_id, count(DISTINCT fold) AS folds FROM folded GROUP BY patient_id HAVING count(DISTINCT fold) > 1", SET1_CTE))(
    lambda s, sf: FO.overlap_guard(set1_folded(s, sf)[0], MODEL_CFG)
)


def _mod5(s: SparkSession, sf: str) -> DataFrame:
    folded, feats, policy = set1_folded(s, sf)
    return round_doubles(FO.fold_medians(folded, feats, policy.folds))


register("mod5_fold_medians", O.with_base(f"SELECT train_fold, feature, {O.r6('median', 'median')} FROM med", SET1_CTE))(_mod5)


def _mod6(s: SparkSession, sf: str) -> DataFrame:
    folded, feats, policy = set1_folded(s, sf)
    return round_doubles(FO.fold_statistics(folded, feats, policy.folds))


register(
    "mod6_fold_scaling",
    O.with_base(
        f"""SELECT train_fold, feature, {O.r6('avg(v)', 'mean')}, {O.r6('stddev_pop(v)', 'std')},
  {O.r6('CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1.0 END', 'scale')}, {O.r6('max(median)', 'median')}
FROM (SELECT u.train_fold, u.feature, coalesce(u.value, m.median) AS v, m.median FROM unp u JOIN med m USING (train_fold, feature) WHERE m.median IS NOT NULL)
GROUP BY train_fold, feature""",
        SET1_CTE,
    ),
)(_mod6)

_ANOVA_SQL = """unp0 AS ({unp0}),
gmed AS (SELECT feature, quantile_cont(value, 0.5) AS m FROM unp0 GROUP BY feature),
cls AS (SELECT u.feature, u.stroke, count(*) AS n, sum(coalesce(u.value, g.m)) AS s, sum(coalesce(u.value, g.m) * coalesce(u.value, g.m)) AS ss
        FROM unp0 u JOIN gmed g USING (feature) WHERE g.m IS NOT NULL GROUP BY u.feature, u.stroke),
tot AS (SELECT feature, sum(n) AS N, sum(s) AS S, count(*) AS k, sum(s * s / n) AS br, sum(ss) AS SS FROM cls GROUP BY feature),
fsc AS (SELECT feature, CASE WHEN SS - br > 0 AND k > 1 AND N > k THEN ((br - S * S / N) / (k - 1)) / ((SS - br) / (N - k))
                        WHEN br - S * S / N > 0 THEN 'Infinity'::DOUBLE END AS f_score FROM tot)""".replace(
    "{unp0}", " UNION ALL ".join(f"SELECT stroke, '{c}' AS feature, {c} AS value FROM set1" for c in _S1_FEATS))
register(
    "imp1_anova_ranking",
    O.with_base(f"SELECT feature, {O.r6('f_score', 'f_score')}, row_number() OVER (ORDER BY round(f_score, 6) DESC NULLS LAST, feature) AS rank FROM fsc", SET1_CTE + ",\n" + _ANOVA_SQL),
)(lambda s, sf: round_doubles(SE.anova_ranking(stage5(s, sf)["extract_set_1"], MODEL_CFG, with_p=False)))

# the continued fraction of the incomplete beta as a reduction over 400 steps
_PVALUE_SQL = """bt AS (SELECT feature, f_score, (N - k) / 2.0 AS a, (k - 1) / 2.0 AS b, (N - k) / ((N - k) + (k - 1) * f_score) AS x FROM fsc JOIN tot USING (feature)),
bs AS (SELECT *, x >= (a + 1) / (a + b + 2) AS flip FROM bt),
bp AS (SELECT feature, f_score, x, flip, CASE WHEN flip THEN b ELSE a END AS p, CASE WHEN flip THEN a ELSE b END AS r, CASE WHEN flip THEN 1 - x ELSE x END AS t FROM bs),
bf AS (SELECT *, list_reduce(list_prepend({'m': 0.0::DOUBLE, 'c': 1.0::DOUBLE, 'd': (1 / (1 - (p + r) * t / (p + 1)))::DOUBLE, 'h': (1 / (1 - (p + r) * t / (p + 1)))::DOUBLE},
    list_transform(range(1, 401), lambda i: {'m': i::DOUBLE, 'c': 0.0::DOUBLE, 'd': 0.0::DOUBLE, 'h': 0.0::DOUBLE})),
  lambda s, e: {'m': e.m,
    'c': (1 - (p + e.m) * (p + r + e.m) * t / ((p + 2 * e.m) * (p + 2 * e.m + 1)) / (1 + e.m * (r - e.m) * t / ((p + 2 * e.m - 1) * (p + 2 * e.m)) / s.c))::DOUBLE,
    'd': (1 / (1 - (p + e.m) * (p + r + e.m) * t / ((p + 2 * e.m) * (p + 2 * e.m + 1)) / (1 + e.m * (r - e.m) * t / ((p + 2 * e.m - 1) * (p + 2 * e.m)) * s.d)))::DOUBLE,
    'h': (s.h / (1 + e.m * (r - e.m) * t / ((p + 2 * e.m - 1) * (p + 2 * e.m)) * s.d) * (1 + e.m * (r - e.m) * t / ((p + 2 * e.m - 1) * (p + 2 * e.m)) / s.c)
      / (1 - (p + e.m) * (p + r + e.m) * t / ((p + 2 * e.m) * (p + 2 * e.m + 1)) / (1 + e.m * (r - e.m) * t / ((p + 2 * e.m - 1) * (p + 2 * e.m)) * s.d))
      * (1 - (p + e.m) * (p + r + e.m) * t / ((p + 2 * e.m) * (p + 2 * e.m + 1)) / (1 + e.m * (r - e.m) * t / ((p + 2 * e.m - 1) * (p + 2 * e.m)) / s.c)))::DOUBLE}).h AS h FROM bp),
pv AS (SELECT *, exp(lgamma(p + r) - lgamma(p) - lgamma(r) + p * ln(t) + r * ln(1 - t)) * h / p AS v FROM bf)"""
register(
    "imp1_anova_pvalues",
    O.with_base(
        f"SELECT feature, {O.r6('f_score', 'f_score')}, row_number() OVER (ORDER BY round(f_score, 6) DESC NULLS LAST, feature) AS rank, "
        f"{O.r6('CASE WHEN flip THEN 1 - v ELSE v END', 'p_value')} FROM pv",
        SET1_CTE + ",\n" + _ANOVA_SQL + ",\n" + _PVALUE_SQL,
    ),
)(lambda s, sf: round_doubles(SE.anova_ranking(stage5(s, sf)["extract_set_1"], MODEL_CFG, with_p=True)))


def _imp3(s: SparkSession, sf: str) -> DataFrame:
    folded, feats, policy = set1_folded(s, sf)
    return round_doubles(SE.fold_anova_topk(folded, feats, policy.folds, 10, MODEL_CFG))


_FOLD_ANOVA = """cls2 AS (SELECT u.train_fold, u.feature, u.stroke, count(*) AS n, sum(coalesce(u.value, m.median)) AS s,
                sum(coalesce(u.value, m.median) * coalesce(u.value, m.median)) AS ss
         FROM unp u JOIN med m USING (train_fold, feature) WHERE m.median IS NOT NULL GROUP BY u.train_fold, u.feature, u.stroke),
tot2 AS (SELECT train_fold, feature, sum(n) AS N, sum(s) AS S, count(*) AS k, sum(s * s / n) AS br, sum(ss) AS SS FROM cls2 GROUP BY train_fold, feature),
fsc2 AS (SELECT train_fold, feature, CASE WHEN SS - br > 0 AND k > 1 AND N > k THEN ((br - S * S / N) / (k - 1)) / ((SS - br) / (N - k))
                        WHEN br - S * S / N > 0 THEN 'Infinity'::DOUBLE END AS f_score FROM tot2)"""
register(
    "imp3_fold_anova_top10",
    O.with_base(
        f"SELECT train_fold, feature, {O.r6('f_score', 'f_score')}, rank FROM (SELECT *, row_number() OVER (PARTITION BY train_fold ORDER BY round(f_score, 6) DESC NULLS LAST, feature) AS rank FROM fsc2) WHERE rank <= 10",
        SET1_CTE + ",\n" + _FOLD_ANOVA,
    ),
)(_imp3)


def _mod8(s: SparkSession, sf: str) -> DataFrame:
    preds, _ = MO.train_predict_cv(stage5(s, sf)["extract_set_1"], "extract_set_1", MODEL_CFG)
    return preds


register("mod8_oof_predictions_set1", None)(_mod8)

# ---------------------------------------------------------------- documented extensions (DOC1-DOC6)

from ..config import MONTH_DAYS  # noqa: E402
from ..streaming import drift as DR  # noqa: E402

# DOC1: alternative look-back windows in days: 180-day windows shifted by 90 days.
ALT_DAY_WINDOWS = (("FIRST", 270, 450), ("MID", 180, 360), ("LAST", 90, 270))
ALT_COHORT = C.CohortConfig(schema=FIXTURE_COHORT.schema, windows=tuple((n, lo / MONTH_DAYS, hi / MONTH_DAYS) for n, lo, hi in ALT_DAY_WINDOWS))


def _doc1(s: SparkSession, sf: str) -> DataFrame:
    prepared = C.prepare_records(fixture_visits(s, sf), FIXTURE_COHORT)
    parts = []
    for label, cfg in (("paper_months", FIXTURE_COHORT), ("days_90_180", ALT_COHORT)):
        _, _, long = C.build_windowed_records(prepared, cfg)
        parts.append(C.completeness_summary(C.cohort_completeness(long, cfg), cfg).withColumn("window_set", F.lit(label)))
    return parts[0].unionByName(parts[1])


def _alt_completeness_sql() -> str:
    conds = {n: f"date_diff('day', p.vstdate, c.reference_date) BETWEEN {lo} AND {hi}" for n, lo, hi in ALT_DAY_WINDOWS}
    core = O.RAW_CORE_NUMERIC
    per = []
    for n in ("FIRST", "MID", "LAST"):
        vis = f"count(*) FILTER (WHERE {conds[n]}) > 0"
        cor = " AND ".join(f"count({x}) FILTER (WHERE {conds[n]}) > 0" for x in core)
        per.append((n.lower(), vis, cor))
    cols = ", ".join(f"{vis} AS {p}_has_visit, ({cor}) AS {p}_has_core_clinical" for p, vis, cor in per)
    comp = " AND ".join(f"({vis} AND {cor})" for _, vis, cor in per)
    return f"SELECT p.hn, {cols}, ({comp}) AS temporal_complete FROM prepared p JOIN cohort c ON p.hn = c.hn WHERE p.vstdate <= c.reference_date GROUP BY p.hn"


def _summary_rows(src: str, label: str) -> str:
    rows = [f"SELECT 1 AS ordinal, 'patients_checked' AS metric, count(*) AS value, '' AS detail, '{label}' AS window_set FROM {src}"]
    i = 2
    for p in ("first", "mid", "last"):
        rows.append(f"SELECT {i}, '{p}_has_visit_patients', count(*) FILTER (WHERE {p}_has_visit), '', '{label}' FROM {src}")
        rows.append(f"SELECT {i + 1}, '{p}_has_core_clinical_patients', count(*) FILTER (WHERE {p}_has_core_clinical), '', '{label}' FROM {src}")
        i += 2
    rows.append(f"SELECT {i}, 'temporal_complete_patients', count(*) FILTER (WHERE temporal_complete), 'visit and core clinical coverage in FIRST, MID, LAST', '{label}' FROM {src}")
    return " UNION ALL ".join(rows)


register(
    "doc1_window_sensitivity",
    O.with_base("SELECT * FROM (" + _summary_rows("completeness", "paper_months") + " UNION ALL " + _summary_rows("alt", "days_90_180") + ")",
                "alt AS (" + _alt_completeness_sql() + ")"),
)(_doc1)


def _doc2(s: SparkSession, sf: str) -> DataFrame:
    cfg = C.CohortConfig(schema=FIXTURE_COHORT.schema, min_core=5)
    long = stage2(s, sf)["pre_reference_records_with_windows"]
    return C.temporal_completeness(long, "hn", cfg.window_names, list(cfg.core_numeric), min_core=5).select("hn", "first_has_core_clinical", "mid_has_core_clinical", "last_has_core_clinical", "temporal_complete")


def _relaxed_sql() -> str:
    parts = []
    comp = []
    for n in ("FIRST", "MID", "LAST"):
        seen = " + ".join(f"CAST(count({x}) FILTER (WHERE \"window\" = '{n}') > 0 AS INTEGER)" for x in O.RAW_CORE_NUMERIC)
        parts.append(f"({seen}) >= 5 AS {n.lower()}_has_core_clinical")
        comp.append(f"(count(*) FILTER (WHERE \"window\" = '{n}') > 0 AND ({seen}) >= 5)")
    return "SELECT hn, " + ", ".join(parts) + ", (" + " AND ".join(comp) + ") AS temporal_complete FROM long GROUP BY hn"


register("doc2_relaxed_completeness", O.with_base(_relaxed_sql()))(_doc2)


def _doc3(s: SparkSession, sf: str) -> DataFrame:
    st5 = stage5(s, sf)
    return IN.routes(st5["temporal_completeness"], st5["single_shot"], MODEL_CFG)


register(
    "doc3_inference_routing",
    O.with_base(
        f"""SELECT e.patient_id, CASE WHEN e.complete THEN 'temporal' WHEN s.patient_id IS NOT NULL THEN 'single_shot' ELSE 'insufficient_history' END AS route
FROM ent e LEFT JOIN (SELECT DISTINCT patient_id FROM frec WHERE {O.IN_ANY}) s ON e.patient_id = s.patient_id"""
    ),
)(_doc3)


def _doc4(s: SparkSession, sf: str) -> DataFrame:
    ev = s.read.parquet(f"{sf}/events.parquet")
    prof = DR.period_profile(ev, "ts", "user_id", ["value"], None, "day")
    return round_doubles(DR.drift_vs_reference(prof))


register(
    "doc4_event_drift_by_day",
    O.with_base(
        f"""SELECT period, records, entities, {O.r6('value_available', 'value_available')}, {O.r6('records_per_entity', 'records_per_entity')},
  records - first_value(records) OVER w AS records_drift, entities - first_value(entities) OVER w AS entities_drift,
  {O.r6('value_available - first_value(value_available) OVER w', 'value_available_drift')},
  {O.r6('records_per_entity - first_value(records_per_entity) OVER w', 'records_per_entity_drift')}
FROM (SELECT date_trunc('day', ts) AS period, count(*) AS records, count(DISTINCT user_id) AS entities,
        avg(CAST(value IS NOT NULL AS DOUBLE)) AS value_available, count(*) / count(DISTINCT user_id) AS records_per_entity FROM events GROUP BY 1)
WINDOW w AS (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
    ),
)(_doc4)



def _quarterly(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The test predictions, made at the first visit of their entity; labels become known at its reference date."""
    cohort = stage2(s, sf)["patient_level_cohort"].select(F.col("hn").alias("patient_id"), "first_visit_date", "reference_date")
    preds = fixture_predictions(s, sf).join(cohort, "patient_id")
    made = preds.select("patient_id", "model_name", "y_pred", "y_prob", F.col("first_visit_date").alias("made_at"))
    return made, preds.select("patient_id", F.col("reference_date").alias("known_at"), "y_true").distinct()


def _doc4_performance(s: SparkSession, sf: str) -> DataFrame:
    made, labels = _quarterly(s, sf)
    return round_doubles(DR.performance_drift(DR.performance_by_period(made, labels, unit="day")))


_RATES = ["prevalence", "mean_score", "brier", "sensitivity", "specificity", "g_mean"]
register(
    "doc4_performance_drift",
    O.with_base(
        f"""SELECT model_name, period, labelled, {", ".join(O.r6(c, c) for c in _RATES)}, {", ".join(O.r6(f"{c} - first_value({c}) OVER w", f"{c}_drift") for c in _RATES)}
FROM (SELECT *, sqrt(sensitivity * specificity) AS g_mean FROM (
  SELECT model_name, date_trunc('day', c.first_visit_date) AS period, count(*) AS labelled, avg(CAST(y_true AS DOUBLE)) AS prevalence, avg(y_prob) AS mean_score,
    avg((y_prob - y_true) * (y_prob - y_true)) AS brier, avg(CASE WHEN y_true = 1 THEN CAST(y_pred AS DOUBLE) END) AS sensitivity, avg(CASE WHEN y_true = 0 THEN 1.0 - y_pred END) AS specificity
  FROM p2 JOIN cohort c ON c.hn = p2.patient_id WHERE c.reference_date >= c.first_visit_date GROUP BY 1, 2))
WINDOW w AS (PARTITION BY model_name ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
        PRED_CTE,
    ),
)(_doc4_performance)

register(
    "doc4_value_stability",
    """WITH e AS (SELECT date_trunc('day', ts) AS period, CAST(value AS DOUBLE) AS value FROM events),
f AS (SELECT min(period) AS first FROM e),
cuts AS (SELECT list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS cuts FROM e, f WHERE period = first),
b AS (SELECT period, CASE WHEN value IS NULL THEN -1 ELSE len(list_filter(cuts, lambda c: c < value)) END AS bin, count(*) AS n FROM e, cuts GROUP BY ALL),
t AS (SELECT period, sum(n) AS total FROM b GROUP BY period),
r AS (SELECT bin, n AS ref_n FROM b, f WHERE period = first),
s AS (SELECT period, total, bin FROM t, r UNION SELECT b.period, total, bin FROM b JOIN t USING (period)),
x AS (SELECT s.period, total, greatest(coalesce(b.n, 0) / total, 1e-4) AS p, greatest(coalesce(ref_n, 0) / (SELECT sum(ref_n) FROM r), 1e-4) AS q
  FROM s LEFT JOIN b USING (period, bin) LEFT JOIN r USING (bin))
SELECT period, 'value' AS "column", CAST(max(total) AS BIGINT) AS n, """ + O.r6("sum((p - q) * ln(p / q))", "psi") + " FROM x GROUP BY period",
)(lambda s, sf: round_doubles(DR.stability_index(s.read.parquet(f"{sf}/events.parquet"), "ts", ["value"], "day")))

register(
    "doc5_set1_last_representation",
    O.with_base(
        "SELECT patient_id, max(stroke) AS stroke, "
        + ", ".join(
            O.r6(f"arg_max({c}, {O.ORDER}) FILTER (WHERE \"window\" = '{n}' AND {c} IS NOT NULL)", f"{n.lower()}_{c}_mean")
            for n in ("FIRST", "MID", "LAST") for c in O.FEATURE_NUMERIC
        )
        + ", "
        + ", ".join(f"{O._latest(c)} AS latest_{c}" for c in O.FEATURE_STATIC)
        + " FROM frec GROUP BY patient_id HAVING bool_and(true) AND patient_id IN (SELECT patient_id FROM ent WHERE complete)"
    ),
)(lambda s, sf: round_doubles(FE.feature_sets(FE.entity_features(FE.ensure_ratio(cleaned_records(s, sf)),
                                                                    FeatureConfig(schema=FIXTURE_CLEAN, representation="LAST")),
                                              FeatureConfig(schema=FIXTURE_CLEAN, representation="LAST"))["extract_set_1"]))

register(
    "doc6_multi_hot_window_flags",
    O.with_base(
        "SELECT hn, vstdate, " + O.KEYS + ", months_before_reference BETWEEN 9 AND 21 AS in_first_window, "
        "months_before_reference BETWEEN 6 AND 18 AS in_mid_window, months_before_reference BETWEEN 3 AND 15 AS in_last_window FROM pre"
    ),
)(lambda s, sf: stage2(s, sf)["pre_reference_records"].select("hn", "vstdate", *KEYS, "in_first_window", "in_mid_window", "in_last_window"))

# ---------------------------------------------------------------- remaining report operators

register(
    "aud3_missing_summary",
    O.with_base(" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, {O.r6(f'(count(*) - count({c})) / count(*)')} AS missing_percent FROM visits"
        for c, _ in VISIT_TYPES)),
)(lambda s, sf: round_doubles(AU.missing_from_summary(audit_stage(s, sf)["raw_schema_summary"])))


def _aud5(s: SparkSession, sf: str) -> DataFrame:
    st = audit_stage(s, sf)
    raw = fixture_visits(s, sf)
    return round_doubles(AU.data_dictionary(raw, st["column_availability_checklist"], st["raw_schema_summary"]).drop("example_values", "ordinal"))


def _aud5_sql() -> str:
    from ..config import EXPECTED_COLUMNS, EXPECTED_FIELD_DETAILS

    cols = [c for c, _ in VISIT_TYPES]
    types = dict(VISIT_TYPES)
    parts = []
    for field, cands in EXPECTED_COLUMNS.items():
        m = next((c for c in cands if c in cols), None)
        cat, role, req = EXPECTED_FIELD_DETAILS[field]
        if m:
            parts.append(
                f"SELECT '{field}' AS required_field, '{m}' AS matched_column, 'available' AS status, '{cat}' AS category, '{role}' AS paper_role, "
                f"'{req}' AS required_for, '{types[m]}' AS dtype, {O.r6(f'(count(*) - count({m})) / count(*)')} AS missing_percent, "
                f"count(DISTINCT {_vstr(m, types[m])}) AS unique_count FROM visits"
            )
        else:
            parts.append(
                f"SELECT '{field}', '', 'missing', '{cat}', '{role}', '{req}', CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT)"
            )
    return O.with_base(" UNION ALL ".join(parts))


register("aud5_data_dictionary", _aud5_sql())(_aud5)

register(
    "coh9_source_record_counts",
    O.with_base('SELECT count(DISTINCT source_record_id) AS pre_reference_source_records, count(DISTINCT source_record_id) FILTER (WHERE "window" IS NOT NULL) AS window_source_records, count(*) AS long_rows FROM long'),
)(lambda s, sf: core2(s, sf)[4].agg(
    C.source_record_count(core2(s, sf)[4]).alias("pre_reference_source_records"),
    C.source_record_count(core2(s, sf)[4], F.col("window").isNotNull()).alias("window_source_records"),
    F.count(F.lit(1)).alias("long_rows")))

register("cln9_missing_after_cleaning", _missing_by_var_sql())(
    lambda s, sf: round_doubles(CL.cleaned_missing_summary(cleaned_records(s, sf)).drop("ordinal"))
)
register(
    "cln10_no_post_reference",
    O.with_base("SELECT bool_and(visit_date <= reference_date) FILTER (WHERE visit_date IS NOT NULL AND reference_date IS NOT NULL) AS no_post_reference_records FROM cleaned"),
)(lambda s, sf: CL.no_post_reference(cleaned_records(s, sf), FIXTURE_CLEAN))


def _cln14(s: SparkSession, sf: str) -> DataFrame:
    d = stage3(s, sf)
    return CL.cleaning_acceptance(d["cleaned_pre_reference_records"], d["required_column_report"], d["binary_validation_report"],
                                  d["range_check_summary"], d["range_change_log"], d["diagnosis_normalization_report"], d["leakage_audit_report"])



def _checks_sql(sources: dict[str, str], rows: list[tuple[str, str, str]]) -> str:
    """Acceptance checks over the SQL of other queries: (check, passed, detail) expressions, in order."""
    ctes = ", ".join(f"{name} AS ({ORACLES[query]})" for name, query in sources.items())
    each = [f"SELECT CAST({i} AS INTEGER) AS check_order, '{c}' AS \"check\", coalesce({ok}, false) AS passed, {detail} AS detail" for i, (c, ok, detail) in enumerate(rows, start=1)]
    return f"WITH {ctes}\n" + "\nUNION ALL ".join(each)


_LEAK_OK = "(SELECT coalesce(bool_and(passed), false) FROM leak)"
register(
    "cln14_cleaning_acceptance",
    _checks_sql(
        {"req": "cln11_required_columns", "leak": "cln13_leakage_audit", "bin": "cln12_binary_validation", "rng": "cln8_range_check_summary", "log": "cln8_range_change_log", "codes": "cln5_code_normalization_report"},
        [
            ("required_columns_kept", "(SELECT coalesce(bool_and(status = 'available'), true) FROM req)", "(SELECT coalesce(string_agg(required_column, ', ' ORDER BY required_column) FILTER (WHERE status = 'missing'), '') FROM req)"),
            ("no_post_reference_records", _LEAK_OK, "(SELECT string_agg(detail, '; ' ORDER BY detail) FROM leak)"),
            ("binary_columns_only_0_1_missing", "(SELECT coalesce(bool_and(valid_binary_or_missing), true) FROM bin)", "'columns_checked=' || (SELECT count(*) FROM bin)"),
            ("implausible_values_logged", "(SELECT coalesce(sum(invalid_values_set_missing), 0) FROM rng) = 0 OR (SELECT count(*) FROM log) > 0", "'range_invalid_values=' || (SELECT coalesce(sum(invalid_values_set_missing), 0)::BIGINT FROM rng)"),
            ("diagnosis_normalization_preserves_stroke_signal", "(SELECT coalesce(bool_and(stroke_icd_signal_preserved), false) FROM codes)", "'ICD-10 I60-I68 hits before/after normalization match'"),
            ("cleaning_does_not_create_new_target_leakage", _LEAK_OK, "'stroke label retained; records remain pre-reference'"),
        ],
    ),
)(_cln14)
register(
    "cln15_unified_cleaning_log",
    f"SELECT * FROM ({ORACLES['cln8_range_change_log']}) UNION ALL BY NAME SELECT *, 'drop_rows' AS action, NULL AS \"column\" FROM ({ORACLES['cln6_duplicate_report']})",
)(lambda s, sf: round_doubles(CL.unified_cleaning_log(stage3(s, sf)["range_change_log"], stage3(s, sf)["duplicate_report"])))
register(
    "eda15_eda_acceptance",
    _checks_sql(
        {"imb": "eda1_class_imbalance", "cov": "eda8_temporal_coverage", "miss": "eda7_missingness_by_window", "leak": "eda12_leakage_audit", "cases": "eda10_complete_case_summary", "rec": "eda14_sensitivity_recommendation"},
        [
            ("class_imbalance_reported", "(SELECT count(*) FROM imb) > 0", "'label_groups=' || (SELECT count(*) FROM imb)"),
            ("temporal_complete_patient_count_reported", "(SELECT count(*) FROM cov WHERE metric = 'temporal_complete_patients') > 0", "'temporal_complete_patients=' || (SELECT max(patient_count)::BIGINT FROM cov WHERE metric = 'temporal_complete_patients')"),
            ("missingness_by_first_mid_last_reported", "(SELECT count(DISTINCT \"window\") FROM miss WHERE \"window\" IN ('FIRST', 'MID', 'LAST')) = 3", "'windows=' || (SELECT count(DISTINCT \"window\") FROM miss WHERE \"window\" IN ('FIRST', 'MID', 'LAST'))"),
            ("no_post_reference_records_confirmed", "(SELECT bool_and(passed) FROM leak)", "'failed_record_count=' || (SELECT sum(failed_record_count)::BIGINT FROM leak)"),
            ("strict_completeness_stroke_case_count_identified", "(SELECT count(stroke_patients) FROM cases WHERE \"group\" = 'temporal_complete') > 0", "'temporal_complete_stroke_patients=' || (SELECT max(stroke_patients)::BIGINT FROM cases WHERE \"group\" = 'temporal_complete')"),
            ("sensitivity_analysis_recommended_if_needed", "(SELECT bool_or(recommend_sensitivity_analysis) FROM rec) = ((SELECT max(stroke_patients) FROM cases WHERE \"group\" = 'temporal_complete') < 2)", "'recommend=' || (SELECT bool_or(recommend_sensitivity_analysis) FROM rec)"),
        ],
    ),
)(lambda s, sf: EX.eda_acceptance(
    eda_stage(s, sf)["class_imbalance"], eda_stage(s, sf)["temporal_coverage"], eda_stage(s, sf)["missingness_by_window"],
    eda_stage(s, sf)["leakage_audit"], eda_stage(s, sf)["temporal_complete_case_summary"], eda_stage(s, sf)["sensitivity_recommendation"]))


def _candidates(features: int) -> int:
    """Candidates of the whole grid over so many features: ANOVA k, PCA n, and both with n <= k."""
    ks, ns = [k for k in ANOVA_K_GRID if k <= features], [n for n in PCA_N_GRID if n <= features]
    return len(ks) + len(ns) + sum(n <= k for k in ks for n in ns)


register(
    "val7_leakage_evidence",
    O.with_base("SELECT 'eda_no_post_reference_records' AS \"check\", count(*) FILTER (WHERE visit_date > reference_date) = 0 AS passed, "
                "'failed_record_count=' || CAST(count(*) FILTER (WHERE visit_date > reference_date) AS VARCHAR) AS detail FROM cleaned "
                f"UNION ALL SELECT 'feature_selection_and_pca_fold_local_fit', true, 'candidates={sum(map(_candidates, FEATURE_TARGET_COUNTS.values()))}'"),
)(lambda s, sf: _full_run(s, sf)["08"]["leakage_audit_report"])
register("val8_attrition_view", ORACLES["coh10_attrition_report"])(lambda s, sf: EV.attrition_view(stage2(s, sf)["cohort_attrition_report"]))


def _full_run(s: SparkSession, sf: str) -> dict[str, dict[str, DataFrame]]:
    """The end-to-end run with models, the whole selection grid and validation."""
    from ..plans.pipeline import PipelineConfig, run_pipeline
    from ..sources.visits import FIXTURE_RAW

    cfg = PipelineConfig(raw=FIXTURE_RAW, clean=FIXTURE_CLEAN, skip_modeling=False)
    return _memo("full_run", s, sf, lambda: run_pipeline(s, fixture_visits(s, sf), cfg))


def _orc3(s: SparkSession, sf: str) -> DataFrame:
    return _full_run(s, sf)["00"]["pipeline_acceptance"]


register("orc3_pipeline_acceptance", None)(_orc3)

register(
    "fea3_observation_records",
    O.with_base(f'SELECT DISTINCT patient_id, visit_date, {O.KEYS} FROM frec WHERE {O.IN_ANY}'),
)(lambda s, sf: FE.observation_records(FE.ensure_ratio(cleaned_records(s, sf)), FEATURE_CFG).select("patient_id", "visit_date", *KEYS))
register(
    "fea4_pre_reference_only",
    O.with_base("SELECT coalesce(bool_and(visit_date <= reference_date) FILTER (WHERE visit_date IS NOT NULL AND reference_date IS NOT NULL), true) AS pre_reference_only FROM frec"),
)(lambda s, sf: FE.validate_pre_reference(cleaned_records(s, sf), FEATURE_CFG))


def _fea18(s: SparkSession, sf: str) -> DataFrame:
    d = stage5(s, sf)
    spark = s
    comparison = FE.feature_set_comparison(spark, {k: d[k] for k in ("extract_set_1", "extract_set_2", "extract_set_3")})
    dictionary = FE.feature_dictionary(spark, FEATURE_CFG, set(cleaned_records(s, sf).columns) | {"tc_hdl_ratio"})
    return FE.feature_acceptance(d["generation_log"], comparison, dictionary, d["temporal_window_usage_report"], d["tc_hdl_audit"])


register("fea18_feature_acceptance", None)(_fea18)

register("mod1_feature_matrix", O.with_base("SELECT patient_id, stroke, " + ", ".join(O.r6(c, c) for c in _S1_FEATS) + " FROM set1", SET1_CTE))(
    lambda s, sf: round_doubles(FO.feature_matrix(stage5(s, sf)["extract_set_1"], MODEL_CFG))
)

_TABLE_CTES = {
    "single_shot": f"SELECT patient_id, stroke FROM (SELECT patient_id, arg_max(stroke, {O.ORDER}) AS stroke FROM frec WHERE {O.IN_ANY} GROUP BY patient_id)",
    "extract_set_1": "SELECT patient_id, label AS stroke FROM ent WHERE complete",
    "extract_set_2": "SELECT patient_id, label AS stroke FROM ent WHERE complete",
    "extract_set_3": "SELECT patient_id, label AS stroke FROM ent WHERE complete",
}
_NFEAT = {"single_shot": 21, "extract_set_1": 35, "extract_set_2": 115, "extract_set_3": 121}


def _policy_sql(select_cols: str, where: str = "") -> str:
    parts = []
    for name, q_ in _TABLE_CTES.items():
        parts.append(
            f"SELECT '{name}' AS model_name, count(*) AS n, count(*) FILTER (WHERE stroke = 1) AS pos, count(*) FILTER (WHERE stroke = 0) AS neg, "
            f"{_NFEAT[name]} AS nf FROM ({q_}) WHERE stroke IS NOT NULL"
        )
    pol = " UNION ALL ".join(parts)
    body = f"""SELECT *, CASE WHEN pos = 0 OR neg = 0 THEN 'not_run_single_class' WHEN least(pos, neg) < 2 THEN 'not_run_min_class_lt_2' ELSE '' END AS skip_reason,
  CASE WHEN pos = 0 OR neg = 0 OR least(pos, neg) < 2 THEN 'not_run' WHEN n <= 200 THEN 'LOOCV' ELSE 'StratifiedKFold_' || CAST(least(5, least(pos, neg)) AS VARCHAR) END AS cv_strategy
FROM ({pol})"""
    return O.with_base(f"SELECT {select_cols} FROM ({body}) {where}")


def _policy_tables(s: SparkSession, sf: str) -> dict[str, DataFrame]:
    d = stored5(s, sf)
    return {k: d[k] for k in ("single_shot", "extract_set_1", "extract_set_2", "extract_set_3")}


register(
    "mod2_cv_policy",
    _policy_sql("model_name, CASE WHEN skip_reason = '' THEN 'completed' ELSE 'skipped' END AS status, skip_reason, n AS n_patients, "
                "CAST(nf AS BIGINT) AS n_features, pos AS target_positive_count, neg AS target_negative_count, cv_strategy"),
)(lambda s, sf: MO.policy_results(_policy_tables(s, sf), MODEL_CFG))
register(
    "mod12_skipped_models",
    _policy_sql("model_name, skip_reason, n AS n_patients, CAST(nf AS BIGINT) AS n_features, pos AS target_positive_count, neg AS target_negative_count, cv_strategy", "WHERE skip_reason <> ''"),
)(lambda s, sf: EV.skipped_models(MO.policy_results(_policy_tables(s, sf), MODEL_CFG)))
register(
    "mod13_cv_policy_report",
    _policy_sql("model_name, 'LOOCV' AS paper_cv_strategy, cv_strategy AS actual_cv_strategy, cv_strategy = 'LOOCV' AS paper_cv_exact_match, "
                "CASE WHEN cv_strategy = 'LOOCV' THEN '' ELSE 'requested non-LOOCV strategy or auto fallback due to runtime/class constraints' END AS fallback_reason, "
                "n AS n_patients, pos AS target_positive_count, neg AS target_negative_count"),
)(lambda s, sf: EV.cv_policy_report(MO.policy_results(_policy_tables(s, sf), MODEL_CFG)))


def _cut_folded(s: SparkSession, sf: str) -> tuple[DataFrame, list[str], FO.CvPolicy]:
    return set1_folded(s, sf)


def _imp4(s: SparkSession, sf: str) -> DataFrame:
    folded, feats, policy = _cut_folded(s, sf)
    return SE.fold_pca_variance(folded, feats, policy.folds, 5, MODEL_CFG)


register("imp4_fold_pca_variance", None)(_imp4)

_PAIR = ["first_bps_mean", "latest_age"]


def _imp4_pair(s: SparkSession, sf: str) -> DataFrame:
    folded, _, policy = _cut_folded(s, sf)
    return round_doubles(SE.fold_pca_variance(folded, _PAIR, policy.folds, 2, MODEL_CFG))


# two standardised features: the eigenvalues of [[1, r], [r, 1]] are 1 + |r| and 1 - |r|
register(
    "imp4_fold_pca_variance_pair",
    O.with_base(
        f"""SELECT train_fold, CAST(component AS INTEGER) AS component, {O.r6("(1 + CASE WHEN component = 1 THEN abs(r) ELSE -abs(r) END) / 2", "explained_variance_ratio")}
FROM (SELECT train_fold, corr(x, y) AS r FROM (
  SELECT t.train_fold, coalesce(t.{_PAIR[0]}, a.median) AS x, coalesce(t.{_PAIR[1]}, b.median) AS y FROM tc t
  JOIN med a ON a.train_fold = t.train_fold AND a.feature = '{_PAIR[0]}' JOIN med b ON b.train_fold = t.train_fold AND b.feature = '{_PAIR[1]}') GROUP BY train_fold)
CROSS JOIN (VALUES (1), (2)) c(component)""",
        SET1_CTE,
    ),
)(_imp4_pair)


def _grid(s: SparkSession, sf: str) -> dict[str, DataFrame]:
    return _memo("grid", s, sf, lambda: SE.run_set_analysis(stage5(s, sf)["extract_set_1"], "extract_set_1", MODEL_CFG))


register("imp8_grid_set1", None)(lambda s, sf: round_doubles(_grid(s, sf)["performance"]))
register("imp8_best_per_method_set1", None)(lambda s, sf: round_doubles(_grid(s, sf)["best"]))

# ---------------------------------------------------------------- final models, routing and scoring


def _final_models(s: SparkSession, sf: str) -> DataFrame:
    st5 = stored5(s, sf)
    return _memo("final_models", s, sf, lambda: IN.fit_final(st5["single_shot"], "single_shot", MODEL_CFG).unionByName(IN.fit_final(st5["extract_set_1"], "extract_set_1", MODEL_CFG)))


def _doc3_scores(s: SparkSession, sf: str) -> DataFrame:
    st5 = stored5(s, sf)
    out = IN.route_and_score(st5["temporal_completeness"], st5["single_shot"], st5["extract_set_1"], _final_models(s, sf), "single_shot", "extract_set_1", MODEL_CFG)
    return round_doubles(out)


register("doc3_routed_scores", None)(_doc3_scores)
register("doc3_final_models", None)(lambda s, sf: round_doubles(_final_models(s, sf).select("model_name", "n_rows", "positives", "intercept", F.size("features").alias("n_features"))))

# ---------------------------------------------------------------- leave-one-out by exclusion

LOO_CFG = ModelConfig(entity="patient_id", label="stroke", cv_strategy="loocv")


def loo_folded(s: SparkSession, sf: str) -> tuple[DataFrame, list[str], FO.CvPolicy]:
    return _memo("loo_folded", s, sf, lambda: _loo_folded(s, sf))


def _loo_folded(s: SparkSession, sf: str) -> tuple[DataFrame, list[str], FO.CvPolicy]:
    ensure_checkpoint_dir(s)
    mat = FO.feature_matrix(stage5(s, sf)["extract_set_1"], LOO_CFG).checkpoint()
    policy = FO.choose_cv(mat, LOO_CFG)
    return FO.assign_folds(mat, policy, LOO_CFG).checkpoint(), FO.feature_columns(mat, LOO_CFG), policy


def _loo_stats(s: SparkSession, sf: str) -> DataFrame:
    folded, feats, _ = loo_folded(s, sf)
    return round_doubles(FF.loo_statistics(folded, feats, LOO_CFG))


LOO_CTE = (
    SET1_CTE
    + ",\nlf AS (SELECT s.*, CAST(row_number() OVER (ORDER BY md5(CAST(patient_id AS VARCHAR) || ':42')) - 1 AS INTEGER) AS train_fold FROM set1 s),\n"
    + "lu AS (" + " UNION ALL ".join(f"SELECT train_fold, '{c}' AS feature, {c} AS value FROM lf" for c in _S1_FEATS) + "),\n"
    + "lm AS (SELECT train_fold, feature, quantile_cont(value, 0.5) OVER w AS median, count(value) OVER w AS held, avg(value) OVER w AS m, var_pop(value) OVER w AS v, count(*) OVER w AS n "
    + "FROM lu WINDOW w AS (PARTITION BY feature ORDER BY train_fold ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW)),\n"
    # mean and variance after the missing entries are set to the median
    + "ls AS (SELECT *, m + (median - m) * (n - held) / n AS mean, sqrt((v * held + (median - m) * (median - m) * held * (n - held) / n) / n) AS std FROM lm)"
)
register("mod5_loo_medians", O.with_base(f"SELECT train_fold, feature, {O.r6('median', 'median')} FROM lm", LOO_CTE))(
    lambda s, sf: _loo_stats(s, sf).select("train_fold", "feature", "median")
)
register(
    "mod6_loo_scaling",
    O.with_base(f"SELECT train_fold, feature, {O.r6('mean', 'mean')}, {O.r6('std', 'std')}, {O.r6('CASE WHEN std > 1e-9 THEN std WHEN median IS NOT NULL THEN 1.0 END', 'scale')} FROM ls", LOO_CTE),
)(lambda s, sf: _loo_stats(s, sf).select("train_fold", "feature", "mean", "std", "scale"))


def _mod8_loo(s: SparkSession, sf: str) -> DataFrame:
    folded, feats, policy = loo_folded(s, sf)
    models, _ = MO.fit_cv(folded, feats, "extract_set_1", policy, LOO_CFG)
    return round_doubles(FF.score(folded, models, feats, LOO_CFG))


register("mod8_loo_predictions_set1", None)(_mod8_loo)


# ---------------------------------------------------------------- inputs on which a check must answer


def _overlapping(s: SparkSession, sf: str) -> DataFrame:
    folded = set1_folded(s, sf)[0].select("patient_id", "fold")
    return FO.overlap_guard(folded.unionByName(folded.where("fold = 0").withColumn("fold", F.lit(1))), MODEL_CFG)


register(
    "mod4_overlap_detected",
    O.with_base("SELECT patient_id, count(DISTINCT fold) AS folds FROM (SELECT patient_id, fold FROM folded UNION ALL SELECT patient_id, 1 FROM folded WHERE fold = 0) "
                "GROUP BY patient_id HAVING count(DISTINCT fold) > 1", SET1_CTE),
)(_overlapping)


def _repeated(s: SparkSession, sf: str) -> DataFrame:
    long = core2(s, sf)[5]
    times = F.when(F.col("window") == "FIRST", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))  # rows of the first window twice
    return CL.drop_exact_duplicates(long.withColumn("__time", F.explode(times)).drop("__time"))[1]


register(
    "cln6_repeated_records",
    O.with_base("SELECT 'drop_exact_duplicates' AS rule, (SELECT count(*) FROM long) + (SELECT count(*) FROM long WHERE \"window\" = 'FIRST') AS rows_before, "
                "(SELECT count(*) FROM long) AS rows_after, (SELECT count(*) FROM long WHERE \"window\" = 'FIRST') AS rows_changed"),
)(_repeated)


def _texts(s: SparkSession, sf: str) -> DataFrame:
    """Laboratory values as text, missing ones as ``NaN`` or as words, coerced again."""
    long, _ = CL.standardize_columns(stage2(s, sf)["pre_reference_records_with_windows"])
    text = long.withColumns({
        "hdl": F.coalesce(F.col("hdl").cast("string"), F.lit("NaN")),
        "ldl": F.coalesce(F.col("ldl").cast("string"), F.lit("not done")),
    })
    out = CL.coerce_types(text)
    return out.agg(
        F.count("hdl").alias("hdl_values"), F.count("ldl").alias("ldl_values"), F.round(F.sum("hdl"), 2).alias("hdl_sum"),
        F.count_if(F.isnan("hdl")).alias("hdl_nan"), F.count(F.lit(1)).alias("rows"),
    )


register(
    "cln3_coerced_text",
    O.with_base("SELECT count(HDL) AS hdl_values, count(LDL) AS ldl_values, round(sum(HDL), 2) AS hdl_sum, 0 AS hdl_nan, count(*) AS rows FROM long"),
)(_texts)


def _one_class(s: SparkSession, sf: str) -> DataFrame:
    table = stage5(s, sf)["extract_set_1"]
    ensure_checkpoint_dir(s)
    table = table.checkpoint()  # read twice
    return EV.skipped_models(MO.policy_results({"extract_set_1": table, "positives_only": table.where("stroke = 1")}, MODEL_CFG))


register(
    "mod12_single_class_skipped",
    O.with_base(f"SELECT 'positives_only' AS model_name, 'not_run_single_class' AS skip_reason, count(*) AS n_patients, CAST({len(_S1_FEATS)} AS BIGINT) AS n_features, "
                "count(*) AS target_positive_count, CAST(0 AS BIGINT) AS target_negative_count, 'not_run' AS cv_strategy FROM set1 WHERE stroke = 1", SET1_CTE),
)(_one_class)
