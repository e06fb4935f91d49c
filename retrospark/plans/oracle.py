"""DuckDB oracle SQL for the query catalogue.

Each oracle is an independent ANSI-SQL statement over the pre-registered test tables
(``lineitem orders customer nation part labels documents ...``).  A shared chain of
CTEs restates the stage semantics in plain SQL (range join for windows, FILTER
aggregates, window functions); every query appends its own final SELECT.
Doubles are rounded to 6 decimals on both sides of the comparison.
"""

from __future__ import annotations

from ..config import (
    BINARY_COLUMNS,
    COLUMN_RENAME_MAP,
    FEATURE_NUMERIC,
    FEATURE_RISK,
    FEATURE_STATIC,
    PLAUSIBLE_RANGES,
    RAW_CORE_NUMERIC,
    RAW_RANGE_CHECKS,
    WINDOWS,
)

KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
WIN = [(n, lo, hi) for n, (hi, lo) in WINDOWS.items()]
IDX = r"'\bI6[0-8]\b', 'i'"
TOKEN = r"'([A-TV-Z][0-9]{2}(?:\.[0-9A-Z]+)?)'"

VISITS = """
visits AS (
  SELECT
    o.o_custkey AS hn,
    l.l_shipdate AS vstdate,
    CASE l.l_linenumber % 3 WHEN 0 THEN l.c1
         WHEN 1 THEN l.c1 || '.' || CAST(l.l_linenumber AS VARCHAR)
         ELSE l.c1 || CAST(l.l_linenumber AS VARCHAR) END AS PrincipleDiagnosis,
    CASE WHEN l.l_returnflag <> 'N' THEN l.c2 END AS ComorbidityDiagnosis,
    1 + o.o_custkey % 2 AS sex,
    20 + o.o_custkey % 70 AS age,
    l.l_linenumber % 4 AS smoke,
    l.l_suppkey % 4 AS drinking,
    l.l_partkey % 3 AS AF,
    90 + 2 * l.l_quantity AS bps,
    50 + l.l_quantity AS bpd,
    18 + 200 * l.l_discount AS bmi,
    CASE WHEN l.l_linenumber <= 3 THEN l.l_extendedprice / 1000 END AS HDL,
    CASE WHEN l.l_linenumber <= 3 THEN l.l_extendedprice / 250 END AS LDL,
    CASE WHEN l.l_linenumber <= 3 THEN l.l_extendedprice / 50 END AS Triglyceride,
    CASE WHEN l.l_linenumber <= 3 THEN 70 + 1000 * l.l_tax END AS FBS,
    CASE WHEN l.l_linenumber <= 3 THEN 120 + 4 * l.l_quantity END AS Cholesterol,
    CASE WHEN l.l_linenumber <= 3 THEN o.o_totalprice / 2500 END AS eGFR,
    CASE WHEN l.l_linenumber <= 3 THEN 10 * l.l_discount END AS Creatinine,
    CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS heart_disease,
    CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END AS hypertension,
    CASE WHEN l.l_returnflag = 'A' THEN 1 ELSE 0 END AS diabetes,
    CASE WHEN l.l_linestatus = 'O' THEN 1 ELSE 0 END AS Statin,
    CASE WHEN l.l_linestatus = 'F' THEN 1 ELSE 0 END AS Gemfibrozil,
    CASE WHEN l.l_quantity > 25 THEN 1 ELSE 0 END AS Antihypertensive_flag,
    n.n_name AS subdistrict,
    p.p_name AS medication,
    l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber
  FROM (
    SELECT *,
      substr('ABCDEFGHIJKLMNOPQRST', CAST(l_partkey % 20 AS INTEGER) + 1, 1) || lpad(CAST(l_orderkey % 100 AS VARCHAR), 2, '0') AS c1,
      substr('ABCDEFGHIJKLMNOPQRST', CAST(l_suppkey % 20 AS INTEGER) + 1, 1) || lpad(CAST(l_partkey % 100 AS VARCHAR), 2, '0') AS c2
    FROM lineitem) l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey
)"""

PREPARED = """
prepared AS (SELECT DISTINCT * FROM visits WHERE hn IS NOT NULL AND vstdate IS NOT NULL)"""

FLAGGED = f"""
flagged AS (
  SELECT *,
    coalesce(regexp_matches(PrincipleDiagnosis, {IDX}), false) AS p_hit,
    coalesce(regexp_matches(ComorbidityDiagnosis, {IDX}), false) AS c_hit
  FROM prepared)"""

COHORT = """
cohort0 AS (
  SELECT hn,
    min(vstdate) AS first_visit_date,
    max(vstdate) AS last_visit_date,
    count(*) AS record_count,
    min(vstdate) FILTER (WHERE p_hit OR c_hit) AS first_stroke_date,
    count(*) FILTER (WHERE p_hit OR c_hit) AS stroke_event_count,
    coalesce(string_agg(DISTINCT CASE WHEN p_hit AND c_hit THEN 'principal_and_comorbidity'
                                      WHEN p_hit THEN 'principal' ELSE 'comorbidity' END, ','
                        ORDER BY CASE WHEN p_hit AND c_hit THEN 'principal_and_comorbidity'
                                      WHEN p_hit THEN 'principal' ELSE 'comorbidity' END)
             FILTER (WHERE p_hit OR c_hit), '') AS stroke_event_sources
  FROM flagged GROUP BY hn),
cohort AS (
  SELECT *,
    CAST(first_stroke_date IS NOT NULL AS INTEGER) AS stroke,
    coalesce(first_stroke_date, last_visit_date) AS reference_date,
    CASE WHEN first_stroke_date IS NOT NULL THEN 'first_stroke_date' ELSE 'last_visit_date' END AS reference_rule,
    date_diff('day', first_visit_date, coalesce(first_stroke_date, last_visit_date)) AS followup_days_before_reference
  FROM cohort0)"""

_win_values = ", ".join(f"('{n}', CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE), {i})" for i, (n, lo, hi) in enumerate(WIN, 1))
PRE = f"""
pre AS (
  SELECT p.*, c.stroke, c.reference_date, c.reference_rule,
    date_diff('day', p.vstdate, c.reference_date) AS days_before_reference,
    date_diff('day', p.vstdate, c.reference_date) / 30.4375 AS months_before_reference,
    hash(p.l_orderkey, p.l_partkey, p.l_suppkey, p.l_linenumber) AS source_record_id
  FROM prepared p JOIN cohort c ON p.hn = c.hn
  WHERE p.vstdate <= c.reference_date),
win AS (SELECT * FROM (VALUES {_win_values}) t(wname, wlo, whi, word)),
long AS (
  SELECT pre.*, w.wname AS "window",
    w.wlo AS window_lower_months_before_reference,
    w.whi AS window_upper_months_before_reference,
    count(w.wname) OVER (PARTITION BY pre.source_record_id) AS window_membership_count,
    w.wname IS NOT NULL AS is_paper_observation_window
  FROM pre LEFT JOIN win w ON pre.months_before_reference BETWEEN w.wlo AND w.whi)"""


def _core_test(cols: list[str], w: str) -> str:
    return " AND ".join(f'count({c}) FILTER (WHERE "window" = \'{w}\') > 0' for c in cols)


def _completeness(src: str, entity: str, cols: list[str], suffix: str, extra: bool) -> str:
    parts = []
    for n, _, _ in WIN:
        p = n.lower()
        parts += [
            f'count(*) FILTER (WHERE "window" = \'{n}\') AS {p}_visit_count',
            f'count(*) FILTER (WHERE "window" = \'{n}\') > 0 AS {p}_has_visit',
            f"({_core_test(cols, n)}) AS {p}_{suffix}",
        ]
    complete = " AND ".join(f'(count(*) FILTER (WHERE "window" = \'{n}\') > 0 AND {_core_test(cols, n)})' for n, _, _ in WIN)
    if extra:
        parts += [f"'{','.join(cols)}' AS core_clinical_columns_checked", f"CAST({len(cols)} AS BIGINT) AS core_clinical_column_count_checked"]
    parts.append(f"({complete}) AS temporal_complete")
    return f"SELECT {entity}, " + ",\n    ".join(parts) + f" FROM {src} GROUP BY {entity}"


COMPLETENESS = f"""
completeness AS ({_completeness('long', 'hn', RAW_CORE_NUMERIC, 'has_core_clinical', True)})"""


def _clean_select() -> str:
    """Stage 03 on the long table: rename, drop quasi-identifier, tokens, binaries, ranges."""
    ren = {k: v for k, v in COLUMN_RENAME_MAP.items()}
    raw_cols = [
        "hn", "vstdate", "PrincipleDiagnosis", "ComorbidityDiagnosis", "sex", "age", "smoke", "drinking", "AF",
        "bps", "bpd", "bmi", "HDL", "LDL", "Triglyceride", "FBS", "Cholesterol", "eGFR", "Creatinine",
        "heart_disease", "hypertension", "diabetes", "Statin", "Gemfibrozil", "Antihypertensive_flag",
        "medication", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "stroke", "reference_date",
        "reference_rule", "days_before_reference", "months_before_reference", "source_record_id", '"window"',
        "window_lower_months_before_reference", "window_upper_months_before_reference",
        "window_membership_count", "is_paper_observation_window",
    ]
    out = []
    for c in raw_cols:
        name = ren.get(c, c)
        if name in BINARY_COLUMNS:
            out.append(f"CASE WHEN {c} IN (0, 1) THEN {c} END AS {name}")
        elif name in PLAUSIBLE_RANGES:
            lo, hi = PLAUSIBLE_RANGES[name]
            out.append(f"CASE WHEN {c} IS NULL OR {c} BETWEEN {lo} AND {hi} THEN {c} END AS {name}")
        elif name != c:
            out.append(f"{c} AS {name}")
        else:
            out.append(c)
    for c, name in (("PrincipleDiagnosis", "principal_diagnosis"), ("ComorbidityDiagnosis", "comorbidity_diagnosis")):
        t = f"regexp_extract_all(upper({c}), {TOKEN}, 1)"
        out.append(f"nullif(array_to_string(list_filter({t}, lambda x, i: list_position({t}, x) = i), ';'), '') AS {name}_normalized")
    return "SELECT " + ",\n    ".join(out) + " FROM (SELECT DISTINCT * EXCLUDE (subdistrict) FROM long) d"


CLEANED = f"""
cleaned AS ({_clean_select()}),
frec AS (SELECT *, CASE WHEN hdl > 0 THEN cholesterol / hdl END AS tc_hdl_ratio FROM cleaned)"""

ORDER = f"(visit_date, {KEYS})"
IN_ANY = "\"window\" IN ('FIRST', 'MID', 'LAST')"


def _latest(c: str, cond: str = IN_ANY) -> str:
    return f"arg_max({c}, {ORDER}) FILTER (WHERE {cond} AND {c} IS NOT NULL)"


def _entity_select() -> str:
    parts = ["patient_id", "max(stroke) AS label"]
    for n, _, _ in WIN:
        p = n.lower()
        parts.append(f'count(*) FILTER (WHERE "window" = \'{n}\') AS {p}_rows')
        for c in FEATURE_NUMERIC:
            parts.append(f'count({c}) FILTER (WHERE "window" = \'{n}\') AS {p}_{c}_n')
            parts.append(f'avg({c}) FILTER (WHERE "window" = \'{n}\') AS {p}_{c}_mean')
    for c in FEATURE_STATIC + FEATURE_RISK:
        parts.append(f"{_latest(c)} AS latest_{c}")
    complete = " AND ".join(
        f'(count(*) FILTER (WHERE "window" = \'{n}\') > 0 AND {_core_test(FEATURE_NUMERIC, n)})' for n, _, _ in WIN
    )
    parts.append(f"({complete}) AS complete")
    return "SELECT " + ",\n    ".join(parts) + " FROM frec GROUP BY patient_id"


FEATURES = f"""
ent AS ({_entity_select()})"""

BASE = [VISITS, PREPARED, FLAGGED, COHORT, PRE, COMPLETENESS, CLEANED, FEATURES]


def with_base(final: str, extra_ctes: str = "") -> str:
    ctes = ",".join(BASE) + ("," + extra_ctes if extra_ctes else "")
    return f"WITH {ctes}\n{final}"


def r6(expr: str, alias: str | None = None) -> str:
    """Round for cross-engine hashing; the 1e-9 nudge keeps exact decimal halves on one side."""
    out = f"round(({expr}) + 1e-9, 6)"
    return f"{out} AS {alias}" if alias else out


# ---------------------------------------------------------------- feature-set projections (SQL)


def set1_columns() -> list[str]:
    cols = [r6(f"{n.lower()}_{c}_mean", f"{n.lower()}_{c}_mean") for n, _, _ in WIN for c in FEATURE_NUMERIC]
    return cols + [f"latest_{c}" for c in FEATURE_STATIC]


def set2_columns() -> list[str]:
    cols = [f"latest_{c}" for c in FEATURE_STATIC]
    for c in FEATURE_NUMERIC:
        f, m, l = f"first_{c}_mean", f"mid_{c}_mean", f"last_{c}_mean"
        mean3 = f"(({f}) + ({m}) + ({l})) / 3.0"
        std = f"sqrt((power({f} - {mean3}, 2) + power({m} - {mean3}, 2) + power({l} - {mean3}, 2)) / 3.0)"
        cols += [
            r6(f, f"{c}_first_window_mean"),
            r6(m, f"{c}_mid_window_mean"),
            r6(l, f"{c}_last_window_mean"),
            r6(f"least({f}, {m}, {l})", f"{c}_temporal_min"),
            r6(f"greatest({f}, {m}, {l})", f"{c}_temporal_max"),
            r6(std, f"{c}_temporal_std"),
            r6(f, f"{c}_first_value"),
            r6(l, f"{c}_last_value"),
            r6(f"{l} - {f}", f"{c}_delta_last_first"),
            r6(f"({l} - {f}) / 6.0", f"{c}_slope_last_first"),
            f"last_{c}_n - first_{c}_n AS {c}_count_diff_last_first",
        ]
    return cols


def set3_columns() -> list[str]:
    return set2_columns() + [
        (r6(f"latest_{c}", f"latest_{c}") if c == "tc_hdl_ratio" else f"latest_{c}") for c in FEATURE_RISK
    ]


RAW_RANGES = RAW_RANGE_CHECKS
