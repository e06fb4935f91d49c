"""Stage 02: index-event labelling, reference date, leakage cut, look-back windows, completeness.

Physical design (for very large visit tables):

* The per-entity cohort is ONE hash aggregate (partial + final), so a hot entity is
  combined map-side before the shuffle.
* The reference date is attached back to the records with an equi-join on
  (entity, salt).  Entities with more than ``hot_entity_rows`` records (known from the
  cohort's record count) get their records spread over ``salts`` partitions and their
  single cohort row replicated per salt; the list of hot entities is bounded and broadcast, so
  records are shuffled once, by (entity, salt).  The entity aggregates downstream shuffle only
  their partial aggregates.
* Where the records are deduplicated here, too (``prepare_records(..., placed=True)``), they are dealt by
  (entity, salt) before that: the dedupe, the join with the cohort rows and the dedupe of the cleaned rows
  then all work inside these partitions, and a record crosses the network once.
* Window membership is computed as multi-hot booleans on each record (no range join,
  no copy per window); the long format is a narrow ``explode_outer``.
* Completeness, window distributions and attrition roll up per entity first, then globally; source
  records are counted from ``window_membership_count`` (a record in m windows has m rows), never
  by distinct ids.  ``source_record_id`` (SHA-256 over the whole row, nulls kept) is for tracing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CLEAN_INDEX_CODE_PATTERN, INDEX_CODE_PATTERN, CohortConfig, RawSchema
from ..functions.codes import code_match, normalized_codes, q
from ..functions.dates import days_between, to_timestamp_safe
from ..functions.profile import scalar_row, stack_metrics

#: Entities whose records are salted at most (the largest ones); their list is broadcast.
HOT_ENTITIES = 10_000
#: The salt of a record that :func:`place_records` dealt by (entity, salt).
PLACE = "__salt"

#: Tags of :func:`index_flags`, sorted.
EVENT_SOURCES = ("comorbidity", "principal", "principal_and_comorbidity")

WINDOW_COLUMNS = [
    "window",
    "window_lower_months_before_reference",
    "window_upper_months_before_reference",
]


# ---------------------------------------------------------------- helpers


def order_columns(df: DataFrame, schema: RawSchema | object, date_col: str) -> list[str]:
    """Total order among an entity's rows: date first, then the configured keys (default all columns)."""
    keys = list(getattr(schema, "order_keys", ()) or [c for c in df.columns if c != date_col])
    return [date_col] + [k for k in keys if k in df.columns and k != date_col]


def order_struct(df: DataFrame, schema: RawSchema | object, date_col: str) -> Column:
    return F.struct(*[q(c) for c in order_columns(df, schema, date_col)])


def _code_test(column: str, cfg: CohortConfig) -> Column:
    if cfg.code_match == "tokenised":
        return F.coalesce(normalized_codes(column).rlike(CLEAN_INDEX_CODE_PATTERN), F.lit(False))
    return code_match(column, INDEX_CODE_PATTERN)


# ---------------------------------------------------------------- COH1 / COH2


def validate_required_columns(df: DataFrame, cfg: CohortConfig = CohortConfig()) -> None:
    """COH1: entity + date are required; at least one code column must exist."""
    s = cfg.schema
    missing = [c for c in (s.entity, s.date) if c not in df.columns]
    if missing:
        raise KeyError(f"Missing required columns: {missing}")
    codes = [s.principal_code, s.comorbidity_code]
    if all(c not in df.columns for c in codes):
        raise KeyError(f"Missing all diagnosis columns: {codes}")


def normalize_nan(df: DataFrame) -> DataFrame:
    """NaN -> null on every floating column (pandas treats NaN as missing)."""
    fixes = {
        f.name: F.when(~F.isnan(q(f.name)), q(f.name))
        for f in df.schema.fields
        if f.dataType.typeName() in ("double", "float")
    }
    return df.withColumns(fixes) if fixes else df


def place_records(df: DataFrame, cfg: CohortConfig = CohortConfig()) -> DataFrame:
    """The records dealt by (entity, ``PLACE``): equal records meet in one partition, entities of more than
    ``hot_entity_rows`` records are spread over ``salts`` of them, every other entity has salt 0."""
    e = cfg.schema.entity
    large = df.groupBy(e).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > F.lit(cfg.hot_entity_rows))
    large = large.orderBy(F.desc("__n"), e).limit(HOT_ENTITIES)
    # never null by its type, too: else a join on the salt puts a null test before this exchange, which is then made twice
    spread = F.coalesce(F.pmod(F.xxhash64(*[q(c) for c in df.columns]), F.lit(cfg.salts)), F.lit(0))
    out = df.join(F.broadcast(large.select(e, F.lit(True).alias("__hot"))), on=e, how="left")
    salt = F.when(F.col("__hot"), spread).otherwise(F.lit(0)).cast("bigint")
    return out.select(*[q(c) for c in df.columns], salt.alias(PLACE)).repartition(q(e), F.col(PLACE))


def prepare_records(df: DataFrame, cfg: CohortConfig = CohortConfig(), placed: bool = False) -> DataFrame:
    """COH2: coerce date, drop rows without entity/date, whole-row dedupe, coerce core numerics.

    With ``placed`` the records are dealt by entity before the dedupe and keep their ``PLACE``.
    """
    validate_required_columns(df, cfg)
    s = cfg.schema
    dtype = dict(df.dtypes)[s.date]
    out = normalize_nan(df).withColumn(s.date, to_timestamp_safe(q(s.date), dtype))
    out = out.where(q(s.entity).isNotNull() & q(s.date).isNotNull())
    out = (place_records(out, cfg) if placed else out).dropDuplicates()
    casts = {c: F.nanvl(q(c).try_cast("double"), F.lit(None).cast("double")) for c in cfg.core_numeric if c in out.columns}
    return out.withColumns(casts) if casts else out


# ---------------------------------------------------------------- COH3 / COH4 / COH5


def index_flags(records: DataFrame, cfg: CohortConfig = CohortConfig()) -> DataFrame:
    """COH3 + COH4: ``is_index_event`` (OR over code columns) and its source tag."""
    s = cfg.schema
    has_p = s.principal_code in records.columns
    has_c = s.comorbidity_code in records.columns
    p = _code_test(s.principal_code, cfg) if has_p else F.lit(False)
    c = _code_test(s.comorbidity_code, cfg) if has_c else F.lit(False)
    source = (
        F.when(p & c, F.lit("principal_and_comorbidity"))
        .when(p, F.lit("principal"))
        .when(c, F.lit("comorbidity"))
        .otherwise(F.lit(""))
    )
    return records.withColumns({"is_index_event": p | c, "index_event_source": source})


def patient_cohort(records: DataFrame, cfg: CohortConfig = CohortConfig()) -> DataFrame:
    """COH5: one row per entity from a single aggregate.

    Columns: entity, first/last visit date, record count, first index date, index event count,
    sorted distinct event sources, label (``stroke``), reference date + rule, follow-up days.
    """
    return _cohort(records, cfg).drop("__places")


def _cohort(records: DataFrame, cfg: CohortConfig) -> DataFrame:
    """COH5; of placed records also ``__places``, the salts that the entity's records may have."""
    s = cfg.schema
    placed = PLACE in records.columns
    flagged = index_flags(records, cfg)
    idx = F.col("is_index_event")
    agg = flagged.groupBy(s.entity).agg(
        F.min(s.date).alias("first_visit_date"),
        F.max(s.date).alias("last_visit_date"),
        F.count(F.lit(1)).alias("record_count"),
        F.min(F.when(idx, q(s.date))).alias("first_stroke_date"),
        F.count_if(idx).alias("stroke_event_count"),
        *[F.coalesce(F.max(idx & (F.col("index_event_source") == t)), F.lit(False)).alias(f"_{t}") for t in EVENT_SOURCES],
        *([F.max(PLACE).alias("__last")] if placed else []),
    )  # buffers of fixed width: a hash aggregate, no sort of the records
    sources = F.array_compact(F.array(*[F.when(F.col(f"_{t}"), F.lit(t)) for t in EVENT_SOURCES]))
    zero, last = F.lit(0).cast("bigint"), F.lit(cfg.salts - 1).cast("bigint")
    places = [F.when(F.col("__last") > 0, F.sequence(zero, last)).otherwise(F.array(zero)).alias("__places")] if placed else []
    ref = F.coalesce(F.col("first_stroke_date"), F.col("last_visit_date"))
    return agg.select(
        s.entity,
        "first_visit_date",
        "last_visit_date",
        "record_count",
        "first_stroke_date",
        "stroke_event_count",
        F.array_join(sources, ",").alias("stroke_event_sources"),
        F.col("first_stroke_date").isNotNull().cast("int").alias("stroke"),
        ref.alias("reference_date"),
        F.when(F.col("first_stroke_date").isNotNull(), F.lit("first_stroke_date"))
        .otherwise(F.lit("last_visit_date"))
        .alias("reference_rule"),
        days_between(ref, F.col("first_visit_date")).alias("followup_days_before_reference"),
        *places,
    )


# ---------------------------------------------------------------- COH6 / COH7


def window_flag_columns(cfg: CohortConfig) -> list[str]:
    return [f"in_{name.lower()}_window" for name in cfg.window_names]


def record_id(columns: list[str]) -> Column:
    """Null-safe content hash of a source record."""
    return F.sha2(F.to_json(F.struct(*[q(c) for c in columns]), {"ignoreNullFields": "false"}).cast("binary"), 256)


def with_record_ids(records: DataFrame, columns: list[str]) -> DataFrame:
    """``source_record_id`` of records built without it (``identified=False``), in its place among the columns."""
    at = records.columns.index("days_before_reference")
    names = [q(c) for c in records.columns]
    return records.select(*names[:at], record_id(columns).alias("source_record_id"), *names[at:])


def pre_reference_records(records: DataFrame, cohort: DataFrame, cfg: CohortConfig = CohortConfig(), identified: bool = True) -> DataFrame:
    """COH6: leakage cut (inclusive) + days/months before reference + null-safe content-hash record id.

    One row per source record, with multi-hot window flags and ``window_membership_count``.  Placed
    records are joined where they are (``cohort`` then holds their ``__places``) and keep their ``PLACE``.
    The id may be left for later (:func:`with_record_ids`): compared with others, a record needs its columns only.
    """
    s = cfg.schema
    rid = record_id([c for c in records.columns if c != PLACE])
    joined = _placed_join(records, cohort, cfg) if PLACE in records.columns else _salted_join(records, cohort, cfg).drop(PLACE)
    joined = joined.where(q(s.date) <= F.col("reference_date"))
    days = days_between(F.col("reference_date"), q(s.date))
    out = joined.withColumns(
        {
            **({"source_record_id": rid} if identified else {}),
            "days_before_reference": days,
        }
    ).withColumn("months_before_reference", F.col("days_before_reference") / F.lit(cfg.month_days))
    m = F.col("months_before_reference")
    flags = {f"in_{name.lower()}_window": m.between(lo, hi) for name, lo, hi in cfg.windows}
    out = out.withColumns(flags)
    count = sum((F.col(f).cast("int") for f in flags), F.lit(0))
    return out.withColumn("window_membership_count", count)


def _placed_join(records: DataFrame, cohort: DataFrame, cfg: CohortConfig) -> DataFrame:
    """Records of :func:`place_records` with their cohort row, of which every place of the entity gets a copy."""
    e = cfg.schema.entity
    # with the record count the cohort needs records without copies, hence the same exchange as the records beside it: by
    # minima and maxima alone it would get an exchange of its own with some of their columns
    side = cohort.where(F.col("record_count") > 0).select(e, "stroke", "reference_date", "reference_rule", F.explode("__places").alias(PLACE))
    joined = records.join(side.hint("shuffle_hash"), on=[e, PLACE])  # a partition holds few entities beside its records
    return joined.select(*[q(c) for c in records.columns if c != PLACE], "stroke", "reference_date", "reference_rule", PLACE)


def _salted_join(records: DataFrame, cohort: DataFrame, cfg: CohortConfig) -> DataFrame:
    s = cfg.schema
    spread = F.pmod(F.xxhash64(*[q(c) for c in records.columns]), F.lit(cfg.salts))
    # Salted join for hot entities: their records spread over ``salts`` partitions and their
    # single cohort row is replicated once per salt; every other entity keeps salt 0.  The list of
    # hot entities holds the HOT_ENTITIES largest at most, so it is broadcast; an entity beyond them
    # has no more than that part of all records.
    large = cohort.where(F.col("record_count") > F.lit(cfg.hot_entity_rows)).orderBy(F.desc("record_count"), s.entity).limit(HOT_ENTITIES)
    hot = F.broadcast(large.select(s.entity, F.lit(True).alias("__hot")))
    rec = records.join(hot, on=s.entity, how="left").withColumn(
        "__salt", F.when(F.col("__hot"), spread).otherwise(F.lit(0)).cast("bigint")
    ).drop("__hot")
    salts = F.when(F.col("__hot"), F.sequence(F.lit(0).cast("bigint"), F.lit(cfg.salts - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    side = cohort.join(hot, on=s.entity, how="left").select(s.entity, "stroke", "reference_date", "reference_rule", F.explode(salts).alias("__salt"))
    return rec.join(side, on=[s.entity, "__salt"], how="inner")


def window_long(pre: DataFrame, cfg: CohortConfig = CohortConfig(), keep_flags: bool = False) -> DataFrame:
    """COH7: one row per (record, window it belongs to); records in no window keep one null-window row."""
    flags = window_flag_columns(cfg)
    members = F.filter(
        F.array(
            *[
                F.when(
                    F.col(flag),
                    F.struct(F.lit(name).alias("name"), F.lit(float(lo)).alias("lower"), F.lit(float(hi)).alias("upper")),
                )
                for flag, (name, lo, hi) in zip(flags, cfg.windows)
            ]
        ),
        lambda x: x.isNotNull(),
    )
    out = pre.withColumn("_w", F.explode_outer(members)).withColumns(
        {
            "window": F.col("_w.name"),
            "window_lower_months_before_reference": F.col("_w.lower"),
            "window_upper_months_before_reference": F.col("_w.upper"),
            "is_paper_observation_window": F.col("_w").isNotNull(),
        }
    ).drop("_w")
    return out if keep_flags else out.drop(*flags)


def build_windowed_records(records: DataFrame, cfg: CohortConfig = CohortConfig(), identified: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """prepared records -> (cohort, pre-reference per record, long format); placed records keep their ``PLACE``."""
    cohort = _cohort(records, cfg)
    pre = pre_reference_records(records, cohort, cfg, identified)
    return cohort.drop("__places"), pre, window_long(pre, cfg)


# ---------------------------------------------------------------- COH8


def temporal_completeness(
    long: DataFrame,
    entity: str,
    window_names: list[str],
    core: list[str],
    has_core_suffix: str = "has_core_clinical",
    min_core: int | None = None,
    extra_columns: bool = True,
) -> DataFrame:
    """COH8 / FEA7: per entity and window, >=1 row and >=1 non-null value of each core column.

    ``min_core`` (DOC2) relaxes the test to "at least ``min_core`` core columns observed".
    No available core column -> never complete.
    """
    available = [c for c in core if c in long.columns]
    aggs = []
    for w in window_names:
        in_w = F.col("window") == F.lit(w)
        aggs.append(F.count_if(in_w).alias(f"{w.lower()}_visit_count"))
        for i, c in enumerate(available):
            aggs.append(F.max(in_w & q(c).isNotNull()).alias(f"__{w.lower()}_{i}"))
    grouped = long.groupBy(entity).agg(*aggs)
    cols: list[Column] = [F.col(entity)]
    complete = F.lit(True)
    for w in window_names:
        p = w.lower()
        has_visit = F.col(f"{p}_visit_count") > 0
        observed = [F.coalesce(F.col(f"__{p}_{i}"), F.lit(False)) for i in range(len(available))]
        if not available:
            has_core = F.lit(False)
        elif min_core is None:
            has_core = observed[0]
            for o in observed[1:]:
                has_core = has_core & o
        else:
            has_core = sum((o.cast("int") for o in observed), F.lit(0)) >= F.lit(min_core)
        cols += [
            F.col(f"{p}_visit_count").cast("bigint").alias(f"{p}_visit_count"),
            has_visit.alias(f"{p}_has_visit"),
            has_core.alias(f"{p}_{has_core_suffix}"),
        ]
        complete = complete & has_visit & has_core
    if extra_columns:
        cols += [
            F.lit(",".join(available)).alias("core_clinical_columns_checked"),
            F.lit(len(available)).cast("bigint").alias("core_clinical_column_count_checked"),
        ]
    cols.append(complete.alias("temporal_complete"))
    return grouped.select(*cols)


def cohort_completeness(long: DataFrame, cfg: CohortConfig = CohortConfig()) -> DataFrame:
    return temporal_completeness(long, cfg.schema.entity, cfg.window_names, list(cfg.core_numeric), min_core=cfg.min_core)


# ---------------------------------------------------------------- COH9 - COH16


def source_record_count(df: DataFrame, where: Column | None = None, windows: int = 3) -> Column:
    """COH9: number of source records of a long table (overlapping window rows counted once).

    A record in m windows has m rows, each counts 1/m (as integers over the least common multiple
    of 1..``windows``).  Tables without ``window_membership_count`` hold one row per record.
    """
    if "window_membership_count" not in df.columns:
        return F.count(F.lit(1)) if where is None else F.count_if(where)
    unit = math.lcm(*range(1, max(windows, 1) + 1))
    share = (F.lit(unit) / F.greatest(F.col("window_membership_count"), F.lit(1))).cast("bigint")
    total = F.sum(share if where is None else F.when(where, share))
    return F.coalesce(F.call_function("div", total, F.lit(unit).cast("bigint")), F.lit(0).cast("bigint"))


def entity_rollup(long: DataFrame, cfg: CohortConfig = CohortConfig()) -> DataFrame:
    """One row per entity: source records, those in a window, window rows, records in several windows."""
    in_w = F.col("window").isNotNull()
    n = len(cfg.windows)
    return long.groupBy(cfg.schema.entity).agg(
        source_record_count(long, windows=n).alias("pre_records"),
        source_record_count(long, in_w, n).alias("win_records"),
        source_record_count(long, F.col("window_membership_count") > 1, n).alias("multi_records"),
        F.count(F.lit(1)).alias("long_rows"),
        F.count_if(in_w).alias("win_rows"),
    )


def attrition_report(raw: DataFrame, prepared: DataFrame, long: DataFrame, completeness: DataFrame, cfg: CohortConfig = CohortConfig()) -> DataFrame:
    """COH10: six attrition steps with entities/records remaining and removed."""
    e = cfg.schema.entity
    raw_stats = raw.groupBy(e).agg(F.count(F.lit(1)).alias("n")).agg(F.count(e).alias("raw_patients"), F.coalesce(F.sum("n"), F.lit(0)).alias("raw_records"))
    prep_stats = prepared.groupBy(e).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("prep_patients"), F.coalesce(F.sum("n"), F.lit(0)).alias("prep_records"))
    per_entity = entity_rollup(long, cfg).join(completeness.select(e, "temporal_complete"), on=e, how="left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("bigint"))
    long_stats = per_entity.agg(
        F.count(F.lit(1)).alias("pre_patients"),
        zero("pre_records").alias("pre_records"),
        F.count_if(F.col("win_rows") > 0).alias("win_patients"),
        zero("win_records").alias("win_records"),
        zero("win_rows").alias("win_rows"),
        zero(F.when(F.col("temporal_complete"), F.col("win_rows"))).alias("complete_rows"),
        F.count_if("temporal_complete").alias("complete_patients"),
    )
    row = scalar_row(raw_stats, prep_stats, long_stats)
    col = F.col
    steps = [
        ("raw_input", col("raw_patients"), col("raw_records"), F.lit(0), F.lit(0), "Raw input before Stage 02 filtering"),
        (
            "valid_patient_and_visit_date",
            col("prep_patients"),
            col("prep_records"),
            col("raw_patients") - col("prep_patients"),
            col("raw_records") - col("prep_records"),
            "Drop rows without patient id or valid visit date and exact duplicates",
        ),
        (
            "pre_reference_records_only",
            col("pre_patients"),
            col("pre_records"),
            F.lit(0),
            col("prep_records") - col("pre_records"),
            "Remove records after reference date to prevent leakage",
        ),
        (
            "has_any_temporal_window_record",
            col("win_patients"),
            col("win_records"),
            col("pre_patients") - col("win_patients"),
            col("pre_records") - col("win_records"),
            "Keep source records assigned to at least one overlapping FIRST/MID/LAST window",
        ),
        (
            "overlapping_window_long_format",
            col("win_patients"),
            col("win_rows"),
            F.lit(0),
            F.lit(0),
            "Expand eligible source records to one row per overlapping window membership",
        ),
        (
            "temporal_complete",
            col("complete_patients"),
            col("complete_rows"),
            col("win_patients") - col("complete_patients"),
            F.lit(0),
            "Require visit and core clinical coverage in FIRST, MID, LAST",
        ),
    ]
    structs = [
        F.struct(
            F.lit(i).alias("step_order"),
            F.lit(name).alias("step"),
            pr.cast("bigint").alias("patients_remaining"),
            rr.cast("bigint").alias("records_remaining"),
            pd.cast("bigint").alias("patients_removed_at_step"),
            rd.cast("bigint").alias("records_removed_at_step"),
            F.lit(reason).alias("reason"),
        )
        for i, (name, pr, rr, pd, rd, reason) in enumerate(steps, start=1)
    ]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def reference_date_audit(prepared: DataFrame, cohort: DataFrame, long: DataFrame, cfg: CohortConfig = CohortConfig()) -> DataFrame:
    """COH11: per entity rule validity and how many records the leakage cut removed."""
    e = cfg.schema.entity
    total = prepared.groupBy(e).agg(F.count(F.lit(1)).alias("total_records"))
    pre = long.groupBy(e).agg(source_record_count(long, windows=len(cfg.windows)).alias("pre_reference_records"))
    a = cohort.join(total, on=e, how="left").join(pre, on=e, how="left")
    pre_n = F.coalesce(F.col("pre_reference_records"), F.lit(0)).cast("bigint")
    valid = ((F.col("stroke") == 1) & (F.col("reference_date") == F.col("first_stroke_date"))) | (
        (F.col("stroke") == 0) & (F.col("reference_date") == F.col("last_visit_date"))
    )
    return a.select(
        e,
        "stroke",
        "first_visit_date",
        "last_visit_date",
        "first_stroke_date",
        "reference_date",
        "reference_rule",
        F.coalesce(valid, F.lit(False)).alias("reference_rule_valid"),
        F.col("total_records").cast("bigint").alias("total_records"),
        pre_n.alias("pre_reference_records"),
        (F.col("total_records") - pre_n).cast("bigint").alias("post_reference_records_removed"),
        "stroke_event_count",
        "stroke_event_sources",
        "followup_days_before_reference",
    )


def _window_catalog(spark, cfg: CohortConfig, outside: str = "OUTSIDE_WINDOWS") -> DataFrame:
    rows = [(i, n, float(lo), float(hi)) for i, (n, lo, hi) in enumerate(cfg.windows, start=1)]
    rows.append((len(rows) + 1, outside, None, None))
    return spark.createDataFrame(rows, "window_order int, window string, lower_months_before_reference double, upper_months_before_reference double")


def window_distribution(long: DataFrame, cfg: CohortConfig = CohortConfig(), label: str = "stroke") -> DataFrame:
    """COH12: rows, source rows, entities and entities by label per window (+ OUTSIDE_WINDOWS).

    Windows with no rows are kept (left join from the window list).
    """
    e = cfg.schema.entity
    key = F.coalesce(F.col("window"), F.lit("OUTSIDE_WINDOWS")).alias("window")
    # a record has one row per window it belongs to: rows of a window are its source records
    per_entity = long.groupBy(key, q(e)).agg(F.count(F.lit(1)).alias("n"), F.max(label).alias("__label"))
    stats = per_entity.groupBy("window").agg(
        F.sum("n").alias("records"),
        F.sum("n").alias("source_records"),
        F.count(F.lit(1)).alias("patients"),
        F.count_if(F.col("__label") == 1).alias("stroke_patients"),
        F.count_if(F.col("__label") == 0).alias("nonstroke_patients"),
    )
    cat = _window_catalog(long.sparkSession, cfg)
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return cat.join(stats, on="window", how="left").select(
        "window_order", "window", "lower_months_before_reference", "upper_months_before_reference",
        z("records"), z("source_records"), z("patients"), z("stroke_patients"), z("nonstroke_patients"),
    )


MEMBERSHIP_MEANING = {
    0: "outside FIRST/MID/LAST observation windows",
    1: "belongs to one paper window",
    2: "belongs to two overlapping paper windows",
    3: "belongs to all FIRST/MID/LAST windows",
}


def membership_report(pre: DataFrame) -> DataFrame:
    """COH13: histogram of window-membership counts over distinct source records."""
    meaning = F.lit(None).cast("string")
    for k, v in reversed(list(MEMBERSHIP_MEANING.items())):
        meaning = F.when(F.col("window_membership_count") == k, F.lit(v)).otherwise(meaning)
    return (
        pre.groupBy(F.col("window_membership_count").cast("bigint").alias("window_membership_count"))
        .agg(F.count(F.lit(1)).alias("source_records"))
        .withColumn("meaning", meaning)
    )


def completeness_summary(completeness: DataFrame, cfg: CohortConfig = CohortConfig(), has_core_suffix: str = "has_core_clinical") -> DataFrame:
    """COH14: patients checked, per-window visit/core coverage, complete patients."""
    aggs = [F.count(F.lit(1)).alias("patients_checked")]
    metrics: list[tuple[str, Column, str]] = [("patients_checked", F.col("patients_checked"), "")]
    for w in cfg.window_names:
        p = w.lower()
        aggs += [F.count_if(f"{p}_has_visit").alias(f"{p}_v"), F.count_if(f"{p}_{has_core_suffix}").alias(f"{p}_c")]
        metrics += [
            (f"{p}_has_visit_patients", F.col(f"{p}_v"), ""),
            (f"{p}_{has_core_suffix}_patients", F.col(f"{p}_c"), ""),
        ]
    aggs.append(F.count_if("temporal_complete").alias("complete"))
    metrics.append(("temporal_complete_patients", F.col("complete"), "visit and core clinical coverage in FIRST, MID, LAST"))
    return stack_metrics(completeness.agg(*aggs), metrics, value_type="bigint")


def _checks(row: DataFrame, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    structs = [
        F.struct(F.lit(i).alias("check_order"), F.lit(n).alias("check"), F.coalesce(p, F.lit(False)).alias("passed"), d.cast("string").alias("detail"))
        for i, (n, p, d) in enumerate(checks, start=1)
    ]
    return row.select(F.explode(F.array(*structs)).alias("c")).select("c.*")


def cohort_facts(cohort: DataFrame, long: DataFrame, completeness: DataFrame, cfg: CohortConfig = CohortConfig()) -> DataFrame:
    """COH16: one-row invariants and counts (the stage's quality record)."""
    s = cfg.schema
    c = cohort.agg(
        F.count(F.lit(1)).alias("patients"),
        F.count_if(F.col("stroke") == 1).alias("stroke_patients"),
        F.count_if(F.col("stroke") == 0).alias("nonstroke_patients"),
        F.coalesce(F.bool_and(F.when(F.col("stroke") == 1, F.col("first_stroke_date") == F.col("reference_date"))), F.lit(True)).alias("stroke_reference_is_first_stroke_date"),
        F.coalesce(F.bool_and(F.when(F.col("stroke") == 0, F.col("last_visit_date") == F.col("reference_date"))), F.lit(True)).alias("nonstroke_reference_is_last_visit_date"),
    )
    n = F.lit(0).cast("bigint")
    per_entity = entity_rollup(long, cfg)
    lg = per_entity.agg(
        F.coalesce(F.sum("pre_records"), n).alias("pre_reference_source_records"),
        F.coalesce(F.sum("long_rows"), n).alias("pre_reference_rows_after_window_expansion"),
        F.coalesce(F.sum("win_rows"), n).alias("paper_observation_window_rows"),
        F.coalesce(F.sum("win_records"), n).alias("source_records_in_any_paper_window"),
        F.coalesce(F.sum("multi_records"), n).alias("source_records_with_multiple_window_memberships"),
        F.count_if(F.col("win_rows") > 0).alias("patients_in_any_paper_window"),
    )
    whole = long.agg(
        F.coalesce(F.bool_and(q(s.date) <= F.col("reference_date")), F.lit(True)).alias("no_post_reference_records"),
        F.array_sort(F.collect_set("window")).alias("observed_windows"),
    )
    cp = completeness.agg(F.count_if("temporal_complete").alias("temporal_complete_patients"))
    return scalar_row(c, lg, whole, cp)


def cohort_acceptance(cohort: DataFrame, long: DataFrame, completeness: DataFrame, attrition: DataFrame, cfg: CohortConfig = CohortConfig()) -> DataFrame:
    """COH15: the seven acceptance checks of the cohort stage."""
    facts = cohort_facts(cohort, long, completeness, cfg)
    att = attrition.agg(F.max(F.col("step") == "temporal_complete").alias("att_ok"))
    row = scalar_row(facts, att)
    expected = sorted(cfg.window_names)
    observed_ok = F.forall(F.array(*[F.lit(w) for w in expected]), lambda x: F.array_contains(F.col("observed_windows"), x))
    checks = [
        ("stroke_reference_is_first_stroke_date", F.col("stroke_reference_is_first_stroke_date"), F.lit("first stroke event date")),
        ("nonstroke_reference_is_last_visit_date", F.col("nonstroke_reference_is_last_visit_date"), F.lit("last clinical visit date")),
        ("no_post_reference_records", F.col("no_post_reference_records"), F.lit("all output records must have visit_date <= reference_date")),
        (
            "paper_default_windows_used",
            observed_ok,
            F.concat(F.lit("observed="), F.array_join(F.col("observed_windows"), ","), F.lit(" expected=" + ",".join(expected))),
        ),
        ("overlapping_window_membership_supported", F.col("source_records_with_multiple_window_memberships") > 0, F.lit("one source medical record can appear in multiple FIRST/MID/LAST rows")),
        ("attrition_reports_temporal_completeness", F.col("att_ok"), F.lit("cohort_attrition_report includes temporal_complete step")),
        ("temporal_complete_cohort_reported", F.lit(True), F.concat(F.lit("temporal_complete_patients="), F.col("temporal_complete_patients").cast("string"))),
    ]
    return _checks(row, checks)


def run_target_cohort(raw: DataFrame, cfg: CohortConfig = CohortConfig(), prepared: DataFrame | None = None) -> dict[str, DataFrame]:
    """COH17: all stage-02 tables, lazily (nothing is executed here).

    ``prepared`` may be given already materialised (the pipeline writes it once so the cohort
    aggregate and the reference-date join read it instead of re-scanning the raw input).
    """
    prepared = prepared if prepared is not None else prepare_records(raw, cfg)
    cohort, pre, long = build_windowed_records(prepared, cfg)
    completeness = cohort_completeness(long, cfg)
    attrition = attrition_report(raw, prepared, long, completeness, cfg)
    return {
        "prepared": prepared,
        "patient_level_cohort": cohort,
        "pre_reference_records": pre,
        "pre_reference_records_with_windows": long,
        "temporal_completeness_flags": completeness,
        "temporal_completeness_summary": completeness_summary(completeness, cfg),
        "cohort_attrition_report": attrition,
        "reference_date_audit": reference_date_audit(prepared, cohort, long, cfg),
        "window_distribution_report": window_distribution(long, cfg),
        "window_membership_report": membership_report(pre),
        "target_cohort_acceptance_checks": cohort_acceptance(cohort, long, completeness, attrition, cfg),
        "target_cohort_summary": cohort_facts(cohort, long, completeness, cfg),
    }
