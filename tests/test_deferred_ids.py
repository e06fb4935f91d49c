"""Record ids are computed after the dedupe and only where they are read; the cohort aggregate needs no sort."""

import datetime as dt

from pyspark.sql import functions as F

from retrospark.config import CleanSchema, CohortConfig, RawSchema
from retrospark.operators import cleaning as CL
from retrospark.operators import cohort as C

RAW = RawSchema(quasi_identifiers=("place",))
CFG, CLEAN = CohortConfig(schema=RAW), CleanSchema(quasi_identifiers=("place",))


def _raw(spark):
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i)
    rows = [(e, day(97 * i), "I63" if (e + i) % 7 == 6 else "A10", "I60" if (e * i) % 5 == 4 else None, float(i), "pq"[i % 2]) for e in range(6) for i in range(8)]
    rows += rows[:9] + [(0, day(0), "A10", None, 0.0, "other")]  # copies, and a row that differs in the place alone
    return spark.createDataFrame(rows, "hn int, vstdate date, PrincipleDiagnosis string, ComorbidityDiagnosis string, bps double, place string")


def _tables(spark):
    raw = _raw(spark)
    prepared = C.prepare_records(raw, CFG, placed=True)
    return raw, prepared, C.build_windowed_records(prepared, CFG)[2], C.build_windowed_records(prepared, CFG, identified=False)[2]


def test_same_cleaned_rows_and_ids(spark):
    raw, _, long, plain = _tables(spark)
    want = CL.clean_records(long, CLEAN)
    got = CL.clean_records(plain, CLEAN, raw.columns)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(got) == rows(want) and got.count() > 0
    assert rows(CL.distinct_records(plain.unionByName(plain), CLEAN, raw.columns)) == rows(CL.distinct_records(long, CLEAN))


def test_ids_are_not_computed_where_they_are_not_read(spark):
    raw, _, _, plain = _tables(spark)
    plan = CL.clean_records(plain, CLEAN, raw.columns).groupBy("patient_id").agg(F.max("bps"))._jdf.queryExecution().toString()
    assert "sha2(" not in plan.split("== Optimized Logical Plan ==")[1]


def test_cohort_is_a_hash_aggregate_with_the_same_sources(spark):
    _, prepared, _, _ = _tables(spark)
    cohort = C.patient_cohort(prepared, CFG)
    plan = cohort._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    flagged = C.index_flags(prepared, CFG).where("is_index_event").groupBy("hn").agg(F.array_join(F.array_sort(F.collect_set("index_event_source")), ",").alias("s"))
    want = {r.hn: r.s for r in flagged.collect()}
    assert {r.hn: r.stroke_event_sources for r in cohort.collect()} == {e: want.get(e, "") for e in range(6)}
    assert want
