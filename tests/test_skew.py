"""A hot entity holding a third of all rows: its records are salted across partitions; results unchanged."""

import datetime as dt
import random

from retrospark.config import CohortConfig
from retrospark.operators import cohort as C


def _skewed(spark):
    rng = random.Random(5)
    base = dt.datetime(2015, 1, 1)
    rows = []
    for e in range(1, 201):
        n = 6000 if e == 1 else 60
        for i in range(n):
            code = "I63.9" if (e % 3 == 0 and i == n - 5) else "A00"
            rows.append((e, base + dt.timedelta(days=rng.randint(0, 2000)), code, None, float(rng.randint(90, 180)), i))
    return spark.createDataFrame(rows, "hn long, vstdate timestamp, PrincipleDiagnosis string, ComorbidityDiagnosis string, bps double, k long")


def _run(spark, cfg):
    prepared = C.prepare_records(_skewed(spark), cfg)
    cohort, pre, long = C.build_windowed_records(prepared, cfg)
    comp = C.cohort_completeness(long, cfg)
    return pre, sorted(tuple(r) for r in comp.collect()), long.count()


def test_hot_entity_salted_and_results_equal(spark):
    plain_cfg = CohortConfig(core_numeric=("bps",))
    salted_cfg = CohortConfig(core_numeric=("bps",), hot_entity_rows=1000, salts=8)
    _, plain, n_plain = _run(spark, plain_cfg)
    pre, salted, n_salted = _run(spark, salted_cfg)
    assert salted == plain and n_salted == n_plain
    # the join is keyed on (entity, salt) and the hot-entity list is broadcast
    plan = pre._jdf.queryExecution().executedPlan().toString()
    assert "__salt" in plan and "BroadcastExchange" in plan


def test_records_are_shuffled_by_entity_and_salt_only(spark):
    """Between the prepared records and the joined ones there is one exchange of the records, on (entity, salt)."""
    cfg = CohortConfig(core_numeric=("bps",), hot_entity_rows=1000, salts=8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        records = spark.createDataFrame(_skewed(spark).collect(), _skewed(spark).schema)
        cohort = C.patient_cohort(records, cfg)
        plan = C.pre_reference_records(records, cohort, cfg)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert sum("__salt" in line for line in exchanges) == 2  # the records and the replicated cohort rows
    assert plan.count("SortMergeJoin") == 1 and "SortMergeJoin [hn" in plan
    bare = [line for line in exchanges if "__salt" not in line]
    assert len(bare) <= 3 and all("hashpartitioning(hn" in line for line in bare)  # partial aggregates of the cohort
