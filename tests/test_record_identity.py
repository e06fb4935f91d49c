"""Records that differ only in where their nulls are stay different records."""

import datetime as dt

from pyspark.sql import functions as F

from retrospark.config import CohortConfig, RawSchema
from retrospark.operators import cohort as C


def _raw(spark):
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    rows = [
        (1, day(0), "E11", None, 50.0),
        (1, day(0), "E11", 50.0, None),
        (1, day(0), "E11", None, 50.0),  # an exact repeat
        (1, day(400), "I63", 50.0, 50.0),
        (1, day(500), "E11", 50.0, 50.0),  # after the reference date
    ]
    return spark.createDataFrame(rows, "hn long, vstdate date, PrincipleDiagnosis string, HDL double, LDL double")


CFG = CohortConfig(schema=RawSchema(entity="hn", date="vstdate"), core_numeric=("HDL", "LDL"))


def test_null_shifted_records_are_counted_apart(spark):
    raw = _raw(spark)
    out = C.run_target_cohort(raw, CFG)
    pre = out["pre_reference_records"]
    assert pre.count() == 3 and pre.select("source_record_id").distinct().count() == 3
    audit = out["reference_date_audit"].first()
    assert (audit.total_records, audit.pre_reference_records, audit.post_reference_records_removed) == (4, 3, 1)
    steps = {r.step: r for r in out["cohort_attrition_report"].collect()}
    assert steps["pre_reference_records_only"].records_remaining == 3
    assert steps["has_any_temporal_window_record"].records_remaining == 2
    facts = out["target_cohort_summary"].first()
    assert (facts.pre_reference_source_records, facts.source_records_in_any_paper_window) == (3, 2)
    windows = {r.window: (r.records, r.source_records, r.patients) for r in out["window_distribution_report"].collect()}
    assert all(windows[w] in ((2, 2, 1), (0, 0, 0)) for w in ("FIRST", "MID", "LAST")) and windows["OUTSIDE_WINDOWS"] == (1, 1, 1)


def test_no_distinct_over_record_ids(spark):
    out = C.run_target_cohort(_raw(spark), CFG)
    for name in ("cohort_attrition_report", "window_distribution_report", "target_cohort_summary", "reference_date_audit"):
        plan = out[name]._jdf.queryExecution().optimizedPlan().toString()
        assert "Expand [" not in plan and "sha2(" not in plan, name


def test_source_record_count_of_long_rows(spark):
    long = spark.createDataFrame([(0,), (1,), (2,), (2,), (3,), (3,), (3,)], "window_membership_count int")
    row = long.agg(C.source_record_count(long).alias("n"), C.source_record_count(long, F.col("window_membership_count") > 1).alias("m")).first()
    assert (row.n, row.m) == (4, 2)


def test_anova_survives_large_offsets(spark):
    import numpy as np

    from retrospark.operators.select import anova_moments

    rng = np.random.default_rng(0)
    y = np.arange(400) % 2
    x = rng.normal(size=400) + 0.3 * y
    groups = [x[y == k] for k in (0, 1)]
    ssb = sum(len(g) * (g.mean() - x.mean()) ** 2 for g in groups)
    want = ssb / (sum(((g - g.mean()) ** 2).sum() for g in groups) / 398)
    df = spark.createDataFrame([("f", int(k), float(v) + 1e9) for k, v in zip(y, x, strict=True)], "feature string, stroke int, value double")
    assert abs(anova_moments(df, [], "stroke").first().f_score / want - 1) < 1e-5
