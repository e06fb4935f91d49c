"""Reports read the records dealt by entity once: one exchange of whole records, one run of a table that is summarised."""

import re

from pyspark.sql import functions as F

from retrospark.config import CohortConfig, RawSchema
from retrospark.functions.profile import exact_quantiles
from retrospark.operators import cohort as C
from retrospark.operators import evaluate as EV
from retrospark.operators import explore as EX


def _subtrees(plan: str, node: str) -> set[str]:
    """The subtrees of the plan under ``node``, without expression numbers."""
    lines = [re.sub(r"#\d+L?", "", x) for x in plan.splitlines()]
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    found = set()
    for i, x in enumerate(lines):
        if x.lstrip(" :+-").startswith(node):
            below = next((j for j in range(i + 1, len(lines)) if depth(lines[j]) <= depth(x)), len(lines))
            found.add("\n".join(y.lstrip(" :+-") for y in lines[i:below]))
    return found


def test_reports_share_one_exchange_of_the_records(spark):
    visits = spark.range(200).selectExpr(
        "id % 20 AS hn", "timestamp'2015-01-01' + make_dt_interval(cast(id * 9 % 900 as int)) AS vstdate",
        "if(id % 31 = 0, 'I63', 'A00') AS PrincipleDiagnosis", "cast(NULL AS string) AS ComorbidityDiagnosis", "90.0D + id % 50 AS bps", "id AS k")
    cfg = CohortConfig(schema=RawSchema(order_keys=("k",)), core_numeric=("bps",), hot_entity_rows=5, salts=4)
    prepared = C.prepare_records(visits, cfg, placed=True)
    cohort, _, long = C.build_windowed_records(prepared, cfg)
    prepared, cohort, long = (t.drop(C.PLACE) for t in (prepared, cohort, long))
    completeness = C.cohort_completeness(long, cfg)
    for report in (C.attrition_report(visits, prepared, long, completeness, cfg), C.reference_date_audit(prepared, cohort, long, cfg)):
        assert len(_subtrees(report._jdf.queryExecution().optimizedPlan().toString(), "RepartitionByExpression")) == 1
    audit = C.reference_date_audit(prepared, cohort, long, cfg)
    assert audit.agg(F.sum("total_records"), F.count(F.lit(1))).first()[:] == (200, 20)
    plain = C.prepare_records(visits, cfg)
    cohort, _, long = C.build_windowed_records(plain, cfg)
    assert sorted(map(tuple, C.reference_date_audit(plain, cohort, long, cfg).collect())) == sorted(map(tuple, audit.collect()))


def test_visit_distribution_reads_the_entities_once(spark):
    freq = spark.range(100).selectExpr("id % 17 AS p").groupBy("p").agg(F.count(F.lit(1)).alias("visit_count"))
    out = EX.visit_distribution(freq)
    assert "Range (" not in out._jdf.queryExecution().executedPlan().toString()  # only the kept counts
    assert out.first().asDict() == {"patients": 17, "mean_visits": 100 / 17, "median_visits": 6.0, "min_visits": 5, "max_visits": 6, "p25_visits": 6.0, "p75_visits": 6.0}
    empty = EX.visit_distribution(freq.where("p < 0")).first().asDict()
    assert set(empty.values()) == {0} and len(empty) == 7
    missing = EX.visit_distribution(freq.select(F.when(F.col("p") > 0, F.col("visit_count")).alias("visit_count"))).first()
    assert (missing.patients, missing.max_visits) == (17, 6)


def test_quantiles_shuffle_the_values_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = exact_quantiles(spark.range(1000).selectExpr("id % 3 AS g", "cast(id AS double) AS v"), ["g"], "v", [0.5], buckets=4)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") <= 2  # asked ranks with their buckets, quantiles with moments: no values
    assert [r.q0 for r in out.orderBy("g").collect()] == [499.5, 499.0, 500.0]


def test_ranks_are_cut_by_one_set_of_boundaries(spark):
    preds = spark.range(60_000, numPartitions=16).selectExpr(
        "id AS patient_id", "'m' AS model_name", "cast(xxhash64(id) % 2 = 0 AS int) AS y_true", "0 AS y_pred", "(xxhash64(id, 7) % 1000003) / 1000003D AS y_prob")
    ranked = EV.cumulative_below(EV.score_table(preds), ["model_name"])
    # approximate boundaries made twice may differ: counts below a score would then be wrong, and its precision a division by zero
    assert "percentile_approx" not in ranked._jdf.queryExecution().optimizedPlan().toString()
    assert ranked.where("pos_below < 0 OR neg_below < 0").count() == 0
    rows = sorted(map(tuple, ranked.select("score", "pos", "neg", "pos_below", "neg_below").collect()))
    pos = neg = 0
    for _, p, n, pos_below, neg_below in rows:
        assert (pos, neg) == (pos_below, neg_below)
        pos, neg = pos + p, neg + n
    values = preds.select("model_name", "y_prob")
    out = exact_quantiles(values, ["model_name"], "y_prob", [0.5], buckets=64)
    assert "percentile_approx" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.first().q0 == values.agg(F.percentile("y_prob", 0.5)).first()[0]
