"""Single-shot ties, latest-non-null, Set 2 closed forms, feature counts and dictionary."""

import datetime as dt

from pyspark.sql import functions as F

from retrospark.config import CleanSchema, FeatureConfig
from retrospark.operators import features as FE

D = dt.datetime


def _records(spark):
    # entity 1: two rows on the same (latest) date; the later order key wins; age null on the winner
    rows = [
        (1, D(2020, 1, 1), "FIRST", 1, 10, 100.0, 50.0, 0, 1),
        (1, D(2020, 1, 1), "MID", 1, 10, 100.0, 50.0, 0, 1),
        (1, D(2020, 6, 1), "LAST", 1, 20, 110.0, None, 0, 1),
        (1, D(2020, 6, 1), "LAST", 1, 30, 120.0, 60.0, None, 1),
        (1, D(2020, 9, 1), None, 1, 40, 999.0, 99.0, 0, 1),
    ]
    return spark.createDataFrame(rows, "patient_id long, visit_date timestamp, window string, stroke int, k long, bps double, age double, smoke int, sex int").withColumn(
        "source_record_id", F.xxhash64("patient_id", "visit_date", "k"))


CFG = FeatureConfig(schema=CleanSchema(order_keys=("k",)), numeric=("bps",), static=("age", "smoke", "sex"), risk=())


def test_single_shot_tie_and_latest_non_null(spark):
    agg = FE.entity_features(_records(spark), CFG)
    ss = FE.single_shot(agg, CFG).first()
    assert (ss.baseline_bps, ss.baseline_age) == (120.0, 60.0)  # k=30 beats k=20 on the same date
    sets = FE.feature_sets(agg, CFG)
    s2 = sets["extract_set_2"].first()
    assert s2.latest_smoke == 0  # k=30 has smoke null -> latest non-null is k=20's 0
    assert s2.latest_age == 60.0
    assert s2.bps_first_window_mean == 100.0 and s2.bps_last_window_mean == 115.0
    assert s2.bps_temporal_min == 100.0 and s2.bps_temporal_max == 115.0
    assert abs(s2.bps_temporal_std - (((100 - 105) ** 2 + (100 - 105) ** 2 + (115 - 105) ** 2) / 3) ** 0.5) < 1e-12
    assert s2.bps_slope_last_first == 15.0 / 6.0
    assert s2.bps_count_diff_last_first == 1


def test_last_representation(spark):
    cfg = FeatureConfig(schema=CFG.schema, numeric=("bps",), static=(), risk=(), representation="LAST")
    s1 = FE.feature_sets(FE.entity_features(_records(spark), cfg), cfg)["extract_set_1"].first()
    assert s1.last_bps_mean == 120.0 and s1.first_bps_mean == 100.0


def test_dictionary_counts():
    rows = FE.feature_dictionary_rows(FeatureConfig())
    by_set = {}
    for r in rows:
        by_set[r[4]] = by_set.get(r[4], 0) + 1
    assert len(rows) == 177
    assert by_set == {"single_shot": 21, "extract_set_1": 35, "extract_set_2": 115, "extract_set_3": 6}


def test_ratio_guard(spark):
    df = spark.createDataFrame([(1, 200.0, 50.0), (2, 200.0, 0.0), (3, 200.0, None)], "i int, cholesterol double, hdl double")
    out = {r.i: r.tc_hdl_ratio for r in FE.ensure_ratio(df).collect()}
    assert out == {1: 4.0, 2: None, 3: None}
