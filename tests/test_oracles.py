"""SQL-oracle parity on the sf0.001 tables (DuckDB) for a representative subset of the catalogue."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_oracles import TABLES, rows  # noqa: E402

from conftest import SF001  # noqa: E402

SUBSET = [
    "coh5_patient_cohort", "coh7_window_long", "coh8_temporal_completeness", "coh10_attrition_report",
    "coh12_window_distribution", "cln4_normalized_codes", "cln8_range_check_summary", "cln8_range_change_log",
    "fea5_single_shot", "fea9_extract_set_1", "fea12_extract_set_3", "fea14_exclusion_report",
    "aud2_schema_summary", "aud10_code_availability", "eda5_time_gap_summary", "eda11_descriptive_stats",
    "mod9_val1_metrics", "val6_mcnemar", "mod3_stratified_folds", "imp1_anova_ranking", "doc1_window_sensitivity",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF001}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", SUBSET)
def test_oracle_parity(spark, con, name):
    import __spark_entry__ as E

    spd = E.queries()[name](spark, SF001).toPandas()
    dpd = con.sql(E.oracle_sql()[name]).df()
    assert sorted(spd.columns) == sorted(dpd.columns)
    assert rows(spd) == rows(dpd)


def test_every_oracle_key_has_a_query():
    import __spark_entry__ as E

    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.oracle_sql()) >= 60
