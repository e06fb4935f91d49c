"""Reports on the cleaned table come from metrics taken while it is written."""

import tempfile

import pytest
from conftest import SF001

from retrospark.operators import cleaning as CL
from retrospark.plans import catalog
from retrospark.sources.visits import FIXTURE_CLEAN

REPORTS = ("missing_summary_after_cleaning", "required_column_report", "binary_validation_report", "leakage_audit_report", "no_post_reference")


def stored(spark, how):
    folder = tempfile.mkdtemp(prefix="retrospark-observed-")

    def parquet(df):
        df.write.mode("overwrite").parquet(folder)
        return spark.read.parquet(folder)

    return parquet if how == "parquet" else lambda df: df.checkpoint()


@pytest.mark.parametrize("how", ["parquet", "checkpoint"])
def test_observed_reports_equal_scanned_ones(spark, how):
    long = catalog.core2(spark, SF001)[4]
    want = CL.run_data_cleaning(long, FIXTURE_CLEAN)
    got = CL.run_data_cleaning(long, FIXTURE_CLEAN, write=stored(spark, how))
    assert got["cleaned_pre_reference_records"].count() == want["cleaned_pre_reference_records"].count()
    for name in REPORTS:
        assert got[name].schema == want[name].schema and got[name].collect() == want[name].collect(), name
        plan = got[name]._jdf.queryExecution().executedPlan().toString()
        assert "Scan parquet" not in plan and "Exchange" not in plan, name


@pytest.mark.parametrize("how", ["parquet", "checkpoint"])
def test_observed_reports_of_an_empty_table(spark, how):
    long = catalog.core2(spark, SF001)[4].where("1 = 0")
    want = CL.run_data_cleaning(long, FIXTURE_CLEAN)
    got = CL.run_data_cleaning(long, FIXTURE_CLEAN, write=stored(spark, how))
    for name in REPORTS:
        assert got[name].collect() == want[name].collect(), name


def test_observed_reports_without_date_columns(spark):
    long = catalog.core2(spark, SF001)[4].drop("reference_date")
    got = CL.run_data_cleaning(long, FIXTURE_CLEAN, write=stored(spark, "checkpoint"))
    assert got["no_post_reference"].collect()[0][0] is None
    assert [r.passed for r in got["leakage_audit_report"].collect()] == [False]
