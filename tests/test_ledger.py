"""A run that is cut off goes on after its last finished stage; damaged stages run again."""

import glob
import os
import tempfile

import pytest
from conftest import SF001

from retrospark.operators import audit as AU
from retrospark.operators import cleaning as CL
from retrospark.operators import cohort as C
from retrospark.operators import explore as EX
from retrospark.plans.ledger import RunLedger
from retrospark.plans.pipeline import PipelineConfig, run_pipeline
from retrospark.sources.visits import FIXTURE_CLEAN, FIXTURE_RAW, fixture_visits


class Stopped(Exception):
    pass


def stop(*args, **kwargs):
    raise Stopped


def test_run_resumes_after_its_last_finished_stage(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="retrospark-ledger-")
    cfg = PipelineConfig(raw=FIXTURE_RAW, clean=FIXTURE_CLEAN, output_root=root)
    raw = fixture_visits(spark, SF001)
    with monkeypatch.context() as m:
        m.setattr(EX, "run_eda", stop)
        with pytest.raises(Stopped):
            run_pipeline(spark, raw, cfg)
    assert sorted(os.listdir(f"{root}/_ledger")) == ["01", "02", "03"]
    with monkeypatch.context() as m:  # none of the finished stages runs again
        for module, name in ((AU, "run_raw_data_audit"), (C, "run_target_cohort"), (CL, "run_data_cleaning")):
            m.setattr(module, name, stop)
        out = run_pipeline(spark, raw, cfg)
    reused = {r[0]: r[1] for r in out["00"]["run_ledger"].collect()}
    assert reused == {"01": True, "02": True, "03": True, "04": False, "05": False}
    assert all(r.passed for r in out["00"]["pipeline_acceptance"].collect())

    # a table that lost a file: its stage runs again, and so do all after it
    part = glob.glob(f"{root}/data_cleaning_output/cleaned_pre_reference_records/part-*")[0]
    os.rename(part, f"{root}/lost")
    out = run_pipeline(spark, raw, cfg)
    reused = {r[0]: r[1] for r in out["00"]["run_ledger"].collect()}
    assert reused == {"01": True, "02": True, "03": False, "04": False, "05": False}


def test_other_configuration_or_input_is_not_reused(spark):
    root = tempfile.mkdtemp(prefix="retrospark-ledger-")
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    first = RunLedger(spark, root, "config", "input")
    first.run("01", lambda: {"t": df, "helper": df}, f"{root}/one", skip=("helper",))
    again = RunLedger(spark, root, "config", "input")
    assert again.run("01", stop, f"{root}/one")["t"].collect() == df.collect() and again.reused == ["01"]
    assert RunLedger(spark, root, "config", "other").finished("01") is None
    assert RunLedger(spark, root, "other", "input").finished("01") is None
    assert RunLedger(spark, root, "config", "input").finished("02") is None
