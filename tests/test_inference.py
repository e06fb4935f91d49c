"""Final models as tables: parity with a plain fit, round trip through files, routing."""

import numpy as np
from pyspark.sql import functions as F
from test_foldfit import CFG, FEATS, brute_scores, data, frame

from retrospark.operators import inference as IN
from retrospark.sources.files import write_table


def whole(x, y):
    """Scores of the model of all rows, by the plain version with an extra, empty fold."""
    rows = np.vstack([x, x])
    fold = np.r_[np.zeros(len(y)), np.ones(len(y))]
    # predictions of fold 0's rows by a model trained on fold 1, which is the whole table
    return brute_scores(rows, np.r_[y, y], fold)[: len(y)]


def test_stored_model_scores_like_the_fit(spark, tmp_path):
    x, y = data(80)
    table = frame(spark, x, y)
    models = IN.fit_final(table, "m", CFG)
    write_table(models, str(tmp_path / "models"))
    stored = spark.read.parquet(str(tmp_path / "models"))
    got = {r["patient_id"]: r for r in IN.apply_model(table, stored, "m", CFG).collect()}
    want = whole(x, y)
    assert np.allclose([got[i]["y_prob"] for i in range(len(y))], want, atol=1e-7)
    assert all(got[i]["y_pred"] == int(want[i] >= CFG.threshold) for i in range(len(y)))
    row = stored.first()
    assert row["n_rows"] == 80 and row["positives"] == int(y.sum()) and sorted(row["features"]) == sorted(FEATS)


def test_missing_column_counts_as_missing_values(spark):
    x, y = data(80)
    models = IN.fit_final(frame(spark, x, y), "m", CFG)
    gone = x.copy()
    gone[:, 1] = np.nan
    a = {r[0]: r[2] for r in IN.apply_model(frame(spark, gone, y), models, "m", CFG).collect()}
    b = {r[0]: r[2] for r in IN.apply_model(frame(spark, x, y).drop("b"), models, "m", CFG).collect()}
    assert a == b


def test_routes_and_scores(spark):
    x, y = data(80)
    table = frame(spark, x, y)
    models = IN.fit_final(table, "base", CFG).unionByName(IN.fit_final(table, "time", CFG))
    complete = spark.createDataFrame([(0, True), (1, False), (2, None), (70, True), (99, True), (100, False), (None, True)], "patient_id long, temporal_complete boolean")
    known = spark.createDataFrame([(0,), (200,)], "patient_id long")
    out = IN.route_and_score(complete, table.where("patient_id < 50"), table.where("patient_id in (0, 70)"), models, "base", "time", CFG, known).collect()
    got = {r["patient_id"]: r for r in out}
    assert len(out) == len(got) == 54
    assert (got[0]["route"], got[0]["model_name"]) == ("temporal", "time") and (got[1]["route"], got[1]["model_name"]) == ("single_shot", "base")
    assert got[70]["y_prob"] is not None and (got[99]["route"], got[99]["y_prob"]) == ("temporal", None)
    assert got[100]["route"] == got[200]["route"] == "insufficient_history" and got[200]["y_prob"] is None


def test_single_class_has_no_model(spark):
    x, y = data(30)
    none = IN.fit_final(frame(spark, x, np.zeros(30, int)), "m", CFG)
    assert none.collect() == []
    scored = IN.apply_model(frame(spark, x, y), none, "m", CFG)
    assert scored.count() == 30 and scored.where(F.col("y_prob").isNotNull()).count() == 0
