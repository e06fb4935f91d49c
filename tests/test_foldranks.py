"""Medians of training folds from counts, leave-one-out models from sums over all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retrospark.config import ModelConfig
from retrospark.operators import foldfit as FF
from retrospark.operators import folds as FO

CFG = ModelConfig(entity="patient_id", label="stroke")


def _rows(n, seed=5):
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(50, 9, n), np.round(rng.normal(0, 2, n)), rng.normal(3, 1, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(a - 50) / 9 - b / 3 + 1))).astype(int)
    gone = rng.random(n) < 0.1
    return [(i, int(y[i]), float(a[i]), float(b[i]), None if gone[i] else float(c[i]), None, 7.3, i) for i in range(n)]


def _frame(spark, rows, fold=lambda i: i):
    return spark.createDataFrame([(*r[:-1], fold(r[-1])) for r in rows], "patient_id bigint, stroke int, a double, b double, c double, gone double, same double, fold int").repartition(3)


def test_training_medians_and_scaling_from_counts(spark, monkeypatch):
    rows, feats = _rows(701), ["a", "b", "c", "gone", "same"]
    folded = _frame(spark, rows, lambda i: i % 3).localCheckpoint()
    copied, plain = [], FO.training_copies
    monkeypatch.setattr(FO, "training_copies", lambda df, k: copied.append(df.count()) or plain(df, k))
    got = {(r.train_fold, r.feature): r.median for r in FO.fold_medians(folded, feats, 3).collect()}
    stats = {(r.train_fold, r.feature): r for r in FO.fold_statistics(folded, feats, 3).collect()}
    assert max(copied, default=0) <= 3 * len(feats)  # moments by fold, never the rows
    assert len(got) == 15
    for f in range(3):
        for j, c in enumerate(feats):
            v = np.array([r[2 + j] for r in rows if r[-1] % 3 != f], float)
            if np.isnan(v).all():
                assert got[f, c] is None and (f, c) not in stats
                continue
            m = np.nanmedian(v)
            assert got[f, c] == m
            full = np.where(np.isnan(v), m, v)
            assert abs(stats[f, c]["mean"] - full.mean()) < 1e-9 and abs(stats[f, c]["std"] - (full.std() if c != "same" else 0)) < 1e-9
    assert stats[0, "same"]["scale"] == 1.0


def test_training_medians_with_infinite_and_few_values(spark):
    rows = [(0, None), (0, 1.0), (1, float("inf")), (1, -2.0), (1, 4.0), (2, None)]
    folded = spark.createDataFrame(rows, "fold int, x double")
    got = {r.train_fold: r.median for r in FO.fold_medians(folded, ["x"], 3).collect()}
    assert got == {0: 4.0, 1: 1.0, 2: 2.5}


def test_leave_one_out_from_sums_matches_exact_blocks(spark):
    rows, feats = _rows(4000), ["a", "b", "c", "same"]
    folded = _frame(spark, rows).localCheckpoint()
    pos = sum(r[1] for r in rows)

    def run(expand):
        _, models, jobs = FF.loo_models(folded, feats, "m", CFG, pos, 4000 - pos, expand=expand)
        return {r.patient_id: r.y_prob for r in FF.score(folded, models, feats, CFG).collect()}, jobs

    whole, _ = run(True)
    exact, _ = run(False)
    assert whole.keys() == exact.keys() and len(whole) == 4000
    assert max(abs(whole[i] - exact[i]) for i in exact) < 2e-9


def test_leave_one_out_jobs_do_not_grow_with_the_blocks(spark, monkeypatch):
    rows, feats = _rows(3000), ["a", "b"]
    folded = _frame(spark, rows).localCheckpoint()
    pos = sum(r[1] for r in rows)
    monkeypatch.setattr(FF, "LOO_BLOCK", 100)
    monkeypatch.setattr(FF, "EXPAND_ROWS", 1000, raising=False)
    monkeypatch.setattr(FF, "EXPANSION_ERROR", 1e-6, raising=False)
    _, models, jobs = FF.loo_models(folded, feats, "m", CFG, pos, 3000 - pos)
    assert models.count() == 3000 and models.select(F.count_distinct("fold")).first()[0] == 3000
    assert jobs < 30  # the blocks alone are 30


@pytest.mark.parametrize("n", [37, 300])
def test_column_statistics_without_one_row_agree(spark, n):
    feats = ["a", "b", "c"]
    folded = _frame(spark, _rows(n)).localCheckpoint()
    facts = {r["feature"]: r for r in FF.column_facts(folded, feats).collect()}
    arrays = {x: np.array([float(facts[c][x]) for c in feats]) for x in ("rows", "held", "mean0", "m20", "whole", "low", "low_next", "high", "high_next")}
    values = {r["fold"]: np.array([[np.nan if r[c] is None else r[c] for c in feats]]) for r in folded.collect()}
    for r in FF.loo_statistics(folded, feats).collect():
        got = FF._without(values[r["train_fold"]], arrays)
        assert np.allclose([x[0][feats.index(r["feature"])] for x in got], [r["median"], r["mean"], r["scale"]], rtol=1e-12, atol=1e-12)


def test_boundaries_are_one_constant_for_all_columns(spark, monkeypatch):
    """The 1023 boundaries are no expressions of their own in each column's aggregate."""
    from retrospark.operators import foldranks as FR

    made = []
    lit = FR.F.lit
    monkeypatch.setattr(FR.F, "percentile_approx", lambda c, at, n, f=FR.F.percentile_approx: made.append(at) or f(c, at, n))
    df = spark.range(3000).select(lit(0).alias("fold"), FR.F.col("id").cast("double").alias("a"), (FR.F.col("id") % 7).cast("double").alias("b"))
    a, b = FR._edges(df, ["a", "b"])
    assert len(made) == 2 and made[0] is made[1] and not isinstance(made[0], list)
    listed = df.agg(*[FR.F.expr(f"percentile_approx({c}, array({', '.join(repr(i / FR.EDGES) + 'D' for i in range(1, FR.EDGES))}), 10000)") for c in "ab"]).first()
    assert a.tolist() == sorted(set(listed[0])) and b.tolist() == sorted(set(listed[1]))
