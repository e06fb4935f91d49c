"""Distributed exact quantiles (weighted and unweighted) against numpy's linear quantiles."""

import random

import numpy as np

from retrospark.functions.profile import exact_quantiles


def test_exact_quantiles_match_numpy(spark):
    rng = random.Random(1)
    rows = []
    for g, n in enumerate([5, 200, 3001]):
        for _ in range(n):
            v = rng.choice([1.0, 2.0, 2.0, 3.5]) if g == 0 else (round(rng.gauss(0, 10), 1) if g == 1 else rng.random())
            rows.append((g, v, rng.randint(1, 3)))
    rows.append((3, 7.0, 1))
    df = spark.createDataFrame(rows, "g int, v double, w int")
    probs = [0.25, 0.5, 0.75, 0.0, 1.0]
    plain = {r.g: r for r in exact_quantiles(df, ["g"], "v", probs, buckets=16).collect()}
    weighted = {r.g: r for r in exact_quantiles(df, ["g"], "v", probs, weight="w", buckets=16).collect()}
    for g in range(4):
        vals = np.array([v for gg, v, _ in rows if gg == g])
        rep = np.repeat(vals, [w for gg, _, w in rows if gg == g])
        for i, p in enumerate(probs):
            assert abs(plain[g][f"q{i}"] - np.quantile(vals, p)) < 1e-9
            assert abs(weighted[g][f"q{i}"] - np.quantile(rep, p)) < 1e-9
    glob = exact_quantiles(df, [], "v", [0.5], buckets=16).first()
    assert abs(glob.q0 - np.quantile(np.array([v for _, v, _ in rows]), 0.5)) < 1e-9


def test_hot_value_is_one_row(spark):
    # a value holding most rows collapses before ranking; result stays exact
    df = spark.createDataFrame([(0, 5.0)] * 5000 + [(0, float(i)) for i in range(100)], "g int, v double")
    r = exact_quantiles(df, ["g"], "v", [0.01, 0.5], buckets=8).first()
    vals = np.array([5.0] * 5000 + [float(i) for i in range(100)])
    assert abs(r.q0 - np.quantile(vals, 0.01)) < 1e-9 and r.q1 == 5.0
