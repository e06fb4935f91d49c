"""Exact AUC / average precision against brute force; confusion metrics; McNemar branches; CV policy."""

import math
import random

from pyspark.sql import functions as F

from retrospark.config import ModelConfig
from retrospark.operators import evaluate as EV
from retrospark.operators.folds import assign_folds, choose_cv, overlap_guard


def brute_auc(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    tot = sum((1.0 if p > n else 0.5 if p == n else 0.0) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def brute_ap(y, s):
    P = sum(y)
    ap, prev_r = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        tp = sum(1 for a, b in zip(y, s) if b >= t and a == 1)
        fp = sum(1 for a, b in zip(y, s) if b >= t and a == 0)
        r = tp / P
        ap += (r - prev_r) * (tp / (tp + fp))
        prev_r = r
    return ap


def test_ranking_metrics_with_ties(spark):
    rng = random.Random(7)
    rows = []
    for m in ("a", "b"):
        for i in range(400):
            y = 1 if rng.random() < 0.3 else 0
            s = round(rng.random() * (0.6 + 0.4 * y), 1)  # many ties
            rows.append((i, m, y, int(s >= 0.5), s))
    df = spark.createDataFrame(rows, "patient_id long, model_name string, y_true int, y_pred int, y_prob double")
    got = {r.model_name: r for r in EV.ranking_metrics(df, buckets=8).collect()}
    for m in ("a", "b"):
        y = [r[2] for r in rows if r[1] == m]
        s = [r[4] for r in rows if r[1] == m]
        assert abs(got[m].roc_auc - brute_auc(y, s)) < 1e-12
        assert abs(got[m].pr_auc - brute_ap(y, s)) < 1e-12


def test_single_class_gives_null_auc(spark):
    df = spark.createDataFrame([(1, "m", 1, 1, 0.9), (2, "m", 1, 0, 0.1)], "patient_id long, model_name string, y_true int, y_pred int, y_prob double")
    r = EV.metrics_table(df).first()
    assert r.roc_auc is None and r.pr_auc is None and r.sensitivity == 0.5 and r.specificity == 0.0 and r.g_mean == 0.0


def test_mcnemar_branches(spark):
    schema = "patient_id long, model_name string, y_true int, y_pred int, y_prob double"
    # b = c = 2 -> chi2 = (0 - 1)^2 / 4 (no clamping)
    rows = [(1, "base", 1, 1, 0.9), (1, "new", 1, 0, 0.1), (2, "base", 1, 1, 0.9), (2, "new", 1, 0, 0.1),
            (3, "base", 1, 0, 0.1), (3, "new", 1, 1, 0.9), (4, "base", 1, 0, 0.1), (4, "new", 1, 1, 0.9)]
    r = EV.mcnemar(spark.createDataFrame(rows, schema), "base", "new").first()
    assert (r.status, r.b_baseline_correct_challenger_wrong, r.c_baseline_wrong_challenger_correct) == ("completed", 2, 2)
    assert abs(r.chi_square - 0.25) < 1e-12
    assert abs(r.p_value - math.erfc(math.sqrt(0.125))) < 1e-6
    same = [(1, "base", 1, 1, 0.9), (1, "new", 1, 1, 0.9)]
    r = EV.mcnemar(spark.createDataFrame(same, schema), "base", "new").first()
    assert (r.status, r.reason, r.chi_square, r.p_value) == ("skipped", "no_disagreement", 0.0, 1.0)
    apart = [(1, "base", 1, 1, 0.9), (2, "new", 1, 1, 0.9)]
    r = EV.mcnemar(spark.createDataFrame(apart, schema), "base", "new").first()
    assert (r.status, r.reason) == ("skipped", "no_overlap_patients_between_models")


def test_cv_policy_and_folds(spark):
    cfg = ModelConfig(entity="patient_id", label="stroke", cv_strategy="auto")
    one = spark.createDataFrame([(i, 1, 1.0) for i in range(5)], "patient_id long, stroke int, x double")
    assert choose_cv(one, cfg).skip_reason == "not_run_single_class"
    lone = spark.createDataFrame([(0, 1, 1.0)] + [(i, 0, 1.0) for i in range(1, 6)], "patient_id long, stroke int, x double")
    assert choose_cv(lone, cfg).skip_reason == "not_run_min_class_lt_2"
    data = spark.createDataFrame([(i, int(i % 4 == 0), float(i)) for i in range(1000)], "patient_id long, stroke int, x double")
    pol = choose_cv(data, cfg)
    assert pol.strategy == "StratifiedKFold_5"
    folded = assign_folds(data, pol, cfg)
    sizes = {(r.fold, r.stroke): r["count"] for r in folded.groupBy("fold", "stroke").count().collect()}
    assert all(v == 50 for (f, y), v in sizes.items() if y == 1) and all(v == 150 for (f, y), v in sizes.items() if y == 0)
    assert overlap_guard(folded, cfg).count() == 0
    small = spark.createDataFrame([(i, int(i % 2), float(i)) for i in range(20)], "patient_id long, stroke int, x double")
    loo = assign_folds(small, choose_cv(small, cfg), cfg)
    assert sorted(r.fold for r in loo.collect()) == list(range(20))
