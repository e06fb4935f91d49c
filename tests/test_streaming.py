"""Structured Streaming drift profile over the events table (file source, availableNow trigger)."""

import os
import shutil
import tempfile

from conftest import SF001


def test_stream_profile(spark):
    from retrospark.streaming.drift import start_stream_profile

    src = tempfile.mkdtemp(prefix="retrospark-src-")
    shutil.copy(f"{SF001}/events.parquet", os.path.join(src, "part-0.parquet"))
    schema = spark.read.parquet(src).schema
    sink, ckpt = tempfile.mkdtemp(prefix="retrospark-sink-"), tempfile.mkdtemp(prefix="retrospark-ckpt-")
    q = start_stream_profile(spark, src, schema, sink, ckpt, window="1 day", watermark="1 hour")
    q.awaitTermination(120)
    out = spark.read.parquet(sink)
    total = spark.read.parquet(src).count()
    # with availableNow the watermark closes every window except the most recent ones
    assert out.count() > 0
    assert out.agg({"events": "sum"}).first()[0] <= total


def test_batch_drift(spark):
    from retrospark.streaming.drift import drift_vs_reference, period_profile

    ev = spark.read.parquet(f"{SF001}/events.parquet")
    d = drift_vs_reference(period_profile(ev, "ts", "user_id", ["value"], None, "day"))
    first = d.orderBy("period").first()
    assert first.records_drift == 0 and first.entities_drift == 0


def _predictions(spark):
    import datetime as dt
    import random

    rng = random.Random(6)
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    preds = [(e, m, day(rng.randint(0, 100)), rng.random()) for e in range(400) for m in ("a", "b")]
    labels = [(e, day(rng.randint(0, 160)), int(rng.random() < 0.3)) for e in range(400)]
    p = spark.createDataFrame(preds, "patient_id long, model_name string, made_at timestamp, y_prob double")
    return p.selectExpr("*", "int(y_prob >= 0.5) AS y_pred"), spark.createDataFrame(labels, "patient_id long, known_at timestamp, y_true int")


def test_performance_with_late_labels(spark):
    from retrospark.streaming.drift import performance_by_period, performance_drift

    p, lab = _predictions(spark)
    got = {(r["model_name"], r["period"]): r for r in performance_by_period(p, lab, horizon="60 days").collect()}
    known = {r["patient_id"]: r for r in lab.collect()}
    want = {}
    for r in p.collect():
        k = known[r["patient_id"]]
        if 0 <= (k["known_at"] - r["made_at"]).days <= 60:
            want.setdefault((r["model_name"], r["made_at"].replace(day=1)), []).append((k["y_true"], r["y_pred"], r["y_prob"]))
    assert set(got) == set(want)
    for key, rows in want.items():
        pos = [x for x in rows if x[0] == 1]
        assert got[key]["labelled"] == len(rows) and abs(got[key]["prevalence"] - len(pos) / len(rows)) < 1e-9
        assert abs(got[key]["brier"] - sum((x[2] - x[0]) ** 2 for x in rows) / len(rows)) < 1e-9
        assert got[key]["sensitivity"] == (sum(x[1] for x in pos) / len(pos) if pos else None)
    drift = performance_drift(performance_by_period(p, lab)).orderBy("model_name", "period").collect()
    assert drift[0]["brier_drift"] == 0.0 and len({r["period"] for r in drift}) > 2


def test_stream_of_predictions_and_labels_restarts(spark):
    """Two runs from one checkpoint give the windows of the batch version, each once."""
    from pyspark.sql import functions as F

    from retrospark.streaming.drift import performance_by_period, start_stream_performance

    p, lab = _predictions(spark)
    dirs = {n: tempfile.mkdtemp(prefix=f"retrospark-{n}-") for n in ("p", "l", "sink", "ckpt")}
    args = (spark, dirs["p"], dirs["l"], p.schema, lab.schema, dirs["sink"], dirs["ckpt"])
    options = {"window": "1 day", "horizon": "60 days", "watermark": "1 day"}
    early_p, early_l = p.where("made_at < '2024-02-10'"), lab.where("known_at < '2024-02-10'")
    early_p.coalesce(1).write.mode("append").parquet(dirs["p"])
    early_l.coalesce(1).write.mode("append").parquet(dirs["l"])
    start_stream_performance(*args, **options).awaitTermination(180)
    first = spark.read.parquet(dirs["sink"]).count() if os.listdir(dirs["sink"]) else 0
    p.where("made_at >= '2024-02-10'").coalesce(1).write.mode("append").parquet(dirs["p"])
    lab.where("known_at >= '2024-02-10'").coalesce(1).write.mode("append").parquet(dirs["l"])
    start_stream_performance(*args, **options).awaitTermination(180)
    # events far ahead move the watermarks, so that all windows close
    spark.createDataFrame([(10**6, "a", __import__("datetime").datetime(2026, 1, 1), 0.5, 1)], p.schema).coalesce(1).write.mode("append").parquet(dirs["p"])
    spark.createDataFrame([(10**6, __import__("datetime").datetime(2026, 1, 1), 1)], lab.schema).coalesce(1).write.mode("append").parquet(dirs["l"])
    start_stream_performance(*args, **options).awaitTermination(180)
    start_stream_performance(*args, **options).awaitTermination(180)
    out = spark.read.parquet(dirs["sink"]).select("model_name", F.col("window.start").alias("period"), "labelled", "tp", "fn", "tn", "fp").where("period < '2025-01-01'")
    got = sorted(map(tuple, out.collect()))
    want = performance_by_period(p, lab, unit="day", horizon="60 days").select("model_name", "period", "labelled", "tp", "fn", "tn", "fp")
    assert got == sorted(map(tuple, want.collect())) and first < len(got)


def test_stability_index(spark):
    import math

    from retrospark.streaming.drift import stability_index

    rows = [("2024-01-05", float(i)) for i in range(100)] + [("2024-02-05", float(i) + 30) for i in range(100)] + [("2024-03-05", None)] * 10
    df = spark.createDataFrame(rows, "d string, x double").selectExpr("timestamp(d) AS ts", "x")
    got = {r["period"].month: r for r in stability_index(df, "ts", ["x"], "month", bins=4).collect()}
    assert got[1]["psi"] == 0.0 and got[1]["n"] == 100
    shares = [(1e-4, 0.25), (0.2, 0.25), (0.25, 0.25), (0.55, 0.25)]  # 30..129 against the quartiles 24.75, 49.5, 74.25
    assert abs(got[2]["psi"] - sum((p - r) * math.log(p / r) for p, r in shares)) < 1e-9
    assert got[3]["psi"] > 5
