"""Drift monitoring (batch and Structured Streaming).

Batch: per calendar period, record/entity volume, visits per entity, missingness and
availability of monitored columns and label prevalence, each compared with a reference
period; performance and calibration of predictions against labels that come late; stability
index of features.  Streaming: the same per-window profile over an event stream with a watermark,
and the performance of a stream of predictions joined with a stream of labels; both are written
by ``writeStream`` with a checkpoint location (state survives restarts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import q
from ..functions.profile import exact_quantiles


def period_profile(records: DataFrame, ts: str, entity: str, columns: list[str], label: str | None = None, unit: str = "month") -> DataFrame:
    """Per period: rows, entities, rows per entity, availability of each column, label prevalence."""
    period = F.date_trunc(unit, q(ts)).alias("period")
    aggs = [F.count(F.lit(1)).alias("records"), F.count_distinct(q(entity)).alias("entities")]
    aggs += [F.avg(q(c).isNotNull().cast("double")).alias(f"{c}_available") for c in columns]
    if label:
        aggs.append(F.avg(q(label).cast("double")).alias("prevalence"))
    g = records.groupBy(period).agg(*aggs)
    return g.withColumn("records_per_entity", F.col("records") / F.col("entities"))


def drift_vs_reference(profile: DataFrame, reference_period: str | None = None) -> DataFrame:
    """Each period's metrics minus the reference period's (default: the earliest period)."""
    metrics = [c for c in profile.columns if c != "period"]
    if reference_period is None:
        ref = profile.agg(F.min_by(F.struct(*metrics), F.col("period")).alias("r")).select("r.*")
    else:
        ref = profile.where(F.col("period") == F.to_timestamp(F.lit(reference_period))).select(*metrics)
    ref = ref.select(*[F.col(c).alias(f"__ref_{c}") for c in metrics])
    joined = profile.crossJoin(ref)  # the reference side is exactly one row
    return joined.select("period", *metrics, *[(F.col(c) - F.col(f"__ref_{c}")).alias(f"{c}_drift") for c in metrics])


def stream_profile(stream: DataFrame, ts: str, entity: str, value_cols: list[str], window: str = "1 day", watermark: str = "2 days", kind: str | None = None) -> DataFrame:
    """Windowed profile of an event stream (event-time windows, late data bounded by the watermark)."""
    keys = [F.window(q(ts), window).alias("window")] + ([q(kind)] if kind else [])
    aggs = [F.count(F.lit(1)).alias("events"), F.approx_count_distinct(q(entity)).alias("entities_approx")]
    for c in value_cols:
        aggs += [F.avg(q(c)).alias(f"{c}_mean"), F.avg(q(c).isNull().cast("double")).alias(f"{c}_missing")]
    if dict(stream.dtypes).get(ts) == "timestamp_ntz":  # watermarks need an instant type
        stream = stream.withColumn(ts, q(ts).cast("timestamp"))
    return stream.withWatermark(ts, watermark).groupBy(*keys).agg(*aggs)


def start_stream_profile(spark, source_dir: str, schema, sink_dir: str, checkpoint_dir: str, ts: str = "ts", entity: str = "user_id",
                         value_cols: tuple[str, ...] = ("value",), kind: str | None = "event_type", window: str = "1 day", watermark: str = "2 days"):
    """readStream (parquet files) -> windowed profile -> append to a parquet sink; returns the query."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    prof = stream_profile(stream, ts, entity, list(value_cols), window, watermark, kind)
    return (
        prof.writeStream.outputMode("append").format("parquet").option("path", sink_dir)
        .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
    )


# ---------------------------------------------------------------- performance and feature drift


def _performance(labelled: DataFrame, keys: list, truth: str, pred: str, prob: str) -> DataFrame:
    y, p = F.col(truth).cast("int"), F.col(pred).cast("int")
    return labelled.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("labelled"),
        F.avg(y.cast("double")).alias("prevalence"),
        F.avg(F.col(prob)).alias("mean_score"),
        F.avg((F.col(prob) - y) ** 2).alias("brier"),
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
    )


def with_rates(counts: DataFrame) -> DataFrame:
    """Sensitivity, specificity and their geometric mean; null where a class is absent."""
    rate = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b)))
    out = counts.withColumn("sensitivity", rate("tp", "fn")).withColumn("specificity", rate("tn", "fp"))
    return out.withColumn("g_mean", F.sqrt(F.col("sensitivity") * F.col("specificity")))


def performance_by_period(
    predictions: DataFrame, labels: DataFrame, entity: str = "patient_id", made: str = "made_at", known: str = "known_at",
    model: str = "model_name", truth: str = "y_true", pred: str = "y_pred", prob: str = "y_prob", unit: str = "month", horizon: str | None = None,
) -> DataFrame:
    """DOC4: per model and period of the prediction: labelled predictions, prevalence, calibration and rates.

    ``predictions``: (entity, made, model, pred, prob); ``labels``: (entity, known, truth), which may come
    late.  A label counts for the predictions made before it, within ``horizon`` if given.
    """
    late = labels.select(q(entity).alias("__e"), F.col(known).alias("__k"), F.col(truth).alias(truth))
    on = (F.col("__e") == q(entity)) & (F.col("__k") >= F.col(made))
    if horizon:
        on &= F.col("__k") <= F.col(made) + F.expr(f"INTERVAL {horizon}")
    joined = predictions.drop(truth).join(late, on)
    return with_rates(_performance(joined, [F.col(model), F.date_trunc(unit, F.col(made)).alias("period")], truth, pred, prob))


def performance_drift(performance: DataFrame, model: str = "model_name") -> DataFrame:
    """Every period's prevalence, calibration and rates minus those of the model's first period."""
    metrics = ["prevalence", "mean_score", "brier", "sensitivity", "specificity", "g_mean"]
    first = performance.groupBy(model).agg(F.min_by(F.struct(*metrics), "period").alias("first"))  # a row a model
    out = performance.join(F.broadcast(first), model)
    return out.select(model, "period", "labelled", *metrics, *[(F.col(c) - F.col(f"first.{c}")).alias(f"{c}_drift") for c in metrics])


def stability_index(records: DataFrame, ts: str, columns: list[str], unit: str = "month", bins: int = 10, reference_period: str | None = None) -> DataFrame:
    """DOC4: population stability index of every column and period against the reference period (default: the first).

    Bins are the reference period's quantiles (exact) and one for missing values; sum over the bins
    of (p - r) ln(p / r), shares below 0.0001 raised to it.  (period, column, n, psi.)
    """
    period = F.date_trunc(unit, q(ts))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), q(c).cast("double").alias("value")) for c in columns])
    long = records.where(q(ts).isNotNull()).select(period.alias("period"), F.explode(pairs).alias("p")).select("period", "p.column", "p.value")
    # equal values are one row from here on
    cells = long.groupBy("period", "column", "value").agg(F.count(F.lit(1)).alias("n"))
    if reference_period is None:
        first = records.agg(F.min(period).alias("first"))  # one row
    else:
        first = records.sparkSession.range(1).select(F.to_timestamp(F.lit(reference_period)).cast(dict(cells.dtypes)["period"]).alias("first"))
    base = cells.join(F.broadcast(first), F.col("period") == F.col("first"), "left_semi")
    cuts = exact_quantiles(base, ["column"], "value", [i / bins for i in range(1, bins)], weight="n")
    cuts = cuts.select("column", F.array_distinct(F.array(*[f"q{i}" for i in range(bins - 1)])).alias("cuts"))  # a row a column
    place = F.when(F.col("value").isNull(), F.lit(-1)).otherwise(F.size(F.filter("cuts", lambda c: c < F.col("value"))))
    binned = cells.join(F.broadcast(cuts), "column", "left").groupBy("period", "column", place.alias("bin")).agg(F.sum("n").alias("n"))
    totals = binned.groupBy("period", "column").agg(F.sum("n").alias("total"))
    # every period against every bin that it or the reference period has
    ref = binned.join(F.broadcast(first), F.col("period") == F.col("first"), "left_semi").select("column", "bin", F.col("n").alias("ref_n"))
    ref_total = ref.groupBy("column").agg(F.sum("ref_n").alias("ref_total"))
    slots = totals.join(ref.select("column", "bin"), "column").unionByName(binned.join(totals, ["period", "column"]).select("column", "period", "total", "bin")).distinct()
    both = slots.join(binned, ["period", "column", "bin"], "left").join(ref, ["column", "bin"], "left").join(ref_total, "column")
    share = lambda n, total: F.greatest(F.coalesce(F.col(n), F.lit(0)) / F.col(total), F.lit(1e-4))
    p, r = share("n", "total"), share("ref_n", "ref_total")
    return both.groupBy("period", "column").agg(F.max("total").alias("n"), F.sum((p - r) * F.log(p / r)).alias("psi"))


def stream_performance(
    predictions: DataFrame, labels: DataFrame, entity: str = "patient_id", made: str = "made_at", known: str = "known_at",
    model: str = "model_name", truth: str = "y_true", pred: str = "y_pred", prob: str = "y_prob", window: str = "30 days", horizon: str = "90 days", watermark: str = "1 day",
) -> DataFrame:
    """Performance per model and window of the prediction time, from a stream of predictions and one of late labels.

    A stream-stream join within ``horizon``; both watermarks bound its state, and a window is put out
    when no label for it can come any more.  Rates follow by :func:`with_rates`.
    """
    p = predictions.drop(truth).withWatermark(made, watermark)
    late = labels.select(q(entity).alias("__e"), F.col(known).alias("__k"), F.col(truth).alias(truth)).withWatermark("__k", watermark)
    on = (F.col("__e") == q(entity)) & (F.col("__k") >= F.col(made)) & (F.col("__k") <= F.col(made) + F.expr(f"INTERVAL {horizon}"))
    return _performance(p.join(late, on), [F.col(model), F.window(made, window).alias("window")], truth, pred, prob)


def start_stream_performance(spark, predictions_dir: str, labels_dir: str, predictions_schema, labels_schema, sink_dir: str, checkpoint_dir: str, **options):
    """Two folders of Parquet files -> :func:`stream_performance` -> append to a Parquet sink; returns the query.

    State and progress are in ``checkpoint_dir`` (shared storage), so a new query there goes on where the last one ended.
    """
    made = stream_performance(spark.readStream.schema(predictions_schema).parquet(predictions_dir), spark.readStream.schema(labels_schema).parquet(labels_dir), **options)
    return made.writeStream.outputMode("append").format("parquet").option("path", sink_dir).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
