"""Profiling helpers: one aggregate per table, reshaped to tall metric rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .codes import q


def stack_metrics(row_df: DataFrame, metrics: list[tuple[str, Column, str]], value_type: str = "double") -> DataFrame:
    """Turn a one-row aggregate into ``(metric, value, detail)`` rows, keeping the given order.

    ``metrics`` is a list of ``(metric_name, value_expression_over_row_df, detail)``.
    """
    structs = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(name).alias("metric"),
            expr.cast(value_type).alias("value"),
            F.lit(detail).alias("detail"),
        )
        for i, (name, expr, detail) in enumerate(metrics, start=1)
    ]
    return row_df.select(F.explode(F.array(*structs)).alias("m")).select("m.*")


def scalar_row(*aggs: DataFrame) -> DataFrame:
    """Side-by-side combination of global aggregates.

    Every input is a global ``agg`` without grouping keys, hence exactly one row, so the
    product is one row (planned as a broadcast nested-loop join of 1-row relations).
    """
    out = aggs[0]
    for a in aggs[1:]:
        out = out.crossJoin(a)
    return out


def missing_columns(df: DataFrame) -> list[Column]:
    """Aggregates that :func:`missing_rows` needs."""
    return [F.count(F.lit(1)).alias("__n"), *[F.count_if(q(c).isNull()).alias(f"__m{i}") for i, c in enumerate(df.columns)]]


def missing_rows(row: DataFrame, columns: list[str]) -> DataFrame:
    structs = [
        F.struct(
            F.lit(i + 1).alias("ordinal"),
            F.lit(c).alias("column"),
            F.col(f"__m{i}").cast("bigint").alias("missing_count"),
            F.when(F.col("__n") > 0, F.col(f"__m{i}") / F.col("__n")).otherwise(F.lit(0.0)).alias("missing_percent"),
        )
        for i, c in enumerate(columns)
    ]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def missing_summary(df: DataFrame) -> DataFrame:
    """Per column: missing count and share, from a single aggregate over the table."""
    return missing_rows(df.agg(*missing_columns(df)), df.columns)


def written_with_metrics(df: DataFrame, write: Callable[[DataFrame], DataFrame], metrics: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The table as ``write`` stores it and, as one row, aggregates of it that are taken during that write.

    The metrics sit on top of the plan, in the stage that writes: a task that is repeated counts once.  Where
    the optimiser leaves no plan to observe (an empty table) they are aggregated from the stored table.
    """
    schema = df.agg(*metrics).schema
    seen = Observation()
    stored = write(df.observe(seen, *metrics))
    found = seen.get
    if len(found) != len(schema.names):
        return stored, stored.agg(*metrics)
    return stored, df.sparkSession.createDataFrame([tuple(found[c] for c in schema.names)], schema)


def long_values(df: DataFrame, columns: list[str], value_type: str = "string") -> DataFrame:
    """Unpivot ``columns`` to ``(column, value)`` rows, each value cast to ``value_type``."""
    pairs = [F.struct(F.lit(c).alias("column"), q(c).cast(value_type).alias("value")) for c in columns]
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def first_k_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """Top-k rows per group by ``order``.

    Written as ``row_number() <= k`` so Catalyst plans a partial ``WindowGroupLimit``
    before the shuffle: each map task forwards at most k rows per group.
    """
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k)


def in_parts(values: DataFrame, bounds: DataFrame, keys: list[str], value: str, parts: int, more: dict[str, Column] | None = None) -> DataFrame:
    """``values`` with ``__bk``, the number of their group's ascending boundaries ``__b`` that are less than ``value``.

    ``bounds`` has a row a group and is broadcast.  Every ``step``-th boundary is compared first, then those up to the next.
    """
    step = max(2, math.isqrt(parts))
    every = F.filter("__b", lambda x, i: (i + 1) % step == 0)
    d = values.join(F.broadcast(bounds.withColumn("__every", every)), on=keys)
    less = lambda a: F.size(F.filter(a, lambda x: x < F.col(value)))
    d = d.withColumn("__from", less("__every") * step)
    return d.withColumns({"__bk": F.col("__from") + less(F.slice("__b", F.col("__from") + 1, F.lit(step))), **(more or {})}).drop("__b", "__every", "__from")


def _rank_intervals(base: DataFrame, keys: list[str], spark, buckets: int | None, values_per_bucket: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Steps 1 to 4 of :func:`exact_quantiles` for rows (keys, __v, __w).

    (bucket boundaries and total weight n of each group; buckets with weight and first rank;
    distinct values with their bucket and rank interval [__lo, __hi]).
    """
    # The collapsed table is read three times below (bounds, bucket totals, ranks): materialise
    # it once in the shared checkpoint folder instead of re-running the input plan each time.
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    dv = base.groupBy(*keys, "__v").agg(F.sum("__w").alias("__w")).checkpoint()
    if buckets is None:  # enough buckets that each holds about ``values_per_bucket`` distinct values
        largest = dv.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        buckets = int(max(8, -(-largest // values_per_bucket)))
    qs = [i / buckets for i in range(1, buckets)]
    # kept: approximate boundaries depend on the order in which parts are merged, and all that follows needs the same ones
    bounds = dv.groupBy(*keys).agg(F.percentile_approx("__v", qs, 10000).alias("__b"), F.sum("__w").alias("n")).checkpoint()
    # groups are columns, labels and the like: their boundaries (a row a group, ``buckets`` numbers), bucket totals (a row a
    # bucket) and asked ranks are broadcast, so that the values are shuffled once, for the ranks inside a bucket
    dv = in_parts(dv, bounds.drop("n"), keys, "__v", buckets, {"__c": F.get("__b", F.lit(len(qs) // 2))})
    bt = dv.groupBy(*keys, "__bk").agg(F.sum("__w").alias("__bw"))
    wb = Window.partitionBy(*keys).orderBy("__bk").rowsBetween(Window.unboundedPreceding, -1)
    bt = bt.withColumn("__start", F.coalesce(F.sum("__bw").over(wb), F.lit(0.0)))
    wi = Window.partitionBy(*keys, "__bk").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    dv = dv.withColumn("__before", F.coalesce(F.sum("__w").over(wi), F.lit(0.0)))
    dv = dv.join(F.broadcast(bt.select(*keys, "__bk", "__start")), on=[*keys, "__bk"])
    dv = dv.withColumns({"__lo": F.col("__start") + F.col("__before"), "__hi": F.col("__start") + F.col("__before") + F.col("__w") - 1})
    return bounds, bt, dv


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: list[float],
    weight: str | None = None,
    buckets: int | None = None,
    prefix: str = "q",
    values_per_bucket: int = 200_000,
) -> DataFrame:
    """Exact linear-interpolated quantiles per group, without holding a group in one buffer.

    Same definition as pandas ``quantile`` / Spark ``percentile`` (position p * (n - 1)).
    1. duplicates collapse to (group, value, weight) rows (map-side combine; a hot value is one row);
    2. the distinct values of each group are cut into ~equi-depth buckets at approximate
       quantile boundaries (``percentile_approx``, ``buckets`` numbers per group);
    3. bucket totals give each bucket's first rank (small window over buckets);
    4. inside each bucket a window over values gives each value's rank interval;
    5. the values covering the two ranks around each target position are interpolated.
    Output: one row per group with ``{prefix}{i}`` for each probability, ``n`` (total weight)
    and the weighted ``{prefix}_mean``, ``{prefix}_m2`` (squared deviations), ``{prefix}_min``, ``{prefix}_max``.
    The collapsed (group, value, weight) table is checkpointed, so building this DataFrame runs
    one job over the input.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    out_keys = list(keys)
    keys = out_keys or ["__all"]  # a global quantile is one group
    src = df if out_keys else df.withColumn("__all", F.lit(0))
    base = src.select(*[F.col(k) for k in keys], F.col(value).cast("double").alias("__v"), w.alias("__w")).where(F.col("__v").isNotNull())
    bounds, bt, dv = _rank_intervals(base, keys, df.sparkSession, buckets, values_per_bucket)
    # target ranks per group and probability, located first in their bucket, then in the bucket's values
    targets = F.explode(F.array(*[
        F.struct(F.lit(i).alias("qi"), F.lit(float(p)).alias("p"), F.lit(side).alias("side"))
        for i, p in enumerate(probs) for side in (0, 1)
    ]))
    tg = bounds.select(*keys, "n", targets.alias("t")).select(*keys, "n", "t.*")
    pos = F.col("p") * (F.col("n") - 1)
    tg = tg.withColumn("__r", F.when(F.col("side") == 0, F.floor(pos)).otherwise(F.least(F.floor(pos) + 1, F.col("n") - 1)).cast("double"))
    tg = tg.withColumn("__frac", pos - F.floor(pos))
    tgb = tg.join(bt, on=keys).where((F.col("__r") >= F.col("__start")) & (F.col("__r") < F.col("__start") + F.col("__bw"))).select(*keys, "n", "qi", "side", "__r", "__frac", "__bk")
    hit = dv.select(*keys, "__bk", "__v", "__lo", "__hi").join(F.broadcast(tgb), on=[*keys, "__bk"])
    hit = hit.where((F.col("__r") >= F.col("__lo")) & (F.col("__r") <= F.col("__hi")))
    picked = hit.groupBy(*keys, "n", "qi").agg(
        F.max(F.when(F.col("side") == 0, F.col("__v"))).alias("__v0"),
        F.max(F.when(F.col("side") == 1, F.col("__v"))).alias("__v1"),
        F.max("__frac").alias("__f"),
    )
    val = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * F.col("__f")
    out = picked.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("qi") == i, val)).alias(f"{prefix}{i}") for i in range(len(probs))])
    off = F.col("__v") - F.col("__c")  # from a value near the middle, so that large values don't cancel
    moments = dv.groupBy(*keys).agg(
        (F.sum(F.col("__v") * F.col("__w")) / F.sum("__w")).alias(f"{prefix}_mean"),
        F.greatest(F.sum(off * off * F.col("__w")) - F.sum(off * F.col("__w")) ** 2 / F.sum("__w"), F.lit(0.0)).alias(f"{prefix}_m2"),
        F.min("__v").alias(f"{prefix}_min"),
        F.max("__v").alias(f"{prefix}_max"),
    )
    out = out.join(moments, on=keys)
    return out if out_keys else out.drop("__all")


def order_statistics(df: DataFrame, keys: list[str], value: str, places: list[Column], values_per_bucket: int = 200_000) -> DataFrame:
    """(keys..., n, place, value): the values at the given places (from 0, ascending; expressions of a group's number ``n``).

    Nulls are no values; places outside a group give no row.  Ranked like :func:`exact_quantiles`.
    """
    base = df.select(*keys, F.col(value).cast("double").alias("__v"), F.lit(1.0).alias("__w")).where(F.col("__v").isNotNull())
    bounds, bt, dv = _rank_intervals(base, keys, df.sparkSession, None, values_per_bucket)
    asked = bounds.select(*keys, F.col("n").cast("bigint").alias("n"), F.explode(F.array_distinct(F.array(*[p.cast("bigint") for p in places]))).alias("place"))
    asked = asked.join(bt, on=keys).where((F.col("place") >= F.col("__start")) & (F.col("place") < F.col("__start") + F.col("__bw"))).select(*keys, "n", "place", "__bk")
    hit = dv.select(*keys, "__bk", "__v", "__lo", "__hi").join(F.broadcast(asked), on=[*keys, "__bk"])
    return hit.where(F.col("place").between(F.col("__lo"), F.col("__hi"))).select(*keys, "n", "place", F.col("__v").alias("value"))
