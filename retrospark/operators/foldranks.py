"""Exact medians and order statistics of all columns and training folds, without copies of the rows.

1. Up to ``EDGES`` boundaries cut every column into about equal parts (``percentile_approx``, one aggregate).
2. One pass counts the values of every part by fold; a training set's counts are those of the other folds, so
   the part that holds an asked place, and the place inside it, follow on the driver.
3. A second pass keeps only the values of those parts, collapsed with their counts by fold; a window inside
   a part finds the values.  What is shuffled is about 1 / ``EDGES`` of the cells.

The driver holds folds x features x ``EDGES`` counts, whatever the number of rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import q

# functions for executors are sent by value, so that they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Parts of a column.
EDGES = 1024


def _edges(cells: DataFrame, features: list[str]) -> list[np.ndarray]:
    # one constant expression, not a literal for each boundary of each column
    qs = F.expr(f"cast(split('{' '.join(repr(i / EDGES) for i in range(1, EDGES))}', ' ') as array<double>)")
    row = cells.agg(*[F.percentile_approx(q(c), qs, 10000) for c in features]).first()
    found = [np.array(sorted({v for v in (at or []) if v == v}), float) for at in row]
    return found or [np.array([])] * len(features)


def _columns(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number, folds, values) of every column's entries that are not null."""
    fold = batch.column(0).to_numpy(zero_copy_only=False).astype(int)
    for j in range(1, batch.num_columns):
        held = batch.column(j).is_valid().to_numpy(zero_copy_only=False)
        yield j - 1, fold[held], batch.column(j).to_numpy(zero_copy_only=False).astype(float)[held]


def _counts(cells: DataFrame, shared, sizes: list[int], k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(per feature the values of (fold, part), rows of each fold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(int)
            held[-1] = held.get(-1, 0) + np.bincount(own, minlength=k)
            for j, fold, values in _columns(batch):
                n = len(shared.value[j]) + 1
                held[j] = held.get(j, 0) + np.bincount(fold * n + np.searchsorted(shared.value[j], values), minlength=k * n)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([c.astype(np.int64).tobytes() for c in held.values()], pa.binary())], ["feature", "body"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py(), np.int64) for b in table.column("body"))
        return pa.table({"feature": pa.array([table.column("feature")[0].as_py()], pa.int64()), "body": pa.array([total.tobytes()], pa.binary())})

    found = {r["feature"]: np.frombuffer(r["body"], np.int64) for r in cells.mapInArrow(run, "feature bigint, body binary").groupBy("feature").applyInArrow(add, "feature bigint, body binary").collect()}
    each = [found.get(j, np.zeros(k * n, np.int64)).reshape(k, n) for j, n in enumerate(sizes)]  # a row a feature
    return each, found.get(-1, np.zeros(k, np.int64))


def places_of(
    folded: DataFrame, features: list[str], k: int, asked: Callable[[int], list[int]], whole: bool = False
) -> tuple[list[list[dict[int, float]]], np.ndarray, np.ndarray]:
    """Values at places (from 0, ascending; ``asked`` gives those for a number of values) of the columns.

    Returns (per group and feature the values by place, numbers of values (group, feature), rows of each group).
    A group is the training set of a fold 0..k-1 (the rows of the other folds); with ``whole`` there is one, all rows.
    """
    spark = folded.sparkSession
    cells = folded.select((F.lit(0) if whole else F.col("fold")).cast("int").alias("fold"), *[q(c).cast("double").alias(c) for c in features])
    k = 1 if whole else k
    shared = spark.sparkContext.broadcast(_edges(cells, features))
    each, rows = _counts(cells, shared, [len(e) + 1 for e in shared.value], k)
    train = [c if whole else c.sum(axis=0) - c for c in each]
    held = np.array([c.sum(axis=1) for c in train], np.int64).reshape(len(features), k).T
    wanted = []
    for j, counts in enumerate(train):
        for g in range(k):
            start = np.cumsum(counts[g])
            for place in sorted({p for p in asked(int(held[g, j])) if 0 <= p < held[g, j]}):
                part = int(np.searchsorted(start, place, side="right"))
                wanted.append((j, part, g, place, place - int(start[part] - counts[g][part])))
    out: list[list[dict[int, float]]] = [[{} for _ in features] for _ in range(k)]
    if wanted:
        parts = spark.sparkContext.broadcast({j: np.array(sorted({w[1] for w in wanted if w[0] == j})) for j in {w[0] for w in wanted}})

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for j, fold, values in _columns(batch):
                    part = np.searchsorted(shared.value[j], values)
                    use = np.isin(part, parts.value.get(j, []))
                    if use.any():
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(use.sum(), j)), pa.array(part[use]), pa.array(fold[use]), pa.array(values[use])], ["feature", "part", "fold", "value"])

        values = cells.mapInArrow(kept, "feature bigint, part bigint, fold bigint, value double").groupBy("feature", "part", "value").agg(
            F.count(F.lit(1)).alias("n"), F.array(*[F.count_if(F.col("fold") == f) for f in range(k)]).alias("own"))
        asks = spark.createDataFrame(wanted, "feature bigint, part bigint, grp int, place bigint, rest bigint")
        own = F.lit(0) if whole else F.get("own", F.col("grp"))
        met = values.join(F.broadcast(asks), ["feature", "part"]).withColumn("n", F.col("n") - own)
        w = Window.partitionBy("feature", "grp", "place").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        met = met.withColumn("upto", F.sum("n").over(w)).where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n") <= F.col("rest")))
        for r in met.select("feature", "grp", "place", "value").collect():  # a row a place that is asked for
            out[r["grp"]][r["feature"]][r["place"]] = r["value"]
    return out, held, rows if whole else rows.sum() - rows


def medians_of(folded: DataFrame, features: list[str], k: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(medians by (group, feature), NaN without values; rows of each group), groups as in :func:`places_of`."""
    at, held, rows = places_of(folded, features, k, lambda n: [(n - 1) // 2, n // 2], whole)
    out = np.full(held.shape, np.nan)
    for g, j in zip(*np.nonzero(held)):
        n, get = int(held[g, j]), at[g][j]
        low, high = get[(n - 1) // 2], get[n // 2]
        out[g, j] = low if n % 2 else low + (high - low) * 0.5
    return out, rows
