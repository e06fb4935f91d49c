"""Batched cross-validation: statistics, selection, components and fits of all folds and candidates at once.

Rows of a feature matrix are written as u = [1, standardised values (missing: 0), missing flags],
standardised by the whole table's mean and deviation (a change of units, undone in the models).
Every fold-local step is a linear map of u, so that one pass over the rows serves all folds:

* **Moments.**  One Gram matrix of u per (fold, class); a training set's Gram matrix is the sum of the
  other folds'.  It holds the training means, deviations, ANOVA F scores and covariances for any
  imputation value, hence the ranking of the features (every k is a prefix of it) and one
  eigen-decomposition per fold that serves every number of components.
* **Fits.**  Newton's method for the penalised, class-balanced logistic loss: a step is one job that adds
  up gradients and Hessians of all models (folds x candidates) over the partitions; steps that
  don't lower a model's loss are halved.  The number of jobs depends on neither.
* **Leave-one-out.**  Medians, means and deviations without one row follow from the whole column's order
  statistics and moments (:func:`loo_statistics`); no row is copied.  Every model is solved from the sums of
  all rows, its own row taken off, with a bound of its error; few rows, and models beyond the bound, are
  fitted in blocks with exact gradients, starting from the model of all rows, whose Hessian is kept.
* **Models are tables** (:data:`MODEL_DDL`): an intercept and, per feature, slope, offset and the value of
  a missing entry.  Scoring is a DataFrame expression (:func:`score`).

What reaches the driver is bounded by folds x candidates x features (leave-one-out: a block of
``LOO_BLOCK`` models), never by the rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ModelConfig
from ..functions.codes import q
from .foldranks import places_of
from .folds import _unpivot, fold_medians

# functions for executors are sent by value, so that they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODEL_DDL = "model_name string, fold int, intercept double, terms array<struct<slope: double, offset: double, missing: double>>"
#: Models of leave-one-out that are fitted together; rows of the matrix handled at once in a task.
LOO_BLOCK = 8192
ROWS = 512
#: Rows handled at once where models are fitted: many small products a block, so that their calls count less.
FIT_ROWS = 4096
#: Leave-one-out from sums over all rows: from this many rows on, up to this many columns of u, with this error of a margin at most.
EXPAND_ROWS, EXPAND_WIDTH, EXPANSION_ERROR = 50_000, 96, 1e-9
#: A variance below this part of the mean square is rounding error of a constant column.
CONSTANT_PART = 1e-13
TOLERANCE, MAX_STEPS = 1e-10, 60
#: Newton decrement of a fitted model.  Along collinear features only the penalty holds a coefficient: there the rounding
#: error of sums over many rows moves it by more than ``TOLERANCE`` for ever, without changing a margin.
DECREMENT = 1e-16


# ---------------------------------------------------------------- rows as u


@dataclass(frozen=True)
class Units:
    """Features with the mean and deviation of their values, in whose units u is written."""

    features: tuple[str, ...]
    center: np.ndarray
    spread: np.ndarray

    def u(self, values: np.ndarray) -> np.ndarray:
        gone = np.isnan(values)
        return np.hstack([np.ones((len(values), 1)), np.where(gone, 0.0, (values - self.center) / self.spread), gone])


def units_of(table: DataFrame, features: list[str]) -> Units:
    row = table.agg(*[f(q(c)) for c in features for f in (F.avg, F.stddev_pop)]).first()
    center = np.array([row[2 * i] if row[2 * i] is not None else 0.0 for i in range(len(features))])
    spread = np.array([row[2 * i + 1] or 1.0 for i in range(len(features))])
    return Units(tuple(features), center, spread)


def _values(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(values, label, fold) of a task's rows, some hundreds at once."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            part = batch.slice(lo, rows)
            columns = [part.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(2, part.num_columns)]
            values = np.stack(columns, axis=1) if columns else np.zeros((part.num_rows, 0))
            yield values, part.column(0).to_numpy(zero_copy_only=False).astype(int), part.column(1).to_numpy(zero_copy_only=False).astype(int)


def _blocks(batches: Iterator[pa.RecordBatch], units: Units, rows: int = ROWS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(u, label, fold) of a task's rows, some hundreds at once."""
    for values, y, fold in _values(batches, rows):
        yield units.u(values), y, fold


def _matrix(folded: DataFrame, units: Units, cfg: ModelConfig) -> DataFrame:
    return folded.select(q(cfg.label).cast("int"), F.col("fold").cast("int"), *[q(c).cast("double") for c in units.features])


def _summed(parts: DataFrame, key: str) -> DataFrame:
    """(key, body): arrays of doubles added up by key, in tasks."""

    def add(table: pa.Table) -> pa.Table:
        bodies = table.column("body")
        total = np.frombuffer(bodies[0].as_py(), float).copy()
        for b in bodies[1:]:
            total += np.frombuffer(b.as_py(), float)
        return pa.table({key: pa.array([table.column(key)[0].as_py()], pa.int64()), "body": pa.array([total.tobytes()], pa.binary())})

    return parts.groupBy(key).applyInArrow(add, f"{key} bigint, body binary")


def _emit(bodies: dict[int, np.ndarray], key: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(bodies), pa.int64()), pa.array([b.tobytes() for b in bodies.values()], pa.binary())], [key, "body"])


def fold_grams(folded: DataFrame, units: Units, k: int, cfg: ModelConfig) -> np.ndarray:
    """Gram matrices of u: (fold, class, d, d); one pass."""
    d = 1 + 2 * len(units.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for u, y, fold in _blocks(batches, units):
            cell = 2 * fold + y
            for c in np.unique(cell):
                rows = u[cell == c]
                held[int(c)] = held.get(int(c), 0) + rows.T @ rows
        if held:
            yield _emit(held, "cell")

    out = np.zeros((k, 2, d, d))
    for r in _summed(_matrix(folded, units, cfg).mapInArrow(run, "cell bigint, body binary"), "cell").collect():  # 2 k rows
        out[r["cell"] // 2, r["cell"] % 2] = np.frombuffer(r["body"], float).reshape(d, d)
    return out


# ---------------------------------------------------------------- fold-local preprocessing


@dataclass
class TrainingSet:
    """What a fold's training rows say: standardisation as a map of u, F scores, covariance of the standardised features."""

    fold: int
    positives: int
    negatives: int
    used: np.ndarray  # features with a value in the training rows
    median: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    f_score: np.ndarray
    cov: np.ndarray
    design: np.ndarray  # u -> [1, standardised features]

    def ranking(self, features: tuple[str, ...]) -> list[int]:
        """Used features by F score (to 6 decimals, then by name)."""
        key = lambda i: (np.isnan(self.f_score[i]), -np.round(self.f_score[i], 6), features[i])
        return sorted(np.flatnonzero(self.used).tolist(), key=key)


def _standardised(gram: np.ndarray, impute: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(rows, mean, second-moment matrix about the mean) of imputed values from a Gram matrix of u."""
    n_f = len(impute)
    t = np.zeros((n_f + 1, 1 + 2 * n_f))
    t[0, 0] = 1
    t[1:, 1 : 1 + n_f] = np.eye(n_f)
    t[1:, 1 + n_f :] = np.diag(impute)
    b = t @ gram @ t.T
    n = b[0, 0]
    mean = b[0, 1:] / n if n else np.zeros(n_f)
    return n, mean, b[1:, 1:] - n * np.outer(mean, mean)


def training_sets(grams: np.ndarray, medians: np.ndarray, units: Units) -> list[TrainingSet]:
    """Per fold, from the sums of the other folds' Gram matrices; ``medians`` is (fold, feature), NaN without values."""
    k, n_f = medians.shape
    before = np.concatenate([np.zeros((1, *grams.shape[1:])), np.cumsum(grams, axis=0)])
    after = np.concatenate([np.cumsum(grams[::-1], axis=0)[::-1], np.zeros((1, *grams.shape[1:]))])
    out = []
    for f in range(k):
        train = before[f] + after[f + 1]
        impute = np.nan_to_num((medians[f] - units.center) / units.spread)
        n, mean, m2 = _standardised(train.sum(axis=0), impute)
        n = max(n, 1.0)  # a training set without rows has zeros throughout
        classes = [_standardised(train[c], impute) for c in (0, 1)]
        square = np.diag(m2) + n * mean**2
        var = np.where(np.diag(m2) > CONSTANT_PART * np.maximum(square, n * 1e-20), np.diag(m2) / n, 0.0)
        dev = np.where(var > 0, np.sqrt(var), 1.0)
        used = ~np.isnan(medians[f])
        within = sum(np.diag(c[2]) for c in classes)
        within = np.where(within > CONSTANT_PART * np.maximum(square, n * 1e-20), within, 0.0)
        between = sum(c[0] * (c[1] - mean) ** 2 for c in classes)
        with np.errstate(divide="ignore", invalid="ignore"):
            f_score = np.where(within > 0, between / (within / (n - 2)), np.where(between > CONSTANT_PART * square, np.inf, np.nan)) if n > 2 and all(c[0] for c in classes) else np.full(n_f, np.nan)
        design = np.zeros((1 + 2 * n_f, 1 + n_f))
        design[0, 0] = 1
        design[0, 1:] = -mean / dev
        design[1 : 1 + n_f, 1:] = np.diag(1 / dev)
        design[1 + n_f :, 1:] = np.diag(impute / dev)
        out.append(TrainingSet(f, int(train[1, 0, 0]), int(train[0, 0, 0]), used, medians[f], units.center + units.spread * mean, units.spread * np.where(var > 0, dev, 0.0), f_score, m2 / n / np.outer(dev, dev), design))
        out[-1].scale[var == 0] = 1.0
    return out


def components(train: TrainingSet, columns: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(variances, directions by column), greatest variance first; a direction's largest entry is positive."""
    values, vectors = np.linalg.eigh(train.cov[np.ix_(columns, columns)])
    values, vectors = values[::-1], vectors[:, ::-1]
    top = np.argmax(np.abs(vectors), axis=0)
    return np.maximum(values, 0.0), vectors * np.sign(vectors[top, np.arange(len(columns))])


def prepare(folded: DataFrame, features: list[str], k: int, cfg: ModelConfig, loo: bool = False) -> tuple[Units, list[TrainingSet]]:
    """Training sets of all folds: one pass for the units, one for the Gram matrices, one quantile job."""
    units = units_of(folded, features)
    med = loo_statistics(folded, features, cfg).select("train_fold", "feature", "median") if loo else fold_medians(folded, features, k)
    place = {c: i for i, c in enumerate(features)}
    medians = np.full((k, len(features)), np.nan)
    for r in med.where(F.col("median").isNotNull()).collect():  # folds x features
        medians[r["train_fold"], place[r["feature"]]] = r["median"]
    return units, training_sets(fold_grams(folded, units, k, cfg), medians, units)


# ---------------------------------------------------------------- models


@dataclass
class Model:
    """One fit: the rows outside ``fold`` seen through ``design`` (u -> [1, inputs]).

    The design is ``base`` (u -> [1, features], one for all models of a training set), of which ``columns`` (or all features)
    are taken and, where there are ``directions``, projected on them.
    """

    name: str
    fold: int
    base: np.ndarray
    weight: tuple[float, float]  # of a negative, of a positive
    coef: np.ndarray
    columns: tuple[int, ...] | None = None
    directions: np.ndarray | None = None

    def __post_init__(self):
        if self.columns is None:
            self.columns = tuple(range(self.base.shape[1] - 1))

    @property
    def design(self) -> np.ndarray:
        inputs = self.base[:, [1 + c for c in self.columns]]
        return np.hstack([self.base[:, :1], inputs if self.directions is None else inputs @ self.directions])


def model(name: str, train: TrainingSet, columns: list[int], directions: np.ndarray | None = None) -> Model:
    """A fold's model on standardised ``columns``, or on their projections on ``directions``."""
    n = train.positives + train.negatives
    balanced = tuple(n / (2.0 * c) if c else 0.0 for c in (train.negatives, train.positives))
    return Model(name, train.fold, train.design, balanced, np.zeros(1 + (len(columns) if directions is None else directions.shape[1])), tuple(columns), directions)


def _logistic(margin: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * margin))


def _nested(models: list[Model], tried: dict[int, np.ndarray]) -> list[tuple]:
    """The models ``tried`` by fold: (fold, base, [(columns, directions, [(number, inputs, weight, coefficients)])]).

    Models on the same columns whose directions are a prefix of the longest ones share their products with the rows.
    """
    out: dict[int, tuple] = {}
    for i, w in sorted(tried.items(), key=lambda x: -len(x[1])):
        m = models[i]
        _, _, sets = out.setdefault(m.fold, (m.fold, m.base, []))
        same = lambda d: d is m.directions if d is None or m.directions is None else np.array_equal(d[:, : m.directions.shape[1]], m.directions)
        at = next((x for x in sets if x[0] == m.columns and same(x[1])), None)
        if at is None:
            sets.append(at := (m.columns, m.directions, []))
        at[2].append((i, len(w) - 1, m.weight, w))
    return list(out.values())


def _derivatives(shared, units: Units):
    """Loss, gradient and Hessian of every model over a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for u, y, fold in _blocks(batches, units, FIT_ROWS):
            for own, base, sets in shared.value:
                train = fold != own  # its own rows are no training rows
                x, y_t = u[train] @ base, y[train]
                for columns, directions, members in sets:
                    part = x[:, [0, *(1 + c for c in columns)]]
                    if directions is not None:
                        part = np.hstack([part[:, :1], part[:, 1:] @ directions])
                    for i, inputs, weight, w in members:
                        z = part[:, : 1 + inputs]
                        margin = z @ w
                        s = np.where(y_t == 1, weight[1], weight[0])
                        p = _logistic(margin)
                        loss = s @ (np.logaddexp(0.0, margin) - y_t * margin)
                        hess = z.T @ (z * (s * p * (1 - p))[:, None])
                        held[i] = held.get(i, 0) + np.concatenate([[loss], z.T @ (s * (p - y_t)), hess.ravel()])
        if held:
            yield _emit(held, "model")

    return run


def _newton_step(shared, reg_scale: float):
    """A model's sums over the partitions become its penalised loss, its Newton decrement (step' H step) and its next step."""

    def newton(table: pa.Table) -> pa.Table:
        i = table.column("model")[0].as_py()
        w = next(m[3] for _, _, sets in shared.value for _, _, members in sets for m in members if m[0] == i)
        total = sum(np.frombuffer(b.as_py(), float) for b in table.column("body"))
        d = len(w)
        slope = total[1 : 1 + d] + w / reg_scale
        move = np.linalg.solve(total[1 + d :].reshape(d, d) + np.eye(d) / reg_scale, slope)
        out = np.concatenate([[total[0] + w @ w / (2 * reg_scale), slope @ move], move])
        return pa.table({"model": pa.array([i], pa.int64()), "body": pa.array([out.tobytes()], pa.binary())})

    return newton


def _loo_gradients(shared, units: Units):
    """Gradients in u of all models of a block over a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta, folds, weights = shared.value
        total = np.zeros(theta.shape)
        for u, y, fold in _blocks(batches, units):
            r = (_logistic(u @ theta) - y[:, None]) * weights[y]
            r[fold[:, None] == folds[None, :]] = 0.0  # its own row is no training row
            total += u.T @ r
        yield _emit({0: total}, "all")

    return run


def fit(folded: DataFrame, units: Units, models: list[Model], cfg: ModelConfig) -> int:
    """Fit all models by Newton steps, each of which is one job; returns their number.

    Minimised is the weighted logistic loss plus |coef|^2 / (2 reg_scale), the intercept included.
    """
    spark, matrix = folded.sparkSession, _matrix(folded, units, cfg)
    step = {i: np.zeros(len(m.coef)) for i, m in enumerate(models)}
    best = {i: np.inf for i in step}
    size = {i: 1.0 for i in step}
    steps = 0
    while step and steps < MAX_STEPS:
        steps += 1
        tried = {i: models[i].coef - size[i] * step[i] for i in step}
        shared = spark.sparkContext.broadcast(_nested(models, tried))
        sums = matrix.mapInArrow(_derivatives(shared, units), "model bigint, body binary").groupBy("model").applyInArrow(_newton_step(shared, cfg.reg_scale), "model bigint, body binary")
        for r in sums.collect():  # a row a model
            i, out = r["model"], np.frombuffer(r["body"], float)
            if out[0] <= best[i] + 1e-12 * abs(out[0]):
                models[i].coef, best[i], step[i], size[i] = tried[i], out[0], out[2:].copy(), 1.0
                if np.abs(out[2:]).max(initial=0.0) < TOLERANCE or out[1] < DECREMENT:
                    models[i].coef = tried[i] - out[2:]
                    del step[i], best[i], size[i]
            elif size[i] < 1e-9:  # no lower loss within rounding error
                del step[i], best[i], size[i]
            else:
                size[i] /= 2
        shared.unpersist()
    if step:
        raise ArithmeticError(f"{len(step)} models did not converge in {MAX_STEPS} steps")
    return steps


def model_rows(units: Units, models: list[tuple[str, int, np.ndarray]]) -> list[tuple]:
    """Rows of :data:`MODEL_DDL` of (name, fold, coefficients of u)."""
    n_f, out = len(units.features), []
    for name, fold, theta in models:
        slope = theta[1 : 1 + n_f] / units.spread
        terms = list(zip(slope.tolist(), (-slope * units.center).tolist(), theta[1 + n_f :].tolist(), strict=True))
        out.append((name, fold, float(theta[0]), terms))
    return out


def model_table(spark: SparkSession, units: Units, models: list[Model]) -> DataFrame:
    return spark.createDataFrame(model_rows(units, [(m.name, m.fold, m.design @ m.coef) for m in models]), MODEL_DDL)


def probability(features: tuple[str, ...] | list[str]) -> Column:
    """Probability of the positive class by the columns ``intercept`` and ``terms`` beside the features."""
    values = F.array(*[q(c).cast("double") for c in features])
    each = F.zip_with(values, F.col("terms"), lambda x, t: F.when(x.isNull(), t["missing"]).otherwise(x * t["slope"] + t["offset"]))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.aggregate(each, F.col("intercept"), lambda s, x: s + x)))


def score(folded: DataFrame, models: DataFrame, features: tuple[str, ...] | list[str], cfg: ModelConfig) -> DataFrame:
    """Out-of-fold predictions: every row by the models of its own fold, in one expression."""
    prob = probability(features)
    return folded.join(models, "fold").select(
        q(cfg.entity).alias("patient_id"), "model_name", "fold", q(cfg.label).cast("int").alias("y_true"),
        (prob >= cfg.threshold).cast("int").alias("y_pred"), prob.alias("y_prob"),
    )


# ---------------------------------------------------------------- leave-one-out by exclusion


FACTS_DDL = "feature string, rows bigint, held bigint, mean0 double, m20 double, whole double, low double, low_next double, high double, high_next double"


def column_facts(folded: DataFrame, features: list[str]) -> DataFrame:
    """A row a feature (:data:`FACTS_DDL`): rows, values, their mean and squared deviations, their median, and the
    order statistics from which the median without one value follows.

    Without one of m values the middle lies at the places ``low`` = (m - 2) div 2 and ``high`` = (m - 1) div 2
    of the others, which are these places of all values, or the next ones if the removed value comes before.
    """
    row = folded.agg(F.count(F.lit(1)), *[f for c in features for f in (F.count(q(c)), F.avg(q(c)), F.var_pop(q(c)) * F.count(q(c)))]).first()
    found, _, _ = places_of(folded, features, 1, lambda n: [(n - 2) // 2 + j for j in range(4)], whole=True)  # 4 values a feature
    at = dict(zip(features, found[0]))
    rows = []
    for i, c in enumerate(features):
        m, get = row[1 + 3 * i], at[c].get
        low, high = (m - 2) // 2, (m - 1) // 2
        whole = (get((m - 1) // 2) + get(m // 2)) / 2 if m else None
        rows.append((c, row[0], m, row[2 + 3 * i], row[3 + 3 * i], whole, *[get(p) if m > 1 else None for p in (low, low + 1, high, high + 1)]))
    return folded.sparkSession.createDataFrame(rows, FACTS_DDL)


def loo_statistics(folded: DataFrame, features: list[str], cfg: ModelConfig = ModelConfig(), facts: DataFrame | None = None) -> DataFrame:
    """(train_fold, feature, mean, std, scale, median) of every leave-one-out training set, by exclusion.

    No row is copied to other folds: each value meets the facts of its own column (a row a feature,
    broadcast).  A feature without a value in a training set has nulls only.
    """
    facts = facts or column_facts(folded, features)
    x, held, empty = F.col("value"), F.col("held"), F.col("rows") - F.col("held")
    given = x.isNotNull()
    step = lambda at, after: F.when(x <= F.col(at), F.col(after)).otherwise(F.col(at))
    cells = _unpivot(folded, ["fold"], features).join(F.broadcast(facts), "feature")
    # values of the others: number, missing entries, median, mean and squared deviations
    cells = cells.select(
        F.col("fold").alias("train_fold"), "feature", F.when(given, held - 1).otherwise(held).alias("m"), F.when(given, empty).otherwise(empty - 1).alias("k"),
        F.when(given, (step("low", "low_next") + step("high", "high_next")) / 2).otherwise(F.col("whole")).alias("median"),
        F.when(given, F.col("mean0") - (x - F.col("mean0")) / F.greatest(held - 1, F.lit(1))).otherwise(F.col("mean0")).alias("own_mean"),
        F.when(given, F.col("m20") - (x - F.col("mean0")) ** 2 * held / F.greatest(held - 1, F.lit(1))).otherwise(F.col("m20")).alias("m2"), "m20",
    )
    cells = cells.withColumn("off", F.col("median") - F.col("own_mean")).withColumn("share", F.col("off") * F.col("k") / (F.col("m") + F.col("k")))
    # the missing entries at the median add their distance from the mean
    added = F.col("off") * F.col("share") * F.col("m")
    var = F.when(F.col("m2") + added > F.lit(CONSTANT_PART) * (F.col("m20") + added), (F.col("m2") + added) / (F.col("m") + F.col("k"))).otherwise(F.lit(0.0))
    std = F.when(F.col("median").isNotNull(), F.sqrt(var))
    out = cells.select("train_fold", "feature", F.when(F.col("median").isNotNull(), F.col("own_mean") + F.col("share")).alias("mean"), std.alias("std"), "median")
    return out.select("train_fold", "feature", "mean", "std", F.when(F.col("std") > 0, F.col("std")).when(F.col("median").isNotNull(), F.lit(1.0)).alias("scale"), "median")


def _column(rows: DataFrame, fold: str, value: str, lo: int, width: int = 1) -> np.ndarray:
    """A column of a block of folds as (fold, feature) numbers; ``place`` numbers the features."""
    got = rows.select(F.col(fold).cast("bigint"), (F.col("place") if width > 1 else F.lit(0)).cast("bigint"), F.col(value).cast("double")).toArrow()
    at, place, values = (got.column(i).to_numpy() for i in range(3))
    out = np.full((int(at.max()) - lo + 1, width), np.nan)
    out[at - lo, place] = values.astype(float)
    return out


def _without(values: np.ndarray, facts: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(median, mean, scale) of every column without each row's own entry: :func:`loo_statistics` on arrays; NaN without values."""
    given, held, rows = ~np.isnan(values), facts["held"], facts["rows"]
    x = np.where(given, values, 0.0)
    step = lambda at, after: np.where(x <= facts[at], facts[after], facts[at])
    median = np.where(given, (step("low", "low_next") + step("high", "high_next")) / 2, facts["whole"])
    m, k, others = np.where(given, held - 1, held), np.where(given, rows - held, rows - held - 1), np.maximum(held - 1, 1)
    mean = np.where(given, facts["mean0"] - (x - facts["mean0"]) / others, facts["mean0"])
    m2 = np.where(given, facts["m20"] - (x - facts["mean0"]) ** 2 * held / others, facts["m20"])
    return _imputed(median, mean, m2, facts["m20"], m, k)


def _imputed(median, mean, m2, m20, m, k):
    """(median, mean, scale) once the ``k`` missing entries stand at the median."""
    off = median - mean
    share = off * k / np.maximum(m + k, 1)
    added = off * share * m
    std = np.sqrt(np.where(m2 + added > CONSTANT_PART * (m20 + added), (m2 + added) / np.maximum(m + k, 1), 0.0))
    return median, mean + share, np.where(np.isnan(median), np.nan, np.where(std > 0, std, 1.0))


def _affine(units: Units, median: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(used, over, shift, impute): the standardised feature is x * over - shift, a missing one impute - shift, x in units."""
    used = ~np.isnan(median)
    over = np.where(used, units.spread / np.where(used, scale, 1.0), 0.0)
    shift = np.where(used, (mean - units.center) / units.spread * over, 0.0)
    return used, over, shift, np.where(used, (median - units.center) / units.spread * over, 0.0)


def _designs(over: np.ndarray, shift: np.ndarray, impute: np.ndarray) -> np.ndarray:
    """Maps from [1, standardised features] to coefficients of u, a matrix a model."""
    n, n_f = over.shape
    d, at = np.zeros((n, 1 + 2 * n_f, 1 + n_f)), np.arange(n_f)
    d[:, 0, 0], d[:, 0, 1:] = 1, -shift
    d[:, 1 + at, 1 + at], d[:, 1 + n_f + at, 1 + at] = over, impute
    return d


def _expansion(units: Units, first: np.ndarray, active: np.ndarray):
    """Sums of a task's rows by class at the coefficients ``first``: gradient, Hessian, third derivatives, u u' over
    the logistic slope, and the greatest absolute entries of u (``active`` columns only)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        top = np.zeros(len(active))
        for u, y, _ in _blocks(batches, units):
            u = u[:, active]
            p = _logistic(u @ first[active])
            slope = p * (1 - p)
            top = np.maximum(top, np.abs(u).max(axis=0))
            for c in np.unique(y):
                v, r, s, p_c = u[y == c], (p - y)[y == c], slope[y == c], p[y == c]
                pairs = (v[:, :, None] * v[:, None, :]).reshape(len(v), -1)
                parts = [v.T @ r, s @ pairs, ((s * (1 - 2 * p_c))[:, None] * v).T @ pairs, (1 / np.maximum(s, 1e-300)) @ pairs]
                held[int(c)] = held.get(int(c), 0) + np.concatenate([x.ravel() for x in parts])
        if held:
            yield _emit({**held, 2: top}, "part")

    return run


def _greatest_or_sum(table: pa.Table) -> pa.Table:
    part = table.column("part")[0].as_py()
    bodies = [np.frombuffer(b.as_py(), float) for b in table.column("body")]
    total = np.max(bodies, axis=0) if part == 2 else np.sum(bodies, axis=0)
    return pa.table({"part": pa.array([part], pa.int64()), "body": pa.array([total.tobytes()], pa.binary())})


def _loo_expanded(shared, units: Units, name: str, reg_scale: float):
    """Every row's own model from the sums of all rows (:func:`_expansion`), its own terms taken off.

    The gradient of the other rows is expanded to the second order about the model of all rows.  With R the
    remainder and A the Hessian, the error of the coefficients is at most |R| in the norm of A's inverse, which by
    Cauchy-Schwarz is at most sqrt(sum_j s_j (u_j d)^6 / slope_j) / 48 <= a^2 / 48 * sqrt(d' Q d), d the move in u,
    a >= max_j |u_j d| and Q the sum of s_j u_j u_j' / slope_j; times sqrt(z' A^-1 z) it bounds the error of the row's margin.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts, first, coef0, active, sums, top, counts = shared.value
        n_f, n = len(units.features), sum(counts)
        for values, y, fold in _values(batches):
            for c in np.unique(y):
                v, at = units.u(values[y == c]), fold[y == c]
                median, mean, scale = _without(values[y == c], facts)
                _, over, shift, impute = _affine(units, median, mean, scale)
                left = [counts[0] - (c == 0), counts[1] - (c == 1)]
                s = [(n - 1) / (2.0 * m) for m in left]
                grad, hess, third, inverse = (s[0] * a + s[1] * b for a, b in zip(*sums, strict=True))
                designs = _designs(over, shift, impute)
                d, v = designs[:, active, :], v[:, active]
                margin = v @ first[active]
                p = _logistic(margin)
                slope = p * (1 - p)
                z = np.einsum("bj,bjk->bk", v, d)
                a = np.swapaxes(d, 1, 2) @ (hess @ d) - (s[c] * slope)[:, None, None] * z[:, :, None] * z[:, None, :] + np.eye(1 + n_f) / reg_scale
                solver = np.linalg.inv(a)
                w = np.tile(coef0, (len(v), 1))
                last = np.full(len(v), np.inf)
                for _ in range(MAX_STEPS):
                    move = np.einsum("bjk,bk->bj", d, w) - first[active]
                    own = (v * move).sum(axis=1)
                    bent = ((move @ third.reshape(len(grad), -1)).reshape(len(v), len(grad), len(grad)) * move[:, None, :]).sum(axis=2) / 2
                    g = grad + move @ hess + bent - (s[c] * ((p - c) + slope * own + slope * (1 - 2 * p) * own**2 / 2))[:, None] * v
                    step = np.einsum("bjk,bk->bj", solver, np.einsum("bjk,bj->bk", d, g) + w / reg_scale)
                    w = w - step
                    last = np.abs(step).max(axis=1)
                    if not np.nanmax(last, initial=0.0) >= TOLERANCE:
                        break
                move = np.einsum("bjk,bk->bj", d, w) - first[active]
                far = np.abs(move) @ top
                error = np.exp(2 * far) * far**2 / 48 * np.sqrt(np.maximum(((move @ inverse) * move).sum(axis=1), 0.0))
                lever = np.sqrt(np.maximum(np.einsum("bj,bjk,bk->b", z, solver, z), 0.0))
                good = (last < TOLERANCE) & (error * lever <= EXPANSION_ERROR) & (far < 1)
                theta = np.einsum("bjk,bk->bj", designs, w)
                slopes = theta[:, 1 : 1 + n_f] / units.spread
                flat = [pa.array(x.ravel()) for x in (slopes, -slopes * units.center, theta[:, 1 + n_f :])]
                terms = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * n_f, pa.int32()), pa.StructArray.from_arrays(flat, ["slope", "offset", "missing"]))
                cols = [pa.array([name] * len(v)), pa.array(at, pa.int32()), pa.array(theta[:, 0]), terms, pa.array(good & np.isfinite(theta).all(axis=1))]
                yield pa.RecordBatch.from_arrays(cols, ["model_name", "fold", "intercept", "terms", "good"])

    return run


def loo_models(
    folded: DataFrame, features: list[str], name: str, cfg: ModelConfig, positives: int, negatives: int, expand: bool | None = None
) -> tuple[Units, DataFrame, int]:
    """(units, model table, jobs): a model without each row.

    Every model is near the model of all rows.  With ``expand`` (by default from ``EXPAND_ROWS`` rows on, where the
    expansion is exact enough and blocks would be quadratic work) each row's model is solved from sums over all rows
    (:func:`_loo_expanded`), one pass; models whose error bound is above ``EXPANSION_ERROR``, and all of them without
    ``expand``, are fitted with exact gradients in blocks of ``LOO_BLOCK`` (:func:`_loo_blocks`).
    """
    spark, n = folded.sparkSession, positives + negatives
    units = units_of(folded, features)
    n_f, matrix = len(features), _matrix(folded, units, cfg)
    facts = column_facts(folded, features)
    known = {r["feature"]: r for r in facts.collect()}
    arrays = {x: np.array([np.nan if known[c][x] is None else float(known[c][x]) for c in features]) for x in ("rows", "held", "mean0", "m20", "whole", "low", "low_next", "high", "high_next")}
    held, rows = arrays["held"], arrays["rows"]
    all_of = _affine(units, *_imputed(arrays["whole"], arrays["mean0"], arrays["m20"], arrays["m20"], held, rows - held))
    whole = _designs(*[x[None, :] for x in all_of[1:]])[0]  # the design of all rows
    start = Model("all", -1, whole, (n / (2.0 * negatives), n / (2.0 * positives)), np.zeros(1 + n_f))
    jobs = fit(folded, units, [start], cfg)
    first = whole @ start.coef
    active = np.concatenate([[0], 1 + np.arange(n_f), 1 + n_f + np.flatnonzero(held < rows)])  # flags of full columns are 0
    if expand is None:
        expand = n >= EXPAND_ROWS
    if not expand or len(active) > EXPAND_WIDTH or min(positives, negatives) < 2:
        tables, more = _loo_blocks(folded, units, features, name, cfg, positives, negatives, facts, first, np.arange(n))
        return units, spark.createDataFrame(tables, MODEL_DDL), jobs + more
    d, found = len(active), {}
    for r in matrix.mapInArrow(_expansion(units, first, active), "part bigint, body binary").groupBy("part").applyInArrow(_greatest_or_sum, "part bigint, body binary").collect():  # 3 rows
        found[r["part"]] = np.frombuffer(r["body"], float)
    cut = [0, d, d + d * d, d + d * d + d**3, d + 2 * d * d + d**3]
    sums = [[found[c][a:b].reshape(shape) for a, b, shape in zip(cut[:-1], cut[1:], [(d,), (d, d), (d, d * d), (d, d)], strict=True)] for c in (0, 1)]
    shared = spark.sparkContext.broadcast((arrays, first, start.coef, active, sums, found[2], (negatives, positives)))
    solved = matrix.mapInArrow(_loo_expanded(shared, units, name, cfg.reg_scale), MODEL_DDL + ", good boolean").checkpoint()  # read here and by the scores
    rest = np.array(sorted(r["fold"] for r in solved.where(~F.col("good")).select("fold").collect()), int)
    models = solved.where("good").drop("good")
    if len(rest):
        tables, more = _loo_blocks(folded, units, features, name, cfg, positives, negatives, facts, first, rest)
        models, jobs = models.unionByName(spark.createDataFrame(tables, MODEL_DDL)), jobs + more
    return units, models, jobs + 2


def _loo_blocks(folded, units, features, name, cfg, positives, negatives, facts, first, rest: np.ndarray) -> tuple[list[tuple], int]:
    """(rows of the models without the rows ``rest``, jobs), fitted in blocks of ``LOO_BLOCK`` models.

    Every model starts from the model of all rows and keeps that model's Hessian (in u), which differs
    from its own by one row of n; gradients are exact, so each step shortens the error about n times.
    """
    spark, n, n_f = folded.sparkSession, positives + negatives, len(features)
    matrix = _matrix(folded, units, cfg)

    def curvature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for u, y, _ in _blocks(batches, units):
            p = _logistic(u @ first)
            s = np.where(y == 1, n / (2.0 * positives), n / (2.0 * negatives))
            h = u.T @ (u * (s * p * (1 - p))[:, None])
            total = h if total is None else total + h
        if total is not None:
            yield _emit({0: total}, "all")

    hess = np.frombuffer(_summed(matrix.mapInArrow(curvature, "all bigint, body binary"), "all").first()["body"], float).reshape(1 + 2 * n_f, 1 + 2 * n_f)
    tables, jobs = [], 0
    for lo in range(0, len(rest), LOO_BLOCK):
        folds = rest[lo : lo + LOO_BLOCK]
        mine = spark.createDataFrame([(int(f), i) for i, f in enumerate(folds)], "fold int, at int")
        block = folded.join(F.broadcast(mine), "fold").drop("fold").withColumnRenamed("at", "fold")  # numbered within the block
        y_own = _column(block.select("fold", F.col(cfg.label).cast("int").alias("y")), "fold", "y", 0)[:, 0]
        place = spark.createDataFrame(list(enumerate(features)), "place int, feature string")
        stats = loo_statistics(block, features, cfg, facts).join(F.broadcast(place), "feature")
        used, over, shift, impute = _affine(units, *(_column(stats, "train_fold", c, 0, n_f) for c in ("median", "mean", "scale")))
        pos, neg = positives - y_own, negatives - (1 - y_own)
        weights = np.stack([(n - 1) / (2.0 * neg), (n - 1) / (2.0 * pos)])  # by class, of each model
        solvers = [np.linalg.inv(d.T @ hess @ d + np.eye(1 + n_f) / cfg.reg_scale) for d in _designs(over, shift, impute)]
        solvers = np.array(solvers)
        coef = np.where(used, first[1 : 1 + n_f] / np.where(used, over, 1.0), 0.0)
        coef = np.hstack([(first[0] + (coef * shift).sum(axis=1))[:, None], coef])
        for _ in range(MAX_STEPS):
            theta = np.hstack([(coef[:, 0] - (coef[:, 1:] * shift).sum(axis=1))[:, None], coef[:, 1:] * over, coef[:, 1:] * impute]).T
            shared = spark.sparkContext.broadcast((theta, folds, weights))
            grad = np.frombuffer(_summed(matrix.mapInArrow(_loo_gradients(shared, units), "all bigint, body binary"), "all").first()["body"], float).reshape(theta.shape).T
            shared.unpersist()
            jobs += 1
            own = np.hstack([grad[:, :1], grad[:, 1 : 1 + n_f] * over + grad[:, 1 + n_f :] * impute - grad[:, :1] * shift])
            moves = np.einsum("ijk,ik->ij", solvers, own + coef / cfg.reg_scale)
            coef -= moves
            if np.abs(moves).max() < TOLERANCE:
                break
        else:
            raise ArithmeticError("leave-one-out models did not converge")
        tables += [(name, int(f), theta[:, i]) for i, f in enumerate(folds)]
    return model_rows(units, tables), jobs
