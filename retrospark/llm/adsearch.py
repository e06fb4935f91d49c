"""Approximate nearest neighbours: inverted lists with an adaptive dimension scan.

* The index is fitted on a bounded sample (``sample_rows`` vectors with the smallest id hashes):
  a random rotation and k-means centroids.  Every vector is indexed in its nearest list.
* How many lists a query probes is calibrated on the sample: the fewest nearest lists that hold
  ``aim`` of the true ``k`` nearest sample neighbours of up to ``CALIBRATE`` sample vectors.
  (In the whole table the neighbours lie nearer, so this errs on the safe side.)  A query
  probes more lists where those hold fewer than ``k`` candidates.
* Within a probed list the rotated vectors are scanned in blocks of ``BLOCK`` columns.  After
  each block a hypothesis test compares the partial distance with the current k-th best: after
  a random rotation ``d`` of ``D`` columns hold about ``d / D`` of the squared distance, so a
  candidate is abandoned once ``partial > best * d / D * (1 + EPS / sqrt(d))**2``.  Survivors
  get the exact distance of the original vectors in double precision.
* Lists larger than ``PART`` vectors and lists with more than ``PART_QUERIES`` queries are split
  by id hash, so a list that holds a third of all vectors is several tasks; each returns its
  best ``k`` and the best of all are taken by a window per query.

Defined cases: vectors that are null, zero, of another length than the commonest, or that hold
null or non-finite components take no part, neither do rows with null id; a query is never its
own candidate (rows that repeat its id neither); ties go to the smaller vec_id; rows that repeat
a query id are one query (the first of its vectors in array order); extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retrospark.llm.common import ship

ship(__name__)

BLOCK = 16
EPS = 2.1
PART = 50_000
PART_QUERIES = 2_000
STEP = 1024
CALIBRATE = 256


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(ok, F.lit(False)))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (size[0]["d"] if size else 0))


def fit(sample: np.ndarray, lists: int, seed: int = 5, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(rotation, centroids in rotated space) from a bounded sample."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
    x = np.unique(sample @ rotation, axis=0)
    centroids = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = _square(x, centroids).argmin(axis=1)
        total = np.zeros_like(centroids)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(centroids))
        centroids = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centroids)
    return rotation, centroids


def probes_needed(sample: np.ndarray, rotation: np.ndarray, centroids: np.ndarray, k: int, aim: float) -> int:
    """Fewest nearest lists that hold the share ``aim`` of the true neighbours within the sample."""
    x = sample @ rotation
    home = _square(x, centroids).argmin(axis=1)
    asked = x[:CALIBRATE]
    near = _square(asked, x)
    near[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    top = np.argsort(near, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    if not top.size:
        return 1
    order = _square(asked, centroids).argsort(axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape).copy(), axis=1)
    at = np.sort(np.take_along_axis(place, home[top], axis=1).ravel())
    return int(at[min(int(np.ceil(aim * len(at))), len(at)) - 1]) + 1


def _square(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :]


def scan(q: np.ndarray, q_id: int, rotated: np.ndarray, query: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best ``k`` (ids, distances) of one list part.  ``rotated``: blocks x vectors x BLOCK; ``q`` is rotated alike."""
    total = len(q)
    best_d, best_i = np.zeros(0), np.zeros(0, np.int64)
    for a in range(0, len(ids), STEP):
        left = np.arange(a, min(a + STEP, len(ids)))
        left = left[ids[left] != q_id]
        if len(best_d) == k:
            limit = best_d[-1] ** 2
            part = np.zeros(len(left))
            for b in range(len(rotated)):
                lo = b * BLOCK
                diff = rotated[b, left] - q[lo : lo + BLOCK]
                part += (diff * diff).sum(axis=1)
                seen = min(lo + BLOCK, total)
                ratio = 1.0 if seen == total else seen / total * (1 + EPS / seen**0.5) ** 2
                stay = part <= limit * ratio * (1 + 1e-9)
                left, part = left[stay], part[stay]
                if not len(left):
                    break
        if len(left):
            diff = vectors[left] - query
            d = np.concatenate([best_d, np.sqrt((diff * diff).sum(axis=1))])
            i = np.concatenate([best_i, ids[left]])
            order = np.lexsort((i, d))[:k]
            best_d, best_i = d[order], i[order]
    return best_i, best_d


def nearest(vectors: DataFrame, is_query, k: int = 10, lists: int | None = None, n_probe: int | None = None, aim: float = 0.98, sample_rows: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every vector for which ``is_query`` (a column) holds.

    ``lists`` defaults to half the square root of the number of vectors, 4096 at most; ``n_probe``
    to the calibrated number of lists.
    """
    spark = vectors.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    rows = usable(vectors)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], schema)
    few = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample_rows).collect()  # sample_rows at most
    n_lists = lists or int(min(max(round(n**0.5 / 2), 1), 4096))
    sample = np.array([r["v"] for r in few])
    rotation, centroids = fit(sample, n_lists)
    n_probe = n_probe or probes_needed(sample, rotation, centroids, k, aim)
    index = spark.sparkContext.broadcast((rotation, centroids))

    def assign(batches):
        r, c = index.value
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()) @ r
                yield pdf.assign(list=_square(x, c).argmin(axis=1).astype(np.int32))

    indexed = rows.mapInPandas(assign, "vec_id bigint, v array<double>, list int")
    sizes = {r["list"]: r["n"] for r in indexed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # one row a list
    held = np.array([sizes.get(i, 0) for i in range(len(centroids))])

    def probe(batches):
        r, c = index.value
        for pdf in batches:
            if not len(pdf):
                continue
            order = _square(np.stack(pdf["v"].to_numpy()) @ r, c).argsort(axis=1, kind="stable")
            enough = np.cumsum(held[order], axis=1) > k  # itself and k others
            n_first = np.maximum(np.where(enough.any(axis=1), enough.argmax(axis=1) + 1, order.shape[1]), min(n_probe, order.shape[1]))
            yield pdf.assign(list=[o[:m].astype(np.int32) for o, m in zip(order, n_first, strict=True)])

    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    probes = asked.mapInPandas(probe, "vec_id bigint, v array<double>, list array<int>").select("vec_id", "v", F.explode("list").alias("list"))
    wanted = {r["list"]: r["n"] for r in probes.groupBy("list").agg(F.count("*").alias("n")).collect()}

    # a row a list: into how many parts its vectors and its queries are dealt
    dealt = [(i, max(1, -(-sizes.get(i, 0) // PART)), max(1, -(-wanted.get(i, 0) // PART_QUERIES))) for i in range(len(centroids))]
    parts = F.broadcast(spark.createDataFrame(dealt, "list int, v_parts int, q_parts int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    left = indexed.join(parts, "list").select("list", own("v_parts").alias("part"), each("q_parts").alias("share"), "vec_id", "v")
    right = probes.join(parts, "list").select("list", each("v_parts").alias("part"), own("q_parts").alias("share"), "vec_id", "v")

    def search(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(queries):
            r, _ = index.value
            candidates = candidates.sort_values("vec_id")
            ids, x = candidates["vec_id"].to_numpy(), np.stack(candidates["v"].to_numpy())
            turned = x @ r
            width = -(-turned.shape[1] // BLOCK) * BLOCK
            padded = np.zeros((len(x), width))
            padded[:, : turned.shape[1]] = turned
            blocks = np.ascontiguousarray(padded.reshape(len(x), -1, BLOCK).transpose(1, 0, 2))
            for q_id, q in zip(queries["vec_id"].to_numpy(), np.stack(queries["v"].to_numpy()), strict=True):
                t = np.zeros(width)
                t[: len(q)] = q @ r
                found, d = scan(t, int(q_id), blocks, q, x, ids, k)
                out.append(pd.DataFrame({"query_id": q_id, "vec_id": found, "score": d}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    keys = ["list", "part", "share"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id bigint, vec_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
