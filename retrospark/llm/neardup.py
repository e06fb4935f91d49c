"""MinHash near-duplicate detection with b-bit signatures.

1. ``signatures``: one map pass gives every text its number of shingles, a digest of its shingle
   set, band keys and the packed low bits of its minima (b-bit MinHash).  Stored once; shingle
   sets are not stored.
2. Equal sets are one class (its smallest doc_id).  Only classes go on, so copies cost nothing.
3. Band candidate generation: classes with a common band key are hung on the smallest of them;
   connected components of these links bound where linked texts can be.
4. Verification: a component's texts are dealt into blocks of about ``BLOCK`` shingles; a task
   meets two blocks at a time.  The bit counts of the packed signatures give a
   collision-corrected similarity; pairs that reach the threshold less ``MARGIN`` standard
   errors and are not yet connected are confirmed on their full shingle sets (matrix product in
   slices).  Only a spanning forest of the confirmed links leaves the task.
   A component of several blocks is first checked within its blocks and against its first
   block; other pairs of blocks follow unless both already lie in one component.
5. Components of the confirmed links give the classes, hence every document, its group.

Skew: exact copies collapse in step 2 by a map-side combined aggregate; a band key held by very
many classes is only aggregated and joined (step 3); a very large component is split into
blocks (step 4).  No pair is emitted but confirmed spanning links.

Defined cases: null or empty text has no shingles, is linked with nothing and is kept; fewer words than a
shingle are one shingle; rows that repeat a doc_id are one document; a row with null doc_id gets
the group of its text (null if no document has it) and is kept only without a group; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrospark.llm import shingles as S
from retrospark.llm.common import materialize, mix64, ship, tidy
from retrospark.llm.components import connected_components

ship(__name__)

BITS = 4
BLOCK = 150_000
MARGIN = 5.5
#: Columns of a slice of the matrix product.
SLICE = 4096


def signatures(docs: DataFrame, words: int, rows: int, count: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, keys, sig): ``count`` bands of ``rows`` minima."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = S.Hasher(words)
        for batch in batches:
            for b in range(0, batch.num_rows, 500):
                part = batch.slice(b, 500)
                sets = [hasher.shingles(t) for t in part.column("text").to_pylist()]
                sizes = np.array([len(s) for s in sets], np.int64)
                d = np.zeros((len(sets), 2), np.uint64)
                keys, sig = [[] for _ in sets], [b""] * len(sets)
                full = np.flatnonzero(sizes)
                if len(full):
                    some = [sets[i] for i in full]
                    at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    flat = np.concatenate(some)
                    d[full, 0] = np.add.reduceat(mix64(flat), at)  # sums of scrambled hashes: equal for equal sets
                    d[full, 1] = np.add.reduceat(mix64(flat ^ np.uint64(0x5851F42D4C957F2D)), at)
                    low = S.minima(some, rows * count)
                    for i, k, g in zip(full, S.bands(low, count), S.pack(low, BITS), strict=True):
                        keys[i], sig[i] = k, g.tobytes()
                digest = [pa.array(d[:, j].view(np.int64)) for j in range(2)]
                made = [pa.array(sizes), *digest, pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made], ["doc_id", "n_shingles", "d1", "d2", "keys", "sig"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {id_type}, n_shingles bigint, d1 bigint, d2 bigint, keys array<bigint>, sig binary")


def _union(n: int, links: np.ndarray) -> np.ndarray:
    """Smallest position connected with each of n positions."""
    parent = list(range(n))
    for a, b in links:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        parent[max(a, b)] = min(a, b)
    out = np.arange(n)
    for i in range(n):
        while parent[out[i]] != out[i]:
            out[i] = parent[out[i]]
    return out


def _confirmed(sets: list[np.ndarray], pairs: np.ndarray, percent: int) -> np.ndarray:
    """Those of the (few or many) position pairs that are linked by their full sets."""
    if len(pairs) <= 4 * len(sets):
        keep = [S.linked(sets[a], sets[b], percent) for a, b in pairs]
        return pairs[np.array(keep, bool)] if len(pairs) else pairs
    used = np.unique(pairs)
    place = np.full(len(sets), -1)
    place[used] = np.arange(len(used))
    sizes = np.array([len(sets[i]) for i in used], np.int64)
    who = np.repeat(np.arange(len(used)), sizes)
    values, column, times = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    who, column = who[shared[column]], number[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    who, column = who[order], column[order]
    both = np.zeros((len(used), len(used)), np.float32)
    for c in range(0, int(shared.sum()), SLICE):
        lo, hi = np.searchsorted(column, [c, c + SLICE])
        m = np.zeros((len(used), SLICE), np.float32)
        m[who[lo:hi], column[lo:hi] - c] = 1
        both += m @ m.T
    a, b = place[pairs[:, 0]], place[pairs[:, 1]]
    inter = both[a, b].astype(np.int64)
    return pairs[100 * inter >= percent * (sizes[a] + sizes[b] - inter)]


def _links(pdf: pd.DataFrame, hasher: S.Hasher, percent: int, cut: float, across: bool) -> np.ndarray:
    """Positions of confirmed links in one component; ``across``: between the two blocks only."""
    sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), -1)
    size, group, side = pdf["n_shingles"].to_numpy(), pdf["known"].to_numpy(), pdf["side"].to_numpy()
    found = []
    for i in range(len(pdf) - 1):
        rest = np.arange(i + 1, len(pdf))
        ok = (group[rest] != group[i]) & (100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i]))
        if across:
            ok &= side[rest] != side[i]
        rest = rest[ok]
        if len(rest):
            rest = rest[S.estimate(sig[rest], np.broadcast_to(sig[i], (len(rest), sig.shape[1])), BITS) >= cut]
            found.append(np.stack([np.full(len(rest), i), rest], axis=1))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    if not len(pairs):
        return pairs
    need = set(np.unique(pairs).tolist())
    sets = [hasher.shingles(t) if i in need else np.zeros(0, np.uint64) for i, t in enumerate(pdf["text"])]
    return _confirmed(sets, pairs, percent)


def _verify(members: DataFrame, words: int, percent: int, cut: float) -> DataFrame:
    """Confirmed spanning links (u, v) of members (task, comp, side, across, known, node, n_shingles, sig, text)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hasher, u, v = S.Hasher(words), [], []
        for _, one in pdf.groupby("comp"):
            one = one.sort_values(["node", "n_shingles"]).reset_index(drop=True)
            links = _links(one, hasher, percent, cut, bool(one["across"].iloc[0]))
            if len(links):
                node = one["node"].to_numpy()
                root = _union(len(one), links)
                at = np.flatnonzero(root != np.arange(len(one)))
                u.extend(node[at].tolist())
                v.extend(node[root[at]].tolist())
        return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})

    return members.groupBy("task").applyInPandas(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, rows: int = 4, count: int = 30) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Texts are linked whose shingle sets share at least ``percent`` / 100 of their union.  With
    ``count`` bands of ``rows`` minima two texts of similarity s meet with probability
    1 - (1 - s**rows)**count (defaults at 0.8: all but 1.3e-7).
    """
    s = percent / 100
    cut = s - MARGIN * ((s * (1 - s) + 2.0**-BITS) / (rows * count)) ** 0.5
    every = materialize(signatures(docs, words, rows, count))
    digest = ["d1", "d2", "n_shingles"]
    some = every.where("n_shingles > 0")
    classes = some.groupBy(*digest).agg(F.min("doc_id").alias("node"))

    # band candidates: a class is hung on the smallest class of each of its bands
    firsts = some.join(classes, digest).where("doc_id = node").select("node", "n_shingles", "sig", "keys", *["d1", "d2"]).dropDuplicates(["node", "d1", "d2"])
    firsts = materialize(firsts)
    banded = firsts.select("node", F.explode("keys").alias("key"))
    hubs = banded.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").select("key", "hub")
    pairs = banded.join(hubs, "key").where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    candidate = connected_components(pairs)

    # blocks of the candidate components
    sized = firsts.join(candidate, "node").withColumnRenamed("component", "comp")
    total = sized.groupBy("comp").agg(F.ceil(F.sum("n_shingles") / BLOCK).cast("int").alias("blocks"))
    sized = sized.join(total, "comp").select(
        "comp", "node", "n_shingles", "sig", "d1", "d2", "blocks", F.pmod(F.xxhash64("node", "d1"), F.col("blocks")).cast("int").alias("block")
    )
    bins = int(some.agg(F.sum("n_shingles")).first()[0] or 0) // BLOCK + 1
    texts = sized.join(docs.select(F.col("doc_id").alias("node"), "text"), "node")
    texts = materialize(texts.withColumn("known", F.col("node")))

    def tasks(first_round: bool, source: DataFrame) -> DataFrame:
        b, n = F.col("block"), F.col("blocks")
        if first_round:  # (b, b), and (0, b) for both
            other = F.when(b == 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array(b, F.lit(0)))
        else:  # (i, j) with 0 < i < j
            other = F.filter(F.sequence(F.lit(1), n - 1), lambda x: x != b)
        out = source.withColumn("other", F.explode(other))
        lo, hi = F.least("block", "other"), F.greatest("block", "other")
        name = F.when(n == 1, F.concat(F.lit("bin:"), F.pmod(F.xxhash64("comp"), F.lit(bins)).cast("string"))).otherwise(F.concat_ws(":", "comp", lo, hi))
        return out.select(
            name.alias("task"), "comp", F.when(b == lo, 0).otherwise(1).alias("side"), (lo != hi).alias("across"), "known", "node", "n_shingles", "sig", "text"
        )

    links = materialize(_verify(tasks(True, texts), words, percent, cut))
    many = texts.where("blocks > 2")
    if many.limit(1).count():
        known = connected_components(links)
        again = many.drop("known").join(known, "node", "left").withColumn("known", F.coalesce("component", F.col("node"))).drop("component")
        whole = again.groupBy("comp", "block").agg(F.min("known").alias("a"), F.max("known").alias("z"))
        one = whole.groupBy("comp").agg(F.min("a").alias("a"), F.max("z").alias("z")).where("a < z").select("comp")  # not yet one component
        again = materialize(again.join(one, "comp", "left_semi"))
        links = links.unionByName(materialize(_verify(tasks(False, again.where("block > 0")), words, percent, cut)))
    groups = connected_components(links)

    named = classes.join(groups, "node", "left").select(*digest, F.coalesce("component", "node").alias("component_id"))
    out = every.select("doc_id", *digest).join(named, digest, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
