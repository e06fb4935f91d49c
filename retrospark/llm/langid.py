"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

* Features: 1- to 3-grams of lower-cased code points, hashed to ``DIM`` buckets; the value is the
  n-gram's share of the text's n-grams times its inverse document frequency.
* Document frequencies count every learnable text (one map pass; each task adds up its own
  vector of ``DIM`` counts, which are then summed).
* Training: follow-the-regularised-leader (per-coordinate rates, L1 and L2 penalties) on a
  bounded sample, ``per_label`` texts a label at most, the ones with the smallest id hashes.
  One fifth of the sample is kept out of the fit and sets the temperature of the softmax.
* Scoring: one map pass over all texts with the broadcast model (``DIM`` x labels floats);
  linear in the characters, blocks of ``BLOCK`` code points, so memory doesn't grow with a text.

The work per text is array code in ``mapInPandas`` and ``mapInArrow``; Spark partitions it, nothing is shuffled
but the counts and the sample, and a lost task is simply run again.

Defined cases: null text or one without a letter is ``und`` with score 0; so is every text if
there is no labelled example; ties go to the first label in alphabetical order; repeated rows
each get a row; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrospark.llm.common import doc_remainder, ship, tidy

ship(__name__)

DIM = 1 << 15
ORDERS = (1, 2, 3)
BLOCK = 1 << 19
UNKNOWN = "und"


def _grams(codes: np.ndarray, n: int, order: int) -> np.ndarray:
    """Bucket of the ``order``-gram at each of the first ``n`` positions; DIM where it holds a 0 (a border)."""
    pad = np.zeros(n + order - 1, np.uint32)
    pad[: min(len(codes), n + order - 1)] = codes[: n + order - 1]
    h = np.full(n, 0x9E3779B1 * order & 0xFFFFFFFF, np.uint32)
    border = np.zeros(n, bool)
    for j in range(order):
        c = pad[j : j + n]
        border |= c == 0
        h = (h ^ c) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
    idx = ((h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - 15)).astype(np.int32)
    idx[border] = DIM
    return idx


def _blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document numbers, their first positions in the block, buckets of all orders) of joined texts."""
    group: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        group.append(i)
        size += len(t) + 1
        if size >= BLOCK or i == len(texts) - 1:
            joined = "\0".join(texts[k].lower().replace("\0", " ") for k in group) + "\0"
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            ends = np.flatnonzero(codes == 0)
            starts = np.concatenate([[0], ends[:-1] + 1])
            for b in range(0, len(codes), BLOCK):
                n = min(BLOCK, len(codes) - b)
                first = np.searchsorted(starts, b, "right") - 1
                last = np.searchsorted(starts, b + n, "left")
                at = np.maximum(starts[first:last] - b, 0)
                part = codes[b : b + n + max(ORDERS) - 1]
                yield np.asarray(group)[first:last], at, np.stack([_grams(part, n, k) for k in ORDERS])
            group, size = [], 0


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """How many texts of ``docs`` (text) hold each bucket; the last entry is the number of texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(DIM + 1, np.int64)
        for pdf in batches:
            texts = [t for t in pdf["text"] if t]
            seen = np.zeros(DIM + 1, bool)
            open_doc = -1
            for nums, at, idx in _blocks(texts):
                stops = np.append(at[1:], idx.shape[1])
                for num, a, z in zip(nums, at, stops, strict=True):
                    if num != open_doc:
                        df += seen
                        seen[:] = False
                        open_doc = num
                    seen[idx[:, a:z].ravel()] = True
            df += seen
            df[DIM] -= int(seen[DIM])
            df[DIM] = 0
            df_docs[0] += len(texts)
        df[DIM] = df_docs[0]
        at = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": df[at]})

    df_docs = [0]
    out = np.zeros(DIM + 1, np.int64)
    for r in docs.select("text").mapInPandas(tidy(count), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]  # at most DIM + 1 rows
    return out


def _features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(DIM + 1)
    for _, _, idx in _blocks([text]):
        total += np.bincount(idx.ravel(), minlength=DIM + 1)
    total[DIM] = 0
    at = np.flatnonzero(total)
    return at, total[at] * idf[at] / max(total.sum(), 1.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], labels: list[str], idf: np.ndarray, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 4, seed: int = 7) -> dict:
    """FTRL-proximal on the given (bounded) examples; every fifth example sets the temperature."""
    names = sorted(set(labels))
    y = np.array([names.index(v) for v in labels])
    rows = [_features(t, idf) for t in texts]
    scale = 1.0 / max(np.mean([np.sqrt((v * v).sum()) for _, v in rows]), 1e-12)  # unit norm on average
    rows = [(a, v * scale) for a, v in rows]
    held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 20 else np.zeros(len(rows), bool)
    z, n = np.zeros((DIM, len(names))), np.zeros((DIM, len(names)))

    def weights(zz: np.ndarray, nn: np.ndarray) -> np.ndarray:
        w = -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2)
        w[np.abs(zz) <= l1] = 0.0
        return w

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(np.flatnonzero(~held)):
            a, v = rows[i]
            w = weights(z[a], n[a])
            g = _softmax(v @ w)
            g[y[i]] -= 1.0
            g = v[:, None] * g[None, :]
            root = np.sqrt(n[a])
            n[a] += g * g
            z[a] += g - (np.sqrt(n[a]) - root) / alpha * w
    w = weights(z, n)
    temperature = 1.0
    if held.any():
        logits = np.stack([v @ w[a] for a, v in (rows[i] for i in np.flatnonzero(held))])
        grid = np.exp(np.linspace(np.log(0.05), np.log(20.0), 241))
        pick = (np.arange(len(logits)), y[held])
        loss = [-np.log(np.maximum(_softmax(logits / t)[pick], 1e-12)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
    table = np.zeros((DIM + 1, len(names)), np.float32)  # the last row is the border
    table[:DIM] = w * idf[:DIM, None] * scale / temperature
    return {"labels": names, "table": table, "temperature": temperature, "nonzero": int((w != 0).sum())}


def train(docs: DataFrame, per_label: int = 1000) -> dict | None:
    """Learn from ``docs`` (doc_id, text, lang): texts with a label and a letter.

    ``per_label`` bounds the sample: so many texts of a label at most (those with the smallest
    hash of their id), which one task fits.  Document frequencies are of all of them.
    """
    usable = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    df = document_frequencies(usable)
    if not df[DIM]:
        return None
    idf = np.log((1.0 + df[DIM]) / (1.0 + df)) + 1.0
    idf[DIM] = 0.0
    ids = usable.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).distinct()
    ids.createOrReplaceTempView("_langid_ids")
    first = "SELECT lang, doc_id, h, row_number() OVER (PARTITION BY lang, pmod(h, 64) ORDER BY h, doc_id) AS r FROM _langid_ids"
    few = docs.sparkSession.sql(  # 64 shares of a label first, so that a common label is not one task's window
        f"SELECT doc_id, h FROM (SELECT doc_id, h, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS r FROM ({first}) WHERE r <= {int(per_label)}) WHERE r <= {int(per_label)}"
    ).distinct()
    sample = usable.join(F.broadcast(few), usable["doc_id"].eqNullSafe(few["doc_id"])).select("h", "text", "lang")  # at most per_label ids a label
    sample = sample.groupBy("h", "lang").agg(F.min("text").alias("text"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "lang"])
        return pd.DataFrame({"model": [pickle.dumps(fit(pdf["text"].tolist(), pdf["lang"].tolist(), idf))]})

    got = sample.groupBy(F.lit(0).alias("one")).applyInPandas(run, "model binary").collect()
    docs.sparkSession.catalog.dropTempView("_langid_ids")
    return pickle.loads(bytes(got[0]["model"])) if got else None


def predict(docs: DataFrame, model: dict | None, keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """``keep`` columns of ``docs`` plus lang_pred and score, for every row.

    ``with_text``: the text is one of the ``keep`` columns.
    """
    spark = docs.sparkSession
    text = [] if with_text else [F.col("text").alias("_text")]
    rows = docs.select(*keep, *text, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_ok"))
    name = "text" if with_text else "_text"
    if model is None:
        return rows.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value["labels"], shared.value["table"]
        for batch in batches:
            ok = np.array(batch.column("_ok").to_pylist(), bool)
            texts = [t if o else "" for t, o in zip(batch.column(name).to_pylist(), ok, strict=True)]
            logits, count = np.zeros((len(texts), len(names))), np.zeros(len(texts))
            for nums, at, idx in _blocks(texts):
                for row in idx:
                    np.add.at(logits, nums, np.add.reduceat(table[row], at, axis=0, dtype=np.float64))
                    np.add.at(count, nums, np.add.reduceat(row != DIM, at, dtype=np.float64))
            p = _softmax(logits / np.maximum(count, 1.0)[:, None])
            best = p.argmax(axis=1)
            label = [names[k] if o else UNKNOWN for k, o in zip(best, ok, strict=True)]
            score = np.where(ok, p[np.arange(len(p)), best], 0.0)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(label, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    return rows.mapInArrow(tidy(run), f"{schema}, lang_pred string, score double")


def learnable(docs: DataFrame) -> DataFrame:
    """Rows of documents that may be learned from: crc32(doc_id as text) mod 4 is not 2 (a null id counts as not 2)."""
    return docs.where(F.coalesce(doc_remainder("doc_id", 4), F.lit(-1)) != 2)


def identify(docs: DataFrame, per_label: int = 1000) -> DataFrame:
    """Train on the learnable documents, then label every document: doc_id, held_out, lang_pred, score."""
    model = train(learnable(docs.select("doc_id", "text", "lang")), per_label)
    held = docs.select("doc_id", "text", F.coalesce(doc_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"))
    return predict(held, model, keep=("doc_id", "held_out"))
