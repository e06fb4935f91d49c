"""Pipeline near-dedup on null, repeated and reused ids; search with every list split."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as C
from retrospark.llm import adsearch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    """One row of each group of texts linked by 5-word shingle sets with a similarity of 0.8 or more."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    best = {}
    for (doc, text), g in zip(rows, group, strict=True):
        key = (doc is None, doc or 0)
        if g not in best or key < best[g][0]:
            best[g] = (key, doc)
    return group, best


def test_near_dedup_loses_no_text(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(4))
    base = {k: [word() for _ in range(60)] for k in "ABCDE"}
    near = lambda k, i: " ".join(w if n != i else "zzzz" for n, w in enumerate(base[k]))
    rows = [(1, near("A", 99)), (7, near("A", 99)), (7, near("B", 99)), (9, near("B", 99))]  # an id with two texts
    rows += [(None, near("A", 99)), (None, near("C", 99)), (None, near("C", 3)), (4, near("D", 99)), (4, near("D", 99)), (4, near("D", 99))]
    rows += [(11, near("D", 7)), (12, near("E", 99)), (13, near("E", 1)), (13, near("E", 1)), (20, None), (21, ""), (22, ""), (None, None), (23, "two words"), (24, "two words")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA).withColumn("row", F.lit("clash")).withColumn("component_id", F.lit("clash"))
    out = C.near_dedup(spark, docs, "")
    assert out.columns == C.COLUMNS
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect())
    group, best = brute(rows)
    assert got == sorted(v[0] for v in best.values())
    texts = {r["text"] for r in out.collect()}
    for k in "ABCDE":
        assert sum(t in texts for t in {near(k, i) for i in (99, 1, 3, 7)}) == 1
    assert C.near_dedup(spark, docs.limit(0), "").collect() == []


def test_every_list_split(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 8))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").withColumn("list", F.lit("clash")).withColumn("v", F.lit("clash"))
    monkeypatch.setattr(adsearch, "PART", 1)
    monkeypatch.setattr(adsearch, "PART_QUERIES", 1)
    got = adsearch.nearest(rows, F.col("vec_id") % 100 == 0, k=3, lists=300, n_probe=300)
    want = {}
    for q in range(0, 900, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want[q] = np.lexsort((np.arange(900), d))[:3].tolist()
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert found == want


def test_mixture_reaches_its_targets(spark):
    """Sources that are scarce against their targets lower the share kept, not their part of the mixture."""
    from retrospark.llm import mixing
    from retrospark.llm.queries import MIX_TARGETS

    rnd = random.Random(3)
    rows = []
    for i in range(30_000):
        source, lang = rnd.choice(["src0", "src1", "src1", "src1", "src2", "zzz"]), rnd.choice(["en", "en", "de", "fr"])
        rows.append((i, "w " * rnd.choice([50, 200, 900]), lang, source))
    rows += [(7, None, None, None), (None, "", "en", "src0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("_p", F.lit("clash")).withColumn("__tokens", F.lit("clash")).withColumn("kept", F.lit("clash"))
    targets = {"source": {"src0": 0.5, "src1": 0.3, "src2": 0.2}, "lang": {"en": 0.4, "de": 0.35, "fr": 0.25}, "topic": {"note": 0.02, "article": 0.2, "report": 0.78}}
    mixed = mixing.mix(docs, targets, keep=0.9, rounds=40).cache()
    assert mixed.count() == len(rows) and {"_p", "__tokens"} <= set(mixed.columns)
    for r in mixing.margins(mixed, targets).collect():
        assert abs(r["expected"] - r["target"]) < 8e-3, r  # where cells are full, the rest is reported, not hidden
        assert abs(r["realised"] - r["target"]) < 0.03, r  # sampling error
    top = mixed.agg(F.max("probability"), F.min("keep_share")).first()
    assert top[0] <= 1.0 and 0 < top[1] < 0.9
    sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for r in mixing.margins(mixing.mix(sf, MIX_TARGETS, keep=0.5, rounds=10), MIX_TARGETS).collect():
        assert abs(r["expected"] - r["target"]) < 2e-3, r
