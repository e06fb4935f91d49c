"""The corpus pipeline, stage by stage, on documents with planted cases."""

import random

import pytest

import corpus_pipeline as C
from retrospark.llm import queries

SF = "/root/testdata/sf0.001"


def test_stage_list():
    assert [n for n, _ in C.STAGES] == ["language_id", "near_dedup", "suffix_dedup", "mix_sources", "tokenize"]
    assert all(n.startswith("op") for n in queries.QUERIES) and set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice(["the", "and", "ing", "er", "tion", "ou", "re"]) for _ in range(rnd.randint(1, 3)))
    passage = " ".join(word() for _ in range(60))
    base = [word() for _ in range(200)]
    near = list(base)
    near[50] = "changed"
    extra = [(10_000, "12 34 !!", "en", "src1", 8), (10_001, None, None, None, 0)]
    extra += [(10_010, " ".join(base), "en", "src1", 0), (10_011, " ".join(near), "en", "src2", 0)]
    extra += [(10_020 + i, " ".join(word() for _ in range(90)) + "\n" + passage + "\n" + " ".join(word() for _ in range(90)), "en", "src3", 0) for i in range(3)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    out, first = {}, docs
    for name, stage in C.STAGES:
        docs = stage(spark, docs, SF).cache()
        out[name] = docs
    return first, out, passage


def test_language_stage_rejects_texts_without_letters(stages):
    first, out, _ = stages
    kept = {r[0] for r in out["language_id"].select("doc_id").collect()}
    every = {r[0] for r in first.select("doc_id").collect()}
    assert 10_000 not in kept and 10_001 not in kept and len(kept) >= len(every) - 4


def test_near_copies_go_and_the_smallest_id_stays(stages):
    kept = {r[0] for r in stages[1]["near_dedup"].select("doc_id").collect()}
    assert 10_010 in kept and 10_011 not in kept


def test_passage_stays_in_its_first_document_only(stages):
    text = {r["doc_id"]: r["text"] for r in stages[1]["suffix_dedup"].where("doc_id >= 10020").collect()}
    assert stages[2] in text[10_020] and all(stages[2] not in text[i] and len(text[i]) > 100 for i in (10_021, 10_022))


def test_columns_and_row_counts(stages):
    _, out, _ = stages
    names = [n for n, _ in C.STAGES]
    assert all(out[n].columns == C.COLUMNS for n in names[:-1])
    counts = [out[n].count() for n in names]
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] > 0


def test_run_registered_as_query(spark):
    import __spark_entry__ as E

    assert E.queries()["pipeline"](spark, SF).count() > 0
