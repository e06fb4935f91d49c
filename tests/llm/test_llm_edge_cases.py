"""Every registered query on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

from retrospark.llm import queries as Q

BIG = (1 << 60) + 1
DOCS = [
    (1, None, None, None, 0),
    (2, "", "en", "src0", 0),
    (3, "a", None, "x", 1),
    (4, "Hello world. This is it.\nx y z", "en", None, 30),
    (4, "Hello world. This is it.\nx y z", "en", None, 30),
    (None, "Null id text. 12", None, None, 16),
    (7, "été " * 60000, "fr", "src1", 240000),
    (8, "日本 " * 30, "ja", "src1", 90),
    (9, "!!! 123", "en", "src2", 7),
    (BIG, "big id text of words and words and words again and words again", "en", "src2", 62),
]
VECTORS = [(0, [1.0, 2.0]), (100, None), (1, [0.0, 0.0]), (2, [1.0, float("nan")]), (3, [1.0, 2.0]), (3, [1.0, 2.0]), (200, [3.0, 4.0]), (None, [1.0, 1.0]), (5, [1.0, None]), (6, [1.0])]
PAGES = [
    (0, None, None),
    (1, "nourl", "<p>a"),
    (2, "http://Example.ORG/es/x?y#z", '<html lang="en"><title>T &amp; x</title><a href="/q">l</a>'),
    (2, "http://Example.ORG/es/x?y#z", '<html lang="en"><title>T &amp; x</title><a href="/q">l</a>'),
    (3, "https://a.b.com", "y"),
    (4, "x://org/", ""),
]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("component_id", "kept", "tokens", "n_removed", "text_hash", "spans", "lang_pred", "part", "node", "score"):
        docs = docs.withColumn(name, F.lit("clash"))
    tables = {
        "documents": docs,
        "embeddings": spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>"),
        "pages": spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("title", F.lit("clash")),
    }
    tables["conversations"] = spark.createDataFrame([(1, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "user", "b"), (100, 1, "user", "")], "conv_id long, turn long, role string, text string").withColumn("id", F.lit("clash"))
    full, empty = (str(tmp_path_factory.mktemp(n)) for n in ("full", "empty"))
    for name, df in tables.items():
        df.coalesce(2).write.parquet(f"{full}/{name}.parquet")
        df.limit(0).write.parquet(f"{empty}/{name}.parquet")
    return full, empty


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_empty_tables_give_no_rows(spark, folders, name):
    assert Q.QUERIES[name](spark, folders[1]).collect() == []


@pytest.mark.parametrize("name", ["op1_document_fingerprints", "op3_language_id", "op6_sentencepiece", "op7_minhash_neardup", "op8_mixing", "op9_suffix_array_dedup", "op10_lm_scoring", "op12_line_rules", "op13_cross_tokenizer_alignment"])
def test_one_row_for_every_document(spark, folders, name):
    rows = Q.QUERIES[name](spark, folders[0]).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((d[0] is None, d[0] or 0) for d in DOCS)
    got = {r["doc_id"]: r for r in rows}
    if name.startswith("op1_"):
        assert got[1]["fingerprint"] == got[2]["fingerprint"] and got[1]["near_edited"] == 1.0
        assert got[7]["n_chars"] == 240000 and got[1]["n_chars"] == 0
    if name.startswith("op3_"):
        assert [got[i]["lang_pred"] for i in (1, 2, 9)] == ["und"] * 3 and got[8]["lang_pred"] == "ja" and got[9]["score"] == 0.0
    if name.startswith("op6_"):
        assert got[1]["n_tokens"] == 0 and got[2]["ids_sha256"] == got[1]["decoded_sha256"]
    if name.startswith("op7_"):
        assert all(r["kept"] for r in rows) and got[1]["n_shingles"] == 0 and got[None]["component_id"] is None
    if name.startswith("op9_"):
        assert all(r["n_removed"] == 0 for r in rows) and got[7]["n_bytes"] == 360000
    if name.startswith("op12_"):
        assert got[1]["n_words"] == 0 and got[1]["base_failed"] and not got[1]["kept"] and got[7]["n_words"] == 60000
    if name.startswith("op13_"):
        assert (got[1]["n_a"], got[1]["groups_sha256"]) == (0, "") and got[2]["n_links"] == 0 and got[4]["n_groups"] > 0 and got[8]["n_b"] > 30
    if name.startswith("op10_"):
        assert got[1]["n_tokens"] == 1 and got[1]["base_score"] == got[2]["base_score"]


def test_urls_without_host_and_repeated_pages(spark, folders):
    rows = Q.op4_url_filter(spark, folders[0]).collect()
    assert len(rows) == len(PAGES)
    got = {r["page_id"]: r for r in rows}
    assert (got[0]["host"], got[0]["path"], got[0]["rule"], got[0]["verdict"]) == ("", "", None, "allow")
    assert (got[1]["host"], got[1]["path"]) == ("", "")
    assert (got[2]["host"], got[2]["path"], got[2]["rule"], got[2]["verdict"]) == ("example.org", "/es/x", "example.org/es/", "block")
    assert got[4]["rule"] == "org/" and got[3]["path"] == ""


def test_warc_records_of_empty_pages(spark, folders):
    rows = Q.op5_warc_derivatives(spark, folders[0]).collect()
    assert len(rows) == 2 * len(PAGES)
    none = [r for r in rows if r["page_id"] == 0 and r["record_type"] == "conversion"][0]
    assert none["content_length"] == 0 and none["target_uri"] is None and none["source_headers"].endswith("Content-Length: 0")


def test_vectors_that_take_no_part(spark, folders):
    rows = [tuple(r) for r in Q.op2_adaptive_scan_search(spark, folders[0]).orderBy("query_id", "rank").collect()]
    far = 8.0**0.5
    assert rows == [(0, 1, 3, 0.0), (0, 2, 3, 0.0), (0, 3, 200, far), (200, 1, 0, far), (200, 2, 3, far), (200, 3, 3, far)]


def test_trie_of_edge_cases(spark, folders):
    rows = {(r["depth"], r["conv_id"]): r for r in Q.op11_conversation_trie(spark, folders[0]).collect()}
    assert rows[0, 1]["n_convs"] == 2 and rows[0, 1]["parent_conv_id"] is None and all(r["conv_id"] in (1, 100) for r in rows.values())
