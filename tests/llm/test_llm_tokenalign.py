"""Cross-tokenizer alignment against the tokenizers' own output on whole texts."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from retrospark.llm import queries, tokenalign
from retrospark.llm.common import join_split

SF = "/root/testdata/sf0.001"


def brute(rows):
    """The contract, token by token, for (doc_id, text) rows."""
    a_tok = Tokenizer.from_file(queries.byte_bpe())
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    chars = {v: k for k, v in _bytes_to_unicode().items()}

    def b_bytes(i):
        p = b_tok.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode()

    done, counts = {}, collections.Counter()
    for _, text in rows:
        if text and text not in done:
            a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
            ab, bb = [bytes(chars[c] for c in a_tok.id_to_token(i)) for i in a], [b_bytes(i) for i in b]
            whole = (" " + text).encode()
            if b"".join(ab) != whole or b"".join(bb) != whole:
                done[text] = None
                continue
            a_end, b_end = ends(ab), ends(bb)
            common = sorted(set(a_end) & set(b_end))
            links, i = [], 0
            for j in range(len(b)):  # two pointers over the ends
                while a_end[i] <= (b_end[j] - len(bb[j])):
                    i += 1
                k = i
                while k < len(a) and a_end[k] - len(ab[k]) < b_end[j]:
                    links.append((a[k], b[j]))
                    k += 1
            groups, i, j = [], 0, 0
            for e in common:
                x, y = [], []
                while i < len(a) and a_end[i] <= e:
                    x.append(a[i])
                    i += 1
                while j < len(b) and b_end[j] <= e:
                    y.append(b[j])
                    j += 1
                groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
            done[text] = (len(a), len(b), groups, links)
        if text and done[text]:
            counts.update(set(done[text][3]))
    best = collections.Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for doc, text in rows:
        r = done.get(text) if text else None
        if not r:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        out.append((doc, r[0], r[1], len(r[2]), len(r[3]), sum(counts[x] == best[x[0]] for x in r[3]), sum(counts[x] for x in r[3]), hashlib.sha256(";".join(r[2]).encode()).hexdigest()))
    return out


def ends(tokens):
    out, at = [], 0
    for t in tokens:
        at += len(t)
        out.append(at)
    return out


def _bytes_to_unicode():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(extra)}


def got(df):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def fuzzed():
    rnd = random.Random(11)
    parts = ["the", "Straße", " ", "  ", "\n", "\n\n", " \n", "\n ", "\t", "\r\n", "　", " ", "日本語", "12345", "don't", "'s", "<|endoftext|>", "</s>", "<0x41>", "▁", "é", "é", "🙂", "...", "\x00", "x" * 40, "​", " ", "ﬁ", "٣"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 14))) for _ in range(1500)] + ["a" * 20000, "ab " * 30000, " ", "\n", "  ", " x", "x "]


def test_measures_equal_brute_force(spark, fuzzed):
    rows = [(i, t) for i, t in enumerate(fuzzed)] + [(5, fuzzed[5]), (None, fuzzed[6]), (-1, None), (-2, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("n_docs", F.lit("clash"))
    want = sorted(brute(rows), key=str)
    paths = queries.byte_bpe(), queries.piece_model()
    assert got(tokenalign.align_documents(docs, *paths)) == want
    for few in (0, 50):  # with few or no pairs broadcast, the others meet by shuffle
        assert got(tokenalign.align_documents(docs, *paths, common_pairs=few)) == want


def test_query_equals_brute_force_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.op13_cross_tokenizer_alignment(spark, SF)) == sorted(brute(rows), key=str)


def test_forgetting_chunks_changes_nothing(monkeypatch, fuzzed):
    with open(queries.byte_bpe(), "rb") as a, open(queries.piece_model(), "rb") as b:
        files = a.read(), b.read()
    texts = [t for t in fuzzed if t]
    whole = tokenalign.Aligner(*files).align(texts)
    monkeypatch.setattr(tokenalign, "MEMO_CHUNKS", 40)
    small = tokenalign.Aligner(*files)
    for lo in range(0, len(texts), 20):
        for x, y in zip(small.align(texts[lo : lo + 20]), whole[lo : lo + 20], strict=True):
            assert x[:5] == y[:5] and (x[5] == y[5]).all() and (x[6] == y[6]).all()


def test_packing_is_lossless():
    import numpy as np

    for codes in ([], [0], [3, 900, 1 << 40], list(range(1000))):
        links = np.arange(1, len(codes) + 1)
        pairs, n = tokenalign._unpack(tokenalign._pack(np.array(codes, np.int64), links))
        assert pairs.tolist() == codes and n.tolist() == links.tolist()


def test_split_join_keeps_every_row(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 7}") for i in range(4000)] + [(-1, "none")], "id long, k string")
    facts = rows.where("k <> 'none'").groupBy("k").agg(F.count("*").alias("n"))
    out = join_split(rows, facts, "k", "n", most=3).collect()
    assert len(out) == 4001 and {r["k"]: r["n"] for r in out} == {r["k"]: r["n"] for r in facts.collect()} | {"none": None}


def test_path_of_the_tokenizers_is_a_parameter():
    assert queries.byte_bpe() == public_tokenizers.path("byte_bpe_50k.json")
