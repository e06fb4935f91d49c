"""Operators against brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from retrospark.llm import adsearch, bitlm, fingerprint, langid, mixing, neardup, pieces, queries, shingles, suffixes, urlrules, warc
from retrospark.llm.components import connected_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).sort_by("doc_id")
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# ---- op1


def test_edited_texts_and_likeness(spark, documents, texts):
    rows = {r["doc_id"]: r for r in fingerprint.fingerprint_with_edits(documents).collect()}
    same = collections.defaultdict(set)
    for i, (doc, text) in enumerate(texts):
        q = len(text) // 4
        edited = text[: len(text) - q] + texts[(i + 1) % len(texts)][1][:q]
        assert rows[doc]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        same[text].add(rows[doc]["fingerprint"])
    assert all(len(v) == 1 for v in same.values()) and len(same) == len({next(iter(v)) for v in same.values()})
    assert np.mean([r["near_edited"] - r["near_next"] for r in rows.values()]) > 0.4


def test_fingerprint_is_homomorphic(spark):
    row = spark.range(1).select(
        fingerprint.lanes(F.lit("b b\na\nc")).alias("all"),
        fingerprint.insert_paragraphs(fingerprint.lanes(F.lit("a\nc")), F.lit("b b")).alias("plus"),
        fingerprint.delete_paragraphs(fingerprint.lanes(F.lit("c\na\nx\nb b")), F.lit("x")).alias("minus"),
        fingerprint.lanes(F.lit("b b\na\na\nc")).alias("twice"),
    ).first()
    assert row["all"] == row["plus"] == row["minus"] != row["twice"]


# ---- op2


def test_search_recall_and_scores(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = adsearch.nearest(e, F.col("vec_id") % 100 == 0, lists=12).collect()
    p = e.toPandas().sort_values("vec_id")
    x, ids = np.stack(p["embedding"].to_numpy()).astype(float), p["vec_id"].to_numpy()
    hits = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert all(abs(d[ids == r["vec_id"]][0] - r["score"]) < 1e-12 for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(best.tolist()))
    assert hits >= 0.9 * 10 * (ids % 100 == 0).sum()


def test_split_lists_give_the_same_neighbours(spark, monkeypatch):
    rows = [(i, [float(i % 7), 1.0]) for i in range(700)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = adsearch.nearest(e, F.col("vec_id") % 100 == 0, lists=3, n_probe=3).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(adsearch, "PART", 50)
    monkeypatch.setattr(adsearch, "PART_QUERIES", 2)
    assert adsearch.nearest(e, F.col("vec_id") % 100 == 0, lists=3, n_probe=3).orderBy("query_id", "rank").collect() == whole


# ---- op3


def test_held_out_accuracy(documents):
    rows = langid.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_block_borders_do_not_change_the_features(monkeypatch):
    words = ["ab", "", "xyz" * 50, "q"]

    def sums():
        out = np.zeros((len(words), langid.DIM + 1))
        for nums, at, idx in langid._blocks(words):
            for row in idx:
                for n, a, z in zip(nums, at, np.append(at[1:], len(row)), strict=True):
                    out[n] += np.bincount(row[a:z], minlength=langid.DIM + 1)
        return out[:, : langid.DIM]

    want = sums()
    monkeypatch.setattr(langid, "BLOCK", 7)
    assert (sums() == want).all() and want.sum() == sum(max(len(w) - k + 1, 0) for w in words for k in langid.ORDERS)


# ---- op4


def test_longest_listed_rule_wins(spark):
    urls = ["http://a.example.org/en/12", "http://example.org/en/2", "http://Example.org/es/", "http://x.com/fr/a", "http://com/de/", "http://xcom/de/", "http://x.net/de/"]
    rows = urlrules.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), min_support=1.0).orderBy("page_id").collect()
    assert [r["rule"] for r in rows] == ["example.org/en/1", "org/", "example.org/es/", "com/fr/", "com/de/", None, None]
    assert [r["verdict"] for r in rows] == ["block", "allow", "block", "allow", "block", "allow", "allow"]


def test_mined_rules_match_brute_force(spark):
    rnd = random.Random(3)
    sets = [sorted(rnd.sample("abcdefgh", rnd.randint(1, 5))) for _ in range(200)]
    labels = ["block" if "a" in s and "b" in s else "allow" for s in sets]
    rules = urlrules.mine_rules(spark.createDataFrame(list(zip(sets, labels, strict=True)), "tokens array<string>, label string"), 0.05, 0.9)
    best = {tuple(r["tokens"]): r for r in urlrules.match_rules(spark.createDataFrame([(s,) for s in sets], "tokens array<string>"), rules).collect()}
    mined = rules.collect()
    for s in sets:
        fit = [(r["confidence"], r["support"], len(r["rule_tokens"]), r["rule_tokens"], r["label"]) for r in mined if set(r["rule_tokens"]) <= set(s)]
        assert (max(fit)[4] if fit else None) == (best[tuple(s)]["label"] if tuple(s) in best else None)
    assert any(r["rule_tokens"] == ["a", "b"] and r["label"] == "block" for r in mined)


# ---- op5


def test_written_warc_files_read_back(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(20)
    made = warc.derivatives(warc.responses(pages))
    warc.write_warc(made, str(tmp_path / "w"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    seen, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(line.split(b": ", 1) for line in data[at:end].split(b"\r\n")[1:])
        body = data[end + 4 : end + 4 + int(head[b"Content-Length"])]
        assert head[b"WARC-Block-Digest"] == b"sha256:" + hashlib.sha256(body).hexdigest().encode()
        seen.append((head[b"WARC-Record-ID"], head[b"WARC-Refers-To"], head[b"WARC-Type"]))
        at = end + 4 + len(body) + 4
    ids = warc.responses(pages).select("response_id").collect()
    assert len(seen) == 40 and len({s[0] for s in seen}) == 40
    assert {s[1] for s in seen} == {f"<{r[0]}>".encode() for r in ids}


def test_ends_are_trimmed_before_the_end_only(spark):
    rows = [("  \n a  b \t\n \n c &nbsp;\n ", "a b\nc"), (" x \u2028 ", "x \u2028"), (" x \u2028", "x \u2028"), ("\n \n", ""), ("", ""), (None, None)]
    made = spark.createDataFrame(rows, "h string, want string").withColumn("got", warc.plain_text(F.col("h")))
    assert all(r["got"] == r["want"] for r in made.collect())


# ---- op6


@pytest.fixture(scope="module")
def model():
    path = queries.piece_model()
    import sentencepiece

    return pieces.PieceTable.from_model(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_encoding_equals_the_library(model, texts):
    table, sp = model
    rnd = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "▁", "\r", ";", "é", "ñ", "😀", "日", "\x00", "\t", "the", "ing", "1", "{", "}", "   ", "\u3000", "ﬁ", "<s>", "&", "\u200b", "на"]
    cases = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    cases += [t for _, t in texts] + ["x" * 3000, " " * 3000, "ab" * 2000, "\n" * 50]
    for c in cases:
        ids = table.encode(c)
        assert ids == sp.encode(c)
        assert table.decode(ids) == sp.decode(ids)


def test_a_word_is_made_once_and_long_words_equal_the_library(model, monkeypatch):
    table, sp = model
    assert table.encode("warm") == sp.encode("warm")
    made, tokens = [], table.tokens
    monkeypatch.setattr(table, "tokens", lambda word: made.append(word) or tokens(word))
    assert table.encode("qzxqv qzxqv qzxqv\nqzxqv") == sp.encode("qzxqv qzxqv qzxqv\nqzxqv")
    assert made.count("▁qzxqv") == made.count("qzxqv") == 1
    rnd = random.Random(4)
    for _ in range(1500):  # many pairs that don't fit: shorter tokens and steps back
        word = "".join(rnd.choice("aeinorsttthélß.,'-(\"1") for _ in range(rnd.randint(1, 60)))
        assert table.encode(word) == sp.encode(word)
    assert table.encode("thention" * 20_000) == sp.encode("thention" * 20_000)


def test_decoding_any_ids_equals_the_library(model):
    table, sp = model
    rnd = random.Random(2)
    for _ in range(500):
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(3, 259), rnd.randrange(3)]) for _ in range(rnd.randint(1, 20))]
        assert table.decode(ids) == sp.decode(ids)


def test_encoded_documents(spark, documents, texts, model):
    got = {r["doc_id"]: r for r in queries.op6_sentencepiece(spark, SF).collect()}
    for doc, text in texts[:80]:
        ids = model[1].encode(text)
        assert got[doc]["n_tokens"] == len(ids) and got[doc]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc]["decoded_sha256"] == hashlib.sha256(model[1].decode(ids).encode()).hexdigest()


# ---- op7


def brute_groups(texts, words, percent):
    hasher = shingles.Hasher(words)
    sets = {i: hasher.shingles(t) for i, t in texts}
    links = []
    full = [(i, set(s.tolist())) for i, s in sets.items() if len(s)]
    for n, (i, a) in enumerate(full):
        links += [(i, j) for j, b in full[:n] if 100 * len(a & b) >= percent * len(a | b)]
    return sets, roots(sets, links)


def planted(seed=5):
    """A base text with many near copies, exact copies and strangers."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(120)]
    out = []
    for i in range(60):
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(len(w))] = word()
        out.append(" ".join(w))
    out += [" ".join(base)] * 10 + [" ".join(word() for _ in range(rnd.randint(1, 60))) for _ in range(30)]
    rnd.shuffle(out)
    return list(enumerate(out, 1))


@pytest.mark.parametrize("block", [neardup.BLOCK, 900])
def test_groups_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    docs = planted()
    sets, want = brute_groups(docs, 3, 85)
    rows = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85, 5, 24).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_groups_of_the_documents(spark, documents, texts):
    _, want = brute_groups(texts, 3, 85)
    assert {r["doc_id"]: r["component_id"] for r in queries.op7_minhash_neardup(spark, SF).collect()} == want


def test_estimate_corrects_chance_collisions():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 62, 4000).astype(np.uint64)
    sets = [np.unique(a[:3000]), np.unique(a[1000:])]  # 2000 of 4000 in common
    low = shingles.minima(sets, 2000)
    for bits in (1, 2, 4, 8):
        sig = shingles.pack(low, bits)
        assert abs(shingles.estimate(sig[:1], sig[1:], bits)[0] - 0.5) < 0.08


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200 + i) for i in range(40)] + [(7, 7)]
    want = roots({n for e in edges for n in e if e[0] != e[1]}, [e for e in edges if e[0] != e[1]])
    rows = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"]: r["component"] for r in rows} == want


# ---- op8


def test_raked_margins_meet_their_targets(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), rnd.choice("xy"), rnd.choice("pq"), rnd.randint(1, 90)) for _ in range(60)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long").groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    targets = {"source": {"a": 0.3, "b": 0.7}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"p": 0.2, "q": 0.8}}
    out = mixing.fit_cells(cells, targets, rounds=15).toPandas()
    for dim, want in targets.items():
        share = out.groupby(dim)["weight"].sum() / out["weight"].sum()
        assert all(abs(share[k] - v) < 1e-6 for k, v in want.items())


# ---- op9


def brute_suffixes(texts, length):
    first, out = {}, {}
    for i, t in texts:
        b = t.encode()
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            first[w] = min(first.get(w, i), i)
    for i, t in texts:
        b = np.frombuffer(t.encode(), np.uint8)
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length].tobytes()] < i:
                gone[k : k + length] = True
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(b[~gone].tobytes()).hexdigest())
    return out


def test_suffix_ranks_are_those_of_bounded_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(60):
        t = rng.integers(1, 4, rng.integers(1, 60))
        s = [tuple(t[i:]) for i in range(len(t))]
        for levels in (1, 2, 4):
            r = suffixes.suffix_ranks(t, levels)
            for i in range(len(t)):
                for j in range(len(t)):
                    assert (s[i] < s[j] if r[i] < r[j] else True) or s[i][: 3**levels] == s[j][: 3**levels]
                    assert r[i] != r[j] or s[i][: 3**levels] == s[j][: 3**levels]


@pytest.mark.parametrize("hot", [False, True])
def test_repeated_bytes_equal_brute_force(spark, documents, texts, monkeypatch, hot):
    if hot:  # every name is dealt by window, small shares
        monkeypatch.setattr(suffixes, "HOT_LEAST", 1)
        monkeypatch.setattr(suffixes, "CHUNK", 20_000)
        monkeypatch.setattr(suffixes, "SHARE", 40_000)
    want = brute_suffixes(texts, 50)
    rows = suffixes.deduplicate(documents.select("doc_id", "text")).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == want


def test_adversarial_repeats(spark):
    rnd = random.Random(9)
    unit = "".join(rnd.choice("ab") for _ in range(70))
    docs = [(1, "a" * 400), (2, "a" * 120 + "b"), (3, unit * 3), (4, "x" + unit + "y"), (5, unit[:49]), (6, "é" * 60), (7, "zé" + "é" * 40), (8, "ab" * 100), (9, "ba" * 60)]
    rows = suffixes.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == brute_suffixes(docs, 50)


def test_piece_that_its_first_document_repeats(spark):
    letters = np.random.default_rng(9).integers(97, 123, 104)
    unit, sep = bytes(letters[:90].tolist()).decode(), bytes(letters[90:].tolist()).decode()
    docs = [(1, "a" * 60 + unit + "b" * 60), (2, "start " + (unit + sep) * 3 + "end"), (3, (unit + sep) * 4), (3, "x" + (unit + sep) * 2)]
    rows = suffixes.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = brute_suffixes(docs[:2], 50)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows if r["doc_id"] < 3} == want
    assert want[2][1:3] == (270, 3)
    for text in (docs[2][1], docs[3][1]):
        alone = brute_suffixes([*docs[:2], (3, text)], 50)[3]
        assert alone in [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows if r["doc_id"] == 3]


def test_kept_text_has_whole_characters(spark):
    docs = [(1, "é" * 60, "x"), (2, "a" + "é" * 40 + "ü" + "b", "clash")]
    rows = suffixes.deduplicate(spark.createDataFrame(docs, "doc_id long, text string, n_removed string"), with_text=True).orderBy("doc_id").collect()
    assert rows[1]["text"] == "aüb" and rows[1]["n_removed"] == 80 and rows[0]["text"] == docs[0][1]


# ---- op10


def test_base_score_and_model(spark, documents, texts):
    rows = {r["doc_id"]: r for r in bitlm.score_documents(documents, common_words=50).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts}
    counts, n_docs = collections.Counter(), 0
    for i, t in texts:
        if not held[i]:
            counts.update(t.encode().lower().split())
            n_docs += 1
    n, v = sum(counts.values()) + n_docs, len(counts) + 1
    for i, t in texts:
        words = t.encode().lower().split()
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words) + math.log10((n_docs + 1) / (n + v + 1))
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(words) + 1, sum(counts[w] > 0 for w in words) + 1, n)
        assert abs(r["base_score"] - base) < 1e-6 and r["score"] < 0
    assert 1.0 < np.mean([r["bits_per_byte"] for r in rows.values()]) < 4.0


def test_bit_probabilities_sum_to_one():
    code, n = np.unique(bitlm._codes([b"abracadabra", b"abrabra"])[0], return_counts=True)
    gram, m = bitlm._merged(code >> np.uint64(24), n)
    tables = bitlm._tables(bitlm._low_tables(gram, m), code, n)
    history = np.frombuffer(b"brac"[::-1] + b"a", np.uint8)  # any context: the 256 next bytes share all probability
    code = np.zeros(256, np.uint64)
    for j, b in enumerate([None, *history.tolist()]):
        code |= (np.arange(256, dtype=np.uint64) if b is None else np.uint64(b)) << np.uint64(8 * (5 - j))
    assert abs((2.0 ** -bitlm._costs(bitlm.Mixer(), tables, code)).sum() - 1) < 1e-6


def brute_bits(rows, model, weights):
    """Cost of each (text, held out) by dictionaries over bytes, with a fitted model's weights and map."""
    texts = [(b"\0" * 24 + t.encode().lower() + b"\xff", out) for t, out in rows]
    mixer = bitlm.Mixer()
    vars(mixer).update(model["mixer"])
    seen, pages, contexts = collections.Counter(), collections.Counter(), collections.Counter()

    def steps(t, at):
        return [((t[at] >> (i + 1)) | (1 << (7 - i)), (t[at] >> i) & 1, i) for i in range(7, -1, -1)]

    def passages(t):
        marks = [i for i in range(48, len(t)) if int(bitlm.mix64(np.array([int.from_bytes(t[i - 8 : i][::-1], "little")], np.uint64))[0]) % bitlm.EVERY == 0]
        return [(a, z, t[a - 24 : a], t[a:z]) for a, z in zip(marks, [*marks[1:], len(t)])]

    for t, out in texts:
        if not out:
            for at in range(24, len(t)):
                for node, bit, _ in steps(t, at):
                    seen.update((t[at - o : at], node, bit) for o in bitlm.ORDERS)
            pages.update((context, page) for _, _, context, page in passages(t))
            contexts.update(context for _, _, context, _ in passages(t))
    costs = []
    for t, out in texts:
        each = [0.0] * len(t)
        for at in range(24, len(t)):
            word = t[max(24, at - 5) : at].replace(b"\n", b" ").replace(b"\t", b" ").rpartition(b" ")[2]
            for node, bit, i in steps(t, at):
                n = [(seen[t[at - o : at], node, 0], seen[t[at - o : at], node, 1]) for o in bitlm.ORDERS]
                longest = max((k + 1 for k, c in enumerate(n) if sum(c)), default=0)
                total = sum(n[longest - 1]) if longest else 0
                conf = (total > 0) + (total > 2) + (total > 12)
                x = np.array([[math.log((c[1] + 0.4) / (c[0] + 0.4)) for c in n]])
                p = mixer.predict(x, np.array([longest * bitlm.PLACES + len(word)]), np.array([conf]), i, np.array([node]))[0][0]
                each[at] -= math.log2(p if bit else 1 - p)
        cost = sum(each)
        for a, z, context, page in passages(t):
            c, total = pages[context, page] - (not out), contexts[context] - (not out)
            if total > 0:
                w, plain = weights[(total > 0) + (total > 1) + (total > 3) + (total > 15)], sum(each[a:z])
                cost += -math.log2(w * c / total + (1 - w) * 2.0**-plain) - plain
        costs.append(cost)
    return costs


def test_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bitlm, "SHARE", 2500)
    monkeypatch.setattr(bitlm, "ASK_BYTES", 2500)
    kept = {}
    train, memory_weights = bitlm.train, bitlm.memory_weights
    monkeypatch.setattr(bitlm, "train", lambda asked: kept.setdefault("model", train(asked)))
    monkeypatch.setattr(bitlm, "memory_weights", lambda known: kept.setdefault("weights", memory_weights(known)))
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 7))) for _ in range(40)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n)) + rnd.choice(["", ".\n", "\tZ"])
    shared = text(30)
    texts = [text(rnd.randint(0, 60)) for _ in range(24)] + [text(5) + shared + text(5) for _ in range(6)]
    texts += [texts[3], texts[5], "", shared, shared]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r["doc_id"]: r for r in bitlm.score_documents(df).collect()}
    want = brute_bits([(t, rows[i]["held_out"]) for i, t in enumerate(texts)], kept["model"], kept["weights"])
    for i, bits in enumerate(want):
        assert abs(rows[i]["score"] + bits * math.log10(2)) < 1e-3 + 1e-5 * bits, i


def test_repeated_texts_score_apart_from_single_ones(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(3000)]
    texts = [" ".join(rnd.choice(words) for _ in range(120)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts + texts[:10])), "doc_id long, text string")
    bits = {r["doc_id"]: r["bits_per_byte"] for r in bitlm.score_documents(df).collect()}
    twice = {i for i in range(10) if zlib.crc32(str(60 + i).encode()) % 7 != 2}  # the copy is a training text
    assert max(bits[i] for i in twice) < 0.7 * min(bits[i] for i in range(10, 60))


def test_words_are_counted_by_arrow(spark):
    texts = ["  A\x0bb\x0cC\rd e\u0130 \x85x\x1cy", "", None, "\t\n", "Ab ab\nAB", "\x00 a"]
    counts = bitlm.word_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    want = collections.Counter(w for t in texts for w in (t or "").encode().lower().split())
    assert {bytes(r["word"]): r["c"] for r in counts.collect()} == dict(want)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan  # no Python object per word


def test_windows_are_the_bytes_before_each_target():
    texts = [b"", b"ab", b"", b"hello, world", b""]
    code, starts = bitlm._codes(texts)
    want = [int.from_bytes((bytes(5) + t + b"\xff")[i : i + 6], "little") for t in texts for i in range(len(t) + 1)]
    assert code.tolist() == want and starts.tolist() == [0, 1, 4, 5, 18]


def test_window_counts_are_exact():
    texts = [np.random.default_rng(i).integers(0, 256, 120_000, np.uint8).tobytes() for i in range(4)] + [b"ab" * 200_000]
    code, n = bitlm._merged(*(np.concatenate(c) for c in zip(*(np.unique(c, return_counts=True) for _, c, _ in bitlm._groups(texts)), strict=True)))
    gram, m = bitlm._merged(code >> np.uint64(24), n)
    tables = bitlm._tables(bitlm._low_tables(gram, m), code, n)
    seen = collections.Counter()  # a window's first bit: target above 127 or not, after each context
    for t in texts:
        full = b"\0" * 5 + t + b"\xff"
        for at in range(5, len(full)):
            for o in bitlm.ORDERS:
                seen[full[at - o : at], full[at] >> 7] += 1
    some = np.concatenate([code[:: len(code) // 500], code[n > 65535]])
    _, _, _, x, _, _ = next(bitlm._bits(tables, some, False))
    for w, row in zip(some.tolist(), x, strict=True):
        context = bytes((w >> (8 * j)) & 255 for j in range(5))
        want = [math.log((seen[context[5 - o :], 1] + 0.4) / (seen[context[5 - o :], 0] + 0.4)) for o in bitlm.ORDERS]
        assert np.allclose(row, want)
    every = (np.arange(256, dtype=np.uint64) << np.uint64(40)) | (some[0] & np.uint64((1 << 40) - 1))
    assert abs((2.0 ** -bitlm._costs(bitlm.Mixer(), tables, every)).sum() - 1) < 1e-6


def test_every_training_text_has_a_part_in_the_mixer(spark, monkeypatch):
    monkeypatch.setattr(bitlm, "SHARE", 4000)
    rnd = random.Random(3)
    docs = [(i, "".join(rnd.choice("abcd") for _ in range(100))) for i in range(600)]
    docs = [(i, t) for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2]

    def fitted(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("doc_id % 3 as share", "text", "false as held_out")
        return bitlm.train(bitlm.ask(df, 60_000))

    model = fitted(docs)
    cells = model["mixer"]["apm"].sum() - bitlm.Mixer().apm.sum()
    assert abs(cells - 8 * sum(len(t) + 1 for _, t in docs)) < 1e-3
    assert not np.array_equal(model["mixer"]["weights"], bitlm.Mixer().weights)
    for i in (0, 300, len(docs) - 1):  # no text is without effect
        other = fitted([(d, "zyxw " * 20 if k == i else t) for k, (d, t) in enumerate(docs)])
        assert not np.allclose(other["mixer"]["weights"], model["mixer"]["weights"], atol=1e-9)


def test_windows_are_looked_up_by_hash_and_passages_take_few_bytes():
    rnd = np.random.default_rng(3)
    for n in (1, 7, 5000):
        known = np.unique(rnd.integers(0, 1 << 48, n, dtype=np.uint64))
        rnd.shuffle(known)
        cost = rnd.random(len(known)).astype(np.float32)
        of = bitlm._lookup(known, cost)
        at = rnd.integers(0, len(known), 4 * n)
        assert (of(known[at]) == cost[at]).all() and (of(known) == cost).all()
    texts = [bytes(rnd.integers(97, 123, 5000).astype(np.uint8)) for _ in range(80)]
    _, _, key, passage = (np.concatenate(c) for c in zip(*(bitlm._passages(code, starts) for _, code, starts in bitlm._groups(texts)), strict=True))
    one = np.ones(len(key), np.int64)
    kept = bitlm._memories([(key, passage, one, one - 1)])
    blob = bitlm._planes(*kept)
    assert len(key) > 8000 and len(blob) < 13 * len(key)
    assert all((a == b).all() for a, b in zip(bitlm._from_planes(blob, "<u8", "<u8", "<i8", "<i8"), kept, strict=True))
