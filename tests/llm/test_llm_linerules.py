"""Quality rules against a plain version of the same definitions."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from retrospark.llm import linerules, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, most_docs=linerules.MOST_DOCS, most_share=linerules.MOST_SHARE):
    """(doc_id, five measures, base_failed, n_left, kept) and the text without removed lines, for (doc_id, text, host) rows."""
    held, texts = collections.defaultdict(set), collections.defaultdict(set)
    norm = lambda line: " ".join(WORD.findall(line.translate(UPPER)))
    for _, text, host in rows:
        texts[host or ""].add(text or "")
        for line in (text or "").split("\n"):
            if WORD.search(line):
                held[host or "", norm(line)].add(text)
    over = {k for k, v in held.items() if len(v) > most_docs and len(v) > len(texts[k[0]]) * most_share}
    out = []
    for doc, text, host in rows:
        t = text or ""
        words = WORD.findall(t)
        windows = collections.defaultdict(list)
        for i in range(len(words) - 4):
            windows[tuple(words[i : i + 5])].append(i)
        repeat = {j for v in windows.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        base = len(words) < 10 or 100 * len(repeat) > 20 * len(words)
        left = sum(len(WORD.findall(x)) for x in lines if (host or "", norm(x)) not in over)
        kept = not base and left >= 10 and left >= len(words) * 0.5
        clean = None if text is None else "\n".join(x for x in t.split("\n") if not WORD.search(x) or (host or "", norm(x)) not in over)
        out.append((doc, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat), base, left, kept, clean))
    return out


def rows_of(df, *more):
    names = ["doc_id", *linerules.MEASURES, "base_failed", "n_left", "kept", *more]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    word = lambda: rnd.choice(["a", "Bé", "#x", "c|d", "日本", "🙂", "of", "THE"]) + rnd.choice(["", "1", "2", "x"])
    line = lambda n: " ".join(word() for _ in range(n))
    menu, spaced = "Home About  Contact us", "home\tabout CONTACT us "
    out = []
    for i in range(160):
        own = [line(rnd.randint(1, 12)) for _ in range(rnd.randint(1, 9))]
        out.append((i, "\n".join([rnd.choice([menu, spaced]), *own] if i % 2 else own), rnd.choice(["h1", "h1", "h2"])))
    out += [(200 + i, "one page that is copied over and over again by many people " + line(0), "h1") for i in range(60)]  # copies count once
    out += [(300 + i, "the same short footer of this site here\n" * 3 + f"page {i}", "h1") for i in range(40)]  # depleted
    out += [(400, None, "h1"), (401, "", None), (402, "\n \n\x0b", ""), (403, "word " * 50000, "h3"), (404, "　 not a space 　", None), (None, line(30), "h2"), (5, out[5][1], out[5][2])]
    out += [(405, "a b c d e f g h i j k a b c", "h4"), (406, "d e x y", "h4")]  # a window across documents counts nowhere
    return out


@pytest.mark.parametrize("limits", [(20, 0.002), (5, 0.1), (0, 0.0)])
def test_measures_and_verdicts(spark, rows, limits):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    docs = docs.withColumn("kept", F.lit("clash")).withColumn("row", F.lit("clash")).withColumn("_host", F.lit("clash"))
    want = sorted(brute(rows, *limits), key=str)
    out = linerules.judge(docs, with_text=True, most_docs=limits[0], most_share=limits[1])
    assert rows_of(out, "text") == want
    if limits[0] == 20:
        kept = {r[0]: r[8] for r in want}
        assert all(kept[i] for i in range(200, 260)) and not any(kept[i] for i in range(300, 340))


def test_slices_change_nothing(rows):
    texts, hosts = [r[1] for r in rows], [r[2] or "" for r in rows]
    whole = linerules.profile(hosts, texts)
    for lo in range(0, len(rows), 7):
        part = linerules.profile(hosts[lo : lo + 7], texts[lo : lo + 7])
        assert all(part[k] == whole[k][lo : lo + 7] for k in whole)


def test_common_lines_by_broadcast_and_by_shuffle(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    split = linerules.join_split
    monkeypatch.setattr(linerules, "join_split", lambda *a: split(*a, most=10**9))
    assert rows_of(linerules.judge(docs)) == sorted((r[:-1] for r in brute(rows)), key=str)


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    assert rows_of(queries.op12_line_rules(spark, sf)) == sorted((r[:-1] for r in brute(docs)), key=str)
