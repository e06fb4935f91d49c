"""The conversation trie against a dictionary of prefixes."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from retrospark.llm import queries, turntrie

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    convs = {c: [(r, t) for _, r, t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    members = collections.defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    out = []
    for c in [*range(0, 60), *range(100, 130), *range(250, 270), 10_000_000_000]:
        for i in range(rnd.choice([1, 2, 3, 7, 8, 9, 30])):
            out.append((c, i, "user" if i % 2 == 0 else "assistant", rnd.choice(["hi", "hi", "yes", "né", "🙂 ok"]) if i < 6 else "go on"))
    out += [(100, i, "user", "long") for i in range(100, 700)]  # one conversation with a third of all rows
    out += [(3, None, "user", "first"), (3, None, None, None), (4, 2, "user", "tie"), (4, 2, "assistant", "tie"), (4, 2, "user", "tie"), (None, 0, "user", "nobody")]
    out += [(5, 0, "user", "x" * 100_000), (6, 0, "", "userhi"), (7, 0, "user", "hi"), (300, None, None, None)]
    return out


@pytest.mark.parametrize("height", [1 << 20, 32, 4, 2])
def test_nodes_equal_brute_force(spark, rows, height):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit("clash")).withColumn("depth", F.lit("clash"))
    assert got(turntrie.conversation_trie(turns.repartition(5), height)) == brute(rows)


def test_query_on_the_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    assert got(queries.op11_conversation_trie(spark, SF)) == brute([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_hot_nodes_and_many_ends(spark, monkeypatch):
    monkeypatch.setattr(turntrie, "ID_BLOCK", 16)
    rows = [(c * 100, i, "user", "same") for c in range(1500) for i in range(2)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(turntrie.conversation_trie(turns)) == brute(rows)
    rows = [(c * 100, 0, "user", f"t{c}") for c in range(1500)]  # a root with many children
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(turntrie.conversation_trie(turns)) == brute(rows)


def test_no_conversations_no_root(spark):
    assert turntrie.conversation_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
