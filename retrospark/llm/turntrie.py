"""Prefix trie of conversations by a depth-band rollup.

A node is a distinct sequence of first turns; conversations that start with it are its members.
Sums over subtrees are wanted for nodes at any depth, without one round a level and without a row
for every (node, ancestor) pair.

1. *Positions.*  Turns are dealt by ranges of (conversation, turn); a turn's position is its place in
   its range plus the turns of the conversation in earlier ranges, so that a very long
   conversation is never one task's sort.
2. *Bands.*  Each conversation is cut into bands of ``height`` positions.  Digests are chained within
   a band; the chained digests of whole bands are again sequences (shorter by the factor
   ``height``), whose chains tell what precedes a band (its *carry*).  So a node's id is a 128-bit
   digest of its whole prefix, found in as many rounds as the depth has digits to base ``height``.
3. *Nodes* are grouped by id; each knows its ancestors within its band only (``height`` at most).
4. *Rollup.*  What hangs below a band's last node is a set of nodes with the same carry.  Their values
   are added up by carry and become the values of the shorter trie of bands, which is rolled up
   alike; its completed totals are added to the last nodes of the bands above, and then every node
   explodes to its ancestors within its band, once.
5. *Ends.*  The ids of the conversations that end at a node are sorted in blocks of ``ID_BLOCK`` ids,
   and hashed as a stream of blocks, however many there are.

Defined cases: a null turn comes first; turns of equal number are ordered by role, then text, equal
rows count as turns of their own; null role or text is empty; rows with null conv_id take no part;
a conversation whose rebuilt sequence has no turns is a member of the root only; an empty table
has no nodes, not even a root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrospark.llm.common import join_split, materialize, ship, tidy

ship(__name__)

HEIGHT = 32
#: Ids that are sorted as one block.
ID_BLOCK = 4096
#: Conversations are rebuilt from less than so many first turns of the conversation that opens their hundred.
LEAD_MOD, LEAD_GROUP = 6, 100
VALUES = ["n_leaves", "saved_tokens"]


def _short(data: Column) -> Column:
    """First 128 bits of SHA-256."""
    return F.unhex(F.substring(F.sha2(data, 256), 1, 32))


def turn_digest(role: Column, text: Column) -> Column:
    return _short(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """member, pos, digest, chars, last: conversations whose lead-in is replaced; position 0 is the root."""
    order = ["conv_id", "turn", "role", "text", "tie"]
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    digest = turn_digest(F.col("role"), F.col("text")).alias("digest")
    stored = materialize(
        dealt.select("conv_id", digest, F.length("text").cast("bigint").alias("chars"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    )
    # a conversation's run of turns in each range
    runs = materialize(stored.groupBy("conv_id", "part").agg(F.count("*").alias("n_run"), F.min("at").alias("first")))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % LEAD_MOD
    convs = runs.groupBy("conv_id").agg(F.sum("n_run").alias("n")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % LEAD_GROUP)
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    lead = F.least("h", F.coalesce("n_base", F.lit(0)))
    # a hundred has a bounded number of conversations, so no base is a hot key
    convs = convs.join(bases, "base", "left").select("conv_id", "base", "h", lead.alias("lead"), (lead + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size"))
    convs = materialize(convs)
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # runs, not turns
    before = F.coalesce(F.sum("n_run").over(earlier), F.lit(0))
    placed = runs.withColumn("skip", before - F.col("first")).join(convs.drop("base"), "conv_id").select("conv_id", "part", "skip", "h", "lead", "size")
    numbered = materialize(stored.join(placed, ["conv_id", "part"]).withColumn("place", F.col("at") + F.col("skip")).drop("at", "part", "skip"))
    own = numbered.where("place >= h").select(F.col("conv_id").alias("member"), F.expr("lead + place - h + 1").alias("pos"), "digest", "chars", "size")
    heads = numbered.where((F.col("place") < LEAD_MOD) & (F.col("conv_id") % LEAD_GROUP == 0)).select(F.col("conv_id").alias("base"), "place", "digest", "chars")
    led = convs.join(heads, "base").where("place < lead").select(F.col("conv_id").alias("member"), F.expr("place + 1").alias("pos"), "digest", "chars", "size")
    root = convs.select(F.col("conv_id").alias("member"), F.expr("0L").alias("pos"), turn_digest(F.lit("root"), F.lit("")).alias("digest"), F.expr("0L").alias("chars"), "size")
    return root.unionByName(led).unionByName(own).select("member", "pos", "digest", "chars", (F.col("pos") == F.col("size")).alias("last"))


def band_paths(seq: DataFrame, longest: int, height: int) -> list[DataFrame]:
    """Tables of (member, band, carry, elems, ids) for ``seq`` and, further on, for its sequences of whole bands.

    ``longest``: the greatest position of ``seq``.  An id names the whole prefix up to its position.
    """
    cells = F.sort_array(F.collect_list(F.struct("pos", "digest", "chars", "last"))).alias("elems")  # at most ``height``
    bands = seq.groupBy("member", F.expr(f"pos div {height}").alias("band")).agg(cells)
    chain = F.aggregate(
        "elems",
        F.array().cast("array<binary>"),
        lambda done, x: F.concat(done, F.array(_short(F.concat(F.coalesce(F.get(done, F.size(done) - 1), F.lit(b"")), x["digest"])))),
    )
    bands = bands.withColumn("ids", chain)
    if longest < height:
        return [materialize(bands.withColumn("carry", F.lit(None).cast("binary")))]
    bands = materialize(bands)
    whole = bands.where(F.size("ids") == height).select(
        "member", F.col("band").alias("pos"), F.get("ids", F.lit(height - 1)).alias("digest"), F.expr("0L").alias("chars"), F.lit(False).alias("last")
    )
    above = band_paths(whole, longest // height, height)
    ends = nodes_of(above[0], height).select("member", F.col("depth").alias("band"), F.col("id").alias("down"))
    carries = ends.select("member", (F.col("band") + 1).alias("band"), F.col("down").alias("carry"))
    named = bands.join(carries, ["member", "band"], "left").join(ends, ["member", "band"], "left")
    full = F.transform("ids", lambda x: F.when(F.col("carry").isNull(), x).otherwise(_short(F.concat("carry", x))))
    # the last node of a whole band goes by its name in the shorter trie, which is the carry of the nodes below it
    renamed = F.when(F.col("down").isNull(), full).otherwise(F.concat(F.slice(full, 1, height - 1), F.array("down")))
    return [materialize(named.select("member", "band", "carry", "elems", renamed.alias("ids"))), *above]


def nodes_of(paths: DataFrame, height: int) -> DataFrame:
    """A row for every (member, position): id, parent, depth, chars, last, carry and the ids from the band's first node on."""
    each = paths.select("member", "band", "carry", "ids", "elems", F.posexplode("ids").alias("i", "id"))
    here = F.get("elems", F.col("i"))
    return each.select(
        "member", "id", F.when(F.col("i") == 0, F.col("carry")).otherwise(F.get("ids", F.col("i") - 1)).alias("parent"),
        (F.col("band") * height + F.col("i")).alias("depth"), here["chars"].alias("chars"), here["last"].alias("last"), "carry", F.slice("ids", F.lit(1), F.col("i") + 1).alias("within"),
    )


def subtree_sums(levels: list[DataFrame], nodes: DataFrame, height: int) -> DataFrame:
    """id and VALUES summed over each node's subtree; ``nodes`` has id, within, carry and VALUES."""
    sums = [F.sum(v).alias(v) for v in VALUES]
    if len(levels) > 1:
        hung = nodes.where(F.col("carry").isNotNull()).groupBy(F.col("carry").alias("id")).agg(*sums)
        bands = nodes_of(levels[1], height).select("id", "within", "carry").distinct().join(hung, "id", "left")
        bands = materialize(bands.select("id", "within", "carry", *[F.coalesce(v, F.lit(0)).alias(v) for v in VALUES]))
        below = subtree_sums(levels[1:], bands, height).select("id", *[F.col(v).alias(f"below_{v}") for v in VALUES])
        nodes = nodes.join(below, "id", "left").select("id", "within", "carry", *[(F.col(v) + F.coalesce(f"below_{v}", F.lit(0))).alias(v) for v in VALUES])
    return nodes.select(F.explode("within").alias("id"), *VALUES).groupBy("id").agg(*sums)


def joined_sha256(ids: DataFrame) -> DataFrame:
    """key, ends_sha256: hash of the numbers ``member`` of each key in ascending order, joined by commas."""
    block = ids.groupBy("id", F.floor(F.col("member") / ID_BLOCK).alias("block")).agg(F.array_sort(F.collect_list("member")).alias("m"))
    text = block.select("id", "block", F.array_join(F.col("m").cast("array<string>"), ",").alias("text"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            done = []
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if key == at:
                    state.update(b",")
                else:
                    if at is not None:
                        done.append((at, state.hexdigest()))
                    at, state = key, hashlib.sha256()
                state.update(text.encode())
            yield made(done)
        if at is not None:
            yield made([(at, state.hexdigest())])

    def made(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["id", "ends_sha256"])

    return text.repartition("id").sortWithinPartitions("id", "block").select("id", "text").mapInArrow(tidy(stream), "id binary, ends_sha256 string")


def prefix_trie(seq: DataFrame, height: int = HEIGHT) -> DataFrame:
    """A row a node of the trie of ``seq`` (member, pos, digest, chars, last), whose position 0 is the root for every member.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    longest = seq.agg(F.max("pos")).first()[0] or 0
    levels = band_paths(seq, longest, height)
    rows = nodes_of(levels[0], height)
    nodes = rows.groupBy("id", "parent", "depth", "chars", "carry", "within").agg(F.min("member").alias("conv_id"), F.count("*").alias("n_convs"))
    nodes = materialize(nodes)
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    valued = nodes.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    valued = valued.withColumn("n_leaves", (F.col("n_children") == 0).cast("bigint")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("chars"))
    valued = materialize(valued)
    sums = subtree_sums(levels, valued.select("id", "within", "carry", *VALUES), height)
    ends = joined_sha256(rows.where("last").select("id", "member"))
    keep = ["conv_id", "depth", "n_convs", "n_children"]
    full = valued.select("id", "parent", *keep).join(sums, "id").join(ends, "id", "left")
    full = materialize(full.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256))).drop("id"))
    parents = valued.where("n_children > 0").select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("weight"))
    return join_split(full, materialize(parents), "parent", "weight").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *VALUES, "ends_sha256")


def conversation_trie(turns: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The trie of the rebuilt conversations of ``turns`` (conv_id, turn, role, text)."""
    return prefix_trie(materialize(rebuilt(turns)), height)
