"""Document fingerprints: a homomorphic multiset hash over paragraphs.

Every paragraph is hashed to a wide vector; a document's fingerprint is the sum of its
paragraphs' vectors modulo 2**32 in each lane.  The sum does not depend on the order of the
paragraphs, and a paragraph is inserted or deleted by adding or subtracting its vector
(:func:`insert_paragraphs`, :func:`delete_paragraphs`).

Lanes (``LANES`` values, each modulo 2**32):

* lane 0: number of paragraphs,
* ``EQUAL`` lanes: 32-bit halves of seeded 64-bit hashes (256 bits that decide equality),
* ``SIGNS`` lanes: one hash bit per lane.  Twice the lane minus the paragraph count is a sum of
  random signs, so the cosine of two such vectors estimates the cosine of the two paragraph
  multisets (:func:`likeness`, standard error about 1 / sqrt(SIGNS)).

Everything is a DataFrame expression: the lanes of a text are computed inside the scan or join
task by one ``aggregate`` over its paragraph hashes; no rows are exploded and nothing is
shuffled for the fingerprint itself.

Defined cases: null text counts as empty; an empty text has no paragraph and an all-zero
fingerprint; likeness is 1 for equal fingerprints (two empty ones too) and 0 if just one is
empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrospark.llm.common import MASK32, materialize

EQUAL = 8
SIGNS = 64
LANES = 1 + EQUAL + SIGNS
#: A paragraph ends at a line break or after a sentence, so that one-line texts have parts, too.
PARAGRAPH = r"\n+|(?<=[.!?]) +"
_PAIR = 0x0000000100000001


def paragraphs(text: Column, pattern: str = PARAGRAPH) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), pattern, -1), lambda p: p != "")


def _lanes_of(parts: Column) -> Column:
    hashed = F.transform(
        parts,
        lambda p: F.struct(*[F.xxhash64(F.lit(s), p).alias(f"h{s}") for s in range(EQUAL // 2)], F.xxhash64(F.lit(97), p).alias("g")),
    )
    zero = F.lit(0).cast("bigint")
    half = SIGNS // 2
    names = ["n", *[f"e{i}" for i in range(EQUAL)], *[f"s{i}" for i in range(half)]]

    def add(acc, h):
        out = [(acc["n"] + F.lit(1).cast("bigint")).alias("n")]
        for s in range(EQUAL // 2):
            out.append((acc[f"e{2 * s}"] + h[f"h{s}"].bitwiseAND(F.lit(MASK32))).alias(f"e{2 * s}"))
            out.append((acc[f"e{2 * s + 1}"] + F.shiftrightunsigned(h[f"h{s}"], 32)).alias(f"e{2 * s + 1}"))
        for i in range(half):  # two 32-bit counters per long: hash bits i and i + 32
            out.append((acc[f"s{i}"] + F.shiftrightunsigned(h["g"], i).bitwiseAND(F.lit(_PAIR))).alias(f"s{i}"))
        return F.struct(*out)

    def finish(acc):
        low = [acc[f"s{i}"].bitwiseAND(F.lit(MASK32)) for i in range(half)]
        high = [F.shiftrightunsigned(acc[f"s{i}"], 32) for i in range(half)]
        return F.array(acc["n"], *[acc[f"e{i}"].bitwiseAND(F.lit(MASK32)) for i in range(EQUAL)], *low, *high)

    return F.aggregate(hashed, F.struct(*[zero.alias(c) for c in names]), add, finish)


def lanes(text: Column, pattern: str = PARAGRAPH) -> Column:
    """The fingerprint vector (array of ``LANES`` longs) of a text."""
    return _lanes_of(paragraphs(text, pattern))


def insert_paragraphs(vector: Column, text: Column, pattern: str = PARAGRAPH) -> Column:
    """The fingerprint after adding the paragraphs of ``text``."""
    return F.zip_with(vector, lanes(text, pattern), lambda a, b: (a + b).bitwiseAND(F.lit(MASK32)))


def delete_paragraphs(vector: Column, text: Column, pattern: str = PARAGRAPH) -> Column:
    """The fingerprint after removing the paragraphs of ``text``."""
    return F.zip_with(vector, lanes(text, pattern), lambda a, b: (a - b).bitwiseAND(F.lit(MASK32)))


def as_string(vector: Column) -> Column:
    """Lower-case hexadecimal, eight digits a lane."""
    return F.lower(F.array_join(F.transform(vector, lambda v: F.lpad(F.hex(v), 8, "0")), ""))


def _signs(vector: Column) -> Column:
    n = F.get(vector, F.lit(0))
    return F.transform(F.slice(vector, 2 + EQUAL, SIGNS), lambda v: (v * 2 - n).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated cosine of the two paragraph multisets, from the fingerprints alone; 0 to 1."""
    x, y = _signs(a), _signs(b)

    def dot(u, v):
        return F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)

    norm = F.sqrt(dot(x, x) * dot(y, y))
    est = F.when(norm > 0, dot(x, y) / norm).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.least(F.greatest(est, F.lit(0.0)), F.lit(1.0)))


def neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id, prev_id, take) in ascending doc_id, closed to a ring.

    ``take`` is how many leading code points the previous document asks for (a quarter of its
    length).  Ids are range-partitioned, ordered inside each partition, and stitched at the
    partition borders (one row per partition); no task sees all ids.  Null ids take no part.
    """
    ids = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n"))
    ids = materialize(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()))
    edge = Window.orderBy("part")
    ends = ids.groupBy("part").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("tail"), F.max_by("n", "doc_id").alias("tail_n"))
    first = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "part",
        F.coalesce(F.lead("head").over(edge), F.first("head").over(first)).alias("after"),
        F.coalesce(F.lag("tail").over(edge), F.last("tail").over(first)).alias("before"),
        F.coalesce(F.lag("tail_n").over(edge), F.last("tail_n").over(first)).alias("before_n"),
    )
    w = Window.partitionBy("part").orderBy("doc_id")
    inner = ids.select(
        "doc_id", "part", F.lead("doc_id").over(w).alias("nx"), F.lag("doc_id").over(w).alias("pv"), F.lag("n").over(w).alias("pn")
    )
    return inner.join(ends, "part").select(
        "doc_id",
        F.coalesce("nx", "after").alias("next_id"),
        F.coalesce("pv", "before").alias("prev_id"),
        F.floor(F.coalesce("pn", "before_n") / 4).cast("int").alias("take"),
    )


def fingerprint_with_edits(docs: DataFrame, pattern: str = PARAGRAPH) -> DataFrame:
    """Fingerprint every text and its edited text (last quarter replaced by the start of the next document).

    Input: doc_id, text (further columns are ignored).  Output: one row per input row: doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Defined cases: rows that repeat a doc_id each keep their row, and the previous document
    takes the smallest of their texts' starts; the next of the last id is the first one (a
    single document follows itself); a row with null doc_id has no next document, so its last
    quarter is dropped and near_next is 0 (1 if its text is empty).
    """
    columns = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = columns.where(F.col("doc_id").isNotNull())
    # both uses of ``base`` are inner joins over the same scan, so the texts are shuffled once
    base = known.join(neighbours(docs), "doc_id")
    starts = (
        base.select(
            F.col("prev_id").alias("doc_id"),
            F.struct(F.substring(F.col("text"), F.lit(1), F.col("take")).alias("start"), lanes(F.col("text"), pattern).alias("lanes")).alias("nx"),
        )
        .groupBy("doc_id")
        .agg(F.min("nx").alias("nx"))
    )
    zero = F.array_repeat(F.lit(0).cast("bigint"), LANES)
    lone = columns.where(F.col("doc_id").isNull()).withColumn("nx", F.struct(F.lit("").alias("start"), zero.alias("lanes")))
    rows = base.select("doc_id", "text").join(starts, "doc_id").unionByName(lone)
    n, q = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - q), F.substring(F.col("nx.start"), F.lit(1), q))
    rows = rows.select(
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        F.sha2(edited.cast("binary"), 256).alias("edited_sha256"),
        lanes(F.col("text"), pattern).alias("own"),
        lanes(edited, pattern).alias("edit"),
        F.col("nx.lanes").alias("next"),
    )
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string(F.col("own")).alias("fingerprint"),
        as_string(F.col("edit")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edit")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
