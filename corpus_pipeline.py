"""Corpus pipeline: language ID, near-dedup, suffix-array dedup, mixing, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps with the columns of
``documents`` (the last one returns token counts and digests).  Between the stages the documents
are written as Parquet and read again, so a stage starts from files, whatever executors are lost.

Defined cases: an empty table stays empty; extra columns are dropped; a null text has no language,
so the first stage drops it (a later stage called by itself keeps it as an empty text); null and
repeated ids are allowed: near-dedup keeps one row of each group of texts, suffix dedup cuts
nothing from rows with a null id and compares no rows of one id with each other, mixing keeps or
drops the rows of one id and cell together, and tokenisation returns a row for every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrospark.llm import langid, mixing, neardup, pieces, suffixes
from retrospark.llm.common import materialize
from retrospark.llm.queries import MIX_ROUNDS, MIX_TARGETS, piece_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if its language is unknown or its calibrated score is lower.
LANG_SCORE = 0.5
#: Bytes of a passage that repeats (well over chance repeats of short phrases, under 50 words).
PASSAGE = 200
#: Share of the tokens that the mix aims to keep, and the least it goes down to where a category is scarce
#: (such a category then stays whole, below its target).
KEEP, LEAST_KEEP = 0.9, 0.75


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised."""
    model = langid.train(langid.learnable(docs.select("doc_id", "text", "lang")))
    return langid.predict(docs.select(*COLUMNS), model, keep=tuple(COLUMNS), with_text=True).where(
        (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LANG_SCORE)
    ).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (five-word shingles, 0.8): the smallest id.

    Rows are told apart by a number of their own, so that null ids, repeated rows and ids that
    several texts share lose no text: each group keeps exactly one row (null ids come last, ties by
    the row's number), and a text without words is a group of its own.
    """
    rows = materialize(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()))
    found = neardup.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), words=5, percent=80)
    groups = found.select(F.col("doc_id").alias("row"), "component_id").join(rows.select("row", "doc_id"), "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    keep = groups.groupBy("component_id").agg(first).select(F.col("first.row").alias("row"))
    return rows.join(keep, "row", "left_semi").select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that documents with smaller ids hold; a document of which nothing is left goes."""
    cut = suffixes.deduplicate(docs.select(*COLUMNS), PASSAGE, with_text=True)
    left = cut.where((F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0))
    return left.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents by their raked probabilities."""
    return mixing.mix(docs.select(*COLUMNS), MIX_TARGETS, keep=KEEP, rounds=MIX_ROUNDS, least=LEAST_KEEP).where("kept").select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    return pieces.encode_documents(docs, pieces.PieceTable.from_model(piece_model()))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("mix_sources", mix_sources),
    ("tokenize", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs


#: SQL can't express four of the stages; tests hold the result against brute-force versions.
ORACLE_SQL = None
