"""Quality rules: base measures of a text, and lines that too many documents of a host share.

1. *Profile.*  One pass over the texts takes the base measures and, of every document, the distinct
   normalised lines (A-Z lower-cased, words joined by one space) as 128-bit hashes of host and line,
   with the words that the line has in the document.
2. *Count.*  A line's frequency is the number of distinct documents (distinct texts) of the host that
   hold it: exact copies of one document don't make its lines common.  Counts are combined in each
   task before the shuffle.
3. *Limits.*  A line is over the limit if more than ``most_docs`` documents and more than
   ``most_share`` of the host's documents hold it.
4. *Remove.*  Documents' lines meet the lines over the limit by hash; lines that very many documents
   hold are joined by broadcast, the others by shuffle (:func:`common.join_split`).
5. *Judge.*  A document is depleted if fewer than ``least_words`` words, or less than ``least_share``
   of its words, are left.  Rejected are depleted documents and those that fail the base rules.

Defined cases: null text has no words and fails the base rules; a null host counts as the empty
host; every row of the input is judged for itself and gets a row, also repeated ones and ones with
null doc_id; lines without a word are neither counted nor removed; an empty table gives no rows;
extra columns are ignored, or kept where asked for (a column named like one made here is replaced).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrospark.llm.common import join_split, materialize, ship, tidy

ship(__name__)

SYMBOLS = b"#*$%&|<>"
SPAN = 5
#: Characters of text that are profiled at once.
SLICE = 1 << 20
MOST_DOCS, MOST_SHARE = 20, 0.002
LEAST_WORDS, LEAST_SHARE = 10, 0.5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Equal rows of keys get equal numbers below the number of rows."""
    out = keys[0]
    for k in keys[1:]:
        out = np.unique(out * (int(k.max(initial=0)) + 1) + k, return_inverse=True)[1]
    return out


def repeated_words(words: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Words (numbers) of each document in ``SPAN``-word windows that occur twice or more in it."""
    n = len(words) - SPAN + 1
    if n < 2:
        return np.zeros(n_docs, np.int64)
    pair = _dense(words[:-1], words[1:])
    four = _dense(pair[:-2], pair[2:])
    at = np.flatnonzero(doc[:n] == doc[SPAN - 1 :])  # windows within one document
    window = _dense(four[at], words[at + SPAN - 1], doc[at])
    again = at[np.bincount(window)[window] > 1] if len(at) else at
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + SPAN, -1)
    return np.bincount(doc[np.cumsum(cover)[:-1] > 0], minlength=n_docs)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each byte value: begins a character of a word; is a symbol."""
    b = np.arange(256)
    starts = ((b & 0xC0) != 0x80) & (b != 0x20) & ~((b >= 0x09) & (b <= 0x0D))
    return starts, np.isin(b, np.frombuffer(SYMBOLS, np.uint8))


def _line_key(host: bytes, line: bytes) -> bytes:
    return hashlib.blake2b(b"%d:%b%b" % (len(host), host, b" ".join(line.split())), digest_size=16).digest()


def profile(hosts: list[str], texts: list[str | None]) -> dict[str, list]:
    """Base measures, line hashes with their words, and text hash of each text."""
    data = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    sizes = np.cumsum([0, *map(len, data)])
    flat = np.frombuffer(b"".join(data), np.uint8)
    numbers: dict[bytes, int] = {}
    words, n_words, dups, keys, line_words = [], [], [], [], []
    for host, raw in zip(hosts, data, strict=True):
        h, own, lines, seen = host.encode("utf-8", "surrogatepass"), 0, {}, set()
        n_lines = 0
        for line in raw.split(b"\n"):
            found = line.split()
            if not found:
                continue
            n_lines += 1
            seen.add(line)
            own += len(found)
            words += [numbers.setdefault(w, len(numbers)) for w in found]
            key = _line_key(h, line.lower())
            lines[key] = lines.get(key, 0) + len(found)
        n_words.append(own)
        dups.append(n_lines - len(seen))
        keys.append(list(lines))
        line_words.append(list(lines.values()))
    starts, symbols = _tables()
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask[flat], dtype=np.int64)])[sizes])
    doc = np.repeat(np.arange(len(texts)), n_words)
    return {
        "n_words": n_words,
        "word_chars": total(starts).tolist(),
        "n_symbols": total(symbols).tolist(),
        "n_dup_lines": dups,
        "n_repeat_words": repeated_words(np.array(words, np.int64), doc, len(texts)).tolist(),
        "digest": [hashlib.blake2b(d, digest_size=16).digest() for d in data],
        "keys": keys,
        "line_words": line_words,
    }


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE or i == len(texts) - 1:
            yield first, i + 1
            first, size = i + 1, 0


def profiles(docs: DataFrame, host: str, keep: list[str], with_text: bool) -> DataFrame:
    """``keep`` columns, host, MEASURES, digest, keys, line_words (and text) of every row."""
    columns = [*keep, "_host", *["_text"] * with_text]
    rows = docs.select(*keep, F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), F.col("text").alias("_text"))
    types = {"digest": pa.binary(), "keys": pa.list_(pa.binary()), "line_words": pa.list_(pa.int64())}
    made = {m: pa.int64() for m in MEASURES} | types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, hosts = batch.column("_text").to_pylist(), batch.column("_host").to_pylist()
            for lo, hi in _slices(texts):
                found = profile(hosts[lo:hi], texts[lo:hi])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in columns] + [pa.array(found[k], t) for k, t in made.items()], [*columns, *made])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in columns)
    schema += "".join(f", {m} bigint" for m in MEASURES) + ", digest binary, keys array<binary>, line_words array<bigint>"
    return rows.mapInArrow(tidy(run), schema)


def lines_over_limit(found: DataFrame, most_docs: int, most_share: float) -> DataFrame:
    """key, n_docs, weight (rows that hold it) of the lines over the limit; ``found`` has row, _host, digest, keys."""
    first = found.groupBy("_host", "digest").agg(F.min("row").alias("row"))  # one row of each distinct text of a host
    first = materialize(first.select("row", "_host"))
    flagged = found.select("row", "_host", "keys").join(first.select("row", F.lit(1).alias("first")), "row", "left")
    each = flagged.select("_host", F.coalesce("first", F.lit(0)).alias("first"), F.explode("keys").alias("key"))
    counts = each.groupBy("key", "_host").agg(F.sum("first").alias("n_docs"), F.count("*").alias("weight")).where(F.col("n_docs") > most_docs)
    counts = materialize(counts)
    hosts = first.groupBy("_host").agg(F.count("*").alias("host_docs"))
    lines = counts.groupBy("_host").agg(F.count("*").alias("host_lines"))
    limits = materialize(hosts.join(lines, "_host"))
    return join_split(counts, limits, "_host", "host_lines").where(F.col("n_docs") > F.col("host_docs") * F.lit(most_share)).select("key", "n_docs", "weight")


def judge(
    docs: DataFrame, host: str = "source", keep: tuple[str, ...] = ("doc_id",), with_text: bool = False,
    most_docs: int = MOST_DOCS, most_share: float = MOST_SHARE, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE,
) -> DataFrame:
    """``keep`` columns, MEASURES, base_failed, n_removed_lines, n_left (words), kept of every row of ``docs``.

    n_removed_lines counts distinct lines.  ``with_text``: also ``text`` without the removed lines.
    """
    made = {*MEASURES, "digest", "keys", "line_words", "_host", "_text", "row", "text", "base_failed", "n_removed_lines", "n_left", "kept"}
    keep = [k for k in keep if k not in made]
    found = materialize(profiles(docs, host, keep, with_text).withColumn("row", F.monotonically_increasing_id()))
    over = materialize(lines_over_limit(found, most_docs, most_share))
    each = found.select("row", F.explode(F.arrays_zip("keys", "line_words")).alias("line")).select("row", F.col("line.keys").alias("key"), F.col("line.line_words").alias("words"))
    hit = join_split(each, over, "key", "weight").where("n_docs is not null")
    gone = hit.groupBy("row").agg(F.sum("words").alias("gone"), F.collect_list("key").alias("gone_keys"))  # a document's own lines
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    fine = (left >= least_words) & (left >= F.col("n_words") * F.lit(least_share))
    out = found.join(gone, "row", "left").select(
        *keep, *MEASURES, base.alias("base_failed"), F.coalesce(F.size("gone_keys"), F.lit(0)).cast("bigint").alias("n_removed_lines"),
        left.alias("n_left"), (~base & fine).alias("kept"), *["_host", "_text", "gone_keys"] * with_text,
    )
    return _without_lines(out, [c for c in out.columns if c not in ("_host", "_text", "gone_keys")]) if with_text else out


def _without_lines(rows: DataFrame, names: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for host, text, gone in zip(*(batch.column(c).to_pylist() for c in ("_host", "_text", "gone_keys")), strict=True):
                if text and gone:
                    h, drop = host.encode("utf-8", "surrogatepass"), set(gone)
                    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
                    text = b"\n".join([x for x in lines if not x.split() or _line_key(h, x.lower()) not in drop]).decode("utf-8", "surrogatepass")
                texts.append(text)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(texts, pa.string())], [*names, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names) + ", text string"
    return rows.mapInArrow(tidy(run), schema)
