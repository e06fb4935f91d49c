"""Cross-tokenizer alignment with exact-text deduplication.

Two tokenizers cut the same bytes (a space and the text): A, a byte-level BPE, and B, a
SentencePiece model, which adds the space itself.  Offsets where tokens of both end cut them into
groups; an A and a B token whose byte ranges overlap are linked; an id pair's count is the number
of documents that hold it linked.

1. *Shuffle by full text.*  Documents are grouped by their whole text (map-side combined), so each
   distinct text is tokenised and aligned once and carries its number of documents.
2. *Align.*  A text is cut into chunks that no token of either tokenizer crosses.  The new chunks of
   a slice of about ``SLICE`` characters are tokenised by both libraries and aligned by a few array
   operations (laid one after another, ends merged by binary search); chunks seen before are
   remembered.  Written are a text's measures and its distinct pairs with their links, packed.
3. *Count.*  Pair counts are sums of the texts' document numbers, combined in each task, then by
   shuffle.  The highest count of an A id is a table bounded by A's vocabulary.
4. *Measure.*  The most common pairs (at most ``COMMON_PAIRS``, a size proven by a histogram of the
   counts) are broadcast and looked up where the packed pairs are; the other pairs meet their
   counts by shuffle and are summed by text.
5. *Join to the documents* by the text's SHA-256; texts that very many documents share are joined by
   broadcast (:func:`common.join_split`), the others by shuffle.

Defined cases: null and empty texts, and texts whose joined token bytes of either tokenizer differ
from space + text (for instance texts that hold U+2581), have no tokens: all measures 0, the
column ``groups_sha256`` an empty string, and no part in the counts.  Every row of the documents
counts as one document and gets a row, also repeated ones and ones with null doc_id.  Extra
columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrospark.llm.common import join_split, materialize, once, sha256_hex, ship, tidy

ship(__name__)

#: Bytes of text that are aligned at once; pairs whose counts are combined at once in a task.
SLICE = 1 << 19
COMBINE = 1 << 21
COMMON_PAIRS = 1 << 20
#: A worker forgets rarely seen chunks beyond these numbers of chunks and of links.
MEMO_CHUNKS, MEMO_CODES = 600_000, 1 << 22
#: Characters of new chunks that are tokenised at once.
RUN = 1 << 14
#: White space, by any reading, besides spaces and line breaks
_ODD = frozenset(c for c in map(chr, range(0x3001)) if c.isspace() or c in "\u180e\u200b") - {" ", "\n"}
_CHUNK = re.compile("[ \\n]+[^ \\n]*")
_CUT = re.compile("(?<=[^\\s\u180e\u200b])(?=[ \\n])")
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves, the others as characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


class Aligner:
    """Both tokenizers with the bytes of their tokens; ``a_json`` and ``b_model`` are the files' contents."""

    def __init__(self, a_json: bytes, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.n_a, self.n_b = self.a.get_vocab_size(with_added_tokens=True), self.b.get_piece_size()
        byte = _byte_of_char()
        self.a_bytes = [b""] * self.n_a
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            self.a_bytes[i] = bytes(byte[c] for c in token)
        self.b_bytes = [self._piece(i) for i in range(self.n_b)]
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self.words = [np.array([f"{i}{end}" for i in range(max(self.n_a, self.n_b))], object) for end in ",|;"]
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b) if not self.b.is_byte(i)]
        #: B's tokens never reach over a line break, nor from something else into a space
        self.can_cut = not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces)
        self.space = self.b.piece_to_id("▁")
        self.known, self.texts = Numbers(), []  # chunk -> place of its row, groups of each chunk
        #: n_a (negative: without tokens), n_b, n_groups, first code, number of codes; times seen
        self.rows, self.hits = np.zeros((0, 5), np.int32), np.zeros(0, np.int32)
        self.codes, self.n_codes = np.zeros(0, np.int64), 0
        self._forget()

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        if self.b.is_control(i) or self.b.is_unknown(i):
            return b""
        return self.b.id_to_piece(i).replace("▁", " ").encode()

    def _forget(self, least: int | None = None) -> None:
        """Drop the chunks seen fewer than ``least`` times (all without it)."""
        n = len(self.texts) if least else 0
        keep = np.flatnonzero(self.hits[:n] >= least) if least else np.zeros(0, np.int64)
        if len(keep) > MEMO_CHUNKS // 2 or (least and self.rows[keep, 4].sum() > MEMO_CODES // 2):
            return self._forget(2 * least)
        chunks, texts, rows, codes = list(self.known), self.texts, self.rows, self.codes
        self.known = Numbers(zip([chunks[i] for i in keep], range(len(keep)), strict=True))
        self.texts = [texts[i] for i in keep]
        self.rows, self.hits = np.zeros((MEMO_CHUNKS, 5), np.int32), np.zeros(MEMO_CHUNKS, np.int32)
        self.codes, self.n_codes = np.zeros(MEMO_CODES, np.int64), 0
        if len(keep):
            kept = rows[keep]
            self.rows[: len(keep)] = kept
            self.rows[: len(keep), 3] = np.cumsum(kept[:, 4]) - kept[:, 4]
            self._keep_codes(_gather(codes, kept[:, 3], kept[:, 4]))
        return None

    def _chunks(self, text: str) -> list[str]:
        """Parts of space + text that neither tokenizer's tokens cross: each starts at a space or line break after something else.

        A's words end before white space that follows something else, and look back no further; for
        B see ``can_cut``.  Other white space than spaces and line breaks gets no cut behind it.
        """
        whole = " " + text
        if not self.can_cut:
            return [whole]
        return _CHUNK.findall(whole) if _ODD.isdisjoint(whole) else _CUT.split(whole)

    def _both(self, run: str) -> tuple[list[int], list[int], bytes] | None:
        """Ids of A and B of a run of chunks and its bytes; None if the tokens' bytes differ from them."""
        a = self.a.encode_batch_fast([run], add_special_tokens=False)[0].ids
        if run == " ":
            b = [self.space]
        elif run[0] == " ":  # the space that B adds itself
            b = self.b.encode(run[1:])
        else:
            b = self.b.encode(run)
            b = b[1:] if b[:1] == [self.space] else []
        whole = run.encode()
        same = b"".join([self.a_bytes[k] for k in a]) == whole and b"".join([self.b_bytes[k] for k in b]) == whole
        return (a, b, whole) if same else None

    def _learn(self, chunks: list[str]) -> None:
        """Tokenise and align chunks at once.

        Chunks that end in something else than white space are tokenised in long runs, which both
        tokenizers cut at the chunks' ends; runs laid one after another are merged by binary search.
        """
        runs, run, size = [], [], 0
        for i, c in enumerate(chunks):
            if c[-1].isspace() or c[-1] in _ODD or "▁" in c:
                runs.append([i])
                continue
            run.append(i)
            size += len(c)
            if size > RUN:
                runs.append(run)
                run, size = [], 0
        runs += [run] if run else []
        rows = np.zeros((len(chunks), 5), np.int64)
        rows[:, 0] = -1
        texts, good, a_ids, b_ids = [""] * len(chunks), [], [], []
        while runs:
            run = runs.pop()
            found = self._both("".join([chunks[i] for i in run]))
            if found:
                good += run
                a_ids.append(np.array(found[0], np.int64))
                b_ids.append(np.array(found[1], np.int64))
            elif len(run) > 1:
                runs += [[i] for i in run]
        if good:
            a, b = np.concatenate(a_ids), np.concatenate(b_ids)
            ends = np.cumsum([len(chunks[i].encode()) for i in good])
            a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
            a_cut = np.concatenate([[0], np.searchsorted(a_end, ends, "right")])
            b_cut = np.concatenate([[0], np.searchsorted(b_end, ends, "right")])
            a_start, b_start = a_end - self.a_size[a], b_end - self.b_size[b]
            both = np.intersect1d(a_end, b_end, assume_unique=True)  # no token is empty
            a_group, b_group = np.searchsorted(both, a_end), np.searchsorted(both, b_end)
            # the tokens in the order of the groups, A's before B's, each with the mark that follows it
            a_place = np.arange(len(a)) + np.searchsorted(b_group, a_group, "left")
            b_place = np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")
            word = np.empty(len(a) + len(b), object)
            word[a_place] = np.where(np.append(a_group[1:] != a_group[:-1], True), self.words[1][a], self.words[0][a])
            word[b_place] = np.where(np.append(b_group[1:] != b_group[:-1], True), self.words[2][b], self.words[0][b])
            # links: B tokens from the first that ends after A's start to the last that starts before its end
            first, past = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
            n = past - first
            link_cut = np.concatenate([[0], np.cumsum(n)])
            other = np.repeat(first - link_cut[:-1], n) + np.arange(link_cut[-1])
            cut = link_cut[a_cut]
            groups = np.diff(a_group[a_cut[1:] - 1] + 1, prepend=0)
            rows[good] = np.stack([np.diff(a_cut), np.diff(b_cut), groups, cut[:-1] + self.n_codes, np.diff(cut)], axis=1)
            self._keep_codes(np.repeat(a, n) * self.n_b + b[other])
            marked = word.tolist()
            for i, lo, hi in zip(good, (a_cut + b_cut)[:-1].tolist(), (a_cut + b_cut)[1:].tolist(), strict=True):
                texts[i] = "".join(marked[lo:hi])[:-1]
        at, need = len(self.texts), len(self.texts) + len(chunks)
        while need > len(self.rows):
            self.rows, self.hits = np.concatenate([self.rows, np.zeros_like(self.rows)]), np.concatenate([self.hits, np.zeros_like(self.hits)])
        self.rows[at:need] = rows
        self.texts += texts

    def _keep_codes(self, codes: np.ndarray) -> None:
        while self.n_codes + len(codes) > len(self.codes):
            self.codes = np.concatenate([self.codes, np.zeros_like(self.codes)])
        self.codes[self.n_codes : self.n_codes + len(codes)] = codes
        self.n_codes += len(codes)

    def align(self, texts: list[str]) -> list[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """(n_a, n_b, n_groups, n_links, groups, distinct pair codes, links of each code) of every text.

        A pair's code is ``a * n_b + b``.  Chunks are aligned once and remembered, within bounds.
        """
        if len(self.texts) > MEMO_CHUNKS or self.n_codes > MEMO_CODES:
            self._forget(2)
        places = [list(map(self.known.__getitem__, self._chunks(t))) if t else [] for t in texts]
        if self.known.new:
            self._learn(self.known.new)
            self.known.new = []
        none = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
        out, n = [], len(self.texts)
        self.hits[:n] += np.bincount(list(chain.from_iterable(places)), minlength=n)[:n].astype(np.int32)
        for at in places:
            rows = self.rows[np.array(at, np.int64)]
            if not at or rows[:, 0].min() < 0:
                out.append(none)
                continue
            pairs, links = np.unique(_gather(self.codes, rows[:, 3], rows[:, 4]), return_counts=True)
            n_a, n_b, groups, _, n_links = rows.sum(axis=0).tolist()
            out.append((n_a, n_b, groups, n_links, ";".join([self.texts[k] for k in at]), pairs, links))
        return out


class Numbers(dict):
    """Numbers keys as they are first asked for; ``new`` lists them."""

    def __init__(self, known=()):
        super().__init__(known)
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


def _gather(flat: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """flat[first[0] : first[0] + n[0]], flat[first[1] : ...], ... one after another."""
    end = np.cumsum(n)
    return flat[np.repeat(first - end + n, n) + np.arange(end[-1] if len(end) else 0)]


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``SLICE`` characters."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLICE or i == len(texts) - 1:
            yield first, i + 1
            first, size = i + 1, 0


def _pack(pairs: np.ndarray, links: np.ndarray) -> bytes:
    """Sorted codes as differences, then links, byte plane by byte plane, which compresses well."""
    both = np.concatenate([np.diff(pairs, prepend=0), links]).astype("<u8")
    planes = both.view(np.uint8).reshape(-1, 8).T
    used = 8 - int(np.argmax(planes[::-1].any(axis=1))) if len(both) else 0
    return bytes([used]) + planes[:used].tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    used = blob[0]
    if not used:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = np.frombuffer(blob, np.uint8, offset=1).reshape(used, -1)
    planes = np.zeros((raw.shape[1], 8), np.uint8)
    planes[:, :used] = raw.T
    both = planes.view("<u8").ravel().astype(np.int64)
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


def align_texts(docs: DataFrame, a_json: bytes, b_model: bytes, with_groups: bool = False) -> DataFrame:
    """Each distinct non-empty text of ``docs`` once: key (SHA-256), n_docs, measures, packed pairs (and the groups)."""
    shared = docs.sparkSession.sparkContext.broadcast({"a_json": a_json, "b_model": b_model})
    distinct = docs.where(F.length("text") > 0).groupBy("text").agg(F.count("*").alias("n_docs"))
    names = ["key", "n_docs", *COUNTS, "groups_sha256", "pairs", *["groups"] * with_groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = once(shared, Aligner)
        for batch in batches:
            for lo, hi in _slices(batch.column("text").to_pylist()):
                texts = batch.column("text").slice(lo, hi - lo).to_pylist()
                rows = aligner.align(texts)
                columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
                columns += [pa.array([sha256_hex(r[4].encode()) if r[0] else "" for r in rows]), pa.array([_pack(r[5], r[6]) for r in rows], pa.binary())]
                columns += [pa.array([r[4] for r in rows])] * with_groups
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(lo, hi - lo), batch.column("n_docs").slice(lo, hi - lo), *columns], names)

    schema = "key binary, n_docs bigint, " + "".join(f"{c} bigint, " for c in COUNTS) + "groups_sha256 string, pairs binary" + ", groups string" * with_groups
    return distinct.select(text_key().alias("key"), "text", "n_docs").mapInArrow(tidy(run), schema)


def text_key():
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(code, n): number of documents that hold a pair linked."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            code, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            n = np.zeros(len(code), np.int64)
            np.add.at(n, at, np.concatenate([np.full(len(c), w, np.int64) for c, w in held]))
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

        for batch in batches:
            for blob, docs in zip(batch.column("pairs").to_pylist(), batch.column("n_docs").to_pylist(), strict=True):
                code = _unpack(blob)[0]
                held.append((code, docs))
                size += len(code)
                if size >= COMBINE:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return aligned.select("pairs", "n_docs").mapInArrow(tidy(combine), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def _common(counts: DataFrame, most: int) -> int:
    """The smallest power of two that at most ``most`` counts reach."""
    sizes = dict(counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect())  # 64 rows at most
    least, left = 64, most
    while least and sizes.get(least - 1, 0) <= left:
        least -= 1
        left -= sizes.get(least, 0)
    return 1 << least if least < 63 else 1 << 62


def _pairs_of(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for n in names]


def measures(aligned: DataFrame, counts: DataFrame, n_b: int, common_pairs: int = COMMON_PAIRS) -> DataFrame:
    """key, n_docs, COUNTS, groups_sha256, n_best, count_sum of every text.  Both tables are read several times."""
    spark = aligned.sparkSession
    best = counts.groupBy(F.expr(f"code div {n_b}").alias("a")).agg(F.max("n").alias("best"))  # bounded by A's vocabulary
    least = _common(counts, common_pairs)
    code, n = _pairs_of(counts.where(F.col("n") >= least).toArrow(), "code", "n")
    a, top = _pairs_of(best.toArrow(), "a", "best")
    order, by_a = np.argsort(code), np.zeros(int(a.max(initial=0)) + 1, np.int64)
    by_a[a] = top
    shared = spark.sparkContext.broadcast({"code": code[order], "n": n[order], "best": by_a})
    rare = counts.where(F.col("n") < least)
    some_rare = not rare.isEmpty()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = (shared.value[k] for k in ("code", "n", "best"))
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                blobs = [_unpack(x) for x in part.column("pairs").to_pylist()]
                code, links = (np.concatenate([b[k] for b in blobs]) for k in (0, 1))
                row = np.repeat(np.arange(len(blobs)), [len(b[0]) for b in blobs])
                at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
                hit = known[at] == code if len(known) else np.zeros(len(code), bool)
                count = np.where(hit, n[at], 0) if len(known) else np.zeros(len(code), np.int64)
                sums, tops = np.zeros(len(blobs), np.int64), np.zeros(len(blobs), np.int64)
                np.add.at(sums, row, links * count)
                is_top = hit & (count == best[code // n_b])
                np.add.at(tops, row[is_top], links[is_top])
                miss = np.flatnonzero(~hit)
                cut = np.searchsorted(row[miss], np.arange(len(blobs) + 1))
                lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x[miss])) for x in (code, links)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep] + [pa.array(tops), pa.array(sums), *lists], [*keep, "n_best", "count_sum", "rare", "rare_links"]
                )

    keep = ["key", "n_docs", *COUNTS, "groups_sha256"]
    schema = "key binary, n_docs bigint, " + "".join(f"{c} bigint, " for c in COUNTS) + "groups_sha256 string, n_best bigint, count_sum bigint, rare array<bigint>, rare_links array<bigint>"
    out = aligned.select(*keep, "pairs").mapInArrow(tidy(look_up), schema)
    if not some_rare:
        return out.drop("rare", "rare_links")
    out = materialize(out)
    each = out.select("key", F.explode(F.arrays_zip("rare", "rare_links")).alias("r")).select("key", F.col("r.rare").alias("code"), F.col("r.rare_links").alias("links"))
    counted = rare.withColumn("a", F.expr(f"code div {n_b}")).join(F.broadcast(best), "a").select("code", "n", (F.col("n") == F.col("best")).alias("top"))
    more = each.join(counted, "code").groupBy("key").agg(F.sum(F.when(F.col("top"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more_sum"))
    return out.drop("rare", "rare_links").join(more, "key", "left").select(
        *keep, (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum")
    )


def align_documents(docs: DataFrame, a_path: str, b_path: str, common_pairs: int = COMMON_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs`` (doc_id, text).

    ``a_path``: a byte-level BPE as ``tokenizers`` JSON, ``b_path``: a SentencePiece model (read on the driver).
    """
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        a_json, b_model = a.read(), b.read()
    aligned = materialize(align_texts(docs, a_json, b_model))
    counts = materialize(pair_counts(aligned))
    found = materialize(measures(aligned, counts, Aligner(a_json, b_model).n_b, common_pairs))
    numbers = [*COUNTS, "n_best", "count_sum"]
    with_text = F.length("text") > 0
    keyed = materialize(docs.where(with_text).select("doc_id", text_key().alias("key")))
    named = join_split(keyed, found, "key", "n_docs").select("doc_id", *numbers, "groups_sha256")
    zeros = [F.lit(0).cast("bigint").alias(c) for c in numbers]
    return named.unionByName(docs.where(F.coalesce(~with_text, F.lit(True))).select("doc_id", *zeros, F.lit("").alias("groups_sha256")))
