"""SentencePiece BPE encoding and decoding by compatible pairs of tokens.

The BPE encoding of a string is the only sequence of tokens in which every neighbouring pair
(a, b) is compatible, that is, BPE turns the string a + b into exactly [a, b].  So every prefix
of a string has one last token.  :meth:`PieceTable.tokens` goes from place to place: a trie of the
vocabulary gives the longest token that begins there, and the longest one that is compatible with
the token before is taken.  Where none is, the place is marked and the token before gives way to a
shorter one; a place has one last token, so no place is left behind twice and the work is linear
in the text, also for one very long word.

Characters outside the vocabulary become byte tokens.  Text is cut where no token can reach
across (before a space that follows something else, around line breaks), and the results of the
pieces are kept in a bounded table per worker process, since most words of a corpus repeat.

Documents are encoded in ``mapInArrow``; the vocabulary (about 1 MB) is broadcast, nothing is
shuffled.

Defined cases: null text counts as empty; empty text has no ids and decodes to an empty text;
repeated rows each get a row; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrospark.llm.common import once, sha256_hex, ship, tidy

ship(__name__)

SPACE = "▁"
#: Entries of the per-process tables of words (two generations; the older one goes when the newer is full) and of token pairs.
MEMO_WORDS = 250_000
MEMO_PAIRS = 300_000


class _Words(dict):
    """Encoded words; one that is missing is made."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, word: str) -> str | tuple[str, str]:
        return self.make(word)


class PieceTable:
    """Vocabulary of a SentencePiece BPE model: pieces in id order with scores and kinds."""

    def __init__(self, pieces: Sequence[str], scores: Sequence[float], kinds: Sequence[str]):
        """kinds: ``normal``, ``byte``, ``control`` or ``unknown`` for each id."""
        self.pieces, self.scores, self.kinds = list(pieces), list(scores), list(kinds)
        self._ready = False

    @classmethod
    def from_model(cls, path: str) -> PieceTable:
        """Read the vocabulary of a model file (on the driver)."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        kind = lambda i: "byte" if sp.is_byte(i) else "control" if sp.is_control(i) or sp.is_unused(i) else "unknown" if sp.is_unknown(i) else "normal"
        return cls([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], [kind(i) for i in range(n)])

    def _prepare(self) -> None:
        if self._ready:
            return
        normal = [i for i, k in enumerate(self.kinds) if k == "normal"]
        self.ids = {self.pieces[i]: i for i in normal}
        self.plain = set(normal)
        self.score = {self.pieces[i]: self.scores[i] for i in normal}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == "byte"}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == "unknown"), 0)
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) > 1:
                self.automaton.add_word(p, 0)
        multi = [p for p in self.ids if len(p) > 1]
        self.most = max(map(len, multi), default=1)
        # of every beginning of a token: the longest token that begins it, or its first character; of every token: the next shorter one
        self.longest, self.shorter = {}, {}
        for p in multi:
            token = p[0]
            for n in range(2, len(p) + 1):
                if p[:n] in self.ids:
                    self.shorter[p[:n]], token = token, p[:n]
                self.longest[p[:n]] = token
        self.texts = {p: str(i) for p, i in self.ids.items()}
        # no token goes on from something else into a space, and none holds a line break:
        self.cut_space = not any(SPACE in p.lstrip(SPACE) for p in multi)
        self.cut_line = not any("\n" in p for p in multi)
        self.pairs: dict[str, dict[str, bool]] = {}  # by the token before
        self.n_pairs = 0
        self.forget()
        self._ready = True

    def forget(self) -> None:
        """Drop the tables of words."""
        self.words, self.older = _Words(self._word), _Words(self._word)

    def _merge(self, text: str) -> list[str]:
        """BPE by its definition: join the best-scored neighbours, the leftmost first; for token pairs."""
        get, none, out = self.score.get, float("-inf"), list(text)
        gains = [get(a + b, none) for a, b in zip(out, out[1:], strict=False)]
        while gains:
            best = max(gains)
            if best == none:
                break
            at = gains.index(best)
            out[at : at + 2] = [out[at] + out[at + 1]]
            del gains[at]
            if at:
                gains[at - 1] = get(out[at - 1] + out[at], none)
            if at < len(gains):
                gains[at] = get(out[at] + out[at + 1], none)
        return out

    def _fits(self, left: str, right: str) -> bool:
        """Whether BPE keeps the pair as it is (without a token before it: the token)."""
        if self.n_pairs >= MEMO_PAIRS:
            self.pairs.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        ok = self.pairs.setdefault(left, {})[right] = self._merge(left + right) == ([left, right] if left else [right])
        return ok

    def tokens(self, text: str) -> list[str]:
        """Tokens of an escaped text (spaces are U+2581): at each place the longest that fits, else a shorter one, else a step back."""
        self._prepare()
        if not text:
            return []
        reach, longest, shorter, pairs, most, end = self.automaton.longest_prefix, self.longest, self.shorter, self.pairs, self.most, len(text)
        out: list[str] = []
        dead: set[int] = set()  # places that tokens reach but from which none leads to the end
        at, left, row = 0, "", pairs.get("") or {}
        n = reach(text[:most])
        token = longest[text[:n]] if n > 1 else text[0]
        while True:
            if not token:  # none is left here
                dead.add(at)
                token = out.pop()
                at -= len(token)
                left = out[-1] if out else ""
                row = pairs.get(left) or {}
            elif not dead or at + len(token) not in dead:
                ok = row.get(token)
                if ok is None:
                    ok = self._fits(left, token)
                if ok:
                    out.append(token)
                    at += len(token)
                    if at == end:
                        return out
                    left, row = token, pairs.get(token) or {}
                    n = reach(text[at : at + most])
                    token = longest[text[at : at + n]] if n > 1 else text[at]
                    continue
            token = shorter.get(token, "")

    def _ids_of(self, token: str) -> list[int]:
        got = self.ids.get(token)
        if got is not None:
            return [got]
        if self.byte_ids:
            return [self.byte_ids[b] for b in token.encode("utf-8")]
        return [self.unknown]

    def _word(self, word: str) -> str | tuple[str, str]:
        """Ids joined by commas of a piece that no token leaves; with the decoded text where it isn't the piece itself."""
        out = self.words.get(word) or self.older.get(word)
        if out is None:
            tokens = self.tokens(word)
            try:
                out = ",".join([self.texts[t] for t in tokens])  # all from the vocabulary: they decode to the word
            except KeyError:
                ids = [i for t in tokens for i in self._ids_of(t)]
                text = self._text_of(ids)
                out = ",".join(map(str, ids))
                if text != word.replace(SPACE, " "):
                    out = (out, text)
        if len(word) <= 64:
            if len(self.words) >= MEMO_WORDS:
                self.older, self.words = self.words, _Words(self._word)
            self.words[word] = out
        return out

    def _encoded(self, text: str) -> tuple[str, str]:
        """(ids joined by commas, decoded text with its leading space)."""
        self._prepare()
        if not text:
            return "", ""
        escaped = SPACE + text.replace(" ", SPACE)
        words = _CUTS.findall(escaped) if self.cut_space and self.cut_line else [escaped]
        found = list(map(self.words.__getitem__, words))
        try:
            return ",".join(found), escaped.replace(SPACE, " ")
        except TypeError:  # words that decode to something else
            pass
        texts = [f[1] if f.__class__ is tuple else w.replace(SPACE, " ") for f, w in zip(found, words, strict=True)]
        return ",".join([f[0] if f.__class__ is tuple else f for f in found]), "".join(texts)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, without begin or end ids."""
        ids = self._encoded(text or "")[0]
        return [int(i) for i in ids.split(",")] if ids else []

    def _text_of(self, ids: Sequence[int]) -> str:
        if self.plain.issuperset(ids):
            return "".join([self.pieces[i] for i in ids]).replace(SPACE, " ")
        out, run = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            kind = self.kinds[i]
            out.append(self.pieces[i].replace(SPACE, " ") if kind == "normal" else " ⁇ " if kind == "unknown" else "")
        if run:
            out.append(_utf8(run))
        return "".join(out)

    def decode(self, ids: Sequence[int]) -> str:
        """Text of ids: byte runs as UTF-8 (U+FFFD for each byte that isn't), a first piece's leading space dropped."""
        self._prepare()
        text = self._text_of(ids)
        first = next((i for i in ids if self.kinds[i] != "control"), None)
        return text[1:] if first is not None and self.kinds[first] == "normal" and self.pieces[first].startswith(SPACE) else text

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text)."""
        ids, decoded = self._encoded(text or "")
        return ids.count(",") + bool(ids), sha256_hex(ids.encode()), sha256_hex(decoded[1:].encode("utf-8", "surrogatepass"))


_CUTS = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


def _utf8(run: bytearray) -> str:
    """UTF-8 with one U+FFFD for each byte that begins no whole character."""
    try:
        return run.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + n].decode("utf-8"))
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def encode_documents(docs: DataFrame, table: PieceTable, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """``keep`` columns plus n_tokens, ids_sha256, decoded_sha256 of every row (and ids, decoded if asked)."""
    shared = docs.sparkSession.sparkContext.broadcast({"pieces": table.pieces, "scores": table.scores, "kinds": table.kinds})
    rows = docs.select(*keep, F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    schema += ", n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = once(shared, PieceTable)  # one object per worker process
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            counts, ids, decoded = zip(*map(t.digests, texts), strict=True) if texts else ((), (), ())
            out = [batch.column(k) for k in keep] + [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                each = [t.encode(x) for x in texts]
                out += [pa.array(each, pa.list_(pa.int32())), pa.array([t.decode(i) for i in each], pa.string())]
            yield pa.RecordBatch.from_arrays(out, names)
        t.forget()  # the table of pairs stays for the next task

    return rows.mapInArrow(tidy(run), schema)
