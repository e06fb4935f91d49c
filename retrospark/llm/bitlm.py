"""Language-model scoring: logistic context mixing over the bits of a text.

The text (A-Z lower-cased, UTF-8, closed by the byte 0xFF) is predicted bit by bit.  For each of
the ``ORDERS`` (1 to 5 preceding bytes) the counts say how often the next bit was 0 and 1 in the
context; the stretched probabilities of the orders are summed with weights that a gate
selects (longest context seen, its confidence, place in the word, bit position), and an adaptive
probability map refines the sum.  Whole passages are predicted by a sixth, hashed context of
``MEMORY`` bytes (below).  A text's cost in bits is the sum over its bits.

A bit's cost depends on its window only (the byte and the five before it), so the model is a
distributed table of distinct windows that grows with the input; its counts are exact:

* *Ask.*  Each share of the texts (about ``SHARE`` bytes) sends its distinct windows, with their
  occurrences in training texts, to the tasks that hold them.  Windows are dealt by the three
  bytes before the target, so a task has all counts of orders 3 to 5 of its contexts.
  The counts of orders 1 and 2 (at most 2**24 three-byte strings) are broadcast.
* *Learn.*  Every training window has a part in the weights and in the map: each task sums the
  gradients and curvatures of its windows, weighted by their occurrences and without the
  occurrence itself; the sums (of a fixed size) are added up in a tree (``FAN`` at a time) and
  give one Newton step of each gate's weights, ``ROUNDS`` times.  The map is counted in a last pass.
* *Answer.*  Each task sends the costs of its windows to the shares that asked.

Long contexts.  Content-defined marks (one byte in ``EVERY``) cut a text into passages.  The context of
a passage is the hash of the ``MEMORY`` bytes before it; C is how often training texts hold the context,
c how often it goes on with this very passage.  The probability of a passage is mixed from the bit
model's and the remembered share c / C; the weight of the memory (by the size of C) is the share of
the training passages, each without itself, that their contexts remember.  The mixture stays a
probability: both parts sum to one over all passages.  Passages are dealt by their context like the
windows, so this memory is a distributed table that grows with the text.  A training text's own
occurrence doesn't count in its own memory, so texts that occur once stay apart from those that repeat.

Scoring uses the frozen model, so a text's score depends on the training texts only.

Word counts for the base score are a distributed table.  The commonest words (at most
``common_words``, chosen by a count threshold) are broadcast; every other word occurrence is
joined with the table, so all words are exact.  A joined word occurs at most threshold times in
the training texts, so no key is hot.

Defined cases: null text counts as empty (one end token); rows that repeat a doc_id each get
a row; a null doc_id is in the training part; with no training text the base score is 0 and the
model predicts every bit with 1/2; extra columns are ignored.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrospark.llm.common import doc_remainder, materialize, mix64, release, ship, tidy

ship(__name__)

ORDERS = (1, 2, 3, 4, 5)
#: Places in a word that a gate tells apart: bytes since the last white space, at most the longest order.
PLACES = max(ORDERS) + 1
#: A passage starts where the hash of the ``MARK`` bytes before it is a multiple of ``EVERY`` (a power of 2); its context's bytes.
MARK, EVERY, MEMORY = 8, 32, 24
BLOCK = 1 << 19
#: Bytes of texts whose windows are made at once: their arrays stay in the cache and the memory is used again.
GROUP = 1 << 17
#: Rows that are taken from a batch at once.
ROWS = 1000
FAN = 64
APM_STEPS = 32
#: Bytes of text whose windows are asked for at once, and whose windows one task holds on average.
SHARE = 1 << 23
ASK_BYTES = 1 << 23
#: Windows that are predicted at once; Newton steps; weight of the starting weights.
SOME = 1 << 13
ROUNDS = 6
RIDGE = 1.0
#: Level of zstd in what is shuffled; bits of a passage's hash (it tells passages of one context apart).
LEVEL = 3
PASSAGE_BITS = 40


def _codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all positions (target in bits 40-47, then the preceding bytes) and the texts' first positions."""
    lead = b"\0" * 5
    joined = b"".join([x for t in texts for x in (lead, t, b"\xff")] + [b"\0\0"])
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)[:-1]])
    whole = _words(joined, "<u8")  # five bytes, the target, two more
    kept = np.ones(len(whole), bool)
    kept[((starts[1:] + 5 * np.arange(1, len(texts)))[:, None] - np.arange(1, 6)).ravel()] = False  # no target of the text before
    return whole[kept] & np.uint64((1 << 48) - 1), starts


def _words(data: bytes, kind: str) -> np.ndarray:
    """The eight bytes from every byte on, as numbers (of the same buffer, not aligned)."""
    return np.ndarray((max(len(data) - 7, 0),), kind, data, strides=(1,))


def _groups(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, windows, first positions), about ``GROUP`` bytes each; a text beyond two ``BLOCK`` is cut."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= GROUP or i == len(texts) - 1:
            code, starts = _codes(texts[first : i + 1])
            for b in range(0, len(code), 2 * BLOCK):
                z = min(b + 2 * BLOCK, len(code))
                lo = int(np.searchsorted(starts, b, "right")) - 1
                hi = int(np.searchsorted(starts, z, "left"))
                yield first + lo, code[b:z], np.maximum(starts[lo:hi] - b, 0)
            first, size = i + 1, 0


def _passages(code: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """First and last (exclusive) position, hashed context and hash of the passages of a group's windows.

    A passage ends at the next mark or the end of its text; the bytes before a text's first mark are in none.
    """
    byte, one = (code >> np.uint64(40)).astype(np.uint8), np.uint64(1)
    packed = _words(bytes(MARK) + byte.tobytes(), ">u8").astype(np.uint64)  # the MARK bytes before each position
    first = np.flatnonzero(mix64(packed[:-1]) & np.uint64(EVERY - 1) == 0)
    text = np.searchsorted(starts, first, "right") - 1
    deep = first - starts[text] >= MEMORY
    first, text = first[deep], text[deep]
    ends = np.append(starts[1:], len(code))[text]
    last = np.minimum(np.append(first[1:], len(code)), ends)
    key = np.zeros(len(first), np.uint64)
    for j in range(0, MEMORY, MARK):
        key = mix64(key + packed[first - j] + one)
    # polynomial hash modulo 2^64 of scrambled bytes, by differences of running sums
    power, back = _powers()
    running = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[byte] * power[: len(code)])])
    passage = mix64((running[last] - running[first]) * back[first] + (last - first).astype(np.uint64))
    return first, last, key, passage >> np.uint64(64 - PASSAGE_BITS)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = mix64(np.arange(1, 257).astype(np.uint64))


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse for a group of the largest size, made once per process."""
    first = np.ones(1, np.uint64)
    return tuple(np.cumprod(np.concatenate([first, np.full(2 * BLOCK, base)])) for base in (_BASE, _INVERSE))


def _level(n: np.ndarray) -> np.ndarray:
    """Class of a context's occurrences: 0, 1, 2-3, 4-15, more."""
    return (n > 0).astype(np.int64) + (n > 1) + (n > 3) + (n > 15)


LEVELS = 5


def _lower(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower() if text else b""  # bytes.lower changes A-Z only


def _stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + 0.4) / (n0 + 0.4))


def _confidence(n: np.ndarray) -> np.ndarray:
    return np.minimum((n > 0).astype(np.int64) + (n > 2) + (n > 12), 3)


class Mixer:
    """Gated weights and the adaptive probability map."""

    def __init__(self) -> None:
        gates = 8 * (len(ORDERS) + 1) * PLACES * 4
        self.weights = np.full((gates, len(ORDERS)), 0.3)
        centres = 1 / (1 + np.exp(-(np.arange(APM_STEPS) - APM_STEPS / 2 + 0.5) / 2))
        self.apm = np.stack([np.tile(1 - centres, (256, 1)), np.tile(centres, (256, 1))], axis=-1) * 4.0

    def predict(self, x: np.ndarray, seen: np.ndarray, conf: np.ndarray, bit_at: int, node: np.ndarray) -> tuple[np.ndarray, ...]:
        """Probability of a 1 (and gate, mixed probability, map cell) from stretched inputs x."""
        gate = (bit_at * (len(ORDERS) + 1) * PLACES + seen) * 4 + conf
        dot = np.clip((self.weights[gate] * x).sum(axis=1), -12, 12)
        mixed = 1 / (1 + np.exp(-dot))
        cell = np.clip((dot * 2 + APM_STEPS / 2).astype(np.int64), 0, APM_STEPS - 1)
        pair = self.apm[node, cell]
        refined = pair[:, 1] / pair.sum(axis=1)
        return np.clip((mixed + refined) / 2, 1e-5, 1 - 1e-5), gate, mixed, cell


# ---------------------------------------------------------------- exact counts of distinct windows


def _keys(code: np.ndarray, order: int) -> np.ndarray:
    """Context of ``order`` bytes (the last one first), then the target byte."""
    context = (code & np.uint64((1 << 40) - 1)) >> np.uint64(8 * (5 - order))
    return (context << np.uint64(8)) | (code >> np.uint64(40))


def _table(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the running total before each of them (and after the last)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[edge], np.concatenate([[0], np.cumsum(np.add.reduceat(n[order], edge))]) if len(keys) else np.zeros(1, np.int64)


def _low_tables(grams: np.ndarray, n: np.ndarray) -> list:
    """Tables of orders 1 and 2 from the counts of three-byte strings (windows without their oldest bytes)."""
    code = grams.astype(np.uint64) << np.uint64(24)
    return [_table(_keys(code, o), n.astype(np.int64)) for o in (1, 2)]


def _tables(low: list, code: np.ndarray, n: np.ndarray) -> list:
    """Tables of all orders from the windows of a task."""
    return [*low, *(_table(_keys(code, o), n) for o in ORDERS[2:])]


def _place(code: np.ndarray) -> np.ndarray:
    """Bytes between the last white space (or the text's start) and the target."""
    place, inside = np.zeros(len(code), np.int64), np.ones(len(code), bool)
    for j in range(1, PLACES):
        byte = (code >> np.uint64(40 - 8 * j)) & np.uint64(255)
        inside &= (byte != 0) & (byte != 32) & ((byte < 9) | (byte > 13))
        place += inside
    return place


def _bits(tables: list, code: np.ndarray, without_own: bool) -> Iterator[tuple]:
    """(bit position, node, bit, stretched inputs, longest order seen and place, its confidence) of every bit of the windows."""
    target = (code >> np.uint64(40)).astype(np.int64)
    keys = [_keys(code, o) & ~np.uint64(255) for o in ORDERS]
    count = lambda k, key: tables[k][1][np.searchsorted(tables[k][0], key)]
    low, high = [count(k, key) for k, key in enumerate(keys)], [count(k, key + np.uint64(256)) for k, key in enumerate(keys)]
    node, place = np.ones(len(code), np.int64), _place(code)
    for i in range(7, -1, -1):
        bit = (target >> i) & 1
        half = (((target >> (i + 1)) * 2 + 1) << i).astype(np.uint64)
        x, seen, conf = np.zeros((len(code), len(ORDERS))), np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        for k, key in enumerate(keys):
            mid = count(k, key | half)
            n0, n1 = mid - low[k], high[k] - mid
            if without_own:
                n0, n1 = n0 - (1 - bit), n1 - bit
            x[:, k] = _stretch(n0, n1)
            c = _confidence(n0 + n1)
            seen, conf = np.where(c > 0, k + 1, seen), np.where(c > 0, c, conf)
            low[k], high[k] = np.where(bit == 1, mid, low[k]), np.where(bit == 1, high[k], mid)
        yield i, node, bit, x, seen * PLACES + place, conf
        node = node * 2 + bit


def _by_context(code: np.ndarray) -> np.ndarray:
    """Order in which windows of like contexts, of every length, are neighbours: lookups then stay in the processor's cache."""
    return np.argsort(_keys(code, max(ORDERS)))


def _parts(code: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in range(0, len(code), SOME):
        yield code[b : b + SOME], n[b : b + SOME]


_UP = np.triu_indices(len(ORDERS))


def _slopes(mixer: Mixer, tables: list, code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per gate: cost, gradient and curvature of the weights over all occurrences (gates x 21)."""
    gates = len(mixer.weights)
    out = np.zeros((gates, 1 + len(ORDERS) + len(_UP[0])))
    for some, times in _parts(code, n):
        for i, node, bit, x, seen, conf in _bits(tables, some, True):
            _, gate, mixed, _ = mixer.predict(x, seen, conf, i, node)
            slope, bend = times * (bit - mixed), times * mixed * (1 - mixed)
            columns = [-times * np.log(np.where(bit == 1, mixed, 1 - mixed)), *(slope * x[:, k] for k in range(len(ORDERS)))]
            columns += [bend * x[:, a] * x[:, b] for a, b in zip(*_UP, strict=True)]
            for c, v in enumerate(columns):
                out[:, c] += np.bincount(gate, v, gates)
    return out


def _cells(mixer: Mixer, tables: list, code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Occurrences in each cell of the probability map."""
    out = np.zeros(mixer.apm.size)
    for some, times in _parts(code, n):
        for i, node, bit, x, seen, conf in _bits(tables, some, True):
            cell = mixer.predict(x, seen, conf, i, node)[3]
            out += np.bincount((node * APM_STEPS + cell) * 2 + bit, times, mixer.apm.size)
    return out.reshape(mixer.apm.shape)


def _costs(mixer: Mixer, tables: list, code: np.ndarray) -> np.ndarray:
    """Cost in bits of each window."""
    out = np.zeros(len(code))
    for b in range(0, len(code), SOME):
        for i, node, bit, x, seen, conf in _bits(tables, code[b : b + SOME], False):
            p = mixer.predict(x, seen, conf, i, node)[0]
            out[b : b + SOME] -= np.log2(np.where(bit == 1, p, 1 - p))
    return out


def newton(sums, rounds: int = ROUNDS) -> Mixer:
    """Mixer whose weights come from ``rounds`` steps; ``sums(mixer)`` gives :func:`_slopes` over all windows.

    A gate whose cost rose takes half of its last step instead.
    """
    mixer = Mixer()
    start = mixer.weights.copy()
    best, cost, step = start.copy(), np.full(len(start), np.inf), np.zeros(start.shape)
    for _ in range(rounds + 1):
        got = sums(mixer)
        now = got[:, 0] + RIDGE / 2 * ((mixer.weights - start) ** 2).sum(axis=1)
        good = now <= cost
        curve = np.zeros((len(start), len(ORDERS), len(ORDERS)))
        curve[:, _UP[0], _UP[1]] = curve[:, _UP[1], _UP[0]] = got[:, 1 + len(ORDERS) :]
        slope = got[:, 1 : 1 + len(ORDERS)] - RIDGE * (mixer.weights - start)
        ahead = np.linalg.solve(curve + RIDGE * np.eye(len(ORDERS)), slope[:, :, None])[:, :, 0]
        best[good], cost[good] = mixer.weights[good], now[good]
        step = np.where(good[:, None], ahead, step / 2)
        mixer.weights = best + step
    mixer.weights = best
    return mixer


def _planes(*columns: np.ndarray) -> bytes:
    """Columns of equal length, the first one sorted, as compressed byte planes."""
    columns = (np.diff(columns[0], prepend=columns[0].dtype.type(0)), *columns[1:])
    data = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, c.itemsize).T).tobytes() for c in columns)
    return len(data).to_bytes(8, "little") + _zstd().compress(data, asbytes=True)


def _zstd() -> pa.Codec:
    return pa.Codec("zstd", LEVEL)


def _from_planes(blob: bytes, *types: str) -> list[np.ndarray]:
    data = np.frombuffer(_zstd().decompress(blob[8:], int.from_bytes(blob[:8], "little")), np.uint8)
    sizes = [np.dtype(t).itemsize for t in types]
    n, at, out = len(data) // sum(sizes), 0, []
    for t, z in zip(types, sizes, strict=True):
        out.append(np.ascontiguousarray(data[at : at + n * z].reshape(z, n).T).view(t).reshape(-1))
        at += n * z
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


def _merged(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows in order, their counts added up."""
    code, total = _table(code, n)
    return code, np.diff(total)


def _memories(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct (context, passage) in order of context, with training and other occurrences added up."""
    key, passage, n, others = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((passage, key))
    key, passage, n, others = key[order], passage[order], n[order], others[order]
    edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (passage[1:] != passage[:-1])])) if len(key) else np.zeros(0, np.int64)
    if not len(edge):
        return key, passage, n, others
    return key[edge], passage[edge], np.add.reduceat(n, edge), np.add.reduceat(others, edge)


def ask(rows: DataFrame, total: int) -> DataFrame:
    """(task, share, windows, passages): distinct windows and passages of each share of ``rows`` (share, text, held_out).

    Each with its training occurrences, passages with those in other texts too.
    """
    bins = max(4, total // ASK_BYTES)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, held, told, size = None, [], [], 0

        def dealt(task: np.ndarray, columns: tuple[np.ndarray, ...]) -> dict[int, bytes]:
            order = np.argsort(task.astype(np.min_scalar_type(bins)), kind="stable")  # a radix sort of small numbers
            task, columns = task[order], [c[order] for c in columns]
            edge = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1], [True]])) if len(task) else [0]
            return {int(task[a]): _planes(*(c[a:z] for c in columns)) for a, z in zip(edge[:-1], edge[1:], strict=True)}

        def flush():
            code, n = _merged(*(np.concatenate(c) for c in zip(*held, strict=True)))
            windows = dealt((mix64((code >> np.uint64(16)) & np.uint64(0xFFFFFF)) % np.uint64(bins)).astype(np.int64), (code, n))
            kept = _memories(told)
            passages = dealt((kept[0] % np.uint64(bins)).astype(np.int64), kept)
            tasks = sorted(windows.keys() | passages.keys())
            blobs = [pa.array([d.get(t) for t in tasks], pa.binary()) for d in (windows, passages)]
            return pa.RecordBatch.from_arrays([pa.array(tasks, pa.int64()), pa.array([share] * len(tasks), pa.int64()), *blobs], ["task", "share", "windows", "passages"])

        for batch in (whole.slice(b, ROWS) for whole in batches for b in range(0, whole.num_rows, ROWS)):
            shares, out = batch.column("share").to_numpy(), batch.column("held_out").to_pylist()
            texts = [_lower(t) for t in batch.column("text").to_pylist()]
            edge = np.flatnonzero(np.concatenate([[True], shares[1:] != shares[:-1], [True]]))
            for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if held and (shares[a] != share or size >= 2 * SHARE):
                    yield flush()
                    held, told, size = [], [], 0
                share = int(shares[a])
                for trained in (True, False):
                    for _, code, starts in _groups([t for t, o in zip(texts[a:z], out[a:z], strict=True) if o != trained]):
                        window, n = np.unique(code, return_counts=True)
                        held.append((window, n.astype(np.int64) if trained else np.zeros(len(n), np.int64)))
                        _, _, key, passage = _passages(code, starts)
                        each = np.ones(len(key), np.int64)
                        told.append((key, passage, each * trained, each * (not trained)))
                        size += len(code)
        if held:
            yield flush()

    return rows.select("share", "text", "held_out").mapInArrow(tidy(send), "task bigint, share bigint, windows binary, passages binary")


def remember(asked: DataFrame) -> DataFrame:
    """(share, passages): known contexts' passages with c and C, of every share that asked.

    Rows without a share hold, for a class of C, how many training passages have a context that other
    occurrences know (``seen``) and how many of these it remembers (``hits``).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [tuple(_from_planes(bytes(b), "<u8", "<u8", "<i8", "<i8")) for b in pdf["passages"]]
        key, passage, n, _ = _memories(parts)
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        context, total = key[edge], np.add.reduceat(n, edge)
        level = _level(np.repeat(total, np.diff(np.append(edge, len(key)))) - 1)
        seen, hits = np.bincount(level, n, LEVELS), np.bincount(level, n * (n > 1), LEVELS)
        out = [(None, None, k, int(seen[k]), int(hits[k])) for k in range(1, LEVELS) if seen[k]]
        pair = _pair(key, passage)
        order = np.argsort(pair)
        pair, count = pair[order], n[order]
        for share, (k, p, _, others) in zip(pdf["share"], parts, strict=True):
            c, every = count[np.searchsorted(pair, _pair(k, p))], total[np.searchsorted(context, k)]
            known = (every > 1) | ((every > 0) & (others > 0))
            if known.any():
                wanted = _pair(k, p)[known]
                order = np.argsort(wanted)
                out.append((share, _planes(wanted[order], c[known][order], every[known][order]), None, None, None))
        release()
        return pd.DataFrame(out, columns=["share", "passages", "level", "seen", "hits"], dtype=object)

    told = asked.where(F.col("passages").isNotNull()).select("task", "share", "passages")
    return told.groupBy("task").applyInPandas(run, "share bigint, passages binary, level int, seen bigint, hits bigint")


def _pair(key: np.ndarray, passage: np.ndarray) -> np.ndarray:
    return mix64(key + mix64(passage))


def memory_weights(remembered: DataFrame) -> np.ndarray:
    """Weight of the memory for each class of C: how often a known context remembers (a row a class at most)."""
    weights = np.full(LEVELS, 0.5)
    for r in remembered.where(F.col("share").isNull()).groupBy("level").agg(F.sum("seen").alias("seen"), F.sum("hits").alias("hits")).collect():
        weights[r["level"]] = (r["hits"] + 1) / (r["seen"] + 2)
    return weights


def _heard(blobs) -> tuple[np.ndarray, np.ndarray]:
    parts = [_from_planes(bytes(b), "<u8", "<i8") for b in blobs]
    return _merged(np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts]))


def _summed(trained: DataFrame, run) -> np.ndarray | None:
    """Sum of ``run(windows, counts)``, an array of a fixed size, over all tasks' training windows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for blob in batch.column("windows").to_pylist():
                got = run(*_from_planes(blob, "<u8", "<i8"))
                out = got if out is None else out + got
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([pickle.dumps(out)], pa.binary())], ["part", "blob"])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "blob": [pickle.dumps(sum(pickle.loads(bytes(b)) for b in pdf.sort_values("part")["blob"]))]})

    schema, parts = "part int, blob binary", trained.rdd.getNumPartitions()
    sums = trained.mapInArrow(tidy(each), schema)
    while parts > FAN:
        sums = sums.groupBy(F.floor(F.col("part") / FAN).cast("int").alias("part")).applyInPandas(add, schema)
        parts = -(-parts // FAN)
    got = [pickle.loads(bytes(r["blob"])) for r in sorted(sums.collect(), key=lambda r: r["part"])]  # FAN rows at most
    return sum(got) if got else None


def train(asked: DataFrame) -> dict:
    """Weights, probability map and tables of orders 1 and 2, from all training windows of ``asked``."""

    def own(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        code, n = _heard(pdf["windows"])
        return pd.DataFrame({"windows": [_planes(code[n > 0], n[n > 0])] if n.any() else []}, dtype=object)

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for blob in pdf["windows"]:
                code, n = _from_planes(bytes(blob), "<u8", "<i8")
                gram, n = _merged(code >> np.uint64(24), n)
                yield pd.DataFrame({"gram": gram.astype(np.int64), "n": n})

    trained = materialize(asked.where(F.col("windows").isNotNull()).select("task", "windows").groupBy("task").applyInPandas(own, "windows binary"))
    found = trained.mapInPandas(tidy(grams), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    low = _low_tables(found["gram"].to_numpy(np.int64), found["n"].to_numpy(np.int64))
    shared = asked.sparkSession.sparkContext.broadcast(low)

    def total(of, mixer: Mixer, empty: np.ndarray) -> np.ndarray:
        state = vars(mixer)

        def run(code: np.ndarray, n: np.ndarray) -> np.ndarray:
            model = Mixer()
            vars(model).update(state)
            order = _by_context(code)
            code, n = code[order], n[order]
            return of(model, _tables(shared.value, code, n), code, n)

        got = _summed(trained, run)
        return empty if got is None else got

    mixer = newton(lambda m: total(_slopes, m, np.zeros((len(m.weights), 1 + len(ORDERS) + len(_UP[0])))))
    mixer.apm = mixer.apm + total(_cells, mixer, np.zeros(mixer.apm.shape))
    shared.unpersist()
    return {"low": low, "mixer": vars(mixer)}


def answer(asked: DataFrame, model: dict) -> DataFrame:
    """(share, costs): cost of every window that a share asked for."""
    shared = asked.sparkSession.sparkContext.broadcast(model)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        code, n = _heard(pdf["windows"])
        mixer = Mixer()
        vars(mixer).update(shared.value["mixer"])
        trained = n > 0
        order, cost = _by_context(code), np.zeros(len(code), np.float32)
        cost[order] = _costs(mixer, _tables(shared.value["low"], code[trained], n[trained]), code[order])
        blobs = []
        for b in pdf["windows"]:
            wanted = _from_planes(bytes(b), "<u8", "<i8")[0]
            blobs.append(_planes(wanted, cost[np.searchsorted(code, wanted)]))
        release()
        return pd.DataFrame({"share": pdf["share"], "costs": pd.Series(blobs, dtype=object, index=pdf.index)})

    told = asked.where(F.col("windows").isNotNull()).select("task", "share", "windows")
    return told.groupBy("task").applyInPandas(run, "share bigint, costs binary")


def _lookup(known: np.ndarray, cost: np.ndarray):
    """Function from windows, all of them in ``known`` (distinct), to their costs.

    A window's cost stands in a table at the window's hash; windows that share a place are looked up by themselves.
    """
    bits = max(8, int(8 * len(known)).bit_length())
    place = lambda code: (code * _BASE) >> np.uint64(64 - bits)
    at = place(known)
    last = np.zeros(1 << bits, np.int32)
    last[at] = np.arange(len(known), dtype=np.int32)
    lost = np.zeros(1 << bits, bool)
    lost[at[last[at] != np.arange(len(known), dtype=np.int32)]] = True  # another window came later
    shared = lost[at]
    table = np.zeros(1 << bits, np.float32)
    table[at] = np.where(shared, np.float32(np.nan), cost)
    rest, rest_cost = pd.Index(known[shared]), cost[shared]

    def of(code: np.ndarray) -> np.ndarray:
        out = table[place(code)]
        odd = np.flatnonzero(np.isnan(out))
        out[odd] = rest_cost[rest.get_indexer(code[odd])]
        return out

    return of


def text_bits(texts: list[bytes], trained: np.ndarray, costs: list[bytes], passages: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Cost in bits of each text (1 in ``trained``: it is a training text), from the answers to its share."""
    parts = [_from_planes(b, "<u8", "<f4") for b in costs]
    cost_of = _lookup(np.concatenate([c for c, _ in parts]), np.concatenate([c for _, c in parts]))
    parts = [_from_planes(b, "<u8", "<i8", "<i8") for b in passages]
    pairs, count, every = (np.concatenate([p[j] for p in parts]) if parts else np.zeros(0, np.int64) for j in range(3))
    order = np.argsort(pairs)
    pairs, count, every = pairs[order], count[order], every[order]
    out = np.zeros(len(texts))
    for first, code, starts in _groups(texts):
        each = cost_of(code).astype(np.float64)
        out[first : first + len(starts)] += np.add.reduceat(each, starts)
        if len(pairs):
            a, z, key, passage = _passages(code, starts)
            pair = _pair(key, passage)
            at = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
            text = first + np.searchsorted(starts, a, "right") - 1
            own = trained[text]
            c, total = count[at] - own, every[at] - own
            use = (pairs[at] == pair) & (total > 0)
            a, z, text, c, total = a[use], z[use], text[use], c[use], total[use]
            running = np.concatenate([[0.0], np.cumsum(each)])
            plain, weight = running[z] - running[a], weights[_level(total)]
            with np.errstate(divide="ignore"):
                mixed = -np.logaddexp2(np.log2(weight * c / total), np.log2(1 - weight) - plain)
            np.add.at(out, text, mixed - plain)
    return out


def _packed(rows: DataFrame) -> DataFrame:
    """(share, texts): rows of a share as compressed Arrow streams, which shuffle at a fraction of the texts' size."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=_zstd())
        for batch in (whole.slice(b, ROWS) for whole in batches for b in range(0, whole.num_rows, ROWS)):
            shares = batch.column("share").to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], shares[1:] != shares[:-1], [True]]))
            for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as stream:
                    stream.write_batch(batch.slice(a, z - a))
                yield pa.RecordBatch.from_arrays([pa.array([shares[a]], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["share", "texts"])

    return rows.select("share", "rid", "doc_id", "text", "held_out").mapInArrow(tidy(pack), "share bigint, texts binary")


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) of all texts; each task combines its words before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(b, ROWS) for whole in batches for b in range(0, whole.num_rows, ROWS)):
            words = pc.list_flatten(pc.ascii_split_whitespace(pc.ascii_lower(batch.column(0))))  # parts at 0x20 and 0x09-0x0D
            found = pc.value_counts(words.filter(pc.greater(pc.binary_length(words), 0)))
            yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.binary()), found.field(1)], ["word", "c"])

    return docs.select("text").mapInArrow(tidy(count), "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def is_held_out():
    return F.coalesce(doc_remainder("doc_id", 7) == 2, F.lit(False))


def score_documents(docs: DataFrame, common_words: int = 200_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row."""
    spark = docs.sparkSession
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text", is_held_out().alias("held_out")))
    n_rows, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    per_share = max(1, SHARE * n_rows // (total + n_rows + 1))  # rows
    share = F.shiftright("rid", 33) * F.lit(1 << 33) + F.floor(F.col("rid").bitwiseAND(F.lit((1 << 33) - 1)) / F.lit(per_share))
    rows = rows.withColumn("share", share.cast("bigint"))
    training = rows.where(~F.col("held_out"))
    asked = materialize(ask(rows, int(total)))
    remembered = materialize(remember(asked))
    weights = memory_weights(remembered)
    known = remembered.where(F.col("share").isNotNull()).select("share", F.lit(None).cast("binary").alias("costs"), "passages")
    answers = answer(asked, train(asked)).withColumn("passages", F.lit(None).cast("binary")).unionByName(known)

    counts = materialize(word_counts(training))
    n_docs = training.count()
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_all, v_all = int(tokens) + n_docs, int(distinct) + (n_docs > 0)
    unit = float(np.log10(n_all + v_all + 1))
    end = float(np.log10(n_docs + 1))
    bound, room = None, common_words  # smallest count of a common word: as many counts from the top as fit
    for r in counts.where("c > 1").groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(common_words).collect():
        room -= r["n"]
        if room < 0:
            break
        bound = r["c"]
    top = counts.where(F.col("c") >= bound).toPandas() if bound else pd.DataFrame({"word": [], "c": []})
    common = spark.sparkContext.broadcast({bytes(w): float(np.log10(c + 1)) for w, c in zip(top["word"], top["c"], strict=True)})

    def run(packed: pa.Table, told: pa.Table) -> pa.Table:
        get = common.value.get
        batch = pa.concat_tables(pa.ipc.open_stream(b.as_buffer()).read_all() for b in packed.column("texts"))
        texts = [_lower(t) for t in batch.column("text").to_pylist()]
        trained = 1 - batch.column("held_out").to_numpy().astype(np.int64)
        costs, passages = (told.column(c).drop_null().to_pylist() for c in ("costs", "passages"))
        bits = text_bits(texts, trained, costs, passages, weights)
        n_tokens, known, sums, rare = [], [], [], []
        for t in texts:
            words = t.split()
            found = list(map(get, words))
            odd = [w for w, f in zip(words, found, strict=True) if f is None] if None in found else []
            n_tokens.append(len(words) + 1)
            known.append(len(words) - len(odd))
            sums.append(float(sum(filter(None, found))))  # a logarithm of 2 or more is not 0
            rare.append(odd)
        made = [
            pa.array(n_tokens, pa.int64()),
            pa.array(known, pa.int64()),
            pa.array(sums, pa.float64()),
            pa.array([len(t) + 1 for t in texts], pa.int64()),
            pa.array(bits, pa.float64()),
            pa.array(rare, pa.list_(pa.binary())),
        ]
        names = ["rid", "doc_id", "held_out", "n_tokens", "n_common", "log_common", "n_bytes", "bits", "rare"]
        release()
        return pa.Table.from_arrays([batch.column("rid"), batch.column("doc_id"), batch.column("held_out"), *made], names)

    id_type = rows.schema["doc_id"].dataType.simpleString()
    scored = _packed(rows).groupBy("share").cogroup(answers.groupBy("share")).applyInArrow(run,
        f"rid bigint, doc_id {id_type}, held_out boolean, n_tokens bigint, n_common bigint, log_common double, n_bytes bigint, bits double, rare array<binary>",
    )
    scored = materialize(scored)
    looked_up = (
        scored.select("rid", F.explode("rare").alias("word"))
        .join(counts, "word")
        .groupBy("rid")
        .agg(F.count("*").alias("n_rare"), F.sum(F.log10(F.col("c") + 1)).alias("log_rare"))
    )
    return scored.join(looked_up, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_common") + F.coalesce("n_rare", F.lit(0)) + F.lit(int(n_docs > 0))).alias("n_known"),
        F.lit(n_all).cast("bigint").alias("train_tokens"),
        (F.col("log_common") + F.coalesce("log_rare", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        (-F.col("bits") * F.lit(float(np.log10(2.0)))).alias("score"),
        (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )
