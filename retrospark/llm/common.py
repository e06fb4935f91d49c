"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import hashlib
import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrospark.session import ensure_checkpoint_dir

MASK32 = 0xFFFFFFFF


def ship(module: str) -> None:
    """Send functions of this module to executors by value, so that they need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def once(shared, build):
    """The object that ``build`` makes of a broadcast dict, made once per worker process and kept beside it."""
    state = shared.value
    if "_made" not in state:
        state["_made"] = build(**state)
    return state["_made"]


def release() -> None:
    """Give freed memory back to the system, so that a worker that is used again starts small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidy(run):
    """A map function over batches that releases memory when its task is over."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` below the shared folder of ``spark.checkpoint.dir`` and read it back (lineage is cut)."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_remainder(doc_id, modulus: int):
    """crc32(doc_id as text) mod ``modulus``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(modulus)


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_lower_bytes() -> bytes:
    """Byte table for ``bytes.translate``: A-Z to a-z, everything else as it is."""
    t = bytearray(range(256))
    for c in range(65, 91):
        t[c] = c + 32
    return bytes(t)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values (multiply-xorshift finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def join_split(rows: DataFrame, facts: DataFrame, key: str, weight: str, most: int = 10_000) -> DataFrame:
    """``rows`` left-joined with ``facts`` (one row a key) without gathering the rows of a common key in one task.

    ``weight`` is the number of rows that a key has.  Keys with a share of 1 / ``most`` of all rows or
    more number at most ``most``, so their facts are broadcast; the others meet by shuffle.  Both
    tables are read twice: pass written ones.
    """
    total = facts.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    hot = F.col(weight) >= max(1000, total // most + 1)
    few = facts.where(hot)
    common = rows.join(F.broadcast(few), key, "inner")
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(facts.where(~hot), key, "left")
    return common.unionByName(rest)
