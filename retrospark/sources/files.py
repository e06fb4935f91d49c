"""File-level sources and sinks: optional tables, feature catalogue, input manifest, table/report sinks."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# functions for executors go by value: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def optional_table(spark: SparkSession, path: str, schema_ddl: str, fmt: str = "parquet") -> DataFrame:
    """SRC3: the table at ``path`` or an empty table of ``schema_ddl`` when it does not exist."""
    try:
        reader = spark.read.format(fmt)
        if fmt == "csv":
            reader = reader.option("header", True).option("inferSchema", True)
        return reader.load(path)
    except AnalysisException as e:  # PATH_NOT_FOUND
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], schema_ddl)
        raise


def feature_catalog(spark: SparkSession, root: str, names: tuple[str, ...] = ("single_shot", "extract_set_1", "extract_set_2", "extract_set_3"), baseline: str = "single_shot") -> dict[str, DataFrame]:
    """SRC4: named feature tables under ``root``; the baseline table is mandatory, others optional."""
    out = {}
    for n in names:
        try:
            out[n] = spark.read.parquet(f"{root}/{n}")
        except AnalysisException:
            if n == baseline:
                raise FileNotFoundError(f"baseline feature table missing: {root}/{n}")
    return out


def read_context(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: a prior stage's report record (JSON lines)."""
    return spark.read.json(path)


def input_manifest(spark: SparkSession, path_glob: str, whole: int = 256 << 20, chunk: int = 8 << 20) -> DataFrame:
    """SRC7: one row per input file: path, name, suffix, size, modification time, SHA-256 of the bytes.

    Files of up to ``whole`` bytes are read by Spark and hashed in the JVM; larger ones never sit in a cell:
    a task opens each through its file system (local, HDFS, S3, GCS) and hashes it in pieces of ``chunk`` bytes.
    """
    files = spark.read.format("binaryFile").load(path_glob)
    facts = ["path", "length", "modificationTime"]

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(sha256=[_sha256(path, chunk) for path in pdf["path"]])

    small = files.where(F.col("length") <= whole).select(*facts, F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole).select(*facts).mapInPandas(
        hashed, "path string, length bigint, modificationTime timestamp, sha256 string"
    )
    name = F.element_at(F.split("path", "/"), -1)
    return small.unionByName(large).select(
        "path",
        name.alias("file_name"),
        F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("suffix"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_time"),
        "sha256",
    )


def _sha256(path: str, chunk: int) -> str:
    """SHA-256 of a file's bytes, at most ``chunk`` of them in memory."""
    scheme, _, rest = path.partition(":")
    system, at = (fs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(path)
    digest = hashlib.sha256()
    with system.open_input_stream(at, buffer_size=0) as stream:
        while piece := stream.read(chunk):
            digest.update(piece)
    return digest.hexdigest()


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """SNK1: overwrite a table (Parquet by default; CSV with header for hand-off)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_report(df: DataFrame, path: str) -> None:
    """SNK2: a small report table (one or few rows) as JSON lines in a single file."""
    df.repartition(1).write.mode("overwrite").json(path)  # the report's stages keep their own parallelism
