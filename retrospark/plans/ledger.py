"""Run ledger: which stages of a run are finished, with the row counts of their tables.

A stage is finished once its marker is written, which happens after all its tables are.  The marker
holds, per table, path, rows and schema, a random id of this commit, and a key made of the run's
configuration, its input and the commit of the stage before.  A later run over the same folder
takes a stage's tables as they are if the key agrees and every table still has its rows and
schema; else the stage runs again and, since its commit changes, all stages after it do.

Everything is Parquet below the run's output folder, so it works in any store that Spark writes to.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..sources.files import write_table

MARKER_DDL = "table string, path string, rows bigint, schema string, commit string, key string"


def digest(*parts: object) -> str:
    return hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()


class RunLedger:
    def __init__(self, spark: SparkSession, root: str, *identity: object):
        """``identity``: what the run depends on (configuration, input)."""
        self.spark, self.root = spark, root.rstrip("/")
        self.key = digest(*identity)
        self.reused: list[str] = []

    def _marker(self, stage: str) -> str:
        return f"{self.root}/_ledger/{stage}"

    def _read(self, path: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(path)
        except AnalysisException:  # no such folder, or none with a whole file
            return None

    def finished(self, stage: str) -> dict[str, DataFrame] | None:
        """The stage's tables, or None if it has to run."""
        marker = self._read(self._marker(stage))
        rows = marker.collect() if marker is not None and marker.columns else []  # a row a table
        if not rows or any(r["key"] != self.key for r in rows):
            return None
        tables = {}
        for r in rows:
            df = self._read(r["path"])
            if df is None or df.schema.simpleString() != r["schema"] or df.count() != r["rows"]:
                return None
            tables[r["table"]] = df
        self.key = digest(self.key, rows[0]["commit"])
        self.reused.append(stage)
        return tables

    def commit(self, stage: str, tables: dict[str, DataFrame], folder: str, written: tuple[str, ...] = ()) -> dict[str, DataFrame]:
        """Write the stage's tables (but those in ``written``, which are in ``folder`` already), then its marker."""
        commit, rows, out = uuid.uuid4().hex, [], {}
        for name, df in tables.items():
            path = f"{folder}/{name}"
            if name not in written:
                write_table(df, path)
            out[name] = self.spark.read.parquet(path)
            rows.append((name, path, out[name].count(), out[name].schema.simpleString(), commit, self.key))
        write_table(self.spark.createDataFrame(rows, MARKER_DDL).coalesce(1), self._marker(stage))
        self.key = digest(self.key, commit)
        return out

    def run(self, stage: str, build: Callable[[], dict[str, DataFrame]], folder: str, written: tuple[str, ...] = (), skip: tuple[str, ...] = ()) -> dict[str, DataFrame]:
        """The tables of a stage: those of a finished one, else built, written and read back (``skip``: not kept)."""
        done = self.finished(stage)
        if done is not None:
            return done
        built = build()
        out = self.commit(stage, {k: v for k, v in built.items() if k not in skip}, folder, written)
        for name in skip:  # helpers that were kept in memory while the stage was written
            if name in built:
                built[name].unpersist()
        return out
