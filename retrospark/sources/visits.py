"""Visit-record sources.

* :func:`read_records` - CSV / Parquet / JSON by suffix (SRC1/SRC2), explicit schema optional.
* :func:`fixture_visits` - the deterministic ``visits`` adapter over the TPC-H-ish test tables
  (lineitem x orders x customer x nation x part).  Used by tests, the query catalogue and bench.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import CleanSchema, CohortConfig, RawSchema

# Column roles of the fixture adapter: the four lineitem keys are a total order for ties.
FIXTURE_ORDER_KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
FIXTURE_RAW = RawSchema(order_keys=FIXTURE_ORDER_KEYS, quasi_identifiers=("subdistrict",))
FIXTURE_COHORT = CohortConfig(schema=FIXTURE_RAW)
FIXTURE_CLEAN = CleanSchema(order_keys=FIXTURE_ORDER_KEYS, quasi_identifiers=("subdistrict",))


def read_records(spark: SparkSession, path: str, schema: StructType | None = None, required: list[str] | None = None) -> DataFrame:
    """Read a visit table; the file suffix picks the reader, an unknown suffix raises."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if suffix == ".csv":
        df = reader.option("header", True).option("encoding", "UTF-8").option("nullValue", "").csv(path)
    elif suffix in (".parquet", ""):
        df = reader.parquet(path)
    elif suffix in (".json", ".jsonl"):
        df = reader.json(path)
    else:
        raise ValueError(f"Unsupported input file type: {path}")
    if required:
        missing = [c for c in required if c not in df.columns]
        if missing:
            raise KeyError(f"Missing required columns: {missing}")
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _flag(cond) -> F.Column:
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def fixture_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``visits`` = lineitem x orders x customer x nation x part, mapped to visit columns."""
    li = table(spark, sf_dir, "lineitem")
    # Test files may hold a single row group (one input split); a session may ask to spread it.
    spread = spark.conf.get("spark.retrospark.fixture.partitions", None)
    if spread:
        li = li.repartition(int(spread))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    # the narrow tables first: what is shuffled by customer are orders, not their lines
    orders = o.join(c.join(F.broadcast(n), F.col("c_nationkey") == n.n_nationkey), F.col("o_custkey") == c.c_custkey)
    j = li.join(orders, li.l_orderkey == F.col("o_orderkey")).join(p, F.col("l_partkey") == p.p_partkey)
    letters = F.lit("ABCDEFGHIJKLMNOPQRST")
    c1 = F.concat(
        F.substring(letters, (F.col("l_partkey") % 20).cast("int") + 1, 1),
        F.lpad((F.col("l_orderkey") % 100).cast("string"), 2, "0"),
    )
    c2 = F.concat(
        F.substring(letters, (F.col("l_suppkey") % 20).cast("int") + 1, 1),
        F.lpad((F.col("l_partkey") % 100).cast("string"), 2, "0"),
    )
    ln = F.col("l_linenumber")
    lab = ln <= 3
    principal = (
        F.when(ln % 3 == 0, c1)
        .when(ln % 3 == 1, F.concat(c1, F.lit("."), ln.cast("string")))
        .otherwise(F.concat(c1, ln.cast("string")))
    )
    return j.select(
        F.col("o_custkey").alias("hn"),
        F.col("l_shipdate").alias("vstdate"),
        principal.alias("PrincipleDiagnosis"),
        F.when(F.col("l_returnflag") != "N", c2).alias("ComorbidityDiagnosis"),
        (1 + F.col("o_custkey") % 2).alias("sex"),
        (20 + F.col("o_custkey") % 70).alias("age"),
        (ln % 4).alias("smoke"),
        (F.col("l_suppkey") % 4).alias("drinking"),
        (F.col("l_partkey") % 3).alias("AF"),
        (90 + 2 * F.col("l_quantity")).alias("bps"),
        (50 + F.col("l_quantity")).alias("bpd"),
        (18 + 200 * F.col("l_discount")).alias("bmi"),
        F.when(lab, F.col("l_extendedprice") / 1000).alias("HDL"),
        F.when(lab, F.col("l_extendedprice") / 250).alias("LDL"),
        F.when(lab, F.col("l_extendedprice") / 50).alias("Triglyceride"),
        F.when(lab, 70 + 1000 * F.col("l_tax")).alias("FBS"),
        F.when(lab, 120 + 4 * F.col("l_quantity")).alias("Cholesterol"),
        F.when(lab, F.col("o_totalprice") / 2500).alias("eGFR"),
        F.when(lab, 10 * F.col("l_discount")).alias("Creatinine"),
        _flag(F.col("o_orderstatus") == "F").alias("heart_disease"),
        _flag(F.col("l_returnflag") == "R").alias("hypertension"),
        _flag(F.col("l_returnflag") == "A").alias("diabetes"),
        _flag(F.col("l_linestatus") == "O").alias("Statin"),
        _flag(F.col("l_linestatus") == "F").alias("Gemfibrozil"),
        _flag(F.col("l_quantity") > 25).alias("Antihypertensive_flag"),
        F.col("n_name").alias("subdistrict"),
        F.col("p_name").alias("medication"),
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
    )
