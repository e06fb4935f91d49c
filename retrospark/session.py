"""Session helpers.

On a cluster the session is given; :func:`ensure_checkpoint_dir` only fills in
``spark.checkpoint.dir`` when the cluster did not name one (tests, local runs).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "retrospark") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # split a hot entity in the reference-date join even though the entity aggregates
        # downstream then need their own (partially aggregated, hence small) shuffle
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.retrospark.fixture.partitions", str(cpus) if str(cpus).isdigit() else str(os.cpu_count() or 8))
        .config("spark.driver.memory", os.environ.get("RETROSPARK_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


# Settings the library expects on a cluster (applied by ``local_session`` for tests/bench).
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # start wide and let AQE coalesce: ~200 MB per shuffle partition after coalescing
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200m",
    "spark.sql.files.maxPartitionBytes": "256m",
    # set spark.sql.shuffle.partitions to about (largest shuffle bytes / 200 MB), e.g. 20000 for 4 TB
}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a scratch one only when none is configured."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (Connect: the server owns the checkpoint folder)
        return spark.conf.get("spark.checkpoint.dir", "")
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:  # only outside a cluster (tests, local runs): a scratch folder of our own
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="retrospark-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf
