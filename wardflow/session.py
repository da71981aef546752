"""Spark session defaults for the library.

The reports are plain DataFrame plans, so the only settings that matter are
the ones that change *semantics* (time zone, ANSI arithmetic) and the ones
that let Spark adapt the physical plan at run time (AQE).  On a cluster the
session is owned by the caller; ``configure`` only fills in what is unset.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that change results: the oracle and the tests assume them.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

# Settings that only change the physical plan.
ADAPTIVE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Size-checked broadcast: Spark broadcasts a join side only when its
    # estimated (static) or measured (AQE) size is under this limit and
    # falls back to a shuffle join above it.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the semantic settings and any adaptive setting left unset."""
    for key, value in SEMANTIC_CONF.items():
        spark.conf.set(key, value)
    for key, value in ADAPTIVE_CONF.items():
        try:
            if spark.conf.get(key, None) is None:
                spark.conf.set(key, value)
        except Exception:  # not settable in this deployment; keep its value
            pass
    ensure_checkpoint_dir(spark)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "wardflow") -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("WARDFLOW_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # a long local session (tests, bench) frees old shuffle files and
        # broadcasts sooner than the 30 min default
        .config("spark.cleaner.periodicGC.interval", "5min")
    )
    for key, value in {**SEMANTIC_CONF, **ADAPTIVE_CONF}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the platform to shared storage and is used
    as is.  Only when it is unset (local tests) do we point it at a fresh
    scratch folder.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a Spark Connect session: the server owns the setting
        return spark.conf.get("spark.checkpoint.dir", None) or ""
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="wardflow-ckpt-")
    sc.setCheckpointDir(path)
    return path
