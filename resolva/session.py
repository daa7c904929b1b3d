"""Spark session helpers.

The library never creates its own cluster settings on top of an existing
session: `get_spark` only fills in defaults that are unset, so a cluster's
`spark.checkpoint.dir`, shuffle sizing and memory settings always win.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Defaults for a local session (tests, bench). A cluster session keeps its own.
LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # CSV sources in cp1252 need the legacy charset list (Spark 4 refuses it otherwise).
    "spark.sql.legacy.javaCharsets": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "resolva") -> SparkSession:
    """Return the active session, or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or os.environ.get("RESOLVA_MASTER", "local[8]"))
    for k, v in LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    builder = builder.config("spark.driver.memory", os.environ.get("RESOLVA_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's `spark.checkpoint.dir`; create a scratch one only when unset.

    On a cluster the setting names a shared folder every executor can read
    (HDFS/S3/NFS). Only a local session without that setting (tests, bench)
    gets a fresh temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    scratch = tempfile.mkdtemp(prefix="resolva-ckpt-")
    sc.setCheckpointDir(scratch)
    return scratch


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the checkpoint folder, for written tables. It is the folder as
    configured, which later sessions share; Spark's own checkpoints go to a
    folder of each session below it."""
    own = ensure_checkpoint_dir(spark)
    return (spark.conf.get("spark.checkpoint.dir", None) or own).rstrip("/") + "/" + name
