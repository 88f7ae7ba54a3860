"""Session construction and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


ARROW_BATCH = "8m"  # of a batch that goes to Python


def configure_session(spark: SparkSession) -> SparkSession:
    """Session settings every operator relies on.

    UTC so month buckets do not move with the host zone; ANSI stays on (Spark 4
    default), so operators use ``try_*`` functions for coercions and divisions.
    A checkpoint folder is only set when the cluster did not name one.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    # a Python worker and its executor hold a batch each: rows of long texts are many MB
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)
    checkpoint_dir(spark)
    return spark


def get_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "quarry") -> SparkSession:
    """Local/test session.  On a cluster, build the session there and call
    :func:`configure_session` instead."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure_session(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session first.  Only a local session (one process) without
    the setting gets a fresh temporary folder; on a cluster that is an error,
    as executors would not see each other's files.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="quarry-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder (never a
    machine-local temp folder) for sinks, stream checkpoints and cut lineage."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/quarry-scratch/{name}-{uuid.uuid4().hex}"
