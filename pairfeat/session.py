"""Spark session defaults and the shared scratch location.

Lineage cuts and persisted intermediate tables go under the cluster's
``spark.checkpoint.dir`` (a shared folder every executor can reach). A local
session that has none gets a fresh local folder; on any other master a missing
setting is an error, because executors would write to disks of their own.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches for the long-sequence and RIBES helpers: small enough that
    # one batch of long texts stays well inside a Python worker's memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def get_spark(master: str | None = None, app: str = "pairfeat",
              shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Build (or fetch) a session with the engine's defaults.

    A master is set only when passed, so under spark-submit the cluster's
    master and settings stand; the defaults below never override an explicit
    ``conf`` entry.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)   # otherwise spark-submit's master (local[*] when none is named)
    settings = dict(DEFAULTS)
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting a local one only on a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf_dir = tempfile.mkdtemp(prefix="pairfeat-ckpt-")
        atexit.register(shutil.rmtree, conf_dir, ignore_errors=True)   # a local session's own folder goes with it
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint directory for a written table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/pairfeat-{name}-{uuid.uuid4().hex[:12]}"
