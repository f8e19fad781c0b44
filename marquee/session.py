"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast joins are decided by Catalyst from size estimates (static) and by
    # AQE from shuffle statistics (runtime); anything above falls back to a
    # shuffled join.  No operator forces a broadcast of an unbounded side.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoint files of frames that are no longer referenced are removed.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Kryo makes checkpoint writes and cached blocks of internal rows cheaper.
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "marquee", extra: dict | None = None) -> SparkSession:
    """Session for tests, bench and local runs.  Sets a checkpoint folder only
    when none is configured (a cluster names a shared one)."""
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, reading ``spark.checkpoint.dir`` first.

    On a cluster the folder must be shared storage named by the cluster; a
    machine-local temporary folder is only created in local mode.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; name a shared folder for checkpoints")
    path = tempfile.mkdtemp(prefix="marquee-ckpt-", dir=os.environ.get("MARQUEE_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def materialize(df):
    """Cut lineage: write ``df`` to the shared checkpoint folder and read it back.

    Persisting first lets the checkpoint write reuse the computed partitions
    instead of recomputing the plan a second time; the cache is released once
    the checkpoint files exist.  Survives executor loss (files, not blocks)."""
    from pyspark import StorageLevel

    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out
