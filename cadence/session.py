"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on; a cluster's own spark-defaults win for anything not listed.
_SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "cadence") -> SparkSession:
    """Return the active session or build one (local mode when ``master`` is given)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor
            builder = builder.config("spark.driver.memory", os.environ.get("CADENCE_DRIVER_MEMORY", "16g"))
    for k, v in _SESSION_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set one only when it is unset (tests, local runs).

    On a cluster this must name a shared folder (HDFS / object store); a machine-local
    folder would not survive the loss of an executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    path = fallback or os.environ.get("CADENCE_CHECKPOINT_DIR")
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "/tmp/cadence-checkpoints"
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return path


def materialise(df, name: str):
    """Write ``df`` once below the shared checkpoint folder and read it back: later uses scan only
    the columns they need, nothing is planned or computed twice, and lost executors do no harm."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


TASK_ROWS = 400_000        # rows that a task sorts or counts, on average


def dealt(df, rows: int, *keys: str, task_rows: int | None = None):
    """``df`` dealt by ``keys`` to as many tasks as ``rows``, its number of rows or a little more, asks
    for, if that is more than the session's shuffle partitions: what a task holds then does not grow
    with the table. Fewer rows are left to Spark."""
    n = -(-rows // (task_rows or TASK_ROWS))
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def scratch(spark: SparkSession, name: str = "scratch") -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df):
    """Materialise ``df`` in the shared checkpoint folder (reliable, survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
