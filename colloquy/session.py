"""A session with the settings that these plans assume."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(name: str = "colloquy", **settings: str) -> SparkSession:
    """The running session, or a new one; settings use ``__`` for the dots of their names."""
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Bytes of rows that a Python stage over sound takes together.
BATCH_BYTES = "4m"


def small_batches(rows: DataFrame) -> DataFrame:
    """rows, in a session whose Python stages are handed BATCH_BYTES at a time, if it has no bound yet: 10,000 recordings at once would be gigabytes."""
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, BATCH_BYTES)
    return rows


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share, beside the session's checkpoints; a session of one machine may have none set."""
    folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if folder is None:
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(rows: DataFrame) -> DataFrame:
    """rows, written to the shared checkpoint folder: read again from there however often, and not lost with an executor."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch(rows.sparkSession, "checkpoints"))
    return rows.checkpoint()
