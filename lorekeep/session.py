"""Session defaults and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings that change results (time zone) or that a large run should not be without.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Picked ids (at most a few hundred) reach the Parquet scan as an IN filter.
    "spark.sql.parquet.pushdown.inFilterThreshold": "256",
    # Streaming state of single entries and timers, on disk.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_session(app: str = "lorekeep", **conf: str) -> SparkSession:
    """A session with the defaults above. Master and memory come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables, as spark.checkpoint.dir names it.

    Only a local session may go without: it gets a temporary folder of its own.
    """
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not known:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        known = tempfile.mkdtemp(prefix="lorekeep-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(known)
    return known
