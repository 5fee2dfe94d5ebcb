"""Session settings the jobs rely on, and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for the plans in this package.  None of them caps data.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", app: str = "tracewright", **extra: str) -> SparkSession:
    """A session for local runs; on a cluster pass the same settings at submit time."""
    builder = SparkSession.builder.master(master).appName(app)
    settings = {
        **RECOMMENDED,
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "16g",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    A machine-local folder is only made for a local master that has none set.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        configured = os.path.join(tempfile.mkdtemp(prefix="tracewright-ckpt-"), "ckpt")
    sc.setCheckpointDir(configured)
    return configured


def materialised(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder: computed once, kept when executors are lost.

    For small tables that several later steps read, such as fitted vocabularies and sums.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
