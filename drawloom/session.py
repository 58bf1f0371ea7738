"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}


def local_session(cores: str | int = "*", partitions: int = 8, **conf) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own settings."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("drawloom")
    settings = {**DEFAULTS, "spark.sql.shuffle.partitions": str(partitions), **conf}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` when the cluster names one.

    Only a session on one machine (master ``local`` or ``local[...]``) without the setting gets a temporary folder,
    which goes when the process ends; any other master without it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.environ.get("DRAWLOOM_SCRATCH")
        if root is None:
            root = tempfile.mkdtemp(prefix="spark-drawloom-")
            os.environ["DRAWLOOM_SCRATCH"] = root
            atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/drawloom/{label}-{uuid.uuid4().hex}"


def cut_lineage(df):
    """Writes an intermediate result to the shared folder and reads it back.

    The table survives the loss of executors, and its file sizes give the optimizer true statistics, so a
    small side is broadcast by Spark's own threshold and a large one is not (a checkpoint has no statistics).
    """
    path = scratch(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df, *keys):
    """Hash-partition by keys over the session's full shuffle width.

    For rows that are small in bytes but cost much CPU: adaptive execution would coalesce them by size
    into a few tasks. A later group-by on the same keys reuses the partitioning.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
