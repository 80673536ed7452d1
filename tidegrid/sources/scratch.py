"""Folders that the driver and every executor can reach."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


@functools.lru_cache(maxsize=1)
def _local() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidegrid-")


def shared_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, or that was set on the context.

    Without either, a temporary folder where driver and executors are one
    machine; on a cluster this raises, as each executor would write to its own disk.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "") or ""
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that driver and executors share")
    return _local()


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder path (not yet made) under the shared folder."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
