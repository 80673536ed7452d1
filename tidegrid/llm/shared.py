"""Places that the driver and every executor can reach, and tables written there."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.sources.scratch import scratch

#: Rows of a few numbers that may be broadcast.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder path (not yet made) under the shared folder, as a URI or path."""
    return scratch(spark, label)


def light(keys: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A table of a few numbers a row, broadcast in joins if it has at most ``most`` rows; it is counted, so have it written."""
    return F.broadcast(keys) if keys.count() <= most else keys


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor afterwards costs a re-read, not a
    recomputation. Any executor can read the files.
    """
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def open_filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow filesystem and inner path of a URI (file, hdfs, s3, gs) or local path."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


class AtomicFile:
    """Write a file under an attempt's own name, and rename it when it is whole.

    Contents are a function of the partition alone, so a retried or duplicate
    attempt replaces the file by an equal one.
    """

    def __init__(self, folder: str, name: str) -> None:
        self.fs, inner = open_filesystem(folder)
        self.fs.create_dir(inner, recursive=True)
        self.path = f"{inner}/{name}"
        self.partial = f"{inner}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.partial, compression=None)

    def __enter__(self):
        return self.out

    def __exit__(self, kind, value, trace) -> None:
        self.out.close()
        if kind is None:
            self.fs.move(self.partial, self.path)
        else:
            self.fs.delete_file(self.partial)
