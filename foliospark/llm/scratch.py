"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it
again, so a lost executor never costs more than the tasks it was running.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder. Where the session names none, a local run gets one of its own; a cluster has no such place, so there this raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folio-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{folder(spark)}/folio-{name}-{uuid.uuid4().hex}"


#: Whether Spark drops an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, path: str) -> DataFrame:
    """What is written is never computed again, so its shuffles need not outlive the write."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write `df` to the shared folder and read it back."""
    return _written(df, place(df.sparkSession, name))


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables of ours through Hadoop's file systems, as they may lie in any store."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for p in paths:
        path = hadoop.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Space:
    """Tables that are deleted when the block ends; what is read from them must be written elsewhere by then."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Space:
        return self

    def __exit__(self, *_) -> None:
        drop(self.spark, *self.paths)

    def cut(self, df: DataFrame, name: str = "table") -> DataFrame:
        self.paths.append(place(self.spark, name))
        return _written(df, self.paths[-1])


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
