"""Streaming ingest: new document files become rows of the batch tables as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliospark.sources import packages as P

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, pattern: str = "*", files_a_batch: int = 1000) -> DataFrame:
    """(doc, format, content) of files as they come; so many a batch at most, the rest in later batches."""
    rows = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).load(folder)
    return rows.select(F.col("path").alias("doc"), P.sniff(F.col("content"), F.col("path")).alias("format"), "content")


def ingest_packages(files: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append parts and nodes of arriving packages to Parquet tables below `folder`.

    A batch is written to a directory of its own number, so one that runs
    again after a failure replaces what it had written.
    """

    def write(batch: DataFrame, number: int) -> None:
        parts = P.parts(P.entries(batch.where("format = 'hwpx'"))).persist()
        try:
            parts.write.mode("overwrite").parquet(f"{folder}/parts/batch={number}")
            P.nodes(parts).write.mode("overwrite").parquet(f"{folder}/nodes/batch={number}")
        finally:
            parts.unpersist()

    query = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events of each kind a window of time; later than `late` they no longer count."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
