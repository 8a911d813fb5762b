"""Streams: files turned into graphs as they arrive, statuses kept current, link counts over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.sources import documents

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def ingest_files(spark: SparkSession, path: str, checkpoint: str, process: Callable[[DataFrame, int], None], available_now: bool = True) -> StreamingQuery:
    """Each new file under a path, parsed, goes once to ``process(parsed, batch id)``.

    The source log remembers the files, so a restart goes on after the last batch that ended; a batch that was cut off
    is repeated with the same id, so that ``process`` can replace what it wrote.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(path)
    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: process(documents.parse_files(df.select("path", "content")), n))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_by_stream(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The latest row of each document of a stream of status rows; rows later than ``delay`` are dropped."""
    return log.withWatermark("updated_at", delay).groupBy("id").agg(F.max_by(F.struct("status", "progress"), "updated_at").alias("x"), F.max("updated_at").alias("updated_at")).select("id", "x.*", "updated_at")


def status_counts(log: DataFrame, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Status rows by window of event time; late rows count until the watermark passes."""
    return log.withWatermark("updated_at", delay).groupBy(F.window("updated_at", window), "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "status", "n")
