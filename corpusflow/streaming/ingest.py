"""Ingest of a folder as a stream: new files are parsed and chunked in micro-batches and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusflow.config import ChunkOptions
from corpusflow.operators.chunking import chunk_units
from corpusflow.sources.parsers import Reader
from corpusflow.sources.scan import parse, visible


def ingest_stream(spark: SparkSession, root: str, out: str, checkpoint: str, options: ChunkOptions | None = None, readers: dict[str, Reader] | None = None, once: bool = True) -> StreamingQuery:
    """Start the stream. A micro-batch writes to a folder named by its number, so a batch that is run again replaces
    itself; with ``once`` the stream ends when what is there is done."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 10_000).load(root)
    found = found.where(visible(F.regexp_replace("path", "^[a-z]+:/*", "")))

    def write(batch: DataFrame, number: int) -> None:
        units = parse(batch, readers).where("error is null")
        chunk_units(units, options).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    writer = found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and type, for batch and stream alike; a stream drops what comes later than ``late``."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    counted = marked.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n")
