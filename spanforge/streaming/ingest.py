"""New pages as they come: a stream of Parquet files through the same operators as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sinks.markdown import block_lines
from ..sources.pages import html_blocks

PAGES = "page_id long, url string, html string"


def page_blocks(spark: SparkSession, folder: str, schema: str = PAGES, max_files: int = 100) -> DataFrame:
    """A stream of blocks of the pages of new files."""
    pages = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)
    blocks = html_blocks(pages)
    return blocks.withColumn("lines", block_lines(F.col("kind"), F.col("level"), F.col("text")))


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and type, final once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def write(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append to a Parquet folder, exactly once per input file."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
