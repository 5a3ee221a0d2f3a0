"""Incremental builds: scene files that arrive are added to a dataset as they come (an extension of O14, S9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators import conversations, tokens
from weftline.sinks.datasets import save_batches
from weftline.sources.files import stem_of


def scenes(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of (path, stem, raw) of new JSON files."""
    rows = spark.readStream.option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", per_trigger).text(folder, wholetext=True)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    return rows.select("path", stem_of(F.col("path")).alias("stem"), "raw")


def append(spark: SparkSession, folder: str, out: str, checkpoint: str, mode: str, max_length: int, tokenizer=None, once: bool = True) -> StreamingQuery:
    """Tokenizes new scenes of a mode without partners and writes each micro-batch under its own batch_id.

    A micro-batch that is run again replaces its own folder, so nothing is added twice.
    """

    def write(rows: DataFrame, number: int) -> None:
        own = tokens.tokenize(conversations.build(rows, mode).select("stem", "messages"), max_length, tokenizer)
        save_batches(own.withColumn("batch_id", F.lit(number).cast("long")), out)

    stream = scenes(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


def event_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Tumbling counts and sums of values by type over a stream or table of events (ts, event_type, value), with a watermark."""
    held = events.withWatermark("ts", late) if events.isStreaming else events
    by = held.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("w.start").alias("start"), "event_type", "n", "total")
