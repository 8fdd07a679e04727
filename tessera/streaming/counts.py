"""Counts over streams of rows. Sources here are files; any streaming table does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.durable import removed, scratch
from tessera.functions import text as T


def file_stream(spark: SparkSession, folder: str, schema, glob: str = "*", files_per_batch: int = 100, kind: str = "parquet") -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(folder)


def run_counts(counts: DataFrame, name: str, mode: str = "complete", interval: str | None = None, seconds: int | None = None) -> DataFrame:
    """Run a streaming aggregate into a table of the shared checkpoint folder and return that table.

    Without ``interval`` all there is now is taken and the query ends; with it micro-batches run for ``seconds``. Each batch of a
    complete aggregate replaces the table, each batch of an appended one has a folder of its own, so a batch that is run again after
    a failure changes nothing.
    """
    spark = counts.sparkSession
    place = scratch(spark, f"stream-{name}")

    def write(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/table/batch={0 if mode == 'complete' else k}")

    writer = counts.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{place}/state")
    q = (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
    q.awaitTermination(seconds) if interval else q.awaitTermination()
    if interval:
        q.processAllAvailable()
        q.stop()
    removed(spark, f"{place}/state")  # the query has ended
    schema = counts.schema
    return spark.read.schema(schema).parquet(f"{place}/table").select(*schema.names)


def each_batch(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call ``act`` on each micro-batch, as an action of the driver."""
    return stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def value_counts(stream: DataFrame, *keys: str) -> DataFrame:
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def tagged(stream: DataFrame, text: str) -> DataFrame:
    """Rows whose text holds a hash sign."""
    return stream.where(F.col(text).contains("#"))


def hashtag_counts(rows: DataFrame, text: str) -> DataFrame:
    """(hashtag, n) over all hashtags of all rows."""
    return tagged(rows, text).select(F.explode(T.hashtags(F.col(text))).alias("hashtag")).groupBy("hashtag").agg(F.count(F.lit(1)).alias("n"))


def hashtag_pairs(rows: DataFrame, text: str) -> DataFrame:
    """(a, b, n): pairs of hashtags of one row, the earlier one first, all positions."""
    tags = tagged(rows, text).select(T.hashtags(F.col(text)).alias("t"))
    pairs = F.flatten(F.transform("t", lambda x, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return tags.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(stream: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(begins, key, n) by event time; an extension beyond counting all there is. ``at`` is made a time with a zone."""
    timed = stream.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    return timed.groupBy(F.window("__at", width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("begins"), key, "n")
