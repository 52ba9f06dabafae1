"""Files that arrive: the same rules on a stream, with state bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextlake.operators import rules
from contextlake.plans import engine
from contextlake.request import Request


def read_events(spark: SparkSession, folder: str, per_batch: int = 1) -> DataFrame:
    """Parquet files of events as a stream; their schema is that of the files there."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def narrow(stream: DataFrame, request: Request, layers: list[rules.Layer]) -> DataFrame:
    """discover() has no shuffle and no state, so it is the same on a stream."""
    return engine.discover(stream, layers, request).where("reason IS NULL")


def first_of_content(stream: DataFrame, time: str = "modified", content: str = "content", late: str = "1 hour") -> DataFrame:
    """The first arrival of each content; digests are forgotten when the watermark has passed them."""
    return stream.withWatermark(time, late).withColumn("sha256", F.sha2(F.col(content), 256)).dropDuplicatesWithinWatermark(["sha256"])


def windowed_counts(stream: DataFrame, time: str, key: str, value: str, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Rows and sums by event-time window and key; late rows count until the watermark has passed their window."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    grouped = stream.withWatermark(time, late).groupBy(window.alias("window"), key)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("window_start"), key, "n", "total")


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    grouped = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("window"), key)
    return grouped.agg(F.count("*").alias("n")).select(F.col("window.start").alias("session_start"), F.col("window.end").alias("session_end"), key, "n")


def final_state(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Runs over what is there and returns the whole result of an aggregation, also of windows that the watermark has not closed; each batch replaces the last one's."""
    schema = stream.schema

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(folder)

    query = stream.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(folder)


def run_to_end(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs over what is there, writes Parquet exactly once by the checkpoint, and returns what was written."""
    query = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(folder)
