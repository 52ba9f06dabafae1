"""Total orders and ranks.

With a count budget the first rows are taken by Spark's distributed top-k and only they are ranked in one task.
Without one, rank_all() sorts in ranges: keys only, positions inside a range, and an offset for each range.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from contextlake.functions import paths

SORT_KEYS = ("path", "size", "modified", "name", "extension", "depth")


def sort_columns(by: str = "path", descending: bool = False) -> list[Column]:
    """The whole comparator, ties included, turned by descending. An unknown key is an error."""
    if by not in SORT_KEYS:
        raise ValueError(f"unknown sort key {by!r}; one of {', '.join(SORT_KEYS)}")
    path = F.col("path")
    first = {
        "path": [],
        "size": [F.coalesce(F.col("size"), F.lit(0))],
        "modified": [F.coalesce(F.col("modified"), F.lit("1970-01-01").cast("timestamp_ntz"))] if by == "modified" else [],
        "name": [paths.collated(paths.basename(path))],
        "extension": [F.collate(paths.extension(path), "en")],
        "depth": [paths.depth(path)],
    }[by]
    keys = [*first, paths.collated(path), path]
    return [k.desc() if descending else k.asc() for k in keys]


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is set and all tasks run on this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the shared folder, and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def observed(df: DataFrame, metrics: dict[str, Column]) -> tuple[DataFrame, dict | None]:
    """checkpointed(df) and aggregates over its rows, which the tasks that write it gather; None where Spark's plan kept no such step."""
    watch = Observation()
    out = checkpointed(df.observe(watch, *[value.alias(name) for name, value in metrics.items()]))
    told = watch.get
    return out, told if set(told) == set(metrics) else None


def take_ranked(files: DataFrame, keys: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows with rank from 1; at most ``limit`` rows meet in one task."""
    return files.orderBy(*keys).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*keys)).cast("bigint"))


def rank_all(files: DataFrame, keys: list[Column]) -> DataFrame:
    """rank from 1 of every row: each task sorts a range of keys, and a range's offset is the rows before it.

    Whole rows are sorted, so rows without or with equal paths stay apart; contents are joined after ranking.
    """
    partitions = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = checkpointed(files.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row for each shuffle partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit(2**33 - 1)) + 1
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").select(*files.columns, rank.alias("rank"))


def running_sum(ranked: DataFrame, value: Column, name: str, block: int = 65536) -> DataFrame:
    """Adds the sum of value over all rows of a lower rank, by blocks of ranks and offsets of blocks."""
    ranked = ranked.withColumn("_value", value).withColumn("_block", F.floor((F.col("rank") - 1) / block))
    sums = ranked.groupBy("_block").agg(F.sum("_value").alias("_sum"))
    before = sums.select("_block", F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_value").over(Window.partitionBy("_block").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranked.withColumn("_inside", inside).join(before, "_block").withColumn(name, F.col("_before") + F.col("_inside")).drop("_value", "_block", "_before", "_inside")
