"""The exclusion ledger: one row for every file that a selection leaves out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contextlake import constants as C

SCHEMA = "path string, size bigint, reason string, rule string, rule_source string, is_directory boolean"


def entries(excluded: DataFrame, reason: Column | str, rule: Column | None = None, rule_source: Column | None = None, is_directory: Column | None = None) -> DataFrame:
    null = F.lit(None).cast("string")
    return excluded.select(
        "path",
        F.coalesce(F.col("size"), F.lit(0)).cast("bigint").alias("size"),
        (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
        (null if rule is None else rule).alias("rule"),
        (null if rule_source is None else rule_source).alias("rule_source"),
        (F.lit(False) if is_directory is None else is_directory).alias("is_directory"),
    )


def merge(ledgers: list[DataFrame]) -> DataFrame:
    """Reports of parts of a run, as one: counts add up because rows do."""
    return reduce(DataFrame.unionByName, ledgers)


def retract(ledger: DataFrame, kept: DataFrame) -> DataFrame:
    """Without the rows of files that a later rule took back."""
    return ledger.join(kept.select("path"), "path", "left_anti")


def by_reason(ledger: DataFrame) -> DataFrame:
    """reason, files of every known reason, with zeros."""
    spark: SparkSession = ledger.sparkSession
    reasons = spark.createDataFrame([(r,) for r in C.REASONS], "reason string")
    counted = ledger.groupBy("reason").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    # the left side has as many rows as there are reasons
    return reasons.join(counted, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def largest(ledger: DataFrame, top: int = C.LEDGER_TOP) -> DataFrame:
    return ledger.orderBy(F.desc("size"), F.asc("path")).limit(top)


def retained(ledger: DataFrame, cap: int = C.LEDGER_MAX_ENTRIES) -> tuple[DataFrame, int]:
    """The first entries by path, and how many are left out of the listing (the counts cover all)."""
    return ledger.orderBy("path").limit(cap), max(0, ledger.count() - cap)
