"""Change sets of version control: narrowing and annotating files by path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextlake import constants as C
from contextlake.operators.order import rank_all


def between(before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """path, status, old_path of what differs between two snapshots (path, digest): modified, created, deleted, renamed.

    Both are joined by path; what only one has is joined by digest. Of equal digests the first created is the first deleted's new name, in
    the order of paths, and so on; they are numbered over all of them by ranges, so contents that many files share (or a null digest, which renames
    nothing) are no task's alone. Where one snapshot is missing nobody can tell: every path of the other is unknown. Of repeated paths one row counts.
    """
    if before is None or after is None:
        known = before if before is not None else after
        if known is None:
            raise ValueError("two snapshots are compared; one may be missing, not both")
        return known.select("path").where("path IS NOT NULL").distinct().select("path", F.lit("unknown").alias("status"), F.lit(None).cast("string").alias("old_path"))
    one = lambda df, name: df.where("path IS NOT NULL").groupBy("path").agg(F.min("digest").alias(name), F.lit(True).alias(f"in_{name}"))
    both = one(before, "old").join(one(after, "new"), "path", "full_outer")
    both = both.where("in_old IS NULL OR in_new IS NULL OR NOT old <=> new")
    changed = both.where("in_old AND in_new").select("path", F.lit("modified").alias("status"), F.lit(None).cast("string").alias("old_path"))

    def numbered(rows: DataFrame) -> DataFrame:
        ranked = rank_all(rows, [F.col("digest"), F.col("path")])
        return ranked.join(ranked.groupBy("digest").agg(F.min("rank").alias("_first")), "digest").select("digest", "path", (F.col("rank") - F.col("_first")).alias("nth"))

    gone = numbered(both.where("in_new IS NULL").select("path", F.col("old").alias("digest")).where("digest IS NOT NULL"))
    come = numbered(both.where("in_old IS NULL").select("path", F.col("new").alias("digest")).where("digest IS NOT NULL"))
    pairs = gone.withColumnRenamed("path", "old_path").join(come, ["digest", "nth"], "full_outer")
    moved = pairs.select(F.coalesce("path", "old_path").alias("path"), F.when(F.isnull("path"), "deleted").when(F.isnull("old_path"), "created").otherwise("renamed").alias("status"), F.when(F.isnotnull("path"), F.col("old_path")).alias("old_path"))
    blank = both.where("(in_new IS NULL AND old IS NULL) OR (in_old IS NULL AND new IS NULL)").select("path", F.when(F.isnull("in_new"), "deleted").otherwise("created").alias("status"), F.lit(None).cast("string").alias("old_path"))
    return changed.unionByName(moved).unionByName(blank)


def snapshot(files: DataFrame) -> DataFrame:
    """path and digest of each file with content; empty and null contents have no digest, as they say nothing about a file's identity."""
    return files.select("path", F.when(F.length("content") > 0, F.sha2(F.encode("content", "UTF-8"), 256)).alias("digest"))


def change_set(statuses: DataFrame, filter_type: str = "modified") -> DataFrame:
    """Distinct paths: modified takes modified, staged, not_added and created; staged takes staged and the new paths of renamed; changed takes all."""
    wanted = {"modified": ("modified", "staged", "not_added", "created"), "staged": ("staged", "renamed"), "changed": C.GIT_STATUS_ORDER}[filter_type]
    return statuses.where(F.col("status").isin(*wanted)).select("path").distinct()


def keep_changed(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Files in the change set, and forced ones."""
    flagged = files.join(changed.withColumn("_changed", F.lit(True)), "path", "left")
    return flagged.where(F.col("_changed").isNotNull() | F.col("forced")).drop("_changed")


def dropped_by_changes(files: DataFrame, changed: DataFrame) -> DataFrame:
    return files.where(~F.col("forced")).join(changed, "path", "left_anti")


def annotate(files: DataFrame, statuses: DataFrame | None) -> DataFrame:
    """git_status: the first status by rank of those a file has; without one unmodified, and unknown where nobody can tell (no statuses)."""
    if statuses is None:
        return files.withColumn("git_status", F.lit("unknown"))
    order = F.array(*[F.lit(s) for s in C.GIT_STATUS_ORDER])
    first = statuses.groupBy("path").agg(F.min_by("status", F.array_position(order, F.col("status"))).alias("git_status"))
    return files.join(first, "path", "left").withColumn("git_status", F.coalesce("git_status", F.lit("unmodified")))


def compare_plans(baseline: DataFrame, attributed: DataFrame, effective: DataFrame) -> DataFrame:
    """path, fate of every baseline file: removed by the rules in question, removedByOthers, or kept."""
    flagged = baseline.select("path", "size").join(attributed.select("path", F.lit(True).alias("_a")), "path", "left").join(effective.select("path", F.lit(True).alias("_e")), "path", "left")
    return flagged.select("path", "size", F.when(F.col("_a").isNull(), "removed").when(F.col("_e").isNull(), "removedByOthers").otherwise("kept").alias("fate"))


def keyed_union(first: DataFrame, second: DataFrame, key: str = "path") -> DataFrame:
    """Both, one row for each key; second's row wins."""
    return second.unionByName(first.join(second.select(key), key, "left_anti"), allowMissingColumns=True)
