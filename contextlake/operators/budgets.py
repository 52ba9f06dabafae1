"""Count, size and character budgets over ranked files."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextlake.functions import text
from contextlake.operators.order import checkpointed, running_sum


def checked_budget(value, name: str, zero_is_none: bool = True) -> int | None:
    """None for no budget; a whole number from 0 to 2**53 - 1, or an error. A string counts as its number."""
    if value is None or value is False or (zero_is_none and value == 0 and value is not True):
        return None
    if isinstance(value, str) and value.strip():
        try:
            value = float(value) if "." in value or "e" in value.lower() else int(value)
        except ValueError:
            raise ValueError(f"{name} must be a whole number, not {value!r}") from None
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value or value < 0 or value > 2**53 - 1 or value != int(value):
        raise ValueError(f"{name} must be a whole number, not {value!r}")
    return None if zero_is_none and value == 0 else int(value)


def greedy_size(ranked: DataFrame, budget: int, keep_first: bool = False, serial: int = 1 << 20) -> DataFrame:
    """Adds fits: files in rank order that fit into what earlier fitting files left; later smaller ones may still fit.

    keep_first keeps the first file even if it is larger. Each decision depends on the ones before it. While more than
    ``serial`` files are open, a round decides all of them up to the place where what is left loses a binary digit: with 2**k <= left < 2**(k+1)
    smaller files than 2**k all fit until then, and of the others the first that fits ends the round, as less than 2**k is left after it.
    So there are at most as many rounds as the budget has binary digits, whatever the sizes and their order. The last files are
    folded over by (rank, size) in one task.
    """
    slim = ranked.select("rank", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"))
    used, taken, first = 0, [], None
    if keep_first:
        first = slim.orderBy("rank").first()
        used = first["size"] if first else 0
        taken = [slim.where(F.col("rank") == first["rank"]).select("rank")] if first else []
        slim = slim.where(F.col("rank") > first["rank"]) if first else slim
    possible = slim.where(F.col("size") <= budget - used)
    while (left := budget - used) > 0 and possible.count() > serial:
        half = 1 << (left.bit_length() - 1)
        small = F.col("size") < half
        summed = checkpointed(running_sum(possible, F.when(small, F.col("size")).otherwise(0), "before"))
        after = F.lit(left) - F.col("before") - F.col("size")
        edge = summed.where(F.when(small, after < half).otherwise(after >= 0)).agg(F.min("rank")).first()[0]
        # without an edge all small files fit and nothing else does
        fitting = summed.where(small) if edge is None else summed.where((small & (F.col("rank") < edge)) | (F.col("rank") == edge))
        taken.append(fitting.select("rank"))
        used += fitting.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        possible = summed.where("false") if edge is None else checkpointed(summed.where((F.col("rank") > edge) & (F.col("size") <= budget - used)).select("rank", "size"))
    if (left := budget - used) <= 0:  # only empty files are open
        taken.append(possible.select("rank"))
        possible = possible.where("false")

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = left
        for batch in batches:
            fits = []
            for size in batch.column(1).to_pylist():
                fits.append(size <= rest)
                rest -= size if fits[-1] else 0
            yield batch.filter(pa.array(fits, pa.bool_())).select(["rank"])

    fitting = possible.coalesce(1).sortWithinPartitions("rank").mapInArrow(fold, "rank bigint")
    for part in taken:
        fitting = fitting.unionByName(part)
    return ranked.join(fitting.withColumn("fits", F.lit(True)), "rank", "left").withColumn("fits", F.coalesce("fits", F.lit(False)))


def character_budget(ranked: DataFrame, limit: int, planned: bool = False) -> DataFrame:
    """Adds outcome (kept, truncated, dropped), original_length, planned_length, and with contents the cut content, dropped_lines and total_lines.

    Files are kept while they fit; the first that does not is cut to what is left, or dropped if nothing useful
    fits; everything after it that has content is dropped. planned counts bytes instead of contents. Files without
    string content always pass and count nothing when contents are counted.
    """
    length = F.coalesce(F.col("size"), F.lit(0)) if planned else text.utf16_length(F.col("content"))
    files = ranked.withColumn("original_length", length)
    # lengths are never negative, so what is used only grows: the first file that does not fit is the boundary. Only ranks and
    # lengths are summed, and written once, so contents are not made for the sums again
    lengths = checkpointed(files.select("rank", "original_length"))
    counted = F.coalesce(F.col("original_length"), F.lit(0))
    used = running_sum(lengths, counted, "used")
    edge = used.where(F.col("original_length").isNotNull() & (F.col("used") + counted > limit)).agg(F.min(F.struct("rank", "used"))).first()[0]
    left = F.lit(limit - edge["used"] if edge else 0).cast("bigint")
    boundary = F.lit(edge["rank"] if edge else None).cast("bigint")
    at = F.coalesce(F.col("rank") == boundary, F.lit(False))
    after = F.coalesce(F.col("rank") > boundary, F.lit(False)) & F.col("original_length").isNotNull()
    if planned:
        outcome = F.when(after, "dropped").when(at & (left <= 0), "dropped").when(at, "truncated").otherwise("kept")
        return files.withColumn("outcome", outcome).withColumn("planned_length", F.when(F.col("outcome") == "truncated", left))
    cut = F.when(at, text.truncate_at_line(F.col("content"), left))
    files = files.withColumn("_cut", cut)
    outcome = F.when(after, "dropped").when(at & F.col("_cut").isNull(), "dropped").when(at, "truncated").otherwise("kept")
    files = files.withColumn("outcome", outcome)
    files = files.withColumn("content", F.when(F.col("outcome") == "truncated", F.col("_cut.content")).when(F.col("outcome") == "kept", F.col("content")))
    return files.withColumn("dropped_lines", F.col("_cut.dropped_lines")).withColumn("total_lines", F.col("_cut.total_lines")).drop("_cut")
