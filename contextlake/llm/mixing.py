"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

1. Every document has a size in words. The documents of a source, in the order of a digest of their
   id, are one stream of words, which is cut into blocks of ``block_words`` words, of which the last may be shorter.
2. Sources get targets: shares by weight of ``budget`` times all words; no target passes ``most``
   times the source's words, and what is cut off goes to the others by weight. A source's slots take as many words as its
   target says, to the nearest word: whole rounds of all its blocks, then blocks of one more round, the last of them in part.
3. The slots of all sources, one after the other, are the whole points 0 to M - 1: a source's interval of cumulative weights holds as many
   points as it has slots. Slot j of the mix has the point j * g modulo M, where g is the number next to M times the golden ratio's
   fraction that has no divisor in common with M. So every point is met once, and any run of slots has of each source about its share.
4. The slots of a source, numbered in the order of the mix, take its blocks in a shuffled order, round after round.

No step gathers a source in one task: streams are summed over ranges of the digest first, slots are made in runs of ``run_slots`` and
numbered within runs first, so a source with most of the rows is dealt to many tasks. A source's slots are found from
its own interval by the inverse of g, so slots and sources are not searched for each other and sources
may be as many as web domains: they are numbered and summed in ranges of Spark's sort.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextlake.llm.store import checkpointed

GOLDEN = (5**0.5 - 1) / 2
#: above every number of blocks, so that its multiples modulo that number meet every block once
PRIME = (1 << 61) - 1
#: up to so many sources, tables with a row for each source are one partition: one task for each step instead of one for each shuffle partition
FEW_SOURCES = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def _before(rows: DataFrame, order: list[Column], sums: dict[str, Column], few: bool = False) -> DataFrame:
    """Adds nth (from 0) and each named sum over the rows before, in an order that Spark sorts in ranges; one row for each range meets in a window.

    With few, the caller knows that the rows fit a task, and they are sorted in one.
    """
    if few:
        before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.coalesce(1).select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(k) for k, c in ({"nth": F.lit(1).cast("long")} | sums).items()])
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("*", *[c.alias(f"_order{i}") for i, c in enumerate(order)], *[c.alias(f"_sum_{k}") for k, c in sums.items()])
    keys = [f"_order{i}" for i in range(len(order))]
    placed = checkpointed(rows.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    named = {"nth": F.lit(1).cast("long")} | {k: F.col(f"_sum_{k}") for k in sums}
    ranges = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_{k}") for k, c in named.items()])
    ranges = ranges.select("_part", *[F.coalesce(F.sum(f"_{k}").over(upto), F.lit(0)).alias(f"_{k}") for k in named])
    here = placed.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(k) for k, c in named.items()]).join(F.broadcast(ranges), "_part")
    return here.select(*[c for c in rows.columns if not c.startswith(("_order", "_sum_"))], *[(F.col(k) + F.col(f"_{k}")).alias(k) for k in named])


def source_targets(by_source: DataFrame, weights: tuple[float, ...], budget: float, most: float, few: bool = False) -> DataFrame:
    """A row per source: source, ordinal, source_size, weight, target. by_source has source and source_size, of few sources or many.

    Sources are ordered by code point, null last. The caps are met in closed form: by rising
    most*size/weight, a prefix of the sources is at its cap and the others share by weight.
    """
    ranked = _before(by_source, [F.col("source").isNull(), F.col("source")], {}, few).withColumnRenamed("nth", "ordinal")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("ordinal") % len(weights) + 1).cast("int"))
    ranked = checkpointed(ranked.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size")))
    words, shares = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    total = float(budget) * (words or 0)
    rising = _before(ranked, [F.col("cap") / F.col("weight"), F.col("ordinal")], {"caps": F.col("cap"), "weights": F.col("weight")}, few)
    level = (F.lit(total) - F.col("caps")) / (F.lit(shares or 0.0) - F.col("weights"))
    # the first source whose cap is above its level fixes the level of all after it
    free = rising.select("cap", "weight", "nth", level.alias("level")).where("cap > level * weight")
    level = free.agg(F.min_by("level", "nth")).first()[0]
    target = F.col("cap") if level is None else F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    return ranked.select("source", "ordinal", "source_size", "weight", target.alias("target"))


def with_slots(targets: DataFrame, block_words: int, few: bool = False) -> DataFrame:
    """Adds words (of the mix), full (blocks of block_words words), blocks, slots, and first, the first of the source's points."""
    size, block = F.col("source_size"), F.lit(block_words)
    counted = targets.withColumns({"words": F.floor(F.col("target") + 0.5).cast("long"), "full": F.floor(size / block).cast("long"), "blocks": F.ceil(size / block).cast("long")})
    rounds, rest = F.expr("words div source_size"), F.expr("words % source_size")
    slots = F.when(size > 0, rounds * F.col("blocks") + F.ceil(rest / block)).otherwise(0).cast("long")
    counted = counted.withColumn("slots", slots)
    return _before(counted, [F.col("ordinal")], {"first": F.col("slots")}, few).drop("nth")


def times_modulo(a: Column, b: Column, m: Column) -> Column:
    """a * b modulo m of numbers of up to 63 bits whose product may have 126."""
    whole = lambda c: c.cast("decimal(19,0)")
    return (whole(a) * whole(b) % whole(m)).cast("long")


def golden_step(points: int) -> int:
    """The least number from points * GOLDEN on that has no divisor in common with points."""
    step = max(1, int(points * GOLDEN))
    while gcd(step, points) != 1:
        step += 1
    return step


def mix_schedule(targets: DataFrame, run_slots: int = 65536) -> DataFrame:
    """(ordinal, slot, rank) of every slot of the mix; rank counts the slots of the source from 0. targets as with_slots() gives them."""
    points = targets.agg(F.sum("slots")).first()[0] or 0
    if not points:
        return targets.select("ordinal", F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("rank")).where("false")
    inverse = pow(golden_step(points), -1, points) if points > 1 else 0
    # runs are at most about a million, of a length that a task can write out
    length = max(run_slots, -(-points // (1 << 20)))
    runs = targets.where("slots > 0").select("ordinal", "first", "slots", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - 1) div {length}"))).alias("run"))
    low = F.col("run") * length
    made = runs.repartition("ordinal", "run").select("ordinal", F.explode(F.sequence(F.col("first") + low, F.col("first") + F.least(F.col("slots"), low + length) - 1)).alias("point"))
    dealt = made.select("ordinal", times_modulo(F.col("point"), F.lit(inverse), F.lit(points)).alias("slot")).withColumn("run", F.expr(f"slot div {length}"))
    counts = dealt.groupBy("ordinal", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("ordinal").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("ordinal", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("ordinal", "run").orderBy("slot")) - 1
    return dealt.withColumn("inside", inside).join(counts.hint("merge"), ["ordinal", "run"]).select("ordinal", "slot", (F.col("base") + F.col("inside")).alias("rank"))


def _beside(facts: DataFrame, few: bool) -> DataFrame:
    """facts, a row for each source, to be joined to rows that grow with the words: Spark estimates both from the sources, and would broadcast either."""
    return F.broadcast(facts) if few else facts.hint("merge")


def taken_blocks(schedule: DataFrame, targets: DataFrame, block_words: int, few: bool = False) -> DataFrame:
    """(ordinal, block, times, part): how often slots take the whole block, and of how many of its words one takes the first."""
    facts = targets.select("ordinal", "source_size", "words", "full", "blocks", "slots")
    dealt = schedule.join(_beside(facts, few), "ordinal").withColumn("nth", F.expr("rank % blocks"))
    # full blocks in shuffled order, then the shorter one
    block = F.when(F.col("nth") < F.col("full"), times_modulo(F.col("nth"), F.expr(f"{PRIME}L % full"), F.col("full"))).otherwise(F.col("full"))
    rest = F.expr(f"words % source_size - nth * {block_words}")
    # the last slot of an unfinished round stops where the words of the mix are taken
    partly = (F.col("rank") == F.col("slots") - 1) & F.expr("words % source_size > 0") & (rest < F.least(F.lit(block_words), F.col("source_size") - block * block_words))
    dealt = dealt.select("ordinal", block.alias("block"), F.when(partly, rest).alias("part"))
    return dealt.groupBy("ordinal", "block").agg(F.count_if(F.isnull("part")).alias("times"), F.coalesce(F.sum("part"), F.lit(0)).alias("part"))


def _streams(sizes: DataFrame, order_key: Column, ranges: int) -> DataFrame:
    """Adds start, the word at which each document begins in its source's stream."""
    keyed = sizes.withColumn("key", order_key)
    keyed = keyed.withColumn("range", F.conv(F.substring("key", 1, 4), 16, 10).cast("int") % ranges)
    key = ["source", "range"]
    sums = keyed.groupBy(*key).agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s_source"), F.col("range").alias("s_range"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*key).orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    keyed = keyed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = keyed.join(sums.hint("merge"), F.col("source").eqNullSafe(F.col("s_source")) & (F.col("range") == F.col("s_range")))
    return out.withColumn("start", F.col("base") + F.col("inside")).drop("s_source", "s_range", "base", "inside", "key", "range")


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    budget: float = 1.5,
    most: float = 2.0,
    block_words: int = 64,
    ranges: int = 1024,
    run_slots: int = 65536,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document.

    size counts runs without ASCII white space (null or empty text: 0, and never taken). taken sums what the slots take of the
    document's words. All words that a source gives are its target to the nearest word, whatever its size, so no document is taken more than ``most`` times
    whole (``most`` is then a whole number). Repeated rows of one doc_id and source are separate documents of equal order; they are numbered
    apart by size, so the totals are the same on every run. A text of any length is one document. Other columns are ignored. No rows: no rows.
    """
    sizes = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = checkpointed(sizes)  # the texts are read once
    by_source = checkpointed(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    few = by_source.count() <= FEW_SOURCES
    targets = checkpointed(with_slots(source_targets(by_source, weights, budget, most, few), block_words, few))
    # written, so that no plan has all steps and none runs again for the pieces
    taken = checkpointed(taken_blocks(mix_schedule(targets, run_slots), targets, block_words, few))
    facts = targets.select(F.col("source").alias("t_source"), "ordinal", "source_size", "target")
    placed = _streams(sizes, F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), ranges).join(_beside(facts, few), F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    placed = checkpointed(placed)
    # a document's pieces, one for each block that it overlaps; runs of whole blocks stay apart so joins are by (source, block)
    end = F.col("start") + F.col("size")
    pieces = placed.where("size > 0").select("doc_id", "source", "ordinal", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words))).alias("block"))
    low = F.col("block") * block_words
    shared = lambda upto: F.greatest(F.lit(0), F.least(end, low + upto) - F.greatest(F.col("start"), low))
    # both grow with the words; Spark estimates them from the few sources that slots are made of, and would broadcast them
    got = pieces.join(taken.hint("merge"), ["ordinal", "block"]).groupBy("ordinal", "start").agg(F.sum(shared(F.lit(block_words)) * F.col("times") + shared(F.col("part"))).alias("taken"))
    empty = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    full = placed.where("size > 0").join(got.hint("merge"), ["ordinal", "start"], "left").withColumn("taken", F.coalesce(F.col("taken"), F.lit(0)).cast("long"))
    cols = ["doc_id", "source", "size", "source_size", "target", "taken"]
    return full.select(*cols).unionByName(empty.select(*cols))
