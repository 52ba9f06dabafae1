"""Canonical exact fingerprints of documents, in DataFrame and SQL functions only.

The canonical form is NFKC, full case folding (which also folds sharp s and final sigma) and runs of
white space as one space; both Unicode steps are static methods of the ICU library that Spark ships,
called by the SQL function reflect. Two xxhash64 values under different seeds make a 128-bit
digest. Where a digest belongs to more than one row, the canonical bytes are compared; if they
differ, the texts of that digest get ``-1``, ``-2``, ... after it, by byte order.

1. A pass over the texts keeps narrow rows: id, two hashes of the text, its length and canonical digest.
2. Narrow rows are sorted in ranges by Spark, so that each knows the row after it and how much of its own start the
   row before it wants. A hot id is split by the hashes; only one row for each range of the sort meets in a window.
3. Texts move once, by id and hashes, which no id can make hot; the starts that neighbours want move too.
   There the edited text is digested, and texts whose digest another row has give their canonical bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextlake.llm.store import checkpointed


def canonical(text: Column) -> Column:
    """NFKC, case folded, white space folded and trimmed."""
    normal = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), normal, F.lit(True))
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}\x85]+", " "))


def digest(canon: Column) -> Column:
    """128 bits as 32 hex digits: xxhash64 after two different prefixes."""
    half = lambda seed: F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), canon))), 16, "0")
    return F.concat(half(0x5EED0001), half(0x5EED0002))


_NO_ID = -(2**63)
#: one row: its id (null: the least long) and two hashes of its text
ROW = ("key", "x", "y")
#: so many rows are sent to all tasks, never more
FEW = 100_000


def _keyed(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("key", F.xxhash64(F.lit(1), "text").alias("x"), F.xxhash64(F.lit(2), "text").alias("y"), "text")


def _neighbours(rows: DataFrame) -> DataFrame:
    """Adds after (struct of ROW and d of the row that follows; after the last comes the first), before (ROW of the row that it follows) and want, the characters that row takes."""
    ends = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    placed = checkpointed(rows.repartitionByRange(int(ends), *ROW).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*ROW)
    here, cut = F.struct(*ROW, "d"), F.floor(F.col("n_chars") / 4).cast("int")
    back = F.struct(*ROW, cut.alias("cut"))
    # one row for each range of the sort, of which there are as many as shuffle partitions
    edges = placed.groupBy("part").agg(F.min(here).alias("first"), F.max(back).alias("last"))
    around, everything = Window.orderBy("part"), Window.partitionBy()
    edges = edges.select("part", F.coalesce(F.lead("first").over(around), F.min("first").over(everything)).alias("to"), F.coalesce(F.lag("last").over(around), F.max("last").over(everything)).alias("from"))
    near = placed.withColumn("after", F.lead(here).over(inside)).withColumn("before", F.lag(back).over(inside)).join(F.broadcast(edges), "part")
    near = near.withColumn("after", F.coalesce("after", "to")).withColumn("before", F.coalesce("before", "from"))
    return near.select(*ROW, "copies", "n_chars", "d", "after", "before")


def _listed(rows: DataFrame) -> DataFrame:
    """Adds listed: another row has the digest. The digests of large groups of copies, of which there are few, go to the rows; the others are joined."""
    counts = checkpointed(rows.groupBy("d").agg(F.count("*").alias("n")).where("n > 1"))
    total = rows.count()
    # n adds up to total at most, so there are no more than FEW of them
    large = F.broadcast(counts.where(F.col("n") * FEW > total * 8).select("d"))
    small = counts.where(F.col("n") * FEW <= total * 8).select("d", F.lit(True).alias("listed"))
    rest = rows.join(large, "d", "left_anti").join(small, "d", "left")
    return rest.unionByName(rows.join(large, "d", "left_semi").withColumn("listed", F.lit(True)))


def _some(texts: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """texts of the n wanted rows; a wanted list that is short goes to the texts instead of both being shuffled."""
    return texts.join(F.broadcast(wanted) if n <= FEW else wanted, list(ROW), "left_semi").dropDuplicates(list(ROW))


def _unlike(named: DataFrame) -> DataFrame:
    """(digest, sha, ordinal) of the digests under which different canonical bytes lie; as a rule there are none."""
    each = Window.partitionBy("digest")
    texts = named.groupBy("digest", "bytes").agg(F.count("*").alias("n"))
    twice = texts.groupBy("digest").agg(F.count("*").alias("different")).where("different > 1")
    unlike = texts.join(twice, "digest")
    return checkpointed(unlike.select("digest", F.sha2("bytes", 256).alias("sha"), F.row_number().over(each.orderBy("bytes")).alias("ordinal")))


def _ordinals(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, unlike): rows has ROW, kind (d or e), digest and sha of every row that shares a digest."""
    listed = found.where("bytes IS NOT NULL").select(*ROW, F.lit("d").alias("kind"), F.col("d").alias("digest"), "bytes")
    # edited texts that fall on another row's digest: short ones, by chance
    open_ = found.where("NOT same").select(F.col("e").alias("digest"), F.lit(1).alias("edited"))
    twice = found.select(F.col("d").alias("digest"), F.lit(0).alias("edited")).unionByName(open_).groupBy("digest").agg(F.count("*").alias("n"), F.max("edited").alias("edited"))
    twice = checkpointed(twice.where("n > 1 AND edited = 1").select("digest"))
    named = listed
    if twice.head(1):
        lone = found.where("bytes IS NULL").select(*ROW, F.col("d").alias("digest")).join(twice, "digest")
        edited = found.where("NOT same").select(*ROW, F.col("e").alias("digest"), F.floor(F.col("n_chars") / 4).cast("int").alias("cut"), "n_chars", *[F.col(f"after.{c}").alias(f"a{c}") for c in ROW]).join(twice, "digest")
        lone, edited = checkpointed(lone), checkpointed(edited)
        wanted = checkpointed(lone.select(*ROW).unionByName(edited.select(*ROW)).unionByName(edited.select(*[F.col(f"a{c}").alias(c) for c in ROW])).distinct())
        texts = checkpointed(_some(_keyed(docs), wanted, wanted.count()))
        own = lone.join(texts, list(ROW)).select(*ROW, F.lit("d").alias("kind"), "digest", canonical(F.col("text")).alias("bytes"))
        after = texts.select(*[F.col(c).alias(f"a{c}") for c in ROW], F.col("text").alias("next"))
        both = edited.join(texts, list(ROW)).join(after, [f"a{c}" for c in ROW]).select(*ROW, F.lit("e").alias("kind"), "digest", canonical(_edited("next")).alias("bytes"))
        named = named.unionByName(own).unionByName(both)
    return named.select(*ROW, "kind", "digest", F.sha2("bytes", 256).alias("sha")), _unlike(named)


def _edited(start: str) -> Column:
    return F.concat(F.expr("substring(text, 1, CAST(n_chars AS INT) - cut)"), F.expr(f"substring({start}, 1, cut)"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last quarter (n_chars/4, rounded down) replaced by the start
    of the next document. Likeness of exact fingerprints is 1 if equal, else 0. Null text is empty;
    a null doc_id goes first; equal doc_ids go by two hashes of their texts; rows of equal id and text are one document, so what is
    next to each of them is the next other row. Other columns are ignored; no rows: no rows.
    """
    texts = _keyed(docs)
    facts = checkpointed(texts.select(*ROW, F.length("text").cast("long").alias("n_chars"), digest(canonical(F.col("text"))).alias("d")))
    rows = facts.groupBy(*ROW, "n_chars", "d").agg(F.count("*").alias("copies"))
    near = checkpointed(_neighbours(rows))
    near = checkpointed(_listed(near))

    # both uses need the same columns of one exchange, so Spark moves the texts once
    whole = texts.groupBy(*ROW).agg(F.first("text").alias("text"))
    starts = whole.join(near.select(*ROW, "before"), list(ROW))
    starts = starts.select(F.col("before.key").alias("key"), F.col("before.x").alias("x"), F.col("before.y").alias("y"), F.expr("substring(text, 1, before.cut)").alias("start"))
    found = whole.join(near.drop("before"), list(ROW)).join(starts, list(ROW)).withColumn("cut", F.floor(F.col("n_chars") / 4).cast("int"))
    found = found.withColumn("edited", _edited("start")).withColumn("e", digest(canonical(F.col("edited"))))
    # equal digests of a row's own two texts are compared here
    same = F.when(F.col("e") == F.col("d"), canonical(F.col("edited")) == canonical(F.col("text"))).otherwise(False)
    found = checkpointed(found.select(*ROW, "copies", "n_chars", "d", "after", "e", F.sha2("edited", 256).alias("sha"), same.alias("same"), F.when(F.col("listed"), canonical(F.col("text"))).alias("bytes")))

    named, unlike = _ordinals(docs, found)
    out = found.drop("bytes").withColumns({"f": F.col("d"), "ef": F.col("e"), "nf": F.col("after.d")})
    if unlike.head(1):
        tags = named.join(unlike, ["digest", "sha"]).select(*ROW, "kind", F.concat(F.lit("-"), "ordinal").alias("tag"))
        for kind, name, at in (("d", "f", ROW), ("e", "ef", ROW), ("d", "nf", [f"after.{c}" for c in ROW])):
            tag = tags.where(F.col("kind") == kind).select(*[F.col(c).alias(f"t{c}") for c in ROW], "tag")
            on = [F.col(a) == F.col(f"t{c}") for a, c in zip(at, ROW, strict=True)]
            out = out.join(tag, on, "left").withColumn(name, F.concat(name, F.coalesce("tag", F.lit("")))).drop("tag", *[f"t{c}" for c in ROW])
    out = out.withColumn("ef", F.when(F.col("same"), F.col("f")).otherwise(F.col("ef")))
    # two steps, so that no array is longer than 65,536 or a 65,536th of the copies
    each = out.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / 65536).cast("long"))))
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(65536).cast("long"), F.col("copies") - F.col("lot") * 65536))))
    likeness = lambda other: F.when(F.col("f") == F.col(other), 1.0).otherwise(0.0)
    doc_id = F.when(F.col("key") != _NO_ID, F.col("key"))
    return each.select(doc_id.alias("doc_id"), "n_chars", F.col("sha").alias("edited_sha256"), F.col("f").alias("fingerprint"), F.col("ef").alias("edited_fingerprint"), likeness("ef").alias("near_edited"), likeness("nf").alias("near_next"))
