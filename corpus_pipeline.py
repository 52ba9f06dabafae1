"""A corpus pipeline of five stages, each over all rows that its predecessor kept.

run(spark, sf_dir) applies STAGES to ``documents``. Every stage's result is written as Parquet below
the folder in ``spark.checkpoint.dir`` and read again, which cuts lineage and survives lost executors.

All stages but the last return the columns of ``documents`` and drop any others, whatever their names. An empty table stays empty in every stage. A
null text is an empty one, and texts of any length are taken whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contextlake.llm import decontamination, language, mixing, neardup, suffixes
from contextlake.llm.store import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: a document stays if its language is known with this score at least
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go: no letters (also null and empty texts), or a score under LEAST_SCORE.

    Rows with a null lang or doc_id are judged like others; of equal scores the first language by name counts; repeated rows all stay or go.
    """
    found = language.identify(docs, docs.where("lang IS NOT NULL"), carry=("text", "lang", "source", "n_chars"))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays, one without an id only if none has one.

    Texts are told apart by their digests, so unlike texts that share an id or have none all stay.
    """
    _, texts = neardup.text_classes(docs, count_links=False)
    first = texts.groupBy("component").agg(F.min(F.struct(F.isnull("rep").alias("unnamed"), F.coalesce("rep", F.lit(0)).alias("id"), "x", "y")).alias("first")).select("first.*")
    text, same = F.coalesce("text", F.lit("")), ["x", "y", "id", "unnamed"]
    keyed = docs.withColumns({"x": F.xxhash64(F.lit(1), text), "y": F.xxhash64(F.lit(2), text), "id": F.coalesce("doc_id", F.lit(0)), "unnamed": F.isnull("doc_id")})
    # repeated rows of that text and id: the first by source
    nth = F.row_number().over(Window.partitionBy(*same).orderBy("text", "source", "lang"))
    return keyed.join(first, same, "left_semi").withColumn("nth", nth).where("nth = 1").select(*COLUMNS)


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that an earlier document has go; documents of which no word is left go too.

    A character of which some bytes were removed goes whole. A null doc_id is before all others; rows of equal doc_id do not take from each other.
    """
    found = suffixes.remove_repeats(docs, carry=("lang", "source"), whole_characters=True)
    return found.select("doc_id", F.col("kept").cast("string").alias("text"), "lang", "source").where(F.trim("text") != "").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with an item of ``benchmark`` go; repeated rows all stay or go, null and empty texts stay, null items match nothing."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.find_leaks(docs, benchmark, carry=("lang", "source", "n_chars"), keep_text=True)
    return found.where(F.size("leaks") == 0).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; a null source is the last one, repeated rows are documents of their own."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language_id", identify_language),
    ("minhash_neardup", drop_near_duplicates),
    ("suffix_array_dedup", remove_repeated_strings),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix),
]

#: SQL expresses neither the classifier nor the sketches; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
