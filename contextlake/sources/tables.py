"""The one base relation, ``files``, from tables of documents or pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("md", "txt", "py", "json", "log")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, size (bytes), modified, forced, content. content is pruned from the scan unless a query uses it; size needs it."""
    return as_files(table(spark, sf_dir, "documents"))


def as_files(docs: DataFrame) -> DataFrame:
    """The relation of a table or stream of documents."""
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat(F.lit("corpus/"), F.coalesce("lang", F.lit("und")), F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/doc"), F.col("doc_id"), F.lit("."), ext)
    return docs.select(
        "doc_id",
        path.alias("path"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, CAST(doc_id % 1000 AS INT))").alias("modified"),
        (F.col("doc_id") % 97 == 0).alias("forced"),
        F.col("text").alias("content"),
    )


def files_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select(F.concat(F.lit("pages/p"), F.col("page_id"), F.lit(".html")).alias("path"), F.octet_length("html").cast("bigint").alias("size"), F.col("html").alias("content"))


def changes_from_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, status): labels stand in for the change lists of a version-control provider; a file may be in several."""
    labels = table(spark, sf_dir, "labels")
    modified = labels.where("quality = 0").select("doc_id", F.lit("modified").alias("status"))
    staged = labels.where("toxic = 1").select("doc_id", F.lit("staged").alias("status"))
    created = labels.where("doc_id % 10 = 3").select("doc_id", F.lit("created").alias("status"))
    return modified.unionByName(staged).unionByName(created)
