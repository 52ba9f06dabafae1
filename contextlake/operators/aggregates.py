"""Roll-ups of selected files for inventories and estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextlake import constants as C
from contextlake.functions import paths, text


def by_extension(files: DataFrame) -> DataFrame:
    return files.groupBy(paths.extension(F.col("path")).alias("extension")).agg(F.count("*").alias("files"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))


def by_directory(files: DataFrame, depth: int = 1) -> DataFrame:
    """path (with a slash at the end), files, bytes, hint and the three most frequent extensions of each directory of the given depth."""
    parts = F.split("path", "/")
    key = F.concat(F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(depth), F.size(parts) - 1)), "/"), F.lit("/"))
    each = files.where(F.contains("path", F.lit("/"))).groupBy(key.alias("directory"), paths.extension(F.col("path")).alias("extension")).agg(F.count("*").alias("n"), F.sum(F.coalesce("size", F.lit(0))).alias("size"))
    # a directory has few extensions: they are counted before they meet
    nth = F.row_number().over(Window.partitionBy("directory").orderBy(F.desc("n"), "extension"))
    ranked = each.withColumn("nth", nth)
    main = F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= 3, F.struct("nth", "extension", "n")))), lambda x: F.concat(x["extension"], F.lit(":"), x["n"]))
    out = ranked.groupBy("directory").agg(F.sum("n").alias("files"), F.sum("size").alias("bytes"), main.alias("main_extensions"))
    return out.select(F.col("directory").alias("path"), "files", "bytes", paths.role_hint(F.expr("left(directory, length(directory) - 1)")).alias("hint"), "main_extensions")


def root_files(files: DataFrame) -> DataFrame:
    return files.where(~F.contains("path", F.lit("/"))).select("path", "size", paths.role_hint(F.col("path")).alias("hint"))


def tree_totals(files: DataFrame, depth: int = 4) -> DataFrame:
    """path, name, depth, is_file, files, bytes of every node down to the depth; what is deeper counts in its ancestors."""
    parts = F.split("path", "/")
    node = F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth))), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("path"), i.alias("depth"), (i == F.size(parts)).alias("is_file"))))
    each = files.select(node.alias("node"), F.coalesce("size", F.lit(0)).alias("size"))
    return each.groupBy("node.path", "node.depth").agg(F.max("node.is_file").alias("is_file"), F.count("*").alias("files"), F.sum("size").alias("bytes")).withColumn("name", paths.basename(F.col("path")))


def by_area(files: DataFrame) -> DataFrame:
    """Totals by top-level directory; root files are areas of their own."""
    top = F.substring_index("path", "/", 1)
    area = F.when(F.contains("path", F.lit("/")), F.concat(top, F.lit("/"))).otherwise(top)
    return files.groupBy(area.alias("area")).agg(F.count("*").alias("files"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))


def by_outcome(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("outcome").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.min("size").alias("smallest"), F.max("size").alias("largest"))


def estimate(files: DataFrame, output: str = "xml", length: Column | None = None, line_numbers: bool = False, only_tree: bool = False) -> DataFrame:
    """characters and tokens that a rendered document takes; length is each file's characters (its bytes if it was not read)."""
    length = F.coalesce(F.col("size"), F.lit(0)) if length is None else length
    numbers = F.ceil(length / 40) * 6 if line_numbers else F.lit(0)
    body = F.lit(0) if only_tree or output == "tree" else length + numbers
    chars = F.sum(text.utf16_length(F.col("path")) + 8 + C.FILE_OVERHEAD[output] + body)
    return files.agg((F.coalesce(chars, F.lit(0)) + C.DOCUMENT_OVERHEAD[output]).cast("bigint").alias("characters")).withColumn("tokens", text.estimate_tokens(F.col("characters")))
