"""Directory trees as text: one row for each line, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextlake import constants as C
from contextlake.functions import paths, sizes
from contextlake.operators.order import rank_all


def tree_lines(files: DataFrame, with_sizes: bool = True) -> DataFrame:
    """path, depth, is_file, order_key, line of every directory and file.

    Siblings: directories first, then by name in plain collation (case and accents only break ties), then by code point. All nodes are
    ranked at once by (parent, sibling order) in ranges, so a directory of any size is dealt to many tasks; a node's key is
    the ranks of the nodes above it and its own, so sorting by order_key is a walk of the tree.
    """
    parts = F.split("path", "/")
    node = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("path"), i.alias("depth"), (i == F.size(parts)).alias("is_file"))))
    nodes = files.select(node.alias("n"), F.coalesce("size", F.lit(0)).alias("size")).groupBy("n.path", "n.depth").agg(F.max("n.is_file").alias("is_file"), F.sum("size").alias("size"))
    nodes = nodes.withColumn("parent", paths.dirname(F.col("path"))).withColumn("name", paths.basename(F.col("path")))
    nodes = rank_all(nodes, [F.col("parent"), F.col("is_file"), F.collate("name", "en"), F.col("name")])
    last = nodes.groupBy("parent").agg(F.max("rank").alias("last"))
    nodes = nodes.join(last, "parent").withColumn("is_last", F.col("rank") == F.col("last"))
    # zeros in front, so that text order is number order
    nodes = nodes.withColumn("place", F.lpad(F.col("rank").cast("string"), 19, "0"))
    # directories are far fewer than files, and each looks up those above it: their places make its key, their being last its prefix
    folders = nodes.where(~F.col("is_file")).select("path", "place", "is_last", "depth")
    up = F.explode(F.array_append(paths.ancestors(F.col("path")), F.col("path")))
    above = folders.select("path", up.alias("above")).join(folders.select(F.col("path").alias("above"), F.col("depth").alias("d"), F.col("place").alias("p"), F.col("is_last").alias("l")), "above")
    chain = above.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("d", "p", "l"))).alias("chain")).withColumnRenamed("path", "parent")
    shown = nodes.join(chain, "parent", "left").withColumn("chain", F.coalesce("chain", F.array().cast("array<struct<d:int,p:string,l:boolean>>")))
    key = F.concat(F.array_join(F.transform("chain", lambda x: F.concat(x["p"], F.lit("/"))), ""), F.col("place"))
    indent = F.array_join(F.transform("chain", lambda x: F.when(x["l"], C.TREE_EMPTY).otherwise(C.TREE_VERTICAL)), "")
    connector = F.when(F.col("is_last"), C.TREE_LAST).otherwise(C.TREE_MIDDLE)
    label = F.when(F.col("is_file"), F.concat("name", F.concat(F.lit(" ("), sizes.format_bytes(F.col("size")), F.lit(")"))) if with_sizes else F.col("name")).otherwise(F.concat("name", F.lit("/")))
    return shown.select("path", "depth", "is_file", key.alias("order_key"), F.concat(indent, connector, label).alias("line"))
