"""Ignore files as a relation: any number of them, without a longer plan and without reading them on the driver.

Every line is a row (base, order, regex, ...). What is judged (each path, and each distinct directory above one) is joined to the rules
of its ancestors by equality of the base directory; of the rules that match, the one of the greatest order decides.
Directories are judged once, however many files they have, and a file learns from its parent what prunes it. Rules of the root meet
everything, so both sides of that key are dealt over ``salts`` parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextlake import constants as C
from contextlake.functions import paths
from contextlake.functions.patterns import ignore_rule
from contextlake.operators import rules
from contextlake.operators.order import checkpointed


def _compile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [ignore_rule(line) for line in batch["raw"]]
        batch = batch.assign(**{c: [getattr(r, c) if r else None for r in found] for c in ("pattern", "regex", "negated", "directories_only")})
        yield batch[[r is not None for r in found]].drop(columns="raw")


def rule_rows(ignore_files: DataFrame, names: tuple[str, ...] = (".gitignore", C.IGNORE_FILE), scopes: tuple[str, ...] = ()) -> DataFrame:
    """base, kind, source, line, place, pattern, regex, negated, directories_only of each rule of (directory, name, text).

    place orders all rules: by depth, directory, order of names and line. Files of other names and null texts have no rules. Rules that
    exclude a scope or a directory above it are left out, as an explicit scope overrides them.
    """
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name")).cast("int")
    base = F.coalesce(F.col("directory"), F.lit(""))
    deep = F.when(base == "", 0).otherwise(F.size(F.split(base, "/")))
    known = ignore_files.where(F.col("name").isin(*names)).select(base.alias("base"), deep.alias("deep"), order.alias("nth"), "name", F.regexp_replace("text", "^﻿", "").alias("text"))
    lines = known.select("base", "deep", "nth", "name", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("at", "raw"))
    kind = F.when(F.col("name") == C.IGNORE_FILE, "toolignore").otherwise("gitignore")
    source = F.when(F.col("base") == "", F.col("name")).otherwise(F.concat_ws("/", "base", "name"))
    rows = lines.select("base", "deep", "nth", kind.alias("kind"), source.alias("source"), (F.col("at") + 1).alias("line"), "raw")
    out = "base string, deep int, nth int, kind string, source string, line int, pattern string, regex string, negated boolean, directories_only boolean"
    compiled = rows.mapInPandas(_compile, out)
    for scope in scopes:
        chain = F.array(*[F.lit(scope[: i or None]) for i in (*[k for k, c in enumerate(scope) if c == "/"], 0)])
        compiled = compiled.where(F.col("negated") | ~F.exists(chain, lambda p: F.regexp_like(p, F.col("regex"))))
    place = F.struct("deep", "base", "nth", "line")
    return compiled.select("base", "kind", "source", "line", place.alias("place"), "pattern", "regex", "negated", "directories_only")


def _last_match(subjects: DataFrame, rule_table: DataFrame, salts: int) -> DataFrame:
    """match of each (path, directory) that some rule matches: the rule of the greatest place."""
    salt = F.pmod(F.xxhash64("path"), F.lit(salts)).cast("int")
    bases = F.concat(F.array(F.lit("")), paths.ancestors(F.col("path")))
    asked = subjects.select("path", "directory", F.explode(bases).alias("base")).withColumn("salt", F.when(F.col("base") == "", salt).otherwise(0))
    spread = F.when(F.col("base") == "", F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    table = rule_table.withColumn("salt", F.explode(spread))
    relative = F.when(F.col("base") == "", F.col("path")).otherwise(F.expr("substring(path, length(base) + 2)"))
    hit = (F.col("directory") | ~F.col("directories_only")) & F.regexp_like(relative, F.col("regex"))
    told = F.struct((~F.col("negated")).alias("ignored"), "kind", F.col("pattern").alias("rule"), F.concat_ws(":", "source", F.col("line").cast("string")).alias("rule_source"))
    return asked.join(table, ["base", "salt"]).where(hit).groupBy("path", "directory").agg(F.max_by(told, F.col("place")).alias("match"))


def judge_by_rows(files: DataFrame, rule_table: DataFrame, before: list[rules.Layer] = (), after: list[rules.Layer] = (), salts: int = 16) -> DataFrame:
    """Adds verdict as rules.judge() does, of layers before, then the rules of the table, then layers after.

    A path that is null has no directories and meets no rule; repeated paths have equal verdicts. No rules or no files are no special case.
    """
    path = F.col("path")
    above = checkpointed(files.select(F.explode(paths.ancestors(path)).alias("path")).distinct().withColumn("directory", F.lit(True)))
    own = files.where("path IS NOT NULL").select("path").distinct().withColumn("directory", F.lit(False))
    found = checkpointed(_last_match(above.unionByName(own), checkpointed(rule_table), salts))

    def decided(directory: bool, subject: DataFrame) -> DataFrame:
        match = found.where(F.col("directory") == directory).select("path", "match")
        late, early = rules.last_match(path, directory, list(after)), rules.last_match(path, directory, list(before))
        return subject.join(match, "path", "left").withColumn("match", F.coalesce(late, F.col("match"), early))

    ignored = decided(True, above).where("match.ignored").select(path.alias("top"), "match")
    # of a directory and those above it the first that is ignored
    chain = above.select(path.alias("parent"), F.explode(F.array_append(paths.ancestors(path), path)).alias("top"))
    pruned = chain.join(ignored, "top").groupBy("parent").agg(F.min_by(F.struct(F.col("top").alias("directory"), "match"), F.length("top")).alias("_pruned"))
    parent = F.when(F.contains(path, F.lit("/")), paths.dirname(path))
    judged = decided(False, files.withColumn("_parent", parent)).join(pruned.withColumnRenamed("parent", "_parent"), "_parent", "left").withColumnRenamed("match", "_own")
    return judged.withColumn("verdict", rules.verdict_of(path, F.col("_pruned"), F.col("_own"))).drop("_parent", "_pruned", "_own")

