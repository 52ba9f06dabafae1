"""Layered exclusion: which rule decides about a path, as one expression without a shuffle.

Layers are ordered; within and across them the last rule that matches wins. A directory that is
excluded takes everything below it along, whatever deeper negations say, so every ancestor is judged before
the path itself. Rules are few and compiled on the driver; the files are never collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextlake import constants as C
from contextlake.functions import paths
from contextlake.functions.patterns import IgnoreRule, glob_regex, ignore_rule


@dataclass(frozen=True)
class Layer:
    """Lines of one source; base is the directory that they are relative to."""

    kind: str
    lines: tuple[str, ...]
    base: str = ""
    source: str = ""

    def rules(self) -> list[tuple[int, IgnoreRule]]:
        return [(n, r) for n, line in enumerate(self.lines, 1) if (r := ignore_rule(line))]


def config_layer() -> Layer:
    return Layer("config-exclude", tuple(f"{d}/" for d in C.EXCLUDED_DIRECTORIES) + C.EXCLUDED_FILES, source="defaults")


def tests_layer() -> Layer:
    return Layer("test-exclude", C.TEST_PATTERNS, source="tests")


def nested_layers(ignore_files: list[tuple[str, str, str]], order: tuple[str, ...] = (".gitignore", C.IGNORE_FILE)) -> list[Layer]:
    """Layers of ignore files (directory, name, text): by depth, then directory, then in the order of names."""
    kinds = {".gitignore": "gitignore", C.IGNORE_FILE: "toolignore"}
    known = [(d.count("/") + bool(d), d, order.index(n), n, text) for d, n, text in ignore_files if n in order]
    return [Layer(kinds.get(n, "gitignore"), tuple(text.removeprefix("﻿").splitlines()), d, f"{d}/{n}".lstrip("/")) for _, d, _, n, text in sorted(known)]


def without_rules_blocking(layer: Layer, scope: str) -> Layer:
    """The layer without the rules that exclude the scope or a directory above it: an explicit scope overrides them."""
    import re

    chain = [scope[: i or None] for i in (*[k for k, c in enumerate(scope) if c == "/"], 0)]
    blocks = lambda line: (r := ignore_rule(line)) and not r.negated and any(re.search(r.regex, p) for p in chain)
    return Layer(layer.kind, tuple(x for x in layer.lines if not blocks(x)), layer.base, layer.source)


def last_match(path: Column, is_directory: Column | bool, layers: list[Layer]) -> Column:
    """struct<ignored, kind, rule, rule_source> of the last rule that matches, null if none does."""
    is_directory = F.lit(is_directory) if isinstance(is_directory, bool) else is_directory
    # one flat CASE from the last rule to the first gives a place in a table of constants, which plans quickly
    place, known = None, []
    for layer in reversed(layers):
        inside = F.lit(True) if not layer.base else F.startswith(path, F.lit(layer.base + "/"))
        relative = path if not layer.base else F.substr(path, F.lit(len(layer.base) + 2))
        for line, rule in reversed(layer.rules()):
            hit = inside & relative.rlike(rule.regex) if layer.base else relative.rlike(rule.regex)
            hit = hit & is_directory if rule.directories_only else hit
            place = (F if place is None else place).when(hit, F.lit(len(known)))
            known.append(F.struct(F.lit(not rule.negated).alias("ignored"), F.lit(layer.kind).alias("kind"), F.lit(rule.pattern).alias("rule"), F.lit(f"{layer.source}:{line}").alias("rule_source")))
    if place is None:
        return F.lit(None).cast("struct<ignored:boolean,kind:string,rule:string,rule_source:string>")
    return F.get(F.array(*known), place)


def hard_excluded(path: Column) -> Column:
    """Nothing overrides this: a segment is .git, in any case."""
    return F.array_contains(F.split(F.lower(path), "/"), ".git")


def judge(files: DataFrame, layers: list[Layer]) -> DataFrame:
    """Adds verdict: struct<ignored, kind, rule, rule_source, pruned_by> of each file."""
    up = paths.ancestors(F.col("path"))
    judged = F.transform(up, lambda d: F.struct(d.alias("directory"), last_match(d, True, layers).alias("match")))
    pruned = F.try_element_at(F.filter(judged, lambda x: F.coalesce(x["match"]["ignored"], F.lit(False))), F.lit(1))
    files = files.withColumn("_pruned", pruned).withColumn("_own", last_match(F.col("path"), False, layers))
    return files.withColumn("verdict", verdict_of(F.col("path"), F.col("_pruned"), F.col("_own"))).drop("_pruned", "_own")


def verdict_of(path: Column, pruned: Column, own: Column) -> Column:
    """The verdict on a path from the first ignored directory above it (struct<directory, match>, or null) and its own match."""
    hard = F.struct(F.lit(True).alias("ignored"), F.lit("config-exclude").alias("kind"), F.lit(".git").alias("rule"), F.lit("built-in").alias("rule_source"), F.lit(None).cast("string").alias("pruned_by"))
    match = pruned["match"]
    by_directory = F.struct(F.lit(True).alias("ignored"), match["kind"].alias("kind"), match["rule"].alias("rule"), match["rule_source"].alias("rule_source"), pruned["directory"].alias("pruned_by"))
    itself = F.struct(F.coalesce(own["ignored"], F.lit(False)).alias("ignored"), own["kind"].alias("kind"), own["rule"].alias("rule"), own["rule_source"].alias("rule_source"), F.lit(None).cast("string").alias("pruned_by"))
    return F.when(hard_excluded(path), hard).when(pruned.isNotNull(), by_directory).otherwise(itself)


def every_match(path: Column, is_directory: Column, layers: list[Layer]) -> Column:
    """array<struct<path, ignored, kind, rule, rule_source>> of all rules that match, the deciding one last."""
    hits = []
    for layer in layers:
        inside = F.startswith(path, F.lit(layer.base + "/")) if layer.base else F.lit(True)
        relative = F.substr(path, F.lit(len(layer.base) + 2)) if layer.base else path
        for line, rule in layer.rules():
            hit = inside & relative.rlike(rule.regex) & (is_directory if rule.directories_only else F.lit(True))
            told = F.struct(path.alias("path"), F.lit(not rule.negated).alias("ignored"), F.lit(layer.kind).alias("kind"), F.lit(rule.pattern).alias("rule"), F.lit(f"{layer.source}:{line}").alias("rule_source"))
            hits.append(F.when(hit, told))
    if not hits:
        return F.array().cast("array<struct<path:string,ignored:boolean,kind:string,rule:string,rule_source:string>>")
    return F.filter(F.array(*hits), lambda h: h.isNotNull())


def trace(path: Column, layers: list[Layer]) -> Column:
    """Every rule that is met on the way to the verdict on a path: directory by directory from the root's, each in the order of the layers.

    The way ends at the first directory that is ignored. What was met last on what it ends at (path in the entries) is judge()'s rule; if nothing was
    met there, no rule decides. The plan grows with the rules, so this is for paths that someone asks about, not for all of a corpus.
    """
    subjects = F.array_append(F.transform(paths.ancestors(path), lambda d: F.struct(d.alias("path"), F.lit(True).alias("directory"))), F.struct(path.alias("path"), F.lit(False).alias("directory")))
    met = F.transform(subjects, lambda s: F.struct(s["directory"].alias("directory"), every_match(s["path"], s["directory"], layers).alias("hits")))
    ends = lambda s: s["directory"] & F.coalesce(F.try_element_at(s["hits"], F.lit(-1))["ignored"], F.lit(False))
    first = F.array_position(F.transform(met, ends), F.lit(True))
    return F.flatten(F.transform(F.slice(met, F.lit(1), F.when(first > 0, first).otherwise(F.size(met)).cast("int")), lambda s: s["hits"]))


def matches_any(path: Column, globs: list[str] | tuple[str, ...], dot: bool = True) -> Column:
    """One alternation of all globs; none match nothing."""
    return path.rlike("|".join(f"(?:{glob_regex(g, dot)})" for g in globs)) if globs else F.lit(False)


def reason_of(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in C.LAYER_REASONS.items() for x in pair])
    return F.coalesce(F.element_at(table, kind), F.lit("configExclude"))
