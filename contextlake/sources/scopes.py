"""Scopes and scan roots: which part of a tree a request is about."""

from __future__ import annotations

import os
import posixpath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextlake.functions import paths


def resolve_scopes(root: str, scopes: list[str]) -> list[str]:
    """Relative POSIX scopes, checked to lie inside root and not behind a link out of it; nested ones are subsumed.

    The whole tree as one entry makes all others superfluous (an empty list).
    """
    real_root, out = os.path.realpath(root), []
    for scope in scopes:
        clean = posixpath.normpath(scope.replace("\\", "/").strip() or ".")
        if clean.startswith("../") or clean == ".." or posixpath.isabs(clean):
            raise ValueError(f"scope leaves the root: {scope}")
        full = os.path.realpath(os.path.join(real_root, clean))
        if full != real_root and not full.startswith(real_root + os.sep):
            raise ValueError(f"scope leaves the root by a link: {scope}")
        if not os.path.exists(full):
            raise FileNotFoundError(scope)
        out.append(clean)
    return subsume(out)


def subsume(scopes: list[str]) -> list[str]:
    if "." in scopes:
        return []
    kept = sorted(set(scopes))
    return [s for s in kept if not any(s.startswith(other + "/") for other in kept if other != s)]


def subsume_rows(scopes: DataFrame) -> DataFrame:
    """subsume() of any number of rows (scope): those without another row above them, each once; the whole tree (``.``) leaves none.

    Each scope is joined to its own ancestors by equality, so no scope meets all others. Nulls are no scopes.
    """
    distinct = scopes.where("scope IS NOT NULL").select("scope").distinct()
    above = F.concat(F.array(F.lit(".")), paths.ancestors(F.col("scope")))
    below = distinct.where("scope <> '.'").select("scope", F.explode(above).alias("above")).join(distinct.select(F.col("scope").alias("above")), "above").select("scope")
    return distinct.where("scope <> '.'").join(below, "scope", "left_anti")


def target(path: str) -> tuple[str, list[str]]:
    """A file as target is its directory with that file as scope."""
    return (os.path.dirname(path) or ".", [os.path.basename(path)]) if os.path.isfile(path) else (path, [])
