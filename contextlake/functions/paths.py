"""Columns about paths: POSIX, relative to the root."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contextlake import constants as C


def to_posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Without the last segment; a root file has an empty one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def extension(path: Column) -> Column:
    """Lower case, with the dot; empty for names without one or with the first character as the only one."""
    return F.regexp_extract(F.lower(basename(path)), r"^.+(\.[^.]*)$", 1)


def trailing_extension(path: Column) -> Column:
    """The registry's flavour: any name's last dot and what follows it, so .env has .env."""
    return F.regexp_extract(F.lower(path), r"(\.[^.]+)$", 1)


def ancestors(path: Column) -> Column:
    """All directories above a path, the root's first: a/b/c.txt has a and a/b."""
    parts = F.split(path, "/")
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.when(F.size(parts) > 1, up).otherwise(F.array().cast("array<string>"))


def natural_key(path: Column) -> Column:
    """Digit runs as their length in four digits and then the digits without leading zeros, so that a7 sorts with a007 and before a10.

    A path of more than 9,999 digits in a run exists in no file system.
    """
    digits = lambda run: F.regexp_replace(run, "^0+(?=.)", "")
    sized = lambda run: F.concat(F.lpad(F.length(digits(run)).cast("string"), 4, "0"), digits(run))
    runs = F.regexp_extract_all(path, F.lit("([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(runs, lambda run: F.when(run.rlike("^[0-9]"), sized(run)).otherwise(run)), "")


def collated(path: Column) -> Column:
    """The terminal sort key: natural, without regard to case and accents."""
    return F.collate(natural_key(path), "en_CI_AI")


def is_within(path: Column, scope: str) -> Column:
    return F.lit(True) if scope in ("", ".") else (path == scope) | F.startswith(path, F.lit(scope + "/"))


def role_hint(path: Column) -> Column:
    """What a path is for: root configuration, generated, or by the deepest telling directory name; else null."""
    name = basename(path)
    at_root = ~F.contains(path, F.lit("/"))
    table = F.create_map(*[F.lit(x) for role, names in C.DIRECTORY_ROLES.items() for n in names for x in (n, role)])
    roles = F.filter(F.transform(F.reverse(F.split(F.lower(path), "/")), lambda s: F.element_at(table, s)), lambda r: r.isNotNull())
    return F.when(at_root & F.lower(name).isin(*C.ROOT_CONFIG_FILES), "project-config").when(name.rlike(C.GENERATED_NAMES), "generated").otherwise(F.try_element_at(roles, F.lit(1)))


def fence_language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for ext, lang in C.FENCE_LANGUAGES.items() for x in (f".{ext}", lang)])
    return F.coalesce(F.element_at(table, extension(path)), F.lit(""))


def split_rule_source(source: Column) -> tuple[Column, Column]:
    """file and line of ``file:line``; without a line the whole and null."""
    line = F.regexp_extract(source, r"^(.*):(\d+)$", 2)
    return F.when(line != "", F.regexp_extract(source, r"^(.*):(\d+)$", 1)).otherwise(source), F.when(line != "", line).cast("int")
