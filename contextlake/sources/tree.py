"""Directory trees as a batch source: input partitions are directories, split further down until there are enough of them.

``spark.read.format("ctxtree").option("path", root).load()`` gives path, absolute_path, size, modified,
is_symlink and problem. Subtrees whose directory is pruned by name are never entered; with ``scope`` only the
subtree of that path is listed. Through files_from_tree(), conditions of ``where`` on path, size and problem reach the source:
directories that cannot hold a wanted path are neither opened nor become tasks. Contents are read later, for the selected files only, by load_contents().
"""

from __future__ import annotations

import errno
import os
import time
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith,
)

SCHEMA = "path string, absolute_path string, size bigint, modified timestamp, is_symlink boolean, problem string"


#: places of the columns whose conditions the source takes, and what it takes
PLACES = {"path": 0, "absolute_path": 1, "size": 2, "problem": 5}
TESTS = {
    EqualTo: lambda x, f: x == f.value, In: lambda x, f: x in f.value, StringStartsWith: lambda x, f: x.startswith(f.value), StringEndsWith: lambda x, f: x.endswith(f.value), StringContains: lambda x, f: f.value in x,
    GreaterThan: lambda x, f: x > f.value, GreaterThanOrEqual: lambda x, f: x >= f.value, LessThan: lambda x, f: x < f.value, LessThanOrEqual: lambda x, f: x <= f.value,
}


class _Subtree(InputPartition):
    def __init__(self, relative: str, recurse: bool):
        self.relative, self.recurse = relative, recurse


PASSING = {errno.EAGAIN, errno.EBUSY, errno.EMFILE, errno.ENFILE, errno.EINTR, errno.EIO, errno.ETIMEDOUT, errno.ESTALE}


def with_retry(action, attempts: int = 3, delay: float = 0.1, cap: float = 2.0):
    """The action's result; an error of the file system that may pass is tried again after a doubling pause, others are not."""
    for n in range(attempts):
        try:
            return action()
        except OSError as error:
            if n + 1 == attempts or error.errno not in PASSING:
                raise
            time.sleep(min(cap, delay * 2**n))


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.realpath(options["path"])
        self.scope = options.get("scope", "").strip("/")
        self.prune = set(filter(None, options.get("prune", ".git").split(",")))
        self.follow = options.get("followsymlinks", "false") == "true"
        self.max_depth = int(options.get("maxdepth", "-1"))
        self.tasks = int(options.get("tasks", "64"))
        self.conditions: list[Filter] = []
        self.opened = 0  # directories, by this reader

    def _entries(self, directory: str) -> list[os.DirEntry]:
        self.opened += 1
        return with_retry(lambda: list(os.scandir(directory)))

    def _holds(self, row: tuple) -> bool:
        for f in self.conditions:
            value = row[PLACES[f.attribute[0]]]
            if isinstance(f, (IsNull, IsNotNull)):
                held = (value is None) == isinstance(f, IsNull)
            else:  # null is neither true nor false, so its row goes
                held = value is not None and TESTS[type(f)](value, f)
            if not held:
                return False
        return True

    def _may_hold(self, relative: str) -> bool:
        """Whether a wanted path can be this directory's or one below; links may lead to it by a longer path only."""
        within = f"{relative}/" if relative else ""
        for f in self.conditions:
            if f.attribute == ("path",):
                if isinstance(f, StringStartsWith) and not (f.value.startswith(within) or within.startswith(f.value) or relative.startswith(f.value)):
                    return False
                if isinstance(f, (EqualTo, In)) and not any(p == relative or p.startswith(within) for p in (f.value if isinstance(f, In) else [f.value]) if p is not None):
                    return False
        return True

    def partitions(self) -> list[InputPartition]:
        """Directories are opened level by level until there are ``tasks`` of them: those opened are listed alone, those left with all below."""
        if os.path.isfile(os.path.join(self.root, self.scope)):
            return [_Subtree(self.scope, False)]
        alone, open_ = [], [self.scope] if self._may_hold(self.scope) else []
        while open_ and len(alone) + len(open_) < self.tasks:
            below = []
            for relative in open_:
                alone.append(relative)
                deep = relative.count("/") + bool(relative) - self.scope.count("/") - bool(self.scope)
                if 0 <= self.max_depth <= deep:
                    continue
                try:
                    entries = self._entries(os.path.join(self.root, relative))
                except OSError:  # told when it is read
                    continue
                below += [f"{relative}/{e.name}".strip("/") for e in entries if e.is_dir(follow_symlinks=False) and e.name not in self.prune]
            open_ = sorted(filter(self._may_hold, below))
        return [*(_Subtree(r, False) for r in alone), *(_Subtree(r, True) for r in open_)]

    def _inside(self, path: str) -> bool:
        real = os.path.realpath(path)
        return real == self.root or real.startswith(self.root + os.sep)

    def read(self, partition: _Subtree) -> Iterator[tuple]:
        return filter(self._holds, self._walk(partition))

    def _walk(self, partition: _Subtree) -> Iterator[tuple]:
        first = os.path.join(self.root, partition.relative)
        if os.path.isfile(first):
            yield self._row(partition.relative, first, None)
            return
        stack, seen = [partition.relative], set()
        while stack:
            relative = stack.pop()
            here = os.path.join(self.root, relative)
            real = os.path.realpath(here)
            if real in seen:  # a cycle of links
                continue
            seen.add(real)
            try:
                entries = sorted(self._entries(here), key=lambda e: e.name)
            except OSError as error:
                yield (relative, here, None, None, False, f"unreadable: {error.strerror}")
                continue
            for entry in entries:
                path = f"{relative}/{entry.name}".strip("/")
                if entry.is_symlink() and not self.follow:
                    continue
                if entry.is_symlink() and not self._inside(entry.path):
                    yield (path, entry.path, None, None, True, "symlinkEscape")
                elif entry.is_dir():
                    deep = path.count("/") - self.scope.count("/") - bool(self.scope)
                    if (partition.recurse or entry.is_symlink() or relative != partition.relative) and entry.name not in self.prune and not 0 <= self.max_depth <= deep and self._may_hold(path):
                        stack.append(path)
                elif entry.is_file():
                    yield self._row(path, entry.path, entry)

    def _row(self, path: str, absolute: str, entry) -> tuple:
        try:
            stat = with_retry(lambda: os.stat(absolute))
        except OSError as error:
            return (path, absolute, None, None, False, f"unreadable: {error.strerror}")
        return (path, absolute, stat.st_size, datetime.fromtimestamp(stat.st_mtime, timezone.utc), bool(entry and entry.is_symlink()), None)


class PrunedTreeReader(TreeReader):
    """A reader that takes conditions; Spark refuses it unless spark.sql.python.filterPushdown.enabled is set."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if len(f.attribute if hasattr(f, "attribute") else ()) == 1 and f.attribute[0] in PLACES and type(f) in (*TESTS, IsNull, IsNotNull):
                self.conditions.append(f)
            else:
                yield f


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ctxtree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PrunedTreeReader(self.options) if self.options.get("conditions") == "true" else TreeReader(self.options)


def files_from_tree(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """Options: scope, prune (names, by comma), followSymlinks, maxDepth, tasks. Executors must see root.

    Sets spark.sql.python.filterPushdown.enabled in the session, so that conditions on the relation narrow the walk itself.
    """
    spark.dataSource.register(TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("ctxtree").options(path=root, conditions="true", **options).load().withColumn("forced", F.lit(False))


def _read_within(path: str | None, root: str) -> bytes | None:
    try:
        if path is None or os.path.commonpath([os.path.realpath(path), root]) != root:
            return None
        with open(path, "rb") as handle:
            return handle.read()
    except OSError:
        return None


def load_contents(files: DataFrame, root: str) -> DataFrame:
    """Adds raw (bytes) to the files of the relation and opens no other; null outside root or where a file went meanwhile."""
    import pyarrow as pa

    root = os.path.realpath(root)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):  # contents of few files at a time
                part = batch.slice(lo, 64)
                raw = pa.array([_read_within(x, root) for x in part.column(part.schema.get_field_index("absolute_path")).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, raw], names=[*part.schema.names, "raw"])

    return files.mapInArrow(run, StructType([*files.schema.fields, StructField("raw", BinaryType())]))


def ignore_rules_from_tree(spark: SparkSession, files: DataFrame, names: tuple[str, ...] = (".gitignore", ".ctxignore")) -> list[tuple[str, str, str]]:
    """(directory, file name, text) of every ignore file of a tree: a few small files, read on the driver."""
    found = files.where(F.substring_index("path", "/", -1).isin(*names) & F.col("problem").isNull()).select("path", "absolute_path").orderBy("path").collect()
    out = []
    for row in found:
        with open(row.absolute_path, encoding="utf-8-sig", errors="replace") as handle:
            out.append((os.path.dirname(row.path), os.path.basename(row.path), handle.read()))
    return out
