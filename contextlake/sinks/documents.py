"""A document as a data sink with a commit: its parts are written aside by the tasks and become visible together.

``rows.write.format("ctxdocument").mode("overwrite").save(folder)`` writes each partition of a frame of one string column as a
part, in the order of the partitions; the parts one after the other are the document. Parts lie in a folder of their own for each
run. The commit names them in one small file, which replaces the last run's in one step: readers see the old document or
the new one. A run that fails, on a task or on the driver, leaves the old document; attempts that were lost or ran twice leave no
row, as only the parts that the commit names count. The document before the last stays on disk, for those that still read it.
The folder may be a path or a URI that executors and driver share; its file system must replace a file by a move.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

NAME = "ctxdocument"
INDEX = "_document.json"


def _place(folder: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _index(system, path: str) -> dict | None:
    """What is committed; None where nothing is."""
    try:
        with system.open_input_stream(posixpath.join(path, INDEX)) as handle:
            return json.loads(handle.read())
    except FileNotFoundError:
        return None


@dataclass
class Part(WriterCommitMessage):
    partition: int
    name: str | None  # None: the partition had no rows
    rows: int
    size: int


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.version = folder, f"v-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, path = _place(self.folder)
        aside = posixpath.join(path, self.version)
        name, rows, size, out = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.txt", 0, 0, None
        try:
            for batch in iterator:
                if batch.num_rows and out is None:
                    system.create_dir(aside, recursive=True)
                    out = system.open_output_stream(posixpath.join(aside, name))
                for line in batch.column(0):
                    data = (line.as_py() or "").encode("utf-8") + b"\n"
                    out.write(data)
                    rows, size = rows + 1, size + len(data)
        except BaseException:
            if out is not None:
                out.close()
                system.delete_file(posixpath.join(aside, name))
            raise
        if out is not None:
            out.close()
        return Part(context.partitionId(), name if rows else None, rows, size)

    def commit(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        system, path = _place(self.folder)
        system.create_dir(path, recursive=True)
        parts = sorted((m for m in messages if m is not None and m.name), key=lambda m: m.partition)
        old = _index(system, path) or {}
        told = {"version": self.version, "before": old.get("version"), "rows": sum(m.rows for m in parts), "bytes": sum(m.size for m in parts), "parts": [{"name": m.name, "rows": m.rows, "bytes": m.size} for m in parts]}
        fresh = posixpath.join(path, f"_{self.version}.json")
        with system.open_output_stream(fresh) as handle:
            handle.write(json.dumps(told).encode("utf-8"))
        system.move(fresh, posixpath.join(path, INDEX))
        # the document is there; what follows only tidies up
        named = {m.name for m in parts}
        for found in system.get_file_info(fs.FileSelector(posixpath.join(path, self.version), allow_not_found=True)):
            if found.base_name not in named:  # of attempts that were lost
                system.delete_file(found.path)
        if old.get("before"):
            self._drop(system, posixpath.join(path, old["before"]))

    def abort(self, messages: list[Part | None]) -> None:
        system, path = _place(self.folder)
        self._drop(system, posixpath.join(path, self.version))

    @staticmethod
    def _drop(system, path: str) -> None:
        try:
            system.delete_dir(path)
        except FileNotFoundError:
            pass


class DocumentSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        if not overwrite:
            raise ValueError("a document is replaced whole: write it in overwrite mode")
        if len(schema.fields) != 1 or schema.fields[0].dataType.typeName() != "string":
            raise ValueError("the rows of a document are one column of strings")
        return DocumentWriter(self.options["path"])


def commit_rows(rows: DataFrame, folder: str) -> None:
    """Replaces the document in folder by the rows, a line each (null: an empty line), in the order of their partitions."""
    rows.sparkSession.dataSource.register(DocumentSink)
    rows.write.format(NAME).mode("overwrite").save(folder)


def describe(folder: str) -> dict | None:
    """version, rows, bytes and parts of the committed document; None where none is."""
    return _index(*_place(folder))


def part_paths(folder: str) -> list[str]:
    """The committed parts, in order. No committed document is an error."""
    told = describe(folder)
    if told is None:
        raise FileNotFoundError(f"no document is committed in {folder}")
    return [posixpath.join(folder, told["version"], part["name"]) for part in told["parts"]]


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of the committed document as rows (value), with the part that each is in; parts are read by as many tasks."""
    found = part_paths(folder)
    if not found:
        return spark.createDataFrame([], "value string, part string")
    return spark.read.text(found).selectExpr("value", "_metadata.file_name AS part")


def stream_bytes(folder: str, block: int = 1 << 20) -> Iterator[bytes]:
    """The committed document in order, block by block."""
    told = describe(folder)
    if told is None:
        raise FileNotFoundError(f"no document is committed in {folder}")
    system, path = _place(folder)
    for part in told["parts"]:
        with system.open_input_stream(posixpath.join(path, told["version"], part["name"])) as handle:
            while data := handle.read(block):
                yield data
