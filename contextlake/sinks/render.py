"""Documents as chunks: every file's text is one row, made in the tasks; only headers are built on the driver.

A document's chunks in the order of ``rank`` are the document. to_file() streams them through the driver one partition
at a time; write_chunks() leaves the same document as text files of sorted ranges, for outputs that no one machine should hold,
and publish() does so by a commit that replaces the last one.
"""

from __future__ import annotations

import json
import os
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from contextlake import constants as C
from contextlake.functions import paths, text
from contextlake.sinks import documents
from contextlake.sinks.tree import tree_lines

_FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
FORMATS = ("xml", "json", "ndjson", "markdown", "sarif", "tree")


def checked_format(name: str) -> str:
    name = {"md": "markdown"}.get(name, name)
    if name not in FORMATS:
        raise ValueError(f"unknown format {name!r}; one of {', '.join(FORMATS)}")
    return name


def format_of_file(name: str) -> str:
    return {".xml": "xml", ".json": "json", ".ndjson": "ndjson", ".jsonl": "ndjson", ".md": "markdown", ".sarif": "sarif", ".txt": "tree"}.get(os.path.splitext(name)[1].lower(), "xml")


@dataclass
class Document:
    """What is resolved once for a document; clock fields are left out when it is reproducible."""

    base_path: str
    profile: str = "default"
    instructions: str | None = None
    instructions_name: str | None = None
    git: dict | None = None
    only_tree: bool = False
    line_numbers: bool = False
    metadata: bool = True
    reproducible: bool = True
    generated: str | None = None  # a time stamp, shown unless the document is reproducible
    pretty: bool = False
    options: dict = field(default_factory=dict)

    def stamp(self) -> str | None:
        return None if self.reproducible else self.generated or datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def _column(files: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in files.columns else F.lit(None).cast(kind)


def _body(files: DataFrame, doc: Document) -> Column:
    body = F.coalesce(F.col("content"), F.lit(""))
    return F.when(F.coalesce(_column(files, "is_binary", "boolean"), F.lit(False)), body).otherwise(text.add_line_numbers(body)) if doc.line_numbers else body


def file_chunks(files: DataFrame, output: str, doc: Document) -> DataFrame:
    """rank, path, chunk of every file. files has rank, path, size and, unless only the tree is asked for, content."""
    make = {"xml": _xml, "json": _json, "ndjson": _ndjson, "markdown": _markdown, "sarif": _sarif}[output]
    return files.where(F.col("path").isNotNull()).select("rank", "path", make(files, doc).alias("chunk"))


def _common(files: DataFrame, doc: Document) -> dict[str, Column]:
    modified = text.iso_timestamp(F.col("modified")) if "modified" in files.columns and not doc.reproducible and doc.metadata else F.lit(None).cast("string")
    return {
        "modified": modified, "binary": F.coalesce(_column(files, "is_binary", "boolean"), F.lit(False)), "encoding": _column(files, "encoding", "string"),
        "category": _column(files, "binary_category", "string"), "status": _column(files, "git_status", "string"), "truncated": F.coalesce(_column(files, "truncated", "boolean"), F.lit(False)),
    }


def _xml(files: DataFrame, doc: Document) -> Column:
    c = _common(files, doc)
    attribute = lambda name, value: F.coalesce(F.concat(F.lit(f' {name}="'), text.escape_xml_attribute(value.cast("string")), F.lit('"')), F.lit(""))
    head = F.concat(
        F.lit('    <ct:file path="@'), text.escape_xml_attribute(F.col("path")), F.lit('" size="'), F.col("size").cast("string"), F.lit('"'), attribute("modified", c["modified"]),
        F.when(c["binary"], F.concat(F.lit(' binary="true"'), attribute("encoding", c["encoding"]))).otherwise(""),
        attribute("binaryCategory", c["category"]) if doc.metadata else F.lit(""), attribute("gitStatus", c["status"]), F.lit(">"),
    )
    body = F.lit("") if doc.only_tree else F.concat(F.lit("<![CDATA["), text.escape_cdata(_body(files, doc)), F.lit("]]>"))
    return F.concat(head, body, F.lit("</ct:file>\n"))


def _record(files: DataFrame, doc: Document, kind: str | None) -> Column:
    c = _common(files, doc)
    fields = [F.lit(kind).alias("type")] if kind else []
    fields += [F.col("path"), F.col("size"), c["modified"].alias("modified"), c["binary"].alias("isBinary"), F.when(c["encoding"] != "utf8", c["encoding"]).alias("encoding")]
    fields += [c["category"].alias("binaryCategory")] if doc.metadata else []
    fields += [c["status"].alias("gitStatus"), F.when(c["truncated"], F.lit(True)).alias("truncated"), F.when(c["truncated"], _column(files, "original_length", "bigint")).alias("originalLength")]
    fields += [] if doc.only_tree else [_body(files, doc).alias("content")]
    return F.to_json(F.struct(*fields))  # without fields that are null


@F.pandas_udf(StringType())
def _pretty(records: pd.Series) -> pd.Series:
    """Records with two blanks for each level, set in by two levels."""
    return records.map(lambda r: json.dumps(json.loads(r), ensure_ascii=False, indent=2).replace("\n", "\n    ")).radd("    ")


def _json(files: DataFrame, doc: Document) -> Column:
    record = _record(files, doc, None)
    return _pretty(record) if doc.pretty else record


def _ndjson(files: DataFrame, doc: Document) -> Column:
    return F.concat(_record(files, doc, "file"), F.lit("\n"))


def _markdown(files: DataFrame, doc: Document) -> Column:
    c = _common(files, doc)
    at = F.concat(F.lit("@"), F.col("path"))
    body = _body(files, doc)
    fence = text.choose_fence(F.col("content"))
    plain = lambda v: v.cast("string")
    parts = [F.concat(F.lit("path="), text.quote_scalar(at)), F.concat(F.lit("size="), plain(F.col("size")))]
    if doc.metadata:
        parts.append(F.concat(F.lit('hash="sha256:'), F.sha2(F.col("content"), 256), F.lit('"')))
    parts += [F.concat(F.lit("git="), text.quote_scalar(c["status"])) if "git_status" in files.columns else F.lit(None).cast("string"), F.concat(F.lit("binary="), plain(c["binary"])), F.concat(F.lit("truncated="), plain(c["truncated"]))]
    begin = F.concat(F.lit("<!-- ctx:file-begin "), F.concat_ws(" ", *parts), F.lit(" -->"))
    language = F.when(c["binary"], F.lit("text")).otherwise(paths.fence_language(F.col("path")))
    end = text.marker("file-end", path=at)
    return F.concat_ws("\n", begin, F.lit(""), F.concat(F.lit("### "), at), F.lit(""), F.concat(fence, language), body, fence, F.lit(""), end, F.lit(""), F.lit(""))


def _sarif(files: DataFrame, doc: Document) -> Column:
    lines = text.count_lines(F.coalesce(F.col("content"), F.lit("")))
    location = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.lit(1).alias("startLine"), lines.alias("endLine")).alias("region")).alias("physicalLocation"))
    return F.to_json(F.struct(F.lit("file").alias("ruleId"), F.lit("note").alias("level"), F.struct(F.concat(F.lit("File: "), F.col("path")).alias("text")).alias("message"), F.array(location).alias("locations")))


def header(output: str, doc: Document, files: int, size: int, tree: str = "") -> str:
    """What stands before the first file."""
    import html

    stamp = doc.stamp()
    if output == "xml":
        out = f'<?xml version="1.0" encoding="UTF-8"?>\n<ct:directory xmlns:ct="{C.XML_NAMESPACE}" path="{html.escape(doc.base_path)}">\n  <ct:metadata>\n    <ct:format>{C.FORMAT_IDS["xml"]}</ct:format>\n'
        out += f"    <ct:generated>{stamp}</ct:generated>\n" if stamp else ""
        out += f"    <ct:fileCount>{files}</ct:fileCount>\n    <ct:totalSize>{size}</ct:totalSize>\n    <ct:profile>{html.escape(doc.profile, quote=False)}</ct:profile>\n"
        if doc.git:
            out += f"    <ct:git>\n      <ct:branch>{html.escape(str(doc.git.get('branch', '')), quote=False)}</ct:branch>\n    </ct:git>\n"
        out += f"    <ct:directoryStructure>{html.escape(tree, quote=False)}</ct:directoryStructure>\n" if doc.metadata and tree else ""
        if doc.instructions:
            name = f' name="{html.escape(doc.instructions_name)}"' if doc.instructions_name else ""
            plain = _FORBIDDEN.sub("", doc.instructions).replace("]]>", "]]]]><![CDATA[>")
            out += f"    <ct:instructions{name}><![CDATA[{plain}]]></ct:instructions>\n"
        return out + "  </ct:metadata>\n  <ct:files>\n"
    if output in ("json", "ndjson"):
        meta = {"type": "metadata"} if output == "ndjson" else {}
        meta |= {"format": C.FORMAT_IDS[output], "directory": doc.base_path, "fileCount": files, "totalSize": size, "profile": doc.profile}
        meta |= {"generated": stamp} if stamp else {}
        meta |= {"git": doc.git} if doc.git else {}
        meta |= {"instructions": {"name": doc.instructions_name or "default", "content": doc.instructions}} if doc.instructions else {}
        if output == "ndjson":
            return json.dumps(meta, ensure_ascii=False) + "\n"
        if doc.pretty:
            inside = json.dumps(meta, ensure_ascii=False, indent=2).replace("\n", "\n  ")
            return '{\n  "directory": ' + json.dumps(doc.base_path, ensure_ascii=False) + ',\n  "metadata": ' + inside + ',\n  "files": [\n'
        return '{"directory":' + json.dumps(doc.base_path) + ',"metadata":' + json.dumps(meta, ensure_ascii=False) + ',"files":[\n'
    if output == "markdown":
        quote = lambda s: '"' + s.replace('"', '\\"') + '"'
        front = ["---", f"format: {C.FORMAT_IDS['markdown']}", f"tool: {C.TOOL_NAME}", f"base_path: {quote(doc.base_path)}", f"profile: {quote(doc.profile)}", f"file_count: {files}", f"total_size_bytes: {size}", *([f"generated: {stamp}"] if stamp else []), f"only_tree: {str(doc.only_tree).lower()}", f"include_line_numbers: {str(doc.line_numbers).lower()}", "---", ""]
        body = [f"# Export of {os.path.basename(doc.base_path)}", "", "## Directory Tree", "```text", tree, "```", ""]
        body += ["## Instructions", "", doc.instructions, ""] if doc.instructions else []
        return "\n".join([*front, *body, *([] if doc.only_tree else ["## Files", "", ""])])
    if output == "sarif":
        return '{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"' + C.TOOL_NAME + '","rules":[{"id":"file"}]}},"results":[\n'
    return f"{os.path.basename(doc.base_path)}/\n"


def footer(output: str, doc: Document, files: int, size: int) -> str:
    return {
        "xml": "  </ct:files>\n</ct:directory>\n", "json": "\n  ]\n}\n" if doc.pretty else "\n]}\n", "ndjson": json.dumps({"type": "summary", "fileCount": files, "totalSize": size}) + "\n",
        "markdown": "", "sarif": "\n]}]}\n", "tree": f"\n{files} files, {size} bytes\n",
    }[output]


def document_chunks(files: DataFrame, output: str, doc: Document) -> Iterator[str]:
    """The document's chunks in order; files come to the driver a partition at a time."""
    output = checked_format(output)
    count, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tree = ""
    if output == "tree" or (doc.metadata and output in ("xml", "markdown")):
        tree = "\n".join(r.line for r in tree_lines(files, with_sizes=output != "xml").orderBy("order_key").select("line").toLocalIterator())
    yield header(output, doc, count, size, tree)
    if output == "tree":
        yield tree
    elif not (doc.only_tree and output == "markdown"):
        between = ",\n" if output in ("json", "sarif") else ""
        for n, row in enumerate(file_chunks(files, output, doc).orderBy("rank").toLocalIterator()):
            yield (between if n else "") + row.chunk
    yield footer(output, doc, count, size)


def deliver(files: DataFrame, output: str | None, doc: Document, target: str) -> int:
    """To standard output for ``-``, else to a file, whose name tells the format where none is given. The bytes written."""
    output = output or ("xml" if target == "-" else format_of_file(target))
    if target != "-":
        return to_file(files, output, doc, target)
    written = 0
    for chunk in document_chunks(files, output, doc):
        written += len(chunk.encode("utf-8"))
        sys.stdout.write(chunk)
    return written


def to_file(files: DataFrame, output: str, doc: Document, target: str) -> int:
    """Writes the document beside the target and then renames it; the bytes written."""
    temporary = f"{target}.{os.getpid()}.part"
    try:
        with open(temporary, "w", encoding="utf-8", newline="") as handle:
            for chunk in document_chunks(files, output, doc):
                handle.write(chunk)
        os.replace(temporary, target)
    finally:
        if os.path.exists(temporary):
            os.remove(temporary)
    return os.path.getsize(target)


def document_rows(files: DataFrame, output: str, doc: Document, partitions: int | None = None) -> DataFrame:
    """The lines of to_file()'s document (value) in sorted partitions, as many as a shuffle has if not told, for outputs too large for one machine.

    Header, lines of the tree, chunks and footer are rows of one sorted frame; a row is its text without the last line end, which
    the text files add. Only counts and the header's own lines are made on the driver.
    """
    output = checked_format(output)
    spark = files.sparkSession
    count, size, last = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.max("rank")).first()
    rows = lambda items: spark.createDataFrame(items, "part int, rank bigint, place string, value string")
    mark = "\0" if count and (output == "tree" or (doc.metadata and output in ("xml", "markdown"))) else ""
    head = header(output, doc, count, size, mark)
    shown = bool(mark) and (output == "tree" or mark in head)
    before, _, after = head.partition(mark) if mark and mark in head else (head, "", "")
    parts = []
    if shown:
        lines = tree_lines(files, with_sizes=output != "xml")
        first, final = lines.agg(F.min("order_key"), F.max("order_key")).first()
        line = text.escape_xml_text(F.col("line")) if output == "xml" else F.col("line")
        # the first and the last line share theirs with what stands around the tree
        open_lines, _, beside = before.rpartition("\n")
        closing, _, rest = after.partition("\n")
        line = F.concat(F.when(F.col("order_key") == first, F.lit(beside)).otherwise(""), line, F.when(F.col("order_key") == final, F.lit(closing)).otherwise(""))
        parts += [rows([(0, 0, "", open_lines)] if open_lines else []), lines.select(F.lit(1).alias("part"), F.lit(0).cast("bigint").alias("rank"), F.col("order_key").alias("place"), line.alias("value"))]
        head = rest
    if head:
        parts.append(rows([(2, 0, "", head.removesuffix("\n"))]))
    end = footer(output, doc, count, size).removeprefix("\n" if count else "")
    if output != "tree" and not (doc.only_tree and output == "markdown"):
        chunks = file_chunks(files, output, doc)
        value = F.regexp_replace("chunk", r"\n\z", "")
        if output in ("json", "sarif"):
            value = F.when(F.col("rank") < F.lit(last), F.concat(value, F.lit(","))).otherwise(value)
        parts.append(chunks.select(F.lit(3).alias("part"), F.col("rank").cast("bigint").alias("rank"), F.lit("").alias("place"), value.alias("value")))
    if end:
        parts.append(rows([(4, 0, "", end.removesuffix("\n"))]))
    whole = reduce(DataFrame.unionByName, parts)
    keys = ["part", "rank", "place"]
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return whole.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).select("value")


def write_chunks(files: DataFrame, output: str, doc: Document, folder: str, partitions: int = 200) -> None:
    """The document as text files in the order of their names, in a folder that is not there yet."""
    document_rows(files, output, doc, partitions).write.text(folder)


def publish(files: DataFrame, output: str, doc: Document, folder: str, partitions: int | None = None) -> dict:
    """Replaces the document in folder in one step, once all its parts are written; a run that fails leaves the old one. What was committed."""
    documents.commit_rows(document_rows(files, output, doc, partitions), folder)
    return documents.describe(folder)
