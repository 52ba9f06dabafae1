"""Classification of contents and what is shown of binary ones; deduplication; registered transforms."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from contextlake import constants as C
from contextlake.functions import paths, sizes, text
from contextlake.operators.order import checkpointed
from contextlake.operators.rules import matches_any


def extension_category(path: Column, groups: dict[str, tuple[str, ...]] = C.BINARY_EXTENSIONS) -> Column:
    """The first group with the path's extension; null for text and unknown ones."""
    table: dict[str, str] = {}
    for name, extensions in groups.items():
        for e in extensions:
            if e not in C.NEVER_BINARY:
                table.setdefault(f".{e.lower()}", name)
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), paths.extension(path))


def is_trusted(path: Column) -> Column:
    return paths.extension(path).isin(*[f".{e}" for e in C.NEVER_BINARY])


def magic(raw: Column) -> Column:
    """struct<category, name> of the first signature that the bytes begin with, else null."""
    head = F.hex(F.substring(raw, 1, 16))
    out = F.lit(None).cast("struct<category:string,name:string>")
    for category, name, sig in reversed(C.MAGIC):
        out = F.when(F.startswith(head, F.lit(sig)), F.struct(F.lit(category).alias("category"), F.lit(name).alias("name"))).otherwise(out)
    return out


_SNIFFED = StructType([StructField("category", StringType()), StructField("name", StringType())])
_SIGNATURES = [(category, name, bytes.fromhex(sig)) for category, name, sig in C.MAGIC]
_CONTROL = np.array([(b < 0x20 and b not in (9, 10, 13)) or b == 0x7F for b in range(256)])


def sniffed(raw: bytes, trusted: bool) -> tuple[str | None, str | None]:
    """(category, name) by the bytes: a signature, a NUL, or too many control bytes (tab, line feed and carriage return aside).

    An extension that is always text is only called binary by a number and a share of control bytes.
    """
    b = np.frombuffer(raw, np.uint8)[: C.SNIFF_BYTES]
    control = int(_CONTROL[b].sum())
    share = control / max(1, len(b))
    if trusted:
        return ("other", None) if control >= C.TRUSTED_CONTROL_FLOOR and share > C.TRUSTED_CONTROL_RATIO else (None, None)
    for category, name, signature in _SIGNATURES:
        if raw.startswith(signature):
            return category, name
    return ("other", None) if (b == 0).any() or share > C.NON_PRINTABLE_RATIO else (None, None)


@F.pandas_udf(_SNIFFED)
def sniff(raw: pd.Series, decided: pd.Series, trusted: pd.Series) -> pd.DataFrame:
    """What names have decided, else what bytes say."""
    rows = [(d, None) if d is not None else sniffed(r, t) if r is not None else (None, None) for r, d, t in zip(raw, decided, trusted, strict=True)]
    return pd.DataFrame(rows, columns=["category", "name"])


def control_ratio(content: Column) -> Column:
    """The share of control characters in text that is a string already, without Python."""
    head = F.substring(content, 1, C.SNIFF_BYTES)
    return F.regexp_count(head, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")) / F.greatest(F.length(head), F.lit(1))


def classify(files: DataFrame) -> DataFrame:
    """Adds is_binary, binary_category, binary_name. files has path and raw (bytes, may be null).

    Structure-only names first, then the extension, and only for what no extension decides the leading bytes, a NUL and
    the share of control bytes. Extensions that are always text need both a count and a share to be called binary.
    """
    path = F.col("path")
    decided = F.when(matches_any(path, C.STRUCTURE_ONLY), "structure-only").otherwise(extension_category(path))
    # bytes of files that their names decide are not sent to Python
    open_raw = F.when(decided.isNull(), F.substring(F.col("raw"), 1, C.SNIFF_BYTES))
    files = files.withColumn("_sniff", sniff(open_raw, decided, is_trusted(path)))
    files = files.withColumn("binary_category", F.col("_sniff.category")).withColumn("binary_name", F.col("_sniff.name")).drop("_sniff")
    return files.withColumn("is_binary", F.col("binary_category").isNotNull())


def policy_of(category: Column, default: str = C.BINARY_POLICY_DEFAULT, exceptions: dict[str, str] | None = None) -> Column:
    table = C.BINARY_POLICY_EXCEPTIONS if exceptions is None else exceptions
    out = F.lit(default)
    for name, policy in table.items():
        out = F.when(category == name, policy).otherwise(out)
    for p in (default, *table.values()):
        if p not in ("skip", "comment", "placeholder", "base64"):
            raise ValueError(f"unknown binary policy {p!r}")
    return out


def binary_comment(path: Column, category: Column, size: Column) -> Column:
    out = F.lit(C.BINARY_COMMENT)
    for mark, value in (("{TYPE}", F.upper(category)), ("{PATH}", text.sanitize_comment(path)), ("{SIZE}", sizes.format_bytes(size))):
        out = F.replace(out, F.lit(mark), value)
    return out


def load(classified: DataFrame, default: str = C.BINARY_POLICY_DEFAULT, exceptions: dict[str, str] | None = None, max_base64: int = C.MAX_BASE64_SIZE) -> tuple[DataFrame, DataFrame]:
    """(loaded, skipped): content and encoding by policy; text is decoded with \\n as the only line end."""
    files = classified.withColumn("policy", F.when(F.col("is_binary") & (F.col("binary_category") != "structure-only"), policy_of(F.col("binary_category"), default, exceptions)))
    decoded = text.normalise_newlines(F.make_valid_utf8(F.col("raw").cast("string")))
    too_large = F.octet_length("raw") > max_base64
    content = (
        F.when(F.col("binary_category") == "structure-only", C.STRUCTURE_ONLY_BODY)
        .when((F.col("policy") == "base64") & too_large, F.lit("[Binary file too large to embed]"))
        .when(F.col("policy") == "base64", text.one_line_base64(F.col("raw")))
        .when(F.col("policy") == "comment", binary_comment(F.col("path"), F.col("binary_category"), F.col("size")))
        .when(F.col("policy") == "placeholder", C.BINARY_PLACEHOLDER)
        .otherwise(decoded)
    )
    loaded = files.withColumn("content", content).withColumn("encoding", F.when((F.col("policy") == "base64") & ~too_large, "base64").when(~F.col("is_binary"), "utf8"))
    skip = F.coalesce(F.col("policy") == "skip", F.lit(False))
    return loaded.where(~skip), files.where(skip)


def deduplicate(files: DataFrame, keep: str = "first") -> tuple[DataFrame, DataFrame]:
    """(kept, duplicates): one file of each content; files without content and most binary ones are never duplicates.

    files has path, rank, content, is_binary and encoding. keep="last" puts the last file's row in the first one's rank.
    The digests' least and greatest ranks are aggregated before the shuffle, so a content that millions share is one row for each task.
    """
    eligible = F.col("content").isNotNull() & (~F.col("is_binary") | (F.coalesce(F.col("encoding"), F.lit("")) == "base64")) & (F.coalesce(F.col("binary_category"), F.lit("")) != "structure-only")
    files = files.withColumn("sha256", F.when(eligible, F.sha2(F.col("content"), 256)))
    ends = files.where("sha256 IS NOT NULL").groupBy("sha256").agg(F.min("rank").alias("_first"), F.max("rank").alias("_last"), F.min_by("path", "rank").alias("_first_path"), F.max_by("path", "rank").alias("_last_path"))
    joined = files.join(ends, "sha256", "left")
    chosen = F.col("_first") if keep == "first" else F.col("_last")
    is_kept = F.col("sha256").isNull() | (F.col("rank") == chosen)
    kept = joined.where(is_kept).withColumn("rank", F.coalesce("_first", "rank")).drop("_first", "_last", "_first_path", "_last_path")
    duplicates = joined.where(~is_kept).withColumn("duplicate_of", F.col("_first_path") if keep == "first" else F.col("_last_path")).drop("_first", "_last", "_first_path", "_last_path")
    return kept, duplicates


@dataclass
class Transform:
    """A named function of content, applied by Arrow batches to the files whose extension it names."""

    name: str
    apply: Callable[[str], str]
    extensions: tuple[str, ...] = ()
    priority: int = 0
    is_default: bool = False
    heavy: bool = False
    order_sensitive: bool = False
    needs: tuple[str, ...] = ()
    conflicts: tuple[str, ...] = ()
    mime_types: tuple[str, ...] = ()
    inputs: tuple[str, ...] = ("any",)
    outputs: tuple[str, ...] = ("any",)
    idempotent: bool = True
    tags: tuple[str, ...] = ()
    requirements: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)
    flush: Callable[[], None] | None = None  # called when a task has seen its last file

    def cache_key(self) -> Column:
        """A digest of the file's path, size and time, and of the transform's name and options."""
        modified = F.coalesce((F.unix_micros(F.col("modified").cast("timestamp")) / 1000).cast("bigint"), F.lit(0))
        parts = F.struct(F.col("path"), F.coalesce("size", F.lit(0)).alias("size"), modified.alias("mtime"), F.lit(self.name).alias("transformer"), F.lit(json.dumps(self.options, sort_keys=True)).alias("options"))
        return F.sha2(F.to_json(parts), 256)


@dataclass
class TransformCache:
    """What heavy transforms made, as a table of (key, content, at) in a shared folder."""

    folder: str
    ttl_hours: int = 24

    def rows(self, spark: SparkSession) -> DataFrame:
        try:
            return spark.read.schema("key string, content string, at timestamp").parquet(self.folder)
        except AnalysisException:  # nothing was written yet
            return spark.createDataFrame([], "key string, content string, at timestamp")

    def fresh(self, spark: SparkSession) -> DataFrame:
        """The newest content of each key that is not too old."""
        young = self.rows(spark).where(F.col("at") > F.current_timestamp() - F.make_dt_interval(hours=F.lit(self.ttl_hours)))
        return young.groupBy("key").agg(F.max_by("content", "at").alias("content"))

    def add(self, made: DataFrame) -> None:
        made.select("key", "content", F.current_timestamp().alias("at")).write.mode("append").parquet(self.folder)

    def status(self, spark: SparkSession) -> DataFrame:
        """entries, bytes, oldest, newest."""
        return self.rows(spark).agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"), F.min("at").alias("oldest"), F.max("at").alias("newest"))


@dataclass
class Registry:
    """Empty unless something is registered; then every file goes to the best match of its extension or to the default."""

    transforms: dict[str, Transform] = field(default_factory=dict)

    def register(self, transform: Transform) -> None:
        self.transforms[transform.name] = transform

    def dispatch(self, path: Column, mime: Column | None = None, required: bool = False) -> Column:
        """The name of the transform for a path: highest priority among its extension's and its MIME type's, else the default, else null (an error if required)."""
        default = next((t.name for t in self.transforms.values() if t.is_default), None)
        out = F.raise_error(F.concat(F.lit("no transform for "), path)).cast("string") if required and default is None else F.lit(default).cast("string")
        # one flat CASE, the highest priority first
        case = None
        for t in sorted(self.transforms.values(), key=lambda t: (t.priority, t.name), reverse=True):
            hit = paths.trailing_extension(path).isin(*t.extensions) if t.extensions else F.lit(False)
            hit = hit | F.coalesce(mime.isin(*t.mime_types), F.lit(False)) if mime is not None and t.mime_types else hit
            case = (F if case is None else case).when(hit, t.name)
        return out if case is None else case.otherwise(out)

    def advice(self, plan: list[str]) -> list[tuple[str, str]]:
        """(severity, message) of what a valid plan could do better."""
        known = [self.transforms[n] for n in plan if n in self.transforms]
        out = []
        for a, b in zip(known, known[1:], strict=False):
            if a.outputs[0] != "any" and b.inputs[0] != "any" and not set(a.outputs) & set(b.inputs):
                out.append(("warning", f"{b.name} takes {', '.join(b.inputs)}, and {a.name} before it gives {', '.join(a.outputs)}"))
        for i, t in enumerate(known):
            out += [("warning", f"{t.name} depends on order and follows {u.name}, which changes what it sees at every run") for u in known[:i] if t.order_sensitive and not u.idempotent]
            if t.heavy and i < len(known) - 2 and not any(u.heavy for u in known[i + 1 :]):
                out.append(("info", f"{t.name} is heavy and could come later"))
            if t.requirements:
                out.append(("info", f"{t.name} needs {', '.join(sorted(t.requirements))}"))
        if (heavy := sum(t.heavy for t in known)) > 3:
            out.append(("warning", f"{heavy} heavy transforms"))
        for tag in sorted({x for t in known for x in t.tags} & {"summary", "text-extraction"}):
            if len(names := [t.name for t in known if tag in t.tags]) > 1:
                out.append(("info", f"{', '.join(names)} do alike ({tag})"))
        return out

    def check(self, plan: list[str]) -> list[str]:
        """What is wrong with a plan: unknown names, missing or circular needs, conflicts."""
        issues = [f"unknown transform {n}" for n in plan if n not in self.transforms]
        known = [self.transforms[n] for n in plan if n in self.transforms]
        issues += [f"{t.name} needs {n}" for t in known for n in t.needs if n not in plan]
        issues += [f"{t.name} conflicts with {n}" for t in known for n in t.conflicts if n in plan]
        done: set[str] = set()
        while left := [t for t in known if t.name not in done]:
            ready = [t.name for t in left if all(n in done or n not in plan for n in t.needs)]
            if not ready:
                return [*issues, "circular needs: " + ", ".join(t.name for t in left)]
            done.update(ready)
        return issues

    def ordered(self, plan: list[str]) -> list[str]:
        """Order-sensitive first, then light, heavy last; equal ones in the plan's order, and never before what they need."""
        ranked = sorted(plan, key=lambda n: (not self.transforms[n].order_sensitive, self.transforms[n].heavy))
        out: list[str] = []
        while ranked:
            n = next(n for n in ranked if all(x in out or x not in ranked for x in self.transforms[n].needs))
            out.append(n)
            ranked.remove(n)
        return out

    def run_cached(self, files: DataFrame, cache: TransformCache) -> DataFrame:
        """run(), but what heavy transforms made within the cache's time to live is taken from there, and what they make now is added.

        files has path, size, modified and content.
        """
        heavy = {n: t for n, t in self.transforms.items() if t.heavy}
        key = None
        chosen = self.dispatch(F.col("path"))
        for n, t in heavy.items():
            key = (F if key is None else key).when(chosen == n, t.cache_key())
        if key is None:
            return self.run(files)
        keyed = files.withColumn("_key", key)
        known = cache.fresh(files.sparkSession).select(F.col("key").alias("_key"), F.col("content").alias("_known"))
        light, heavy_rows = self.run(keyed.where("_key IS NULL")), keyed.where("_key IS NOT NULL")
        made = checkpointed(self.run(heavy_rows.join(known, "_key", "left_anti")))
        cache.add(made.where("transform_error IS NULL").select(F.col("_key").alias("key"), "content"))
        found = heavy_rows.join(known, "_key").withColumn("content", F.col("_known")).drop("_known").withColumn("transform_error", F.lit(None).cast("string"))
        return light.unionByName(made).unionByName(found.select(*light.columns)).drop("_key")

    def run(self, files: DataFrame) -> DataFrame:
        """content transformed and transform_error; a file whose transform fails keeps its content."""
        if not self.transforms:
            return files.withColumn("transform_error", F.lit(None).cast("string"))
        flushes = [t.flush for t in self.transforms.values() if t.flush]
        functions = {n: t.apply for n, t in self.transforms.items()}

        def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                contents, errors = [], []
                for name, content in zip(batch.column("_transform").to_pylist(), batch.column("content").to_pylist(), strict=True):
                    error = None
                    if name is not None and content is not None:
                        try:
                            content = functions[name](content)
                        except Exception as failure:  # the row stays, the failure is told
                            error = f"{name}: {failure}"
                    contents.append(content)
                    errors.append(error)
                at = batch.schema.get_field_index("content")
                batch = batch.set_column(at, "content", pa.array(contents, pa.string())).drop_columns(["_transform"])
                yield batch.append_column("transform_error", pa.array(errors, pa.string()))
            for flush in flushes:
                flush()

        schema = files.schema.add("transform_error", "string")
        return files.withColumn("_transform", self.dispatch(F.col("path"))).mapInArrow(apply, schema)
