"""Secrets: files that are not exported, and values that are masked in place. The rules are our own."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextlake import constants as C
from contextlake.operators.rules import matches_any

SECRET_FILES = ("**/.env", "**/.env.*", "**/*.pem", "**/*.p12", "**/*.pfx", "**/id_rsa", "**/id_ed25519", "**/.netrc", "**/.npmrc", "**/credentials.json")
#: (rule id, pattern, group that holds the secret); earlier rules win where spans overlap
DETECTORS = (
    ("private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", 0),
    ("private-key-start", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*", 0),  # of a file that ends before the key does
    ("aws-access-key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", 0),
    ("aws-secret-key", r"(?i)aws[\w-]{0,20}secret[\w-]{0,20}[\"']?\s{0,4}[:=]\s{0,4}[\"']?([A-Za-z0-9/+]{40})(?![A-Za-z0-9/+])", 1),
    ("service-token", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_-]{35}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|npm_[A-Za-z0-9]{36})", 0),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0),
    # names as they are written: db_password, service-client-secret, STRIPE_API_KEY
    ("assignment", r"(?i)(?<![A-Za-z0-9])(?:[A-Za-z0-9]{1,30}[_-]){0,4}(?:api[_-]?key|secret|token|passw(?:or)?d)[\"']?\s{0,4}[:=]\s{0,4}[\"']?([A-Za-z0-9+/_=.-]{12,})", 1),
)
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|your[-_].*|example.*|changeme.*|[a-z_]\w{0,30}(?:\.[a-z_]\w{0,30})+|process\.env.*|os\.environ.*|\$\{.*|<.*|(.)\1*)$")
#: what a text must contain for any detector to be worth running
ANY = r"(?i)(PRIVATE KEY|AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[sr]k_live_|AIza|SG\.|npm_|eyJ|api[_-]?key|secret|token|passw)"


def entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, rule) of secret values, by place; of overlapping ones the earlier rule's."""
    spans: list[tuple[int, int, str]] = []
    for rule, pattern, group in DETECTORS:
        for m in re.finditer(pattern, text):
            a, b = m.span(group)
            value = text[a:b]
            if rule == "assignment" and (entropy(value) < 3.0 or _PLACEHOLDER.match(value)):
                continue
            if all(b <= x or a >= y for x, y, _ in spans):
                spans.append((a, b, rule))
    return sorted(spans)


def mask(rule: str, value: str, mode: str) -> str:
    return {"typed": f"***REDACTED:{rule.upper()}***", "generic": "***REDACTED***", "hash": f"***{hashlib.sha256(value.encode()).hexdigest()[:12]}***"}[mode]


def redactor(mode: str = "typed"):
    """A pandas UDF: struct<content, findings, clean>; findings carry no secret, only place, length and a fingerprint. clean: no found value is left anywhere in the content."""
    mask("", "", mode)

    @F.pandas_udf("struct<content:string,findings:array<struct<rule:string,start_line:int,start_column:int,length:int,fingerprint:string>>,clean:boolean>")
    def redact(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for content in contents:
            found = find(content) if content else []
            out, last, told = [], 0, []
            for a, b, rule in found:
                out += [content[last:a], mask(rule, content[a:b], mode)]
                last = b
                line_start = content.rfind("\n", 0, a) + 1
                told.append({"rule": rule, "start_line": content.count("\n", 0, a) + 1, "start_column": a - line_start + 1, "length": b - a, "fingerprint": hashlib.sha256(content[a:b].encode()).hexdigest()[:16]})
            shown = "".join(out) + content[last:] if found else content
            rows.append((shown, told, not any(content[a:b] in shown for a, b, _ in found)))
        return pd.DataFrame(rows, columns=["content", "findings", "clean"])

    return redact


def secret_file(path: Column) -> Column:
    return matches_any(path, SECRET_FILES)


def screen(files: DataFrame, max_bytes: int = C.SECRET_MAX_FILE_BYTES, oversize: str = "exclude") -> DataFrame:
    """Adds secret_reason (secretFile, secretUnscannable or null) from names and sizes alone, as a plan can."""
    if oversize not in ("exclude", "scan", "fail"):
        raise ValueError(f"unknown policy {oversize!r}")
    large = (F.col("size") > max_bytes) & F.lit(oversize != "scan")
    return files.withColumn("secret_reason", F.when(secret_file(F.col("path")), "secretFile").when(large, "secretUnscannable"))


def guard(files: DataFrame, mode: str = "typed") -> DataFrame:
    """content redacted, findings and clean (no found value is left); only texts in which some detector could hit go to Python."""
    suspect = F.when(F.col("content").rlike(ANY), F.col("content"))
    files = files.withColumn("_guard", redactor(mode)(suspect))
    empty = F.array().cast("array<struct<rule:string,start_line:int,start_column:int,length:int,fingerprint:string>>")
    return files.withColumn("findings", F.coalesce(F.col("_guard.findings"), empty)).withColumn("clean", F.coalesce(F.col("_guard.clean"), F.lit(True))).withColumn("content", F.coalesce(F.col("_guard.content"), F.col("content"))).drop("_guard")


def counters(guarded: DataFrame, excluded: DataFrame, samples: int = 5) -> dict:
    """What the guard did: exact counts, and up to five paths of each kind. guarded holds the files that stay, excluded the ledger."""
    kinds = {"secretFile": "excludedSecretFiles", "secretUnscannable": "excludedUnscannable", "secretDetected": "excludedWithSecrets"}
    out = {"findings": 0, "redacted": 0, "redactedPaths": [], **{k: 0 for k in kinds.values()}, **{f"{k}Paths": [] for k in kinds.values()}}
    from pyspark.sql import Window

    rows = excluded.where(F.col("reason").isin(*kinds)).select("path", "reason", F.lit(0).alias("n"))
    if "findings" in guarded.columns:
        rows = rows.unionByName(guarded.where(F.size("findings") > 0).select("path", F.lit("redacted").alias("reason"), F.size("findings").alias("n")))
    # counts apart from samples: each task keeps its first few paths of a reason, so no task gets all files of one
    shown = rows.withColumn("_k", F.row_number().over(Window.partitionBy("reason").orderBy("path"))).where(F.col("_k") <= samples)
    shown = shown.groupBy("reason").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    for r in rows.groupBy("reason").agg(F.count("*").alias("files"), F.sum("n").alias("n")).join(shown, "reason", "left").collect():
        if r.reason == "redacted":
            out |= {"findings": r.n, "redacted": r.n, "redactedPaths": r.paths}
        else:
            out |= {kinds[r.reason]: r.files, f"{kinds[r.reason]}Paths": r.paths}
    return out


def summary(guarded: DataFrame, samples: int = 5) -> DataFrame:
    """rule, findings, files, and up to five sample paths."""
    each = guarded.select("path", F.explode("findings.rule").alias("rule"))
    counted = each.groupBy("rule", "path").agg(F.count("*").alias("n"))
    # the least paths are kept bounded while they are aggregated
    first = F.slice(F.array_sort(F.collect_set(F.col("path"))), 1, samples)
    top = counted.groupBy("rule").agg(F.sum("n").alias("findings"), F.count("*").alias("files"))
    from pyspark.sql import Window

    shown = counted.withColumn("_k", F.row_number().over(Window.partitionBy("rule").orderBy("path"))).where(F.col("_k") <= samples).groupBy("rule").agg(first.alias("sample_paths"))
    return top.join(shown, "rule")
