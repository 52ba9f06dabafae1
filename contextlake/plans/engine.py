"""One chain from candidates to a document; a plan and a run share it up to the contents.

Narrowing is one narrow expression; ranks are given after the count budget; contents are joined to the
files that are left. Every file that goes is a row of the ledger, so candidates = selected + excluded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextlake import constants as C
from contextlake.functions import paths
from contextlake.operators import aggregates, budgets, changes, content, ledger, order, rule_tables, rules, secrets
from contextlake.request import PolicyFailure, Request, SecretsDetected
from contextlake.sinks import render


def layers_of(request: Request, nested: list[rules.Layer] = (), global_lines: tuple[str, ...] = (), info_lines: tuple[str, ...] = ()) -> list[rules.Layer]:
    """The layers in rising precedence: defaults, tests, global, info, ignore files by depth, profile, options.

    Explicit scopes override the rules of ignore files and defaults that would block them.
    """
    out = [rules.config_layer()]
    out += [] if request.tests else [rules.tests_layer()]
    if request.respect_gitignore:
        out += [rules.Layer("global-gitignore", global_lines, source="global"), rules.Layer("git-info-exclude", info_lines, source="info/exclude"), *nested]
    for scope in request.scopes:
        out = [rules.without_rules_blocking(layer, scope) for layer in out]
    return [*out, rules.Layer("profile-exclude", request.profile_exclude, source="profile"), rules.Layer("option-exclude", request.exclude, source="options")]


def depth_in_scope(path: Column, scopes: tuple[str, ...]) -> Column:
    """Directories between a path and the scope that it lies in, or the root."""
    out = paths.depth(path)
    for scope in scopes:
        if scope not in ("", "."):
            out = F.when(paths.is_within(path, scope), F.greatest(paths.depth(path) - (scope.count("/") + 1), F.lit(0))).otherwise(out)
    return out


#: kinds of layers that come after those of ignore files
LATE = ("profile-exclude", "option-exclude")


def discover(files: DataFrame, layers: list[rules.Layer], request: Request, ignore_files: DataFrame | None = None) -> DataFrame:
    """Adds forced, reason (null: selected so far), rule and rule_source. No shuffle, no contents.

    ignore_files (directory, name, text) are joined as a relation, where they are too many to be layers; that shuffles paths.
    """
    path, size = F.col("path"), F.coalesce(F.col("size"), F.lit(0))
    forced = rules.matches_any(path, request.forced_globs()) | (F.col("forced") if "forced" in files.columns else F.lit(False))
    files = files.withColumn("forced", forced)
    if ignore_files is None or not request.respect_gitignore:
        files = rules.judge(files, layers)
    else:
        late = [layer for layer in layers if layer.kind in LATE]
        files = rule_tables.judge_by_rows(files, rule_tables.rule_rows(ignore_files, scopes=request.scopes), [layer for layer in layers if layer.kind not in LATE], late)
    null = F.lit(None).cast("string")
    checks = []  # (applies to forced too, condition, reason, rule)
    if request.scopes:
        inside = F.lit(False)
        for scope in request.scopes:
            inside = inside | paths.is_within(path, scope)
        checks.append((True, ~inside, "scopeFilter", F.lit("scope")))
    if "*" not in [g.replace("**/*", "*") for g in request.profile_include]:
        checks.append((False, ~rules.matches_any(path, request.profile_include, dot=False), "filterPattern", F.lit("profile")))
    if request.include:
        checks.append((True, ~rules.matches_any(path, request.include), "filterPattern", F.lit("include:" + ",".join(request.include))))
    if request.extensions:
        wanted = [e.lower() if e.startswith(".") else f".{e.lower()}" for e in request.extensions]
        checks.append((False, ~paths.extension(path).isin(*wanted), "filterPattern", F.lit("ext:" + ",".join(request.extensions))))
    if request.max_depth is not None:
        checks.append((False, depth_in_scope(path, request.scopes) > request.max_depth, "filterPattern", F.lit(f"maxDepth:{request.max_depth}")))
    gate = min(request.size_gate or request.max_file_size, request.max_file_size)
    checks.append((True, size > F.when(F.col("forced"), request.max_file_size).otherwise(gate), "sizeGate", F.lit(f"sizeGate:{gate}")))
    reason, rule = null, null
    for everyone, condition, name, told in reversed(checks):
        hit = condition if everyone else condition & ~F.col("forced")
        reason, rule = F.when(hit, name).otherwise(reason), F.when(hit, told).otherwise(rule)
    ignored = rules.hard_excluded(path) | (F.col("verdict.ignored") & ~F.col("forced"))
    return files.select(
        "*",
        F.when(ignored, rules.reason_of(F.col("verdict.kind"))).otherwise(reason).alias("reason"),
        F.when(ignored, F.col("verdict.rule")).otherwise(rule).alias("rule"),
        F.when(ignored, F.col("verdict.rule_source")).alias("rule_source"),
        F.coalesce(F.when(ignored, F.col("verdict.pruned_by").isNotNull()), F.lit(False)).alias("is_directory"),
    ).drop("verdict")


@dataclass
class Selection:
    """Lazy results of one selection. selected has path, size, modified, forced, rank and what else candidates had but content."""

    request: Request
    candidates: DataFrame
    selected: DataFrame
    excluded: DataFrame
    degradations: list[dict] = field(default_factory=list)
    tally: dict | None = None  # the summary's counts, where the frames that were written gave them all

    def manifest(self) -> DataFrame:
        return self.selected.select("path", "size", outcome(self.selected).alias("outcome")).unionByName(self.excluded.select("path", "size", F.concat(F.lit("excluded:"), "reason").alias("outcome")))

    def summary(self, recount: bool = False) -> dict:
        """Counts of the selection. They come from the metrics of the frames that the selection wrote, without a job, where those tell all.

        Otherwise, and with recount, candidates, selected and excluded are counted apart, so candidates = selected + excluded is a check.
        """
        if self.tally and not recount:
            candidates, count, size = (self.tally[k] for k in ("candidates", "selected", "bytes"))
            left = {reason: self.tally["byReason"].get(reason, 0) for reason in C.REASONS}
        else:
            count, size = self.selected.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
            left = {r.reason: r.files for r in ledger.by_reason(self.excluded).collect()}
            candidates = self.candidates.count()
        return {"candidates": candidates, "selected": count, "bytes": size, "excluded": sum(left.values()), "byReason": left, "exactness": self.request.exactness(), "truncated": any(left[k] for k in ("fileCountBudget", "totalSizeBudget", "charBudget"))}

    def enforce(self, summary: dict | None = None) -> dict:
        """The summary, if no policy of the request fails."""
        summary = summary or self.summary()
        if self.request.fail_empty and not summary["selected"]:
            raise PolicyFailure("nothing is selected")
        if self.request.fail_on_truncation and summary["truncated"]:
            raise PolicyFailure("budgets dropped files")
        if self.request.fail_on_unreadable and summary["byReason"]["unreadable"]:
            raise PolicyFailure(f"{summary['byReason']['unreadable']} files could not be read")
        if self.request.redact and self.request.secret_oversize == "fail" and summary["byReason"]["secretUnscannable"]:
            raise PolicyFailure(f"{summary['byReason']['secretUnscannable']} files are too large to be scanned for secrets")
        if self.request.fail_on_secrets and "findings" in self.selected.columns:
            told = self.selected.select("path", F.explode("findings").alias("f")).select("path", "f.rule", "f.start_line").orderBy("path", "start_line").limit(100).collect()
            if told or summary["byReason"]["secretDetected"]:
                raise SecretsDetected(f"secrets in {len({r.path for r in told}) + summary['byReason']['secretDetected']} files", [r.asDict() for r in told])
        if self.request.strict and self.degradations:
            raise PolicyFailure("; ".join(d["message"] for d in self.degradations))
        return summary


def outcome(files: DataFrame):
    truncated = F.coalesce(F.col("truncated"), F.lit(False)) if "truncated" in files.columns else F.lit(False)
    return F.when(truncated, "truncated").when(rules.matches_any(F.col("path"), C.STRUCTURE_ONLY), "structure-only").when(content.extension_category(F.col("path")).isNotNull(), "binary-placeholder").otherwise("included")


def _sums(kept: Column) -> dict[str, Column]:
    """Metrics of the rows that stay."""
    return {"selected": F.count(F.when(kept, 1)), "bytes": F.coalesce(F.sum(F.when(kept, F.col("size"))), F.lit(0))}


def _narrowed(tally: dict | None, told: dict | None, reason: str) -> dict | None:
    """The tally after a step that kept what told counts, all else going for one reason."""
    if not (tally and told):
        return None
    return tally | {"selected": told["selected"], "bytes": told["bytes"], "byReason": tally["byReason"] | {reason: tally["selected"] - told["selected"]}}


def select(files: DataFrame, request: Request, layers: list[rules.Layer], statuses: DataFrame | None = None, ignore_files: DataFrame | None = None) -> Selection:
    """Narrow, filter by changes, rank, and cut by count and size. Rows that share a path are files of their own."""
    meta = files.drop("content", "raw")
    # judged once, without contents: the ledger, the ranks and the summaries all read the result
    kept = F.isnull("reason")
    # counts of what is written are gathered as it is written
    wanted = {"candidates": F.count("*")} | _sums(kept) | {reason: F.count(F.when(F.col("reason") == reason, 1)) for reason in C.REASONS}
    found, told = order.observed(discover(meta, layers, request, ignore_files).withColumn("_row", F.monotonically_increasing_id()), wanted)
    tally = told and {"candidates": told["candidates"], "selected": told["selected"], "bytes": told["bytes"], "byReason": {reason: told[reason] for reason in C.REASONS}}
    gone = [ledger.entries(found.where("reason IS NOT NULL"), F.col("reason"), F.col("rule"), F.col("rule_source"), F.col("is_directory"))]
    left = found.where("reason IS NULL").drop("reason", "rule", "rule_source", "is_directory")
    if request.git_filter and statuses is not None:
        changed = changes.change_set(statuses, request.git_filter)
        gone.append(ledger.entries(changes.dropped_by_changes(left, changed), "gitFilter"))
        left = changes.keep_changed(left, changed)
        tally = None
    if statuses is not None or request.git_filter:
        left = changes.annotate(left, statuses)
    keys = order.sort_columns(request.sort, request.descending)
    if request.max_files.value is None:
        ranked = order.rank_all(left, keys)
    else:
        # decided once: the ledger and the selection then agree on who is in
        ranked, told = order.observed(order.take_ranked(left, keys, request.max_files.value), _sums(F.lit(True)))
        tally = _narrowed(tally, told, "fileCountBudget")
        gone.append(ledger.entries(left.join(ranked.select("_row"), "_row", "left_anti"), "fileCountBudget", F.lit(f"maxFileCount:{request.max_files.value}")))
    if request.max_total_size.value is not None:
        # folded once: the ledger and the selection both read the result
        ranked, told = order.observed(budgets.greedy_size(ranked, request.max_total_size.value, request.keep_oversized_first), _sums(F.col("fits")))
        tally = _narrowed(tally, told, "totalSizeBudget")
        gone.append(ledger.entries(ranked.where(~F.col("fits")), "totalSizeBudget", F.lit(f"maxTotalSize:{request.max_total_size.value}")))
        ranked = ranked.where("fits").drop("fits")
    if request.redact:
        # what names and sizes alone decide, so that a plan leaves out what a run does
        ranked = secrets.screen(ranked, request.secret_max_bytes, request.secret_oversize)
        gone.append(ledger.entries(ranked.where("secret_reason IS NOT NULL"), F.col("secret_reason")))
        ranked = ranked.where("secret_reason IS NULL").drop("secret_reason")
        tally = None
    degraded = [{"stage": "changes", "message": "no change set was given, so none was applied"}] if request.git_filter and statuses is None else []
    return Selection(request, meta, ranked.drop("_row"), ledger.merge(gone), degraded, tally)


def plan(files: DataFrame, request: Request, layers: list[rules.Layer], statuses: DataFrame | None = None) -> Selection:
    """A selection with the character budget counted in bytes; reads no contents."""
    chosen = select(files, request, layers, statuses)
    if request.max_chars.value is None:
        return chosen
    cut = budgets.character_budget(chosen.selected, request.max_chars.value, planned=True)
    gone = ledger.entries(cut.where("outcome = 'dropped'"), "charBudget", F.lit(f"charLimit:{request.max_chars.value}"))
    kept = cut.where("outcome <> 'dropped'").withColumn("truncated", F.col("outcome") == "truncated").drop("outcome")
    return Selection(request, chosen.candidates, kept, chosen.excluded.unionByName(gone), chosen.degradations)


def scan(files: DataFrame, request: Request, layers: list[rules.Layer], statuses: DataFrame | None = None, registry: content.Registry | None = None) -> Selection:
    """A selection with contents: load, classify, transform, deduplicate, redact, cut, in this order. files has content (string) or raw (bytes).

    The result is written to the shared folder once, so summaries, policies and documents do not make contents again.
    """
    chosen = select(files, request, layers, statuses)
    policy = {"default": request.binary, "exceptions": {}} if request.binary else {}
    # no bytes go to files that their names decide, unless they are shown as base64
    path = F.col("path")
    named = F.when(rules.matches_any(path, C.STRUCTURE_ONLY), "structure-only").otherwise(content.extension_category(path))
    shown = named.isNull() | ((named != "structure-only") & (content.policy_of(named, **policy) == "base64"))
    # rows that share a path are told apart by size and number, so each gets one content; equal sizes may change places
    same = lambda order: {"wanted": path, "_size": F.coalesce("size", F.lit(-1)), "_nth": F.row_number().over(Window.partitionBy("path", F.coalesce("size", F.lit(-1))).orderBy(order))}
    body = F.encode("content", "UTF-8") if "raw" not in files.columns else F.col("raw")
    bodies = files.where(shown).select("path", "size", body.alias("raw")).withColumns(same(F.xxhash64("raw"))).drop("path", "size")
    opened = chosen.selected.withColumns(same(F.col("rank"))).withColumn("wanted", F.when(shown, path)).join(bodies, ["wanted", "_size", "_nth"], "left").drop("wanted", "_size", "_nth")
    loaded, skipped = content.load(content.classify(opened), **policy)
    gone = [chosen.excluded, ledger.entries(skipped, "binaryPolicy")]
    kept = loaded.drop("raw", "policy")
    degraded = list(chosen.degradations)
    if registry and registry.transforms:
        kept = registry.run(kept)
    if request.deduplicate:
        kept, duplicates = content.deduplicate(kept)
        gone.append(ledger.entries(duplicates, "duplicate", F.concat(F.lit("duplicateOf:"), "duplicate_of")))
    if request.redact:
        kept = secrets.guard(kept, request.redact)
        dirty = (F.size("findings") > 0) & (~F.col("clean") | F.lit(not request.redact_inline))
        kept = order.checkpointed(kept)
        gone.append(ledger.entries(kept.where(dirty), "secretDetected"))
        kept = kept.where(~dirty).drop("clean")
    else:
        kept = order.checkpointed(kept)
    if registry and registry.transforms and (failed := kept.where("transform_error IS NOT NULL").count()):
        degraded.append({"stage": "transform", "message": f"{failed} transforms failed and left their files as they were"})
    if request.max_chars.value is not None:
        cut = budgets.character_budget(kept, request.max_chars.value)
        gone.append(ledger.entries(cut.where("outcome = 'dropped'"), "charBudget", F.lit(f"charLimit:{request.max_chars.value}")))
        kept = cut.where("outcome <> 'dropped'").withColumn("truncated", F.col("outcome") == "truncated").drop("outcome")
    return Selection(request, chosen.candidates, kept, ledger.merge(gone), degraded)


def rows(selection: Selection, on_summary: Callable[[dict], None] | None = None) -> Iterator:
    """Selected rows in rank order, a partition at a time; the summary first."""
    if on_summary:
        on_summary(selection.summary())
    yield from selection.selected.orderBy("rank").toLocalIterator(prefetchPartitions=True)


def copy(files: DataFrame, request: Request, layers: list[rules.Layer], document: render.Document, target: str, **more) -> dict:
    """Renders a scan into one file; with target empty (a dry run) only plans. Returns the summary."""
    if not target:
        chosen = plan(files, request, layers, more.get("statuses"))
        return chosen.summary() | {"estimate": aggregates.estimate(chosen.selected, request.format, only_tree=request.only_tree).first().asDict()}
    chosen = scan(files, request, layers, **more)
    return chosen.enforce() | {"outputBytes": render.deliver(chosen.selected, request.format, document, target)}
