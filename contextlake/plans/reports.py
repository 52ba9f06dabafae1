"""Reports about a selection: plan, inventory, explanation of a path, and a check of ignore rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextlake import constants as C
from contextlake.functions import paths
from contextlake.functions.patterns import ignore_rule
from contextlake.functions.tables import markdown_table, short_bytes
from contextlake.operators import aggregates, changes, rules
from contextlake.plans.engine import Selection, depth_in_scope
from contextlake.request import Request


def plan_report(selection: Selection) -> DataFrame:
    """path, size, rank, outcome, reason, rule of every candidate."""
    kept = selection.selected.select("path", "size", "rank").join(selection.manifest().where(~F.startswith("outcome", F.lit("excluded:"))).select("path", "outcome"), "path")
    kept = kept.withColumn("reason", F.lit(None).cast("string")).withColumn("rule", F.lit(None).cast("string"))
    left = selection.excluded.select("path", "size", F.lit(None).cast("bigint").alias("rank"), F.concat(F.lit("excluded:"), "reason").alias("outcome"), "reason", "rule")
    return kept.unionByName(left)


def inspect(selection: Selection, depth: int = 1) -> dict[str, DataFrame]:
    """Views of an inventory, each lazy."""
    files = selection.selected
    return {
        "summary": aggregates.totals(files), "directories": aggregates.by_directory(files, depth), "extensions": aggregates.by_extension(files), "rootFiles": aggregates.root_files(files),
        "tree": aggregates.tree_totals(files), "areas": aggregates.by_area(files), "outcomes": aggregates.by_outcome(selection.manifest()),
        "rules": selection.excluded.groupBy("rule_source", "rule", "reason").agg(F.count("*").alias("files")).where("rule_source IS NOT NULL"),
    }


def explain(files: DataFrame, request: Request, layers: list[rules.Layer], selection: Selection | None = None) -> DataFrame:
    """path, decision, reason, steps array<struct<id, verdict, detail>>, trace: every check that a path meets, in order, and every rule that matches on the way.

    The steps are discover()'s, so the decision is too. Each row is judged by itself; only the last step, the place in the budgets, needs the selection.
    """
    path, size = F.col("path"), F.coalesce(F.col("size"), F.lit(0))
    step = lambda n, passed, detail: F.struct(F.lit(n).alias("id"), F.when(passed, "pass").otherwise("fail").alias("verdict"), detail.cast("string").alias("detail"))
    forced = rules.matches_any(path, request.forced_globs()) | (F.col("forced") if "forced" in files.columns else F.lit(False))
    judged = rules.judge(files.drop("content"), layers).withColumn("forced", forced)
    gate = min(request.size_gate or request.max_file_size, request.max_file_size)
    inside = F.lit(not request.scopes)
    for scope in request.scopes:
        inside = inside | paths.is_within(path, scope)
    limit = F.when(F.col("forced"), request.max_file_size).otherwise(gate)
    wanted = [e.lower() if e.startswith(".") else f".{e.lower()}" for e in request.extensions]
    everything = "*" in [g.replace("**/*", "*") for g in request.profile_include]
    steps = [
        step("hard-exclusion", ~rules.hard_excluded(path), F.lit(".git")),
        step("containment", ~(F.startswith(path, F.lit("/")) | F.array_contains(F.split(path, "/"), "..")), path),
        step("scope", inside, F.lit(",".join(request.scopes))),
        step("ignore-rules", ~F.col("verdict.ignored") | F.col("forced"), F.concat_ws(" ", F.col("verdict.rule"), F.col("verdict.rule_source"), F.col("verdict.pruned_by"))),
        step("force-include", F.col("forced"), F.lit(",".join(request.forced_globs()))),
        step("profile-include", F.lit(everything) | rules.matches_any(path, request.profile_include, dot=False) | F.col("forced"), F.lit(",".join(request.profile_include))),
        step("include", rules.matches_any(path, request.include) if request.include else F.lit(True), F.lit(",".join(request.include))),
        step("extension", paths.extension(path).isin(*wanted) | F.col("forced") if request.extensions else F.lit(True), paths.extension(path)),
        step("depth", (depth_in_scope(path, request.scopes) <= request.max_depth) | F.col("forced") if request.max_depth is not None else F.lit(True), paths.depth(path)),
        step("size-gate", size <= limit, limit),
    ]
    out = judged.select("path", F.array(*steps).alias("steps"), rules.trace(path, layers).alias("trace"))
    # force-include is an answer, not a hurdle; no source gives paths outside of the root, so containment only tells of rows that came otherwise
    failed = F.filter("steps", lambda s: (s["verdict"] == "fail") & ~s["id"].isin("force-include", "containment"))
    out = out.withColumn("reason", F.try_element_at(F.transform(failed, lambda s: s["id"]), F.lit(1)))
    if selection is not None:
        place = selection.selected.select("path", "rank")
        out = out.join(place, "path", "left").join(selection.excluded.select("path", F.col("reason").alias("_ledger")), "path", "left")
        budget = F.struct(F.lit("budgets").alias("id"), F.when(F.col("rank").isNotNull(), "pass").otherwise("fail").alias("verdict"), F.coalesce(F.concat(F.lit("position "), "rank"), F.col("_ledger")).alias("detail"))
        out = out.withColumn("steps", F.when(F.col("reason").isNull(), F.array_append("steps", budget)).otherwise(F.col("steps"))).withColumn("reason", F.coalesce("reason", F.when(F.col("rank").isNull(), F.col("_ledger")))).drop("rank", "_ledger")
    return out.select("path", F.when(F.col("reason").isNull(), "selected").otherwise("excluded").alias("decision"), "reason", "steps", "trace")


def rule_lines(texts: DataFrame) -> DataFrame:
    """line, raw, pattern, negation of every rule of the ignore files in ``text``, with the other columns; a null text has none."""
    keys = [F.col(c) for c in texts.columns if c != "text"]
    lines = texts.select(*keys, F.posexplode(F.split(F.regexp_replace("text", "^\ufeff", ""), "\n")).alias("line", "raw"))
    out = lines.withColumn("line", F.col("line") + 1).withColumn("pattern", F.trim(F.regexp_replace("raw", "\r$", "")))
    return out.where((F.col("pattern") != "") & ~F.startswith("pattern", F.lit("#"))).withColumn("negation", F.startswith("pattern", F.lit("!")))


def parse_rules(spark, text: str) -> DataFrame:
    """rule_lines() of one ignore file."""
    return rule_lines(spark.createDataFrame([(text,)], "text string"))


def rule_effects(spark, text: str, baseline: DataFrame, attributed: DataFrame) -> DataFrame:
    """line, pattern, negation, matched, removed, re_included of every rule, over all baseline files.

    One conditional sum for each rule in a single pass: rules are columns, files are never joined to each rule.
    """
    compiled = _compiled(text)
    files = baseline.select("path").join(attributed.select("path", F.lit(True).alias("_left")), "path", "left")
    up = F.concat(F.transform(paths.ancestors(F.col("path")), lambda d: F.struct(d.alias("p"), F.lit(True).alias("d"))), F.array(F.struct(F.col("path").alias("p"), F.lit(False).alias("d"))))
    sums = []
    matches = lambda rule: lambda x: x["p"].rlike(rule.regex) & (x["d"] if rule.directories_only else F.lit(True))
    for line, rule in compiled:
        hit = F.exists(up, matches(rule))
        sums += [F.count(F.when(hit, 1)).alias(f"m{line}"), F.count(F.when(hit & F.col("_left").isNull(), 1)).alias(f"r{line}")]
    if not sums:
        return spark.createDataFrame([], "line int, pattern string, negation boolean, matched bigint, removed bigint, re_included bigint")
    wide = files.agg(*sums)
    out = F.explode(F.array(*[F.struct(F.lit(n).alias("line"), F.lit(r.pattern).alias("pattern"), F.lit(r.negated).alias("negation"), F.col(f"m{n}").alias("matched"), F.col(f"r{n}").alias("_r")) for n, r in compiled]))
    rows = wide.select(out.alias("x")).select("x.*")
    return rows.select("line", "pattern", "negation", "matched", F.when(F.col("negation"), 0).otherwise(F.col("_r")).cast("bigint").alias("removed"), F.when(F.col("negation"), F.col("matched") - F.col("_r")).otherwise(0).cast("bigint").alias("re_included"))


def _literal_keys(rule) -> list[str]:
    """What a path must have for the rule to match: "/" and a segment, or "*" and the last extension of a segment. No key: nothing can be said."""
    import re

    segments = [s for s in rule.pattern.lstrip("!").strip("/").split("/") if s]
    keys = ["/" + s for s in segments if not set(s) & set("*?[\\")]
    ext = re.fullmatch(r"\*(\.[^*?\[\\.]+)", segments[-1]) if segments else None
    return keys + (["*" + ext[1]] if ext else [])


def rule_effects_by_key(spark, text: str, baseline: DataFrame, attributed: DataFrame) -> DataFrame:
    """rule_effects() for any number of rules, with critical and source: how many of the removed files describe the project, or hold source outside of directories for tests, examples and the like.

    An inverted index: rules are rows under a literal segment or extension that a path must have, the one of theirs that fewest files have, and files
    meet a rule only under that key. Only rules without any literal are tried on every file, as columns in one pass. Rules that match
    nothing have zeros; repeated paths count each, a null path none.
    """
    compiled = _compiled(text)
    files = baseline.select("path").where("path IS NOT NULL").join(attributed.select("path").distinct().withColumn("_left", F.lit(True)), "path", "left").withColumn("_left", F.isnotnull("_left"))
    segments = F.split("path", "/")
    has = F.concat(F.transform(segments, lambda s: F.concat(F.lit("/"), s)), F.transform(segments, lambda s: F.concat(F.lit("*"), F.regexp_extract(s, r"(\.[^.]*)$", 1))))
    keyed = files.withColumn("key", F.explode(F.array_distinct(has)))
    rows = [(n, r.pattern, r.regex, r.negated, r.directories_only, _literal_keys(r)) for n, r in compiled]
    table = spark.createDataFrame([r for r in rows if r[5]], "line int, pattern string, regex string, negation boolean, directories boolean, keys array<string>")
    wanted = table.select("line", F.explode("keys").alias("key"))
    often = keyed.select("key").join(wanted.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
    rarest = wanted.join(often, "key", "left").groupBy("line").agg(F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), "key")).alias("key"))
    up = F.concat(F.transform(paths.ancestors(F.col("path")), lambda d: F.struct(d.alias("p"), F.lit(True).alias("d"))), F.array(F.struct(F.col("path").alias("p"), F.lit(False).alias("d"))))
    hit = F.exists(up, lambda x: (x["d"] | ~F.col("directories")) & F.regexp_like(x["p"], F.col("regex")))
    critical = F.lower("path").isin(*C.CRITICAL_ROOT_FILES)
    source = paths.extension(F.col("path")).isin(*[f".{e}" for e in C.SOURCE_EXTENSIONS]) & ~F.coalesce(paths.role_hint(F.col("path")).isin(*C.DELIBERATE_ROLES), F.lit(False))
    sums = lambda on: [F.count_if(on).alias("matched"), F.count_if(on & ~F.col("_left")).alias("_r"), F.count_if(on & ~F.col("_left") & critical).alias("_c"), F.count_if(on & ~F.col("_left") & source).alias("_s")]
    met = keyed.join(table.drop("keys").join(rarest, "line"), "key").where(hit).groupBy("line").agg(*sums(F.lit(True)))
    loose = [(n, r) for n, r in compiled if not _literal_keys(r)]
    if loose:
        tried = lambda r: F.exists(up, lambda x: x["p"].rlike(r.regex) & (x["d"] if r.directories_only else F.lit(True)))
        wide = files.agg(*[c.alias(f"{k}{n}") for n, r in loose for k, c in zip("mrcs", sums(tried(r)), strict=True)])
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("line"), F.col(f"m{n}").alias("matched"), F.col(f"r{n}").alias("_r"), F.col(f"c{n}").alias("_c"), F.col(f"s{n}").alias("_s")) for n, _ in loose]))
        met = met.unionByName(wide.select(each.alias("x")).select("x.*"))
    every = spark.createDataFrame([r[:2] + (r[3],) for r in rows], "line int, pattern string, negation boolean").join(met, "line", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    taken = lambda c: count(F.when(F.col("negation"), 0).otherwise(F.col(c)))
    back = count(F.when(F.col("negation"), F.col("matched") - F.col("_r")))
    return every.select("line", "pattern", "negation", count(F.col("matched")).alias("matched"), taken("_r").alias("removed"), back.alias("re_included"), taken("_c").alias("critical"), taken("_s").alias("source"))


def _compiled(text: str):
    out = []
    for n, raw in enumerate(text.removeprefix("﻿").split("\n"), 1):
        rule = ignore_rule(raw.rstrip("\r").strip())
        if rule:
            out.append((n, rule))
    return out


def check_rules(spark, text: str, baseline: DataFrame, attributed: DataFrame, effective: Selection, focus: str | None = None) -> DataFrame:
    """line, code, message of what is odd about an ignore file; the file's lines are few and looked at on the driver, the effects are summed by Spark.

    focus asks for one rule, by line number or pattern; one that is not there is told too.
    """
    import re

    found: list[tuple[int | None, str, str]] = []
    if focus is not None and not any(focus in (str(n), rule.pattern) for n, rule in _compiled(text)):
        found.append((None, "RULE_NOT_FOUND", f"no rule {focus}"))
    if text.startswith("﻿"):
        found.append((1, "BOM", "the file starts with a byte order mark"))
    if "�" in text:
        found.append((None, "INVALID_ENCODING", "some bytes are not UTF-8"))
    compiled = _compiled(text)
    seen: dict[str, int] = {}
    for n, rule in compiled:
        if rule.pattern in seen:
            found.append((n, "DUPLICATE_RULE", f"repeats line {seen[rule.pattern]}"))
        seen.setdefault(rule.pattern, n)
        if "../" in rule.pattern or rule.pattern.startswith("/.."):
            found.append((n, "ROOT_ESCAPE", "rules cannot reach above their directory"))
        try:
            re.compile(rule.regex)
        except re.error as error:
            found.append((n, "INVALID_PATTERN", str(error)))
    for i, (n, rule) in enumerate(compiled):
        # a path that the rule is about, and the directories above it; a later rule that takes one of them decides instead
        probe = rule.pattern.lstrip("!").strip("/").replace("**", "x").replace("*", "x")
        steps = probe.split("/")
        above = ["/".join(steps[: n + 1]) for n in range(len(steps) - 1)]
        for later_line, later in compiled[i + 1 :]:
            if rule.negated or later.pattern == rule.pattern:
                continue
            if re.search(later.regex, probe) and (rule.directories_only or not later.directories_only) or (not later.negated and any(re.search(later.regex, d) for d in above)):
                found.append((n, "RULE_CANCELLED" if later.negated else "RULE_SHADOWED", f"by line {later_line}"))
                break
    effects = {r.line: r for r in rule_effects_by_key(spark, text, baseline, attributed).collect()}  # a row for each line
    for n, rule in compiled:
        effect = effects[n]
        if rule.negated and not effect.re_included:
            parent = rule.pattern[1:].strip("/").rpartition("/")[0]
            blocked = parent and any(not r.negated and re.search(r.regex, parent) for m, r in compiled if m != n)
            found.append((n, "NEGATION_BLOCKED" if blocked else "RULE_MATCHES_NOTHING", "re-includes nothing"))
        elif not rule.negated and not effect.matched:
            found.append((n, "RULE_MATCHES_NOTHING", "matches no path"))
        elif not rule.negated and not effect.removed:
            found.append((n, "RULE_REDUNDANT", "removes nothing that was not excluded before"))
    for n, rule in compiled:
        if effects[n].critical:
            found.append((n, "CRITICAL_FILE_EXCLUDED", f"{effects[n].critical} files that describe the project"))
        if effects[n].source:
            found.append((n, "SOURCE_EXCLUDED", f"{effects[n].source} source files"))
    summary = effective.summary()
    if not summary["selected"]:
        found.append((None, "EMPTY_SELECTION", "nothing is left"))
    if summary["truncated"]:
        found.append((None, "BUDGET_STILL_BINDS", "budgets still drop files"))
    if forced := effective.selected.where("forced").count():
        found.append((None, "FORCE_INCLUDED", f"{forced} files are forced in"))
    return spark.createDataFrame(found, "line int, code string, message string")


def ignore_context(spark, text: str | None, baseline: Selection, effective: Selection, depth: int = 4, all_paths: bool = False) -> dict:
    """What a writer of ignore rules wants to see: counts, roll-ups and a tree of the candidates, the rules there are, and the paths if they are few.

    Above the limit no path is listed, and truncation says how many are left out. Frames are lazy; only counts come to the driver.
    """
    files = baseline.selected
    limit = C.REPORT_ALL_PATHS if all_paths else C.REPORT_PATHS
    candidates, selected = files.count(), effective.selected.count()
    listed = files.select("path", "size", (F.col("size") > (effective.request.size_gate or effective.request.max_file_size)).alias("over_size_gate")).orderBy("path")
    return {
        "candidates": candidates, "selected": selected, "directories": aggregates.by_directory(files, 1), "extensions": aggregates.by_extension(files), "rootFiles": aggregates.root_files(files),
        "tree": aggregates.tree_totals(files, depth), "rules": parse_rules(spark, text or ""), "exists": text is not None,
        "paths": listed if candidates <= limit else None,
        "truncation": {"truncated": candidates > limit, "omitted": candidates if candidates > limit else 0, "reason": f"{candidates} candidates exceed the limit of {limit} paths" if candidates > limit else None},
    }


def ignore_context_text(context: dict) -> str:
    """The report as Markdown; its tables have a row for each directory of the first level, extension or rule."""
    lines = ["# Ignore context", "", f"{context['candidates']} candidates, {context['selected']} selected", ""]
    for title, frame, columns in (
        ("Directories", context["directories"].orderBy(F.desc("bytes"), "path").limit(50), (("path", "Directory", False), ("files", "Files", True), ("size", "Size", True), ("hint", "Role", False))),
        ("Extensions", context["extensions"].orderBy(F.desc("bytes"), "extension").limit(50), (("extension", "Extension", False), ("files", "Files", True), ("size", "Size", True))),
        ("Rules", context["rules"].orderBy("line"), (("line", "Line", True), ("pattern", "Pattern", False))),
    ):
        rows = [r.asDict() | ({"size": short_bytes(r.bytes)} if "bytes" in frame.columns else {}) for r in frame.collect()]
        lines += [f"## {title}", "", *(markdown_table(columns, rows) if rows else ["none"]), ""]
    if context["paths"] is None:
        lines += ["## Paths", "", context["truncation"]["reason"]]
    else:
        lines += ["## Paths", "", *(f"- {r.path} ({short_bytes(r.size)}){' over the size gate' if r.over_size_gate else ''}" for r in context["paths"].toLocalIterator())]
    return "\n".join(lines) + "\n"


def removed_by_area(baseline: DataFrame, attributed: DataFrame, effective: DataFrame) -> DataFrame:
    fates = changes.compare_plans(baseline, attributed, effective)
    return aggregates.by_area(fates.where("fate = 'removed'"))


def starter_rules(files: DataFrame, names: tuple[str, ...] = ("docs", "examples", "fixtures", "testdata", "benchmarks")) -> list[str]:
    """Lines for a new ignore file: conventional directories that exist."""
    found = files.select(F.explode(paths.ancestors(F.col("path"))).alias("d")).where(F.col("d").isin(*names)).distinct().orderBy("d").collect()
    return [f"{r.d}/" for r in found]
