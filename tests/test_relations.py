"""Ignore files as a relation, traces, greedy fit in rounds, snapshots and repeated paths."""

import random

import pytest
from pyspark.sql import functions as F

from contextlake.operators import budgets, changes, rule_tables, rules
from contextlake.plans import engine, reports
from contextlake.request import Budget, Request

NAMES = ["a", "b", "c.txt", "d.md", ".x", "é", "a b", "test"]
LINES = ["a", "a/", "/a", "*.md", "!*.md", "b/", "!b", "**/c.txt", "a/**", "!a/b/", "[ab]", "?.md", "# no", "", "é", "\\!x", "/b/d.md", "!/b/d.md", "te*", "a b/"]


def corpus(rng, n=120):
    return sorted({"/".join(rng.choice(NAMES) for _ in range(rng.randint(1, 5))) for _ in range(n)})


@pytest.mark.parametrize("seed,salts", [(0, 1), (1, 7), (2, 3)])
def test_relation_equals_layers(spark, seed, salts):
    rng = random.Random(seed)
    files = corpus(rng)
    directories = sorted({p.rsplit("/", k)[0] for p in files for k in (1, 2) if p.count("/") >= k} | {""})
    ignore = [(d, name, rng.choice(["\n", "\r\n"]).join(rng.choices(LINES, k=rng.randint(0, 5)))) for d in directories for name in (".gitignore", rules.C.IGNORE_FILE) if rng.random() < 0.5]
    ignore += [("a", "other", "*"), ("b", ".gitignore2", "*")]
    before = [rules.Layer("config-exclude", ("*.txt", "!b/c.txt"), source="defaults")]
    after = [rules.Layer("option-exclude", ("test", "!a/test"), source="options")]
    df = spark.createDataFrame([(p, i) for i, p in enumerate(files + files[:3] + [None])], "path string, i int")
    table = rule_tables.rule_rows(spark.createDataFrame([*ignore, ("zz", ".gitignore", None)], "directory string, name string, text string"))
    got = rule_tables.judge_by_rows(df, table, before, after, salts)
    want = rules.judge(df, [*before, *rules.nested_layers([x for x in ignore if x[1] in (".gitignore", rules.C.IGNORE_FILE)]), *after])
    assert sorted(map(repr, got.select("path", "i", "verdict").collect())) == sorted(map(repr, want.select("path", "i", "verdict").collect()))


def test_relation_keeps_scopes_open(spark):
    files = spark.createDataFrame([("a/b/x",), ("a/y",)], "path string")
    ignored = spark.createDataFrame([("", ".gitignore", "a/\n*.log")], "directory string, name string, text string")
    chosen = lambda scopes: [r.path for r in rule_tables.judge_by_rows(files, rule_tables.rule_rows(ignored, scopes=scopes)).where("verdict.ignored").orderBy("path").collect()]
    assert chosen(()) == ["a/b/x", "a/y"] and chosen(("a/b",)) == []


def test_plan_does_not_grow_with_ignore_files(spark):
    files = spark.range(2000).select(F.concat(F.lit("d"), F.col("id"), F.lit("/x.md")).alias("path"))
    plans, kept = [], []
    for n in (10, 10_000):
        ignored = spark.range(n).select(F.concat(F.lit("d"), F.col("id")).alias("directory"), F.lit(".gitignore").alias("name"), F.lit("*.md\nx\n!y").alias("text"))
        judged = rule_tables.judge_by_rows(files, rule_tables.rule_rows(ignored))
        plans.append(judged._jdf.queryExecution().optimizedPlan().toString().count("\n"))
        kept.append(judged.where("NOT verdict.ignored").count())
    assert plans[0] == plans[1] and kept == [1990, 0]


def test_relation_in_a_selection(spark):
    files = spark.createDataFrame([("a/x.md", 1), ("a/y.md", 2), ("b/x.md", 3)], "path string, size long").withColumn("modified", F.lit(None).cast("timestamp"))
    ignored = spark.createDataFrame([("a", ".gitignore", "x.*")], "directory string, name string, text string")
    chosen = engine.select(files, Request(), engine.layers_of(Request()), ignore_files=ignored)
    assert sorted(r.path for r in chosen.selected.collect()) == ["a/y.md", "b/x.md"]
    assert [(r.path, r.reason, r.rule_source) for r in chosen.excluded.collect()] == [("a/x.md", "gitignore", "a/.gitignore:1")]
    assert engine.select(files, Request(respect_gitignore=False), engine.layers_of(Request(respect_gitignore=False)), ignore_files=ignored).selected.count() == 3


@pytest.mark.parametrize("seed", range(3))
def test_trace_ends_with_the_judge(spark, seed):
    rng = random.Random(10 + seed)
    files = corpus(rng, 80)
    layers = [rules.Layer("gitignore", tuple(rng.choices(LINES, k=6)), base=b, source=b + ".gitignore") for b in ("", "a", "b")]
    df = spark.createDataFrame([(p,) for p in files], "path string")
    for r in rules.judge(df, layers).withColumn("trace", rules.trace(F.col("path"), layers)).collect():
        own = [t for t in r.trace if t.path == (r.verdict.pruned_by or r.path)]
        assert (own[-1].rule, own[-1].rule_source, own[-1].ignored) == (r.verdict.rule, r.verdict.rule_source, r.verdict.ignored) if own else r.verdict.rule is None
        assert r.verdict.rule is None or r.trace[-1].rule == r.verdict.rule
    assert rules.judge(df, []).select(F.size(rules.trace(F.col("path"), [])).alias("n")).agg(F.sum("n")).first()[0] == 0


@pytest.mark.parametrize("request_", [Request(profile_include=("b/**",)), Request(extensions=("MD",)), Request(extensions=(".Md", "TXT"), profile_include=("**/*.md",), scopes=("a",), max_depth=1), Request(include=("a/**",), force_include=("b/**",))])
def test_explain_agrees_with_discover(spark, request_):
    files = spark.createDataFrame([(p, 5) for p in ("a/x.md", "b/x.md", "a/b/c/x.MD", "a/.x", "b/y.txt", "z.md")], "path string, size long")
    found = {r.path: r.reason is None for r in engine.discover(files, [], request_).collect()}
    told = {r.path: r.decision == "selected" for r in reports.explain(files, request_, []).collect()}
    assert found == told


def fold(sizes, budget):
    out = []
    for s in sizes:
        out.append(s <= budget)
        budget -= s if out[-1] else 0
    return out


LARGE = 1 << 40


@pytest.mark.parametrize("sizes,budget", [
    ([x for i in range(60) for x in (1, LARGE - i)], LARGE), ([1 << i for i in range(40, -1, -1)], (1 << 40) - 1), ([0] * 20 + [5, 3, 0, 2, 1, 0], 5), ([7] * 30, 50), ([], 9), ([9, 8, 7], 0), ([3] * 10, 30),
    (random.Random(1).choices(range(2000), k=300), 20000), (random.Random(2).choices([1, 10, 100, 1000, 10**6], k=300), 123456),
])
def test_greedy_in_rounds(spark, monkeypatch, sizes, budget):
    rounds, summed = [], budgets.running_sum
    monkeypatch.setattr(budgets, "running_sum", lambda *a: rounds.append(1) or summed(*a))
    ranked = spark.createDataFrame([(i + 1, s) for i, s in enumerate(sizes)], "rank long, size long")
    got = [r.fits for r in budgets.greedy_size(ranked, budget, serial=0).orderBy("rank").collect()]
    assert got == fold(sizes, budget)
    assert len(rounds) <= budget.bit_length()


def test_snapshots(spark):
    frame = lambda rows: spark.createDataFrame(rows, "path string, digest string")
    old = frame([("same", "1"), ("edited", "2"), ("gone", "3"), ("m1", "4"), ("m2", "4"), ("m3", "4"), ("empty", None), ("stays", None), ("filled", None), (None, "4"), ("same", "1")])
    new = frame([("same", "1"), ("edited", "5"), ("new", "6"), ("n1", "4"), ("n2", "4"), ("void", None), ("stays", None), ("filled", "7")])
    assert sorted(tuple(r) for r in changes.between(old, new).fillna("").collect()) == [
        ("edited", "modified", ""), ("empty", "deleted", ""), ("filled", "modified", ""), ("gone", "deleted", ""), ("m3", "deleted", ""), ("n1", "renamed", "m1"), ("n2", "renamed", "m2"), ("new", "created", ""), ("void", "created", ""),
    ]
    assert {r.status for r in changes.between(None, new).collect()} == {"unknown"} and changes.between(old, None).count() == 9
    assert changes.between(old.limit(0), new.limit(0)).count() == 0
    with pytest.raises(ValueError):
        changes.between(None, None)


def test_unknown_status_without_snapshots(spark):
    files = spark.createDataFrame([("a.md", 1)], "path string, size long").withColumn("modified", F.lit(None).cast("timestamp"))
    chosen = engine.select(files, Request(git_filter="modified"), [])
    assert [r.git_status for r in chosen.selected.collect()] == ["unknown"] and chosen.degradations


@pytest.mark.parametrize("limit", [None, 1, 2])
def test_repeated_paths_are_files_of_their_own(spark, limit):
    rows = [("x.md", 3, "one"), ("x.md", 5, "three"), ("y.md", 3, "two"), ("x.md", 5, "seven")]
    files = spark.createDataFrame(rows, "path string, size long, content string").withColumn("modified", F.lit(None).cast("timestamp"))
    request = Request(deduplicate=False) if limit is None else Request(deduplicate=False, max_files=Budget(limit))
    for chosen in (engine.select(files, request, []), engine.scan(files, request, [])):
        assert chosen.selected.count() + chosen.excluded.count() == 4
    if limit is None:
        assert sorted(r.content for r in engine.scan(files, request, []).selected.collect()) == ["one", "seven", "three", "two"]


def test_effects_by_key_equal_effects(spark):
    rng = random.Random(3)
    files = corpus(rng, 150) + ["package.json", "a/x.py", "a/x.py"]
    text = "\n".join([*LINES, "*.py", "/package.json", "*.tar.gz", "a.b/", "**"])
    baseline = spark.createDataFrame([(p, 1) for p in files], "path string, size long")
    attributed = baseline.where("length(path) % 3 <> 0")
    want = {r.line: tuple(r)[1:] for r in reports.rule_effects(spark, text, baseline.distinct(), attributed.distinct()).collect()}
    got = {r.line: r for r in reports.rule_effects_by_key(spark, text, baseline.distinct(), attributed).collect()}
    assert {n: tuple(r)[1:6] for n, r in got.items()} == want
    line = text.split("\n").index("*.py") + 1
    assert got[line].source == got[line].removed and got[text.split("\n").index("/package.json") + 1].critical == 1
    assert reports.rule_effects_by_key(spark, "# none", baseline, attributed).count() == 0
