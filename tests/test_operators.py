"""Semantic pins on small hand-written frames."""

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from contextlake import constants as C
from contextlake.functions import paths, sizes, tables, text
from contextlake.operators import aggregates, budgets, changes, content, ledger, order, rules, secrets
from contextlake.plans import engine, reports
from contextlake.plans.chain import Chain, Stage, cancel, cancellable
from contextlake.request import Budget, Interrupted, InvalidOption, PolicyFailure, Profile, ProfileNotFound, Request, SecretsDetected, build_request, layered_options, load_profile, read_instructions, read_profile
from contextlake.sinks import render
from contextlake.sinks.tree import tree_lines
from contextlake.sources import git, scopes, tree


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_text_functions(spark):
    assert column(spark, ["a😀", "", None], "string", text.utf16_length) == [3, 0, None]
    assert column(spark, ["a\r\nb\rc"], "string", text.normalise_newlines) == ["a\nb\nc"]
    assert column(spark, ["a\nb", ""], "string", text.add_line_numbers) == ["   1: a\n   2: b", ""]
    assert column(spark, ["x", "a ```` b", "``` q"], "string", text.choose_fence) == ["```", "`````", "````"]
    assert column(spark, ["a]]>b", "a\x01]]\x1f>b\x7f\t"], "string", text.escape_cdata) == ["a]]]]><![CDATA[>b", "a]]]]><![CDATA[>b\t"]
    assert column(spark, ['<a & "b">'], "string", text.escape_xml_attribute) == ["&lt;a &amp; &quot;b&quot;&gt;"]
    assert column(spark, [" a--b<c> "], "string", text.sanitize_comment) == ["a—b‹c›"]
    assert column(spark, ["a\x00b\x7f\t"], "string", text.sanitize_xml) == ["ab\t"]
    assert column(spark, [b"x" * 100], "binary", text.one_line_base64)[0].count("\n") == 0


def test_sizes(spark):
    assert column(spark, [0, 1023, 1536, 1048576, 5 * 2**30], "bigint", sizes.format_bytes) == ["0 B", "1023 B", "1.5 KB", "1 MB", "5 GB"]
    assert [sizes.parse_size(x) for x in ("10", "1.5KB", "2 mb")] == [10, 1536, 2097152]
    for bad in ("many", "2 K", " 10", "-1", "1.5.2KB"):
        with pytest.raises(ValueError):
            sizes.parse_size(bad)
    assert [sizes.format_duration(x) for x in (999, 1500, 65_000, 3_600_000 * 2 + 3000)] == ["999ms", "1s", "1m 5s", "2h 0m 3s"]
    assert [sizes.format_elapsed(x) for x in (250, 1500, 120_000)] == ["250ms", "1.5s", "2.0m"]
    assert column(spark, [5 * 2**50, 2**40], "bigint", lambda x: sizes.format_bytes(x, sizes.ALL_UNITS)) == ["5 PB", "1 TB"]
    assert column(spark, [2**40], "bigint", lambda x: sizes.format_bytes(x, sizes.DOCUMENT_UNITS)) == ["1024 GB"]


def test_tables():
    rows = [{"a": "x", "n": 1, "s": None}, {"a": "longer", "n": 250, "s": "é"}]
    columns = (("a", "Name", False), ("n", "N", True), ("s", "Note", False))
    assert tables.text_table(columns, rows, "  ") == ["  Name      N  Note", "  x         1", "  longer  250  é"]
    assert tables.markdown_table(columns, rows) == ["| Name | N | Note |", "|---|---:|---|", "| x | 1 |  |", "| longer | 250 | é |"]
    assert [tables.short_bytes(x) for x in (0, 1023, 1536, 552_960, 5 * 2**30)] == ["0 B", "1023 B", "1.5 KB", "540 KB", "5 GB"]
    assert [tables.short_tokens(x) for x in (0, 999, 171_400)] == ["~0 tokens", "~999 tokens", "~171k tokens"]


def test_paths(spark):
    assert column(spark, ["a/b.TXT", ".env", "x"], "string", paths.extension) == [".txt", "", ""]
    assert column(spark, [".env", "a.b/c"], "string", paths.trailing_extension)[0] == ".env"
    assert column(spark, ["a/b/c.txt", "r"], "string", paths.ancestors) == [["a", "a/b"], []]
    hints = column(spark, ["package.json", "a/x.min.js", "src/__tests__/a.js", "src/a.js", "q/a.js"], "string", paths.role_hint)
    assert hints == ["project-config", "generated", "tests", "source", None]


def test_path_order(spark):
    names = ["file10", "file9", "README.md", "readme.md", "a7", "a007", "é", "e", "f"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    ranked = [r.path for r in order.rank_all(df, order.sort_columns()).orderBy("rank").collect()]
    assert ranked.index("file9") < ranked.index("file10") and ranked.index("README.md") + 1 == ranked.index("readme.md")
    assert ranked.index("a007") + 1 == ranked.index("a7") and ranked.index("é") < ranked.index("f")
    with pytest.raises(ValueError):
        order.sort_columns("color")
    long = ["v" + "9" * 25, "v1" + "0" * 25, "v" + "0" * 30 + "7", "v8"]
    assert [r.path for r in order.rank_all(spark.createDataFrame([(n,) for n in long], "path string"), order.sort_columns()).orderBy("rank").collect()] == [long[2], long[3], long[0], long[1]]


def test_ranks_of_rows_without_or_with_equal_paths(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4), ("b", 5)], "path string, size bigint")
    out = order.rank_all(df, order.sort_columns()).collect()
    assert len(out) == 5 and sorted(r["rank"] for r in out) == [1, 2, 3, 4, 5] and {r["rank"] for r in out if r.path is None} == {1, 2}


def ranked_sizes(spark, values):
    return spark.createDataFrame([(i + 1, f"f{i}", v) for i, v in enumerate(values)], "rank bigint, path string, size bigint")


@pytest.mark.parametrize(("values", "budget", "first", "kept"), [([6, 6, 1], 7, False, [1, 3]), ([500], 5, False, []), ([500, 1], 5, True, [1]), ([10], 10, False, [1]), ([0, 0], 0, False, [1, 2])])
def test_greedy_size(spark, values, budget, first, kept):
    for serial in (1 << 20, 0):
        out = budgets.greedy_size(ranked_sizes(spark, values), budget, first, serial).where("fits").orderBy("rank").collect()
        assert [r["rank"] for r in out] == kept


def test_greedy_size_in_rounds(spark):
    import random

    rng = random.Random(3)
    values = [rng.choice([1, 5, 40, 300]) for _ in range(200)]
    used, kept = 0, []
    for n, v in enumerate(values, 1):
        if used + v <= 900:
            used, kept = used + v, [*kept, n]
    out = budgets.greedy_size(ranked_sizes(spark, values), 900, serial=5).where("fits").orderBy("rank").collect()
    assert [r["rank"] for r in out] == kept


@pytest.mark.parametrize("bad", [-1, 1.5, float("nan"), "12abc", 2**60, True])
def test_budget_values(bad):
    with pytest.raises(ValueError):
        budgets.checked_budget(bad, "x")


def test_budget_zero():
    assert budgets.checked_budget(0, "x") is None and budgets.checked_budget(0, "x", zero_is_none=False) == 0 and budgets.checked_budget("7", "x") == 7


def test_planned_characters(spark):
    out = budgets.character_budget(ranked_sizes(spark, [60, 80, 10]), 100, planned=True).orderBy("rank").collect()
    assert [(r.outcome, r.planned_length) for r in out] == [("kept", None), ("truncated", 40), ("dropped", None)]


def test_characters_with_contents(spark):
    rows = [(1, "a", 50, "x" * 50), (2, "b", 500, "\n".join(["y" * 9] * 50)), (3, "c", 50, "z" * 50), (4, "d", 0, None)]
    out = budgets.character_budget(spark.createDataFrame(rows, "rank bigint, path string, size bigint, content string"), 220).orderBy("rank").collect()
    assert [r.outcome for r in out] == ["kept", "truncated", "dropped", "kept"]
    assert out[1].content.startswith("yyyyyyyyy\n") and out[1].content.endswith("of 50 lines]") and len(out[1].content) <= 170


def test_truncation_never_splits_a_pair(spark):
    df = spark.createDataFrame([("😀" * 100, n) for n in range(60, 76)], "content string, budget int")
    for r in df.select(text.truncate_at_line(F.col("content"), F.col("budget")).alias("t"), "budget").collect():
        assert r.t is None or (len(r.t.content.encode("utf-16-le")) // 2 <= r.budget and set(r.t.content.split("\n")[0]) <= {"😀"})


def test_layers(spark):
    names = ["a/x.log", "a/keep.log", "b/c/d.txt", "b/e.txt", "sub/p.py", "p.py", ".GIT/x", "q/.git/x"]
    layers = [rules.Layer("gitignore", ("*.log", "!keep.log", "b/c/", "!b/c/d.txt", "!.git/"), source="g"), rules.Layer("toolignore", ("/p.py",), base="sub", source="s")]
    out = {r.path: r.verdict for r in rules.judge(spark.createDataFrame([(n, 1) for n in names], "path string, size bigint"), layers).collect()}
    assert [n for n in names if out[n].ignored] == ["a/x.log", "b/c/d.txt", "sub/p.py", ".GIT/x", "q/.git/x"]
    assert out["b/c/d.txt"].pruned_by == "b/c" and out["a/x.log"].rule_source == "g:1"


def test_nested_layers_and_scope_override():
    layers = rules.nested_layers([("a", ".gitignore", "x\n"), ("", C.IGNORE_FILE, "y"), ("", ".gitignore", "z")])
    assert [(x.base, x.kind) for x in layers] == [("", "gitignore"), ("", "toolignore"), ("a", "gitignore")]
    assert rules.without_rules_blocking(rules.Layer("gitignore", ("build/", "*.md")), "build/x").lines == ("*.md",)


def test_classify_and_load(spark):
    rows = [
        ("a.png", b"text"), ("b.xyz", bytes.fromhex("89504E470D0A1A0A")), ("c.xyz", b"ab\x00c"), ("d.ts", b"x=\"\x00\";"), ("e.xyz", b"\x01\x02\x03abc"), ("f.txt", b"hi\r\nthere"),
        ("yarn.lock", b"x"), ("sub/yarn.lock", b"plain"), ("g.ts", b"\x01" * 20 + b"a" * 20), ("h.xyz", None),
    ]
    df = spark.createDataFrame([(p, 4, r) for p, r in rows], "path string, size bigint, raw binary")
    out = {r.path: r for r in content.classify(df).collect()}
    assert [out[p].binary_category for p, _ in rows] == ["image", "image", "other", None, "other", None, "structure-only", None, "other", None]
    loaded, skipped = content.load(content.classify(df), "comment", {"other": "skip"})
    got = {r.path: r.content for r in loaded.collect()}
    assert got["f.txt"] == "hi\nthere" and got["yarn.lock"] == C.STRUCTURE_ONLY_BODY and got["a.png"] == "<!-- IMAGE File Excluded: a.png (4 B) -->"
    assert {r.path for r in skipped.collect()} == {"c.xyz", "e.xyz", "g.ts"}


def test_deduplicate(spark):
    rows = [(1, "a", "x", False, "utf8", None), (2, "b", "y", False, "utf8", None), (3, "c", "x", False, "utf8", None), (4, "l", "s", True, None, "structure-only"), (5, "m", "s", True, None, "structure-only"), (6, "n", None, False, None, None), (7, "o", "", False, None, None), (8, "p", "", False, None, None)]
    df = spark.createDataFrame(rows, "rank bigint, path string, content string, is_binary boolean, encoding string, binary_category string")
    kept, gone = content.deduplicate(df)
    assert [r.path for r in kept.orderBy("rank").collect()] == ["a", "b", "l", "m", "n", "o"]
    assert {(r.path, r.duplicate_of) for r in gone.collect()} == {("c", "a"), ("p", "o")}
    assert [(r["rank"], r.path) for r in content.deduplicate(df, "last")[0].orderBy("rank").collect()][:2] == [(1, "c"), (2, "b")]


def test_registry():
    r = content.Registry()
    for t in (content.Transform("a", str, heavy=True), content.Transform("b", str, needs=("a",)), content.Transform("c", str, order_sensitive=True, conflicts=("b",)), content.Transform("d", str, needs=("e",)), content.Transform("e", str, needs=("d",))):
        r.register(t)
    assert r.ordered(["a", "b", "c"]) == ["c", "a", "b"]
    assert r.check(["b", "x"]) == ["unknown transform x", "b needs a"] and r.check(["b", "a", "c"]) == ["c conflicts with b"]
    assert r.check(["d", "e"])[-1].startswith("circular")


def test_registry_advice_and_dispatch(spark):
    r = content.Registry()
    for t in (content.Transform("pdf", str, mime_types=("application/pdf",), outputs=("text",), heavy=True, requirements=("tool",)), content.Transform("thumb", str, inputs=("image",), idempotent=False), content.Transform("sort", str, (".md",), 3, order_sensitive=True)):
        r.register(t)
    told = [m for _, m in r.advice(["pdf", "thumb", "sort"])]
    assert len(told) == 4 and "gives text" in told[0] and any("follows thumb" in m for m in told) and any("needs tool" in m for m in told) and any("could come later" in m for m in told)
    files = spark.createDataFrame([("a.md", "application/pdf"), ("b.bin", "application/pdf"), ("c", None)], "path string, mime string")
    assert [x.t for x in files.select(r.dispatch(F.col("path"), F.col("mime")).alias("t")).collect()] == ["sort", "pdf", None]
    with pytest.raises(Exception, match="no transform for c"):
        files.select(r.dispatch(F.col("path"), F.col("mime"), required=True).alias("t")).collect()


def test_transform_cache(spark, tmp_path):
    def shout(s: str) -> str:
        with open(tmp_path / "calls", "a") as log:
            log.write("x")
        if s == "bad":
            raise ValueError(s)
        return s.upper()

    r = content.Registry()
    r.register(content.Transform("shout", shout, (".md",), heavy=True, flush=lambda: open(tmp_path / "flushed", "a").close()))
    cache = content.TransformCache(str(tmp_path / "cache"))
    rows = [("a.md", 1, "one"), ("b.md", 2, "two"), ("c.md", 3, "bad"), ("d.txt", 4, "four")]
    files = spark.createDataFrame(rows, "path string, size bigint, content string").withColumn("modified", F.lit("2024-01-01").cast("timestamp_ntz"))
    want = {("a.md", "ONE", None), ("b.md", "TWO", None), ("c.md", "bad", "shout: bad"), ("d.txt", "four", None)}
    for calls in (3, 4):  # the failure is not kept
        assert {(x.path, x.content, x.transform_error) for x in r.run_cached(files, cache).collect()} == want
        assert len((tmp_path / "calls").read_text()) == calls and (tmp_path / "flushed").exists()
    status = cache.status(spark).first()
    assert (status.entries, status.bytes) == (2, 6) and status.oldest <= status.newest
    old = content.TransformCache(cache.folder, ttl_hours=0)
    assert old.fresh(spark).count() == 0


def test_secrets(spark):
    key = "AKIA" + "ABCDEFGHIJKLMNOP"
    rows = [("a", f"x\nid={key}\n"), ("b", "password = changemechangeme"), ("c", 'api_key: "q8Zr3LmX91vTbY72"'), ("d", None), ("e", "plain")]
    out = {r.path: r for r in secrets.guard(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert out["a"].content == "x\nid=***REDACTED:AWS-ACCESS-KEY***\n" and out["a"].findings[0].start_line == 2
    more = [("f", "db_password=q8Zr3LmX91vTbY72"), ("g", "token = payload.token.trim.value"), ("h", "-----BEGIN RSA PRIVATE KEY-----\nMIIabc"), ("i", "aws_secret_access_key = " + "aB3/" * 10), ("j", "x = npm_" + "a1B2" * 9), ("k", "pk_live_" + "a" * 30)]
    rules_of = {r.path: [f.rule for f in r.findings] for r in secrets.guard(spark.createDataFrame(more, "path string, content string")).collect()}
    assert rules_of == {"f": ["assignment"], "g": [], "h": ["private-key-start"], "i": ["aws-secret-key"], "j": ["service-token"], "k": []}
    assert not out["b"].findings and out["c"].findings[0].rule == "assignment" and out["d"].content is None and out["e"].content == "plain"


def test_ledger(spark):
    df = spark.createDataFrame([("a", 5), ("b", 7)], "path string, size bigint")
    led = ledger.entries(df, "sizeGate")
    counts = {r.reason: r.files for r in ledger.by_reason(led).collect()}
    assert len(counts) == 22 and counts["sizeGate"] == 2 and counts["duplicate"] == 0
    assert [r.path for r in ledger.largest(led, 1).collect()] == ["b"] and ledger.retained(led, 1)[1] == 1
    assert ledger.retract(led, df.where("path = 'a'")).count() == 1


def test_changes(spark):
    files = spark.createDataFrame([("a", 1, False), ("b", 1, True), ("c", 1, False)], "path string, size bigint, forced boolean")
    st = spark.createDataFrame([("a", "staged"), ("a", "modified"), ("z", "modified")], "path string, status string")
    assert {r.path for r in changes.keep_changed(files, changes.change_set(st)).collect()} == {"a", "b"}
    assert {r.path for r in changes.change_set(st.union(spark.createDataFrame([("n", "renamed"), ("c", "created")], st.schema)), "staged").collect()} == {"a", "n"}
    assert {r.git_status for r in changes.annotate(files, None).collect()} == {"unknown"}
    assert {r.path: r.git_status for r in changes.annotate(files, st).collect()} == {"a": "modified", "b": "unmodified", "c": "unmodified"}


def sample(spark):
    rows = [("src/a.py", 10, "print(1)"), ("src/b.py", 20, "print(1)"), ("docs/x.md", 30, "# hi"), ("big.bin", 400000, "b"), ("dist/y.js", 5, "y"), (".git/config", 5, "g"), ("notes.log", 5, "n")]
    return spark.createDataFrame(rows, "path string, size bigint, content string")


def test_engine_accounts_for_every_file(spark):
    request = build_request({"force_include": ["notes.log"], "max_files": 3, "max_chars": 40})
    found = engine.plan(sample(spark), request, engine.layers_of(request))
    s = found.summary()
    assert s["candidates"] == s["selected"] + s["excluded"] == 7
    assert {r.path for r in found.selected.collect()} <= {"src/a.py", "src/b.py", "docs/x.md", "notes.log"}
    assert s["byReason"]["configExclude"] == 2 and s["byReason"]["sizeGate"] == 1
    with pytest.raises(PolicyFailure):
        engine.plan(sample(spark), build_request({"include": ["none/**"], "fail_empty": True}), []).enforce()


def test_row_order_does_not_matter(spark):
    request = build_request({"max_total_size": 45})
    a = engine.select(sample(spark), request, engine.layers_of(request)).selected.select("path", "rank").collect()
    b = engine.select(sample(spark).orderBy(F.desc("size")).repartition(3), request, engine.layers_of(request)).selected.select("path", "rank").collect()
    assert sorted(a) == sorted(b)


@pytest.mark.parametrize("output", render.FORMATS)
def test_render_documents(spark, tmp_path, output):
    request = build_request({"format": output, "deduplicate": True})
    target = str(tmp_path / "out")
    summary = engine.copy(sample(spark), request, engine.layers_of(request), render.Document("/root/p"), target)
    body = open(target, encoding="utf-8").read()
    assert summary["outputBytes"] == os.path.getsize(target) and "a.py" in body and ("b.py" not in body)
    if output == "json":
        import json

        assert [f["path"] for f in json.loads(body)["files"]] == ["docs/x.md", "src/a.py"]
    if output == "xml":
        import xml.dom.minidom

        assert len(xml.dom.minidom.parseString(body).getElementsByTagName("ct:file")) == 2
    if output == "sarif":
        import json

        assert len(json.loads(body)["runs"][0]["results"]) == 2


def test_xml_stays_valid(spark, tmp_path):
    import xml.dom.minidom

    files = spark.createDataFrame([("a.txt", 9, "x\x01]]>\x1fy")], "path string, size bigint, content string")
    request = build_request({})
    engine.copy(files, request, [], render.Document("/root/p", instructions="a\x02]]>", instructions_name='"n"'), str(tmp_path / "o"))
    parsed = xml.dom.minidom.parseString((tmp_path / "o").read_text())
    assert parsed.getElementsByTagName("ct:file")[0].firstChild.data + parsed.getElementsByTagName("ct:file")[0].lastChild.data == "x]]>y" and parsed.getElementsByTagName("ct:instructions")[0].getAttribute("name") == '"n"'


@pytest.mark.parametrize("output", render.FORMATS)
@pytest.mark.parametrize("rows", [7, 0])
def test_chunks_are_the_document(spark, tmp_path, output, rows):
    files = sample(spark).withColumn("rank", F.row_number().over(Window.orderBy("path"))).limit(rows).withColumn("content", F.concat("content", F.lit("  \n"), F.repeat(F.lit(" \n"), (F.col("rank") % 3).cast("int"))))
    for doc in (render.Document("/root/p"), render.Document("/root/p", pretty=True, metadata=False, instructions="read")):
        render.to_file(files, output, doc, str(tmp_path / f"whole{doc.pretty}"))
        render.write_chunks(files, output, doc, str(tmp_path / f"parts{doc.pretty}"), 3)
        parts = b"".join(p.read_bytes() for p in sorted((tmp_path / f"parts{doc.pretty}").glob("part-*")))
        assert parts == (tmp_path / f"whole{doc.pretty}").read_bytes()


def test_pretty_and_stamped(spark, tmp_path):
    import json

    request = build_request({"format": "json"})
    doc = render.Document("/root/p", pretty=True, reproducible=False, generated="2024-01-01T00:00:00.000Z")
    engine.copy(sample(spark).withColumn("modified", F.lit("2024-02-03 04:05:06").cast("timestamp_ntz")), request, engine.layers_of(request), doc, str(tmp_path / "o"))
    body = (tmp_path / "o").read_text()
    parsed = json.loads(body)
    assert parsed["metadata"]["generated"] == doc.generated and parsed["files"][0]["modified"] == "2024-02-03T04:05:06.000Z"
    assert '\n    {\n      "path": "docs/x.md",' in body and body.endswith("\n  ]\n}\n")
    assert "generated" not in render.header("json", render.Document("p"), 1, 1) and "<ct:generated>" in render.header("xml", doc, 1, 1)


def test_tree_order(spark):
    files = spark.createDataFrame([(p, 1) for p in ("b/x", "B", "a", "A", "é", "z", "Zeta/y", "b/c/d", "10", "9")], "path string, size bigint")
    lines = [r.path for r in tree_lines(files).orderBy("order_key").collect()]
    assert lines == ["b", "b/c", "b/c/d", "b/x", "Zeta", "Zeta/y", "10", "9", "a", "A", "B", "é", "z"]


def test_secret_policies(spark):
    key = "AKIA" + "ABCDEFGHIJKLMNOP"
    files = spark.createDataFrame([("a.txt", 30, f"id={key}"), ("b.txt", 10, "plain"), ("c.pem", 5, "x"), ("d.txt", 4000, "long")], "path string, size bigint, content string")
    made = lambda **more: engine.scan(files, build_request({"redact": "typed", "secret_max_bytes": 1000, **more}), [])
    found = made()
    s = found.summary()
    assert s["selected"] == 2 and s["byReason"]["secretFile"] == 1 and s["byReason"]["secretUnscannable"] == 1 and s["candidates"] == s["selected"] + s["excluded"]
    told = secrets.counters(found.selected, found.excluded)
    assert (told["findings"], told["redactedPaths"], told["excludedSecretFilesPaths"], told["excludedUnscannable"]) == (1, ["a.txt"], ["c.pem"], 1)
    assert made(redact_inline=False).summary()["byReason"]["secretDetected"] == 1 and made(secret_oversize="scan").summary()["selected"] == 3
    with pytest.raises(SecretsDetected) as raised:
        made(fail_on_secrets=True).enforce()
    assert raised.value.findings == [{"path": "a.txt", "rule": "aws-access-key", "start_line": 1}]
    with pytest.raises(PolicyFailure, match="too large"):
        made(secret_oversize="fail").enforce()
    planned = engine.plan(files.drop("content"), build_request({"redact": "typed", "secret_max_bytes": 1000}), [])
    assert planned.summary()["byReason"]["secretUnscannable"] == 1


def test_forced_dotfiles_and_scoped_depth(spark):
    rows = [(p, 1) for p in (".env.example", ".github/w.yml", "a/b/c.py", "a/b/d/e.py", "x/y.py", ".git/.env.example")]
    files = spark.createDataFrame(rows, "path string, size bigint")
    request = build_request({"exclude": ["**"]})
    assert {r.path for r in engine.select(files, request, engine.layers_of(request)).selected.collect()} == {".env.example", ".github/w.yml"}
    request = build_request({"scopes": ["a/b"], "max_depth": 0})
    assert {r.path for r in engine.select(files, request, []).selected.collect()} == {"a/b/c.py"}


def test_strict_and_degraded(spark):
    request = build_request({"git_filter": "modified", "strict": True})
    with pytest.raises(PolicyFailure, match="no change set"):
        engine.select(sample(spark), request, []).enforce()


def test_option_layers(tmp_path):
    for bad in ({"only_tree": True, "line_numbers": True}, {"fail_on_secrets": True}):
        with pytest.raises(InvalidOption):
            build_request(bad)
    (tmp_path / ".ctxprofile.json").write_text('{"exclude": ["x"], "options": {"format": "MD"}}')
    (tmp_path / ".ctxprofile-api.json").write_text('{"include": ["src/**"], "exclude": ["y"], "options": {"format": "nonsense"}}')
    profile = load_profile(str(tmp_path), "api")
    assert (profile.include, profile.exclude) == (["src/**"], ["x", "y"]) and build_request({}, load_profile(str(tmp_path))).format == "markdown"
    assert build_request({"format": "json"}, load_profile(str(tmp_path))).format == "json" and build_request({}, profile).format == "xml"
    with pytest.raises(ProfileNotFound):
        load_profile(str(tmp_path), "other")
    (tmp_path / "o.json").write_text('{"sort": "size", "max_files": 3}')
    assert layered_options((str(tmp_path / "o.json"),), {"max_files": 9}) == {"sort": "size", "max_files": 9}
    (tmp_path / "bad.json").write_text('{"sorted": 1}')
    with pytest.raises(InvalidOption):
        layered_options((str(tmp_path / "bad.json"),))
    (tmp_path / "mine.md").write_text("hello")
    assert read_instructions("mine", (str(tmp_path),)) == "hello" and read_instructions("default")


def test_chain(spark):
    frame = spark.range(5)
    seen = []
    chain = Chain(written=True).add(Stage("double", lambda d: d.withColumn("id", F.col("id") * 2), after=lambda d: seen.append(d.count())))
    chain.add(Stage("fail", lambda d: d.select("nothing"), recover=lambda error, d: d)).add(Stage("filter", lambda d: d.where("id > 2")), after="double")
    assert chain.stats()["duration"] is None and chain.stats()["successRate"] is None
    assert [s.name for s in chain.stages] == ["double", "filter", "fail"]
    assert chain.run(frame).count() == 3 and seen == [5]
    stats = chain.stats()
    assert (stats["completed"], stats["recovered"]) == (2, 1) and set(stats["seconds"]) == {"double", "filter", "fail"} and stats["average"] > 0
    with pytest.raises(Interrupted):
        chain.run(frame, cancelled=lambda: True)
    with pytest.raises(Exception):
        Chain([Stage("fatal", lambda d: d.select("nothing"), recover=lambda error, d: d, fatal=True)]).run(frame)


def test_cancellation(spark):
    import threading

    with cancellable(spark) as tag:
        stop = threading.Timer(2, cancel, (spark, tag))
        stop.start()
        with pytest.raises(Exception, match="cancel"):
            spark.range(0, 10**13, 1, 2).selectExpr("sum(id * 3 % 7)").collect()
        stop.join()


def test_git_excludes(tmp_path):
    repo, home = tmp_path / "repo", tmp_path / "home"
    (repo / ".git/info").mkdir(parents=True)
    (repo / "a/b").mkdir(parents=True)
    home.mkdir()
    (repo / ".git/info/exclude").write_text("# c\nsecret.txt\n")
    (home / "mine").write_text("*.tmp")
    (home / ".gitconfig").write_text('[user]\nexcludesfile = no\n[core]\n  # x\n  ExcludesFile = ~/mine ; note\n')
    layers = git.exclude_layers(str(repo / "a/b"), {"HOME": str(home)})
    assert [(x.kind, x.lines[0]) for x in layers] == [("global-gitignore", "*.tmp"), ("git-info-exclude", "# c")]
    tree_of = tmp_path / "linked"
    tree_of.mkdir()
    (tree_of / ".git").write_text(f"gitdir: {repo}/.git/worktrees/w\n")
    (repo / ".git/worktrees/w").mkdir(parents=True)
    (repo / ".git/worktrees/w/commondir").write_text("../..\n")
    assert [x.kind for x in git.exclude_layers(str(tree_of), {"HOME": str(tmp_path / "none")})] == ["git-info-exclude"]
    assert git.excludes_setting('[core]\nexcludesfile = "a b" # x') == "a b" and git.excludes_setting(None) is None


def test_deliver(spark, tmp_path, capsys):
    files = sample(spark).withColumn("rank", F.monotonically_increasing_id())
    assert render.deliver(files, None, render.Document("p"), str(tmp_path / "o.jsonl")) == os.path.getsize(tmp_path / "o.jsonl") and (tmp_path / "o.jsonl").read_text().startswith('{"type": "metadata"')
    assert render.deliver(files, "ndjson", render.Document("p"), "-") == len(capsys.readouterr().out.encode())


def test_ignore_context(spark, monkeypatch):
    request = build_request({})
    found = engine.select(sample(spark), request, [])
    report = reports.ignore_context(spark, "*.log\n", found, engine.select(sample(spark), request, engine.layers_of(request)))
    body = reports.ignore_context_text(report)
    assert "| src/ | 2 | 30 B |" in body and "- docs/x.md (30 B)" in body and "*.log" in body and not report["truncation"]["truncated"]
    monkeypatch.setattr(C, "REPORT_PATHS", 2)
    report = reports.ignore_context(spark, None, found, found)
    assert report["paths"] is None and report["truncation"]["omitted"] == report["candidates"] and "exceed" in reports.ignore_context_text(report)


def test_dry_run_and_rows(spark):
    request = build_request({})
    assert engine.copy(sample(spark), request, engine.layers_of(request), render.Document("p"), "")["estimate"]["tokens"] > 0
    seen = []
    assert [r.path for r in engine.rows(engine.select(sample(spark), request, engine.layers_of(request)), seen.append)] == ["docs/x.md", "src/a.py", "src/b.py"] and seen


def test_explain_and_inspect(spark):
    request = build_request({"extensions": ["py"]})
    layers = engine.layers_of(request)
    found = engine.select(sample(spark), request, layers)
    out = {r.path: r for r in reports.explain(sample(spark), request, layers, found).collect()}
    assert out["src/a.py"].decision == "selected" and out["src/a.py"].steps[-1].detail == "position 1"
    assert out["docs/x.md"].reason == "extension" and out["dist/y.js"].reason == "ignore-rules" and out[".git/config"].steps[0].verdict == "fail"
    assert {k: v.count() for k, v in reports.inspect(found).items()}["directories"] == 1
    assert reports.starter_rules(sample(spark)) == ["docs/"]


def test_check_rules(spark):
    text_of = "﻿*.py\nsrc/\n!src/a.py\n../x\n*.py\nnope\n"
    layer = rules.Layer("toolignore", tuple(text_of.removeprefix("﻿").split("\n")), source="t")
    files = sample(spark)
    left = rules.judge(files, [layer]).where(~F.col("verdict.ignored"))
    request = build_request({"max_files": 1})
    codes = {r.code for r in reports.check_rules(spark, text_of, files, left, engine.select(files, request, [layer])).collect()}
    assert {r.code for r in reports.check_rules(spark, "a/b\na/\n*.md\n!*.md\n", files, left, engine.select(files, request, [layer]), focus="9").collect()} >= {"RULE_SHADOWED", "RULE_CANCELLED", "RULE_NOT_FOUND"}
    assert {"BOM", "NEGATION_BLOCKED", "ROOT_ESCAPE", "DUPLICATE_RULE", "RULE_MATCHES_NOTHING", "SOURCE_EXCLUDED", "BUDGET_STILL_BINDS"} <= codes


def test_tree_source(spark, tmp_path):
    for name, body in (("a/x.txt", "1"), ("a/.gitignore", "x.txt"), ("b/c/y.txt", "22"), ("z.txt", "3"), (".git/h", "4")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    os.symlink("/etc", tmp_path / "out")
    os.symlink(tmp_path, tmp_path / "b/loop")
    files = tree.files_from_tree(spark, str(tmp_path))
    assert sorted(r.path for r in files.collect()) == ["a/.gitignore", "a/x.txt", "b/c/y.txt", "z.txt"]
    assert [r.path for r in tree.files_from_tree(spark, str(tmp_path), scope="b/c").collect()] == ["b/c/y.txt"]
    for tasks in ("1", "3", "1000"):
        assert sorted(r.path for r in tree.files_from_tree(spark, str(tmp_path), tasks=tasks).collect()) == ["a/.gitignore", "a/x.txt", "b/c/y.txt", "z.txt"]
        assert sorted(r.path for r in tree.files_from_tree(spark, str(tmp_path), tasks=tasks, maxDepth="1").collect()) == ["a/.gitignore", "a/x.txt", "z.txt"]
    with pytest.raises(FileNotFoundError):
        tree.with_retry(lambda: os.stat(tmp_path / "nothing"), delay=100)
    assert "symlinkEscape" in {r.problem for r in tree.files_from_tree(spark, str(tmp_path), followSymlinks="true").collect()}
    assert {r.path: bytes(r.raw) for r in tree.load_contents(files, str(tmp_path)).where("raw IS NOT NULL").collect()}["b/c/y.txt"] == b"22"
    nested = rules.nested_layers(tree.ignore_rules_from_tree(spark, files))
    assert {r.path for r in rules.judge(files, nested).where("verdict.ignored").collect()} == {"a/x.txt"}


def test_scopes(tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    assert scopes.resolve_scopes(str(tmp_path), ["a", "a/b"]) == ["a"] and scopes.subsume([".", "a"]) == []
    with pytest.raises(ValueError):
        scopes.resolve_scopes(str(tmp_path), ["../x"])


def test_request_layers(tmp_path):
    (tmp_path / "p.json").write_text('{"include": ["src/**"], "exclude": ["x"], "options": {"max_files": 5}, "x-note": 1}')
    profile = read_profile(str(tmp_path / "p.json")).over(Profile(exclude=["y"], options={"sort": "size"}))
    r = build_request({"max_chars": 0}, profile)
    assert r.max_files == Budget(5, "profile") and r.max_chars == Budget(0, "option") and r.profile_exclude == ("y", "x") and r.sort == "size"
    for bad in ({"colour": 1}, {"sort": "colour"}, {"git_filter": "x"}):
        with pytest.raises(InvalidOption):
            build_request(bad)
    (tmp_path / "q.json").write_text('{"inclde": []}')
    with pytest.raises(InvalidOption):
        read_profile(str(tmp_path / "q.json"))


def test_rollups(spark):
    files = sample(spark)
    assert {r.extension: r.files for r in aggregates.by_extension(files).collect()}[".py"] == 2
    d = {r.path: r for r in aggregates.by_directory(files).collect()}
    assert d["src/"].main_extensions == [".py:2"] and d["docs/"].hint == "documentation"
    assert {r.path for r in aggregates.tree_totals(files, 1).collect()} >= {"src", "big.bin"}
    assert aggregates.estimate(files.limit(0)).first().characters == C.DOCUMENT_OVERHEAD["xml"]


def test_streams(spark, tmp_path, sf_dir):
    from contextlake.streaming import arrivals

    batch = spark.createDataFrame([("a.md", 1, "same", "2024-01-01 00:00:00"), ("b.md", 1, "same", "2024-01-01 00:01:00"), ("c.log", 1, "other", "2024-01-01 00:02:00")], "path string, size bigint, content string, modified string").withColumn("modified", F.to_timestamp("modified"))
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = arrivals.read_events(spark, str(tmp_path / "in"))
    request = Request()
    kept = arrivals.first_of_content(arrivals.narrow(stream, request, engine.layers_of(request)))
    out = arrivals.run_to_end(kept.select("path", "sha256"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert out.count() == 1
