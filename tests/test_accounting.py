"""Counts that the written frames give against counts of their own jobs."""

import pytest
from pyspark.sql import functions as F

from contextlake.operators import rules
from contextlake.plans import engine
from contextlake.request import Budget, Request
from contextlake.sources.tables import changes_from_labels, files_from_documents

LAYERS = [rules.Layer("config-exclude", ("*.log",), source="defaults"), rules.Layer("option-exclude", ("**/src1*/",), source="options")]
OPEN = {"max_files": Budget(None), "max_total_size": Budget(None), "size_gate": 8000, "max_file_size": 20000}
REQUESTS = {
    "open": Request(**OPEN),
    "files": Request(**OPEN | {"max_files": Budget(20)}),
    "size": Request(**OPEN | {"max_total_size": Budget(30_000)}),
    "both": Request(**OPEN | {"max_files": Budget(40), "max_total_size": Budget(30_000), "keep_oversized_first": True, "extensions": ("md", "py")}),
    "nothing": Request(**OPEN | {"include": ("none/**",), "max_files": Budget(5), "max_total_size": Budget(10)}),
}


def jobs(spark, call):
    spark.sparkContext.setJobGroup("counted", "")
    try:
        before = set(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
        out = call()
        return out, len(set(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) - before)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("name", list(REQUESTS))
@pytest.mark.parametrize("rows", ["all", "none", "doubled"])
def test_summary_without_jobs(spark, sf_dir, name, rows):
    files = files_from_documents(spark, sf_dir)
    files = {"all": files, "none": files.where("false"), "doubled": files.unionByName(files)}[rows]
    if rows == "doubled":
        files = files.withColumn("size", F.when(F.col("doc_id") % 9 != 0, F.col("size")))  # some sizes are not known
    chosen = engine.select(files, REQUESTS[name], LAYERS)
    told, needed = jobs(spark, chosen.summary)
    assert told == chosen.summary(recount=True) and told["candidates"] == told["selected"] + told["excluded"]
    assert jobs(spark, lambda: chosen.summary(recount=True))[1] >= 3
    assert needed == 0 or (rows == "none" and chosen.tally is None)
    assert told["truncated"] == any(told["byReason"][k] for k in ("fileCountBudget", "totalSizeBudget"))


def test_summary_where_metrics_do_not_tell_all(spark, sf_dir):
    files = files_from_documents(spark, sf_dir)
    statuses = changes_from_labels(spark, sf_dir).join(files.select("doc_id", "path"), "doc_id").select("path", "status")
    changed = engine.select(files, Request(**OPEN, git_filter="modified"), LAYERS, statuses)
    secret = engine.select(files, Request(**OPEN, redact="typed", secret_max_bytes=2000), LAYERS)
    cut = engine.plan(files, Request(**OPEN, max_chars=Budget(5000)), LAYERS)
    for chosen in (changed, secret, cut):
        told = chosen.summary()
        assert chosen.tally is None and told["candidates"] == told["selected"] + told["excluded"]
    assert secret.summary()["byReason"]["secretUnscannable"] and changed.summary()["byReason"]["gitFilter"] and cut.summary()["byReason"]["charBudget"]


def test_scopes_as_rows_equal_the_list(spark):
    import random

    from contextlake.sources import scopes

    rng = random.Random(5)
    for n in range(4):
        given = ["/".join(rng.choice("ab-.") + rng.choice("xy") for _ in range(rng.randint(1, 4))) for _ in range(40)] + (["."] if n == 3 else [])
        found = scopes.subsume_rows(spark.createDataFrame([(x,) for x in [*given, given[0], None]], "scope string"))
        assert sorted(r.scope for r in found.collect()) == scopes.subsume(given)
    assert scopes.subsume_rows(spark.createDataFrame([], "scope string")).count() == 0


def test_rule_lines_of_many_files(spark):
    from contextlake.plans import reports

    texts = spark.createDataFrame([(1, "\ufeff*.a\r\n\n # b\n!c "), (2, None), (3, ""), (4, "x")], "id int, text string")
    assert [tuple(r) for r in reports.rule_lines(texts).select("id", "line", "pattern", "negation").orderBy("id", "line").collect()] == [(1, 1, "*.a", False), (1, 4, "!c", True), (4, 1, "x", False)]
