"""Documents that are committed, and trees that are narrowed by conditions."""

import os
import threading

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from contextlake.sinks import documents, render
from contextlake.sources import tree


def files(spark, n):
    made = spark.range(n).select((F.col("id") + 1).alias("rank"), F.concat(F.lit("d/f"), "id", F.lit(".md")).alias("path"), F.concat(F.lit("line\n é"), "id", F.lit("\n")).alias("content"))
    return made.withColumn("size", F.octet_length("content").cast("bigint"))


@pytest.mark.parametrize("output", ["xml", "json", "ndjson", "markdown", "sarif", "tree"])
@pytest.mark.parametrize("n", [23, 0])
def test_committed_document_is_the_document(spark, tmp_path, output, n):
    doc = render.Document("/root/p")
    render.to_file(files(spark, n), output, doc, str(tmp_path / "whole"))
    told = render.publish(files(spark, n), output, doc, str(tmp_path / "parts"), 5)
    whole = (tmp_path / "whole").read_bytes()
    assert b"".join(documents.stream_bytes(str(tmp_path / "parts"), 7)) == whole and told["bytes"] == len(whole) == sum(p["bytes"] for p in told["parts"])
    lines = documents.read_lines(spark, "file:" + str(tmp_path / "parts"))
    assert sorted(r.value for r in lines.collect()) == sorted(whole.decode().removesuffix("\n").split("\n"))  # a row may be several lines


def test_failed_document_leaves_the_old_one(spark, tmp_path):
    folder = str(tmp_path / "doc")
    with pytest.raises(FileNotFoundError):
        documents.read_lines(spark, folder)
    rows = spark.range(0, 1000, 1, 4).select(F.col("id").cast("string").alias("value"))
    documents.commit_rows(rows, folder)
    first = documents.describe(folder)
    # one task fails after it and others have written rows
    broken = rows.select(F.when(F.col("value") == "900", F.raise_error(F.lit("lost half-way"))).otherwise(F.col("value")).cast("string").alias("value"))
    with pytest.raises(Exception, match="lost half-way"):
        documents.commit_rows(broken, folder)
    assert documents.describe(folder) == first and b"".join(documents.stream_bytes(folder)) == b"".join(b"%d\n" % i for i in range(1000))
    assert sorted(os.listdir(folder)) == sorted(["_document.json", first["version"]])  # what was aside is gone
    # a file that a lost attempt left in the version's folder is no part of the document
    (tmp_path / "doc" / first["version"] / "part-000000-999.txt").write_text("stray\n")
    assert documents.read_lines(spark, folder).count() == 1000
    documents.commit_rows(rows.where("id < 10"), folder)
    documents.commit_rows(rows.where("id < 5").union(spark.sql("SELECT CAST(NULL AS STRING)")), folder)
    last = documents.describe(folder)
    assert first["version"] not in os.listdir(folder) and last["before"] in os.listdir(folder)
    assert b"".join(documents.stream_bytes(folder)) == b"0\n1\n2\n3\n4\n\n" and last["rows"] == 6
    documents.commit_rows(rows.where("false"), folder)
    assert documents.read_lines(spark, folder).count() == 0 and documents.part_paths(folder) == []


def test_document_sink_refuses(spark, tmp_path):
    spark.dataSource.register(documents.DocumentSink)
    rows = spark.range(3).select(F.col("id").cast("string").alias("value"))
    with pytest.raises(Exception, match="overwrite"):
        rows.write.format(documents.NAME).mode("append").save(str(tmp_path / "a"))
    with pytest.raises(Exception, match="column of strings"):
        documents.commit_rows(spark.range(3), str(tmp_path / "b"))


def test_readers_see_one_document_or_the_other(spark, tmp_path):
    folder, seen, done = str(tmp_path / "doc"), set(), threading.Event()
    text = lambda k: spark.range(0, 400, 1, 4).select(F.lit(f"version {k}").alias("value"))
    documents.commit_rows(text(0), folder)

    def watch():
        while not done.is_set():
            try:
                seen.add(b"".join(documents.stream_bytes(folder)))
            except FileNotFoundError:  # two publications while one was read
                pass

    reader = threading.Thread(target=watch)
    reader.start()
    for k in (1, 2, 3):
        documents.commit_rows(text(k), folder)
    done.set()
    reader.join()
    assert seen <= {f"version {k}\n".encode() * 400 for k in range(4)}


@pytest.fixture
def wide(tmp_path):
    for a in range(6):
        for b in range(5):
            (tmp_path / f"d{a}/e{b}").mkdir(parents=True)
            for c in range(3):
                (tmp_path / f"d{a}/e{b}/f{c}.txt").write_text("x" * (c + 1))
    (tmp_path / "d1.txt").write_text("top")
    os.symlink(tmp_path / "d0/e0", tmp_path / "d1/link")
    return tmp_path


@pytest.mark.parametrize("tasks,follow", [("1", "false"), ("4", "true"), ("64", "true")])
@pytest.mark.parametrize(
    "condition",
    ["path = 'd1/e2/f1.txt'", "path LIKE 'd1%'", "path LIKE 'd1/e%' AND size > 1", "path IN ('d2/e0/f0.txt', 'd3/e1/f2.txt', 'none')", "size BETWEEN 2 AND 3 AND path LIKE '%.txt'", "path LIKE 'd1/link/%'", "path = 'd9'", "size > 1 OR path LIKE 'd2%'", "problem IS NULL AND path LIKE '%e1%'", "path <> 'd1.txt' AND size IS NOT NULL", "size IS NULL", "modified > '2001-01-01' AND path LIKE 'd4/%'"],
)
def test_conditions_change_no_result(spark, wide, condition, tasks, follow):
    options = {"tasks": tasks, "followSymlinks": follow}
    got = tree.files_from_tree(spark, str(wide), **options).where(condition)
    everything = spark.createDataFrame(tree.files_from_tree(spark, str(wide), **options).collect(), tree.SCHEMA + ", forced boolean")
    assert sorted(got.select("path", "size").collect()) == sorted(everything.where(condition).select("path", "size").collect())


def test_conditions_open_few_directories(spark, wide):
    spark.dataSource.register(tree.TreeSource)

    def opened(*conditions, **options):
        reader = tree.PrunedTreeReader({"path": str(wide), **options})
        assert list(reader.pushFilters(list(conditions))) == []
        found = [row[0] for part in reader.partitions() for row in reader.read(part)]
        return len(found), reader.opened

    assert opened(tasks="1") == (91, 37)
    assert opened(tree.StringStartsWith(("path",), "d3/e1/"), tasks="1") == (3, 3)
    assert opened(tree.EqualTo(("path",), "d3/e1/f0.txt"), tasks="1") == (1, 3)
    assert opened(tree.In(("path",), ("d3/e1/f0.txt", "d4/e1/f0.txt")), tasks="1") == (2, 5)
    assert opened(tree.EqualTo(("path",), "d1.txt"), tasks="64")[0] == 1 and opened(tree.EqualTo(("path",), "d1.txt"), tasks="1")[1] == 1
    assert opened(tree.StringStartsWith(("path",), "zz"), tasks="64")[0] == 0 and opened(tree.StringStartsWith(("path",), "zz"), tasks="1") == (0, 1)
    assert opened(tree.StringStartsWith(("path",), "d3/"), scope="d4", tasks="8") == (0, 0)
    # listed once to be split into tasks and once when it is read
    assert opened(tree.StringStartsWith(("path",), "d3/e1/"), tasks="64")[1] <= 6
    narrowed = tree.files_from_tree(spark, str(wide)).where("path LIKE 'd3/e1/%' AND size > 1")
    assert narrowed.rdd.getNumPartitions() <= 3 and tree.files_from_tree(spark, str(wide)).rdd.getNumPartitions() > 30
    plan = narrowed._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "Filter (" not in plan  # every condition is the source's
