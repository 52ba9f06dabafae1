"""The pipeline on a small corpus with planted cases, and the SQL of the queries that have it."""

import zlib

import duckdb
import pytest

import corpus_pipeline
from contextlake.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, sf_dir):
    out = tmp_path_factory.mktemp("corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    first = docs.orderBy("doc_id").first()
    odd = [
        (9000, "12345 !!!", "en", "src0", 9), (9001, first.text, first.lang, "src1", len(first.text)), (9002, f"{first.text[:200]} {item}", first.lang, "src1", 1), (9003, None, None, None, 0), (9004, "", "en", None, 0),
    ]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).write.parquet(f"{out}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_stages(spark, folder):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
    assert not {9000, 9003, 9004} & kept[0] and 9001 in kept[0] and 9001 not in kept[1] and 9002 in kept[2] and 9002 not in kept[3]
    assert kept[4] == kept[3] and len(kept[0]) >= 195


def test_near_duplicates_without_or_with_shared_ids(spark, words):
    one, two, three, four = (words(i, 60) for i in range(1, 5))
    rows = [(None, one), (None, two), (None, two), (7, three), (7, four), (8, four), (9, one + " end"), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(((r.doc_id, r.text or "") for r in out.collect()), key=repr) == sorted([(9, one + " end"), (None, two), (7, three), (7, four), (None, "")], key=repr)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = queries.QUERIES[name](spark, sf_dir)
    cursor = connection.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    plain = lambda r: repr([round(x, 6) if isinstance(x, float) else x for x in r])
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(plain, cursor.fetchall())) == sorted(map(plain, found.select(*columns).collect()))


def test_registered_classifiers(spark, sf_dir):
    """The queries' own parts: folds by crc32, one row for each document, predictions by the limit, and skill on what was held out."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    fold = lambda i, n: zlib.crc32(str(i).encode()) % n
    out = queries.op8_language_id(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in out)
    known = [r for r in out if r.held_out and docs[r.doc_id].lang is not None and r.lang_pred != "und"]
    assert known and sum(r.lang_pred == docs[r.doc_id].lang for r in known) >= 0.95 * len(known)
    out = queries.op10_quality_classifier(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in out)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [r for r in out if r.held_out and r.doc_id in labels]
    assert held and sum(r.predicted == labels[r.doc_id] for r in held) >= 0.8 * len(held)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_take_empty_tables(spark, folder, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_rows_without_or_with_shared_ids(spark, folder, words):
    """Clean rows stay in every stage, with null columns, one id for two texts, and a replacement character of their own."""
    texts = [f"{words(70 + i, 80)} \ufffd {words(170 + i, 20)}" for i in range(6)]
    passage = words(90, 40) + " é"
    ids = [None, None, 5, 5, 7, 8]
    rows = [(i, f"{t} {passage}", None if n else "en", None, None) for n, (i, t) in enumerate(zip(ids, texts, strict=True))]
    docs = spark.createDataFrame(rows, SCHEMA)
    near = corpus_pipeline.drop_near_duplicates(spark, docs, folder)
    assert sorted(map(repr, near.collect())) == sorted(map(repr, docs.collect()))
    cut = corpus_pipeline.remove_repeated_strings(spark, docs, folder)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.text) for r in cut.collect()))
    # the rows of the least id (null) keep the passage, and every text keeps its own words and sign
    assert [t.endswith(passage) for _, _, t in got] == [True, True, False, False, False, False] and all(t[:400] in {x[:400] for x in texts} and " \ufffd w" in t for _, _, t in got)
    clean = corpus_pipeline.drop_contaminated(spark, docs, folder)
    assert sorted(map(repr, clean.collect())) == sorted(map(repr, docs.collect()))
    known = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 9000").limit(60)
    odd = known.limit(3).selectExpr("CAST(NULL AS long) AS doc_id", "text", "lang", "CAST(NULL AS string) AS source", "CAST(NULL AS long) AS n_chars")
    assert corpus_pipeline.identify_language(spark, known.unionByName(odd), folder).where("doc_id IS NULL").count() == 3
    assert corpus_pipeline.mix(spark, docs, folder).count() == 6


def test_whole_characters(spark):
    rows = [(1, "é" * 40), (2, "x" + "é" * 30 + "y"), (3, "a" * 30 + "\u20ac" * 9 + "\ufffd"), (4, "a" * 29 + "b" + "a" * 29 + "\u20ac" * 7 + "tail \ufffd")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    out = {r.doc_id: r.text for r in corpus_pipeline.remove_repeated_strings(spark, docs, "").collect()}
    assert out[1] == rows[0][1] and out[2] == "xy" and out[3] == rows[2][1] and out[4].endswith("tail \ufffd") and out[4].startswith("a" * 29 + "b")
