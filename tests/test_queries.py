"""Every registered query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from contextlake import queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return connection


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(columns), sorted(repr([plain(r[i]) for i in order]) for r in values)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, sf_dir, name):
    found = queries.QUERIES[name](spark, sf_dir)
    got = rows(found.columns, [tuple(r) for r in found.collect()])
    if name in queries.ORACLES:
        cursor = duck.execute(queries.ORACLES[name])
        assert got == rows([c[0] for c in cursor.description], cursor.fetchall())


def test_line_numbers_of_odd_texts(spark, tmp_path):
    """An empty text is one empty line, as in the SQL; null stays null."""
    texts = ["", None, "\n", "a\r\nb", "a\n\n", "x\n" * 10001]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(path)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = dict(connection.execute(queries.ORACLES["line_numbers"]).fetchall())
    assert {r.path: r.numbered for r in queries.QUERIES["line_numbers"](spark, str(tmp_path)).collect()} == want


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
