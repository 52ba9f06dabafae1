import pytest
from pyspark.sql import functions as F

WORDS = [f"w{i:03d}" for i in range(400)]


@pytest.fixture(scope="session")
def words():
    """words(seed, n): a text of n words that no other seed shares runs with."""
    import random

    def make(seed: int, n: int) -> str:
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def frame(spark):
    """frame(rows): documents (doc_id, text) with columns whose names clash with the operators' own."""

    def make(rows, **more):
        df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
        return df.withColumns({"key": F.lit("k"), "range": F.lit(7), "block": F.lit("b"), "size": F.lit(3), "rank": F.lit(1), "a": F.lit(0), "b": F.lit(0), "spans": F.lit(None).cast("string")} | more)

    return make
