"""The budget over arriving files against a fold over all of them."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from contextlake.streaming import arrivals, budgets

SCHEMA = "key string, time timestamp, id bigint, size bigint, digest string"


def fold(rows, budget, period=86400):
    out, state = [], {}
    for key, time, number, size, digest in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
        used, seen = state.get((key, time // period), (0, set()))
        size = size or 0
        if digest is not None and digest in seen:
            outcome, after = "duplicate", used
        else:
            outcome, after = "kept" if used + size <= budget else "truncated" if used < budget else "dropped", used + size
        out.append((key, time, number, size, used, outcome))
        state[key, time // period] = (after, seen | {digest})
    return sorted(out, key=lambda r: r[2])


def write(spark, rows, folder, files):
    each = -(-len(rows) // files)
    for n in range(files):  # files arrive in this order
        part = spark.createDataFrame([(k, None if t is None else t, i, s, d) for k, t, i, s, d in rows[n * each : (n + 1) * each]], "key string, t bigint, id bigint, size bigint, digest string")
        part.withColumn("time", F.timestamp_seconds("t")).select("key", "time", "id", "size", "digest").coalesce(1).write.mode("append").parquet(folder)


def collected(df):
    return sorted(((r.key, r.t, r.id, r.size, r.used, r.outcome) for r in df.select("*", F.unix_seconds("time").alias("t")).collect()), key=lambda r: r[2])


@pytest.mark.parametrize("files", [1, 4])
def test_stream_equals_fold(spark, tmp_path, files):
    rng = random.Random(files)
    start = 1_700_000_000
    rows = [(rng.choice(["a", "b", "é\"", None]), start + i * 900 + rng.randint(-3000, 3000), i, rng.choice([0, 1, 7, 40, None]), rng.choice(["x", "y", None, str(i)])) for i in range(240)]
    rows += [("a", rows[5][1], 1000, 3, "z"), ("a", rows[5][1], 1001, 3, "z"), ("a", None, 1002, 3, "z")]  # ties, and a row without a time
    rows.sort(key=lambda r: r[1] or start)
    if files > 1:  # rows come out of order, by less than the watermark allows
        rows = [r for n in range(0, len(rows), 4) for r in reversed(rows[n : n + 4])]
    write(spark, rows, str(tmp_path / "in"), files)
    stream = arrivals.read_events(spark, str(tmp_path / "in"))
    found = budgets.run_closed(stream, lambda s: budgets.running_budget(s, 100, late="3 hours"), str(tmp_path / "out"), str(tmp_path / "progress"))
    assert collected(found) == fold(rows, 100)
    assert spark.conf.get(budgets.PROVIDER) != budgets.ROCKS


def test_nothing_arrives(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = arrivals.read_events(spark, str(tmp_path / "in"))
    assert budgets.run_closed(stream, lambda s: budgets.running_budget(s, 100), str(tmp_path / "out"), str(tmp_path / "progress")).count() == 0


def test_state_is_forgotten(spark, tmp_path):
    """Forty days of one row an hour in ten files: state never holds more than the open period and what waits."""
    rows = [("k", 1_700_000_000 + i * 3600, i, 5, str(i)) for i in range(960)]
    write(spark, rows, str(tmp_path / "in"), 10)
    stream = arrivals.read_events(spark, str(tmp_path / "in"))
    old = spark.conf.get(budgets.PROVIDER)
    spark.conf.set(budgets.PROVIDER, budgets.ROCKS)
    try:
        query = budgets.running_budget(stream, 60).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    finally:
        spark.conf.set(budgets.PROVIDER, old)
    # a file holds 96 rows, each waiting with a timer; without clearing 960 digests would stay
    assert max(held) <= 350 and held[-1] <= 120
    done = collected(spark.read.parquet(str(tmp_path / "out")))
    assert done == fold(rows, 60)[: len(done)] and len(done) >= 950  # the last ticks wait for a watermark


def test_many_rows_wait_for_one_tick(spark, tmp_path, monkeypatch):
    rows = [("k", 1_700_000_000 + i % 60, i, 2, None) for i in range(23)]
    write(spark, rows, str(tmp_path / "in"), 3)  # a tick's rows come in three batches, in values of four
    whole = budgets.RunningBudget.__init__
    monkeypatch.setattr(budgets.RunningBudget, "__init__", lambda self, *a: (whole(self, *a), setattr(self, "rows_in_value", 4))[0])
    found = budgets.run_closed(arrivals.read_events(spark, str(tmp_path / "in")), lambda s: budgets.running_budget(s, 20), str(tmp_path / "out"), str(tmp_path / "progress"))
    assert collected(found) == fold(rows, 20)


class CountedHandle:
    """State in dicts, with the number of calls."""

    def __init__(self):
        self.calls = 0

    def getMapState(self, *_):
        return CountedState(self)

    getValueState = getMapState

    def registerTimer(self, _):
        self.calls += 1


class CountedState:
    def __init__(self, handle):
        self.handle, self.rows = handle, {}

    def __getattribute__(self, name):
        if name not in ("handle", "rows"):
            object.__getattribute__(self, "handle").calls += 1
        return object.__getattribute__(self, name)

    def containsKey(self, key):
        return key in self.rows

    def getValue(self, key):
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.rows[key] = value

    def removeKey(self, key):
        del self.rows[key]

    def exists(self):
        return None in self.rows

    def get(self):
        return self.rows[None]

    def update(self, value):
        self.rows[None] = value

    def clear(self):
        self.rows.clear()


def test_calls_to_the_store_grow_with_values_not_with_rows():
    """A tick of 6,000 rows, each of another digest and then each again, comes in 120 small batches in three triggers."""
    handle, processor = CountedHandle(), budgets.RunningBudget(100, 86_400_000, 3_600_000)
    processor.init(handle)
    rows = [(i * 1000, i, 1, str(i % 3000)) for i in range(6000)]
    frame = pd.DataFrame(rows, columns=["time", "id", "size", "digest"])
    for trigger in range(3):
        batches = [frame.iloc[lo : lo + 50] for lo in range(trigger * 2000, trigger * 2000 + 2000, 50)]
        list(processor.handleInputRows(('["k"]', 0), iter(batches), None))
    expired = type("Expired", (), {"getExpiryTimeInMs": lambda self: 3_600_000})()
    out = pd.concat(processor.handleExpiredTimer(('["k"]', 0), None, expired))
    expected = [(t, i, s, min(i, 3000), "duplicate" if i >= 3000 else "kept" if i < 100 else "dropped") for t, i, s, _ in rows]
    assert list(out.drop(columns="key").itertuples(index=False, name=None)) == expected
    assert handle.calls < 700


def test_ticks_make_periods():
    with pytest.raises(ValueError):
        budgets.RunningBudget(1, 10, 3)
