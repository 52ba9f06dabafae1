"""A budget over files as they arrive: the prefix budget of a batch, kept for each key and period of event time.

Rows wait until the watermark has passed their tick, and are then decided in the order of (time, id), so the result does not
depend on how they arrived, only on whether they arrived before the watermark. Each period of a key is a group of its own, as nothing passes from
one to the next: its state is its waiting rows, the bytes it has used and the digests it has seen, and a timer at its end clears it. State
is so bounded by the rows of open ticks and the digests of open periods. Rows and digests lie in packed values, so calls to the state store grow with
values, not with rows. One key's rows of one tick are decided in one task: a shorter tick means fewer of them.
"""

from __future__ import annotations

import json
import sys
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from contextlake.streaming import arrivals

DECIDED = "key string, time bigint, id bigint, size bigint, used bigint, outcome string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: later than any event
END = "9000-01-01 00:00:00"


# Spark looks at a processor in a Python worker of the driver first, which does not get the session's shipped files
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class RunningBudget(StatefulProcessor):
    def __init__(self, budget: int, period: int, tick: int):
        """period and tick in milliseconds, a period being whole ticks."""
        if tick <= 0 or period % tick:
            raise ValueError("a period must be a whole number of ticks")
        self.budget, self.period, self.tick = budget, period, tick
        self.rows_in_value = 5_000
        self.buckets = 256

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # rows by the tick whose end decides them, some thousand in a value, so a timer reads no row of another tick
        self.waiting = handle.getMapState("waiting", "tick bigint, part bigint", "rows string")
        self.spent = handle.getValueState("spent", "used bigint")
        # digests by bucket: a tick reads each of its rows' buckets once
        self.seen = handle.getMapState("seen", "bucket int", "digests string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held: dict[int, list[pd.DataFrame]] = {}
        parts: dict[int, int] = {}
        n = 0
        for batch in rows:
            ends = (batch["time"] // 1000 // self.tick + 1) * self.tick
            for tick, group in batch[["time", "id", "size", "digest"]].groupby(ends):
                held.setdefault(int(tick), []).append(group)
                n += len(group)
            if n >= 40 * self.rows_in_value:
                self._wait(held, parts)
                held, n = {}, 0
        self._wait(held, parts)
        return iter(())

    def _wait(self, held: dict[int, list[pd.DataFrame]], parts: dict[int, int]) -> None:
        """Puts rows aside until their tick ends; parts has the first free part of the ticks met before."""
        for tick, groups in held.items():
            if tick not in parts:
                parts[tick] = self._free_part(tick)
                self.handle.registerTimer(tick)  # again is the same timer
            group = pd.concat(groups)
            for lo in range(0, len(group), self.rows_in_value):
                self.waiting.updateValue((tick, parts[tick]), (group.iloc[lo : lo + self.rows_in_value].to_json(orient="values"),))
                parts[tick] += 1

    def _free_part(self, tick: int) -> int:
        """How many parts wait for the tick, by doubling and halving, as there is no gap between them."""
        low, high = -1, 0
        while self.waiting.containsKey((tick, high)):
            low, high = high, 2 * high + 1
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self.waiting.containsKey((tick, middle)) else (low, middle)
        return high

    def _take(self, tick: int) -> list[list]:
        """The rows that waited for this tick, in their order; they wait no more."""
        rows, part = [], 0
        while (packed := self.waiting.getValue((tick, part))) is not None:
            rows += json.loads(packed[0])
            self.waiting.removeKey((tick, part))
            part += 1
        return sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3] or ""))

    def _repeated(self, digests: list[str | None]) -> list[bool]:
        """Which digests the period has seen, here or before; from now on it has seen all of them."""
        firsts: dict[str, int] = {}
        for i, digest in enumerate(digests):
            if digest is not None:
                firsts.setdefault(digest, i)
        out = [digest is not None and firsts[digest] != i for i, digest in enumerate(digests)]
        buckets: dict[int, list[str]] = {}
        for digest in firsts:
            buckets.setdefault(zlib.crc32(digest.encode("utf-8", "surrogatepass")) % self.buckets, []).append(digest)
        for bucket, own in buckets.items():
            packed = self.seen.getValue((bucket,))
            before = json.loads(packed[0]) if packed is not None else []
            known = set(before)
            for digest in own:
                out[firsts[digest]] = digest in known
            if fresh := [digest for digest in own if digest not in known]:
                self.seen.updateValue((bucket,), (json.dumps(before + fresh),))
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        ends = int(key[1]) // 1000 + self.period
        used = self.spent.get()[0] if self.spent.exists() else None
        if used is None and ends > now:
            self.handle.registerTimer(ends)
        used = used or 0
        rows = self._take(now)
        out = []
        for (time, number, size, _), repeated in zip(rows, self._repeated([r[3] for r in rows]), strict=True):
            if repeated:
                out.append((time, number, size, used, "duplicate"))
                continue
            outcome = "kept" if used + size <= self.budget else "truncated" if used < self.budget else "dropped"
            out.append((time, number, size, used, outcome))
            used += size
        if ends > now:
            self.spent.update((used,))
        else:
            self.spent.clear()
            self.seen.clear()
        for lo in range(0, len(out), 10_000):
            part = pd.DataFrame(out[lo : lo + 10_000], columns=["time", "id", "size", "used", "outcome"])
            part.insert(0, "key", key[0])
            yield part

    def close(self) -> None:
        pass


def running_budget(stream: DataFrame, budget: int, period: str = "1 day", tick: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """time, key, id, size, used (bytes of the period before it) and outcome (kept, truncated, dropped, duplicate) of every row.

    stream has key (string), time (timestamp), id, size and digest. A null size counts as 0, null digests are no duplicates of each other, rows
    without a time, or from the year 9000 on, are left out, a null key is a key. Rows that come after the watermark has passed them are dropped by Spark. The part of a stream that
    no watermark has passed stays undecided; run_closed() ends it. Rows behind the one that passes the budget are dropped, also smaller ones.
    """
    span = lambda text: int(pd.Timedelta(text) / pd.Timedelta(milliseconds=1))
    processor = RunningBudget(budget, span(period), span(tick))
    # a condition on the time itself stays behind the watermark, which so sees the end mark
    rows = stream.where("time IS NOT NULL").withWatermark("time", late).where(F.col("time") < F.lit(END).cast("timestamp"))
    rows = rows.select(F.to_json(F.array("key")).alias("packed"), F.col("time").alias("at"), F.unix_micros("time").alias("time"), F.col("id").cast("bigint").alias("id"), F.coalesce(F.col("size").cast("bigint"), F.lit(0)).alias("size"), "digest")
    period_start = F.col("time") - F.pmod("time", F.lit(1000 * processor.period).cast("bigint"))
    decided = rows.withColumn("period", period_start).groupBy("packed", "period").transformWithStateInPandas(processor, DECIDED, "append", "eventTime")
    return decided.select(F.timestamp_micros("time").alias("time"), F.from_json("key", "array<string>")[0].alias("key"), "id", "size", "used", "outcome")


def run_closed(stream: DataFrame, decide: Callable[[DataFrame], DataFrame], folder: str, progress: str, time: str = "time") -> DataFrame:
    """What decide() makes of all that is there, in append mode, also of what the stream's own watermark would leave open.

    A second source of end marks joins the stream. It is empty in the first run; then a mark later than any event is added, and a second
    run from the same checkpoint moves the watermark past everything. Each row is written once.
    """
    spark = stream.sparkSession
    marks = f"{folder.rstrip('/')}-end-{uuid.uuid4().hex}"
    fields = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != time else F.lit(END).cast(f.dataType).alias(time) for f in stream.schema.fields]
    mark = spark.range(1).select(*fields)
    mark.limit(0).write.parquet(marks)
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # which state of several variables needs
    try:
        for closing in (False, True):
            if closing:
                mark.write.mode("append").parquet(marks)
            ends = spark.readStream.schema(mark.schema).parquet(marks)
            out = arrivals.run_to_end(decide(stream.unionByName(ends)), folder, progress)
    finally:
        spark.conf.set(PROVIDER, before)
    return out
