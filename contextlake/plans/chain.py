"""Chains of stages from DataFrame to DataFrame, with hooks, recovery, timings and cancellation."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from contextlake.operators.order import checkpointed
from contextlake.request import Interrupted

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Stage:
    """before and after see the frame; recover may give a frame in place of a failure, unless the stage is fatal."""

    name: str
    apply: Step
    before: Callable[[DataFrame], None] | None = None
    after: Callable[[DataFrame], None] | None = None
    recover: Callable[[Exception, DataFrame], DataFrame] | None = None
    fatal: bool = False


@dataclass
class Chain:
    """Stages in a row. With ``written`` each stage's result is checkpointed, so that its time is its work and not only its planning."""

    stages: list[Stage] = field(default_factory=list)
    written: bool = False
    completed: int = 0
    failed: int = 0
    recovered: int = 0
    seconds: dict[str, float] = field(default_factory=dict)
    began: float | None = None
    ended: float | None = None

    def add(self, stage: Stage, after: str | None = None) -> Chain:
        at = next((i + 1 for i, s in enumerate(self.stages) if s.name == after), None)
        if after is not None and at is None:
            raise ValueError(f"no stage {after!r}")
        self.stages.insert(len(self.stages) if at is None else at, stage)
        return self

    def run(self, frame: DataFrame, cancelled: Callable[[], bool] = lambda: False) -> DataFrame:
        self.began, self.ended = time.time(), None
        self.completed, self.failed, self.recovered, self.seconds = 0, 0, 0, {}
        try:
            for stage in self.stages:
                if cancelled():
                    raise Interrupted(f"cancelled before {stage.name}")
                frame = self._one(stage, frame)
        finally:
            self.ended = time.time()
        return frame

    def _one(self, stage: Stage, frame: DataFrame) -> DataFrame:
        start = time.time()
        try:
            if stage.before:
                stage.before(frame)
            out = stage.apply(frame)
            out = checkpointed(out) if self.written else out
            self.completed += 1
        except Exception as failure:
            if stage.fatal or stage.recover is None:
                self.failed += 1
                raise
            out = stage.recover(failure, frame)
            self.recovered += 1
        finally:
            self.seconds[stage.name] = time.time() - start
        if stage.after:
            stage.after(out)
        return out

    def stats(self) -> dict:
        """Counts, seconds by stage, their mean, the whole duration and the share of stages that succeeded; null before a run."""
        run = self.completed + self.failed + self.recovered
        return {
            "completed": self.completed, "failed": self.failed, "recovered": self.recovered, "seconds": dict(self.seconds), "average": sum(self.seconds.values()) / run if run else None,
            "duration": None if self.began is None else (self.ended or time.time()) - self.began, "successRate": self.completed / run if run else None,
        }


@contextmanager
def cancellable(spark: SparkSession, tag: str | None = None) -> Iterator[str]:
    """Jobs started inside carry the tag that is given back; cancel() with it ends them from another thread."""
    tag = tag or f"run-{uuid.uuid4().hex}"
    spark.sparkContext.addJobTag(tag)
    try:
        yield tag
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    spark.sparkContext.cancelJobsWithTag(tag)
