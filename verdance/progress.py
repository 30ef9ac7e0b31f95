"""What a running step does: counters taken in the pass that writes a table, and lines about running stages."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

log = logging.getLogger("verdance")


class Counted:
    """Counters of rows on their way through a plan; no pass of their own.

    The first action over a frame that ``of`` gave fills them.  It must take
    all rows: a shuffle or a write behind it, not a ``head``.
    """

    def __init__(self) -> None:
        self._seen = Observation()

    def of(self, df: DataFrame, **counters: Column) -> DataFrame:
        """``df`` itself, observed; once for each object."""
        return df.observe(self._seen, *[c.alias(k) for k, c in counters.items()])

    def __getitem__(self, name: str) -> int:
        return self._seen.get.get(name) or 0


@contextmanager
def watched(spark: SparkSession, label: str, every: float = 30.0, say: Callable[[str], None] = log.info) -> Iterator[None]:
    """While the block runs, a line for each running stage of the context every so many seconds, and one at the start and the end."""
    tracker, done, began = spark.sparkContext.statusTracker(), threading.Event(), time.monotonic()

    def report() -> None:
        while not done.wait(every):
            for stage in sorted(tracker.getActiveStageIds()):
                info = tracker.getStageInfo(stage)
                if info:
                    say(f"{label}: stage {stage}: {info.numCompletedTasks} of {info.numTasks} tasks, {info.numFailedTasks} failed, {time.monotonic() - began:.0f} s")

    say(f"{label}: begins")
    thread = threading.Thread(target=report, daemon=True)
    thread.start()
    ended = "failed"
    try:
        yield
        ended = "done"
    finally:
        done.set()
        thread.join()
        say(f"{label}: {ended} after {time.monotonic() - began:.0f} s")
