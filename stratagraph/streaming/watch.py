"""The watch loop as Structured Streaming, and debouncing of wake-ups.

A file source cannot see changes in place or deletions, so the stream is a
clock: every trigger lists the tree again, compares it with the last listing
and commits if something changed.  State lives in the written listing, so a
restarted stream goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.incremental import Plan, detect


def cycle(previous: DataFrame | None, current: DataFrame) -> tuple[str, Plan]:
    """One cycle's outcome: bootstrap, idle, update or reindex, and its plan."""
    if previous is None or previous.isEmpty():
        return "bootstrap", Plan(full=True, reasons=["no previous snapshot"])
    plan = detect(current, previous)
    return ("reindex" if plan.full else "update" if plan.scoped or plan.deltas else "idle"), plan


def watch(spark: SparkSession, listing: Callable[[], DataFrame], last: Callable[[], DataFrame | None], commit: Callable[[str, Plan, DataFrame], None], interval: str = "2 seconds", checkpoint: str | None = None):
    """Start the loop: ``listing`` reads the tree, ``last`` the committed listing, ``commit`` writes a snapshot.

    Triggers that come late are folded into one batch, which is the debouncing
    of bursts; a forced look after silence needs nothing, as every tick looks.
    """

    def batch(_: DataFrame, __: int) -> None:
        now = listing()
        kind, plan = cycle(last(), now)
        if kind != "idle":
            commit(kind, plan, now)

    writer = spark.readStream.format("rate").option("rowsPerSecond", 1).load().writeStream.trigger(processingTime=interval).foreachBatch(batch)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def resync_seconds(interval: float) -> float:
    """After how much silence a cycle is forced."""
    return max(30.0, 15 * interval)


def bursts(events: DataFrame, key: str, time: str, reason: str, window_ms: int) -> DataFrame:
    """Wake-ups folded into bursts of a fixed window from their first event: key, started, wakes, reasons.

    A window that is fixed from the first event depends on all events before
    it, so no window function can say it; events are walked in order of time,
    one key at a time in batches, with the open burst as all state.  The keys'
    events are sorted by Spark, never gathered in memory.
    """
    ordered = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(
        F.col(key).cast("string").alias("key"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.coalesce(F.col(reason).cast("string"), F.lit("")).alias("why")
    )
    sorted_rows = ordered.repartition("key").sortWithinPartitions("key", "at", "why")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, start, wakes, why = None, 0, 0, {}
        out: list[tuple] = []
        for batch in batches:
            for k, at, reason_ in zip(batch["key"], batch["at"], batch["why"]):
                if k != now or at - start > window_ms * 1000:
                    if wakes:
                        out.append((now, start, wakes, "+".join(why)))
                    now, start, wakes, why = k, at, 0, {}
                wakes += 1
                if reason_:
                    why[reason_] = None  # in order of first use
            if out:
                yield pd.DataFrame(out, columns=["key", "started", "wakes", "reasons"])
                out = []
        if wakes:
            yield pd.DataFrame([(now, start, wakes, "+".join(why))], columns=["key", "started", "wakes", "reasons"])

    return sorted_rows.mapInPandas(fold, "key string, started long, wakes long, reasons string")
