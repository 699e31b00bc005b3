"""How far jobs are and when they will end: a stateful stream over the progress of their documents.

Events (job, ts, id, doc, progress, docs, prior) say how much of a document is done (0 to 1), how many documents the job has and, if known, the seconds a document took before. They are kept
until the watermark has passed them and then counted in order of (ts, id), so neither the cut into batches nor a restart changes a row. For each event: elapsed seconds, share of
the work, an estimate of all seconds (smoothed; from four seconds and some work on), and what remains. A job without an event for `idle` is closed: a last row, and its state is
dropped; a later event begins it anew. State is one entry for each document of an open job and each event the watermark hasn't passed; a job's events meet in one task, in order.

Times count in whole milliseconds, to the nearest (halves away from 1970). Null jobs are a job; events with a null ts, doc or progress are dropped; progress beyond 0 to 1 is cut to it; without documents the share is 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Seconds and work from which speed is measured, weights of the old and the new estimate, milliseconds between two rows of a job.
FROM_SECONDS, FROM_WORK, OLD, NEW, PAUSE_MS = 4.0, 0.15, 0.72, 0.28, 350
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_Estimate = Row("job", "ms", "kind", "elapsed", "share", "total", "remaining")
ROW = "job bigint, ms bigint, kind string, elapsed double, share double, total double, remaining double"


class _Jobs(StatefulProcessor):
    def __init__(self, idle_ms: int) -> None:
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("events", "ms bigint, id bigint, doc bigint, progress double, docs bigint, prior double")
        self.done = handle.getMapState("done", "doc bigint", "progress double")
        self.job = handle.getValueState("job", "started bigint, last bigint, shown bigint, work double, docs bigint, total double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        # Each call to the state is a message to the JVM, so a job's events are put there at once and have one timer, that of the first.
        new = [(r["ms"], r["id"], r["doc"], r["progress"], r["docs"], r["prior"]) for r in rows]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(e[0] for e in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        # The first timer of a batch counts all that the watermark has passed; those after it find nothing left.
        mark = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        state = tuple(self.job.get()) if self.job.exists() else None
        # Of events of one time and id the last counts.
        waiting = {tuple(e)[:2]: tuple(e)[2:] for e in self.waiting.get()}
        due = sorted((k, v) for k, v in waiting.items() if k[0] <= mark)
        rest = [(*k, *v) for k, v in waiting.items() if k[0] > mark]
        # What is known of documents in this call, whether the stored ones count besides, and which are to be stored.
        done, stored, changed = {}, state is not None, set()
        for (ms, _), (doc, progress, docs, prior) in due:
            if state and ms - state[1] > self.idle:
                yield self._closed(key, state)
                state = None
            if state is None:
                if stored:
                    self.done.clear()
                done, stored, changed = {}, False, set()
                state = (ms, ms, None, 0.0, docs, prior * docs if prior and docs else None)
            started, _, shown, work, _, total = state
            if doc not in done:
                done[doc] = self.done.getValue((doc,))[0] if stored and self.done.containsKey((doc,)) else 0.0
            now = max(0.0, min(1.0, progress))
            work += now - done[doc]
            done[doc] = now
            changed.add(doc)
            if shown is None or ms - shown >= PAUSE_MS:
                elapsed = max(0.001, (ms - started) / 1000)
                share = max(0.0, min(1.0, work / docs)) if docs else 1.0
                if elapsed >= FROM_SECONDS and work >= FROM_WORK:
                    raw = elapsed / max(0.001, share)
                    total = raw if total is None else total * OLD + raw * NEW
                shown = ms
                yield _Estimate(key[0], ms, "progress", elapsed, share, total, None if total is None else max(0.0, total - elapsed))
            state = (started, ms, shown, work, docs, total)
        if due and rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(e[0] for e in rest))
        elif due:
            self.waiting.clear()
        if state and state[1] + self.idle < mark:
            yield self._closed(key, state)
            if stored:
                self.done.clear()
            self.job.clear()
        elif state and due:
            for doc in changed:
                self.done.updateValue((doc,), (done[doc],))
            self.job.update(state)
            self.handle.registerTimer(state[1] + self.idle + 1)

    def _closed(self, key, state: tuple) -> Row:
        started, last, _, work, docs, total = state
        return _Estimate(key[0], last, "closed", max(0.001, (last - started) / 1000), max(0.0, min(1.0, work / docs)) if docs else 1.0, total, 0.0)

    def close(self) -> None:
        pass


def estimates(events: DataFrame, idle_ms: int, late: str = "1 hour") -> DataFrame:
    """The stream of ROW for events (job, ts, id, doc, progress, docs, prior)."""
    # The event time itself is rounded, so that the watermark and the milliseconds of the rows are counted alike.
    ts = F.timestamp_millis((F.round(F.unix_micros("ts"), -3) / 1000).cast("long"))
    e = events.filter("ts is not null and doc is not null and progress is not null").withColumn("ts", ts).withWatermark("ts", late)
    e = e.select(F.col("job").cast("long").alias("job"), "ts", F.unix_millis("ts").alias("ms"), F.col("id").cast("long").alias("id"), F.col("doc").cast("long").alias("doc"), F.col("progress").cast("double").alias("progress"), F.col("docs").cast("long").alias("docs"), F.col("prior").cast("double").alias("prior"))
    return e.groupBy("job").transformWithState(_Jobs(idle_ms), ROW, "Append", "EventTime")


@contextmanager
def rocks(spark: SparkSession):
    """While this holds, streams that are started keep their state in RocksDB, as processors with timers need."""
    old = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, old) if old else spark.conf.unset(_PROVIDER)
