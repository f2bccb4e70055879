"""Sessions with absorption and threshold episodes on a stream: custom state, timers on event time, state gone when the watermark has passed.

Rows may arrive in any order within the watermark, but what absorbs what depends on their
order, so rows wait in state until the watermark reaches them and are then walked in order. Rows
later than the watermark are dropped by Spark, and counted by it (``late_rows``). A run is
given out, and its state removed, once no row that could join it can come. Over all batches the
rows given out are those of the batch forms.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that custom state needs.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Ordered(StatefulProcessor):
    """Waits for the watermark, then takes a key's rows in order; ``take`` and ``closed`` say what happens to them."""

    pending_schema: str
    run_schema: str
    columns: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.pending_schema)
        self.run = handle.getValueState("run", self.run_schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = [self.row(r) for batch in rows for r in batch.itertuples(index=False)]
        if came:
            self.pending.appendList(came)
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def _advance(self, key, watermark_ms: int) -> Iterator[pd.DataFrame]:
        now, out = watermark_ms * 1000, []
        held = sorted(tuple(r) for r in self.pending.get()) if self.pending.exists() else []
        ready, wait = [r for r in held if r[0] <= now], [r for r in held if r[0] > now]
        run = list(self.run.get()) if self.run.exists() else None
        for r in ready:
            run, done = self.take(run, r)
            out += [done] if done else []
        if run is not None and now - self.last(run) > self.gap:
            out += [done] if (done := self.closed(run)) else []
            run = None
        if ready:
            self.pending.clear()
            if wait:
                self.pending.put(wait)
        if run is None:
            self.run.clear()
        else:
            self.run.update(tuple(run))
        ends = [r[0] for r in wait[:1]] + ([self.last(run) + self.gap + 1] if run is not None else [])
        if ends:  # wakes this key when the next row may be taken or the run can be closed
            at = -(-min(ends) // 1000)
            if at > watermark_ms:
                self.handle.registerTimer(at)
        if out:
            yield pd.DataFrame([(*key, *row) for row in out], columns=self.columns)

    def close(self) -> None:
        pass


class Absorbing(_Ordered):
    """A run of one kind takes short items of other kinds in, as interruptions."""

    pending_schema = "start long, stop long, kind string"
    run_schema = "kind string, start long, stop long, items long, interruptions long"
    columns = ["user_id", "kind", "start", "end", "items", "interruptions"]

    def __init__(self, gap: int, absorb: int):
        self.gap, self.absorb = gap, absorb

    def row(self, r) -> tuple:
        return int(r.start), int(r.end), r.kind

    def last(self, run) -> int:
        return run[2]

    def take(self, run, r):
        start, end, kind = r
        if run and start - run[2] <= self.gap and (kind == run[0] or end - start <= self.absorb):
            run[3 if kind == run[0] else 4] += 1
            run[2] = max(run[2], end)
            return run, None
        return [kind, start, end, 1, 0], tuple(run) if run else None

    def closed(self, run):
        return tuple(run)


class Episodes(_Ordered):
    """Points over a threshold that follow each other within a gap; shorter runs than ``least`` are none."""

    pending_schema = "at long, value double"
    run_schema = "start long, stop long, n long, most double"
    columns = ["event_type", "user_id", "start", "end", "n", "most"]

    def __init__(self, gap: int, least: int):
        self.gap, self.least = gap, least

    def row(self, r) -> tuple:
        return int(r.at), float(r.value)

    def last(self, run) -> int:
        return run[1]

    def take(self, run, r):
        at, value = r
        if run and at - run[1] <= self.gap:
            return [run[0], at, run[2] + 1, max(run[3], value)], None
        return [at, at, 1, value], self.closed(run) if run else None

    def closed(self, run):
        return tuple(run) if run[2] >= self.least else None


def absorbing_sessions(spans: DataFrame, gap: int, absorb: int, late: str = "1 day") -> DataFrame:
    """user_id, kind, start, end, items, interruptions of a stream of user_id, ts, kind, start, end (microseconds; ts is start)."""
    rows = spans.select("user_id", "ts", "kind", "start", "end").withWatermark("ts", late)
    out = "user_id long, kind string, start long, end long, items long, interruptions long"
    return rows.groupBy("user_id").transformWithStateInPandas(statefulProcessor=Absorbing(gap, absorb), outputStructType=out, outputMode="append", timeMode="eventTime")


def threshold_episodes(points: DataFrame, thresholds: DataFrame, gap: int, least: int = 2, late: str = "1 day") -> DataFrame:
    """event_type, user_id, start, end, n, most of the runs of a stream's points over the (static) threshold of their type."""
    over = points.join(F.broadcast(thresholds.select("event_type", "threshold")), "event_type").where("value > threshold")  # a row a type
    rows = over.withColumn("at", F.unix_micros("ts")).select("event_type", "user_id", "ts", "at", "value").withWatermark("ts", late)
    out = "event_type string, user_id long, start long, end long, n long, most double"
    return rows.groupBy("event_type", "user_id").transformWithStateInPandas(statefulProcessor=Episodes(gap, least), outputStructType=out, outputMode="append", timeMode="eventTime")


def late_rows(query) -> int:
    """How many rows of a query's batches came after the watermark and were dropped."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
