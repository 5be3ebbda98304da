"""Keyed state of document events: put-off runs by timers, and a filter that passes changes only.

Both run in ``transformWithState``, so what is known of a key lives in the state store and survives restarts by the query's
checkpoint. The state of a key is bounded by its open bursts or one digest, never by its events.
"""

from __future__ import annotations

import datetime as dt
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Gaps of the quick check of one file and of the run over its project, in milliseconds.
FAST, SLOW = 100, 1000
_STORE = "spark.sql.streaming.stateStore.providerClass"
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def with_timers(spark: SparkSession) -> None:
    """Chooses the state store that keyed state with timers needs; other queries can use it as well."""
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def merged_in(bursts: list[list[int]], at: int, gap: int) -> None:
    """Adds an event to disjoint bursts [first, last, n] in order of time: it joins those no farther than ``gap``."""
    k = bisect_left(bursts, at, key=lambda b: b[1] + gap)
    if k == len(bursts) or bursts[k][0] - gap > at:
        bursts.insert(k, [at, at, 1])
        return
    mine = bursts[k]
    mine[:] = [min(mine[0], at), max(mine[1], at), mine[2] + 1]
    if k + 1 < len(bursts) and bursts[k + 1][0] - gap <= mine[1]:
        after = bursts.pop(k + 1)
        mine[:] = [mine[0], max(mine[1], after[1]), mine[2] + after[2]]


class _Bursts(StatefulProcessor):
    """Emits a key's burst once no event of it can follow: ``clock`` is processing time, or the watermark for replays."""

    def __init__(self, event_time: bool):
        self.event_time = event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "gap bigint, first array<bigint>, last array<bigint>, n array<bigint>, timer bigint")

    def _held(self) -> tuple[int, list[list[int]], int]:
        if not self.open.exists():
            return 0, [], 0
        gap, first, last, n, timer = self.open.get()
        return gap, [list(x) for x in zip(first, last, n, strict=True)], timer

    def _hold(self, gap: int, bursts: list[list[int]], timer: int) -> None:
        if bursts:
            self.open.update((gap, [b[0] for b in bursts], [b[1] for b in bursts], [b[2] for b in bursts], timer))
        else:
            self.open.clear()

    def _set(self, old: int, new: int) -> int:
        if old != new:
            if old:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(new)
        return new

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        gap, bursts, timer = self._held()
        for r in rows:
            gap = r.gap
            if self.event_time or not bursts:
                merged_in(bursts, r.at, gap)
            else:  # one burst as long as events keep coming
                bursts[0][:] = [min(bursts[0][0], r.at), max(bursts[0][1], r.at), bursts[0][2] + 1]
        due = bursts[0][1] // 1000 + gap // 1000 + 1 if self.event_time else timerValues.getCurrentProcessingTimeInMs() + gap // 1000
        self._hold(gap, bursts, self._set(timer, due))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        gap, bursts, timer = self._held()
        now = timerValues.getCurrentWatermarkInMs() if self.event_time else 0  # all that are due: a timer set for the past may never fire
        done = [b for b in bursts if b[1] // 1000 + gap // 1000 + 1 <= now] if self.event_time else bursts
        left = bursts[len(done) :]
        if left:
            timer = left[0][1] // 1000 + gap // 1000 + 1
            self.handle.registerTimer(timer)
        self._hold(gap, left, timer)
        for first, last, n in done:
            yield Row(tier=key[0], key=key[1], start=_EPOCH + dt.timedelta(microseconds=first), last=_EPOCH + dt.timedelta(microseconds=last), n=n)

    def close(self) -> None:
        pass


def put_off(events: DataFrame, file: str, project: str, ts: str, fast: int = FAST, slow: int = SLOW, late: str | None = None) -> DataFrame:
    """(tier, key, start, last, n): one row for each burst of events of a file (tier 1) and of a project (tier 2), gaps in ms.

    Without ``late`` a burst ends when its gap has passed by the clock without another event, each event starting the gap
    anew, and is emitted then. With ``late``, a watermark such as ``"10 seconds"``, bursts go by ``ts`` as in
    ``relational.two_tier``: they are emitted when the watermark has passed them, whatever the order of events. Rows without
    key or time are left out. A project may hold most events: its state is its open bursts.
    """
    with_timers(events.sparkSession)
    rows = events.where(F.col(ts).isNotNull())
    if late is not None:
        rows = rows.withWatermark(ts, late)
    tier = lambda k, key, gap: F.struct(F.lit(k).alias("tier"), F.col(key).cast("string").alias("key"), F.lit(gap * 1000).cast("bigint").alias("gap"))
    rows = rows.select(ts, F.explode(F.array(tier(1, file, fast), tier(2, project, slow))).alias("t")).where("t.key is not null")
    rows = rows.select("t.*", F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), *([ts] if late is not None else []))
    mode = "ProcessingTime" if late is None else "EventTime"
    return rows.groupBy("tier", "key").transformWithState(_Bursts(late is not None), "tier int, key string, start timestamp, last timestamp, n bigint", "Append", mode)


class _Changes(StatefulProcessor):
    """Passes events whose digest is not the known one, with the number of the path's version."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "digest string, version bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        digest, version = self.known.get() if self.known.exists() else (None, 0)
        before = version
        for r in sorted(rows, key=lambda r: (r.ts, r.op, r.content or "")):  # a path's events of one batch
            now = None if r.op == "unlink" else r.md5
            if now != digest:
                digest, version = now, version + 1
                yield Row(path=key[0], ts=r.ts, op=r.op, md5=now, version=version, content=None if now is None else r.content)
        if version != before:
            self.known.update((digest, version))

    def close(self) -> None:
        pass


def changes_only(events: DataFrame) -> DataFrame:
    """(path, ts, op, md5, version, content): the events (ts, path, op, content) that change what is known of their path.

    New or other content passes, a change back passes, a repeated one does not, an unlink passes if the path is known. Of
    equal times the larger operation name, then content, comes last. A null content counts as empty; rows without path or
    time are left out. What is known of a path is one digest and a number in the state store, so no batch reads older ones.
    """
    with_timers(events.sparkSession)
    rows = events.where("path is not null and ts is not null").select("path", "ts", "op", "content", F.md5(F.coalesce("content", F.lit("")).cast("binary")).alias("md5"))
    return rows.groupBy("path").transformWithState(_Changes(), "path string, ts timestamp, op string, md5 string, version bigint, content string", "Append", "None")
