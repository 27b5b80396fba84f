"""Lease spans on a stream: keyed state with timers.

The state of a key is its open span. A change extends or ends it; a timer at the end
of the lease ends it when no change came.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hostloom.operators.registry import EXPIRED, KEPT, MIN_TTL_S, REVOKED
from hostloom.sources.changes import DELETE, PUT

SPAN = "svc_key string, started_at timestamp, ended_at timestamp, ended_by string, puts bigint"
_OPEN_SPAN = "started_us bigint, until_us bigint, puts bigint, timer_ms bigint"
# executors get the processor itself, so they need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _moment(us: int | None) -> datetime | None:
    return None if us is None else _EPOCH + timedelta(microseconds=us)


class LeaseSpans(StatefulProcessor):
    """Changes of one key, in order of ``rev``, to the spans they end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.span = handle.getValueState("span", _OPEN_SPAN)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        stored = self.span.get()
        held, timer = (tuple(stored[:3]), stored[3]) if stored else (None, None)
        dated, undated = [], 0
        # events of other kinds only move time on; a filter would slip below the watermark and lose that
        for _, rev, op, _, at_us, ttl_us in rows:
            if op in (PUT, DELETE):
                leased = op == PUT and ttl_us is not None
                if at_us is None:
                    undated += leased
                else:
                    dated.append(((rev is None, rev or 0), op, at_us, ttl_us, leased))
        for _, op, at_us, ttl_us, leased in sorted(dated, key=lambda change: change[0]):
            if held and at_us > held[1]:
                yield self._ended(key, held, held[1], EXPIRED)
                held = None
            if leased:
                started, _, puts = held or (at_us, 0, 0)
                held = (started, at_us + ttl_us, puts + 1)
            elif held:
                yield self._ended(key, held, at_us, REVOKED if op == DELETE else KEPT)
                held = None
        if undated:
            yield self._ended(key, (None, None, undated), None, EXPIRED)
        self._store(held, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.span.get()
        if held and held[3] <= expiredTimerInfo.getExpiryTimeInMs():
            self.span.clear()
            yield self._ended(key, held, held[1], EXPIRED)

    def close(self) -> None:
        pass

    def _store(self, held: tuple | None, timer: int | None) -> None:
        # a change at the very end of a lease still counts, so the timer is behind it
        due = held and held[1] // 1000 + 1
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if held is None:
            if timer is not None:
                self.span.clear()
            return
        if timer != due:
            self.handle.registerTimer(due)
        self.span.update((*held, due))

    @staticmethod
    def _ended(key, held, until_us: int | None, by: str) -> Row:
        return Row(svc_key=key[0], started_at=_moment(held[0]), ended_at=_moment(until_us), ended_by=by, puts=held[2])


def lease_events(changes: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Spans of ``registry.lease_spans`` as they end, from a stream of changes.

    Changes of a key must come in order of ``rev`` from one batch to the next; within a
    batch they are sorted. ``delay`` is how late a change may be against the newest
    one. A lease that nobody renews ends when the stream's time, the greatest ``ts`` less
    ``delay``, is past it: changes of any key and of any kind move it on. Puts with a lease
    but without ``ts`` touch no other span; those of a key in one batch are a span without times.
    """
    ttl = F.greatest(F.col("ttl_s"), F.lit(MIN_TTL_S)) * 1_000_000
    rows = changes.select(
        "svc_key", "rev", "op", F.col("ts").cast("timestamp").alias("at"), F.unix_micros(F.col("ts").cast("timestamp")).alias(
            "at_us"), F.when(F.col("ttl_s").isNotNull(), ttl).alias("ttl_us"))
    rows = rows.withWatermark("at", delay)
    spans = rows.groupBy("svc_key").transformWithState(
        LeaseSpans(), SPAN, outputMode="Append", timeMode="EventTime")
    return spans.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "ended_at")})
