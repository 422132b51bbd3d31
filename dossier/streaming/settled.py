"""Limits and quotas of requests that arrive in any order, settled by event time.

Requests wait in their caller's state until all that may come before them is there: until the clock of arrivals has
passed the end of their minute by ``wait``. Then they are decided in order of (ts, event_id), as the batch operators
decide them. What arrives after that is not lost: it is counted in its own minute and hour, behind those settled, and
marked as late. The clock of arrivals is a watermark over ``arrived``; state is forgotten a day after its last hour.

State is kept by RocksDB: set spark.sql.streaming.stateStore.providerClass to STORE in the session of the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from dossier.operators.accounting import PER_HOUR, PER_MINUTE, QUOTA

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MINUTE, HOUR, KEEP, NEVER = 60_000, 3_600_000, 24 * 3_600_000, 1 << 62
_START = "timestamp_ntz'1970-01-01 00:00:00'"


def _micros(ts: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, {_START}, cast(`{ts}` as timestamp_ntz))")


class _Settling(StatefulProcessor):
    """Holds requests back until they are due. Subclasses decide them, in order.

    A caller's state is read and written once a batch, as packed numbers, and one timer, ``wake``, is set for what is due
    next: each call of a state goes to the JVM and back, and one a request would take longer than all else. ``kept`` are
    the numbers beside the waiting requests, named in ``more``.
    """

    more: list[str] = []

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("waiting", ", ".join(f"{c} binary" for c in ["places", *self.more]) + ", wake long")

    def due(self, at):
        return at // 1000 // MINUTE * MINUTE + MINUTE + self.wait_ms

    def decide_all(self, places: np.ndarray, late_at: int | None) -> dict:
        """The columns that are decided, for requests in order. Each is decided as of the clock at which it is due, or of ``late_at``."""
        rows = [self.decide(at, event_id, late_at or self.due(at)) for at, event_id in places.tolist()]
        return dict(zip(self.columns[3:-1], zip(*rows, strict=True), strict=True))

    def settle(self, key: tuple, places: np.ndarray, late_at: int | None = None) -> Iterator[pd.DataFrame]:
        if len(places):
            places = places[np.lexsort((places[:, 1], places[:, 0]))]
            fixed = {self.columns[0]: key[0], "event_id": places[:, 1], "at": places[:, 0]}
            yield pd.DataFrame(fixed | self.decide_all(places, late_at) | {"is_late": late_at is not None}, columns=self.columns)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """What is due comes before all that arrives from now on, also where a batch's rows are seen before its timers."""
        now = timerValues.getCurrentWatermarkInMs()
        places, wake = self.held()
        is_due = self.due(places[:, 0]) <= now
        yield from self.settle(key, places[is_due])
        new = self.requests(pd.concat(list(rows)))
        is_late = self.due(new[:, 0]) <= now
        yield from self.settle(key, new[is_late], now)
        self.hold(np.concatenate([places[~is_due], new[~is_late]]), wake)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        places, wake = self.held()
        is_due = self.due(places[:, 0]) <= now
        yield from self.settle(key, places[is_due])
        self.forget(now)
        self.hold(places[~is_due], wake if wake and wake > now else None)

    def held(self) -> tuple[np.ndarray, int | None]:
        *packed, wake = self.state.get() or (*[b""] * (1 + len(self.more)), None)
        places, *self.kept = (np.frombuffer(bytes(x), np.int64).reshape(-1, 2) for x in packed)
        return places, wake

    def hold(self, places: np.ndarray, wake: int | None) -> None:
        """Keep what waits, each request once, and see to it that a timer comes for the first that is to be done."""
        places = np.unique(places, axis=0)
        first = min([self.due(at) for at in places[:1, 0].tolist()] + self.ends(), default=None)
        if first is not None and (wake is None or first < wake):
            self.handle.registerTimer(first)
            wake = first
        if wake is not None:
            self.state.update((*(x.tobytes() for x in (places, *self.kept)), wake))
        else:
            self.state.clear()

    def requests(self, rows: pd.DataFrame) -> np.ndarray:
        return rows[["at", "event_id"]].to_numpy(np.int64)

    def ends(self) -> list[int]:
        """When the next of what is kept can be dropped."""
        return []

    def forget(self, now: int) -> None:
        """Drop what can no longer be asked for."""

    def close(self) -> None:
        pass


class _Limits(_Settling):
    """Keeps rows (start, n) of minutes and of hours, in order."""

    columns = ["caller", "event_id", "at", "minute_count", "hour_count", "allowed", "is_late"]
    more = ["minutes", "hours"]

    def __init__(self, wait_ms: int, per_minute: int, per_hour: int):
        super().__init__(wait_ms)
        self.limits = per_minute, per_hour

    def decide_all(self, places: np.ndarray, late_at: int | None) -> dict:
        counts, kept = [], self.kept
        for i, size in enumerate((MINUTE, HOUR)):
            start = places[:, 0] // 1000 // size * size  # in order, as the requests are
            one, first, n = np.unique(start, return_index=True, return_counts=True)
            before = np.zeros(len(one), np.int64)
            seen = np.isin(one, kept[i][:, 0])
            before[seen] = kept[i][np.searchsorted(kept[i][:, 0], one[seen]), 1]
            counts.append(np.arange(len(start)) + 1 + np.repeat(before - first, n))
            others = kept[i][~np.isin(kept[i][:, 0], one)]
            kept[i] = np.concatenate([others, np.stack([one, before + n], axis=1)])
            kept[i] = kept[i][np.argsort(kept[i][:, 0])]
        allowed = (counts[0] <= self.limits[0]) & (counts[1] <= self.limits[1])
        return {"minute_count": counts[0], "hour_count": counts[1], "allowed": allowed}

    def end(self, start):
        return start // HOUR * HOUR + HOUR + self.wait_ms + KEEP

    def ends(self) -> list[int]:
        return [self.end(start) for start in self.kept[1][:1, 0].tolist()]

    def forget(self, now: int) -> None:
        self.kept = [x[self.end(x[:, 0]) > now] for x in self.kept]


class _Quota(_Settling):
    """``used`` names the requests that consume, at most ``quota`` at any clock, and when each was given back; ``refunds``
    those told of requests that are not decided yet."""

    columns = ["visitor", "event_id", "at", "used", "reserved", "is_late"]

    def __init__(self, wait_ms: int, quota: int):
        super().__init__(wait_ms)
        self.quota = quota

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.used = handle.getMapState("used", "event_id long", "free_at long")
        self.refunds = handle.getMapState("refunds", "event_id long", "came long")

    def requests(self, rows: pd.DataFrame) -> np.ndarray:
        back = rows["is_refund"].fillna(False).astype(bool)
        for event_id, came in rows.loc[back, ["event_id", "came"]].sort_values("came", ascending=False).itertuples(index=False, name=None):
            known = self.used if self.used.containsKey((event_id,)) else self.refunds
            known.updateValue((event_id,), (came,))
            self.handle.registerTimer(came + self.wait_ms + KEEP)
        return super().requests(rows[~back])

    def decide(self, at: int, event_id: int, clock: int) -> tuple:
        used = sum(free_at > clock for _, (free_at,) in self.used.iterator())
        free_at = NEVER
        if self.refunds.containsKey((event_id,)):
            free_at = self.refunds.getValue((event_id,))[0]
            self.refunds.removeKey((event_id,))
        if used < self.quota and free_at > clock:
            self.used.updateValue((event_id,), (free_at,))
        return used, used < self.quota

    def forget(self, now: int) -> None:
        for state, keep in ((self.used, 0), (self.refunds, self.wait_ms + KEEP)):
            for (event_id,), (when,) in list(state.iterator()):
                if when + keep <= now:
                    state.removeKey((event_id,))


def _run(events: DataFrame, key: str, more: list[str], work: StatefulProcessor, shape: str) -> DataFrame:
    rows = events.select(key, "event_id", _micros("ts").alias("at"), F.timestamp_micros(_micros("arrived")).alias("arrived"), F.floor(_micros("arrived") / 1000).alias("came"), *more)
    timed = rows.where("at is not null and event_id is not null and arrived is not null").withWatermark("arrived", "0 seconds")
    out = timed.groupBy(key).transformWithStateInPandas(work, f"{key} string, event_id long, at long, {shape}, is_late boolean", "append", "EventTime")
    return out.withColumn("at", F.expr(f"timestampadd(MICROSECOND, at, {_START})")).withColumnRenamed("at", "ts")


def rate_limited(events: DataFrame, *, wait_seconds: int = 600, per_minute: int = PER_MINUTE, per_hour: int = PER_HOUR) -> DataFrame:
    """events: caller string, event_id long, ts, arrived. Rows (caller, event_id, ts, minute_count, hour_count, allowed,
    is_late). Those without an id or a time are left out; a request that is told twice while it waits counts once."""
    return _run(events, "caller", [], _Limits(wait_seconds * 1000, per_minute, per_hour), "minute_count long, hour_count long, allowed boolean")


def within_quota(events: DataFrame, *, wait_seconds: int = 600, quota: int = QUOTA) -> DataFrame:
    """events: visitor string, event_id long, ts, arrived, is_refund. Rows (visitor, event_id, ts, used, reserved, is_late)
    of requests. A refund has the event_id of its request and may come up to a day before it, while it waits, or at any time
    after. A request is decided as of the clock when it is due: refunds that came by then count, wherever batches end."""
    return _run(events, "visitor", ["is_refund"], _Quota(wait_seconds * 1000, quota), "used long, reserved boolean")
