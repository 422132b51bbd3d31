"""Settling calls a caller's state a few times a batch, however many requests there are."""

import numpy as np
import pandas as pd

from dossier.streaming import settled


class Handle:
    """Counts what goes to the state."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, {}, set()

    def getValueState(self, name, schema):
        return State(self, name)

    getMapState = getValueState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class State:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def __getattr__(self, what):
        def call(*given):
            self.handle.calls += 1
            if what == "update":
                self.handle.value[self.name] = given[0]
            return self.handle.value.get(self.name) if what == "get" else self.handle.value.pop(self.name, None) if what == "clear" else iter(()) if what == "iterator" else False

        return call


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


def test_calls_do_not_grow_with_requests():
    rng = np.random.default_rng(1)
    for n in (10, 5000):
        handle = Handle()
        work = settled._Limits(600_000, 5, 30)
        work.init(handle)
        at = rng.integers(0, 3_600_000_000, n)
        rows = pd.DataFrame({"at": at, "event_id": np.arange(n)})
        assert not list(work.handleInputRows(("c",), iter([rows]), Clock(0)))
        assert len(handle.timers) == 1
        (found,) = work.handleExpiredTimer(("c",), Clock(3 * 3_600_000), None)
        want = rows.sort_values(["at", "event_id"])
        want["minute_count"] = want.groupby(want["at"] // 60_000_000).cumcount() + 1
        assert found[["event_id", "at", "minute_count"]].to_numpy().tolist() == want[["event_id", "at", "minute_count"]].to_numpy().tolist()
        assert found["hour_count"].tolist() == list(range(1, n + 1)) and handle.calls <= 8
