import json
import random
from types import SimpleNamespace

import pandas as pd
import pytest

from tapewright.streaming import streams

H = 3600 * 1_000_000


class Value:
    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value


class Values(dict):
    def updateValue(self, k, v):
        self[k] = v

    def getValue(self, k):
        return self[k]

    def removeKey(self, k):
        del self[k]


class Handle:
    """What an engine keeps for one key."""

    def __init__(self):
        self.value, self.values, self.timers = Value(), Values(), []

    def getValueState(self, *_):
        return self.value

    def getMapState(self, *_):
        return self.values

    def registerTimer(self, ms):
        self.timers.append(ms)


def plain(times, end):
    out = []
    for t, after in zip(times, [*times[1:], end]):
        if not out or out[-1][1] != "ok":
            out.append((t, "ok"))
        out += [(t + w, name) for name, w in (("lagging", 2 * H), ("stale", 5 * H)) if after - t > w]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_neighbours_are_one_key(seed):
    """200 sources, events of all in every batch and out of order within two: state is read and written once a batch, one timer waits."""
    rng = random.Random(seed)
    sources = [None] if seed == 3 else range(200)
    rows = {s: sorted(rng.sample(range(0, 200 * H, H // 4), 30)) for s in sources}
    every = sorted((t, s, n + 1) for s, ts in rows.items() for n, t in enumerate(ts))
    dealt = [[] for _ in range(12)]
    for i, (t, s, n) in enumerate(every):
        dealt[min(10, i * 11 // len(every) + rng.randrange(2))].append({"together": 0, "source": s, "nth": n, "arrival": t, "ts_us": t})
    handle, p = Handle(), streams._Heartbeat(2 * H, 5 * H)
    p.bound_us = 300 * H
    p.init(handle)
    got, now = [], 0
    for batch in dealt:
        rng.shuffle(batch)
        at = SimpleNamespace(getCurrentWatermarkInMs=lambda: now // 1000)
        if batch:
            calls, timers = handle.value.calls, len(handle.timers)
            got += [tuple(r) for d in p.handleInputRows((0,), iter([pd.DataFrame(batch)]), at) for r in d.itertuples(index=False)]
            assert handle.value.calls - calls == 2 and len(handle.timers) - timers <= 1
            now = max(now, max(r["ts_us"] for r in batch) - 60 * H)
    end = 400 * H
    now = end
    while due := [t for t in handle.timers if t * 1000 <= end]:
        handle.timers = [t for t in handle.timers if t not in due]
        got += [tuple(r) for _ in due for d in p.handleExpiredTimer((0,), at, None) for r in d.itertuples(index=False)]
    for s in sources:
        assert [(t, h) for k, t, h in got if k == s or (k is None) == (s is None) == True] == plain(rows[s], end)  # noqa: E712
    assert not handle.values and len(json.loads(handle.value.value[1])) == len(rows)
