"""Alerts of a shard against the same alerts one by one."""

from __future__ import annotations

import random
from types import SimpleNamespace

import pandas as pd
import pytest

from sensorspark.streaming.alerts import AlertShards, AlertStates, Held

RULES = {"r": (600_000_000, 300_000_000, "NoData"), "s": (120_000_000, 400_000_000, "Alerting")}


class Shard(Held):
    """A handle that counts how often it is asked."""

    def __init__(self):
        super().__init__()
        self.asked = 0

    def update(self, value):
        self.asked += 1
        super().update(value)

    def registerTimer(self, t):
        assert t not in self.timers
        self.asked += 1
        super().registerTimer(t)


def expired(ms):
    return SimpleNamespace(getExpiryTimeInMs=lambda: ms)


def shown(frames):
    return [tuple(None if pd.isna(v) else v for v in row) for f in frames for row in f.itertuples(index=False)]


@pytest.mark.parametrize("seed", range(6))
def test_a_shard_is_its_alerts(seed):
    rng = random.Random(seed)
    names = [(r, i) for r in RULES for i in ("a", "b", None, "d")]
    one, shard = {k: Held() for k in names}, Shard()
    whole = AlertShards(RULES)
    whole.init(shard)
    single = AlertStates(RULES)
    mark = 0
    for _ in range(6):
        rows = [(*rng.choice(names), mark * 1000 + rng.randrange(1200) * 1_000_000, rng.random() < 0.6) for _ in range(rng.randrange(1, 30))]
        parts = [pd.DataFrame(rows[i : i + 7], columns=["rule", "instance", "us", "breach"]) for i in range(0, len(rows), 7)]
        asked, frames = shard.asked, list(whole.handleInputRows(3, iter(parts), None))
        assert len(frames) == 1 and shard.asked - asked <= 2 and len(shard.timers) <= 1
        want = []
        for key, held in one.items():
            mine = [pd.DataFrame([(u, b) for *k, u, b in rows if tuple(k) == key], columns=["us", "breach"])]
            if len(mine[0]):
                single.handle = single.held = held
                want += shown(single.handleInputRows(key, iter(mine), None))
        assert sorted(shown(frames), key=str) == sorted(want, key=str)
        mark = max(mark, max(r[2] for r in rows) // 1000)
        clock, frames, want = SimpleNamespace(getCurrentWatermarkInMs=lambda: mark), [], []
        while shard.timers and shard.timers[0] <= mark:
            t = shard.timers[0]
            frames += whole.handleExpiredTimer(3, clock, expired(t))
            shard.timers.remove(t)
        for key, held in one.items():
            single.handle = single.held = held
            for t in sorted(t for t in held.timers if t <= mark):
                want += shown(single.handleExpiredTimer(key, None, expired(t)))
                held.timers.remove(t)
        assert len(frames) <= 1 and sorted(shown(frames), key=str) == sorted(want, key=str)
    first = [t for h in one.values() for t in h.timers]
    assert shard.timers == ([min(first)] if first else [])
