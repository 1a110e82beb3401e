"""Alert states of a stream of evaluations, kept by key with event-time timers.

A rule and instance hold their last fine evaluation, the first breach after it and the newest
evaluation. What becomes true without a further evaluation (a duration that has passed, a series
that has fallen silent) is a timer of the key, which the watermark sets off.

A call into the state and a frame for each alert cost far more than the alert itself, so alerts are kept
by shard (a hash of rule and instance): one state, one timer and one frame for all alerts of a shard.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from sensorspark.functions.columns import utc_instant, utc_wall
from sensorspark.streaming.days import read_days, start_day_sink

KEYS = ("rule", "instance")
_STATE = "last_ok long, since long, last_ts long, breach boolean, step long, shown string"
_OUT = "rule string, instance string, at_us long, step long, last_us long, since_us long, state string, changed boolean"
_COLUMNS = [c.split()[0] for c in _OUT.split(", ")]
_TYPES = [{"string": "object", "long": "Int64", "boolean": "bool"}[c.split()[1]] for c in _OUT.split(", ")]
_MS = 1000
#: Shards of a stream's alerts; a checkpoint belongs to their number.
SHARDS = 1024
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AlertStates(StatefulProcessor):
    """``rules``: name -> (look-back, duration, no-data policy), both times in microseconds."""

    def __init__(self, rules: dict[str, tuple[int, int, str]]):
        self.rules = rules

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("alert", _STATE)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """An expected series that nothing has been heard of: what it is shown as follows from its
        rule as soon as the stream has a time."""
        self.held.update((None, None, None, None, 0, None))
        self.handle.registerTimer(1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self.evaluated(key, ((part["us"].to_numpy(np.int64), part["breach"].to_numpy(bool)) for part in rows))

    def evaluated(self, key, blocks: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
        """``blocks``: times of evaluations, and which of them are breaches."""
        last_ok, since, last_ts, breach, step, shown = self.held.get() if self.held.exists() else (None, None, None, None, 0, None)
        # Breaches after the last fine evaluation known so far; the earliest counts in the end.
        open_ = [np.array([t for t in (since, last_ts if breach else None) if t is not None], dtype=np.int64)]
        for ts, bad in blocks:
            if not bad.all():
                last_ok = max(int(ts[~bad].max()), last_ok if last_ok is not None else -(1 << 62))
            newest = int(ts.max())
            if last_ts is None or newest >= last_ts:
                breach = bool(bad[ts == newest].any()) or (newest == last_ts and bool(breach))
                last_ts = newest
            open_.append(ts[bad])
            if last_ok is not None:
                open_ = [x[x > last_ok] for x in open_]
        later = np.concatenate(open_)
        since = int(later.min()) if len(later) else None
        yield from self._show(key, last_ts, (last_ok, since, last_ts, breach, step, shown), True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.expired(key, expiredTimerInfo.getExpiryTimeInMs())

    def expired(self, key, ms: int) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            yield from self._show(key, ms * _MS, self.held.get(), False)

    def name_at(self, rule: str, now: int, since: int | None, last_ts: int | None, breach: bool | None) -> str:
        """As ``state_now`` has it, for one alert at one time."""
        lookback, held_for, no_data = self.rules[rule]
        if last_ts is None or now - last_ts > lookback:
            if no_data != "Alerting":
                return "Normal" if no_data == "OK" else "NoData"
            return "Firing" if last_ts is None or now - last_ts >= held_for else "Pending"
        if not breach:
            return "Normal"
        return "Firing" if since is not None and now - since >= held_for else "Pending"

    def due(self, rule: str, now: int, since: int | None, last_ts: int | None, breach: bool | None) -> list[int]:
        """Times after ``now`` (in ms, rounded up) at which the alert may get another name by itself."""
        if last_ts is None:
            return []
        lookback, held_for, no_data = self.rules[rule]
        times = [last_ts + lookback + 1]
        if breach and since is not None:
            times.append(since + held_for)
        if no_data == "Alerting":
            times.append(max(last_ts + held_for, last_ts + lookback + 1))
        return sorted({-(-t // _MS) for t in times if t > now})

    def _show(self, key, now: int, state: tuple, evaluated: bool) -> Iterator[pd.DataFrame]:
        rule, instance = key
        last_ok, since, last_ts, breach, step, shown = state
        name = self.name_at(rule, now, since, last_ts, breach)
        changed = name != shown
        if evaluated:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            for t in self.due(rule, now, since, last_ts, breach):
                self.handle.registerTimer(t)
        if changed or evaluated:
            step += 1
            self.held.update((last_ok, since, last_ts, breach, step, name))
            yield self.made((rule, instance, now, step, last_ts, since if breach else None, name, changed))

    def made(self, row: tuple):
        """What a shown row comes out as."""
        return frame_of([row])


def frame_of(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.array(x, dtype=t) if t == "Int64" else np.array(x, dtype=t) for c, t, x in zip(_COLUMNS, _TYPES, zip(*rows))})


class Held:
    """State and timers of one alert, as a handle gives them, in its shard's memory."""

    def __init__(self, value: tuple | None = None, timers: tuple[int, ...] = ()):
        self.value, self.timers = value, list(timers)

    def getValueState(self, name, schema):
        return self

    def exists(self) -> bool:
        return self.value is not None

    def get(self) -> tuple | None:
        return self.value

    def update(self, value: tuple) -> None:
        self.value = value

    def listTimers(self) -> Iterator[int]:
        return iter(self.timers)

    def deleteTimer(self, t: int) -> None:
        self.timers.remove(t)

    def registerTimer(self, t: int) -> None:
        self.timers.append(t)


class _Rows(AlertStates):
    """One alert at a time, whose rows are gathered by the shard."""

    def at(self, held: Held) -> _Rows:
        self.handle = self.held = held
        return self

    def made(self, row: tuple) -> tuple:
        return row


def what_counts(ts: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The newest fine evaluation and the breaches from then on: what an alert takes from a block."""
    fine = ts[~bad]
    if not len(fine):
        return ts, bad
    later = ts[bad & (ts >= fine.max())]
    return np.append(later, fine.max()), np.append(np.ones(len(later), bool), False)


class AlertShards(StatefulProcessor):
    """``AlertStates`` of all alerts of a shard. The shard's one timer is the earliest of theirs."""

    def __init__(self, rules: dict[str, tuple[int, int, str]]):
        self.alerts = _Rows(rules)

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("shard", "alerts binary, timer long")

    def _load(self) -> tuple[dict[tuple[str, str], Held], int | None]:
        found = self.state.get()
        if found is None:
            return {}, None
        return {key: Held(value, timers) for key, value, timers in pickle.loads(bytes(found[0]))}, found[1]

    def _store(self, held: dict[tuple[str, str], Held], timer: int | None) -> None:
        first = min((t for h in held.values() for t in h.timers), default=None)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        self.state.update((pickle.dumps([(k, h.value, tuple(h.timers)) for k, h in held.items()]), first))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        held, timer = self._load()
        for rule, instance in zip(initialState["rule"], initialState["instance"]):
            held[rule, instance] = Held()
            self.alerts.at(held[rule, instance]).handleInitialState((rule, instance), None, timerValues)
        self._store(held, timer)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, timer = self._load()
        blocks: dict[tuple[str, str], list] = defaultdict(list)
        for part in rows:
            # A null instance is a key as well.
            of = part.groupby(list(KEYS), sort=False, dropna=False).ngroup().to_numpy()
            order = np.argsort(of, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(of[order]) != 0))
            us, bad = part["us"].to_numpy(np.int64)[order], part["breach"].to_numpy(bool)[order]
            names = (part[k].to_numpy(object)[order[starts]] for k in KEYS)
            for rule, instance, a, b in zip(*names, starts, np.append(starts[1:], len(order))):
                blocks[rule, None if pd.isna(instance) else instance].append(what_counts(us[a:b], bad[a:b]))
        out = []
        for alert, found in blocks.items():
            out += self.alerts.at(held.setdefault(alert, Held())).evaluated(alert, found)
        self._store(held, timer)
        yield frame_of(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, timer = self._load()
        now, out = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()), []
        for alert, h in held.items():
            for t in sorted(t for t in h.timers if t <= now):
                h.deleteTimer(t)
                out += self.alerts.at(h).expired(alert, t)
        # The timer that went off is taken away after this.
        self._store(held, None if timer == expiredTimerInfo.getExpiryTimeInMs() else timer)
        if out:
            yield frame_of(out)


def alert_changes(stream: DataFrame, rules: DataFrame, delay: str = "0 seconds", expected: DataFrame | None = None) -> DataFrame:
    """From evaluations (rule, instance, ts, breach) a stream of alert rows: ``rule, instance, at, step,
    last_ts, active_since, state, changed, alert_date``. A key's rows are numbered by ``step``; one
    comes for every batch that evaluates it, and one for every change that time alone brings
    (Pending to Firing, or silence) once the watermark, ``delay`` behind the newest evaluation, has
    passed it. ``expected`` (rule, instance) names series that may never report.

    Evaluations in a batch may come in any order; those older than the watermark are left out. A null
    breach is none; rules that are not in ``rules`` are left out, as are null times. Times are exact to
    the millisecond. The rules are collected: they are a configuration, not data."""
    known = {r["rule"]: (r["lookback_s"] * 1_000_000, r["for_s"] * 1_000_000, r["no_data"]) for r in rules.select("rule", "lookback_s", "for_s", "no_data").collect()}
    event = utc_instant(F.col("ts"))
    shard = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in KEYS]), F.lit(SHARDS)).cast("int").alias("shard")
    rows = stream.where(F.col("rule").isin(list(known)) & F.col("ts").isNotNull()).select(
        shard, *[F.col(k).cast("string").alias(k) for k in KEYS], F.coalesce("breach", F.lit(False)).alias("breach"), event.alias("event"), F.unix_micros(event).alias("us")
    )
    rows = rows.withWatermark("event", delay)
    first = None
    if expected is not None:
        first = expected.where(F.col("rule").isin(list(known))).select(shard, *[F.col(k).cast("string").alias(k) for k in KEYS]).distinct().groupBy("shard")
    out = rows.groupBy("shard").transformWithStateInPandas(
        AlertShards(known), _OUT, "Append", "EventTime", **({} if first is None else {"initialState": first})
    )
    at, last, since = (utc_wall(F.timestamp_micros(F.col(c))) for c in ("at_us", "last_us", "since_us"))
    return out.select(
        *KEYS, at.alias("at"), "step", last.alias("last_ts"), since.alias("active_since"), "state", "changed", at.cast("date").alias("alert_date")
    )


def str_alert_for(
    stream: DataFrame, rules: DataFrame, alerts: str, checkpoint: str, delay: str = "0 seconds", expected: DataFrame | None = None, available_now: bool = True
) -> StreamingQuery:
    """``alert_changes`` to a table by day; ``latest_alerts`` has the state of each alert. The keyed state
    lies in the checkpoint, in RocksDB: for each of ``SHARDS`` shards its alerts with at most three times each."""
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        # A query keeps the settings that it started with.
        return start_day_sink(alert_changes(stream, rules, delay, expected), alerts, checkpoint, "alert_date", "rule", available_now)
    finally:
        spark.conf.set(_PROVIDER, before)


def latest_alerts(spark: SparkSession, alerts: str) -> DataFrame:
    """``rule, instance, last_ts, active_since, state`` of every alert, from its newest row."""
    newest = F.max_by(F.struct("last_ts", "active_since", "state"), "step").alias("x")
    return read_days(spark, alerts).groupBy(*KEYS).agg(newest).select(*KEYS, "x.*")


def alert_spells(spark: SparkSession, alerts: str) -> DataFrame:
    """What happened when: every change of an alert's state, ``began`` and ``ended`` (null if it lasts)."""
    changes = read_days(spark, alerts).where("changed")
    following = F.lead("at").over(Window.partitionBy(*KEYS).orderBy("step"))
    return changes.select(*KEYS, "state", F.col("at").alias("began"), following.alias("ended"))
