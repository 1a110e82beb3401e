"""Streams against their batch forms: copies, late rows, restarts, repeated batches."""

from __future__ import annotations

import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorspark.operators.metrics import alert_rules, mon_for_duration
from sensorspark.session import scratch_path, shared_folder, via_table
from sensorspark.streaming.alerts import AlertStates, alert_spells, latest_alerts, str_alert_for
from sensorspark.streaming.days import MOST_FOLDERS, Folder, compact, folders, read_days
from sensorspark.streaming.flows import (
    str_dedup,
    str_incremental_ingest,
    str_late_quarantine,
    str_tumbling_rollup,
)

READ = "sensor_id string, reading_ts timestamp_ntz, count double"


@pytest.fixture
def inbox(spark, frame, tmp_path):
    """A folder rows arrive in, and a stream over it."""
    folder = str(tmp_path / "inbox")

    def arrive(rows, schema=READ):
        df = frame(rows, schema)
        df.write.mode("append").parquet(folder)
        return spark.readStream.schema(df.schema).parquet(folder)

    return arrive


def test_ingest_resumes(spark, inbox, tmp_path):
    target, checkpoint = str(tmp_path / "t"), str(tmp_path / "c")
    stream = inbox([("a", "2024-01-01 10:00:00", 1.0), ("b", "2024-01-02 10:00:00", 1.0)])
    for _ in range(2):  # nothing new the second time
        str_incremental_ingest(stream, target, checkpoint).awaitTermination()
        assert read_days(spark, target).count() == 2
    # A row older than all others is taken in as well.
    str_incremental_ingest(inbox([("a", "2023-12-31 10:00:00", 1.0)]), target, checkpoint).awaitTermination()
    stored = spark.read.parquet(target)
    assert stored.count() == 3 and stored.select("reading_date").distinct().count() == 3


def test_copies_across_restarts(spark, inbox, tmp_path):
    out, checkpoint = str(tmp_path / "o"), str(tmp_path / "c")

    def run(stream):
        q = str_dedup(stream, "2 hours").writeStream.format("parquet").option("path", out)
        q.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out).count()

    assert run(inbox([("a", "2024-01-01 10:00:00", 1.0)] * 3)) == 1
    assert run(inbox([("a", "2024-01-01 10:00:00", 1.0), ("a", "2024-01-01 11:00:00", 1.0)])) == 2


def forget_commit(checkpoint):
    """As if the run had ended before it noted its newest batch as done."""
    commits = os.path.join(checkpoint, "commits")
    newest = max((f for f in os.listdir(commits) if f.isdigit()), key=int)
    for name in (newest, f".{newest}.crc"):
        if os.path.exists(os.path.join(commits, name)):
            os.remove(os.path.join(commits, name))


def test_late_rows_are_kept_aside(spark, inbox, tmp_path):
    target, late, marks, checkpoint = (str(tmp_path / n) for n in "tlmc")
    schema = inbox([]).schema.add("reading_date", "date")

    def run(rows):
        str_late_quarantine(inbox(rows), target, late, marks, checkpoint).awaitTermination()
        return read_days(spark, target, schema).count(), read_days(spark, late, schema).count()

    assert run([("a", "2024-01-01 10:00:00", 1.0), ("a", "2024-01-01 01:00:00", 1.0), ("a", None, 1.0)]) == (3, 0)
    assert run([("b", "2024-01-01 08:00:00", 1.0), ("b", "2024-01-01 07:59:59", 1.0), ("b", "2024-01-02 12:00:00", 1.0)]) == (5, 1)
    assert run([("c", "2024-01-02 09:59:00", 1.0)]) == (5, 2)
    # A repeated batch splits as it did and replaces what it wrote; the marks stay two.
    forget_commit(checkpoint)
    assert run([]) == (5, 2) and len(os.listdir(marks)) == 2
    assert run([("d", "2024-01-02 10:00:00", 1.0), ("d", "2024-01-02 09:59:59", 1.0)]) == (6, 3) and len(os.listdir(marks)) == 2
    assert {d for d in os.listdir(target) if "=" in d} == {"reading_date=2024-01-01", "reading_date=2024-01-02", "reading_date=__HIVE_DEFAULT_PARTITION__"}


def test_few_folders_a_day_after_many_batches(spark, inbox, tmp_path):
    target, checkpoint = str(tmp_path / "t"), str(tmp_path / "c")
    for i in range(14):
        rows = [("a", f"2024-01-01 {i:02}:00:00", float(i)), ("b", f"2024-01-0{1 + i % 3} 23:00:00", float(i))]
        str_incremental_ingest(inbox(rows), target, checkpoint).awaitTermination()
        assert len(folders(spark, target, "reading_date=2024-01-01")) <= MOST_FOLDERS + 1
    held = folders(spark, target, "reading_date=2024-01-01")
    assert any(f.last - f.first > 3 for f in held)
    got = read_days(spark, target)
    assert got.columns == ["sensor_id", "reading_ts", "count", "reading_date"]
    assert got.count() == 28 and got.where("sensor_id = 'a'").select("reading_ts").distinct().count() == 14
    # The newest batch again.
    forget_commit(checkpoint)
    str_incremental_ingest(inbox([]), target, checkpoint).awaitTermination()
    assert read_days(spark, target).count() == 28


def test_replaced_folders_do_not_count(spark, frame, tmp_path):
    """A run that ends between a merge and its clean-up leaves both; readers and the next run see one."""
    root, day = str(tmp_path / "t"), "reading_date=2024-01-01"
    rows = frame([("a", "2024-01-01 10:00:00", 1.0)], READ)
    for first, last, n in ((0, 0, 1), (1, 1, 2), (0, 1, 3), (2, 2, 1)):
        for _ in range(n):
            rows.write.mode("append").parquet(Folder(day, first, last).path(root))
    assert read_days(spark, root).count() == 4
    assert compact(spark, root, 3, "reading_date", "sensor_id", rows.schema) == 0
    assert [(f.first, f.last) for f in folders(spark, root, day)] == [(0, 1), (2, 2)] and read_days(spark, root).count() == 4
    assert compact(spark, root, 3, "reading_date", "sensor_id", rows.schema, most=1) == 1
    assert [(f.first, f.last) for f in folders(spark, root, day)] == [(0, 2)] and read_days(spark, root).count() == 4
    none = read_days(spark, str(tmp_path / "none"), rows.schema)
    assert none.count() == 0 and none.columns == rows.columns


STATES = "rule string, instance string, ts timestamp_ntz, breach boolean"


def evaluations(flags, start="2024-01-01 00:00:00"):
    t0 = pd.Timestamp(start)
    return [("model_rmse_high", "i", str(t0 + pd.Timedelta(minutes=i)), f) for i, f in enumerate(flags)]


def states_of(df):
    return {(r["rule"], r["instance"]): (r["last_ts"], r["active_since"], r["state"]) for r in df.collect()}


def test_alerts_equal_batch(spark, frame, inbox, tmp_path):
    alerts, checkpoint = str(tmp_path / "a"), str(tmp_path / "c")
    rules = alert_rules(spark)
    flags = [False, True, True, True, True, True, True, False, True, True]
    rows = evaluations(flags)
    seen = []
    for part, want in ((rows[:3], "Pending"), (rows[3:7], "Firing"), (rows[7:8], "Normal"), (rows[8:], "Pending")):
        seen += part
        str_alert_for(inbox(part, STATES), rules, alerts, checkpoint).awaitTermination()
        got = states_of(latest_alerts(spark, alerts))
        assert got == states_of(mon_for_duration(frame(seen, STATES), rules, seen[-1][2]))
        assert got["model_rmse_high", "i"][2] == want
    spells = [(r.state, str(r.began)[11:16], r.ended and str(r.ended)[11:16]) for r in alert_spells(spark, alerts).orderBy("began").collect()]
    assert spells == [("Pending", "00:02", "00:06"), ("Firing", "00:06", "00:07"), ("Normal", "00:07", "00:09"), ("Pending", "00:09", None)]


def test_time_alone_changes_alerts(spark, frame, inbox, tmp_path):
    """Other series move the watermark: a breach that holds fires, silent series take their rule's policy,
    both at the exact time, and series that never report are shown from the start."""
    alerts, checkpoint = str(tmp_path / "a"), str(tmp_path / "c")
    rules = alert_rules(spark)
    expected = frame([("service_down", "gone"), ("model_rmse_high", "never"), ("api_error_rate_high", "quiet"), ("no such rule", "x")], "rule string, instance string")
    every = [(r, "i", "2024-01-01 00:00:00", True) for r in ("model_rmse_high", "service_down", "api_error_rate_high", "high_drift_detected")]
    every += [("model_rmse_high", "fine", "2024-01-01 00:00:00", False), ("unknown", "i", "2024-01-01 00:00:00", True), ("service_down", "i", None, True)]
    seen = []
    clock = ["00:00:00", "00:00:59", "00:01:00", "00:02:00", "00:02:00.001", "00:05:00", "00:10:00", "00:10:00.001", "00:15:00", "01:00:00"]
    for k, t in enumerate(clock):
        part = (every if k == 0 else []) + [("run_too_slow", "clock", f"2024-01-01 {t}", False)]
        seen += part
        str_alert_for(inbox(part, STATES), rules, alerts, checkpoint, expected=expected).awaitTermination()
        want = mon_for_duration(frame(seen, STATES).where("ts IS NOT NULL"), rules, f"2024-01-01 {t}", expected=expected)
        assert states_of(latest_alerts(spark, alerts)) == states_of(want), t
    fired = alert_spells(spark, alerts).where("rule = 'model_rmse_high' AND instance = 'i'").orderBy("began").collect()
    assert [(r.state, str(r.began)[11:23]) for r in fired] == [("Pending", "00:00:00"), ("Firing", "00:05:00"), ("NoData", "00:10:00.001")]


class Handle:
    """What a processor asks of its handle, for one key."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)


@pytest.mark.parametrize("seed", range(8))
def test_state_does_not_depend_on_order_within_a_batch(seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(20) * 60_000_000, rng.random() < 0.7) for _ in range(12)]
    results = set()
    for _ in range(6):
        rng.shuffle(rows)
        handle = Handle()
        states = AlertStates({"r": (600_000_000, 300_000_000, "NoData")})
        states.init(handle)
        parts = [pd.DataFrame(rows[i : i + 5], columns=["us", "breach"]) for i in range(0, 12, 5)]
        out = pd.concat(states.handleInputRows(("r", "i"), iter(parts), None))
        assert len(out) == 1 and len(handle.timers) <= 3
        results.add((handle.value, tuple(sorted(handle.timers)), tuple(map(str, out.iloc[0]))))
    assert len(results) == 1
    fine = [t for t, b in rows if not b]
    after = [t for t, b in rows if b and t > max(fine, default=-1)]
    assert handle.value[0] == max(fine, default=None) and handle.value[1] == min(after, default=None) and handle.value[2] == max(t for t, _ in rows)


def test_written_tables_cut_lineage(spark, frame):
    df = frame([("a", "2024-01-01 00:00:00", 1.0)], READ).where(F.col("count") > 0)
    back = via_table(df, "test")
    assert back.collect() == df.collect()
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert shared_folder(spark).split(":")[-1] in plan and "ExistingRDD" not in plan
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


@pytest.mark.parametrize("zone", ["UTC", "Europe/Paris", "America/New_York"])
def test_streams_in_any_session_zone(spark, inbox, tmp_path, zone):
    """Hours around both clock changes stay apart."""
    hours = ["2024-03-31 00:10:00", "2024-03-31 01:10:00", "2024-03-31 02:10:00", "2024-10-27 00:10:00", "2024-10-27 01:10:00", "2024-10-27 02:10:00", "2024-11-03 05:10:00", "2024-11-03 06:10:00"]
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)

    def run(name, form, rows, schema=READ):
        q = form(inbox(rows, schema)).writeStream.format("parquet").option("path", str(tmp_path / name)).outputMode("append")
        q.option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / name))

    try:
        rows = [("a", h, 1.0) for h in hours] + [("a", "2024-12-01 00:00:00", 1.0)]
        rolled = run("roll", str_tumbling_rollup, rows)
        assert sorted(str(r[0]) for r in rolled.select(F.col("hour_start").cast("string")).collect()) == [h[:13] + ":00:00" for h in hours]
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


@pytest.mark.parametrize("zone", ["UTC", "Europe/Paris", "America/New_York"])
def test_dedup_in_any_session_zone(spark, inbox, tmp_path, zone):
    hours = ["2024-03-31 01:10:00", "2024-03-31 02:10:00", "2024-10-27 00:10:00", "2024-10-27 01:10:00"]
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        q = str_dedup(inbox([("a", h, 1.0) for h in hours] * 2)).writeStream.format("parquet").option("path", str(tmp_path / "o"))
        q.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        got = spark.read.parquet(str(tmp_path / "o")).select(F.col("reading_ts").cast("string")).collect()
        assert sorted(r[0] for r in got) == hours
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
