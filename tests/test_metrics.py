from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sensorspark.operators.metrics import (
    ALERT_RULES,
    alert_history,
    alert_rules,
    breach,
    mon_and_match,
    mon_error_ratio,
    mon_for_duration,
    mon_gauges_from_audit,
    mon_histogram_quantile,
    mon_rate_increase,
    mon_reduce_last,
    mon_success_rate,
    mon_threshold,
)

SAMPLES = "metric string, instance string, ts timestamp_ntz, value double"


def test_counter_resets(frame):
    t = "2024-01-01 00:0{}:00"
    rows = [("m", "i", t.format(m), v) for m, v in ((0, 10.0), (1, 15.0), (2, 3.0), (3, 4.0))]
    rows += [("m", "i", t.format(3), 4.0), ("m", "j", t.format(0), 5.0), ("m", "i", t.format(6), 100.0)]
    df = frame(rows, SAMPLES)
    got = mon_rate_increase(df, "5 minutes", "increase").collect()
    # 10 -> 15 adds 5, the reset to 3 adds 3, 3 -> 4 adds 1; single samples say nothing.
    assert [(r.instance, r.increase) for r in got] == [("i", 9.0)]
    assert mon_rate_increase(df, "5 minutes", "rate").first().rate == 9.0 / 300


def test_sliding_windows_cover_every_step(frame):
    rows = [("m", "i", f"2024-01-01 00:{m:02d}:30", float(m)) for m in range(20)]
    got = mon_rate_increase(frame(rows, SAMPLES), "5 minutes", "increase", slide="1 minute").collect()
    assert sorted(r.increase for r in got)[-1] == 4.0 and len(got) == 22


def buckets(frame, rows):
    return frame(rows, "endpoint string, le double, le_count int")


def test_histogram_quantiles(frame):
    inf = float("inf")
    rows = [("a", 0.1, 5), ("a", 0.5, 9), ("a", 1.0, 10), ("a", inf, 10)]
    rows += [("b", 0.1, 0), ("b", 1.0, 0), ("b", inf, 4), ("c", 0.1, 0), ("c", inf, 0)]
    got = {r.endpoint: r for r in mon_histogram_quantile(buckets(frame, rows), by=["endpoint"]).collect()}
    assert math.isclose(got["a"].p50, 0.1) and math.isclose(got["a"].p95, 0.75)
    assert got["b"].p50 == 1.0  # in the open bucket: its lower bound
    assert got["c"].p50 is None and got["c"].requests == 0


def test_empty_buckets_are_skipped(frame):
    rows = [("a", 0.1, 2), ("a", 0.5, 2), ("a", 1.0, 4), ("a", float("inf"), 4)]
    r = mon_histogram_quantile(buckets(frame, rows), q=(0.5, 0.75), by=["endpoint"]).first()
    assert r.p50 == 0.1 and r.p75 == 0.75


def test_error_ratio_and_success(frame):
    log = frame([("2024-01-01 00:00:00", s) for s in (200, 500, 503, 422)], "ts timestamp_ntz, status_code int")
    assert mon_error_ratio(log).first().error_pct == 50.0
    runs = frame([("p", "success"), ("p", "failed"), ("p", "running"), ("p", "success")], "pipeline_id string, state string")
    assert mon_success_rate(runs).first().success_pct == 50.0


def test_thresholds_on_their_bounds(frame):
    rows = [("lt", 0.65, None, v) for v in (0.64, 0.65)] + [("gt", 70.0, None, v) for v in (70.0, 70.1)]
    rows += [("eq", 0.0, None, v) for v in (0.0, 0.1)] + [("within_range", 0.65, 0.7, v) for v in (0.65, 0.66, 0.7)]
    df = frame(rows, "evaluator string, low double, high double, value double")
    got = [r.b for r in df.withColumn("b", breach(F.col("value"))).collect()]
    assert got == [True, False, False, True, True, False, False, True, False]


def test_rules(spark, frame):
    assert alert_rules(spark).count() == len(ALERT_RULES) == 9
    last = frame([("model_r2_champion_current", "i", "2024-01-01 00:00:00", 0.6)], SAMPLES)
    got = {r.rule: r.breach for r in mon_threshold(last, alert_rules(spark)).collect()}
    assert got == {"model_performance_critical": True, "model_performance_warning": False}


def test_last_value_in_range(frame):
    rows = [("m", "i", "2024-01-01 00:00:00", 1.0), ("m", "i", "2024-01-01 00:09:00", 2.0), ("m", "i", "2024-01-01 00:11:00", 3.0), ("m", "old", "2023-12-31 23:59:00", 9.0)]
    got = mon_reduce_last(frame(rows, SAMPLES), "2024-01-01 00:10:00").collect()
    assert [(r.instance, r.value) for r in got] == [("i", 2.0)]


def test_and(frame):
    a = frame([("i", 0.6), ("j", 0.6), ("k", 0.4)], "instance string, value double")
    b = frame([("i", 0.6), ("j", 0.8), ("k", 0.6)], "instance string, value double")
    got = mon_and_match(a, b, ["instance"], F.col("value") > 0.5, F.col("value") < 0.7)
    assert [r.instance for r in got.collect()] == ["i"]


STATES = "rule string, instance string, ts timestamp_ntz, breach boolean"


def states(frame, rule, flags, start="2024-01-01 23:50:00", step=60):
    t0 = pd.Timestamp(start)
    return frame([(rule, "i", str(t0 + pd.Timedelta(seconds=step * i)), f) for i, f in enumerate(flags)], STATES)


def test_condition_must_hold(spark, frame):
    rules = alert_rules(spark)
    # For 300 seconds; the run starts at 23:52 and goes past midnight.
    flags = [True, False] + [True] * 12 + [False, True]
    df = states(frame, "model_rmse_high", flags)
    got = alert_history(df, rules).orderBy("ts").collect()
    assert [r.state for r in got] == ["Pending", "Normal"] + ["Pending"] * 5 + ["Firing"] * 7 + ["Normal", "Pending"]
    assert str(got[13].active_since) == "2024-01-01 23:52:00" and str(got[-1].active_since) == "2024-01-02 00:05:00"
    for now, want in (("2024-01-01 23:56:59", "Pending"), ("2024-01-01 23:57:00", "Firing"), ("2024-01-02 00:04:00", "Normal")):
        assert mon_for_duration(df, rules, now).first().state == want


def test_history_agrees_with_the_state_now(spark, frame):
    rng = np.random.default_rng(5)
    flags = [bool(x) for x in rng.random(300) < 0.8]
    rules = alert_rules(spark)
    df = states(frame, "model_rmse_high", flags, step=3600)
    history = {str(r.ts): (r.state, str(r.active_since)) for r in alert_history(df, rules).collect()}
    since = None
    for i, f in enumerate(flags):
        t = pd.Timestamp("2024-01-01 23:50:00") + pd.Timedelta(hours=i)
        since = (since if since is not None else t) if f else None
        want = "Normal" if not f else ("Firing" if (t - since).total_seconds() >= 300 else "Pending")
        assert history[str(t)] == (want, str(since))
    for i in (0, 50, 299):
        t = str(pd.Timestamp("2024-01-01 23:50:00") + pd.Timedelta(hours=i))
        r = mon_for_duration(df, rules, t).first()
        assert (r.state, str(r.active_since)) == history[t]


def test_no_data_policies(spark, frame):
    rules = alert_rules(spark)
    rows = [(r, "i", "2024-01-01 00:00:00", True) for r in ("service_down", "api_error_rate_high", "model_rmse_high")]
    got = {r.rule: r.state for r in mon_for_duration(frame(rows, STATES), rules, "2024-01-01 01:00:00").collect()}
    assert got == {"service_down": "Firing", "api_error_rate_high": "Normal", "model_rmse_high": "NoData"}


def test_gauges(frame):
    audit = frame([("2024-01-01 00:00:00", 0.8, None, True)], "timestamp timestamp_ntz, r2 double, r2_baseline double, drift_detected boolean")
    got = {r.metric: r.value for r in mon_gauges_from_audit(audit).collect()}
    assert got == {"model_r2_champion_current": 0.8, "drift_detected": 1.0}
