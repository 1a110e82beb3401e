from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sensorspark.functions import ordering
from sensorspark.operators.metrics import mon_up
from sensorspark.operators.ranking import win_last_n_sorted
from sensorspark.sources.tables import src_first_n


@pytest.mark.parametrize("n", [0, 1, 777, 5000, 9000])
def test_first_rows_without_a_gathering_task(spark, monkeypatch, n):
    ts = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'") + F.make_dt_interval(mins=(F.col("id") * 7919 % 5000 / 3).cast("int"))
    df = spark.range(5000).select((F.col("id") % 9).alias("sensor_id"), ts.alias("reading_ts"), F.col("id").alias("count")).repartition(6)
    order = ["reading_ts", "sensor_id", "count"]
    want = src_first_n(df, n, order).collect()
    monkeypatch.setattr(ordering, "GATHERED", -1)
    got = src_first_n(df, n, order)
    assert sorted(got.collect()) == sorted(want) and len(want) == min(n, 5000)
    assert "TakeOrdered" not in got._jdf.queryExecution().executedPlan().toString()
    last = win_last_n_sorted(df, n, ("sensor_id", "count"))
    assert sorted(last.collect()) == sorted(df.orderBy(F.desc("reading_ts"), "sensor_id", "count").limit(n).collect())


def test_liveness_of_the_look_back_is_the_end_of_the_whole(frame):
    rows = [("a", f"2024-01-01 00:{m:02}:30") for m in range(0, 60, 2)] + [("gone", "2024-01-01 00:10:00"), ("new", "2024-01-01 00:57:10"), ("late", "2024-01-01 02:00:00")]
    scrapes = frame(rows, "instance string, ts timestamp_ntz")
    now = "2024-01-01 01:00:00"
    whole = mon_up(scrapes, now)
    recent = mon_up(scrapes, now, lookback="10 MINUTES")
    want = whole.where("ts > TIMESTAMP_NTZ'2024-01-01 00:50:00'")
    assert sorted(map(tuple, recent.collect())) == sorted(map(tuple, want.collect()))
    assert recent.where("instance = 'gone'").agg(F.sum("value")).first()[0] == 0 and recent.count() == 10 + 10 + 3
