from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorspark.operators.daily import daily_states, day_coverage_of, describe_of, merged_states, outliers_of, period_profile_of
from sensorspark.operators.joins import jn_known_semi, jn_pred_actual
from sensorspark.operators.profile import agg_day_coverage, agg_describe, agg_outliers_iqr, agg_period_profile
from sensorspark.sources.sinks import snk_append_partitioned, snk_bucketed, snk_replace_day
from sensorspark.sources.tables import src_days


@pytest.fixture(scope="module")
def readings(spark):
    """Forty days, 5,000 sensors, values far from 0; one day holds a third of the rows."""
    day = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 40).cast("int")
    ts = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'") + F.make_dt_interval(days=day, mins=(F.col("id") % 1440).cast("int"))
    rows = spark.range(120_000).select(
        (F.col("id") * 7919 % 5000).alias("sensor_id"), ts.alias("reading_ts"), (1e6 + F.randn(5) * 10).alias("count"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source")
    )
    return rows.cache()


def test_daily_states_merge_to_the_whole(readings):
    states = daily_states(readings, ["source"])
    assert states.count() == states.select("reading_date", "source").distinct().count() <= 80
    got = {r.source: r for r in period_profile_of(states).collect()}
    want = {r.source: r for r in agg_period_profile(readings).collect()}
    assert set(got) == set(want) == {"a", "b", "TOTAL"}
    for s, r in want.items():
        assert (got[s].first_ts, got[s].last_ts, got[s].span_days, got[s].n_rows, got[s].valid_rows) == (r.first_ts, r.last_ts, r.span_days, r.n_rows, r.valid_rows)
        assert abs(got[s].n_sensors - r.n_sensors) <= 0.05 * r.n_sensors
    assert {r.source: r.n_sensors for r in agg_period_profile(readings, approx=True).collect()} == {s: r.n_sensors for s, r in got.items()}
    # Merged in steps or at once.
    weeks = merged_states(states.withColumn("week", F.date_trunc("week", "reading_date")), ["week", "source"])
    a, b = describe_of(weeks).first(), describe_of(states).first()
    assert a.n_rows == b.n_rows and a.std == pytest.approx(b.std, rel=1e-9) and a.mean == pytest.approx(b.mean, rel=1e-14)


def test_rank_error_of_sketches(readings):
    values = np.sort(np.array([r["count"] for r in readings.select("count").collect()]))
    got, want = describe_of(daily_states(readings)).first(), agg_describe(readings, "count").first()
    assert got.n_rows == want.n_rows and got.min == want.min and got.max == want.max
    assert got.mean == pytest.approx(want.mean, rel=1e-12) and got.std == pytest.approx(want.std, rel=1e-6)
    for q, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        assert abs(np.searchsorted(values, got[q]) / len(values) - p) < 0.015
    assert agg_describe(readings, "count", approx=True).first().n_rows == want.n_rows
    o, e = agg_outliers_iqr(readings, "count", approx=True).first(), agg_outliers_iqr(readings, "count").first()
    assert o.n_rows == e.n_rows and abs(o.outliers - e.outliers) <= 0.015 * e.n_rows and o.q1 == pytest.approx(e.q1, abs=1.0)


def test_empty_days_nulls_and_no_rows(frame):
    df = frame([("a", "2024-01-01 10:00:00", None), ("b", None, 4.0), (None, "2024-01-02 00:00:00", float(2))], "sensor_id string, reading_ts timestamp_ntz, count double")
    got = describe_of(daily_states(df)).first()
    assert (got.n_rows, got.mean, got.min, got.max) == (2, 3.0, 2.0, 4.0) and got.std == pytest.approx(2**0.5)
    only = describe_of(daily_states(df.where("count IS NULL"))).first()
    assert only.n_rows == 0 and only["mean"] is None and only.q50 is None
    assert outliers_of(daily_states(df.where("count IS NULL"))).first().q1 is None
    assert period_profile_of(daily_states(df.limit(0).withColumn("source", F.lit("x")), ["source"])).where("source <> 'TOTAL'").count() == 0
    args = ("2023-12-31", "2024-01-03")
    assert day_coverage_of(daily_states(df), *args).first() == agg_day_coverage(df, *args).first()


def test_one_day_is_replaced(spark, readings, tmp_path):
    path = str(tmp_path / "s")
    snk_replace_day(daily_states(readings, ["source"]), path, "reading_date", "source")
    again = readings.where("CAST(reading_ts AS DATE) = DATE'2024-01-08'").limit(100)
    snk_replace_day(daily_states(again, ["source"]), path, "reading_date", "source")
    stored = spark.read.parquet(path)
    assert merged_states(stored).first().n_rows == readings.where("CAST(reading_ts AS DATE) <> DATE'2024-01-08'").count() + 100


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_days_prune_the_scan(spark, readings, tmp_path):
    path = str(tmp_path / "t")
    dated = readings.withColumn("reading_date", F.to_date("reading_ts"))
    snk_append_partitioned(dated, path)
    few = spark.sql("SELECT DATE'2024-01-05' AS reading_date UNION ALL SELECT DATE'2024-01-05' UNION ALL SELECT DATE'2024-03-01' UNION ALL SELECT CAST(NULL AS DATE)")
    few.write.parquet(str(tmp_path / "days"))
    got = src_days(spark.read.parquet(path), spark.read.parquet(str(tmp_path / "days")))
    assert "dynamicpruning" in plan_of(got)
    assert got.count() == dated.where("reading_date = DATE'2024-01-05'").count() > 0
    # Only the named day's files are read.
    got.collect()
    scan = got._jdf.queryExecution().executedPlan().toString()
    assert "SubqueryAdaptiveBroadcast" in scan or "SubqueryBroadcast" in scan


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bucketed_tables_join_without_a_shuffle(spark, readings, tmp_path, no_broadcast):
    pred = readings.select("sensor_id", "reading_ts", (F.col("count") + 1).alias("prediction"))
    sides = [snk_bucketed(df, f"bucketed_test_{n}", str(tmp_path / n), buckets=4) for n, df in (("p", pred), ("a", readings.select("sensor_id", "reading_ts", "count")))]
    got = jn_pred_actual(*sides, "2024-02-11", days=60)
    rows = sorted(map(tuple, got.where("sensor_id < 20").collect()))
    text = plan_of(got)
    assert "Exchange" not in text and "SortMergeJoin" in text
    assert rows == sorted(map(tuple, jn_pred_actual(pred, readings, "2024-02-11", days=60).where("sensor_id < 20").collect()))
    for n in "pa":
        spark.sql(f"DROP TABLE bucketed_test_{n}")


def test_prefilter_drops_rows_before_the_shuffle(spark, readings, no_broadcast):
    known = spark.range(0, 5000, 50).select(F.col("id").alias("sensor_id"))
    got = jn_known_semi(readings, known, prefilter=True)
    assert got.count() == readings.where("sensor_id % 50 = 0").count()
    assert "getbit" in plan_of(got).lower() and "subquery" in plan_of(got).lower()
    assert sorted(got.columns) == sorted(jn_known_semi(readings, known).columns)
