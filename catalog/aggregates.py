"""Profiles and aggregate checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import (
    BASE,
    CUR,
    LATENCY_BOUNDS,
    M,
    PREDS,
    Q,
    R,
    RT,
    RUNS,
    SCORED,
    baseline,
    current,
    local_sql,
    models,
    newest,
    predictions,
    profile_scored,
    query,
    readings,
    requests,
    runs,
    table,
    typed_readings,
    with_,
)
from sensorspark.operators.daily import daily_states, describe_of, period_profile_of
from sensorspark.operators.profile import (
    agg_continuity_gap,
    agg_corr_matrix,
    agg_day_coverage,
    agg_daytype_hour,
    agg_describe,
    agg_duplicates,
    agg_freshness_check,
    agg_histogram,
    agg_http_rollup,
    agg_ingest_check,
    agg_key_distribution,
    agg_kv_pivot,
    agg_latest_row,
    agg_mean_by_hour,
    agg_mean_by_month,
    agg_mean_by_weekday,
    agg_null_dup_profile,
    agg_outliers_iqr,
    agg_period_profile,
    agg_prediction_check,
    agg_run_durations,
    agg_sensor_pivot,
    agg_value_quality,
    agg_weekday_hour,
    describe_difference,
    sensor_means,
)
from sensorspark.schema import Roles
from sensorspark.session import via_table

MAX_P = "(SELECT max(prediction_ts) FROM preds)"


@query(
    "agg_ingest_check",
    with_(
        *PREDS,
        f"""SELECT *, CASE WHEN n_rows = 0 THEN 'failed' WHEN n_rows < expected * 0.9 THEN 'warning' ELSE 'ok' END AS status
        FROM (SELECT count(*) AS n_rows, min(prediction_ts) AS first_ingestion, max(prediction_ts) AS last_ingestion,
          min(reading_ts) AS first_reading, max(reading_ts) AS last_reading, CAST(2000 AS BIGINT) AS expected
          FROM preds WHERE prediction_ts >= {MAX_P} - INTERVAL 2880 MINUTE)""",
    ),
)
def ingest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    return agg_ingest_check(p, newest(p, "prediction_ts"), 2000, minutes=2880, ingestion_ts="prediction_ts")


@query(
    "agg_freshness_check",
    with_(
        R,
        """SELECT count(*) AS n_rows, min(reading_ts) AS first_ts, max(reading_ts) AS last_ts,
        CASE WHEN count(*) = 0 THEN 'failed' ELSE 'ok' END AS status
        FROM r WHERE reading_ts >= (SELECT max(reading_ts) FROM r) - INTERVAL 7 DAY""",
    ),
)
def freshness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    return agg_freshness_check(r, newest(r))


@query(
    "agg_prediction_check",
    with_(
        *PREDS,
        """SELECT count(*) AS n_rows, avg(prediction) AS avg_prediction, min(prediction) AS min_prediction,
        max(prediction) AS max_prediction, min(prediction_ts) AS first_prediction, max(prediction_ts) AS last_prediction,
        count(*) <> 5000 AS count_mismatch, count(*) = 0 AS no_rows, min(prediction) < 0 AS has_negative FROM preds""",
    ),
    rounds=["avg_prediction", "min_prediction", "max_prediction"],
)
def prediction_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg_prediction_check(predictions(spark, sf_dir), 5000)


DESCRIBE = """count(count) AS n_rows, avg(count) AS mean, stddev_samp(count) AS std, min(count) AS min,
    quantile_cont(count, 0.25) AS q25, quantile_cont(count, 0.5) AS q50, quantile_cont(count, 0.75) AS q75,
    max(count) AS max"""
DESC_COLS = ["mean", "std", "min", "q25", "q50", "q75", "max"]


@query("agg_describe", with_(RT, f"SELECT source, {DESCRIBE} FROM rt GROUP BY source"), rounds=DESC_COLS)
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg_describe(typed_readings(spark, sf_dir), "count", ["source"])


@query("agg_describe_all", with_(R, f"SELECT {DESCRIBE} FROM r"), rounds=DESC_COLS)
def describe_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg_describe(readings(spark, sf_dir), "count")


def _stat_rows(side: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{s}' AS stat, CAST({s} AS DOUBLE) AS v FROM d WHERE source = '{side}'"
        for s in ("n_rows", *DESC_COLS)
    )


@query(
    "agg_describe_difference",
    with_(
        RT,
        f"d AS (SELECT source, {DESCRIBE} FROM rt GROUP BY source)",
        f"""SELECT a.stat, a.v AS value_a, b.v AS value_b, round((b.v - a.v) * 100.0::DOUBLE / nullif(a.v, 0), 1) AS difference_pct
        FROM ({_stat_rows('view')}) a JOIN ({_stat_rows('click')}) b USING (stat)""",
    ),
    rounds=["value_a", "value_b"],
)
def describe_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = agg_describe(typed_readings(spark, sf_dir), "count", ["source"])
    return describe_difference(d, "source", "view", "click")


RL = f"rl AS (SELECT *, {local_sql('reading_ts')} AS lt FROM r)"


def _mean_sql(**keys: str) -> str:
    cols = ", ".join(f"{e} AS {k}" for k, e in keys.items())
    return with_(R, RL, f"SELECT {cols}, avg(count) AS mean_count, count(*) AS n_rows FROM rl GROUP BY ALL")


WEEKDAY, HOUR, MONTH = (
    "CAST(isodow(lt) - 1 AS INTEGER)",
    "CAST(hour(lt) AS INTEGER)",
    "CAST(month(lt) AS INTEGER)",
)


@query("agg_mean_by_weekday", _mean_sql(weekday=WEEKDAY), rounds=["mean_count"])
def mean_by_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg_mean_by_weekday(readings(spark, sf_dir))


@query("agg_mean_by_hour", _mean_sql(hour=HOUR), rounds=["mean_count"])
def mean_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg_mean_by_hour(readings(spark, sf_dir))


@query("agg_mean_by_month", _mean_sql(month=MONTH), rounds=["mean_count"])
def mean_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg_mean_by_month(readings(spark, sf_dir))


@query(
    "agg_daytype_hour",
    _mean_sql(day_type="CASE WHEN isodow(lt) >= 6 THEN 'weekend' ELSE 'week' END", hour=HOUR),
    rounds=["mean_count"],
)
def daytype_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg_daytype_hour(readings(spark, sf_dir))


@query("agg_weekday_hour", _mean_sql(weekday=WEEKDAY, hour=HOUR), rounds=["mean_count"])
def weekday_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg_weekday_hour(readings(spark, sf_dir))


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "agg_sensor_pivot",
    "SELECT date_trunc('hour', ts) AS reading_ts, "
    + ", ".join(f"avg(value) FILTER (event_type = '{t}') AS \"{t}\"" for t in EVENT_TYPES)
    + " FROM events GROUP BY ALL",
    rounds=EVENT_TYPES,
)
def sensor_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("sensor_id"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("reading_ts"),
        F.col("value").alias("count"),
    )
    return agg_sensor_pivot(e, EVENT_TYPES)


@query(
    "agg_sensor_means",
    with_(
        R,
        """SELECT sensor_id, date_trunc('day', reading_ts) AS reading_ts, avg(count) AS mean_count
        FROM r GROUP BY ALL""",
    ),
    rounds=["mean_count"],
)
def sensor_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_trunc("day", "reading_ts").cast("timestamp_ntz")
    return sensor_means(readings(spark, sf_dir).withColumn("reading_ts", day))


@query(
    "agg_key_distribution",
    with_(
        R,
        "n AS (SELECT sensor_id, count(*) AS c FROM r GROUP BY sensor_id)",
        """SELECT count(*) AS n_keys, CAST(sum(c) AS BIGINT) AS n_rows, min(c) AS min_rows, max(c) AS max_rows,
        avg(c) AS mean_rows, median(c) AS median_rows, count(*) FILTER (c < 60) AS rare_keys FROM n""",
    ),
    rounds=["mean_rows", "median_rows"],
)
def key_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg_key_distribution(readings(spark, sf_dir), rare_below=60)


PERIOD = """min(reading_ts) AS first_ts, max(reading_ts) AS last_ts,
    CAST(floor(epoch_us(max(reading_ts)) / 86400000000.0::DOUBLE - epoch_us(min(reading_ts)) / 86400000000.0::DOUBLE) AS BIGINT) AS span_days,
    count(*) AS n_rows, count(*) FILTER (count > 20) AS valid_rows,
    count(*) FILTER (count > 20) * 100.0::DOUBLE / count(*) AS valid_pct, count(DISTINCT sensor_id) AS n_sensors"""


@query(
    "agg_period_profile",
    with_(RT, f"SELECT source, {PERIOD} FROM rt GROUP BY source UNION ALL SELECT 'TOTAL', {PERIOD} FROM rt"),
    rounds=["valid_pct"],
)
def period_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rt = typed_readings(spark, sf_dir).withColumn("count", F.col("count") - 20)
    return agg_period_profile(rt)


@query(
    "agg_period_profile_daily",
    with_(RT, f"SELECT * EXCLUDE (n_sensors), true AS sensors_close FROM (SELECT source, {PERIOD} FROM rt GROUP BY source UNION ALL SELECT 'TOTAL', {PERIOD} FROM rt)"),
    rounds=["valid_pct"],
)
def period_profile_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From stored daily states; distinct sensors within 5 % of the exact number (three standard errors)."""
    rt = typed_readings(spark, sf_dir).withColumn("count", F.col("count") - 20)
    states = via_table(daily_states(rt, ["source"]), "daily-states")
    exact = agg_period_profile(rt).select("source", F.col("n_sensors").alias("exact"))
    close = F.abs(F.col("n_sensors") - F.col("exact")) <= 0.05 * F.col("exact")
    return period_profile_of(states).join(exact, "source").withColumn("sensors_close", close).drop("n_sensors", "exact")


@query(
    "agg_describe_daily",
    with_(RT, f"SELECT source, n_rows, mean, std, min, max, true AS quartiles_close FROM (SELECT source, {DESCRIBE} FROM rt GROUP BY source)"),
    rounds=["mean", "std", "min", "max"],
)
def describe_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From stored daily states; each quartile's exact rank within 2 % of where it should be."""
    rt = typed_readings(spark, sf_dir)
    d = describe_of(via_table(daily_states(rt, ["source"]), "daily-states"), ["source"])
    v, n = F.col("count"), F.count(F.lit(1))
    met = rt.select("source", "count").join(d.select("source", "q25", "q50", "q75"), "source").groupBy("source")
    fine = F.lit(True)
    for q, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        fine &= (F.count(F.when(v < F.col(q), 1)) / n <= p + 0.02) & (F.count(F.when(v <= F.col(q), 1)) / n >= p - 0.02)
    return d.drop("q25", "q50", "q75").join(met.agg(fine.alias("quartiles_close")), "source")


@query(
    "agg_day_coverage",
    with_(
        R,
        """SELECT count(DISTINCT CAST(reading_ts AS DATE)) AS days_with_data, CAST(35 AS INTEGER) AS expected_days,
        count(DISTINCT CAST(reading_ts AS DATE)) * 100.0::DOUBLE / 35 AS coverage_pct
        FROM r WHERE reading_ts >= DATE '2023-12-29' AND reading_ts < DATE '2024-02-02'""",
    ),
    rounds=["coverage_pct"],
)
def day_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg_day_coverage(readings(spark, sf_dir), "2023-12-29", "2024-02-01")


@query(
    "agg_continuity_gap",
    with_(
        R,
        BASE,
        CUR,
        "e AS (SELECT (SELECT max(reading_ts) FROM base) AS history_end, (SELECT min(reading_ts) FROM cur) AS live_start, (SELECT max(reading_ts) FROM cur) AS live_end)",
        """e2 AS (SELECT *, CAST(floor((epoch_us(live_start) - epoch_us(history_end)) / 86400000000.0::DOUBLE) AS BIGINT) AS gap_days,
          CAST(floor((epoch_us(TIMESTAMP '2024-02-03') - epoch_us(live_end)) / 86400000000.0::DOUBLE) AS BIGINT) AS age_days,
          CAST(history_end AS DATE) AS cutoff_date FROM e)""",
        """SELECT *, CASE WHEN gap_days < 0 THEN 'overlap' WHEN gap_days = 0 THEN 'contiguous' ELSE 'gap' END AS continuity,
        CASE WHEN age_days <= 1 THEN 'fresh' WHEN age_days <= 7 THEN 'late' ELSE 'stale' END AS freshness FROM e2""",
    ),
)
def continuity_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    return agg_continuity_gap(baseline(r), current(r), "2024-02-03")


HOLES = "h AS (SELECT event_type, CAST(floor(value / 40) AS BIGINT) AS level, CASE WHEN event_id % 4 > 0 THEN event_id % 4 END AS k FROM events)"


def holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_type",
        F.floor(F.col("value") / 40).alias("level"),
        F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 4).alias("k"),
    )


@query(
    "agg_null_dup_profile",
    with_(
        HOLES,
        """SELECT 'k' AS "column", count(*) FILTER (k IS NULL) * 100.0::DOUBLE / count(*) AS null_pct,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM h)) AS duplicate_rows FROM h""",
    ),
    rounds=["null_pct"],
)
def null_dup_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg_null_dup_profile(holes(spark, sf_dir))


@query(
    "agg_duplicates",
    with_(
        HOLES,
        "SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM h)) AS duplicate_rows FROM h",
    ),
)
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg_duplicates(holes(spark, sf_dir))


@query(
    "agg_value_quality",
    """SELECT count(*) AS n_rows, count(*) FILTER (v IS NULL) AS null_values, count(*) FILTER (v = 0) AS zero_values,
       count(*) FILTER (v > 0) AS positive_values, min(v) FILTER (v > 0) AS min_positive, max(v) FILTER (v > 0) AS max_value,
       avg(v) FILTER (v > 0) AS mean_positive, count(DISTINCT user_id) AS n_sensors
       FROM (SELECT user_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 0 ELSE value - 1 END AS v FROM events)""",
    rounds=["min_positive", "max_value", "mean_positive"],
)
def value_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("row_key")
    v = F.when(k % 7 == 0, F.lit(None)).when(k % 5 == 0, F.lit(0.0)).otherwise(F.col("count") - 1)
    return agg_value_quality(readings(spark, sf_dir).withColumn("count", v))


# Values on a bin edge fall left or right of it by the last bit; these columns have none.
HIST_COLS = {"price": "l_extendedprice", "mixed": "l_extendedprice * (1 - l_discount) + l_tax"}


def _hist(c: str, e: str) -> str:
    pos = "(x - lo) / ((hi - lo) / 30)"
    return f"""SELECT '{c}' AS "column", CAST(least(floor({pos}), 29) AS BIGINT) AS bin,
      lo + (hi - lo) / 30 * least(floor({pos}), 29) AS bin_start, count(*) AS n_rows
      FROM (SELECT {e} AS x FROM lineitem), (SELECT min({e}) AS lo, max({e}) AS hi FROM lineitem) GROUP BY ALL"""


@query(
    "agg_histogram",
    " UNION ALL ".join(_hist(c, e) for c, e in HIST_COLS.items()),
    rounds=["bin_start"],
    digits=4,
)
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(*[F.expr(e).alias(c) for c, e in HIST_COLS.items()])
    return agg_histogram(li)


CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "agg_corr_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, {'1.0::DOUBLE' if a == b else f'corr({a}, {b})'} AS r"
        + ("" if a == b else " FROM lineitem")
        for a in CORR
        for b in CORR
    ),
    rounds=["r"],
)
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg_corr_matrix(table(spark, sf_dir, "lineitem"), CORR)


def _iqr(by: str) -> str:
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    join = f"JOIN q USING ({by})" if by else ", q"
    return with_(
        RT,
        f"q0 AS (SELECT {key} quantile_cont(count, 0.25) AS q1, quantile_cont(count, 0.75) AS q3 FROM rt {group})",
        "q AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5::DOUBLE * (q3 - q1) AS lower, q3 + 1.5::DOUBLE * (q3 - q1) AS upper FROM q0)",
        f"""SELECT {key} q1, q3, iqr, lower, upper, count(*) AS n_rows,
        count(*) FILTER (count < lower OR count > upper) AS outliers,
        count(*) FILTER (count < lower OR count > upper) * 100.0::DOUBLE / count(*) AS outlier_pct
        FROM rt {join} GROUP BY {key} q1, q3, iqr, lower, upper""",
    )


IQR_COLS = ["q1", "q3", "iqr", "lower", "upper", "outlier_pct"]


@query("agg_outliers_iqr", _iqr(""), rounds=IQR_COLS)
def outliers_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg_outliers_iqr(typed_readings(spark, sf_dir), "count")


@query("agg_outliers_iqr_by_source", _iqr("source"), rounds=IQR_COLS)
def outliers_iqr_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg_outliers_iqr(typed_readings(spark, sf_dir), "count", by=["source"])


@query(
    "agg_latest_row",
    with_(
        M,
        """SELECT run_id, timestamp, r2, rmse, drift_detected, drift_status FROM m
        QUALIFY row_number() OVER (PARTITION BY drift_status ORDER BY timestamp DESC, run_id DESC) = 1""",
    ),
    rounds=["r2", "rmse"],
)
def latest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = models(spark, sf_dir).select("run_id", "timestamp", "r2", "rmse", "drift_detected", "drift_status")
    return agg_latest_row(m, "timestamp", ["drift_status"])


@query(
    "agg_run_durations",
    with_(
        RUNS,
        """SELECT pipeline_id, state, count(*) AS n_runs, avg(d) AS mean_duration_s, max(d) AS max_duration_s,
        median(d) AS median_duration_s
        FROM (SELECT *, (epoch_us(end_ts) - epoch_us(start_ts)) / 1000000.0::DOUBLE AS d FROM runs)
        GROUP BY pipeline_id, state""",
    ),
    rounds=["mean_duration_s", "max_duration_s", "median_duration_s"],
    digits=3,
)
def run_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg_run_durations(runs(spark, sf_dir))


@query(
    "agg_kv_pivot",
    """SELECT user_id AS run_id, max_by(value, (ts, value)) FILTER (event_type = 'click') AS click,
       max_by(value, (ts, value)) FILTER (event_type = 'error') AS error,
       max_by(value, (ts, value)) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id""",
)
def kv_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("key"), "value", "ts"
    )
    return agg_kv_pivot(kv, ["click", "error", "view"])


LE = ", ".join(f"({b}::DOUBLE)" for b in LATENCY_BOUNDS) + ", ('inf'::DOUBLE)"


@query(
    "agg_http_rollup",
    with_(
        Q,
        f"""SELECT method, endpoint, status_code, count(*) AS requests, count(*) FILTER (status_code >= 500) AS errors,
        sum(latency) AS latency_sum, le, count(*) FILTER (latency <= le) AS le_count
        FROM q, (VALUES {LE}) AS b(le) GROUP BY method, endpoint, status_code, le""",
    ),
    rounds=["latency_sum"],
)
def http_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg_http_rollup(requests(spark, sf_dir), LATENCY_BOUNDS)


@query(
    "agg_http_rollup_hourly",
    with_(
        Q,
        f"""SELECT method, endpoint, date_trunc('hour', ts) AS window_start, count(*) AS requests,
        count(*) FILTER (status_code >= 500) AS errors, sum(latency) AS latency_sum, le,
        count(*) FILTER (latency <= le) AS le_count
        FROM q, (VALUES {LE}) AS b(le) GROUP BY method, endpoint, window_start, le""",
    ),
    rounds=["latency_sum"],
)
def http_rollup_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg_http_rollup(
        requests(spark, sf_dir), LATENCY_BOUNDS, window="1 hour", by=("method", "endpoint")
    )


def quality_of_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg_value_quality(profile_scored(spark, sf_dir), Roles(value="prediction"))


@query(
    "agg_value_quality_predictions",
    with_(
        *SCORED,
        """SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS null_values, count(*) FILTER (prediction = 0) AS zero_values,
        count(*) FILTER (prediction > 0) AS positive_values, min(prediction) AS min_positive, max(prediction) AS max_value,
        avg(prediction) AS mean_positive, count(DISTINCT sensor_id) AS n_sensors FROM p""",
    ),
    rounds=["min_positive", "max_value", "mean_positive"],
)
def prediction_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_of_scores(spark, sf_dir)
