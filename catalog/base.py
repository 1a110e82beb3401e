"""Registration, and the logical inputs every query starts from.

Each input is derived from the given tables twice: as a DataFrame and as a SQL table expression.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None, rounds: Sequence[str] = (), digits: int = 6):
    """Register a query. ``rounds`` names the floating results to compare at ``digits`` decimals.

    Means of short decimals often end in an exact half of the last digit, where the order of a sum
    decides the rounding. Both sides are therefore moved off that point by the same tiny amount."""
    shift = f"{0.137 * 10**-digits:.15f}"

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(spark, sf_dir)
            return out.withColumns({c: F.round(F.col(c) + F.lit(float(shift)), digits) + F.lit(0.0) for c in rounds}) if rounds else out

        text = sql
        if sql is not None and rounds:
            replaced = ", ".join(f"round({c} + {shift}::DOUBLE, {digits}) + 0.0::DOUBLE AS {c}" for c in rounds)
            text = f"SELECT * REPLACE ({replaced}) FROM ({sql})"
        if name in CATALOG:
            raise ValueError(f"registered twice: {name}")
        CATALOG[name] = Query(run, text)
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPLIT_AT = "2024-01-22 00:00:00"


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("sensor_id"),
        F.col("ts").alias("reading_ts"),
        F.col("value").alias("count"),
        F.col("event_id").alias("row_key"),
    )


R = """r AS (SELECT user_id AS sensor_id, ts AS reading_ts, value AS count, event_id AS row_key
      FROM events)"""


def dated(df: DataFrame) -> DataFrame:
    return df.withColumn("reading_date", F.to_date("reading_ts"))


def typed_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with the event type, which names a source."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("sensor_id"),
        F.col("ts").alias("reading_ts"),
        F.col("value").alias("count"),
        F.col("event_id").alias("row_key"),
        F.col("event_type").alias("source"),
    )


RT = """rt AS (SELECT user_id AS sensor_id, ts AS reading_ts, value AS count, event_id AS row_key,
      event_type AS source FROM events)"""


def baseline(df: DataFrame) -> DataFrame:
    return df.where(F.col("reading_ts") < F.lit(SPLIT_AT).cast("timestamp_ntz"))


def current(df: DataFrame) -> DataFrame:
    return df.where(F.col("reading_ts") >= F.lit(SPLIT_AT).cast("timestamp_ntz"))


BASE = f"base AS (SELECT * FROM r WHERE reading_ts < TIMESTAMP '{SPLIT_AT}')"
CUR = f"cur AS (SELECT * FROM r WHERE reading_ts >= TIMESTAMP '{SPLIT_AT}')"


def source_a(df: DataFrame) -> DataFrame:
    return df.where(F.col("source") == "view")


def source_b(df: DataFrame) -> DataFrame:
    """Every reading that the first source doesn't have."""
    return df.where(F.col("source") != "view")


SRC_A = "a AS (SELECT * FROM rt WHERE source = 'view')"
SRC_B = "b AS (SELECT * FROM rt WHERE source <> 'view')"


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Larger readings: deliveries per supplier."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("sensor_id"),
        F.col("l_shipdate").alias("reading_ts"),
        F.col("l_quantity").alias("count"),
        "l_orderkey",
        "l_linenumber",
    )


S = """s AS (SELECT l_suppkey AS sensor_id, l_shipdate AS reading_ts, l_quantity AS count,
      l_orderkey, l_linenumber FROM lineitem)"""


def newest(df: DataFrame, col: str = "reading_ts"):
    """The newest time of a table, as a literal: what "now" means for stored data."""
    return F.lit(df.agg(F.max(col)).first()[0])


def local_sql(ts: str) -> str:
    return f"timezone('Europe/Paris', timezone('UTC', {ts}))"


def with_(*parts: str) -> str:
    """``WITH`` the given table expressions; the last part is the body."""
    *ctes, body = parts
    return f"WITH {', '.join(ctes)} {body}"


def profile_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sensorspark.operators.models import ml_profile_score

    r = readings(spark, sf_dir)
    return ml_profile_score(baseline(r), current(r))


P = f"""rl AS (SELECT *, {local_sql('reading_ts')} AS lt FROM r),
  prof AS (SELECT sensor_id, isodow(lt) AS d, hour(lt) AS h, avg(count) AS m FROM rl
           WHERE reading_ts < TIMESTAMP '{SPLIT_AT}' GROUP BY ALL),
  p AS (SELECT rl.sensor_id, reading_ts, count, row_key,
          coalesce(m, (SELECT avg(count) FROM base)) AS prediction
        FROM rl LEFT JOIN prof ON rl.sensor_id = prof.sensor_id AND isodow(lt) = d AND hour(lt) = h
        WHERE reading_ts >= TIMESTAMP '{SPLIT_AT}')"""
SCORED = (R, BASE, P)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored predictions: overlapping scoring runs leave two per reading, by two model versions."""
    p = profile_scored(spark, sf_dir)
    runs = F.array(
        *[
            F.struct(
                F.lit(v).alias("model_version"),
                (F.col("prediction") + F.lit(float(i))).alias("prediction"),
                (F.col("reading_ts") + F.expr(f"INTERVAL {i + 1} DAYS")).alias("prediction_ts"),
            )
            for i, v in enumerate(("v1", "v2"))
        ]
    )
    return p.select("sensor_id", "reading_ts", F.explode(runs).alias("e")).select(
        "sensor_id", "reading_ts", "e.*"
    )


PREDS = (
    *SCORED,
    """preds AS (
    SELECT sensor_id, reading_ts, 'v1' AS model_version, prediction + 0.0::DOUBLE AS prediction,
           reading_ts + INTERVAL 1 DAY AS prediction_ts FROM p
    UNION ALL
    SELECT sensor_id, reading_ts, 'v2', prediction + 1.0::DOUBLE, reading_ts + INTERVAL 2 DAY FROM p)""",
)


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fleet of models, one per order: metrics spread over the whole range of each threshold."""
    k = F.floor("o_totalprice").cast("bigint")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderdate").alias("timestamp"),
        (k % 101 / 100.0).alias("r2"),
        (k % 113).cast("double").alias("rmse"),
        (k % 11 / 10.0).alias("drift_share"),
        (k % 3 != 0).alias("drift_detected"),
        (k % 29 == 0).alias("force"),
        F.when(k % 7 == 0, "error").otherwise("ok").alias("drift_status"),
        (k % 103 / 100.0).alias("r2_baseline"),
        (k % 107 / 100.0).alias("r2_current"),
        F.when(k % 5 != 0, k % 109 / 100.0).alias("champion_r2_baseline"),
        F.when(k % 17 == 0, F.lit(0.0)).otherwise(k % 97 / 100.0).alias("champion_r2_current"),
        (k % 127 / 100.0).alias("r2_train"),
        k.alias("k"),
    )


M = """m0 AS (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS k FROM orders),
  m AS (SELECT o_orderkey AS run_id, o_orderdate AS timestamp, k,
      (k % 101) / 100.0::DOUBLE AS r2, CAST(k % 113 AS DOUBLE) AS rmse,
      (k % 11) / 10.0::DOUBLE AS drift_share, (k % 3 <> 0) AS drift_detected, (k % 29 = 0) AS force,
      CASE WHEN k % 7 = 0 THEN 'error' ELSE 'ok' END AS drift_status,
      (k % 103) / 100.0::DOUBLE AS r2_baseline, (k % 107) / 100.0::DOUBLE AS r2_current,
      CASE WHEN k % 5 <> 0 THEN (k % 109) / 100.0::DOUBLE END AS champion_r2_baseline,
      CASE WHEN k % 17 = 0 THEN 0.0::DOUBLE ELSE (k % 97) / 100.0::DOUBLE END AS champion_r2_current,
      (k % 127) / 100.0::DOUBLE AS r2_train FROM m0)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task runs: each delivery of an order is a run that ends at its ship date."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    state = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "failed")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderpriority").alias("pipeline_id"),
        F.concat_ws("-", "o_orderkey", "l_linenumber").alias("run_id"),
        state.otherwise("running").alias("state"),
        F.col("o_orderdate").alias("start_ts"),
        F.when(F.col("o_orderstatus") != "P", F.col("l_shipdate")).alias("end_ts"),
    )


RUNS = """runs AS (SELECT o_orderpriority AS pipeline_id,
    concat_ws('-', o_orderkey, l_linenumber) AS run_id,
    CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'running' END AS state,
    o_orderdate AS start_ts, CASE WHEN o_orderstatus <> 'P' THEN l_shipdate END AS end_ts
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request log: one request per event; errors answer 500."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.when(F.col("event_id") % 3 == 0, "GET").otherwise("POST").alias("method"),
        F.col("event_type").alias("endpoint"),
        F.when(F.col("event_type") == "error", 500)
        .when(F.col("event_id") % 10 == 0, 422)
        .otherwise(200)
        .alias("status_code"),
        (F.col("value") / 100.0).alias("latency"),
        "ts",
    )


Q = """q AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'GET' ELSE 'POST' END AS method,
    event_type AS endpoint,
    CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 10 = 0 THEN 422 ELSE 200 END AS status_code,
    value / 100.0::DOUBLE AS latency, ts FROM events)"""


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter samples per event type: the value grows with the event id and starts over now and
    then."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.lit("requests_total").alias("metric"),
        F.col("event_type").alias("instance"),
        "ts",
        (F.col("event_id") % 977).cast("double").alias("value"),
    )


C = """c AS (SELECT 'requests_total' AS metric, event_type AS instance, ts,
    CAST(event_id % 977 AS DOUBLE) AS value FROM events)"""

# Latency bounds in seconds of the request histogram.
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]


def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauge samples of model metrics: every event is one sample of each gauge of its sensor."""
    e = table(spark, sf_dir, "events")
    k = F.floor(F.col("value") * 100).cast("bigint")
    entries = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), v.alias("value"))
            for m, v in {
                "model_r2_champion_current": k % 101 / 100.0,
                "model_r2_challenger_current": k % 103 / 100.0,
                "model_r2_champion_baseline": k % 107 / 100.0,
                "model_r2_challenger_baseline": k % 109 / 100.0,
                "model_rmse_production": (k % 113).cast("double"),
                "prediction_rmse": (k % 127).cast("double"),
                "drift_share": k % 11 / 10.0,
            }.items()
        ]
    )
    return e.select(
        F.col("user_id").cast("string").alias("instance"), "ts", F.explode(entries).alias("e")
    ).select("instance", "ts", "e.*")


G = """g0 AS (SELECT CAST(user_id AS VARCHAR) AS instance, ts, CAST(floor(value * 100) AS BIGINT) AS k
    FROM events),
  g AS (
    SELECT instance, ts, 'model_r2_champion_current' AS metric, (k % 101) / 100.0::DOUBLE AS value FROM g0
    UNION ALL SELECT instance, ts, 'model_r2_challenger_current', (k % 103) / 100.0::DOUBLE FROM g0
    UNION ALL SELECT instance, ts, 'model_r2_champion_baseline', (k % 107) / 100.0::DOUBLE FROM g0
    UNION ALL SELECT instance, ts, 'model_r2_challenger_baseline', (k % 109) / 100.0::DOUBLE FROM g0
    UNION ALL SELECT instance, ts, 'model_rmse_production', CAST(k % 113 AS DOUBLE) FROM g0
    UNION ALL SELECT instance, ts, 'prediction_rmse', CAST(k % 127 AS DOUBLE) FROM g0
    UNION ALL SELECT instance, ts, 'drift_share', (k % 11) / 10.0::DOUBLE FROM g0)"""
