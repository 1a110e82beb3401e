"""Structured Streaming forms. Each runs over all files of a folder and ends; where a batch form
exists its SQL is the check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from catalog.base import (
    CUR,
    Q,
    R,
    SPLIT_AT,
    current,
    dated,
    query,
    readings,
    requests,
    with_,
)
from catalog.learning import fitted
from catalog.monitoring import HIST, LATEST, _evaluated, evaluations
from sensorspark.operators.metrics import alert_rules
from sensorspark.session import scratch_path, via_table
from sensorspark.streaming.alerts import latest_alerts, str_alert_for
from sensorspark.streaming.days import read_days
from sensorspark.streaming.flows import (
    str_dedup,
    str_incremental_ingest,
    str_late_quarantine,
    str_score,
    str_sliding_error_rate,
    str_tumbling_rollup,
)


def in_parts(
    spark: SparkSession,
    df: DataFrame,
    ts: str,
    run: Callable[[DataFrame], StreamingQuery],
    parts: int = 3,
) -> None:
    """Rows arrive in a folder span by span of time; after each arrival the stream runs to its end
    and resumes from its checkpoint the next time."""
    lo, hi = df.agg(F.min(ts), F.max(ts)).first()
    inbox = scratch_path(spark, "inbox")
    for i in range(parts):
        after = F.col(ts) >= F.lit(lo + (hi - lo) * i / parts)
        before = F.col(ts) < F.lit(lo + (hi - lo) * (i + 1) / parts)
        arrived = df.where(after & before) if i + 1 < parts else df.where(after)
        arrived.write.mode("append").parquet(inbox)
        run(spark.readStream.schema(df.schema).parquet(inbox)).awaitTermination()


def streamed(
    spark: SparkSession, df: DataFrame, ts: str, form: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """What a streaming frame has written after all parts arrived."""
    out, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "checkpoint")

    def run(stream: DataFrame) -> StreamingQuery:
        return (
            form(stream)
            .writeStream.outputMode("append")
            .format("parquet")
            .option("path", out)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    in_parts(spark, df, ts, run)
    return spark.read.parquet(out)


@query(
    "str_incremental_ingest",
    with_(R, "SELECT *, CAST(reading_ts AS DATE) AS reading_date FROM r"),
)
def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every arrival is taken in once, whatever is in the folder already."""
    r = readings(spark, sf_dir)
    target, checkpoint = scratch_path(spark, "target"), scratch_path(spark, "checkpoint")
    in_parts(spark, r, "reading_ts", lambda s: str_incremental_ingest(s, target, checkpoint))
    return read_days(spark, target).select(*r.columns, "reading_date")


@query("str_dedup", with_(R, "SELECT sensor_id, reading_ts, count FROM r"))
def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading arrives twice."""
    r = readings(spark, sf_dir).select("sensor_id", "reading_ts", "count")
    return streamed(spark, r.unionAll(r), "reading_ts", str_dedup)


@query(
    "str_tumbling_rollup",
    with_(
        R,
        """h AS (SELECT sensor_id, date_trunc('hour', reading_ts) AS hour_start, avg(count) AS mean_count, count(*) AS n_rows
        FROM r GROUP BY 1, 2)""",
        """SELECT * FROM h
        WHERE hour_start + INTERVAL 1 HOUR <= (SELECT max(reading_ts) FROM r) - INTERVAL 2 HOUR""",
    ),
    rounds=["mean_count"],
)
def tumbling_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed(spark, readings(spark, sf_dir), "reading_ts", str_tumbling_rollup)


@query(
    "str_sliding_error_rate",
    with_(
        Q,
        """s AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) - i * INTERVAL 1 MINUTE AS window_start, status_code
           FROM q, range(5) AS t(i))""",
        """w AS (SELECT window_start, count(*) AS requests, count(*) FILTER (status_code >= 500) AS errors,
        count(*) FILTER (status_code >= 500) * 100.0::DOUBLE / count(*) AS error_pct FROM s GROUP BY 1)""",
        """SELECT * FROM w
        WHERE window_start + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM q) - INTERVAL 10 MINUTE""",
    ),
    rounds=["error_pct"],
)
def sliding_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed(spark, requests(spark, sf_dir), "ts", str_sliding_error_rate)


@query(
    "str_score",
    with_(
        R,
        CUR,
        """SELECT sensor_id, reading_ts, count, 'v1' AS model_version, CAST(reading_ts AS DATE) AS pred_date, true AS scored FROM cur""",
    ),
)
def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    model: PipelineModel = fitted(spark, sf_dir)
    rows = current(readings(spark, sf_dir))
    path, checkpoint = scratch_path(spark, "scored"), scratch_path(spark, "checkpoint")
    tags = {"model_version": "v1"}
    in_parts(spark, rows, "reading_ts", lambda s: str_score(s, model, path, checkpoint, tags))
    stored = read_days(spark, path).withColumn("scored", F.col("prediction").isNotNull())
    return stored.drop("prediction_ts", "prediction")


@query(
    "str_late_quarantine",
    with_(
        R,
        f"""SELECT row_key, CASE WHEN row_key % 20 = 0 AND reading_ts < TIMESTAMP '{SPLIT_AT}' THEN 'late' ELSE 'in_time' END AS part
        FROM r""",
    ),
)
def late_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some early readings arrive only after all others."""
    r = readings(spark, sf_dir)
    held_back = F.expr(f"row_key % 20 = 0 AND reading_ts < TIMESTAMP_NTZ'{SPLIT_AT}'")
    inbox = scratch_path(spark, "inbox")
    target, late, marks, checkpoint = (
        scratch_path(spark, n) for n in ("in-time", "late", "marks", "checkpoint")
    )
    for arrived in (r.where(~held_back), r.where(held_back)):
        arrived.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(r.schema).parquet(inbox)
        str_late_quarantine(stream, target, late, marks, checkpoint).awaitTermination()
    parts = [
        read_days(spark, p, dated(r).schema).select("row_key", F.lit(n).alias("part"))
        for n, p in (("in_time", target), ("late", late))
    ]
    return parts[0].unionAll(parts[1])


@query(
    "str_alert_for",
    with_(
        *_evaluated(),
        HIST,
        "nw AS (SELECT max(ts) AS t FROM ev)",
        LATEST,
    ),
)
def alert_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts, checkpoint = scratch_path(spark, "alerts"), scratch_path(spark, "checkpoint")
    rules = alert_rules(spark)
    # Made once, not anew for each arrival.
    found = via_table(evaluations(spark, sf_dir), "evaluations")
    in_parts(spark, found, "ts", lambda s: str_alert_for(s, rules, alerts, checkpoint))
    return latest_alerts(spark, alerts)
