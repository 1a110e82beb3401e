"""Streams of readings and requests.

Files are the sources; offsets live in the checkpoint. Tables are written by day, a batch's rows to
folders of its number, so a repeated batch leaves the same result (``days.py``). Alerts are in
``alerts.py``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sensorspark.functions.columns import utc_instant, utc_wall
from sensorspark.operators.models import ml_batch_score
from sensorspark.schema import ROLES, Roles
from sensorspark.streaming.days import compact, delete_folder, start_batches, start_day_sink, touched_days, write_batch


def event_time(stream: DataFrame, col: str, delay: str) -> DataFrame:
    """Watermark on a timestamp column. Watermarks need a zoned type: wall times are taken as UTC,
    whatever the session's zone; ``utc_wall`` leads back."""
    wall = isinstance(stream.schema[col].dataType, T.TimestampNTZType)
    return stream.withColumn(col, utc_instant(F.col(col)) if wall else F.col(col)).withWatermark(col, delay)


def str_incremental_ingest(
    stream: DataFrame, target: str, checkpoint: str, roles: Roles = ROLES, available_now: bool = True
) -> StreamingQuery:
    """New files to the day-partitioned table, each exactly once and in few files a day; the
    checkpoint takes the place of the highest stored timestamp. ``read_days`` reads the table."""
    out = stream.withColumn("reading_date", F.to_date(roles.ts))
    return start_day_sink(out, target, checkpoint, "reading_date", roles.sensor, available_now)


def str_dedup(
    stream: DataFrame, delay: str = "2 hours", salts: int = 16, roles: Roles = ROLES
) -> DataFrame:
    """One row per sensor and time while copies arrive within the delay.

    Copies are first dropped within salted parts (the salt follows the input partition), so that a
    row that is repeated without end does not send every copy to one task."""
    keys = [roles.sensor, roles.ts]
    salted = event_time(stream, roles.ts, delay).withColumn(
        "__salt", F.pmod(F.spark_partition_id(), F.lit(salts))
    )
    return (
        salted.dropDuplicatesWithinWatermark([*keys, "__salt"])
        .dropDuplicatesWithinWatermark(keys)
        .withColumn(roles.ts, utc_wall(F.col(roles.ts)))
        .drop("__salt")
    )


def str_tumbling_rollup(stream: DataFrame, delay: str = "2 hours", roles: Roles = ROLES) -> DataFrame:
    """Hourly mean per sensor; an hour is emitted once, when the watermark has passed it."""
    return (
        event_time(stream, roles.ts, delay)
        .groupBy(roles.sensor, F.window(roles.ts, "1 hour").alias("w"))
        .agg(F.avg(roles.value).alias("mean_count"), F.count(F.lit(1)).alias("n_rows"))
        .select(roles.sensor, utc_wall(F.col("w.start")).alias("hour_start"), "mean_count", "n_rows")
    )


def str_sliding_error_rate(
    stream: DataFrame, delay: str = "10 minutes", is_error: Column | None = None
) -> DataFrame:
    """Errors per request in percent over 5 minutes, every minute."""
    bad = F.col("status_code") >= 500 if is_error is None else is_error
    return (
        event_time(stream.withColumn("__bad", bad), "ts", delay)
        .groupBy(F.window("ts", "5 minutes", "1 minute").alias("w"))
        .agg(F.count(F.lit(1)).alias("requests"), F.count(F.when(F.col("__bad"), 1)).alias("errors"))
        .select(
            utc_wall(F.col("w.start")).alias("window_start"),
            "requests",
            "errors",
            (F.col("errors") * 100.0 / F.col("requests")).alias("error_pct"),
        )
    )


def str_score(
    stream: DataFrame,
    model: PipelineModel,
    path: str,
    checkpoint: str,
    tags: dict[str, str] | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """New readings scored into the day-partitioned prediction table, in few files a day."""
    return start_day_sink(ml_batch_score(model, stream, tags), path, checkpoint, "pred_date", available_now=available_now)


MARKS = T.StructType([T.StructField("mark", T.TimestampNTZType())])


def _mark_path(marks: str, batch_id: int) -> str:
    return f"{marks.rstrip('/')}/mark-{batch_id}"


def _mark(spark: SparkSession, marks: str, batch_id: int) -> datetime | None:
    """The highest time of all batches up to the given one; null before the first row."""
    if batch_id < 0:
        return None
    return spark.read.schema(MARKS).parquet(_mark_path(marks, batch_id)).first()["mark"]


def str_late_quarantine(
    stream: DataFrame,
    target: str,
    late: str,
    marks: str,
    checkpoint: str,
    delay: str = "2 HOURS",
    roles: Roles = ROLES,
    available_now: bool = True,
) -> StreamingQuery:
    """Rows older than the watermark (the highest time of earlier batches minus the delay) go to a side
    table instead of being lost; all others to the target. Both are tables by day (``read_days``; rows
    without a time are in time). ``marks`` holds the highest time after the newest two batches, so a
    repeated batch splits its rows as it did the first time and replaces what it wrote."""
    data = stream.schema
    day = "reading_date"

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()  # three writes read it
        mark = _mark(spark, marks, batch_id - 1)
        ts = F.col(roles.ts)
        is_late = F.lit(False) if mark is None else F.coalesce(ts < F.lit(mark) - F.expr(f"INTERVAL {delay}"), F.lit(False))
        dated = batch.withColumn(day, F.to_date(ts))
        for path, rows in ((target, dated.where(~is_late)), (late, dated.where(is_late))):
            write_batch(rows, batch_id, path, day, roles.sensor)
            compact(spark, path, batch_id, day, roles.sensor, data, days=touched_days(spark, path, batch_id, day))
        highest = batch.agg(F.max(ts.cast("timestamp_ntz")).alias("mark"))
        highest.select(F.greatest("mark", F.lit(mark).cast("timestamp_ntz")).alias("mark")).coalesce(1).write.mode("overwrite").parquet(_mark_path(marks, batch_id))
        delete_folder(spark, _mark_path(marks, batch_id - 2))
        batch.unpersist()

    return start_batches(stream, work, checkpoint, available_now)
