"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.base import (
    M,
    PREDS,
    R,
    SCORED,
    SPLIT_AT,
    baseline,
    current,
    dated,
    models,
    newest,
    predictions,
    profile_scored,
    query,
    readings,
    table,
    with_,
)
from sensorspark.operators.split import spl_holdout
from sensorspark.schema import AUDIT
from sensorspark.session import scratch_path
from sensorspark.sources.files import (
    src_csv_readings,
    src_json_pages,
    src_wildcard_partitions,
)
from sensorspark.sources.sinks import (
    snk_append_partitioned,
    snk_audit_append,
    snk_csv_split,
    snk_replace_day,
    snk_schema_evolve,
)
from sensorspark.sources.tables import (
    src_daily_union,
    src_days,
    src_first_n,
    src_unified_view,
    src_warehouse_window,
)


@query(
    "src_csv_readings",
    with_(
        R,
        """SELECT CAST(sensor_id AS VARCHAR) AS "Nom du compteur", count,
        strftime(reading_ts, '%Y-%m-%d %H:%M:%S') AS "Date et heure de comptage"
        FROM r WHERE row_key % 9 <> 0""",
    ),
    rounds=["count"],
)
def csv_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    readings(spark, sf_dir).select(
        F.col("sensor_id").alias("Nom du compteur"),
        F.when(F.col("row_key") % 9 != 0, F.col("count")).alias("Comptage horaire"),
        F.date_format("reading_ts", "yyyy-MM-dd HH:mm:ss").alias("Date et heure de comptage"),
    ).write.csv(path, sep=";", header=True)
    return src_csv_readings(spark, path, sep=None, preserve_target=False)


@query(
    "src_json_pages",
    """SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS date, CAST(json_extract(props, '$.k') AS DOUBLE) AS sum_counts,
         CAST(user_id AS VARCHAR) AS id_compteur, event_type AS nom_compteur,
         CAST(user_id % 90 AS DOUBLE) AS lat, CAST(event_id % 180 AS DOUBLE) AS lon
       FROM events""",
)
def json_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    record = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("date"),
        F.get_json_object("props", "$.k").cast("double").alias("sum_counts"),
        F.col("user_id").cast("string").alias("id_compteur"),
        F.col("event_type").alias("nom_compteur"),
        F.struct(
            (F.col("user_id") % 90).cast("double").alias("lat"),
            (F.col("event_id") % 180).cast("double").alias("lon"),
        ).alias("coordinates"),
    )
    # A hundred records make a page; every other page wraps its records in "fields".
    pages = (
        e.select(F.floor(F.col("event_id") / 100).alias("page"), record.alias("rec"))
        .groupBy("page")
        .agg(F.collect_list("rec").alias("recs"))
    )
    bare = F.to_json(F.struct(F.size("recs").alias("total_count"), F.col("recs").alias("results")))
    wrapped = F.to_json(
        F.struct(
            F.size("recs").alias("total_count"),
            F.transform("recs", lambda r: F.struct(r.alias("fields"))).alias("results"),
        )
    )
    landed = pages.select(F.when(F.col("page") % 2 == 0, bare).otherwise(wrapped).alias("body"))
    return src_json_pages(landed, "body").select(
        "date", "sum_counts", "id_compteur", "nom_compteur", "coordinates.lat", "coordinates.lon"
    )


@query(
    "src_warehouse_window",
    with_(
        R,
        """SELECT * FROM r WHERE reading_ts >= (SELECT max(reading_ts) FROM r) - INTERVAL 48 HOUR
        ORDER BY reading_ts DESC, row_key LIMIT 500""",
    ),
)
def warehouse_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    return src_warehouse_window(
        r, newest(r), "48 HOURS", order_by=[F.desc("reading_ts"), F.col("row_key")], limit=500
    )


@query(
    "src_daily_union",
    with_(
        R,
        """SELECT sensor_id, reading_ts, count, row_key, CAST(reading_ts AS DATE) AS reading_date
        FROM r WHERE CAST(reading_ts AS DATE) < (SELECT CAST(max(reading_ts) AS DATE) FROM r)
          AND CAST(reading_ts AS DATE) >= (SELECT CAST(max(reading_ts) AS DATE) - 7 FROM r)""",
    ),
)
def daily_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = dated(readings(spark, sf_dir))
    return src_daily_union(r, newest(r))


@query(
    "src_wildcard_partitions",
    with_(
        *SCORED,
        """SELECT sensor_id, reading_ts, count, row_key, prediction, CAST(reading_ts AS DATE) AS pred_date
        FROM p WHERE reading_ts >= TIMESTAMP '2024-01-25'""",
    ),
    rounds=["prediction"],
)
def wildcard_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "daily")
    scored = profile_scored(spark, sf_dir).withColumn("pred_date", F.to_date("reading_ts"))
    snk_replace_day(scored, path)
    return src_wildcard_partitions(spark, path, "2024-01-25")


@query(
    "src_days",
    with_(
        R,
        "rd AS (SELECT *, CAST(reading_ts AS DATE) AS reading_date FROM r)",
        "SELECT * FROM rd WHERE reading_date IN (SELECT reading_date FROM rd GROUP BY 1 HAVING max(count) >= (SELECT max(count) - 2 FROM r))",
    ),
)
def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days that saw the highest counts, from a table by day."""
    r = dated(readings(spark, sf_dir))
    path = scratch_path(spark, "by-day")
    snk_append_partitioned(r, path)
    highest = r.agg(F.max("count")).first()[0]
    named = r.groupBy("reading_date").agg(F.max("count").alias("most")).where(F.col("most") >= (highest or 0) - 2)
    return src_days(spark.read.parquet(path), named).select(*r.columns)


@query(
    "src_unified_view",
    with_(
        R,
        f"""SELECT sensor_id, reading_ts, count, row_key, CAST(NULL AS VARCHAR) AS origin
        FROM r WHERE reading_ts <= TIMESTAMP '{SPLIT_AT}'
        UNION ALL SELECT sensor_id, reading_ts, count, row_key, 'live' FROM r
        WHERE reading_ts > TIMESTAMP '{SPLIT_AT}'""",
    ),
)
def unified_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    return src_unified_view(r, r.withColumn("origin", F.lit("live")), SPLIT_AT)


@query("src_first_n", with_(R, "SELECT * FROM r ORDER BY reading_ts, row_key LIMIT 1000"))
def first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src_first_n(readings(spark, sf_dir), 1000, ["reading_ts", "row_key"])


@query(
    "snk_append_partitioned",
    with_(
        R,
        "SELECT sensor_id, reading_ts, count, row_key, CAST(reading_ts AS DATE) AS reading_date FROM r",
    ),
)
def append_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "readings")
    r = dated(readings(spark, sf_dir))
    snk_append_partitioned(baseline(r), path)
    snk_append_partitioned(current(r), path)
    return spark.read.parquet(path).select(*r.columns)


@query(
    "snk_replace_day",
    with_(
        *PREDS,
        """SELECT sensor_id, reading_ts, model_version, prediction, prediction_ts,
             CAST(reading_ts AS DATE) AS pred_date FROM preds
           WHERE model_version = CASE WHEN reading_ts < TIMESTAMP '2024-01-26' THEN 'v1' ELSE 'v2' END""",
    ),
    rounds=["prediction"],
)
def replace_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "predictions")
    p = predictions(spark, sf_dir).withColumn("pred_date", F.to_date("reading_ts"))
    snk_replace_day(p.where("model_version = 'v1'"), path)
    snk_replace_day(p.where("model_version = 'v2' AND pred_date >= DATE'2024-01-26'"), path)
    return spark.read.parquet(path).select(*p.columns)


AUDIT_SQL = """SELECT timestamp, drift_detected, CASE WHEN rmse <> 0 THEN rmse ELSE 999.0::DOUBLE END AS rmse, r2,
    false AS fine_tune_triggered, false AS fine_tune_success, 0.0::DOUBLE AS model_improvement,
    'prod' AS env, '' AS error_message, false AS double_evaluation_enabled, false AS baseline_regression,
    r2_baseline, r2_current, r2_train, 'not_triggered' AS deployment_decision, champion_r2_baseline,
    '' AS model_uri, CAST(run_id AS VARCHAR) AS run_id FROM m"""


@query("snk_audit_append", with_(M, AUDIT_SQL))
def audit_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "audit")
    snk_audit_append(models(spark, sf_dir).withColumn("env", F.lit("prod")), path)
    return spark.read.schema(AUDIT).parquet(path)


@query(
    "snk_schema_evolve",
    with_(
        M,
        """SELECT timestamp, r2, k, CAST(NULL AS DOUBLE) AS champion_r2_baseline,
        CAST(NULL AS BOOLEAN) AS baseline_regression FROM m""",
    ),
)
def schema_evolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = models(spark, sf_dir).select("timestamp", "r2", "k")
    wanted = T.StructType(
        [f for f in AUDIT.fields if f.name in ("timestamp", "r2", "champion_r2_baseline", "baseline_regression")]
    )
    return snk_schema_evolve(old, wanted)


@query(
    "snk_csv_split",
    with_(
        R,
        """SELECT CAST(row_key AS VARCHAR) AS row_key,
        CASE WHEN substr(md5(CAST(row_key AS VARCHAR)), 1, 4) < 'cccd' THEN 'train' ELSE 'test' END AS part FROM r""",
    ),
)
def csv_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "split")
    train, test, *_ = spl_holdout(readings(spark, sf_dir), key="row_key")
    snk_csv_split(train, test, path, "1")
    back = [
        spark.read.csv(f"{path}/split_id=1/{part}", sep=";", header=True).select(
            "row_key", F.lit(part).alias("part")
        )
        for part in ("train", "test")
    ]
    return back[0].unionAll(back[1])


