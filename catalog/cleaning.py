"""Projections, cleaning and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import (
    PREDS,
    R,
    SCORED,
    SPLIT_AT,
    baseline,
    local_sql,
    newest,
    predictions,
    profile_scored,
    query,
    readings,
    table,
    with_,
)
from sensorspark.operators.clean import (
    prj_api_mapping,
    prj_calendar_parts,
    prj_class_label,
    prj_day_type,
    prj_downcast,
    prj_drop_unused,
    prj_floor_hour,
    prj_join_coords,
    prj_norm_key,
    prj_parse_ts,
    prj_regex_coords,
    prj_rename_map,
    prj_required_columns,
    prj_round_pred,
    prj_sanitize_numeric,
    prj_split_coords,
    prj_stamp_ingestion,
    prj_struct_coords,
    prj_ts_to_string,
    clean_readings,
)
from sensorspark.operators.filters import (
    flt_date_range,
    flt_high_water,
    flt_not_null_pair,
    flt_recent_ingest,
    flt_valid_coords,
    flt_valid_count,
)


@query(
    "prj_rename_map",
    """SELECT user_id AS identifiant_du_compteur, event_type AS nom_du_compteur, value AS comptage_horaire,
       ts AS date_et_heure_de_comptage, props AS url_sites, event_id FROM events""",
)
def rename_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("Identifiant du compteur"),
        F.col("event_type").alias("Nom du compteur"),
        F.col("value").alias("Comptage horaire"),
        F.col("ts").alias("Date et heure de comptage"),
        F.col("props").alias("url_sites"),
        "event_id",
    )
    return prj_rename_map(raw)


def _api(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id_compteur"),
        F.col("event_type").alias("nom_compteur"),
        F.col("value").alias("sum_counts"),
        F.col("ts").alias("date"),
        "event_id",
    )


@query(
    "prj_api_mapping",
    """SELECT user_id AS identifiant_du_compteur, event_type AS nom_du_compteur, value AS comptage_horaire,
       ts AS date_et_heure_de_comptage, event_id FROM events""",
)
def api_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prj_api_mapping(_api(spark, sf_dir))


@query("prj_drop_unused", "SELECT event_id, ts, value FROM events")
def drop_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prj_drop_unused(
        table(spark, sf_dir, "events").select(
            "event_id",
            "ts",
            "value",
            F.col("props").alias("url_sites"),
            F.col("event_type").alias("nom_du_site_de_comptage"),
            F.col("user_id").alias("identifiant_du_compteur"),
        )
    )


@query(
    "prj_required_columns",
    """SELECT value AS comptage_horaire, ts AS date_et_heure_de_comptage, user_id AS identifiant_du_compteur,
       event_type AS nom_du_compteur FROM events""",
)
def required_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prj_required_columns(prj_api_mapping(_api(spark, sf_dir)))


@query(
    "prj_parse_ts",
    "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN date_trunc('second', ts) END AS ts FROM events",
)
def parse_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    text = (
        F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
        .when(k == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(
            k == 2,
            F.concat(F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd HH:mm:ss"), F.lit("+02:00")),
        )
        .otherwise("not a time")
    )
    raw = table(spark, sf_dir, "events").select("event_id", text.alias("ts"))
    return prj_parse_ts(raw, "ts", strict=False)


PARTS = f"""SELECT *, CAST(hour(lt) AS INTEGER) AS hour, CAST(day(lt) AS INTEGER) AS day,
    CAST(month(lt) AS INTEGER) AS month, CAST(year(lt) AS INTEGER) AS year,
    CAST(isodow(lt) - 1 AS INTEGER) AS weekday FROM (SELECT *, {local_sql('reading_ts')} AS lt FROM r)"""


@query("prj_calendar_parts", with_(R, f"SELECT * EXCLUDE (lt) FROM ({PARTS})"))
def calendar_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prj_calendar_parts(readings(spark, sf_dir))


def _coords_text(sep: str):
    """Coordinates as text, built from integers only."""
    lat = F.concat(F.lit("48."), F.lpad((F.col("user_id") % 1000).cast("string"), 3, "0"))
    lon = F.concat(F.lit("2."), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"))
    return F.concat(lat, F.lit(sep), lon)


COORDS = """SELECT event_id,
    CAST('48.' || lpad(CAST(user_id % 1000 AS VARCHAR), 3, '0') AS DOUBLE) AS latitude,
    CAST('2.' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') AS DOUBLE) AS longitude FROM events"""


@query("prj_split_coords", COORDS)
def split_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select("event_id", _coords_text(", ").alias("c"))
    return prj_split_coords(raw, "c").drop("c")


@query("prj_regex_coords", COORDS)
def regex_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("POINT ("), _coords_text("  "), F.lit(")"))
    raw = table(spark, sf_dir, "events").select("event_id", text.alias("c"))
    return prj_regex_coords(raw, "c").drop("c")


@query(
    "prj_struct_coords",
    """SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(user_id AS DOUBLE) END AS latitude,
       CASE WHEN event_id % 5 <> 0 THEN value END AS longitude FROM events""",
)
def struct_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.struct(F.col("user_id").cast("double").alias("lat"), F.col("value").alias("lon"))
    raw = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 5 != 0, s).alias("coordinates")
    )
    return prj_struct_coords(raw)


@query(
    "prj_join_coords",
    """SELECT event_id, CAST(user_id AS VARCHAR) || ',' || CAST(event_id % 90 AS VARCHAR) AS coords FROM events""",
)
def join_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("latitude"), (F.col("event_id") % 90).alias("longitude")
    )
    return prj_join_coords(raw, "coords")


@query("prj_ts_to_string", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events")
def ts_to_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prj_ts_to_string(table(spark, sf_dir, "events").select("event_id", "ts"))


@query(
    "prj_sanitize_numeric",
    """SELECT event_id, CASE WHEN event_id % 5 < 4 THEN 0.0::DOUBLE ELSE value END AS value,
       CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_id FROM events""",
)
def sanitize_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    v = (
        F.when(k == 0, F.lit(float("inf")))
        .when(k == 1, F.lit(float("-inf")))
        .when(k == 2, F.lit(float("nan")))
        .when(k == 3, F.lit(None))
        .otherwise(F.col("value"))
    )
    raw = table(spark, sf_dir, "events").select(
        "event_id", v.alias("value"), F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("user_id")
    )
    return prj_sanitize_numeric(raw)


@query(
    "prj_downcast",
    """SELECT event_id, CAST(value AS FLOAT) AS latitude, CAST(value / 2 AS FLOAT) AS longitude,
       CAST(event_id % 7 AS TINYINT) AS weekday FROM events""",
)
def downcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("value").alias("latitude"),
        (F.col("value") / 2).alias("longitude"),
        (F.col("event_id") % 7).alias("weekday"),
    )
    return prj_downcast(raw)


@query(
    "prj_stamp_ingestion",
    with_(
        R,
        """SELECT *, TIMESTAMP '2024-02-01 06:00:00' AS ingestion_ts, 'rf' AS model_type,
        'v1' AS model_version FROM r""",
    ),
)
def stamp_ingestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prj_stamp_ingestion(
        readings(spark, sf_dir), "2024-02-01 06:00:00", {"model_type": "rf", "model_version": "v1"}
    )


@query(
    "prj_day_type",
    with_(
        R,
        f"""SELECT row_key, CASE WHEN isodow({local_sql('reading_ts')}) >= 6 THEN 'weekend' ELSE 'week' END
        AS day_type FROM r""",
    ),
)
def day_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prj_day_type(prj_calendar_parts(readings(spark, sf_dir))).select("row_key", "day_type")


@query("prj_norm_key", "SELECT event_id, lower(trim('  ' || upper(event_type) || ' ')) AS sensor_key FROM events")
def norm_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("  "), F.upper("event_type"), F.lit(" "))
    raw = table(spark, sf_dir, "events").select("event_id", name.alias("n"))
    return prj_norm_key(raw, "n").drop("n")


@query(
    "prj_floor_hour",
    with_(
        R,
        """SELECT row_key, date_trunc('hour', timezone('UTC', timezone('Europe/Paris', reading_ts))) AS date_hour
        FROM r""",
    ),
)
def floor_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prj_floor_hour(readings(spark, sf_dir), tz="Europe/Paris").select("row_key", "date_hour")


@query(
    "prj_round_pred",
    """SELECT event_id, CAST(round_even(floor(value * 2) / 2, 0) AS INTEGER) AS prediction FROM events""",
)
def round_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    halves = F.floor(F.col("value") * 2) / 2
    return prj_round_pred(table(spark, sf_dir, "events").select("event_id", halves.alias("prediction")))


@query(
    "prj_class_label",
    "SELECT event_id, CASE event_id % 2 WHEN 0 THEN 'faible' ELSE 'forte' END AS label FROM events",
)
def class_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 2).alias("c"))
    return prj_class_label(raw, "c").drop("c")


@query(
    "prj_clean_readings",
    f"""SELECT event_type AS nom_du_compteur, CAST(hour(lt) AS INTEGER) AS hour, CAST(day(lt) AS INTEGER) AS day,
       CAST(month(lt) AS INTEGER) AS month, CAST(year(lt) AS INTEGER) AS year,
       CAST(isodow(lt) - 1 AS TINYINT) AS weekday, value AS comptage_horaire, event_id AS row_key,
       CAST('48.' || lpad(CAST(user_id % 1000 AS VARCHAR), 3, '0') AS FLOAT) AS latitude,
       CAST('2.' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') AS FLOAT) AS longitude
       FROM (SELECT *, {local_sql('ts')} AS lt FROM events)""",
)
def whole_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("Nom du compteur"),
        F.col("user_id").alias("Identifiant du compteur"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("Date et heure de comptage"),
        F.col("value").alias("Comptage horaire"),
        _coords_text(", ").alias("Coordonnées géographiques"),
        F.col("props").alias("ID Photos"),
        F.col("event_id").alias("row_key"),
    )
    return clean_readings(raw)


@query("flt_high_water", with_(R, f"SELECT * FROM r WHERE reading_ts > (SELECT max(reading_ts) FROM r WHERE reading_ts < TIMESTAMP '{SPLIT_AT}')"))
def high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    return flt_high_water(r, baseline(r))


@query("flt_valid_count", with_(R, "SELECT row_key, count - 50 AS count FROM r WHERE count - 50 > 0"), rounds=["count"])
def valid_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flt_valid_count(readings(spark, sf_dir).select("row_key", (F.col("count") - 50).alias("count")))


RANGES = {"midnight": "<= TIMESTAMP '2024-01-17'", "day": "< TIMESTAMP '2024-01-18'", "none": "< TIMESTAMP '2024-01-17'"}


@query(
    "flt_date_range",
    with_(
        "d AS (SELECT event_id, date_trunc('hour', ts) AS reading_ts FROM events)",
        " UNION ALL ".join(
            f"SELECT *, '{k}' AS end_inclusive FROM d WHERE reading_ts >= TIMESTAMP '2024-01-10' AND reading_ts {c}"
            for k, c in RANGES.items()
        ),
    ),
)
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = prj_floor_hour(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "reading_ts").drop("ts")
    a, b, c = (
        flt_date_range(d, "2024-01-10", "2024-01-17", k).withColumn("end_inclusive", F.lit(k)) for k in RANGES
    )
    return a.unionAll(b).unionAll(c)


@query(
    "flt_not_null_pair",
    with_(
        *SCORED,
        """SELECT row_key, count, prediction FROM (SELECT row_key, nullif(row_key % 4, 0) AS x, count, prediction FROM p)
        WHERE x IS NOT NULL AND count > 20""",
    ),
    rounds=["prediction"],
)
def not_null_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile_scored(spark, sf_dir)
    holes = p.select(
        "row_key",
        F.when(F.col("count") > 20, F.col("count")).alias("count"),
        F.when(F.col("row_key") % 4 != 0, F.col("prediction")).alias("prediction"),
    )
    return flt_not_null_pair(holes, "count", "prediction")


@query(
    "flt_valid_coords",
    """SELECT event_id, user_id AS latitude, value AS longitude FROM events
       WHERE event_id % 6 <> 0 AND value < 100""",
)
def valid_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flt_valid_coords(
        table(spark, sf_dir, "events").select(
            "event_id",
            F.when(F.col("event_id") % 6 != 0, F.col("user_id")).alias("latitude"),
            F.when(F.col("value") < 100, F.col("value")).alias("longitude"),
        )
    )


@query(
    "flt_recent_ingest",
    with_(
        *PREDS,
        """SELECT * FROM preds WHERE prediction_ts >= (SELECT max(prediction_ts) FROM preds) - INTERVAL 360 MINUTE""",
    ),
    rounds=["prediction"],
)
def recent_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    return flt_recent_ingest(p, newest(p, "prediction_ts"), minutes=360, col="prediction_ts")
