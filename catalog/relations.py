"""Joins and ranked results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import (
    BASE,
    CUR,
    PREDS,
    R,
    RT,
    RUNS,
    S,
    SPLIT_AT,
    SRC_A,
    SRC_B,
    baseline,
    current,
    dated,
    newest,
    predictions,
    query,
    readings,
    runs,
    shipments,
    source_a,
    source_b,
    typed_readings,
    with_,
)
from sensorspark.session import scratch_path
from sensorspark.sources.sinks import snk_bucketed
from sensorspark.operators.clean import prj_floor_hour, prj_norm_key
from sensorspark.operators.joins import (
    jn_dedup_merge,
    jn_known_semi,
    jn_pred_actual,
    jn_remainder,
    jn_source_match,
    jn_unknown_anti,
    jn_unknown_fallback,
    match_rate,
    unknown_summary,
)
from sensorspark.operators.ranking import (
    win_group_threshold,
    win_last_n_sorted,
    win_latest_prediction,
    win_latest_success,
    win_peak_per_sensor,
    win_per_day_limit,
    win_top_peaks,
    win_top_sensors,
    win_top_with_membership,
)

WEEK = "(SELECT max(reading_ts) FROM r) - INTERVAL 7 DAY"


@query(
    "jn_pred_actual",
    with_(
        *PREDS,
        f"""SELECT sensor_id, reading_ts, preds.prediction, model_version, prediction_ts, r.count, count(*) AS n_rows
        FROM preds JOIN r USING (sensor_id, reading_ts)
        WHERE reading_ts >= {WEEK} GROUP BY ALL""",
    ),
    rounds=["prediction"],
)
def pred_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    return jn_pred_actual(predictions(spark, sf_dir), r, newest(r))


@query(
    "jn_pred_actual_bucketed",
    with_(
        *PREDS,
        f"""SELECT sensor_id, reading_ts, preds.prediction, model_version, prediction_ts, r.count, count(*) AS n_rows
        FROM preds JOIN r USING (sensor_id, reading_ts)
        WHERE reading_ts >= {WEEK} GROUP BY ALL""",
    ),
    rounds=["prediction"],
)
def pred_actual_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides from bucketed tables: nothing is shuffled."""
    r = readings(spark, sf_dir)
    sides = []
    for name, df in (("predictions", predictions(spark, sf_dir)), ("readings", r)):
        path = scratch_path(spark, name)
        sides.append(snk_bucketed(df, "bucketed_" + path.rsplit("-", 1)[1], path, buckets=16))
    return jn_pred_actual(*sides, newest(r))


@query(
    "jn_pred_actual_latest",
    with_(
        *PREDS,
        f"""SELECT sensor_id, reading_ts, max(preds.prediction) AS prediction, 'v2' AS model_version,
        max(prediction_ts) AS prediction_ts, r.count, CAST(1 AS BIGINT) AS n_rows
        FROM preds JOIN r USING (sensor_id, reading_ts)
        WHERE reading_ts >= {WEEK} GROUP BY sensor_id, reading_ts, r.count""",
    ),
    rounds=["prediction"],
)
def pred_actual_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    return jn_pred_actual(predictions(spark, sf_dir), r, newest(r), latest_only=True)


def keyed(df: DataFrame) -> DataFrame:
    return prj_floor_hour(prj_norm_key(df, "sensor_id"))


KEYED_A = "ka AS (SELECT lower(trim(CAST(sensor_id AS VARCHAR))) AS sensor_key, date_trunc('hour', reading_ts) AS date_hour, count FROM a)"
KEYED_B = "kb AS (SELECT lower(trim(CAST(sensor_id AS VARCHAR))) AS sensor_key, date_trunc('hour', reading_ts) AS date_hour, count FROM b)"
MATCHED = (RT, SRC_A, SRC_B, KEYED_A, KEYED_B)
PAIRS = (
    *MATCHED,
    """pr AS (SELECT ka.sensor_key, ka.date_hour, ka.count AS count_a, kb.count AS count_b
       FROM ka JOIN kb ON ka.sensor_key = kb.sensor_key AND ka.date_hour = kb.date_hour)""",
)


def keyed_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rt = typed_readings(spark, sf_dir)
    return keyed(source_a(rt)), keyed(source_b(rt))


@query(
    "jn_source_match",
    with_(*PAIRS, "SELECT sensor_key, date_hour, count(*) AS pairs, sum(count_a) AS pair_sum_a FROM pr GROUP BY ALL"),
    rounds=["pair_sum_a"],
)
def source_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = keyed_sources(spark, sf_dir)
    m = jn_source_match(a, b)
    return m.select("sensor_key", "date_hour", "pairs", (F.col("sum_a") * F.col("n_b")).alias("pair_sum_a"))


@query(
    "jn_source_match_rate",
    with_(
        *PAIRS,
        """SELECT (SELECT count(*) FROM a) AS rows_a, (SELECT count(*) FROM b) AS rows_b,
        (SELECT count(*) FROM pr) AS matched,
        (SELECT count(*) FROM pr) * 100.0::DOUBLE / least((SELECT count(*) FROM a), (SELECT count(*) FROM b)) AS match_rate""",
    ),
    rounds=["match_rate"],
)
def source_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = keyed_sources(spark, sf_dir)
    return match_rate(jn_source_match(a, b), a, b)


def known_sensors(df: DataFrame) -> DataFrame:
    """Sensors with a high early reading count as known."""
    return baseline(df).where(F.col("count") > 120).select("sensor_id")


KNOWN = f"known AS (SELECT DISTINCT sensor_id FROM r WHERE reading_ts < TIMESTAMP '{SPLIT_AT}' AND count > 120)"


@query("jn_known_semi", with_(R, KNOWN, "SELECT * FROM r WHERE sensor_id IN (SELECT sensor_id FROM known)"))
def known_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    return jn_known_semi(r, known_sensors(r))


@query("jn_known_semi_prefilter", with_(R, KNOWN, "SELECT * FROM r WHERE sensor_id IN (SELECT sensor_id FROM known)"))
def known_semi_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    return jn_known_semi(r, known_sensors(r), prefilter=True)


@query(
    "jn_unknown_anti",
    with_(
        R,
        KNOWN,
        """SELECT sensor_id, count(*) AS n_rows, count(*)::DOUBLE / (SELECT count(*) FROM r) AS share
        FROM r WHERE sensor_id NOT IN (SELECT sensor_id FROM known) GROUP BY sensor_id""",
    ),
    rounds=["share"],
)
def unknown_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    return jn_unknown_anti(r, known_sensors(r))


@query(
    "jn_unknown_summary",
    with_(
        R,
        KNOWN,
        """SELECT count(*) AS unknown_rows, count(DISTINCT sensor_id) AS unknown_sensors,
        count(*)::DOUBLE / (SELECT count(*) FROM r) AS unknown_share
        FROM r WHERE sensor_id NOT IN (SELECT sensor_id FROM known)""",
    ),
    rounds=["unknown_share"],
)
def unknown_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    return unknown_summary(r, known_sensors(r))


@query(
    "jn_unknown_fallback",
    with_(
        R,
        KNOWN,
        """SELECT CASE WHEN sensor_id IN (SELECT sensor_id FROM known) THEN sensor_id
        ELSE (SELECT min(sensor_id) FROM known) END AS sensor_id, reading_ts, count, row_key,
        sensor_id NOT IN (SELECT sensor_id FROM known) AS was_unknown FROM r""",
    ),
)
def unknown_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    return jn_unknown_fallback(r, known_sensors(r))


@query("jn_remainder", with_(R, "SELECT * FROM r WHERE row_key NOT IN (SELECT row_key FROM r WHERE count > 40)"))
def remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    return jn_remainder(r, r.where(F.col("count") > 40), "row_key")


@query(
    "jn_dedup_merge",
    with_(
        S,
        """SELECT sensor_id, reading_ts, min(count) AS count FROM s
        WHERE (sensor_id, reading_ts) NOT IN (SELECT (sensor_id, reading_ts) FROM s WHERE count < 20)
        GROUP BY sensor_id, reading_ts""",
    ),
)
def dedup_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shipments(spark, sf_dir).select("sensor_id", "reading_ts", "count")
    return jn_dedup_merge(s, s.where(F.col("count") < 20))


def _threshold_sql(fn: str) -> str:
    return with_(
        R,
        f"""SELECT r.*, t AS threshold, CASE WHEN count > t THEN 1 ELSE 0 END AS affluence
        FROM r JOIN (SELECT sensor_id, {fn}(count) AS t FROM r GROUP BY sensor_id) USING (sensor_id)""",
    )


@query("win_group_threshold", _threshold_sql("avg"), rounds=["threshold"])
def group_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win_group_threshold(readings(spark, sf_dir), "mean")


@query("win_group_threshold_median", _threshold_sql("median"), rounds=["threshold"])
def group_threshold_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win_group_threshold(readings(spark, sf_dir), "median")


PEAKS = """pk AS (SELECT sensor_id, m AS peak_value, reading_ts AS peak_ts FROM (
    SELECT sensor_id, reading_ts, avg(count) AS m,
      row_number() OVER (PARTITION BY sensor_id ORDER BY avg(count) DESC, reading_ts) AS rn
    FROM s GROUP BY sensor_id, reading_ts) WHERE rn = 1)"""


@query("win_peak_per_sensor", with_(S, PEAKS, "SELECT * FROM pk"), rounds=["peak_value"])
def peak_per_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win_peak_per_sensor(shipments(spark, sf_dir))


@query(
    "win_top_peaks",
    with_(
        R,
        PEAKS.replace("FROM s ", "FROM r "),
        """SELECT *, strftime(peak_ts, '%Y-%m-%d %H:%M') AS peak_at FROM pk
        ORDER BY peak_value DESC, sensor_id LIMIT 20""",
    ),
    rounds=["peak_value"],
)
def top_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win_top_peaks(readings(spark, sf_dir))


@query(
    "win_top_sensors",
    with_(R, "SELECT sensor_id, sum(count) AS total FROM r GROUP BY sensor_id ORDER BY total DESC, sensor_id LIMIT 10"),
    rounds=["total"],
)
def top_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win_top_sensors(readings(spark, sf_dir), 10)


@query(
    "win_top_with_membership",
    with_(
        R,
        BASE,
        CUR,
        """SELECT sensor_id, count(*) AS n_rows, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM base) AS pct,
        sensor_id IN (SELECT sensor_id FROM cur) AS in_other
        FROM base GROUP BY sensor_id ORDER BY n_rows DESC, sensor_id LIMIT 10""",
    ),
    rounds=["pct"],
)
def top_with_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    return win_top_with_membership(baseline(r), current(r))


@query("win_last_n_sorted", with_(R, "SELECT * FROM r ORDER BY reading_ts DESC, row_key LIMIT 500"))
def last_n_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win_last_n_sorted(readings(spark, sf_dir), 500, key=["row_key"])


@query(
    "win_per_day_limit",
    with_(
        S,
        """SELECT *, CAST(reading_ts AS DATE) AS reading_date FROM s
        QUALIFY row_number() OVER (PARTITION BY CAST(reading_ts AS DATE)
          ORDER BY count DESC, l_orderkey, l_linenumber, sensor_id) <= 3""",
    ),
)
def per_day_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("count"), "l_orderkey", "l_linenumber", "sensor_id"]
    return win_per_day_limit(dated(shipments(spark, sf_dir)), 3, order_by=order)


@query(
    "win_latest_success",
    with_(
        RUNS,
        """SELECT * FROM runs WHERE state = 'success'
        QUALIFY row_number() OVER (PARTITION BY pipeline_id ORDER BY start_ts DESC, run_id DESC, end_ts DESC) = 1""",
    ),
)
def latest_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win_latest_success(runs(spark, sf_dir))


@query(
    "win_latest_prediction",
    with_(
        *PREDS,
        """SELECT * FROM preds
        QUALIFY row_number() OVER (PARTITION BY sensor_id, reading_ts ORDER BY prediction_ts DESC) = 1""",
    ),
    rounds=["prediction"],
)
def latest_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return win_latest_prediction(predictions(spark, sf_dir))
