"""Two-sample tests, match quality and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import (
    BASE,
    CUR,
    R,
    RT,
    SPLIT_AT,
    SRC_A,
    SRC_B,
    baseline,
    current,
    query,
    readings,
    source_a,
    source_b,
    table,
    typed_readings,
    with_,
)
from catalog.relations import KNOWN, PAIRS, keyed_sources, known_sensors
from sensorspark.operators.combine import set_key_overlap
from sensorspark.operators.drift import (
    categorical_drift,
    drf_column_drift,
    drf_dataset_drift,
    drf_schema_drift,
    drf_unknown_keys,
    numeric_drift,
)
from sensorspark.operators.joins import jn_source_match
from sensorspark.operators.stats import (
    match_paired_t,
    quality_checks,
    stat_ks_2samp,
    stat_mannwhitney,
    stat_match_quality,
    stat_paired_t,
    stat_quality_score,
)


def view_click(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rt = typed_readings(spark, sf_dir)
    return source_a(rt), source_b(rt)


# Both distribution functions at each distinct value.
CDF = (
    "v AS (SELECT count AS x, count(*) FILTER (source = 'view') AS a, count(*) FILTER (source <> 'view') AS b FROM rt GROUP BY 1)",
    "w AS (SELECT x, a, b, sum(a) OVER (ORDER BY x) AS ca, sum(b) OVER (ORDER BY x) AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM v)",
)
KS = """ks AS (SELECT CAST(max(na) AS BIGINT) AS n_a, CAST(max(nb) AS BIGINT) AS n_b,
    max(abs(ca / na::DOUBLE - cb / nb::DOUBLE)) AS statistic FROM w)"""
KS_P = """least(1.0::DOUBLE, greatest(0.0::DOUBLE, 2 * list_sum(list_transform(range(1, 21),
    lambda j: (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0::DOUBLE * j * j * statistic * statistic * n_a * n_b / (n_a + n_b))))))"""


@query(
    "stat_ks_2samp",
    with_(RT, *CDF, KS, f"SELECT *, {KS_P} AS p_value, {KS_P} > 0.05 AS passed FROM ks"),
    rounds=["statistic", "p_value"],
)
def ks_2samp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stat_ks_2samp(*view_click(spark, sf_dir), "count")


MW = """mw AS (SELECT CAST(max(na) AS BIGINT) AS n_a, CAST(max(nb) AS BIGINT) AS n_b,
      CAST(sum(a * (cb - b + b / 2.0::DOUBLE)) AS DOUBLE) AS u,
      CAST(sum((a + b)::DOUBLE * (a + b) * (a + b) - (a + b)) AS DOUBLE) AS ties FROM w),
    mz AS (SELECT n_a, n_b, u, (greatest(u, n_a::DOUBLE * n_b - u) - n_a::DOUBLE * n_b / 2 - 0.5::DOUBLE)
      / sqrt(n_a::DOUBLE * n_b / 12 * ((n_a + n_b + 1) - ties / ((n_a + n_b)::DOUBLE * (n_a + n_b - 1)))) AS z FROM mw)"""


@query(
    "stat_mannwhitney",
    with_(RT, *CDF, MW, "SELECT *, abs(z) < 1.959963984540054::DOUBLE AS passed FROM mz"),
    rounds=["u", "z"],
)
def mannwhitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The p-value has no SQL form; tests check it. Its verdict at 5 % is the same as |z| < 1.96.
    return stat_mannwhitney(*view_click(spark, sf_dir), "count").drop("p_value")


# 1.963 is where the t distribution with about 1000 degrees of freedom has 5 % in both tails; t is far
# from it at every scale.
@query(
    "stat_paired_t",
    with_(
        R,
        "d AS (SELECT count - (row_key % 97) AS x FROM r)",
        """SELECT count(*) AS n_pairs, avg(x) AS mean_difference, avg(x) / (stddev_samp(x) / sqrt(count(*))) AS t,
        abs(avg(x) / (stddev_samp(x) / sqrt(count(*)))) < 1.963::DOUBLE AS passed FROM d""",
    ),
    rounds=["mean_difference", "t"],
)
def paired_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = readings(spark, sf_dir).select(
        F.col("count").alias("count_a"), (F.col("row_key") % 97).alias("count_b")
    )
    return stat_paired_t(pairs).drop("p_value")


@query(
    "stat_paired_t_matched",
    with_(
        *PAIRS,
        """SELECT count(*) AS n_pairs, avg(count_a - count_b) AS mean_difference,
        avg(count_a - count_b) / (stddev_samp(count_a - count_b) / sqrt(count(*))) AS t FROM pr""",
    ),
    rounds=["mean_difference", "t"],
)
def paired_t_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = keyed_sources(spark, sf_dir)
    return match_paired_t(jn_source_match(a, b)).drop("p_value", "passed")


QUALITY = """mq AS (SELECT count(*) AS n_pairs, corr(count_a, count_b) AS pearson_r, avg(abs(count_a - count_b)) AS mae,
    avg(abs(count_a - count_b) / nullif(count_a, 0) * 100) AS mape FROM {pairs})"""
BAND = "CASE WHEN pearson_r > 0.9 THEN 'excellent' WHEN pearson_r > 0.7 THEN 'good' WHEN pearson_r > 0.5 THEN 'moderate' ELSE 'poor' END AS band"


@query(
    "stat_match_quality",
    with_(*PAIRS, QUALITY.format(pairs="pr"), f"SELECT *, {BAND} FROM mq"),
    rounds=["pearson_r", "mae", "mape"],
)
def match_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stat_match_quality(*keyed_sources(spark, sf_dir))


def suppliers_by_day(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Deliveries of two kinds, keyed by supplier and day."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("sensor_key"),
        F.col("l_shipdate").alias("date_hour"),
        F.col("l_quantity").alias("count"),
        "l_returnflag",
    )
    return li.where("l_returnflag = 'A'").drop("l_returnflag"), li.where("l_returnflag <> 'A'").drop("l_returnflag")


@query(
    "stat_match_quality_deliveries",
    with_(
        """pd AS (SELECT x.l_quantity AS count_a, y.l_quantity AS count_b FROM lineitem x JOIN lineitem y
           ON x.l_suppkey = y.l_suppkey AND x.l_shipdate = y.l_shipdate
           WHERE x.l_returnflag = 'A' AND y.l_returnflag <> 'A')""",
        QUALITY.format(pairs="pd"),
        f"SELECT *, {BAND} FROM mq",
    ),
    rounds=["pearson_r", "mae", "mape"],
)
def match_quality_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stat_match_quality(*suppliers_by_day(spark, sf_dir))


@query(
    "stat_quality_score",
    with_(
        RT,
        SRC_A,
        SRC_B,
        *CDF,
        KS,
        MW,
        "ka AS (SELECT lower(trim(CAST(sensor_id AS VARCHAR))) AS sensor_key, date_trunc('hour', reading_ts) AS date_hour, count FROM a)",
        "kb AS (SELECT lower(trim(CAST(sensor_id AS VARCHAR))) AS sensor_key, date_trunc('hour', reading_ts) AS date_hour, count FROM b)",
        PAIRS[-1],
        """checks AS (SELECT (SELECT """
        + KS_P
        + """ > 0.05 FROM ks) AS passed
          UNION ALL SELECT (SELECT abs(z) < 1.959963984540054::DOUBLE FROM mz)
          UNION ALL SELECT (SELECT count(DISTINCT sensor_id) FROM a WHERE sensor_id IN (SELECT sensor_id FROM b)) * 100.0::DOUBLE
            / (SELECT count(DISTINCT sensor_id) FROM a) > 80
          UNION ALL SELECT corr(count_a, count_b) > 0.7 FROM pr HAVING count(*) > 0)""",
        "t AS (SELECT count(*) FILTER (passed) AS passed_checks, count(*) AS total_checks FROM checks)",
        """SELECT *, passed_checks * 100.0::DOUBLE / total_checks AS score_pct,
        CASE WHEN passed_checks >= total_checks * 0.75 THEN 'trustworthy' WHEN passed_checks >= total_checks * 0.5 THEN 'investigate'
        ELSE 'not_recommended' END AS recommendation FROM t""",
    ),
    rounds=["score_pct"],
)
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = view_click(spark, sf_dir)
    checks = quality_checks(
        stat_ks_2samp(a, b, "count"),
        stat_mannwhitney(a, b, "count"),
        set_key_overlap(a, b),
        stat_match_quality(*keyed_sources(spark, sf_dir)),
    )
    return stat_quality_score(checks)


def drift_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events before and from the split date, the later ones shifted in two columns."""
    e = table(spark, sf_dir, "events").withColumnRenamed("ts", "reading_ts")
    late = F.col("reading_ts") >= F.lit(SPLIT_AT).cast("timestamp_ntz")
    e = e.select(
        "reading_ts",
        F.col("value").alias("count"),
        F.when(late, F.col("value") + F.col("user_id") % 50).otherwise(F.col("value")).alias("shifted"),
        F.col("event_type").alias("kind"),
        F.when(late & (F.col("event_id") % 3 == 0), "view").otherwise(F.col("event_type")).alias("mixed"),
    )
    return baseline(e).drop("reading_ts"), current(e).drop("reading_ts")


D = f"""d0 AS (SELECT *, ts >= TIMESTAMP '{SPLIT_AT}' AS late FROM events),
  d AS (SELECT late, value AS count, CASE WHEN late THEN value + user_id % 50 ELSE value END AS shifted,
      event_type AS kind, CASE WHEN late AND event_id % 3 = 0 THEN 'view' ELSE event_type END AS mixed FROM d0),
  nl AS (SELECT 'count' AS "column", late, count AS x FROM d UNION ALL SELECT 'shifted', late, shifted FROM d),
  nv AS (SELECT "column", x, count(*) FILTER (NOT late) AS a, count(*) FILTER (late) AS b FROM nl GROUP BY ALL),
  nw AS (SELECT "column", x, a, b, lag(x) OVER o AS px, sum(a) OVER o AS ca, sum(b) OVER o AS cb,
      sum(a) OVER (PARTITION BY "column") AS na, sum(b) OVER (PARTITION BY "column") AS nb
      FROM nv WINDOW o AS (PARTITION BY "column" ORDER BY x)),
  sd AS (SELECT "column", stddev_pop(x) AS sd FROM nl WHERE NOT late GROUP BY 1),
  num AS (SELECT "column", CAST(max(na) AS BIGINT) AS n_reference, CAST(max(nb) AS BIGINT) AS n_current,
      max(abs(ca / na::DOUBLE - cb / nb::DOUBLE)) AS ks,
      coalesce(sum(abs((ca - a) / na::DOUBLE - (cb - b) / nb::DOUBLE) * (x - px)), 0) / max(greatest(sd, 0.001::DOUBLE)) AS wasserstein
      FROM nw JOIN sd USING ("column") GROUP BY "column"),
  cl AS (SELECT 'kind' AS "column", late, kind AS x FROM d UNION ALL SELECT 'mixed', late, mixed FROM d),
  cv AS (SELECT "column", x, count(*) FILTER (NOT late)::DOUBLE AS a, count(*) FILTER (late)::DOUBLE AS b FROM cl GROUP BY ALL),
  ct AS (SELECT *, sum(a) OVER (PARTITION BY "column") AS na, sum(b) OVER (PARTITION BY "column") AS nb FROM cv),
  cp AS (SELECT *, a / na AS pa, b / nb AS pb, (a / na + b / nb) / 2 AS pm,
      (a + b) * na / (na + nb) AS ea, (a + b) * nb / (na + nb) AS eb FROM ct),
  cat AS (SELECT "column", CAST(max(na) AS BIGINT) AS n_reference, CAST(max(nb) AS BIGINT) AS n_current,
      sum((a - ea) * (a - ea) / ea + (b - eb) * (b - eb) / eb) AS chi_square,
      sqrt(greatest(sum(CASE WHEN pa > 0 THEN pa * log2(pa / pm) ELSE 0 END + CASE WHEN pb > 0 THEN pb * log2(pb / pm) ELSE 0 END) / 2, 0)) AS jensen_shannon,
      sum((greatest(pb, 0.0001::DOUBLE) - greatest(pa, 0.0001::DOUBLE)) * ln(greatest(pb, 0.0001::DOUBLE) / greatest(pa, 0.0001::DOUBLE))) AS psi
      FROM cp GROUP BY "column")"""


@query(
    "drf_numeric",
    with_(D, f"""SELECT *, {KS_P.replace('statistic', 'ks').replace('n_a', 'n_reference').replace('n_b', 'n_current')} AS ks_p FROM num"""),
    rounds=["ks", "wasserstein", "ks_p"],
)
def drift_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numeric_drift(*drift_sides(spark, sf_dir), ["count", "shifted"])


@query("drf_categorical", with_(D, "SELECT * FROM cat"), rounds=["chi_square", "jensen_shannon", "psi"])
def drift_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categorical_drift(*drift_sides(spark, sf_dir), ["kind", "mixed"]).drop("chi_square_p")


JUDGED = """j AS (SELECT "column", 'numeric' AS kind, 'wasserstein' AS method, wasserstein AS score, 0.1::DOUBLE AS threshold,
      wasserstein >= 0.1 AS drifted, n_reference, n_current FROM num
    UNION ALL SELECT "column", 'categorical', 'jensen_shannon', jensen_shannon, 0.1::DOUBLE, jensen_shannon >= 0.1, n_reference, n_current FROM cat)"""


@query("drf_column_drift", with_(D, JUDGED, "SELECT * FROM j"), rounds=["score"])
def column_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drf_column_drift(*drift_sides(spark, sf_dir))


@query(
    "drf_dataset_drift",
    with_(
        D,
        JUDGED,
        """SELECT avg(CASE WHEN drifted THEN 1 ELSE 0 END) AS drift_share,
        list("column" ORDER BY "column") FILTER (drifted) AS drifted_features, count(*) AS total_features,
        max(n_reference) AS reference_size, max(n_current) AS current_size,
        avg(CASE WHEN drifted THEN 1 ELSE 0 END) >= 0.5 AS drift_detected, false AS schema_drift, 'ok' AS drift_status FROM j""",
    ),
    rounds=["drift_share"],
)
def dataset_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drf_dataset_drift(drf_column_drift(*drift_sides(spark, sf_dir)))


@query(
    "drf_schema_drift",
    with_(
        R,
        BASE,
        CUR,
        """SELECT 1.0::DOUBLE AS drift_share, CAST([] AS VARCHAR[]) AS drifted_features, CAST(0 AS BIGINT) AS total_features,
        (SELECT count(*) FROM base) AS reference_size, (SELECT count(*) FROM cur) AS current_size,
        true AS drift_detected, true AS schema_drift, 'ok' AS drift_status""",
    ),
)
def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    renamed = current(r).select(F.col("count").alias("comptage"), F.col("sensor_id").alias("compteur"))
    return drf_schema_drift(baseline(r), renamed)


@query(
    "drf_unknown_keys",
    with_(
        R,
        CUR,
        KNOWN,
        """SELECT TIMESTAMP '2024-02-01 00:00:00' AS event_ts, 'rf' AS model_type, sensor_id AS unknown_sensor,
        count(*) AS n_rows, count(*)::DOUBLE / (SELECT count(*) FROM cur) AS share,
        (SELECT min(sensor_id) FROM known) AS fallback_sensor
        FROM cur WHERE sensor_id NOT IN (SELECT sensor_id FROM known) GROUP BY sensor_id""",
    ),
    rounds=["share"],
)
def unknown_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    return drf_unknown_keys(current(r), known_sensors(r), "rf", "2024-02-01 00:00:00")


