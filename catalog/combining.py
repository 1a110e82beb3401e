"""Sets, combination, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import (
    BASE,
    CUR,
    R,
    S,
    SRC_A,
    SRC_B,
    baseline,
    current,
    query,
    readings,
    shipments,
    source_a,
    source_b,
    typed_readings,
    with_,
)
from sensorspark.operators.combine import (
    set_concat_align,
    set_key_overlap,
    set_new_keys,
    set_quarter_merge,
    set_union_history,
)
from sensorspark.operators.ranking import win_group_threshold
from sensorspark.operators.split import (
    spl_holdout,
    spl_label_stratified,
    spl_random_sample,
    spl_stratified,
    spl_stratified_sample,
    spl_temporal,
    spl_verify_iso,
)


def two_networks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every reading in one of two networks: a third of the sensors is in the first only, a third in
    the second only, the others are in both by source."""
    rt = typed_readings(spark, sf_dir)
    first = F.expr(FIRST_NETWORK)
    return rt.where(first), rt.where(~first)


FIRST_NETWORK = "sensor_id % 3 = 0 OR (sensor_id % 3 = 1 AND source = 'view')"
NETWORKS = (
    "rt AS (SELECT user_id AS sensor_id, event_type AS source FROM events)",
    f"a AS (SELECT * FROM rt WHERE {FIRST_NETWORK})",
    f"b AS (SELECT * FROM rt WHERE NOT ({FIRST_NETWORK}))",
    "ka AS (SELECT DISTINCT sensor_id FROM a)",
    "kb AS (SELECT DISTINCT sensor_id FROM b)",
)


@query(
    "set_key_overlap",
    with_(
        *NETWORKS,
        """SELECT count(ka.sensor_id) AS keys_a, count(kb.sensor_id) AS keys_b,
        count(*) FILTER (ka.sensor_id IS NOT NULL AND kb.sensor_id IS NOT NULL) AS common,
        count(*) FILTER (kb.sensor_id IS NULL) AS only_a, count(*) FILTER (ka.sensor_id IS NULL) AS only_b,
        count(*) FILTER (ka.sensor_id IS NOT NULL AND kb.sensor_id IS NOT NULL) * 100.0::DOUBLE / count(ka.sensor_id) AS common_pct_of_a
        FROM ka FULL JOIN kb ON ka.sensor_id = kb.sensor_id""",
    ),
    rounds=["common_pct_of_a"],
)
def key_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_key_overlap(*two_networks(spark, sf_dir))


@query(
    "set_new_keys",
    with_(
        *NETWORKS,
        """SELECT sensor_id, count(*) AS n_rows, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM b) AS pct
        FROM b WHERE sensor_id NOT IN (SELECT sensor_id FROM ka) GROUP BY sensor_id""",
    ),
    rounds=["pct"],
)
def new_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = two_networks(spark, sf_dir)
    return set_new_keys(b, a)


@query(
    "set_concat_align",
    with_(
        R,
        BASE,
        CUR,
        """SELECT sensor_id AS nom_du_compteur, count AS comptage_horaire, row_key AS row_key,
        CAST(NULL AS TIMESTAMP) AS ingestion_ts FROM base
        UNION ALL SELECT sensor_id, count, row_key, reading_ts FROM cur""",
    ),
)
def concat_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    old = baseline(r).select(
        F.col("sensor_id").alias("Nom du compteur"), F.col("count").alias("Comptage horaire"), "row_key"
    )
    new = current(r).select(
        F.col("sensor_id").alias("nom_du_compteur"),
        F.col("count").alias("comptage_horaire"),
        "row_key",
        F.col("reading_ts").alias("ingestion_ts"),
    )
    return set_concat_align(old, new)


@query("set_union_history", with_(R, "SELECT *, CAST(NULL AS VARCHAR) AS source FROM r UNION ALL SELECT * FROM (SELECT user_id, ts, value, event_id, event_type FROM events)"))
def union_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_union_history(readings(spark, sf_dir), typed_readings(spark, sf_dir))


@query(
    "set_quarter_merge",
    with_(
        S,
        """SELECT sensor_id, reading_ts, coalesce(min(count) FILTER (count < 20), min(count)) AS count
        FROM s GROUP BY sensor_id, reading_ts""",
    ),
)
def quarter_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shipments(spark, sf_dir).select("sensor_id", "reading_ts", "count")
    return set_quarter_merge(s.where(F.col("count") < 20), s)


def both_parts(parts: tuple[DataFrame, DataFrame], *cols: str) -> DataFrame:
    train, test = parts
    return train.select(*cols, F.lit("train").alias("part")).unionAll(
        test.select(*cols, F.lit("test").alias("part"))
    )


@query(
    "spl_temporal",
    with_(
        S,
        """o AS (SELECT reading_ts, row_number() OVER (ORDER BY reading_ts) - 1 AS i, count(*) OVER () AS n FROM s)""",
        """cut AS (SELECT reading_ts AS c FROM o WHERE i = CAST(floor(n * 0.8::DOUBLE) AS BIGINT))""",
        """SELECT l_orderkey, l_linenumber, CASE WHEN reading_ts < (SELECT c FROM cut) THEN 'train' ELSE 'test' END AS part
        FROM s""",
    ),
)
def temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both_parts(spl_temporal(shipments(spark, sf_dir)), "l_orderkey", "l_linenumber")


RANKED = """k AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY md5(CAST(row_key AS VARCHAR) || '42')) AS rn,
    count(*) OVER (PARTITION BY sensor_id) AS n FROM r)"""
IN_TEST = "rn <= CASE WHEN n < 2 THEN 0 ELSE greatest(1, CAST(round(n * 0.2::DOUBLE) AS BIGINT)) END"


@query(
    "spl_stratified",
    with_(R, RANKED, f"SELECT row_key, CASE WHEN {IN_TEST} THEN 'test' ELSE 'train' END AS part FROM k"),
)
def stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both_parts(spl_stratified(readings(spark, sf_dir), key="row_key"), "row_key")


@query(
    "spl_verify_iso",
    with_(
        *NETWORKS,
        "ca AS (SELECT sensor_id, count(*) AS na FROM a GROUP BY 1)",
        "cb AS (SELECT sensor_id, count(*) AS nb FROM b GROUP BY 1)",
        """v AS (SELECT count(*) FILTER (na > 0 AND nb > 0) AS common, count(*) FILTER (nb IS NULL) AS only_train,
          count(*) FILTER (nb IS NULL AND na = 1) AS single_row_orphans,
          count(*) FILTER (nb IS NULL AND na > 1) AS multi_row_orphans, count(*) FILTER (na IS NULL) AS only_test
          FROM ca FULL JOIN cb USING (sensor_id))""",
        """SELECT *, CASE WHEN only_test > 0 THEN 'FAIL' WHEN only_train > 0 THEN 'ACCEPTABLE' ELSE 'PERFECT' END AS verdict FROM v""",
    ),
)
def verify_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spl_verify_iso(*two_networks(spark, sf_dir))


SAMPLE = 2000


@query(
    "spl_stratified_sample",
    with_(
        R,
        """k AS (SELECT *, md5(CAST(row_key AS VARCHAR) || '42') AS h,
          row_number() OVER (PARTITION BY sensor_id ORDER BY md5(CAST(row_key AS VARCHAR) || '42')) AS rn,
          count(*) OVER (PARTITION BY sensor_id) AS n, count(*) OVER () AS total FROM r)""",
        f"""SELECT sensor_id, reading_ts, count, row_key FROM k
        ORDER BY CASE WHEN rn <= least(n, greatest(1, CAST(floor({SAMPLE} * n / total::DOUBLE) AS BIGINT))) THEN 0 ELSE 1 END, h
        LIMIT {SAMPLE}""",
    ),
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spl_stratified_sample(readings(spark, sf_dir), n=SAMPLE, key="row_key")


@query(
    "spl_random_sample",
    with_(R, f"SELECT * FROM r ORDER BY md5(CAST(row_key AS VARCHAR) || '42'), row_key LIMIT {SAMPLE}"),
)
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spl_random_sample(readings(spark, sf_dir), SAMPLE, key="row_key")


@query(
    "spl_holdout",
    with_(
        R,
        CUR,
        """SELECT row_key, CASE WHEN substr(md5(CAST(row_key AS VARCHAR)), 1, 4) < 'cccd' THEN 'train' ELSE 'test' END AS part
        FROM cur""",
    ),
)
def holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both_parts(spl_holdout(current(readings(spark, sf_dir)), key="row_key")[:2], "row_key")


@query(
    "spl_label_stratified",
    with_(
        R,
        "l AS (SELECT r.*, CASE WHEN count > avg(count) OVER (PARTITION BY sensor_id) THEN 1 ELSE 0 END AS affluence FROM r)",
        RANKED.replace("PARTITION BY sensor_id", "PARTITION BY affluence").replace("FROM r)", "FROM l)"),
        f"SELECT row_key, affluence, CASE WHEN {IN_TEST} THEN 'test' ELSE 'train' END AS part FROM k",
    ),
)
def label_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = win_group_threshold(readings(spark, sf_dir))
    return both_parts(spl_label_stratified(labelled, key="row_key"), "row_key", "affluence")


