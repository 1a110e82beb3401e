"""Metric samples, request logs, runs and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import (
    C,
    G,
    LATENCY_BOUNDS,
    M,
    Q,
    RUNS,
    counters,
    gauges,
    models,
    newest,
    query,
    requests,
    runs,
    with_,
)
from sensorspark.operators.metrics import (
    ALERT_RULES,
    alert_history,
    alert_rules,
    mon_and_match,
    mon_champion_vs_challenger,
    mon_error_ratio,
    mon_for_duration,
    mon_gauges_from_audit,
    mon_histogram_quantile,
    mon_r2_vs_drift,
    mon_rate_increase,
    mon_rule_samples,
    mon_reduce_last,
    mon_success_rate,
    mon_threshold,
    mon_up,
)
from sensorspark.operators.profile import agg_http_rollup

GAUGE_SQL = {
    "model_r2_champion_current": "r2",
    "model_r2_champion_baseline": "champion_r2_baseline",
    "model_r2_challenger_baseline": "r2_baseline",
    "model_r2_challenger_current": "r2_current",
    "model_rmse_production": "rmse",
    "drift_detected": "CAST(drift_detected AS DOUBLE)",
    "drift_share": "drift_share",
}


@query(
    "mon_gauges_from_audit",
    with_(
        M,
        " UNION ALL ".join(
            f"SELECT run_id, timestamp AS ts, '{g}' AS metric, {e} AS value FROM m WHERE {e} IS NOT NULL"
            for g, e in GAUGE_SQL.items()
        ),
    ),
)
def gauges_from_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mon_gauges_from_audit(models(spark, sf_dir), keys=["run_id"])


INCREASE = """b AS (SELECT metric, instance, time_bucket(INTERVAL {w}, ts) AS window_start, ts, value,
      lag(value) OVER (PARTITION BY instance, time_bucket(INTERVAL {w}, ts) ORDER BY ts) AS p FROM c)"""
STEPS = """SELECT metric, instance, window_start, {v} FROM b GROUP BY ALL HAVING count(*) > 1"""
SUMMED = "sum(CASE WHEN p IS NULL THEN 0.0::DOUBLE WHEN value >= p THEN value - p ELSE value END)"


@query(
    "mon_rate_increase",
    with_(C, INCREASE.format(w="1 HOUR"), STEPS.format(v=SUMMED + " AS increase")),
    rounds=["increase"],
)
def increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mon_rate_increase(counters(spark, sf_dir), "1 hour", "increase")


@query(
    "mon_rate",
    with_(C, INCREASE.format(w="6 HOUR"), STEPS.format(v=SUMMED + " / 21600.0::DOUBLE AS rate")),
    rounds=["rate"],
    digits=9,
)
def rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mon_rate_increase(counters(spark, sf_dir), "6 hours", "rate")


@query(
    "mon_error_ratio",
    with_(
        Q,
        """SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS requests,
        count(*) FILTER (status_code >= 500) AS errors, count(*) FILTER (status_code >= 500) * 100.0::DOUBLE / count(*) AS error_pct
        FROM q GROUP BY ALL""",
    ),
    rounds=["error_pct"],
)
def error_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mon_error_ratio(requests(spark, sf_dir))


@query(
    "mon_error_ratio_sliding",
    with_(
        Q,
        """s AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) - i * INTERVAL 1 MINUTE AS window_start, status_code
           FROM q, range(5) AS t(i))""",
        """SELECT window_start, count(*) AS requests, count(*) FILTER (status_code >= 500) AS errors,
        count(*) FILTER (status_code >= 500) * 100.0::DOUBLE / count(*) AS error_pct FROM s GROUP BY ALL""",
    ),
    rounds=["error_pct"],
)
def error_ratio_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mon_error_ratio(requests(spark, sf_dir), "5 minutes", "1 minute")


LES = ", ".join(f"({b}::DOUBLE)" for b in LATENCY_BOUNDS) + ", ('inf'::DOUBLE)"


def _quantile(p: float) -> str:
    return f"""(SELECT CASE WHEN hi = 'inf'::DOUBLE THEN lo ELSE lo + (hi - lo) * ({p}::DOUBLE * total - below) / (cum - below) END
      FROM bb WHERE bb.method = t.method AND bb.endpoint = t.endpoint AND cum >= {p}::DOUBLE * total ORDER BY hi LIMIT 1)"""


@query(
    "mon_histogram_quantile",
    with_(
        Q,
        f"""ba AS (SELECT method, endpoint, le AS hi, count(*) FILTER (latency <= le) AS cum
           FROM q, (VALUES {LES}) AS v(le) GROUP BY ALL)""",
        """bb AS (SELECT *, coalesce(lag(hi) OVER o, 0.0::DOUBLE) AS lo, coalesce(lag(cum) OVER o, 0) AS below,
           max(cum) OVER (PARTITION BY method, endpoint) AS total FROM ba WINDOW o AS (PARTITION BY method, endpoint ORDER BY hi))""",
        "t AS (SELECT DISTINCT method, endpoint, total AS requests FROM bb)",
        f"SELECT method, endpoint, requests, {_quantile(0.5)} AS p50, {_quantile(0.95)} AS p95, {_quantile(0.99)} AS p99 FROM t",
    ),
    rounds=["p50", "p95", "p99"],
)
def histogram_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mon_histogram_quantile(agg_http_rollup(requests(spark, sf_dir), LATENCY_BOUNDS))


@query(
    "mon_success_rate",
    with_(
        RUNS,
        """SELECT pipeline_id, count(*) FILTER (state = 'success') AS succeeded, count(*) AS total,
        count(*) FILTER (state = 'success') * 100.0::DOUBLE / count(*) AS success_pct FROM runs GROUP BY pipeline_id""",
    ),
    rounds=["success_pct"],
)
def success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mon_success_rate(runs(spark, sf_dir))


LAST = """l AS (SELECT metric, instance, value, ts AS last_ts FROM g
    WHERE ts > (SELECT max(ts) FROM g) - INTERVAL 3 DAY
    QUALIFY row_number() OVER (PARTITION BY metric, instance ORDER BY ts DESC, value DESC) = 1)"""


@query("mon_reduce_last", with_(G, LAST, "SELECT * FROM l"))
def reduce_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gauges(spark, sf_dir)
    return mon_reduce_last(g, newest(g, "ts"), "3 DAYS")


RULE_VALUES = "rules AS (SELECT * FROM (VALUES {}) AS v(rule, metric, evaluator, low, high, lookback_s, for_s, no_data, severity))".format(
    ", ".join(
        f"('{r}', '{m}', '{e}', {lo}::DOUBLE, {'NULL' if hi is None else hi}::DOUBLE, {lb}::BIGINT, {f}::BIGINT, '{nd}', '{sv}')"
        for r, m, e, lo, hi, lb, f, nd, sv in ALERT_RULES
    )
)
BREACH = """CASE evaluator WHEN 'lt' THEN value < low WHEN 'gt' THEN value > low WHEN 'eq' THEN value = low
    WHEN 'within_range' THEN value > low AND value < high END"""


@query(
    "mon_and_match",
    with_(
        G,
        """SELECT instance, ts, value FROM g WHERE metric = 'drift_share' AND value > 0.5
        AND (instance, ts) IN (SELECT (instance, ts) FROM g WHERE metric = 'model_r2_champion_current' AND value < 0.7)""",
    ),
)
def and_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gauges(spark, sf_dir)
    drift = g.where("metric = 'drift_share'")
    r2 = g.where("metric = 'model_r2_champion_current'")
    return mon_and_match(
        drift, r2, ["instance", "ts"], F.col("value") > 0.5, F.col("value") < 0.7
    ).drop("metric")


UNTIL = "2024-01-31 00:00:00"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples for all rules, from every log that there is."""
    g = gauges(spark, sf_dir)
    return mon_rule_samples(g, requests(spark, sf_dir), runs(spark, sf_dir), counters(spark, sf_dir), mon_up(g, UNTIL, "1 day"))


SAMPLES = (
    Q,
    C,
    RUNS,
    INCREASE.format(w="1 HOUR"),
    f"i AS ({STEPS.format(v=SUMMED + ' AS increase')})",
    "u0 AS (SELECT DISTINCT instance, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS d FROM g)",
    f"""u AS (SELECT f.instance, t.d FROM (SELECT instance, min(d) AS a FROM u0 GROUP BY 1) f,
      LATERAL (SELECT unnest(generate_series(f.a, TIMESTAMP '{UNTIL}' - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d) t)""",
    """sm AS (SELECT metric, instance, ts, value FROM g
      UNION ALL SELECT 'drift_and_declining_r2', instance, ts, CASE WHEN value > 0.5 AND (instance, ts) IN
        (SELECT (instance, ts) FROM g WHERE metric = 'model_r2_champion_current' AND value < 0.7) THEN value ELSE 0 END
        FROM g WHERE metric = 'drift_share'
      UNION ALL SELECT 'api_error_ratio', 'api', time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE,
        count(*) FILTER (status_code >= 500) / count(*)::DOUBLE FROM q GROUP BY 3
      UNION ALL SELECT 'run_duration_seconds', pipeline_id, end_ts, (epoch_us(end_ts) - epoch_us(start_ts)) / 1000000.0::DOUBLE FROM runs WHERE end_ts IS NOT NULL
      UNION ALL SELECT 'records_ingested_increase_1h', instance, window_start + INTERVAL 1 HOUR, increase FROM i
      UNION ALL SELECT 'up', instance, d + INTERVAL 1 DAY, CASE WHEN (instance, d) IN (SELECT (instance, d) FROM u0) THEN 1.0 ELSE 0.0 END FROM u)""",
)


@query("mon_rule_samples", with_(G, *SAMPLES, "SELECT * FROM sm"), rounds=["value"])
def rule_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir)


@query(
    "mon_threshold",
    with_(G, *SAMPLES, LAST.replace("FROM g", "FROM sm"), RULE_VALUES, f"SELECT rule, instance, value, last_ts, severity, {BREACH} AS breach FROM l JOIN rules USING (metric)"),
)
def threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = samples(spark, sf_dir)
    last = mon_reduce_last(g, newest(g, "ts"), "3 DAYS")
    return mon_threshold(last, alert_rules(spark)).select(
        "rule", "instance", "value", "last_ts", "severity", "breach"
    )


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample against its rules. Several runs of a pipeline can end at one time: one breach is
    enough."""
    found = mon_threshold(samples(spark, sf_dir), alert_rules(spark))
    return found.groupBy("rule", "instance", "ts").agg(F.max("breach").alias("breach"))


def _evaluated(until: str = "") -> tuple[str, ...]:
    cols = f"rule, instance, ts, bool_or({BREACH}) AS breach, for_s, lookback_s, no_data"
    return G, *SAMPLES, RULE_VALUES, f"ev AS (SELECT {cols} FROM sm JOIN rules USING (metric) {until} GROUP BY ALL)"


NOW = "2024-01-30 23:30:00"
HIST = """hs AS (SELECT *, max(CASE WHEN NOT breach THEN ts END) OVER w AS ok_ts FROM ev
      WINDOW w AS (PARTITION BY rule, instance ORDER BY ts)),
    hb AS (SELECT *, min(CASE WHEN breach THEN ts END) OVER (PARTITION BY rule, instance, ok_ts) AS since FROM hs)"""


@query(
    "mon_for_duration_history",
    with_(
        *_evaluated(),
        HIST,
        """SELECT rule, instance, ts, breach, CASE WHEN breach THEN since END AS active_since,
        CASE WHEN NOT breach THEN 'Normal' WHEN epoch_us(ts) - epoch_us(since) >= for_s * 1000000 THEN 'Firing' ELSE 'Pending' END AS state
        FROM hb""",
    ),
)
def for_duration_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_history(evaluations(spark, sf_dir), alert_rules(spark))


LATEST = """SELECT rule, instance, ts AS last_ts, CASE WHEN breach THEN since END AS active_since,
        CASE WHEN epoch_us(t) - epoch_us(ts) > 1000000 * lookback_s THEN
            CASE no_data WHEN 'OK' THEN 'Normal' WHEN 'NoData' THEN 'NoData'
              ELSE CASE WHEN epoch_us(t) - epoch_us(ts) >= for_s * 1000000 THEN 'Firing' ELSE 'Pending' END END
          WHEN NOT breach THEN 'Normal' WHEN epoch_us(t) - epoch_us(since) >= for_s * 1000000 THEN 'Firing' ELSE 'Pending' END AS state
        FROM (SELECT * FROM hb QUALIFY row_number() OVER (PARTITION BY rule, instance ORDER BY ts DESC) = 1), nw"""


@query(
    "mon_for_duration",
    with_(
        *_evaluated(f"WHERE ts <= TIMESTAMP '{NOW}'"),
        HIST,
        f"nw AS (SELECT TIMESTAMP '{NOW}' AS t)",
        LATEST,
    ),
)
def for_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mon_for_duration(evaluations(spark, sf_dir), alert_rules(spark), NOW)


def _last_in_bucket(metric: str) -> str:
    return f"max_by(value, (ts, value)) FILTER (metric = '{metric}')"


@query(
    "mon_r2_vs_drift",
    with_(
        G,
        f"""SELECT instance, time_bucket(INTERVAL 1 HOUR, ts) AS bucket_start, {_last_in_bucket('model_r2_champion_current')} AS r2,
        {_last_in_bucket('drift_share')} AS drift_share FROM g GROUP BY ALL""",
    ),
)
def r2_vs_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mon_r2_vs_drift(gauges(spark, sf_dir))


@query(
    "mon_champion_vs_challenger",
    with_(
        G,
        f"""v AS (SELECT instance, time_bucket(INTERVAL 1 HOUR, ts) AS bucket_start,
        {_last_in_bucket('model_r2_champion_current')} AS r2_champion_current,
        {_last_in_bucket('model_r2_challenger_current')} AS r2_challenger_current,
        {_last_in_bucket('model_r2_champion_baseline')} AS r2_champion_baseline,
        {_last_in_bucket('model_r2_challenger_baseline')} AS r2_challenger_baseline,
        {_last_in_bucket('model_rmse_production')} AS rmse_champion,
        {_last_in_bucket('prediction_rmse')} AS rmse_challenger FROM g GROUP BY ALL)""",
        "SELECT *, r2_challenger_current - r2_champion_current AS r2_gain FROM v",
    ),
    rounds=["r2_gain"],
)
def champion_vs_challenger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mon_champion_vs_challenger(gauges(spark, sf_dir))

