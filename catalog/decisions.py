"""Evaluation, decisions and the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import M, R, SCORED, baseline, models, profile_scored, query, readings, table, with_
from sensorspark.operators.decide import (
    dec_audit_row,
    dec_deploy,
    dec_deploy_class,
    dec_effective_metrics,
    dec_fallback_improvement,
    dec_retrain,
    dec_severity,
)
from sensorspark.operators.evaluate import (
    evl_classification,
    evl_double,
    evl_min_samples,
    roc_points,
    evl_overfit_gap,
    evl_regression,
    evl_roc_auc,
)
from sensorspark.operators.models import ml_profile_score
from sensorspark.operators.registry import (
    SCOPE,
    promotion_events,
    reg_append,
    reg_champions,
    reg_promote_guard,
    reg_select_best,
    reg_select_legacy,
)
from sensorspark.plans.cycles import sensors_to_retrain

REG = """count(*) AS n, sqrt(avg((count - prediction) ** 2)) AS rmse, avg(abs(count - prediction)) AS mae,
    CASE WHEN min(count) = max(count) THEN CASE WHEN sum((count - prediction) ** 2) = 0 THEN 1 ELSE 0 END
    ELSE 1 - sum((count - prediction) ** 2) / (var_pop(count) * count(*)) END AS r2"""
METRICS = ["rmse", "mae", "r2"]


@query("evl_regression", with_(*SCORED, f"SELECT sensor_id, {REG} FROM p GROUP BY sensor_id"), rounds=METRICS)
def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evl_regression(profile_scored(spark, sf_dir), by=["sensor_id"])


@query("evl_regression_all", with_(*SCORED, f"SELECT {REG} FROM p"), rounds=METRICS)
def regression_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evl_regression(profile_scored(spark, sf_dir))


@query(
    "evl_min_samples",
    with_(
        *SCORED,
        f"e AS (SELECT sensor_id, {REG} FROM p GROUP BY sensor_id)",
        "SELECT sensor_id, n, rmse, mae, r2, n < 20 AS too_few FROM e",
    ),
    rounds=METRICS,
)
def min_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evl_min_samples(evl_regression(profile_scored(spark, sf_dir), by=["sensor_id"]), 20)


BUSY_T = 25.0
CONF = """count(*) FILTER (t AND q) AS tp, count(*) FILTER (NOT t AND q) AS fp,
    count(*) FILTER (t AND NOT q) AS fn, count(*) FILTER (NOT t AND NOT q) AS tn"""


@query(
    "evl_classification",
    with_(
        *SCORED,
        f"b AS (SELECT sensor_id, count > {BUSY_T} AS t, prediction > {BUSY_T} AS q FROM p)",
        f"k AS (SELECT sensor_id, {CONF} FROM b GROUP BY sensor_id)",
        """SELECT *, coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0)::DOUBLE, 0) AS accuracy,
        coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall,
        coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1_score FROM k""",
    ),
    rounds=["accuracy", "precision", "recall", "f1_score"],
)
def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile_scored(spark, sf_dir).select(
        "sensor_id",
        (F.col("count") > BUSY_T).cast("int").alias("affluence"),
        (F.col("prediction") > BUSY_T).cast("int").alias("prediction"),
    )
    return evl_classification(p, by=["sensor_id"])


@query(
    "evl_roc_auc",
    with_(
        *SCORED,
        f"""g AS (SELECT round(prediction, 4) AS x, count(*) FILTER (count > {BUSY_T}) AS a,
          count(*) FILTER (count <= {BUSY_T}) AS b FROM p GROUP BY 1)""",
        "h AS (SELECT a, b, sum(b) OVER (ORDER BY x) - b AS below FROM g)",
        """SELECT CAST(sum(a) AS BIGINT) AS positives, CAST(sum(b) AS BIGINT) AS negatives,
        sum(a * (below + b / 2.0::DOUBLE)) / (sum(a)::DOUBLE * sum(b)::DOUBLE) AS auc FROM h""",
    ),
    rounds=["auc"],
)
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile_scored(spark, sf_dir).select(
        (F.col("count") > BUSY_T).cast("int").alias("affluence"), F.round("prediction", 4).alias("score")
    )
    return evl_roc_auc(p)


@query(
    "evl_roc_points",
    with_(
        *SCORED,
        f"""g AS (SELECT round(prediction, 4) AS threshold, count(*) FILTER (count > {BUSY_T}) AS a,
          count(*) FILTER (count <= {BUSY_T}) AS b FROM p GROUP BY 1)""",
        """SELECT threshold, sum(b) OVER (ORDER BY threshold DESC) / (sum(b) OVER ())::DOUBLE AS fpr,
        sum(a) OVER (ORDER BY threshold DESC) / (sum(a) OVER ())::DOUBLE AS tpr FROM g""",
    ),
    rounds=["threshold", "fpr", "tpr"],
)
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile_scored(spark, sf_dir).select(
        (F.col("count") > BUSY_T).cast("int").alias("affluence"), F.round("prediction", 4).alias("score")
    )
    return roc_points(p)


@query(
    "evl_double",
    with_(
        *SCORED,
        """f AS (SELECT rl.sensor_id, count, coalesce(m, (SELECT avg(count) FROM base)) AS prediction
           FROM rl LEFT JOIN prof ON rl.sensor_id = prof.sensor_id AND isodow(lt) = d AND hour(lt) = h
           WHERE reading_ts < (SELECT min(reading_ts) FROM p))""",
        f"eb AS (SELECT sensor_id, {REG} FROM f GROUP BY 1)",
        f"ec AS (SELECT sensor_id, {REG} FROM p GROUP BY 1)",
        """SELECT sensor_id, eb.rmse AS rmse_baseline, eb.r2 AS r2_baseline, eb.mae AS mae_baseline, ec.rmse AS rmse_current,
        ec.r2 AS r2_current, ec.mae AS mae_current, coalesce(eb.n, 0) AS test_baseline_size,
        coalesce(ec.n, 0) AS test_current_size, coalesce(eb.r2 < 0.6, false) AS baseline_regression
        FROM eb FULL JOIN ec USING (sensor_id)""",
    ),
    rounds=["rmse_baseline", "r2_baseline", "mae_baseline", "rmse_current", "r2_current", "mae_current"],
)
def double(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = baseline(readings(spark, sf_dir))
    return evl_double(ml_profile_score(base, base), profile_scored(spark, sf_dir), by=["sensor_id"])


@query(
    "evl_overfit_gap",
    with_(M, "SELECT run_id, r2_train - r2_current AS r2_gap, r2_train - r2_current > 0.35::DOUBLE AS possible_overfit FROM m"),
    rounds=["r2_gap"],
)
def overfit_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evl_overfit_gap(models(spark, sf_dir)).select("run_id", "r2_gap", "possible_overfit")


RETRAIN = """CASE WHEN force THEN 'force' WHEN r2 < 0.45 OR rmse > 90 THEN 'reactive'
    WHEN drift_detected AND drift_status = 'ok' AND drift_share >= 0.5 AND r2 < 0.55 THEN 'proactive'
    WHEN drift_detected AND drift_status = 'ok' AND drift_share >= 0.3 THEN 'wait' ELSE 'ok' END"""
BRANCH = "CASE WHEN decision IN ('force', 'reactive', 'proactive') THEN 'fine_tune_model' ELSE 'end_monitoring' END AS branch"


@query("dec_retrain", with_(M, f"SELECT *, {BRANCH} FROM (SELECT run_id, {RETRAIN} AS decision FROM m)"))
def retrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dec_retrain(models(spark, sf_dir)).select("run_id", "decision", "branch")


@query(
    "dec_sensors_to_retrain",
    with_(
        R,
        """o AS (SELECT reading_ts, row_number() OVER (ORDER BY reading_ts) - 1 AS i, count(*) OVER () AS n FROM r)""",
        "cut AS (SELECT reading_ts AS c FROM o WHERE i = CAST(floor(n * 0.8::DOUBLE) AS BIGINT))",
        "base AS (SELECT * FROM r WHERE reading_ts < (SELECT c FROM cut))",
        SCORED[2]
        .replace("reading_ts < TIMESTAMP '2024-01-22 00:00:00'", "reading_ts < (SELECT c FROM cut)")
        .replace("reading_ts >= TIMESTAMP '2024-01-22 00:00:00'", "reading_ts >= (SELECT c FROM cut)"),
        f"e AS (SELECT sensor_id, {REG} FROM p GROUP BY sensor_id)",
        "e2 AS (SELECT sensor_id, n, rmse, mae, r2, n < 10 AS too_few FROM e)",
        f"SELECT *, {BRANCH} FROM (SELECT *, CASE WHEN too_few OR r2 < 0.45 OR rmse > 90 THEN 'reactive' ELSE 'ok' END AS decision FROM e2)",
    ),
    rounds=METRICS,
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensors_to_retrain(readings(spark, sf_dir))


DEPLOY = """im AS (SELECT *, r2_baseline < 0.6 AS baseline_regression,
      CASE WHEN champion_r2_current IS NULL OR champion_r2_current = 0 THEN 0.0::DOUBLE ELSE r2_current - champion_r2_current END AS improvement_current,
      r2_baseline - champion_r2_baseline AS improvement_baseline, coalesce(champion_r2_baseline < 0.6, false) AS cf FROM m),
    dp AS (SELECT *, CASE WHEN baseline_regression AND cf THEN
        CASE WHEN improvement_current > 0 THEN 'deploy_both_fail_baseline' ELSE 'skip_both_fail_baseline' END
      WHEN baseline_regression THEN 'reject_baseline_regression'
      WHEN improvement_current > 0 THEN 'deploy' ELSE 'skip_no_improvement' END AS deployment_decision FROM im)"""


def deployed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = models(spark, sf_dir).withColumn("baseline_regression", F.col("r2_baseline") < 0.6)
    return dec_deploy(m)


@query(
    "dec_deploy",
    with_(M, DEPLOY, "SELECT run_id, improvement_current, improvement_baseline, deployment_decision FROM dp"),
    rounds=["improvement_current", "improvement_baseline"],
)
def deploy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deployed(spark, sf_dir).select(
        "run_id", "improvement_current", "improvement_baseline", "deployment_decision"
    )


@query(
    "dec_fallback_improvement",
    with_(
        M,
        """SELECT run_id, CASE WHEN k % 2 = 0 THEN NULL WHEN champion_r2_current = 0 THEN 0.0::DOUBLE
        ELSE coalesce(CASE WHEN k % 3 > 0 THEN r2_current END, champion_r2_current) - champion_r2_current END AS model_improvement FROM m""",
    ),
    rounds=["model_improvement"],
)
def fallback_improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = models(spark, sf_dir).withColumns(
        {
            "double_evaluation_enabled": F.col("k") % 2 == 0,
            "new_r2": F.when(F.col("k") % 3 > 0, F.col("r2_current")),
        }
    )
    return dec_fallback_improvement(m).select("run_id", "model_improvement")


@query(
    "dec_deploy_class",
    with_(
        M,
        DEPLOY,
        """SELECT run_id, CASE WHEN deployment_decision LIKE '%deploy%' THEN 'deploy'
        WHEN deployment_decision LIKE '%skip%' THEN 'skip' ELSE 'reject' END AS deployment_class FROM dp""",
    ),
)
def deploy_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dec_deploy_class(deployed(spark, sf_dir)).select("run_id", "deployment_class")


@query("dec_severity", with_(M, "SELECT run_id, CASE WHEN r2 < 0.45 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM m"))
def severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dec_severity(models(spark, sf_dir)).select("run_id", "severity")


@query(
    "dec_effective_metrics",
    with_(
        M,
        """SELECT run_id, CASE WHEN k % 4 <> 0 AND k % 6 <> 0 THEN rmse + 1 ELSE rmse END AS rmse,
        CASE WHEN k % 4 <> 0 AND k % 6 <> 0 THEN r2_current ELSE r2 END AS r2 FROM m""",
    ),
    rounds=["rmse", "r2"],
)
def effective_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = models(spark, sf_dir).withColumns(
        {
            "new_champion_rmse": F.when(F.col("k") % 4 != 0, F.col("rmse") + 1),
            "new_champion_r2": F.when(F.col("k") % 6 != 0, F.col("r2_current")),
        }
    )
    return dec_effective_metrics(m).select("run_id", "rmse", "r2")


@query(
    "dec_audit_row",
    with_(
        M,
        DEPLOY,
        """SELECT run_id AS cycle_id, timestamp, CASE WHEN k % 13 <> 0 THEN drift_detected ELSE false END AS drift_detected,
        CASE WHEN k % 4 = 0 THEN rmse + 1 WHEN rmse = 0 THEN 999.0::DOUBLE ELSE rmse END AS rmse, r2,
        k % 2 = 0 AS fine_tune_triggered, k % 2 = 0 AS fine_tune_success,
        CASE WHEN k % 2 = 0 THEN improvement_current ELSE 0.0::DOUBLE END AS model_improvement, 'prod' AS env, '' AS error_message,
        k % 2 = 0 AS double_evaluation_enabled, k % 2 = 0 AND baseline_regression AS baseline_regression,
        CASE WHEN k % 2 = 0 THEN r2_baseline END AS r2_baseline, CASE WHEN k % 2 = 0 THEN r2_current END AS r2_current,
        CASE WHEN k % 2 = 0 THEN r2_train END AS r2_train,
        CASE WHEN k % 2 = 0 THEN deployment_decision ELSE 'not_triggered' END AS deployment_decision,
        CASE WHEN k % 2 = 0 THEN champion_r2_baseline END AS champion_r2_baseline, '' AS model_uri, '' AS run_id,
        CASE WHEN k % 13 <> 0 THEN drift_share END AS drift_share FROM dp""",
    ),
    rounds=["model_improvement"],
)
def audit_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = deployed(spark, sf_dir).withColumnRenamed("run_id", "cycle_id")
    stages = {
        "validation": d.select("cycle_id", "timestamp", F.lit("prod").alias("env"), "rmse", "r2"),
        "drift": d.where("k % 13 <> 0").select("cycle_id", "drift_detected", "drift_share"),
        "training": d.where("k % 2 = 0").select(
            "cycle_id",
            F.lit(True).alias("fine_tune_success"),
            F.lit(True).alias("double_evaluation_enabled"),
            F.col("improvement_current").alias("model_improvement"),
            "baseline_regression",
            "r2_baseline",
            "r2_current",
            "r2_train",
            "deployment_decision",
            "champion_r2_baseline",
        ),
        "new_champion": d.where("k % 4 = 0").select(
            "cycle_id", (F.col("rmse") + 1).alias("new_champion_rmse"), F.col("r2").alias("new_champion_r2")
        ),
    }
    return dec_audit_row(stages)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.floor("o_totalprice").cast("bigint")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderpriority").alias("model_type"),
        F.when(F.col("o_orderstatus") == "F", "prod").otherwise("dev").alias("env"),
        (k % 4 == 0).alias("test_mode"),
        (F.col("o_totalprice") / 1000).alias("rmse"),
        F.when(k % 6 != 0, k % 1009 / 1009.0).alias("r2"),
        F.when(k % 5 != 0, k % 499 / 499.0).alias("f1_score"),
        F.col("o_orderkey").alias("seq"),
        F.lit(False).alias("is_champion"),
        F.col("o_orderdate").alias("registered_at"),
    )


GR = """rg AS (SELECT o_orderkey AS run_id, o_orderpriority AS model_type,
    CASE WHEN o_orderstatus = 'F' THEN 'prod' ELSE 'dev' END AS env, CAST(floor(o_totalprice) AS BIGINT) % 4 = 0 AS test_mode,
    o_totalprice / 1000 AS rmse,
    CASE WHEN CAST(floor(o_totalprice) AS BIGINT) % 6 <> 0 THEN (CAST(floor(o_totalprice) AS BIGINT) % 1009) / 1009.0::DOUBLE END AS r2,
    CASE WHEN CAST(floor(o_totalprice) AS BIGINT) % 5 <> 0 THEN (CAST(floor(o_totalprice) AS BIGINT) % 499) / 499.0::DOUBLE END AS f1_score,
    o_orderkey AS seq, false AS is_champion, o_orderdate AS registered_at FROM orders)"""


def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of two types were promoted at some time, some of them more than once."""
    return (
        registry(spark, sf_dir)
        .where("run_id % 50 = 0 AND model_type IN ('1-URGENT', '2-HIGH')")
        .select("run_id", *SCOPE, F.col("registered_at").alias("promoted_at"))
    )


PR = """pm AS (SELECT run_id, model_type, env, test_mode, registered_at AS promoted_at FROM rg
    WHERE run_id % 50 = 0 AND model_type IN ('1-URGENT', '2-HIGH')),
  ch AS (SELECT * FROM pm QUALIFY row_number() OVER (PARTITION BY model_type, env, test_mode ORDER BY promoted_at DESC, run_id DESC) = 1)"""


@query(
    "reg_append",
    with_(
        GR,
        """SELECT run_id, model_type, env, test_mode, rmse, r2, f1_score, seq, is_champion, registered_at FROM rg
        UNION ALL SELECT run_id, model_type, env, test_mode, rmse + 1, NULL, NULL, seq + 1000000, false, registered_at FROM rg WHERE env = 'prod'""",
    ),
    rounds=["rmse"],
)
def registry_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = registry(spark, sf_dir)
    entry = r.where("env = 'prod'").select(
        "run_id", *SCOPE, (F.col("rmse") + 1).alias("rmse"), (F.col("seq") + 1000000).alias("seq"), "registered_at"
    )
    return reg_append(r, entry)


@query(
    "reg_promote",
    with_(
        GR,
        PR,
        """rq AS (SELECT run_id, model_type, env, test_mode, TIMESTAMP '2002-01-01' AS promoted_at FROM rg WHERE run_id % 77 = 0
             UNION ALL SELECT run_id + 1000000000, model_type, env, test_mode, TIMESTAMP '2002-01-01' FROM rg WHERE run_id % 77 = 0)""",
        """kn AS (SELECT * FROM rq WHERE (run_id, model_type, env, test_mode) IN (SELECT (run_id, model_type, env, test_mode) FROM rg)
             QUALIFY row_number() OVER (PARTITION BY model_type, env, test_mode ORDER BY promoted_at DESC, run_id DESC) = 1)""",
        """SELECT kn.*, CASE WHEN ch.run_id <> kn.run_id THEN ch.run_id END AS demoted_run_id
        FROM kn LEFT JOIN ch USING (model_type, env, test_mode)""",
    ),
)
def promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = registry(spark, sf_dir)
    at = F.lit("2002-01-01 00:00:00").cast("timestamp_ntz").alias("promoted_at")
    known = r.where("run_id % 77 = 0").select("run_id", *SCOPE, at)
    unknown = known.withColumn("run_id", F.col("run_id") + 1000000000)
    return promotion_events(r, promotions(spark, sf_dir), known.unionAll(unknown))


def _best_sql(order: str, where: str = "true") -> str:
    return f"""SELECT model_type, run_id, env, test_mode, rmse, r2, is_champion FROM flagged WHERE {where}
        QUALIFY row_number() OVER (PARTITION BY model_type ORDER BY {order}) = 1"""


FLAGGED = """flagged AS (SELECT rg.* REPLACE (ch.run_id IS NOT NULL AS is_champion) FROM rg
    LEFT JOIN ch ON rg.run_id = ch.run_id AND rg.model_type = ch.model_type AND rg.env = ch.env AND rg.test_mode = ch.test_mode)"""
PICKED = ["model_type", "run_id", "env", "test_mode", "rmse", "r2", "is_champion"]


@query(
    "reg_select_best",
    with_(
        GR,
        PR,
        FLAGGED,
        _best_sql(
            """CASE WHEN is_champion THEN 0 ELSE 1 END,
            CASE WHEN is_champion OR (env = 'prod' AND NOT test_mode) THEN 0 ELSE 1 END,
            CASE WHEN is_champion THEN 0 ELSE rmse END, seq"""
        ),
    ),
    rounds=["rmse", "r2"],
)
def select_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg_select_best(registry(spark, sf_dir), promotions(spark, sf_dir)).select(*PICKED)


@query(
    "reg_select_legacy",
    with_(
        GR,
        "flagged AS (SELECT * FROM rg)",
        _best_sql("r2 DESC NULLS LAST, seq", "env = 'dev' AND NOT test_mode"),
    ),
    rounds=["rmse", "r2"],
)
def select_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg_select_legacy(registry(spark, sf_dir), "r2", "dev", False).select(*PICKED)


@query(
    "reg_champions",
    with_(GR, PR, "SELECT ch.*, rmse, r2 FROM ch JOIN rg USING (run_id, model_type, env, test_mode)"),
    rounds=["rmse", "r2"],
)
def champions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg_champions(registry(spark, sf_dir), promotions(spark, sf_dir)).select(
        "run_id", *SCOPE, "promoted_at", "rmse", "r2"
    )


@query(
    "reg_promote_guard",
    with_(
        M,
        DEPLOY,
        GR,
        """SELECT run_id, model_type, env, test_mode, dp.timestamp AS promoted_at, deployment_decision
        FROM dp JOIN rg USING (run_id) WHERE deployment_decision LIKE '%deploy%'""",
    ),
)
def promote_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = deployed(spark, sf_dir).withColumnRenamed("timestamp", "decided_at")
    return reg_promote_guard(d, registry(spark, sf_dir))
