"""The three recurring jobs: ingest, score, monitor. Stages hand over DataFrames."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorspark.functions.columns import ts_of, utc_timestamp
from sensorspark.operators.clean import prj_stamp_ingestion, prj_struct_coords
from sensorspark.operators.decide import dec_audit_row, dec_deploy, dec_retrain
from sensorspark.operators.drift import drf_schema_drift
from sensorspark.operators.evaluate import evl_double, evl_min_samples, evl_regression
from sensorspark.operators.filters import flt_high_water
from sensorspark.operators.joins import jn_dedup_merge, jn_pred_actual
from sensorspark.operators.models import ml_batch_score, ml_profile_score, ml_train_window
from sensorspark.operators.profile import agg_freshness_check, agg_ingest_check, agg_prediction_check
from sensorspark.operators.split import spl_temporal
from sensorspark.schema import ROLES, Roles
from sensorspark.session import forget, via_table
from sensorspark.sources.files import src_json_pages
from sensorspark.sources.sinks import snk_append_partitioned, snk_audit_append, snk_replace_day
from sensorspark.sources.tables import src_warehouse_window


def api_readings(pages: DataFrame, json_col: str, now: Column | datetime | str) -> DataFrame:
    """Landed API pages to typed readings; texts that are no timestamp become null."""
    records = prj_struct_coords(src_json_pages(pages, json_col))
    typed = records.select(
        F.col("id_compteur").alias("sensor_id"),
        F.col("nom_compteur").alias("sensor_name"),
        utc_timestamp(F.col("date")).alias("reading_ts"),
        F.col("sum_counts").cast("bigint").alias("count"),
        "latitude",
        "longitude",
    )
    return prj_stamp_ingestion(typed, now).withColumn("reading_date", F.to_date("reading_ts"))


def ingest_cycle(
    spark: SparkSession,
    pages: DataFrame,
    json_col: str,
    path: str,
    now: datetime | str,
    target: DataFrame | None = None,
    by_key: bool = False,
) -> DataFrame:
    """Pages to the readings table, then the ingest check. New rows are those above the highest
    stored time; ``by_key`` inserts by key instead, which keeps late rows. Without new rows nothing is
    written and the check says ``failed`` with 0 rows."""
    new = api_readings(pages, json_col, now)
    if target is not None:
        new = jn_dedup_merge(new, target) if by_key else flt_high_water(new, target)
    # What is new is fixed before it is appended, as it may be found by reading the same table.
    new = via_table(new, "ingest")
    day = F.col("reading_date")
    n, first, last, undated = new.agg(F.count(F.lit(1)), F.min(day), F.max(day), F.count(F.when(day.isNull(), 1))).first()
    if n == 0:
        forget(new)
        return agg_ingest_check(spark.createDataFrame([], new.schema), now, 0)
    snk_append_partitioned(new, path)
    forget(new)
    # The check reads the days that the write touched, no others.
    touched = day.between(F.lit(first), F.lit(last)) | (day.isNull() & F.lit(undated > 0))
    return agg_ingest_check(spark.read.schema(new.schema).parquet(path).where(touched), now, n)


def score_cycle(
    spark: SparkSession,
    readings: DataFrame,
    model: PipelineModel,
    path: str,
    now: datetime | str,
    tags: Mapping[str, str],
    interval: str = "48 HOURS",
) -> tuple[DataFrame, DataFrame]:
    """Fresh readings scored into the prediction table. Returns its check and its accuracy."""
    if agg_freshness_check(readings, now).first()["status"] == "failed":
        raise ValueError("no readings in the last 7 days")
    scored = ml_batch_score(model, src_warehouse_window(readings, now, interval), tags, now)
    scored = via_table(scored, "scored")
    n, first, last = scored.agg(F.count(F.lit(1)), F.min("pred_date"), F.max("pred_date")).first()
    if n == 0:
        return agg_prediction_check(scored, 0), evl_regression(scored)
    snk_replace_day(scored, path)
    forget(scored)
    stored = spark.read.parquet(path).where(F.col("prediction_ts") == ts_of(now))
    stored = stored.where(F.col("pred_date").between(F.lit(first), F.lit(last)))
    return agg_prediction_check(stored, n), evl_regression(stored)


@dataclass
class MonitorResult:
    drift: DataFrame
    validation: DataFrame
    decision: DataFrame
    audit: DataFrame
    challenger: PipelineModel | None


def monitor_cycle(
    reference: DataFrame,
    readings: DataFrame,
    predictions: DataFrame,
    test_baseline: DataFrame,
    champion: PipelineModel,
    estimator: Pipeline,
    now: datetime | str,
    env: str = "prod",
    audit_path: str | None = None,
    force: bool = False,
) -> MonitorResult:
    """Drift, accuracy, decision, and where it says so a challenger with its deployment decision;
    one audit record."""
    stamp = F.lit("cycle").alias("cycle_id")
    current = src_warehouse_window(readings, now, "7 DAYS")
    drift = drf_schema_drift(reference, current).select(stamp, "drift_detected", "drift_share")
    matched = jn_pred_actual(predictions, readings, now)
    validation = evl_min_samples(evl_regression(matched, weight="n_rows")).select(
        stamp, "rmse", "r2", "too_few", ts_of(now).alias("timestamp"), F.lit(env).alias("env")
    )
    decision = dec_retrain(validation.join(drift, "cycle_id").withColumn("force", F.lit(force)))
    stages = {"validation": validation, "drift": drift}
    challenger = None
    if decision.first()["branch"] == "fine_tune_model":
        recent = src_warehouse_window(readings, now, "30 DAYS")
        trained = ml_train_window(reference, recent, estimator)
        challenger = trained.model
        new = evl_double(challenger.transform(test_baseline), challenger.transform(trained.test_current))
        old = evl_regression(champion.transform(test_baseline)).select(
            F.col("r2").alias("champion_r2_baseline")
        )
        compared = (
            new.withColumn("cycle_id", F.lit("cycle"))
            .withColumn("champion_r2_baseline", old.scalar())
            .join(validation.select("cycle_id", F.col("r2").alias("champion_r2_current")), "cycle_id")
        )
        stages["training"] = dec_deploy(compared).select(
            "cycle_id",
            F.lit(True).alias("fine_tune_success"),
            F.col("improvement_current").alias("model_improvement"),
            F.lit(True).alias("double_evaluation_enabled"),
            "baseline_regression",
            "r2_baseline",
            "r2_current",
            "champion_r2_baseline",
            "deployment_decision",
        )
    audit = dec_audit_row(stages)
    if audit_path is not None:
        snk_audit_append(audit, audit_path)
    return MonitorResult(drift, validation, decision, audit, challenger)


def sensors_to_retrain(readings: DataFrame, train_ratio: float = 0.8, roles: Roles = ROLES) -> DataFrame:
    """Which sensors need retraining: a profile from earlier readings scores the later ones, and
    each sensor's accuracy leads to its decision."""
    train, test = spl_temporal(readings, train_ratio, roles)
    scored = ml_profile_score(train, test, roles=roles)
    metrics = evl_min_samples(evl_regression(scored, roles.value, "prediction", [roles.sensor]))
    return dec_retrain(metrics)
