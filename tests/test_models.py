from __future__ import annotations

import json

import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Observation
from pyspark.sql import functions as F

from sensorspark.operators.evaluate import evl_classification, evl_regression
from sensorspark.operators.features import ml_assemble, ml_clean_pipeline, ml_one_hot, ml_standardize
from sensorspark.operators.models import (
    MIN_CURRENT_ROWS,
    ml_ablation,
    ml_baselines,
    ml_batch_score,
    ml_cross_validate,
    ml_embedding_regressor,
    ml_feature_importance,
    ml_profile_score,
    ml_rf_classifier,
    ml_rf_regressor,
    ml_save_load,
    ml_train_window,
)
from sensorspark.operators.ranking import win_group_threshold
from sensorspark.plans.cycles import ingest_cycle, monitor_cycle, score_cycle

SMALL = {"num_trees": 8, "max_depth": 6}


@pytest.fixture(scope="module")
def readings(spark):
    """Three sensors, hourly, with a daily rhythm of their own."""
    ts = pd.date_range("2024-04-01", periods=400, freq="h")
    rows = [
        {"sensor_id": s, "reading_ts": t, "count": float(base + amp * (8 <= t.hour <= 18) + t.dayofweek)}
        for s, base, amp in (("A", 10, 50), ("B", 100, 20), ("C", 5, 0))
        for t in ts
    ]
    return spark.createDataFrame(pd.DataFrame(rows)).withColumn("reading_ts", F.col("reading_ts").cast("timestamp_ntz"))


@pytest.fixture(scope="module")
def forest(readings):
    return ml_rf_regressor(**SMALL).fit(readings)


def test_forest_learns(readings, forest):
    m = evl_regression(forest.transform(readings)).first()
    assert m.n == 1200 and m.r2 > 0.9
    assert forest.transform(readings).where("prediction < 0").count() == 0


def test_sensor_as_category(readings):
    model = ml_rf_regressor(**SMALL, sensor_as="category").fit(readings)
    assert evl_regression(model.transform(readings)).first().r2 > 0.9
    odd = readings.limit(3).withColumn("sensor_id", F.lit("nowhere"))
    assert model.transform(odd).dropna(subset=["prediction"]).count() == 3
    with pytest.raises(ValueError):
        ml_rf_regressor(sensor_as="other")


def test_same_seed_same_model(readings, forest):
    again = ml_rf_regressor(**SMALL).fit(readings)
    keys = ["sensor_id", "reading_ts", "prediction"]
    assert forest.transform(readings).select(keys).exceptAll(again.transform(readings).select(keys)).count() == 0


def test_saved_model_predicts_the_same(readings, forest, tmp_path):
    again = ml_save_load(forest, str(tmp_path / "m"))
    assert isinstance(again, PipelineModel)
    keys = ["sensor_id", "reading_ts", "prediction"]
    assert forest.transform(readings).select(keys).exceptAll(again.transform(readings).select(keys)).count() == 0


def test_cleaning_is_part_of_the_saved_chain(readings, tmp_path):
    fitted = ml_clean_pipeline(year_base=2020).fit(readings)
    again = ml_save_load(fitted, str(tmp_path / "c"))
    assert again.transform(readings).first() == fitted.transform(readings).first()
    assert again.transform(readings).first().year_idx == 4


def test_unknown_sensor_is_scored(readings, forest):
    odd = readings.limit(3).withColumn("sensor_id", F.lit("nowhere"))
    assert ml_batch_score(forest, odd).dropna(subset=["prediction"]).count() == 3


def test_ten_rows_are_enough(readings):
    few = readings.where("sensor_id = 'A'").orderBy("reading_ts").limit(10)
    assert ml_rf_regressor(num_trees=2, max_depth=3).fit(few).transform(few).count() == 10


def test_sensor_vectors(readings):
    model = ml_embedding_regressor(maxIter=200).fit(readings)
    assert evl_regression(model.transform(readings)).first().r2 > 0.5
    assert model.stages[-1].table.columns == ["sensor", *[f"e{i}" for i in range(9)]] and model.stages[-1].table.count() == 3


def test_classifier(readings):
    labelled = win_group_threshold(readings).withColumn("affluence", F.col("affluence").cast("double"))
    model = ml_rf_classifier(**SMALL).fit(labelled)
    assert evl_classification(model.transform(labelled)).first().accuracy > 0.8
    odd = readings.limit(2).withColumn("sensor_id", F.lit("nowhere"))
    assert model.transform(odd).count() == 2


def test_classifier_scores_in_a_session_that_observes(spark, readings, forest, tmp_path):
    """After both cycles and an observed write, as a fitted model must not carry its session along."""
    score_cycle(spark, readings, forest, str(tmp_path / "p"), "2024-04-17 15:00:00", {"model_version": "v1"})
    seen = Observation()
    readings.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(str(tmp_path / "o"))
    assert seen.get["n"] == 1200
    labelled = win_group_threshold(readings).withColumn("affluence", F.col("affluence").cast("double"))
    model = ml_rf_classifier(**SMALL).fit(labelled)
    assert evl_classification(model.transform(labelled)).first().accuracy > 0.8


def test_nothing_to_score(spark, readings, forest, tmp_path):
    none = readings.withColumn("reading_ts", F.expr("reading_ts - INTERVAL 3 DAYS"))
    check, metrics = score_cycle(spark, none, forest, str(tmp_path / "p"), "2024-04-17 15:00:00", {"model_version": "v1"})
    assert check.first().no_rows and metrics.first().n == 0


def test_profile_beats_the_mean(readings):
    cut = F.lit("2024-04-15").cast("timestamp_ntz")
    scored = ml_profile_score(readings.where(F.col("reading_ts") < cut), readings.where(F.col("reading_ts") >= cut))
    assert evl_regression(scored).first().r2 > 0.9
    other = readings.limit(1).withColumn("sensor_id", F.lit("nowhere"))
    overall = readings.agg(F.avg("count")).first()[0]
    assert abs(ml_profile_score(readings, other).first().prediction - overall) < 1e-9


def test_importance_ablation_validation(readings, forest):
    top = ml_feature_importance(forest, readings, 5).collect()
    assert len(top) == 5 and top[0].importance >= top[-1].importance and any("sensor_mean" in r.feature for r in top)
    hot = ml_rf_regressor(**SMALL, sensor_as="one_hot").fit(readings)
    assert any("sensor_id" in r.feature for r in ml_feature_importance(hot, readings, 5).collect())
    row = ml_ablation(readings, ml_rf_regressor(**SMALL), ml_rf_regressor(**SMALL, with_sensor=False)).first()
    assert row.advice == "keep" and row.r2_gain > 0.05
    cv = ml_cross_validate(readings, ml_rf_regressor(**SMALL)).first()
    assert cv.folds == 3 and cv["mean"] > 0.8
    assert {r.model for r in ml_baselines(readings).collect()} == {"linear", "boosted_trees"}


def test_coordinates_count_as_one_feature(readings):
    df = readings.withColumns({"latitude": F.rand(1), "longitude": F.rand(2)})
    model = ml_rf_regressor(num_trees=3, max_depth=4, extra=["latitude", "longitude"]).fit(df)
    names = [r.feature for r in ml_feature_importance(model, df, 50).collect()]
    assert "latitude+longitude" in names and "latitude" not in names


def test_train_window(readings):
    current = readings.where("sensor_id <> 'C'")
    est = ml_rf_regressor(num_trees=2, max_depth=3)
    out = ml_train_window(readings, current, est)
    assert out.sliding_window and out.train.count() + out.test_current.count() == 1200 + 800
    few = current.orderBy("sensor_id", "reading_ts").limit(199)
    assert ml_train_window(readings, few, est).sliding_window
    assert ml_train_window(readings, current.limit(0), est).reason == "no current data"
    small = ml_train_window(readings, few, est, min_rows=MIN_CURRENT_ROWS)
    assert not small.sliding_window and small.train.count() == 1200 and small.reason == "fewer than 200 current rows"
    assert small.test_current.count() == 199
    other = ml_train_window(readings, current.select("sensor_id", "reading_ts").withColumn("x", F.lit(1)), est)
    assert not other.sliding_window and other.reason == "columns differ"
    assert not ml_train_window(readings, None, est).sliding_window


def counting(spark, df):
    """The frame, and how many of its rows have been read."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(count, df.schema), seen


def test_a_fit_reads_its_input_once(spark, readings):
    df, seen = counting(spark, readings)
    assert ml_rf_regressor(num_trees=2, max_depth=3).fit(df).stages[-1].getNumTrees == 2 and seen.value == 1200
    df, seen = counting(spark, readings)
    assert not ml_train_window(df, None, ml_rf_regressor(num_trees=2, max_depth=3)).sliding_window and seen.value == 1200


def test_stored_rows_give_the_chain_of_plain_ones(readings):
    """Sensors that are null, rows that come twice; columns that nothing reads may be there. One partition,
    as the order of rows decides the last bits of means."""
    odd = readings.withColumn("sensor_id", F.when(F.col("sensor_id") != "C", F.col("sensor_id"))).withColumn("other", F.lit("x"))
    odd = odd.unionAll(odd.where("count > 60")).coalesce(1)
    for options in ({}, {"sensor_as": "one_hot"}, {"with_sensor": False}):
        chain = ml_rf_regressor(num_trees=3, max_depth=4, **options)
        was = Pipeline(stages=chain.getStages()).fit(odd).transform(odd)
        now = chain.fit(odd).transform(odd)
        assert now.columns == was.columns
        keys = ["sensor_id", "reading_ts", "count", F.round("prediction", 6)]
        assert was.select(*keys).exceptAll(now.select(*keys)).count() == 0 and now.count() == was.count() > 1200
    with pytest.raises(Exception):
        chain.fit(odd.limit(0))


def test_train_window_counts_current_rows(readings):
    est = ml_rf_regressor(num_trees=2, max_depth=3)
    out = ml_train_window(readings, readings.where("sensor_id <> 'C'"), est)
    assert out.n_current == out.train.count() - 1200 > 0
    assert ml_train_window(readings, readings.limit(5), est, min_rows=MIN_CURRENT_ROWS).n_current == 0
    assert ml_train_window(readings, None, est).n_current == 0


def test_one_hot_and_z_scores(frame):
    df = frame([("a", 1.0), ("b", 3.0)], "k string, v double")
    got = ml_one_hot(frame([("b", 0.0), ("z", 0.0)], "k string, v double"), ["k"], fit_on=df)
    assert [r[0] for r in got.select(vector_to_array("k_vec")).collect()] == [[0.0, 1.0], [0.0, 0.0]]
    assert [r.v_z for r in ml_standardize(df, ["v"]).collect()] == [-1.0, 1.0]
    assert [r.v_z for r in ml_standardize(df.withColumn("v", F.lit(2.0)), ["v"]).collect()] == [0.0, 0.0]


def test_scoring_cycle(spark, readings, forest, tmp_path):
    path = str(tmp_path / "pred")
    now = "2024-04-17 15:00:00"
    check, metrics = score_cycle(spark, readings, forest, path, now, {"model_version": "v1"})
    n = readings.where(F.col("reading_ts") >= F.lit("2024-04-15 15:00:00").cast("timestamp_ntz")).count()
    row = check.first()
    assert row.n_rows == n and not row.count_mismatch and metrics.first().r2 > 0.8
    again, _ = score_cycle(spark, readings, forest, path, now, {"model_version": "v1"})
    assert again.first().n_rows == n
    with pytest.raises(ValueError):
        score_cycle(spark, readings, forest, path, "2030-01-01 00:00:00", {})


def test_monitoring_cycle(spark, readings, forest, tmp_path):
    now = "2024-04-17 15:00:00"
    pred = ml_batch_score(forest, readings, {"model_version": "v1"}, now)
    est = ml_rf_regressor(num_trees=3, max_depth=4)
    calm = monitor_cycle(readings, readings, pred, readings, forest, est, now)
    assert calm.decision.first().branch == "end_monitoring" and calm.challenger is None
    assert calm.audit.first().deployment_decision == "not_triggered"
    path = str(tmp_path / "audit")
    forced = monitor_cycle(readings, readings, pred, readings, forest, est, now, audit_path=path, force=True)
    row = spark.read.parquet(path).first()
    assert forced.challenger is not None and row.fine_tune_triggered and row.double_evaluation_enabled
    assert row.deployment_decision in ("deploy", "skip_no_improvement") and row.env == "prod"


def test_ingest_cycle(spark, frame, tmp_path):
    def page(*records):
        body = [{"date": d, "sum_counts": 5, "id_compteur": s, "nom_compteur": s, "coordinates": {"lat": 1.0, "lon": 2.0}} for s, d in records]
        return frame([(json.dumps({"results": body}),)], "body string")

    path = str(tmp_path / "t")
    first = page(("a", "2024-01-01T10:00:00+01:00"), ("b", "2024-01-01T11:00:00+01:00"))
    assert ingest_cycle(spark, first, "body", path, "2024-01-01 12:00:00").first().status == "ok"
    late = page(("a", "2024-01-01T10:00:00+01:00"), ("c", "2024-01-01T10:00:00+01:00"), ("a", "2024-01-01T12:00:00+01:00"))
    stored = spark.read.parquet(path)
    assert ingest_cycle(spark, late, "body", str(tmp_path / "u"), "2024-01-01 13:00:00", stored).first().n_rows == 1
    assert ingest_cycle(spark, late, "body", str(tmp_path / "v"), "2024-01-01 13:00:00", stored, by_key=True).first().n_rows == 2
    nothing = ingest_cycle(spark, first, "body", str(tmp_path / "w"), "2024-01-01 13:00:00", stored).first()
    assert (nothing.status, nothing.n_rows, nothing.expected) == ("failed", 0, 0)
    # Into the table that is read, new rows once and nothing the second time.
    now = "2024-01-01 13:00:00"
    assert ingest_cycle(spark, late, "body", path, now, spark.read.parquet(path), by_key=True).first().n_rows == 2
    assert ingest_cycle(spark, late, "body", path, now, spark.read.parquet(path), by_key=True).first().status == "failed"
    assert spark.read.parquet(path).count() == 4


def test_years_beyond_the_known_ones(frame):
    df = frame([("A", f"20{y}-05-0{d} 10:00:00", float(d)) for y in (24, 26, 31) for d in (1, 2, 3)], "sensor_id string, reading_ts timestamp_ntz, count double")
    assert ml_assemble(df).where("features is not null").count() == 9
    known = ml_assemble(df.where("year(reading_ts) = 2024"), year_base=-1)
    assert known.select("year_idx").distinct().first()[0] == 0
