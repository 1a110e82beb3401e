from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sensorspark.operators.encode import SensorEmbedding, TargetEncoding, fold_of, ml_target_encode, train_shard
from sensorspark.operators.evaluate import evl_regression
from sensorspark.operators.models import ml_embedding_regressor, ml_rf_regressor, ml_save_load

ROWS = [(s, i, float(v)) for s, base in (("a", 10), ("b", 50), ("c", 90)) for i, v in enumerate(base + np.arange(40) % 7)]
ROWS += [("single", 0, 1000.0), ("a", 99, None), (None, 5, 3.0)]


@pytest.fixture
def rows(frame):
    return frame(ROWS, "sensor_id string, k long, count double")


def brute(rows, fold, own, smoothing=10.0, folds=5):
    """Encoded value of a row by the definition."""
    used = [(s, f, y) for (s, _, y), f in zip(ROWS, fold, strict=True) if y is not None and s is not None]
    prior = np.mean([y for _, _, y in used])
    out = []
    for (s, _, y), f in zip(ROWS, fold, strict=True):
        mine = [v for t, g, v in used if t == s and not (own and y is not None and g == f)]
        out.append((sum(mine) + smoothing * prior) / (len(mine) + smoothing))
    return out


def test_encoding_out_of_fold_and_whole(rows):
    got = ml_target_encode(rows, keyCols=["k"]).withColumn("fold", fold_of("k", 5)).orderBy("sensor_id", "k").collect()
    by = {(r.sensor_id, r.k): r for r in got}
    fold = [by[s, k].fold for s, k, _ in ROWS]
    for (s, k, _), want in zip(ROWS, brute(rows, fold, True), strict=True):
        assert by[s, k].sensor_mean == pytest.approx(want)
    whole = {(r.sensor_id, r.k): r.sensor_mean for r in ml_target_encode(rows, fit_on=rows.select("*"), keyCols=["k"]).collect()}
    for (s, k, _), want in zip(ROWS, brute(rows, fold, False), strict=True):
        assert whole[s, k] == pytest.approx(want)
    prior = np.mean([y for s, _, y in ROWS if y is not None and s])
    other = rows.limit(1).withColumn("sensor_id", F.lit("nowhere"))
    assert ml_target_encode(other, fit_on=rows, keyCols=["k"]).first().sensor_mean == pytest.approx(prior)
    assert ml_target_encode(rows, fit_on=rows.limit(0), keyCols=["k"]).first().sensor_mean == 0.0


def test_a_fold_is_hashed_once_for_each_row(rows):
    plan = ml_target_encode(rows, keyCols=["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1


def test_a_chain_is_fitted_out_of_fold_and_saved_with_its_table(rows, tmp_path):
    chain = Pipeline(stages=[TargetEncoding(keyCols=["k"], folds=3, smoothing=2.0), VectorAssembler(inputCols=["sensor_mean"], outputCol="features")])
    fitted = chain.fit(rows)
    model = ml_save_load(fitted, str(tmp_path / "m"))
    assert isinstance(model, PipelineModel) and model.stages[0].getOrDefault("smoothing") == 2.0
    one = ml_target_encode(rows, fit_on=rows.select("*"), keyCols=["k"], folds=3, smoothing=2.0)
    want = sorted((str(r.sensor_id), r.k, r.sensor_mean) for r in one.collect())
    for got in (fitted.transform(rows.select("*")), model.transform(rows)):
        assert sorted((str(r.sensor_id), r.k, r.sensor_mean) for r in got.collect()) == want
    # The frame that it was fitted on, as the stages after it see it in fitting.
    own = sorted((str(r.sensor_id), r.k, r.sensor_mean) for r in fitted.transform(rows).collect())
    assert own == sorted((str(r.sensor_id), r.k, r.sensor_mean) for r in ml_target_encode(rows, keyCols=["k"], folds=3, smoothing=2.0).collect()) != want
    again = Pipeline.read().load(_saved(chain, tmp_path))
    assert again.getStages()[0].getOrDefault("keyCols") == ["k"]


def _saved(chain, tmp_path):
    chain.write().overwrite().save(str(tmp_path / "chain"))
    return str(tmp_path / "chain")


def test_a_target_that_only_the_row_knows_is_not_leaked(spark):
    """Sensors of one row: in-fold means would be the targets themselves."""
    noise = spark.range(400).select(F.concat(F.lit("s"), "id").alias("sensor_id"), F.col("id").alias("k"), F.rand(3).alias("count"))
    assert ml_target_encode(noise, keyCols=["k"]).select("sensor_mean").distinct().count() == 1


def test_no_labels_come_to_the_driver(spark, monkeypatch):
    """Whatever is collected in fitting a forest or vectors is of fixed size."""
    from pyspark.sql.classic.dataframe import DataFrame

    sizes, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: (lambda rows: (sizes.append(len(rows)), rows)[1])(collect(self)))
    df = spark.range(6000).select(
        F.concat(F.lit("s"), F.col("id") % 1500).alias("sensor_id"), F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(id AS int) % 500)").alias("reading_ts"), (F.col("id") % 1500 % 7).cast("double").alias("count"),
    )
    forest = ml_rf_regressor(num_trees=3, max_depth=4).fit(df)
    vectors = ml_embedding_regressor(maxIter=4, rounds=2).fit(df)
    assert max(sizes) <= 8 * 20 and forest.stages[-1].numFeatures == vectors.stages[-1].table.sparkSession.range(1).count() * 14
    for model in (forest, vectors):
        assert "StringIndexer" not in "".join(type(s).__name__ for s in model.stages if s.uid.find("sensor") >= 0)


def test_gradient_of_a_shard():
    """One pass of one batch is one AdaGrad step along the squared error's gradient."""
    rng = np.random.default_rng(0)
    x, y = np.hstack([rng.normal(size=(30, 2)), np.ones((30, 1))]), rng.normal(size=30)
    own, vectors, shared = rng.integers(0, 4, 30), rng.normal(size=(4, 3)), rng.normal(size=3 + 2 * 3)

    def loss(v, s, rows):
        w, p = s[:3], s[3:].reshape(2, 3)
        e = x[rows] @ w + v[own[rows], 0] + (v[own[rows], 1:] * (x[rows] @ p.T)).sum(axis=1) - y[rows]
        return (e * e).sum() / 2

    new_v, new_s = train_shard(x, y, own, vectors, shared, 1, 0.1, 0.0, 1)
    everything = np.arange(30)
    for i in range(len(shared)):
        step = np.eye(len(shared))[i] * 1e-6
        g = (loss(vectors, shared + step, everything) - loss(vectors, shared - step, everything)) / 2e-6 / 30
        assert new_s[i] == pytest.approx(shared[i] - 0.1 * g / np.sqrt(g * g + 1e-2), abs=1e-6)
    for s in range(4):
        rows = np.flatnonzero(own == s)
        for j in range(3):
            step = np.zeros_like(vectors)
            step[s, j] = 1e-6
            g = (loss(vectors + step, shared, rows) - loss(vectors - step, shared, rows)) / 2e-6 / len(rows)
            assert new_v[s, j] == pytest.approx(vectors[s, j] - 0.1 * g / np.sqrt(g * g + 1e-2), abs=1e-6)


@pytest.fixture(scope="module")
def many(spark):
    """1e5 sensors of a few rows each, and one that holds a third of all."""
    x = ((F.col("id") * 7919) % 1000 / 500 - 1).alias("x")
    s = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 100_000)
    level = (F.xxhash64(s) % 10).cast("double")
    slope = (F.xxhash64(s, F.lit(1)) % 3).cast("double")
    return spark.range(600_000).select(s.cast("string").alias("sensor_id"), x, (50 + 5 * level + 4 * slope * x + F.randn(1)).alias("count"))


def test_vectors_of_many_sensors(many):
    chain = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), SensorEmbedding(factorSize=3, maxIter=12, rounds=3, shardRows=60_000)])
    model = chain.fit(many)
    vectors = model.stages[-1]
    assert vectors.table.count() == many.select("sensor_id").distinct().count() > 66_000
    assert len(vectors.numbers) == 4 + 2 + 3 * 2
    assert evl_regression(model.transform(many)).first().r2 > 0.8
    other = model.transform(many.limit(2).withColumn("sensor_id", F.lit("nowhere"))).collect()
    assert all(abs(r.prediction - 50) < 30 for r in other)


def test_vectors_are_the_same_again_and_after_reloading(many, tmp_path):
    few = many.where("sensor_id < '2'").limit(3000).cache()
    chain = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), SensorEmbedding(factorSize=2, maxIter=4, rounds=2, shardRows=500)])
    a, b = chain.fit(few), chain.fit(few.repartition(3))
    saved = ml_save_load(a, str(tmp_path / "m"))
    get = lambda m: sorted((r.sensor_id, r.x, r["count"], round(r.prediction, 9)) for r in m.transform(few).collect())
    assert get(a) == get(b) == get(saved)
    nothing = chain.fit(few.limit(0))
    assert {r.prediction for r in nothing.transform(few).collect()} == {0.0}
