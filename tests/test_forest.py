"""The forest against plain trees, Spark's own forest, and itself under other limits."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from sensorspark.operators import forest
from sensorspark.operators.forest import Grower, Layout, Sets, SparseForestModel, SparseForestRegressor, thresholds


def rows(n: int, seed: int = 0):
    """Cells of a label, a number and a 1, with weights and labels that follow all three."""
    rng = np.random.default_rng(seed)
    layout = Layout(30, [0, 1], [12, 0], [[], [0.5, 1.5, 2.5, 3.5]])
    cells = np.column_stack([rng.integers(0, 12, n), rng.integers(0, 5, n), rng.integers(3, 31, n)]).astype(np.int32)
    y = cells[:, 0] % 3 * 10 + cells[:, 1] * (cells[:, 2] > 20) + rng.normal(size=n)
    return layout, cells, rng.poisson(1, n).astype(float), y


def plain(layout, cells, w, y, depth, least=1.0):
    """Sum of squares left in the leaves of a tree that tries every split of every node."""
    mean = (w * y).sum() / w.sum()
    best, parts = 1e-9, None
    for j in range(3):
        values = np.unique(cells[:, j])
        if j == 0:
            by_mean = sorted((((w * y)[cells[:, 0] == v].sum() / w[cells[:, 0] == v].sum()), v) for v in values if w[cells[:, 0] == v].sum())
            sides = [np.isin(cells[:, 0], [v for _, v in by_mean[: i + 1]]) for i in range(len(by_mean) - 1)]
        else:
            sides = [cells[:, j] <= v if j == 1 else cells[:, j] != v for v in values]
        for side in sides:
            a, b = w[side].sum(), w[~side].sum()
            if a >= least and b >= least:
                gain = ((w * (y - mean))[side].sum() ** 2) * (1 / a + 1 / b)
                if gain > best * (1 + 1e-9):
                    best, parts = gain, side
    if not depth or parts is None:
        return (w * (y - mean) ** 2).sum()
    return sum(plain(layout, cells[p], w[p], y[p], depth - 1, least) for p in (parts, ~parts))


def grown(layout, cells, w, y, depth, most, blocks=7, least=1.0):
    used = np.flatnonzero(w)
    mean = y.mean()

    def read():
        for part in np.array_split(used, blocks):
            yield cells[part], w[part], w[part] * (y[part] - mean)

    tree = Grower(layout, 1, depth, least, 0.0, 1e-12 * y.var(), most).grow(read)
    return tree, tree.value[tree.leaves(cells)] + mean


@pytest.mark.parametrize("least", [1.0, 5.0])
def test_a_tree_takes_the_best_splits(least):
    layout, cells, w, y = rows(400)
    for depth in (1, 2, 4):
        _, p = grown(layout, cells, w, y, depth, 1 << 20, least=least)
        assert (w * (y - p) ** 2).sum() == pytest.approx(plain(layout, cells[w > 0], w[w > 0], y[w > 0], depth, least))


def test_a_tree_is_the_same_however_few_cells_a_task_holds():
    layout, cells, w, y = rows(3000, 1)
    whole, p = grown(layout, cells, w, y, 9, 1 << 20)
    assert len(whole.feature) > 100 and len(whole.sets) > 3
    for most in (40, 300, 900):
        parts, q = grown(layout, cells, w, y, 9, most)
        assert len(parts.feature) == len(whole.feature) and np.allclose(p, q)


def test_equal_labels_are_one_leaf():
    layout, cells, w, y = rows(300)
    tree, p = grown(layout, cells, w, np.full(300, 1e6 + 0.1), 9, 1 << 20)
    assert len(tree.feature) == 1 and np.allclose(p, 1e6 + 0.1)
    empty, _ = grown(layout, cells, np.zeros(300), y, 9, 1 << 20)
    assert len(empty.feature) == 1


def test_sets_of_labels():
    sets = [np.array([0, 5, 99]), np.array([7]), np.arange(0, 100, 2), np.array([99])]
    found = Sets(*Sets.stored(sets, 100), 100)
    of, label = (x.ravel() for x in np.meshgrid(np.arange(4), np.arange(100), indexing="ij"))
    assert found.has(of, label).tolist() == [v in set(sets[k].tolist()) for k, v in zip(of, label)]


def test_thresholds_as_quantiles():
    assert thresholds(np.array([3.0, 1.0, 2.0]), np.array([1, 1, 1]), 5) == [1.5, 2.5]
    cuts = thresholds(np.arange(1000.0), np.ones(1000, int), 9)
    assert len(cuts) == 9 and np.allclose(np.diff(cuts), 100, atol=1)


@pytest.fixture(scope="module")
def wide(spark):
    """2,000 sensors, whose counts follow from the sensor and one number."""
    df = spark.range(0, 12_000, 1, 3).select(
        (F.col("id") * 7919 % 2000).alias("sensor"), (F.col("id") * 31 % 17).cast("double").alias("x"), (F.col("id") * 7919 % 2000 % 7 * 10 + F.col("id") * 31 % 17).cast("double").alias("count")
    )
    stages = [StringIndexer(inputCol="sensor", outputCol="label", handleInvalid="keep"), OneHotEncoder(inputCols=["label"], outputCols=["hot"])]
    return Pipeline(stages=stages).fit(df).transform(df).localCheckpoint()


def test_a_column_for_each_sensor(spark, wide, tmp_path):
    """Spark's forest has a histogram of 2,001 features for every node."""
    vectors = VectorAssembler(inputCols=["x", "hot"], outputCol="features").transform(wide)
    model = SparseForestRegressor(featureSubsetStrategy="all", labelCol="count", numTrees=4, maxDepth=12, seed=1).fit(vectors)
    assert isinstance(model, SparseForestModel) and model.numFeatures == 2001 and model.getNumTrees == 4
    shares = model.featureImportances.toArray()
    assert shares.sum() == pytest.approx(1) and (shares > 0).sum() > 10 and shares.argmax() == 0
    model.write().overwrite().save(str(tmp_path / "m"))
    again = SparseForestModel.load(str(tmp_path / "m"))
    both = model.transform(vectors).withColumnRenamed("prediction", "a")
    assert again.transform(both).where("a <> prediction OR a IS NULL").count() == 0


def test_a_label_for_each_sensor(wide, monkeypatch):
    vectors = VectorAssembler(inputCols=["x", "label"], outputCol="features").transform(wide)
    options = {"featureSubsetStrategy": "all", "labelCol": "count", "numTrees": 5, "maxDepth": 10, "seed": 1, "maxBins": 2001}
    model = SparseForestRegressor(**options).fit(vectors)
    assert sum(len(t["feature"]) for t in model.trees) < 5 * 2000

    def error(m):
        return m.transform(vectors).agg(F.avg((F.col("count") - F.col("prediction")) ** 2)).first()[0]

    theirs = error(RandomForestRegressor(**options).fit(vectors))
    assert error(model) < 1.3 * theirs + 0.1
    monkeypatch.setattr(forest, "MOST_CELLS", 500)
    few = SparseForestRegressor(**options).fit(vectors)
    assert error(few) == pytest.approx(error(model)) and few.totalNumNodes == model.totalNumNodes
    with pytest.raises(ValueError, match="maxBins"):
        SparseForestRegressor(**{**options, "maxBins": 100}).fit(vectors)


def test_equal_rows_are_stored_once(wide):
    """What a fit holds follows the different rows, not their number."""
    vectors = VectorAssembler(inputCols=["x", "label"], outputCol="features").transform(wide)
    layout = Layout(2, [0, 1], [0, 2001], [[float(v) for v in range(16)], []])
    rows = vectors.select(F.unwrap_udt("features").alias("v"), F.col("count").alias("y"))
    once = SparseForestRegressor._cells(rows, layout)
    many = SparseForestRegressor._cells(rows.unionAll(rows).unionAll(rows), layout)
    assert once.count() == many.count() == wide.select("sensor", "x").distinct().count()
    assert many.agg(F.sum("n")).first()[0] == 3 * once.agg(F.sum("n")).first()[0] == 3 * 12_000


def test_vectors_are_made_once(spark, wide):
    """However many passes a fit makes over them."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = wide.select("x", "count").mapInArrow(counted, "x double, count double")
    model = SparseForestRegressor(featureSubsetStrategy="all", labelCol="count", numTrees=2, maxDepth=3).fit(VectorAssembler(inputCols=["x"], outputCol="features").transform(df))
    assert model.getNumTrees == 2 and seen.value == 12_000


def test_thresholds_beyond_what_the_driver_takes(spark, monkeypatch):
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.range(3000).select(F.col("id").cast("double").alias("x"), (F.col("id") > 1400).cast("double").alias("count")))
    monkeypatch.setattr(forest, "MOST_VALUES", 100)
    model = SparseForestRegressor(featureSubsetStrategy="all", labelCol="count", numTrees=1, bootstrap=False, maxBins=30, maxDepth=3).fit(df)
    (cuts,) = model.numbers[3]
    assert len(cuts) == 29 and np.allclose(np.diff(cuts), 100, atol=2)
    assert model.transform(df).where("abs(prediction - count) > 0.01").count() <= 100


def test_null_labels_fail(spark):
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.createDataFrame([(1.0, 1.0), (2.0, None)], "x double, count double"))
    with pytest.raises(Exception, match="Null"):
        SparseForestRegressor(featureSubsetStrategy="all", labelCol="count").fit(df)


def test_null_vectors_and_labels_fail_as_they_are_read(spark):
    rows = [(1.0, 1.0), (2.0, 2.0)]
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.createDataFrame(rows, "x double, count double"))
    options = {"featureSubsetStrategy": "all", "labelCol": "count", "numTrees": 1}
    with pytest.raises(SparkRuntimeException, match="USER_RAISED_EXCEPTION.*Labels"):
        SparseForestRegressor(**options).fit(df.withColumn("count", F.when(F.col("x") > 1, F.col("count"))))
    missing = F.when(F.col("x") > 1, F.col("features")).alias("features", metadata=df.schema["features"].metadata)
    with pytest.raises(Exception, match="Vectors MUST NOT be Null"):
        SparseForestRegressor(**options).fit(df.select("x", "count", missing))


def test_other_options_stay_with_spark(wide):
    vectors = VectorAssembler(inputCols=["x"], outputCol="features").transform(wide)
    model = SparseForestRegressor(featureSubsetStrategy="onethird", labelCol="count", numTrees=2, maxDepth=2).fit(vectors)
    assert not isinstance(model, SparseForestModel)
