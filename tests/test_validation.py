"""Cross-validation fits what it returns and nothing else."""

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from sensorspark.operators.encode import fold_of
from sensorspark.operators.models import ml_cross_validate


class Counted(Pipeline):
    fits = 0

    def _fit(self, dataset):
        Counted.fits += 1
        return super()._fit(dataset)


def test_as_many_fits_as_folds(spark):
    df = spark.range(400).select("id", F.col("id").cast("double").alias("x"), (F.col("id") * 2 + F.col("id") % 7 * 40).cast("double").alias("count"))
    est = Counted(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression(labelCol="count")])
    Counted.fits = 0
    got = ml_cross_validate(df, est, folds=4, key="id").first()
    assert Counted.fits == 4
    rows, scores = df.withColumn("fold", fold_of("id", 4)), []
    for k in range(4):
        model = est.fit(rows.where(F.col("fold") != k))
        scores.append(RegressionEvaluator(labelCol="count", metricName="r2").evaluate(model.transform(rows.where(F.col("fold") == k))))
    assert got["mean"] == pytest.approx(np.mean(scores)) and got["std"] == pytest.approx(np.std(scores)) and got.folds == 4
    with pytest.raises(ValueError, match="folds"):
        ml_cross_validate(df.limit(1), est, folds=4, key="id")
