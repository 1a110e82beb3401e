"""Spark ML models over readings: fit, score, compare, save."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import (
    GBTRegressor,
    LinearRegression,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorspark.functions.columns import ts_of
from sensorspark.functions.ordering import salted_join
from sensorspark.operators.clean import prj_calendar_parts
from sensorspark.operators.combine import set_concat_align, set_schema_gate
from sensorspark.operators.encode import SensorEmbedding, fold_of
from sensorspark.operators.evaluate import evl_regression
from sensorspark.operators.features import NUMERIC_FEATURES, StoredPipeline, clean_stages, feature_stages
from sensorspark.operators.forest import SparseForestRegressor
from sensorspark.operators.split import spl_holdout
from sensorspark.schema import LOCAL_TIME_ZONE, ROLES, YEAR_BASE, Roles
from sensorspark.session import forget, via_table

MIN_CURRENT_ROWS = 200  # fixed value: the usual gate of ``ml_train_window``
# Deep forests: many nodes in each pass over the rows, and each row's nodes kept instead of found anew.
FOREST = {"maxMemoryInMB": 1024, "cacheNodeIds": True}
ABLATION_MARGIN = 0.05  # fixed value: R² differences below this do not count


def ml_rf_regressor(
    label: str = "count",
    num_trees: int = 50,
    max_depth: int = 20,
    seed: int = 42,
    with_sensor: bool = True,
    extra: Sequence[str] = (),
    year_base: int = YEAR_BASE,
    sensor_as: str = "target",
    **params,
) -> Pipeline:
    """Features and a random forest that looks at every feature in each split. The sensor is one
    column, the mean of its target in other folds; ``sensor_as="one_hot"`` has a column for each
    sensor, ``"category"`` one that needs ``maxBins`` above their number."""
    forest = SparseForestRegressor(
        featuresCol="features",
        labelCol=label,
        numTrees=num_trees,
        maxDepth=max_depth,
        seed=seed,
        featureSubsetStrategy="all",
        **{**FOREST, **params},
    )
    # A row's fold in the sensor's mean follows from its sensor and time.
    keys = ["sensor_id", "reading_ts"] if with_sensor else []
    return StoredPipeline(
        [*feature_stages(with_sensor, extra, year_base, sensor_as, label), forest],
        [*keys, label, "weekday", *NUMERIC_FEATURES, *extra],
    )


class LeanForestClassifier(RandomForestClassifier):
    """A forest whose model leaves its training summary behind: that holds the session, which tasks
    cannot take along once the session observes anything."""

    def _fit(self, dataset: DataFrame):
        model = super()._fit(dataset)
        model._java_obj.setSummary(dataset.sparkSession._jvm.scala.Option.empty())
        return model


def ml_rf_classifier(
    label: str = "affluence", num_trees: int = 100, max_depth: int = 20, seed: int = 42, **params
) -> Pipeline:
    """Busy/quiet forest on hour, day, month, weekday, year and the sensor's index. The index is a
    plain number, as any number of sensors must fit. An unknown sensor gets the next index."""
    return Pipeline(
        stages=[
            *clean_stages(keep_parts=True),
            StringIndexer(
                inputCol="sensor_id",
                outputCol="sensor_label",
                stringOrderType="alphabetAsc",
                handleInvalid="keep",
            ),
            SQLTransformer(statement="SELECT *, CAST(sensor_label AS INT) AS sensor_idx FROM __THIS__"),
            VectorAssembler(
                inputCols=["hour", "day", "month", "weekday", "year", "sensor_idx"],
                outputCol="features",
            ),
            LeanForestClassifier(
                featuresCol="features",
                labelCol=label,
                numTrees=num_trees,
                maxDepth=max_depth,
                seed=seed,
                **{**FOREST, **params},
            ),
        ]
    )


def ml_embedding_regressor(
    factor_size: int = 8, label: str = "count", seed: int = 42, year_base: int = YEAR_BASE, **params
) -> Pipeline:
    """A learned vector per sensor, a table that is trained in shards by stochastic gradient descent
    (``SensorEmbedding``), over weekday and scaled numbers."""
    fit = SensorEmbedding(labelCol=label, factorSize=factor_size, seed=seed, **params)
    return Pipeline(stages=[*feature_stages(False, year_base=year_base), fit])


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores for fitting, which passes over them many times: a frame read from few
    files would keep most of the cluster idle."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


@dataclass
class TrainResult:
    model: PipelineModel
    train: DataFrame
    test_current: DataFrame
    sliding_window: bool
    reason: str
    n_current: int = 0  # current rows in ``train``


def ml_train_window(
    baseline: DataFrame,
    current: DataFrame | None,
    estimator: Pipeline,
    key: Sequence[str] = ("sensor_id", "reading_ts"),
    min_rows: int | None = None,
) -> TrainResult:
    """Fit on the baseline plus 80 % of current data; on the baseline alone, with the ``reason``, when
    current data is absent or has too different columns, or fewer rows than a caller's ``min_rows``
    (``MIN_CURRENT_ROWS`` is the usual gate). All current rows that are not trained on come back for
    evaluation."""
    train, test, reason, n_current = baseline, baseline.limit(0), "no current data", 0
    if current is not None:
        split = spl_holdout(current, key=key)
        test, reason = current, ""
        if split.n_train + split.n_test < (min_rows or 1):
            reason = f"fewer than {min_rows} current rows" if min_rows else "no current data"
        elif not set_schema_gate(baseline, current):
            reason = "columns differ"
        else:
            train, test, n_current = set_concat_align(baseline, split.train), split.test, split.n_train
    return TrainResult(estimator.fit(spread(train)), train, test, not reason, reason, n_current)


def ml_batch_score(
    model: PipelineModel,
    df: DataFrame,
    tags: Mapping[str, str] | None = None,
    now: Column | datetime | str | None = None,
    roles: Roles = ROLES,
) -> DataFrame:
    """A scored table in one job: keys, actual value where known, prediction and tags."""
    kept = [c for c in (roles.sensor, roles.ts, roles.value) if c in df.columns]
    stamp = F.localtimestamp() if now is None else ts_of(now)
    return model.transform(df).select(
        *kept,
        "prediction",
        *[F.lit(v).alias(k) for k, v in (tags or {}).items()],
        stamp.alias("prediction_ts"),
        F.to_date(roles.ts).alias("pred_date"),
    )


def ml_profile_score(
    train: DataFrame, df: DataFrame, tz: str = LOCAL_TIME_ZONE, roles: Roles = ROLES
) -> DataFrame:
    """Predicts the mean of the same sensor, weekday and hour in training, else the overall mean.
    The profile has at most 168 rows per sensor; the join is left to adaptive execution."""
    keys = [roles.sensor, "weekday", "hour"]
    sums = (
        prj_calendar_parts(train, tz, roles)
        .groupBy(*keys)
        .agg(F.sum(roles.value).alias("__s"), F.count(roles.value).alias("__n"))
    )
    profile = sums.select(*keys, (F.col("__s") / F.col("__n")).alias("__mean"))
    # The overall mean follows from the same sums.
    overall = sums.agg(F.sum("__s") / F.sum("__n")).scalar()
    parts = prj_calendar_parts(df, tz, roles)
    return (
        salted_join(parts, profile, keys)
        .withColumn("prediction", F.coalesce("__mean", overall))
        .select(*df.columns, "prediction")
    )


def feature_names(df: DataFrame, col: str = "features") -> list[str]:
    """Names of a vector column's entries, from its metadata."""
    groups = df.schema[col].metadata["ml_attr"]["attrs"]
    entries = [a for kind in groups.values() for a in kind]
    return [a.get("name", str(a["idx"])) for a in sorted(entries, key=lambda a: a["idx"])]


def ml_feature_importance(model: PipelineModel, df: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most important features of a fitted forest, coordinates counted as one. ``df`` is
    any frame the model can score; only its schema is used."""
    names = feature_names(model.transform(df))
    weights = model.stages[-1].featureImportances.toArray()
    summed: dict[str, float] = {}
    for name, w in zip(names, weights):
        name = "latitude+longitude" if name in ("latitude", "longitude") else name
        summed[name] = summed.get(name, 0.0) + float(w)
    top = sorted(summed.items(), key=lambda e: (-e[1], e[0]))[:k]
    return df.sparkSession.createDataFrame(
        [(i + 1, n, w) for i, (n, w) in enumerate(top)], "position int, feature string, importance double"
    )


def ml_ablation(
    df: DataFrame,
    with_it: Pipeline,
    without_it: Pipeline,
    key: Sequence[str] = ("sensor_id", "reading_ts"),
    y: str = "count",
) -> DataFrame:
    """Two fits on the same split, with and without a feature, and whether to keep it: a gain in
    R² above the margin keeps it, anything else drops it."""
    train, test, *_ = spl_holdout(df, key=key)
    rows = None
    for name, est in (("with_feature", with_it), ("without_feature", without_it)):
        m = evl_regression(est.fit(spread(train)).transform(test), y, "prediction").withColumn(
            "variant", F.lit(name)
        )
        rows = m if rows is None else rows.unionByName(m)

    def of(variant: str, col: str) -> Column:
        return F.max(F.when(F.col("variant") == variant, F.col(col)))

    d = F.col("r2_gain")
    return rows.agg(
        *[of(v, c).alias(f"{c}_{v}") for v in ("with_feature", "without_feature") for c in ("r2", "rmse")]
    ).withColumns(
        {
            "r2_gain": F.col("r2_with_feature") - F.col("r2_without_feature"),
            "rmse_gain": F.col("rmse_without_feature") - F.col("rmse_with_feature"),
        }
    ).withColumn(
        "advice",
        F.when(F.abs(d) < ABLATION_MARGIN, "drop").when(d > ABLATION_MARGIN, "keep").otherwise("drop"),
    )


def ml_cross_validate(
    df: DataFrame,
    estimator: Pipeline,
    folds: int = 3,
    key: str | Sequence[str] = ("sensor_id", "reading_ts"),
    y: str = "count",
    metric: str = "r2",
) -> DataFrame:
    """Mean and standard deviation of a metric over folds. Folds follow the key's hash, so they do
    not change with partitioning. As many fits as folds: no model of all rows, which nobody gets, is
    fitted besides."""
    evaluator = RegressionEvaluator(labelCol=y, metricName=metric)
    rows = via_table(spread(df).withColumn("fold", fold_of(key, folds)), "folds")
    sizes = dict(rows.groupBy("fold").count().collect())
    if set(sizes) != set(range(folds)) or folds < 2:
        raise ValueError(f"rows must fill {folds} folds, 2 or more: {sizes}")
    scores = []
    for k in range(folds):
        model = estimator.fit(rows.where(F.col("fold") != k))
        scores.append(evaluator.evaluate(model.transform(rows.where(F.col("fold") == k))))
    forget(rows)
    return df.sparkSession.createDataFrame(
        [(metric, folds, float(np.mean(scores)), float(np.std(scores)))],
        "metric string, folds int, mean double, std double",
    )


def baseline_estimators(label: str = "count", year_base: int = YEAR_BASE) -> dict[str, Pipeline]:
    stages = feature_stages(year_base=year_base, sensor_as="target", label=label)
    return {
        "linear": Pipeline(stages=[*stages, LinearRegression(labelCol=label, regParam=0.01)]),
        "boosted_trees": Pipeline(
            stages=[*stages, GBTRegressor(labelCol=label, maxIter=20, maxDepth=5, seed=42)]
        ),
    }


def ml_baselines(
    df: DataFrame,
    estimators: Mapping[str, Pipeline] | None = None,
    key: Sequence[str] = ("sensor_id", "reading_ts"),
    y: str = "count",
) -> DataFrame:
    """Comparison models on one split: metrics per model."""
    train, test, *_ = spl_holdout(df, key=key)
    rows = None
    for name, est in (estimators or baseline_estimators(y)).items():
        m = evl_regression(est.fit(spread(train)).transform(test), y, "prediction").select(
            F.lit(name).alias("model"), "*"
        )
        rows = m if rows is None else rows.unionByName(m)
    return rows


def ml_save_load(model: PipelineModel, path: str) -> PipelineModel:
    """Write a fitted chain and read it back."""
    model.write().overwrite().save(path)
    return PipelineModel.load(path)

