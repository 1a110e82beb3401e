"""Feature columns and the persistable transformers built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorspark.functions.columns import cyclic, year_index
from sensorspark.functions.ordering import running, salted_join, with_bucket
from sensorspark.operators.encode import TargetEncoding
from sensorspark.operators.clean import (
    prj_calendar_parts,
    prj_downcast,
    prj_drop_unused,
    prj_split_coords,
)
from sensorspark.schema import LOCAL_TIME_ZONE, YEAR_BASE, Roles
from sensorspark.session import forget, via_table

NUMERIC_FEATURES = ["day", "year_idx", "hour_sin", "hour_cos", "month_sin", "month_cos"]


def ml_cyclical_features(df: DataFrame, year_base: int | None = YEAR_BASE) -> DataFrame:
    """sin/cos of hour and month and the year index; hour and month themselves go."""
    hour_sin, hour_cos = cyclic(F.col("hour"), 24)
    month_sin, month_cos = cyclic(F.col("month"), 12)
    return df.withColumns(
        {
            "hour_sin": hour_sin,
            "hour_cos": hour_cos,
            "month_sin": month_sin,
            "month_cos": month_cos,
            "year_idx": year_index(F.col("year"), year_base),
        }
    ).drop("hour", "month")


class CleanReadings(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Local calendar parts, coordinates as numbers, unused columns dropped. Keys and the target
    stay, so scored rows can be joined."""

    tz = Param(Params._dummy(), "tz", "time zone of the calendar", TypeConverters.toString)
    tsCol = Param(Params._dummy(), "tsCol", "timestamp column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, tz: str = LOCAL_TIME_ZONE, tsCol: str = "reading_ts"):
        super().__init__()
        self._setDefault(tz=LOCAL_TIME_ZONE, tsCol="reading_ts")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = prj_calendar_parts(
            dataset, self.getOrDefault(self.tz), Roles(ts=self.getOrDefault(self.tsCol))
        )
        if "coordonnées_géographiques" in out.columns:
            out = prj_split_coords(out)
        return prj_downcast(prj_drop_unused(out))


class TimeFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """``ml_cyclical_features`` as a stage; hour and month are kept where ``keepParts`` is set."""

    yearBase = Param(Params._dummy(), "yearBase", "year of index 0, -1: known years only", TypeConverters.toInt)
    keepParts = Param(Params._dummy(), "keepParts", "keep hour and month", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, yearBase: int = YEAR_BASE, keepParts: bool = False):
        super().__init__()
        self._setDefault(yearBase=YEAR_BASE, keepParts=False)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        base = self.getOrDefault(self.yearBase)
        out = ml_cyclical_features(
            dataset.withColumns({"__h": F.col("hour"), "__m": F.col("month")}),
            None if base < 0 else base,
        )
        if self.getOrDefault(self.keepParts):
            out = out.withColumns({"hour": F.col("__h"), "month": F.col("__m")})
        return out.drop("__h", "__m")


def clean_stages(year_base: int = YEAR_BASE, keep_parts: bool = False) -> list[Transformer]:
    return [CleanReadings(), TimeFeatures(yearBase=year_base, keepParts=keep_parts)]


def ml_clean_pipeline(year_base: int = YEAR_BASE) -> Pipeline:
    return Pipeline(stages=clean_stages(year_base))


def ml_label_encode(df: DataFrame, col: str = "sensor_id", out: str = "sensor_idx") -> DataFrame:
    """Alphabetical index of a label, from 0; null gets the index after all others. Labels are ranked
    bucket by bucket (their first bytes are the bucket) and joined back by salted key: any number of
    them fits, none comes to the driver."""
    labels = df.where(F.col(col).isNotNull()).select(F.col(col).cast("string").alias("__label")).distinct()
    first = F.rpad(F.hex(F.substring(F.col("__label").cast("binary"), 1, 6)), 12, "0")
    placed = with_bucket(labels.withColumn("__first", F.conv(first, 16, 10).cast("double")), "__first")
    ranks = running(placed, [], "__label", measures={"__rank": ("sum", F.lit(1))})
    table = ranks.select("__label", (F.col("__rank") - 1).cast("int").alias("__idx"))
    total = labels.agg(F.count(F.lit(1)).cast("int")).scalar()
    rows = df.withColumn("__label", F.col(col).cast("string"))
    return salted_join(rows, table, ["__label"]).select(*df.columns, F.coalesce("__idx", total).alias(out))


def one_hot_stages(cols: Sequence[str]) -> list:
    """Alphabetical labels to 0/1 vectors ``<col>_vec``; a label not seen in fitting is all zeros."""
    idx = [f"{c}_label" for c in cols]
    return [
        StringIndexer(
            inputCols=list(cols), outputCols=idx, stringOrderType="alphabetAsc", handleInvalid="keep"
        ),
        OneHotEncoder(inputCols=idx, outputCols=[f"{c}_vec" for c in cols], dropLast=True),
    ]


def ml_one_hot(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    fitted = Pipeline(stages=one_hot_stages(cols)).fit(df if fit_on is None else fit_on)
    return fitted.transform(df).drop(*[f"{c}_label" for c in cols])


def ml_standardize(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Z-scores with the population standard deviation (a constant column gives 0), as ``<col>_z``."""
    base = df if fit_on is None else fit_on
    moments = base.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
            *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)],
        ).alias("m")
    ).scalar()
    z = {}
    for i, c in enumerate(cols):
        sd = moments[f"s_{i}"]
        z[f"{c}_z"] = (F.col(c) - moments[f"m_{i}"]) / F.when(sd == 0, 1.0).otherwise(sd)
    return df.withColumns(z)


def feature_stages(
    with_sensor: bool = True,
    extra: Sequence[str] = (),
    year_base: int = YEAR_BASE,
    sensor_as: str = "one_hot",
    label: str = "count",
) -> list:
    """The fixed feature set: weekday and sensor one-hot, six scaled numbers, extra numbers as they
    are. Output column ``features``.

    ``sensor_as="target"`` gives the sensor as the mean of its target in other folds (one column, a table
    of sensors, nothing on the driver), ``"category"`` as one categorical feature, which trees split by
    groups of sensors (the labels are on the driver, as with one-hot columns)."""
    if sensor_as not in ("one_hot", "category", "target"):
        raise ValueError(f"sensor_as: {sensor_as}")
    hot = ["weekday"]
    sensor, stages = [], []
    if with_sensor and sensor_as == "one_hot":
        hot.append("sensor_id")
    elif with_sensor and sensor_as == "target":
        sensor, stages = ["sensor_mean"], [TargetEncoding(labelCol=label)]
    elif with_sensor:
        sensor = ["sensor_id_label"]
        stages = [
            StringIndexer(
                inputCol="sensor_id",
                outputCol="sensor_id_label",
                stringOrderType="alphabetAsc",
                handleInvalid="keep",
            )
        ]
    return [
        *clean_stages(year_base),
        *stages,
        *one_hot_stages(hot),
        VectorAssembler(inputCols=NUMERIC_FEATURES, outputCol="numbers"),
        StandardScaler(inputCol="numbers", outputCol="numbers_z", withMean=True, withStd=True),
        VectorAssembler(
            inputCols=[*[f"{c}_vec" for c in hot], *sensor, "numbers_z", *extra],
            outputCol="features",
        ),
    ]


class StoredPipeline(Pipeline):
    """A chain whose estimators are fitted on stored rows: the stages before the first estimator run
    once, over one scan of the input, and ``columns`` of what they give are written for the passes of
    all estimators. The fitted chain is that of a plain ``Pipeline``."""

    def __init__(self, stages: Sequence, columns: Sequence[str]):
        super().__init__(stages=list(stages))
        self.columns = list(dict.fromkeys(columns))

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        stages = self.getStages()
        first = next(i for i, stage in enumerate(stages) if isinstance(stage, Estimator))
        rows = via_table(PipelineModel(stages[:first]).transform(dataset).select(*self.columns), "fit-rows")
        fitted = Pipeline(stages=stages[first:]).fit(rows)
        forget(rows)
        return PipelineModel([*stages[:first], *fitted.stages])


def ml_assemble(
    df: DataFrame, features: Sequence[str] | None = None, year_base: int = YEAR_BASE, sensor_as: str = "one_hot"
) -> DataFrame:
    """Readings with their feature vector: the fixed set, or the named numeric columns. Its width
    follows the sensors only with ``sensor_as="one_hot"``."""
    if features is not None:
        return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)
    return Pipeline(stages=feature_stages(year_base=year_base, sensor_as=sensor_as)).fit(df).transform(df)


def vector_width(col: str) -> Column:
    """The number of entries of a vector, stored or not."""
    v = F.unwrap_udt(col)
    return F.coalesce(v["size"], F.size(v["values"]))


def vector_total(col: str) -> Column:
    """The sum of a vector's entries, from the stored ones: the others are 0."""
    return F.aggregate(F.unwrap_udt(col)["values"], F.lit(0.0), lambda a, x: a + x)
