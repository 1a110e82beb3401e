"""Sensors as numbers of fixed width: encoders and models whose per-sensor values are tables.

What is learned for a sensor is a row of a table in the shared folder, found by a join. Nothing that
grows with the number of sensors comes to the driver, and a saved chain takes its tables along.
"""

from __future__ import annotations

import json
import weakref
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorspark.functions.columns import divide
from sensorspark.functions.ordering import hash_order, salted_join
from sensorspark.session import forget, via_table


class _TableWriter(MLWriter):
    """Parameters as usual, and the model's table beside them."""

    def __init__(self, instance: TableModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"numbers": list(self.instance.numbers)})
        self.instance.table.write.parquet(f"{path}/table")


class _TableReader(MLReader):
    def __init__(self, cls: type[TableModel]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TableModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(self.sparkSession.read.parquet(f"{path}/table"), json.loads(json.dumps(metadata["numbers"])))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class TableModel(Model, MLWritable, MLReadable):
    """A model made of a table with one row a sensor and a few numbers."""

    def __init__(self, table: DataFrame, numbers: Sequence[float]):
        super().__init__()
        self.table, self.numbers = table, numbers

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)

    def joined(self, rows: DataFrame, col: str, out: Sequence[str]) -> DataFrame:
        """Rows with the table's columns; null for unknown sensors."""
        small = self.table.select(F.col("sensor").alias("__sensor"), *out)
        keyed = rows.withColumn("__sensor", F.col(col).cast("string"))
        if rows.isStreaming:
            return keyed.join(small, "__sensor", "left").drop("__sensor")
        return salted_join(keyed, small, ["__sensor"]).drop("__sensor")


def fold_of(key: str | Sequence[str], folds: int) -> Column:
    """0 to ``folds`` - 1 from the key's hash."""
    return F.pmod(F.conv(F.substring(hash_order(key, "fold"), 1, 8), 16, 10).cast("bigint"), F.lit(folds)).cast("int")


class _EncoderParams(Params):
    inputCol = Param(Params._dummy(), "inputCol", "label column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "number column", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "target", TypeConverters.toString)
    keyCols = Param(Params._dummy(), "keyCols", "columns whose hash gives a row's fold", TypeConverters.toListString)
    folds = Param(Params._dummy(), "folds", "folds of the rows that are fitted on", TypeConverters.toInt)
    smoothing = Param(Params._dummy(), "smoothing", "rows that the overall mean counts for", TypeConverters.toFloat)


_ENCODER = {"inputCol": "sensor_id", "outputCol": "sensor_mean", "labelCol": "count", "keyCols": ["sensor_id", "reading_ts"], "folds": 5, "smoothing": 10.0}


class TargetEncoding(Estimator, _EncoderParams, DefaultParamsReadable, DefaultParamsWritable):
    """A label as the mean of its target, drawn to the overall mean as if that were ``smoothing`` more
    rows. The very frame that it is fitted on gets the means of the other folds' rows (``Pipeline.fit``
    hands it on to the next stages), so a model that learns from them does not see its own target; any
    other frame, and every frame after reloading, gets the means of all. Unknown labels get the overall
    mean."""

    @keyword_only
    def __init__(self, *, inputCol="sensor_id", outputCol="sensor_mean", labelCol="count", keyCols=("sensor_id", "reading_ts"), folds=5, smoothing=10.0):
        super().__init__()
        self._setDefault(**_ENCODER)
        self._set(**{k: list(v) if k == "keyCols" else v for k, v in self._input_kwargs.items()})

    def _fit(self, dataset: DataFrame) -> TargetEncodingModel:
        col, y, folds = self.getOrDefault("inputCol"), F.col(self.getOrDefault("labelCol")).cast("double"), self.getOrDefault("folds")
        rows = dataset.select(F.col(col).cast("string").alias("sensor"), y.alias("y"), fold_of(self.getOrDefault("keyCols"), folds).alias("fold"))
        used = rows.where(F.col("y").isNotNull() & F.col("sensor").isNotNull())
        of = lambda k, c: F.when(F.col("fold") == k, c)
        sums = used.groupBy("sensor").agg(
            F.array(*[F.count(of(k, F.col("y"))) for k in range(folds)]).alias("n"),
            F.array(*[F.coalesce(F.sum(of(k, F.col("y"))), F.lit(0.0)) for k in range(folds)]).alias("s"),
        )
        table = via_table(sums, "target-encoding")
        add = lambda a, x: a + x
        mean = table.agg(divide(F.sum(F.aggregate("s", F.lit(0.0), add)), F.sum(F.aggregate("n", F.lit(0).cast("bigint"), add)))).first()[0]
        model = TargetEncodingModel(table, [0.0 if mean is None else mean])
        self._copyValues(model)
        # ``Pipeline.fit`` hands the same frame on to the model: those rows get out-of-fold values.
        model._fitted_on = weakref.ref(dataset)
        return model


class TargetEncodingModel(TableModel, _EncoderParams):
    _fitted_on = None

    def __init__(self, table: DataFrame, numbers: Sequence[float]):
        super().__init__(table, numbers)
        self._setDefault(**_ENCODER)

    def encode(self, dataset: DataFrame, out_of_fold: bool) -> DataFrame:
        out, folds = self.getOrDefault("outputCol"), self.getOrDefault("folds")
        add = lambda a, x: a + x
        # Sums over folds are taken for each sensor, not for each of its rows.
        totals = [F.aggregate("n", F.lit(0).cast("bigint"), add).alias("__n"), F.aggregate("s", F.lit(0.0), add).alias("__s")]
        rows = self.joined(dataset.drop(out), self.getOrDefault("inputCol"), ["n", "s", *totals])
        n, s = F.col("__n"), F.col("__s")
        if out_of_fold:
            # Rows without a target took no part, whatever their fold. A column of its own, as its hash is
            # otherwise made anew wherever n and s are used.
            fold = F.when(F.col(self.getOrDefault("labelCol")).isNotNull(), fold_of(self.getOrDefault("keyCols"), folds))
            rows = rows.withColumn("__fold", fold)
            n = n - F.coalesce(F.get("n", F.col("__fold")), F.lit(0))
            s = s - F.coalesce(F.get("s", F.col("__fold")), F.lit(0.0))
        m, prior = F.lit(float(self.getOrDefault("smoothing"))), F.lit(float(self.numbers[0]))
        value = F.coalesce(divide(s + m * prior, n + m), prior)
        return rows.withColumn(out, value).drop("n", "s", "__n", "__s", "__fold")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.encode(dataset, self._fitted_on is not None and self._fitted_on() is dataset)


def ml_target_encode(df: DataFrame, fit_on: DataFrame | None = None, **params) -> DataFrame:
    """``df`` with its sensors as target means (parameters of ``TargetEncoding``): out-of-fold where it
    is fitted on itself, else from all rows of ``fit_on``."""
    model = TargetEncoding(**params).fit(df if fit_on is None else fit_on)
    return model.encode(df, fit_on is None)


# A learned vector for every sensor

#: Rows that a task trains on at a time, about: shards are as many as the rows need.
SHARD_ROWS = 100_000
_BATCH = 512


class _EmbeddingParams(Params):
    sensorCol = Param(Params._dummy(), "sensorCol", "sensor", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "vector of a row's own numbers", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "target", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "prediction", TypeConverters.toString)
    factorSize = Param(Params._dummy(), "factorSize", "numbers of a sensor's vector", TypeConverters.toInt)
    maxIter = Param(Params._dummy(), "maxIter", "passes over the rows", TypeConverters.toInt)
    rounds = Param(Params._dummy(), "rounds", "times that shards meet; passes are dealt to them", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "AdaGrad step", TypeConverters.toFloat)
    regParam = Param(Params._dummy(), "regParam", "pull of all weights to 0", TypeConverters.toFloat)
    shardRows = Param(Params._dummy(), "shardRows", "rows of a shard, about", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)


_EMBEDDING = {
    "sensorCol": "sensor_id", "featuresCol": "features", "labelCol": "count", "predictionCol": "prediction", "factorSize": 8, "maxIter": 24, "rounds": 4,
    "stepSize": 0.2, "regParam": 1e-4, "shardRows": SHARD_ROWS, "seed": 42,
}


def _split(shared: np.ndarray, dim: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the numbers (and a constant), and their projection to the sensors' space."""
    return shared[: dim + 1], shared[dim + 1 :].reshape(k, dim + 1)


def train_shard(x: np.ndarray, y: np.ndarray, sensor: np.ndarray, vectors: np.ndarray, shared: np.ndarray, passes: int, rate: float, decay: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Stochastic gradient descent on one shard's rows: ``x`` (rows x numbers, the last one 1), sensors as
    places in ``vectors`` (bias first). Returns new vectors and shared weights."""
    vectors, shared = vectors.copy(), shared.copy()
    k, dim = vectors.shape[1] - 1, x.shape[1] - 1
    seen_v, seen_s = np.full(vectors.shape, 1e-2), np.full(shared.shape, 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        order = rng.permutation(len(y))
        for at in range(0, len(y), _BATCH):
            rows = order[at : at + _BATCH]
            xb, own = x[rows], sensor[rows]
            w, p = _split(shared, dim, k)
            v, places = vectors[own], xb @ p.T
            error = (xb @ w + v[:, 0] + (v[:, 1:] * places).sum(axis=1) - y[rows]) / len(rows)
            grad_s = np.concatenate([error @ xb, ((v[:, 1:] * error[:, None]).T @ xb).ravel()]) + decay * shared
            touched, inverse, times = np.unique(own, return_inverse=True, return_counts=True)
            grad_v = np.zeros((len(touched), k + 1))
            np.add.at(grad_v, inverse, error[:, None] * np.hstack([np.ones((len(rows), 1)), places]))
            # A sensor's own step follows its own rows, however few of the batch they are.
            grad_v = grad_v * (len(rows) / times)[:, None] + decay * vectors[touched]
            seen_s += grad_s * grad_s
            shared -= rate * grad_s / np.sqrt(seen_s)
            seen_v[touched] += grad_v * grad_v
            vectors[touched] -= rate * grad_v / np.sqrt(seen_v[touched])
    return vectors, shared


class SensorEmbedding(Estimator, _EmbeddingParams, DefaultParamsReadable, DefaultParamsWritable):
    """A regressor with a learned vector for every sensor: constant + weights of the numbers + the
    sensor's bias + its vector times a learned projection of the numbers.

    The vectors are a table. Rows are dealt to shards by sensor, a sensor of many rows to several; a
    task holds one shard's rows and the vectors of its sensors, and descends on them for a few passes.
    Then a sensor's vectors are averaged over its shards and the shared weights over all, weighed by
    rows; the next round goes on from there. Only the shared weights pass through the driver."""

    @keyword_only
    def __init__(
        self, *, sensorCol="sensor_id", featuresCol="features", labelCol="count", predictionCol="prediction", factorSize=8, maxIter=24, rounds=4, stepSize=0.2,
        regParam=1e-4, shardRows=SHARD_ROWS, seed=42,
    ):
        super().__init__()
        self._setDefault(**_EMBEDDING)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> SensorEmbeddingModel:
        get = self.getOrDefault
        k, shard_rows, seed, rate, decay = (get(n) for n in ("factorSize", "shardRows", "seed", "stepSize", "regParam"))
        rows = dataset.select(
            F.coalesce(F.col(get("sensorCol")).cast("string"), F.lit("")).alias("sensor"), vector_to_array(get("featuresCol")).alias("x"), F.col(get("labelCol")).cast("double").alias("y")
        )
        rows = via_table(rows.dropna(), "embedding-rows")
        n, mean, sd, dim = rows.agg(F.count("y"), F.avg("y"), F.stddev_pop("y"), F.max(F.size("x"))).first()
        schema = "sensor string, weight double, " + ", ".join(f"e{i} double" for i in range(k + 1)) + ", shared array<double>"
        if not n:
            empty = dataset.sparkSession.createDataFrame([], schema).drop("weight", "shared")
            return self._copyValues(SensorEmbeddingModel(empty, [0.0, 1.0, 0, k]))
        sd = sd or 1.0
        counts = rows.groupBy("sensor").agg(F.ceil(F.count("y") / shard_rows).cast("int").alias("parts"))
        own = F.xxhash64("x", "y", F.lit(seed))
        salted = salted_join(rows, counts, ["sensor"]).withColumn("salt", F.pmod(own, F.col("parts")).cast("int"))
        shards = -(-n // shard_rows)
        dealt = via_table(salted.select("sensor", "x", "y", F.pmod(F.xxhash64("sensor", "salt", F.lit(seed)), F.lit(shards)).cast("int").alias("shard")), "embedding-shards")
        places = via_table(dealt.select("shard", "sensor").distinct(), "embedding-places")
        rng = np.random.default_rng(seed)
        shared = np.concatenate([np.zeros(dim + 1), rng.normal(scale=0.3, size=k * (dim + 1))])
        rounds = max(1, min(get("rounds"), get("maxIter")))
        vectors: DataFrame | None = None
        cols = [f"e{i}" for i in range(k + 1)]
        for r in range(rounds):
            passes = get("maxIter") // rounds + (r < get("maxIter") % rounds)
            if vectors is None:
                start = places.select("shard", "sensor", *[F.lit(0.0).alias(c) for c in cols])
            else:
                start = places.join(vectors, "sensor").select("shard", "sensor", *cols)

            def train(key: tuple, held: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
                known = known.sort_values("sensor", ignore_index=True)
                held = held.sort_values(["sensor", "y"], ignore_index=True)
                at = np.searchsorted(known["sensor"].to_numpy(str), held["sensor"].to_numpy(str))
                x = np.hstack([np.stack(held["x"].to_numpy()), np.ones((len(held), 1))])
                begin = known[cols].to_numpy()
                if r == 0:
                    begin = begin + np.hstack([np.zeros((len(begin), 1)), np.random.default_rng([seed, key[0]]).normal(scale=0.1, size=(len(begin), k))])
                made, after = train_shard(x, (held["y"].to_numpy() - mean) / sd, at, begin, shared, passes, rate, decay, seed + 1000 * r + key[0])
                out = pd.DataFrame(made, columns=cols)
                out.insert(0, "weight", np.bincount(at, minlength=len(known)).astype(float))
                out.insert(0, "sensor", known["sensor"])
                out["shared"] = None
                total = pd.DataFrame([[None, float(len(held)), *[0.0] * (k + 1), after.tolist()]], columns=out.columns)
                return pd.concat([out, total], ignore_index=True)

            made = via_table(dealt.groupBy("shard").cogroup(start.groupBy("shard")).applyInPandas(train, schema), "embedding-round")
            weight = F.col("weight")
            mine = made.where("sensor IS NOT NULL").groupBy("sensor").agg(*[(F.sum(weight * F.col(c)) / F.sum(weight)).alias(c) for c in cols])
            new = via_table(mine, "embedding-vectors")
            parts = made.where("sensor IS NULL").select("weight", F.posexplode("shared").alias("at", "v"))
            averaged = parts.groupBy("at").agg((F.sum(weight * F.col("v")) / F.sum(weight)).alias("v"))
            shared = np.array([r["v"] for r in averaged.orderBy("at").collect()])
            forget(made, *([] if vectors is None else [vectors]))
            vectors = new
        forget(rows, dealt, places)
        return self._copyValues(SensorEmbeddingModel(vectors, [mean, sd, dim, k, *shared.tolist()]))


class SensorEmbeddingModel(TableModel, _EmbeddingParams):
    """``table``: sensor, e0 (bias), e1 ... (vector). A sensor that is not in it has the vector 0."""

    def __init__(self, table: DataFrame, numbers: Sequence[float]):
        super().__init__(table, numbers)
        self._setDefault(**_EMBEDDING)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        mean, sd, dim, k, *shared = self.numbers
        dim, k = int(dim), int(k)
        out = self.getOrDefault("predictionCol")
        if not shared:
            return dataset.withColumn(out, F.lit(mean))
        cols = [f"e{i}" for i in range(k + 1)]
        rows = dataset.drop(out).withColumn("__at", F.coalesce(F.col(self.getOrDefault("sensorCol")).cast("string"), F.lit("")))
        rows = self.joined(rows, "__at", [F.col(c).alias(f"__{c}") for c in cols])
        w, p = _split(np.array(shared), dim, k)
        x = vector_to_array(self.getOrDefault("featuresCol"))
        # The numbers' weights as this sensor has them: shared ones and those by its vector.
        of = [F.coalesce(F.col(f"__{c}"), F.lit(0.0)) for c in cols]
        total = F.lit(float(w[dim])) + of[0]
        for j in range(k):
            total = total + of[j + 1] * float(p[j, dim])
        for i in range(dim):
            weight = F.lit(float(w[i]))
            for j in range(k):
                weight = weight + of[j + 1] * float(p[j, i])
            total = total + x[i] * weight
        return rows.withColumn(out, F.lit(float(mean)) + total * float(sd)).drop("__at", *[f"__{c}" for c in cols])
