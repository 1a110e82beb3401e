"""Thresholds, peaks, top-k and latest rows.

Latest and best rows are aggregates (``max_by``), which combine before the shuffle; windows are
used only with a row limit that is applied to each part first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorspark.functions.columns import micros
from sensorspark.functions.ordering import first_rows, quantiles, salted_join, top_k_per_group
from sensorspark.schema import ROLES, Roles


def win_group_threshold(df: DataFrame, stat: str = "mean", fit_on: DataFrame | None = None,
                        roles: Roles = ROLES) -> DataFrame:
    """``affluence`` = 1 where a count is strictly above its sensor's mean or median. ``fit_on``
    takes the thresholds from another frame (the training part); a sensor it lacks gives 0."""
    base = df if fit_on is None else fit_on
    if stat == "mean":
        limits = base.groupBy(roles.sensor).agg(F.avg(roles.value).alias("threshold"))
    elif stat == "median":
        limits = quantiles(base, [roles.sensor], roles.value, {"threshold": 0.5})
    else:
        raise ValueError(f"stat: {stat}")
    busy = F.col(roles.value) > F.col("threshold")
    joined = salted_join(df, limits, [roles.sensor])
    return joined.select(*df.columns, "threshold", F.when(busy, 1).otherwise(0).alias("affluence"))


def win_peak_per_sensor(df: DataFrame, roles: Roles = ROLES) -> DataFrame:
    """Per sensor: the highest mean of one timestamp, and the first timestamp that reaches it."""
    means = df.groupBy(roles.sensor, roles.ts).agg(F.avg(roles.value).alias("m"))
    order = F.struct(F.col("m"), -micros(F.col(roles.ts)))
    return means.groupBy(roles.sensor).agg(
        F.max("m").alias("peak_value"), F.max_by(roles.ts, order).alias("peak_ts")
    )


def win_top_peaks(df: DataFrame, k: int = 20, roles: Roles = ROLES) -> DataFrame:
    """The ``k`` sensors with the highest peaks."""
    return (
        win_peak_per_sensor(df, roles)
        .orderBy(F.desc("peak_value"), roles.sensor)
        .limit(k)
        .withColumn("peak_at", F.date_format("peak_ts", "yyyy-MM-dd HH:mm"))
    )


def win_top_sensors(df: DataFrame, k: int = 10, roles: Roles = ROLES) -> DataFrame:
    totals = df.groupBy(roles.sensor).agg(F.sum(roles.value).alias("total"))
    return totals.orderBy(F.desc("total"), roles.sensor).limit(k)


def win_top_with_membership(a: DataFrame, b: DataFrame, k: int = 10, roles: Roles = ROLES) -> DataFrame:
    """The ``k`` sensors of ``a`` with most rows, their share, and whether ``b`` has them."""
    counts = a.groupBy(roles.sensor).agg(F.count(F.lit(1)).alias("n_rows"))
    total = counts.agg(F.sum("n_rows")).scalar()
    top = counts.orderBy(F.desc("n_rows"), roles.sensor).limit(k)
    other = b.select(F.col(roles.sensor).alias("__s")).distinct()
    return (
        top.join(other, F.col(roles.sensor) == F.col("__s"), "left")
        .withColumn("pct", F.col("n_rows") * 100.0 / total)
        .withColumn("in_other", F.col("__s").isNotNull())
        .drop("__s")
    )


def win_last_n_sorted(df: DataFrame, n: int = 500, key: Sequence[str] = ("sensor_id",),
                      roles: Roles = ROLES) -> DataFrame:
    """The newest ``n`` rows; the key breaks ties."""
    return first_rows(df, [F.desc(roles.ts), *[F.col(k) for k in key]], n)


def win_per_day_limit(df: DataFrame, k: int, day_col: str = "reading_date",
                      order_by: Sequence[str | Column] = ("reading_ts", "sensor_id")) -> DataFrame:
    """At most ``k`` rows per day."""
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    return top_k_per_group(df, [day_col], order, k)


def _latest(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in by]
    # The other columns settle what the order leaves open, so reruns agree.
    order = [*order, *[c for c in rest if c not in order]]
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")
    return df.groupBy(*by).agg(row).select(*by, "__r.*").select(*df.columns)


def win_latest_success(runs: DataFrame, by: Sequence[str] = ("pipeline_id",)) -> DataFrame:
    """The most recent successful run of each pipeline."""
    return _latest(runs.where(F.col("state") == "success"), by, ["start_ts", "run_id"])


def win_latest_prediction(pred: DataFrame, roles: Roles = ROLES) -> DataFrame:
    """The newest prediction of each (sensor, time); ties go to the larger version and value."""
    ties = [c for c in ("prediction_ts", "model_version", "prediction") if c in pred.columns]
    return _latest(pred, [roles.sensor, roles.ts], ties)
