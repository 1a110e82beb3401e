"""Joins between readings, predictions and sources.

Equal rows are collapsed to one row with a multiplicity before any join, so many copies of a key
never multiply into pairs. Joins stay unhinted: adaptive execution broadcasts only what it has
measured to be small and splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorspark.functions.bloom import bloom_prefilter
from sensorspark.functions.columns import since, ts_of
from sensorspark.operators.ranking import win_latest_prediction
from sensorspark.schema import ROLES, Roles


def collapse(df: DataFrame, out: str) -> DataFrame:
    """Distinct rows with their number of copies."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(out))


def jn_pred_actual(
    pred: DataFrame,
    actual: DataFrame,
    now: Column | datetime | str,
    days: int = 7,
    latest_only: bool = False,
    model_version: str | None = None,
    roles: Roles = ROLES,
) -> DataFrame:
    """Predictions with the actual value of the same sensor and time, both of the last ``days``.

    A reading scored several times matches once per prediction, as stored; ``latest_only`` keeps
    the newest prediction, ``model_version`` one model. ``n_rows`` counts how many (prediction,
    actual) row pairs an output row stands for; metrics take it as weight.
    """
    start = ts_of(now) - F.expr(f"INTERVAL {days} DAYS")
    keys = [roles.sensor, roles.ts]
    p = since(pred, roles.ts, start, day="pred_date")
    if model_version is not None:
        p = p.where(F.col("model_version") == model_version)
    extra = [c for c in ("model_type", "model_version", "prediction_ts") if c in pred.columns]
    if latest_only:
        p = win_latest_prediction(p, roles=roles)
    p = collapse(p.select(*keys, "prediction", *extra), "__p")
    a = since(actual, roles.ts, start).where(F.col(roles.value).isNotNull())
    a = collapse(a.select(*keys, roles.value), "__a")
    return p.join(a, keys).withColumn("n_rows", F.col("__p") * F.col("__a")).drop("__p", "__a")


def jn_source_match(
    a: DataFrame, b: DataFrame, key: str = "sensor_key", hour: str = "date_hour", roles: Roles = ROLES
) -> DataFrame:
    """Sources matched on (sensor key, hour): one row per matched key with the row counts and sums
    of both sides. ``pairs`` is the number of row pairs the match stands for; the pairs themselves
    are never made, their statistics follow from the sums."""

    def side(df: DataFrame, s: str) -> DataFrame:
        v = F.col(roles.value).cast("double")
        return df.groupBy(key, hour).agg(
            F.count(roles.value).alias(f"n_{s}"),
            F.sum(v).alias(f"sum_{s}"),
            F.sum(v * v).alias(f"sum2_{s}"),
            (F.var_pop(v) * F.count(v)).alias(f"dev2_{s}"),
        )

    return (
        side(a, "a")
        .join(side(b, "b"), [key, hour])
        .withColumn("pairs", F.col("n_a") * F.col("n_b"))
    )


def match_rate(matched: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Matched pairs as a share of the smaller source, in one row."""
    sizes = a.select(F.lit("a").alias("side")).unionAll(b.select(F.lit("b").alias("side")))
    counts = (
        sizes.groupBy().agg(
            F.count(F.when(F.col("side") == "a", 1)).alias("rows_a"),
            F.count(F.when(F.col("side") == "b", 1)).alias("rows_b"),
        )
    )
    found = matched.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("matched"))
    smaller = F.least("rows_a", "rows_b")
    return counts.withColumn("matched", found.scalar()).withColumn(
        "match_rate", F.when(smaller > 0, F.col("matched") * 100.0 / smaller)
    )


def jn_known_semi(df: DataFrame, known: DataFrame, roles: Roles = ROLES, prefilter: bool = False) -> DataFrame:
    """Rows whose sensor is known. ``prefilter`` is for known sets too large to broadcast: a Bloom filter
    of them (1 MB) drops nearly all other rows where they lie, so the exact join shuffles few."""
    labels = known.select(roles.sensor).distinct()
    rows = bloom_prefilter(df, labels, [roles.sensor]) if prefilter else df
    return rows.join(labels, roles.sensor, "left_semi")


def unknown_rows(df: DataFrame, known: DataFrame, roles: Roles = ROLES) -> DataFrame:
    return df.join(known.select(roles.sensor).distinct(), roles.sensor, "left_anti")


def jn_unknown_anti(df: DataFrame, known: DataFrame, roles: Roles = ROLES) -> DataFrame:
    """One row per unknown sensor with its rows and share of all rows (a table, as the list can be
    long). Rows are counted per sensor before the join, so the join sees sensors, not readings."""
    per_sensor = df.groupBy(roles.sensor).agg(F.count(F.lit(1)).alias("n_rows"))
    total = per_sensor.agg(F.sum("n_rows")).scalar()
    return unknown_rows(per_sensor, known, roles).withColumn("share", F.col("n_rows") / total)


def unknown_summary(df: DataFrame, known: DataFrame, roles: Roles = ROLES) -> DataFrame:
    """Rows with unknown sensors, distinct unknown sensors and share of all rows, in one row."""
    return jn_unknown_anti(df, known, roles).agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("unknown_rows"),
        F.count(F.lit(1)).alias("unknown_sensors"),
        F.coalesce(F.sum("share"), F.lit(0.0)).alias("unknown_share"),
    )


def jn_unknown_fallback(df: DataFrame, known: DataFrame, roles: Roles = ROLES) -> DataFrame:
    """Unknown sensors replaced by the first known one in sort order; ``was_unknown`` marks them."""
    labels = known.select(F.col(roles.sensor).alias("__known")).distinct()
    fallback = labels.agg(F.min("__known")).scalar()
    joined = df.join(labels, F.col(roles.sensor) == F.col("__known"), "left")
    return (
        joined.withColumn("was_unknown", F.col("__known").isNull())
        .withColumn(roles.sensor, F.coalesce("__known", fallback))
        .drop("__known")
    )


def jn_remainder(df: DataFrame, sample: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows that are not in the sample, by row key."""
    key = [key] if isinstance(key, str) else list(key)
    return df.join(sample.select(*key).distinct(), key, "left_anti")


def jn_dedup_merge(
    new: DataFrame, target: DataFrame, keys: Sequence[str] = ("sensor_id", "reading_ts")
) -> DataFrame:
    """Rows of ``new`` to insert: one per key, only keys that ``target`` lacks. Of several rows
    with one key the smallest in column order is taken, so reruns agree."""
    rest = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__r")) if rest else new.distinct()
    if rest:
        one = one.select(*keys, *[F.col(f"__r.`{c}`").alias(c) for c in rest]).select(*new.columns)
    return one.join(target.select(*keys).distinct(), list(keys), "left_anti").select(*new.columns)
