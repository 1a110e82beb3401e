"""One row a day of what reports need, mergeable upwards: counts, moments and sketches.

A day's states come from one pass over its rows and replace the day when it changes; reports over months
or all sources merge states and read no readings. Distinct sensors are HyperLogLog sketches (about 1.6 %
standard error at 12 bits), values KLL sketches (a rank error of about 1 % at ``k`` = 400).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorspark.functions.columns import divide, floor_days
from sensorspark.schema import ROLES, Roles

HLL_BITS, KLL_K = 12, 400
DAY = "reading_date"
#: Ranks at which a sketch is read to tell the rank of a value.
GRID = 1000


def daily_states(df: DataFrame, by: Sequence[str] = (), roles: Roles = ROLES, bits: int = HLL_BITS, k: int = KLL_K) -> DataFrame:
    """``reading_date``, ``by`` and the states of each day. Aggregates combine before the shuffle, so a
    day or a source may hold any share of the rows; rows without a time make a day of their own."""
    v = F.col(roles.value).cast("double")
    return df.groupBy(F.to_date(roles.ts).alias(DAY), *by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(v > 0, 1)).alias("valid_rows"),
        F.min(roles.ts).alias("first_ts"),
        F.max(roles.ts).alias("last_ts"),
        F.count(v).alias("n_values"),
        F.avg(v).alias("mean"),
        (F.var_pop(v) * F.count(v)).alias("dev2"),
        F.min(v).alias("low"),
        F.max(v).alias("high"),
        F.hll_sketch_agg(F.col(roles.sensor).cast("string"), F.lit(bits)).alias("sensors"),
        F.kll_sketch_agg_double(v, F.lit(k)).alias("values"),
    )


def _merged_columns() -> list[Column]:
    """Aggregates of states. Moments are merged pair by pair; a group has one entry for each of its days
    and sources."""
    one = F.struct(F.col("n_values").alias("n"), "mean", F.col("dev2"))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("dev2"))

    def both(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        d = b["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + d * b["n"] / n).alias("mean"), (a["dev2"] + b["dev2"] + d * d * a["n"] * b["n"] / n).alias("dev2"))

    moments = F.aggregate(F.array_sort(F.collect_list(F.when(F.col("n_values") > 0, one))), zero, both)
    return [
        F.sum("n_rows").alias("n_rows"),
        F.sum("valid_rows").alias("valid_rows"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        moments.alias("moments"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.hll_union_agg("sensors").alias("sensors"),
        F.kll_merge_agg_double(F.when(F.col("n_values") > 0, F.col("values"))).alias("values"),
    ]


def _moment(name: str) -> Column:
    return F.col("moments")[name]


def merged_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """States of larger groups, in the same columns (without the day, unless ``by`` names it)."""
    out = states.groupBy(*by).agg(*_merged_columns())
    n = _moment("n")
    return out.select(
        *by, "n_rows", "valid_rows", "first_ts", "last_ts", n.alias("n_values"), F.when(n > 0, _moment("mean")).alias("mean"),
        F.when(n > 0, _moment("dev2")).alias("dev2"), "low", "high", "sensors", "values",
    )


def quantile_of(p: float) -> Column:
    """Of merged states; null without values."""
    return F.when(F.col("n_values") > 0, F.kll_sketch_get_quantile_double("values", F.lit(float(p))))


def period_profile_of(states: DataFrame, source_col: str = "source") -> DataFrame:
    """As ``agg_period_profile``, from daily states by source; sensors are estimates."""
    rolled = states.withColumn("source", F.col(source_col)).rollup("source").agg(F.grouping("source").alias("g"), *_merged_columns())
    return rolled.select(
        F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("source")).alias("source"),
        "first_ts",
        "last_ts",
        floor_days(F.col("last_ts"), F.col("first_ts")).alias("span_days"),
        "n_rows",
        "valid_rows",
        (F.col("valid_rows") * 100.0 / F.col("n_rows")).alias("valid_pct"),
        F.hll_sketch_estimate("sensors").alias("n_sensors"),
    )


def describe_of(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """As ``agg_describe``, from states; quartiles are estimates, all else is exact."""
    n = F.col("n_values")
    return merged_states(states, by).select(
        *by, n.alias("n_rows"), "mean", F.sqrt(divide(F.col("dev2"), n - 1)).alias("std"), F.col("low").alias("min"),
        *[quantile_of(p).alias(f"q{round(100 * p)}") for p in (0.25, 0.5, 0.75)], F.col("high").alias("max"),
    )


def outliers_of(states: DataFrame, k: float = 1.5, by: Sequence[str] = ()) -> DataFrame:
    """As ``agg_outliers_iqr``, from states: quartiles, and from the ranks of the bounds the number of
    values outside, are estimates."""
    quart = merged_states(states, by).select("*", quantile_of(0.25).alias("q1"), quantile_of(0.75).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    bounds = quart.withColumns({"iqr": iqr, "lower": F.col("q1") - k * iqr, "upper": F.col("q3") + k * iqr})
    # The bounds' ranks, by the values at a grid of ranks.
    at = F.kll_sketch_get_quantile_double("values", F.array(*[F.lit((i + 0.5) / GRID) for i in range(GRID)]))
    outside = F.size(F.filter(at, lambda x: (x < F.col("lower")) | (x > F.col("upper"))))
    n = F.col("n_values")
    return bounds.select(
        *by, "q1", "q3", "iqr", "lower", "upper", n.alias("n_rows"), F.round(n * F.when(n > 0, outside) / GRID).cast("bigint").alias("outliers")
    ).withColumn("outlier_pct", F.col("outliers") * 100.0 / F.col("n_rows"))


def day_coverage_of(states: DataFrame, start: date | str, end: date | str) -> DataFrame:
    """As ``agg_day_coverage``: the days are the states' own, so the count is exact."""
    first, last = (F.lit(str(d)).cast("date") for d in (start, end))
    days = states.where(F.col(DAY).between(first, last) & (F.col("n_rows") > 0))
    return (
        days.agg(F.countDistinct(DAY).alias("days_with_data"))
        .withColumn("expected_days", F.datediff(last, first) + 1)
        .withColumn("coverage_pct", F.col("days_with_data") * 100.0 / F.col("expected_days"))
    )
