"""Weighted mean and spread without a second pass over the rows.

Rows that stand for equally many rows meet first, where Spark's own moments keep their digits; the few
results of a group, one for each weight that occurs in it, are then merged around a value near them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_moments(
    rows: DataFrame, x: Column, weight: Column | None = None, by: Sequence[str] = (), sums: Mapping[str, Column] | None = None
) -> DataFrame:
    """Per group ``n`` (sum of the weights), ``mean``, ``dev2`` (squared distances from the mean),
    ``low``, ``high``, and for each of ``sums`` the weighted sum. Rows without a value or with a weight
    that is null or not above 0 do not count. Without groups there is always one row."""
    by, sums = list(by), dict(sums or {})
    w = F.lit(1) if weight is None else weight
    used = rows.select(*by, x.cast("double").alias("__x"), w.alias("__w"), *[c.alias(f"__s_{n}") for n, c in sums.items()])
    same = (
        used.where(F.col("__x").isNotNull() & (F.col("__w") > 0))
        .groupBy(*by, "__w")
        .agg(
            (F.count("__x") * F.col("__w")).alias("__n"),
            F.avg("__x").alias("__m"),
            (F.var_pop("__x") * F.count("__x") * F.col("__w")).alias("__d"),
            F.min("__x").alias("__low"),
            F.max("__x").alias("__high"),
            *[(F.sum(f"__s_{n}") * F.col("__w")).alias(f"__s_{n}") for n in sums],
        )
    )
    near = F.min("__m").over(Window.partitionBy(*(by or [F.lit(0)])))
    off = F.col("__m") - F.col("__c")
    merged = (
        same.withColumn("__c", near)
        .groupBy(*by)
        .agg(
            F.coalesce(F.sum("__n"), F.lit(0)).alias("n"),
            F.first("__c").alias("__c"),
            F.sum(F.col("__n") * off).alias("__o"),
            F.sum(F.col("__n") * off * off).alias("__oo"),
            F.sum("__d").alias("__d"),
            F.min("__low").alias("low"),
            F.max("__high").alias("high"),
            *[F.sum(f"__s_{n}").alias(n) for n in sums],
        )
    )
    n = F.when(F.col("n") != 0, F.col("n"))
    return merged.select(
        *by, "n", (F.col("__c") + F.col("__o") / n).alias("mean"), (F.col("__d") + F.greatest(F.lit(0.0), F.col("__oo") - F.col("__o") * F.col("__o") / n)).alias("dev2"),
        "low", "high", *sums,
    )
