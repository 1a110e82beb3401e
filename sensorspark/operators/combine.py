"""Set operations on sensors and schemas, and dataset combination."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorspark.operators.clean import prj_normalize_names
from sensorspark.operators.joins import jn_unknown_anti
from sensorspark.schema import ROLES, Roles


def key_flags(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row per key of either side with its rows in each; a single shuffle on the key."""
    both = a.select(key, F.lit(1).alias("__a")).unionByName(b.select(key, F.lit(0).alias("__a")))
    return (
        both.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.sum("__a").alias("rows_a"), F.sum(1 - F.col("__a")).alias("rows_b"))
    )


def set_key_overlap(a: DataFrame, b: DataFrame, roles: Roles = ROLES) -> DataFrame:
    """Common and one-sided sensors with shares, in one row."""
    in_a, in_b = F.col("rows_a") > 0, F.col("rows_b") > 0

    def count(cond):
        return F.count(F.when(cond, 1))

    return (
        key_flags(a, b, roles.sensor)
        .agg(
            count(in_a).alias("keys_a"),
            count(in_b).alias("keys_b"),
            count(in_a & in_b).alias("common"),
            count(in_a & ~in_b).alias("only_a"),
            count(in_b & ~in_a).alias("only_b"),
        )
        .withColumn("common_pct_of_a", F.when(F.col("keys_a") > 0, F.col("common") * 100.0 / F.col("keys_a")))
    )


def set_new_keys(current: DataFrame, train: DataFrame, roles: Roles = ROLES) -> DataFrame:
    """Sensors of current that training never saw, with their rows and share in percent."""
    return jn_unknown_anti(current, train, roles).select(
        roles.sensor, "n_rows", (F.col("share") * 100.0).alias("pct")
    )


def set_concat_align(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both frames under normalized names without repeated columns, one after the other; columns
    missing on a side are null."""
    return prj_normalize_names(a).unionByName(prj_normalize_names(b), allowMissingColumns=True)


def set_union_history(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), dfs)


def set_schema_diff(a: DataFrame, b: DataFrame, critical: Sequence[str] = ()) -> DataFrame:
    """One row per column of either frame: where it is, and whether it is critical."""
    names = sorted(set(a.columns) | set(b.columns))
    rows = [(n, n in a.columns, n in b.columns, n in critical) for n in names]
    return a.sparkSession.createDataFrame(
        rows, "column string, in_a boolean, in_b boolean, critical boolean"
    )


def set_schema_gate(a: DataFrame, b: DataFrame, min_common: float = 0.8) -> bool:
    """Whether enough of the columns of ``a`` are in ``b`` to combine the two."""
    return len(set(a.columns) & set(b.columns)) >= len(a.columns) * min_common


def set_quarter_merge(
    baseline: DataFrame, export: DataFrame, keys: Sequence[str] = ("sensor_id", "reading_ts")
) -> DataFrame:
    """Baseline plus export, one row per key. A key of the baseline keeps its baseline row."""
    both = baseline.withColumn("__o", F.lit(0)).unionByName(
        export.withColumn("__o", F.lit(1)), allowMissingColumns=True
    )
    rest = [c for c in both.columns if c not in keys and c != "__o"]
    row = F.min(F.struct("__o", *rest)).alias("r")
    cols = [c for c in both.columns if c != "__o"]
    return both.groupBy(*keys).agg(row).select(*keys, *[F.col(f"r.{c}") for c in rest]).select(*cols)
