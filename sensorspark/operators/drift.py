"""Column and dataset drift of current data against a reference."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorspark.functions.columns import ts_of
from sensorspark.functions.tails import chi_square_p, kolmogorov_p
from sensorspark.operators.filters import flt_feature_select
from sensorspark.operators.joins import jn_unknown_anti
from sensorspark.operators.stats import cumulated_sides, ks_columns, wasserstein_column
from sensorspark.schema import ROLES, Roles

# How each method calls a column drifted.
THRESHOLDS = {"ks": 0.05, "chi_square": 0.05, "wasserstein": 0.1, "jensen_shannon": 0.1}
PSI_FLOOR = 0.0001


def common_columns(reference: DataFrame, current: DataFrame) -> list[str]:
    """Columns of both frames that are worth testing."""
    return flt_feature_select([c for c in reference.columns if c in current.columns])


def _is_numeric(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.NumericType)


def _long(df: DataFrame, cols: Sequence[str], side: int, to: str) -> DataFrame:
    """One row per (column, value): the frame is read once for all columns."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(to).alias("x")) for c in cols])
    return df.select(F.explode(entries).alias("e")).select("e.*", F.lit(side).alias("side"))


def numeric_drift(reference: DataFrame, current: DataFrame, cols: Sequence[str]) -> DataFrame:
    """KS distance and p-value, and the Wasserstein distance in units of the reference's standard
    deviation, per numeric column. Side a is the reference."""
    # Both sides are moved to the reference's means: distances stay, and the spread of values far
    # from 0 keeps its digits.
    means = reference.agg(*[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(cols)]).first()

    def centred(df: DataFrame) -> DataFrame:
        return df.select(*[(F.col(f"`{c}`").cast("double") - F.lit(means[i] or 0.0)).alias(c) for i, c in enumerate(cols)])

    both = _long(centred(reference), cols, 1, "double").unionAll(_long(centred(current), cols, 0, "double"))
    cum = cumulated_sides(both, ["column"])
    x, na = F.col("x"), F.col("n_a")
    mean = F.sum(na * x) / F.sum(na)
    ks = ks_columns()
    out = cum.groupBy("column").agg(
        ks["n_a"].alias("n_reference"),
        ks["n_b"].alias("n_current"),
        ks["statistic"].alias("ks"),
        wasserstein_column().alias("w"),
        F.sqrt(F.greatest(F.sum(na * x * x) / F.sum(na) - mean * mean, F.lit(0.0))).alias("sd"),
    )
    norm = F.greatest(F.col("sd"), F.lit(0.001))
    return out.withColumns(
        {
            "ks_p": kolmogorov_p(F.col("ks"), F.col("n_reference"), F.col("n_current")),
            "wasserstein": F.col("w") / norm,
        }
    ).drop("w", "sd")


def categorical_drift(reference: DataFrame, current: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Chi-square with p-value, Jensen-Shannon distance (base 2) and PSI per categorical column.
    Side a is the reference."""
    both = _long(reference, cols, 1, "string").unionAll(_long(current, cols, 0, "string"))
    counts = both.groupBy("column", "x").agg(
        F.sum("side").alias("a"), F.sum(1 - F.col("side")).alias("b")
    )
    totals = counts.groupBy("column").agg(
        F.sum("a").alias("n_reference"), F.sum("b").alias("n_current"), F.count(F.lit(1)).alias("k")
    )
    n_a, n_b = F.col("n_reference"), F.col("n_current")
    n = n_a + n_b
    a, b = F.col("a"), F.col("b")
    pa, pb = a / n_a, b / n_b
    expected_a, expected_b = (a + b) * n_a / n, (a + b) * n_b / n
    chi = (a - expected_a) * (a - expected_a) / expected_a + (b - expected_b) * (b - expected_b) / expected_b
    m = (pa + pb) / 2

    def half(p: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    fa, fb = F.greatest(pa, F.lit(PSI_FLOOR)), F.greatest(pb, F.lit(PSI_FLOOR))
    out = (
        counts.join(totals, "column")
        .groupBy("column", "n_reference", "n_current", "k")
        .agg(
            F.sum(chi).alias("chi_square"),
            F.sqrt(F.greatest(F.sum(half(pa) + half(pb)) / 2, F.lit(0.0))).alias("jensen_shannon"),
            F.sum((fb - fa) * F.log(fb / fa)).alias("psi"),
        )
    )
    return out.withColumn(
        "chi_square_p", chi_square_p("chi_square", (F.col("k") - 1).cast("double"))
    ).drop("k")


def drf_column_drift(
    reference: DataFrame,
    current: DataFrame,
    cols: Sequence[str] | None = None,
    method: str = "distance",
    thresholds: Mapping[str, float] | None = None,
) -> DataFrame:
    """One row per column: kind, method, score, threshold, drifted, row counts.

    ``distance`` judges by Wasserstein and Jensen-Shannon distance, ``p_value`` by KS and chi-square
    tests, at every size. Every numeric column is handled in one pass, every categorical column in
    another."""
    limits = {**THRESHOLDS, **(thresholds or {})}
    cols = list(cols) if cols is not None else common_columns(reference, current)
    numeric = [c for c in cols if _is_numeric(reference, c) and _is_numeric(current, c)]
    categorical = [c for c in cols if c not in numeric]
    if method not in ("p_value", "distance"):
        raise ValueError(f"method: {method}")

    def judged(df: DataFrame, kind: str, by_p: tuple[str, str], by_distance: tuple[str, str]) -> DataFrame:
        name, col = by_p if method == "p_value" else by_distance
        limit = F.lit(limits[name])
        drifted = F.col(col) < limit if method == "p_value" else F.col(col) >= limit
        return df.select(
            "column",
            F.lit(kind).alias("kind"),
            F.lit(name).alias("method"),
            F.col(col).alias("score"),
            limit.alias("threshold"),
            F.coalesce(drifted, F.lit(False)).alias("drifted"),
            "n_reference",
            "n_current",
        )

    parts = []
    if numeric:
        parts.append(
            judged(numeric_drift(reference, current, numeric), "numeric",
                   ("ks", "ks_p"), ("wasserstein", "wasserstein"))
        )
    if categorical:
        parts.append(
            judged(categorical_drift(reference, current, categorical), "categorical",
                   ("chi_square", "chi_square_p"), ("jensen_shannon", "jensen_shannon"))
        )
    if not parts:
        raise ValueError("no column to test")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def drf_dataset_drift(col_drift: DataFrame, share: float = 0.5) -> DataFrame:
    """Share of drifted columns, the dataset flag, the drifted names (at most one per column) and
    the row counts."""
    return (
        col_drift.agg(
            F.avg(F.col("drifted").cast("int")).alias("drift_share"),
            F.sort_array(F.collect_list(F.when(F.col("drifted"), F.col("column")))).alias("drifted_features"),
            F.count(F.lit(1)).alias("total_features"),
            F.max("n_reference").alias("reference_size"),
            F.max("n_current").alias("current_size"),
        )
        .withColumn("drift_detected", F.col("drift_share") >= share)
        .withColumn("schema_drift", F.lit(False))
        .withColumn("drift_status", F.lit("ok"))
    )


def drf_schema_drift(
    reference: DataFrame, current: DataFrame, share: float = 0.5, method: str = "distance"
) -> DataFrame:
    """Dataset drift with the schema gate in front: without a common column everything drifted."""
    if [c for c in reference.columns if c in current.columns]:
        return drf_dataset_drift(drf_column_drift(reference, current, method=method), share)
    sizes = reference.select(F.lit(1).alias("r")).unionAll(current.select(F.lit(0)))
    return sizes.agg(
        F.lit(1.0).alias("drift_share"),
        F.array().cast("array<string>").alias("drifted_features"),
        F.lit(0).cast("bigint").alias("total_features"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("reference_size"),
        F.coalesce(F.sum(1 - F.col("r")), F.lit(0)).alias("current_size"),
        F.lit(True).alias("drift_detected"),
        F.lit(True).alias("schema_drift"),
        F.lit("ok").alias("drift_status"),
    )


def drf_unknown_keys(
    current: DataFrame,
    known: DataFrame,
    model_type: str,
    ts: Column | datetime | str,
    roles: Roles = ROLES,
) -> DataFrame:
    """Unknown-sensor events, one row per unknown sensor with its rows and the fallback used."""
    fallback = known.agg(F.min(roles.sensor)).scalar()
    return jn_unknown_anti(current, known, roles).select(
        ts_of(ts).alias("event_ts"),
        F.lit(model_type).alias("model_type"),
        F.col(roles.sensor).alias("unknown_sensor"),
        "n_rows",
        "share",
        fallback.alias("fallback_sensor"),
    )
