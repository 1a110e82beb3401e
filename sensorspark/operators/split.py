"""Reproducible splits and samples.

Random order is the md5 of the row key and a seed: the same rows are chosen on any cluster, after
any retry, for any partitioning. Ranks inside a stratum are found bucket by bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorspark.functions.ordering import (
    hash_cut,
    hash_order,
    running,
    salted_join,
    value_counts,
    with_bucket,
)
from sensorspark.operators.combine import key_flags
from sensorspark.operators.joins import jn_remainder
from sensorspark.schema import ROLES, Roles
from sensorspark.session import via_table


def temporal_cutoff(df: DataFrame, train_ratio: float = 0.8, roles: Roles = ROLES) -> DataFrame:
    """The time of row number ``int(n * ratio)`` in time order, found from counts per time."""
    counts = with_bucket(value_counts(df, [], roles.ts), "x")
    ranked = running(counts, [], "x", measures={"cum": ("sum", F.col("n"))})
    reached = F.col("cum") > F.floor(F.col("cum_total") * F.lit(float(train_ratio)))
    return ranked.agg(F.min(F.when(reached, F.col("x"))).alias("cutoff"))


def spl_temporal(
    df: DataFrame, train_ratio: float = 0.8, roles: Roles = ROLES
) -> tuple[DataFrame, DataFrame]:
    """Earlier rows to train, rows from the cutoff on to test. The cutoff is one value; as a
    literal it reaches both scans."""
    cut = F.lit(temporal_cutoff(df, train_ratio, roles).first()[0])
    ts = F.col(roles.ts)
    return df.where(ts < cut), df.where(ts >= cut)


def test_quota(n: Column, test_size: float) -> Column:
    """Test rows of a stratum: the rounded share, at least one; none from a single row."""
    share = F.round(n * F.lit(float(test_size)), 0).cast("bigint")
    return F.when(n < 2, F.lit(0)).otherwise(F.greatest(F.lit(1), share))


def with_stratified_part(
    df: DataFrame, by: str, test_size: float, seed: int, key: str | Sequence[str]
) -> DataFrame:
    hashed = df.withColumn("__h", hash_order(key, seed))
    cuts = hash_cut(hashed, [by], "__h", lambda n: test_quota(n, test_size))
    part = F.when(F.col("__h") <= F.col("cut"), "test").otherwise("train")
    return salted_join(hashed, cuts, [by]).withColumn("part", part).select(*df.columns, "part")


def _parts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (
        df.where(F.col("part") == "train").drop("part"),
        df.where(F.col("part") == "test").drop("part"),
    )


def spl_stratified(
    df: DataFrame,
    by: str = "sensor_id",
    test_size: float = 0.2,
    seed: int = 42,
    key: str | Sequence[str] = ("sensor_id", "reading_ts"),
) -> tuple[DataFrame, DataFrame]:
    """Train and test with every sensor of two or more rows in both; single rows train."""
    return _parts(with_stratified_part(df, by, test_size, seed, key))


def spl_verify_iso(train: DataFrame, test: DataFrame, by: str = "sensor_id") -> DataFrame:
    """Verdict on a split: PERFECT (same sensors), ACCEPTABLE (sensors missing in test, none only
    in test), FAIL (sensors only in test). Single-row sensors in train are expected orphans."""
    ra, rb = F.col("rows_a"), F.col("rows_b")

    def count(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    return (
        key_flags(train, test, by)
        .agg(
            count((ra > 0) & (rb > 0)).alias("common"),
            count((ra > 0) & (rb == 0)).alias("only_train"),
            count((ra == 1) & (rb == 0)).alias("single_row_orphans"),
            count((ra > 1) & (rb == 0)).alias("multi_row_orphans"),
            count((ra == 0) & (rb > 0)).alias("only_test"),
        )
        .withColumn(
            "verdict",
            F.when(F.col("only_test") > 0, "FAIL")
            .when(F.col("only_train") > 0, "ACCEPTABLE")
            .otherwise("PERFECT"),
        )
    )


def spl_stratified_sample(
    df: DataFrame,
    by: str = "sensor_id",
    n: int = 10000,
    seed: int = 42,
    key: str | Sequence[str] = ("sensor_id", "reading_ts"),
) -> DataFrame:
    """Each sensor's proportional share (at least one row), topped up at random to ``n`` rows and
    cut at ``n``.

    Rows inside their sensor's share come first, then all others, both in hash order; the sample
    is the first ``n`` of that order."""
    hashed = df.withColumn("__h", hash_order(key, seed))
    total = df.count()
    share = hash_cut(
        hashed, [by], "__h", lambda m: F.greatest(F.lit(1), F.floor(F.lit(n) * m / F.lit(total)))
    )
    # One row per sensor, used by every later step.
    cuts = via_table(share, "sample-cuts")
    placed = hashed.join(cuts, by, "left").withColumn(
        "__h", F.concat(F.when(F.col("__h") <= F.col("cut"), "0").otherwise("1"), "__h")
    )
    return _first_by_hash(placed, n, key).select(*df.columns)


def _first_by_hash(df: DataFrame, n: int, key: str | Sequence[str]) -> DataFrame:
    """The first ``n`` rows by ``__h``: a filter on the hash. Only where rows of the last hash are
    more than fit (repeated keys) are those put in order, and no others."""
    keys = [key] if isinstance(key, str) else list(key)
    cut = F.lit(hash_cut(df, [], "__h", lambda m: F.least(m, F.lit(n))).agg(F.max("cut")).first()[0])
    below, at = df.where(F.col("__h") < cut), df.where(F.col("__h") == cut)
    n_below, n_at = df.where(F.col("__h") <= cut).agg(
        F.count(F.when(F.col("__h") < cut, 1)), F.count(F.when(F.col("__h") == cut, 1))
    ).first()
    if n_below + n_at <= n:
        return df.where(F.col("__h") <= cut)
    return below.unionByName(at.orderBy(*keys).limit(n - n_below))


def spl_random_sample(
    df: DataFrame, n: int, seed: int = 42, key: str | Sequence[str] = ("sensor_id", "reading_ts")
) -> DataFrame:
    """``n`` rows in hash order."""
    return _first_by_hash(df.withColumn("__h", hash_order(key, seed)), n, key).select(*df.columns)


def holdout_part(key: str | Sequence[str], frac: float = 0.8, seed: int | str = "") -> Column:
    """``train`` or ``test`` from the key's hash alone: no shuffle, no state."""
    limit = format(min(65536, round(frac * 65536)), "05x")
    h = F.concat(F.lit("0"), F.substring(hash_order(key, seed), 1, 4))
    return F.when(h < limit, "train").otherwise("test")


class Holdout(NamedTuple):
    train: DataFrame
    test: DataFrame
    n_train: int
    n_test: int


def spl_holdout(
    df: DataFrame,
    frac: float = 0.8,
    key: str | Sequence[str] = ("sensor_id", "reading_ts"),
    seed: int | str = "",
) -> Holdout:
    """Every row in one of two parts, and how many each has: whether they are enough is for the
    caller to say."""
    marked = df.withColumn("part", holdout_part(key, frac, seed))
    n, n_test = marked.agg(
        F.count(F.lit(1)), F.count(F.when(F.col("part") == "test", 1))
    ).first()
    return Holdout(*_parts(marked), n - n_test, n_test)


def spl_label_stratified(
    df: DataFrame,
    label: str = "affluence",
    test_size: float = 0.2,
    seed: int = 42,
    key: str | Sequence[str] = ("sensor_id", "reading_ts"),
) -> tuple[DataFrame, DataFrame]:
    """As ``spl_stratified`` by class label; a class may hold most of the rows, as no class
    is gathered."""
    return _parts(with_stratified_part(df, label, test_size, seed, key))


__all__ = [n for n in dir() if n.startswith("spl_")] + ["jn_remainder", "temporal_cutoff"]
