"""Two-sample tests and match quality.

Samples are reduced to distinct values with counts per side; cumulative counts give KS distances,
mid-ranks and Wasserstein areas without sorting raw rows in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorspark.functions.columns import divide
from sensorspark.functions.moments import weighted_moments
from sensorspark.functions.ordering import BUCKET, running, split_points, with_bucket
from sensorspark.functions.tails import (
    kolmogorov_p,
    normal_two_sided_p,
    student_two_sided_p,
)
from sensorspark.schema import ROLES, Roles

# Fixed value: |z| beyond this has a two-sided normal p-value below 0.05.
Z_05 = 1.959963984540054


def two_sided_counts(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Rows of both samples as ``(x, side)``, side 1 for ``a``."""
    return a.select(F.col(col).cast("double").alias("x"), F.lit(1).alias("side")).unionAll(
        b.select(F.col(col).cast("double"), F.lit(0))
    )


def cumulated_sides(
    df: DataFrame,
    by: Sequence[str] = (),
    x: str = "x",
    side: str = "side",
    points: Sequence[float] | None = None,
) -> DataFrame:
    """``by..., x, n_a, n_b, cum_a, cum_b, cum_a_total, cum_b_total, prev_x`` per distinct value."""
    rows = df.where(F.col(x).isNotNull())
    points = split_points(rows, x) if points is None else points
    s = F.col(side)
    counts = rows.groupBy(*by, F.col(x).cast("double").alias("x")).agg(
        F.count(F.when(s == 1, 1)).alias("n_a"), F.count(F.when(s == 0, 1)).alias("n_b")
    )
    return running(
        with_bucket(counts, "x", points),
        by,
        "x",
        measures={
            "cum_a": ("sum", F.col("n_a")),
            "cum_b": ("sum", F.col("n_b")),
            "prev_x": ("previous", F.col("x")),
        },
    ).drop(BUCKET)


def ks_columns() -> dict[str, Column]:
    """KS distance and sample sizes as aggregates over ``cumulated_sides``."""
    fa = F.col("cum_a") / F.col("cum_a_total")
    fb = F.col("cum_b") / F.col("cum_b_total")
    return {
        "n_a": F.max("cum_a_total"),
        "n_b": F.max("cum_b_total"),
        "statistic": F.max(F.abs(fa - fb)),
    }


def rank_columns() -> dict[str, Column]:
    """Mann-Whitney U of side a and the tie sum as aggregates over ``cumulated_sides``."""
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    below = F.col("cum_b") - nb
    t = na + nb
    return {
        "n_a": F.max("cum_a_total"),
        "n_b": F.max("cum_b_total"),
        "u": F.sum(na * (below + nb / 2)),
        "ties": F.sum(t * t * t - t),
    }


def wasserstein_column() -> Column:
    """Area between both distribution functions: each step up to a value has the height before it."""
    fa = (F.col("cum_a") - F.col("n_a")) / F.col("cum_a_total")
    fb = (F.col("cum_b") - F.col("n_b")) / F.col("cum_b_total")
    return F.coalesce(F.sum(F.abs(fa - fb) * (F.col("x") - F.col("prev_x"))), F.lit(0.0))


def _named(aggs: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in aggs.items()]


def stat_ks_2samp(a: DataFrame, b: DataFrame, col: str, alpha: float = 0.05) -> DataFrame:
    """KS statistic with its asymptotic p-value; passes when p > alpha."""
    out = cumulated_sides(two_sided_counts(a, b, col)).agg(*_named(ks_columns()))
    p = kolmogorov_p(F.col("statistic"), F.col("n_a"), F.col("n_b"))
    return out.withColumn("p_value", p).withColumn("passed", F.col("p_value") > alpha)


def mann_whitney_z(df: DataFrame) -> DataFrame:
    """Tie-corrected z with continuity correction, from ``rank_columns``."""
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = na + nb
    spread = F.sqrt(na * nb / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    larger = F.greatest(F.col("u"), na * nb - F.col("u"))
    return df.withColumn("z", divide(larger - na * nb / 2.0 - 0.5, spread))


def stat_mannwhitney(a: DataFrame, b: DataFrame, col: str, alpha: float = 0.05) -> DataFrame:
    """U of the first sample, z and two-sided p; passes when p > alpha."""
    out = mann_whitney_z(cumulated_sides(two_sided_counts(a, b, col)).agg(*_named(rank_columns())))
    p = F.least(F.lit(1.0), F.when(F.col("z") < 0, 1.0).otherwise(normal_two_sided_p("z")))
    return out.drop("ties").withColumn("p_value", p).withColumn("passed", F.col("p_value") > alpha)


def stat_paired_t(
    matched: DataFrame, a: str = "count_a", b: str = "count_b", weight: str | None = None,
    alpha: float = 0.05,
) -> DataFrame:
    """Paired t on matched rows with the mean difference. ``weight`` is a column with the number of
    pairs a row stands for."""
    w = F.lit(1) if weight is None else F.col(weight)
    d = F.col(a).cast("double") - F.col(b).cast("double")
    return _finish_t(weighted_moments(matched, d, w), alpha)


def _finish_t(sums: DataFrame, alpha: float) -> DataFrame:
    """From the number, mean and squared deviations of the differences."""
    n, mean = F.col("n"), F.col("mean")
    t = divide(mean, F.sqrt(divide(F.col("dev2"), n - 1) / n))
    return (
        sums.select(n.cast("bigint").alias("n_pairs"), mean.alias("mean_difference"), t.alias("t"))
        .withColumn("p_value", student_two_sided_p("t", (F.col("n_pairs") - 1).cast("double")))
        .withColumn("passed", F.col("p_value") > alpha)
    )


def match_paired_t(matched: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Paired t over every row pair behind ``jn_source_match``, from the group sums."""
    # Differences of a key's pairs: their mean is that of the sides' means, and around it they
    # spread by what each side spreads around its own mean.
    na, nb, pairs = F.col("n_a"), F.col("n_b"), F.col("pairs")
    mean = divide(F.col("sum_a"), na) - divide(F.col("sum_b"), nb)
    inside = (F.col("dev2_a") * nb + F.col("dev2_b") * na) / pairs
    sums = weighted_moments(matched, mean, pairs, sums={"inside": inside})
    return _finish_t(sums.withColumn("dev2", F.col("dev2") + F.col("inside")), alpha)


def _bands(r: Column) -> Column:
    return (
        F.when(r > 0.9, "excellent").when(r > 0.7, "good").when(r > 0.5, "moderate").otherwise("poor")
    )


def stat_match_quality(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str] = ("sensor_key", "date_hour"),
    roles: Roles = ROLES,
) -> DataFrame:
    """Pearson r (with its band), MAE and MAPE (relative to ``a``) over all pairs of rows of ``a``
    and ``b`` that share a key.

    Within a key every value of ``a`` needs the number and the sum of the values of ``b`` below it.
    Both come from running sums over distinct values, so a key with many rows on both sides costs
    its distinct values, not its pairs."""
    keys = list(keys)
    v = F.col(roles.value).cast("double")
    rows = (
        a.select(*keys, v.alias("x"), F.lit(1).alias("side"))
        .unionByName(b.select(*keys, v.alias("x"), F.lit(0).alias("side")))
        .where(F.col("x").isNotNull())
    )
    # Sums of squares and products are taken around the mean of all values.
    centre = rows.agg(F.avg("x")).first()[0] or 0.0
    rows = rows.withColumn("x", F.col("x") - F.lit(centre))
    counts = rows.groupBy(*keys, "x").agg(
        F.count(F.when(F.col("side") == 1, 1)).alias("n_a"),
        F.count(F.when(F.col("side") == 0, 1)).alias("n_b"),
    )
    x, na, nb = F.col("x"), F.col("n_a"), F.col("n_b")
    value = x + F.lit(centre)
    r = running(
        with_bucket(counts, "x", split_points(rows, "x")),
        keys,
        "x",
        measures={"cb": ("sum", nb), "sb": ("sum", nb * x), "sb2": ("sum", nb * x * x)},
    )
    cb, sb = F.col("cb"), F.col("sb")
    tb, tsb, tsb2 = F.col("cb_total"), F.col("sb_total"), F.col("sb2_total")
    apart = (x * cb - sb) + (tsb - sb) - x * (tb - cb)
    sums = r.where((na > 0) & (tb > 0)).agg(
        F.sum(na * tb).alias("n"),
        F.sum(na * tb * x).alias("sa"),
        F.sum(na * tb * x * x).alias("saa"),
        F.sum(na * tsb).alias("sb"),
        F.sum(na * tsb2).alias("sbb"),
        F.sum(na * x * tsb).alias("sab"),
        F.sum(na * apart).alias("abs_sum"),
        F.sum(na * F.when(value != 0, apart / value * 100.0)).alias("pct_sum"),
        F.sum(F.when(value != 0, na * tb)).alias("pct_n"),
    )
    n, sa, sbt = F.col("n"), F.col("sa"), F.col("sb")
    cov = n * F.col("sab") - sa * sbt
    spread = F.sqrt(n * F.col("saa") - sa * sa) * F.sqrt(n * F.col("sbb") - sbt * sbt)
    return sums.select(
        F.coalesce(n, F.lit(0)).cast("bigint").alias("n_pairs"),
        divide(cov, spread).alias("pearson_r"),
        divide(F.col("abs_sum"), n).alias("mae"),
        divide(F.col("pct_sum"), F.col("pct_n")).alias("mape"),
    ).withColumn("band", _bands(F.col("pearson_r")))


def quality_checks(
    ks: DataFrame, mw: DataFrame, overlap: DataFrame, match: DataFrame | None = None
) -> DataFrame:
    """The four checks as rows ``(check, score, passed)``; correlation only with matched rows."""
    cols = ["check", "score", "passed"]
    rows = ks.select(F.lit("distribution").alias("check"), F.col("p_value").alias("score"), "passed")
    rows = rows.unionByName(
        mw.select(F.lit("median").alias("check"), F.col("p_value").alias("score"), "passed")
    )
    pct = F.col("common_pct_of_a")
    rows = rows.unionByName(
        overlap.select(
            F.lit("sensor_overlap").alias("check"), (pct / 100.0).alias("score"), (pct > 80).alias("passed")
        )
    )
    if match is not None:
        r = F.col("pearson_r")
        rows = rows.unionByName(
            match.where(F.col("n_pairs") > 0).select(
                F.lit("correlation").alias("check"), r.alias("score"), (r > 0.7).alias("passed")
            )
        )
    return rows.select(*cols)


def stat_quality_score(checks: DataFrame, pass_share: float = 0.75, warn_share: float = 0.5) -> DataFrame:
    """Passed checks against all checks, and what to do with the source."""
    n, ok = F.col("total_checks"), F.col("passed_checks")
    return (
        checks.agg(
            F.count(F.when(F.col("passed"), 1)).alias("passed_checks"),
            F.count(F.lit(1)).alias("total_checks"),
        )
        .withColumn("score_pct", ok * 100.0 / n)
        .withColumn(
            "recommendation",
            F.when(ok >= n * pass_share, "trustworthy")
            .when(ok >= n * warn_share, "investigate")
            .otherwise("not_recommended"),
        )
    )
