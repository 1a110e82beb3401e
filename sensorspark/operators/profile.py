"""Profiles and aggregate checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from datetime import date, datetime
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorspark.functions.columns import divide, floor_days, seconds_between, since, ts_of
from sensorspark.functions.ordering import (
    quantile_columns,
    ranked_counts,
    ranked_values,
    running,
    split_points,
    value_counts,
    with_bucket,
)
from sensorspark.operators.clean import prj_calendar_parts, prj_day_type
from sensorspark.operators.daily import daily_states, describe_of, outliers_of, period_profile_of
from sensorspark.schema import LOCAL_TIME_ZONE, ROLES, Roles
from sensorspark.session import via_table


def n_rows() -> Column:
    return F.count(F.lit(1))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def agg_ingest_check(
    df: DataFrame,
    now: Column | datetime | str,
    expected: int | Column,
    minutes: int = 5,
    ingestion_ts: str = "ingestion_ts",
    roles: Roles = ROLES,
) -> DataFrame:
    """Rows ingested in the last minutes against the expected number: ``failed`` when there are
    none, ``warning`` below 90 % of expected."""
    fresh = df.where(F.col(ingestion_ts) >= ts_of(now) - F.expr(f"INTERVAL {minutes} MINUTES"))
    exp = expected if isinstance(expected, Column) else F.lit(expected)
    n = F.col("n_rows")
    return (
        fresh.agg(
            n_rows().alias("n_rows"),
            F.min(ingestion_ts).alias("first_ingestion"),
            F.max(ingestion_ts).alias("last_ingestion"),
            F.min(roles.ts).alias("first_reading"),
            F.max(roles.ts).alias("last_reading"),
        )
        .withColumn("expected", exp.cast("bigint"))
        .withColumn(
            "status",
            F.when(n == 0, "failed").when(n < F.col("expected") * F.lit(0.9), "warning").otherwise("ok"),
        )
    )


def agg_freshness_check(
    df: DataFrame, now: Column | datetime | str, days: int = 7, roles: Roles = ROLES
) -> DataFrame:
    """Rows of the last days with their first and last time; ``failed`` when there are none."""
    recent = since(df, roles.ts, ts_of(now) - F.expr(f"INTERVAL {days} DAYS"))
    return recent.agg(
        n_rows().alias("n_rows"), F.min(roles.ts).alias("first_ts"), F.max(roles.ts).alias("last_ts")
    ).withColumn("status", F.when(F.col("n_rows") == 0, "failed").otherwise("ok"))


def agg_prediction_check(
    df: DataFrame, expected: int | Column, ts: str = "prediction_ts", col: str = "prediction"
) -> DataFrame:
    """Count and range of stored predictions with the flags mismatch, no rows, negative value."""
    exp = expected if isinstance(expected, Column) else F.lit(expected)
    return df.agg(
        n_rows().alias("n_rows"),
        F.avg(col).alias("avg_prediction"),
        F.min(col).alias("min_prediction"),
        F.max(col).alias("max_prediction"),
        F.min(ts).alias("first_prediction"),
        F.max(ts).alias("last_prediction"),
    ).withColumns(
        {
            "count_mismatch": F.col("n_rows") != exp,
            "no_rows": F.col("n_rows") == 0,
            "has_negative": F.coalesce(F.col("min_prediction") < 0, F.lit(False)),
        }
    )


def agg_describe(
    df: DataFrame, col: str, by: Sequence[str] | None = None, points: Sequence[float] | None = None, approx: bool = False
) -> DataFrame:
    """count, mean, sample standard deviation, min, exact quartiles and max, per group.

    All of it comes from one pass over distinct values with their counts. ``approx`` takes the quartiles
    from sketches of a day's values instead, in one aggregation (``daily.py``)."""
    by = list(by or [])
    if approx:
        return describe_of(daily_states(df, by, replace(ROLES, value=col)), by)
    points = split_points(df, col) if points is None else points
    ranked = ranked_values(df, by, col, points)
    x, n = F.col("x").cast("double"), F.col("n")
    # The spread does not depend on a shift; centring keeps the squares small.
    d = x - F.lit(float(points[len(points) // 2]) if points else 0.0)
    out = ranked.groupBy(*by).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n_rows"),
        (F.sum(x * n) / F.sum(n)).alias("mean"),
        F.sum(d * n).alias("__s"),
        F.sum(d * d * n).alias("__s2"),
        F.min(x).alias("min"),
        *quantile_columns({"q25": 0.25, "q50": 0.5, "q75": 0.75}),
        F.max(x).alias("max"),
    )
    m = F.col("n_rows")
    var = divide(F.col("__s2") - F.col("__s") * F.col("__s") / m, m - 1)
    std = F.sqrt(F.when(var >= 0, var).when(var < 0, 0.0))
    return out.select(*by, "n_rows", "mean", std.alias("std"), "min", "q25", "q50", "q75", "max")


DESCRIBED = ["n_rows", "mean", "std", "min", "q25", "q50", "q75", "max"]


def describe_difference(described: DataFrame, side: str, a: str, b: str) -> DataFrame:
    """Two described sources side by side: one row per statistic with ``b``'s difference to ``a``
    in percent, one decimal."""
    longer = described.select(
        side,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("v"))
                    for s in DESCRIBED
                ]
            )
        ).alias("e"),
    )
    va, vb = (F.max(F.when(F.col(side) == s, F.col("e.v"))) for s in (a, b))
    return (
        longer.groupBy(F.col("e.stat").alias("stat"))
        .agg(va.alias("value_a"), vb.alias("value_b"))
        .withColumn(
            "difference_pct",
            F.round(divide((F.col("value_b") - F.col("value_a")) * 100.0, F.col("value_a")), 1),
        )
    )


def _mean_by(df: DataFrame, by: Sequence[str], roles: Roles) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(roles.value).alias("mean_count"), n_rows().alias("n_rows"))


def agg_mean_by_weekday(df: DataFrame, tz: str = LOCAL_TIME_ZONE, roles: Roles = ROLES) -> DataFrame:
    return _mean_by(prj_calendar_parts(df, tz, roles), ["weekday"], roles)


def agg_mean_by_hour(df: DataFrame, tz: str = LOCAL_TIME_ZONE, roles: Roles = ROLES) -> DataFrame:
    return _mean_by(prj_calendar_parts(df, tz, roles), ["hour"], roles)


def agg_mean_by_month(df: DataFrame, tz: str = LOCAL_TIME_ZONE, roles: Roles = ROLES) -> DataFrame:
    return _mean_by(prj_calendar_parts(df, tz, roles), ["month"], roles)


def agg_daytype_hour(df: DataFrame, tz: str = LOCAL_TIME_ZONE, roles: Roles = ROLES) -> DataFrame:
    return _mean_by(prj_day_type(prj_calendar_parts(df, tz, roles)), ["day_type", "hour"], roles)


def agg_weekday_hour(df: DataFrame, tz: str = LOCAL_TIME_ZONE, roles: Roles = ROLES) -> DataFrame:
    """Mean per weekday and hour, Monday first."""
    return _mean_by(prj_calendar_parts(df, tz, roles), ["weekday", "hour"], roles).orderBy(
        "weekday", "hour"
    )


def sensor_means(df: DataFrame, roles: Roles = ROLES) -> DataFrame:
    """Mean per (sensor, time): the long form of the pivot, for any number of sensors."""
    return df.groupBy(roles.sensor, roles.ts).agg(F.avg(roles.value).alias("mean_count"))


def agg_sensor_pivot(df: DataFrame, sensors: Sequence, roles: Roles = ROLES) -> DataFrame:
    """One row per time and one column per named sensor. The list is explicit, so the width is
    known before the job; ``sensor_means`` is the form without a list."""
    return df.groupBy(roles.ts).pivot(roles.sensor, list(sensors)).agg(F.avg(roles.value))


def agg_key_distribution(df: DataFrame, rare_below: int = 10, roles: Roles = ROLES) -> DataFrame:
    """Rows per sensor: number of sensors, min, max, mean, exact median, rare sensors."""
    counts = df.groupBy(roles.sensor).agg(n_rows().alias("rows_of_key"))
    # Sensors with equal row counts collapse, so the median works on distinct counts.
    sizes = counts.groupBy(F.col("rows_of_key").alias("x")).agg(n_rows().alias("n"))
    points = [0.0] + [float(2**i) for i in range(48)]  # row counts spread over orders of magnitude
    ranked = running(with_bucket(sizes, "x", points), [], "x", measures={"cum": ("sum", F.col("n"))})
    x, n = F.col("x"), F.col("n")
    return ranked.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n_keys"),
        F.sum(x * n).alias("n_rows"),
        F.min(x).alias("min_rows"),
        F.max(x).alias("max_rows"),
        (F.sum(x * n) / F.sum(n)).alias("mean_rows"),
        *quantile_columns({"median_rows": 0.5}),
        F.coalesce(F.sum(F.when(x < rare_below, n)), F.lit(0)).alias("rare_keys"),
    )


def agg_period_profile(df: DataFrame, source_col: str = "source", roles: Roles = ROLES, approx: bool = False) -> DataFrame:
    """Period, span, rows, valid rows and sensors per source, and in total (source ``TOTAL``).

    Rows are first reduced to (source, sensor); the totals are rolled up from those. ``approx`` counts
    sensors by sketches instead, in one aggregation."""
    if approx:
        return period_profile_of(daily_states(df, [source_col], roles), source_col)
    per = df.groupBy(F.col(source_col).alias("source"), F.col(roles.sensor).alias("s")).agg(
        n_rows().alias("n"),
        F.count(F.when(F.col(roles.value) > 0, 1)).alias("v"),
        F.min(roles.ts).alias("lo"),
        F.max(roles.ts).alias("hi"),
    )
    rolled = per.rollup("source").agg(
        F.grouping("source").alias("g"),
        F.min("lo").alias("first_ts"),
        F.max("hi").alias("last_ts"),
        F.sum("n").alias("n_rows"),
        F.sum("v").alias("valid_rows"),
        F.countDistinct("s").alias("n_sensors"),
    )
    return rolled.select(
        F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("source")).alias("source"),
        "first_ts",
        "last_ts",
        floor_days(F.col("last_ts"), F.col("first_ts")).alias("span_days"),
        "n_rows",
        "valid_rows",
        (F.col("valid_rows") * 100.0 / F.col("n_rows")).alias("valid_pct"),
        "n_sensors",
    )


def agg_day_coverage(df: DataFrame, start: date | str, end: date | str, roles: Roles = ROLES) -> DataFrame:
    """Distinct days with data against the days from start to end, both counted."""
    expected = F.datediff(F.lit(str(end)).cast("date"), F.lit(str(start)).cast("date")) + 1
    days = df.where(
        (F.col(roles.ts) >= ts_of(start)) & (F.col(roles.ts) < ts_of(end) + F.expr("INTERVAL 1 DAY"))
    )
    return (
        days.agg(F.countDistinct(F.to_date(roles.ts)).alias("days_with_data"))
        .withColumn("expected_days", expected)
        .withColumn("coverage_pct", F.col("days_with_data") * 100.0 / F.col("expected_days"))
    )


def agg_continuity_gap(
    a: DataFrame, b: DataFrame, now: Column | datetime | str, roles: Roles = ROLES
) -> DataFrame:
    """Whole days between the end of ``a`` and the start of ``b``: gap, overlap or contiguous, with
    the cutoff date and how fresh ``b`` is."""
    ends = (
        a.agg(F.max(roles.ts).alias("t")).select(F.lit("a").alias("k"), "t")
        .unionAll(b.agg(F.min(roles.ts).alias("t")).select(F.lit("b0"), "t"))
        .unionAll(b.agg(F.max(roles.ts).alias("t")).select(F.lit("b1"), "t"))
    )
    one = ends.agg(
        *[
            F.max(F.when(F.col("k") == k, F.col("t"))).alias(n)
            for k, n in (("a", "history_end"), ("b0", "live_start"), ("b1", "live_end"))
        ]
    )
    gap, age = F.col("gap_days"), F.col("age_days")
    return one.withColumns(
        {
            "gap_days": floor_days(F.col("live_start"), F.col("history_end")),
            "age_days": floor_days(ts_of(now), F.col("live_end")),
            "cutoff_date": F.to_date("history_end"),
        }
    ).withColumns(
        {
            "continuity": F.when(gap < 0, "overlap").when(gap == 0, "contiguous").otherwise("gap"),
            "freshness": F.when(age <= 1, "fresh").when(age <= 7, "late").otherwise("stale"),
        }
    )


def agg_null_dup_profile(df: DataFrame) -> DataFrame:
    """Share of nulls of each column that has any (ascending), and the number of rows that repeat
    an earlier one in ``duplicate_rows``."""
    # Copies collapse once; nulls are then counted with their multiplicity.
    distinct = df.groupBy(*df.columns).agg(n_rows().alias("__n"))
    n = F.col("__n")
    one = distinct.agg(
        F.sum(n).alias("__rows"),
        F.sum(n - 1).alias("duplicate_rows"),
        *[
            F.coalesce(F.sum(F.when(F.col(f"`{c}`").isNull(), n)), F.lit(0)).alias(f"__null_{i}")
            for i, c in enumerate(df.columns)
        ],
    )
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"__null_{i}").alias("nulls"))
            for i, c in enumerate(df.columns)
        ]
    )
    return (
        one.select("__rows", "duplicate_rows", F.explode(entries).alias("e"))
        .select(
            F.col("e.column").alias("column"),
            (F.col("e.nulls") * 100.0 / F.col("__rows")).alias("null_pct"),
            "duplicate_rows",
        )
        .where(F.col("null_pct") > 0)
        .orderBy("null_pct", "column")
    )


def agg_duplicates(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row."""
    return (
        df.groupBy(*df.columns)
        .agg(n_rows().alias("__n"))
        .agg(
            F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows"),
            F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"),
        )
    )


def agg_value_quality(df: DataFrame, roles: Roles = ROLES) -> DataFrame:
    """Nulls, zeros and positives of the target, range and mean of the positives, sensors."""
    v = F.col(roles.value)
    pos = F.when(v > 0, v)
    return df.agg(
        n_rows().alias("n_rows"),
        F.count(F.when(v.isNull(), 1)).alias("null_values"),
        F.count(F.when(v == 0, 1)).alias("zero_values"),
        F.count(pos).alias("positive_values"),
        F.min(pos).alias("min_positive"),
        F.max(pos).alias("max_value"),
        F.avg(pos).alias("mean_positive"),
        F.countDistinct(roles.sensor).alias("n_sensors"),
    )


def agg_histogram(df: DataFrame, cols: Sequence[str] | None = None, bins: int = 30) -> DataFrame:
    """Equal-width bins (0-based) of each numeric column; the maximum falls in the last bin."""
    cols = list(cols or numeric_columns(df))
    limits = df.agg(
        *[F.min(F.col(c).cast("double")).alias(f"lo_{i}") for i, c in enumerate(cols)],
        *[F.max(F.col(c).cast("double")).alias(f"hi_{i}") for i, c in enumerate(cols)],
    ).first()
    entries = []
    for i, c in enumerate(cols):
        lo, hi = limits[f"lo_{i}"], limits[f"hi_{i}"]
        if lo is None:
            continue
        x = F.col(c).cast("double")
        if hi > lo:
            b = F.least(F.width_bucket(x, F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins)) - 1
        else:
            b = F.lit(bins // 2).cast("bigint")
        entries.append(
            F.struct(
                F.lit(c).alias("column"),
                F.when(x.isNotNull(), b).alias("bin"),
                F.lit(lo).alias("lo"),
                F.lit(hi).alias("hi"),
            )
        )
    width = (F.col("hi") - F.col("lo")) / bins
    return (
        df.select(F.explode(F.array(*entries)).alias("e"))
        .select("e.*")
        .where(F.col("bin").isNotNull())
        .groupBy("column", "bin", "lo", "hi")
        .agg(n_rows().alias("n_rows"))
        .select(
            "column", "bin", (F.col("lo") + width * F.col("bin")).alias("bin_start"), "n_rows"
        )
    )


def agg_corr_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson matrix of the numeric columns in long form; one pass computes every pair."""
    cols = list(cols or numeric_columns(df))
    pairs = list(combinations(cols, 2))
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    entries = [
        F.struct(F.lit(x).alias("col_a"), F.lit(y).alias("col_b"), F.col(f"c{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
        for x, y in ((a, b), (b, a))
    ] + [F.struct(F.lit(c).alias("col_a"), F.lit(c).alias("col_b"), F.lit(1.0).alias("r")) for c in cols]
    return one.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def agg_outliers_iqr(
    df: DataFrame,
    col: str,
    k: float = 1.5,
    by: Sequence[str] | None = None,
    points: Sequence[float] | None = None,
    approx: bool = False,
) -> DataFrame:
    """Quartiles, bounds at ``k`` interquartile ranges, and the rows outside them; with ``approx`` from
    sketches of the values, in one aggregation."""
    by = list(by or [])
    if approx:
        return outliers_of(daily_states(df, by, replace(ROLES, value=col)), k, by)
    ranked = ranked_values(df, by, col, points)
    quart = ranked.groupBy(*by).agg(*quantile_columns({"q1": 0.25, "q3": 0.75}))
    iqr = F.col("q3") - F.col("q1")
    bounds = quart.withColumns(
        {"iqr": iqr, "lower": F.col("q1") - k * iqr, "upper": F.col("q3") + k * iqr}
    )
    if by:
        joined = ranked.join(bounds, by)
    else:
        one = bounds.first()
        joined = ranked.withColumns({c: F.lit(one[c]) for c in bounds.columns})
    x, n = F.col("x"), F.col("n")
    outside = (x < F.col("lower")) | (x > F.col("upper"))
    return (
        joined.groupBy(*by, "q1", "q3", "iqr", "lower", "upper")
        .agg(F.sum(n).alias("n_rows"), F.coalesce(F.sum(F.when(outside, n)), F.lit(0)).alias("outliers"))
        .withColumn("outlier_pct", F.col("outliers") * 100.0 / F.col("n_rows"))
    )


def agg_latest_row(df: DataFrame, ts: str, by: Sequence[str] | None = None) -> DataFrame:
    """The row with the newest timestamp (per group); ties go to the largest row."""
    by = list(by or [])
    rest = [c for c in df.columns if c not in by]
    row = F.max_by(F.struct(*rest), F.struct(ts, *[c for c in rest if c != ts])).alias("r")
    return df.groupBy(*by).agg(row).select(*by, "r.*").select(*df.columns)


def agg_run_durations(
    runs: DataFrame,
    by: Sequence[str] = ("pipeline_id", "state"),
    points: Sequence[float] | None = None,
) -> DataFrame:
    """Runs, mean and median duration in seconds per group; runs without an end count as runs."""
    d = runs.withColumn("duration_s", seconds_between(F.col("end_ts"), F.col("start_ts")))
    # Counted once: cut points and ranks come from the few distinct durations, not from the runs.
    counts = via_table(value_counts(d, by, "duration_s", nulls=True), "durations")
    ranked = ranked_counts(counts, by, points, nulls=True)
    x, n = F.col("x"), F.col("n")
    return ranked.groupBy(*by).agg(
        F.sum(n).alias("n_runs"),
        (F.sum(x * n) / F.sum(F.when(x.isNotNull(), n))).alias("mean_duration_s"),
        F.max(x).alias("max_duration_s"),
        *quantile_columns({"median_duration_s": 0.5}),
    )


def agg_kv_pivot(kv: DataFrame, keys: Sequence[str], run: str = "run_id") -> DataFrame:
    """Long (run, key, value) rows to one row per run; of several values of a key the latest by
    ``ts`` counts (the largest value where there is no ``ts``)."""
    value = F.max_by("value", "ts") if "ts" in kv.columns else F.max("value")
    return kv.groupBy(run).pivot("key", list(keys)).agg(value)


def agg_http_rollup(
    log: DataFrame,
    buckets: Sequence[float],
    window: str | None = None,
    by: Sequence[str] = ("method", "endpoint", "status_code"),
    ts: str = "ts",
    latency: str = "latency",
) -> DataFrame:
    """Requests, 5xx errors, summed latency and cumulative latency buckets per label set (and time
    window). The bucket list is fixed, so a row per bound comes out of one aggregate."""
    keys: list[Column] = [F.col(c) for c in by]
    if window is not None:
        keys.append(F.window(ts, window).getField("start").alias("window_start"))
    bounds = [*buckets, float("inf")]
    grouped = log.groupBy(*keys).agg(
        n_rows().alias("requests"),
        F.count(F.when(F.col("status_code") >= 500, 1)).alias("errors"),
        F.sum(latency).alias("latency_sum"),
        *[F.count(F.when(F.col(latency) <= b, 1)).alias(f"__le_{i}") for i, b in enumerate(bounds)],
    )
    entries = F.array(
        *[
            F.struct(F.lit(float(b)).alias("le"), F.col(f"__le_{i}").alias("le_count"))
            for i, b in enumerate(bounds)
        ]
    )
    kept = [c for c in grouped.columns if not c.startswith("__le_")]
    return grouped.select(*kept, F.explode(entries).alias("e")).select(*kept, "e.*")

