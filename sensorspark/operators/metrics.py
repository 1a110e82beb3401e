"""Monitoring rollups over metric samples, request logs and run tables.

Samples are long rows: series columns (such as metric and instance), ``ts``, ``value``.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorspark.functions.columns import divide, seconds_between, ts_of
from sensorspark.functions.ordering import BUCKET

SERIES = ("metric", "instance")

# Gauges published from the audit table -> audit column.
AUDIT_GAUGES = {
    "model_r2_champion_current": "r2",
    "model_r2_champion_baseline": "champion_r2_baseline",
    "model_r2_challenger_baseline": "r2_baseline",
    "model_r2_challenger_current": "r2_current",
    "model_rmse_production": "rmse",
    "model_improvement_delta": "model_improvement",
    "drift_detected": "drift_detected",
    "drift_share": "drift_share",
}

# The alert rules under this library's own names; bounds, durations and no-data policies are fixed
# values. Columns: rule, metric, evaluator, low, high, look-back seconds, for seconds, no-data policy,
# severity.
ALERT_RULES = [
    ("model_performance_critical", "model_r2_champion_current", "lt", 0.65, None, 600, 300, "NoData", "critical"),
    ("model_performance_warning", "model_r2_champion_current", "within_range", 0.65, 0.70, 600, 600, "NoData", "warning"),
    ("model_rmse_high", "model_rmse_production", "gt", 70.0, None, 600, 300, "NoData", "critical"),
    ("high_drift_detected", "drift_share", "gt", 0.5, None, 900, 900, "NoData", "warning"),
    ("critical_drift_with_performance", "drift_and_declining_r2", "gt", 0.0, None, 600, 300, "OK", "critical"),
    ("service_down", "up", "lt", 1.0, None, 120, 60, "Alerting", "critical"),
    ("api_error_rate_high", "api_error_ratio", "gt", 0.05, None, 300, 300, "OK", "warning"),
    ("run_too_slow", "run_duration_seconds", "gt", 3600.0, None, 600, 600, "OK", "warning"),
    ("no_data_ingested", "records_ingested_increase_1h", "eq", 0.0, None, 3600, 129600, "NoData", "warning"),
]
RULE_SCHEMA = pa.schema(
    [
        ("rule", pa.string()),
        ("metric", pa.string()),
        ("evaluator", pa.string()),
        ("low", pa.float64()),
        ("high", pa.float64()),
        ("lookback_s", pa.int32()),
        ("for_s", pa.int32()),
        ("no_data", pa.string()),
        ("severity", pa.string()),
    ]
)


def alert_rules(spark: SparkSession, rules: Sequence[tuple] = ALERT_RULES) -> DataFrame:
    """Rules as a local relation: the planner knows its size, so joins on it need no shuffle by
    metric name (a handful of names would carry all samples)."""
    rows = [dict(zip(RULE_SCHEMA.names, r)) for r in rules]
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=RULE_SCHEMA))


def mon_gauges_from_audit(audit: DataFrame, ts: str = "timestamp", keys: Sequence[str] = ()) -> DataFrame:
    """Audit rows to gauge samples; values that are missing give no sample."""
    entries = F.array(
        *[
            F.struct(F.lit(g).alias("metric"), F.col(c).cast("double").alias("value"))
            for g, c in AUDIT_GAUGES.items()
            if c in audit.columns
        ]
    )
    return (
        audit.select(*keys, F.col(ts).alias("ts"), F.explode(entries).alias("e"))
        .select(*keys, "ts", "e.*")
        .where(F.col("value").isNotNull())
    )


def mon_rate_increase(
    metrics: DataFrame,
    window: str = "5 minutes",
    kind: str = "rate",
    slide: str | None = None,
    series: Sequence[str] = SERIES,
) -> DataFrame:
    """Increase of counters inside each window, resets included: a drop means the counter started
    over, so the new value is the increase. ``rate`` divides by the window length. No guess is made
    for the window's edges. The unit of work is one series in one window."""
    samples = metrics.groupBy(*series, "ts").agg(F.max("value").alias("value"))
    frame = F.window("ts", window, slide) if slide else F.window("ts", window)
    placed = samples.select(*series, "ts", "value", frame.alias("w"))
    inside = Window.partitionBy(*series, "w").orderBy("ts")
    before = F.lag("value").over(inside)
    step = F.when(F.col("value") >= before, F.col("value") - before).when(before.isNotNull(), F.col("value"))
    grouped = (
        placed.withColumn("step", step)
        .groupBy(*series, "w")
        .agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("increase"), F.count(F.lit(1)).alias("samples"))
    )
    seconds = seconds_between(F.col("w.end"), F.col("w.start"))
    value = F.col("increase") / seconds if kind == "rate" else F.col("increase")
    if kind not in ("rate", "increase"):
        raise ValueError(f"kind: {kind}")
    return grouped.where(F.col("samples") > 1).select(
        *series, F.col("w.start").alias("window_start"), value.alias(kind)
    )


def mon_error_ratio(
    log: DataFrame,
    window: str = "5 minutes",
    slide: str | None = None,
    is_error: Column | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Errors per request in percent, per window (and label)."""
    bad = F.col("status_code") >= 500 if is_error is None else is_error
    frame = F.window("ts", window, slide) if slide else F.window("ts", window)
    return (
        log.groupBy(*by, frame.alias("w"))
        .agg(F.count(F.lit(1)).alias("requests"), F.count(F.when(bad, 1)).alias("errors"))
        .select(
            *by,
            F.col("w.start").alias("window_start"),
            "requests",
            "errors",
            (F.col("errors") * 100.0 / F.col("requests")).alias("error_pct"),
        )
    )


def mon_histogram_quantile(
    buckets: DataFrame,
    q: Sequence[float] = (0.5, 0.95, 0.99),
    by: Sequence[str] = ("method", "endpoint"),
    le: str = "le",
    count: str = "le_count",
) -> DataFrame:
    """Quantiles from cumulative bucket counts by linear interpolation inside the bucket that
    reaches the rank. The lowest bucket starts at 0; ranks in the open bucket give its lower bound.
    A group has as many rows as there are bounds."""
    by = list(by)
    summed = buckets.groupBy(*by, F.col(le).alias("hi")).agg(F.sum(count).alias("cum"))
    ordered = Window.partitionBy(*by).orderBy("hi")
    whole = Window.partitionBy(*by)
    rows = summed.withColumns(
        {
            "lo": F.coalesce(F.lag("hi").over(ordered), F.lit(0.0)),
            "below": F.coalesce(F.lag("cum").over(ordered), F.lit(0)),
            "total": F.max("cum").over(whole),
        }
    )
    out = []
    for p in q:
        rank = F.lit(float(p)) * F.col("total")
        share = divide(rank - F.col("below"), (F.col("cum") - F.col("below")).cast("double"))
        at = F.when(F.col("hi") == float("inf"), F.col("lo")).otherwise(
            F.col("lo") + (F.col("hi") - F.col("lo")) * F.coalesce(share, F.lit(0.0))
        )
        hit = (F.col("cum") >= rank) & (F.col("total") > 0)
        out.append(F.min_by(F.when(hit, at), F.when(hit, F.col("hi"))).alias(f"p{round(p * 100):02d}"))
    return rows.groupBy(*by).agg(F.max("total").alias("requests"), *out)


def mon_success_rate(runs: DataFrame, by: Sequence[str] = ("pipeline_id",)) -> DataFrame:
    return (
        runs.groupBy(*by)
        .agg(
            F.count(F.when(F.col("state") == "success", 1)).alias("succeeded"),
            F.count(F.lit(1)).alias("total"),
        )
        .withColumn("success_pct", F.col("succeeded") * 100.0 / F.col("total"))
    )


def mon_up(scrapes: DataFrame, now: Column | datetime | str, every: str = "1 minute", lookback: str | None = None) -> DataFrame:
    """Liveness as samples ``metric, instance, ts, value``: for each stretch of ``every`` from an
    instance's first scrape to now 1 if it was scraped, else 0, at the stretch's end. ``lookback``
    gives the newest stretches only: what a rule that looks back 2 minutes needs of a year's scrapes is
    read by time and is as many samples as stretches; instances that were not scraped since are found
    by their older scrapes."""
    start = F.window("ts", every).getField("start")
    past = scrapes.where(F.col("ts") < ts_of(now))
    if lookback is None:
        seen = past.select("instance", start.alias("__start")).distinct()
        first = seen.groupBy("instance").agg(F.min("__start").alias("__first"))
    else:
        from_ = ts_of(now) - interval_of(lookback)
        seen = past.where(F.col("ts") >= from_).select("instance", start.alias("__start")).distinct()
        began = past.groupBy("instance").agg(F.min("ts").alias("ts"))
        first = began.select("instance", F.greatest(start, F.window(F.greatest(F.col("ts"), from_), every).getField("start")).alias("__first"))
    ends = F.sequence("__first", ts_of(now) - interval_of(every), interval_of(every))
    grid = first.select("instance", F.explode(ends).alias("__start"))
    value = F.when(F.col("up").isNotNull(), 1.0).otherwise(0.0)
    return grid.join(seen.withColumn("up", F.lit(1)), ["instance", "__start"], "left").select(
        F.lit("up").alias("metric"), "instance", (F.col("__start") + interval_of(every)).alias("ts"), value.alias("value")
    )


def mon_rule_samples(
    gauges: DataFrame | None = None,
    requests: DataFrame | None = None,
    runs: DataFrame | None = None,
    ingested: DataFrame | None = None,
    up: DataFrame | None = None,
) -> DataFrame:
    """What the rules read, ``metric, instance, ts, value``: model gauges as they are, drift where R²
    declines with it (0 where it doesn't), the share of failed requests in 5 minutes, durations of
    runs that ended, what came in within an hour, and liveness."""
    cols = ["metric", F.col("instance").cast("string").alias("instance"), "ts", F.col("value").cast("double").alias("value")]
    parts = []
    if gauges is not None:
        parts.append(gauges.select(*cols))
        # One pass: what an instance reports at one time meets in one group.
        value, drift = F.col("value").cast("double"), F.col("metric") == "drift_share"
        met = gauges.where(drift | (F.col("metric") == "model_r2_champion_current")).groupBy("instance", "ts").agg(
            F.collect_list(F.when(drift, value)).alias("shares"), F.coalesce(F.max(~drift & (value < 0.70)), F.lit(False)).alias("declines")
        )
        shares = met.select("instance", "ts", "declines", F.explode("shares").alias("share"))
        declining = F.when(F.col("declines") & (F.col("share") > 0.5), F.col("share")).otherwise(0.0)
        parts.append(shares.select(F.lit("drift_and_declining_r2").alias("metric"), "instance", "ts", declining.alias("value")).select(*cols))
    if requests is not None:
        ratio = mon_error_ratio(requests, "5 minutes").select(
            F.lit("api_error_ratio").alias("metric"), F.lit("api").alias("instance"),
            (F.col("window_start") + interval_of("5 minutes")).alias("ts"), (F.col("errors") / F.col("requests")).alias("value"),
        )
        parts.append(ratio.select(*cols))
    if runs is not None:
        took = runs.where(F.col("end_ts").isNotNull()).select(
            F.lit("run_duration_seconds").alias("metric"), F.col("pipeline_id").alias("instance"), F.col("end_ts").alias("ts"),
            seconds_between(F.col("end_ts"), F.col("start_ts")).alias("value"),
        )
        parts.append(took.select(*cols))
    if ingested is not None:
        grown = mon_rate_increase(ingested, "1 hour", "increase").select(
            F.lit("records_ingested_increase_1h").alias("metric"), "instance",
            (F.col("window_start") + interval_of("1 hour")).alias("ts"), F.col("increase").alias("value"),
        )
        parts.append(grown.select(*cols))
    if up is not None:
        parts.append(up.select(*cols))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def interval_of(text: str) -> Column:
    return F.expr(f"INTERVAL {text}")


def mon_reduce_last(
    metrics: DataFrame,
    now: Column | datetime | str,
    lookback: str = "10 MINUTES",
    series: Sequence[str] = SERIES,
) -> DataFrame:
    """Last value of each series in the look-back range that ends now."""
    t = ts_of(now)
    recent = metrics.where((F.col("ts") > t - F.expr(f"INTERVAL {lookback}")) & (F.col("ts") <= t))
    return recent.groupBy(*series).agg(
        F.max_by("value", F.struct("ts", "value")).alias("value"), F.max("ts").alias("last_ts")
    )


def breach(value: Column) -> Column:
    """Whether a value meets its rule (columns evaluator, low, high). Ranges exclude their ends."""
    low, high, kind = F.col("low"), F.col("high"), F.col("evaluator")
    return (
        F.when(kind == "lt", value < low)
        .when(kind == "gt", value > low)
        .when(kind == "eq", value == low)
        .when(kind == "within_range", (value > low) & (value < high))
    )


def mon_threshold(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Each value against the rules of its metric."""
    return metrics.join(rules, "metric").withColumn("breach", breach(F.col("value")))


def mon_and_match(
    a: DataFrame, b: DataFrame, on: Sequence[str], when_a: Column, when_b: Column
) -> DataFrame:
    """Samples of ``a`` that meet their condition while a sample of ``b`` with the same labels meets
    its own; the values are those of ``a``."""
    return a.where(when_a).join(b.where(when_b).select(*on).distinct(), list(on), "left_semi")


def alert_history(
    states: DataFrame, rules: DataFrame, by: Sequence[str] = ("rule", "instance")
) -> DataFrame:
    """Every evaluation with the time its condition has held since, and Normal, Pending or Firing.

    Evaluations are handled day by day. Within a day a run of breaches starts where the evaluation
    before was fine; whether the day's first breach starts a run, and which run reaches into the
    day, follows from one row per earlier day."""
    by = list(by)
    day = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date"))
    one = (
        states.groupBy(*by, "ts")
        .agg(F.coalesce(F.max("breach"), F.lit(False)).alias("breach"))
        .withColumn(BUCKET, F.coalesce(day, F.lit(-1)))
    )
    keys = [*by, BUCKET]
    inside = Window.partitionBy(*keys).orderBy("ts")
    rows = one.withColumn("__start", F.when(F.col("breach") & ~F.lag("breach").over(inside), F.col("ts")))
    days = rows.groupBy(*keys).agg(
        F.max("__start").alias("__latest"),
        F.min("ts").alias("__first_ts"),
        F.min_by("breach", "ts").alias("__first"),
        F.max_by("breach", "ts").alias("__last"),
    )
    in_order = Window.partitionBy(*by).orderBy(BUCKET)
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.when(
        F.col("__first") & ~F.coalesce(F.lag("__last").over(in_order), F.lit(False)), F.col("__first_ts")
    )
    carry = (
        days.withColumn("__opens", opens)
        .withColumn("__reach", F.max(F.greatest("__latest", "__opens")).over(earlier))
        .select(*keys, F.greatest("__opens", "__reach").alias("__carried"))
    )
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    since = rows.join(carry, keys).withColumn(
        "since", F.greatest(F.max("__start").over(upto), F.col("__carried"))
    )
    return _named_state(since, rules, F.col("ts")).select(
        *by, "ts", "breach", F.when(F.col("breach"), F.col("since")).alias("active_since"), "state"
    )


def _named_state(df: DataFrame, rules: DataFrame, at: Column) -> DataFrame:
    held = seconds_between(at, F.col("since"))
    return df.join(rules.select("rule", "for_s"), "rule").withColumn(
        "state",
        F.when(~F.col("breach"), "Normal").when(held >= F.col("for_s"), "Firing").otherwise("Pending"),
    )


def mon_for_duration(
    states: DataFrame,
    rules: DataFrame,
    now: Column | datetime | str,
    by: Sequence[str] = ("rule", "instance"),
    expected: DataFrame | None = None,
) -> DataFrame:
    """State of every alert now: a condition fires when it has held without a break for the rule's
    duration. A series without an evaluation in the rule's look-back takes its no-data policy, and so
    does a series of ``expected`` (its ``by`` columns) that was never evaluated.

    Two aggregations give the answer, the last evaluation that was fine and the first breach after
    it; nothing is sorted."""
    by = list(by)
    t = ts_of(now)
    past = states.where(F.col("ts") <= t)
    last = past.groupBy(*by).agg(
        F.max(F.when(~F.col("breach"), F.col("ts"))).alias("last_ok"),
        F.max("ts").alias("last_ts"),
        F.max_by("breach", F.struct("ts", "breach")).alias("breach"),
    )
    since = (
        past.where(F.col("breach"))
        .join(last.select(*by, "last_ok"), by)
        .where(F.col("last_ok").isNull() | (F.col("ts") > F.col("last_ok")))
        .groupBy(*by)
        .agg(F.min("ts").alias("since"))
    )
    known = last.join(since, by, "left")
    if expected is not None:
        known = known.unionByName(expected.select(*by).distinct().join(last.select(*by), by, "left_anti"), allowMissingColumns=True)
    return state_now(known, rules, t, by)


def state_now(known: DataFrame, rules: DataFrame, now: Column, by: Sequence[str] = ("rule", "instance")) -> DataFrame:
    """States at ``now`` of alerts with their last evaluation (``last_ts``, ``breach``) and the time
    since which the condition has held (``since``)."""
    joined = known.join(rules.select("rule", "for_s", "lookback_s", "no_data"), "rule")
    quiet_for = seconds_between(now, F.col("last_ts"))
    silent = F.col("last_ts").isNull() | (quiet_for > F.col("lookback_s"))
    held = seconds_between(now, F.col("since"))
    state = (
        F.when(silent & (F.col("no_data") == "OK"), "Normal")
        .when(silent & (F.col("no_data") == "NoData"), "NoData")
        .when(silent, F.when(F.col("last_ts").isNull() | (quiet_for >= F.col("for_s")), "Firing").otherwise("Pending"))
        .when(~F.col("breach"), "Normal")
        .when(held >= F.col("for_s"), "Firing")
        .otherwise("Pending")
    )
    return joined.select(
        *by,
        "last_ts",
        F.when(F.col("breach"), F.col("since")).alias("active_since"),
        state.alias("state"),
    )


def _aligned(metrics: DataFrame, names: dict[str, str], bucket: str, by: Sequence[str]) -> DataFrame:
    """Last value of each named metric per time bucket, side by side."""
    return (
        metrics.where(F.col("metric").isin(list(names)))
        .groupBy(*by, F.window("ts", bucket).getField("start").alias("bucket_start"))
        .agg(
            *[
                F.max_by(
                    F.when(F.col("metric") == m, F.col("value")),
                    F.when(F.col("metric") == m, F.struct("ts", "value")),
                ).alias(out)
                for m, out in names.items()
            ]
        )
    )


def mon_r2_vs_drift(
    metrics: DataFrame, bucket: str = "1 hour", by: Sequence[str] = ("instance",)
) -> DataFrame:
    """R² and drift share on one time axis; buckets that have both."""
    names = {"model_r2_champion_current": "r2", "drift_share": "drift_share"}
    return _aligned(metrics, names, bucket, by).dropna(subset=["r2", "drift_share"])


def mon_champion_vs_challenger(
    metrics: DataFrame, bucket: str = "1 hour", by: Sequence[str] = ("instance",)
) -> DataFrame:
    """R² (both test sets) and RMSE of champion and challenger per time bucket."""
    names = {
        "model_r2_champion_current": "r2_champion_current",
        "model_r2_challenger_current": "r2_challenger_current",
        "model_r2_champion_baseline": "r2_champion_baseline",
        "model_r2_challenger_baseline": "r2_challenger_baseline",
        "model_rmse_production": "rmse_champion",
        "prediction_rmse": "rmse_challenger",
    }
    return _aligned(metrics, names, bucket, by).withColumn(
        "r2_gain", F.col("r2_challenger_current") - F.col("r2_champion_current")
    )
