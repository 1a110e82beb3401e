"""Windows and unions over stored tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorspark.functions.columns import since, ts_of
from sensorspark.functions.ordering import first_rows, top_k_per_group
from sensorspark.schema import ROLES, Roles


def src_warehouse_window(
    df: DataFrame,
    now: Column | datetime | str,
    interval: str,
    order_by: Sequence[Column] | None = None,
    limit: int | None = None,
    roles: Roles = ROLES,
) -> DataFrame:
    """Rows not older than ``interval`` (such as ``48 HOURS``) before ``now``. A literal ``now``
    reaches the scan as a pushed filter. A limit needs an order."""
    out = since(df, roles.ts, ts_of(now) - F.expr(f"INTERVAL {interval}"))
    if order_by is not None:
        out = out.orderBy(*order_by)
    if limit is not None:
        if order_by is None:
            raise ValueError("limit needs order_by")
        out = out.limit(limit)
    return out


def src_daily_union(
    df: DataFrame,
    now: Column | date | str,
    days_back: int = 7,
    limit_per_day: int | None = None,
    day_col: str = "reading_date",
    order_by: Sequence[str] = ("reading_ts", "sensor_id"),
) -> DataFrame:
    """The rows of the last ``days_back`` days before today, with ``limit_per_day`` the first so many
    of each day. A day without data simply has no partition."""
    today = ts_of(now).cast("date")
    days = df.where((F.col(day_col) >= F.date_sub(today, days_back)) & (F.col(day_col) < today))
    if limit_per_day is None:
        return days
    return top_k_per_group(days, [day_col], [F.col(c) for c in order_by], limit_per_day)


def src_unified_view(
    history: DataFrame, live: DataFrame, cutoff: Column | datetime | str, roles: Roles = ROLES
) -> DataFrame:
    """History up to and including the cutoff, live data after it; columns align by name."""
    cut = ts_of(cutoff)
    return history.where(F.col(roles.ts) <= cut).unionByName(
        live.where(F.col(roles.ts) > cut), allowMissingColumns=True
    )


def src_days(df: DataFrame, days: DataFrame, part: str = "reading_date") -> DataFrame:
    """The rows of the days that another table names (days to load again, days with alerts). The days
    (one row each, so there are never many) are broadcast, and the same broadcast prunes the scan of a
    table that is partitioned by day: other folders are not read."""
    named = days.select(F.col(part).cast("date").alias(part)).where(F.col(part) > F.lit("0001-01-01").cast("date")).distinct()
    return df.join(F.broadcast(named), part, "left_semi")


def src_first_n(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in an explicit order (files have none in Spark)."""
    return first_rows(df, [F.col(c) for c in order_by], n)
