"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorspark.functions.columns import since, ts_of
from sensorspark.schema import DRIFT_ALWAYS_KEEP, DRIFT_EXCLUDE_PATTERNS, ROLES, Roles


def flt_high_water(df: DataFrame, target: DataFrame, roles: Roles = ROLES) -> DataFrame:
    """Rows strictly newer than the newest row of ``target``; all rows when it is empty (rows
    without a timestamp included). The mark is one value, so it becomes a literal and reaches the
    scan."""
    mark = target.agg(F.max(roles.ts)).first()[0]
    return df if mark is None else since(df, roles.ts, ts_of(mark), strict=True)


def flt_valid_count(df: DataFrame, roles: Roles = ROLES) -> DataFrame:
    return df.where(F.col(roles.value) > 0)


def flt_date_range(
    df: DataFrame,
    start: date | str | None,
    end: date | str | None,
    end_inclusive: str = "midnight",
    roles: Roles = ROLES,
) -> DataFrame:
    """Rows from ``start`` on. ``end_inclusive`` says what the end date covers: ``midnight`` keeps
    only its first instant, ``day`` the whole day, ``none`` stops before it."""
    ts = F.col(roles.ts)
    out = df if start is None else df.where(ts >= ts_of(start))
    if end is None:
        return out
    if end_inclusive == "midnight":
        return out.where(ts <= ts_of(end))
    if end_inclusive == "day":
        return out.where(ts < ts_of(end) + F.expr("INTERVAL 1 DAY"))
    if end_inclusive == "none":
        return out.where(ts < ts_of(end))
    raise ValueError(f"end_inclusive: {end_inclusive}")


def flt_not_null_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.dropna(subset=[a, b])


def flt_feature_select(
    cols: Sequence[str],
    exclude: Sequence[str] = DRIFT_EXCLUDE_PATTERNS,
    keep: Sequence[str] = DRIFT_ALWAYS_KEEP,
) -> list[str]:
    """Columns worth testing for drift: those kept by name, and those whose name contains no
    excluded part. All columns when nothing remains."""
    chosen = [c for c in cols if c in keep or not any(part in c.lower() for part in exclude)]
    return chosen or list(cols)


def flt_valid_coords(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["latitude", "longitude"])


def flt_recent_ingest(
    df: DataFrame, now: Column | datetime | str, minutes: int = 5, col: str = "ingestion_ts"
) -> DataFrame:
    return df.where(F.col(col) >= ts_of(now) - F.expr(f"INTERVAL {minutes} MINUTES"))
