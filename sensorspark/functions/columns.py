"""Small column expressions shared by the operators."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorspark.schema import LOCAL_TIME_ZONE, YEAR_BASE, YEAR_INDEX

# Accepted spellings of a reading timestamp, most specific first.
OFFSET_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]XXX",
]
PLAIN_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
]


def ts_of(value: Column | datetime | date | str) -> Column:
    """A timestamp column from a column or a literal."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp_ntz")


def interval(amount: float, unit: str) -> Column:
    return F.expr(f"INTERVAL {amount} {unit}")


def utc_timestamp(text: Column, formats: Sequence[str] | None = None) -> Column:
    """Text in mixed formats to UTC wall time (no zone); null when nothing fits. Text without an
    offset is taken as UTC. Texts are parsed with an offset, theirs or ``Z``, so they name instants
    and the session's zone plays no part."""
    formats = [*OFFSET_FORMATS, *PLAIN_FORMATS] if formats is None else formats
    tries = []
    for fmt in formats:
        if fmt.rstrip("]").endswith(("X", "Z", "x")):
            tries.append(F.try_to_timestamp(text, F.lit(fmt)))
        else:
            tries.append(F.try_to_timestamp(F.concat(text, F.lit("Z")), F.lit(fmt + "XXX")))
    return utc_wall(F.coalesce(*tries))


def utc_wall(instant: Column) -> Column:
    """The UTC wall time of a zoned timestamp."""
    seconds = (F.unix_micros(instant) / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def utc_instant(wall: Column) -> Column:
    """The zoned timestamp whose UTC wall time is given."""
    return F.timestamp_micros(micros(wall))


def local_time(ts: Column, tz: str = LOCAL_TIME_ZONE) -> Column:
    """UTC wall time to wall time in ``tz``."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts)


def cyclic(col: Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * col / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def year_index(year: Column, base: int | None = YEAR_BASE) -> Column:
    """Year as a small index, counted from ``base``; without one only the known years have any."""
    if base is not None:
        return (year - F.lit(base)).cast("int")
    out = F.lit(None).cast("int")
    for known, idx in YEAR_INDEX.items():
        out = F.when(year == known, F.lit(idx)).otherwise(out)
    return out


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a wall time, whatever the session's zone (a cast to a zoned type
    would bend the hours around its clock changes)."""
    wall = ts.cast("timestamp_ntz")
    day = F.datediff(wall.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    minutes = (day * 24 + F.hour(wall)) * 60 + F.minute(wall)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), wall) * 1_000_000).cast("bigint")


def seconds_between(end: Column, start: Column) -> Column:
    """Elapsed seconds with fractions."""
    return (micros(end) - micros(start)) / F.lit(1_000_000.0)


def floor_days(end: Column, start: Column) -> Column:
    """Whole days, rounded towards minus infinity (half a day back is -1)."""
    return F.floor(seconds_between(end, start) / 86400.0)


def divide(a: Column, b: Column) -> Column:
    """a / b, null when b is 0."""
    return F.when(b != 0, a / b)


def since(df: DataFrame, ts: str, start: Column, strict: bool = False, day: str | None = None) -> DataFrame:
    """Rows from ``start`` on. Where the table keeps the day of ``ts`` as a column of its own
    (``reading_date`` beside ``reading_ts``), the day is filtered too, so whole partitions drop out."""
    day = day or {"reading_ts": "reading_date"}.get(ts)
    out = df.where(F.col(ts) > start if strict else F.col(ts) >= start)
    if day in df.columns:
        out = out.where(F.col(day) >= start.cast("date"))
    return out
