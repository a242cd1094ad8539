"""Column expressions on single values: time, altitude, heading, percentages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS = {"s": 1_000_000, "ms": 1_000, "us": 1}


def as_micros(df: DataFrame, name: str, unit: str = "us") -> Column:
    """Any time column as epoch microseconds. Epoch numbers need their ``unit``; nothing is guessed."""
    dt = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dt, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(dt, (T.DoubleType, T.FloatType, T.DecimalType)):
        return F.round(c.cast("double") * MICROS[unit]).cast("long")
    return c.cast("long") * F.lit(MICROS[unit])


def micros_to_timestamp(us: Column) -> Column:
    return F.timestamp_micros(us)


def timestamp_to_millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def point_time(base_s: Column, offset_s: Column) -> Column:
    """UTC time of a report given as base second plus fractional offset."""
    return F.timestamp_micros(F.round((base_s + offset_s) * 1e6).cast("long"))


def seconds_before(now: Column, seen: Column) -> Column:
    """Time of the report itself: the snapshot time less how long ago it was heard."""
    return now - F.coalesce(seen, F.lit(0))


def altitude_or_ground(c: Column, ignore_case: bool = True) -> Column:
    """The word 'ground' is altitude 0; other text is read as a number or becomes NULL."""
    text = c.cast("string")
    word = F.lower(text) if ignore_case else text
    return F.when(word == "ground", F.lit(0)).otherwise(text.try_cast("double").try_cast("int"))


def short_id(c: Column, n: int = 6) -> Column:
    return F.substring(c, 1, n)


def minutes_since_midnight(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def minutes_crossed(start: Column, end: Column) -> Column:
    """Minute boundaries between two times, so 00:00:59 to 00:01:01 is 1."""
    return (F.floor(F.unix_micros(end) / 60_000_000) - F.floor(F.unix_micros(start) / 60_000_000)).cast("long")


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(F.lit(100.0) * part, whole), digits)


def duration_text(us: Column) -> Column:
    """HH:MM:SS.ffffff"""
    return F.format_string(
        "%02d:%02d:%02d.%06d",
        F.floor(us / 3_600_000_000).cast("long"),
        F.floor(us / 60_000_000).cast("long") % 60,
        F.floor(us / 1_000_000).cast("long") % 60,
        us % 1_000_000,
    )


def non_null_fields(cols: list[str]) -> Column:
    """How many of the named columns hold a value."""
    total = F.lit(0)
    for c in cols:
        total = total + F.when(F.col(f"`{c}`").isNotNull(), 1).otherwise(0)
    return total


def heading_change(a: Column, b: Column) -> Column:
    """Signed turn from ``a`` to ``b`` in degrees across the 0/360 seam."""
    d = b - a
    return F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)
