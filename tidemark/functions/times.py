"""Time helpers. Batch columns are TIMESTAMP_NTZ, so no session zone is involved."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

_CALENDAR_UNITS = ("week", "month", "quarter", "year")


def as_of(df: DataFrame, ts: str, value: datetime | str | Column | None = None) -> Column:
    """The reference instant: ``value`` if given, else the newest ``ts`` of ``df``.

    The default is a scalar subquery, so it costs one pruned column scan and
    never visits the driver.
    """
    if value is None:
        return df.agg(F.max(ts)).scalar()
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp_ntz")


def ago(instant: Column, n: int, unit: str) -> Column:
    return instant - F.expr(f"INTERVAL {int(n)} {unit.upper()}")


def floor_time(ts: str | Column, n: int = 1, unit: str = "hour") -> Column:
    """Start of the ``n``-unit bucket that holds ``ts``."""
    if unit in _CALENDAR_UNITS:
        if n != 1:
            raise ValueError("calendar units are floored one at a time")
        return F.date_trunc(unit, ts).cast("timestamp_ntz")
    return F.window(ts, f"{int(n)} {unit}")["start"]


def millis_between(start: Column | str, end: Column | str) -> Column:
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    return F.timestamp_diff("MILLISECOND", start, end)


def epoch_millis(ts: Column | str) -> Column:
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def to_local_literal(instant: Column | str, zone: str, source_zone: str = "UTC") -> Column:
    """Wall-clock text of an instant in ``zone``; ``instant`` is held in ``source_zone``."""
    local = F.convert_timezone(F.lit(source_zone), F.lit(zone), instant)
    return F.date_format(local, "yyyy-MM-dd HH:mm:ss")


def partition_of(literal: Column | str) -> Column:
    """Name of the day partition that a wall-clock literal falls into."""
    return F.concat(F.lit("p"), F.date_format(F.to_date(literal), "yyyyMMdd"))
