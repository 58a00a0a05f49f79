"""Timeframes and time: lengths, period starts, zones, differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTES = {"1m": 1, "5m": 5, "15m": 15, "30m": 30, "1h": 60, "4h": 240, "1d": 1440, "1w": 10080}


def minutes(timeframe: Column) -> Column:
    """The length in minutes of a timeframe's name; null for an unknown one."""
    table = F.create_map(*[F.lit(x) for kv in MINUTES.items() for x in kv])
    return F.try_element_at(table, timeframe)


def period_start(ts: Column, timeframe: str) -> Column:
    """The start of the period that holds ``ts``: multiples of the length from midnight, Mondays for weeks."""
    if timeframe == "1w":
        return F.date_trunc("week", ts)
    seconds = MINUTES[timeframe] * 60
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts.cast("timestamp")) / seconds) * seconds)


def to_utc(ts: Column, zone: Column | str) -> Column:
    """A wall-clock time of ``zone`` as UTC."""
    return F.to_utc_timestamp(ts, zone)


def hours_between(start: Column, end: Column) -> Column:
    """Hours from start to end, never under 0; null if either is."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.when(micros.isNotNull(), F.greatest(F.lit(0.0), micros / F.lit(3.6e9)))


def finite(x: Column) -> Column:
    """A number, or null for NaN, infinities and null."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)
