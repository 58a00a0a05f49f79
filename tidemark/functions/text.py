"""Texts about prices, trades and notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _trimmed(s: Column) -> Column:
    return F.when(s.contains("."), F.regexp_replace(F.regexp_replace(s, "0+$", ""), "\\.$", "")).otherwise(s)


def price_text(x: Column) -> Column:
    """A price with 2, 4 or 6 decimals by its magnitude (100 and over, 1 and over, less), trailing zeros trimmed."""
    a = F.abs(x)
    return _trimmed(F.when(a >= 100, F.format_string("%.2f", x)).when(a >= 1, F.format_string("%.4f", x)).otherwise(F.format_string("%.6f", x)))


def percent_text(x: Column) -> Column:
    """A percentage: whole from 1000 on, one decimal from 100 on, else two."""
    a = F.abs(x)
    return F.when(a >= 1000, F.format_string("%.0f%%", x)).when(a >= 100, F.format_string("%.1f%%", x)).otherwise(F.format_string("%.2f%%", x))


def pip_size(symbol: Column) -> Column:
    """The pip of a currency pair: 0.01 against the yen, else 0.0001."""
    return F.when(F.endswith(symbol, F.lit("JPY")), F.lit(0.01)).otherwise(F.lit(0.0001))


def distance_text(symbol: Column, a: Column, b: Column) -> Column:
    return F.concat(F.format_string("%.1f", F.abs(a - b) / pip_size(symbol)), F.lit(" pips"))


def point_name(symbol: Column, ts: Column, kind: Column, direction: Column, result: Column, pnl: Column) -> Column:
    """The name of a point of interest; parts that are null are left out."""
    amount = F.when(pnl.isNotNull(), F.format_string("%+.2f", pnl))
    return F.concat_ws("_", symbol, F.date_format(ts, "yyyy-MM-dd"), kind, direction, result, amount)


def alert_line(kind: Column, symbol: Column, direction: Column, entry: Column, stop: Column, target: Column, r: Column) -> Column:
    """The line of an entry, with its reward to risk, or of an exit."""
    ratio = F.try_divide(F.abs(target - entry), F.abs(entry - stop))
    opened = F.concat_ws(" ", F.lit("ENTRY"), symbol, direction, F.concat(F.lit("@"), price_text(entry)), F.concat(F.lit("SL "), price_text(stop)), F.concat(F.lit("TP "), price_text(target)), F.format_string("R:R %.2f", ratio))
    return F.when(kind == "entry", opened).otherwise(F.concat_ws(" ", F.lit("EXIT"), symbol, direction, F.format_string("%+.2fR", r)))


def review_tag(cell: Column) -> Column:
    """The name in a review cell's mark, or null."""
    found = F.regexp_extract(cell, r"<!--\s*REVIEW:\s*(.+?)\s*-->", 1)
    return F.when(found != "", found)


def note_state(note: Column) -> Column:
    """none, empty or text."""
    return F.when(note.isNull(), "none").when(F.trim(note) == "", "empty").otherwise("text")
