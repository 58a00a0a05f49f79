"""Signals: direction, confidence and, where there is none, the reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.indicators import last

SIGNAL = ["symbol", "ts", "bar_idx", "source", "direction", "confidence", "reject_reason"]


def _as_signal(rows: DataFrame, source: str, direction: Column, confidence: Column, reason: Column, *more: str) -> DataFrame:
    reason = F.when(reason.isNotNull(), reason).when(confidence <= 0, "zero_confidence")
    return rows.select("symbol", "ts", "bar_idx", F.lit(source).alias("source"), F.when(reason.isNull(), direction).alias("direction"), F.when(reason.isNull(), confidence).alias("confidence"), reason.alias("reject_reason"), *more)


def pullback_signal(bars: DataFrame, min_strength: float = 0.6) -> DataFrame:
    """A pullback with the trend. Bars without a pattern give no row. Confidence: the pattern's strength (or depth) times the trend's; zone: close +- half an ATR."""
    rows = bars.where("pullback_direction is not null").withColumn("_s", F.coalesce("pullback_strength", "pullback_depth", F.lit(0.0)))
    reason = F.when(F.col("_s") < min_strength, "weak_pattern").when(F.col("trend_direction") != F.col("pullback_direction"), "against_trend")
    rows = rows.withColumns({"zone_low": F.col("close") - 0.5 * F.col("atr"), "zone_high": F.col("close") + 0.5 * F.col("atr")})
    return _as_signal(rows, "pullback", F.col("pullback_direction"), F.col("_s") * F.col("trend_strength"), reason, "zone_low", "zone_high")


def breakout_signal(bars: DataFrame, compress_bars: int = 10, max_range: float = 3.0, min_age: int = 0, min_penetration: float = 0.0) -> DataFrame:
    """A close through the channel with the trend, out of a range of at most ``max_range`` ATRs. Other bars give no row.

    ``min_age``: bars that the breakout before it is back at least; the range is that of the ``compress_bars`` bars before.
    """
    rows = bars.withColumns({"_range": F.max("high").over(last(compress_bars, 1)) - F.min("low").over(last(compress_bars, 1)), "_before": F.lag("breakout_age").over(Window.partitionBy("symbol").orderBy("ts"))})
    up = F.col("close") > F.col("channel_high")
    rows = rows.where(up | (F.col("close") < F.col("channel_low"))).withColumn("_dir", F.when(up, "bullish").otherwise("bearish"))
    depth = F.when(F.col("_dir") == "bullish", F.col("close") - F.col("channel_high")).otherwise(F.col("channel_low") - F.col("close"))
    reason = (
        F.when(~F.coalesce(F.col("atr") > 0, F.lit(False)), "no_atr")
        .when(F.col("_before") < min_age, "stale")
        .when(F.col("trend_direction") != F.col("_dir"), "against_trend")
        .when(F.col("_range") > max_range * F.col("atr"), "not_compressed")
        .when(depth < min_penetration * F.col("atr"), "shallow")
    )
    return _as_signal(rows, "breakout", F.col("_dir"), F.col("trend_strength"), reason)


def reversion_signal(bars: DataFrame, swings: DataFrame, short_max: float | None = 0.8) -> DataFrame:
    """Fades a magnitude swing at the bar that confirms it; shorts only low in the range (``position`` of the bars), if that is known."""
    at = swings.where("accepted").select("symbol", F.col("confirm_idx").alias("bar_idx"), "type", F.col("price").alias("pivot_price"), F.col("bar_idx").alias("pivot_idx"))
    rows = bars.join(at, ["symbol", "bar_idx"])
    down = F.col("type") == "H"
    reason = F.when(down & ~F.coalesce(F.col("position") < short_max, F.lit(False)), "short_filter") if short_max is not None else F.lit(None).cast("string")
    return _as_signal(rows, "reversion", F.when(down, "bearish").otherwise("bullish"), F.lit(1.0), reason, "pivot_price", "pivot_idx")


def evaluated(parts: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The signals of several strategies, ranked by their order in the list, and the rejections."""
    marked = [p.select(*SIGNAL).withColumn("priority", F.lit(i)) for i, p in enumerate(parts)]
    rows = reduce(DataFrame.unionByName, marked)
    return rows.where("direction is not null"), rows.where("direction is null")


def first_accepted(candidates: DataFrame) -> DataFrame:
    """Of each symbol and bar, the candidate of the first strategy."""
    n = F.row_number().over(Window.partitionBy("symbol", "bar_idx").orderBy("priority", "source"))
    return candidates.withColumn("_n", n).where("_n = 1").drop("_n")
