"""Bar indicators. Every frame ends at the current bar: a value at a bar depends on no later one.

``bars``: symbol, ts, open, high, low, close, volume; a window is one symbol's bars in time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Bars before the current one that an analysis sees.
LOOKBACK = 100


def in_time() -> WindowSpec:
    """A symbol's bars in time."""
    return Window.partitionBy("symbol").orderBy("ts")


def last(n: int, skip: int = 0):
    """The frame of the ``n`` bars that end ``skip`` bars ago."""
    return in_time().rowsBetween(-(n - 1) - skip, -skip)


def indexed(bars: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """bar_idx from 0 and is_valid: a whole lookback lies before the bar."""
    return bars.withColumn("bar_idx", (F.row_number().over(in_time()) - 1).cast("long")).withColumn("is_valid", F.col("bar_idx") >= lookback)


def history(column: str, lookback: int = LOOKBACK) -> Column:
    """The values of the lookback and the current bar, oldest first."""
    return F.collect_list(column).over(in_time().rowsBetween(-lookback, 0))


def true_range() -> Column:
    """The true range; 0 at a symbol's first bar."""
    before = F.lag("close").over(in_time())
    return F.when(before.isNull(), F.lit(0.0)).otherwise(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def with_atr_sma(bars: DataFrame, period: int = 14, name: str = "atr") -> DataFrame:
    """The mean true range of the last ``period`` bars, over as many as have one; 0 at the first bar. Needs bar_idx."""
    rows = bars.withColumn("_tr", true_range())
    n = F.least("bar_idx", F.lit(period))
    return rows.withColumn(name, F.when(n > 0, F.sum("_tr").over(last(period)) / n).otherwise(F.lit(0.0))).drop("_tr")


def with_atr_wilder(bars: DataFrame, period: int = 14, lookback: int = LOOKBACK, name: str = "atr_wilder") -> DataFrame:
    """Wilder's smoothing within the lookback: the mean of the window's first ``period`` true ranges, then a fold over the others."""
    names = ["high", "low", "close"]
    rows = bars.withColumn("_w", F.collect_list(F.struct(*names)).over(in_time().rowsBetween(-lookback, 0)))
    before, now = F.slice("_w", 1, F.greatest(F.size("_w") - 1, F.lit(0))), F.slice("_w", 2, F.size("_w"))
    tr = F.zip_with(before, now, lambda a, b: F.greatest(b["high"] - b["low"], F.abs(b["high"] - a["close"]), F.abs(b["low"] - a["close"])))
    rows = rows.withColumn("_tr", tr).drop("_w")
    head = F.slice("_tr", 1, period)
    seed = F.aggregate(head, F.lit(0.0), lambda a, x: a + x) / F.size(head)
    fold = F.aggregate(F.slice("_tr", period + 1, lookback + 1), seed, lambda a, x: (a * (period - 1) + x) / period)
    return rows.withColumn(name, F.when(F.size("_tr") > 0, fold).otherwise(F.lit(0.0))).drop("_tr")


def ema_of(values: Column, period: int) -> Column:
    """The exponential mean of a list, seeded with the mean of its first ``period``; of a shorter list, of all of it."""
    if period < 2:
        return F.element_at(values, -1)
    k = 2.0 / (period + 1)
    short = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)
    head = F.aggregate(F.slice(values, 1, period), F.lit(0.0), lambda a, x: a + x) / period
    fold = F.aggregate(F.slice(values, period + 1, 100_000), head, lambda a, x: x * k + a * (1 - k))
    return F.when(F.size(values) <= period, short).otherwise(fold)


def with_ema(bars: DataFrame, period: int = 20, lookback: int = LOOKBACK, name: str | None = None) -> DataFrame:
    rows = bars.withColumn("_h", history("close", lookback))
    return rows.withColumn(name or f"ema_{period}", ema_of(F.col("_h"), period)).drop("_h")


def side_of(price: Column, mean: Column) -> Column:
    return F.when(price > mean, "above").when(price < mean, "below").otherwise("at")


def with_channel(bars: DataFrame, period: int = 20) -> DataFrame:
    """The highest high and lowest low of the ``period`` bars before the current one."""
    frame = last(period, 1)
    return bars.withColumns({"channel_high": F.max("high").over(frame), "channel_low": F.min("low").over(frame)})


def with_breakout_age(bars: DataFrame, period: int = 20, lookback: int = LOOKBACK) -> DataFrame:
    """Bars since the last close outside its own channel within the lookback. Needs bar_idx and the channel.

    0 while the window is too short to tell; the number of bars before the current one if there was none.
    """
    full = F.col("bar_idx") >= period
    out = full & ((F.col("close") > F.col("channel_high")) | (F.col("close") < F.col("channel_low")))
    rows = bars.withColumn("_out", F.when(out, F.col("bar_idx")))
    seen = F.least(F.col("bar_idx") + 1, F.lit(lookback + 1))
    when = F.max("_out").over(in_time().rowsBetween(-(lookback - period), 0))
    age = F.when(seen < period + 2, 0).otherwise(F.coalesce(F.col("bar_idx") - when, seen - 1))
    return rows.withColumn("breakout_age", age.cast("int")).drop("_out")


def with_trend(bars: DataFrame, fast: str = "ema_20", slow: str = "ema_50", atr: str = "atr_wilder") -> DataFrame:
    """Direction of the fast mean against the slow one, and its strength: their distance in ATRs, at most 1."""
    f, s = F.col(fast), F.col(slow)
    strength = F.round(F.least(F.lit(1.0), F.coalesce(F.when(F.col(atr) > 0, F.abs(f - s) / F.col(atr)), F.lit(0.0))), 4)
    confirmed = F.when((F.col("close") > f) & (F.col("close") > s), "above").when((F.col("close") < f) & (F.col("close") < s), "below").otherwise("between")
    return bars.withColumns({"trend_direction": F.when(f > s, "bullish").when(f < s, "bearish").otherwise("neutral"), "trend_strength": strength, "trend_side": confirmed})


def efficiency(period: int = 63) -> Column:
    """Kaufman's efficiency, signed: the move over ``period`` bars over the path that it took; null without so many bars or a path."""
    move = F.col("close") - F.lag("close", period).over(in_time())
    return F.try_divide(move, F.sum("_step").over(last(period)))


def with_regime(bars: DataFrame, atr: str = "atr", period: int = 63) -> DataFrame:
    """atr_pct, vol_ratio (to the mean of the 20 bars before), rng20_atr and trend_eff. Needs bar_idx and an ATR."""
    rows = bars.withColumn("_step", F.abs(F.col("close") - F.lag("close").over(in_time())))
    full = F.col("bar_idx") >= 20
    span = F.max("high").over(last(20)) - F.min("low").over(last(20))
    own = F.when(F.col(atr) > 0, F.col(atr))
    return rows.withColumns(
        {
            "atr_pct": F.try_divide(own * 100, F.col("close")),
            "vol_ratio": F.when(full, F.try_divide(F.col("volume"), F.avg("volume").over(last(20, 1)))),
            "rng20_atr": F.when(F.col("bar_idx") >= 19, F.try_divide(span, own)),
            "trend_eff": F.when(F.col("bar_idx") >= period, efficiency(period)),
        }
    ).drop("_step")


def regime_map() -> Column:
    """The regime as a map, without what is null."""
    names = ["atr_pct", "vol_ratio", "rng20_atr", "trend_eff"]
    return F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]), lambda _, v: v.isNotNull())
