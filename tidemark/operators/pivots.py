"""Pivots, swings and price levels. A pivot is known only at its confirmation bar, ``right`` bars later."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.indicators import in_time

PIVOT = "struct<bar_idx: long, ts: timestamp, type: string, price: double>"


def with_pivots(bars: DataFrame, left: int = 2, right: int = 1) -> DataFrame:
    """``pivots_here``: the bar's strict fractal pivots, the high before the low; needs ``left`` bars before and ``right`` after."""
    before, after = in_time().rowsBetween(-left, -1), in_time().rowsBetween(1, right)
    whole = (F.col("bar_idx") >= left) & F.lead("bar_idx", right).over(in_time()).isNotNull()
    top = whole & (F.col("high") > F.max("high").over(before)) & (F.col("high") > F.max("high").over(after))
    bottom = whole & (F.col("low") < F.min("low").over(before)) & (F.col("low") < F.min("low").over(after))
    one = lambda ok, kind, price: F.when(ok, F.struct("bar_idx", "ts", F.lit(kind).alias("type"), F.col(price).alias("price")))
    return bars.withColumn("pivots_here", F.filter(F.array(one(top, "H", "high"), one(bottom, "L", "low")), lambda p: p.isNotNull()))


def pivots(bars: DataFrame, left: int = 2, right: int = 1) -> DataFrame:
    """A row for each pivot, with seq (its order in the symbol) and confirm_idx."""
    rows = with_pivots(bars, left, right).select("symbol", F.explode("pivots_here").alias("p")).select("symbol", "p.*")
    seq = F.row_number().over(Window.partitionBy("symbol").orderBy("bar_idx", "type")).cast("long")
    return rows.withColumns({"seq": seq, "confirm_idx": F.col("bar_idx") + right})


def visible_swings(bars: DataFrame, lookback: int, right: int = 1) -> DataFrame:
    """``swings``: the pivots confirmed by the bar whose bars lie in its last ``lookback``, oldest first. Needs pivots_here."""
    return bars.withColumn("swings", F.flatten(F.collect_list("pivots_here").over(in_time().rowsBetween(-(lookback - 1), -right))))


def alternating(rows: DataFrame) -> DataFrame:
    """Of each run of pivots of one type, the most extreme, the earliest of equals."""
    order = Window.partitionBy("symbol").orderBy("seq")
    new = F.coalesce(F.lag("type").over(order) != F.col("type"), F.lit(True))
    runs = rows.withColumn("_run", F.sum(new.cast("int")).over(order))
    extreme = F.when(F.col("type") == "H", F.col("price")).otherwise(-F.col("price"))
    best = runs.groupBy("symbol", "_run").agg(F.max_by(F.struct("seq", "bar_idx", "ts", "type", "price", "confirm_idx"), F.struct(extreme, -F.col("seq"))).alias("p"), F.count(F.lit(1)).alias("run_length"))
    return best.select("symbol", "p.*", "run_length")


def swing_structure(rows: DataFrame) -> DataFrame:
    """At each pivot, the last five types, if they alternate through all five; else null."""
    five = F.collect_list("type").over(Window.partitionBy("symbol").orderBy("seq").rowsBetween(-4, 0))
    tags = F.array_join(five, "")
    return rows.withColumn("structure", F.when(tags.isin("LHLHL", "HLHLH"), tags))


def _fold(min_travel: float, fold_rejected: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", ignore_index=True)
        kept: list[int] = []  # a stack: only its two last can change
        accepted = [False] * len(pdf)
        kinds, prices, atrs = pdf["type"].tolist(), pdf["price"].tolist(), pdf["atr"].tolist()
        beyond = lambda i, j: prices[i] > prices[j] if kinds[i] == "H" else prices[i] < prices[j]
        for i in range(len(pdf)):
            if kept and kinds[i] == kinds[kept[-1]]:
                if not beyond(i, kept[-1]):
                    continue
                kept[-1] = i
            elif not kept or not atrs[i] > 0 or abs(prices[i] - prices[kept[-1]]) >= min_travel * atrs[i]:
                kept.append(i)
            else:
                if fold_rejected and len(kept) > 1:
                    if beyond(i, kept[-2]):
                        kept[-2] = i
                        accepted[i] = True
                    kept.pop()
                continue
            accepted[i] = True
        last = {*kept}
        return pdf.assign(accepted=accepted, kept=[i in last for i in range(len(pdf))])

    return run


def magnitude_swings(rows: DataFrame, min_travel: float = 3.0, fold_rejected: bool = True) -> DataFrame:
    """Pivots with ``accepted`` (it became a swing when it was confirmed) and ``kept`` (it still is one at the end).

    ``rows``: pivots with ``atr``, the ATR that a move from the last swing is measured by (null or 0: any move will do). An
    ordered fold for each symbol: a pivot's fate depends on all before it, so a symbol's pivots are read in one go; a small part of its bars.
    """
    schema = rows.select("symbol", "seq", "bar_idx", "ts", "type", "price", "confirm_idx", "atr")
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.schema) + ", accepted boolean, kept boolean"
    return schema.groupBy("symbol").applyInPandas(_fold(min_travel, fold_rejected), out)


def spacing(rows: DataFrame) -> DataFrame:
    """Of each symbol's kept swings: how many, how many pivots were rejected, and the upper median of their distances in ATRs."""
    order = Window.partitionBy("symbol").orderBy("seq")
    kept = rows.where("kept").withColumn("_d", F.try_divide(F.abs(F.col("price") - F.lag("price").over(order)), F.col("atr")))
    found = kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_kept"), F.array_sort(F.collect_list("_d")).alias("_all"))
    median = F.try_element_at("_all", (F.floor(F.size("_all") / 2) + 1).cast("int"))
    lost = rows.groupBy("symbol").agg(F.count_if(~F.col("accepted")).alias("n_rejected"))
    return lost.join(found.select("symbol", "n_kept", median.alias("median_spacing")), "symbol", "left").fillna({"n_kept": 0})


def levels(swings: DataFrame, tolerance: float = 0.5, min_touches: int = 2, within: list[str] | None = None) -> DataFrame:
    """Support (of lows) and resistance (of highs): swings whose bands, price +- tolerance * atr, overlap in turn; mean price and touches."""
    by = [*(within or ["symbol"]), "type"]
    order = Window.partitionBy(*by).orderBy("price", "bar_idx")
    band = F.coalesce(F.col("atr"), F.lit(0.0)) * tolerance
    reach = F.max(F.col("price") + band).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = swings.withColumn("_new", F.coalesce(F.col("price") - band > reach, F.lit(True)).cast("int"))
    rows = rows.withColumn("_island", F.sum("_new").over(order))
    found = rows.groupBy(*by, "_island").agg(F.avg("price").alias("level"), F.count(F.lit(1)).alias("touches")).where(F.col("touches") >= min_touches)
    kind = F.when(F.col("type") == "L", "support").otherwise("resistance")
    return found.select(*by[:-1], kind.alias("kind"), "level", "touches")


def levels_in_view(frames: DataFrame, at: DataFrame, tolerance: float = 0.5, min_touches: int = 2) -> DataFrame:
    """The levels of each frame (symbol, frame_idx and its visible ``swings``), from what is confirmed by then alone; ``at``: symbol, bar_idx, atr."""
    rows = frames.select("symbol", "frame_idx", F.explode("swings").alias("s")).select("symbol", "frame_idx", F.col("s.bar_idx").alias("bar_idx"), F.col("s.type").alias("type"), F.col("s.price").alias("price"))
    return levels(rows.join(at.select("symbol", "bar_idx", "atr"), ["symbol", "bar_idx"]), tolerance, min_touches, ["symbol", "frame_idx"])


def nearest_levels(found: DataFrame, *by: str) -> DataFrame:
    """The highest support and the lowest resistance, whatever the price."""
    of = lambda kind: F.when(F.col("kind") == kind, F.col("level"))
    return found.groupBy(*(by or ("symbol",))).agg(F.max(of("support")).alias("highest_support"), F.min(of("resistance")).alias("lowest_resistance"))


def _last_two(swings: Column, kind: str) -> tuple[Column, Column]:
    own = F.filter(swings, lambda p: p["type"] == kind)
    return F.try_element_at(own, F.lit(-2)), F.try_element_at(own, F.lit(-1))


def with_pullback(bars: DataFrame, retest: bool = False) -> DataFrame:
    """pullback_direction (both highs and lows rise, or both fall), the four prices in time order, and how deep the last leg went back.

    ``retest`` also takes a second dip: the last low under the one before, over the one before that. Needs swings.
    """
    (h1, h2), (l1, l2) = _last_two(F.col("swings"), "H"), _last_two(F.col("swings"), "L")
    lows = F.filter("swings", lambda p: p["type"] == "L")
    higher_low = l2["price"] > l1["price"]
    if retest:
        higher_low |= l2["price"] > F.try_element_at(lows, F.lit(-3))["price"]
    up = (h2["price"] > h1["price"]) & higher_low
    down = (h2["price"] < h1["price"]) & (l2["price"] < l1["price"])
    four = F.transform(F.array_sort(F.array(h1, h2, l1, l2)), lambda p: p["price"])
    whole = h1.isNotNull() & l1.isNotNull()
    a, b, c = (F.try_element_at(four, F.lit(i)) for i in (-3, -2, -1))
    rows = bars.withColumn("pullback_direction", F.when(whole & up, "bullish").when(whole & down, "bearish"))
    shown = F.col("pullback_direction").isNotNull()
    return rows.withColumns({"swing_pattern": F.when(shown, four), "pullback_depth": F.when(shown, F.try_divide(F.abs(c - b), F.abs(b - a)))})


def with_pattern_strength(bars: DataFrame, compact: int = 40) -> DataFrame:
    """The geometric mean of a pullback's compactness, evenness of legs, depth of the pivots and inclination, each 0 to 1. Needs swing_pattern, swings, atr."""
    p = F.col("swing_pattern")
    legs = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.abs(F.element_at(p, (i + 1).cast("int")) - F.element_at(p, i.cast("int"))))
    four = F.slice(F.array_sort(F.filter("swings", lambda s: s["price"].isNotNull())), -4, 4)
    span = F.when(F.size("swings") >= 4, F.element_at(four, 4)["bar_idx"] - F.element_at(four, 1)["bar_idx"])
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    compactness = unit(1 - span / compact)
    evenness = F.try_divide(F.array_min(legs), F.array_max(legs))
    quality = unit(F.try_divide(F.array_min(legs), F.col("atr")))
    rise = unit(F.try_divide(F.abs(F.element_at(p, 4) - F.element_at(p, 1)), F.array_max(legs)))
    return bars.withColumn("pullback_strength", F.when(p.isNotNull() & span.isNotNull(), F.pow(compactness * evenness * quality * rise, 0.25)))


def confirmation_failures(direction: Column, min_body: float = 0.6) -> Column:
    """Why the bar doesn't confirm a pullback: a list of reasons."""
    body = F.try_divide(F.abs(F.col("close") - F.col("open")), F.col("high") - F.col("low"))
    with_it = F.when(direction == "bullish", F.col("close") > F.col("open")).otherwise(F.col("close") < F.col("open"))
    return F.filter(F.array(F.when(~with_it, "against"), F.when(F.coalesce(body, F.lit(0.0)) < min_body, "small_body")), lambda r: r.isNotNull())


def first_bar_after(points: DataFrame, bars: DataFrame) -> DataFrame:
    """Points (symbol, point_ts) with entry_idx, the first bar after them in the bars' timeframe; null past the end."""
    from tidemark.operators.joins import asof_backward

    numbered = bars.select("symbol", "ts", "bar_idx")
    rows = asof_backward(points, numbered.withColumnRenamed("ts", "_bts"), ["symbol"], "point_ts", "_bts", ["bar_idx"]).drop("_bts_asof")
    ends = numbered.groupBy("symbol").agg(F.max("bar_idx").alias("_end"))
    after = F.coalesce(F.col("bar_idx") + 1, F.lit(0))
    return rows.join(ends, "symbol").withColumn("entry_idx", F.when(after <= F.col("_end"), after)).drop("bar_idx", "_end")
