"""A portfolio on one merged calendar: which bar of each symbol counts at each tick, and at which ticks the symbol is judged anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calendar(bars: DataFrame) -> DataFrame:
    """ts and tick: the distinct times of all symbols, numbered from 0. A day's times are numbered in a task; the days' counts, a row a day, are put before."""
    times = bars.select("ts").distinct().withColumn("_day", F.to_date("ts"))
    days = times.groupBy("_day").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_day").orderBy("ts")) - 1
    return times.join(days.select("_day", before.alias("_before")), "_day").select("ts", (F.col("_before") + inside).cast("long").alias("tick"))


def on_calendar(bars: DataFrame, window: int = 100) -> DataFrame:
    """A row for each tick from ``window`` on and each symbol that has a bar by then: tick, tick_ts, frame_ts (its latest bar), age (ticks since that bar), judged, and the bar's columns.

    A bar counts from its own tick until the symbol's next one, so each is spread over those ticks: no tick is joined to a symbol. It is judged at the
    first of them past the warm-up alone: a symbol whose bar has not advanced is not judged again.
    """
    ticks = calendar(bars)
    end = ticks.agg((F.max("tick") + 1).alias("_end"))  # one row
    rows = bars.join(ticks, "ts").withColumn("_next", F.lead("tick").over(Window.partitionBy("symbol").orderBy("tick"))).join(F.broadcast(end))
    first, last = F.greatest("tick", F.lit(window).cast("long")), F.coalesce("_next", "_end") - 1
    held = [c for c in bars.columns if c not in ("symbol", "ts")]
    spread = rows.withColumn("_from", first).where(F.col("_from") <= last).withColumn("_tick", F.explode(F.sequence("_from", last)))
    out = spread.select("symbol", F.col("_tick"), F.col("ts").alias("frame_ts"), (F.col("_tick") - F.col("tick")).alias("age"), (F.col("_tick") == F.col("_from")).alias("judged"), *held)
    return out.join(ticks.select(F.col("tick").alias("_tick"), F.col("ts").alias("tick_ts")), "_tick").withColumnRenamed("_tick", "tick")


def submissions(replayed: DataFrame, signals: DataFrame) -> DataFrame:
    """Signals (symbol, ts, ...) at the ticks where their symbol is judged: each once, at the first tick that sees its bar; those before the warm-up not at all."""
    judged = replayed.where("judged").select("symbol", "tick", "tick_ts", F.col("frame_ts").alias("ts"))
    return signals.join(judged, ["symbol", "ts"])


def fills(submitted: DataFrame, bars: DataFrame) -> DataFrame:
    """Submissions (symbol, ts, ...) with fill_ts and fill_tick: the symbol's first bar that is newer than the signal's; null where none came."""
    following = bars.select("symbol", "ts", F.lead("ts").over(Window.partitionBy("symbol").orderBy("ts")).alias("fill_ts"))
    ticks = calendar(bars).select(F.col("ts").alias("fill_ts"), F.col("tick").alias("fill_tick"))
    return submitted.join(following, ["symbol", "ts"], "left").join(ticks, "fill_ts", "left")
