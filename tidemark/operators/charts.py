"""Series for charts: zigzags between swings, levels as spans of time, markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zigzag(swings: DataFrame, bars: DataFrame) -> DataFrame:
    """symbol, ts, bar_idx, segment, value: the line from each swing to the next one of its symbol, at every bar between, both ends included (a swing begins its own segment;
    the last one ends the last).

    ``swings``: symbol, seq, bar_idx, price, in order of seq; ``bars``: symbol, bar_idx, ts. A segment is spread over its own bars, so nothing is joined by range.
    """
    order = Window.partitionBy("symbol").orderBy("seq")
    ends = swings.select("symbol", "seq", F.col("bar_idx").alias("_a"), F.col("price").alias("_p"), F.lead("bar_idx").over(order).alias("_b"), F.lead("price").over(order).alias("_q"), (F.row_number().over(order) - 1).alias("segment"))
    until = F.when(F.col("_b") > F.col("_a"), F.col("_b") - 1).otherwise(F.col("_a"))  # two swings of one bar: a step
    spread = ends.withColumn("bar_idx", F.explode(F.sequence("_a", until)))
    value = F.coalesce(F.col("_p") + (F.col("_q") - F.col("_p")) * F.try_divide(F.col("bar_idx") - F.col("_a"), F.col("_b") - F.col("_a")), F.col("_p"))
    return spread.select("symbol", "bar_idx", "segment", value.alias("value")).join(bars.select("symbol", "bar_idx", "ts"), ["symbol", "bar_idx"])


def spans(levels: DataFrame, digits: int = 6) -> DataFrame:
    """symbol, kind, level, start_idx, end_idx, touches (the most): for how long a level (symbol, frame_idx, kind, level, touches) is in view without a break."""
    rows = levels.withColumn("level", F.round("level", digits))
    order = Window.partitionBy("symbol", "kind", "level").orderBy("frame_idx")
    new = F.coalesce(F.lag("frame_idx").over(order) < F.col("frame_idx") - 1, F.lit(True)).cast("int")
    runs = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order))
    return runs.groupBy("symbol", "kind", "level", "_run").agg(F.min("frame_idx").alias("start_idx"), F.max("frame_idx").alias("end_idx"), F.max("touches").alias("touches")).drop("_run")


def changes(frames: DataFrame, what: Column, marker: str) -> DataFrame:
    """symbol, ts, marker, text: the bars at which ``what`` (a text) is another one than at the symbol's last bar that had one."""
    order = Window.partitionBy("symbol").orderBy("ts")
    rows = frames.withColumn("_what", what).where("_what is not null").withColumn("_before", F.lag("_what").over(order))
    return rows.where(F.coalesce(F.col("_before") != F.col("_what"), F.lit(True))).select("symbol", "ts", F.lit(marker).alias("marker"), F.col("_what").alias("text"))
