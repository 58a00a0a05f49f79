"""As-of, completed-bar, range and pairing joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, columns: list[str]) -> DataFrame:
    """``left`` with the ``columns`` of the latest row of ``right`` at or before its time; null where none is.

    Both sides are one sorted stream for each key, in which the last seen right row is carried on: no range join, no
    pairs. Of right rows of one time, the greatest by the columns' values counts.
    """
    value = F.struct(F.col(right_ts).alias("_rts"), *columns)
    l_ = left.select(*by, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).alias("_r"))
    r_ = right.select(*by, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.lit(None).alias("_l"), value.alias("_r"))
    order = Window.partitionBy(*by).orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    both = l_.unionByName(r_).withColumn("_seen", F.last("_r", ignorenulls=True).over(order))
    return both.where("_side = 1").select("_l.*", *[F.col(f"_seen.{c}").alias(c) for c in columns], F.col("_seen._rts").alias(f"{right_ts}_asof"))


def completed(left: DataFrame, right: DataFrame, by: list[str], minutes: int, lag: int, columns: list[str]) -> DataFrame:
    """As of, but a right bar can be used only once it and ``lag`` more of its length have passed."""
    usable = right.withColumn("usable_at", F.timestamp_seconds(F.unix_timestamp("ts") + 60 * minutes * (1 + lag)))
    return asof_backward(left, usable, by, "ts", "usable_at", columns)


def within_bars(points: DataFrame, bars: DataFrame, before: int, after: int) -> DataFrame:
    """Each point (symbol, point_idx, ...) with the bars from ``before`` bars before it to ``after`` after: offset and the bar.

    Both sides are dealt by (symbol, block of bars), each point to the few blocks it reaches: an equality join.
    """
    size = before + after + 1
    reach = F.sequence(F.floor((F.col("point_idx") - before) / size), F.floor((F.col("point_idx") + after) / size))
    p = points.withColumn("_block", F.explode(reach))
    b = bars.withColumn("_block", F.floor(F.col("bar_idx") / size))
    near = F.col("bar_idx").between(F.col("point_idx") - before, F.col("point_idx") + after)
    return p.join(b, ["symbol", "_block"]).where(near).withColumn("offset", F.col("bar_idx") - F.col("point_idx")).drop("_block")


def pair_events(events: DataFrame) -> DataFrame:
    """Entries with their exits (symbol, kind, ts, ...): the k-th with the k-th, which is the earliest unused while one is open at a time."""
    k = F.row_number().over(Window.partitionBy("symbol", "kind").orderBy("ts", "event_id"))
    rows = events.withColumn("_k", k)
    a = rows.where("kind = 'entry'").select("symbol", "_k", F.col("ts").alias("entry_ts"), F.col("price").alias("entry_price"))
    b = rows.where("kind = 'exit'").select("symbol", "_k", F.col("ts").alias("exit_ts"), F.col("price").alias("exit_price"))
    return a.join(b, ["symbol", "_k"], "left").drop("_k")


def review(points: DataFrame, notes: DataFrame, overrides: DataFrame) -> DataFrame:
    """Points (key) and notes (key, note): matched, orphan notes and unreviewed points; an override's text wins; an empty note is a review."""
    said = notes.join(overrides.select("key", F.col("note").alias("_extra")), "key", "full").select("key", F.coalesce("_extra", "note").alias("note"))
    rows = points.select("key", F.lit(True).alias("_p")).join(said.withColumn("_n", F.col("note").isNotNull()), "key", "full")
    state = F.when(F.col("_p").isNull(), "orphan").when(F.coalesce(F.col("_n"), F.lit(False)), "matched").otherwise("unreviewed")
    return rows.select("key", "note", state.alias("state"))
