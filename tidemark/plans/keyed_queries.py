"""Streams that stop and go on: heartbeats, warm starts, state read back, alerts past a cursor, late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import sql
from tidemark.plans.bar_queries import hourly, rounded
from tidemark.plans.registry import register
from tidemark.plans.stream_queries import folder
from tidemark.sources import bars as src
from tidemark.streaming import keyed, ledger
from tidemark.streaming.keyed import played

_CUT = "2024-01-15 00:00:00"
_STOP, _TARGET = 1.5, 3.0


def _at(t: str) -> Column:
    return F.lit(t).cast("timestamp")


def _bars(spark: SparkSession, d: str) -> DataFrame:
    return hourly(spark, d).select("symbol", "ts", "high", "low", "close")


@register(
    "stream_heartbeats",
    sql.query(
        """SELECT symbol, b.ts + INTERVAL 90 MINUTES * k AS ts, b.ts AS last_ts, k::INTEGER AS missed FROM (SELECT symbol, ts, coalesce(lead(ts) OVER (PARTITION BY symbol ORDER BY ts), (SELECT max(ts) FROM b1h) - INTERVAL 1 HOUR + INTERVAL 1 SECOND) AS until FROM b1h) b, range(1, 600) r(k)
        WHERE b.ts + INTERVAL 90 MINUTES * k < until""",
        "b1h",
    ),
)
def stream_heartbeats(spark: SparkSession, d: str) -> DataFrame:
    """A row for each hour and a half that a symbol is without a bar: from timers, and from the bars that end a silence. The bars land in three parts."""
    at, ts = folder(spark), F.col("ts")
    cuts = [ts < _at("2024-01-10 05:00:00"), (ts >= _at("2024-01-10 05:00:00")) & (ts < _at("2024-01-20 17:00:00")), ts >= _at("2024-01-20 17:00:00")]
    played(_bars(spark, d), cuts, lambda stream: keyed.heartbeats(stream, "90 minutes"), ledger.sink(f"{at}/table", "beats"), at)
    return ledger.taken(spark, f"{at}/table", "beats", keyed.BEATS)[0].select("symbol", "ts", "last_ts", "missed")


_WARM = f"SELECT symbol, ts, {', '.join(f'round({c}, 6) AS {c}' for c in ('channel_high', 'channel_low', 'atr'))}, CASE WHEN close > channel_high THEN 1 WHEN close < channel_low THEN -1 ELSE 0 END::INTEGER AS breakout FROM c1h"


@register("stream_warm_start", sql.query(f"{_WARM} WHERE ts >= TIMESTAMP '{_CUT}'", "c1h"))
def stream_warm_start(spark: SparkSession, d: str) -> DataFrame:
    """Indicators of a stream that begins at a day with a state from the ten days before: the same as of one that has seen all bars."""
    at, bars = folder(spark), _bars(spark, d)
    first = folder(spark)
    keyed.warm(bars.where(F.col("ts") < _at(_CUT)), 10).write.parquet(first)
    make = lambda stream: keyed.indicators(stream, stream.sparkSession.read.parquet(first))
    played(bars, [F.col("ts") >= _at(_CUT)], make, ledger.sink(f"{at}/table", "indicators"), at)
    rows = ledger.taken(spark, f"{at}/table", "indicators", keyed.INDICATORS)[0]
    return rounded(rows, "symbol", "ts", "breakout", channel_high="channel_high", channel_low="channel_low", atr="atr")


@register("stream_state", sql.query("SELECT symbol, ts, round(close, 6) AS close, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - greatest(count(*) OVER (PARTITION BY symbol) - 21, 0) - 1 AS place FROM b1h) WHERE place >= 0", "b1h"))
def stream_state(spark: SparkSession, d: str) -> DataFrame:
    """What the stream of indicators holds for each symbol after it has stopped twice, by the state reader."""
    at, ts = folder(spark), F.col("ts")
    played(_bars(spark, d), [ts < _at(_CUT), ts >= _at(_CUT)], keyed.indicators, ledger.sink(f"{at}/table", "indicators"), at)
    held = keyed.tails(keyed.session(spark), f"{at}/checkpoint").select("symbol", F.posexplode(F.arrays_zip("ts", "close")).alias("place", "b"))
    held.select("symbol", "b.ts", F.round("b.close", 6).alias("close"), "place").write.parquet(f"{at}/state")
    return spark.read.parquet(f"{at}/state")


@register(
    "alert_feed",
    sql.query(
        f"""SELECT symbol, ts, CASE WHEN s > 0 THEN 'bullish' ELSE 'bearish' END AS direction, round(close, 6) AS entry, round(close - s * {_STOP} * atr, 6) AS stop, round(close + s * {_TARGET} * atr, 6) AS target, CASE WHEN ts < TIMESTAMP '{_CUT}' THEN 0 ELSE 1 END::INTEGER AS taken
        FROM (SELECT *, CASE WHEN close > channel_high THEN 1 WHEN close < channel_low THEN -1 END AS s FROM c1h WHERE bar_idx >= 20) WHERE s IS NOT NULL""",
        "c1h",
    ),
)
def alert_feed(spark: SparkSession, d: str) -> DataFrame:
    """Breakouts of the stream of indicators, as a reader takes them past its cursor: after the first stop, and after the second; a third look finds nothing."""
    at, ts, looks = folder(spark), F.col("ts"), []

    def look() -> None:
        rows, cursor = ledger.taken(spark, f"{at}/table", "indicators", keyed.INDICATORS, looks[-1][1] if looks else -1)
        looks.append((rows, cursor))

    played(_bars(spark, d), [ts < _at(_CUT), ts >= _at(_CUT)], keyed.indicators, ledger.sink(f"{at}/table", "indicators"), at, look)
    look()
    rows = None
    for i, (taken, _) in enumerate(looks):
        part = taken.where("breakout <> 0").withColumn("taken", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    s = F.col("breakout")
    rows = rows.withColumns({"direction": F.when(s > 0, "bullish").otherwise("bearish"), "stop": F.col("close") - s * _STOP * F.col("atr"), "target": F.col("close") + s * _TARGET * F.col("atr")})
    return rounded(rows, "symbol", "ts", "direction", "taken", entry="close", stop="stop", target="target")


@register(
    "late_ticks",
    f"""WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM events WHERE event_id % 5 <> 0 AND ts < TIMESTAMP '{_CUT}')
    SELECT event_id, event_type AS symbol, ts, (event_id % 5 = 0 OR ts >= TIMESTAMP '{_CUT}')::BIGINT AS batch, event_id % 5 = 0 AND ts < w AS late FROM events, m""",
)
def late_ticks(spark: SparkSession, d: str) -> DataFrame:
    """Ticks of two landings, the second with a fifth of the first's time: those behind the watermark by then go to the side table, and are known."""
    at, ts = folder(spark), F.col("ts")
    ticks = src.event_ticks(spark.read.parquet(f"{d}/events.parquet")).withColumnRenamed("tie", "event_id")
    soon = (F.col("event_id") % 5 != 0) & (ts < _at(_CUT))
    played(ticks, [soon, ~soon], lambda stream: stream, ledger.sink(f"{at}/table", "ticks", delay="1 HOUR"), at)
    schema = "symbol string, ts timestamp, price double, event_id long"
    kept, late = (ledger.taken(spark, f"{at}/table", "ticks", schema, side=side)[0].withColumn("late", F.lit(side == "late")) for side in ("rows", "late"))
    return kept.unionByName(late).select("event_id", "symbol", "ts", "batch", "late")
