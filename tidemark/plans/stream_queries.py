"""Streams over the tables' files, run to the end of what is there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import sql
from tidemark.plans.bar_queries import hourly, rounded
from tidemark.plans.registry import register
from tidemark.streaming import keyed, positions, resample


def folder(spark: SparkSession) -> str:
    """A new folder in the one that all executors share (spark.checkpoint.dir; unset in tests, where a local one serves)."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def stored(rows: DataFrame) -> DataFrame:
    """``rows`` as a table in the shared folder, for plans that read them several times."""
    at = folder(rows.sparkSession)
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def drained(df: DataFrame, mode: str, *key: str) -> DataFrame:
    """What the stream gives for all there is, through a table in the shared folder. ``key``: of an update stream, what its last row counts for."""
    at = folder(df.sparkSession)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/rows/part={number}")  # run again, a batch replaces its own

    df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = df.sparkSession.read.parquet(f"{at}/rows").drop("part")
    if not key:
        return rows.drop("_batch")
    values = [c for c in df.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*values), "_batch").alias("_v")).select(*key, "_v.*")


@register("stream_resample", sql.query("SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM b1h", "b1h"))
def stream_resample(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars of the events as a stream: in the end, the same as from the table."""
    rows = drained(resample.resampled(resample.event_stream(spark, d)), "update", "symbol", "ts")
    return rounded(rows, "symbol", "ts", "volume", open="open", high="high", low="low", close="close")


def position_stream(spark: SparkSession, d: str) -> DataFrame:
    """Entries and exits of a stream over the files of the hourly bars."""
    at, own = folder(spark), keyed.session(spark)
    hourly(spark, d).select("symbol", "ts", "high", "low", "close").write.parquet(at)
    return drained(positions.stream_events(own.readStream.schema("symbol string, ts timestamp, high double, low double, close double").parquet(at)), "append")


_STEP = "symbol, k + 1 AS k, CASE WHEN pos = 0 THEN sig WHEN why IS NULL THEN pos ELSE 0 END AS pos, CASE WHEN opens THEN close ELSE entry END AS entry, CASE WHEN opens THEN close - sig * 1.5 * atr ELSE stop END AS stop, CASE WHEN opens THEN close + sig * 3.0 * atr ELSE target END AS target"
sql.define("sig1h", "SELECT symbol, bar_idx, ts, high, low, close, atr, CASE WHEN bar_idx < 20 OR NOT coalesce(atr > 0, false) THEN 0 WHEN close > channel_high THEN 1 WHEN close < channel_low THEN -1 ELSE 0 END AS sig FROM c1h", "c1h")
sql.define(
    "held1h",
    f"""SELECT DISTINCT symbol, -1::BIGINT AS k, 0::INTEGER AS pos, 0.0::DOUBLE AS entry, 0.0::DOUBLE AS stop, 0.0::DOUBLE AS target, 0::INTEGER AS n, NULL::TIMESTAMP AS ts, ''::VARCHAR AS kind, NULL::VARCHAR AS reason, 0::INTEGER AS side, NULL::DOUBLE AS price, NULL::DOUBLE AS r FROM sig1h
    UNION ALL SELECT {_STEP}, CASE WHEN pos <> 0 THEN n + 1 ELSE 0 END, ts, CASE WHEN opens THEN 'entry' WHEN pos <> 0 AND why IS NOT NULL THEN 'exit' ELSE '' END, CASE WHEN pos <> 0 THEN why END, CASE WHEN pos <> 0 THEN pos ELSE sig END,
      CASE WHEN opens THEN close WHEN pos <> 0 THEN paid END, CASE WHEN pos <> 0 AND why IS NOT NULL THEN (paid - entry) * pos / abs(entry - stop) END
    FROM (SELECT *, pos = 0 AND sig <> 0 AS opens, CASE why WHEN 'stop' THEN stop WHEN 'target' THEN target ELSE close END AS paid FROM (
      SELECT h.symbol, h.k, h.pos, h.entry, h.stop, h.target, h.n, b.ts, b.close, b.atr, b.sig, CASE WHEN (CASE WHEN h.pos > 0 THEN b.low ELSE b.high END - h.stop) * h.pos <= 0 THEN 'stop' WHEN (CASE WHEN h.pos > 0 THEN b.high ELSE b.low END - h.target) * h.pos >= 0 THEN 'target' WHEN h.n + 1 >= 15 THEN 'timeout' END AS why
      FROM held1h h JOIN sig1h b ON b.symbol = h.symbol AND b.bar_idx = h.k + 1))""",
    "sig1h",
)
sql.define("told1h", "SELECT *, CASE side WHEN 1 THEN 'bullish' ELSE 'bearish' END AS direction FROM held1h WHERE kind <> ''", "held1h")
_PRICE = "CASE WHEN abs({x}) >= 100 THEN rtrim(rtrim(printf('%.2f', {x}), '0'), '.') WHEN abs({x}) >= 1 THEN rtrim(rtrim(printf('%.4f', {x}), '0'), '.') ELSE rtrim(rtrim(printf('%.6f', {x}), '0'), '.') END"
_LINE = f"'ENTRY ' || symbol || ' ' || direction || ' @' || {_PRICE.format(x='price')} || ' SL ' || {_PRICE.format(x='stop')} || ' TP ' || {_PRICE.format(x='target')} || printf(' R:R %.2f', abs(target - price) / abs(price - stop))"


def _recursive(text: str) -> str:
    return "WITH RECURSIVE " + text.removeprefix("WITH ")


@register("position_events", _recursive(sql.query("SELECT symbol, ts, kind, direction, reason, round(price, 6) AS price, round(r, 6) AS r FROM told1h", "told1h")))
def position_events(spark: SparkSession, d: str) -> DataFrame:
    """Entries and exits over hourly bars."""
    return rounded(position_stream(spark, d), "symbol", "ts", "kind", "direction", "reason", price="price", r="r")


@register("position_alerts", _recursive(sql.query(f"SELECT symbol, ts, CASE kind WHEN 'entry' THEN {_LINE} ELSE 'EXIT ' || symbol || ' ' || direction || printf(' %+.2fR', r) END AS line FROM told1h", "told1h")))
def position_alerts(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the stream's entries and exits."""
    return positions.alerts(position_stream(spark, d)).select("symbol", "ts", F.col("line"))
