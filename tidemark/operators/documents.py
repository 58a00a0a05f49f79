"""Run documents in JSON, event logs, and lookups of frames and facts.

A document holds one instrument's part of a run (a week, say), so that no row grows with the length of a history; a portfolio document
maps instruments to theirs. Reading is tolerant: what isn't a document gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRADE = "struct<submit_ts: timestamp, candidate_id: string, direction: string, entry: double, stop: double, target: double, exit_ts: timestamp, exit_reason: string, r: double, result: string>"
CANDLE = "struct<t: string, o: double, h: double, l: double, c: double, v: double>"
DOCUMENT = f"struct<symbol: string, candles: array<{CANDLE}>, facts_by_ts: map<string, map<string, double>>, patterns_by_ts: map<string, array<string>>, rejections_by_ts: map<string, array<string>>, trades: array<{TRADE}>, equity: array<struct<t: string, seq: long, balance: double>>>"
_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _key(ts: str = "ts") -> Column:
    return F.date_format(ts, _TIME)


def _section(rows: DataFrame, unit: str, value: Column, name: str, ts: str = "ts") -> DataFrame:
    """symbol, part and the sorted values of each part."""
    return rows.withColumn("part", F.date_trunc(unit, ts)).groupBy("symbol", "part").agg(F.array_sort(F.collect_list(value)).alias(name))


def _by_time(rows: DataFrame, unit: str, value: Column, name: str) -> DataFrame:
    """A map from times to lists of values, for each part."""
    each = rows.groupBy("symbol", "ts").agg(F.array_sort(F.collect_list(value)).alias("_v"))
    found = _section(each, unit, F.struct(_key().alias("k"), F.col("_v").alias("v")), name)
    return found.withColumn(name, F.map_from_entries(name))


def run_documents(candles: DataFrame, facts: DataFrame, patterns: DataFrame, rejections: DataFrame, trades: DataFrame, balances: DataFrame, unit: str = "week") -> DataFrame:
    """symbol, part, document. facts: symbol, ts, name, value; patterns and rejections: symbol, ts, what; balances: symbol, ts, seq, balance."""
    sections = [
        _section(candles, unit, F.struct(_key().alias("t"), *[F.col(c).alias(c[0]) for c in ("open", "high", "low", "close", "volume")]), "candles"),
        _by_time(facts, unit, F.struct("name", "value"), "facts_by_ts").withColumn("facts_by_ts", F.transform_values("facts_by_ts", lambda _, v: F.map_from_entries(v))),
        _by_time(patterns, unit, F.col("what"), "patterns_by_ts"),
        _by_time(rejections, unit, F.col("what"), "rejections_by_ts"),
        _section(trades, unit, F.struct("submit_ts", "candidate_id", "direction", "entry", "stop", "target", "exit_ts", "exit_reason", "r", "result"), "trades", "submit_ts"),
        _section(balances, unit, F.struct(_key().alias("t"), "seq", "balance"), "equity"),
    ]
    out = sections[0]
    for s in sections[1:]:
        out = out.join(s, ["symbol", "part"], "full")
    return out.select("symbol", "part", F.to_json(F.struct("symbol", "candles", "facts_by_ts", "patterns_by_ts", "rejections_by_ts", "trades", "equity")).alias("document"))


def portfolio_documents(documents: DataFrame) -> DataFrame:
    """part, document: {"per_instrument": {symbol: its document}} of all instruments of a part."""
    held = F.map_from_entries(F.array_sort(F.collect_list(F.struct("symbol", "document"))))
    parts = documents.groupBy("part").agg(F.transform_values(held, lambda _, v: F.from_json(v, DOCUMENT)).alias("per_instrument"))
    return parts.select("part", F.to_json(F.struct("per_instrument")).alias("document"))


def opened(documents: DataFrame) -> DataFrame:
    """symbol, part and the sections of documents of either form; what is neither gives no row. Instruments come in the document's order (position)."""
    rows = documents.select("part", F.from_json("document", f"struct<per_instrument: map<string, {DOCUMENT}>>").alias("p"), F.from_json("document", DOCUMENT).alias("d"))
    many = rows.where("p.per_instrument is not null").select("part", F.posexplode("p.per_instrument").alias("position", "_name", "d"))
    one = rows.where("p.per_instrument is null and d.symbol is not null").select("part", F.lit(0).alias("position"), F.col("d.symbol").alias("_name"), "d")
    names = ["candles", "facts_by_ts", "patterns_by_ts", "rejections_by_ts", "trades", "equity"]
    return many.unionByName(one).where("d is not null").select("part", "position", F.col("_name").alias("symbol"), *[F.col(f"d.{n}").alias(n) for n in names])


def _time(c: str | Column) -> Column:
    return F.try_to_timestamp(F.col(c) if isinstance(c, str) else c, F.lit(_TIME))


def facts_of(sections: DataFrame) -> DataFrame:
    rows = sections.select("symbol", F.explode("facts_by_ts").alias("k", "m")).select("symbol", _time("k").alias("ts"), F.explode("m").alias("name", "value"))
    return rows.where("ts is not null")


def texts_of(sections: DataFrame, name: str) -> DataFrame:
    """symbol, ts, what of patterns_by_ts or rejections_by_ts."""
    return sections.select("symbol", F.explode(name).alias("k", "v")).select("symbol", _time("k").alias("ts"), F.explode("v").alias("what")).where("ts is not null")


def candles_of(sections: DataFrame) -> DataFrame:
    return sections.select("symbol", F.explode("candles").alias("c")).select("symbol", _time(F.col("c.t")).alias("ts"), *[F.col(f"c.{n[0]}").alias(n) for n in ("open", "high", "low", "close", "volume")])


def trades_of(sections: DataFrame) -> DataFrame:
    """The trades with their instrument's position and their place in its list."""
    return sections.select("symbol", "part", "position", F.posexplode("trades").alias("place", "t")).select("symbol", "part", "position", "place", "t.*")


def by_time(patterns: DataFrame, rejections: DataFrame) -> DataFrame:
    """symbol, ts and the sorted texts of patterns and of rejections (symbol, ts, what) at that time."""
    both = patterns.withColumn("_kind", F.lit("p")).unionByName(rejections.withColumn("_kind", F.lit("r")))
    of = lambda k: F.array_sort(F.collect_list(F.when(F.col("_kind") == k, F.col("what"))))
    return both.groupBy("symbol", "ts").agg(of("p").alias("patterns"), of("r").alias("rejections"))


def fact_context(points: DataFrame, facts: DataFrame, limit: int = 12) -> DataFrame:
    """Points (symbol, ts, ...) with ``context``: the first ``limit`` facts by name of exactly their time, empty where there are none."""
    held = facts.groupBy("symbol", "ts").agg(F.slice(F.array_sort(F.collect_list(F.struct("name", "value"))), 1, limit).alias("context"))
    return points.join(held, ["symbol", "ts"], "left").withColumn("context", F.coalesce("context", F.array().cast("array<struct<name: string, value: double>>")))


def frame_at(frames: DataFrame, ts: Iterable[str]) -> DataFrame:
    """The frames of exactly these times."""
    return frames.where(F.col("ts").isin(*[F.lit(t).cast("timestamp") for t in ts]))


def frame_slice(frames: DataFrame, start: int, end: int) -> DataFrame:
    """Each symbol's frames from position ``start`` up to, not including, ``end``."""
    return frames.where((F.col("bar_idx") >= start) & (F.col("bar_idx") < end))


def append_events(events: DataFrame, path: str) -> None:
    """Adds a JSON line for each event."""
    events.select(F.to_json(F.struct(*events.columns))).write.mode("append").text(path)


def tail_events(spark: SparkSession, path: str, schema: str, after: Column | None = None) -> DataFrame:
    """A log's events with ts past ``after``; lines that aren't events are skipped."""
    rows = spark.read.text(path).select(F.from_json("value", schema).alias("e")).where("e is not null and e.ts is not null").select("e.*")
    return rows if after is None else rows.where(F.col("ts") > after)


def live_compare(logged: DataFrame, expected: DataFrame) -> DataFrame:
    """Each symbol's latest logged result (symbol, ts, r) beside the backtest's mean (symbol, expectancy), and their difference."""
    last = logged.groupBy("symbol").agg(F.max_by("r", "ts").alias("last_r"), F.max("ts").alias("last_ts"))
    return expected.join(last, "symbol", "left").withColumn("difference", F.col("last_r") - F.col("expectancy"))
