"""Points of interest, chart series, evidence, run documents and the causality check."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def points(kinds: dict[str, DataFrame], include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """symbol, ts, kind, what of the kinds that are wanted."""
    chosen = {k: v for k, v in kinds.items() if (include is None or k in include) and k not in (exclude or [])}
    return reduce(DataFrame.unionByName, [v.select("symbol", "ts", F.lit(k).alias("kind"), "what") for k, v in chosen.items()])


def long_series(df: DataFrame, columns: list[str]) -> DataFrame:
    """symbol, ts, series, value."""
    return df.unpivot(["symbol", "ts"], [F.col(c) for c in columns], "series", "value")


def evidence_summary(df: DataFrame, level: str) -> DataFrame:
    """Of each symbol, how many entries of a level and their texts in time. ``evidence``: a list of (text, level, source)."""
    rows = df.select("symbol", "ts", F.explode("evidence").alias("e")).where(F.col("e.level") == level)
    found = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("ts", "e.text"))).alias("_all"))
    return found.select("symbol", "n", F.array_join(F.transform("_all", lambda x: x["text"]), "; ").alias("summary"))


def run_document(trades: DataFrame, balances: DataFrame) -> DataFrame:
    """A JSON document for each symbol: its trades and its balances, in order."""
    t = trades.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("submit_ts", "candidate_id", "direction", "entry", "stop", "target", "exit_ts", "exit_reason", "r", "result"))).alias("trades"))
    b = balances.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "balance"))).alias("equity"))
    return t.join(b, "symbol", "full").select("symbol", F.to_json(F.struct("trades", "equity")).alias("document"))


TRADE = "struct<submit_ts: timestamp, candidate_id: string, direction: string, entry: double, stop: double, target: double, exit_ts: timestamp, exit_reason: string, r: double, result: string>"


def read_document(documents: DataFrame) -> DataFrame:
    """The trades of run documents (symbol, document); malformed documents give none."""
    rows = documents.select("symbol", F.from_json("document", f"struct<trades: array<{TRADE}>>").alias("d"))
    return rows.select("symbol", F.explode("d.trades").alias("t")).select("symbol", "t.*")


def causality(bars: DataFrame, facts: dict[str, Callable[[DataFrame], DataFrame]], until: list[str]) -> DataFrame:
    """For each kind of facts, how many of those before each of the times ``until`` differ when the bars from then on are left out.

    facts: functions from bars to symbol, ts and any columns of values, which are compared as JSON.
    """
    def told(b: DataFrame) -> DataFrame:
        rows = [f(b) for f in facts.values()]
        return reduce(DataFrame.unionByName, [r.select(F.lit(k).alias("fact"), "symbol", "ts", F.to_json(F.struct(*[c for c in r.columns if c not in ("symbol", "ts")])).alias("value")) for k, r in zip(facts, rows, strict=True)])

    times = F.array(*[F.lit(u).cast("timestamp") for u in until])
    sides = [told(bars).withColumn("until", F.explode(times)).where(F.col("ts") < F.col("until")).withColumn("side", F.lit(1))]
    for u in until:
        end = F.lit(u).cast("timestamp")
        sides.append(told(bars.where(F.col("ts") < end)).withColumns({"until": end, "side": F.lit(-1)}))
    seen = reduce(DataFrame.unionByName, sides).groupBy("fact", "until", "symbol", "ts", "value").agg(F.sum("side").alias("left"))
    return seen.groupBy("fact").agg(F.sum(F.abs("left")).alias("n_changed"))
