"""Queries over bars: resampling, indicators, as-of joins, store upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timeframes import minutes
from tidemark.operators import indicators as ind
from tidemark.operators import joins
from tidemark.plans import sql
from tidemark.plans.registry import register
from tidemark.sources import bars as src


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return src.from_ticks(src.event_ticks(spark.read.parquet(f"{d}/events.parquet")), "1h")


def daily(spark: SparkSession, d: str) -> DataFrame:
    return src.from_ticks(src.order_ticks(spark.read.parquet(f"{d}/orders.parquet")), "1d")


def rounded(df: DataFrame, *keep: str, **values: str) -> DataFrame:
    """``keep`` as they are and ``values`` (alias=column) rounded to 6 places."""
    return df.select(*keep, *[F.round(F.col(c).cast("double"), 6).alias(a) for a, c in values.items()])


def _r(**values: str) -> str:
    return ", ".join(f"round({c}, 6) AS {a}" for a, c in values.items())


_OHLCV = {c: c for c in ("open", "high", "low", "close", "volume")}


@register("bars_resample_1h", sql.query(f"SELECT symbol, ts, {_r(**_OHLCV)} FROM b1h", "b1h"))
def bars_resample_1h(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hourly(spark, d), "symbol", "ts", **_OHLCV)


@register("bars_resample_4h", sql.query(f"SELECT symbol, ts, {_r(**_OHLCV)} FROM b4h", "b4h"))
def bars_resample_4h(spark: SparkSession, d: str) -> DataFrame:
    return rounded(src.resample(hourly(spark, d), "4h", "1h"), "symbol", "ts", **_OHLCV)


@register("bars_resample_1w", sql.query(f"SELECT symbol, ts, {_r(**_OHLCV)} FROM b1w", "b1w"))
def bars_resample_1w(spark: SparkSession, d: str) -> DataFrame:
    return rounded(src.resample(daily(spark, d), "1w", "1d"), "symbol", "ts", **_OHLCV)


@register("true_range", sql.query(f"SELECT symbol, ts, bar_idx, {_r(tr='tr')} FROM x1h", "x1h"))
def true_range(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ind.indexed(hourly(spark, d)).withColumn("tr", ind.true_range()), "symbol", "ts", "bar_idx", tr="tr")


@register("atr_sma_14", sql.query(f"SELECT symbol, ts, bar_idx, bar_idx >= 100 AS is_valid, {_r(atr='atr')} FROM a1h", "a1h"))
def atr_sma_14(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ind.with_atr_sma(ind.indexed(hourly(spark, d))), "symbol", "ts", "bar_idx", "is_valid", atr="atr")


@register("atr_wilder_14", sql.query(f"SELECT symbol, ts, {_r(atr='atr_wilder', atr_pct='CASE WHEN close <> 0 THEN atr_wilder * 100 / close END')} FROM i1h", "i1h"))
def atr_wilder_14(spark: SparkSession, d: str) -> DataFrame:
    rows = ind.with_atr_wilder(ind.indexed(hourly(spark, d)))
    return rounded(rows.withColumn("p", F.try_divide(F.col("atr_wilder") * 100, "close")), "symbol", "ts", atr="atr_wilder", atr_pct="p")


for _p in (20, 50):

    @register(f"ema_{_p}", sql.query(f"SELECT symbol, ts, {_r(ema=f'ema_{_p}')}, CASE WHEN close > ema_{_p} THEN 'above' WHEN close < ema_{_p} THEN 'below' ELSE 'at' END AS side FROM g1h", "g1h"))
    def ema(spark: SparkSession, d: str, p: int = _p) -> DataFrame:
        rows = ind.with_ema(hourly(spark, d), p)
        return rounded(rows.withColumn("side", ind.side_of(F.col("close"), F.col(f"ema_{p}"))), "symbol", "ts", "side", ema=f"ema_{p}")


def with_facts(bars: DataFrame) -> DataFrame:
    """Indexed bars with both ATRs, both means and the trend."""
    rows = ind.with_atr_wilder(ind.with_atr_sma(ind.indexed(bars)))
    rows = rows.withColumn("_h", ind.history("close"))
    rows = rows.withColumns({f"ema_{p}": ind.ema_of(F.col("_h"), p) for p in (20, 50)}).drop("_h")
    return ind.with_trend(rows)


@register("trend", sql.query("SELECT symbol, ts, trend_direction, trend_strength, trend_side FROM t1h", "t1h"))
def trend(spark: SparkSession, d: str) -> DataFrame:
    return with_facts(hourly(spark, d)).select("symbol", "ts", "trend_direction", "trend_strength", "trend_side")


sql.define(
    "c1h",
    """SELECT *, max(high) OVER w AS channel_high, min(low) OVER w AS channel_low FROM t1h
    WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
    "t1h",
)
sql.define(
    "o1h",
    """SELECT *, CASE WHEN least(bar_idx + 1, 101) < 22 THEN 0 ELSE coalesce(bar_idx - max(hit) OVER w, least(bar_idx + 1, 101) - 1) END::INTEGER AS breakout_age
    FROM (SELECT *, CASE WHEN bar_idx >= 20 AND (close > channel_high OR close < channel_low) THEN bar_idx END AS hit FROM c1h)
    WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 80 PRECEDING AND CURRENT ROW)""",
    "c1h",
)


@register("channel_20", sql.query(f"SELECT symbol, ts, bar_idx, {_r(channel_high='channel_high', channel_low='channel_low', atr='atr')} FROM c1h", "c1h"))
def channel_20(spark: SparkSession, d: str) -> DataFrame:
    rows = ind.with_channel(ind.with_atr_sma(ind.indexed(hourly(spark, d))))
    return rounded(rows, "symbol", "ts", "bar_idx", channel_high="channel_high", channel_low="channel_low", atr="atr")


@register("breakout_age", sql.query("SELECT symbol, ts, breakout_age FROM o1h", "o1h"))
def breakout_age(spark: SparkSession, d: str) -> DataFrame:
    return ind.with_breakout_age(ind.with_channel(ind.indexed(hourly(spark, d)))).select("symbol", "ts", "breakout_age")


sql.define(
    "r1h",
    """SELECT *, CASE WHEN atr > 0 AND close <> 0 THEN atr * 100 / close END AS atr_pct,
    CASE WHEN bar_idx >= 20 THEN volume / avg(volume) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS vol_ratio,
    CASE WHEN bar_idx >= 19 AND atr > 0 THEN (max(high) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) - min(low) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) / atr END AS rng20_atr,
    CASE WHEN bar_idx >= 63 THEN (close - lag(close, 63) OVER w) / nullif(sum(step) OVER (w ROWS BETWEEN 62 PRECEDING AND CURRENT ROW), 0) END AS trend_eff
    FROM (SELECT *, abs(close - lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS step FROM a1h)
    WINDOW w AS (PARTITION BY symbol ORDER BY ts)""",
    "a1h",
)
_REGIME = {c: c for c in ("atr_pct", "vol_ratio", "rng20_atr", "trend_eff")}


@register("regime_context", sql.query(f"SELECT symbol, ts, {_r(**_REGIME)} FROM r1h", "r1h"))
def regime_context(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ind.with_regime(ind.with_atr_sma(ind.indexed(hourly(spark, d)))), "symbol", "ts", **_REGIME)


@register("asof_timeframe_align", sql.query("SELECT a.symbol, a.ts, round(b.close, 6) AS close_4h, b.ts AS ts_4h FROM b1h a ASOF LEFT JOIN b4h b ON a.symbol = b.symbol AND a.ts >= b.ts", "b1h", "b4h"))
def asof_timeframe_align(spark: SparkSession, d: str) -> DataFrame:
    low = hourly(spark, d)
    high = src.resample(low, "4h", "1h").select("symbol", "ts", F.round("close", 6).alias("close_4h"))
    return joins.asof_backward(low.select("symbol", "ts"), high.withColumnRenamed("ts", "ts_4h"), ["symbol"], "ts", "ts_4h", ["close_4h"]).select("symbol", "ts", "close_4h", F.col("ts_4h_asof").alias("ts_4h"))


@register(
    "range_position",
    sql.query(
        """, hi AS (SELECT symbol, ts + INTERVAL 21 DAYS AS usable_at, max(high) OVER w AS range_high, min(low) OVER w AS range_low, count(*) OVER w AS n
        FROM b1w WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
        SELECT a.symbol, a.ts, round(range_high, 6) AS range_high, round(range_low, 6) AS range_low,
        round(CASE WHEN range_high > range_low THEN (a.close - range_low) / (range_high - range_low) END, 6) AS position
        FROM b1d a ASOF LEFT JOIN hi ON a.symbol = hi.symbol AND a.ts >= hi.usable_at""",
        "b1d",
        "b1w",
    ),
)
def range_position(spark: SparkSession, d: str) -> DataFrame:
    """Where the close lies in the last 12 completed weeks, with a confirmation lag of two more."""
    days = daily(spark, d)
    weeks = src.resample(days, "1w", "1d")
    ranges = weeks.select("symbol", "ts", F.max("high").over(ind.last(12)).alias("range_high"), F.min("low").over(ind.last(12)).alias("range_low"))
    rows = joins.completed(days.select("symbol", "ts", "close"), ranges, ["symbol"], 10080, 2, ["range_high", "range_low"])
    span = F.col("range_high") - F.col("range_low")
    return rounded(rows.withColumn("p", F.when(span > 0, (F.col("close") - F.col("range_low")) / span)), "symbol", "ts", range_high="range_high", range_low="range_low", position="p")


@register("merged_calendar", sql.query("SELECT c.ts, c.tick::BIGINT AS tick, count(*) AS n_symbols FROM (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS tick FROM (SELECT DISTINCT ts FROM b1h)) c JOIN b1h USING (ts) GROUP BY ALL", "b1h"))
def merged_calendar(spark: SparkSession, d: str) -> DataFrame:
    """The distinct times of all symbols, numbered: a month's times are numbered in a task and the months' counts put before."""
    from pyspark.sql import Window

    times = hourly(spark, d).groupBy("ts").agg(F.count(F.lit(1)).alias("n_symbols")).withColumn("_m", F.date_trunc("month", "ts"))
    months = times.groupBy("_m").agg(F.count(F.lit(1)).alias("_n"))  # a row for each month of the calendar
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = times.join(F.broadcast(months.select("_m", before.alias("_before"))), "_m")
    return rows.select("ts", (F.col("_before") + F.row_number().over(Window.partitionBy("_m").orderBy("ts")) - 1).alias("tick"), "n_symbols")


_TWO = "SELECT symbol, '1h' AS timeframe, ts, open, high, low, close, volume FROM b1h UNION ALL SELECT symbol, '1d', ts, open, high, low, close, volume FROM b1d"
sql.define("store", _TWO, "b1h", "b1d")


def store(spark: SparkSession, d: str) -> DataFrame:
    return hourly(spark, d).withColumn("timeframe", F.lit("1h")).unionByName(daily(spark, d).withColumn("timeframe", F.lit("1d")))


@register("coverage", sql.query("SELECT symbol, timeframe, min(ts) AS first_ts, max(ts) AS last_ts FROM store GROUP BY ALL", "store"))
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return src.coverage(store(spark, d))


@register("catalog", sql.query("SELECT DISTINCT symbol, timeframe, CASE timeframe WHEN '1h' THEN 60 ELSE 1440 END AS minutes FROM store", "store"))
def catalog(spark: SparkSession, d: str) -> DataFrame:
    return src.catalog(store(spark, d)).withColumn("minutes", minutes(F.col("timeframe")))


def requests(spark: SparkSession, d: str) -> DataFrame:
    """What is asked for: ten days before to one day after what is held, and two timeframes that are not."""
    held = src.coverage(store(spark, d))
    more = held.where("timeframe = '1d'").withColumn("timeframe", F.lit("4h"))
    return held.unionByName(more).select("symbol", "timeframe", (F.col("first_ts") - F.expr("INTERVAL 10 DAYS")).alias("start_ts"), (F.col("last_ts") + F.expr("INTERVAL 1 DAY")).alias("end_ts"))


sql.define("held", "SELECT symbol, timeframe, min(ts) AS first_ts, max(ts) AS last_ts FROM store GROUP BY ALL", "store")
sql.define("asked", "SELECT symbol, tf AS timeframe, first_ts - INTERVAL 10 DAYS AS start_ts, last_ts + INTERVAL 1 DAY AS end_ts FROM (SELECT *, timeframe AS tf FROM held UNION ALL SELECT *, '4h' FROM held WHERE timeframe = '1d')", "held")


@register(
    "missing_ranges",
    sql.query(
        """SELECT symbol, timeframe, start_ts AS gap_start, end_ts AS gap_end, 'all' AS gap FROM asked ANTI JOIN held USING (symbol, timeframe)
        UNION ALL SELECT symbol, timeframe, start_ts, least(first_ts, end_ts), 'lead' FROM asked JOIN held USING (symbol, timeframe) WHERE start_ts < first_ts
        UNION ALL SELECT symbol, timeframe, greatest(last_ts, start_ts), end_ts, 'trail' FROM asked JOIN held USING (symbol, timeframe) WHERE end_ts > last_ts""",
        "asked",
        "held",
    ),
)
def missing_ranges(spark: SparkSession, d: str) -> DataFrame:
    return src.missing_ranges(requests(spark, d), src.coverage(store(spark, d)))


@register("is_covered", sql.query("SELECT symbol, timeframe, start_ts, end_ts, coalesce(first_ts <= start_ts AND end_ts <= last_ts + INTERVAL 2 DAYS, false) AS is_covered FROM asked LEFT JOIN held USING (symbol, timeframe)", "asked", "held"))
def is_covered(spark: SparkSession, d: str) -> DataFrame:
    return src.covered(requests(spark, d), src.coverage(store(spark, d)))


@register(
    "bar_upsert",
    sql.query(
        """, landed AS (SELECT symbol, timeframe, ts + INTERVAL 12 HOURS AS ts, close AS open, close + 1 AS high, close - 1 AS low, close, volume FROM store WHERE hour(ts) = 0)
        SELECT symbol, timeframe, ts, round(close, 6) AS close, round(high, 6) AS high FROM landed UNION ALL
        SELECT symbol, timeframe, ts, round(close, 6), round(high, 6) FROM store ANTI JOIN landed USING (symbol, timeframe, ts)""",
        "store",
    ),
)
def bar_upsert(spark: SparkSession, d: str) -> DataFrame:
    held = store(spark, d)
    landed = held.where(F.hour("ts") == 0).withColumns({"ts": F.col("ts") + F.expr("INTERVAL 12 HOURS"), "open": F.col("close"), "high": F.col("close") + 1, "low": F.col("close") - 1})
    return rounded(src.upsert(held, landed), "symbol", "timeframe", "ts", close="close", high="high")


@register(
    "bar_ingest",
    sql.query(
        """, landed AS (SELECT symbol, timeframe, ts - INTERVAL 5 DAYS AS ts, close FROM store)
        SELECT symbol, timeframe, ts, round(close, 6) AS close FROM landed l JOIN held USING (symbol, timeframe) JOIN asked USING (symbol, timeframe)
        WHERE ts >= start_ts AND (ts <= first_ts OR (ts >= last_ts AND ts <= end_ts))
        UNION ALL SELECT s.symbol, s.timeframe, s.ts, round(s.close, 6) FROM store s JOIN held h USING (symbol, timeframe)
        LEFT JOIN (SELECT DISTINCT symbol, timeframe, ts FROM landed) l USING (symbol, timeframe, ts)
        WHERE NOT (l.ts IS NOT NULL AND (s.ts = h.first_ts OR s.ts = h.last_ts))""",
        "store",
        "held",
        "asked",
    ),
)
def bar_ingest(spark: SparkSession, d: str) -> DataFrame:
    held = store(spark, d)
    landed = held.withColumn("ts", F.col("ts") - F.expr("INTERVAL 5 DAYS"))
    return rounded(src.ingest(held, landed, requests(spark, d).where("timeframe <> '4h'")), "symbol", "timeframe", "ts", close="close")


@register(
    "bar_hygiene",
    sql.query(
        """SELECT symbol, ts, round(open, 6) AS open, round(greatest(open, high, low, close), 6) AS high, round(least(open, high, low, close), 6) AS low, round(close, 6) AS close
        FROM b4h WHERE dayofweek(ts) <> 6 QUALIFY row_number() OVER (PARTITION BY symbol, ts::DATE ORDER BY hour(ts) <> 0, ts) = 1""",
        "b4h",
    ),
)
def bar_hygiene(spark: SparkSession, d: str) -> DataFrame:
    rows = src.cleaned(src.resample(hourly(spark, d), "4h", "1h"))
    return rounded(rows, "symbol", "ts", open="open", high="high", low="low", close="close")


@register(
    "acquisition_plan",
    sql.query(
        """, need AS (SELECT symbol, tf AS timeframe, m FROM (SELECT DISTINCT symbol FROM store), (VALUES ('1h', 60), ('4h', 240), ('1d', 1440), ('15m', 15)) t(tf, m)),
        have AS (SELECT symbol, timeframe AS htf, CASE timeframe WHEN '1h' THEN 60 ELSE 1440 END AS hm FROM held)
        SELECT symbol, timeframe, CASE WHEN bool_or(hm = m) THEN 'stored' WHEN bool_or(hm < m) THEN 'resample' WHEN timeframe <> '15m' THEN 'native' ELSE 'missing' END AS mode,
        CASE WHEN NOT coalesce(bool_or(hm = m), false) THEN arg_min(htf, hm) FILTER (hm < m) END AS source_timeframe
        FROM need LEFT JOIN have USING (symbol) GROUP BY symbol, timeframe, m""",
        "held",
    ),
)
def acquisition_plan(spark: SparkSession, d: str) -> DataFrame:
    held = store(spark, d)
    names = spark.createDataFrame([(t,) for t in ("1h", "4h", "1d", "15m")], "timeframe string")
    need = src.requirements(held, names)
    return src.acquisition_plan(need, src.coverage(held), need.where("timeframe <> '15m'"))


@register("group_strength", sql.query("SELECT ts, count(*) AS n_members, round(avg(CASE WHEN trend_direction = 'bullish' THEN trend_strength WHEN trend_direction = 'bearish' THEN -trend_strength ELSE 0 END), 6) AS strength, max_by(symbol, (trend_strength, symbol)) AS leader FROM t1h GROUP BY ts", "t1h"))
def group_strength(spark: SparkSession, d: str) -> DataFrame:
    """A cross-symbol fact: at each time, the members' mean signed trend strength and the strongest member."""
    from tidemark.operators.extension import spanning

    signed = F.when(F.col("trend_direction") == "bullish", F.col("trend_strength")).when(F.col("trend_direction") == "bearish", -F.col("trend_strength")).otherwise(0.0)
    return spanning(with_facts(hourly(spark, d)), n_members=F.count(F.lit(1)), strength=F.round(F.avg(signed), 6), leader=F.max_by("symbol", F.struct("trend_strength", "symbol")))
