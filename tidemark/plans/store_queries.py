"""Files, versioned stores, typed facts, bundles of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bundle, factcodec, metrics as met
from tidemark.operators import indicators as ind
from tidemark.operators import pivots as piv
from tidemark.plans import sql
from tidemark.plans.bar_queries import hourly, rounded, with_facts
from tidemark.plans.registry import register
from tidemark.plans.stream_queries import folder
from tidemark.plans.trade_queries import levels_of, trades
from tidemark.sources import bars as src
from tidemark.sources import files, snapshots

sql.define("two", "SELECT symbol, '1h' AS timeframe, ts, open, high, low, close, volume FROM b1h UNION ALL SELECT symbol, '4h', ts, open, high, low, close, volume FROM b4h", "b1h", "b4h")


def two(spark: SparkSession, d: str) -> DataFrame:
    bars = hourly(spark, d)
    return bars.withColumn("timeframe", F.lit("1h")).unionByName(src.resample(bars, "4h", "1h").withColumn("timeframe", F.lit("4h")))


@register(
    "bar_files",
    sql.query(
        """SELECT 'bar' AS what, symbol, timeframe, ts, round(close + (symbol = 'click')::INT, 6) AS value FROM two WHERE symbol IN ('click', 'view') AND timeframe = '1h'
        UNION ALL SELECT 'frame', symbol, '1h', ts, round(ema_20, 6) FROM t1h WHERE symbol = 'click' AND trend_direction = 'bullish'""",
        "two",
        "t1h",
    ),
)
def bar_files(spark: SparkSession, d: str) -> DataFrame:
    """Bars and fact frames through the file source: written, one symbol's replaced, and read with filters that name files."""
    own, bars, frames = files.session(spark), folder(spark), folder(spark)
    files.save(two(own, d).repartition("symbol", "timeframe"), bars)
    files.save(two(own, d).where("symbol = 'click' AND timeframe = '1h'").withColumn("close", F.col("close") + 1), bars)
    files.save(with_facts(hourly(own, d)).withColumn("timeframe", F.lit("1h")).select("symbol", "timeframe", "ts", "ema_20", "trend_direction"), frames)
    held = files.load(own, bars).where(F.col("symbol").isin("click", "view") & (F.col("timeframe") == "1h"))
    facts = files.load(own, frames, "symbol string, timeframe string, ts timestamp, ema_20 double, trend_direction string, never_held double")
    facts = facts.where("symbol = 'click' AND trend_direction = 'bullish' AND never_held IS NULL")
    both = held.select(F.lit("bar").alias("what"), "symbol", "timeframe", "ts", F.col("close").alias("value")).unionByName(facts.select(F.lit("frame").alias("what"), "symbol", "timeframe", "ts", F.col("ema_20").alias("value")))
    return rounded(both, "what", "symbol", "timeframe", "ts", value="value")


_WHEN = "SELECT '{w}' AS seen, symbol, timeframe, count(*) AS n, round(sum(close {x}), 6) AS total FROM two GROUP BY ALL"
_TWICE = "* CASE WHEN symbol IN ('click', 'view') AND timeframe = '1h' THEN 2 ELSE 1 END"


@register("bar_snapshots", sql.query(" UNION ALL ".join([_WHEN.format(w="during", x=""), _WHEN.format(w="pinned", x=""), _WHEN.format(w="after", x=_TWICE)]), "two"))
def bar_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """A store while two of its series are replaced, a reader that stays with the version it began with, and one that comes after."""
    at, rows = folder(spark), two(spark, d)
    first = snapshots.replace(rows, at)
    changed = rows.where("symbol IN ('click', 'view') AND timeframe = '1h'").withColumn("close", 2 * F.col("close"))
    waiting = snapshots.prepare(changed, at)
    during = snapshots.read(spark, at)
    snapshots.commit(waiting)
    seen = {"during": during, "pinned": snapshots.read(spark, at, first), "after": snapshots.read(spark, at)}
    out = None
    for name, bars in seen.items():
        part = bars.groupBy(F.lit(name).alias("seen"), "symbol", "timeframe").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("close"), 6).alias("total"))
        out = part if out is None else out.unionByName(part)
    return out


def facts_of(spark: SparkSession, d: str) -> DataFrame:
    """The hourly bars' facts of all kinds: two means, the channel, the trend, pullbacks and levels."""
    frames = ind.with_channel(with_facts(hourly(spark, d)))
    seen = piv.with_pullback(piv.visible_swings(piv.with_pivots(frames), 20)).where("pullback_direction is not null")
    levels = levels_of(frames).withColumnRenamed("frame_idx", "bar_idx").groupBy("symbol", "bar_idx").agg(F.array_sort(F.collect_list(F.struct("kind", "level", "touches"))).alias("levels"))
    code, name = factcodec.encoded, lambda n: F.lit(n).alias("name")
    return factcodec.stacked(
        *[frames.select("symbol", "ts", name(f"ema_{p}"), code("mean", period=F.lit(p), value=F.col(f"ema_{p}")).alias("fact")) for p in (20, 50)],
        frames.select("symbol", "ts", name("channel"), code("channel", period=F.lit(20), high=F.col("channel_high"), low=F.col("channel_low")).alias("fact")),
        frames.select("symbol", "ts", name("trend"), code("trend", direction=F.col("trend_direction"), strength=F.col("trend_strength")).alias("fact")),
        seen.select("symbol", "ts", name("pullback"), code("pattern", direction=F.col("pullback_direction"), confirmed_at=F.col("ts"), prices=F.col("swing_pattern")).alias("fact")),
        levels.join(frames.select("symbol", "bar_idx", "ts"), ["symbol", "bar_idx"]).select("symbol", "ts", name("levels"), code("levels", levels=F.col("levels")).alias("fact")),
    )


@register(
    "fact_codec",
    sql.query(
        """SELECT symbol, ts, 'ema_20' AS name, 'value' AS part, round(ema_20, 6) AS value FROM c1h UNION ALL SELECT symbol, ts, 'ema_50', 'value', round(ema_50, 6) FROM c1h
        UNION ALL SELECT symbol, ts, 'channel', unnest(['high', 'low']), round(unnest([channel_high, channel_low]), 6) FROM c1h UNION ALL SELECT symbol, ts, 'trend', trend_direction, round(trend_strength, 6) FROM c1h
        UNION ALL SELECT symbol, ts, 'pullback', direction || ' ' || (unnest([1, 2, 3, 4]))::VARCHAR, round(unnest(pattern), 6) FROM pull WHERE direction IS NOT NULL
        UNION ALL SELECT f.symbol, ts, 'levels', kind || ' ' || touches, round(level, 6) FROM flv f JOIN a1h a ON a.symbol = f.symbol AND a.bar_idx = f.frame_idx
        UNION ALL SELECT symbol, NULL, 'unread', 'from_elsewhere', count(*) FROM b1h WHERE hour(ts) = 0 GROUP BY symbol""",
        "c1h",
        "pull",
        "flv",
        "a1h",
        "b1h",
    ),
)
def fact_codec(spark: SparkSession, d: str) -> DataFrame:
    """Facts of all kinds as JSON texts, with some of a kind that nobody here knows, and back as typed columns."""
    elsewhere = hourly(spark, d).where(F.hour("ts") == 0).select("symbol", "ts", F.lit("x").alias("name"), F.lit('{"kind": "from_elsewhere", "value": 1}').alias("text"))
    at = folder(spark)
    factcodec.from_text(factcodec.to_text(facts_of(spark, d)).unionByName(elsewhere)).write.parquet(at)  # VARIANT columns
    held = spark.read.parquet(at)
    row = lambda df, part, value: df.select("symbol", "ts", "name", part.alias("part"), F.round(value, 6).alias("value"))
    text, dec = F.col, lambda k: factcodec.decoded(held, k)
    channel = dec("channel").select(*factcodec.KEYS, F.explode(F.create_map(F.lit("high"), F.col("high"), F.lit("low"), F.col("low"))).alias("part", "v"))
    pattern = dec("pattern").where("confirmed_at = ts").select(*factcodec.KEYS, "direction", F.posexplode("prices").alias("i", "v"))
    levels = dec("levels").select(*factcodec.KEYS, F.explode("levels").alias("l"))
    unread = held.withColumn("k", factcodec.kind()).groupBy("symbol", "k").agg(F.count(F.lit(1)).alias("n")).join(factcodec.unread(held).select(F.col("kind").alias("k")), "k")
    parts = [
        row(dec("mean"), F.lit("value"), F.col("value")), row(channel, text("part"), F.col("v")), row(dec("trend"), text("direction"), F.col("strength")),
        row(pattern, F.concat_ws(" ", "direction", F.col("i") + 1), F.col("v")), row(levels, F.concat_ws(" ", "l.kind", "l.touches"), F.col("l.level")),
        unread.select("symbol", F.lit(None).cast("timestamp").alias("ts"), F.lit("unread").alias("name"), F.col("k").alias("part"), F.col("n").cast("double").alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_RUN = """SELECT '{run}' AS run, 'candles' AS part, symbol, count(*) AS n, round(sum(close), 6) AS total FROM b1h GROUP BY symbol UNION ALL SELECT '{run}', 'frames', symbol, count(*), round(sum(ema_20), 6) FROM t1h GROUP BY symbol
    UNION ALL SELECT '{run}', 'trades', symbol, count(*), round(sum(r), 6) FROM trades WHERE {keep} GROUP BY symbol UNION ALL SELECT '{run}', 'summary', symbol, count(*) FILTER (result = 'win'), round(avg(r), 6) FROM trades WHERE {keep} GROUP BY symbol
    UNION ALL SELECT '{run}', 'monthly', symbol, count(DISTINCT date_trunc('month', exit_ts)), round(sum(r), 6) FROM trades WHERE {keep} GROUP BY symbol"""


@register("run_bundles", sql.query(" UNION ALL ".join([_RUN.format(run="both", keep="true"), _RUN.format(run="long", keep="direction = 'bullish'")]), "b1h", "t1h", "trades"))
def run_bundles(spark: SparkSession, d: str) -> DataFrame:
    """Two runs as bundles, one of them written twice, and read back; a run whose writing stopped halfway is not there."""
    at, bars = folder(spark), hourly(spark, d)
    done, frames = trades(spark, d), with_facts(bars).select("symbol", "ts", "ema_20", "trend_direction")
    results = lambda rows: bundle.results(bars, frames, rows, met.ordered_balances(rows))
    long = done.where("direction = 'bullish'")
    bundle.write(results(done), at, "both")
    bundle.write({"trades": done}, at, "long")
    bundle.write(results(long), at, "long")
    long.write.parquet(f"{at}/tables/attempt=stopped/trades")
    out = None
    for run in bundle.runs(spark, at):
        held = bundle.read(spark, at, run)
        of = lambda part, n, total: held[part].groupBy(F.lit(run).alias("run"), F.lit(part).alias("part"), "symbol").agg(n.alias("n"), F.round(total, 6).alias("total"))  # noqa: B023, E731
        one = F.count(F.lit(1))
        parts = [of("candles", one, F.sum("close")), of("frames", one, F.sum("ema_20")), of("trades", one, F.sum("r")), of("summary", F.sum("n_win"), F.max("expectancy_all")), of("monthly", one, F.sum("pnl"))]
        for p in parts:
            out = p if out is None else out.unionByName(p)
    return out
