"""Sources, sinks and upkeep of bar tables: symbol, ts, open, high, low, close, volume (and timeframe where several are held)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.timeframes import MINUTES, period_start

PRICES = ["open", "high", "low", "close", "volume"]
SCHEMA = "timestamp timestamp, open double, high double, low double, close double, volume double"
KEYS = ["symbol", "timeframe"]


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The bars of all files ``{symbol}.{timeframe}.parquet`` under ``path``; a file without a required column fails."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    df = spark.read.schema(SCHEMA).option("pathGlobFilter", "*.parquet").parquet(path)
    return df.select(F.regexp_extract(name, r"^(.*)\.([^.]+)\.parquet$", 1).alias("symbol"), F.regexp_extract(name, r"^(.*)\.([^.]+)\.parquet$", 2).alias("timeframe"), F.col("timestamp").alias("ts"), *PRICES)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """A store that ``write_store`` laid out; filters on symbol and timeframe prune its folders."""
    return spark.read.schema("ts timestamp, open double, high double, low double, close double, volume double, symbol string, timeframe string").parquet(path)


def write_store(bars: DataFrame, path: str) -> None:
    """Replaces the (symbol, timeframe) folders that ``bars`` has rows for, and no others."""
    dealt = bars.repartition(*KEYS).sortWithinPartitions(*KEYS, "ts")
    dealt.write.partitionBy(*KEYS).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def catalog(bars: DataFrame) -> DataFrame:
    return bars.select(*KEYS).distinct()


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """One bar for each key and time: the new one where both have it; of several new ones, the last by all its values."""
    both = stored.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    last = Window.partitionBy(*KEYS, "ts").orderBy(F.desc("_batch"), *[F.desc(c) for c in PRICES])
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_batch")


def coverage(bars: DataFrame) -> DataFrame:
    return bars.groupBy(*KEYS).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def covered(requests: DataFrame, held: DataFrame, slack_days: int = 2) -> DataFrame:
    """``requests`` (symbol, timeframe, start_ts, end_ts) with is_covered: the store reaches from the start to the end, less the slack."""
    rows = requests.join(held, KEYS, "left")
    ok = (F.col("first_ts") <= F.col("start_ts")) & (F.col("end_ts") <= F.col("last_ts") + F.expr(f"INTERVAL {slack_days} DAYS"))
    return rows.select(*requests.columns, F.coalesce(ok, F.lit(False)).alias("is_covered"))


def missing_ranges(requests: DataFrame, held: DataFrame) -> DataFrame:
    """The leading and trailing parts of the requests that the store lacks; gaps inside are taken to be closed markets."""
    rows = requests.join(held, KEYS, "left")
    part = lambda a, b, kind: F.struct(a.alias("gap_start"), b.alias("gap_end"), F.lit(kind).alias("gap"))
    start, end, first, last = (F.col(c) for c in ("start_ts", "end_ts", "first_ts", "last_ts"))
    whole = F.when(first.isNull(), part(start, end, "all"))
    lead = F.when(first.isNotNull() & (start < first), part(start, F.least(first, end), "lead"))
    trail = F.when(last.isNotNull() & (end > last), part(F.greatest(last, start), end, "trail"))
    gaps = F.filter(F.array(whole, lead, trail), lambda g: g.isNotNull())
    return rows.select(*KEYS, F.explode(gaps).alias("g")).select(*KEYS, "g.*")


def ingest(stored: DataFrame, landed: DataFrame, requests: DataFrame) -> DataFrame:
    """The store with what it lacked of the requests: landed bars inside the missing ranges only."""
    gaps = missing_ranges(requests, coverage(stored)).withColumnsRenamed({k: f"_{k}" for k in KEYS})
    inside = (F.col("symbol") == F.col("_symbol")) & (F.col("timeframe") == F.col("_timeframe")) & F.col("ts").between(F.col("gap_start"), F.col("gap_end"))
    return upsert(stored, landed.join(gaps, inside, "left_semi"))


def clip(bars: DataFrame, start: Column, end: Column) -> DataFrame:
    return bars.where(F.col("ts").between(start, end))


def feed_rows(pages: DataFrame, end_ms: Column) -> tuple[DataFrame, DataFrame]:
    """Bars and rejected rows of landed feed pages (symbol, timeframe, page, body: JSON rows [ms, open, high, low, close, volume]).

    Rows at or after the end stop; a boundary row that two pages share counts once; rows with a null or of another length are rejected, and so
    is a page that is no such JSON (i = -1).
    """
    read = pages.select(*KEYS, "page", F.from_json("body", "array<array<double>>").alias("_a"), end_ms.alias("_end")).where("_a is null or size(_a) > 0")
    rows = read.select(*KEYS, "page", F.posexplode_outer("_a").alias("i", "r"), "_end").withColumn("i", F.coalesce("i", F.lit(-1)))
    bad = F.col("r").isNull() | (F.size("r") != 6) | F.exists("r", lambda x: x.isNull())
    good = rows.where(~F.coalesce(bad, F.lit(True))).where(F.col("r")[0] < F.col("_end"))
    bars = good.select(*KEYS, F.timestamp_millis(F.col("r")[0].cast("long")).alias("ts"), *[F.col("r")[i + 1].alias(c) for i, c in enumerate(PRICES)], "page", "i")
    first = Window.partitionBy(*KEYS, "ts").orderBy("page", "i")
    bars = bars.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "page", "i")
    return bars, rows.where(F.coalesce(bad, F.lit(True))).select(*KEYS, "page", "i")


def vendor_rows(table: DataFrame, zone: str = "UTC") -> DataFrame:
    """A vendor's table (Date, Open, High, Low, Close, Volume, symbol, timeframe) as bars; naive times are ``zone``'s."""
    return table.select(*KEYS, F.to_utc_timestamp(F.col("Date"), zone).alias("ts"), *[F.col(c.capitalize()).cast("double").alias(c) for c in PRICES])


def by_priority(parts: DataFrame) -> DataFrame:
    """Of each (symbol, timeframe), all rows of the source with the least ``priority`` that has any, and none of the others'."""
    best = parts.groupBy(*KEYS).agg(F.min("priority").alias("_best"))
    return parts.join(best, KEYS).where(F.col("priority") == F.col("_best")).drop("_best")


def requirements(symbols: DataFrame, timeframes: DataFrame) -> DataFrame:
    """All pairs of the two small lists, once."""
    return symbols.select("symbol").distinct().crossJoin(F.broadcast(timeframes.select("timeframe").distinct()))


def acquisition_plan(required: DataFrame, held: DataFrame, native: DataFrame) -> DataFrame:
    """How each requirement is met: stored; resampled from the finest stored finer timeframe; natively from a source; or missing."""
    length = F.create_map(*[F.lit(x) for kv in MINUTES.items() for x in kv])
    have = held.select("symbol", F.col("timeframe").alias("_tf"), length[F.col("timeframe")].alias("_m"))
    finer = required.withColumn("_need", length[F.col("timeframe")]).join(have, "symbol", "left").where(F.col("_m").isNull() | (F.col("_m") <= F.col("_need")))
    best = finer.groupBy(*KEYS).agg(F.max((F.col("_m") == F.col("_need")).cast("int")).alias("_own"), F.min_by("_tf", F.when(F.col("_m") < F.col("_need"), F.col("_m"))).alias("_from"), F.min(F.when(F.col("_m") < F.col("_need"), F.col("_m"))).alias("_any"))
    rows = required.join(best, KEYS, "left").join(native.select(*KEYS, F.lit(True).alias("_native")), KEYS, "left")
    mode = F.when(F.col("_own") == 1, "stored").when(F.col("_any").isNotNull(), "resample").when(F.col("_native"), "native").otherwise("missing")
    return rows.select(*KEYS, mode.alias("mode"), F.when(mode == "resample", F.col("_from")).alias("source_timeframe"))


def provider_symbols(instruments: DataFrame) -> DataFrame:
    """canonical, provider, provider_symbol of a registry (canonical, providers map<string,string>, priority array<string>), with the provider's rank.

    Without a priority list, providers rank by name.
    """
    rows = instruments.select("canonical", "priority", F.explode(F.map_entries("providers")).alias("e"))
    named = F.array_sort(F.map_keys(F.col("providers")))
    rows = instruments.select("canonical", F.when(F.size("priority") > 0, F.col("priority")).otherwise(named).alias("_order"), F.explode(F.map_entries("providers")).alias("e"))
    return rows.select("canonical", F.col("e.key").alias("provider"), F.col("e.value").alias("provider_symbol"), F.array_position("_order", F.col("e.key")).cast("int").alias("rank"))


def portfolio(listed: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The list's (position, symbol) known instruments, each at its first position, and the unknown entries."""
    first = listed.groupBy("symbol").agg(F.min("position").alias("position"))
    return first.join(known.select("symbol"), "symbol", "left_semi"), listed.join(known.select("symbol"), "symbol", "left_anti")


def cleaned(bars: DataFrame) -> DataFrame:
    """Daily bars without Saturdays, one a date (the one at hour 0, else the first), high and low widened to hold open and close."""
    first = Window.partitionBy("symbol", F.to_date("ts")).orderBy(F.hour("ts") != 0, "ts")
    rows = bars.where(F.dayofweek("ts") != 7).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return rows.withColumns({"high": F.greatest("open", "high", "low", "close"), "low": F.least("open", "high", "low", "close")})


def from_ticks(ticks: DataFrame, timeframe: str) -> DataFrame:
    """Bars of ticks (symbol, ts, price, tie): the first and last price by (ts, tie), the count as volume."""
    at = F.struct("ts", "tie")
    rows = ticks.withColumn("_p", period_start(F.col("ts"), timeframe)).groupBy("symbol", F.col("_p").alias("_start"))
    agg = rows.agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return agg.withColumnRenamed("_start", "ts")


def resample(bars: DataFrame, timeframe: str, source: str | None = None) -> DataFrame:
    """Coarser bars: first open, highest high, lowest low, last close, summed volume. A finer timeframe than the source's fails."""
    if source and MINUTES[source] > MINUTES[timeframe]:
        raise ValueError(f"{timeframe} is finer than {source}")
    if source == timeframe:
        return bars
    rows = bars.withColumn("_p", period_start(F.col("ts"), timeframe)).groupBy("symbol", F.col("_p").alias("_start"))
    agg = rows.agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    return agg.withColumnRenamed("_start", "ts")


def event_ticks(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.col("event_id").alias("tie"))


def order_ticks(orders: DataFrame) -> DataFrame:
    return orders.select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_totalprice").cast("double").alias("price"), F.col("o_orderkey").alias("tie"))
