"""Streams of bars with a state for each symbol: indicators over a held tail, warm starts, and heartbeats by timers.

The state of a symbol is its tail: the last bars that any indicator looks at. A bar at or before the symbol's last one changes
nothing. The tail can be built from a table (``warm``), handed to a stream as its initial state, and read back from the
stream's checkpoint (``tails``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Bars of the channel and of the ATR; the tail holds as many as both need.
PERIOD, ATR_PERIOD = 20, 14
BARS = "symbol string, ts timestamp, high double, low double, close double"
INDICATORS = f"{BARS}, channel_high double, channel_low double, atr double, breakout int"
TAIL = "ts array<timestamp>, high array<double>, low array<double>, close array<double>"
BEATS = "symbol string, ts timestamp, last_ts timestamp, missed int, reason string"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session(spark: SparkSession) -> SparkSession:
    """A session of its own with the state store that keyed state needs: the caller's settings stay as they are."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own


def measured(tail: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    """The indicators of ``new`` bars after ``tail``; null where the tail is still too short. The channel leaves the current bar out."""
    every = pd.concat([tail, new], ignore_index=True)
    before = every["close"].shift(1)
    ranges = pd.concat([every["high"] - every["low"], (every["high"] - before).abs(), (every["low"] - before).abs()], axis=1).max(axis=1).where(before.notna())
    top, bottom = every["high"].rolling(PERIOD).max().shift(1), every["low"].rolling(PERIOD).min().shift(1)
    out = every.assign(channel_high=top, channel_low=bottom, atr=ranges.rolling(ATR_PERIOD).mean(), breakout=(every["close"] > top).astype("int32") - (every["close"] < bottom).astype("int32"))
    return out.iloc[len(tail) :]


class Indicators(StatefulProcessor):
    """Channel, ATR and breakouts of each new bar; the initial state is a row of TAIL's arrays for each symbol."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getValueState("tail", TAIL)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = ["ts", "high", "low", "close"]
        tail = pd.DataFrame(dict(zip(names, self.tail.get(), strict=True)) if self.tail.exists() else {n: [] for n in names})
        tail["ts"] = pd.to_datetime(tail["ts"])
        new = pd.concat(list(rows))[names].drop_duplicates("ts").sort_values("ts")
        if len(tail):
            new = new[new["ts"] > tail["ts"].iloc[-1]]
        if not len(new):
            return
        out = measured(tail, new)
        tail = pd.concat([tail, new]).tail(PERIOD + 1)
        self.tail.update(([t.to_pydatetime() for t in tail["ts"]], *(tail[n].tolist() for n in names[1:])))
        yield out.assign(symbol=key[0])[[c.split()[0] for c in INDICATORS.split(", ")]]

    def handleInitialState(self, key: Any, initial: pd.DataFrame, timerValues: Any) -> None:  # noqa: N802, N803
        first = initial.iloc[0]
        self.tail.update(([pd.Timestamp(t).to_pydatetime() for t in first["ts"]], *([float(v) for v in first[n]] for n in ("high", "low", "close"))))

    def close(self) -> None:
        pass


def indicators(bars: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """INDICATORS of a stream of BARS; ``initial`` (``warm``) is where a stream begins that has not seen the history."""
    return bars.groupBy("symbol").transformWithStateInPandas(Indicators(), INDICATORS, "Append", "None", initialState=initial.groupBy("symbol") if initial is not None else None)


def warm(bars: DataFrame, days: int = 40) -> DataFrame:
    """symbol and TAIL of a table's last ``days`` days for each symbol: only those are gathered, and no more than the indicators look at."""
    last = bars.groupBy("symbol").agg(F.max("ts").alias("_last"))
    recent = bars.join(last, "symbol").where(F.col("ts") > F.col("_last") - F.expr(f"INTERVAL {days} DAYS"))
    tail = F.slice(F.array_sort(F.collect_list(F.struct("ts", "high", "low", "close"))), -(PERIOD + 1), PERIOD + 1)
    short = F.array_sort(F.collect_list(F.struct("ts", "high", "low", "close")))
    held = recent.groupBy("symbol").agg(F.when(F.count(F.lit(1)) > PERIOD + 1, tail).otherwise(short).alias("_t"))
    return held.select("symbol", *[F.col(f"_t.{c}").alias(c) for c in ("ts", "high", "low", "close")])


def tails(spark: SparkSession, checkpoint: str) -> DataFrame:
    """symbol and TAIL as the stream with this checkpoint holds them, by the state reader."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "tail").load()
    return rows.select(F.col("key.symbol").alias("symbol"), *[F.col(f"value.{c}").alias(c) for c in ("ts", "high", "low", "close")])


class Heartbeats(StatefulProcessor):
    """A row whenever a symbol has had no bar for ``every``: by the next bar that came later than that, or by a timer that the watermark passes."""

    def __init__(self, every: pd.Timedelta) -> None:
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts timestamp, missed int")

    def _due(self, symbol: str, last: pd.Timestamp, missed: int, until: pd.Timestamp, reason: str) -> pd.DataFrame:
        """Beats of ``symbol`` after its bar at ``last``, of which ``missed`` are out already, before ``until``."""
        n = max(0, -((last - until) // self.every) - 1)
        k = pd.Series(range(missed + 1, n + 1), dtype="int32")
        return pd.DataFrame({"symbol": symbol, "ts": last + k * self.every, "last_ts": last, "missed": k, "reason": reason})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times = pd.concat(list(rows))["ts"].drop_duplicates().sort_values()
        last, missed = (pd.Timestamp(self.last.get()[0]), self.last.get()[1]) if self.last.exists() else (None, 0)
        times = times if last is None else times[times > last]
        if not len(times):
            return
        begin = times.iloc[:-1].tolist() if last is None else [last, *times.iloc[:-1]]
        ends = times.iloc[1:] if last is None else times
        for i, (a, b) in enumerate(zip(begin, ends, strict=True)):
            if b - a > self.every:
                yield self._due(key[0], a, missed if i == 0 else 0, b, "bar")
        self.last.update((times.iloc[-1].to_pydatetime(), 0))
        for timer in [*self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((times.iloc[-1] + self.every).timestamp() * 1000))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, missed = self.last.get()
        last = pd.Timestamp(last)
        beats = self._due(key[0], last, missed, pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms") + pd.Timedelta(milliseconds=1), "timer")
        if len(beats):
            missed = int(beats["missed"].iloc[-1])
            self.last.update((last.to_pydatetime(), missed))
            yield beats
        self.handle.registerTimer(int((last + (missed + 1) * self.every).timestamp() * 1000))

    def close(self) -> None:
        pass


def heartbeats(bars: DataFrame, every: str = "3 hours", late: str = "1 hour") -> DataFrame:
    """BEATS of a stream of bars (symbol, ts): one each time that a symbol has had no bar for another ``every``, up to the watermark (the latest bar of any
    symbol less ``late``). Which rows there are doesn't depend on how the bars are cut into batches; ``reason`` does."""
    timed = bars.select("symbol", "ts").withWatermark("ts", late)
    return timed.groupBy("symbol").transformWithStateInPandas(Heartbeats(pd.Timedelta(every)), BEATS, "Append", "EventTime")


def played(rows: DataFrame, cuts: Iterable[Column], make: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], at: str, seen: Callable[[], None] = lambda: None) -> None:
    """For each cut, in turn: the rows that it picks land under ``at``, the stream starts again from its checkpoint, takes them and stops; then ``seen``."""
    own = session(rows.sparkSession)
    for cut in cuts:
        rows.where(cut).write.mode("append").parquet(f"{at}/landed")
        stream = make(own.readStream.schema(rows.schema).parquet(f"{at}/landed"))
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        seen()
