"""The daily job as a stream: bars come in, entries and exits go out.

The state of a symbol is its last bar's time, the bars that the channel and the ATR need, and the open position. A bar at or before
the symbol's last one is ignored (a late bar must not trade). On a bar, an open position is judged first: stop, then target, then
the holding limit; only a bar that closed none may open one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PERIOD, ATR_PERIOD, HOLD, STOP_ATR, TARGET_ATR = 20, 14, 15, 1.5, 3.0
EVENTS = "symbol string, ts timestamp, kind string, direction string, price double, stop double, target double, reason string, r double"
_COLUMNS = [c.split()[0] for c in EVENTS.split(", ")]


def start() -> dict[str, Any]:
    return {"last": None, "bars": [], "open": None}


def on_bar(state: dict[str, Any], symbol: str, ts: pd.Timestamp, high: float, low: float, close: float) -> list[tuple]:
    """The events of a bar; moves the state."""
    if state["last"] is not None and ts.value <= state["last"]:
        return []
    out, held, bars = [], state["open"], state["bars"]
    if held:
        s, held["bars"] = (1 if held["direction"] == "bullish" else -1), held["bars"] + 1
        bad, good = (low, high) if s > 0 else (high, low)
        if (bad - held["stop"]) * s <= 0:
            price, why = held["stop"], "stop"
        elif (good - held["target"]) * s >= 0:
            price, why = held["target"], "target"
        elif held["bars"] >= HOLD:
            price, why = close, "timeout"
        else:
            price = None
        if price is not None:
            r = (price - held["entry"]) * s / abs(held["entry"] - held["stop"])
            out.append((symbol, ts, "exit", held["direction"], price, held["stop"], held["target"], why, r))
            state["open"] = None
    elif len(bars) >= PERIOD:
        ranges = [max(h - lo, abs(h - c), abs(lo - c)) for (_, _, c), (h, lo, _) in zip(bars, bars[1:] + [[high, low, close]], strict=True)][-ATR_PERIOD:]
        atr = sum(ranges) / len(ranges)
        top, bottom = max(b[0] for b in bars[-PERIOD:]), min(b[1] for b in bars[-PERIOD:])
        s = 1 if close > top else -1 if close < bottom else 0
        if s and atr > 0:
            held = {"direction": "bullish" if s > 0 else "bearish", "entry": close, "stop": close - s * STOP_ATR * atr, "target": close + s * TARGET_ATR * atr, "bars": 0}
            state["open"] = held
            out.append((symbol, ts, "entry", held["direction"], close, held["stop"], held["target"], None, None))
    state["bars"] = [*bars, [high, low, close]][-(PERIOD + 1) :]
    state["last"] = ts.value
    return out


def _events(state: dict[str, Any], symbol: str, pdf: pd.DataFrame) -> pd.DataFrame:
    rows = [e for b in pdf.sort_values("ts").itertuples(index=False) for e in on_bar(state, symbol, pd.Timestamp(b.ts), b.high, b.low, b.close)]
    return pd.DataFrame(rows, columns=_COLUMNS)


class Positions(StatefulProcessor):
    """Keyed by symbol; an initial state (symbol, state as JSON) warms it up."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("state", "state string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = json.loads(self.held.get()[0]) if self.held.exists() else start()
        yield _events(state, key[0], pd.concat(list(rows)))
        self.held.update((json.dumps(state),))

    def handleInitialState(self, key: Any, initial: pd.DataFrame, timerValues: Any) -> None:  # noqa: N802, N803
        self.held.update((initial["state"].iloc[0],))

    def close(self) -> None:
        pass


def stream_events(bars: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """The events of a stream of bars (symbol, ts, high, low, close). Needs the RocksDB state store."""
    return bars.groupBy("symbol").transformWithStateInPandas(Positions(), EVENTS, "Append", "None", initialState=initial.groupBy("symbol") if initial is not None else None)


def batch_events(bars: DataFrame) -> DataFrame:
    """The same events from a table."""
    return bars.select("symbol", "ts", "high", "low", "close").groupBy("symbol").applyInPandas(lambda pdf: _events(start(), pdf["symbol"].iloc[0], pdf), EVENTS)


def warm_state(bars: DataFrame, days: int = 40) -> DataFrame:
    """symbol and state after the last ``days`` days of a table, without positions: where a cold stream starts."""
    recent = bars.join(bars.groupBy("symbol").agg(F.max("ts").alias("_last")), "symbol").where(F.col("ts") > F.col("_last") - F.expr(f"INTERVAL {days} DAYS"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        state = start()
        _events(state, pdf["symbol"].iloc[0], pdf)
        return pd.DataFrame([(pdf["symbol"].iloc[0], json.dumps(state | {"open": None}))], columns=["symbol", "state"])

    return recent.select("symbol", "ts", "high", "low", "close").groupBy("symbol").applyInPandas(fold, "symbol string, state string")


def alerts(events: DataFrame) -> DataFrame:
    """The lines of entries and exits; heartbeats are skipped. The stream's checkpoint is the cursor."""
    from tidemark.functions.text import alert_line

    line = alert_line(*(F.col(c) for c in ("kind", "symbol", "direction", "price", "stop", "target", "r")))
    return events.where(F.col("kind").isin("entry", "exit")).select("symbol", "ts", line.alias("line"))


def capital_sink(path: str, initial: float = 100.0, fraction: float = 0.01):
    """A foreachBatch function that keeps capital, peak, drawdown and trade count after each exit under ``path``; a batch without exits leaves a heartbeat.

    A batch's rows are written under its number, so one that is run again replaces its own rows.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        exits = batch.where("kind = 'exit'").select("ts", "symbol", "r")
        schema = "batch long, seq long, ts timestamp, symbol string, capital double, peak double, max_drawdown double, kind string"
        last = {"seq": 0, "capital": initial, "peak": initial, "max_drawdown": 0.0}
        if number > 0:
            rows = spark.read.schema(schema).parquet(path).where((F.col("batch") < number) & (F.col("kind") == "exit")).orderBy(F.desc("seq")).limit(1).collect()
            last = rows[0].asDict() if rows else last

        def fold(pdf: pd.DataFrame) -> pd.DataFrame:
            out, seq, capital, peak, worst = [], last["seq"], last["capital"], last["peak"], last["max_drawdown"]
            for e in pdf.sort_values(["ts", "symbol"]).itertuples(index=False):
                seq, capital = seq + 1, capital * (1 + fraction * e.r)
                peak = max(peak, capital)
                worst = max(worst, (peak - capital) / peak)
                out.append((number, seq, e.ts, e.symbol, capital, peak, worst, "exit"))
            return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

        done = exits.groupBy(F.lit(0).alias("book")).applyInPandas(fold, schema)  # a tick's exits: at most one a symbol and bar
        beat = spark.createDataFrame([(number,)], "batch long").join(exits.limit(1).select(F.lit(1).alias("_any")), F.lit(True), "left").where("_any is null")
        beat = beat.select("batch", *[F.lit(None).cast(t).alias(n) for n, t in (("seq", "long"), ("ts", "timestamp"), ("symbol", "string"), ("capital", "double"), ("peak", "double"), ("max_drawdown", "double"))], F.lit("heartbeat").alias("kind"))
        done.unionByName(beat).drop("batch").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink
