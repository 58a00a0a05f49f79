"""Outcomes of candidates, found in the bars after them: every candidate by itself, then those that a lane takes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.candidates import sign
from tidemark.operators.joins import within_bars

_BAR = ["bar_idx", "ts", "open", "high", "low", "close"]


def with_future(candidates: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """``future``: the bars after each candidate (symbol, bar_idx), ``horizon`` at most, in order."""
    points = candidates.withColumn("point_idx", F.col("bar_idx"))
    keys = ["symbol", "point_idx", "candidate_id"]
    near = within_bars(points.select(*keys), bars.select("symbol", *_BAR), -1, horizon)
    future = near.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*_BAR))).alias("future"))
    return points.join(future, keys, "left").drop("point_idx").withColumn("future", F.coalesce("future", F.array().cast(future.schema["future"].dataType)))


def _ahead(bar: Column, s: Column, column: str, against: str) -> Column:
    """The bar's extreme in the trade's favour (column for longs, against for shorts)."""
    return F.when(s > 0, bar[column]).otherwise(bar[against])


def next_open_fill(rows: DataFrame, max_gap_atr: float = 1.0, slip_pct: float = 0.0) -> DataFrame:
    """Entry at the next bar's open: cancelled for too wide a gap or an open at or past stop or target; else stop and reward are kept.

    Adds fill_state; entry, target and future are moved to the fill.
    """
    s, first = sign(F.col("direction")), F.try_element_at("future", F.lit(1))
    price = first["open"] * (1 + s * slip_pct / 100)
    bad = F.when(first.isNull(), "no_bar").when(F.abs(first["open"] - F.col("entry")) > max_gap_atr * F.col("atr"), "gap").when((price - F.col("stop")) * s <= 0, "past_stop").when((price - F.col("target")) * s >= 0, "past_target")
    rr = F.try_divide(F.abs(F.col("target") - F.col("entry")), F.abs(F.col("entry") - F.col("stop")))
    rows = rows.withColumns({"fill_state": F.coalesce(bad, F.lit("filled")), "_e": price, "_rr": rr})
    filled = F.col("fill_state") == "filled"
    return rows.withColumns({"target": F.when(filled, F.col("_e") + s * F.col("_rr") * F.abs(F.col("_e") - F.col("stop"))).otherwise(F.col("target")), "entry": F.when(filled, F.col("_e")).otherwise(F.col("entry"))}).drop("_e", "_rr")


def touch_fill(rows: DataFrame, max_days: int | None = None) -> DataFrame:
    """Entry once a later bar touches it, unless ``max_days`` calendar days pass before; the future then begins with that bar. Adds fill_state."""
    s = sign(F.col("direction"))
    hit = F.filter("future", lambda b: F.when(s > 0, b["high"] >= F.col("entry")).otherwise(b["low"] <= F.col("entry")))
    first = F.try_element_at(hit, F.lit(1))
    late = F.lit(False) if max_days is None else F.datediff(first["ts"], F.col("ts")) >= max_days
    state = F.when(first.isNull(), "expired").when(late, "expired").otherwise("filled")
    return rows.withColumns({"fill_state": state, "future": F.when(state == "filled", F.filter("future", lambda b: b["bar_idx"] >= first["bar_idx"])).otherwise(F.col("future"))})


def label(rows: DataFrame, breakeven_rr: float | None = None, scale: tuple[float, float, float | None, float | None] | None = None, max_days: int | None = None) -> DataFrame:
    """exit_idx, exit_ts, exit_price, exit_reason, r, mfe_r, mae_r of candidates with their future.

    On a bar the stop is tested first, then what arms, then the target. ``breakeven_rr``: from the bar after that reward is reached, the stop
    is the entry. ``scale``: (part, reward, trail, runner target): the part is banked at the reward, the rest has its stop at the
    entry, or behind the best price by ``trail`` times the risk if that is closer, and its own target. ``max_days``: held so many calendar days
    at most. Without an exit, the last bar's close counts as a timeout; without any bar there is no outcome. R is in units of the first risk.
    """
    s, entry, stop, target = sign(F.col("direction")), F.col("entry"), F.col("stop"), F.col("target")
    risk = F.abs(entry - stop)
    price = lambda r: entry + s * r * risk
    part, at, trail, runner = scale or (0.0, 0.0, None, None)
    none = F.lit(None)
    first = F.struct(
        F.lit(False).alias("armed"), F.lit(False).alias("done"), none.cast("long").alias("idx"), none.cast("timestamp").alias("ts"), none.cast("double").alias("price"),
        none.cast("string").alias("why"), F.lit(0.0).alias("banked"), entry.cast("double").alias("best"), F.lit(0.0).alias("mfe"), F.lit(0.0).alias("mae"),
    )

    def step(a: Column, b: Column) -> Column:
        good, bad = _ahead(b, s, "high", "low"), _ahead(b, s, "low", "high")
        reached = lambda p: (good - p) * s >= 0
        lost = lambda p: (bad - p) * s <= 0
        best = F.when(s > 0, F.greatest(a["best"], good)).otherwise(F.least(a["best"], good))
        held = F.datediff(b["ts"], F.col("ts")) >= max_days if max_days is not None else F.lit(False)
        if scale:
            tight = F.when(s > 0, F.greatest(entry, best - trail * risk)).otherwise(F.least(entry, best + trail * risk)) if trail is not None else entry
            now = a["armed"] | reached(price(at))
            end = price(runner) if runner is not None else target
            why = F.when(~a["armed"] & lost(stop), "stop").when(now & lost(tight), "runner_stop").when(now & reached(end), "target").when(held, "timeout")
            exit_price = F.when(why == "stop", stop).when(why == "runner_stop", tight).when(why == "target", end).otherwise(b["close"])
            armed = now & ~((why == "stop") & why.isNotNull())
        elif breakeven_rr is not None:
            active = F.when(a["armed"], entry).otherwise(stop)
            armed = a["armed"] | reached(price(breakeven_rr))
            why = F.when(lost(active), F.when(a["armed"], "breakeven").otherwise("stop")).when(reached(target), "target").when(held, "timeout")
            exit_price = F.when(why.isin("stop", "breakeven"), active).when(why == "target", target).otherwise(b["close"])
        else:
            armed = a["armed"]
            why = F.when(lost(stop), "stop").when(reached(target), "target").when(held, "timeout")
            exit_price = F.when(why == "stop", stop).when(why == "target", target).otherwise(b["close"])
        moved = F.struct(
            armed.alias("armed"), why.isNotNull().alias("done"), b["bar_idx"].alias("idx"), b["ts"].alias("ts"), exit_price.cast("double").alias("price"), why.alias("why"),
            F.when(armed & ~a["armed"], F.lit(part * at)).otherwise(a["banked"]).alias("banked"), best.alias("best"),
            F.greatest(a["mfe"], (good - entry) * s / risk).alias("mfe"), F.greatest(a["mae"], (entry - bad) * s / risk).alias("mae"),
        )
        return F.when(a["done"], a).otherwise(moved)

    rows = rows.where(F.size("future") > 0).withColumn("_o", F.aggregate("future", first, step))
    left = F.when(F.col("_o.armed"), F.lit(1.0 - part)).otherwise(F.lit(1.0)) if scale else F.lit(1.0)
    r = F.col("_o.banked") + left * (F.col("_o.price") - entry) * s / risk
    return rows.withColumns(
        {"exit_idx": F.col("_o.idx"), "exit_ts": F.col("_o.ts"), "exit_price": F.col("_o.price"), "exit_reason": F.coalesce("_o.why", F.lit("timeout")), "r": r, "mfe_r": F.col("_o.mfe"), "mae_r": F.col("_o.mae"), "result": F.when(r > 1e-12, "win").when(r < -1e-12, "loss").otherwise("breakeven")}
    ).drop("_o", "future")


def _take(exclusive: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bar_idx", "candidate_id"], ignore_index=True)
        free, taken = -1, []
        for start, end in zip(pdf["bar_idx"], pdf["exit_idx"], strict=True):
            ok = start > free if exclusive else start >= free
            taken.append(ok)
            if ok:
                free = end
        return pdf[taken]

    return run


def _islands(rows: DataFrame, by: list[str], start: str, end: str, order: list[str], touching: bool) -> DataFrame:
    """``rows`` with _island: a new one begins where all before it in ``by`` have ended (at or, not ``touching``, before its start)."""
    window = Window.partitionBy(*by).orderBy(start, *order)
    reach = F.max(end).over(window.rowsBetween(Window.unboundedPreceding, -1))
    free = F.col(start) >= reach if touching else F.col(start) > reach
    return rows.withColumn("_new", F.coalesce(free, F.lit(True)).cast("int")).withColumn("_island", F.sum("_new").over(window)).drop("_new")


def lanes(labelled: DataFrame, exclusive: bool = True) -> DataFrame:
    """The candidates that a symbol's lane takes: in order, each that comes after the last one's exit (or, not ``exclusive``, on its bar).

    Where a candidate comes after all exits before it, the lane is free whatever was taken: the fold goes by such islands, not by whole symbols.
    """
    parts = _islands(labelled, ["symbol"], "bar_idx", "exit_idx", ["candidate_id"], not exclusive)
    take = _take(exclusive)
    return parts.groupBy("symbol", "_island").applyInPandas(lambda pdf: take(pdf).drop(columns="_island"), labelled.schema)


def compounded(trades: DataFrame, fraction: float = 0.01, initial: float = 100.0, by: list[str] | None = None) -> DataFrame:
    """The balance after each trade, sized at the balance of its entry, for trades that don't overlap: seq, balance, peak.

    ``by``: the books. A loss that takes all leaves nothing.
    """
    books = by or ["symbol"]
    order = Window.partitionBy(*books).orderBy("exit_ts", "candidate_id")
    growth = F.greatest(F.lit(0.0), 1 + fraction * F.col("r"))
    ruined = F.max((growth <= 0).cast("int")).over(order) == 1
    rows = trades.withColumn("seq", F.row_number().over(order).cast("long"))
    rows = rows.withColumn("balance", F.when(ruined, 0.0).otherwise(initial * F.exp(F.sum(F.log(F.when(growth > 0, growth).otherwise(1.0))).over(order))))
    return rows.withColumn("peak", F.greatest(F.lit(initial), F.max("balance").over(order)))


def ledger(trades: DataFrame, fraction: float = 0.01, initial: float = 100.0, by: list[str] | None = None) -> DataFrame:
    """As ``compounded``, but for trades that may overlap: risk is sized when a trade is submitted, closes before submits at one time.

    Between trades that all earlier ones have left behind, what is won or lost is a share of the balance there: each such island of overlapping trades is
    folded from a balance of 1, wherever it lies, and a window over the islands multiplies them up. A balance of nothing or less stays.
    """
    books = by or ["book"]
    rows = trades if by else trades.withColumn("book", F.lit("all"))
    rows = rows.select(*books, "candidate_id", F.col("ts").alias("submit_ts"), "exit_ts", "r")
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", _island long, _k long, _risk double, _share double, _end double"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        events = sorted([(t, 1, i) for i, t in enumerate(pdf["submit_ts"])] + [(t, 0 if t > s else 2, i) for i, (s, t) in enumerate(zip(pdf["submit_ts"], pdf["exit_ts"], strict=True))], key=lambda e: (e[0], e[1], pdf["candidate_id"][e[2]]))
        share, risk, done = 1.0, {}, []
        for _, kind, i in events:
            if kind == 1:
                risk[i] = max(0.0, share) * fraction
                continue
            share += pdf["r"][i] * risk[i]
            done.append((i, risk[i], share))
        at = pdf.iloc[[d[0] for d in done]].reset_index(drop=True)
        return at.assign(_k=range(len(done)), _risk=[d[1] for d in done], _share=[d[2] for d in done], _end=share)

    # one that is submitted as the last one closes stays in its island: a trade of no length closes after what is submitted with it
    parts = _islands(rows, books, "submit_ts", "exit_ts", ["candidate_id"], False)
    done = parts.groupBy(*books, "_island").applyInPandas(fold, out)
    begun = Window.partitionBy(*books).orderBy("_island").rangeBetween(Window.unboundedPreceding, -1)  # all islands before
    share = F.when(F.col("_k") == 0, F.col("_end"))  # once an island
    own = initial * F.exp(F.coalesce(F.sum(F.log(F.when(share > 0, share))).over(begun), F.lit(0.0)))
    done = done.withColumn("_own", own).withColumn("_left", F.first(F.when(share <= 0, F.col("_own") * share), ignorenulls=True).over(begun))
    ruined = F.col("_left").isNotNull()
    done = done.withColumns({"risk": F.when(ruined, 0.0).otherwise(F.col("_own") * F.col("_risk")), "balance": F.when(ruined, F.col("_left")).otherwise(F.col("_own") * F.col("_share"))})
    order = Window.partitionBy(*books).orderBy("_island", "_k")
    done = done.withColumns({"seq": F.row_number().over(order).cast("long"), "peak": F.greatest(F.lit(initial), F.max("balance").over(order))})
    return done.select(*rows.columns, "seq", "risk", "balance", "peak")
