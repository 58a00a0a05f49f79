"""Portfolio records: returns, risk, exposure and costs of whole books, one row for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.metrics import bucket_returns, decided, drawdowns, elapsed_years, lost, ordered_balances, streaks, won

#: Closes a year where the history tells none.
PERIODS = 252.0


def initial_balance(trades: DataFrame, curve: DataFrame | None, explicit: float | None, *by: str) -> DataFrame:
    """``initial`` and its ``basis``: the explicit one, else the curve's last balance less all pnl, else an index of 100.

    ``curve``: ``by``, ts, balance; its books may be fewer.
    """
    pnl = trades.groupBy(*by).agg(F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("_pnl"))
    if explicit is not None:
        return pnl.select(*by, F.lit(float(explicit)).alias("initial"), F.lit("explicit").alias("basis"))
    if curve is None:
        return pnl.select(*by, F.lit(100.0).alias("initial"), F.lit("default_index").alias("basis"))
    last = curve.where("ts is not null and balance is not null").groupBy(*by).agg(F.max_by("balance", "ts").alias("_final"))
    rows = pnl.join(last, list(by), "left")
    known = F.col("_final").isNotNull()
    return rows.select(*by, F.when(known, F.col("_final") - F.col("_pnl")).otherwise(100.0).alias("initial"), F.when(known, "derived_final_minus_pnl").otherwise("default_index").alias("basis"))


def annual(final: Column, initial: Column, years: Column) -> Column:
    """The compound annual growth rate; null unless all are positive."""
    return F.when((final > 0) & (initial > 0) & (years > 0), F.pow(final / initial, 1 / years) - 1)


def periods_per_year(periods: Column, years: Column, timeframe_bars: float | None = None, explicit: float | None = None) -> tuple[Column, Column]:
    """The factor and its basis: explicit, of the timeframe, as observed (1 at least), or PERIODS."""
    if explicit is not None:
        return F.lit(float(explicit)), F.lit("explicit")
    if timeframe_bars is not None:
        return F.lit(float(timeframe_bars)), F.lit("timeframe_bars_per_year")
    seen = (years > 0) & (periods > 0)
    return F.when(seen, F.greatest(F.lit(1.0), periods / years)).otherwise(PERIODS), F.when(seen, "observed_closes_per_year").otherwise("default_252")


def portfolio(trades: DataFrame, *by: str, initial: float = 100.0, fraction: float = 0.01, deeper: tuple[float, ...] = (1.0, 2.0, 5.0)) -> DataFrame:
    """A record for each book: balances, years and periods, simple and compounded returns and the drag between them, growth a year, best
    and worst month, volatility, Sharpe, Sortino (over losing periods only), Calmar, drawdown and how often it is deeper than thresholds, streaks, the
    balance as an index of the start. Logs of returns are of positive balances.
    """
    balances = ordered_balances(trades, initial, fraction, by)
    at = F.struct("ts", "seq")
    order = Window.partitionBy(*by).orderBy("ts", "seq")
    before = F.lag("balance").over(order)
    rows = balances.withColumn("_lr", F.when((before > 0) & (F.col("balance") > 0), F.log(F.when(before > 0, F.col("balance") / before))))
    years = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / (365.25 * 86400e6)
    own = rows.groupBy(*by).agg(
        F.min_by("balance", at).alias("initial_balance"), F.max_by("balance", at).alias("final_balance"), F.max("seq").alias("periods"), years.alias("years"),
        F.avg("_lr").alias("_mean"), F.stddev_samp("_lr").alias("_sd"), F.sqrt(F.avg(F.when(F.col("_lr") < 0, F.col("_lr") * F.col("_lr")))).alias("_down"), F.max("balance").alias("_top"),
    )
    months = bucket_returns(balances, "month", *by).groupBy(*by).agg(F.sum("ret").alias("_simple"), (F.exp(F.sum(F.log(F.when(F.col("ret") > -1, 1 + F.col("ret"))))) - 1).alias("_all"), F.max("ret").alias("_best"), F.min("ret").alias("_worst"))
    under = drawdowns(balances, *by).groupBy(*by).agg(F.max("depth_pct").alias("_dd"), F.max("depth").alias("_depth"), F.count(F.lit(1)).alias("n_episodes"), *[F.avg((F.col("depth_pct") > t).cast("double")).alias(f"deeper_than_{t:g}") for t in deeper])
    every = own.join(months, list(by)).join(under, list(by), "left").join(streaks(trades, *by), list(by))
    rate, basis = periods_per_year(F.col("periods"), F.col("years"))
    every = every.withColumns({"periods_per_year": rate, "annualization_basis": basis, "_cagr": annual(F.col("final_balance"), F.col("initial_balance"), F.col("years"))})
    year = F.sqrt("periods_per_year")
    pct = lambda c: (100 * F.col(c))
    return every.select(
        *by, "initial_balance", "final_balance", (F.col("final_balance") - F.col("initial_balance")).alias("total_pnl"), ((F.col("final_balance") / F.col("initial_balance") - 1) * 100).alias("total_return_pct"),
        "years", "periods", "periods_per_year", "annualization_basis", pct("_simple").alias("simple_sum_pct"), pct("_all").alias("compounded_pct"), (100 * (F.col("_simple") - F.col("_all"))).alias("drag_pct"), pct("_cagr").alias("cagr_pct"),
        pct("_best").alias("best_month_pct"), pct("_worst").alias("worst_month_pct"), (100 * F.col("_sd") * year).alias("volatility_pct"), (F.try_divide("_mean", "_sd") * year).alias("sharpe"), (F.try_divide("_mean", "_down") * year).alias("sortino"),
        F.when(F.col("_dd") > 0, F.col("_cagr") / (F.col("_dd") / 100)).alias("calmar"), F.coalesce("_dd", F.lit(0.0)).alias("max_drawdown_pct"), F.coalesce("_depth", F.lit(0.0)).alias("largest_fall"), F.coalesce("n_episodes", F.lit(0)).alias("n_episodes"),
        *[F.coalesce(f"deeper_than_{t:g}", F.lit(0.0)).alias(f"deeper_than_{t:g}") for t in deeper], "max_wins", "max_losses", (100 * F.col("_top") / F.col("initial_balance")).alias("top_index"),
    )


def book_exposure(trades: DataFrame, initial: float, *by: str) -> DataFrame:
    """Of each book over its span: most trades and most risk open at once, risk open on average (time-weighted, in percent of ``initial``), instruments
    open on average and the share of time with several. Exits come before entries of their time. trades: ``by``, symbol, submit_ts, exit_ts, risk_amount.
    """
    ends = trades.select(*by, "symbol", F.explode(F.array(F.struct(F.col("submit_ts").alias("t"), F.lit(1).alias("d"), F.col("risk_amount").alias("risk")), F.struct(F.col("exit_ts").alias("t"), F.lit(-1).alias("d"), (-F.col("risk_amount")).alias("risk")))).alias("e")).select(*by, "symbol", "e.*")
    at = ends.groupBy(*by, "symbol", "t").agg(F.sum("d").alias("d"), F.sum("risk").alias("risk"))
    own = Window.partitionBy(*by, "symbol").orderBy("t")
    at = at.withColumn("_open", F.sum("d").over(own))
    at = at.withColumn("_on", (F.col("_open") > 0).cast("int") - F.coalesce((F.lag("_open").over(own) > 0).cast("int"), F.lit(0)))
    at = at.groupBy(*by, "t").agg(F.sum("d").alias("d"), F.sum("risk").alias("risk"), F.sum("_on").alias("on"))
    order = Window.partitionBy(*by).orderBy("t")
    rows = at.withColumns({**{f"_{c}": F.sum(c).over(order) for c in ("d", "risk", "on")}, "_dt": F.unix_micros(F.lead("t").over(order)) - F.unix_micros("t")})
    span = F.sum("_dt")
    mean = lambda c: F.try_divide(F.sum(c * F.col("_dt")), span)
    return rows.groupBy(*by).agg(
        F.max("_d").alias("max_trades"), F.max("_risk").alias("max_risk"), (F.max("_risk") / initial * 100).alias("max_risk_pct"), (mean(F.col("_risk")) / initial * 100).alias("avg_exposure_pct"),
        mean(F.col("_on")).alias("avg_instruments"), (100 * mean((F.col("_on") > 1).cast("int"))).alias("multi_instrument_pct"),
    )


def by_instrument(trades: DataFrame, initial: float, *by: str) -> DataFrame:
    """Of each instrument of a book: trades, wins, losses, win rate, total and mean risk in percent of ``initial``."""
    return trades.groupBy(*by, "symbol").agg(F.count(F.lit(1)).alias("trades"), F.count_if(won()).alias("wins"), F.count_if(lost()).alias("losses"), F.coalesce(F.try_divide(F.count_if(won()), F.count_if(decided())), F.lit(0.0)).alias("win_rate"), F.sum("risk_amount").alias("total_risk"), (F.avg("risk_amount") / initial * 100).alias("mean_risk_pct"))


def gross_vs_net(net: DataFrame, *by: str, initial: float = 100.0, risk: float = 1.0) -> DataFrame:
    """What costs take from each book, from ``metrics.with_costs``: drags of return, growth, expectancy, profit factor and win rate; the signs that flip; win rates to break even.

    A net trade wins or loses by its own pnl; dropped ones are in neither count.
    """
    sides = {"gross": (F.col("r"), F.col("r") * risk), "net": (F.col("net_r"), F.col("net_pnl"))}
    aggs = [(elapsed_years()).alias("years")]
    for k, (r, pnl) in sides.items():
        up, down = F.when(r > 1e-12, r), F.when(r < -1e-12, -r)
        aggs += [
            (F.sum(pnl) / initial).alias(f"{k}_return"), F.avg(r).alias(f"{k}_expectancy"), F.try_divide(F.sum(up), F.sum(down)).alias(f"{k}_pf"),
            F.try_divide(F.count(up), F.count(up) + F.count(down)).alias(f"{k}_wr"), F.try_divide(F.avg(down), F.avg(up) + F.avg(down)).alias(f"{k}_even"),
        ]
    rows = net.groupBy(*by).agg(*aggs)
    rows = rows.withColumns({f"{k}_cagr": annual(1 + F.col(f"{k}_return"), F.lit(1.0), F.col("years")) for k in sides})
    drag = lambda c: F.col(f"gross_{c}") - F.col(f"net_{c}")
    flips = [("return", (F.col("gross_return") > 0) & (F.col("net_return") <= 0)), ("cagr", (F.col("gross_cagr") > 0) & (F.col("net_cagr") < 0)), ("expectancy", (F.col("gross_expectancy") > 0) & (F.col("net_expectancy") <= 0)), ("profit_factor", (F.col("gross_pf") >= 1) & (F.col("net_pf") < 1))]
    return rows.select(
        *by, (100 * drag("return")).alias("return_drag_pct"), (100 * drag("cagr")).alias("cagr_drag_pct"), drag("expectancy").alias("expectancy_drag_r"), drag("pf").alias("profit_factor_drag"), (100 * drag("wr")).alias("win_rate_drag_pp"),
        F.array_join(F.filter(F.array(*[F.when(hit, name) for name, hit in flips]), lambda x: x.isNotNull()), ",").alias("sign_flips"),
        F.col("gross_even").alias("break_even_gross"), F.col("net_even").alias("break_even_net"), (100 * (F.col("net_even") - F.col("gross_wr"))).alias("required_lift_pp"),
    )


COSTS = ("flat", "rate", "slip_entry", "slip_exit", "slip_stop", "step")


def cost_schedules(rows: DataFrame) -> DataFrame:
    """Cost schedules of JSON texts (schedule): their numbers, 0 where one is left out, and ``error``: not_json, unknown_key, not_a_number, negative or rate_over_1."""
    given = F.from_json("schedule", "map<string, string>")
    unknown = F.size(F.array_except(F.map_keys(given), F.array(*[F.lit(c) for c in COSTS]))) > 0
    number = {c: F.try_element_at(given, F.lit(c)).try_cast("double") for c in COSTS}
    odd = F.exists(F.map_values(given), lambda v: v.try_cast("double").isNull() | F.isnan(v.try_cast("double")))
    error = F.when(given.isNull() | (F.map_keys(given).isNull()), "not_json").when(unknown, "unknown_key").when(odd, "not_a_number").when(F.exists(F.map_values(given), lambda v: v.try_cast("double") < 0), "negative").when(number["rate"] > 1, "rate_over_1")
    return rows.withColumns({**{c: F.coalesce(x, F.lit(0.0)) for c, x in number.items()}, "error": error})
