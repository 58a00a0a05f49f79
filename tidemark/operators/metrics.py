"""Statistics of trades and of balances.

``trades``: symbol, direction, result, exit_reason, r, mfe_r, mae_r, submit_ts, exit_ts, entry, stop, candidate_id. ``by``: the
columns that tell books apart; each function is one grouped aggregation or one window over a book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timeframes import hours_between

def decided() -> Column:
    return F.col("result").isin("win", "loss")


def won() -> Column:
    return F.col("result") == "win"


def lost() -> Column:
    return F.col("result") == "loss"


def elapsed_years() -> Column:
    """The years between a group's first and last exit."""
    return (F.unix_micros(F.max("exit_ts")) - F.unix_micros(F.min("exit_ts"))) / (365.25 * 86400e6)


def risk_fraction(trades: DataFrame, initial: float, *by: str) -> DataFrame:
    """The share of the initial balance that decided trades risk on average: one half at most, one hundredth where none is known."""
    mean = F.avg(F.when(decided() & (F.col("risk_amount") > 0), F.col("risk_amount"))) / initial
    return trades.groupBy(*by).agg(F.when(mean > 0, F.least(mean, F.lit(0.5))).otherwise(0.01).alias("risk_fraction"))


def counts(trades: DataFrame, *by: str) -> DataFrame:
    """How many of each result; filled and decided; the share of wins among decided and among filled."""
    n = {r: F.count_if(F.col("result") == r) for r in ("win", "loss", "breakeven", "cancelled")}
    filled, clear = F.count_if(F.col("result") != "cancelled"), F.count_if(decided())
    return trades.groupBy(*by).agg(*[c.alias(f"n_{r}") for r, c in n.items()], filled.alias("n_filled"), clear.alias("n_decided"), F.try_divide(n["win"], clear).alias("win_rate"), F.try_divide(n["win"], filled).alias("filled_win_rate"))


def r_summary(trades: DataFrame, *by: str) -> DataFrame:
    """Mean and median R of wins and losses, payoff, expectancy over all closed and over decided, profit factor (null without a loss), Kelly share."""
    win, loss = F.when(won(), F.col("r")), F.when(lost(), F.col("r"))
    out = trades.where("result <> 'cancelled'").groupBy(*by).agg(
        F.avg(win).alias("avg_win_r"), F.median(win).alias("median_win_r"), F.avg(loss).alias("avg_loss_r"), F.median(loss).alias("median_loss_r"),
        F.avg("r").alias("expectancy_all"), F.avg(F.when(decided(), F.col("r"))).alias("expectancy_decided"), F.sum(win).alias("gross_win_r"), F.sum(loss).alias("gross_loss_r"), F.try_divide(F.count_if(won()), F.count_if(decided())).alias("win_rate"),
    )
    payoff = F.try_divide(F.col("avg_win_r"), F.abs("avg_loss_r"))
    kelly = F.col("win_rate") - F.try_divide(1 - F.col("win_rate"), F.col("payoff"))
    out = out.withColumn("payoff", payoff).withColumn("profit_factor", F.try_divide("gross_win_r", F.abs("gross_loss_r")))
    return out.withColumn("kelly", F.greatest(F.lit(0.0), F.least(F.lit(1.0), kelly)))


def r_distribution(trades: DataFrame, *by: str) -> DataFrame:
    p = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    q = F.percentile("r", F.array(*[F.lit(x) for x in p]))
    moments = [F.when((F.count("r") >= 3) & (F.stddev_pop("r") > 0), f("r")).alias(n) for n, f in (("skew", F.skewness), ("excess_kurtosis", F.kurtosis))]
    out = trades.where("r is not null").groupBy(*by).agg(F.count("r").alias("n"), F.min("r").alias("lowest"), F.max("r").alias("highest"), q.alias("_q"), *moments)
    return out.select("*", *[F.col("_q")[i].alias(f"p{round(100 * x)}") for i, x in enumerate(p)]).drop("_q")


def histogram(df: DataFrame, value: str, bins: int, *by: str) -> DataFrame:
    """Counts in ``bins`` bins of equal width from the least to the greatest value, which is in the last; one bin if they are equal."""
    ends = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    rows = df.where(F.col(value).isNotNull()).join(ends, list(by)) if by else df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    return rows.groupBy(*by, at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def duration(trades: DataFrame, *by: str) -> DataFrame:
    """Hours from submission to exit: mean and median, by result and in all."""
    rows = trades.withColumn("_h", hours_between(F.col("submit_ts"), F.col("exit_ts"))).where("_h is not null")
    agg = [F.avg("_h").alias("mean_hours"), F.median("_h").alias("median_hours"), F.count(F.lit(1)).alias("n")]
    return rows.groupBy(*by, "result").agg(*agg).unionByName(rows.groupBy(*by).agg(*agg).withColumn("result", F.lit("all")))


def exit_quality(trades: DataFrame, levels: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """For each level: winners whose best was over it but that closed under it, and what winners left on the table."""
    wins = trades.where(won() & F.col("mfe_r").isNotNull())
    rows = wins.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    left = F.col("mfe_r") - F.col("r")
    return rows.groupBy("level").agg(F.count_if((F.col("mfe_r") >= F.col("level")) & (F.col("r") < F.col("level"))).alias("n_gave_back"), F.count(F.lit(1)).alias("n_wins"), F.avg(left).alias("mean_left_r"), F.median(left).alias("median_left_r"))


def adverse(trades: DataFrame, *by: str) -> DataFrame:
    return trades.where("mae_r is not null").groupBy(*by).agg(F.avg("mae_r").alias("mean_mae"), F.median("mae_r").alias("median_mae"), F.percentile("mae_r", F.lit(0.95)).alias("p95_mae"), F.median(F.when(lost(), F.col("mae_r"))).alias("median_loser_mae"))


def exit_breakdown(trades: DataFrame, *by: str) -> DataFrame:
    rows = trades.groupBy(*by, "exit_reason").agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.count_if(won()), F.count_if(decided())).alias("win_rate"), F.avg("r").alias("avg_r"))
    total = trades.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    rows = rows.join(total, list(by)) if by else rows.crossJoin(F.broadcast(total))
    return rows.withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def frequency(trades: DataFrame, *by: str) -> DataFrame:
    """Trades a day, week and month over the span from the first submission to the last exit."""
    out = trades.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), ((F.unix_micros(F.max("exit_ts")) - F.unix_micros(F.min("submit_ts"))) / 86.4e9).alias("days"))
    return out.select("*", *[F.try_divide(F.col("n") * x, "days").alias(n) for n, x in (("per_day", 1.0), ("per_week", 7.0), ("per_month", 30.4375))])


def reach(trades: DataFrame, levels: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """The share of filled trades that reached each R, closed or at best, by direction and in all."""
    rows = trades.where("result <> 'cancelled'").withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    agg = [F.avg((F.col("r") >= F.col("level")).cast("double")).alias("realized"), F.avg((F.col("mfe_r") >= F.col("level")).cast("double")).alias("at_best"), F.count(F.lit(1)).alias("n")]
    return rows.groupBy("direction", "level").agg(*agg).unionByName(rows.groupBy("level").agg(*agg).withColumn("direction", F.lit("all")))


def monthly(trades: DataFrame, initial: float = 100.0, fraction: float = 0.01) -> DataFrame:
    """For each symbol and month from its first exit to its last, empty ones too: trades, wins, pnl at a fixed risk, growth on the balance that it began with."""
    month = F.date_trunc("month", "exit_ts")
    pnl = F.col("r") * initial * fraction
    held = trades.groupBy("symbol", month.alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count_if(won()).alias("wins"), F.sum(pnl).alias("pnl"))
    span = held.groupBy("symbol").agg(F.explode(F.sequence(F.min("month"), F.max("month"), F.expr("INTERVAL 1 MONTH"))).alias("month"))
    rows = span.join(held, ["symbol", "month"], "left").fillna({"n": 0, "wins": 0, "pnl": 0.0})
    before = Window.partitionBy("symbol").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    start = initial + F.coalesce(F.sum("pnl").over(before), F.lit(0.0))
    return rows.withColumn("growth_pct", F.try_divide(F.col("pnl") * 100, start))


def ordered_balances(trades: DataFrame, initial: float = 100.0, fraction: float = 0.01, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The balance at a fixed risk after each trade, from a start point (seq 0) at the first exit on."""
    order = Window.partitionBy(*by).orderBy("exit_ts", "candidate_id")
    rows = trades.select(*by, F.col("exit_ts").alias("ts"), F.row_number().over(order).cast("long").alias("seq"), (initial + F.sum(F.col("r") * initial * fraction).over(order)).alias("balance"))
    start = F.struct("ts", F.lit(0).cast("long").alias("seq"), F.lit(initial).alias("balance"))
    own = F.struct("ts", "seq", "balance")
    return rows.select(*by, F.explode(F.when(F.col("seq") == 1, F.array(start, own)).otherwise(F.array(own))).alias("_p")).select(*by, "_p.*")


def drawdowns(balances: DataFrame, *by: str) -> DataFrame:
    """Episodes under a peak: a point at or over the peak ends one. Depth, its length to the trough and back in points; recovery is null while open."""
    order = Window.partitionBy(*by).orderBy("ts", "seq")
    peak = F.max("balance").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = balances.withColumn("_top", F.coalesce(F.col("balance") >= peak, F.lit(True)))
    rows = rows.withColumns({"_episode": F.sum(F.col("_top").cast("int")).over(order), "_i": F.row_number().over(order), "_last": F.lead("ts").over(order).isNull()})
    at = F.struct("balance", "_i")
    found = rows.groupBy(*by, "_episode").agg(F.max(F.when(F.col("_top"), F.col("balance"))).alias("peak"), F.min(at).alias("_low"), F.min("_i").alias("_from"), F.max("_i").alias("_to"), F.count(F.lit(1)).alias("_n"), F.max("_last").alias("_open"))
    found = found.where("_n > 1")
    return found.select(
        *by, F.col("_from").cast("long").alias("start"), "peak", F.col("_low.balance").alias("trough"), (F.col("peak") - F.col("_low.balance")).alias("depth"),
        F.try_divide((F.col("peak") - F.col("_low.balance")) * 100, "peak").alias("depth_pct"), (F.col("_low._i") - F.col("_from")).cast("long").alias("duration"), F.when(~F.col("_open"), F.col("_to") + 1 - F.col("_low._i")).cast("long").alias("recovery"),
    )


def deeper_than(episodes: DataFrame, thresholds: tuple[float, ...], *by: str) -> DataFrame:
    rows = episodes.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return rows.groupBy(*by, "threshold").agg(F.avg((F.col("depth_pct") > F.col("threshold")).cast("double")).alias("share"))


def bucket_returns(balances: DataFrame, unit: str, *by: str) -> DataFrame:
    """The return of each calendar bucket that has a point, against the last balance before it."""
    last = balances.groupBy(*by, F.date_trunc(unit, "ts").alias("bucket")).agg(F.max_by("balance", F.struct("ts", "seq")).alias("_last"), F.min_by("balance", F.struct("ts", "seq")).alias("_first"))
    before = F.coalesce(F.lag("_last").over(Window.partitionBy(*by).orderBy("bucket")), F.col("_first"))
    return last.select(*by, "bucket", (F.try_divide(F.col("_last"), before) - 1).alias("ret"))


def ratios(returns: DataFrame, per_year: float, *by: str, mar: float = 0.0) -> DataFrame:
    """Of period returns: compounded and annual geometric return, volatility, Sharpe (sample deviation) and Sortino (over the periods below ``mar`` only)."""
    under = F.when(F.col("ret") < mar, F.pow(F.lit(mar) - F.col("ret"), 2))
    logs = F.sum(F.log(F.when(F.col("ret") > -1, 1 + F.col("ret"))))
    out = returns.where("ret is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("_sd"), F.sqrt(F.avg(under)).alias("_down"), logs.alias("_logs"), F.max("ret").alias("best"), F.min("ret").alias("worst"))
    year = per_year**0.5
    return out.select(
        *by, "n", (F.exp("_logs") - 1).alias("compounded"), (F.exp(F.col("_logs") / F.col("n") * per_year) - 1).alias("annual"), (F.col("_sd") * year).alias("volatility"),
        (F.try_divide("mean", "_sd") * year).alias("sharpe"), (F.try_divide(F.col("mean") - mar, "_down") * year).alias("sortino"), "best", "worst",
    )


def streaks(trades: DataFrame, *by: str) -> DataFrame:
    """The longest runs of wins and of losses; any other result breaks both."""
    order = Window.partitionBy(*by).orderBy("exit_ts", "candidate_id")
    new = F.coalesce(F.lag("result").over(order) != F.col("result"), F.lit(True)).cast("int")
    runs = trades.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order)).groupBy(*by, "_run", "result").agg(F.count(F.lit(1)).alias("_n"))
    longest = lambda r: F.coalesce(F.max(F.when(F.col("result") == r, F.col("_n"))), F.lit(0))
    return runs.groupBy(*by).agg(longest("win").alias("max_wins"), longest("loss").alias("max_losses"))


def exposure(trades: DataFrame, *by: str) -> DataFrame:
    """Trades open at a time: the most, the time-weighted mean, and the share of the span with more than one open. Exits come before entries of their time."""
    ends = trades.select(*by, F.explode(F.array(F.struct(F.col("submit_ts").alias("t"), F.lit(1).alias("d")), F.struct(F.col("exit_ts").alias("t"), F.lit(-1).alias("d")))).alias("e")).select(*by, "e.*")
    at = ends.groupBy(*by, "t").agg(F.sum("d").alias("d"))
    order = Window.partitionBy(*by).orderBy("t")
    rows = at.withColumns({"open": F.sum("d").over(order), "_dt": (F.unix_micros(F.lead("t").over(order)) - F.unix_micros("t")) / 3.6e9})
    span = F.sum("_dt")
    return rows.groupBy(*by).agg(F.max("open").alias("max_open"), F.try_divide(F.sum(F.col("open") * F.col("_dt")), span).alias("avg_open"), F.try_divide(F.sum(F.when(F.col("open") > 1, F.col("_dt")).otherwise(0.0)), span).alias("share_several"))


def with_costs(trades: DataFrame, flat: float = 0.0, rate: float = 0.0, slip_entry: float = 0.0, slip_exit: float = 0.0, slip_stop: float = 0.0, step: float = 0.0, risk: float = 1.0) -> DataFrame:
    """net_pnl and net_r after commission, slippage (in percent of notional) and rounding of the size down to ``step``; dropped: too small for one step.

    Costs: flat, rate times both legs' notional, slippage of each leg, and the stop's slippage on stopped trades. Cancelled trades pay nothing.
    """
    if min(flat, rate, slip_entry, slip_exit, slip_stop, step) < 0 or rate > 1:
        raise ValueError("costs can't be negative, nor a rate over 1")
    raw = F.lit(risk) / F.abs(F.col("entry") - F.col("stop"))
    size = F.floor(raw / step + 1e-12) * step if step else raw
    rows = trades.withColumns({"_raw": raw, "size": size})
    pnl = F.col("r") * risk
    s = F.when(F.col("direction") == "bullish", 1.0).otherwise(-1.0)
    leave = F.col("entry") + s * pnl / F.col("_raw")
    n_in, n_out = F.col("size") * F.col("entry"), F.col("size") * leave
    cost = flat + rate * (n_in + n_out) + (slip_entry * n_in + slip_exit * n_out) / 100 + F.when(F.col("exit_reason") == "stop", slip_stop * n_in / 100).otherwise(0.0)
    free, dropped = F.col("result") == "cancelled", F.col("size") <= 0
    part = F.col("size") / F.col("_raw")
    cost = F.when(free | dropped, 0.0).otherwise(cost)
    net = F.when(dropped | free, 0.0).otherwise(pnl * part - cost)
    rows = rows.withColumns({"cost": cost, "net_pnl": net, "dropped": dropped})
    return rows.withColumn("net_r", F.when(~dropped, F.try_divide(F.col("net_pnl"), risk * part))).drop("_raw")


def cost_summary(net: DataFrame, *by: str) -> DataFrame:
    kept = ~F.col("dropped")
    flips = F.count_if(kept & (F.col("r") > 0) & (F.col("net_r") <= 0))
    return net.groupBy(*by).agg(F.sum("cost").alias("total_cost"), F.count_if("dropped").alias("n_dropped"), F.avg(F.when(kept, F.col("r"))).alias("gross_expectancy"), F.avg("net_r").alias("net_expectancy"), flips.alias("n_flipped"))


def break_even_win_rate(payoff: Column) -> Column:
    return F.try_divide(F.lit(1.0), 1 + payoff)


def study_stats(trades: DataFrame, cost_r: float, *by: str) -> DataFrame:
    """n, win percentage, mean R before and after a cost, its 95 % half-width and t-value."""
    out = trades.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (100 * F.try_divide(F.count_if(won()), F.count_if(decided()))).alias("win_pct"), F.avg("r").alias("mean_r"), F.stddev_samp("r").alias("_sd"))
    se = F.try_divide(F.col("_sd"), F.sqrt("n"))
    return out.select(*by, "n", "win_pct", "mean_r", (F.col("mean_r") - cost_r).alias("mean_net_r"), (1.96 * se).alias("half_width"), F.try_divide(F.col("mean_r"), se).alias("t_value"))


def study_costs(trades: DataFrame, spread: float = 0.001, stop_atr: float = 1.5, *by: str) -> DataFrame:
    """A spread in units of R, by the median of atr / entry; the shares of exits in percent; mean R with and without what ran out of time, before and after the cost."""
    cost = spread / (stop_atr * F.median(F.col("atr") / F.col("entry")))
    part = lambda r: (100 * F.avg((F.col("exit_reason") == r).cast("double"))).alias(f"{r}_pct")
    out = trades.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), cost.alias("cost_r"), *[part(r) for r in ("target", "stop", "timeout")], F.avg("r").alias("mean_r"), F.avg(F.when(F.col("exit_reason") != "timeout", F.col("r"))).alias("mean_in_time_r"))
    return out.withColumn("mean_net_r", F.col("mean_r") - F.col("cost_r"))
