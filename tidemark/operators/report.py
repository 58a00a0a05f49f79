"""The report of a book: the whole, its calendar periods, its instruments and its strategies in one pass, their dispersion, and a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import percent_text
from tidemark.operators.metrics import decided, lost, won

_MEASURES = ["n", "n_decided", "win_rate", "expectancy_r", "profit_factor_r", "total_r", "return_pct"]


def sections(trades: DataFrame, unit: str = "year", fraction: float = 0.01, strategy: str | None = None) -> DataFrame:
    """scope (book, period, instrument, strategy, period_instrument), period, symbol, strategy and measures of each group, by grouping sets: the trades are read once.

    ``trades``: symbol, exit_ts, r, result; ``strategy``: a column of the strategies' names, if there is one. return_pct compounds ``fraction`` of the
    balance a trade; win_rate and profit_factor_r are null without a decided trade and without a loss. A book without trades has its row, too.
    """
    kept = [F.date_trunc(unit, "exit_ts").alias("period"), "symbol", F.col(strategy).alias("strategy") if strategy else F.lit(None).cast("string").alias("strategy"), "r", "result"]
    rows = trades.where("result <> 'cancelled' AND r IS NOT NULL").select(*kept, F.lit(True).alias("_trade"))
    rows = rows.unionByName(rows.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]))  # grouping sets give nothing of no rows
    period, symbol, by_strategy = F.col("period"), F.col("symbol"), F.col("strategy")
    sets = [[], [period], [symbol], [period, symbol]] + ([[by_strategy]] if strategy else [])
    win, loss = F.sum(F.when(won(), F.col("r"))), F.sum(F.when(lost(), F.col("r")))
    growth = F.sum(F.log(F.when(1 + fraction * F.col("r") > 0, 1 + fraction * F.col("r"))))
    found = rows.groupingSets(sets, period, symbol, by_strategy).agg(
        F.grouping_id().alias("_g"), F.count("_trade").alias("n"), F.count_if(decided()).alias("n_decided"), F.try_divide(F.count_if(won()), F.count_if(decided())).alias("win_rate"),
        F.avg("r").alias("expectancy_r"), F.try_divide(win, F.abs(loss)).alias("profit_factor_r"), F.sum("r").alias("total_r"), (100 * (F.exp(growth) - 1)).alias("return_pct"),
    )
    scope = F.when(F.col("_g") == 7, "book").when(F.col("_g") == 3, "period").when(F.col("_g") == 5, "instrument").when(F.col("_g") == 6, "strategy").otherwise("period_instrument")
    return found.where("n > 0 OR _g = 7").select(scope.alias("scope"), "period", "symbol", "strategy", *_MEASURES)


def spread(values: Column) -> Column:
    """The sample deviation; of one value, the value itself; of none, null."""
    return F.when(F.count(values) > 1, F.stddev_samp(values)).otherwise(F.max(values))


def dispersion(found: DataFrame) -> DataFrame:
    """One row: over periods, how many, the deviation, best and worst of their returns; over instruments, how many and the deviation of their expectancies."""
    of = lambda scope, c: F.when(F.col("scope") == scope, F.col(c))
    ret, exp = of("period", "return_pct"), of("instrument", "expectancy_r")
    return found.agg(
        F.count(ret).alias("n_periods"), spread(ret).alias("period_std_pct"), F.max(ret).alias("best_period_pct"), F.min(ret).alias("worst_period_pct"),
        F.count(exp).alias("n_instruments"), spread(exp).alias("instrument_std_r"), F.max_by(F.col("symbol"), exp).alias("best_instrument"), F.min_by(F.col("symbol"), exp).alias("worst_instrument"),
    )


def judged(rows: DataFrame, observed: str, low: str, mid: str, high: str, target: float) -> DataFrame:
    """``rows`` with doubles (the observed growth clears the target), reliable (the band's low end is over 0) and the line that says both; without an observed growth the line
    is about the band's middle."""
    point, p5, p95, goal = F.coalesce(F.col(observed), F.col(mid)), F.col(low), F.col(high), f"{target:g}"
    doubles, reliable = F.coalesce(F.col(observed) >= target, F.lit(False)), F.coalesce(p5 > 0, F.lit(False))
    band = F.concat(percent_text(point), F.when(p5.isNotNull() & p95.isNotNull(), F.concat(F.lit(" [P5-P95: "), percent_text(p5), F.lit("-"), percent_text(p95), F.lit("]"))).otherwise(" [no MC band]"))
    # the texts are part of the result's format
    says = F.when(doubles & reliable, "doubles target and survives resampling").when(doubles, "clears target but the MC band includes failure — not yet reliable")
    says = says.when(reliable, f"below the {goal}%/yr target, but the edge is positive").otherwise(f"not at the {goal}%/yr doubling target and not reliable")
    line = F.when(point.isNull(), f"no CAGR data — cannot judge against the {goal}%/yr target").otherwise(F.concat(F.lit("CAGR "), band, F.lit(f" vs {goal}%/yr target: "), says))
    return rows.withColumns({"doubles": doubles, "reliable": reliable, "line": line})


def document(found: DataFrame, over: DataFrame) -> DataFrame:
    """The report as one JSON text: source, book, per period, per instrument and per strategy in order, and the dispersion; a row for each group of ``found`` goes in."""
    row = F.struct(*[F.col(c) for c in _MEASURES])
    part = lambda scope, key: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("scope") == scope, F.struct(F.coalesce(key.cast("string"), F.lit("-")).alias("k"), row.alias("v"))))))
    whole = found.agg(F.max(F.when(F.col("scope") == "book", row)).alias("book"), part("period", F.col("period")).alias("per_period"), part("instrument", F.col("symbol")).alias("per_instrument"), part("strategy", F.col("strategy")).alias("per_strategy"))
    both = whole.join(F.broadcast(over))  # one row each
    return both.select(F.to_json(F.struct("book", "per_period", "per_instrument", "per_strategy", F.struct(*over.columns).alias("dispersion"))).alias("document"))


def index_curve(balances: DataFrame, *by: str) -> DataFrame:
    """Balances (``by``, ts, seq, balance) with index (the first is 100), peak and fall_pct under it: the equity curve as a series."""
    order = Window.partitionBy(*by).orderBy("ts", "seq")
    rows = balances.withColumns({"index": F.try_divide(100 * F.col("balance"), F.first("balance").over(order)), "_peak": F.max("balance").over(order)})
    return rows.select(*by, "ts", "seq", "index", F.try_divide(100 * (F.col("_peak") - F.col("balance")), "_peak").alias("fall_pct"))


def annual_geometric(balances: DataFrame, per_year: float, *by: str) -> DataFrame:
    """Of each book, the growth a year that the mean log return of its steps between positive balances gives at ``per_year`` steps; null without a step."""
    order = Window.partitionBy(*by).orderBy("ts", "seq")
    before = F.lag("balance").over(order)
    steps = balances.select(*by, F.when((before > 0) & (F.col("balance") > 0), F.log(F.col("balance") / F.when(before > 0, before))).alias("_lr"))
    return steps.groupBy(*by).agg(F.count("_lr").alias("n_steps"), (F.exp(F.avg("_lr") * per_year) - 1).alias("annual_return"))
