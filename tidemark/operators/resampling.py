"""Bootstrap, shuffles, splits and verdicts over decided trades.

Draws are hashes of (seed, simulation, position), so they are independent, the same on any cluster, and need no state; simulations are
rows, joined to the trades by number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.metrics import decided, elapsed_years

#: Log balances stay within this, as exp() does.
LOG_RANGE = 709.0


def numbered(trades: DataFrame) -> DataFrame:
    """The decided trades, numbered from 0 by exit, with their count: each day's trades are numbered in a task, and the days' counts, a row a day, put before."""
    rows = trades.where(decided() & F.col("r").isNotNull() & F.col("exit_ts").isNotNull()).withColumn("_day", F.date_trunc("day", "exit_ts"))
    days = rows.groupBy("_day").agg(F.count(F.lit(1)).alias("_m"))
    order = Window.orderBy("_day")
    before = F.coalesce(F.sum("_m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("_m").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    inside = F.row_number().over(Window.partitionBy("_day").orderBy("exit_ts", "candidate_id"))
    rows = rows.withColumn("_i", inside).join(days.select("_day", before.alias("_first"), whole.alias("n")), "_day")
    return rows.withColumn("i", (F.col("_first") + F.col("_i") - 1).cast("long")).drop("_day", "_first", "_i")


def _draws(rows: DataFrame, sims: int) -> DataFrame:
    """sim, n (the trades there are) and k, from 0 to n."""
    size = rows.agg(F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("n"))
    each = rows.sparkSession.range(sims).withColumnRenamed("id", "sim").crossJoin(F.broadcast(size)).where("n > 0")
    each = each.repartition(F.col("sim"))
    return each.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))


def drawn_index(seed: Column, n: Column) -> Column:
    """A number below ``n`` for each seed, sim and k: 32 bits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", seed, "sim", "k").cast("binary")), 1, 8), 16, 10).cast("long") % n


def simulated(rows: DataFrame, sims: int = 1000, fraction: float = 0.01, seed: int = 42) -> DataFrame:
    """Draws with replacement: sim, k, r and the log of the growth so far. ``rows``: from ``numbered``."""
    drawn = _draws(rows, sims).withColumn("j", drawn_index(F.lit(seed), F.col("n"))).join(rows.select(F.col("i").alias("j"), "r"), "j")
    return _grown(drawn, fraction)


def shuffled(rows: DataFrame, sims: int = 1000, fraction: float = 0.01, seed: int = 42) -> DataFrame:
    """Each simulation has all trades, in an order of its own."""
    each = _draws(rows, sims).join(rows.select(F.col("i").alias("k"), "r"), "k")
    order = Window.partitionBy("sim").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "sim", "k").cast("binary")), "k")
    return _grown(each.withColumn("k", F.row_number().over(order).cast("long")), fraction)


def log_growth(r: Column, fraction: float | Column) -> Column:
    """The log of a trade's growth; ruin is minus infinity."""
    growth = 1 + fraction * r
    return F.when(growth <= 0, F.lit(float("-inf"))).otherwise(F.log(F.when(growth > 0, growth)))


def _held(lg: Column) -> Column:
    return F.greatest(F.lit(-LOG_RANGE), F.least(F.lit(LOG_RANGE), lg))


def _grown(drawn: DataFrame, fraction: float) -> DataFrame:
    log = log_growth(F.col("r"), fraction)
    return drawn.select("sim", "k", "r", _held(F.sum(log).over(Window.partitionBy("sim").orderBy("k"))).alias("lg"))


def outcomes(sims: DataFrame) -> DataFrame:
    """Each simulation's total return, largest drawdown (from the start on) and mean R."""
    peak = F.greatest(F.lit(0.0), F.max("lg").over(Window.partitionBy("sim").orderBy("k")))
    rows = sims.withColumn("_dd", 1 - F.exp(F.col("lg") - peak))
    return rows.groupBy("sim").agg((F.exp(F.max_by("lg", "k")) - 1).alias("total_return"), F.max("_dd").alias("max_drawdown"), F.avg("r").alias("expectancy_r"))


def bands(sims: DataFrame) -> DataFrame:
    """The 5th to 95th percentiles of the outcomes, a row for each measure; nulls where there is nothing to simulate."""
    p = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    measures = ["total_return", "max_drawdown", "expectancy_r"]
    whole = outcomes(sims).agg(*[F.percentile(m, F.array(*[F.lit(x) for x in p.values()])).alias(m) for m in measures])
    q = whole.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("_q")) for m in measures])).alias("x")).select("x.*")
    return q.select("measure", *[F.col("_q")[i].alias(a) for i, a in enumerate(p)])


def negative_share(trades: DataFrame, years: tuple[int, ...], sims: int = 1000, fraction: float = 0.01, seed: int = 42) -> DataFrame:
    """The share of simulations that end under the start after so many years: as many trades are drawn as fall into them at the rate of the history.

    A shorter horizon reads the first draws of a longer one.
    """
    rows = numbered(trades)
    long = lambda y: F.greatest(F.lit(1), F.round(y * F.col("rate"))).cast("long")
    size = rows.agg(F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("n")).crossJoin(trades.agg(elapsed_years().alias("_years")))
    size = size.select("n", F.try_divide("n", "_years").alias("rate"))
    each = rows.sparkSession.range(sims).withColumnRenamed("id", "sim").crossJoin(F.broadcast(size)).where("n > 0 and rate is not null").repartition(F.col("sim"))
    each = each.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), long(max(years)) - 1))).withColumn("j", drawn_index(F.lit(seed), F.col("n")))
    drawn = each.join(rows.select(F.col("i").alias("j"), "r"), "j").withColumn("_lg", log_growth(F.col("r"), fraction))
    ends = drawn.groupBy("sim").agg(*[F.sum(F.when(F.col("k") < long(y), F.col("_lg"))).alias(f"y{y}") for y in years])
    return ends.select(F.explode(F.array(*[F.struct(F.lit(y).alias("years"), F.col(f"y{y}").alias("lg")) for y in years])).alias("x")).groupBy("x.years").agg(F.avg((F.col("x.lg") < 0).cast("double")).alias("p_negative"))


def sensitivity(rows: DataFrame, factors: tuple[float, ...], sims: int = 1000, fraction: float = 0.01) -> DataFrame:
    """The bootstrap at multiples of the risked fraction: median return and how often it is negative."""
    drawn = simulated(rows, sims, fraction).withColumn("factor", F.explode(F.array(*[F.lit(float(f)) for f in factors])))
    ends = drawn.groupBy("factor", "sim").agg(_held(F.sum(log_growth(F.col("r"), fraction * F.col("factor")))).alias("lg"))
    return ends.groupBy("factor").agg(F.percentile(F.exp("lg") - 1, F.lit(0.5)).alias("median_return"), F.avg((F.col("lg") < 0).cast("double")).alias("p_negative"))


def out_of_sample(rows: DataFrame, test: float = 0.3) -> DataFrame:
    """``role``: train for the first part in time, at least one trade, test for the rest."""
    cut = F.greatest(F.lit(1), F.floor((1 - test) * F.col("n")))
    return rows.withColumn("role", F.when(F.col("i") < cut, "train").otherwise("test"))


def walk_forward(rows: DataFrame, folds: int = 3, first: float = 0.4) -> DataFrame:
    """Each trade once for each fold that it is in: ``fold`` and ``role``; the training part grows."""
    size = F.greatest(F.lit(1), F.floor((1 - first) * F.col("n") / folds))
    each = rows.withColumn("fold", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(folds).cast("long"))))
    end = F.greatest(F.lit(1), F.floor(first * F.col("n"))) + (F.col("fold") - 1) * size
    return each.where(F.col("i") < end + size).withColumn("role", F.when(F.col("i") < end, "train").otherwise("test"))


def by_dates(trades: DataFrame, valid_from: str, test_from: str) -> DataFrame:
    at = F.col("exit_ts")
    return trades.withColumn("split", F.when(at < F.lit(valid_from).cast("timestamp"), "train").when(at < F.lit(test_from).cast("timestamp"), "valid").otherwise("test"))


def split_stats(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("expectancy"), F.avg((F.col("result") == "win").cast("double")).alias("win_rate"))


def verdict(pct: Column, low: Column, target: int) -> Column:
    """A sentence: whether the target is met, and reliably (the 5th percentile is positive)."""
    return F.concat(F.when(pct >= target, "meets").otherwise("misses"), F.lit(f" {target}%"), F.when(low > 0, ", reliably").otherwise(""))
