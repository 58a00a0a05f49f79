"""Queries over the labelled trades: statistics, drawdowns, costs, resampling, splits, sweeps, review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import metrics as met
from tidemark.operators import resampling as res
from tidemark.operators import review as rev
from tidemark.plans import sql
from tidemark.plans.bar_queries import hourly, rounded
from tidemark.plans.registry import register
from tidemark.plans.stream_queries import stored
from tidemark.plans.trade_queries import breakouts, trades


def _r(**values: str) -> str:
    return ", ".join(f"round({c}, 6) AS {a}" for a, c in values.items())


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


_N = ["n_win", "n_loss", "n_breakeven", "n_cancelled", "n_filled", "n_decided"]
_COUNTS = "count(*) FILTER (result = 'win') AS n_win, count(*) FILTER (result = 'loss') AS n_loss, count(*) FILTER (result = 'breakeven') AS n_breakeven, count(*) FILTER (result = 'cancelled') AS n_cancelled, count(*) AS n_filled, count(*) FILTER (result IN ('win', 'loss')) AS n_decided"

for _name, _key in (("trade_counts", "exit_reason"), ("by_direction", "direction"), ("by_instrument", "symbol")):

    @register(_name, sql.query(f"SELECT {_key}, {_COUNTS}, round(n_win / nullif(n_decided, 0), 6) AS win_rate, round(n_win / nullif(n_filled, 0), 6) AS filled_win_rate FROM trades GROUP BY {_key}", "trades"))
    def trade_counts(spark: SparkSession, d: str, key: str = _key) -> DataFrame:
        return rounded(met.counts(trades(spark, d), key), key, *_N, win_rate="win_rate", filled_win_rate="filled_win_rate")


_SUM = """SELECT symbol, avg(r) FILTER (result = 'win') AS avg_win_r, median(r) FILTER (result = 'win') AS median_win_r, avg(r) FILTER (result = 'loss') AS avg_loss_r, median(r) FILTER (result = 'loss') AS median_loss_r,
avg(r) AS expectancy_all, avg(r) FILTER (result IN ('win', 'loss')) AS expectancy_decided, sum(r) FILTER (result = 'win') AS gw, sum(r) FILTER (result = 'loss') AS gl, count(*) FILTER (result = 'win') / nullif(count(*) FILTER (result IN ('win', 'loss')), 0) AS win_rate,
avg_win_r / abs(avg_loss_r) AS payoff, gw / abs(gl) AS profit_factor, greatest(0, least(1, win_rate - (1 - win_rate) / payoff)) AS kelly FROM trades GROUP BY symbol"""
_SUMS = ["avg_win_r", "median_win_r", "avg_loss_r", "median_loss_r", "expectancy_all", "expectancy_decided", "payoff", "profit_factor", "win_rate"]


@register("book_summary", sql.query(f"SELECT symbol, {_r(**_same(*_SUMS))}, round(CASE WHEN payoff IS NULL OR win_rate IS NULL THEN coalesce(kelly, 0) ELSE kelly END, 6) AS kelly FROM ({_SUM})", "trades"))
def book_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(met.r_summary(trades(spark, d), "symbol"), "symbol", **_same(*_SUMS, "kelly"))


_P = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


@register(
    "r_distribution",
    sql.query(
        f"""SELECT direction, count(*) AS n, round(min(r), 6) AS lowest, round(max(r), 6) AS highest, {", ".join(f"round(quantile_cont(r, {p}), 6) AS {a}" for a, p in _P.items())},
        round(CASE WHEN count(*) >= 3 AND stddev_pop(r) > 0 THEN avg(d * d * d) / power(avg(d * d), 1.5) END, 6) AS skew, round(CASE WHEN count(*) >= 3 AND stddev_pop(r) > 0 THEN avg(d * d * d * d) / power(avg(d * d), 2) - 3 END, 6) AS excess_kurtosis
        FROM (SELECT direction, r, r - avg(r) OVER (PARTITION BY direction) AS d FROM trades) GROUP BY direction""",
        "trades",
    ),
)
def r_distribution(spark: SparkSession, d: str) -> DataFrame:
    return rounded(met.r_distribution(trades(spark, d), "direction"), "direction", "n", **_same("lowest", "highest", *_P, "skew", "excess_kurtosis"))


@register("r_histogram", sql.query("SELECT CASE WHEN hi > lo THEN least(floor((r - lo) / ((hi - lo) / 10)), 9) ELSE 0 END::BIGINT AS bin, count(*) AS n FROM trades, (SELECT min(r) AS lo, max(r) AS hi FROM trades) GROUP BY 1", "trades"))
def r_histogram(spark: SparkSession, d: str) -> DataFrame:
    return met.histogram(trades(spark, d), "r", 10)


_H = "greatest(0, (epoch_us(exit_ts) - epoch_us(submit_ts)) / 3.6e9)"


@register("duration", sql.query(f"SELECT result, {_r(mean_hours=f'avg({_H})', median_hours=f'median({_H})')}, count(*) AS n FROM trades GROUP BY result UNION ALL SELECT 'all', {_r(mean_hours=f'avg({_H})', median_hours=f'median({_H})')}, count(*) FROM trades", "trades"))
def duration(spark: SparkSession, d: str) -> DataFrame:
    return rounded(met.duration(trades(spark, d)), "result", "n", mean_hours="mean_hours", median_hours="median_hours")


@register("mfe_quality", sql.query("SELECT level, count(*) FILTER (mfe_r >= level AND r < level) AS n_gave_back, count(*) AS n_wins, round(avg(mfe_r - r), 6) AS mean_left_r, round(median(mfe_r - r), 6) AS median_left_r FROM trades, (VALUES (1), (2), (3), (4)) v(level) WHERE result = 'win' GROUP BY level", "trades"))
def mfe_quality(spark: SparkSession, d: str) -> DataFrame:
    return rounded(met.exit_quality(trades(spark, d)), "level", "n_gave_back", "n_wins", mean_left_r="mean_left_r", median_left_r="median_left_r")


@register("mae_distribution", sql.query("SELECT symbol, round(avg(mae_r), 6) AS mean_mae, round(median(mae_r), 6) AS median_mae, round(quantile_cont(mae_r, 0.95), 6) AS p95_mae, round(median(mae_r) FILTER (result = 'loss'), 6) AS median_loser_mae FROM trades GROUP BY symbol", "trades"))
def mae_distribution(spark: SparkSession, d: str) -> DataFrame:
    return rounded(met.adverse(trades(spark, d), "symbol"), "symbol", **_same("mean_mae", "median_mae", "p95_mae", "median_loser_mae"))


@register("exit_breakdown", sql.query("SELECT exit_reason, count(*) AS n, round(count(*) FILTER (result = 'win') / nullif(count(*) FILTER (result IN ('win', 'loss')), 0), 6) AS win_rate, round(avg(r), 6) AS avg_r, round(count(*) / (SELECT count(*) FROM trades), 6) AS share FROM trades GROUP BY exit_reason", "trades"))
def exit_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return rounded(met.exit_breakdown(trades(spark, d)), "exit_reason", "n", win_rate="win_rate", avg_r="avg_r", share="share")


@register("frequency", sql.query("SELECT symbol, n, round(days, 6) AS days, round(n / nullif(days, 0), 6) AS per_day, round(7 * n / nullif(days, 0), 6) AS per_week, round(30.4375 * n / nullif(days, 0), 6) AS per_month FROM (SELECT symbol, count(*) AS n, (epoch_us(max(exit_ts)) - epoch_us(min(submit_ts))) / 86.4e9 AS days FROM trades GROUP BY symbol)", "trades"))
def frequency(spark: SparkSession, d: str) -> DataFrame:
    return rounded(met.frequency(trades(spark, d), "symbol"), "symbol", "n", **_same("days", "per_day", "per_week", "per_month"))


_REACH = "level, round(avg((r >= level)::INT), 6) AS realized, round(avg((mfe_r >= level)::INT), 6) AS at_best, count(*) AS n FROM trades, (VALUES (1), (2), (3), (4)) v(level)"


@register("reach", sql.query(f"SELECT direction, {_REACH} GROUP BY direction, level UNION ALL SELECT 'all', {_REACH} GROUP BY level", "trades"))
def reach(spark: SparkSession, d: str) -> DataFrame:
    return rounded(met.reach(trades(spark, d)), "direction", "level", "n", realized="realized", at_best="at_best")


@register(
    "monthly_summary",
    sql.query(
        """, h AS (SELECT symbol, date_trunc('month', exit_ts)::TIMESTAMP AS month, count(*) AS n, count(*) FILTER (result = 'win') AS wins, sum(r) AS pnl FROM trades GROUP BY ALL),
        m AS (SELECT symbol, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS month FROM h GROUP BY symbol)
        SELECT symbol, month, coalesce(n, 0) AS n, coalesce(wins, 0) AS wins, round(coalesce(pnl, 0), 6) AS pnl,
        round(100 * coalesce(pnl, 0) / (100 + coalesce(sum(coalesce(pnl, 0)) OVER (PARTITION BY symbol ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 6) AS growth_pct FROM m LEFT JOIN h USING (symbol, month)""",
        "trades",
    ),
)
def monthly_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(met.monthly(trades(spark, d)), "symbol", "month", "n", "wins", pnl="pnl", growth_pct="growth_pct")


sql.define(
    "bal",
    """SELECT symbol, exit_ts AS ts, row_number() OVER w AS seq, 100 + sum(r) OVER w AS balance FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY exit_ts, candidate_id)
    UNION ALL SELECT symbol, min(exit_ts), 0, 100 FROM trades GROUP BY symbol""",
    "trades",
)
sql.define(
    "dd",
    """SELECT symbol, min(i) AS start, max(balance) FILTER (top) AS peak, min(balance) AS trough, peak - trough AS depth, depth * 100 / peak AS depth_pct, arg_min(i, (balance, i)) AS low_at, max(i) AS last_at, low_at - min(i) AS duration, any_value(n) AS n, CASE WHEN last_at < any_value(n) THEN last_at + 1 - low_at END AS recovery
    FROM (SELECT *, sum(top::INT) OVER (PARTITION BY symbol ORDER BY ts, seq) AS episode FROM (
    SELECT *, coalesce(balance >= max(balance) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS top, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bal))
    GROUP BY symbol, episode HAVING count(*) > 1""",
    "bal",
)


@register("drawdown_episodes", sql.query("SELECT symbol, start, duration, coalesce(recovery, -1) AS recovery, round(peak, 6) AS peak, round(trough, 6) AS trough, round(depth, 6) AS depth, round(depth_pct, 6) AS depth_pct FROM dd", "dd"))
def drawdown_episodes(spark: SparkSession, d: str) -> DataFrame:
    """-1: not recovered yet."""
    return rounded(met.drawdowns(met.ordered_balances(trades(spark, d)), "symbol").fillna({"recovery": -1}), "symbol", "start", "duration", "recovery", **_same("peak", "trough", "depth", "depth_pct"))


@register("drawdown_shares", sql.query("SELECT symbol, threshold, round(avg((depth_pct > threshold)::INT), 6) AS share FROM dd, (VALUES (0.5), (1.0), (2.0), (5.0)) v(threshold) GROUP BY ALL", "dd"))
def drawdown_shares(spark: SparkSession, d: str) -> DataFrame:
    eps = met.drawdowns(met.ordered_balances(trades(spark, d)), "symbol")
    return rounded(met.deeper_than(eps, (0.5, 1.0, 2.0, 5.0), "symbol"), "symbol", "threshold", share="share")


sql.define(
    "rets",
    """SELECT symbol, bucket, l / coalesce(lag(l) OVER (PARTITION BY symbol ORDER BY bucket), f) - 1 AS ret FROM (
    SELECT symbol, date_trunc('day', ts) AS bucket, arg_max(balance, (ts, seq)) AS l, arg_min(balance, (ts, seq)) AS f FROM bal GROUP BY ALL)""",
    "bal",
)


@register("period_returns", sql.query("SELECT symbol, bucket::TIMESTAMP AS bucket, round(ret, 6) AS ret FROM rets", "rets"))
def period_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(met.bucket_returns(met.ordered_balances(trades(spark, d)), "day", "symbol"), "symbol", "bucket", ret="ret")


_RATIO = ["compounded", "annual", "volatility", "sharpe", "sortino", "best", "worst"]


@register(
    "risk_ratios",
    sql.query(
        """SELECT symbol, n, round(exp(lg) - 1, 6) AS compounded, round(exp(lg / n * 252) - 1, 6) AS annual, round(sd * sqrt(252), 6) AS volatility, round(mean / nullif(sd, 0) * sqrt(252), 6) AS sharpe,
        round(mean / nullif(down, 0) * sqrt(252), 6) AS sortino, round(best, 6) AS best, round(worst, 6) AS worst FROM (SELECT symbol, count(*) AS n, sum(ln(1 + ret)) AS lg, avg(ret) AS mean, stddev_samp(ret) AS sd, sqrt(avg(ret * ret) FILTER (ret < 0)) AS down, max(ret) AS best, min(ret) AS worst FROM rets GROUP BY symbol)""",
        "rets",
    ),
)
def risk_ratios(spark: SparkSession, d: str) -> DataFrame:
    rets = met.bucket_returns(met.ordered_balances(trades(spark, d)), "day", "symbol")
    return rounded(met.ratios(rets, 252.0, "symbol"), "symbol", "n", **_same(*_RATIO))


@register(
    "streaks",
    sql.query(
        """SELECT symbol, coalesce(max(n) FILTER (result = 'win'), 0) AS max_wins, coalesce(max(n) FILTER (result = 'loss'), 0) AS max_losses FROM (SELECT symbol, result, count(*) AS n FROM (
        SELECT *, sum(CASE WHEN p IS NULL OR p <> result THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY exit_ts, candidate_id) AS run FROM (SELECT *, lag(result) OVER (PARTITION BY symbol ORDER BY exit_ts, candidate_id) AS p FROM trades)) GROUP BY symbol, run, result) GROUP BY symbol""",
        "trades",
    ),
)
def streaks(spark: SparkSession, d: str) -> DataFrame:
    return met.streaks(trades(spark, d), "symbol")


@register(
    "exposure",
    sql.query(
        """, e AS (SELECT symbol, t, sum(k) AS k FROM (SELECT symbol, submit_ts AS t, 1 AS k FROM trades UNION ALL SELECT symbol, exit_ts, -1 FROM trades) GROUP BY symbol, t),
        o AS (SELECT symbol, sum(k) OVER w AS n, (epoch_us(lead(t) OVER w) - epoch_us(t)) / 3.6e9 AS dt FROM e WINDOW w AS (PARTITION BY symbol ORDER BY t))
        SELECT symbol, max(n)::BIGINT AS max_open, round(sum(n * dt) / sum(dt), 6) AS avg_open, round(sum(CASE WHEN n > 1 THEN dt ELSE 0 END) / sum(dt), 6) AS share_several FROM o GROUP BY symbol""",
        "trades",
    ),
)
def exposure(spark: SparkSession, d: str) -> DataFrame:
    return rounded(met.exposure(trades(spark, d), "symbol"), "symbol", "max_open", avg_open="avg_open", share_several="share_several")


COSTS = {"flat": 0.01, "rate": 0.0005, "slip_entry": 0.02, "slip_exit": 0.02, "slip_stop": 0.05, "step": 0.001}
sql.define(
    "net",
    """SELECT *, CASE WHEN size <= 0 THEN 0 ELSE r * size / raw - cost END AS net_pnl, CASE WHEN size > 0 THEN net_pnl / (size / raw) END AS net_r FROM (
    SELECT *, CASE WHEN size <= 0 THEN 0 ELSE 0.01 + 0.0005 * (size * entry + size * leave) + (0.02 * size * entry + 0.02 * size * leave) / 100 + CASE exit_reason WHEN 'stop' THEN 0.05 * size * entry / 100 ELSE 0 END END AS cost FROM (
    SELECT *, 1.0 / abs(entry - stop) AS raw, floor(raw / 0.001 + 1e-12) * 0.001 AS size, entry + (CASE direction WHEN 'bullish' THEN 1 ELSE -1 END) * r / raw AS leave FROM trades))""",
    "trades",
)


@register("net_costs", sql.query("SELECT candidate_id, round(size, 6) AS size, round(cost, 6) AS cost, round(net_pnl, 6) AS net_pnl, round(net_r, 6) AS net_r, size <= 0 AS dropped FROM net", "net"))
def net_costs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(met.with_costs(trades(spark, d), **COSTS), "candidate_id", "dropped", **_same("size", "cost", "net_pnl", "net_r"))


@register("cost_drag", sql.query("SELECT symbol, round(sum(cost), 6) AS total_cost, count(*) FILTER (size <= 0) AS n_dropped, round(avg(r) FILTER (size > 0), 6) AS gross_expectancy, round(avg(net_r), 6) AS net_expectancy, count(*) FILTER (size > 0 AND r > 0 AND net_r <= 0) AS n_flipped FROM net GROUP BY symbol", "net"))
def cost_drag(spark: SparkSession, d: str) -> DataFrame:
    return rounded(met.cost_summary(met.with_costs(trades(spark, d), **COSTS), "symbol"), "symbol", "n_dropped", "n_flipped", **_same("total_cost", "gross_expectancy", "net_expectancy"))


@register("study_stats", sql.query("SELECT symbol, count(*) AS n, round(100 * count(*) FILTER (result = 'win') / nullif(count(*) FILTER (result IN ('win', 'loss')), 0), 6) AS win_pct, round(avg(r), 6) AS mean_r, round(avg(r) - 0.05, 6) AS mean_net_r, round(1.96 * stddev_samp(r) / sqrt(count(*)), 6) AS half_width, round(avg(r) / nullif(stddev_samp(r) / sqrt(count(*)), 0), 6) AS t_value FROM trades GROUP BY symbol", "trades"))
def study_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(met.study_stats(trades(spark, d), 0.05, "symbol"), "symbol", "n", **_same("win_pct", "mean_r", "mean_net_r", "half_width", "t_value"))


sql.define("dec", "SELECT *, row_number() OVER (ORDER BY exit_ts, candidate_id) - 1 AS i, count(*) OVER () AS n FROM trades WHERE result IN ('win', 'loss')", "trades")
_DRAW = "('0x' || substr(md5('42:' || sim || ':' || k), 1, 8))::BIGINT % n"
_LOG = "CASE WHEN 1 + {f} * r <= 0 THEN '-inf'::DOUBLE ELSE ln(1 + {f} * r) END"
_HELD = "greatest(-709.0, least(709.0, {x}))"
SIMS = 1000
sql.define("sims", f"SELECT sim, k, r, {_HELD.format(x=f'sum({_LOG.format(f=0.01)}) OVER w')} AS lg FROM (SELECT s.sim, q.k, {_DRAW} AS j FROM range({SIMS}) s(sim), range((SELECT max(n) FROM dec)) q(k), (SELECT max(n) AS n FROM dec)) JOIN dec ON i = j WINDOW w AS (PARTITION BY sim ORDER BY k)", "dec")
sql.define("ends", "SELECT sim, arg_max(lg, k) AS lg, avg(r) AS expectancy, max(1 - exp(lg - peak)) AS max_dd FROM (SELECT *, greatest(0, max(lg) OVER (PARTITION BY sim ORDER BY k)) AS peak FROM sims) GROUP BY sim", "sims")
_BANDS = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


@register("bootstrap_ci", sql.query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS measure, " + ", ".join(f"round(quantile_cont({e}, {p}), 6) AS {a}" for a, p in _BANDS.items()) + " FROM ends" for m, e in (("total_return", "exp(lg) - 1"), ("max_drawdown", "max_dd"), ("expectancy_r", "expectancy"))) + ")", "ends"))
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return rounded(res.bands(res.simulated(res.numbered(stored(trades(spark, d))), sims=SIMS)), "measure", **_same(*_BANDS))


sql.define("shuf", f"SELECT sim, k, r, {_HELD.format(x=f'sum({_LOG.format(f=0.01)}) OVER w')} AS lg FROM (SELECT sim, row_number() OVER (PARTITION BY sim ORDER BY md5('42:' || sim || ':' || i), i) AS k, r FROM range({SIMS}) s(sim), dec) WINDOW w AS (PARTITION BY sim ORDER BY k)", "dec")
sql.define("shuf_ends", "SELECT sim, arg_max(lg, k) AS lg, avg(r) AS expectancy, max(1 - exp(lg - peak)) AS max_dd FROM (SELECT *, greatest(0, max(lg) OVER (PARTITION BY sim ORDER BY k)) AS peak FROM shuf) GROUP BY sim", "shuf")


@register("shuffle_dd", sql.query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS measure, " + ", ".join(f"round(quantile_cont({e}, {p}), 6) AS {a}" for a, p in _BANDS.items()) + " FROM shuf_ends" for m, e in (("total_return", "exp(lg) - 1"), ("max_drawdown", "max_dd"), ("expectancy_r", "expectancy"))) + ")", "shuf_ends"))
def shuffle_dd(spark: SparkSession, d: str) -> DataFrame:
    """Drawdown bands over shuffled orders: the return is the same for each, which the tests check."""
    return rounded(res.bands(res.shuffled(res.numbered(stored(trades(spark, d))), sims=SIMS)), "measure", **_same(*_BANDS))


@register("risk_sensitivity", sql.query(f"SELECT factor, round(quantile_cont(exp(lg) - 1, 0.5), 6) AS median_return, round(avg((lg < 0)::INT), 6) AS p_negative FROM (SELECT factor, sim, {_HELD.format(x='sum(' + _LOG.format(f='0.01 * factor') + ')')} AS lg FROM sims, (VALUES (0.5), (1.0), (2.0)) v(factor) GROUP BY factor, sim) GROUP BY factor", "sims"))
def risk_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(res.sensitivity(res.numbered(stored(trades(spark, d))), (0.5, 1.0, 2.0), sims=SIMS), "factor", median_return="median_return", p_negative="p_negative")


@register("oos_split", sql.query("SELECT CASE WHEN i < greatest(1, floor(0.7 * n)) THEN 'train' ELSE 'test' END AS role, count(*) AS n, round(avg(r), 6) AS expectancy, round(avg((result = 'win')::INT), 6) AS win_rate FROM dec GROUP BY 1", "dec"))
def oos_split(spark: SparkSession, d: str) -> DataFrame:
    return rounded(res.split_stats(res.out_of_sample(res.numbered(stored(trades(spark, d))), 0.3), "role"), "role", "n", expectancy="expectancy", win_rate="win_rate")


@register(
    "walk_forward",
    sql.query(
        """, f AS (SELECT fold, greatest(1, floor(0.4 * n)) + (fold - 1) * greatest(1, floor(0.6 * n / 3)) AS train_end, train_end + greatest(1, floor(0.6 * n / 3)) AS test_end FROM range(1, 4) t(fold), (SELECT max(n) AS n FROM dec))
        SELECT fold, CASE WHEN i < train_end THEN 'train' ELSE 'test' END AS role, count(*) AS n, round(avg(r), 6) AS expectancy, round(avg((result = 'win')::INT), 6) AS win_rate FROM dec JOIN f ON i < test_end GROUP BY ALL""",
        "dec",
    ),
)
def walk_forward(spark: SparkSession, d: str) -> DataFrame:
    return rounded(res.split_stats(res.walk_forward(res.numbered(stored(trades(spark, d))), 3, 0.4), "fold", "role"), "fold", "role", "n", expectancy="expectancy", win_rate="win_rate")


@register("date_splits", sql.query("SELECT CASE WHEN exit_ts < TIMESTAMP '2024-01-11' THEN 'train' WHEN exit_ts < TIMESTAMP '2024-01-21' THEN 'valid' ELSE 'test' END AS split, count(*) AS n, round(avg(r), 6) AS expectancy, round(avg((result = 'win')::INT), 6) AS win_rate FROM trades GROUP BY 1", "trades"))
def date_splits(spark: SparkSession, d: str) -> DataFrame:
    return rounded(res.split_stats(res.by_dates(trades(spark, d), "2024-01-11", "2024-01-21"), "split"), "split", "n", expectancy="expectancy", win_rate="win_rate")


@register("verdict", sql.query("SELECT symbol, round(100 * avg(r), 6) AS pct, CASE WHEN 100 * avg(r) >= 5 THEN 'meets' ELSE 'misses' END || ' 5%' || CASE WHEN quantile_cont(r, 0.05) > 0 THEN ', reliably' ELSE '' END AS verdict FROM trades GROUP BY symbol", "trades"))
def verdict(spark: SparkSession, d: str) -> DataFrame:
    rows = trades(spark, d).groupBy("symbol").agg((100 * F.avg("r")).alias("p"), F.percentile("r", F.lit(0.05)).alias("low"))
    return rounded(rows.withColumn("verdict", res.verdict(F.col("p"), F.col("low"), 5)), "symbol", "verdict", pct="p")


@register(
    "variant_sweep",
    sql.query(
        """, v AS (SELECT * FROM (VALUES (1.0, 2.0), (1.0, 3.0), (1.5, 2.0), (1.5, 3.0)) t(stop_atr, target_atr)),
        f AS (SELECT candidate_id, stop_atr, target_atr, i, bc, good, bad, entry, s, atr, entry - s * stop_atr * atr AS sp, entry + s * target_atr * atr AS tp FROM fut, v),
        x AS (SELECT candidate_id, stop_atr, target_atr, any_value(s) AS s, any_value(entry) AS entry, any_value(atr) AS atr, any_value(sp) AS sp, any_value(tp) AS tp, min(i) FILTER ((bad - sp) * s <= 0) AS si, min(i) FILTER ((good - tp) * s >= 0) AS ti, arg_max(bc, i) AS lc FROM f GROUP BY ALL),
        o AS (SELECT stop_atr, target_atr, CASE WHEN si IS NULL AND ti IS NULL THEN (lc - entry) * s / (stop_atr * atr) WHEN ti IS NULL OR si <= ti THEN -1.0 ELSE target_atr / stop_atr END AS r FROM x)
        SELECT 'stop_atr=' || stop_atr::DECIMAL(3, 1) || ', target_atr=' || target_atr::DECIMAL(3, 1) AS variant, count(*) AS n, round(avg(r), 6) AS expectancy, round(avg((r > 1e-12)::INT), 6) AS win_rate FROM o GROUP BY stop_atr, target_atr""",
        "fut",
    ),
)
def variant_sweep(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators import labels as lab
    from tidemark.operators import sweeps

    rows, bars = breakouts(spark, d)
    each = sweeps.crossed(lab.with_future(rows, bars, 15), sweeps.variants(spark, {"stop_atr": [1.0, 1.5], "target_atr": [2.0, 3.0]}))
    s = F.when(F.col("direction") == "bullish", 1.0).otherwise(-1.0)
    each = each.withColumns({"stop": F.col("entry") - s * F.col("stop_atr") * F.col("atr"), "target": F.col("entry") + s * F.col("target_atr") * F.col("atr")})
    done = lab.label(each).groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("e"), F.avg((F.col("result") == "win").cast("double")).alias("w"))
    return rounded(done, "variant", "n", expectancy="e", win_rate="w")


@register(
    "review_join",
    sql.query(
        """, p AS (SELECT candidate_id AS key FROM trades WHERE r < 0), n AS (SELECT 'click:' || doc_id AS key, left(text, 20) AS note FROM documents), o AS (SELECT 'click:' || doc_id AS key, 'quality ' || quality AS note FROM labels),
        m AS (SELECT coalesce(n.key, o.key) AS key, coalesce(o.note, n.note) AS note FROM n FULL JOIN o ON n.key = o.key)
        SELECT coalesce(p.key, m.key) AS key, m.note, CASE WHEN p.key IS NULL THEN 'orphan' WHEN m.note IS NULL THEN 'unreviewed' ELSE 'matched' END AS state FROM p FULL JOIN m ON p.key = m.key""",
        "trades",
    ),
)
def review_join(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.joins import review

    key = F.concat(F.lit("click:"), F.col("doc_id").cast("string")).alias("key")
    notes = spark.read.parquet(f"{d}/documents.parquet").select(key, F.left("text", F.lit(20)).alias("note"))
    more = spark.read.parquet(f"{d}/labels.parquet").select(key, F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("note"))
    return review(trades(spark, d).where("r < 0").select(F.col("candidate_id").alias("key")), notes, more)


@register("points_of_interest", sql.query("SELECT symbol, submit_ts AS ts, 'trade' AS kind, direction || ' ' || result AS what FROM trades UNION ALL SELECT symbol, ts, 'pattern', CASE WHEN close > channel_high THEN 'above' ELSE 'below' END FROM c1h WHERE bar_idx >= 20 AND (close > channel_high OR close < channel_low)", "trades", "c1h"))
def points_of_interest(spark: SparkSession, d: str) -> DataFrame:
    _, bars = breakouts(spark, d)
    hits = bars.where((F.col("bar_idx") >= 20) & ((F.col("close") > F.col("channel_high")) | (F.col("close") < F.col("channel_low"))))
    done = trades(spark, d)
    return rev.points({"trade": done.select("symbol", F.col("submit_ts").alias("ts"), F.concat_ws(" ", "direction", "result").alias("what")), "pattern": hits.select("symbol", "ts", F.when(F.col("close") > F.col("channel_high"), "above").otherwise("below").alias("what"))}, exclude=["rejection"])


@register("context_window", sql.query("SELECT t.candidate_id, b.bar_idx - t.bar_idx AS \"offset\", round(b.close, 6) AS close FROM trades t JOIN a1h b ON b.symbol = t.symbol AND b.bar_idx BETWEEN t.bar_idx - 45 AND t.bar_idx + 25", "trades", "a1h"))
def context_window(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.joins import within_bars

    _, bars = breakouts(spark, d)
    points = trades(spark, d).select("symbol", F.col("bar_idx").alias("point_idx"), "candidate_id")
    return rounded(within_bars(points, bars.select("symbol", "bar_idx", "close"), 45, 25), "candidate_id", "offset", close="close")


@register("event_pairs", sql.query("SELECT symbol, user_id, row_number() OVER (PARTITION BY symbol, user_id ORDER BY entry_ts) AS k, entry_ts, exit_ts FROM (SELECT 'u' AS symbol, user_id, ts AS entry_ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS exit_ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n % 2 = 1"))
def event_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A user's events in turn as entries and exits, paired."""
    from pyspark.sql import Window

    from tidemark.operators.joins import pair_events

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = spark.read.parquet(f"{d}/events.parquet").withColumns({"kind": F.when(n % 2 == 1, "entry").otherwise("exit"), "symbol": F.col("user_id").cast("string"), "price": F.col("value")})
    pairs = pair_events(rows).withColumn("user_id", F.col("symbol").cast("long"))
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("entry_ts")).cast("long")
    return pairs.select(F.lit("u").alias("symbol"), "user_id", k.alias("k"), F.col("entry_ts").cast("timestamp").alias("entry_ts"), F.col("exit_ts").cast("timestamp").alias("exit_ts"))


@register("chart_series", sql.query("SELECT symbol, ts, unnest(['ema_20', 'ema_50', 'atr']) AS series, round(unnest([ema_20, ema_50, atr]), 6) AS value FROM t1h", "t1h"))
def chart_series(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.plans.bar_queries import with_facts

    return rounded(rev.long_series(with_facts(hourly(spark, d)), ["ema_20", "ema_50", "atr"]), "symbol", "ts", "series", value="value")


@register("evidence", sql.query("SELECT symbol, count(*) AS n, string_agg(text, '; ' ORDER BY ts) AS summary FROM (SELECT symbol, ts, 'trend ' || trend_direction AS text FROM t1h WHERE trend_strength >= 0.2) GROUP BY symbol", "t1h"))
def evidence(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.plans.bar_queries import with_facts

    strong = F.when(F.col("trend_strength") >= 0.2, "strong").otherwise("weak")
    said = F.array(F.struct(F.concat(F.lit("trend "), F.col("trend_direction")).alias("text"), strong.alias("level"), F.lit("trend").alias("source")))
    return rev.evidence_summary(with_facts(hourly(spark, d)).withColumn("evidence", said), "strong")


def _facts_in_time() -> dict:
    """Everything that a strategy reads at a bar, from hourly bars."""
    from tidemark.operators import pivots as piv
    from tidemark.plans import trade_queries as tq
    from tidemark.plans.bar_queries import with_facts

    base = lambda b: tq.ind.with_atr_sma(tq.ind.indexed(b))
    time_of = lambda rows, b: rows.join(base(b).select("symbol", "bar_idx", "ts"), ["symbol", "bar_idx"])
    level = F.array_sort(F.collect_list(F.round("level", 9))).alias("levels")
    return {
        "trend": lambda b: with_facts(b).select("symbol", "ts", F.round("ema_20", 9).alias("a"), F.round("atr_wilder", 9).alias("b"), "trend_direction"),
        "swings": lambda b: piv.visible_swings(piv.with_pivots(base(b)), 20).select("symbol", "ts", "swings"),
        "levels": lambda b: time_of(tq.levels_of(base(b)).groupBy("symbol", F.col("frame_idx").alias("bar_idx")).agg(level), b).drop("bar_idx"),
        "pullbacks": lambda b: tq.pullbacks_of(with_facts(b)).select("symbol", "ts", "direction", F.round("confidence", 9).alias("c"), "reject_reason"),
        "breakouts": lambda b: tq.breakout_signals_of(with_facts(b)).select("symbol", "ts", "direction", F.round("confidence", 9).alias("c"), "reject_reason"),
        "reversions": lambda b: tq.reversions_of(base(b)).select("symbol", "ts", "direction", "pivot_idx"),
        "candidates": lambda b: tq.judged_of(base(b)).select("symbol", "ts", "direction", F.round("entry", 9).alias("e"), F.round("rr", 9).alias("rr"), "reject_reason"),
    }


@register("causality_audit", "SELECT unnest(['trend', 'swings', 'levels', 'pullbacks', 'breakouts', 'reversions', 'candidates']) AS fact, 0::BIGINT AS n_changed")
def causality_audit(spark: SparkSession, d: str) -> DataFrame:
    """Facts, swings, levels, signals and candidates of the first bars must not change when later bars are added."""
    return rev.causality(hourly(spark, d), _facts_in_time(), ["2024-01-09 13:00:00", "2024-01-20"])
