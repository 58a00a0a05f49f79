"""Queries over sources and sinks, registries, gates, sizes, texts and run documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as txt
from tidemark.functions import timeframes as tfs
from tidemark.operators import candidates as cand
from tidemark.operators import indicators as ind
from tidemark.operators import joins
from tidemark.operators import metrics as met
from tidemark.operators import pivots as piv
from tidemark.operators import resampling as res
from tidemark.operators import review as rev
from tidemark.plans import sql
from tidemark.plans import trade_queries as tq
from tidemark.plans.bar_queries import daily, hourly, rounded
from tidemark.plans.registry import register
from tidemark.plans.stream_queries import stored
from tidemark.plans.trade_queries import TRAVEL, base, breakouts, breakouts_of, trades, with_levels
from tidemark.sources import bars as src

_B = "round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume"
_BARS = {"open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume"}


@register("feed_pages", sql.query(f"SELECT symbol, '1h' AS timeframe, ts, {_B} FROM b1h WHERE ts < TIMESTAMP '2024-01-20'", "b1h"))
def feed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Bars as a feed would page them (each page repeats the last row of the one before; some rows are broken), read back."""
    bars = hourly(spark, d).withColumn("page", F.floor(F.unix_timestamp("ts") / 86400))
    row = F.array((F.unix_timestamp("ts") * 1000).cast("double"), "open", "high", "low", "close", "volume")
    twice = bars.unionByName(bars.where(F.hour("ts") == 23).withColumn("page", F.col("page") + 1))
    pages = twice.groupBy("symbol", "page").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    broken = F.array(F.array(F.lit(1.0), F.lit(None).cast("double")))
    pages = pages.select("symbol", F.lit("1h").alias("timeframe"), "page", F.to_json(F.concat("rows", broken)).alias("body"))
    good, _ = src.feed_rows(pages, F.unix_millis(F.lit("2024-01-20").cast("timestamp")))
    return rounded(good, "symbol", "timeframe", "ts", **_BARS)


@register("vendor_table", sql.query(f"SELECT symbol, '1d' AS timeframe, ts, {_B} FROM b1d", "b1d"))
def vendor_table(spark: SparkSession, d: str) -> DataFrame:
    named = daily(spark, d).withColumn("timeframe", F.lit("1d")).withColumnsRenamed({"ts": "Date"} | {c: c.capitalize() for c in _BARS})
    return rounded(src.vendor_rows(named), "symbol", "timeframe", "ts", **_BARS)


@register("source_priority", sql.query("SELECT symbol, timeframe, ts, 1 AS priority FROM store WHERE timeframe = '1d' UNION ALL SELECT symbol, timeframe, ts, 2 FROM store WHERE timeframe = '1h'", "store"))
def source_priority(spark: SparkSession, d: str) -> DataFrame:
    """Two sources, the better of which has no hourly bars."""
    h, day = hourly(spark, d).withColumn("timeframe", F.lit("1h")), daily(spark, d).withColumn("timeframe", F.lit("1d"))
    second = h.unionByName(day).withColumn("priority", F.lit(2))
    return src.by_priority(day.withColumn("priority", F.lit(1)).unionByName(second)).select("symbol", "timeframe", "ts", "priority")


@register("instrument_registry", "SELECT n_name AS canonical, unnest(['alpha', 'beta']) AS provider, unnest([lower(n_name), 'B.' || n_nationkey]) AS provider_symbol, unnest(CASE WHEN n_regionkey = 0 THEN [2, 1] ELSE [1, 2] END) AS rank FROM nation")
def instrument_registry(spark: SparkSession, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/nation.parquet")
    maps = F.create_map(F.lit("alpha"), F.lower("n_name"), F.lit("beta"), F.concat(F.lit("B."), F.col("n_nationkey").cast("string")))
    order = F.when(F.col("n_regionkey") == 0, F.array(F.lit("beta"), F.lit("alpha"))).otherwise(F.array().cast("array<string>"))
    return src.provider_symbols(n.select(F.col("n_name").alias("canonical"), maps.alias("providers"), order.alias("priority")))


sql.define("listed", "SELECT n_name AS symbol, c_custkey AS position FROM customer JOIN nation ON n_nationkey = c_nationkey")


@register("portfolio_list", sql.query("SELECT symbol, min(position) AS position FROM listed WHERE symbol IN (SELECT n_name FROM nation WHERE n_regionkey < 3) GROUP BY symbol", "listed"))
def portfolio_list(spark: SparkSession, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/nation.parquet")
    listed = spark.read.parquet(f"{d}/customer.parquet").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("symbol"), F.col("c_custkey").alias("position"))
    return src.portfolio(listed, n.where("n_regionkey < 3").select(F.col("n_name").alias("symbol")))[0]


@register("portfolio_unknown", sql.query("SELECT symbol, position FROM listed WHERE symbol NOT IN (SELECT n_name FROM nation WHERE n_regionkey < 3)", "listed"))
def portfolio_unknown(spark: SparkSession, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/nation.parquet")
    listed = spark.read.parquet(f"{d}/customer.parquet").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("symbol"), F.col("c_custkey").alias("position"))
    return src.portfolio(listed, n.where("n_regionkey < 3").select(F.col("n_name").alias("symbol")))[1]


@register("range_clip", sql.query("SELECT symbol, ts, round(close, 6) AS close FROM b1h WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10'", "b1h"))
def range_clip(spark: SparkSession, d: str) -> DataFrame:
    at = lambda x: F.lit(x).cast("timestamp")
    return rounded(src.clip(hourly(spark, d), at("2024-01-05"), at("2024-01-10")), "symbol", "ts", close="close")


sql.define("gated", "SELECT c.candidate_id, c.direction, r.* EXCLUDE (symbol, ts) FROM cand c JOIN r1h r USING (symbol, ts)", "cand", "r1h")


@register(
    "regime_gates",
    sql.query("SELECT candidate_id, CASE WHEN atr_pct < 50 THEN 'atr_too_low' WHEN vol_ratio < 0.7 THEN 'volume_too_low' WHEN trend_eff * (CASE direction WHEN 'bullish' THEN 1 ELSE -1 END) < -0.02 THEN 'inefficient_trend' END AS reason FROM gated", "gated"),
)
def regime_gates(spark: SparkSession, d: str) -> DataFrame:
    rows, bars = breakouts(spark, d)
    regime = ind.with_regime(bars).select("symbol", "bar_idx", "atr_pct", "vol_ratio", "trend_eff")
    return rows.join(regime, ["symbol", "bar_idx"]).select("candidate_id", cand.gates(min_atr_pct=50.0, min_vol_ratio=0.7, min_trend_eff=-0.02).alias("reason"))


@register("sized_candidates", sql.query("SELECT candidate_id, round(100.0, 6) AS risk_amount, round(100.0 / abs(entry - stop), 6) AS size, round(100.0 * abs(target - entry) / abs(entry - stop), 6) AS reward_amount FROM cand", "cand"))
def sized_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = cand.sized(breakouts(spark, d)[0], F.lit(10_000.0))
    return rounded(rows, "candidate_id", risk_amount="risk_amount", size="size", reward_amount="reward_amount")


@register("level_relations", sql.query("""SELECT candidate_id, (SELECT count(*) FROM flv l WHERE l.symbol = c.symbol AND l.frame_idx = c.bar_idx AND (level - entry) * s > 0 AND (level - entry) * s <= 4.0 * abs(entry - stop)) AS n_blocking,
    round((SELECT arg_min(level, abs(level - target)) FROM flv l WHERE l.symbol = c.symbol AND l.frame_idx = c.bar_idx AND (level - target) * s > 0 AND (level - target) * s <= 1.0 * atr), 6) AS anchor FROM (SELECT *, CASE direction WHEN 'bullish' THEN 1 ELSE -1 END AS s FROM cand) c""", "cand", "flv"))  # fmt: skip
def level_relations(spark: SparkSession, d: str) -> DataFrame:
    """The levels within a candidate's reward grid, and the nearest one beyond its target."""
    bars = base(spark, d)
    rows = with_levels(breakouts_of(bars)[0], bars)
    lv = F.col("levels")
    return rounded(rows.select("candidate_id", F.size(cand.blocking(lv, F.col("entry"), F.col("stop"))).cast("long").alias("n_blocking"), cand.anchor_level(lv, F.col("target"), F.col("direction"), F.col("atr")).alias("a")), "candidate_id", "n_blocking", anchor="a")


_G = "(CASE WHEN entry > {t} THEN 1 ELSE -1 END)"
_AIM = f"entry + {_G} * k * abs(entry - {{t}})"
_CLEAR = f"list_filter(list_transform(range(0, 21), lambda i: round(2 + 0.1 * i, 10)), lambda k: len(list_filter(lv, lambda x: (x > least(entry, {_AIM}) AND x < greatest(entry, {_AIM})) OR abs(x - ({_AIM})) < 0.05 * atr)) = 0)[1]"


@register(
    "swing_stop_candidates",
    sql.query(
        f""", lv AS (SELECT symbol, frame_idx, list(level) AS levels FROM flv GROUP BY ALL),
        sw AS (SELECT c.candidate_id, arg_max(p.price, p.bar_idx) AS anchor FROM cand c JOIN p21 p ON p.symbol = c.symbol AND p.confirm_idx <= c.bar_idx AND p.bar_idx > c.bar_idx - 20
          WHERE p.type = CASE c.direction WHEN 'bullish' THEN 'L' ELSE 'H' END AND (c.close - p.price) * (CASE c.direction WHEN 'bullish' THEN 1 ELSE -1 END) > 0 GROUP BY c.candidate_id),
        x AS (SELECT c.candidate_id, c.close AS entry, c.atr, CASE c.direction WHEN 'bullish' THEN 1 ELSE -1 END AS s, coalesce(lv.levels, []) AS lv, sw.anchor FROM cand c LEFT JOIN lv ON lv.symbol = c.symbol AND lv.frame_idx = c.bar_idx LEFT JOIN sw USING (candidate_id)),
        y AS (SELECT *, coalesce(anchor - s * 0.1 * atr, entry - s * 2.0 * atr) AS stop FROM x),
        z AS (SELECT *, {_CLEAR.format(t="stop")} AS rr, len(list_filter(lv, lambda x: x > least(entry, stop) AND x < greatest(entry, stop))) > 0 AS crosses FROM y),
        v AS (SELECT *, CASE WHEN NOT abs(entry - stop) > 0 THEN 'no_risk' WHEN abs(entry - stop) > 4.0 * atr THEN 'stop_too_wide' WHEN crosses THEN 'stop_crosses_level' WHEN rr IS NULL THEN 'no_clear_target' END AS why,
          list_transform(range(0, 36), lambda j: entry - s * round(4.0 - 0.1 * j, 10) * atr) AS stops FROM z),
        w AS (SELECT candidate_id, u, j, {_CLEAR.format(t="u")} AS r FROM (SELECT candidate_id, entry, atr, lv, unnest(stops) AS u, generate_subscripts(stops, 1) AS j FROM v WHERE why IN ('stop_too_wide', 'stop_crosses_level', 'no_clear_target')) WHERE len(list_filter(lv, lambda x: abs(x - u) < 0.05 * atr)) = 0),
        f AS (SELECT candidate_id, arg_min(u, j) AS u, arg_min(r, j) AS r FROM w WHERE r IS NOT NULL GROUP BY candidate_id),
        o AS (SELECT v.candidate_id, entry, s, f.u IS NOT NULL AS spaced, CASE WHEN f.u IS NULL THEN why END AS reject_reason, coalesce(f.u, stop) AS stop, coalesce(f.r, rr) AS rr FROM v LEFT JOIN f USING (candidate_id))
        SELECT candidate_id, spaced, reject_reason, round(entry, 6) AS entry, round(stop, 6) AS stop, round(entry + s * rr * abs(entry - stop), 6) AS target, round(rr, 6) AS rr FROM o""",
        "cand",
        "flv",
        "p21",
    ),
)
def swing_stop_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with swing stops, clear rewards and the widest-stop fallback."""
    bars = base(spark, d)
    seen = piv.visible_swings(piv.with_pivots(bars), 20).select("symbol", "bar_idx", "swings", "close")
    rows = with_levels(breakouts_of(bars)[0], bars).drop("stop", "target", "entry").join(seen, ["symbol", "bar_idx"])
    out = cand.risk_candidates(rows, buffer=0.05)
    return rounded(out, "candidate_id", "spaced", "reject_reason", entry="entry", stop="stop", target="target", rr="rr")


@register(
    "weekly_context",
    sql.query(
        """, hi AS (SELECT symbol, ts + INTERVAL 14 DAYS AS usable_at, max(high) OVER w AS hi, min(low) OVER w AS lo FROM b1w WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
        SELECT a.symbol, a.ts, round(CASE WHEN hi > lo THEN (a.close - lo) / (hi - lo) END, 6) AS position FROM b1d a ASOF LEFT JOIN hi ON a.symbol = hi.symbol AND a.ts >= hi.usable_at""",
        "b1d",
        "b1w",
    ),
)
def weekly_context(spark: SparkSession, d: str) -> DataFrame:
    """The study's form of the range position: a lag of two weeks from the week's start."""
    days = daily(spark, d)
    weeks = src.resample(days, "1w", "1d").select("symbol", "ts", F.max("high").over(ind.last(12)).alias("hi"), F.min("low").over(ind.last(12)).alias("lo"))
    rows = joins.completed(days.select("symbol", "ts", "close"), weeks, ["symbol"], 10080, 1, ["hi", "lo"])
    span = F.col("hi") - F.col("lo")
    return rounded(rows.withColumn("p", F.when(span > 0, (F.col("close") - F.col("lo")) / span)), "symbol", "ts", position="p")


sql.define("pa_p", "SELECT p.*, a.atr FROM p22 p JOIN a1h a ON a.symbol = p.symbol AND a.bar_idx = p.bar_idx", "p22", "a1h")
_UNFOLDED = tq.CASE[: tq.CASE.index("WHEN len(f.kept) > 1 THEN")] + "ELSE 'h' END"
for _name, _case in (("fold_pf", tq.CASE), ("fold_p", _UNFOLDED)):
    sql.define(_name, tq.fold_sql(_name, "pa_p", _case), "pa_p")

for _name, _fold, _folded in (("study_legs", "fold_p", False), ("study_legs_folded", "fold_pf", True)):

    @register(_name, "WITH RECURSIVE " + sql.query(f"SELECT p.symbol, p.seq, p.type, round(p.price, 6) AS price FROM pa_p p JOIN (SELECT symbol, arg_max(kept, k) AS kept FROM {_fold} GROUP BY symbol) z ON z.symbol = p.symbol WHERE list_contains(list_transform(z.kept, lambda x: x.seq), p.seq)", "pa_p", _fold).removeprefix("WITH "))
    def study_legs(spark: SparkSession, d: str, folded: bool = _folded) -> DataFrame:
        """The study's legs by the ATR at the pivot; rejected pivots are folded into the swings before them, or dropped."""
        bars = base(spark, d)
        rows = piv.pivots(bars, 2, 2).join(bars.select("symbol", "bar_idx", "atr"), ["symbol", "bar_idx"])
        return rounded(piv.magnitude_swings(rows, TRAVEL, fold_rejected=folded).where("kept"), "symbol", "seq", "type", price="price")


@register("run_document", sql.query("SELECT symbol, candidate_id, exit_reason, round(r, 6) AS r FROM trades", "trades"))
def run_document(spark: SparkSession, d: str) -> DataFrame:
    """The trades, written as a JSON document for each symbol and read back."""
    done = trades(spark, d)
    return rounded(rev.read_document(rev.run_document(done, met.ordered_balances(done))), "symbol", "candidate_id", "exit_reason", r="r")


@register(
    "negative_horizons",
    sql.query(
        """, w AS (SELECT max(n) AS n, max(n) / ((epoch_us(max(exit_ts)) - epoch_us(min(exit_ts))) / (365.25 * 86400e6)) AS rate FROM dec),
        g AS (SELECT sim, k, n, rate, ('0x' || substr(md5('42:' || sim || ':' || k), 1, 8))::BIGINT % n AS j FROM range(1000) s(sim), w, range(greatest(1, round(5 * (SELECT rate FROM w)))::BIGINT) q(k)),
        e AS (SELECT sim, years, sum(CASE WHEN 1 + 0.01 * r <= 0 THEN '-inf'::DOUBLE ELSE ln(1 + 0.01 * r) END) AS lg FROM g JOIN dec ON i = j, (VALUES (1), (3), (5)) v(years) WHERE k < greatest(1, round(years * rate)) GROUP BY ALL)
        SELECT years, round(avg((lg < 0)::INT), 6) AS p_negative FROM e GROUP BY years""",
        "dec",
    ),
)
def negative_horizons(spark: SparkSession, d: str) -> DataFrame:
    """How often one, three and five years of trades, drawn at the history's rate, end under the start."""
    return rounded(res.negative_share(stored(trades(spark, d)), (1, 3, 5)), "years", p_negative="p_negative")


@register("price_texts", sql.query("SELECT candidate_id, CASE WHEN abs(entry) >= 100 THEN rtrim(rtrim(printf('%.2f', entry), '0'), '.') WHEN abs(entry) >= 1 THEN rtrim(rtrim(printf('%.4f', entry), '0'), '.') ELSE rtrim(rtrim(printf('%.6f', entry), '0'), '.') END AS price, printf('%.2f%%', r) AS pct, symbol || strftime(submit_ts, '_%Y-%m-%d_trade_') || direction || '_' || result || '_' || printf('%+.2f', r) AS name FROM trades", "trades"))
def price_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = trades(spark, d)
    name = txt.point_name(F.col("symbol"), F.col("submit_ts"), F.lit("trade"), F.col("direction"), F.col("result"), F.col("r"))
    return rows.select("candidate_id", txt.price_text(F.col("entry")).alias("price"), txt.percent_text(F.col("r")).alias("pct"), name.alias("name"))


@register("time_functions", sql.query("SELECT candidate_id, round(greatest(0, (epoch_us(exit_ts) - epoch_us(submit_ts)) / 3.6e9), 6) AS hours, time_bucket(INTERVAL '15 minutes', exit_ts, TIMESTAMP '1970-01-01') AS quarter, date_trunc('week', exit_ts)::TIMESTAMP AS week, CASE WHEN isfinite(mfe_r / nullif(mae_r, 0)) THEN round(mfe_r / nullif(mae_r, 0), 6) END AS ratio FROM trades", "trades"))
def time_functions(spark: SparkSession, d: str) -> DataFrame:
    rows = trades(spark, d)
    cols = [tfs.hours_between(F.col("submit_ts"), F.col("exit_ts")).alias("h"), tfs.period_start(F.col("exit_ts"), "15m").alias("quarter"), tfs.period_start(F.col("exit_ts"), "1w").alias("week"), tfs.finite(F.try_divide("mfe_r", "mae_r")).alias("f")]
    return rounded(rows.select("candidate_id", *cols), "candidate_id", "quarter", "week", hours="h", ratio="f")


@register(
    "touch_expiry",
    sql.query(
        """SELECT candidate_id, CASE WHEN i IS NULL OR datediff('day', submit_ts, touched) >= 1 THEN 'expired' ELSE 'filled' END AS fill_state FROM (
        SELECT c.candidate_id, any_value(c.ts) AS submit_ts, min(i) FILTER ((good - level) * f.s >= 0) AS i, min(bts) FILTER ((good - level) * f.s >= 0) AS touched
        FROM cand c LEFT JOIN (SELECT *, entry + s * 0.5 * atr AS level FROM fut) f USING (candidate_id) GROUP BY c.candidate_id)""",
        "cand",
        "fut",
    ),
)
def touch_expiry(spark: SparkSession, d: str) -> DataFrame:
    """Orders half an ATR beyond the close, which count no more on the next calendar day."""
    from tidemark.operators import labels as lab

    rows, bars = breakouts(spark, d)
    s = F.when(F.col("direction") == "bullish", 1.0).otherwise(-1.0)
    rows = rows.withColumn("entry", F.col("entry") + s * 0.5 * F.col("atr"))
    return lab.touch_fill(lab.with_future(rows, bars, tq.HORIZON), max_days=1).select("candidate_id", "fill_state")


#: The depths, in percent, of the heuristic.
RUIN = (5.0, 10.0, 15.0, 20.0, 25.0, 30.0, 40.0, 50.0)


@register("risk_of_ruin", sql.query(f"SELECT s.symbol, threshold, round(coalesce(avg((depth_pct > threshold)::INT), 0), 6) AS share FROM (SELECT DISTINCT symbol FROM bal) s CROSS JOIN (SELECT unnest({list(RUIN)})::DOUBLE AS threshold) t LEFT JOIN dd ON dd.symbol = s.symbol GROUP BY ALL", "bal", "dd"))
def risk_of_ruin(spark: SparkSession, d: str) -> DataFrame:
    """The share of each book's drawdowns that were deeper than thresholds; 0 where there were none."""
    balances = met.ordered_balances(trades(spark, d))
    found = met.deeper_than(met.drawdowns(balances, "symbol"), RUIN, "symbol")
    every = balances.select("symbol").distinct().withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in RUIN])))
    return every.join(found, ["symbol", "threshold"], "left").select("symbol", "threshold", F.round(F.coalesce("share", F.lit(0.0)), 6).alias("share"))
