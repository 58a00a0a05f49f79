"""Queries for whole reports: dashboards, costs, run documents, logs, frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as txt
from tidemark.functions import timeframes as tfs
from tidemark.operators import dashboards as dash
from tidemark.operators import documents as doc
from tidemark.operators import metrics as met
from tidemark.operators import signals as sig
from tidemark.operators.joins import asof_backward
from tidemark.plans import sql
from tidemark.plans.bar_queries import hourly, rounded, with_facts
from tidemark.plans.metric_queries import COSTS
from tidemark.plans.registry import oracle_sql, queries, register
from tidemark.plans.stream_queries import folder, stored
from tidemark.plans.trade_queries import base, breakout_signals_of, pullbacks_of, trades
from tidemark.sources import bars as src


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


_RECORD = ["initial_balance", "final_balance", "total_pnl", "total_return_pct", "years", "periods_per_year", "simple_sum_pct", "compounded_pct", "drag_pct", "cagr_pct", "best_month_pct", "worst_month_pct", "volatility_pct", "sharpe", "sortino", "calmar", "max_drawdown_pct", "largest_fall", "deeper_than_1", "deeper_than_2", "deeper_than_5", "top_index"]
sql.define(
    "rec",
    """SELECT o.symbol, initial_balance, final_balance, final_balance - initial_balance AS total_pnl, (final_balance / initial_balance - 1) * 100 AS total_return_pct, years, periods,
    CASE WHEN years > 0 AND periods > 0 THEN greatest(1.0, periods / years) ELSE 252.0 END AS periods_per_year, CASE WHEN years > 0 AND periods > 0 THEN 'observed_closes_per_year' ELSE 'default_252' END AS annualization_basis,
    100 * simple AS simple_sum_pct, 100 * whole AS compounded_pct, 100 * (simple - whole) AS drag_pct, CASE WHEN final_balance > 0 AND years > 0 THEN power(final_balance / initial_balance, 1 / years) - 1 END AS cagr, 100 * cagr AS cagr_pct,
    100 * best AS best_month_pct, 100 * worst AS worst_month_pct, 100 * sd * sqrt(periods_per_year) AS volatility_pct, mean / nullif(sd, 0) * sqrt(periods_per_year) AS sharpe, mean / nullif(down, 0) * sqrt(periods_per_year) AS sortino,
    CASE WHEN dd > 0 THEN cagr / (dd / 100) END AS calmar, coalesce(dd, 0) AS max_drawdown_pct, coalesce(fall, 0) AS largest_fall, coalesce(n_episodes, 0) AS n_episodes, coalesce(d1, 0) AS deeper_than_1, coalesce(d2, 0) AS deeper_than_2, coalesce(d5, 0) AS deeper_than_5, 100 * top / initial_balance AS top_index
    FROM (SELECT symbol, arg_min(balance, (ts, seq)) AS initial_balance, arg_max(balance, (ts, seq)) AS final_balance, max(seq) AS periods, (epoch_us(max(ts)) - epoch_us(min(ts))) / (365.25 * 86400e6) AS years, avg(lr) AS mean, stddev_samp(lr) AS sd, sqrt(avg(lr * lr) FILTER (lr < 0)) AS down, max(balance) AS top
      FROM (SELECT *, CASE WHEN balance > 0 AND lag(balance) OVER w > 0 THEN ln(balance / lag(balance) OVER w) END AS lr FROM bal WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)) GROUP BY symbol) o
    JOIN (SELECT symbol, sum(ret) AS simple, exp(sum(ln(1 + ret))) - 1 AS whole, max(ret) AS best, min(ret) AS worst FROM (
      SELECT symbol, l / coalesce(lag(l) OVER (PARTITION BY symbol ORDER BY bucket), f) - 1 AS ret FROM (SELECT symbol, date_trunc('month', ts) AS bucket, arg_max(balance, (ts, seq)) AS l, arg_min(balance, (ts, seq)) AS f FROM bal GROUP BY ALL)) GROUP BY symbol) m ON m.symbol = o.symbol
    LEFT JOIN (SELECT symbol, max(depth_pct) AS dd, max(depth) AS fall, count(*) AS n_episodes, avg((depth_pct > 1)::INT) AS d1, avg((depth_pct > 2)::INT) AS d2, avg((depth_pct > 5)::INT) AS d5 FROM dd GROUP BY symbol) e ON e.symbol = o.symbol""",
    "bal",
    "dd",
)


@register("portfolio_dashboard", f"SELECT symbol, periods, annualization_basis, n_episodes, {_r(*_RECORD)}, max_wins, max_losses FROM ({sql.query('SELECT * FROM rec', 'rec')}) JOIN ({oracle_sql()['streaks']}) USING (symbol)")
def portfolio_dashboard(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dash.portfolio(stored(trades(spark, d)), "symbol"), "symbol", "periods", "annualization_basis", "n_episodes", "max_wins", "max_losses", **_same(*_RECORD))


_PARTS = {"by_instrument": [], "book_summary": ["win_rate"], "streaks": []}


@register("trade_dashboard", "SELECT * FROM " + " JOIN ".join(f"(SELECT * {f'EXCLUDE ({chr(44).join(out)})' if out else ''} FROM ({oracle_sql()[name]}))" + (" USING (symbol)" if i else "") for i, (name, out) in enumerate(_PARTS.items())))
def trade_dashboard(spark: SparkSession, d: str) -> DataFrame:
    """Counts, rates, R averages, expectancy, profit factor, Kelly share and streaks of each instrument as one record."""
    out = None
    for name, dropped in _PARTS.items():
        part = queries()[name](spark, d).drop(*dropped)
        out = part if out is None else out.join(part, "symbol")
    return out


def risked(spark: SparkSession, d: str) -> DataFrame:
    """The trades as positions of ten units: what each risks, and makes."""
    return trades(spark, d).withColumn("risk_amount", 10 * F.abs(F.col("entry") - F.col("stop"))).withColumn("pnl", F.col("r") * F.col("risk_amount"))


sql.define("risked", "SELECT *, 10 * abs(entry - stop) AS risk_amount, r * 10 * abs(entry - stop) AS pnl FROM trades", "trades")


@register("risk_fraction", sql.query("SELECT symbol, round(CASE WHEN avg(risk_amount) FILTER (result IN ('win', 'loss') AND risk_amount > 0) > 0 THEN least(0.5, avg(risk_amount) FILTER (result IN ('win', 'loss') AND risk_amount > 0) / 2000.0) ELSE 0.01 END, 6) AS risk_fraction FROM risked GROUP BY symbol", "risked"))
def risk_fraction(spark: SparkSession, d: str) -> DataFrame:
    return rounded(met.risk_fraction(risked(spark, d), 2000.0, "symbol"), "symbol", risk_fraction="risk_fraction")


@register("initial_balances", sql.query("SELECT t.symbol, CASE WHEN f IS NULL THEN 'default_index' ELSE 'derived_final_minus_pnl' END AS basis, round(CASE WHEN f IS NULL THEN 100.0 ELSE f - pnl END, 6) AS initial FROM (SELECT symbol, sum(pnl) AS pnl FROM risked GROUP BY symbol) t LEFT JOIN (SELECT symbol, arg_max(balance, (ts, seq)) AS f FROM bal WHERE symbol <> 'click' GROUP BY symbol) c ON c.symbol = t.symbol", "risked", "bal"))
def initial_balances(spark: SparkSession, d: str) -> DataFrame:
    """Backed out of a curve's end, or an index where there is no curve."""
    curve = met.ordered_balances(trades(spark, d)).where("symbol <> 'click'").groupBy("symbol", "ts").agg(F.max_by("balance", "seq").alias("balance"))
    return rounded(dash.initial_balance(risked(spark, d), curve, None, "symbol"), "symbol", "basis", initial="initial")


_EXPOSED = ["max_risk", "max_risk_pct", "avg_exposure_pct", "avg_instruments", "multi_instrument_pct"]


@register(
    "book_exposure",
    sql.query(
        f""", e AS (SELECT direction, symbol, t, sum(k) AS k, sum(x) AS x FROM (SELECT direction, symbol, submit_ts AS t, 1 AS k, risk_amount AS x FROM risked UNION ALL SELECT direction, symbol, exit_ts, -1, -risk_amount FROM risked) GROUP BY ALL),
        o AS (SELECT *, sum(k) OVER (PARTITION BY direction, symbol ORDER BY t) AS open FROM e),
        i AS (SELECT *, (open > 0)::INT - coalesce((lag(open) OVER (PARTITION BY direction, symbol ORDER BY t) > 0)::INT, 0) AS g FROM o),
        a AS (SELECT direction, t, sum(k) AS k, sum(x) AS x, sum(g) AS g FROM i GROUP BY ALL),
        s AS (SELECT direction, sum(k) OVER w AS n, sum(x) OVER w AS risk, sum(g) OVER w AS ins, epoch_us(lead(t) OVER w) - epoch_us(t) AS dt FROM a WINDOW w AS (PARTITION BY direction ORDER BY t))
        SELECT direction, max_trades, {_r(*_EXPOSED)} FROM (SELECT direction, max(n)::BIGINT AS max_trades, max(risk) AS max_risk, max(risk) / 2000.0 * 100 AS max_risk_pct, sum(risk * dt) / sum(dt) / 2000.0 * 100 AS avg_exposure_pct, sum(ins * dt) / sum(dt) AS avg_instruments, 100 * sum((ins > 1)::INT * dt) / sum(dt) AS multi_instrument_pct FROM s GROUP BY direction)""",
        "risked",
    ),
)
def book_exposure(spark: SparkSession, d: str) -> DataFrame:
    """Long and short trades as two books of all instruments."""
    return rounded(dash.book_exposure(risked(spark, d), 2000.0, "direction"), "direction", "max_trades", **_same(*_EXPOSED))


@register("book_instruments", sql.query("SELECT direction, symbol, count(*) AS trades, count(*) FILTER (result = 'win') AS wins, count(*) FILTER (result = 'loss') AS losses, round(coalesce(count(*) FILTER (result = 'win') / nullif(count(*) FILTER (result IN ('win', 'loss')), 0), 0), 6) AS win_rate, round(sum(risk_amount), 6) AS total_risk, round(avg(risk_amount) / 2000.0 * 100, 6) AS mean_risk_pct FROM risked GROUP BY ALL", "risked"))
def book_instruments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dash.by_instrument(risked(spark, d), 2000.0, "direction"), "direction", "symbol", "trades", "wins", "losses", **_same("win_rate", "total_risk", "mean_risk_pct"))


_SIDE = "sum({p}) / 100 AS {k}_return, avg({r}) AS {k}_expectancy, sum({r}) FILTER ({r} > 1e-12) / nullif(-sum({r}) FILTER ({r} < -1e-12), 0) AS {k}_pf, count(*) FILTER ({r} > 1e-12) / nullif(count(*) FILTER ({r} > 1e-12) + count(*) FILTER ({r} < -1e-12), 0) AS {k}_wr, -avg({r}) FILTER ({r} < -1e-12) / nullif(avg({r}) FILTER ({r} > 1e-12) - avg({r}) FILTER ({r} < -1e-12), 0) AS {k}_even"
_DRAGS = ["return_drag_pct", "cagr_drag_pct", "expectancy_drag_r", "profit_factor_drag", "win_rate_drag_pp", "break_even_gross", "break_even_net", "required_lift_pp"]


@register(
    "gross_vs_net",
    sql.query(
        f""", g AS (SELECT symbol, (epoch_us(max(exit_ts)) - epoch_us(min(exit_ts))) / (365.25 * 86400e6) AS years, {_SIDE.format(k='gross', r='r', p='r')}, {_SIDE.format(k='net', r='net_r', p='net_pnl')} FROM net GROUP BY symbol),
        c AS (SELECT *, {", ".join(f"CASE WHEN 1 + {k}_return > 0 AND years > 0 THEN power(1 + {k}_return, 1 / years) - 1 END AS {k}_cagr" for k in ("gross", "net"))} FROM g)
        SELECT symbol, sign_flips, {_r(*_DRAGS)} FROM (SELECT symbol, 100 * (gross_return - net_return) AS return_drag_pct, 100 * (gross_cagr - net_cagr) AS cagr_drag_pct, gross_expectancy - net_expectancy AS expectancy_drag_r, gross_pf - net_pf AS profit_factor_drag, 100 * (gross_wr - net_wr) AS win_rate_drag_pp,
        concat_ws(',', CASE WHEN gross_return > 0 AND net_return <= 0 THEN 'return' END, CASE WHEN gross_cagr > 0 AND net_cagr < 0 THEN 'cagr' END, CASE WHEN gross_expectancy > 0 AND net_expectancy <= 0 THEN 'expectancy' END, CASE WHEN gross_pf >= 1 AND net_pf < 1 THEN 'profit_factor' END) AS sign_flips,
        gross_even AS break_even_gross, net_even AS break_even_net, 100 * (net_even - gross_wr) AS required_lift_pp FROM c)""",
        "net",
    ),
)
def gross_vs_net(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dash.gross_vs_net(met.with_costs(trades(spark, d), **COSTS), "symbol"), "symbol", "sign_flips", **_same(*_DRAGS))


@register(
    "cost_schedules",
    """SELECT s_name AS key, error, CASE WHEN error IS NULL THEN flat END AS flat, CASE WHEN error IS NULL THEN rate END AS rate FROM (SELECT *, round(s_acctbal / 1000, 6) AS flat, round((s_suppkey % 12) / 10.0, 6) AS rate,
    CASE WHEN s_suppkey % 11 = 0 THEN 'not_json' WHEN s_suppkey % 7 = 0 THEN 'unknown_key' WHEN s_suppkey % 13 = 0 THEN 'not_a_number' WHEN s_acctbal < 0 THEN 'negative' WHEN s_suppkey % 12 = 11 THEN 'rate_over_1' END AS error FROM supplier)""",
)
def cost_schedules(spark: SparkSession, d: str) -> DataFrame:
    """Schedules of the suppliers' balances, some of them torn, or with a name where a number should be, or an odd key."""
    rows, k = spark.read.parquet(f"{d}/supplier.parquet"), F.col("s_suppkey")
    flat = F.when(k % 13 == 0, F.col("s_name")).otherwise(F.round(F.col("s_acctbal") / 1000, 6).cast("string"))
    text = F.to_json(F.create_map(F.when(k % 7 == 0, "fee").otherwise("flat"), flat, F.lit("rate"), F.round(k % 12 / 10, 6).cast("string")))
    rows = dash.cost_schedules(rows.select(F.col("s_name").alias("key"), F.when(k % 11 == 0, F.substring(text, 1, 6)).otherwise(text).alias("schedule")))
    sound = F.col("error").isNull()
    return rows.select("key", "error", F.when(sound, F.round("flat", 6)).alias("flat"), F.when(sound, F.round("rate", 6)).alias("rate"))


@register("break_even", sql.query("SELECT symbol, round(1 / (1 + avg(r) FILTER (result = 'win') / abs(avg(r) FILTER (result = 'loss'))), 6) AS win_rate FROM trades GROUP BY symbol", "trades"))
def break_even(spark: SparkSession, d: str) -> DataFrame:
    rows = met.r_summary(trades(spark, d), "symbol").withColumn("w", met.break_even_win_rate(F.col("payoff")))
    return rounded(rows, "symbol", win_rate="w")


sql.define(
    "sigs",
    """SELECT p.symbol, ts, 'pullback' AS source, 0 AS priority, CASE WHEN s < 0.6 THEN 'weak_pattern' WHEN trend_direction <> direction THEN 'against_trend' WHEN s * trend_strength <= 0 THEN 'zero_confidence' END AS why, direction
      FROM (SELECT p.*, t.trend_direction, t.trend_strength, coalesce(abs(pattern[4] - pattern[3]) / nullif(abs(pattern[3] - pattern[2]), 0), 0) AS s FROM pull p JOIN t1h t USING (symbol, ts) WHERE direction IS NOT NULL) p
    UNION ALL SELECT symbol, ts, 'breakout', 1, why, dir FROM brk""",
    "pull",
    "t1h",
    "brk",
)


def _signals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    facts = with_facts(hourly(spark, d))
    return sig.evaluated([pullbacks_of(facts), breakout_signals_of(facts)])


@register("evaluated_signals", sql.query("SELECT symbol, ts, source, CASE WHEN why IS NULL THEN direction END AS direction, why AS reject_reason FROM sigs", "sigs"))
def evaluated_signals(spark: SparkSession, d: str) -> DataFrame:
    """All strategies' signals, and the reasons of those that give none."""
    kept, lost = _signals(spark, d)
    return kept.unionByName(lost).select("symbol", "ts", "source", "direction", "reject_reason")


@register("first_accepted", sql.query("SELECT symbol, ts, arg_min(source, priority) AS source, arg_min(direction, priority) AS direction FROM sigs WHERE why IS NULL GROUP BY symbol, ts", "sigs"))
def first_accepted(spark: SparkSession, d: str) -> DataFrame:
    return sig.first_accepted(_signals(spark, d)[0]).select("symbol", "ts", "source", "direction")


def _said(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    kept, lost = _signals(spark, d)
    what = lambda *c: F.concat_ws(" ", *c).alias("what")
    return kept.select("symbol", "ts", what("source", "direction")), lost.select("symbol", "ts", what("source", "reject_reason"))


@register("evidence_by_time", sql.query("SELECT symbol, ts, coalesce(string_agg(source || ' ' || direction, '; ' ORDER BY source) FILTER (why IS NULL), '') AS patterns, coalesce(string_agg(source || ' ' || why, '; ' ORDER BY source) FILTER (why IS NOT NULL), '') AS rejections FROM sigs GROUP BY symbol, ts", "sigs"))
def evidence_by_time(spark: SparkSession, d: str) -> DataFrame:
    return doc.by_time(*_said(spark, d)).select("symbol", "ts", *[F.array_join(c, "; ").alias(c) for c in ("patterns", "rejections")])


def _documents(spark: SparkSession, d: str) -> DataFrame:
    facts = with_facts(hourly(spark, d))
    long = facts.unpivot(["symbol", "ts"], ["ema_20", "atr_wilder"], "name", "value")
    done, at = trades(spark, d), folder(spark)
    doc.run_documents(facts, long, *_said(spark, d), done, met.ordered_balances(done)).write.parquet(at)
    return spark.read.parquet(at)


sql.define(
    "sections",
    """SELECT symbol, 'fact' AS section, ts, unnest(['ema_20', 'atr_wilder']) AS name, round(unnest([ema_20, atr_wilder]), 6) AS value FROM t1h
    UNION ALL SELECT symbol, 'candle', ts, 'close', round(close, 6) FROM b1h UNION ALL SELECT symbol, 'trade', submit_ts, candidate_id, round(r, 6) FROM trades
    UNION ALL SELECT symbol, CASE WHEN why IS NULL THEN 'pattern' ELSE 'rejection' END, ts, source || ' ' || coalesce(why, direction), NULL FROM sigs""",
    "t1h",
    "b1h",
    "trades",
    "sigs",
)


def _sections(opened: DataFrame) -> DataFrame:
    row = lambda rows, kind, ts, name, value: rows.select("symbol", F.lit(kind).alias("section"), F.col(ts).alias("ts"), F.col(name).alias("name"), F.round(value, 6).alias("value"))
    none = F.lit(None).cast("double")
    parts = [row(doc.facts_of(opened), "fact", "ts", "name", F.col("value")), row(doc.candles_of(opened).withColumn("name", F.lit("close")), "candle", "ts", "name", F.col("close")), row(doc.trades_of(opened), "trade", "submit_ts", "candidate_id", F.col("r"))]
    parts += [row(doc.texts_of(opened, f"{k}s_by_ts"), k, "ts", "what", none) for k in ("pattern", "rejection")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("run_document_sections", sql.query("SELECT * FROM sections", "sections"))
def run_document_sections(spark: SparkSession, d: str) -> DataFrame:
    """Candles, facts, patterns, rejections and trades, written as a document for each instrument and week and read back; what is no document is skipped."""
    documents = _documents(spark, d)
    torn = documents.select("symbol", "part", F.expr("left(document, 40)").alias("document"))
    return _sections(doc.opened(documents.unionByName(torn)))


@register(
    "portfolio_document",
    sql.query(
        """, w AS (SELECT symbol, date_trunc('week', ts)::TIMESTAMP AS part, dense_rank() OVER (PARTITION BY date_trunc('week', ts) ORDER BY symbol) - 1 AS position FROM b1h),
        t AS (SELECT symbol, date_trunc('week', submit_ts)::TIMESTAMP AS part, candidate_id, row_number() OVER (PARTITION BY symbol, date_trunc('week', submit_ts) ORDER BY submit_ts, candidate_id) - 1 AS place FROM trades)
        SELECT symbol, part, position, place, candidate_id FROM t JOIN (SELECT DISTINCT symbol, part, position FROM w) USING (symbol, part)""",
        "trades",
        "b1h",
    ),
)
def portfolio_document(spark: SparkSession, d: str) -> DataFrame:
    """All instruments in one document a week; the trades come back in the instruments' order."""
    opened = doc.opened(doc.portfolio_documents(_documents(spark, d)))
    return doc.trades_of(opened).select("symbol", "part", F.col("position").cast("long"), F.col("place").cast("long"), "candidate_id")


@register("fact_context", sql.query("SELECT candidate_id, CASE WHEN minute(submit_ts) = 0 THEN 'atr_wilder,ema_20,ema_50' ELSE '' END AS names, round(atr_wilder, 6) AS first_value FROM trades JOIN t1h ON t1h.symbol = trades.symbol AND ts = submit_ts", "trades", "t1h"))
def fact_context(spark: SparkSession, d: str) -> DataFrame:
    facts = with_facts(hourly(spark, d)).unpivot(["symbol", "ts"], ["ema_20", "ema_50", "atr_wilder"], "name", "value")
    rows = doc.fact_context(trades(spark, d).select("symbol", F.col("submit_ts").alias("ts"), "candidate_id"), facts)
    return rounded(rows.withColumns({"names": F.array_join(F.transform("context", lambda x: x["name"]), ","), "v": F.try_element_at("context", F.lit(1))["value"]}), "candidate_id", "names", first_value="v")


@register("latest_frame", sql.query("SELECT candidate_id, f.ts AS frame_ts, round(f.ema_20, 6) AS ema_20 FROM (SELECT symbol, candidate_id, exit_ts + INTERVAL 30 MINUTES AS at FROM trades) t ASOF LEFT JOIN t1h f ON f.symbol = t.symbol AND f.ts <= t.at", "trades", "t1h"))
def latest_frame(spark: SparkSession, d: str) -> DataFrame:
    """The latest frame at or before half an hour past each trade's exit."""
    points = trades(spark, d).select("symbol", "candidate_id", (F.col("exit_ts") + F.expr("INTERVAL 30 MINUTES")).alias("at"))
    rows = asof_backward(points, with_facts(hourly(spark, d)), ["symbol"], "at", "ts", ["ema_20"])
    return rounded(rows.withColumnRenamed("ts_asof", "frame_ts"), "candidate_id", "frame_ts", ema_20="ema_20")


@register("frame_lookup", sql.query("SELECT symbol, ts, 'slice' AS how, round(close, 6) AS close FROM a1h WHERE bar_idx >= 100 AND bar_idx < 120 UNION ALL SELECT symbol, ts, 'exact', round(close, 6) FROM a1h WHERE ts IN (TIMESTAMP '2024-01-09 12:00:00', TIMESTAMP '2024-01-20 00:00:00')", "a1h"))
def frame_lookup(spark: SparkSession, d: str) -> DataFrame:
    frames = base(spark, d)
    rows = doc.frame_slice(frames, 100, 120).withColumn("how", F.lit("slice")).unionByName(doc.frame_at(frames, ["2024-01-09 12:00:00", "2024-01-20 00:00:00"]).withColumn("how", F.lit("exact")))
    return rounded(rows, "symbol", "ts", "how", close="close")


def _logged(spark: SparkSession, d: str, after: str | None) -> DataFrame:
    """The trades' exits through a log of JSON lines, with torn lines among them."""
    path = folder(spark)
    exits = trades(spark, d).select("symbol", F.col("exit_ts").alias("ts"), F.lit("exit").alias("kind"), "candidate_id", "r")
    doc.append_events(exits, path)
    exits.select(F.lit('{"symbol": "x", "ts').alias("value")).write.mode("append").text(path)
    return doc.tail_events(spark, path, "symbol string, ts timestamp, kind string, candidate_id string, r double", F.lit(after).cast("timestamp") if after else None)


@register("event_log_tail", sql.query("SELECT symbol, exit_ts AS ts, candidate_id, round(r, 6) AS r FROM trades WHERE exit_ts > TIMESTAMP '2024-01-15'", "trades"))
def event_log_tail(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_logged(spark, d, "2024-01-15"), "symbol", "ts", "candidate_id", r="r")


@register("live_compare", sql.query("SELECT symbol, round(avg(r), 6) AS expectancy, max(exit_ts) AS last_ts, round(arg_max(r, (exit_ts, r)) - avg(r), 6) AS difference FROM trades GROUP BY symbol", "trades"))
def live_compare(spark: SparkSession, d: str) -> DataFrame:
    logged = _logged(spark, d, None).groupBy("symbol", "ts").agg(F.max("r").alias("r"))
    rows = doc.live_compare(logged, trades(spark, d).groupBy("symbol").agg(F.avg("r").alias("expectancy")))
    return rounded(rows, "symbol", "last_ts", expectancy="expectancy", difference="difference")


@register("data_requirements", "SELECT DISTINCT event_type AS symbol, timeframe FROM events, (VALUES ('1h'), ('4h'), ('1d')) v(timeframe)")
def data_requirements(spark: SparkSession, d: str) -> DataFrame:
    symbols = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("symbol"))
    return src.requirements(symbols, spark.createDataFrame([("1h",), ("4h",), ("1d",), ("4h",)], "timeframe string")).select("symbol", "timeframe")


@register("zone_times", sql.query("SELECT symbol, ts, (ts AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS utc FROM b4h", "b4h"))
def zone_times(spark: SparkSession, d: str) -> DataFrame:
    """Four-hour bars' times, read as New York's wall clock."""
    rows = src.resample(hourly(spark, d), "4h", "1h")
    return rows.select("symbol", "ts", tfs.to_utc(F.col("ts"), "America/New_York").alias("utc"))


@register(
    "note_texts",
    """SELECT doc_id, CASE WHEN text IS NULL THEN 'none' WHEN trim(text) = '' THEN 'empty' ELSE 'text' END AS state, CASE WHEN doc_id % 3 = 0 THEN 'note ' || doc_id END AS tag,
    printf('%.1f', n_chars / 100.0 / (CASE WHEN doc_id % 2 = 0 THEN 0.01 ELSE 0.0001 END)) || ' pips' AS distance FROM documents""",
)
def note_texts(spark: SparkSession, d: str) -> DataFrame:
    """Review cells' tags, whether a note has a text, and distances in pips, over the documents."""
    rows = spark.read.parquet(f"{d}/documents.parquet")
    cell = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# x\n<!-- REVIEW: note "), F.col("doc_id").cast("string"), F.lit(" -->"))).otherwise("plain")
    symbol = F.when(F.col("doc_id") % 2 == 0, "USDJPY").otherwise("EURUSD")
    return rows.select("doc_id", txt.note_state(F.col("text")).alias("state"), txt.review_tag(cell).alias("tag"), txt.distance_text(symbol, F.col("n_chars") / 100.0, F.lit(0.0)).alias("distance"))


_STUDY = ["cost_r", "target_pct", "stop_pct", "timeout_pct", "mean_r", "mean_in_time_r", "mean_net_r"]


@register(
    "study_costs",
    sql.query(
        f"""SELECT symbol, n, {_r(*_STUDY)} FROM (SELECT t.symbol, count(*) AS n, 0.001 / (1.5 * median(c.atr / c.entry)) AS cost_r, {", ".join(f"100 * avg((exit_reason = '{x}')::INT) AS {x}_pct" for x in ("target", "stop", "timeout"))},
        avg(r) AS mean_r, avg(r) FILTER (exit_reason <> 'timeout') AS mean_in_time_r, avg(r) - cost_r AS mean_net_r FROM trades t JOIN cand c USING (candidate_id) GROUP BY t.symbol)""",
        "trades",
        "cand",
    ),
)
def study_costs(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of a percent as a cost of the study's trades."""
    return rounded(met.study_costs(trades(spark, d), 0.001, 1.5, "symbol"), "symbol", "n", **_same(*_STUDY))
