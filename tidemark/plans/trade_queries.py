"""Queries from pivots to labelled trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import candidates as cand
from tidemark.operators import indicators as ind
from tidemark.operators import labels as lab
from tidemark.operators import pivots as piv
from tidemark.operators import signals as sig
from tidemark.plans import sql
from tidemark.plans.bar_queries import hourly, rounded, with_facts
from tidemark.plans.registry import register


def _define_pivots(name: str, left: int, right: int) -> None:
    w = "PARTITION BY symbol ORDER BY ts"
    sides = ", ".join(f"{f}({c}) OVER ({w} ROWS BETWEEN {a}) AS {c}_{n}" for c, f in (("high", "max"), ("low", "min")) for n, a in (("b", f"{left} PRECEDING AND 1 PRECEDING"), ("a", f"1 FOLLOWING AND {right} FOLLOWING")))
    sql.define(
        name,
        f"""SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_idx, type) AS seq, bar_idx + {right} AS confirm_idx FROM (
        SELECT symbol, bar_idx, ts, unnest([CASE WHEN high > high_b AND high > high_a THEN 'H' END, CASE WHEN low < low_b AND low < low_a THEN 'L' END]) AS type, unnest([high, low]) AS price
        FROM (SELECT *, {sides}, lead(bar_idx, {right}) OVER ({w}) AS nx FROM a1h) WHERE bar_idx >= {left} AND nx IS NOT NULL) WHERE type IS NOT NULL""",
        "a1h",
    )


_define_pivots("p21", 2, 1)
_define_pivots("p22", 2, 2)


def base(spark: SparkSession, d: str) -> DataFrame:
    return ind.with_atr_sma(ind.indexed(hourly(spark, d)))


@register("fractal_pivots", sql.query("SELECT symbol, seq, bar_idx, ts, type, round(price, 6) AS price, confirm_idx FROM p21", "p21"))
def fractal_pivots(spark: SparkSession, d: str) -> DataFrame:
    return rounded(piv.pivots(base(spark, d)), "symbol", "seq", "bar_idx", "ts", "type", "confirm_idx", price="price")


sql.define("runs", "SELECT *, sum(CASE WHEN prev IS NULL OR prev <> type THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY seq) AS run FROM (SELECT *, lag(type) OVER (PARTITION BY symbol ORDER BY seq) AS prev FROM p21)", "p21")


@register("alternating_pivots", sql.query("SELECT symbol, seq, type, round(price, 6) AS price, count(*) OVER (PARTITION BY symbol, run) AS run_length FROM runs QUALIFY row_number() OVER (PARTITION BY symbol, run ORDER BY CASE type WHEN 'H' THEN -price ELSE price END, seq) = 1", "runs"))
def alternating_pivots(spark: SparkSession, d: str) -> DataFrame:
    return rounded(piv.alternating(piv.pivots(base(spark, d))), "symbol", "seq", "type", "run_length", price="price").withColumn("run_length", F.col("run_length").cast("long"))


@register("swing_structure", sql.query("SELECT symbol, seq, CASE WHEN s IN ('LHLHL', 'HLHLH') THEN s END AS structure FROM (SELECT symbol, seq, string_agg(type, '' ORDER BY seq) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s FROM p21)", "p21"))
def swing_structure(spark: SparkSession, d: str) -> DataFrame:
    return piv.swing_structure(piv.pivots(base(spark, d))).select("symbol", "seq", "structure")


@register(
    "visible_swings",
    sql.query("SELECT b.symbol, b.ts, count(p.seq) AS n, round(min(p.price), 6) AS lowest, round(max(p.price), 6) AS highest FROM a1h b LEFT JOIN p21 p ON p.symbol = b.symbol AND p.confirm_idx <= b.bar_idx AND p.bar_idx > b.bar_idx - 20 GROUP BY ALL", "a1h", "p21"),
)
def visible_swings(spark: SparkSession, d: str) -> DataFrame:
    rows = piv.visible_swings(piv.with_pivots(base(spark, d)), 20)
    prices = F.transform("swings", lambda p: p["price"])
    return rounded(rows.withColumns({"n": F.size("swings").cast("long"), "a": F.array_min(prices), "b": F.array_max(prices)}), "symbol", "ts", "n", lowest="a", highest="b")


TRAVEL = 1.0
_TOP = "(CASE p.type WHEN 'H' THEN p.price > {k} ELSE p.price < {k} END)"
_KEPT, _BACK = "f.kept[len(f.kept)]", "f.kept[len(f.kept) - 1]"
_ME = "{'seq': p.seq, 'type': p.type, 'price': p.price}"
sql.define("pa", "SELECT p.*, a.atr FROM p22 p JOIN a1h a ON a.symbol = p.symbol AND a.bar_idx = p.confirm_idx", "p22", "a1h")
#: A step's case: a first, b same type and beyond, c same type, d far enough, e folded and beyond, g folded, h dropped.
CASE = f"""CASE WHEN len(f.kept) = 0 THEN 'a' WHEN {_KEPT}.type = p.type THEN CASE WHEN {_TOP.format(k=_KEPT + '.price')} THEN 'b' ELSE 'c' END
    WHEN NOT coalesce(p.atr > 0, false) OR abs(p.price - {_KEPT}.price) >= {TRAVEL} * p.atr THEN 'd'
    WHEN len(f.kept) > 1 THEN CASE WHEN {_TOP.format(k=_BACK + '.price')} THEN 'e' ELSE 'g' END ELSE 'h' END"""


def fold_sql(name: str, rows: str, case: str) -> str:
    """The stack of kept swings after each pivot of ``rows``."""
    return f"""SELECT DISTINCT symbol, 0::BIGINT AS k, []::STRUCT(seq BIGINT, type VARCHAR, price DOUBLE)[] AS kept, ''::VARCHAR AS step FROM {rows}
    UNION ALL SELECT symbol, k, CASE step WHEN 'a' THEN [me] WHEN 'b' THEN list_append(kept[:len(kept) - 1], me) WHEN 'd' THEN list_append(kept, me)
      WHEN 'e' THEN list_append(kept[:len(kept) - 2], me) WHEN 'g' THEN kept[:len(kept) - 1] ELSE kept END, step
    FROM (SELECT f.symbol, f.k + 1 AS k, f.kept, {_ME} AS me, {case} AS step FROM {name} f JOIN {rows} p ON p.symbol = f.symbol AND p.seq = f.k + 1)"""


sql.define("fold", fold_sql("fold", "pa", CASE), "pa")
sql.define("swings", "SELECT p.*, f.step IN ('a', 'b', 'd', 'e') AS accepted, list_contains(list_transform(z.kept, lambda x: x.seq), p.seq) AS kept FROM pa p JOIN fold f ON f.symbol = p.symbol AND f.k = p.seq JOIN (SELECT symbol, arg_max(kept, k) AS kept FROM fold GROUP BY symbol) z ON z.symbol = p.symbol", "pa", "fold")


def _recursive(text: str) -> str:
    return "WITH RECURSIVE " + text.removeprefix("WITH ")


def swings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Hourly bars with facts, and their magnitude swings by the ATR at the confirmation bar."""
    return swings_of(base(spark, d))


def swings_of(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    at = bars.select("symbol", F.col("bar_idx").alias("confirm_idx"), "atr")
    return bars, piv.magnitude_swings(piv.pivots(bars, 2, 2).join(at, ["symbol", "confirm_idx"]), TRAVEL)


@register("magnitude_swings", _recursive(sql.query("SELECT symbol, seq, type, round(price, 6) AS price, accepted, kept FROM swings", "swings")))
def magnitude_swings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(swings(spark, d)[1], "symbol", "seq", "type", "accepted", "kept", price="price")


@register(
    "swing_spacing",
    _recursive(
        sql.query(
            """, ds AS (SELECT symbol, abs(price - lag(price) OVER (PARTITION BY symbol ORDER BY seq)) / atr AS dist FROM swings WHERE kept AND atr > 0)
            SELECT s.symbol, count(*) FILTER (NOT accepted) AS n_rejected, count(*) FILTER (s.kept) AS n_kept,
            round((SELECT list_sort(list(dist))[len(list(dist)) // 2 + 1] FROM ds WHERE ds.symbol = s.symbol AND dist IS NOT NULL), 6) AS median_spacing FROM swings s GROUP BY s.symbol""",
            "swings",
        )
    ),
)
def swing_spacing(spark: SparkSession, d: str) -> DataFrame:
    return rounded(piv.spacing(swings(spark, d)[1]), "symbol", "n_rejected", "n_kept", median_spacing="median_spacing")


sql.define("pp", "SELECT p.*, a.atr FROM p21 p JOIN a1h a ON a.symbol = p.symbol AND a.bar_idx = p.bar_idx", "p21", "a1h")
sql.define(
    "levels",
    """SELECT symbol, CASE type WHEN 'L' THEN 'support' ELSE 'resistance' END AS kind, avg(price) AS level, count(*) AS touches FROM (
    SELECT *, sum(CASE WHEN reach IS NULL OR price - 0.02 * atr > reach THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, type ORDER BY price, bar_idx) AS island FROM (
    SELECT *, max(price + 0.02 * atr) OVER (PARTITION BY symbol, type ORDER BY price, bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM pp))
    GROUP BY symbol, type, island HAVING count(*) >= 2""",
    "pp",
)
#: The prices here are noise: narrower bands than for market data keep levels apart.
TOLERANCE = 0.02


def sr(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    bars = base(spark, d)
    rows = piv.pivots(bars).join(bars.select("symbol", "bar_idx", "atr"), ["symbol", "bar_idx"])
    return bars, piv.levels(rows, TOLERANCE)


@register("sr_levels", sql.query("SELECT symbol, kind, round(level, 6) AS level, touches FROM levels", "levels"))
def sr_levels(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sr(spark, d)[1], "symbol", "kind", "touches", level="level")


@register("sr_nearest", sql.query("SELECT symbol, round(max(level) FILTER (kind = 'support'), 6) AS highest_support, round(min(level) FILTER (kind = 'resistance'), 6) AS lowest_resistance FROM levels GROUP BY symbol", "levels"))
def sr_nearest(spark: SparkSession, d: str) -> DataFrame:
    return rounded(piv.nearest_levels(sr(spark, d)[1]), "symbol", highest_support="highest_support", lowest_resistance="lowest_resistance")


#: Bars back to which a frame sees swings for its levels.
VIEW = 100
sql.define(
    "flv",
    f"""SELECT symbol, frame_idx, CASE type WHEN 'L' THEN 'support' ELSE 'resistance' END AS kind, avg(price) AS level, count(*) AS touches FROM (
    SELECT *, sum(CASE WHEN reach IS NULL OR price - 0.02 * atr > reach THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, frame_idx, type ORDER BY price, bar_idx) AS island FROM (
    SELECT b.bar_idx AS frame_idx, p.*, max(price + 0.02 * p.atr) OVER (PARTITION BY b.symbol, b.bar_idx, type ORDER BY price, p.bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
    FROM a1h b JOIN pp p ON p.symbol = b.symbol AND p.confirm_idx <= b.bar_idx AND p.bar_idx > b.bar_idx - {VIEW}))
    GROUP BY symbol, frame_idx, type, island HAVING count(*) >= 2""",
    "a1h",
    "pp",
)


def levels_of(bars: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Each bar's levels, as of the bar; of those in ``frames`` (symbol, frame_idx) alone, where they are given."""
    seen = piv.visible_swings(piv.with_pivots(bars), VIEW).select("symbol", F.col("bar_idx").alias("frame_idx"), "swings")
    return piv.levels_in_view(seen if frames is None else seen.join(frames.distinct(), ["symbol", "frame_idx"], "left_semi"), bars, TOLERANCE)


def with_levels(rows: DataFrame, bars: DataFrame) -> DataFrame:
    """Candidates (symbol, bar_idx) with ``levels``, those known at their bar."""
    found = levels_of(bars, rows.select("symbol", F.col("bar_idx").alias("frame_idx"))).groupBy("symbol", F.col("frame_idx").alias("bar_idx")).agg(F.collect_list("level").alias("levels"))
    return rows.join(found, ["symbol", "bar_idx"], "left").withColumn("levels", F.coalesce("levels", F.array().cast("array<double>")))


@register("frame_levels", sql.query("SELECT symbol, frame_idx, kind, round(level, 6) AS level, touches FROM flv", "flv"))
def frame_levels(spark: SparkSession, d: str) -> DataFrame:
    return rounded(levels_of(base(spark, d)), "symbol", "frame_idx", "kind", "touches", level="level")


_LAST = "list({c} ORDER BY p.seq DESC) FILTER (p.type = '{t}')"
sql.define(
    "pull",
    f"""SELECT symbol, ts, bar_idx, CASE WHEN h[1].price > h[2].price AND l[1].price > l[2].price THEN 'bullish' WHEN h[1].price < h[2].price AND l[1].price < l[2].price THEN 'bearish' END AS direction,
    list_transform(list_sort([{{'i': h[2].i, 'u': h[2].ts, 't': 'H', 'price': h[2].price}}, {{'i': h[1].i, 'u': h[1].ts, 't': 'H', 'price': h[1].price}}, {{'i': l[2].i, 'u': l[2].ts, 't': 'L', 'price': l[2].price}}, {{'i': l[1].i, 'u': l[1].ts, 't': 'L', 'price': l[1].price}}]), lambda x: x.price) AS pattern
    FROM (SELECT b.symbol, b.ts, b.bar_idx, {_LAST.format(t='H', c="{'i': p.bar_idx, 'ts': p.ts, 'price': p.price}")} AS h, {_LAST.format(t='L', c="{'i': p.bar_idx, 'ts': p.ts, 'price': p.price}")} AS l
      FROM a1h b JOIN p21 p ON p.symbol = b.symbol AND p.confirm_idx <= b.bar_idx AND p.bar_idx > b.bar_idx - 20 GROUP BY ALL) WHERE len(h) > 1 AND len(l) > 1""",
    "a1h",
    "p21",
)


@register("pullback_pattern", sql.query("SELECT symbol, ts, direction, round(abs(pattern[4] - pattern[3]) / nullif(abs(pattern[3] - pattern[2]), 0), 6) AS depth, round(pattern[1], 6) AS first_price FROM pull WHERE direction IS NOT NULL", "pull"))
def pullback_pattern(spark: SparkSession, d: str) -> DataFrame:
    rows = piv.with_pullback(piv.visible_swings(piv.with_pivots(base(spark, d)), 20)).where("pullback_direction is not null")
    rows = rows.withColumn("f", F.element_at("swing_pattern", 1))
    return rounded(rows.withColumn("direction", F.col("pullback_direction")), "symbol", "ts", "direction", depth="pullback_depth", first_price="f")


@register(
    "pullback_signal",
    sql.query(
        """SELECT symbol, ts, CASE WHEN why IS NULL THEN direction END AS direction, CASE WHEN why IS NULL THEN round(conf, 6) END AS confidence, why AS reject_reason FROM (
        SELECT *, CASE WHEN s < 0.6 THEN 'weak_pattern' WHEN trend_direction <> direction THEN 'against_trend' WHEN conf <= 0 THEN 'zero_confidence' END AS why FROM (
        SELECT p.*, t.trend_direction, coalesce(abs(pattern[4] - pattern[3]) / nullif(abs(pattern[3] - pattern[2]), 0), 0) AS s, s * t.trend_strength AS conf
        FROM pull p JOIN t1h t USING (symbol, ts) WHERE direction IS NOT NULL))""",
        "pull",
        "t1h",
    ),
)
def pullback_signal(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pullbacks_of(with_facts(hourly(spark, d))), "symbol", "ts", "direction", "reject_reason", confidence="confidence")


def pullbacks_of(facts: DataFrame) -> DataFrame:
    rows = piv.with_pullback(piv.visible_swings(piv.with_pivots(facts), 20)).withColumn("pullback_strength", F.lit(None).cast("double"))
    return sig.pullback_signal(rows)


_P = "{'i': p.bar_idx, 'u': p.ts, 't': p.type, 'price': p.price}"
_AT = "list({v} ORDER BY p.bar_idx DESC, p.ts DESC, p.type DESC) FILTER (p.type = '{t}')"
sql.define(
    "strong",
    f"""SELECT *, [abs(q[2].price - q[1].price), abs(q[3].price - q[2].price), abs(q[4].price - q[3].price)] AS legs, z[4].i - z[1].i AS span FROM (
    SELECT *, list_sort([h[2], h[1], l[2], l[1]]) AS q, list_sort(a[1:4]) AS z, CASE WHEN h[1].price > h[2].price AND (l[1].price > l[2].price OR coalesce(l[1].price > l[3].price, false)) THEN 'bullish' WHEN h[1].price < h[2].price AND l[1].price < l[2].price THEN 'bearish' END AS direction FROM (
    SELECT b.symbol, b.ts, b.open, b.high, b.low, b.close, b.atr, {_AT.format(v=_P, t='H')} AS h, {_AT.format(v=_P, t='L')} AS l, list({_P} ORDER BY p.bar_idx DESC, p.ts DESC, p.type DESC) AS a
    FROM a1h b JOIN p21 p ON p.symbol = b.symbol AND p.confirm_idx <= b.bar_idx AND p.bar_idx > b.bar_idx - 20 GROUP BY ALL) WHERE len(h) > 1 AND len(l) > 1)""",
    "a1h",
    "p21",
)
_UNIT = "greatest(0.0, least(1.0, {x}))"


@register(
    "pullback_strength",
    sql.query(
        f"""SELECT symbol, ts, concat_ws('|', CASE WHEN NOT (CASE direction WHEN 'bullish' THEN close > open ELSE close < open END) THEN 'against' END, CASE WHEN coalesce(abs(close - open) / nullif(high - low, 0), 0) < 0.6 THEN 'small_body' END) AS failures,
        round(CASE WHEN span IS NOT NULL THEN power({_UNIT.format(x='1 - span / 40')} * list_min(legs) / nullif(list_max(legs), 0) * {_UNIT.format(x='list_min(legs) / nullif(atr, 0)')} * {_UNIT.format(x='abs(q[4].price - q[1].price) / nullif(list_max(legs), 0)')}, 0.25) END, 6) AS strength FROM strong WHERE direction IS NOT NULL""",
        "strong",
    ),
)
def pullback_strength(spark: SparkSession, d: str) -> DataFrame:
    """The patterns' strengths and their confirmation bars' failures."""
    rows = piv.with_pattern_strength(piv.with_pullback(piv.visible_swings(piv.with_pivots(base(spark, d)), 20), retest=True)).where("pullback_direction is not null")
    return rounded(rows.withColumn("failures", F.array_join(piv.confirmation_failures(F.col("pullback_direction")), "|")), "symbol", "ts", "failures", strength="pullback_strength")


sql.define(
    "brk",
    """SELECT *, CASE WHEN NOT coalesce(atr > 0, false) THEN 'no_atr' WHEN trend_direction <> dir THEN 'against_trend' WHEN rng > 3.0 * atr THEN 'not_compressed' WHEN trend_strength <= 0 THEN 'zero_confidence' END AS why
    FROM (SELECT *, CASE WHEN close > channel_high THEN 'bullish' WHEN close < channel_low THEN 'bearish' END AS dir, max(high) OVER w - min(low) OVER w AS rng FROM o1h
    WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) WHERE dir IS NOT NULL""",
    "o1h",
)


@register("breakout_signal", sql.query("SELECT symbol, ts, CASE WHEN why IS NULL THEN dir END AS direction, CASE WHEN why IS NULL THEN round(trend_strength, 6) END AS confidence, why AS reject_reason FROM brk", "brk"))
def breakout_signal(spark: SparkSession, d: str) -> DataFrame:
    return rounded(breakout_signals_of(with_facts(hourly(spark, d))), "symbol", "ts", "direction", "reject_reason", confidence="confidence")


def breakout_signals_of(facts: DataFrame) -> DataFrame:
    return sig.breakout_signal(ind.with_breakout_age(ind.with_channel(facts)))


sql.define("rev", "SELECT b.symbol, b.ts, b.bar_idx, b.close, s.bar_idx AS pivot_idx, CASE s.type WHEN 'H' THEN 'bearish' ELSE 'bullish' END AS direction, q.atr AS pivot_atr FROM swings s JOIN a1h b ON b.symbol = s.symbol AND b.bar_idx = s.confirm_idx JOIN a1h q ON q.symbol = s.symbol AND q.bar_idx = s.bar_idx WHERE s.accepted", "swings", "a1h")


def reversion(spark: SparkSession, d: str) -> DataFrame:
    """Reversion signals with the close, the bar's and the pivot's ATR; no short filter."""
    return reversions_of(base(spark, d))


def reversions_of(bars: DataFrame) -> DataFrame:
    bars, found = swings_of(bars)
    s = sig.reversion_signal(bars.withColumn("position", F.lit(0.5)), found, None)
    at = bars.select("symbol", F.col("bar_idx").alias("pivot_idx"), F.col("atr").alias("pivot_atr"))
    return s.join(bars.select("symbol", "bar_idx", "close", "atr"), ["symbol", "bar_idx"]).join(at, ["symbol", "pivot_idx"])


@register("reversion_signal", _recursive(sql.query("SELECT symbol, ts, direction, pivot_idx FROM rev", "rev")))
def reversion_signal(spark: SparkSession, d: str) -> DataFrame:
    return reversion(spark, d).select("symbol", "ts", "direction", "pivot_idx")


_SIGN = "CASE direction WHEN 'bullish' THEN 1 ELSE -1 END"
_BRACKET = f"close AS entry, close - ({_SIGN}) * 1.5 * {{a}} AS stop, close + ({_SIGN}) * 3.0 * {{a}} AS target"


@register("atr_bracket_candidates", _recursive(sql.query(f"SELECT symbol, ts, direction, round(entry, 6) AS entry, round(stop, 6) AS stop, round(target, 6) AS target, reject_reason FROM (SELECT symbol, ts, direction, {_BRACKET.format(a='(CASE WHEN pivot_atr > 0 THEN pivot_atr END)')}, CASE WHEN NOT coalesce(pivot_atr > 0, false) THEN 'no_atr' END AS reject_reason FROM rev)", "rev")))
def atr_bracket_candidates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cand.atr_bracket(reversion(spark, d)), "symbol", "ts", "direction", "reject_reason", entry="entry", stop="stop", target="target")


sql.define("cand", f"SELECT *, symbol || ':' || bar_idx AS candidate_id, {_BRACKET.format(a='atr')} FROM (SELECT *, CASE WHEN (close > channel_high) = (bar_idx % 2 = 0) THEN 'bullish' ELSE 'bearish' END AS direction FROM c1h WHERE bar_idx >= 20 AND atr > 0 AND (close > channel_high OR close < channel_low))", "c1h")
HORIZON = 15


def breakouts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All closes through the channel, followed and faded in turn, each with an ATR bracket, and the bars."""
    return breakouts_of(base(spark, d))


def breakouts_of(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    bars = ind.with_channel(bars)
    rows = bars.where((F.col("bar_idx") >= 20) & (F.col("atr") > 0) & ((F.col("close") > F.col("channel_high")) | (F.col("close") < F.col("channel_low"))))
    rows = rows.withColumns({"direction": F.when((F.col("close") > F.col("channel_high")) == (F.col("bar_idx") % 2 == 0), "bullish").otherwise("bearish"), "candidate_id": F.concat_ws(":", "symbol", "bar_idx")})
    return cand.atr_bracket(rows, atr="atr").select("symbol", "ts", "bar_idx", "candidate_id", "direction", "entry", "stop", "target", "atr"), bars


sql.define(
    "fut",
    f"""SELECT c.candidate_id, c.symbol, c.ts AS submit_ts, c.bar_idx, c.direction, c.entry, c.stop, c.target, c.atr, {_SIGN} AS s, abs(c.entry - c.stop) AS risk, b.bar_idx AS i, b.ts AS bts, b.open AS bo, b.close AS bc,
    CASE direction WHEN 'bullish' THEN b.high ELSE b.low END AS good, CASE direction WHEN 'bullish' THEN b.low ELSE b.high END AS bad
    FROM cand c JOIN a1h b ON b.symbol = c.symbol AND b.bar_idx BETWEEN c.bar_idx + 1 AND c.bar_idx + {HORIZON}""",
    "cand",
    "a1h",
)
_DONE = """SELECT candidate_id, symbol, direction, bar_idx, submit_ts, entry, stop, target, exit_idx, exit_ts, exit_reason, exit_price, r, CASE WHEN r > 1e-12 THEN 'win' WHEN r < -1e-12 THEN 'loss' ELSE 'breakeven' END AS result, mfe_r, mae_r"""
sql.define(
    "trades",
    f"""{_DONE} FROM (SELECT *, (exit_price - entry) * s / risk AS r FROM (
    SELECT candidate_id, symbol, direction, bar_idx, submit_ts, entry, stop, target, s, risk, x.exit_idx, max(bts) FILTER (i = x.exit_idx) AS exit_ts, x.exit_reason,
    CASE x.exit_reason WHEN 'stop' THEN stop WHEN 'target' THEN target ELSE max(bc) FILTER (i = x.exit_idx) END AS exit_price,
    greatest(0, max((good - entry) * s / risk) FILTER (i <= x.exit_idx)) AS mfe_r, greatest(0, max((entry - bad) * s / risk) FILTER (i <= x.exit_idx)) AS mae_r
    FROM fut JOIN (SELECT candidate_id, CASE WHEN si IS NULL AND ti IS NULL THEN li ELSE least(coalesce(si, li + 1), coalesce(ti, li + 1)) END AS exit_idx,
      CASE WHEN si IS NULL AND ti IS NULL THEN 'timeout' WHEN si <= coalesce(ti, si) THEN 'stop' ELSE 'target' END AS exit_reason
      FROM (SELECT candidate_id, min(i) FILTER ((bad - stop) * s <= 0) AS si, min(i) FILTER ((good - target) * s >= 0) AS ti, max(i) AS li FROM fut GROUP BY candidate_id)) x USING (candidate_id)
    GROUP BY candidate_id, symbol, direction, bar_idx, submit_ts, entry, stop, target, s, risk, x.exit_idx, x.exit_reason))""",
    "fut",
)


def trades(spark: SparkSession, d: str) -> DataFrame:
    """The breakouts' outcomes: the trades that the metrics' queries read."""
    rows, bars = breakouts(spark, d)
    return lab.label(lab.with_future(rows, bars, HORIZON)).withColumnRenamed("ts", "submit_ts")


_OUT = {"exit_price": "exit_price", "r": "r", "mfe_r": "mfe_r", "mae_r": "mae_r"}
_OUT_SQL = ", ".join(f"round({c}, 6) AS {a}" for a, c in _OUT.items())


@register("label_fixed", sql.query(f"SELECT candidate_id, exit_idx, exit_ts, exit_reason, result, {_OUT_SQL} FROM trades", "trades"))
def label_fixed(spark: SparkSession, d: str) -> DataFrame:
    return rounded(trades(spark, d), "candidate_id", "exit_idx", "exit_ts", "exit_reason", "result", **_OUT)


sql.define(
    "ratchet",
    """SELECT candidate_id, arg_min({'i': i, 'why': why, 'price': CASE why WHEN 'stop' THEN stop WHEN 'breakeven' THEN entry WHEN 'target' THEN target END}, i) FILTER (why IS NOT NULL) AS x, max(i) AS li, arg_max(bc, i) AS lc, any_value(entry) AS entry, any_value(s) AS s, any_value(risk) AS risk
    FROM (SELECT *, CASE WHEN (bad - CASE WHEN armed THEN entry ELSE stop END) * s <= 0 THEN CASE WHEN armed THEN 'breakeven' ELSE 'stop' END WHEN (good - target) * s >= 0 THEN 'target' END AS why
    FROM (SELECT *, coalesce(bool_or((good - (entry + s * risk)) * s >= 0) OVER (PARTITION BY candidate_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS armed FROM fut)) GROUP BY candidate_id""",
    "fut",
)


@register("label_ratchet", sql.query("SELECT candidate_id, coalesce(x.i, li) AS exit_idx, coalesce(x.why, 'timeout') AS exit_reason, round((coalesce(x.price, lc) - entry) * s / risk, 6) AS r FROM ratchet", "ratchet"))
def label_ratchet(spark: SparkSession, d: str) -> DataFrame:
    rows, bars = breakouts(spark, d)
    return rounded(lab.label(lab.with_future(rows, bars, HORIZON), breakeven_rr=1.0), "candidate_id", "exit_idx", "exit_reason", r="r")


@register(
    "label_scaled",
    sql.query(
        """, st AS (SELECT *, coalesce(bool_or((good - (entry + s * risk)) * s >= 0) OVER w1, false) AS was, bool_or((good - (entry + s * risk)) * s >= 0) OVER w2 AS now,
        s * greatest(s * entry, max(s * good) OVER w2 - 0.5 * risk) AS tight FROM fut WINDOW w1 AS (PARTITION BY candidate_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w2 AS (PARTITION BY candidate_id ORDER BY i)),
        ev AS (SELECT *, CASE WHEN NOT was AND (bad - stop) * s <= 0 THEN 'stop' WHEN now AND (bad - tight) * s <= 0 THEN 'runner_stop' WHEN now AND (good - target) * s >= 0 THEN 'target' END AS why FROM st),
        x AS (SELECT candidate_id, arg_min({'i': i, 'why': why, 'price': CASE why WHEN 'stop' THEN stop WHEN 'runner_stop' THEN tight WHEN 'target' THEN target END, 'now': now AND why <> 'stop'}, i) FILTER (why IS NOT NULL) AS x,
        arg_max({'i': i, 'why': 'timeout', 'price': bc, 'now': now}, i) AS z, any_value(entry) AS entry, any_value(s) AS s, any_value(risk) AS risk FROM ev GROUP BY candidate_id)
        SELECT candidate_id, o.i AS exit_idx, o.why AS exit_reason, round(CASE WHEN o.now THEN 0.5 + 0.5 * (o.price - entry) * s / risk ELSE (o.price - entry) * s / risk END, 6) AS r FROM (SELECT *, coalesce(x, z) AS o FROM x)""",
        "fut",
    ),
)
def label_scaled(spark: SparkSession, d: str) -> DataFrame:
    """Half banked at 1 R, the rest trailed by half the risk to the target."""
    rows, bars = breakouts(spark, d)
    return rounded(lab.label(lab.with_future(rows, bars, HORIZON), scale=(0.5, 1.0, 0.5, None)), "candidate_id", "exit_idx", "exit_reason", r="r")


@register(
    "label_next_open",
    sql.query(
        """SELECT candidate_id, CASE WHEN abs(bo - entry) > 1.0 * atr THEN 'gap' WHEN (bo - stop) * s <= 0 THEN 'past_stop' WHEN (bo - target) * s >= 0 THEN 'past_target' ELSE 'filled' END AS fill_state,
        round(CASE WHEN fill_state = 'filled' THEN bo ELSE entry END, 6) AS entry, round(CASE WHEN fill_state = 'filled' THEN bo + s * 2.0 * abs(bo - stop) ELSE target END, 6) AS target FROM fut WHERE i = bar_idx + 1""",
        "fut",
    ),
)
def label_next_open(spark: SparkSession, d: str) -> DataFrame:
    rows, bars = breakouts(spark, d)
    return rounded(lab.next_open_fill(lab.with_future(rows, bars, HORIZON).where(F.size("future") > 0)), "candidate_id", "fill_state", entry="entry", target="target")


@register("touch_fill", sql.query("SELECT c.candidate_id, CASE WHEN min(i) FILTER ((good - entry) * s >= 0) IS NULL THEN 'expired' ELSE 'filled' END AS fill_state, coalesce(min(i) FILTER ((good - entry) * s >= 0), -1) AS fill_idx FROM cand c LEFT JOIN (SELECT candidate_id, i, good, s FROM fut) f USING (candidate_id) GROUP BY ALL", "cand", "fut"))
def touch_fill(spark: SparkSession, d: str) -> DataFrame:
    rows, bars = breakouts(spark, d)
    rows = lab.touch_fill(lab.with_future(rows, bars, HORIZON))
    return rows.select("candidate_id", "fill_state", F.coalesce(F.when(F.col("fill_state") == "filled", F.try_element_at("future", F.lit(1))["bar_idx"]), F.lit(-1)).alias("fill_idx"))


sql.define(
    "lane",
    """SELECT symbol, candidate_id, bar_idx, exit_idx, 1 AS k FROM (SELECT * FROM trades QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_idx, candidate_id) = 1)
    UNION ALL SELECT symbol, candidate_id, bar_idx, exit_idx, k FROM (SELECT t.symbol, t.candidate_id, t.bar_idx, t.exit_idx, l.k + 1 AS k, row_number() OVER (PARTITION BY t.symbol ORDER BY t.bar_idx, t.candidate_id) AS n FROM lane l JOIN trades t ON t.symbol = l.symbol AND t.bar_idx > l.exit_idx) WHERE n = 1""",
    "trades",
)


@register("lane_trades", _recursive(sql.query("SELECT symbol, candidate_id, bar_idx, exit_idx FROM lane", "lane")))
def lane_trades(spark: SparkSession, d: str) -> DataFrame:
    return lab.lanes(trades(spark, d)).select("symbol", "candidate_id", "bar_idx", "exit_idx")


@register("equity_curve", _recursive(sql.query("SELECT symbol, candidate_id, row_number() OVER w AS seq, round(100 * exp(sum(ln(1 + 0.01 * r)) OVER w), 6) AS balance, round(greatest(100.0, max(b0) OVER w), 6) AS peak FROM (SELECT l.symbol, l.candidate_id, t.r, t.exit_ts, 100 * exp(sum(ln(1 + 0.01 * t.r)) OVER (PARTITION BY l.symbol ORDER BY t.exit_ts, l.candidate_id)) AS b0 FROM lane l JOIN trades t USING (candidate_id)) WINDOW w AS (PARTITION BY symbol ORDER BY exit_ts, candidate_id)", "lane", "trades")))
def equity_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lab.compounded(lab.lanes(trades(spark, d))), "symbol", "candidate_id", "seq", balance="balance", peak="peak")


sql.define("lt", "SELECT t.* FROM lane l JOIN trades t USING (candidate_id)", "lane", "trades")
sql.define(
    "lev",
    """SELECT e.*, s.place FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY t, kind, candidate_id) AS k FROM (
      SELECT direction AS book, candidate_id, r, submit_ts AS t, 1 AS kind FROM lt UNION ALL SELECT direction, candidate_id, r, exit_ts, CASE WHEN exit_ts > submit_ts THEN 0 ELSE 2 END FROM lt)) e
    JOIN (SELECT candidate_id, row_number() OVER (PARTITION BY direction ORDER BY submit_ts, candidate_id) AS place FROM lt) s USING (candidate_id)""",
    "lt",
)
sql.define(
    "led",
    """SELECT DISTINCT book, 0::BIGINT AS k, ''::VARCHAR AS candidate_id, 1 AS kind, 0.0::DOUBLE AS risk, 100.0::DOUBLE AS balance, 100.0::DOUBLE AS peak, []::DOUBLE[] AS risks FROM lev
    UNION ALL SELECT l.book, e.k, e.candidate_id, e.kind, l.risks[e.place], CASE WHEN e.kind = 1 THEN l.balance ELSE l.balance + e.r * l.risks[e.place] END,
      greatest(l.peak, CASE WHEN e.kind = 1 THEN l.balance ELSE l.balance + e.r * l.risks[e.place] END), CASE WHEN e.kind = 1 THEN list_append(l.risks, greatest(0.0, l.balance) * 0.01) ELSE l.risks END
    FROM led l JOIN lev e ON e.book = l.book AND e.k = l.k + 1""",
    "lev",
)


@register("shared_ledger", _recursive(sql.query("SELECT book AS direction, candidate_id, row_number() OVER (PARTITION BY book ORDER BY k) AS seq, round(risk, 6) AS risk, round(balance, 6) AS balance, round(peak, 6) AS peak FROM led WHERE kind <> 1", "led")))
def shared_ledger(spark: SparkSession, d: str) -> DataFrame:
    """A long and a short book over all symbols' lanes, in which trades overlap."""
    rows = lab.ledger(lab.lanes(trades(spark, d)).withColumnRenamed("submit_ts", "ts"), by=["direction"])
    return rounded(rows, "direction", "candidate_id", "seq", risk="risk", balance="balance", peak="peak")


@register(
    "risk_candidates",
    sql.query(
        f""", lv AS (SELECT symbol, frame_idx, list(level) AS levels FROM flv GROUP BY ALL),
        c AS (SELECT c.*, coalesce(levels, []) AS lv, {_SIGN} AS s FROM cand c LEFT JOIN lv ON lv.symbol = c.symbol AND lv.frame_idx = c.bar_idx),
        g AS (SELECT *, list_filter(list_transform(range(0, 21), lambda i: round(2 + 0.1 * i, 10)), lambda k: len(list_filter(lv, lambda x: (x > least(entry, entry + s * k * abs(entry - stop)) AND x < greatest(entry, entry + s * k * abs(entry - stop))) OR abs(x - (entry + s * k * abs(entry - stop))) < 0.05 * atr)) = 0)[1] AS rr,
        len(list_filter(lv, lambda x: x > least(entry, stop) AND x < greatest(entry, stop))) > 0 AS crosses FROM c)
        SELECT candidate_id, round(rr, 6) AS rr, crosses, CASE WHEN crosses THEN 'stop_crosses_level' WHEN rr IS NULL THEN 'no_clear_target' END AS reject_reason FROM g""",
        "cand",
        "flv",
    ),
)
def risk_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The least clear reward of the breakouts' brackets, given the levels that are known at their bars."""
    return rounded(judged_of(base(spark, d)), "candidate_id", "crosses", "reject_reason", rr="rr")


def judged_of(bars: DataFrame) -> DataFrame:
    rows = with_levels(breakouts_of(bars)[0], bars)
    lv, e, s = F.col("levels"), F.col("entry"), F.col("stop")
    rows = rows.withColumns({"rr": cand.reward(lv, e, s, F.col("atr"), 0.05), "crosses": F.exists(lv, lambda x: (x > F.least("entry", "stop")) & (x < F.greatest("entry", "stop")))})
    return rows.withColumn("reject_reason", F.when(F.col("crosses"), "stop_crosses_level").when(F.col("rr").isNull(), "no_clear_target"))
