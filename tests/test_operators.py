"""Hand cases and brute-force versions of operators that SQL expresses badly."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.text import note_state, pip_size, review_tag
from tidemark.operators import candidates, dashboards, documents, extension, indicators, labels, metrics, pivots, resampling, review, sweeps
from tidemark.operators.indicators import indexed
from tidemark.sources import bars as src
from tidemark.streaming import positions

T0 = dt.datetime(2024, 1, 1)


def bars_of(spark, values, symbol="x"):
    rows = [(symbol, T0 + dt.timedelta(hours=i), float(o), float(h), float(lo), float(c), 1.0) for i, (o, h, lo, c) in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")


def noise(n, seed=3):
    import random

    rng, out, p = random.Random(seed), [], 100.0
    for _ in range(n):
        o, p = p, p + rng.gauss(0, 2)
        out.append((o, max(o, p) + rng.random(), min(o, p) - rng.random(), p))
    return out


def candidate(spark, direction, entry, stop, target):
    return spark.createDataFrame([("x", T0, 0, "a", direction, entry, stop, target, 1.0)], "symbol string, ts timestamp, bar_idx long, candidate_id string, direction string, entry double, stop double, target double, atr double")


@pytest.mark.parametrize(
    ("after", "kind", "reason", "r"),
    [
        ([(100, 104, 96, 100)], {}, "stop", -1.0),  # both on one bar: the stop counts
        ([(100, 101, 99, 100), (100, 104, 99, 103)], {}, "target", 1.0),
        ([(100, 101, 99, 100.5)], {}, "timeout", 0.5 / 3),
        ([(100, 102, 99, 100), (100, 101, 99, 100)], {"breakeven_rr": 0.5}, "breakeven", 0.0),
        ([(100, 102, 100.5, 101), (101, 101, 99.5, 100)], {"scale": (0.5, 0.5, None, None)}, "runner_stop", 0.25),
    ],
)
def test_exit_rules(spark, after, kind, reason, r):
    bars = indexed(bars_of(spark, [(100, 101, 99, 100), *after]))
    row = labels.label(labels.with_future(candidate(spark, "bullish", 100.0, 97.0, 103.0), bars, 5), **kind).first()
    assert (row["exit_reason"], round(row["r"], 9)) == (reason, round(r, 9))


def test_fractal_pivots_need_strictness_and_emit_high_first(spark):
    bars = indexed(bars_of(spark, [(5, 5, 4, 5), (5, 5, 4, 5), (5, 9, 1, 5), (5, 6, 2, 5), (5, 6, 2, 5)]))
    assert [(p["bar_idx"], p["type"], p["confirm_idx"]) for p in pivots.pivots(bars, 2, 1).orderBy("seq").collect()] == [(2, "H", 3), (2, "L", 3)]


def test_shared_ledger_sizes_at_submission(spark):
    t = [T0 + dt.timedelta(hours=i) for i in range(5)]
    rows = [("a", t[0], t[3], 1.0), ("b", t[1], t[2], -1.0)]
    out = labels.ledger(spark.createDataFrame(rows, "candidate_id string, ts timestamp, exit_ts timestamp, r double"), 0.1, 100.0).orderBy("seq").collect()
    assert [(o["candidate_id"], o["risk"], round(o["balance"], 9)) for o in out] == [("b", 10.0, 90.0), ("a", 10.0, 100.0)]


def test_shuffles_keep_the_return(spark):
    rows = spark.createDataFrame([(f"c{i}", T0 + dt.timedelta(hours=i), [1.0, -0.5][i % 2], ["win", "loss"][i % 2]) for i in range(12)], "candidate_id string, exit_ts timestamp, r double, result string")
    ends = resampling.outcomes(resampling.shuffled(resampling.numbered(rows), 20)).collect()
    assert len({round(e["total_return"], 9) for e in ends}) == 1
    assert len({round(e["max_drawdown"], 9) for e in ends}) > 1


def test_draws_are_independent(spark):
    """The bootstrap's spread is the analytic standard error, and every trade is drawn equally often."""
    r = [(-1.0) ** i * (1 + i % 7) for i in range(60)]
    rows = spark.createDataFrame([(f"c{i:03}", T0 + dt.timedelta(hours=5 * i), x, "win" if x > 0 else "loss") for i, x in enumerate(r)], "candidate_id string, exit_ts timestamp, r double, result string")
    numbered = resampling.numbered(rows).cache()
    assert [x["r"] for x in numbered.orderBy("i").collect()] == r and numbered.agg(F.max("n")).first()[0] == 60
    drawn = resampling.simulated(numbered, 1000)
    sd = np.std(r)
    spread = drawn.groupBy("sim").agg(F.avg("r").alias("m")).agg(F.stddev("m")).first()[0]
    assert spread == pytest.approx(sd / 60**0.5, rel=0.1)
    often = [x["n"] for x in drawn.groupBy("r").agg(F.count("*").alias("n")).collect()]
    assert sum(often) == 60_000
    lag = drawn.withColumn("b", F.lag("r").over(Window.partitionBy("sim").orderBy("k"))).agg(F.corr("r", "b")).first()[0]
    assert abs(lag) < 0.02


def test_long_horizons_draw_more_trades_than_there_are(spark):
    """A game with a small edge seldom ends under the start in the long run; the rate of the history tells how many trades that is."""
    rows = spark.createDataFrame([(f"c{i:03}", T0 + dt.timedelta(days=9 * i), [1.3, -1.0][i % 2], ["win", "loss"][i % 2]) for i in range(41)], "candidate_id string, exit_ts timestamp, r double, result string")
    got = {x["years"]: x["p_negative"] for x in resampling.negative_share(rows, (1, 3, 5), 1000).collect()}
    logs = np.log(1 + 0.01 * np.array([[1.3, -1.0][i % 2] for i in range(41)]))
    rng = np.random.default_rng(5)
    for years, p in got.items():
        n = round(years * 41 / (360 / 365.25))
        expected = (rng.choice(logs, (4000, n)).sum(axis=1) < 0).mean()
        assert p == pytest.approx(expected, abs=0.05)
    assert got[5] < got[1]


def test_ruin_is_minus_infinity(spark):
    row = spark.createDataFrame([(-200.0,), (1.0,)], "r double").select(resampling.log_growth(F.col("r"), 0.01).alias("g")).collect()
    assert row[0]["g"] == float("-inf") and row[1]["g"] == pytest.approx(np.log(1.01))


def test_audit_finds_a_look_ahead(spark):
    bars = bars_of(spark, noise(60))
    ahead = F.lead("close").over(Window.partitionBy("symbol").orderBy("ts"))
    facts = {"close": lambda b: b.select("symbol", "ts", "close"), "next": lambda b: b.select("symbol", "ts", ahead.alias("next"))}
    got = {r["fact"]: r["n_changed"] for r in review.causality(bars, facts, [str(T0 + dt.timedelta(hours=30))]).collect()}
    assert got["close"] == 0 and got["next"] > 0


def test_levels_in_view_see_confirmed_swings_only(spark):
    bars = indicators.with_atr_sma(indicators.indexed(bars_of(spark, noise(80))))
    frames = pivots.visible_swings(pivots.with_pivots(bars), 40).select("symbol", F.col("bar_idx").alias("frame_idx"), "swings")
    found = {(r["frame_idx"], r["kind"], round(r["level"], 9), r["touches"]) for r in pivots.levels_in_view(frames, bars, 0.3).collect()}
    rows = {r["bar_idx"]: r for r in bars.collect()}
    expected = set()
    for n in rows:
        for kind, name in (("L", "support"), ("H", "resistance")):
            seen = []
            for i in range(max(2, n - 39), n):  # a pivot needs the bar after it
                side = (lambda j: -rows[j]["low"]) if kind == "L" else (lambda j: rows[j]["high"])
                if side(i) > max(side(i - 1), side(i - 2)) and side(i) > side(i + 1):
                    seen.append((abs(side(i)), i))
            island, reach = [], None
            for price, i in [*sorted(seen), (None, None)]:
                band = rows[i]["atr"] * 0.3 if i is not None else 0
                if price is None or reach is not None and price - band > reach:
                    if len(island) > 1:
                        expected.add((n, name, round(sum(island) / len(island), 9), len(island)))
                    island, reach = [], None
                if price is not None:
                    island.append(price)
                    reach = max(reach or price + band, price + band)
    assert found == expected and found


def test_documents_survive_torn_and_odd_ones(spark):
    t = F.lit(T0)
    bars = bars_of(spark, noise(200))
    none = bars.limit(0).select("symbol", "ts", F.lit("x").alias("what"))
    facts = bars.select("symbol", "ts", F.lit("close").alias("name"), F.col("close").alias("value"))
    trades = bars.limit(0).select("symbol", t.alias("submit_ts"), F.lit("c").alias("candidate_id"), F.lit("bullish").alias("direction"), *[F.lit(1.0).alias(c) for c in ("entry", "stop", "target", "r")], t.alias("exit_ts"), F.lit("stop").alias("exit_reason"), F.lit("loss").alias("result"))
    balances = bars.limit(1).select("symbol", "ts", F.lit(0).cast("long").alias("seq"), F.lit(100.0).alias("balance"))
    written = documents.run_documents(bars, facts, bars.limit(3).select("symbol", "ts", F.lit("p").alias("what")), none, trades, balances)
    odd = spark.createDataFrame([("y", None, "{"), ("y", None, ""), ("y", None, None), ("y", None, "[1, 2]"), ("y", None, '{"other": 1}')], "symbol string, part timestamp, document string")
    opened = documents.opened(written.unionByName(odd))
    assert opened.select("symbol").distinct().count() == 1
    assert documents.facts_of(opened).exceptAll(facts).isEmpty() and documents.facts_of(opened).count() == 200
    assert documents.candles_of(opened).select("ts", "close").exceptAll(bars.select("ts", "close")).isEmpty()
    assert documents.texts_of(opened, "patterns_by_ts").count() == 3 and documents.trades_of(opened).count() == 0


def test_swing_stops_and_clear_rewards_equal_a_loop(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(150):
        swings = [(k, T0, "LH"[int(rng.integers(2))], float(100 + rng.normal(0, 4))) for k in range(int(rng.integers(0, 6)))]
        rows.append((f"c{i}", ["bullish", "bearish"][i % 2], float(100 + rng.normal()), float(abs(rng.normal(1.5, 0.7))) + 0.1, swings, [float(x) for x in 100 + rng.normal(0, 7, int(rng.integers(0, 5)))]))
    df = spark.createDataFrame(rows, f"candidate_id string, direction string, close double, atr double, swings array<{pivots.PIVOT}>, levels array<double>")
    got = {r["candidate_id"]: r for r in candidates.risk_candidates(df, 3.0, 0.3).collect()}
    reasons = set()
    for name, direction, entry, atr, swings, levels in rows:
        s = 1 if direction == "bullish" else -1

        def reward(stop, s=s, entry=entry, atr=atr, levels=levels):
            for rr in candidates.REWARDS:
                target = entry + s * rr * abs(entry - stop)
                if not any(min(entry, target) < x < max(entry, target) or abs(x - target) < 0.3 * atr for x in levels):
                    return rr
            return None

        own = [p[3] for p in swings if p[2] == ("L" if s > 0 else "H") and (entry - p[3]) * s > 0]
        stop = own[-1] - s * 0.1 * atr if own else entry - s * 2 * atr
        rr, why = reward(stop), None
        if abs(entry - stop) > 3 * atr:
            why = "stop_too_wide"
        elif any(min(entry, stop) < x < max(entry, stop) for x in levels):
            why = "stop_crosses_level"
        elif rr is None:
            why = "no_clear_target"
        spaced = False
        if why:
            for w in [round(0.1 * k, 10) for k in range(30, 4, -1)]:
                at = entry - s * w * atr
                if (found := reward(at)) is not None and not any(abs(x - at) < 0.3 * atr for x in levels):
                    stop, rr, why, spaced = at, found, None, True
                    break
        reasons.add((why, spaced))
        r = got[name]
        assert (r["reject_reason"], bool(r["spaced"])) == (why, spaced), name
        assert r["stop"] == pytest.approx(stop) and r["rr"] == pytest.approx(rr)
        if rr:
            assert r["target"] == pytest.approx(entry + s * rr * abs(entry - stop))
    assert len(reasons) >= 4


def test_costs_and_balances_of_odd_books(spark):
    rows = spark.createDataFrame([("a", "bullish", "win", "target", 2.0, 100.0, 97.0, 30.0, 60.0, T0, T0 + dt.timedelta(days=100)), ("a", "bullish", "loss", "stop", -1.0, 100.0, 97.0, 30.0, -30.0, T0, T0 + dt.timedelta(days=200))], "symbol string, direction string, result string, exit_reason string, r double, entry double, stop double, risk_amount double, pnl double, submit_ts timestamp, exit_ts timestamp").withColumn("candidate_id", F.col("exit_reason"))
    assert metrics.risk_fraction(rows, 1000.0, "symbol").first()["risk_fraction"] == pytest.approx(0.03)
    assert metrics.risk_fraction(rows.withColumn("risk_amount", F.lit(None).cast("double")), 1000.0, "symbol").first()["risk_fraction"] == 0.01
    curve = spark.createDataFrame([("a", T0, 1030.0)], "symbol string, ts timestamp, balance double")
    assert [dashboards.initial_balance(rows, c, e, "symbol").first()[1:] for c, e in ((curve, None), (None, None), (None, 5.0))] == [(1000.0, "derived_final_minus_pnl"), (100.0, "default_index"), (5.0, "explicit")]
    free = dashboards.gross_vs_net(metrics.with_costs(rows, risk=1.0), "symbol").first()
    assert (free["return_drag_pct"], free["expectancy_drag_r"], free["sign_flips"]) == (0.0, 0.0, "")
    dear = dashboards.gross_vs_net(metrics.with_costs(rows, flat=1.0), "symbol").first()
    assert dear["expectancy_drag_r"] == pytest.approx(1.0) and "expectancy" in dear["sign_flips"] and dear["break_even_gross"] == pytest.approx(1 / 3)
    record = dashboards.portfolio(rows, "symbol").first()
    assert record["final_balance"] == pytest.approx(101.0) and record["cagr_pct"] == pytest.approx((1.01 ** (365.25 / 100) - 1) * 100) and record["max_drawdown_pct"] == pytest.approx(100 / 102)


def test_store_round_trip(spark, tmp_path):
    bars = bars_of(spark, noise(30)).withColumn("timeframe", F.lit("1h"))
    src.write_store(bars, str(tmp_path / "s"))
    src.write_store(bars.withColumn("symbol", F.lit("y")), str(tmp_path / "s"))
    back = src.read_store(spark, str(tmp_path / "s"))
    assert src.catalog(back).count() == 2
    assert back.where("symbol = 'x'").select(*bars.columns).exceptAll(bars).isEmpty()


def test_scan_reads_names(spark, tmp_path):
    one = bars_of(spark, noise(3)).select(F.col("ts").alias("timestamp"), "open", "high", "low", "close", "volume").toPandas()
    one.to_parquet(tmp_path / "EURUSD.1d.parquet", coerce_timestamps="us")
    assert {(r["symbol"], r["timeframe"]) for r in src.scan(spark, str(tmp_path)).collect()} == {("EURUSD", "1d")}


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    bars = bars_of(spark, noise(120)).unionByName(bars_of(spark, noise(120, 9), "y")).cache()
    expected = positions.batch_events(bars).collect()
    cut = T0 + dt.timedelta(hours=50)
    bars.where(F.col("ts") < cut).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(bars.schema).parquet(str(tmp_path / "in"))

    def run():
        q = positions.stream_events(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    late = bars.where(F.col("ts") < T0 + dt.timedelta(hours=3))
    bars.where(F.col("ts") >= cut).unionByName(late).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = spark.read.parquet(str(tmp_path / "out")).select(*positions._COLUMNS).collect()
    assert sorted(map(str, got)) == sorted(map(str, expected))
    assert any(e["kind"] == "exit" for e in expected)


def test_sweep_expands_nested_choices():
    assert [tuple(v.values()) for v in sweeps.expanded({"a": [1, [2, 3]], "b": ["x", "y"]})] == [(1, "x"), (1, "y"), (2, "x"), (2, "y"), (3, "x"), (3, "y")]
    with pytest.raises(ValueError, match="no choice"):
        sweeps.expanded({"a": []})


def test_fact_operators_are_ordered_and_checked(spark):
    add = extension.FactOp("add", ("close",), ("one",), lambda df, by=1: df.withColumn("one", F.col("close") + by), {"by": 1})
    twice = extension.FactOp("twice", ("base",), ("two",), lambda df: df.withColumn("two", F.col("base") * 2), bindings={"base": "one"})
    df = spark.createDataFrame([(1.0,)], "close double")
    assert extension.facts(df, [twice, add], ["two"]).first()["two"] == 4.0
    with pytest.raises(ValueError, match="which nothing makes"):
        extension.ordered([twice], ["close"])
    loop = extension.FactOp("loop", ("two",), ("one",), lambda df: df)
    with pytest.raises(ValueError, match="cycle"):
        extension.ordered([twice, loop], ["close"])


def test_small_texts(spark):
    df = spark.createDataFrame([("USDJPY", "<!-- REVIEW: a b -->", ""), ("EURUSD", "none", None)], "s string, c string, n string")
    got = df.select(pip_size(F.col("s")).alias("p"), review_tag(F.col("c")).alias("t"), note_state(F.col("n")).alias("n")).collect()
    assert [tuple(r) for r in got] == [(0.01, "a b", "empty"), (0.0001, None, "none")]


@pytest.mark.parametrize("exclusive", [True, False])
def test_lanes_by_islands_are_the_walk_over_all(spark, exclusive):
    import random

    rng = random.Random(4)
    rows = [(s, f"{s}{i}", b, b + rng.randint(0, 6)) for s in ("x", "y") for i, b in enumerate(sorted(rng.randint(0, 120) for _ in range(60)))]
    expected, free = set(), {}
    for s, c, a, b in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if s not in free or (a > free[s] if exclusive else a >= free[s]):
            expected.add(c)
            free[s] = b
    got = labels.lanes(spark.createDataFrame(rows, "symbol string, candidate_id string, bar_idx long, exit_idx long"), exclusive)
    assert got.columns == ["symbol", "candidate_id", "bar_idx", "exit_idx"] and {r["candidate_id"] for r in got.collect()} == expected


@pytest.mark.parametrize("fraction", [0.05, 0.6])
def test_ledger_by_islands_is_the_walk_over_all(spark, fraction):
    """With the larger fraction some books lose everything on the way."""
    import random

    rng = random.Random(9)
    rows = []
    for b in ("a", "b", "c"):
        for i in range(40):
            start = rng.randint(0, 90)
            rows.append((b, f"{b}{i:02d}", T0 + dt.timedelta(hours=start), T0 + dt.timedelta(hours=start + rng.choice([0, 1, 2, 5])), rng.choice([-1.0, -1.0, 0.5, 2.0])))
    expected = {}
    for b in ("a", "b", "c"):
        own = [r for r in rows if r[0] == b]
        events = sorted([(r[2], 1, r[1], r) for r in own] + [(r[3], 0 if r[3] > r[2] else 2, r[1], r) for r in own])
        balance, peak, risk, seq = 100.0, 100.0, {}, 0
        for _, kind, c, r in events:
            if kind == 1:
                risk[c] = max(0.0, balance) * fraction
            else:
                balance, seq = balance + r[4] * risk[c], seq + 1
                peak = max(peak, balance)
                expected[c] = (seq, risk[c], balance, peak)
    got = labels.ledger(spark.createDataFrame(rows, "book string, candidate_id string, ts timestamp, exit_ts timestamp, r double"), fraction, by=["book"]).collect()
    assert {r["candidate_id"]: r["seq"] for r in got} == {c: v[0] for c, v in expected.items()}
    for r in got:
        assert (r["risk"], r["balance"], r["peak"]) == pytest.approx(expected[r["candidate_id"]][1:], abs=1e-9)
