"""Stores, streams that stop and go on, replay, charts, reports and analyzers: hand cases and brute-force versions."""

import datetime as dt
import json

import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from test_operators import T0, bars_of, noise
from tidemark.operators import analyzers, bundle, charts, factcodec, replay, report
from tidemark.operators.extension import FactOp
from tidemark.operators.indicators import indexed
from tidemark.sources import files, snapshots
from tidemark.streaming import keyed, ledger


def hours(*at):
    return [T0 + dt.timedelta(hours=h) for h in at]


def keyed_bars(spark, n=60, symbols=("x", "y"), timeframe="1h"):
    rows = None
    for i, s in enumerate(symbols):
        part = bars_of(spark, noise(n, 3 + i), s)
        rows = part if rows is None else rows.unionByName(part)
    return rows.withColumn("timeframe", F.lit(timeframe))


# streams


def test_a_batch_that_runs_again_counts_once_and_readers_go_on(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "symbol string, ts timestamp"
    put = ledger.sink(path, "q")
    batch = lambda *at: spark.createDataFrame([("x", t) for t in hours(*at)], schema)
    assert ledger.taken(spark, path, "q", schema)[1] == -1
    put(batch(1, 2), 0)
    put(batch(1, 2), 0)
    rows, cursor = ledger.taken(spark, path, "q", schema)
    assert (rows.count(), cursor) == (2, 0)
    batch(9).write.parquet(f"{path}/rows/query=q/batch=1")  # written, and its entry not yet
    assert ledger.taken(spark, path, "q", schema, cursor)[0].count() == 0
    put(batch(3), 1)
    rows, cursor = ledger.taken(spark, path, "q", schema, cursor)
    assert ([r["ts"] for r in rows.collect()], cursor) == (hours(3), 1)
    assert ledger.taken(spark, path, "q", schema, cursor)[1] == 1 and ledger.taken(spark, path, "other", schema)[0].count() == 0


def test_late_rows_are_those_behind_the_watermark_of_the_batches_before(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "symbol string, ts timestamp"
    put = ledger.sink(path, "q", delay="2 HOURS")
    for n, at in enumerate([(5, 1), (2, 3, 6), (4, 8)]):
        put(spark.createDataFrame([("x", t) for t in hours(*at)], schema), n)
    kept, late = (sorted(r["ts"] for r in ledger.taken(spark, path, "q", schema, side=s)[0].collect()) for s in ("rows", "late"))
    assert kept == hours(1, 3, 4, 5, 6, 8) and late == hours(2)  # 4 is at the watermark, not behind it


@pytest.mark.parametrize("parts", [1, 3])
def test_heartbeats_whatever_the_batches(spark, tmp_path, parts):
    rows = spark.createDataFrame([("x", t) for t in hours(0, 1, 9, 10)] + [("y", t) for t in hours(0, 3, 20)], "symbol string, ts timestamp")
    edges = [-1, 21] if parts == 1 else [-1, 2, 9.5, 21]
    cuts = [(F.col("ts") > F.lit(T0 + dt.timedelta(hours=a))) & (F.col("ts") <= F.lit(T0 + dt.timedelta(hours=b))) for a, b in zip(edges, edges[1:], strict=False)]
    keyed.played(rows, cuts, lambda s: keyed.heartbeats(s, "3 hours", "1 hour"), ledger.sink(f"{tmp_path}/t", "b"), str(tmp_path))
    got = sorted((r["symbol"], r["ts"], r["last_ts"], r["missed"]) for r in ledger.taken(spark, f"{tmp_path}/t", "b", keyed.BEATS)[0].collect())
    beats = lambda s, last, *at: [(s, *hours(t, last), i) for i, t in enumerate(at, 1)]
    assert got == sorted(beats("x", 1, 4, 7) + beats("x", 10, 13, 16, 19) + beats("y", 3, 6, 9, 12, 15, 18))


def test_a_warm_stream_goes_on_like_one_that_saw_all(spark, tmp_path):
    bars = keyed_bars(spark, 80).select("symbol", "ts", "high", "low", "close")
    cut = F.col("ts") >= F.lit(T0 + dt.timedelta(hours=50))
    first = keyed.warm(bars.where(~cut), 1)
    assert first.select(F.max(F.size("ts"))).first()[0] == keyed.PERIOD + 1
    first.write.parquet(f"{tmp_path}/first")
    for name, cuts, make in (("all", [~cut, cut], keyed.indicators), ("warm", [cut], lambda s: keyed.indicators(s, s.sparkSession.read.parquet(f"{tmp_path}/first")))):
        keyed.played(bars, cuts, make, ledger.sink(f"{tmp_path}/{name}/t", "i"), f"{tmp_path}/{name}")
    rows = [ledger.taken(spark, f"{tmp_path}/{n}/t", "i", keyed.INDICATORS)[0].where(cut).drop("batch").toPandas().sort_values(["symbol", "ts"], ignore_index=True) for n in ("all", "warm")]
    pd.testing.assert_frame_equal(*rows)
    assert len(rows[0]) == 60 and rows[0]["atr"].notna().all()
    held = {r["symbol"]: r for r in keyed.tails(keyed.session(spark), f"{tmp_path}/warm/checkpoint").collect()}
    assert len(held["x"]["ts"]) == keyed.PERIOD + 1 and held["x"]["ts"][-1] == T0 + dt.timedelta(hours=79)


# stores


def test_bar_files_prune_replace_and_refuse(spark, tmp_path):
    own, path = files.session(spark), str(tmp_path / "bars")
    bars = keyed_bars(own).unionByName(keyed_bars(own, 20, ("x",), "4h"))
    put = lambda rows, mode: files.save(rows.repartition(3), path, mode)
    put(bars, "append")
    assert not [*(tmp_path / "bars").glob("_*")]
    held = lambda: files.load(own, path)
    assert held().count() == 140 and sorted(map(tuple, held().select("symbol", "timeframe", "ts", "close").collect())) == sorted(map(tuple, bars.select("symbol", "timeframe", "ts", "close").collect()))
    one = held().where("symbol = 'x' AND timeframe = '4h'")
    assert one.count() == 20 and one.rdd.getNumPartitions() == len([*(tmp_path / "bars").glob("x.4h.*")])
    assert held().where("symbol = 'z'").count() == 0 and held().where("symbol = 'x' AND symbol = 'y'").count() == 0
    put(bars.where("symbol = 'x' AND timeframe = '1h'").limit(7), "overwrite")
    assert {(r[0], r[1]): r[2] for r in held().groupBy("symbol", "timeframe").count().collect()} == {("x", "1h"): 7, ("x", "4h"): 20, ("y", "1h"): 60}
    pq.write_table(pq.read_table(next((tmp_path / "bars").glob("y.1h.*"))).drop_columns(["volume"]), tmp_path / "bars" / "w.1h.parquet")
    with pytest.raises(Exception, match="lacks"):
        held().where("symbol = 'w'").count()
    (tmp_path / "bars" / "w.1h.parquet").unlink()
    (tmp_path / "bars" / "notes.txt").write_text("no bars")
    assert held().count() == 87
    with pytest.raises(Exception, match="no file can be named"):
        put(bars.withColumn("timeframe", F.lit("3h")), "append")
    assert held().count() == 87 and not [*(tmp_path / "bars").glob("_*")]
    assert files.load(own, str(tmp_path / "nothing")).count() == 0


def test_snapshots_are_whole_pinned_and_ordered(spark, tmp_path):
    path, bars = str(tmp_path / "s"), keyed_bars(spark)
    assert snapshots.versions(spark, path) == [] and snapshots.read(spark, path).count() == 0
    assert snapshots.replace(bars, path) == 1
    a, b = snapshots.prepare(bars.where("symbol = 'x'").limit(5), path), snapshots.prepare(bars.where("symbol = 'y'").limit(3), path)
    assert snapshots.read(spark, path).count() == 120
    pinned = snapshots.read(spark, path, 1)
    assert (snapshots.commit(b), snapshots.commit(a)) == (2, 3)  # both count, whoever was first
    assert pinned.count() == 120 and snapshots.read(spark, path, 2).count() == 63 and snapshots.read(spark, path).count() == 8
    assert snapshots.vacuum(spark, path, 2) == 0  # version 2 still has x of the first run
    assert snapshots.replace(bars.limit(1), path) == 4 and snapshots.vacuum(spark, path, 1) == 2
    assert snapshots.versions(spark, path) == [4] and snapshots.read(spark, path).count() == 4
    with pytest.raises(ValueError, match="not there"):
        snapshots.read(spark, path, 1)


def test_a_commit_that_comes_second_takes_the_next_number(spark, tmp_path, monkeypatch):
    path, bars = str(tmp_path / "s"), keyed_bars(spark)
    snapshots.replace(bars, path)
    waiting, seen = snapshots.prepare(bars.where("symbol = 'x'").limit(5), path), snapshots.versions
    stale = [[]]
    monkeypatch.setattr(snapshots, "versions", lambda *a: stale.pop() if stale else seen(*a))
    assert snapshots.commit(waiting) == 2 and snapshots.read(spark, path, 2).count() == 65


def test_bundles_are_whole_or_not_there(spark, tmp_path):
    path, rows = str(tmp_path / "b"), spark.range(5)
    assert bundle.runs(spark, path) == []
    bundle.write({"a": rows, "b": rows.limit(2)}, path, "one")
    first = bundle.read(spark, path, "one")
    with pytest.raises(Exception):  # noqa: B017
        bundle.write({"a": rows, "b": rows.select(F.raise_error(F.lit("stop")).alias("x"))}, path, "two")
    assert bundle.runs(spark, path) == ["one"]
    bundle.write({"a": rows.limit(1)}, path, "one")
    assert {n: t.count() for n, t in bundle.read(spark, path, "one").items()} == {"a": 1} and first["b"].count() == 2
    assert bundle.vacuum(spark, path) == 2
    for bad in ("two", "../one"):
        with pytest.raises(ValueError):
            bundle.read(spark, path, bad)
    with pytest.raises(ValueError, match="can't name"):
        bundle.write({"a": rows}, path, "a/b")


def test_monthly_pivot(spark):
    months = spark.createDataFrame([("x", dt.datetime(2024, 1, 1), 2.0), ("x", dt.datetime(2024, 12, 1), -1.0), ("x", dt.datetime(2025, 1, 1), 0.0)], "symbol string, month timestamp, pnl double")
    rows = {(r["symbol"], r["year"]): r for r in bundle.monthly_pivot(months).collect()}
    assert rows["x", 2024]["01"] == 2.0 and rows["x", 2024]["12"] == -1.0 and rows["x", 2024]["02"] is None and rows["x", 2025]["01"] == 0.0


# facts


def test_facts_of_all_kinds_and_of_none(spark):
    row = spark.createDataFrame([("x", T0, 1.5)], "symbol string, ts timestamp, v double").withColumn("name", F.lit("n"))
    made = [
        row.withColumn("fact", factcodec.encoded("mean", period=F.lit(20), value=F.col("v"))),
        row.withColumn("fact", factcodec.encoded("pattern", direction=F.lit("bullish"), confirmed_at=F.col("ts"), prices=F.array(F.lit(1.0), F.col("v")))),
        row.withColumn("fact", factcodec.encoded("levels", levels=F.array(F.struct(F.lit("support").alias("kind"), F.col("v").alias("level"), F.lit(2).alias("touches"))))),
        row.withColumn("fact", factcodec.encoded("channel", high=F.col("v"))),
    ]
    texts = ['{"kind": "elsewhere"}', "{torn", "[1]", '{"kind": "mean", "period": "much", "value": 2}']
    more = spark.createDataFrame([("x", T0, "n", t) for t in texts], "symbol string, ts timestamp, name string, text string")
    facts = factcodec.from_text(factcodec.to_text(factcodec.stacked(*made)).unionByName(more))
    assert sorted((r["period"], r["value"]) for r in factcodec.decoded(facts, "mean").collect() if r["period"]) == [(20, 1.5)]
    assert [(r["period"], r["value"]) for r in factcodec.decoded(facts, "mean").where("period is null").collect()] == [(None, 2.0)]
    pattern = factcodec.decoded(facts, "pattern").first()
    assert (pattern["direction"], pattern["confirmed_at"], pattern["prices"]) == ("bullish", T0, [1.0, 1.5])
    assert factcodec.decoded(facts, "levels").first()["levels"][0].asDict() == {"kind": "support", "level": 1.5, "touches": 2}
    channel = factcodec.decoded(facts, "channel").first()
    assert (channel["period"], channel["high"], channel["low"]) == (None, 1.5, None)
    assert {r["kind"]: r["n"] for r in factcodec.unread(facts).collect()} == {"elsewhere": 1, None: 2}
    assert {r["kind"]: r["n"] for r in factcodec.shapes(facts).collect()} == {"mean": 2, "pattern": 1, "levels": 1, "channel": 1, "elsewhere": 1}
    with pytest.raises(ValueError, match="no fields"):
        factcodec.encoded("mean", price=F.lit(1))
    with pytest.raises(ValueError, match="another kind"):
        factcodec.kind_of("mean", "value string")


# replay, charts, reports


def test_replay_is_a_walk_along_the_calendar(spark):
    at = {"x": [0, 1, 2, 5, 6, 9], "y": [1, 3, 4, 9], "late": [8]}
    rows = spark.createDataFrame([(s, t, float(i)) for s, hs in at.items() for i, t in enumerate(hours(*hs))], "symbol string, ts timestamp, close double")
    axis = sorted({h for hs in at.values() for h in hs})
    expected, seen = [], {}
    for tick, h in [*enumerate(axis)][3:]:
        for s, hs in at.items():
            if bars := [b for b in hs if b <= h]:
                expected.append((tick, hours(h)[0], s, hours(bars[-1])[0], seen.get(s) != bars[-1]))
                seen[s] = bars[-1]
    replayed = replay.on_calendar(rows, 3)
    assert sorted(map(tuple, replayed.select("tick", "tick_ts", "symbol", "frame_ts", "judged").collect())) == sorted(expected)
    signals = rows.where("symbol <> 'late'").select("symbol", "ts", F.lit("bullish").alias("direction"))
    told = replay.fills(replay.submissions(replayed, signals), rows).collect()
    judged = {(s, t) for _, _, s, t, j in expected if j and s != "late"}
    assert {(r["symbol"], r["ts"]) for r in told} == judged
    for r in told:
        later = [h for h in at[r["symbol"]] if hours(h)[0] > r["ts"]]
        assert (r["fill_ts"], r["fill_tick"]) == ((hours(later[0])[0], axis.index(later[0])) if later else (None, None))


def test_zigzag_and_spans(spark):
    bars = indexed(bars_of(spark, noise(12)))
    swings = spark.createDataFrame([("x", 1, 2, 10.0), ("x", 2, 5, 4.0), ("x", 3, 5, 8.0), ("x", 4, 7, 6.0)], "symbol string, seq long, bar_idx long, price double")
    got = sorted((r["segment"], r["bar_idx"], r["value"]) for r in charts.zigzag(swings, bars).collect())
    assert got == [(0, 2, 10.0), (0, 3, 8.0), (0, 4, 6.0), (1, 5, 4.0), (2, 5, 8.0), (2, 6, 7.0), (3, 7, 6.0)]
    seen = spark.createDataFrame([("x", i, "support", 5.0, t) for i, t in [(3, 2), (4, 3), (5, 2), (8, 2)]] + [("x", 4, "resistance", 5.0, 2)], "symbol string, frame_idx long, kind string, level double, touches long")
    assert sorted((r["kind"], r["start_idx"], r["end_idx"], r["touches"]) for r in charts.spans(seen).collect()) == [("resistance", 4, 4, 2), ("support", 3, 5, 3), ("support", 8, 8, 2)]
    turns = spark.createDataFrame([("x", t, w) for t, w in zip(hours(0, 1, 2, 3, 4), ["up", "up", None, "down", "up"], strict=True)], "symbol string, ts timestamp, w string")
    assert [(r["ts"], r["text"]) for r in charts.changes(turns, F.col("w"), "m").orderBy("ts").collect()] == [*zip(hours(0, 3, 4), ["up", "down", "up"], strict=True)]


def test_report_scopes_dispersion_and_lines(spark):
    rows = [("x", dt.datetime(2023, 5, 1), 2.0, "win", "a"), ("x", dt.datetime(2024, 5, 1), -1.0, "loss", "a"), ("y", dt.datetime(2024, 6, 1), 1.0, "win", "b"), ("y", dt.datetime(2024, 7, 1), 0.0, "breakeven", "b"), ("y", dt.datetime(2024, 7, 2), None, "cancelled", "b")]
    trades = spark.createDataFrame(rows, "symbol string, exit_ts timestamp, r double, result string, how string")
    found = report.sections(trades, "year", 0.1, "how")
    at = {(r["scope"], r["period"] and r["period"].year, r["symbol"], r["strategy"]): r for r in found.collect()}
    assert len(at) == 1 + 2 + 2 + 3 + 2 and at["book", None, None, None]["n"] == 4 and at["instrument", None, "y", None]["profit_factor_r"] is None
    assert at["period", 2024, None, None]["return_pct"] == pytest.approx(100 * (0.9 * 1.1 - 1)) and at["strategy", None, None, "a"]["expectancy_r"] == 0.5
    over = report.dispersion(found).first()
    assert (over["n_periods"], over["n_instruments"], over["instrument_std_r"], over["best_period_pct"]) == (2, 2, 0.0, pytest.approx(20.0))
    one = report.dispersion(report.sections(trades.where("symbol = 'x' AND r > 0"))).first()
    assert one["instrument_std_r"] == 2.0 and one["period_std_pct"] == pytest.approx(2.0)  # of one value, the value
    assert report.dispersion(report.sections(trades.limit(0))).first()["period_std_pct"] is None
    text = json.loads(report.document(found, report.dispersion(found)).first()["document"])
    assert text["book"]["n"] == 4 and [*text["per_instrument"]] == ["x", "y"] and text["dispersion"]["n_periods"] == 2
    bands = [(60.0, 1.0, 2.0, 3.0), (60.0, -1.0, 2.0, 3.0), (10.0, 1.0, 2.0, 3.0), (10.0, -1.0, 2.0, 3.0), (None, None, None, None), (10.0, None, None, None), (None, 1.0, 70.0, 90.0)]
    lines = [r["line"] for r in report.judged(spark.createDataFrame(bands, "o double, a double, b double, c double").coalesce(1), "o", "a", "b", "c", 50).collect()]
    assert [next(k for k in ("doubles target", "not yet reliable", "edge is positive", "and not reliable", "no CAGR data") if k in x) for x in lines] == ["doubles target", "not yet reliable", "edge is positive", "and not reliable", "no CAGR data", "and not reliable", "edge is positive"]
    assert "[no MC band]" in lines[5] and lines[6].startswith("CAGR 70.00%")


# analyzers


def test_analyzers_from_sql_and_what_they_refuse(spark):
    own = spark.newSession()
    shape = lambda lag, name: f"{name} double"
    analyzers.add(own, analyzers.Analyzer("lagged", ("close",), shape, lambda f, lag, name: f.assign(**{name: f["close"].shift(lag)}), {"lag": 1, "name": "before"}))
    keyed_bars(own).createOrReplaceTempView("bars")
    rows = own.sql("SELECT symbol, ts, close, b2 FROM lagged(TABLE(bars), lag => 2, name => 'b2')").toPandas().sort_values(["symbol", "ts"])
    assert len(rows) == 120 and (rows.groupby("symbol")["close"].shift(2).fillna(-1) == rows["b2"].fillna(-1)).all()
    assert own.sql("SELECT * FROM lagged(TABLE(SELECT * FROM bars WHERE false))").count() == 0
    for text, why in (("lagged(TABLE(bars), width => 2)", "no parameters"), ("lagged(TABLE(SELECT symbol, ts FROM bars))", "lacks"), ("lagged(TABLE(bars), name => 'open')", "already")):
        with pytest.raises(Exception, match=why):
            own.sql(f"SELECT * FROM {text}").collect()


def test_wiring_across_timeframes_and_its_faults(spark):
    bars = keyed_bars(spark, 40, ("x",)).drop("timeframe")
    double = FactOp("double", ("close",), ("twice",), lambda df: df.withColumn("twice", 2 * F.col("close")))
    gap = FactOp("gap", ("close", "twice@4h"), ("gap",), lambda df: df.withColumn("gap", F.col("close") - F.col("twice@4h")))
    rows = {r["ts"]: r for r in analyzers.wired(bars, "1h", [gap, double], ["gap"]).collect()}
    closes = {r["ts"]: r["close"] for r in bars.collect()}
    for i, t in enumerate(hours(*range(40))):
        last = (i // 4) * 4 - 1  # the last hour of the last complete four
        assert rows[t]["gap"] == (None if last < 0 else pytest.approx(closes[t] - 2 * closes[hours(last)[0]]))
    a = FactOp("a", ("b@4h",), ("a",), lambda df: df.withColumn("a", F.lit(1)))
    b = FactOp("b", ("a@4h",), ("b",), lambda df: df.withColumn("b", F.lit(1)))
    faults = [([a, b], "a", "cycle"), ([gap], "gap", "nothing makes"), ([FactOp("x", ("twice@1m",), ("x",), None), double], "x", "can't be made"), ([double], "triple", "nothing makes triple")]
    for ops, want, why in faults:
        with pytest.raises(ValueError, match=why):
            analyzers.wired(bars, "1h", ops, [want])
