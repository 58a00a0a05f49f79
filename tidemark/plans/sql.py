"""Common table expressions that the oracles share, in DuckDB SQL."""

from __future__ import annotations

_LOADED: dict[str, tuple[tuple[str, ...], str]] = {}


def define(name: str, sql: str, *needs: str) -> None:
    _LOADED[name] = (needs, sql)


def query(sql: str, *needs: str) -> str:
    """``sql`` with the expressions it needs before it, each once and after its own needs."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in _LOADED[name][0]:
            visit(n)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    return sql if not order else "WITH " + ",\n".join(f"{n} AS ({_LOADED[n][1]})" for n in order) + "\n" + sql


_OHLC = "first({p} ORDER BY {t}, {k}) AS open, max({p}) AS high, min({p}) AS low, last({p} ORDER BY {t}, {k}) AS close, count(*)::DOUBLE AS volume"
_E = _OHLC.format(p="value", t="ts", k="event_id")
_O = _OHLC.format(p="o_totalprice::DOUBLE", t="o_orderdate", k="o_orderkey")
define("b1h", f"SELECT event_type AS symbol, date_trunc('hour', e.ts) AS ts, {_E} FROM events e GROUP BY ALL")
define("b4h", f"SELECT event_type AS symbol, time_bucket(INTERVAL '4 hours', e.ts, TIMESTAMP '1970-01-01') AS ts, {_E} FROM events e GROUP BY ALL")
define("b1d", f"SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate::TIMESTAMP) AS ts, {_O} FROM orders GROUP BY ALL")
define("b1w", f"SELECT o_orderpriority AS symbol, date_trunc('week', o_orderdate::TIMESTAMP)::TIMESTAMP AS ts, {_O} FROM orders GROUP BY ALL")
_TR = "CASE WHEN lag(close) OVER w IS NULL THEN 0.0 ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END"
define("x1h", f"SELECT *, row_number() OVER w - 1 AS bar_idx, {_TR} AS tr FROM b1h WINDOW w AS (PARTITION BY symbol ORDER BY ts)", "b1h")
define("x1d", f"SELECT *, row_number() OVER w - 1 AS bar_idx, {_TR} AS tr FROM b1d WINDOW w AS (PARTITION BY symbol ORDER BY ts)", "b1d")
define(
    "a1h",
    "SELECT *, CASE WHEN bar_idx > 0 THEN sum(tr) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) / least(bar_idx, 14) ELSE 0.0 END AS atr FROM x1h",
    "x1h",
)
define(
    "f1h",
    """SELECT *, list({'h': high, 'l': low, 'c': close}) OVER w AS win, list(close) OVER w AS h FROM a1h
    WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 100 PRECEDING AND CURRENT ROW)""",
    "a1h",
)


def ema(p: int) -> str:
    k = 2.0 / (p + 1)
    return f"CASE WHEN len(h) <= {p} THEN list_avg(h) ELSE list_reduce(list_prepend(list_avg(h[1:{p}]), h[{p + 1}:]), lambda a, x: x * {k!r} + a * (1 - {k!r})) END"


_TRS = "list_transform(range(2, len(win) + 1), lambda i: greatest(win[i].h - win[i].l, abs(win[i].h - win[i - 1].c), abs(win[i].l - win[i - 1].c)))"
define("g1h", f"SELECT * EXCLUDE (win), {_TRS} AS trs, {ema(20)} AS ema_20, {ema(50)} AS ema_50 FROM f1h", "f1h")
define(
    "i1h",
    """SELECT *, CASE WHEN len(trs) = 0 THEN 0.0 WHEN len(trs) <= 14 THEN list_avg(trs)
    ELSE list_reduce(list_prepend(list_avg(trs[1:14]), trs[15:]), lambda a, x: (a * 13 + x) / 14) END AS atr_wilder FROM g1h""",
    "g1h",
)
define(
    "t1h",
    """SELECT *, CASE WHEN ema_20 > ema_50 THEN 'bullish' WHEN ema_20 < ema_50 THEN 'bearish' ELSE 'neutral' END AS trend_direction,
    round(least(1.0, CASE WHEN atr_wilder > 0 THEN abs(ema_20 - ema_50) / atr_wilder ELSE 0.0 END), 4) AS trend_strength,
    CASE WHEN close > ema_20 AND close > ema_50 THEN 'above' WHEN close < ema_20 AND close < ema_50 THEN 'below' ELSE 'between' END AS trend_side FROM i1h""",
    "i1h",
)
