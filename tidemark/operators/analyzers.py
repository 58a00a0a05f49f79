"""Analyzers of one's own, called from SQL: a table function for each, with the columns that its parameters give, and aggregates over groups.

    add(spark, Analyzer("roc", ("close",), "roc double", lambda df, lag: df.assign(roc=df["close"].pct_change(lag)), {"lag": 5}))
    spark.sql("SELECT symbol, ts, roc FROM roc(TABLE(bars), lag => 3)")

A function gets a symbol's frames in time, and adds a value to each from those up to it. Its output is the table's columns and the analyzer's own. Facts of other
timeframes are named ``fact@timeframe``: ``wired`` computes them on resampled bars and joins them as of their completion.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from tidemark.functions.timeframes import MINUTES
from tidemark.operators import joins
from tidemark.operators.extension import FactOp, ordered
from tidemark.sources.bars import resample


@dataclass(frozen=True)
class Analyzer:
    """``fn(frames, **params)`` gives the frames, a symbol's in time, with the columns ``produces`` ("name type, ...", plain types), which may be a function of the
    parameters."""

    name: str
    requires: tuple[str, ...]
    produces: str | Callable[..., str]
    fn: Callable[..., pd.DataFrame]
    defaults: dict[str, Any] = field(default_factory=dict)

    def given(self, params: dict[str, Any]) -> dict[str, Any]:
        if unknown := {*params} - {*self.defaults}:
            raise ValueError(f"{self.name} has no parameters {sorted(unknown)}")
        return self.defaults | params

    def columns(self, params: dict[str, Any]) -> StructType:
        """Parsed here: a table function is analysed without a session."""
        out = StructType()
        for part in (self.produces(**params) if callable(self.produces) else self.produces).split(","):
            name, kind = part.split()
            out = out.add(name, {"int": "integer", "bigint": "long"}.get(kind, kind))
        return out


def table_function(op: Analyzer) -> type:
    """The class of the analyzer's table function; its TABLE argument is dealt by symbol and ordered by ts."""

    class Function:
        @staticmethod
        def analyze(frames: AnalyzeArgument, **params: AnalyzeArgument) -> AnalyzeResult:
            if not frames.isTable:
                raise ValueError(f"{op.name} needs a TABLE")
            names = frames.dataType.names
            if lacking := [c for c in ("symbol", "ts", *op.requires) if c not in names]:
                raise ValueError(f"{op.name} lacks {lacking}")
            own = op.columns(op.given({k: v.value for k, v in params.items()}))
            if twice := [c for c in own.names if c in names]:
                raise ValueError(f"the table has {twice} already")
            return AnalyzeResult(StructType([*frames.dataType.fields, *own.fields]), partitionBy=[PartitioningColumn("symbol")], orderBy=[OrderingColumn("ts")])

        def __init__(self) -> None:
            self.rows: list[tuple] = []
            self.names: list[str] = []
            self.params: dict[str, Any] = {}

        def eval(self, frame: Any, **params: Any) -> None:
            self.names, self.params = frame.__fields__, params
            self.rows.append(tuple(frame))

        def terminate(self):
            if not self.rows:
                return
            held = op.given(self.params)
            frames = pd.DataFrame(self.rows, columns=self.names)
            out = op.fn(frames, **held)[op.columns(held).names].astype(object)
            for row, new in zip(self.rows, out.itertuples(index=False), strict=True):
                yield (*row, *(None if pd.isna(v) else v for v in new))

    return Function


def add(spark: SparkSession, op: Analyzer) -> None:
    """Registers the analyzer as a table function of its name."""
    spark.udtf.register(op.name, F.udtf(table_function(op)))


def add_aggregate(spark: SparkSession, name: str, fn: Callable[[pd.Series], Any], kind: str) -> None:
    """Registers a group's aggregate (all members' values as one Arrow batch to a value) under ``name``."""

    def whole(values: pd.Series) -> Any:
        return fn(values)

    whole.__annotations__ = {"values": pd.Series, "return": float}
    spark.udf.register(name, F.pandas_udf(whole, kind))


def wired(bars: DataFrame, timeframe: str, ops: list[FactOp], wanted: list[str], lag: int = 0) -> DataFrame:
    """``bars`` (of ``timeframe``) with the columns ``wanted`` and all that they need.

    A need ``fact@tf`` is the fact on bars of ``tf``, made by the same operators there, joined as of the last bar that is complete (and ``lag`` bars older). A bare name
    means the bars' own timeframe, as ``fact@timeframe`` does. Cycles, missing inputs and timeframes finer than the bars' fail, before anything runs.
    """
    own = lambda c: c.removesuffix(f"@{timeframe}")
    here = [replace(op, bindings={c: own(op.bindings.get(c, c)) for c in op.requires if own(op.bindings.get(c, c)) != c}) for op in ops]
    goals = [own(g) for g in wanted]
    other = {c for c in [*goals, *(n for op in here for n in op.needs())] if "@" in c}
    steps = ordered(here, [*bars.columns, *other], goals)
    coarser: dict[str, set[str]] = {}
    for c in other & {*goals, *(n for op in steps for n in op.needs())}:
        fact, tf = c.rsplit("@", 1)
        if tf not in MINUTES or MINUTES[tf] < MINUTES[timeframe]:
            raise ValueError(f"{c} can't be made of {timeframe}")
        coarser.setdefault(tf, set()).add(fact)
    out = bars
    for tf, names in sorted(coarser.items()):
        right = wired(resample(bars, tf, timeframe), tf, ops, sorted(names), lag).select("symbol", "ts", *[F.col(n).alias(f"{n}@{tf}") for n in sorted(names)])
        out = joins.completed(out, right, ["symbol"], MINUTES[tf], lag, [f"{n}@{tf}" for n in sorted(names)]).drop("usable_at_asof")
    for op in steps:
        out = op.apply(out)
    return out
