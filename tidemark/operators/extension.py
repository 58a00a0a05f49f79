"""The surface for operators of one's own: facts, signals and candidates as functions over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame


@dataclass(frozen=True)
class FactOp:
    """Adds the columns ``produces`` to rows that have the columns ``requires``; ``bindings`` renames what it requires, ``rename`` what it adds."""

    name: str
    requires: tuple[str, ...]
    produces: tuple[str, ...]
    fn: Callable[..., DataFrame]
    defaults: dict[str, Any] = field(default_factory=dict)
    bindings: dict[str, str] = field(default_factory=dict)
    rename: dict[str, str] = field(default_factory=dict)

    def needs(self) -> list[str]:
        return [self.bindings.get(c, c) for c in self.requires]

    def gives(self) -> list[str]:
        return [self.rename.get(c, c) for c in self.produces]

    def apply(self, df: DataFrame, **params: Any) -> DataFrame:
        if unknown := {*params} - {*self.defaults}:
            raise ValueError(f"{self.name} has no parameters {sorted(unknown)}")
        if lacking := [c for c in self.needs() if c not in df.columns]:
            raise ValueError(f"{self.name} lacks {lacking}")
        for inner, outer in self.bindings.items():
            df = df.withColumn(inner, df[outer])
        out = self.fn(df, **(self.defaults | params))
        if lacking := [c for c in self.produces if c not in out.columns]:
            raise ValueError(f"{self.name} didn't add {lacking}")
        return out.withColumnsRenamed(self.rename)


class SignalOp(FactOp):
    """A FactOp that adds direction, confidence and reject_reason."""


class CandidateOp(FactOp):
    """A FactOp that adds entry, stop, target and reject_reason."""


REGISTRY: dict[str, FactOp] = {}


def provide(op: FactOp) -> FactOp:
    """Registers an operator by its name; another one of the name fails."""
    if REGISTRY.setdefault(op.name, op) is not op:
        raise ValueError(f"{op.name} is registered twice")
    return op


def ordered(ops: list[FactOp], given: list[str], wanted: list[str] | None = None) -> list[FactOp]:
    """``ops`` so that each comes after what it needs; those that ``wanted`` (all, if none) doesn't need are left out.

    Cycles, missing inputs and two makers of one column fail.
    """
    maker: dict[str, FactOp] = {}
    for op in ops:
        for c in op.gives():
            if maker.setdefault(c, op) is not op:
                raise ValueError(f"{c} has two makers: {maker[c].name} and {op.name}")
    out: list[FactOp] = []
    open_: list[FactOp] = []

    def visit(op: FactOp) -> None:
        if op in out:
            return
        if op in open_:
            raise ValueError("a cycle: " + " > ".join(o.name for o in [*open_, op]))
        open_.append(op)
        for c in op.needs():
            if c in maker:
                visit(maker[c])
            elif c not in given:
                raise ValueError(f"{op.name} needs {c}, which nothing makes")
        out.append(open_.pop())

    for c in wanted if wanted is not None else [c for op in ops for c in op.gives()]:
        if c in maker:
            visit(maker[c])
        elif c not in given:
            raise ValueError(f"nothing makes {c}")
    return out


def facts(df: DataFrame, ops: list[FactOp], wanted: list[str] | None = None) -> DataFrame:
    """``df`` with the columns of the operators, in the order that they need: one lazy plan."""
    for op in ordered(ops, df.columns, wanted):
        df = op.apply(df)
    return df


def spanning(df: DataFrame, **aggregates: Column) -> DataFrame:
    """A fact over all symbols at each time."""
    return df.groupBy("ts").agg(*[c.alias(n) for n, c in aggregates.items()])
