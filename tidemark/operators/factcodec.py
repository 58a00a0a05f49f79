"""Typed facts of many kinds in one VARIANT column, and back.

A fact is an object with its ``kind`` and the fields of that kind. Kinds are a registry: one's own join it with ``kind_of``. What
a reader doesn't know, a kind or a text that is no JSON, gives no rows there and shows up in ``unread``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of each kind, as DDL: primitive facts, channels, trends, patterns, and structures with lists of objects.
KINDS: dict[str, str] = {
    "mean": "period int, value double",
    "channel": "period int, high double, low double",
    "trend": "direction string, strength double",
    "pattern": "direction string, confirmed_at timestamp, prices array<double>",
    "levels": "levels array<struct<kind: string, level: double, touches: long>>",
}
KEYS = ["symbol", "ts", "name"]


def kind_of(name: str, fields: str) -> None:
    """Adds a kind; another one of the name fails."""
    if KINDS.setdefault(name, fields) != fields:
        raise ValueError(f"{name} is another kind already")


def _fields(kind: str) -> list[tuple[str, str]]:
    depth, parts = 0, [""]
    for ch in KINDS[kind]:
        depth += (ch == "<") - (ch == ">")
        parts.append("") if ch == "," and not depth else parts.__setitem__(-1, parts[-1] + ch)
    return [tuple(p.strip().split(" ", 1)) for p in parts]


def encoded(kind: str, **values: Column) -> Column:
    """A fact as a VARIANT; a field that isn't given is null, one that the kind lacks fails."""
    fields = _fields(kind)
    if unknown := {*values} - {n for n, _ in fields}:
        raise ValueError(f"{kind} has no fields {sorted(unknown)}")
    held = [values.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields]
    return F.to_variant_object(F.struct(F.lit(kind).alias("kind"), *held))


def stacked(*facts: DataFrame) -> DataFrame:
    """symbol, ts, name, fact of several tables of them."""
    return reduce(DataFrame.unionByName, [f.select(*KEYS, "fact") for f in facts])


def to_text(facts: DataFrame) -> DataFrame:
    """The facts as JSON texts, as documents and logs hold them."""
    return facts.select(*KEYS, F.to_json("fact").alias("text"))


def from_text(rows: DataFrame) -> DataFrame:
    """Facts of JSON texts; ``fact`` is null where a text is none."""
    return rows.select(*KEYS, F.try_parse_json("text").alias("fact"))


def kind(fact: str = "fact") -> Column:
    return F.try_variant_get(fact, "$.kind", "string")


def decoded(facts: DataFrame, name: str) -> DataFrame:
    """The facts of one kind with its fields as typed columns; a field of another type than the kind's is null."""
    own = facts.where(kind() == name)
    return own.select(*KEYS, *[F.try_variant_get("fact", f"$.{n}", t).alias(n) for n, t in _fields(name)])


def unread(facts: DataFrame) -> DataFrame:
    """kind (null: no JSON, or without one) and how many facts there are that no kind of the registry reads."""
    return facts.withColumn("kind", kind()).where(F.col("kind").isNull() | ~F.col("kind").isin(*KINDS)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def shapes(facts: DataFrame) -> DataFrame:
    """kind and the schema that its facts have in fact, over all of them."""
    return facts.where(kind().isNotNull()).groupBy(kind().alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.schema_of_variant_agg("fact").alias("shape"))
