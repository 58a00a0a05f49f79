"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import numbered, written

#: Fixed values of the published algorithm: the multiplier of its 64-bit generator.
MULTIPLIER = 2862933555777941757
_LOW = 0xFFFFFFFF


def _times(hi: Column, lo: Column, m: int) -> tuple[Column, Column]:
    """hi, lo (32 bits each) of (hi:lo) * m + 1 modulo 2**64, in 16-bit steps: ANSI arithmetic may not wrap."""
    mh, ml = F.lit(m >> 32), F.lit(m & _LOW)
    short = lambda x: x.bitwiseAND(F.lit(0xFFFF))
    upper = lambda x: F.shiftright(x, 16)
    up = lambda x: F.shiftleft(short(x), 16)
    p0, p1 = short(lo) * ml, upper(lo) * ml
    t = p0 + up(p1) + F.lit(1)
    high = F.shiftright(t, 32) + upper(p1) + short(hi) * ml + up(upper(hi) * ml) + short(lo) * mh + up(upper(lo) * mh)
    return high.bitwiseAND(F.lit(_LOW)), t.bitwiseAND(F.lit(_LOW))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to ``shards`` - 1, of a 64-bit key (null counts as -1).

    A key jumps from shard to shard in growing order, so ``shards`` steps are always enough; with one shard more, a key
    stays or goes to the new one. No table of shards is kept.
    """
    k = F.coalesce(key.cast("long"), F.lit(-1).cast("long"))
    zero = F.lit(0).cast("long")
    first = F.struct(zero.alias("b"), zero.alias("j"), F.shiftright(k, 32).bitwiseAND(F.lit(_LOW)).alias("hi"), k.bitwiseAND(F.lit(_LOW)).alias("lo"))

    def step(s: Column, _: Column) -> Column:
        hi, lo = _times(s["hi"], s["lo"], MULTIPLIER)
        jump = F.floor((s["j"] + 1) * (F.lit(2.0**31) / (F.shiftright(hi, 1) + 1).cast("double"))).cast("long")
        moved = F.struct(s["j"].alias("b"), jump.alias("j"), hi.alias("hi"), lo.alias("lo"))
        return F.when(s["j"] < shards, moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), first, step, lambda s: s["b"].cast("int"))


def assign_shards(df: DataFrame, key: str, shards: int) -> DataFrame:
    """``df`` with ``shard`` and ``grown_shard`` (the shard if there were one more); no shuffle.

    Equal keys, and so repeated rows, share a shard; null keys count as -1. Columns of these names are replaced.
    """
    return df.withColumns({"shard": jump_hash(F.col(key), shards), "grown_shard": jump_hash(F.col(key), shards + 1)})


def shard_plan(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A null text is empty (size 1, crc 0), texts of any length count whole, repeated rows get a slot each, an empty table
    gives no rows, and other columns of ``docs`` are left behind.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = written(assign_shards(rows, "doc_id", shards), "shards")
    return numbered(rows, ["shard"], ["doc_id", "size", "text_crc32"], "slot").withColumn("law", F.lit("key"))
