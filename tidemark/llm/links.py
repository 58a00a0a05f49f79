"""Linking of near-equal sets: candidates from band keys, exact confirmation, connected components.

Copies make large buckets, in which all pairs are out of the question. Each bucket's members are held against its hub, the
member that shares buckets with most others, and confirmed links give components. Only where a bucket still holds several components
can a link be missing; there, a prefix filter over the sets finds every further pair that can reach the threshold and whose ends
are in different components. It orders elements by rarity, so what a copy alone has prunes it. No pair within a component is made. For each
element, the sets outside its main component meet one set of it first, a few times: groups of near copies grow together by that, before any pairs are made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.common import in_order, release, salted_join, written
from tidemark.llm.shingles import HyperMinHash

#: A list of ids up to this length is broadcast; a longer one is joined by a shuffle.
BROADCAST_IDS = 200_000
#: Rounds in which each element's sets meet one of its main component.
WITNESSES = 2
#: Tasks over which the pairs of a hot element are dealt.
SPREAD = 8
#: 64-bit words of a set's bitmap.
WORDS = 8
_BITS = [f"b{k}" for k in range(WORDS)]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """For each end of ``edges`` (a, b): id and component, the least id that it reaches. Large and small stars in turn (Kiveris et al., 2014)."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large, old = written(large, "edges"), e
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = written(small.where("u > v").distinct(), "edges")
        release(large, old)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components didn't settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))


def only(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` is in ``ids`` (a written table of distinct ids)."""
    name = ids.columns[0]
    wanted = ids.select(F.col(name).alias("_wanted"))
    if ids.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    return df.join(wanted, F.col(column) == F.col("_wanted"), "left_semi")


def candidates(bands: DataFrame) -> DataFrame:
    """The rows (key, id) of ``bands`` whose key several ids share, written."""
    shared = bands.groupBy("key").agg(F.min("id").alias("_low"), F.max("id").alias("_high")).where("_low < _high").select("key")
    return written(bands.join(shared, "key").distinct(), "buckets")


def hub_pairs(buckets: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of each bucket's members with its hub: the one that shares buckets with most others, over all its buckets."""
    size = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("_s"))
    degree = buckets.join(size, "key").groupBy("id").agg(F.sum("_s").alias("_n"))
    hub = buckets.join(degree, "id").groupBy("key").agg(F.max(F.struct("_n", "id")).alias("_hub")).select("key", F.col("_hub.id").alias("hub"))
    a, b = in_order(F.col("id"), F.col("hub"))
    return buckets.join(hub, "key").where("id <> hub").select(a.alias("a"), b.alias("b")).distinct()


def _sized(percent: int) -> Column:
    return F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, sketches: HyperMinHash | None, sized: bool = False) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= ``percent`` * union, from their whole sets. sized: their sizes are known to allow it.

    sets: id, n, elements (sorted 64-bit numbers, as bytes) and, with ``sketches``, sketch. A sketch's estimate that is lower
    than the threshold by over six standard deviations spares the comparison.
    """
    size = sets.select("id", "n")
    near = pairs
    if not sized:
        near = pairs.join(size.select(F.col("id").alias("a"), F.col("n").alias("n_a")), "a").join(size.select(F.col("id").alias("b"), F.col("n").alias("n_b")), "b").where(_sized(percent)).select("a", "b")
    side = lambda k: sets.select(F.col("id").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in sets.columns if c not in ("id", "n")])
    rows = near.join(side("a"), "a").join(side("b"), "b")
    t = percent / 100
    least = t - 6 * (t * (1 - t) / sketches.m) ** 0.5 if sketches else 0.0

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = lambda c, i, kind: np.frombuffer(batch.column(c)[i].as_buffer(), kind)
            keep = []
            for i in range(batch.num_rows):
                if sketches and sketches.similarity(of("sketch_a", i, np.uint16), of("sketch_b", i, np.uint16)) < least:
                    keep.append(False)
                    continue
                x, y = of("elements_a", i, np.uint64), of("elements_b", i, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(confirm, "a long, b long")


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            some = batch.slice(start, 500)
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in some.column("elements")]
            many = np.array([len(x) for x in sets], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some.column("id").to_numpy(), many)), pa.array(np.concatenate(sets))], ["id", "x"])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which of WORDS * 64 bits a set's elements fall on."""
    for batch in batches:
        maps = np.zeros((batch.num_rows, WORDS * 64), dtype=np.uint8)
        for i, x in enumerate(batch.column("elements")):
            maps[i, np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(64 - WORDS.bit_length() - 5)] = 1
        packed = np.packbits(maps, axis=1, bitorder="little").view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(packed[:, k]) for k in range(WORDS))], ["id", *_BITS])


def prefixes(buckets: DataFrame, sets: DataFrame, found: DataFrame, percent: int) -> DataFrame | None:
    """id, n, at, x and bitmap: the rarest elements of each set in a bucket of several components, as many as any two sets that link must share
    one of, at their places in the order of rarity. Elements of one set alone are left out. Written; None where no bucket has several components.
    """
    own = F.coalesce("component", "id")
    several = buckets.join(found, "id", "left").groupBy("key").agg(F.min(own).alias("_low"), F.max(own).alias("_high")).where("_low < _high").select("key")
    left = written(buckets.join(several, "key").select("id").distinct(), "open")
    if left.isEmpty():
        return None
    some = only(sets, "id", left).select("id", "elements")
    rows = some.mapInArrow(_elements, "id long, x long")
    often = rows.groupBy("x").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    ordered = rows.join(often, "x", "left").groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(1)).alias("f"), "x"))).alias("_all"))
    n = F.size("_all")
    head = n - F.ceil(n * percent / 100) + 1
    bits = some.mapInArrow(_bitmaps, "id long, " + ", ".join(f"{b} long" for b in _BITS))
    prefix = ordered.join(bits, "id").select("id", *_BITS, n.alias("n"), F.posexplode(F.slice("_all", 1, head.cast("int"))).alias("at", "_e")).where("_e.f > 1")
    return written(prefix.select("id", "n", "at", F.col("_e.x").alias("x"), *_BITS), "prefixes")


def at_mains(prefix: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of elements that sets of several components share, with their component c, the element's main one (most of its sets) and _parts.

    Elements that many sets share are dealt over _parts tasks. Written.
    """
    rows = prefix.join(found, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    main = rows.groupBy("x", "c").agg(F.count(F.lit(1)).alias("k"))
    main = main.groupBy("x").agg(F.max(F.struct("k", "c")).alias("_m"), F.count(F.lit(1)).alias("_cs"), F.sum("k").alias("_n")).where("_cs > 1")
    main = written(main.select("x", F.col("_m.c").alias("main"), "_n"), "mains")
    total = main.agg(F.sum("_n")).first()[0] or 0
    parts = F.when(F.col("_n") > max(common.HOT_LEAST, total // common.HOT_SHARE), SPREAD).otherwise(1)
    out = written(salted_join(rows, main.withColumn("_parts", parts), ["x"], "_n", "inner", ["id"]), "prefixes")
    release(main)
    return out


def _fits(percent: int) -> Column:
    """Bounds that no link can fail: two sets share an element at places that leave enough to share, and each has few bits that the other lacks
    (a bit that only one set has is an element that only it has)."""

    def lacking(one: str, two: str) -> Column:
        return reduce(Column.__add__, [F.bit_count(F.col(f"{b}{one}").bitwiseAND(F.bitwise_not(F.col(f"{b}{two}")))) for b in _BITS])

    need, both = (F.col("n") + F.col("n_2")) * percent, 100 + percent
    fits = (F.least("n", "n_2") * 100 >= F.greatest("n", "n_2") * percent) & (F.least(F.col("n") - F.col("at"), F.col("n_2") - F.col("at_2")) * both >= need)
    return fits & ((F.col("n") - lacking("", "_2")) * both >= need) & ((F.col("n_2") - lacking("_2", "")) * both >= need)


_OTHER = ("id", "n", "at", "c", *_BITS)


def _pairs(rows: DataFrame) -> DataFrame:
    a, b = in_order(F.col("id"), F.col("id_2"))
    return rows.select(a.alias("a"), b.alias("b")).distinct()


def witness_pairs(rows: DataFrame, percent: int, turn: int) -> DataFrame:
    """For each element, its sets outside the main component beside one of the main component: no more pairs than rows."""
    one = rows.where("c = main").groupBy("x").agg(F.max_by(F.struct(*_OTHER), F.xxhash64("id", "x", F.lit(turn))).alias("_w")).select(F.col("x").alias("_x"), *[F.col(f"_w.{k}").alias(f"{k}_2") for k in _OTHER])
    return _pairs(rows.where("c <> main").join(one, (F.col("x") == F.col("_x")) & _fits(percent)))


def further_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of different components that may link."""
    mine = rows.where("c <> main").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("_parts") - 1).cast("long"))))
    other = rows.select("x", F.pmod(F.xxhash64("id"), F.col("_parts")).alias("_part"), *[F.col(k).alias(f"{k}_2") for k in _OTHER])
    apart = (F.col("c") != F.col("c_2")) & ((F.col("c_2") == F.col("main")) | (F.col("id") < F.col("id_2")))
    return _pairs(mine.alias("s").join(other.alias("o"), (F.col("s.x") == F.col("o.x")) & (F.col("s._part") == F.col("o._part")) & apart & _fits(percent)))


def linked(buckets: DataFrame, sets: DataFrame, percent: int, sketches: HyperMinHash | None = None) -> DataFrame:
    """id and component (the least id that links reach) of those that a link reaches, written.

    buckets: written (key, id) of ``candidates``; sets: a written table, see ``confirmed``, of every id in them.
    """
    links = written(confirmed(hub_pairs(buckets), sets, percent, sketches), "links")
    found = written(components(links), "components")
    prefix = prefixes(buckets, sets, found, percent)
    if prefix is None:
        return found
    # Witnesses first: what they bring into one component needs no further comparison. Then all that is left.
    for turn in range(WITNESSES + 1):
        rows = at_mains(prefix, found)
        pairs = witness_pairs(rows, percent, turn) if turn < WITNESSES else further_pairs(rows, percent)
        extra = written(confirmed(pairs, sets, percent, sketches, True), "links")
        if not extra.isEmpty():
            found = written(components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(extra)), "components")
        release(rows, extra)
    release(links, prefix)
    return found
