"""Hard negatives by an inverted multi-index: exact searches for the best scores inside windows, certified by bounds.

Vectors are cut in two halves; each half has a codebook, and a pair of codewords is a cell. A cell's scores with an anchor a are
bounded by what its halves give: a half scores at most a·c + |a| r, c the codeword and r the largest distance of any half from it.
The multi-sequence heap visits cells by falling sums of the two bounds. A window (lo to hi, so many rows) is certified once the
next cell's bound is under ``lo`` or under the worst row of a full window: no later cell can change it. Searches go in rounds over growing numbers of
rows, so each round knows how good a row must be to matter; every round's visits are joined with blocks of the index.

Codebooks come from SAMPLE rows at most; every row is in the index, and results are exact whatever the codebooks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import release, written

#: Rows that the codebooks are fitted on, codewords of a half, rows of a block of the index, anchors of a block of visits.
SAMPLE, CODEWORDS, ROWS, ANCHORS = 8192, 16, 1024, 256
#: Rows that the first round of a search reaches for each anchor, and how many times more each further one does.
FIRST, GROWTH = 2048, 16
#: The largest absolute component that takes part: scores stay exact.
LARGEST = 2.0**20
_FOUND = "anchor_id long, window int, score long, vec_id long"


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and vec (floor(scale * x) as little-endian 32-bit numbers), a row for each vec_id.

    Rows with a null vec_id, label or vector, an empty vector, or a component that is null, not finite or beyond LARGEST take no part; of rows that share a
    vec_id the one of least label and vector does.
    """
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) > LARGEST))
    whole = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("int"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~bad & (F.size("embedding") > 0))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("long").alias("label"), whole.alias("x")).alias("r"))
    return rows.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.x")


@dataclass
class Index:
    """Codebooks (codewords x half), radii of codewords, rows and blocks of each cell, and the table of blocks (cell, block, rows)."""

    books: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray
    parts: np.ndarray
    blocks: DataFrame

    def cells(self, vector: np.ndarray) -> Iterator[tuple[float, float, int]]:
        """(upper bound, lower bound, cell) of all cells with rows, by falling upper bound: the multi-sequence heap."""
        halves = np.split(vector, [self.books[0].shape[1]])
        mids = [b @ h for b, h in zip(self.books, halves, strict=True)]
        gaps = [np.linalg.norm(h) * r for h, r in zip(halves, self.radii, strict=True)]
        ups = [m + g for m, g in zip(mids, gaps, strict=True)]
        orders = [np.argsort(-u, kind="stable") for u in ups]
        slack = 1e-6 + 1e-9 * float(np.abs(vector).max() ** 2 * len(vector))
        heap, n, m = [(-float(ups[0][orders[0][0]] + ups[1][orders[1][0]]), 0, 0)], len(orders[0]), len(orders[1])
        while heap:
            bound, i, j = heapq.heappop(heap)
            if j + 1 < m:
                heapq.heappush(heap, (-float(ups[0][orders[0][i]] + ups[1][orders[1][j + 1]]), i, j + 1))
            if j == 0 and i + 1 < n:  # each pair has one way in
                heapq.heappush(heap, (-float(ups[0][orders[0][i + 1]] + ups[1][orders[1][0]]), i + 1, 0))
            a, b = orders[0][i], orders[1][j]
            cell = int(a * m + b)
            if self.counts[cell]:
                yield -bound + slack, float(mids[0][a] - gaps[0][a] + mids[1][b] - gaps[1][b]) - slack, cell


def codebook(points: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """At most ``k`` centres of ``points`` by Lloyd's rounds from distinct points."""
    distinct = np.unique(points, axis=0)
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]].astype(float)
    for _ in range(rounds):
        of = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, points)
        n = np.bincount(of, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin(np.square(centres).sum(axis=1) - 2 * (points @ centres.T), axis=1)


def index(rows: DataFrame, codewords: int = CODEWORDS) -> Index | None:
    """The multi-index of a written table of ``usable`` rows; None if it is empty. Vectors of another length than most have are left out (of equally common
    lengths, the longest stays)."""
    first = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if first is None:
        return None
    d, rows = first["d"], rows.where(F.size("x") == first["d"])
    some = np.array([r["x"] for r in rows.select("x", F.xxhash64("vec_id").alias("_h")).orderBy("_h").limit(SAMPLE).collect()], dtype=float)
    books = codebook(some[:, : d // 2], codewords), codebook(some[:, d // 2 :], codewords)
    names = ["vec_id", "label", "vec", "cell", "r0", "r1"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, d)
            halves = x[:, : d // 2].astype(float), x[:, d // 2 :].astype(float)
            of = [nearest(h, b) for h, b in zip(halves, books, strict=True)]
            far = [np.linalg.norm(h - b[o], axis=1) for h, b, o in zip(halves, books, of, strict=True)]
            vec = [v.tobytes() for v in x.astype("<i4")]
            cell = (of[0] * len(books[1]) + of[1]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(vec, pa.binary()), pa.array(cell), *map(pa.array, far)], names)

    placed = written(rows.mapInArrow(assign, "vec_id long, label long, vec binary, cell int, r0 double, r1 double"), "cells")
    radii, counts = (np.zeros(len(books[0])), np.zeros(len(books[1]))), np.zeros(len(books[0]) * len(books[1]), dtype=np.int64)
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r0").alias("r0"), F.max("r1").alias("r1")).collect():  # a row for each cell
        counts[r["cell"]] = r["n"]
        for half, (code, far) in enumerate(zip(divmod(r["cell"], len(books[1])), (r["r0"], r["r1"]), strict=True)):
            radii[half][code] = max(radii[half][code], far)
    parts = np.maximum(1, -(-counts // ROWS))
    of_cell = rows.sparkSession.createDataFrame([(c, int(p)) for c, p in enumerate(parts) if p > 1], "cell int, _parts int")
    dealt = placed.join(F.broadcast(of_cell), "cell", "left").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.coalesce("_parts", F.lit(1))).cast("int"))
    blocks = written(dealt.groupBy("cell", "block").agg(F.collect_list(F.struct("vec_id", "label", "vec")).alias("rows")), "index")
    release(placed)
    return Index(books, radii, counts, parts, blocks)


def visits(anchors: DataFrame, held: Index, after: int, until: int) -> DataFrame:
    """Which blocks each anchor (anchor_id, label, vec, windows) must see: of the cells by falling bound, those that begin after ``after`` rows and before
    ``until``, but for cells that none of its windows can gain from."""
    schema = "cell int, block int, anchor_id long, label long, vec binary, windows array<struct<window int, lo long, hi long, least long>>"
    names = ["cell", "block", "anchor_id", "label", "vec", "windows"]
    shared = anchors.sparkSession.sparkContext.broadcast(Index(held.books, held.radii, held.counts, held.parts, None))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for batch in batches:
            row, cell, block = [], [], []
            for i, (vec, windows) in enumerate(zip(batch.column("vec"), batch.column("windows").to_pylist(), strict=True)):
                passed, least = 0, min(max(w["lo"], w["lo"] if w["least"] is None else w["least"]) for w in windows)
                most = max(w["hi"] for w in windows)
                for up, low, c in seen.cells(np.frombuffer(vec.as_buffer(), "<i4").astype(float)):
                    if up < least or passed >= until:
                        break
                    if passed >= after and low <= most:
                        n = int(seen.parts[c])
                        row += [i] * n
                        cell += [c] * n
                        block += range(n)
                    passed += int(seen.counts[c])
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(block, pa.int32()), *(batch.column(c).take(at) for c in names[2:])], names)

    return anchors.select(*names[2:]).mapInArrow(walk, schema)


def _scored(groups: DataFrame, same: bool, k: int) -> DataFrame:
    """The ``k`` best rows of each block for each window of the anchors that visit it (of their own label or of another), as _FOUND."""
    names = [c.split()[0] for c in _FOUND.split(", ")]

    def best(visitors: pa.StructArray, rows: pa.StructArray) -> list[np.ndarray]:
        a = np.frombuffer(b"".join(visitors.field("vec").to_pylist()), "<i4").reshape(len(visitors), -1)
        b = np.frombuffer(b"".join(rows.field("vec").to_pylist()), "<i4").reshape(len(rows), -1)
        exact = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53
        scores = (a.astype(float) @ b.T.astype(float)).astype(np.int64) if exact else a.astype(np.int64) @ b.T.astype(np.int64)
        of, ids = visitors.field("anchor_id").to_numpy(), rows.field("vec_id").to_numpy()
        fits = ((visitors.field("label").to_numpy()[:, None] == rows.field("label").to_numpy()) == same) & (of[:, None] != ids)
        windows = visitors.field("windows")
        flat, who = windows.flatten(), np.repeat(np.arange(len(visitors)), np.diff(windows.offsets.to_numpy()))
        lo, hi = flat.field("lo").to_numpy(), flat.field("hi").to_numpy()
        lo = np.maximum(lo, flat.field("least").fill_null(-(2**63)).to_numpy(zero_copy_only=False))
        s = scores[who]
        q, at = np.nonzero(fits[who] & (s >= lo[:, None]) & (s <= hi[:, None]))
        s = s[q, at]
        order = np.lexsort((ids[at], -s, q))
        q, at, s = q[order], at[order], s[order]
        top = np.arange(len(q)) - np.searchsorted(q, q) < k
        q, at, s = q[top], at[top], s[top]
        return [of[who[q]], flat.field("window").to_numpy()[q], s, ids[at]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([*map(pa.array, best(batch.column("visitors")[i].values, batch.column("rows")[i].values))], names)

    return groups.select("visitors", "rows").mapInArrow(run, _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def search(held: Index, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """anchor_id, window, rank, score, vec_id: the first ``k`` rows (all, if fewer) of each window of ``anchors`` (a written table: anchor_id, label, vec,
    windows as structs of window, lo, hi, least), higher scores first, then smaller vec_id; of the anchor's label if ``same``, else of the others'."""
    total, blocks = int(held.counts.sum()), max(1, -(-anchors.count() // ANCHORS))
    found, after, until = None, 0, FIRST
    while True:
        todo = visits(anchors, held, after, until)
        one = todo.groupBy("cell", "block", F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)).alias("_b"))
        groups = one.agg(F.collect_list(F.struct("anchor_id", "label", "vec", "windows")).alias("visitors")).hint("merge").join(held.blocks, ["cell", "block"])  # neither side has a bound that would let it be broadcast
        new = _scored(groups, same, k)
        found, old = written(_first(new if found is None else found.drop("rank").unionByName(new), k), "found"), found
        if old is not None:
            release(old)
        if until >= total:
            return found.select("anchor_id", "window", "rank", "score", "vec_id")
        worst = found.where(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("_least"))
        held_windows = F.transform("windows", lambda w: w.withField("least", F.coalesce(F.col("_least")[w["window"]], w["least"])))
        anchors = written(anchors.join(worst, "anchor_id", "left").select("anchor_id", "label", "vec", held_windows.alias("windows")), "anchors")
        after, until = until, until * GROWTH


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """Per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows that ``anchor`` (over vec_id) picks; scores are inner products of ``floor(scale * x)``. An anchor's positives are its first rows of the same label; each
    positive's negatives are the first rows of other labels whose score is ``low`` to ``high`` per cent of the positive's (a positive of a score
    under 0 has none). See ``usable`` for nulls, repeated ids and odd vectors; an empty table, or one without anchors, gives no rows; other columns
    are left behind.
    """
    rows = written(usable(vectors, scale), "vectors")
    held = index(rows)
    if held is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width = 4 * (held.books[0].shape[1] + held.books[1].shape[1])
    picked = held.blocks.select(F.explode("rows").alias("r")).select("r.*").where(anchor)
    kind = "array<struct<window int, lo long, hi long, least long>>"
    anyone = F.array(F.struct(F.lit(0).alias("window"), F.lit(-(2**62)).alias("lo"), F.lit(2**62).alias("hi"), F.lit(None).cast("long").alias("least"))).cast(kind)
    anchors = written(picked.where(F.octet_length("vec") == width).select(F.col("vec_id").alias("anchor_id"), "label", "vec", anyone.alias("windows")), "anchors")
    close = search(held, anchors, True, positives)
    # low * p <= 100 * n <= high * p, in whole numbers; p is 0 or more
    window = F.struct(F.col("rank").alias("window"), F.expr(f"({low} * score + 99) div 100").alias("lo"), F.expr(f"({high} * score) div 100").alias("hi"), F.lit(None).cast("long").alias("least"))
    windows = close.where("score >= 0").groupBy("anchor_id").agg(F.collect_list(window).cast(kind).alias("windows"))
    asked = written(anchors.drop("windows").join(windows, "anchor_id"), "anchors")
    hard = search(held, asked, False, negatives)
    pairs = close.select("anchor_id", F.col("rank").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(pairs, ["anchor_id", "window"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
