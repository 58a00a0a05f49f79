"""Removal of long repeated byte strings: prefix doubling over sampled suffixes, then an exact check of the windows.

A suffix array of every byte is far more than the answer needs. Suffixes are sampled where the content itself says so: each
window start's minimizer, the least hash of a K-byte string among the next W positions, is the *anchor* of that start. Equal
windows of ``length`` bytes have their anchors at equal places, so a repeated window's anchor starts a repeated run of anchors.

Prefix doubling finds those: an anchor's first rank orders what lies from it to the second next anchor; pairs of ranks, at offsets
of 2, 4, 8 ... anchors, are sorted and ranked anew. An anchor whose pair is unique drops out; one whose next doubling would leave
the bytes that equal windows surely share is past the threshold and stays. At 400 bytes that is so after one doubling for some 13 % of the
anchors, and at once for the others: the sampling is as sparse as equal windows allow, and the hashes below do the rest.

For the anchors that stay, all windows they are responsible for are hashed at once (the bytes from the first to the end of
the last). Where that string repeats, every one of its windows does. Where it is unique while its run repeats, a copy begins or
ends there, and its windows are hashed one by one, with those of one of each kind of the anchors that the bytes common to all of an
anchor's windows are equal for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, StructField, StructType

from tidemark.llm.common import release, row_of, salted_join, texts, written
from tidemark.llm.links import BROADCAST_IDS
from tidemark.llm.shingles import mix

#: Bytes of a hashed string.
K = 16
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64(0xFFFFFFFF)


def reach(length: int) -> int:
    """W, the positions among which the least hash is taken, for windows of ``length`` bytes: of what the hashed strings leave, so
    much that equal windows share two anchors at least, and mostly three or more, which doubling needs."""
    return (length - 3 * K) * 7 // 22


def anchors(text: bytes, W: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: N803
    """The anchors' positions, and the first and last window start that each is responsible for; none in texts under W + K - 1 bytes."""
    n = len(text) - K + 1
    if n < W:
        return (np.empty(0, np.int64),) * 3
    padded = text + bytes(16)
    eight = np.empty(len(text) + 8, dtype=np.uint64)
    for r in range(8):
        part = np.frombuffer(padded, dtype="<u8", offset=r, count=(len(padded) - r) // 8)
        own = eight[r::8]
        own[:] = part[: len(own)]
    h = mix(eight[:n] * _C1 + eight[8 : n + 8] * _C2)
    keyed = np.full(-(-n // W) * W, np.uint64(2**64 - 1))
    keyed[:n] = (h & ~_LOW) | np.arange(n, dtype=np.uint64)  # the leftmost of equal hashes is the least
    blocks = keyed.reshape(-1, W)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - W + 1
    at = (np.minimum(down[:m], up[W - 1 : W - 1 + m]) & _LOW).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], first, np.r_[first[1:] - 1, m - 1]


def _levels(at: np.ndarray, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each anchor but the last can double its rank within ``shared`` bytes, and where the string of its first rank ends."""
    n = len(at) - 1
    level, step = np.zeros(n, dtype=np.int32), 2
    while step <= n:
        some = np.flatnonzero(at[step:] - at[:-step] <= shared)
        if not len(some):
            break
        level[some] = step.bit_length() - 1
        step *= 2
    return level, at[np.arange(n) + np.minimum(level, 1) + 1] + K


def _doubled(level: np.ndarray) -> np.ndarray:
    """Which anchors a doubling reads: those that double, and what follows them."""
    out = np.zeros(len(level), dtype=bool)
    for k in range(2, int(level.max(initial=0)) + 1):
        own = np.flatnonzero(level >= k)
        out[own] = True
        out[own + 2 ** (k - 1)] = True
    return out


def _ranks(length: int):
    """Each anchor's place and first rank's hash; its number in the text only where a doubling will ask for it."""
    near = reach(length)
    shared = length - 2 * near - K  # from its anchor on, so many bytes' anchors are equal in equal windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many, index, asked, place, levels, hashes = [], [], [], [], [], []
            for t in batch.column("text").to_pylist():
                at = anchors(t, near)[0] if len(t) >= length else np.empty(0, np.int64)
                n = max(0, len(at) - 1)
                many.append(n)
                if not n:
                    continue
                level, ends = _levels(at, shared)
                hashes += [xxhash.xxh64_intdigest(t[a:b]) for a, b in zip(at.tolist(), ends.tolist(), strict=False)]
                index.append(np.arange(n, dtype=np.int32))
                asked.append(_doubled(level))
                place.append(at[:-1])
                levels.append(level)
            join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
            of = np.repeat(np.arange(batch.num_rows), many)
            number = pa.array(join(index, np.int32), mask=~join(asked, bool))
            columns = [batch.column("doc_id").take(pa.array(of)), batch.column("fp").take(pa.array(of)), number, pa.array(join(place, np.int64)), pa.array(join(levels, np.int32)), pa.array(np.array(hashes, dtype=np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "i", "at", "levels", "r"])

    return run


def _ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` whose ``by`` others share, with ``rank`` in place of it: the sorted combinations are numbered, rising with them."""
    several = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    order = written(several.orderBy(*by).withColumn("_rank", F.monotonically_increasing_id()), "ranks")
    out = written(salted_join(rows, order, by, "_n", "inner", ["doc_id", "at"]).drop(*by).withColumnRenamed("_rank", "rank"), "ranked")
    release(order, rows)
    return out


def repeated_runs(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, fp, at of the anchors whose run repeats. Written."""
    rows = written(docs.mapInArrow(_ranks(length), "doc_id long, fp int, i int, at long, levels int, r long"), "anchors")
    now, level, stay = _ranked(rows, ["r"]), 1, []
    while True:
        stay.append(written(now.where(F.col("levels") <= level).select("doc_id", "fp", "at"), "runs"))
        more = now.where(F.col("levels") > level)
        if more.isEmpty():
            break
        # Anchors that can't double again still follow others in pairs.
        after = now.where("i is not null").select(F.col("doc_id").alias("_d"), F.col("fp").alias("_f"), (F.col("i") - 2**level).alias("_i"), F.col("rank").alias("next")).distinct()
        pairs = written(more.join(after, _same("doc_id", "fp", "_d", "_f") & (F.col("i") == F.col("_i"))).drop("_d", "_f", "_i"), "pairs")
        release(now)
        now, level = _ranked(pairs, ["rank", "next"]), level + 1
    release(now)
    out = stay[0]
    for s in stay[1:]:
        out = out.unionByName(s)
    return out


def _same(d: str, f: str, d2: str, f2: str):
    return F.col(d).eqNullSafe(F.col(d2)) & (F.col(f) == F.col(f2))


def _marked(rows: DataFrame, value: Column) -> DataFrame:
    """For each document that has ``rows``, their distinct ``value`` structs as a list, ``marks``. Written."""
    return written(rows.groupBy(F.col("doc_id").alias("_d"), F.col("fp").alias("_f")).agg(F.sort_array(F.collect_set(value)).alias("marks")), "marks")


def _with_texts(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The documents that have marks, with them."""
    if marks.count() <= BROADCAST_IDS:  # spares the shuffle of other documents' texts
        wanted = F.broadcast(marks.select(F.col("_f").alias("_w")).distinct())
        docs = docs.join(wanted, F.col("fp") == F.col("_w"), "left_semi")
    return docs.join(marks, _same("doc_id", "fp", "_d", "_f")).select("doc_id", "fp", "text", "marks")


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of 16 bytes as two columns of whole numbers."""
    both = np.frombuffer(b"".join(digests), dtype=">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _runs(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The lengths of the maximal runs of bytes that [first, end) cover; ``first`` rises."""
    if not len(first):
        return np.zeros(1, np.int64)
    far = np.maximum.accumulate(end)
    new = first[1:] > far[:-1]
    return far[np.r_[new, True]] - first[np.r_[True, new]]


def _whole(length: int):
    """For marked anchors: their windows' bytes as one string, hashed, and as cls the bytes that any window of the anchor has.

    Besides, a row without a hash for each text: s, the bytes that its marked anchors' first ranks cover, and e, the longest run of them.
    """
    near = reach(length)
    core = length - near + 1
    shared = length - 2 * near - K

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            n = batch.num_rows
            many, first, last, covered, longest, cls, digests = [], [], [], [], [], [], []
            marks = batch.column("marks")
            places = np.split(marks.flatten().field("at").to_numpy(zero_copy_only=False), np.cumsum(marks.value_lengths().to_numpy(zero_copy_only=False))[:-1])
            for t, where in zip(batch.column("text").to_pylist(), places, strict=True):
                at, starts, lasts = anchors(t, near)
                ends = _levels(at, shared)[1]
                marked = where[np.searchsorted(where, at) % len(where)] == at  # both rise
                runs = _runs(at[:-1][marked[:-1]], ends[marked[:-1]])
                covered.append(runs.sum())
                longest.append(runs.max())
                lasts = np.minimum(lasts, len(t) - length)
                marked &= starts <= lasts
                of, to = starts[marked], lasts[marked]
                many.append(len(of))
                first.append(of)
                last.append(to)
                cls += [xxhash.xxh64_intdigest(t[a : a + core]) for a in at[marked].tolist()]
                digests += [xxhash.xxh3_128_digest(t[s : e + length]) for s, e in zip(of.tolist(), to.tolist(), strict=True)]
            none = np.arange(n + len(digests)) < n
            index = pa.array(np.r_[np.arange(n), np.repeat(np.arange(n), many)])
            hashes = [np.array(cls, dtype=np.uint64).view(np.int64), *_halves(digests)]
            c, h1, h2 = (pa.array(np.r_[np.zeros(n, np.int64), h], mask=none) for h in hashes)
            columns = [batch.column("doc_id").take(index), batch.column("fp").take(index), c, pa.array(np.r_[(np.array(covered, np.int64), *first)]), pa.array(np.r_[(np.array(longest, np.int64), *last)]), h1, h2]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "cls", "s", "e", "h1", "h2"])

    return run


def _single(length: int):
    """For marked ranges of window starts: each window, hashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            marks = batch.column("marks")
            s, e, own = (marks.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("s", "e", "own"))
            each = e - s + 1
            at = np.arange(each.sum()) + np.repeat(s - (np.cumsum(each) - each), each)
            text = np.repeat(np.repeat(np.arange(batch.num_rows), marks.value_lengths().to_numpy(zero_copy_only=False)), each)
            digests: list[bytes] = []
            for t, places in zip(batch.column("text").to_pylist(), np.split(at, np.searchsorted(text, np.arange(1, batch.num_rows))), strict=True):
                digests += [xxhash.xxh3_128_digest(t[p : p + length]) for p in places.tolist()]
            index = pa.array(text)
            columns = [batch.column("doc_id").take(index), batch.column("fp").take(index), pa.array(at), pa.array(np.repeat(own, each)), *map(pa.array, _halves(digests))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "s", "own", "h1", "h2"])

    return run


def repeated_windows(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, fp, s, e: ranges of starts of windows of ``length`` bytes that also start elsewhere; and, with s and e null, shared and
    longest: bytes of a text in strings that the ranks found repeated, and the longest run of them. Written tables."""
    marks = _marked(repeated_runs(docs, length), F.struct("at"))
    whole = written(_with_texts(docs, marks).mapInArrow(_whole(length), "doc_id long, fp int, cls long, s long, e long, h1 long, h2 long"), "windows")
    release(marks)
    hashed, none = whole.where("h1 is not null"), F.lit(None).cast("long")
    kinds = hashed.groupBy("h1", "h2", "cls").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "fp", "s", "e")).alias("one"))
    kinds = written(kinds, "kinds")
    several = written(kinds.where("n > 1").groupBy("h1", "h2").agg(F.sum("n").alias("n")), "several")
    found = salted_join(hashed, several, ["h1", "h2"], "n", "left_semi", ["doc_id", "s"]).select("doc_id", "fp", "s", "e", none.alias("shared"), none.alias("longest"))
    shared = whole.where("h1 is null").select("doc_id", "fp", none.alias("s"), none.alias("e"), F.col("s").alias("shared"), F.col("e").alias("longest"))
    ranges = written(found.unionByName(shared), "ranges")
    # Where a kind of its own shares those bytes with another, a copy may begin or end within an anchor's windows.
    mixed = kinds.groupBy("cls").agg(F.min("n").alias("_least"), F.count(F.lit(1)).alias("_kinds")).where("_least = 1 and _kinds > 1").drop("_least")
    mixed = written(mixed, "mixed")
    marks = _marked(salted_join(kinds, mixed, ["cls"], "_kinds", "left_semi", ["h1"]).select("one.*", (F.col("n") == 1).alias("own")), F.struct("s", "e", "own"))
    release(whole, kinds, several, mixed)
    single = written(_with_texts(docs, marks).mapInArrow(_single(length), "doc_id long, fp int, s long, own boolean, h1 long, h2 long"), "windows")
    several = written(single.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "several")
    more = salted_join(single.where("own"), several, ["h1", "h2"], "_n", "left_semi", ["doc_id", "s"])
    more = written(more.select("doc_id", "fp", "s", F.col("s").alias("e"), none.alias("shared"), none.alias("longest")), "ranges")
    release(marks, single, several)
    return ranges.unionByName(more)


def spans_of(ranges: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the windows cover, as [start, end)."""
    out: list[list[int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e + length)
        else:
            out.append([s, e + length])
    return [(a, b) for a, b in out]


#: Texts that are cut at once.
SLICE = 500


def _cut(length: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            spans, kept, sizes = [], [], []
            for t, marks in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                mine, at, parts = spans_of([(m["s"], m["e"]) for m in marks or ()], length), 0, []
                for a, b in mine:
                    parts.append(t[at:a])
                    at = b
                spans.append([{"start": a, "end": b} for a, b in mine])
                sizes.append(len(t))
                left = b"".join([*parts, t[at:]])
                kept.append(left.decode("utf-8", "ignore").encode() if whole else hashlib.sha256(left).hexdigest())
            more = [c for c in batch.schema.names if c not in ("text", "marks")]
            if whole:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in more), pa.array(kept, pa.binary())], [*more, "kept"])
                continue
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in more), pa.array(spans, kind), pa.array(kept), pa.array(sizes, pa.int64())], [*more, "spans", "kept_sha256", "n_bytes"])

    return run


def _fingerprinted(docs: DataFrame, *more: str) -> DataFrame:
    """fp tells texts of one doc_id apart."""
    return texts(docs, *more).withColumn("fp", F.shiftright(F.xxhash64("text"), 32).cast("int"))


def _marks(docs: DataFrame, length: int) -> DataFrame:
    if reach(length) < 8:
        raise ValueError("the strings are too short for the anchors")
    ranges = repeated_windows(docs, length)
    places = F.collect_set(F.when(F.col("s").isNotNull(), F.struct("s", "e")))
    return ranges.groupBy(F.col("doc_id").alias("_d"), F.col("fp").alias("_f")).agg(places.alias("marks"), F.max("shared").alias("n_shared"), F.max("longest").alias("longest_shared"))


def repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, spans (start, end), kept_sha256, n_shared, longest_shared.

    Each byte that a string of ``length`` bytes covers, which also starts anywhere else in the input (in the document itself
    too), is removed. n_shared counts the bytes in strings of two or three anchors that also stand elsewhere, however long the
    whole copy is, and longest_shared the longest run of them: shorter copies than ``length`` show there, and lose nothing.
    Texts are UTF-8 bytes, whole; null and empty ones lose nothing; of repeated rows, each is a document, so that texts of
    ``length`` or more go whole; other columns are left behind. ``length`` must be 74 at least.
    """
    plain = _fingerprinted(docs)
    rows = plain.join(_marks(plain, length), _same("doc_id", "fp", "_d", "_f"), "left").select("doc_id", "text", "marks", "n_shared", "longest_shared")
    out = rows.mapInArrow(_cut(length, False), "doc_id long, n_shared long, longest_shared long, spans array<struct<start: long, end: long>>, kept_sha256 string, n_bytes long")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "spans", "kept_sha256", zero("n_shared"), zero("longest_shared"))


def without_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """``docs`` with every column, its texts without the bytes that ``repeats`` removes; texts that nothing is left of go.

    A cut inside a character takes the character's other bytes too. Where there is a column n_chars, it follows. Texts that were empty or null before stay.
    """
    plain = _fingerprinted(docs)
    others = docs.select(row_of(docs, "text").alias("_row"), F.col("text").isNull().alias("_null"), "doc_id", "text")
    rows = _fingerprinted(others, "_row", "_null").join(_marks(plain, length), _same("doc_id", "fp", "_d", "_f"), "left").select("_row", "_null", "text", "marks")
    kind = StructType([StructField("_row", others.schema["_row"].dataType), StructField("_null", BooleanType()), StructField("kept", BinaryType())])
    cut = rows.where("marks is not null").mapInArrow(_cut(length, True), kind).where(F.length("kept") > 0).withColumn("_cut", F.lit(True))
    out = rows.where("marks is null").select("_row", "_null", F.col("text").alias("kept"), F.lit(False).alias("_cut")).unionByName(cut)
    kept = F.when(~F.col("_null"), F.col("kept").cast("string"))
    n = {c: F.when(F.col("_cut"), F.length(kept).cast(docs.schema[c].dataType)).otherwise(F.col("_row")[c]) for c in docs.columns if c == "n_chars"}
    return out.select(*[kept.alias(c) if c == "text" else n.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
