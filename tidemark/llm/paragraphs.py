"""Near-equal paragraphs and repeated passages: MinHash bands tuned for recall, exact Jaccard confirmation, removal by connected components.

Paragraphs are lines. A passage that is repeated inside longer lines makes no two of them near-equal, so lines of over PIECES words
are also cut where their content says so: before a word whose hash, with its predecessor's, is the least among REACH words to either side.
Copies of a passage are cut alike, all but their ends, however much stands around them. Pieces are copies where they are equal, word
for word; an edit spoils the piece that holds it, and no other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import release, salted_join, texts, written
from tidemark.llm.links import BROADCAST_IDS, candidates, linked
from tidemark.llm.shingles import MinHash, mix, tuned, windows_of, word_hashes

#: Longer lines are cut into pieces; words to either side that a cut is the least of, so that pieces have REACH + 1 words or more.
PIECES, REACH = 24, 6
#: Words that are looked at together.
WORDS = 100_000
_GOLD, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Lines:
    """All lines with a word of some texts: text and line number of each, its word count, and the words' hashes."""

    def __init__(self, some: list[bytes]) -> None:
        of, index, words, counts = [], [], [], []
        for k, t in enumerate(some):
            for i, line in enumerate(t.lower().split(b"\n")):
                if w := line.split():
                    of.append(k)
                    index.append(i)
                    counts.append(len(w))
                    words += w
        self.of, self.index, self.counts = np.array(of, np.int64), np.array(index, np.int32), np.array(counts, np.int64)
        self.hashes = word_hashes(words)

    def pieces(self) -> tuple[np.ndarray, ...]:
        """Of the pieces of long lines: the line's place in this table, first word in the line, words, and two hashes of them."""
        first = np.cumsum(self.counts) - self.counts
        line = np.repeat(np.arange(len(self.counts)), self.counts)
        before = np.r_[np.zeros(1, np.uint64), self.hashes[:-1]]
        before[first] = 0
        key = mix(self.hashes + before * _GOLD)
        least = (self.counts > PIECES)[line]
        for d in range(1, REACH + 1):
            other = line[d:] != line[:-d]
            least[d:] &= (key[d:] < key[:-d]) | other
            least[:-d] &= (key[:-d] < key[d:]) | other
        least[first] = True
        start = np.flatnonzero(least)
        size = np.diff(np.r_[start, len(line)])
        place = (np.arange(len(line)) - np.repeat(start, size)).astype(np.uint64)
        sums = [np.add.reduceat(mix(self.hashes + (place + np.uint64(1)) * f), start).view(np.int64) for f in (_GOLD, _OTHER)]
        line = line[start]
        own = (self.counts > PIECES)[line] & (size > REACH)  # what a line's ends leave is compared with the line alone
        return tuple(x[own] for x in (line, start - first[line], size, *sums))


def _named(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A name for each line: its shingles, each as often as it is there, in any order."""
    if not len(starts):
        return np.empty(0, np.int64)
    return (mix(np.add.reduceat(mix(hashes ^ _GOLD), starts)) >> np.uint64(1)).view(np.int64)


def _some(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, list[bytes]]]:
    """The batch's texts, few enough at a time, with the first one's place."""
    start, held, n = 0, [], 0
    for i, t in enumerate(batch.column(column)):
        held.append(t.as_py())
        n += len(held[-1])
        if n > 6 * WORDS:
            yield start, held
            start, held, n = i + 1, [], 0
    if held:
        yield start, held


def _banded(minhash: MinHash):
    """Lines with their names and bands; and pieces, which have two hashes instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, fps = batch.column("doc_id"), batch.column("fp")
            for start, some in _some(batch):
                lines = Lines(some)
                if not (n := len(lines.of)):
                    continue
                hashes, starts = windows_of(lines.hashes, lines.counts)
                line, first, size, a, b = lines.pieces()
                of, is_line = pa.array(start + np.r_[lines.of, lines.of[line]]), np.arange(n + len(line)) < n
                ends = np.minimum(np.arange(n + len(line) + 1), n) * minhash.bands
                bands = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(minhash.keys(mix(hashes), starts).T.ravel()))
                piece = lambda x: pa.array(np.r_[np.zeros(n, x.dtype), x], mask=is_line)  # noqa: B023, E731
                name = pa.array(np.r_[_named(hashes, starts), np.zeros(len(line), np.int64)], mask=~is_line)
                columns = [ids.take(of), fps.take(of), pa.array(np.r_[lines.index, lines.index[line]]), name, bands, piece(first.astype(np.int32)), piece(size.astype(np.int32)), piece(a), piece(b)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "i", "id", "bands", "s", "n", "a", "b"])

    return run


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, some in _some(batch):
            lines = Lines(some)
            if not len(lines.of):
                continue
            hashes, starts = windows_of(lines.hashes, lines.counts)
            names, ends = _named(hashes, starts), np.r_[starts[1:], len(hashes)]
            marks = [{*m} for m in batch.column("marks").slice(start, len(some)).to_pylist()]
            own = [k for k, (d, i) in enumerate(zip(lines.of.tolist(), lines.index.tolist(), strict=True)) if i in marks[d]]
            sets = [np.unique(hashes[starts[k] : ends[k]]) for k in own]
            yield pa.RecordBatch.from_arrays([pa.array(names[own]), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "n", "elements"])


def _line_copies(docs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """doc_id, fp, i, component of the lines in components of several, written. rows: lines, with id and bands."""
    buckets = candidates(rows.select(F.explode("bands").alias("key"), "id"))
    ids = written(buckets.select("id").distinct(), "ids")
    wanted = ids.select(F.col("id").alias("_w"))
    places = rows.join(F.broadcast(wanted) if ids.count() <= BROADCAST_IDS else wanted, F.col("id") == F.col("_w"), "left_semi")
    first = places.groupBy("id").agg(F.min(F.struct("doc_id", "fp", "i")).alias("_p")).select("_p.*")
    marks = written(first.groupBy(F.col("doc_id").alias("_d"), F.col("fp").alias("_f")).agg(F.collect_set("i").alias("marks")), "marks")
    some = docs
    if marks.count() <= BROADCAST_IDS:  # spares the shuffle of other documents' texts
        some = docs.join(F.broadcast(marks.select(F.col("_f").alias("_w")).distinct()), F.col("fp") == F.col("_w"), "left_semi")
    held = some.join(marks, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("fp") == F.col("_f"))).select("text", "marks")
    sets = written(held.mapInArrow(_sets_of, "id long, n long, elements binary").dropDuplicates(["id"]), "sets")
    found = linked(buckets, sets, percent)
    release(ids, marks, buckets, sets)
    # Lines of one name are many where a line is common: they are counted before they meet their component.
    names = rows.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).join(found.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
    names = written(names.select("id", "_n", F.coalesce("component", "id").alias("component")), "names")
    several = names.groupBy("component").agg(F.sum("_n").alias("_all")).where("_all > 1").select("component")
    names = written(names.join(several, "component", "left_semi"), "names")
    return written(salted_join(rows.select("doc_id", "fp", "i", "id"), names, ["id"], "_n", "inner", ["doc_id", "i"]).drop("id"), "copies")


def _marks(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` (doc_id, fp, i, s, n and ``by``) with gone: false for the first place of each value of ``by``."""
    place = F.struct("doc_id", "fp", "i", "s", "n")
    first = written(rows.groupBy(*by).agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_all")), "firsts")
    out = salted_join(rows, first, by, "_all", "inner", ["doc_id", "i", "s"])
    return written(out.select("doc_id", "fp", "i", "s", "n", (place != F.col("_first")).alias("gone")), "marked")


def copied_parts(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, fp, i, s, n, gone of all lines (s = -1, n = 0) and pieces (s: first word in the line, n: words) that have copies. Written.

    Lines are copies where their sets of 5-word shingles (lower-cased A-Z; under five words, one of them all) are linked, directly or
    through others, by 100 * intersection >= ``percent`` * union. Pieces are copies where they are equal; those of lines that go are
    left out. gone is false for the first of all copies. fp tells texts of one doc_id apart.
    """
    minhash = MinHash(*tuned(percent / 100))
    rows = written(docs.mapInArrow(_banded(minhash), "doc_id long, fp int, i int, id long, bands array<long>, s int, n int, a long, b long"), "paragraphs")
    lines = _line_copies(docs, rows.where("id is not null").select("doc_id", "fp", "i", "id", "bands"), percent)
    lines = _marks(lines.select("doc_id", "fp", "i", F.lit(-1).alias("s"), F.lit(0).alias("n"), "component"), ["component"])
    pieces = rows.where("id is null").select("doc_id", "fp", "i", "s", "n", "a", "b")
    several = written(pieces.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "several")
    pieces = written(salted_join(pieces, several, ["a", "b"], "_n", "inner", ["doc_id", "i", "s"]), "pieces")
    release(rows, several)
    away = lines.where("gone").select(F.col("doc_id").alias("_d"), F.col("fp").alias("_f"), F.col("i").alias("_i")).distinct()
    left = pieces.join(away, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("fp") == F.col("_f")) & (F.col("i") == F.col("_i")), "left_anti")
    pieces = _marks(written(left, "pieces"), ["a", "b"])
    return lines.unionByName(pieces)


_WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def without(line: bytes, parts: list[tuple[int, int]]) -> bytes:
    """``line`` without runs of words (first, count), and without the white space after them."""
    out, at, words = [], 0, [m.span() for m in _WORD.finditer(line)]
    for s, n in sorted(parts):
        out.append(line[at : words[s][0]])
        at = words[s + n - 1][1]
    return b"".join([*out, line[at:]])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_paragraphs", "n_removed", "removed", "n_pieces_removed", "pieces_removed", "n_words_removed", "n_words_copied", "longest_copied", "kept_text"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.list_(pa.struct([("line", pa.int32()), ("first_word", pa.int32()), ("words", pa.int32())])), *[pa.int64()] * 3, pa.string()]
    for batch in (b.slice(i, 300) for b in batches for i in range(0, b.num_rows, 300)):
        rows = []
        for d, t, marks in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "marks")), strict=True):
            lines = t.split(b"\n")
            if not marks:
                rows.append((d, sum(bool(x.strip()) for x in lines), 0, [], 0, [], 0, 0, 0, t.decode("utf-8", "replace")))
                continue
            counts = [len(x.split()) for x in lines]
            starts = np.r_[0, np.cumsum(counts)]
            copied, gone = np.zeros(int(starts[-1]) + 1, dtype=bool), np.zeros(int(starts[-1]), dtype=bool)
            for m in marks:
                a = int(starts[m["i"]]) + max(m["s"], 0)
                b = int(starts[m["i"] + 1]) if m["s"] < 0 else a + m["n"]
                copied[a:b] = True
                gone[a:b] |= m["gone"]
            edges = np.flatnonzero(np.diff(np.r_[False, copied]))
            away, parts = sorted(m["i"] for m in marks if m["gone"] and m["s"] < 0), {}
            for m in marks:
                if m["gone"] and m["s"] >= 0:
                    parts.setdefault(m["i"], []).append((m["s"], m["n"]))
            left = t
            if away or parts:
                no = {*away}
                left = b"\n".join(without(x, parts[i]) if i in parts else x for i, x in enumerate(lines) if i not in no)
            pieces = [{"line": i, "first_word": s, "words": n} for i in sorted(parts) for s, n in sorted(parts[i])]
            rows.append((d, sum(c > 0 for c in counts), len(away), away, len(pieces), pieces, int(gone.sum()), int(copied.sum()), int((edges[1::2] - edges[::2]).max(initial=0)), left.decode("utf-8", "replace")))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


_OUT = "doc_id long, n_paragraphs long, n_removed long, removed array<int>, n_pieces_removed long, pieces_removed array<struct<line: int, first_word: int, words: int>>, n_words_removed long, n_words_copied long, longest_copied long, kept_text string"


def without_paragraph_copies(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_paragraphs, n_removed, removed (line numbers from 0), n_pieces_removed, pieces_removed, n_words_removed,
    n_words_copied, longest_copied, kept_text.

    Paragraphs are lines with a word. Of all copies of a line or of a piece of a long line (see ``copied_parts``), the first by doc_id and
    place stays and the others go; lines of under five words only if they are equal, word for word. n_words_copied counts the words of
    all that has a copy elsewhere, the first copies included, and longest_copied the longest run of them. Null and empty texts have
    none; of repeated rows, the same parts go from each (a row can't be told from its twin), the first one's own copies included only
    where another document or place precedes; rows without an id come first; other columns are left behind.
    """
    plain = texts(docs).withColumn("fp", F.shiftright(F.xxhash64("text"), 32).cast("int"))
    marks = copied_parts(plain, percent)
    marks = marks.groupBy(F.col("doc_id").alias("_d"), F.col("fp").alias("_f")).agg(F.sort_array(F.collect_set(F.struct("i", "s", "n", "gone"))).alias("marks"))
    rows = plain.join(marks, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("fp") == F.col("_f")), "left")
    return rows.select("doc_id", "text", "marks").mapInArrow(_cut, _OUT)
