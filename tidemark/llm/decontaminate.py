"""Benchmark decontamination: bounds that lose no alignment pick items and passages, Smith-Waterman alignment decides.

The test items are a stated query set: they go to the executors in blocks of a bounded size. A first pass counts in how many
documents each of their words occurs, which orders the work and excludes nothing; a second looks, in each text, for stretches that share
enough words with an item and aligns them. No text is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import forget, texts, unused, written
from tidemark.llm.links import BROADCAST_IDS

#: Characters of test items in a block: what goes to an executor at once.
BLOCK_CHARS = 8_000_000
#: Shorter items must be there whole, word for word; those of under LEAST_WHOLE words are no passages and match nothing.
LEAST_WORDS, LEAST_WHOLE = 8, 3
#: Occurrences of items' words in a text that are looked at together.
OCCURRENCES = 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1

_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: bytes) -> list[str]:
    """Words, lower-cased A-Z; ASCII punctuation separates them as white space does."""
    return text.translate(_PLAIN).decode("utf-8", "replace").split()


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """The best local alignment's score and where in the passage it starts and ends (end excluded)."""
    score, end = _best(item, passage)
    if score <= 0:
        return 0, 0, 0
    back, length = _best(item[::-1], passage[:end][::-1])
    return score, end - length, end


def _best(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    steps = -GAP * np.arange(len(b) + 1)
    row, best, end = np.zeros(len(b) + 1, dtype=np.int64), 0, 0
    for x in a:
        new = np.zeros_like(row)
        np.maximum(row[:-1] + np.where(b == x, MATCH, MISMATCH), row[1:] + GAP, out=new[1:])
        new = np.maximum.accumulate(np.maximum(new, 0) + steps) - steps
        at = int(new.argmax())
        if new[at] > best:
            best, end = int(new[at]), at
        row = new
    return best, end


def _frequencies(docs: DataFrame, code: dict[str, int]) -> np.ndarray:
    """In how many documents each word of the block's items occurs."""
    held = docs.sparkSession.sparkContext.broadcast(code)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        code = held.value
        n = np.zeros(len(code), dtype=np.int64)
        for batch in batches:
            for t in batch.column("text").to_pylist():
                n[[code[w] for w in code.keys() & words_of(t)]] += 1
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["word", "n"])

    out = np.zeros(len(code), dtype=np.int64)
    for r in docs.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r["word"]] = r["n"]
    return out


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


class Searcher:
    """Finds, in one text after another, every item whose best alignment scores ``least`` of the whole item or more.

    Such an alignment scores at most 2 a match and loses 1 for each other word of its passage, so it has ``need`` matches or more
    in a passage of ``width`` words or fewer. Two bounds follow, and neither can lose an alignment: of any words of the item that
    all but ``need - sure`` of its places hold, the text has ``sure`` places' worth (the words in fewest documents are taken, for speed
    alone); and some ``width`` words in a row share ``need`` words with the item, each as often as both have it. Only what passes is aligned.
    """

    def __init__(self, block: list[tuple[int | None, list[str]]], n_docs: np.ndarray, least: float) -> None:
        self.code = _codes(block)
        self.names = [name for name, _ in block]
        self.items = [np.array([self.code[w] for w in words], dtype=np.int64) for _, words in block]
        size = np.array([len(x) for x in self.items])
        self.least = np.where(size < LEAST_WORDS, 1.0, least)
        score = np.ceil(self.least * MATCH * size).astype(np.int64)
        self.need, self.width = np.maximum(1, -(-score // MATCH)), np.maximum(1, (1 + MATCH) * size - score)
        self.sure = -(-self.need // 4)
        own = [np.unique(x, return_counts=True) for x in self.items]
        self.n_own = np.array([len(c) for c, _ in own])
        self.first_own = np.cumsum(self.n_own) - self.n_own
        self.own, self.often = (np.concatenate([x[k] for x in own]) for k in (0, 1))
        taken: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i, (c, m) in enumerate(own):
            rare = np.argsort(n_docs[c], kind="stable")
            rare = rare[: np.searchsorted(np.cumsum(m[rare]), size[i] - self.need[i] + self.sure[i]) + 1]
            taken.append((c[rare], np.full(len(rare), i), m[rare]))
        word, item, places = (np.concatenate(x) for x in zip(*taken, strict=True))
        order = np.argsort(word, kind="stable")
        self.n_rare = np.bincount(word, minlength=len(self.code))
        self.first_rare, self.rare_item, self.rare_places = np.cumsum(self.n_rare) - self.n_rare, item[order], places[order]

    def __call__(self, text: bytes) -> list[tuple[int | None, float, int, int]]:
        """item, score (1: the whole item, word for word), first word and end of the best passage, for each item with ``least`` or more."""
        words = words_of(text)
        codes = np.fromiter(map(self.code.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        place = np.flatnonzero(codes >= 0)
        place = place[np.argsort(codes[place], kind="stable")]  # by word, then in the text's order
        known, first, n = np.unique(codes[place], return_index=True, return_counts=True)
        at = _ranges(self.first_rare[known], self.n_rare[known])
        likely = np.bincount(self.rare_item[at], weights=self.rare_places[at], minlength=len(self.items)) >= self.sure
        best: dict[object, tuple[int, float, int, int]] = {}
        for i, spans in self._near(np.flatnonzero(likely), place, known, first, n, len(words)):
            own = self.items[i]
            score, a, b = max(((_best(own, codes[a:b])[0], a, b) for a, b in spans), key=lambda x: x[0])
            if score >= self.least[i] * MATCH * len(own):
                _, s, e = align(own, codes[a:b])
                key = ("", i) if self.names[i] is None else self.names[i]
                best[key] = max(best.get(key, (i, 0.0, 0, 0)), (i, score / (MATCH * len(own)), a + s, a + e), key=lambda x: x[1])
        return [(self.names[i], *rest) for i, *rest in best.values()]

    def _near(self, likely: np.ndarray, place: np.ndarray, known: np.ndarray, first: np.ndarray, n: np.ndarray, length: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """The items of ``likely`` with the spans of the text in which some ``width`` words share ``need`` words with them."""
        word = _ranges(self.first_own[likely], self.n_own[likely])
        item, often, word = np.repeat(likely, self.n_own[likely]), self.often[word], self.own[word]
        at = np.minimum(np.searchsorted(known, word), max(0, len(known) - 1))
        here = known[at] == word if len(known) else np.zeros(0, dtype=bool)
        item, often, at = item[here], often[here], at[here]
        size = np.cumsum(n[at])
        while len(item):  # so many occurrences at a time, whole items each
            upto = int(np.searchsorted(item, item[min(len(item) - 1, np.searchsorted(size, OCCURRENCES))], "right"))
            yield from self._spans(item[:upto], often[:upto], at[:upto], place, first, n, length)
            item, often, at, size = item[upto:], often[upto:], at[upto:], size[upto:] - size[upto - 1]

    def _spans(self, item: np.ndarray, often: np.ndarray, at: np.ndarray, place: np.ndarray, first: np.ndarray, n: np.ndarray, length: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        i, count = _ranges(first[at], n[at]), n[at]
        item, often, rank = np.repeat(item, count), np.repeat(often, count), _ranges(np.zeros_like(count), count)
        width = self.width[item]
        # The word at p counts in the stretches of ``width`` words that end at p or later, hold p, and hold fewer than ``often`` of the same word before it.
        begin = np.maximum(place[i], np.where(rank >= often, place[np.maximum(i - often, 0)] + width, 0))
        end = place[i] + width
        some = begin < end
        item, begin, end = item[some], begin[some], end[some]
        stride = length + int(self.width.max()) + 1
        event = np.concatenate([(item * stride + end) * 2, (item * stride + begin) * 2 + 1])
        event.sort()
        shared = np.cumsum(np.where(event & 1, 1, -1))
        of, last = np.divmod(event >> 1, stride)
        full = np.flatnonzero(shared >= self.need[of])
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, a, b in zip(of[full].tolist(), (last[full] - self.width[of[full]] + 1).tolist(), last[full + 1].tolist(), strict=True):
            a, b, own = max(0, a), min(length, b), spans[k]
            if own and a <= own[-1][1]:
                own[-1] = (own[-1][0], max(b, own[-1][1]))
            else:
                own.append((a, b))
        yield from spans.items()


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """A row for each document and test item of which it holds a copy, edited or not: doc_id, item_id, score, first_word, end_word.

    ``score`` is the alignment's share of what the whole item would score. Whole texts are searched. An item of under LEAST_WORDS words must be there
    word for word; null or empty texts and items of under LEAST_WHOLE words match nothing. All texts of an item_id are searched, and the best one
    counts; items without an id are told apart by their texts. Repeated rows of ``docs`` give rows each, repeated items one; other columns are left behind.
    """
    plain, out = texts(docs), None
    for block in _blocks(benchmark):
        found = _in_block(plain, block, least)
        out = found if out is None else out.unionByName(found)
    return plain.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, first_word long, end_word long") if out is None else out


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, list[str]]]]:
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    block: list[tuple[int | None, list[str]]] = []
    held = 0
    for r in rows.toLocalIterator():
        words = words_of(r["text"].encode())
        if len(words) >= LEAST_WHOLE:
            block.append((r["item_id"], words))
            held += len(r["text"])
        if held > BLOCK_CHARS:
            yield block
            block, held = [], 0
    if block:
        yield block


def _codes(block: list[tuple[int | None, list[str]]]) -> dict[str, int]:
    code: dict[str, int] = {}
    for _, words in block:
        for w in words:
            code.setdefault(w, len(code))
    return code


def _in_block(docs: DataFrame, block: list[tuple[int | None, list[str]]], least: float) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast((block, _frequencies(docs, _codes(block))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        find = Searcher(*held.value, least)
        for batch in batches:
            rows = [(d, *m) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for m in find(t)]
            columns = [*zip(*rows, strict=True)] or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "score", "first_word", "end_word"])

    return docs.mapInArrow(search, "doc_id long, item_id long, score double, first_word long, end_word long")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no copy of a test item; each is judged by its own text, rows of a null id too.

    Of the rows that go, id and text's hash are written, and taken out of ``docs``, by broadcast while they are few.
    """
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    plain, gone = texts(docs, text.alias("fp")), None
    for block in _blocks(benchmark):
        found = _holding(plain, block, least)
        gone = found if gone is None else gone.unionByName(found)
    if gone is None:
        return docs
    names = [unused(c, docs) for c in ("_gone", "_fp")]
    gone = written(gone.distinct().toDF(*names), "contaminated")
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(names[0])) & (text == F.col(names[1]))
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, on, "left_anti")


def _holding(plain: DataFrame, block: list[tuple[int | None, list[str]]], least: float) -> DataFrame:
    """doc_id and fp of the texts that hold an item of the block."""
    held = plain.sparkSession.sparkContext.broadcast((block, _frequencies(plain, _codes(block))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        find = Searcher(*held.value, least)
        for batch in batches:
            yield batch.select(["doc_id", "fp"]).filter(pa.array([bool(find(t)) for t in batch.column("text").to_pylist()], pa.bool_()))

    return plain.mapInArrow(search, "doc_id long, fp long")
