"""Best-fit-decreasing packing of token sequences into sequences of a fixed capacity.

Lengths are whole numbers up to the capacity, so documents of a length are alike: only how many there are of each
(at most ``capacity`` counts) goes to the driver. A segment tree over remaining capacities finds the tightest open bin in
logarithmic time; where it serves a run of equal documents, the run is placed at once, as one by one would place it.
The plan says which ranks of a length go to which bins; executors look theirs up.
"""

from __future__ import annotations

import json
import random
import re
import struct
import zlib
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import numbered, remembered, texts, written
from tidemark.llm.wordpieces import byte_of_symbol

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: Words whose ids a worker remembers at once, at most: those of late, and half of them those that were looked up before.
REMEMBERED = 600_000
#: Rows of a plan at most: it goes to every executor. Counts of 4096 lengths give far fewer.
PLAN_ROWS = 2_000_000


class OpenBins:
    """How many bins are open at each remaining capacity, under a segment tree of which capacities have any."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.any = np.zeros(2 * self.size, dtype=bool)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]

    def add(self, left: int, first: int, n: int) -> None:
        """Open bins ``first`` to ``first + n - 1``, each with ``left`` remaining."""
        if n and left:
            self.runs[left].append((first, n))
            self._mark(left, True)

    def take(self, left: int, n: int) -> tuple[int, int]:
        """The first bin and the number, at most ``n``, of bins with ``left`` remaining; they are no longer open at it."""
        first, m = self.runs[left].pop()
        if m > n:
            self.runs[left].append((first + n, m - n))
        elif not self.runs[left]:
            self._mark(left, False)
        return first, min(n, m)

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of ``need`` or more at which a bin is open."""
        at = need + self.size
        if self.any[at]:
            return need
        while at > 1:
            if not at & 1 and self.any[at + 1]:
                at += 1
                break
            at >>= 1
        else:
            return None
        while at < self.size:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.size

    def _mark(self, left: int, on: bool) -> None:
        at = left + self.size
        self.any[at] = on
        while at > 1:
            at >>= 1
            on = bool(self.any[2 * at] or self.any[2 * at + 1])
            if self.any[at] == on:
                return
            self.any[at] = on


def best_fit_plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, ranks, first bin, documents a bin, offset in the bin) and the number of bins.

    ``counts``: documents of each length from 1 to ``capacity``. Ranks first + i*k to first + i*k + k - 1 (k a bin) go to
    bin ``first bin + i``, from the offset on.
    """
    open_bins, plan, bins = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            left = open_bins.tightest(length)
            if left is None:
                left = capacity
                a_bin = left // length
                n = -(-todo // a_bin)
                first, bins = bins, bins + n
            else:
                a_bin = left // length
                first, n = open_bins.take(left, -(-todo // a_bin))
            whole = min(n, todo // a_bin)
            if whole:
                plan.append((length, rank, whole * a_bin, first, a_bin, capacity - left))
                open_bins.add(left - a_bin * length, first, whole)
            rank, todo = rank + whole * a_bin, todo - whole * a_bin
            if whole < n:  # the last bin of the run takes what is left
                plan.append((length, rank, todo, first + whole, todo, capacity - left))
                open_bins.add(left - todo * length, first + whole, 1)
                rank, todo = rank + todo, 0
    return np.array(plan, dtype=np.int64).reshape(-1, 6), bins


def place(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` (a written table with ``length``, 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Best-fit decreasing over all pieces. Equal rows are told apart by rank. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length: at most ``capacity``
    plan, _ = best_fit_plan(counts, capacity)
    if len(plan) > PLAN_ROWS:
        raise ValueError(f"a plan of {len(plan)} rows; the bound is {PLAN_ROWS}")
    ends = np.searchsorted(plan[:, 0] * -1, np.arange(0, -capacity - 1, -1), side="right") if len(plan) else np.zeros(capacity + 1, int)
    starts = np.searchsorted(plan[:, 0] * -1, np.arange(0, -capacity - 1, -1), side="left") if len(plan) else ends
    held = spark.sparkContext.broadcast((plan, starts, ends))
    ranked = numbered(pieces, ["length"], [c for c in pieces.columns if c != "length"], "_rank", 64)
    names = pieces.columns

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, starts, ends = held.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(zero_copy_only=False), batch.column("_rank").to_numpy(zero_copy_only=False)
            row = np.empty(len(length), dtype=np.int64)
            for v in np.unique(length):
                mine = length == v
                row[mine] = starts[v] + np.searchsorted(plan[starts[v] : ends[v], 1], rank[mine], side="right") - 1
            _, first, _, to, a_bin, at = plan[row].T
            i = rank - first
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(to + i // a_bin), pa.array(at + i % a_bin * length)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(look_up, schema)


_MARKS = (b".", b",")
#: Steps of tokenizers that look at words alone, whatever stands around them.
_BY_WORD = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "Replace", "Split", "ByteLevel", "Whitespace", "WhitespaceSplit", "Punctuation", "Digits", "BertNormalizer", "BertPreTokenizer"}
#: Patterns of Replace and Split steps that look at words alone (fixed values): a step with any other may look across them.
_BY_WORD_PATTERNS = {r"\s+", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
_PROBES = "a Z b. c, . , d.e f,g 7 8. é Éa ß. 's don't we'll x'S \t \n  \r\n () a) (b 3.5 1,000 _ -- a-b ö, é. zz.. qq,, words straße müde, naïve. œuvre ÿær é ªº ×÷ ".split(" ")


def by_words(tokenizer_json: bytes) -> bool:
    """Whether a text's ids are those of its words, lower-cased A-Z, in a row, and a word's last full stop or comma parts from the letter before it.

    All steps, and the patterns that they have, must be known to look at words alone, and many mixtures of odd words must come out the same either way.
    """
    from tokenizers import Tokenizer

    parts = json.loads(tokenizer_json)
    steps = [x for k in ("normalizer", "pre_tokenizer") for x in ((parts.get(k) or {}).get("normalizers") or (parts.get(k) or {}).get("pretokenizers") or [parts.get(k) or {"type": None}])]
    if not {x["type"] for x in steps} <= _BY_WORD or parts.get("post_processor"):
        return False
    if not {(x.get("pattern") or {}).get("Regex") for x in steps if x["type"] in ("Replace", "Split")} <= _BY_WORD_PATTERNS:
        return False
    tokenizer = Tokenizer.from_buffer(tokenizer_json)
    tokenizer.encode_special_tokens = True
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    known = _Ids(tokenizer_json)
    rng = random.Random(1)
    for _ in range(300):
        text = " ".join(rng.choices(_PROBES, k=8))
        if np.array(ids(text), "<u4").tobytes() != b"".join(known.of(text.encode().lower().split())):
            return False
    return True


#: Words of lower-case letters up to U+00FF, as UTF-8.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_SYMBOLS = {b: s for s, b in byte_of_symbol().items()}


def letters_alone(parts: dict) -> Tokenizer | None:
    """A tokenizer of the byte-level symbols of ``_LETTERS``, where all other steps of one that is ``by_words`` leave such words as they are; else None."""
    from tokenizers import Tokenizer

    steps = [x for k in ("normalizer", "pre_tokenizer") for x in ((parts.get(k) or {}).get("normalizers") or (parts.get(k) or {}).get("pretokenizers") or [parts.get(k) or {"type": None}])]
    if not {x["type"] for x in steps} <= {"NFC", "Lowercase", "Replace", "Split", "ByteLevel"} or [x["add_prefix_space"] for x in steps if x["type"] == "ByteLevel"] != [False]:
        return None
    tokenizer = Tokenizer.from_buffer(json.dumps(parts | {"normalizer": None, "pre_tokenizer": None}).encode())
    tokenizer.encode_special_tokens = True
    return tokenizer


class _Ids:
    """The ids of words, lower-cased A-Z, as little-endian unsigned 32-bit numbers, by a tokenizer that is ``by_words``."""

    def __init__(self, tokenizer_json: bytes) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(tokenizer_json)
        self.tokenizer.encode_special_tokens = True
        self.letters = letters_alone(json.loads(tokenizer_json))
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def of(self, words: list[bytes]) -> list[bytes]:
        ids = [*map(self.known.get, words)]
        if new := {w for w, i in zip(words, ids, strict=True) if i is None}:
            got = self._with(new)
            ids = [got[w] if i is None else i for w, i in zip(words, ids, strict=True)]
        return ids

    def _with(self, new: set[bytes]) -> dict[bytes, bytes]:
        """The words known, ``new`` among them."""
        if 2 * (len(self.known) + len(new)) > REMEMBERED:  # what is still in use comes back from there
            self.before, self.known = self.known, {}
        known, before = self.known, self.before
        marked = {w for w in new if len(w) > 1 and w[-1:] in _MARKS and 97 <= w[-2] <= 122}
        plain = {*(new - marked), *(w[:-1] for w in marked), *_MARKS}
        known.update([(w, before[w]) for w in plain if w not in known and w in before])
        plain = [w for w in plain if w not in known]
        letters = [w for w in plain if _LETTERS.fullmatch(w)] if self.letters else []
        rest = [w for w in plain if not _LETTERS.fullmatch(w)] if self.letters else plain
        as_symbols = [w.decode() if w.isascii() else w.decode("latin-1").translate(_SYMBOLS) for w in letters]
        for some, tokenizer, shown in ((letters, self.letters, as_symbols), (rest, self.tokenizer, [w.decode() for w in rest])):
            if some:
                for w, e in zip(some, tokenizer.encode_batch_fast(shown, add_special_tokens=False), strict=True):
                    ids = e.ids
                    known[w] = struct.pack(f"<{len(ids)}I", *ids)
        for w in marked:
            known[w] = known[w[:-1]] + known[w[-1:]]
        return known

    def text(self, text: bytes) -> bytes:
        return b"".join(self.of(text.lower().split()))


class _Whole:
    """The ids of whole texts, by any tokenizer."""

    def __init__(self, tokenizer_json: bytes) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(tokenizer_json)
        self.tokenizer.encode_special_tokens = True

    def text(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()


def _ids_of(tokenizer_json: bytes) -> _Ids | _Whole:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is what Spark has given it
    return remembered((_Ids, zlib.crc32(tokenizer_json)), lambda: (_Ids if by_words(tokenizer_json) else _Whole)(tokenizer_json))


def tokenize(docs: DataFrame, tokenizer_json: bytes, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit).

    A document is its whole text's ids, then ``end_id``; one that is longer than ``capacity`` is cut into pieces of it.
    Null and empty texts are the end alone; repeated rows give pieces each; other columns are left behind.
    """
    return _pieces(docs, tokenizer_json, capacity, end_id, "ids")


def _pieces(docs: DataFrame, tokenizer_json: bytes, capacity: int, end_id: int, what: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    end, digest = int(end_id).to_bytes(4, "little"), what == "ids_crc32"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _ids_of(held.value)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = known.text(text.as_py()) + end
                for i in range(0, len(ids) // 4, capacity):
                    part = ids[4 * i : 4 * (i + capacity)]
                    rows.append((doc_id, i // capacity, i, len(part) // 4, zlib.crc32(part) if digest else part))
            columns = [*zip(*rows, strict=True)] or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64() if digest else pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", what])

    return texts(docs).mapInArrow(cut, f"doc_id long, piece int, start long, length long, {what} {'long' if digest else 'binary'}")


def pack(docs: DataFrame, tokenizer_json: bytes, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. See ``tokenize`` and ``place``."""
    return place(written(_pieces(docs, tokenizer_json, capacity, end_id, "ids_crc32"), "pieces"), capacity)
