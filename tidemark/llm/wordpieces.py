"""Token counts by greedy longest match, in time linear in the word (Song et al., 2021, "Fast WordPiece").

The vocabulary's surface forms make a trie. A node that cannot go on has a failure link to the node that stands for what
is left once the pieces matched so far are popped, and holds how many those are: pieces are counted, never built.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import remembered, texts

#: Words whose counts a worker remembers at once.
REMEMBERED = 400_000


class PieceCounter:
    """Counts the pieces of words over a vocabulary that holds every single byte."""

    def __init__(self, pieces: Iterable[bytes]) -> None:
        pieces = {*pieces, *(bytes([b]) for b in range(256))} - {b""}
        self.child: list[dict[int, int]] = [{}]
        final = [False]
        for p in pieces:
            at = 0
            for b in p:
                if (to := self.child[at].get(b)) is None:
                    to = self.child[at][b] = len(self.child)
                    self.child.append({})
                    final.append(False)
                at = to
            final[at] = True
        self.fail, self.popped = [0] * len(final), [0] * len(final)
        level = [0]
        while level:  # by depth: links lead to shorter strings
            below = []
            for at in level:
                for b, to in self.child[at].items():
                    below.append(to)
                    if final[to]:
                        self.popped[to] = 1
                        continue
                    back, n = self.fail[at], self.popped[at]
                    while b not in self.child[back]:
                        n += self.popped[back]
                        back = self.fail[back]
                    self.fail[to], self.popped[to] = self.child[back][b], n
            level = below

    def count(self, word: bytes) -> int:
        child, fail, popped = self.child, self.fail, self.popped
        at = n = 0
        for b in word:
            while (to := child[at].get(b)) is None:
                n += popped[at]
                at = fail[at]
            at = to
        while at:
            n += popped[at]
            at = fail[at]
        return n


class _Known(dict):
    def __init__(self, counter: PieceCounter) -> None:
        self.counter = counter

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self[word] = self.counter.count(word)
        return n


def byte_of_symbol() -> dict[str, int]:
    """The published byte-level alphabet: printable bytes stand for themselves, the others for code points from 256."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> list[bytes]:
    """The surface forms, as bytes, of a byte-level vocabulary file of the tokenizers library; word-end marks go."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    back, end = byte_of_symbol(), model.get("end_of_word_suffix") or ""
    forms = {v.removesuffix(end) if end else v for v in model["vocab"]}
    return sorted(bytes(map(back.__getitem__, v)) for v in forms if v and all(c in back for c in v))


def token_counts(docs: DataFrame, pieces: list[bytes]) -> DataFrame:
    """Per document: doc_id, n_bytes, n_words, n_tokens (pieces of its whole text, lower-cased A-Z).

    Words are runs of bytes other than ASCII white space; each is matched greedily from its start. Bytes outside the
    vocabulary are pieces of their own, so nothing is unknown. Null and empty texts have no tokens; repeated rows count
    each; other columns are left behind. ``pieces`` goes to the executors: a vocabulary, not data.
    """
    held = docs.sparkSession.sparkContext.broadcast(pieces)
    key = hash(tuple(pieces))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered((_Known, key), lambda: _Known(PieceCounter(held.value)))
        for batch in batches:
            n_words, n_tokens, size = [], [], []
            for t in batch.column("text").to_pylist():
                words = t.lower().split()
                n_words.append(len(words))
                n_tokens.append(sum(map(known.__getitem__, words)))
                size.append(len(t))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, n_words, n_tokens))], ["doc_id", "n_bytes", "n_words", "n_tokens"])

    return texts(docs).mapInArrow(count, "doc_id long, n_bytes long, n_words long, n_tokens long")
