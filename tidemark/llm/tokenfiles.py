"""Token ids as compressed binary files: canonical length-limited Huffman codes from the corpus's own counts.

One code serves all files. Its lengths come from global counts (a row for each id of the vocabulary at most goes to the driver)
by package-merge, so no code is longer than the limit and one table of ``2 ** limit`` entries decodes it. Documents are dealt by
ranges of doc_id, so files in the order of their numbers hold the corpus in ascending order. A file is a header, blocks and an
end; each part closes with a line feed, as Spark's text writer leaves it, and says its own length, so the bytes between may be any:

    header  "TMH1", file number u32, limit u8, ids in the vocabulary u32, size u32, zlib of a code length (u8) for each id
    block   "TMB1", size u32, documents u32, tokens u32, stride u32, goes on u8, then
            doc_id i64 and null u8 and tokens u32 of each document, bit offset u32 of each ``stride``-th token, bits, crc32 u32
    end     "TME1", blocks u32, documents u64, tokens u64

Numbers are little-endian; bits fill big-endian 32-bit words from the top. A block decodes without any other: its checkpoints are
lanes that walk the table side by side, and each lane must end where the next begins. "goes on": the last document continues in
the next block; a document never leaves its file.
"""

from __future__ import annotations

import gc
import itertools
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import release, remembered, shared_dir, texts, written

#: Longest code in bits (more where a vocabulary needs them), tokens of a block, tokens from checkpoint to checkpoint, tokens of a file (about).
LIMIT, BLOCK, STRIDE, FILE = 16, 65_536, 64, 4_000_000
#: Chunks whose ids a worker remembers at once, the longest (in bytes) that it remembers, and texts that are encoded together.
REMEMBERED, LONGEST, TEXTS = 1_200_000, 64, 4096
_HEADER, _BLOCK, _END = struct.Struct("<4sIBII"), struct.Struct("<4sIIIIB"), struct.Struct("<4sIQQ")
#: Characters that are or may be taken for white space beyond ASCII's.
_ODD = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """The lengths, 1 to ``limit`` (0: no code), of an optimal prefix code for ``counts`` by package-merge; ids of count 0 get none."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits")
    order = used[np.lexsort((used, counts[used]))]
    weights = counts[order].astype(np.int64)
    leaves, items = [], np.empty(0, dtype=np.int64)
    for _ in range(limit):
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        at = np.argsort(both, kind="stable")
        leaves.append(at < len(weights))
        items = both[at]
    take = 2 * len(order) - 2
    for leaf in reversed(leaves):
        n = int(leaf[:take].sum())
        out[order[:n]] += 1
        take = 2 * (take - n)
    return out


class Code:
    """A canonical code of given lengths: codes by id, and the decoding table of ``2 ** limit`` entries."""

    def __init__(self, lengths: np.ndarray, limit: int) -> None:
        self.limit, self.lengths = limit, lengths.astype(np.int64)
        ids = np.flatnonzero(lengths)
        ids = ids[np.lexsort((ids, lengths[ids]))]  # shorter codes first, then by id
        sizes = np.left_shift(1, limit - self.lengths[ids])
        firsts = np.cumsum(sizes) - sizes
        self.codes = np.zeros(len(lengths), dtype=np.uint64)
        self.codes[ids] = firsts >> (limit - self.lengths[ids])
        self.ids, self.steps = np.zeros(1 << limit, dtype=np.uint32), np.ones(1 << limit, dtype=np.int64)
        self.ids[: sizes.sum()] = np.repeat(ids, sizes)
        self.steps[: sizes.sum()] = np.repeat(self.lengths[ids], sizes)

    def encode(self, ids: np.ndarray, stride: int) -> tuple[np.ndarray, bytes]:
        """Bit offsets of each ``stride``-th id, and the bits."""
        n = self.lengths[ids]
        if not len(n):
            return np.empty(0, "<u4"), b""
        if not n.all():
            raise ValueError("an id without a code")
        at = np.cumsum(n) - n
        word = at >> 5
        # codes fill different bits, so the sum of those that begin in a word is the word and what reaches into the next; each word has one that begins there
        both = np.add.reduceat(self.codes[ids] << (64 - n - (at & 31)).astype(np.uint64), np.flatnonzero(np.diff(word, prepend=-1)))
        bits = np.append(both >> np.uint64(32), np.uint64(0))
        bits[1:] |= both & np.uint64(0xFFFFFFFF)
        return at[::stride].astype("<u4"), bits[: (at[-1] + n[-1] + 31) // 32].astype(">u4").tobytes()

    def decode(self, n: int, stride: int, checkpoints: np.ndarray, bits: bytes) -> np.ndarray:
        """The ``n`` ids: all lanes step through the table together."""
        words = np.frombuffer(bits, ">u4").astype(np.uint64)
        words = np.concatenate([words, np.zeros(stride * self.limit // 32 + 2, dtype=np.uint64)])
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        at, out = checkpoints.astype(np.int64), np.empty((len(checkpoints), stride), dtype=np.uint32)
        mask = np.uint64((1 << self.limit) - 1)
        for i in range(stride):
            entry = (pairs[at >> 5] >> (64 - self.limit - (at & 31)).astype(np.uint64)) & mask
            out[:, i] = self.ids[entry]
            at += self.steps[entry]
        if (at[:-1] != checkpoints[1:]).any():
            raise ValueError("a lane doesn't end where the next begins")
        return out.reshape(-1)[:n]


class _Encoder:
    """Ids of texts as little-endian numbers of ``width`` bytes.

    Where the tokenizer is byte-level BPE under its library's fixed pattern, no match of the pattern holds white space after anything else, and what white
    space matches depends on the next character at most. So each run of white space with the run after it has its ids to itself; a batch's distinct
    ones are looked up and, where new, encoded and remembered. Texts with white space beyond ASCII's, and all texts of other tokenizers, are encoded whole.
    """

    def __init__(self, tokenizer_json: bytes, width: int) -> None:
        from tokenizers import Tokenizer

        parts = json.loads(tokenizer_json)
        before = parts.get("pre_tokenizer") or {}
        self.by_chunk = parts.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.tokenizer, self.kind, self.known = Tokenizer.from_buffer(tokenizer_json), np.dtype(f"<u{width}"), {}
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def _learned(self, new: list[bytes]) -> dict[bytes, bytes]:
        """The ids of new chunks. A space and letters are one match whatever stands around: the library's model takes them directly. All else goes through all its steps."""
        words = [x for x in new if _WORD.match(x)] if self.by_chunk else []
        rest = [*{*new}.difference(words)] if words else new
        of, space = self.tokenizer.model.tokenize, _BYTES[32]
        ids = [[t.id for t in of((x.decode() if x.isascii() else x.decode("latin-1").translate(_BYTES)).replace(" ", space))] for x in words]
        ids += [e.ids for e in self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in rest], add_special_tokens=False)]
        flat = np.fromiter(itertools.chain.from_iterable(ids), self.kind).tobytes()
        ends = [0, *itertools.accumulate(self.kind.itemsize * n for n in map(len, ids))]
        return dict(zip(words + rest, [flat[a:b] for a, b in itertools.pairwise(ends)], strict=True))

    def of(self, distinct: list[bytes]) -> list[bytes]:
        known = self.known
        found = [*map(known.get, distinct)]
        if new := [x for x, v in zip(distinct, found, strict=True) if v is None]:
            now = self._learned(new)
            if len(known) + len(now) > REMEMBERED:
                known.clear()
            found = [now[x] if v is None else v for x, v in zip(distinct, found, strict=True)]
            known.update(now if max(map(len, now)) <= LONGEST else {x: v for x, v in now.items() if len(x) <= LONGEST})
        return found

    def ids(self, texts: pa.BinaryArray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, ``end`` after each, and how many each text has."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets -= offsets[0]
        starts = np.zeros(len(data) + 1, dtype=bool)
        if self.by_chunk:
            space = (data == 32) | ((data >= 9) & (data <= 13))
            starts[1:-1] = space[1:] & ~space[:-1]
            # a full stop or comma between a letter and white space, or the end, is a match of its own
            letter, last = ((data | 32) >= 97) & ((data | 32) <= 122), np.append(space[1:], True)
            last[offsets[1:][np.diff(offsets) > 0] - 1] = True
            starts[1:-1] |= ((data[1:] == 46) | (data[1:] == 44)) & letter[:-1] & last[1:]
            doubtful = ((data >= 0x1C) & (data <= 0x1F)) | (data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)) | (data == 0xEF)
            for i in np.unique(np.searchsorted(offsets, np.flatnonzero(doubtful), side="right") - 1):
                if _ODD.search(texts[int(i)].as_py().decode("utf-8", "replace")):
                    starts[offsets[i] : offsets[i + 1]] = False
        starts[offsets] = True
        starts[-1] = False
        at = np.flatnonzero(starts)
        chunks = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        distinct = self.of(_slices(chunks.dictionary))
        # the end stands as one more chunk behind each text's
        order = np.insert(chunks.indices.to_numpy(), np.searchsorted(at, offsets[1:]), len(distinct))
        pool = np.frombuffer(b"".join([*distinct, end.to_bytes(self.kind.itemsize, "little")]), self.kind)
        sizes = np.array([*map(len, distinct), self.kind.itemsize], dtype=np.int64) // self.kind.itemsize
        firsts, each = np.cumsum(sizes) - sizes, sizes[order]
        ends = np.cumsum(each)
        ids = pool[np.repeat(firsts[order] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.diff(ends[np.flatnonzero(order == len(distinct))], prepend=0)


def _slices(values: pa.BinaryArray) -> list[bytes]:
    raw, ends = (values.buffers()[2] or pa.py_buffer(b"")).to_pybytes(), np.frombuffer(values.buffers()[1], np.int32)[: len(values) + 1].tolist()
    return [raw[a:b] for a, b in itertools.pairwise(ends)]


#: A space at most, then letters of which no Unicode version doubts that they are: A-Z, and U+00C0 to U+023F without the two signs.
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]){1,30}\Z")
#: Byte-level BPE's letters for bytes (a fixed rule): visible ones stand for themselves, the others for U+0100 on, in order.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}


def token_rows(docs: DataFrame, tokenizer_json: bytes, end_id: int) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian, 2 bytes each, 4 if the vocabulary needs them) of each document, the end with them.

    Texts are whole; null counts as empty, which is the end alone; a text's own "<|...|>" is ordinary text.
    """
    width, held, end = width_of(tokenizer_json, end_id), docs.sparkSession.sparkContext.broadcast(tokenizer_json), int(end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is what Spark has given it
        encoder = remembered((_Encoder, zlib.crc32(held.value), width), lambda: _Encoder(held.value, width))
        for whole in batches:
            for i in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(i, TEXTS)
                gc.disable()  # a million remembered words have no cycles to look for
                try:
                    ids, n = encoder.ids(batch.column("text"), end)
                finally:
                    gc.enable()
                offsets = (np.cumsum(np.append(0, n)) * width).astype(np.int32)
                values = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), values], ["doc_id", "n_tokens", "ids"])

    return texts(docs).mapInArrow(encode, "doc_id long, n_tokens long, ids binary")


def _vocabulary(tokenizer_json: bytes, end_id: int) -> int:
    from tokenizers import Tokenizer

    return max(end_id, max(Tokenizer.from_buffer(tokenizer_json).get_vocab(with_added_tokens=True).values(), default=0)) + 1


def width_of(tokenizer_json: bytes, end_id: int) -> int:
    return 2 if _vocabulary(tokenizer_json, end_id) <= 1 << 16 else 4


def id_counts(rows: DataFrame, width: int, size: int) -> np.ndarray:
    """How often each id stands in ``ids`` of all rows; tasks count first, and a row for each id comes to the driver (``size`` at most)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, dtype=np.int64)
        for batch in batches:
            n += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), f"<u{width}"), minlength=size)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["id", "n"])

    out = np.zeros(size, dtype=np.int64)
    for r in rows.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def _block(code: Code, docs: list[tuple[int | None, np.ndarray]], goes_on: bool) -> bytes:
    ids = np.concatenate([x for _, x in docs]) if docs else np.empty(0, dtype=np.uint32)
    checkpoints, bits = code.encode(ids, STRIDE)
    body = b"".join([
        np.array([d or 0 for d, _ in docs], "<i8").tobytes(), bytes(d is None for d, _ in docs), np.array([len(x) for _, x in docs], "<u4").tobytes(), checkpoints.tobytes(), bits,
    ])
    return _BLOCK.pack(b"TMB1", len(body), len(docs), len(ids), STRIDE, goes_on) + body + struct.pack("<I", zlib.crc32(body))


def write_tokens(docs: DataFrame, tokenizer_json: bytes, end_id: int, path: str, limit: int = LIMIT) -> None:
    """``docs`` as token files under ``path``, in ascending order of doc_id; null ids come first, and rows of one id stand in an order that their texts decide.

    An empty table leaves no files. Other columns are left behind. The writer's commit makes all files appear, or none.
    """
    width, size = width_of(tokenizer_json, end_id), _vocabulary(tokenizer_json, end_id)
    rows = written(token_rows(docs, tokenizer_json, end_id), "tokens", "zstd")
    counts = id_counts(rows, width, size)
    limit = max(limit, int(np.count_nonzero(counts) - 1).bit_length())
    lengths = code_lengths(counts, limit)
    files = max(1, -(-int(counts.sum()) // FILE))
    held = docs.sparkSession.sparkContext.broadcast((lengths, limit))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _parts(((d.as_py(), x.as_buffer()) for b in batches for d, x in zip(b.column("doc_id"), b.column("ids"), strict=True)), *held.value, width)
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.binary())], ["part"])

    # equal rows are told apart by their places in the table that was written, so no value, however common, is one task's
    dealt = rows.select("doc_id", "ids", F.xxhash64("ids").alias("_h"), F.col("_metadata.file_name").alias("_f"), F.col("_metadata.row_index").alias("_r"))
    order = ["doc_id", "_h", "_f", "_r"]
    dealt = dealt.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    dealt.mapInArrow(encode, "part binary").select(F.col("part").cast("string").alias("value")).write.option("compression", "none").text(path)
    release(rows)


def _parts(rows: Iterator[tuple[int | None, pa.Buffer]], lengths: np.ndarray, limit: int, width: int) -> Iterator[bytes]:
    """The parts of a file, in order; nothing for no rows. At most a block is held, beside one document."""
    code, waiting, held, totals = Code(lengths, limit), [], 0, [0, 0, 0]
    for doc_id, buffer in rows:
        if not totals[1]:
            packed = zlib.compress(lengths.tobytes(), 9)
            yield _HEADER.pack(b"TMH1", TaskContext.get().partitionId() if TaskContext.get() else 0, limit, len(lengths), len(packed)) + packed
        ids, at = np.frombuffer(buffer, f"<u{width}"), 0
        totals[1], totals[2] = totals[1] + 1, totals[2] + len(ids)
        while held + len(ids) - at >= BLOCK:
            cut = at + BLOCK - held
            waiting.append((doc_id, ids[at:cut]))
            totals[0] += 1
            yield _block(code, waiting, cut < len(ids))
            waiting, held, at = [], 0, cut
            if cut == len(ids):
                break
        if at < len(ids):
            waiting.append((doc_id, ids[at:]))
            held += len(ids) - at
    if waiting:
        totals[0] += 1
        yield _block(code, waiting, False)
    if totals[1]:
        yield _END.pack(b"TME1", *totals)


def documents_of(content: bytes) -> Iterator[tuple[int, int | None, int, np.ndarray]]:
    """(file number, doc_id, ids before it in the file, ids) of each document of a file's bytes; a damaged file fails."""
    magic, number, limit, size, packed = _HEADER.unpack_from(content)
    if magic != b"TMH1":
        raise ValueError("not a token file")
    at = _HEADER.size + packed
    code = Code(np.frombuffer(zlib.decompress(content[_HEADER.size : at]), np.uint8), limit)
    begun, start, seen, open_doc = [], 0, [0, 0, 0], False
    while content[at + 1 : at + 5] == b"TMB1":
        _, size, n_docs, n_ids, stride, goes_on = _BLOCK.unpack_from(content, at + 1)
        at += 1 + _BLOCK.size
        body = memoryview(content)[at : at + size]
        if at + size + 4 > len(content) or zlib.crc32(body) != struct.unpack_from("<I", content, at + size)[0]:
            raise ValueError("a damaged block")
        at += size + 4
        doc_ids, nulls, counts = np.frombuffer(body, "<i8", n_docs), np.frombuffer(body, np.uint8, n_docs, 8 * n_docs), np.frombuffer(body, "<u4", n_docs, 9 * n_docs)
        lanes = -(-n_ids // stride)
        checkpoints = np.frombuffer(body, "<u4", lanes, 13 * n_docs)
        ids = code.decode(n_ids, stride, checkpoints, bytes(body[13 * n_docs + 4 * lanes :]))
        ends = np.cumsum(counts)
        for i in range(n_docs):
            begun.append(ids[ends[i] - counts[i] : ends[i]])
            seen[1] += not (i == 0 and open_doc)
            if i + 1 < n_docs or not goes_on:
                whole = begun[0] if len(begun) == 1 else np.concatenate(begun)
                yield number, None if nulls[i] else int(doc_ids[i]), start, whole
                start, begun = start + len(whole), []
        seen[0], seen[2], open_doc = seen[0] + 1, seen[2] + n_ids, bool(goes_on)
    if content[at + 1 : at + 5] != b"TME1" or _END.unpack_from(content, at + 1)[1:] != tuple(seen) or at + 1 + _END.size + 1 != len(content):
        raise ValueError("a file without its end")


def _decoded(spark: SparkSession, path: str, schema: str, row: Callable[[int, int | None, int, np.ndarray], tuple], kinds: list[pa.DataType]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                some = []
                for d in documents_of(content.as_py()):
                    some.append(row(*d))
                    if len(some) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names)
                        some = []
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names)

    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").load(path)
    return files.where("length > 0").select("content").mapInArrow(decode, schema)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """file, doc_id, file_start (ids before the document in its file) and ids of each document of the files under ``path``."""
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    return _decoded(spark, path, "file int, doc_id long, file_start long, ids array<int>", lambda f, d, s, x: (f, d, s, x.astype(np.int32)), kinds)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from the files under ``path``."""
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    rows = _decoded(spark, path, "file int, doc_id long, file_start long, n_tokens long, ids_crc32 long", lambda f, d, s, x: (f, d, s, len(x), zlib.crc32(x.astype("<u4").tobytes())), kinds)
    rows = written(rows, "digests")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("_n")).withColumn("_some", F.floor(F.col("file") / 1024))
    some = files.groupBy("_some").agg(F.sum("_n").alias("_m"))  # a row for each 1,024 files
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    some = some.select("_some", F.coalesce(F.sum("_m").over(before(Window.orderBy("_some"))), F.lit(0)).alias("_first"))
    inside = F.coalesce(F.sum("_n").over(before(Window.partitionBy("_some").orderBy("file"))), F.lit(0))
    starts = files.withColumn("_inside", inside).join(some, "_some").select("file", (F.col("_first") + F.col("_inside")).alias("_start"))
    return rows.join(starts, "file").select("doc_id", (F.col("_start") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_json: bytes, end_id: int) -> DataFrame:
    """Writes ``docs`` as token files into the shared folder and gives ``token_digests`` of what is read back. An empty table gives no rows."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer_json, end_id, path)
    return token_digests(spark, path)
