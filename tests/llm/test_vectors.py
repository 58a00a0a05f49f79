"""Whitening, hard negatives and token files against brute-force versions, and their edge cases."""

import heapq
import itertools
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hardneg, tokenfiles, whitening
from tidemark.llm.queries import tokenizer_path

VECTORS = "vec_id long, embedding array<float>, label int, n long, component string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], label, 1, "x") for i, v, label in rows], VECTORS)


def cloud(n, d, seed=1, common=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) * np.linspace(3, 0.5, d)
    x[:common] = x[0]
    return x.astype(np.float32)


ODD = [(9001, None, 1), (9002, [None] * 12, 1), (9003, [float("nan")] * 12, 2), (9004, [1.0] * 11 + [float("inf")], 2), (9005, [], 3), (9006, [1.0, 2.0], 3)]


@pytest.mark.parametrize(("n", "d", "k"), [(400, 12, 32), (900, 80, 32), (300, 64, 8)])
def test_whitening_is_the_dense_one(spark, n, d, k):
    x = cloud(n, d, common=n // 3)
    rows = [(i, v, 0) for i, v in enumerate(x.tolist())]
    got = whitening.whiten(vectors_of(spark, [*rows, rows[5], *ODD, (None, x[7].tolist(), 0)]), k).toPandas()
    ids = np.array([*range(n), 5, -1])
    w = np.floor(64 * np.concatenate([x, x[[5, 7]]]).astype(float))
    z = w - w.mean(axis=0)
    values, vectors = np.linalg.eigh(z.T @ z / len(z))
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    assert len(got) == len(z) * min(k, d) and (got["n"] == len(z)).all() and got["identity_error"].max() < 1e-9
    exact = {int(i): sum((len(w) * int(a) - int(s)) ** 2 for a, s in zip(r, w.sum(axis=0), strict=True)) for i, r in zip(ids, w, strict=True)}
    expected = z @ vectors / np.sqrt(values)
    for c, part in got.assign(vec_id=got["vec_id"].fillna(-1).astype(int)).groupby("component"):
        part = part.drop_duplicates("vec_id").set_index("vec_id").loc[ids]
        assert part["deviation"].tolist() == [exact[int(i)] for i in ids]
        sign = np.sign((part["whitened"].to_numpy() * expected[:, c - 1]).sum())
        assert np.allclose(part["whitened"], sign * expected[:, c - 1], atol=1e-7)
        assert np.allclose(part["explained"], values[c - 1] / (z * z).sum() * len(z), rtol=1e-9)


def test_whitening_of_few_dimensions_and_none(spark):
    line = np.outer(np.arange(-20, 21), [1, 2, -1, 0.5]).astype(np.float32)
    got = whitening.whiten(vectors_of(spark, [(i, v, 0) for i, v in enumerate(line.tolist())])).toPandas()
    assert set(got["component"]) == {1} and abs(got["whitened"].var(ddof=0) - 1) < 1e-9
    assert whitening.whiten(vectors_of(spark, [(i, [1.0, 2.0], 0) for i in range(5)])).count() == 0
    assert whitening.whiten(vectors_of(spark, ODD[:5])).count() == 0
    assert whitening.whiten(vectors_of(spark, [])).count() == 0


def test_a_missed_component_is_found_by_the_probe():
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.standard_normal((90, 90)))
    values = np.concatenate([np.full(10, 9.0), np.linspace(4, 3.9, 40), np.full(40, 1.0)])  # ties and a flat middle
    v = (q * values) @ q.T
    got, vectors = whitening.leading(lambda x: v @ x, 90, 32)
    assert np.allclose(got, values[:32], rtol=1e-11) and np.linalg.norm(v @ vectors - vectors * got) < 1e-9
    assert np.allclose(vectors.T @ vectors, np.eye(32), atol=1e-12)


def mined(rows, every):
    kept = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and len(v) == 12 and all(c is not None and np.isfinite(c) for c in v):
            one = (label, [int(np.floor(256 * float(np.float32(c)))) for c in v])
            kept[i] = min(kept.get(i, one), one)
    out = []
    for a, (label, x) in kept.items():
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), i, other) for i, (other, y) in kept.items() if i != a)
        for s, p, _ in [t for t in scored if t[2] == label][:5]:
            fits = [t for t in scored if t[2] != label and 30 * -s <= 100 * -t[0] <= 90 * -s][:10]
            out += [(a, p, r, i, -s, -t) for r, (t, i, _) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.05, 2.0])
def test_hard_negatives_are_the_brute_force_ones(spark, monkeypatch, spread):
    monkeypatch.setattr(hardneg, "FIRST", 64)
    monkeypatch.setattr(hardneg, "ROWS", 50)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 12))
    x = (centres[rng.integers(12, size=1500)] + spread * rng.standard_normal((1500, 12))).astype(np.float32)
    x[:500] = x[0]  # a third of the rows are one vector
    rows = [(i, v, int(rng.integers(4))) for i, v in enumerate(x.tolist())]
    rows += [(20, x[21].tolist(), 9), (None, x[3].tolist(), 1), (5000, x[4].tolist(), None), rows[30], *ODD]
    got = hardneg.hard_negatives(vectors_of(spark, rows), F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == mined(rows, 20)


def test_hard_negatives_of_little(spark):
    assert hardneg.hard_negatives(vectors_of(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert hardneg.hard_negatives(vectors_of(spark, [(0, [1.0], 1)]), F.col("vec_id") % 20 == 0).count() == 0
    assert hardneg.hard_negatives(vectors_of(spark, [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 2)]), F.col("vec_id") % 20 == 0).count() == 0


def test_cells_come_by_falling_bounds_that_hold():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 6)) * 50
    books = hardneg.codebook(x[:, :3], 5), hardneg.codebook(x[:, 3:], 4)
    of = [hardneg.nearest(h, b) for h, b in zip((x[:, :3], x[:, 3:]), books, strict=True)]
    radii = [np.array([np.linalg.norm(h[o == c] - b[c], axis=1).max(initial=0) for c in range(len(b))]) for h, b, o in zip((x[:, :3], x[:, 3:]), books, of, strict=True)]
    cells = of[0] * len(books[1]) + of[1]
    counts = np.bincount(cells, minlength=20)
    held = hardneg.Index(books, tuple(radii), counts, np.ones(20, int), None)
    for a in x[:20]:
        seen = [*held.cells(a)]
        assert [c for *_, c in seen].__len__() == (counts > 0).sum() == len({c for *_, c in seen})
        assert all(p[0] >= q[0] for p, q in zip(seen, seen[1:], strict=False))
        assert all(low <= s <= up for up, low, c in seen for s in x[cells == c] @ a)


def huffman_bits(counts):
    heap = [(c, 0) for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        a = heapq.heappop(heap)[0] + heapq.heappop(heap)[0]
        total += a
        heapq.heappush(heap, (a, 0))
    return total


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    counts = np.where(rng.random(3000) < 0.3, 0, (1e6 / rng.permutation(np.arange(1, 3001)) ** 1.3).astype(int) + 1)
    lengths = tokenfiles.code_lengths(counts, 32).astype(int)
    assert (lengths * counts).sum() == huffman_bits(counts.tolist())
    limited = tokenfiles.code_lengths(counts, 12).astype(int)
    assert limited.max() <= 12 and sum(2.0**-n for n in limited[limited > 0]) == 1
    few = np.array([1, 1, 2, 3, 5, 8])
    best = tokenfiles.code_lengths(few, 4).astype(int)
    assert best.max() <= 4 and (best * few).sum() == min((few * n).sum() for n in itertools.product(range(1, 5), repeat=6) if sum(2.0**-v for v in n) <= 1)
    assert tokenfiles.code_lengths(np.array([0, 7, 0]), 16).tolist() == [0, 1, 0]
    with pytest.raises(ValueError, match="don't fit"):
        tokenfiles.code_lengths(np.ones(5, int), 2)


@pytest.mark.parametrize("n", [1, 63, 64, 65, 5000])
def test_bits_decode_by_lanes(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, size=n), 999)
    code = tokenfiles.Code(tokenfiles.code_lengths(np.bincount(ids, minlength=1000), 16), 16)
    checkpoints, bits = code.encode(ids, 64)
    assert (code.decode(n, 64, checkpoints, bits) == ids).all()


def test_blocks_files_and_damage(monkeypatch):
    monkeypatch.setattr(tokenfiles, "BLOCK", 100)
    rng = np.random.default_rng(3)
    docs = [(i if i else None, rng.integers(0, 50, size=n).astype("<u2")) for i, n in enumerate([3, 97, 1, 450, 100, 100, 1, 30])]
    lengths = tokenfiles.code_lengths(np.bincount(np.concatenate([x for _, x in docs]), minlength=60), 16)
    content = b"".join(p + b"\n" for p in tokenfiles._parts(iter((d, x.tobytes()) for d, x in docs), lengths, 16, 2))
    got = [*tokenfiles.documents_of(content)]
    assert [d for _, d, _, _ in got] == [d for d, _ in docs] and all((a == x).all() for (*_, a), (_, x) in zip(got, docs, strict=True))
    assert [s for _, _, s, _ in got] == np.cumsum([0, *[len(x) for _, x in docs]])[:-1].tolist()
    for broken in (content[:-40], content[:200] + bytes([content[200] ^ 1]) + content[201:]):
        with pytest.raises((ValueError, zlib.error)):
            [*tokenfiles.documents_of(broken)]


@pytest.fixture(scope="module")
def byte_level():
    return Path(tokenizer_path("byte_bpe_50k.json")).read_bytes()


def test_token_files_give_the_tokenizer_s_ids(spark, byte_level, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenfiles, "FILE", 3000)
    rng = random.Random(8)
    odd = ["  two  spaces ", "\n\n x\t\ty \n", "a\x1c!b", "é ü", "don't we'll x'S 12 3.5", "<|endoftext|> a", " ", "", None, "x" * 3000, "ö z", "a\r\n b", "tab\tend ", "\u0085next", "!? \x1f."]
    texts = odd + ["".join(rng.choice(["word ", "ing", " a", "\n", "  ", "'s", ".", "9", "é", "\t"]) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    rows = [*enumerate(texts), (None, "no id"), (None, None), (7, "again"), *[(3, "much the same")] * 40]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, start int, ids int").repartition(5)
    tokenizer = Tokenizer.from_buffer(byte_level)
    tokenizer.encode_special_tokens = True
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t in rows]
    got = sorted(tokenfiles.token_files(docs, byte_level, 2).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    digests = sorted((-1 if i is None else i, len(x), zlib.crc32(x.tobytes())) for (i, _), x in zip(rows, ids, strict=True))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == digests


def test_token_files_read_back_as_ids(spark, byte_level, tmp_path):
    docs = spark.createDataFrame([(2, "b b"), (1, "a text"), (3, None)], "doc_id long, text string")
    tokenfiles.write_tokens(docs, byte_level, 2, str(tmp_path / "files"))
    rows = sorted(tokenfiles.read_tokens(spark, str(tmp_path / "files")).collect(), key=lambda r: r["doc_id"])
    assert [r["ids"][-1] for r in rows] == [2, 2, 2] and rows[2]["ids"] == [2] and len(rows[0]["ids"]) == 3
    assert tokenfiles.token_files(docs.where("false"), byte_level, 2).count() == 0
