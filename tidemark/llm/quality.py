"""Quality rules whose cutoffs are chosen under a bound on false rejections.

A rule rejects a document when a ratio lies above its cutoff. In each stratum (language), half of the labelled documents tune and
the other half, the holdout, decides; a hash of the id says which half. Tuning picks for each rule the cutoff of its grid with the most
bad documents rejected, each good one counting against ``GOOD_WEIGHT`` bad ones (ties go to the loosest), and orders the rules by that
gain. The holdout then tests the first rule, the first two together, and so on: a set of rules passes while the exact (Clopper-Pearson)
upper bound on the share of good documents that any of its rules rejects stays within ``alpha``; the last set that passes is taken. Sets grow,
so that testing in this order up to the first failure costs nothing (fixed-sequence testing), and the confidence is split over the
strata (Bonferroni): with probability 1 - ``delta``, in no stratum do the rules together reject more than ``alpha`` of the good
documents. A stratum without enough labels to prove anything gets no rule.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, forget, release, texts, unused, written
from tidemark.llm.links import BROADCAST_IDS

SYMBOLS = b"#*$%&|<>"
GOOD_WEIGHT = 10
#: Rules: a ratio and its grid, loosest first.
RULES: dict[str, tuple[float, ...]] = {
    "symbols_a_word": (2.0, 1.0, 0.5, 0.3, 0.2, 0.1, 0.05),
    "duplicate_lines": (0.9, 0.7, 0.5, 0.4, 0.3),
    "repeated_words": (0.9, 0.7, 0.5, 0.3, 0.2, 0.15),
    "upper_words": (0.9, 0.7, 0.5, 0.3),
    "repeats_of_a_word": (200.0, 100.0, 50.0, 20.0, 10.0, 5.0),
}
_NOT_COUNTED = bytes(range(0x80, 0xC0)) + SPACE  # neither starts a code point of a word


def measure(text: bytes) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper_words, n_distinct_words of a whole text."""
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    windows = [*zip(words, words[1:], words[2:], words[3:], words[4:], strict=False)]
    repeated = 0
    if len({*windows}) < len(windows):
        seen, covered = Counter(windows), 0  # covered: the first word that no window has counted yet
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 5 - max(covered, i)
                covered = i + 5
    return (
        n,
        len(text.translate(None, _NOT_COUNTED)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len({*lines}),
        repeated,
        len(lines),
        sum(w.isupper() and len(w) > 1 for w in words),
        len({*words}),
    )


METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_distinct_words"]
_SCHEMA = ", ".join(f"{m} long" for m in METRICS)


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        rows = [measure(t) for t in batch.column("text").to_pylist()]
        columns = [*zip(*rows, strict=True)] or [()] * len(METRICS)
        others = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *(pa.array(c, pa.int64()) for c in columns)], [*others, *METRICS])


def ratios() -> dict[str, Column]:
    """The rules' ratios; 0 where a text has no word or line."""
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return {
        "symbols_a_word": part("n_symbols", "n_words"),
        "duplicate_lines": part("n_dup_lines", "n_lines"),
        "repeated_words": part("n_repeat_words", "n_words"),
        "upper_words": part("n_upper_words", "n_words"),
        "repeats_of_a_word": part("n_words", "n_distinct_words"),
    }


def upper_bound(k: int, n: int, delta: float) -> float:
    """The exact upper confidence bound, at 1 - delta, on a rate of which k in n were seen."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]

    def at_most_k(p: float) -> float:
        return sum(math.exp(c + i * math.log(p) + (n - i) * math.log1p(-p)) for i, c in enumerate(logs))

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if at_most_k(mid) > delta else (low, mid)
    return high


def choose(grid: tuple[float, ...], good: list[int], bad: list[int]) -> tuple[int, float | None]:
    """The gain and the cutoff for a rule in a stratum. good, bad: how many tuning documents each cutoff of the grid rejects."""
    best, cutoff = 0, None
    for c, k, b in zip(grid, good, bad, strict=True):
        if b - GOOD_WEIGHT * k > best:
            best, cutoff = b - GOOD_WEIGHT * k, c
    return best, cutoff


def proven(rejected: list[int], n_good: int, alpha: float, delta: float) -> int:
    """How many rules, in order, the holdout proves. rejected: good documents whose first rejecting rule is the k-th, for each k."""
    k = total = 0
    for k, n in enumerate(rejected):
        total += n
        if total > alpha * n_good or upper_bound(total, n_good, delta) > alpha:
            return k
    return k + 1 if rejected else 0


def tunes() -> Column:
    """Whether a labelled document tunes; else it is in the holdout."""
    return F.pmod(F.xxhash64("doc_id", F.lit("tunes")), F.lit(2)) == 0


_CUTS = [f"cut_{r}" for r in RULES]
_TABLE = "stratum string, " + ", ".join(f"{c} double" for c in _CUTS) + ", rank array<int>"


def _tuned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each stratum's counts, the rules' cutoffs and the numbers of the chosen rules in order."""
    for batch in batches:
        strata, cuts, ranks = [], [], []
        for s in batch.to_pylist():
            found = [choose(grid, *([s[f"{r}_{i}_{g}"] for i in range(len(grid))] for g in (1, 0))) for r, grid in RULES.items()]
            strata.append(s["stratum"])
            cuts.append([c for _, c in found])
            ranks.append(sorted((k for k, (_, c) in enumerate(found) if c is not None), key=lambda k: (-found[k][0], k)))
        columns = [pa.array([c[k] for c in cuts], pa.float64()) for k in range(len(_CUTS))]
        yield pa.RecordBatch.from_arrays([pa.array(strata, pa.string()), *columns, pa.array(ranks, pa.list_(pa.int32()))], ["stratum", *_CUTS, "rank"])


def _proving(alpha: float, delta: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for s in rows:
                k = proven([s[f"first_{k}"] for k in range(len(s["rank"]))], s["n_good"], alpha, delta)
                for r in s["rank"][k:]:
                    s[_CUTS[r]] = None
            columns = [pa.array([s[c] for s in rows], pa.float64()) for c in _CUTS]
            yield pa.RecordBatch.from_arrays([pa.array([s["stratum"] for s in rows], pa.string()), *columns, pa.array([s["rank"] for s in rows], pa.list_(pa.int32()))], ["stratum", *_CUTS, "rank"])

    return run


def _with_cuts(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` with the cutoffs of their strata (null: none). A long list of strata isn't broadcast."""
    table = table.withColumnRenamed("stratum", "_stratum")
    return rows.join(F.broadcast(table) if table.count() <= BROADCAST_IDS else table, F.col("stratum") == F.col("_stratum"), "left").drop("_stratum")


def _hits() -> list[Column]:
    """For each rule, whether it rejects."""
    ratio = ratios()
    return [F.coalesce(ratio[r] > F.col(c), F.lit(False)) for r, c in zip(RULES, _CUTS, strict=True)]


def cutoffs(metrics: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """A row for each stratum with labels: stratum, the rules' cutoffs (null: none), rank. ``metrics``: doc_id, stratum and METRICS.

    Labels: doc_id, quality (1 good, 0 bad; others and nulls are left out). Repeated labels of a document count once, and
    contradicting ones not at all. Written.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("_low"), F.max("quality").alias("_good")).where("_low = _good")
    rows = written(metrics.where(F.col("doc_id").isNotNull()).join(marked, "doc_id").select("stratum", *METRICS, F.col("_good").alias("good"), tunes().alias("tunes")), "labelled")
    ratio = ratios()
    counts = [F.sum(((F.col("good") == g) & (ratio[r] > c)).cast("long")).alias(f"{r}_{i}_{g}") for r, grid in RULES.items() for i, c in enumerate(grid) for g in (0, 1)]
    tuned = written(rows.where("tunes").groupBy("stratum").agg(*counts).mapInArrow(_tuned, _TABLE), "tuned")
    strata = max(1, rows.select("stratum").distinct().count())
    hit = F.array(*_hits())
    first = F.array_position(F.transform("rank", lambda k: F.get(hit, k)), True) - 1
    seen = _with_cuts(rows.where("not tunes and good = 1"), tuned).withColumn("first", first)
    n = seen.groupBy(F.col("stratum").alias("_s")).agg(F.count(F.lit(1)).alias("n_good"), *[F.sum((F.coalesce("first", F.lit(-1)) == k).cast("long")).alias(f"first_{k}") for k in range(len(RULES))])
    held = tuned.join(n, F.col("stratum") == F.col("_s"))  # a stratum without a holdout has nothing to prove by
    out = written(held.mapInArrow(_proving(alpha, delta / strata), _TABLE), "cutoffs")
    release(rows, tuned)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _judged(rows: DataFrame, table: DataFrame) -> DataFrame:
    hits = _with_cuts(rows, table).withColumn("base_failed", base_failed())
    return hits.withColumn("kept", ~F.col("base_failed") & ~reduce(Column.__or__, _hits())).drop(*_CUTS, "rank")


def quality(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Per document: doc_id, METRICS, base_failed, stratum, kept.

    Null and empty texts have no words, and so fail the base rules; a null language is the stratum ''; repeated rows are
    judged each; other columns are left behind; without labels only the base rules reject.
    """
    rows = texts(docs, F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"))
    rows = written(rows.mapInArrow(measured, f"doc_id long, stratum string, {_SCHEMA}"), "quality")
    return _judged(rows, cutoffs(rows, labels, alpha, delta))


def passing(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``quality`` keeps, each judged by its own text and language.

    Texts are measured once; of the rows that go, id, text's hash and stratum are taken out of ``docs``, by broadcast while they are few.
    """
    stratum = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = texts(docs, stratum.alias("stratum"), text.alias("fp"))
    rows = written(rows.mapInArrow(measured, f"doc_id long, stratum string, fp long, {_SCHEMA}"), "quality")
    names = [unused(c, docs) for c in ("_gone", "_fp", "_stratum")]
    gone = _judged(rows, cutoffs(rows, labels, alpha, delta)).where(~F.col("kept")).select("doc_id", "fp", "stratum").distinct().toDF(*names)
    gone = written(gone, "rejected")
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(names[0])) & (text == F.col(names[1])) & (stratum == F.col(names[2]))
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, on, "left_anti")
