"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols: an insult, a threat, a target, a negation, reported speech, or another word. Five transducers read a
clause's symbols and are composed into one: the first two weigh insults and threats, the others change the weight of what
follows them. A threat is one only after a target. A clause scores what its heaviest match weighs; a document's score joins its clauses' as
independent evidence.

Both words and arcs are learned from labelled documents. Insults are words, or beginnings that several words share, that speak for
themselves; threats are those that do so only behind a target. What an arc behind a target, a negation or reported speech is worth is learned
from the clauses that take it: the share of them in toxic documents, against that of plain matches, smoothed towards PRIOR, which
holds a negated or reported match under the usual limit of 0.3 until the labels show otherwise.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batches_of, texts, written

#: Labelled clean and toxic documents, at most, that words and arcs are learned from (those of the least hashes).
LABELLED = (20_000, 8_000)
#: The chance that any word is in the lexicon by mere chance.
ERROR = 0.05
#: Bytes of word beginnings.
STEMS = (5, 7, 9)
#: A document of no match: less than any match.
NO_MATCH = 0.02
#: What a match is worth behind a target, a negation, reported speech, against a plain one, before any label; and so many matches weigh as much.
PRIOR, PRIOR_MATCHES = {"aimed": 1.05, "negated": 0.25, "reported": 0.25}, 8

# Small function-word classes of the grammar.
TARGETS = "you your yours u he she they them him her his their du dich dir ihr euch sie er tu toi te vous ton ta il elle ils usted tú ti te él ella ustedes".split()
NEGATIONS = "not no never nobody none isn't aren't nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say told tells claimed wrote quoted sagte sagt schrieb dit disait écrit dijo dice escribió".split()

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "ihtnr."
SYMBOLS = INSULT + THREAT + TARGET + NEGATION + REPORT + OTHER


class Transducer:
    """A deterministic weighted transducer: at (state, symbol), or else at (state, None), to a state, a symbol and a factor."""

    def __init__(self, arcs: dict[tuple[int, str | None], tuple[int, str | None, float]]) -> None:
        self.arcs = arcs

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        to, out, factor = self.arcs.get((state, symbol)) or self.arcs.get((state, None)) or (state, None, 1.0)
        return to, symbol if out is None else out, factor

    def then(self, other: Transducer, symbols: str) -> Transducer:
        """The composition: ``other`` reads what this one writes. Only the pairs of states that are reached are built."""
        number, arcs, todo = {(0, 0): 0}, {}, [(0, 0)]
        while todo:
            a, b = todo.pop()
            for s in symbols:
                a2, mid, f = self.step(a, s)
                b2, out, g = other.step(b, mid)
                if (a2, b2) not in number:
                    number[a2, b2] = len(number)
                    todo.append((a2, b2))
                arcs[number[a, b], s] = (number[a2, b2], out, f * g)
        return Transducer(arcs)


def grammar(worth: dict[str, float]) -> Transducer:
    """insult . threat . target . negation . reported speech, by what arcs are worth. Factors apply to insults and threats only."""
    insult = Transducer({(0, INSULT): (0, None, 1.0)})
    threat = Transducer({(0, THREAT): (0, None, 1.0)})
    # Behind a target a match is heavier; a threat without one is mere narration.
    target = Transducer({(0, TARGET): (1, None, 1.0), (0, THREAT): (0, OTHER, 1.0), **{(1, s): (1, None, worth["aimed"]) for s in INSULT + THREAT}})
    # A negation reaches over the next two words.
    negation = Transducer({**{(k, NEGATION): (2, None, 1.0) for k in (0, 1, 2)}, **{(k, s): (k - 1, None, worth["negated"] if s in INSULT + THREAT else 1.0) for k in (1, 2) for s in SYMBOLS if s != NEGATION}})
    report = Transducer({(0, REPORT): (1, None, 1.0), **{(1, s): (1, None, worth["reported"]) for s in INSULT + THREAT}})
    out = insult
    for t in (threat, target, negation, report):
        out = out.then(t, SYMBOLS)
    return out


_ENDS = frozenset(b".!?;:\n")
_CLAUSES = bytes(10 if b in _ENDS else b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() or b == 39 else 32 for b in range(256))
_CLASS = {w.encode(): c for c, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}
_TARGETS = frozenset(w.encode() for w in TARGETS)
#: Factors that tell, as a sum, which arcs a match took.
_TRACE = {"aimed": 2.0, "negated": 3.0, "reported": 5.0}


def forms(word: bytes) -> list[bytes]:
    """A word, and its beginnings with a star."""
    return [word, *(word[:n] + b"*" for n in STEMS if len(word) >= n)]


class Model:
    """What is learned: insults and threats (words, or beginnings with a star) with their weights, 0 to 1, and what arcs are worth."""

    def __init__(self, insults: dict[bytes, float] | None = None, threats: dict[bytes, float] | None = None, worth: dict[str, float] | None = None) -> None:
        self.insults, self.threats, self.worth = insults or {}, threats or {}, PRIOR | (worth or {})


class Scorer:
    """Scores texts by the grammar over a model's words."""

    def __init__(self, model: Model) -> None:
        self.model, self.machine = model, grammar(model.worth)
        self.known: dict[bytes, tuple[str, float]] = {}

    def symbol(self, word: bytes) -> tuple[str, float]:
        """A word's symbol and weight; remembered, as texts repeat words."""
        if (found := self.known.get(word)) is None:
            own = forms(word) if word not in _CLASS else []
            best = {s: max((held[f] for f in own if f in held), default=0.0) for s, held in ((INSULT, self.model.insults), (THREAT, self.model.threats))}
            found = next(((s, x) for s, x in best.items() if x), (_CLASS.get(word, OTHER), 0.0))
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = found
        return found

    def clauses(self, text: bytes) -> Iterator[tuple[bytes, float]]:
        """The clauses that match, with their scores."""
        plain = text.translate(_CLAUSES)
        if not any(self.symbol(w)[1] for w in {*plain.split()}):
            return
        for clause in plain.split(b"\n"):
            if best := max((x for _, x in self.matches(clause)), default=0.0):
                yield clause, min(best, 1.0)

    def matches(self, clause: bytes) -> Iterator[tuple[str, float]]:
        """The symbol and the weight of each match of a clause."""
        state, step = 0, self.machine.step
        for word in clause.split():
            symbol, own = self.symbol(word)
            state, out, factor = step(state, symbol)
            if own and out in (INSULT, THREAT):
                yield out, own * factor

    def score(self, text: bytes) -> tuple[float, int]:
        """A text's score, and how many of its clauses match."""
        clean, n = 1 - NO_MATCH, 0
        for _, p in self.clauses(text):
            clean *= 1 - min(p, 0.999)
            n += 1
        return 1 - clean, n


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model, from at most LABELLED documents, none of them held out; contradicting labels of a document count for nothing."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("toxic").alias("_low"), F.max("toxic").alias("_toxic")).where("_low = _toxic")
    some = [marked.where(F.col("_toxic") == c).orderBy(F.xxhash64("_id"), "_id").limit(LABELLED[c]).select("_id", "_toxic") for c in (0, 1)]
    chosen = F.broadcast(written(some[0].unionByName(some[1]), "labelled"))  # at most the sum of LABELLED
    n = {r["_toxic"]: r["n"] for r in chosen.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1):
        return Model()
    rows = written(texts(docs).join(chosen, F.col("doc_id") == F.col("_id")).select("text", "_toxic"), "labelled")
    insults, threats = lexicon(rows, n[1] / (n[1] + n.get(0, 0) + 1))
    return Model(insults, threats, arcs(rows, Model(insults, threats)))


def lexicon(rows: DataFrame, share: float) -> tuple[dict[bytes, float], dict[bytes, float]]:
    """Insults and threats with their weights, from text and _toxic.

    A form's support is in how many surroundings (the words beside its use, one a document) toxic documents have it: copies of a
    document add nothing. It must be too high for chance, by the tail bound of the binomial distribution, over all forms together at most
    ERROR; forms that are too rare to reach that, whatever their labels, don't count as tried (Tarone, 1990). Beginnings need two words or more.
    The weight is the share of toxic, clean documents counted four times, smoothed towards a low prior; weights under one half are left out.
    The grammar's own words are none. There can't be more entries than the LABELLED documents have forms.
    """
    found = rows.mapInArrow(_uses, "form binary, aimed boolean, around long, n long, word long").groupBy("form", "aimed", "around").agg(F.sum("n").alias("n"), F.min("word").alias("low"), F.max("word").alias("high"))
    found = found.groupBy("form", "aimed").agg(F.count("around").alias("t"), F.sum("n").alias("c"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = written(found.where("t >= 3 and (low <> high or right(form, 1) <> binary('*'))").drop("low", "high"), "uses")
    tried = {r["m"]: r["k"] for r in found.groupBy(F.least(F.col("t") + F.col("c"), F.lit(200)).alias("m")).agg(F.count(F.lit(1)).alias("k")).collect()}
    least = next((m for m in range(3, 201) if m * -math.log(share) >= math.log(max(1, sum(k for x, k in tried.items() if x >= m)) / ERROR)), 200)
    bound = math.log(max(1, sum(k for x, k in tried.items() if x >= least)) / ERROR)
    t, c = F.col("t").cast("double"), F.col("c").cast("double")
    part = t / (t + c)
    excess = t * F.log(part / share) + F.when(c > 0, c * F.log((1 - part) / (1 - share))).otherwise(0.0)
    best = found.where((t + c >= least) & (part > share) & (excess >= bound)).withColumn("weight", (t + 0.1) / (t + 4 * c + 0.5)).where("weight >= 0.5").collect()
    insults, aimed = ({bytes(r["form"]): min(0.95, r["weight"]) for r in best if r["aimed"] == a} for a in (False, True))
    return insults, {w: x for w, x in aimed.items() if w not in insults and not any(f in insults for f in forms(w.rstrip(b"*")))}


def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """form, aimed (only behind a target), around, n, word: a toxic document's forms with what surrounds them (n = 0) and the word that has the form, and how many clean documents have each (no around)."""

    def give(rows: list[tuple[bytes, bool, int | None, int, int | None]]) -> pa.RecordBatch:
        kinds = [pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["form", "aimed", "around", "n", "word"])

    clean: Counter = Counter()

    def counted() -> Iterator[pa.RecordBatch]:
        for some in batches_of(clean.items(), 50_000):
            yield give([(*key, None, n, None) for key, n in some])
        clean.clear()

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("_toxic").to_pylist(), strict=True):
            plain = text.translate(_CLAUSES)
            words = [w for w in plain.split() if w not in _CLASS]
            behind = {w for clause in plain.split(b"\n") if not _TARGETS.isdisjoint(own := clause.split()) for w in own[next(i for i, x in enumerate(own) if x in _TARGETS) + 1 :] if w not in _CLASS}
            if not toxic:
                for aimed, some in ((False, {*words}), (True, behind)):
                    clean.update((f, aimed) for f in {f for w in some for f in forms(w)})
                if len(clean) > 300_000:
                    yield from counted()
                continue
            seen: dict[tuple[bytes, bool], tuple[int, int]] = {}
            for before, w, after in zip([b"", *words], words, [*words[1:], b""], strict=False):
                around, name = xxhash.xxh64_intdigest(before + b" " + after) >> 1, xxhash.xxh64_intdigest(w) >> 1
                for f in forms(w):
                    for aimed in (False, True) if w in behind else (False,):
                        seen[f, aimed] = min((around, name), seen.get((f, aimed), (around, name)))
            for some in batches_of(seen.items(), 20_000):
                yield give([(f, aimed, around, 0, name) for (f, aimed), (around, name) in some])
    yield from counted()


def arcs(rows: DataFrame, model: Model) -> dict[str, float]:
    """What arcs behind a target, a negation and reported speech are worth, from the matching clauses of text and _toxic; equal clauses count once."""
    held = rows.sparkSession.sparkContext.broadcast(Model({w: 1.0 for w in model.insults}, {w: 1.0 for w in model.threats}, _TRACE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            found = {(xxhash.xxh64_intdigest(clause) >> 1, round(x), toxic) for text, toxic in zip(batch.column("text").to_pylist(), batch.column("_toxic").to_pylist(), strict=True) for clause, _ in scorer.clauses(text) for _, x in scorer.matches(clause)}
            clauses, taken, toxic = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(clauses, pa.int64()), pa.array(taken, pa.int32()), pa.array(toxic, pa.int32())], ["clause", "taken", "toxic"])

    seen = rows.mapInArrow(run, "clause long, taken int, toxic int").distinct().groupBy("taken").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).collect()  # eight kinds at most
    plain = next(((r["t"] + 1) / (r["n"] + 1) for r in seen if r["taken"] == 1), 1.0)
    worth = {}
    for arc, trace in _TRACE.items():
        # Of the matches that took this arc, and no other that lowers them.
        own = [r for r in seen if r["taken"] % int(trace) == 0 and all(r["taken"] % int(_TRACE[x]) for x in ("negated", "reported") if x != arc)]
        n, t = sum(r["n"] for r in own), sum(r["t"] for r in own)
        worth[arc] = min(1.2, (t / plain + PRIOR[arc] * PRIOR_MATCHES) / (n + PRIOR_MATCHES))
    return worth


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, n_clauses (matched ones).

    Whole texts are read; null and empty ones score NO_MATCH; repeated rows are scored each; other columns are left behind,
    and none but the text is seen; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            found = [scorer.score(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array([s for s, _ in found], pa.float64()), pa.array([int(s >= threshold) for s, _ in found], pa.int32()), pa.array([n for _, n in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *columns], ["doc_id", "held_out", "score", "predicted", "n_clauses"])

    return texts(docs).withColumn("held_out", held_out()).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_clauses long")
