"""Toxicity by a weighted finite-state pattern grammar.

Words are mapped to symbols (insult, threat, target, negation, reporting
verb, clause end, other).  Five small transducers read the symbols of a
clause: insult seen, threat seen, target seen, insult or threat in the scope
of a negation, insult or threat after a reporting verb.  Their composition
is one automaton; where a clause ends, its state says which kind of clause
was matched (plain, aimed, negated, reported, threat).  A document's score is
logistic in the weight matched per kind of clause, so an isolated word counts
by the clause that it stands in.

The insult words, their weights and the weights of the clause kinds are
learned from labelled rows: at most ``SAMPLE`` of them, the ones with the
smallest hashes (the only bound; texts are read whole, all their words are
looked at, and every document is scored).  A word is learned from ``FLOOR``
toxic texts on, however many labels there are.  Inflected words are learned
as stems (a prefix with ``*``).  ``FLOOR``, ``COVER`` and ``CLEAN_COST`` were
chosen by four folds inside the training rows.

Null or empty text: the score without any clause.  No labels, or labels of
one kind only: score 0 for every text.  Repeated rows get equal scores.
Label rows without a label, and null ids, are not learned from; a document
with several labels counts as toxic if one of them says so.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, filter_rows

SAMPLE = 12_000             # labelled rows that a model is fitted on, at most
FLOOR = 3                   # toxic texts that a unit must cover at least
STEM_LENGTHS = (4, 5, 6)
COVER = 3                   # units wanted in each toxic text
CLEAN_COST = 10             # toxic texts that a unit must cover to make up for one clean text
WORD_CACHE = 400_000        # entries,
CACHED_CHARS = 200          # of words up to this length
THRESHOLD = 0.3
NEGATION_SCOPE = 4          # words

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
KINDS = ("plain", "aimed", "negated", "reported", "threat")

# Function words of the grammar in English, German, French and
# Spanish.
THREATS = """kill hurt destroy shoot stab burn beat murder töten verletzen schlagen vernichten
tuer blesser frapper détruire matar herir golpear destruir""".split()
TARGETS = """you your yours he she they him them his her their people everyone du dich dir ihr euch er
sie alle tu toi te vous il elle ils elles tous usted ustedes vosotros él ella ellos todos""".split()
NEGATIONS = """not no never nobody nothing without nicht kein keine nie niemals ohne ne pas jamais sans
nunca jamás sin nadie""".split()
REPORTS = """said says say told wrote reported claimed quoted called sagte sagt sagen schrieb nannte
berichtete dit disait dire écrit raconte dijo dice decir escribió contó""".split()

_TOKEN = re.compile(r"\w+|[.!?;:\n]")


# --- the grammar ---------------------------------------------------------

class Transducer:
    """``step[state][symbol]`` with start state 0; ``output[state]`` is read
    where a clause ends."""

    def __init__(self, step: list[list[int]], output: list[int]):
        self.step, self.output = step, output


def _seen(symbol: int) -> Transducer:
    """1 once the symbol was read."""
    return Transducer([[int(s == symbol) for s in range(7)], [1] * 7], [0, 1])


def _after_report() -> Transducer:
    """1 once an insult or threat followed a reporting verb."""
    first = [1 if s == REPORT else 0 for s in range(7)]
    second = [2 if s in (INSULT, THREAT) else 1 for s in range(7)]
    return Transducer([first, second, [2] * 7], [0, 0, 1])


def _negated() -> Transducer:
    """1 once an insult or threat stood at most NEGATION_SCOPE words after a
    negation."""
    last = NEGATION_SCOPE + 1
    step = [[1 if s == NEGATION else 0 for s in range(7)]]
    for k in range(1, last):
        far = k + 1 if k + 1 < last else 0
        step.append([last if s in (INSULT, THREAT) else 1 if s == NEGATION else far for s in range(7)])
    step.append([last] * 7)
    return Transducer(step, [0] * last + [1])


def compose(parts: list[Transducer]) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """The product of the transducers, its reachable states only: a step
    table and the outputs of each state."""
    number, states, table = {(0,) * len(parts): 0}, [(0,) * len(parts)], []
    for at in states:
        row = []
        for s in range(7):
            to = tuple(p.step[q][s] for p, q in zip(parts, at))
            if to not in number:
                number[to] = len(states)
                states.append(to)
            row.append(number[to])
        table.append(row)
    return np.array(table), [tuple(p.output[q] for p, q in zip(parts, at)) for at in states]


def _kind(out: tuple[int, ...]) -> int | None:
    """Clause kind of the outputs (insult, threat, target, negated, reported)."""
    insult, threat, target, negated, reported = out
    if not insult and not (threat and target):
        return None
    if negated:
        return 2
    if reported:
        return 3
    if threat and target:
        return 4
    return 1 if target else 0


_TABLE, _OUTPUTS = compose([_seen(INSULT), _seen(THREAT), _seen(TARGET), _negated(), _after_report()])
_STEP = _TABLE.tolist()
_KIND = [_kind(o) for o in _OUTPUTS]


def units_of(word: str) -> list[str]:
    """The word and its stems."""
    return [word, *(word[:k] + "*" for k in STEM_LENGTHS if len(word) > k)]


class _Symbols(dict):
    """Word to (symbol, weight), looked up once per word and task."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon
        self.fixed = {w: (s, 1.0) for s, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS),
                                                (REPORT, REPORTS)) for w in ws}
        self.fixed |= {c: (END, 0.0) for c in ".!?;:\n"}

    def __missing__(self, w):
        if len(self) >= WORD_CACHE:
            self.clear()
        hits = [self.lexicon[u] for u in units_of(w) if u in self.lexicon]
        v = (INSULT, max(hits)) if hits else self.fixed.get(w, (OTHER, 0.0))
        if len(w) <= CACHED_CHARS:
            self[w] = v
        return v


def clause_weights(text: str, symbols: dict) -> list[float]:
    """Weight matched per clause kind: the weightiest insult or threat of
    each clause, summed over the clauses of a kind."""
    got = [0.0] * len(KINDS)
    seen = [symbols[w] for w in _TOKEN.findall(text.lower())]
    if not any(s in (INSULT, THREAT) for s, _ in seen):
        return got
    state, best = 0, 0.0
    for s, w in (*seen, (END, 0.0)):
        if s == END:
            kind = _KIND[state]
            if kind is not None:
                got[kind] += best
            state, best = 0, 0.0
        else:
            state = _STEP[state][s]
            if s in (INSULT, THREAT) and w > best:
                best = w
    return got


# --- learning ------------------------------------------------------------

def _units(text: str) -> set[str]:
    return {u for w in set(_TOKEN.findall(text.lower())) for u in units_of(w)}


def _sum_per_unit(train: DataFrame, toxic: int, wanted) -> DataFrame:
    """(unit, docs): training texts of one label that hold the unit."""
    def run(batches):
        c: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                u = _units(t or "")
                c.update(u if wanted is None else u & wanted.value)
        if c:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())],
                                             names=["unit", "docs"])
    return (train.where(F.col("toxic") == toxic).select("text").mapInArrow(run, "unit string, docs long")
            .groupBy("unit").agg(F.sum("docs").alias("docs")))


def _pick_units(rows: list[list[str]], t: dict, c: dict, n_toxic: int, n_clean: int) -> dict:
    """Greedy cover of the toxic training texts, COVER units each: the unit
    that covers most of what is still open comes next (less CLEAN_COST for each
    clean text that holds it), a whole word before a stem of equal use.  A word that only stands in copies of one text is of
    little use once the words that make those texts toxic are in."""
    holders: dict[str, list[int]] = {}
    for i, us in enumerate(rows):
        for u in us:
            holders.setdefault(u, []).append(i)
    open_ = [COVER] * len(rows)
    # of equal use, first what shares its stem with no word of clean texts
    k = STEM_LENGTHS[0]
    common = lambda u: c.get(u[:k] + "*" if len(u) > k else u, 0)
    cost = {u: CLEAN_COST * c.get(u, 0) for u in holders}
    heap = [(cost[u] - len(h), common(u), u.endswith("*"), -len(u), u) for u, h in holders.items()
            if len(h) >= FLOOR + cost[u]]
    heapq.heapify(heap)
    lexicon: dict[str, float] = {}
    words: dict[str, int] = {}          # stems of words in the lexicon: texts with the word
    while heap:
        was, *rest, u = heapq.heappop(heap)
        bare = u.rstrip("*")
        if any(bare[:n] + "*" in lexicon for n in STEM_LENGTHS if n <= len(bare)):
            continue                    # a shorter stem matches all that it matches
        if len(holders[u]) <= 1.2 * words.get(u, 0):
            continue                    # little more than a word that is in
        gain = sum(open_[i] > 0 for i in holders[u])
        if gain < FLOOR + cost[u]:
            continue
        if cost[u] - gain > was:    # out of date
            heapq.heappush(heap, (cost[u] - gain, *rest, u))
            continue
        if bare == u:
            words |= {x: max(words.get(x, 0), len(holders[u])) for x in units_of(u)[1:]}
        lexicon[u] = math.log((t[u] + 0.5) / (n_toxic + 1)) - math.log((c.get(u, 0) + 0.5) / (n_clean + 1))
        for i in holders[u]:
            open_[i] = max(0, open_[i] - 1)
    return lexicon


def _features(got: list[float]) -> list[float]:
    return [1.0, *(math.log1p(x) for x in got)]


def _logistic(x: np.ndarray, n: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Ridge logistic regression by Newton's method on grouped rows."""
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-6),
                               x.T @ (y - n * p) - pull * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Learn a model from documents (doc_id, text) and label rows (doc_id,
    toxic).  The caller leaves held-out rows out of ``labels``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    train = scratch.write(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(
        "text", "toxic"), "train")
    size = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    if not n_toxic or not n_clean:
        return {"lexicon": {}, "weights": None}
    t = {r["unit"]: r["docs"] for r in _sum_per_unit(train, 1, None).where(F.col("docs") >= FLOOR).collect()}
    wanted = spark.sparkContext.broadcast(set(t))
    c = {r["unit"]: r["docs"] for r in _sum_per_unit(train, 0, wanted).collect()}
    pure = {u for u in t if c.get(u, 0) * n_toxic * 20 <= t[u] * n_clean and c.get(u, 0) * 4 <= t[u]}
    names = sorted(pure)
    place = spark.sparkContext.broadcast({u: i for i, u in enumerate(names)})

    def hold(batches):
        for b in batches:
            us = [sorted(place.value[u] for u in _units(x or "") if u in place.value)
                  for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.list_(pa.int32()))], names=["units"])
    rows = [[names[i] for i in r["units"]] for r in
            train.where("toxic = 1").select("text").mapInArrow(hold, "units array<int>").collect()]
    lexicon = _pick_units(rows, t, c, n_toxic, n_clean)

    def match(batches):
        symbols = _Symbols(lexicon)
        for b in batches:
            got = [clause_weights(x or "", symbols) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(got, pa.list_(pa.float64()))],
                                             names=["toxic", "got"])
    seen = (train.mapInArrow(match, "toxic int, got array<double>").groupBy("got")
            .agg(F.count("*").alias("n"), F.sum("toxic").alias("y")).collect())
    x = np.array([_features(r["got"]) for r in seen])
    w = _logistic(x, np.array([r["n"] for r in seen], float), np.array([r["y"] for r in seen], float))
    scratch.drop("train")
    return {"lexicon": lexicon, "weights": w.tolist()}


# --- scoring -------------------------------------------------------------

def make_scorer(model: dict):
    """A function from text to score."""
    if model["weights"] is None:
        return lambda text: 0.0
    symbols, w = _Symbols(model["lexicon"]), model["weights"]

    def score(text: str) -> float:
        z = sum(a * b for a, b in zip(w, _features(clause_weights(text, symbols))))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    return score


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of every row of ``docs`` (doc_id, text)."""
    def run(batches):
        score = make_scorer(model)
        for b in batches:
            s = [score(x or "") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(s, pa.float64())],
                                             names=["doc_id", "score"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, all columns, that score below the threshold."""
    def make_keep():
        score = make_scorer(model)
        return lambda text: score(text) < threshold
    return filter_rows(docs, "text", make_keep)


def held_out(col="doc_id"):
    """True for ids in the held-out fold: crc32 of the id as text, mod 4, is
    2.  A null id is not held out."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % 4 == 2
