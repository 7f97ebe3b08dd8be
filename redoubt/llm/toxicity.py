"""Toxicity by a weighted finite-state pattern grammar.

A text is read clause by clause.  A first transducer writes one symbol per
word: I insult, H threat, Y target, N negation, R reported speech, Q a
quotation mark, and a point for other words.  Which words are insults is learned
from labelled texts: whole words and word beginnings, each with a weight.  Five
small transducers read that tape: insult and threat mark their words, negation
counts the words since one, reported speech knows whether a verb of saying came
or quotation marks are open, and target knows whether one came (one that comes
later is written beside the symbol by a pass from the end, since a transducer
can't look ahead).  They are composed into one by a product over the states that
can be reached; its marks give each I and H a pattern:

  plain       the word alone            aimed     at a target in the clause
  negated     within NEAR words of a negation
  reported    after a verb of saying or within quotation marks
  threat      H with a target; H alone is no match

A clause scores the weight of its strongest word in each pattern.  A logistic
model over the patterns' sums, learned from the same labelled texts, gives the
document's score.  Labels, language, source and id never enter a score.

Learning takes at most ``SAMPLE`` labelled documents, those of least hash
among the rows whose crc32(doc_id as text) mod 5 isn't 0; scoring takes every
whole text.  Without toxic examples the built-in words alone are the lexicon.

Definitions: null and empty texts have no match and score the model's base
rate.  Rows that repeat a ``doc_id`` are scored alike if their texts are; of
several labels of a ``doc_id`` the highest counts, null labels don't.  A row
without ``doc_id`` counts as id '' for ``held_out`` and is never learned from.
Empty tables give no rows, and without labels the built-in words score alone.
Further columns stay as they are in ``clean`` and are ignored otherwise.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, simhash

SAMPLE = 16_000
NEAR = 3
PREFIXES = (4, 5, 6, 7)
PATTERNS = ("plain", "aimed", "negated", "reported", "threat")

# Words of the closed classes, English, German, French, Spanish.
INSULTS = "idiot moron scum loser stupid pathetic worthless disgusting trash clown imbecile dumbass bastard vermin filth abschaum arschloch connard salaud imbécil pendejo"
THREATS = "kill killing murder strangle stab shoot lynch behead töten umbringen erschiessen tuer égorger matar degollar"
TARGETS = "you your yours youre they them their he him his she her these those people du dich dein ihr euch sie tu toi vous ils elles tú usted ustedes ellos vosotros"
NEGATIONS = "not no never isn't aren't wasn't don't doesn't didn't nobody nicht kein keine nie niemals ne pas jamais aucun nunca jamás tampoco"
REPORTS = "said says say wrote writes claimed claims quoted called quote alleged reported sagte sagt schrieb nannte dit écrit déclara dijo dice escribió llamó"

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"“”«»„]")
_CLAUSE = re.compile(r"[.!?;\n]+")
_EDGE = re.compile(r"\w")


def _closed() -> dict[str, str]:
    out = {}
    for symbol, words in (("Y", TARGETS), ("N", NEGATIONS), ("R", REPORTS)):
        out.update(dict.fromkeys(words.split(), symbol))
    return out | dict.fromkeys('"“”«»„', "Q")


# A transducer: its first state, and a step from (state, symbol) to (state, mark).  A symbol is one of IHYNRQ. and
# a plus if a target comes later in the clause.
SYMBOLS = [c + later for c in "IHYNRQ." for later in ("", "+")]


def _marker(symbol: str, mark: str):
    return 0, lambda state, x: (0, mark if x[0] == symbol else "")


def _negation(near: int):
    """The state counts down the words in which a negation is in force."""
    return 0, lambda state, x: (near if x[0] == "N" else max(0, state - 1), "negated" if state else "")


def _reported():
    """The state holds whether a verb of saying came (1) and whether quotation marks are open (2)."""
    return 0, lambda state, x: (state | 1 if x[0] == "R" else state ^ 2 if x[0] == "Q" else state, "reported" if state else "")


def _target():
    return 0, lambda state, x: (1 if x[0] == "Y" else state, "aimed" if state or x[-1] == "+" else "")


def compose(machines: list) -> dict[tuple, tuple]:
    """The product of transducers: (states, symbol) to (states, set of marks), for the states that can be reached."""
    first = tuple(m[0] for m in machines)
    out, todo = {}, [first]
    while todo:
        states = todo.pop()
        for x in SYMBOLS:
            if (states, x) not in out:
                found = [m[1](state, x) for state, m in zip(states, machines)]
                then = tuple(f[0] for f in found)
                out[states, x] = then, frozenset(f[1] for f in found) - {""}
                todo.append(then)
    return out


def pattern(marks: frozenset) -> str:
    """The pattern of a word's marks, "" for no match."""
    if "threat" in marks and "aimed" not in marks or not marks & {"threat", "insult"}:
        return ""
    for mark in ("reported", "negated", "threat", "aimed"):
        if mark in marks:
            return mark
    return "plain"


def _automaton() -> tuple[tuple, dict[tuple, tuple]]:
    """The composed automaton's first state and its steps, with patterns in the place of marks."""
    machines = [_marker("I", "insult"), _marker("H", "threat"), _negation(NEAR), _reported(), _target()]
    return tuple(m[0] for m in machines), {at: (then, pattern(marks)) for at, (then, marks) in compose(machines).items()}


class Grammar:
    """The transducers for one lexicon: ``words`` and ``stems`` (word beginnings) to weights."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.threats = set(THREATS.split())
        self.closed, (self.first, self.step) = _closed(), _automaton()
        self.finder = ahocorasick.Automaton()
        for w in {*words, *stems, *self.threats}:
            self.finder.add_word(w, len(w))
        if len(self.finder):
            self.finder.make_automaton()

    def weight(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        for n in PREFIXES:
            if len(word) >= n:
                found = max(found, self.stems.get(word[:n], 0.0))
        return found

    def clauses(self, text: str):
        """Clauses that hold the beginning of a word of the lexicon."""
        begin, last = 0, -1
        for end, size in self.finder.iter(text) if len(self.finder) else ():
            at = end - size + 1
            if at <= last or at and text[at - 1].isalnum():
                continue
            begin = max(text.rfind(c, 0, at) for c in ".!?;\n") + 1
            stop = _CLAUSE.search(text, at)
            last = stop.start() if stop else len(text)
            yield begin, last, text[begin:last]

    def read(self, clause: str) -> list[tuple[str, float, int, int]]:
        """``(pattern, weight, start, end)`` of the clause's matches."""
        words = [(m[0].replace("’", "'"), m.start(), m.end()) for m in _WORD.finditer(clause)]
        tape = [self.closed.get(w) or ("H" if w in self.threats else "I" if self.weight(w) > 0 else ".") for w, _, _ in words]
        last = max((i for i, x in enumerate(tape) if x == "Y"), default=-1)
        state, out = self.first, []
        for i, symbol in enumerate(tape):
            state, found = self.step[state, symbol + "+" if i < last else symbol]
            if found:
                out.append((found, self.weight(words[i][0]) if symbol == "I" else 1.0, words[i][1], words[i][2]))
        return out

    def matches(self, text: str | None) -> list[tuple[str, float, int, int]]:
        text = (text or "").lower()
        return [(p, w, a + s, a + e) for a, _, clause in self.clauses(text) for p, w, s, e in self.read(clause)]

    def features(self, text: str | None) -> list[float]:
        """For each pattern, the sum over clauses of the strongest word's weight, damped."""
        text, sums = (text or "").lower(), dict.fromkeys(PATTERNS, 0.0)
        for _, _, clause in self.clauses(text):
            best: dict[str, float] = {}
            for pattern, weight, _, _ in self.read(clause):
                best[pattern] = max(best.get(pattern, 0.0), weight)
            for pattern, weight in best.items():
                sums[pattern] += weight
        return [math.log1p(sums[p]) for p in PATTERNS]


# ---- learning


def _beginnings(batches):
    """``(feature, toxic, docs)``: words and, marked by *, word beginnings, counted once a document and summed within the task."""
    held: Counter = Counter()

    def flush():
        keys = list(held)
        rows = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([held[k] for k in keys], pa.int64())], names=["feature", "toxic", "docs"])
        held.clear()
        return rows

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = {m[0].replace("’", "'") for m in _WORD.finditer((text or "").lower())}
            held.update((w, toxic) for w in words)
            held.update((s, toxic) for s in {w[:n] + "*" for w in words for n in PREFIXES if len(w) >= n})
            if len(held) > 400_000:
                yield flush()
    if held:
        yield flush()


def chance(a: int, b: int, share: float) -> float:
    """Log of a bound on the chance that ``a`` or more of ``a + b`` documents are toxic by luck (Chernoff)."""
    n = a + b
    if a <= share * n:
        return 0.0
    return -sum(k * math.log(k / (n * q)) for k, q in ((a, share), (b, 1 - share)) if k)


def learn_lexicon(counts, n_toxic: int, n_clean: int, n_features: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems that mark toxic texts, with their log odds.

    A mark is far commoner in toxic texts, beyond luck even among all features
    tried.  Of a stem and the marks it begins, the stem is taken only if it
    reaches clearly further than the best of them.
    """
    share, marks = n_toxic / (n_toxic + n_clean), {}
    for feature, a, b in counts:
        odds = math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1))
        if odds > 3 and chance(a, b, share) + math.log(n_features) < math.log(0.05):
            marks[feature] = odds, a
    ordered = sorted(marks)
    words, stems = {}, {}
    for feature in sorted(marks, key=lambda f: (len(f.rstrip("*")), not f.endswith("*"), f)):
        bare, (odds, reach) = feature.rstrip("*"), marks[feature]
        if any(bare[:n] in stems for n in PREFIXES):
            continue
        if not feature.endswith("*"):
            words[bare] = odds
            continue
        below = ordered[bisect_left(ordered, bare) : bisect_left(ordered, bare + "\U0010ffff")]
        if max((marks[f][1] for f in below if f != feature), default=0) < 0.8 * reach:
            stems[bare] = odds
    return words, stems


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, steps: int = 50) -> np.ndarray:
    """Newton's method for a ridge logistic model; the last weight is the base."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.diag([ridge * len(x) / 100] * (x.shape[1] - 1) + [1e-9])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep + 1e-9 * np.eye(len(w)), x.T @ (y - p) - keep @ w)
        w = w + np.clip(move, -4, 4)
        if np.abs(move).max() < 1e-6:
            break
    return w


def remainder(column="doc_id"):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most about ``sample`` labelled rows ``(text, toxic)`` outside the held-out fold, by hash of the id."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(remainder() != 0)
    many = known.count()
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30))
    some = known.where(place < int((1 << 30) * min(1.0, sample / max(many, 1))))
    rows = docs.select("doc_id", "text").join(some.withColumnRenamed("doc_id", "of"), F.col("doc_id") == F.col("of")).select("text", F.col("toxic").cast("int").alias("toxic"))
    # Copies would count one author's words many times: of texts that share the least shingles of two orders one stays.
    return rows.mapInArrow(_keyed, "text string, toxic int, least long, other long").groupBy("least", "other", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def _keyed(batches):
    for batch in batches:
        hashes = [simhash.shingle_hashes((t or "").encode(), 4, 1) for t in batch.column(0).to_pylist()]
        orders = [np.array([simhash.remixed(h, take).min(initial=np.uint64(0xFFFFFFFFFFFFFFFF)) for h in hashes], dtype=np.uint64).view(np.int64) for take in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, orders)], names=["text", "toxic", "least", "other"])


def _features(words, stems):
    def run(batches):
        grammar = Grammar(words, stems)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([grammar.features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    return run


class Model:
    def __init__(self, words, stems, weights):
        self.words, self.stems, self.weights = words, stems, list(map(float, weights))

    def score(self, grammar: Grammar, text: str | None) -> float:
        z = sum(w * f for w, f in zip(self.weights, grammar.features(text))) + self.weights[-1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = common.checkpoint(training_rows(docs, labels, sample))
    n = dict(rows.groupBy("toxic").count().collect())
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    seeds = dict.fromkeys(INSULTS.split(), 2.0)
    if not n_toxic or not n_clean:
        return Model(seeds, {}, [3.0, 3.0, 0.5, 0.5, 5.0, -2.5])
    counts = rows.where("toxic in (0, 1)").mapInArrow(_beginnings, "feature string, toxic int, docs long").groupBy("feature").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("docs")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("docs")).otherwise(0)).alias("b")
    )
    counts = common.checkpoint(counts.where("a + b > 1"))
    marks = counts.where(f"a >= 3 and a * {n_clean} > 20 * b * {n_toxic}").collect()  # of the bounded sample
    words, stems = learn_lexicon([tuple(r) for r in marks], n_toxic, n_clean, max(1, counts.count()))
    words = {w: v for w, v in seeds.items() if w not in words and not any(w[:p] in stems for p in PREFIXES)} | words
    seen = rows.where("toxic in (0, 1)").mapInArrow(_features(words, stems), "x array<double>, toxic int").collect()  # six numbers a sampled row
    order = sorted((tuple(r.x), r.toxic) for r in seen)
    x, y = np.array([r[0] for r in order]), np.array([r[1] for r in order], dtype=float)
    return Model(words, stems, fit_logistic(x, y))


def _score(model: Model):
    def run(batches):
        grammar = Grammar(model.words, model.stems)
        for batch in batches:
            scores = [model.score(grammar, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row."""
    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score(model), "doc_id long, score double")
    return found.select("doc_id", (remainder() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _filter(model: Model, at: int):
    def run(batches):
        grammar = Grammar(model.words, model.stems)
        for batch in batches:
            yield batch.filter(pa.array([model.score(grammar, t) < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return run


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the documents predicted toxic."""
    return docs.mapInArrow(_filter(model, docs.columns.index("text")), docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scores(docs, learn(docs, common.table(spark, sf_dir, "labels")))
