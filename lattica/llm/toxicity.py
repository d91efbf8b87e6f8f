"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, report, other).  Five small transducers rewrite
the symbols of a clause one after another: negation weakens an insult or threat in its scope, reported
speech weakens what follows it, a target turns what follows it into something aimed, an insult matches
by itself, more if aimed or heaped upon another, and a threat matches only if it is aimed or a target
follows.  Their composition is a single deterministic machine whose transitions are built once and
remembered; it scores clauses, not isolated words.  The lexicon's weights and the final calibration are
learned from labels.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import map_batches, words_of
from lattica.llm.rolling import portions

# Seed words in the four languages of the corpus.
INSULTS = "idiot moron stupid loser trash scum worthless pathetic disgusting clown imbecile dumb crétin imbécile débile ordure idiota imbécil estúpido basura escoria dummkopf trottel abschaum".split()
THREATS = "kill murder stab strangle destroy hurt tuer égorger matar asesinar töten umbringen".split()
TARGETS = "you your yours he she him her they them their tu toi vous il elle ils eux usted ustedes él ella ellos du dich dir ihr euch er sie".split()
NEGATIONS = "not never no isn aren wasn don doesn without pas jamais sans ni nunca sin nicht kein keine nie ohne".split()
REPORTS = "said says wrote writes called quoted claimed reports dit disait écrit dijo dice escribió sagte sagt schrieb nannte".split()

STEM_LENGTHS = (4, 5, 6, 7, 8)
WORD_RE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CLAUSE_RE = re.compile(r"[.!?;:\n]+")
#: Words whose symbols a task remembers.
REMEMBER = 50_000
#: Weight of a seed word that the labels do not hold, and of the scopes.
SEED_WEIGHT, NEGATED, REPORTED, TARGETED, HEAPED, SCOPE = 2.0, 0.35, 0.6, 1.5, 1.25, 4


@dataclass(frozen=True)
class Transducer:
    """Arcs (state, symbol) -> (state, symbol out, factor); a missing arc passes the symbol on and returns to ``rest(state)``."""

    name: str
    arcs: dict
    rest: dict

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol)) or (self.rest.get(state, 0), symbol, 1.0)


def scoped(name: str, opener: str, touched: dict[str, float], scope: int) -> Transducer:
    """After ``opener``, for ``scope`` words, symbols in ``touched`` get their factor."""
    arcs: dict = {(s, opener): (scope, opener, 1.0) for s in range(scope + 1)}
    arcs |= {(s, x): (s - 1, x, f) for s in range(1, scope + 1) for x, f in touched.items()}
    return Transducer(name, arcs, {s: s - 1 for s in range(1, scope + 1)})


def targets(scope: int) -> Transducer:
    """For ``scope`` words after a target, insults and threats are aimed."""
    arcs: dict = {(s, "target"): (scope, "target", 1.0) for s in range(scope + 1)}
    arcs |= {(s, x): (s - 1, f"aimed {x}", 1.0) for s in range(1, scope + 1) for x in ("insult", "threat")}
    return Transducer("target", arcs, {s: s - 1 for s in range(1, scope + 1)})


def insults(scope: int) -> Transducer:
    """An insult matches; one that is aimed counts more, and so does one within ``scope`` words of another."""
    arcs: dict = {}
    for s in range(scope + 1):
        heaped = HEAPED if s else 1.0
        arcs |= {(s, "insult"): (scope, "match", heaped), (s, "aimed insult"): (scope, "match", heaped * TARGETED)}
    return Transducer("insult", arcs, {s: s - 1 for s in range(1, scope + 1)})


def threats(scope: int) -> Transducer:
    """An aimed threat matches; another waits ``scope`` words for a target, which then brings the threat's weight."""
    arcs: dict = {(s, "threat"): (scope, "waiting", 1.0) for s in range(scope + 1)}
    arcs |= {(s, "aimed threat"): (0, "match", TARGETED) for s in range(scope + 1)}
    arcs |= {(s, "target"): (0, "late match", TARGETED) for s in range(1, scope + 1)}
    return Transducer("threat", arcs, {s: s - 1 for s in range(1, scope + 1)})


@dataclass
class Grammar:
    """The composition of transducers, in order; its transition table grows as symbols are met and stays finite."""

    parts: tuple[Transducer, ...] = (
        scoped("negation", "negation", {"insult": NEGATED, "threat": NEGATED}, SCOPE),
        scoped("reported speech", "report", {"insult": REPORTED, "threat": REPORTED}, 3 * SCOPE),
        targets(SCOPE),
        insults(SCOPE),
        threats(SCOPE // 2),
    )
    table: dict = field(default_factory=dict)

    def step(self, state: tuple, symbol: str) -> tuple[tuple, str, float]:
        """(next state, symbol out, factor)."""
        if (hit := self.table.get((state, symbol))) is None:
            states, out, factor = [], symbol, 1.0
            for part, s in zip(self.parts, state, strict=True):
                s, out, f = part.step(s, out)
                states.append(s)
                factor *= f
            hit = self.table[state, symbol] = (tuple(states), out, factor)
        return hit

    def clause(self, read: list[tuple[str, float]]) -> float:
        """Weight of a clause given (symbol, weight) of its words."""
        state, total, waiting = (0,) * len(self.parts), 0.0, 0.0
        for symbol, weight in read:
            state, out, factor = self.step(state, symbol)
            if out == "match":
                total += factor * weight
            elif out == "waiting":
                waiting = factor * weight
            elif out == "late match":
                total += factor * waiting
        return total


@dataclass
class Lexicon:
    """Weights of words and of stems (beginnings of words), as many as the labels single out."""

    words: dict[str, float]
    stems: dict[str, float]

    def __post_init__(self):
        self.kinds = {w: k for k, ws in (("report", REPORTS), ("negation", NEGATIONS), ("target", TARGETS)) for w in ws} | {w: "insult" for w in self.words} | {w: "threat" for w in THREATS if w in self.words}
        self.lengths = sorted({len(x) for x in self.stems})
        self.seen: dict[str, tuple[str, float]] = {}

    def read(self, word: str) -> tuple[str, float]:
        """(symbol, weight) of a word; some ten thousand words are remembered."""
        if (hit := self.seen.get(word)) is None:
            if len(self.seen) >= REMEMBER:
                self.seen.clear()
            if kind := self.kinds.get(word):
                hit = kind, self.words.get(word, 0.0)
            else:
                weight = next((self.stems[word[:n]] for n in self.lengths if word[:n] in self.stems), None)
                hit = ("word", 0.0) if weight is None else ("insult", weight)
            self.seen[word] = hit
        return hit


def features(text: str | None, lexicon: Lexicon, grammar: Grammar) -> tuple[float, float, float, int]:
    """(sum of clause weights, largest clause weight, sum per hundred words, number of matched clauses) of a whole text."""
    low = (text or "").encode().lower().decode()  # bytes.lower touches A-Z alone
    words = WORD_RE.findall(low)
    if not any(lexicon.read(w)[1] for w in set(words)):
        return 0.0, 0.0, 0.0, 0
    total, most, n = 0.0, 0.0, 0
    for clause in CLAUSE_RE.split(low):
        read = [lexicon.read(w) for w in WORD_RE.findall(clause)]
        if any(weight for _, weight in read) and (score := grammar.clause(read)) > 0:
            total, most, n = total + score, max(most, score), n + 1
    return total, most, 100 * total / len(words), n


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 5 is 0; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


@dataclass
class Model:
    lexicon: Lexicon
    coefficients: tuple[float, ...] = (-3.0, 1.5, 0.5, 0.5)

    def score(self, total: float, most: float, rate: float) -> float:
        z = sum(c * x for c, x in zip(self.coefficients, (1.0, math.log1p(total), math.log1p(most), math.log1p(rate)), strict=True))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def _calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Ridge logistic regression by Newton's method."""
    a = np.column_stack((np.ones(len(x)), np.log1p(x)))
    w, penalty = np.zeros(a.shape[1]), ridge * np.diag([1e-3] + [1.0] * x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (p - y) + penalty @ w)
    return tuple(map(float, w))


def _starts(words: Column, n: int) -> Column:
    """The first ``n`` letters of every word that has as many."""
    return F.transform(F.filter(words, lambda w: F.length(w) >= n), lambda w: F.substring(w, 1, n))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, surprise: float = 6.0) -> Model:
    """Learn the lexicon's weights and the calibration from at most ``sample`` labelled rows that are not held out.

    The sample is the rows whose hashed ids are smallest; of texts that share an id the first in
    order counts. Beginnings of words, of four to eight letters, are counted by document; all whose
    toxic documents exceed the expected number by ``surprise`` standard deviations join the lexicon,
    the most surprising first and none that another begins, weighted by their log odds. Labels other
    than 0 and 1 and null ids are left out; with one class or none, or an empty table, only the seeds
    and default coefficients remain.
    """
    spark = docs.sparkSession
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    train = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))  # `sample` ids at most
    size = {r.toxic: r.n for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    stems: dict[str, float] = {}
    bad, good = size.get(1, 0), size.get(0, 0)
    weigh = lambda b, n: math.log((b + 0.5) / (bad + 1)) - math.log((n - b + 0.5) / (good + 1))
    seen = {}
    if bad and good:
        seeds = F.array(*[F.lit(w) for w in (*INSULTS, *THREATS)])
        per_doc = train.select("doc_id", "toxic", F.array_distinct(words_of(F.col("text"))).alias("ws"))
        seed_rows = per_doc.select("toxic", F.explode(F.array_intersect("ws", seeds)).alias("w")).groupBy("w").agg(F.sum("toxic").alias("b"), F.count("*").alias("n")).collect()  # the seeds at most
        seen = {r.w: (r.b, r.n) for r in seed_rows}
        starts = F.array_distinct(F.flatten(F.array(*[_starts(F.col("ws"), n) for n in STEM_LENGTHS])))
        counted = per_doc.select("toxic", F.explode(starts).alias("w")).groupBy("w").agg(F.sum("toxic").alias("b"), F.count("*").alias("n"))
        base = bad / (bad + good)
        z = (F.col("b") - F.col("n") * base) / F.sqrt(F.col("n") * (base * (1 - base)))
        sure = counted.where("b >= 3").withColumn("z", z).where(F.col("z") >= surprise).orderBy(F.desc("z"), F.length("w"), "w")
        begun: set[str] = set()
        for r in sure.collect():  # of the sample's words alone
            starts_of = {r.w[:n] for n in STEM_LENGTHS if n <= len(r.w)}
            if weigh(r.b, r.n) >= 1.5 and r.w not in begun and not any(x in stems for x in starts_of):
                stems[r.w] = weigh(r.b, r.n)
                begun |= starts_of
    seeds_kept = {w: (weigh(*seen[w]) if w in seen else SEED_WEIGHT) for w in (*INSULTS, *THREATS)}
    lexicon = Lexicon({w: x for w, x in seeds_kept.items() if x >= 1}, stems)
    model = Model(lexicon)
    if bad and good:
        rows = score_frame(train, model, keep=("toxic",)).select("total", "most", "rate", "toxic").toPandas()  # `sample` rows at most
        if rows["toxic"].nunique() == 2:
            model.coefficients = _calibrate(rows[["total", "most", "rate"]].to_numpy(float), rows["toxic"].to_numpy(float))
    return model


def score_frame(docs: DataFrame, model: Model, keep: tuple[str, ...] = (), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Score every whole text: (doc_id, kept columns, score, total, most, rate, clauses).

    Null and empty texts score as one without matches. Every row is scored for itself, repeated ones
    and those with a null id too; an empty table gives no rows; columns not in ``keep`` are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.col(text).alias("__text"))
    fields = [f for f in rows.schema.fields if f.name != "__text"]
    schema = type(rows.schema)(fields)
    for name in ("score", "total", "most", "rate"):
        schema = schema.add(name, "double")
    schema = schema.add("clauses", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar()
        for b in portions(batches, "__text"):
            found = [features(t, model.lexicon, grammar) for t in b.column(b.num_columns - 1).to_pylist()]
            scores = [model.score(*f[:3]) for f in found]
            columns = [pa.array(scores, pa.float64()), *(pa.array([f[i] for f in found], pa.float64()) for i in range(3)), pa.array([f[3] for f in found], pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], names=schema.names)

    return map_batches(rows, run, schema)
