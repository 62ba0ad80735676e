"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols (insult, threat, target, negation, report, other). Transducers for
negation, reported speech and targets are composed into one machine that rewrites the insults
and threats of a clause by what stands before them; a clause counts as its strongest match.
A document's score is a logistic function of its clauses of each kind. Which words and word
stems insult, and what each kind weighs, is learned from labelled documents; kinds that these
say nothing about keep the weights set here, and the grammar's order holds: what is directed
weighs no less than what isn't, what is negated or quoted never speaks for toxicity.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import session, spread

#: Labelled documents that are learned from, at most; those with the smallest hashes of their ids.
SAMPLE = 20_000
#: Texts whose words are held at once in a task.
SLICE = 64
#: Letters of a word's start that make a stem.
STEMS = (8, 7, 6, 5, 4, 3)
#: Least hashes of a text's word triples that near copies have in common.
FAMILY = 3
#: A word or stem insults, or insults mildly, if so many of its documents, at least, are toxic ...
PURITY, MILD_PURITY = 0.9, 0.35
#: ... and chance would make any of the words tried look like that with this probability.
CHANCE = 0.1

#: Word lists of the grammar (fixed values), in English, German, French and Spanish.
INSULTS = "idiot moron scum loser trash clown stupid pathetic worthless disgusting dumb fool"
THREATS = "kill hurt beat destroy punish töten schlagen zerstören tuer frapper détruire matar golpear destruir"
TARGETS = "you your yourself du dich dir dein ihr euch tu toi ton vous votre tú usted ustedes vosotros"
NEGATIONS = "not no never neither nicht kein keine nie niemals pas jamais aucun nunca jamás ningún"
REPORTS = "said says told called wrote quoted reported sagte sagt schrieb nannte dit disait écrit dijo dice escribió llamó"

TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")
END = frozenset(".!?;:\n")

# Symbols of words: Insult, Mild insult, tHreat, Target (you), Negation, Report, Other; of matches:
# Directed insult, directed threat (A), Weakened by a negation, Quoted.
WORDS, MATCHES = "IMHTNRO", "DAIHMWQ"


class Transducer:
    """A deterministic transducer: rules (state, symbols, next state, output); "=" copies the symbol."""

    def __init__(self, rules: Iterable[tuple[int, str, int, str]]):
        self.arcs = {(s, x): (t, x if y == "=" else y) for s, xs, t, y in rules for x in xs}

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.arcs.get((state, symbol), (state, symbol))


#: A negation reaches over the next three words.
NEGATED = Transducer([
    *((s, "N", 3, "=") for s in range(4)),
    *((s, "IMH", s - 1, "W") for s in (1, 2, 3)),
    *((s, "TRO", s - 1, "=") for s in (1, 2, 3)),
])
#: Behind a reporting verb a clause is quoted.
REPORTED = Transducer([(0, "R", 1, "="), (1, "IMHW", 1, "Q")])
#: Of two mild insults in a clause the second is a full one.
REPEATED = Transducer([(0, "M", 1, "="), (1, "M", 1, "I")])
#: Behind a target, insults and threats are directed.
DIRECTED = Transducer([(0, "T", 1, "="), (1, "I", 1, "D"), (1, "H", 1, "A")])


class Composed:
    """The composition of transducers, as one table over tuples of their states."""

    def __init__(self, *parts: Transducer):
        self.start = (0,) * len(parts)
        self.table: dict[tuple, dict[str, tuple[tuple, str]]] = {}
        todo = [self.start]
        while todo:
            states = todo.pop()
            if states in self.table:
                continue
            row = self.table[states] = {}
            for symbol in WORDS:
                out, after = symbol, []
                for part, state in zip(parts, states, strict=True):
                    to, out = part.step(state, out)
                    after.append(to)
                row[symbol] = (tuple(after), out)
                todo.append(tuple(after))

    def clause(self, symbols: str) -> str:
        """The clause's strongest match, or nothing."""
        state, found = self.start, set()
        for symbol in symbols:
            state, out = self.table[state][symbol]
            found.add(out)
        return next((m for m in MATCHES if m in found), "")


GRAMMAR = Composed(NEGATED, REPORTED, REPEATED, DIRECTED)


#: Weights of MATCHES, of the number of clauses and the bias where no document tells.
WEIGHTS = (6.0, 5.0, 5.0, 2.0, 2.0, 0.0, 0.0, 0.0, -3.0)


@dataclass(frozen=True)
class Model:
    """Symbols of words and stems ("stem-"), and the weights of clauses(); the bias last."""

    learned: dict[str, str] = field(default_factory=dict)
    weights: tuple[float, ...] = WEIGHTS

    @cached_property
    def symbols(self) -> dict[str, str]:
        lists = (("R", REPORTS), ("N", NEGATIONS), ("T", TARGETS), ("H", THREATS))
        return {w: s for s, listed in (*lists, ("I", INSULTS)) for w in listed.split()} | self.learned

    def symbol(self, word: str) -> str:
        found = self.symbols.get(word)
        if found is None:
            get = self.learned.get
            found = next((s for n in STEMS if len(word) > n and (s := get(f"{word[:n]}-"))), "O")
        return found

    def clauses(self, text: str) -> list[int]:
        """How many clauses there are of each kind, and in all."""
        kinds, clause, counts, n = self.symbol, [], Counter(), 0
        tokens = TOKEN.findall(text.lower())
        tokens.append(".")
        for token in tokens:
            if token not in END:
                clause.append(kinds(token))
            elif clause:
                n += 1
                if "I" in clause or "M" in clause or "H" in clause:
                    counts[GRAMMAR.clause("".join(clause))] += 1
                clause = []
        return [*(counts[m] for m in MATCHES), n]

    def score(self, text: str) -> float:
        x = self.clauses(text) if text else [0] * (len(MATCHES) + 1)
        z = sum(w * math.log1p(n) for w, n in zip(self.weights, x, strict=False)) + self.weights[-1]
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def features(text: str) -> tuple[int, int, set[str]]:
    """A key that near copies mostly share (the FAMILY least hashes of its word triples), a hash of the text, and its words and stems ("word" and "stem-")."""
    words = [t for t in TOKEN.findall(text.lower()) if t not in END]
    triples = zip(words, words[1:], words[2:], strict=False) if len(words) > 2 else [tuple(words)]
    least = heapq.nsmallest(FAMILY, {xxhash.xxh64_intdigest(" ".join(t)) for t in triples})
    family = xxhash.xxh64_intdigest(" ".join(map(str, least)))
    own = set(words)
    return family - (1 << 63), xxhash.xxh64_intdigest(text) - (1 << 63), own | {f"{w[:n]}-" for w in own for n in STEMS if len(w) > n}


def _tail(k: int, n: int, p: float) -> float:
    """Logarithm of the probability of k or more of n, each with probability p."""
    first = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    i = np.arange(k, n)
    logs = first + np.r_[0.0, np.cumsum(np.log((n - i) / (i + 1)) + math.log(p) - math.log1p(-p))]
    return min(0.0, float(logs.max() + np.log(np.exp(logs - logs.max()).sum())))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from docs (doc_id, text) that have a label 0 or 1 in labels (doc_id, toxic) and aren't held out.

    Of the labels `sample` at most are used, so their ids can be broadcast; of an id with both
    labels, 1. Near copies count once, as toxic if any is, so that the words of a text copied
    often don't pass for insults. What reaches the driver are the words that pass the test and the clause counts of
    the sample. With no rows of either label the word lists and set weights hold. Whole texts are
    read, however long; null texts teach nothing, and ids on several rows teach all their texts.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = spread(docs.where("text is not null").select("text", F.col("doc_id").cast("long").alias("_id")))
    texts = rows.join(F.broadcast(chosen), "_id")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            found = [features(x) for x in batch.column(1).to_pylist()]
            keys = [pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*keys, batch.column(0), pa.array([list(x[2]) for x in found], pa.list_(pa.string()))], names=["family", "text", "toxic", "features"])

    base = texts.select(F.col("toxic").cast("int"), "text").mapInArrow(featured, "family long, text long, toxic int, features array<string>")
    once = base.groupBy("family").agg(F.max_by(F.struct("toxic", "features"), F.struct("toxic", "text")).alias("one")).select("one.*").persist()
    try:
        n, k = once.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        if not 0 < k < n:
            return Model()
        counts = once.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
        tried = counts.count()
        likely = counts.where((F.col("k") >= 3) & (F.col("k") >= MILD_PURITY * F.col("n"))).collect()
    finally:
        once.unpersist()
    limit = math.log(CHANCE / tried)
    learned = {r["feature"]: "I" if r["k"] >= PURITY * r["n"] else "M" for r in likely if _tail(r["k"], r["n"], k / n) < limit}
    model = Model(learned)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.clauses(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.int64()))], names=["toxic", "x"])

    seen = texts.select(F.col("toxic").cast("int"), "text").mapInArrow(counted, "toxic int, x array<long>").groupBy("toxic", "x").count().collect()
    return Model(learned, weigh([(r["x"], r["toxic"], r["count"]) for r in seen]))


def weigh(seen: list[tuple[list[int], int, int]]) -> tuple[float, ...]:
    """Weights from (clause counts, toxic or not, documents): a logistic regression on logarithms of counts, drawn towards WEIGHTS.

    Where the fit would break the grammar's order it is fitted anew with the directed kind tied
    to the plain one, or the negated or quoted kind at 0.
    """
    seen = sorted(seen)
    x = np.array([[*np.log1p(counts), 1.0] for counts, _, _ in seen])
    y, n = (np.array([r[i] for r in seen], float) for i in (1, 2))
    prior, at, held = np.array(WEIGHTS), {m: i for i, m in enumerate(MATCHES)}, {}
    while True:
        whole = np.eye(len(prior))
        for i, of in held.items():
            whole[i] = whole[of] if of is not None else 0
        whole = whole[:, [i for i in range(len(prior)) if i not in held]]
        w = whole @ _logistic(x @ whole, y, n, np.linalg.lstsq(whole, prior, rcond=None)[0])
        broken = {at[m]: None for m in "WQ" if w[at[m]] > 1e-9} | {at[m]: at[of] for m, of in ("DI", "AH") if w[at[m]] < w[at[of]] - 1e-9}
        if not broken:
            return tuple(w.tolist())
        held |= broken


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Ridge logistic regression around prior weights, by Newton's method; the bias, the last, is nearly free."""
    ridge, w = np.eye(x.shape[1]), prior.copy()
    ridge[-1, -1] = 1e-3

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((n * (np.logaddexp(0, z) - y * z)).sum() + (w - prior) @ ridge @ (w - prior) / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + ridge, x.T @ (n * (y - p)) - ridge @ (w - prior))
        size = 1.0
        while loss(w + size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w + size * step
        if np.abs(step).max() < 1e-9:
            break
    return w


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.5).

    Only the text is looked at, whole whatever its length. Null and empty texts have no clauses
    and get the score of that. Rows are scored one by one, so repeated rows get equal scores.
    Columns score and predicted of docs, if there are any, are replaced; all others stay.
    """
    known = session(docs.sparkSession).sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(texts):  # noqa: ANN001, ANN202
        return texts.fillna("").map(known.value.score)

    return spread(docs).withColumn("score", scores("text")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
