"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insult, threat, target, negation, report, other. Five small transducers
read the symbols of a clause and add weights: an insult counts its own weight, more near a
target; a threat counts near a target; a negation takes the weight off what follows closely;
reported speech takes most of it off to the end of the clause. They are composed into one
machine, and a clause is scored by one walk through it. A document's clause scores go through
a logistic regression.

Insult words and their weights are learned: log-odds of toxic against other labelled documents,
over distinct texts, of which at most ``SAMPLE`` in hash order are used. Labels of held-out rows
(``crc32`` of the doc_id modulo 5 is 0) are never read. Only texts enter a score.

Defined results: a null or empty text scores as one without matches; without labels, or with
one class only, the score is 0.5 times the share of matched clauses; repeated rows score alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as tx

SAMPLE = 20_000  # distinct labelled texts to learn from
LEXICON = 300  # learned words at most
MIN_DOCS, MIN_Z, MIN_ODDS = 5, 4.0, 2.5
REACH = 4  # words a target, a negation or a threat reaches

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)
#: Small closed classes of words; insults are learned.
CLOSED = {
    THREAT: "kill killed hurt destroy beat burn shoot stab töten umbringen schlagen tuer frapper brûler matar golpear quemar",
    TARGET: "you your yours he she they them him her his their du dich dir ihr euch sie er tu toi vous ton ta il elle ils tú usted ustedes él ella ellos",
    NEGATION: "not no never none nobody isn't aren't don't nicht kein keine nie ne pas jamais aucun nunca jamás ningún tampoco",
    REPORT: "said says say wrote writes quoted called reported allegedly sagte schrieb angeblich dit disait écrit selon dijo dice escribió según",
}
SYMBOLS = {w: k for k, ws in CLOSED.items() for w in ws.split()}
CLAUSE = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
TARGET_BONUS, THREAT_WEIGHT, NEGATED, REPORTED = 0.3, 3.0, 0.8, 0.6


@dataclass
class Transducer:
    """States 0..n-1, all final; step[state][symbol] is the next state and the weight factor or bonus."""

    step: list[list[tuple[int, tuple[float, float]]]]


def _machine(states: int, rule) -> Transducer:
    return Transducer([[rule(s, x) for x in range(6)] for s in range(states)])


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both machines on one input: factors multiply, bonuses add."""
    index, todo, step = {(0, 0): 0}, [(0, 0)], []
    for u, v in todo:
        row = []
        for x in range(6):
            (p, (f, g)), (q, (h, k)) = a.step[u][x], b.step[v][x]
            if (p, q) not in index:
                index[p, q] = len(todo)
                todo.append((p, q))
            row.append((index[p, q], (f * h, g + k)))
        step.append(row)
    return Transducer(step)


def grammar() -> Transducer:
    hurtful = (INSULT, THREAT)
    # an insult counts its own weight, anything else none
    insult = _machine(1, lambda s, x: (0, (1.0 if x in hurtful else 0.0, 0.0)))
    # a target raises what follows within reach
    target = _machine(REACH + 1, lambda s, x: (REACH if x == TARGET else max(s - 1, 0), (1.0 + (TARGET_BONUS if s and x in hurtful else 0.0), 0.0)))
    # a threat counts only with a target within reach, before or after
    def threat_rule(s: int, x: int):
        if x == TARGET:
            return (REACH, (1.0, THREAT_WEIGHT if s > REACH else 0.0))
        if x == THREAT:
            return (2 * REACH, (1.0, 0.0)) if s == 0 or s > REACH else (0, (1.0, THREAT_WEIGHT))
        return (0 if s in (0, 1, REACH + 1) else s - 1, (1.0, 0.0))

    threat = _machine(2 * REACH + 1, threat_rule)
    negation = _machine(REACH + 1, lambda s, x: (REACH if x == NEGATION else max(s - 1, 0), (1.0 - NEGATED if s and x in hurtful else 1.0, 0.0)))
    report = _machine(2, lambda s, x: (1 if x == REPORT else s, (1.0 - REPORTED if s and x in hurtful else 1.0, 0.0)))
    out = insult
    for m in (target, threat, negation, report):
        out = compose(out, m)
    return out


def clause_scores(text: str, lexicon: dict[str, float], machine: Transducer) -> list[float]:
    """Scores of the clauses that hold an insult or a threat."""
    low = text.lower()
    threats = {w for w, k in SYMBOLS.items() if k == THREAT}
    # most texts have no such word at all
    if not (lexicon.keys() | threats) & set(WORD.findall(low)):
        return []
    out = []
    for clause in CLAUSE.split(low):
        words = WORD.findall(clause)
        if not any(w in lexicon or w in threats for w in words):
            continue
        state, total = 0, 0.0
        for w in words:
            symbol = INSULT if w in lexicon else SYMBOLS.get(w, OTHER)
            state, (factor, bonus) = machine.step[state][symbol]
            total += factor * lexicon.get(w, 0.0) + bonus
        out.append(total)
    return out


def piecewise(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of rows of a batch with their texts, a piece at a time: strings take several times the bytes of a text."""
    for i, j, _, _ in tx.pieces(batch.column("text")):
        part = batch.slice(i, j - i)
        yield part, part.column("text").to_pylist()


def features(scores: list[float]) -> list[float]:
    return [max(scores, default=0.0), float(np.log1p(sum(scores))), float(sum(s > 1 for s in scores) > 0)]


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """text and label of distinct texts outside the held-out fold, at most ``limit`` in hash order."""
    known = labels.where(f"doc_id IS NOT NULL AND {label} IN (0, 1)").where(~held_out())
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(label).alias("label"))
    # whole texts travel only for the rows that are used
    chosen = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(limit)
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    return own.join(F.broadcast(chosen), "doc_id").withColumn("mark", F.xxhash64("text")).dropDuplicates(["mark"]).select("mark", "text", "label")


def learn_lexicon(train: DataFrame) -> dict[str, float]:
    """The words that tell toxic texts apart, with their log-odds; bounded by ``LEXICON``."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+(?:'\p{L}+)?)"), 1))
    count = train.groupBy("label").count().collect()
    size = {r.label: r["count"] for r in count}
    t, n = float(size.get(1, 0)), float(size.get(0, 0))
    if not t or not n:
        return {}
    seen = train.select("label", F.explode(words).alias("word")).groupBy("word").agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b"))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (t + 1 - a)) - F.log(b / (n + 1 - b))
    scored = seen.where(F.col("a") >= MIN_DOCS).select("word", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("z"))
    best = scored.where(f"z >= {MIN_Z} AND odds >= {MIN_ODDS}").orderBy(F.desc("z"), "word").limit(LEXICON).collect()
    return {r.word: float(r.odds) for r in best}


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 0.1) -> np.ndarray:
    """Newton's method with a small ridge; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
    return w


@dataclass
class Model:
    lexicon: dict[str, float]
    weights: np.ndarray | None


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model:
    train = training_rows(docs, labels, "toxic", limit).persist()
    lexicon = learn_lexicon(train)
    machine = grammar()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in piecewise(batch):
                cols = zip(*(features(clause_scores(t, lexicon, machine)) for t in texts))
                yield pa.record_batch([part.column("mark"), part.column("label").cast(pa.int32()), *[pa.array(c, pa.float64()) for c in cols]], names=["mark", "label", "f0", "f1", "f2"])

    # at most ``limit`` rows of three numbers
    seen = train.mapInArrow(measure, "mark bigint, label int, f0 double, f1 double, f2 double").orderBy("mark").toArrow()
    train.unpersist()
    y = seen.column("label").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return Model(lexicon, None)
    x = np.column_stack([seen.column(c).to_numpy() for c in ("f0", "f1", "f2")])
    return Model(lexicon, _logistic(x, y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, score from 0 to 1 and the number of matched clauses."""
    machine = grammar()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in piecewise(batch):
                out, matched = [], []
                for text in texts:
                    scores = clause_scores(text, model.lexicon, machine)
                    f = features(scores)
                    matched.append(len(scores) if f[0] else 0)
                    z = float(np.dot([*f, 1.0], model.weights)) if model.weights is not None else -1.0 + f[2]
                    out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))) if model.weights is not None else 0.5 * f[2])
                yield pa.record_batch([part.column("doc_id"), pa.array(out, pa.float64()), pa.array(matched, pa.int64())], names=["doc_id", "score", "n_clauses"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double, n_clauses bigint")
