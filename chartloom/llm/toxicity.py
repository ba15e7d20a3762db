"""Toxicity by a weighted finite-state grammar over clauses.

Words are mapped to classes (insult, threat, target, negation, reported speech, other) and a clause, the
words between punctuation marks or line ends, runs through a product of small transducers:

* target:   an address or person near a hit (three words on either side) raises its weight;
* negation: a hit within three words after a negation counts little;
* reported: in the rest of a clause after a verb of speech, and in quotes, a hit counts half.

A hit's weight is the lexicon's times the factors of the state it is met in, so it is the clause that is
scored and not the isolated word. The row's features are the sum of its clause scores, the best clause
and the share of clauses with a hit; a logistic model makes them a score.

The lexicon is learned from labels: words and word beginnings of 4 to 6 letters that are at least
`LIFT` times as frequent among toxic rows, with weight log odds, beside a few fixed seed words. It and
the logistic model are fitted on a bounded sample of labelled rows: per label the `SAMPLE_ROWS` rows with
the smallest hash. Scoring reads every whole text.

Defined results: null, empty and unmatched texts get the score of a row without hits; labels that are
null, or of unknown rows, teach nothing; without both kinds of labels only the seed words are known and
the logistic model is the fixed prior.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chartloom.llm.anchors import wrap
from chartloom.llm.store import claim_worker, stage

SAMPLE_ROWS = 6_000
TERMS = 5_000
LIFT = 8.0
LEAST_ROWS = 4
HEADS = (4, 5, 6)
THRESHOLD = 0.7
PRIOR = (-4.0, 2.0, 1.0, 1.0)
KNOWN_WORDS = 150_000

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
SEEDS = {
    INSULT: "idiot idiots moron stupid scum worthless loser trash pathetic disgusting",
    THREAT: "kill hurt destroy beat punish burn",
    TARGET: "you your yours he she they him her them people everyone du dich dir ihr sie tu te toi vous tú ti usted ustedes",
    NEGATION: "not no never none isn't aren't don't nicht kein keine nie ne pas jamais nunca jamás",
    REPORT: "said says say wrote writes called calls quoted quotes claimed sagte sagt schrieb dit disait dijo dice",
}
SEED_WEIGHT = 3.0
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
CLAUSE = re.compile(r"[.!?;:,\n]+")
QUOTES = re.compile(r"[\"“”„«»]")


class Transducer:
    """States 0..n-1; (state, class) -> next state; `factor[state]` multiplies a hit met in that state."""

    def __init__(self, states: int, moves: dict[tuple[int, int], int], default: dict[int, int], factor: list[float]):
        self.states, self.factor = states, factor
        self.next = [[moves.get((s, c), default[s]) for c in range(6)] for s in range(states)]

    def compose(self, other: Transducer) -> Transducer:
        """Both at once: a state is a pair, factors multiply."""
        out = Transducer(0, {}, {}, [])
        out.states = self.states * other.states
        out.factor = [a * b for a in self.factor for b in other.factor]
        out.next = [[self.next[a][c] * other.states + other.next[b][c] for c in range(6)]
                    for a in range(self.states) for b in range(other.states)]
        return out


def _window(trigger: int, inside: float) -> Transducer:
    """`inside` for the three words after a word of class `trigger`."""
    return Transducer(4, {(s, trigger): 3 for s in range(4)}, {0: 0, 1: 0, 2: 1, 3: 2}, [1.0, inside, inside, inside])


TARGETED = _window(TARGET, 1.5)
NEGATED = _window(NEGATION, 0.1)
REPORTED = Transducer(2, {(0, REPORT): 1}, {0: 0, 1: 1}, [1.0, 0.5])
GRAMMAR = TARGETED.compose(NEGATED).compose(REPORTED)
UNTARGETED = NEGATED.states * REPORTED.states        # states below this have no target in reach


class Lexicon(dict):
    """word -> (class, weight), looked up by the word and its beginnings; a bounded table of words seen."""

    def __init__(self, terms: dict[str, float]):
        super().__init__()
        self.terms = terms
        self.seeds = {w: (kind, SEED_WEIGHT if kind in (INSULT, THREAT) else 0.0) for kind, ws in SEEDS.items() for w in ws.split()}

    def __missing__(self, word: str) -> tuple[int, float]:
        terms = self.terms
        weight = max([terms.get(word, 0.0), *(terms.get(word[:n] + "*", 0.0) for n in HEADS if len(word) >= n)])
        kind, seed = self.seeds.get(word, (OTHER, 0.0))
        if weight > seed and kind in (OTHER, INSULT, THREAT):
            kind, seed = (kind or INSULT), weight
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = kind, seed
        return self[word]


def clause_score(classes: list[tuple[int, float]], quoted: bool) -> float:
    """Weight of one clause's hits, each times the factor of the grammar's state it is met in.

    A target may also follow: where the forward run has none in reach, the backward run's factor counts.
    """
    behind, state = [], 0
    for kind, _ in reversed(classes):
        behind.append(TARGETED.factor[state])
        state = TARGETED.next[state][kind]
    total, state = 0.0, 0
    for (kind, weight), after in zip(classes, reversed(behind)):
        if weight:
            total += weight * GRAMMAR.factor[state] * (after if state < UNTARGETED else 1.0)
        state = GRAMMAR.next[state][kind]
    return total * (0.5 if quoted else 1.0)


def features(text: str | None, lexicon: Lexicon) -> tuple[float, float, float]:
    """(log of 1 + all clause scores, log of 1 + the best, share of clauses with a hit)."""
    if not text:
        return 0.0, 0.0, 0.0
    lowered = text.lower()
    if not any(lexicon[w][1] for w in set(WORD.findall(lowered))):
        return 0.0, 0.0, 0.0
    total = best = 0.0
    hits = clauses = 0
    quoted = False
    for clause in CLAUSE.split(lowered):
        marks = len(QUOTES.findall(clause))
        words = WORD.findall(clause)
        if words:
            clauses += 1
            classes = [lexicon[w] for w in words]
            if any(w for _, w in classes):
                score = clause_score(classes, quoted or marks >= 2)
                total, best, hits = total + score, max(best, score), hits + (score > 0)
        quoted ^= bool(marks & 1)
    return float(np.log1p(total)), float(np.log1p(best)), hits / max(1, clauses)


def sample_labels(labels: DataFrame, id_col: str, label: str, train: Column) -> DataFrame:
    """(id, label 0 or 1): at most SAMPLE_ROWS ids of each label, those with the smallest hash."""
    known = (labels.where(train).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label"))
             .where("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.max("label").alias("label")))
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    return known.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE_ROWS).select("id", "label")


def _terms_of(batches):
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            words = set(WORD.findall((text or "").lower()))
            for term in words | {w[:n] + "*" for w in words for n in HEADS if len(w) > n}:
                counts.setdefault(term, [0, 0])[label] += 1
        yield pa.RecordBatch.from_pydict({"term": list(counts), "clean": [c[0] for c in counts.values()],
                                          "toxic": [c[1] for c in counts.values()]},
                                         schema=pa.schema([("term", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())]))


class Model:
    def __init__(self, terms: dict[str, float], weights: tuple[float, ...]):
        self.terms, self.weights = terms, weights

    def score(self, x) -> float:
        z = self.weights[0] + sum(w * v for w, v in zip(self.weights[1:], x))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, ...]:
    """Newton's method with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def learn(df: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", label: str = "toxic",
          text: str = "text") -> Model:
    """Lexicon and logistic model from the labels where `train` holds."""
    # at most 2 * SAMPLE_ROWS ids: small enough to be sent everywhere
    picked = sample_labels(labels, id_col, label, train)
    rows = stage(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
                 .join(F.broadcast(picked), "id").select("text", "label"), "toxicity")
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model({}, PRIOR)
    counted = rows.mapInArrow(_terms_of, "term string, clean long, toxic long").groupBy("term").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("toxic") >= LEAST_ROWS)
    lift = ((F.col("toxic") + 1) / (sizes[1] + 2)) / ((F.col("clean") + 1) / (sizes[0] + 2))
    top = (counted.withColumn("lift", lift).where(F.col("lift") >= LIFT)
           .orderBy(F.desc(F.col("toxic") * F.log("lift")), "term").limit(TERMS).collect())
    terms = {r.term: float(np.log(r.lift)) for r in top}

    def measure(batches):
        claim_worker("lexicon", _lexicon.cache_clear)
        lexicon = _lexicon(tuple(sorted(terms.items())))
        for batch in batches:
            found = [features(t, lexicon) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), *(pa.array([f[i] for f in found], pa.float64()) for i in range(3))],
                                             names=["label", "a", "b", "c"])

    seen = np.array(sorted(tuple(r) for r in rows.mapInArrow(measure, "label int, a double, b double, c double").collect()))
    return Model(terms, logistic(seen[:, 1:], seen[:, 0]))


@lru_cache(maxsize=4)
def _lexicon(terms: tuple[tuple[str, float], ...]) -> Lexicon:
    return Lexicon(dict(terms))


def score_texts(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """text, rest (struct of the other columns), score, predicted."""
    wrapped = wrap(df, text)
    schema = T.StructType([*wrapped.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    arrow, terms = to_arrow_schema(schema), tuple(sorted(model.terms.items()))

    def run(batches):
        claim_worker("lexicon", _lexicon.cache_clear)
        lexicon = _lexicon(terms)
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                scores = [model.score(features(t, lexicon)) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("text"), batch.column("rest").cast(arrow.field("rest").type), pa.array(scores, pa.float64()),
                     pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], schema=arrow)

    return wrapped.mapInArrow(run, schema)
