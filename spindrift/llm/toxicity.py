"""Operator 10: toxicity by a weighted finite-state grammar over clauses.

A clause (text between punctuation or line ends) is read as a string of word classes: insult, threat,
intent, target, negation, report, other. Six weighted transducers are composed into one automaton that
reads it from left to right; the weight of a path is the product of its arcs':

* insult: an insult matches, further ones of the clause count less;
* threat: a threat matches fully after a word of intent, weakly without one;
* target: a match after a target counts more;
* negation: the next match after a negation counts little;
* report: matches after a verb of report count less, to the clause's end;
* the transducer of later targets, which reads the clause from right to left before the others and
  marks matches that a target follows: they count more, too.

A clause's score is the sum over its matches of the word's weight times the path's weight there. A text
is scored by its clauses: their sum, the heaviest, how many match, what share of all, and the text's
length, through a logistic function.

A word's weight as an insult comes from labelled texts: the lower bound of the log odds of a word form,
or a word beginning, standing in a toxic text; the forms make a trie that a word's letters walk. Words of
the other classes are the fixed lists below. Forms and logistic weights are learned from at most
`SAMPLE_ROWS` rows of labelled documents, the first in order of a hash, and at most `MOST_FORMS` forms.

Null and empty texts score as a text without matches. With no label of either kind every score is 0. Of
several labels of one document the highest counts. Rows with one id are scored each on their own; a text
of any length is read whole. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import fold, held, pinned, release, slices, table

SAMPLE_ROWS = 20_000
SHORTEST, LONGEST = 3, 8
MOST_FORMS = 30_000
#: Lower bound of the log odds, at so many standard errors, from which a form is an insult.
LEAST_ODDS, ERRORS = 0.7, 2.5
HELD_WORDS = 500_000

# Word classes that are not learned, and their weights as matches where they are any.
THREATS = (
    "kill hurt destroy beat burn shoot stab crush smash strangle hang punish ruin hunt murder attack "
    "töten umbringen schlagen vernichten verletzen erschießen verbrennen erwürgen jagen "
    "tuer frapper détruire brûler blesser écraser étrangler abattre massacrer "
    "matar golpear destruir quemar herir aplastar estrangular disparar"
).split()
INTENTS = "will gonna shall must should going let werde werden wird will soll sollte muss vais va vont veux faut dois voy vas van quiero debe hay".split()
TARGETS = (
    "you your yours yourself u ur he she they them him her his their "
    "du dich dir dein deine ihr euch euer sie ihm ihn ihnen "
    "tu toi te ton ta tes vous votre vos ils elle elles lui leur "
    "tú ti tus vosotros usted ustedes ellos ella ellas él"
).split()
NEGATIONS = "not never no none nor neither without isn't aren't don't won't nicht nie niemals kein keine keinen ohne weder ne pas jamais aucun aucune sans ni nunca jamás ningún ninguna sin tampoco".split()
REPORTS = (
    "said says say wrote writes quoted claimed claims called stated reported according "
    "sagte sagt schrieb schreibt behauptete behauptet nannte laut meinte "
    "dit disait écrit prétend affirme appelé selon déclare "
    "dijo dice escribió escribe afirma afirmó llamó según"
).split()
THREAT_WEIGHT = 2.0

WORD = re.compile(r"[^\W\d_]+(?:'t)?")
CLAUSE = re.compile(r"[.!?;:,|\n]+")

OTHER, TARGET, NEGATION, REPORT, INTENT, THREAT, INSULT = "o", "u", "n", "r", "w", "t", "i"
#: A match that a target follows, and one that a transducer has already taken as such.
FOLLOWED = "+"
MATCH = "m"
CLASSES = {w: c for c, words in ((INTENT, INTENTS), (THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}

# Weights of arcs.
AGAIN, WITHOUT_INTENT, TARGETED, TARGET_FOLLOWS, NEGATED, REPORTED = 0.6, 0.5, 1.5, 1.3, 0.2, 0.4


class Transducer:
    """Deterministic and weighted: (state, symbol) to (next state, symbol out, weight); other symbols pass
    unchanged, with weight 1. State 0 is the first."""

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, str, float]], states: int) -> None:
        self.arcs, self.states = arcs, states

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol)) or (state, symbol, 1.0)

    def then(self, other: Transducer, alphabet: list[str]) -> Transducer:
        """Composition: this one's output is the other's input, weights multiply; states are pairs."""
        arcs = {}
        for (a, b), symbol in product(product(range(self.states), range(other.states)), alphabet):
            a2, middle, x = self.step(a, symbol)
            b2, out, y = other.step(b, middle)
            arcs[a * other.states + b, symbol] = a2 * other.states + b2, out, x * y
        return Transducer(arcs, self.states * other.states)


HITS = (INSULT, THREAT, INSULT + FOLLOWED, THREAT + FOLLOWED)


def later_targets() -> Transducer:
    """Reads a clause from its end: matches met after a target become FOLLOWED."""
    return Transducer({(0, TARGET): (1, TARGET, 1.0)} | {(1, h): (1, h + FOLLOWED, 1.0) for h in (INSULT, THREAT)}, 2)


def insults() -> Transducer:
    first = {(0, INSULT): (1, MATCH, 1.0), (0, INSULT + FOLLOWED): (1, MATCH, TARGET_FOLLOWS)}
    return Transducer(first | {(1, INSULT): (1, MATCH, AGAIN), (1, INSULT + FOLLOWED): (1, MATCH, AGAIN * TARGET_FOLLOWS)}, 2)


def threats() -> Transducer:
    arcs = {(0, INTENT): (1, OTHER, 1.0), (1, INTENT): (1, OTHER, 1.0)}
    for state, weight in ((0, WITHOUT_INTENT), (1, 1.0)):
        arcs |= {(state, THREAT): (state, MATCH, weight), (state, THREAT + FOLLOWED): (state, MATCH, weight * TARGET_FOLLOWS)}
    return Transducer(arcs, 2)


def targets() -> Transducer:
    return Transducer({(0, TARGET): (1, OTHER, 1.0), (1, TARGET): (1, OTHER, 1.0), (1, MATCH): (1, MATCH, TARGETED)}, 2)


def negations() -> Transducer:
    return Transducer({(0, NEGATION): (1, OTHER, 1.0), (1, NEGATION): (1, OTHER, 1.0), (1, MATCH): (0, MATCH, NEGATED)}, 2)


def reports() -> Transducer:
    return Transducer({(0, REPORT): (1, OTHER, 1.0), (1, REPORT): (1, OTHER, 1.0), (1, MATCH): (1, MATCH, REPORTED)}, 2)


def grammar() -> Transducer:
    """What reads a clause from left to right: all but `later_targets`."""
    alphabet = [OTHER, TARGET, NEGATION, REPORT, INTENT, *HITS]
    return insults().then(threats(), alphabet).then(targets(), alphabet).then(negations(), alphabet).then(reports(), alphabet)


FEATURES = 6


def forms(word: str) -> list[str]:
    """A word's beginnings and, with an end mark, the word."""
    return [word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1)] + [word + "$"]


class Lexicon(dict):
    """Maps a word to (class, weight): the heaviest form on its way through the trie of forms."""

    def __init__(self, odds: dict[str, float]) -> None:
        self.trie: dict = {}
        for form, weight in odds.items():
            node = self.trie
            for c in form:
                node = node.setdefault(c, {})
            node["weight"] = weight
        self.run, self.backward = grammar(), later_targets()

    def __missing__(self, word: str) -> tuple[str, float]:
        node, weight = self.trie, 0.0
        for c in word + "$":
            node = node.get(c)
            if node is None:
                break
            weight = max(weight, node.get("weight", 0.0))
        own = CLASSES.get(word, OTHER)
        found = (INSULT, weight) if weight else (own, THREAT_WEIGHT if own == THREAT else 0.0)
        if len(self) > HELD_WORDS:
            self.clear()
        self[word] = found
        return found

    def clause(self, words: list[str]) -> tuple[float, int]:
        """Score and matches of a clause."""
        read = [x for x in map(self.__getitem__, words) if x[0] != OTHER]
        if not any(x[1] for x in read):
            return 0.0, 0
        state, marked = 0, []
        for symbol, weight in reversed(read):
            state, out, _ = self.backward.step(state, symbol)
            marked.append((out, weight))
        state, total, matches = 0, 0.0, 0
        for symbol, weight in reversed(marked):
            state, out, path = self.run.step(state, symbol)
            if out == MATCH:
                total += weight * path
                matches += 1
        return total, matches

    def features(self, text: str | None) -> list[float]:
        """Clauses' sum, the heaviest, how many match, their share, words, and a constant."""
        lower = (text or "").lower()
        words = WORD.findall(lower)
        total, heaviest, matched, clauses = 0.0, 0.0, 0, 0
        lookup = self.__getitem__
        if any([lookup(w)[1] for w in set(words)]):
            for clause in CLAUSE.split(lower):
                own = WORD.findall(clause)
                clauses += bool(own)
                score, matches = self.clause(own)
                total, heaviest, matched = total + score, max(heaviest, score), matched + (matches > 0)
        return [math.log1p(total), math.log1p(heaviest), math.log1p(matched), matched / max(1, clauses), math.log1p(len(words)), 1.0]


class Model:
    def __init__(self, odds: dict[str, float], weights: np.ndarray | None) -> None:
        self.odds, self.weights, self.key = odds, weights, uuid.uuid4().hex


def _form_counts(texts: DataFrame, wanted: set[str] | None) -> DataFrame:
    """form, n: in how many texts a form stands; only those in `wanted`, if given."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, found = shared.value, Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                own = {f for w in set(WORD.findall((text or "").lower())) for f in forms(w)}
                found.update(own if wanted is None else own & wanted)
            if len(found) > 1_000_000:
                yield pa.RecordBatch.from_pydict({"form": list(found), "n": list(found.values())})
                found.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["form", "n"])

    return texts.select("text").mapInArrow(count, "form string, n long").groupBy("form").agg(F.sum("n").alias("n"))


def _featured(rows: DataFrame, odds: dict[str, float], key: str, keep: list[str]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((key, odds))
    kept = rows.select(*keep, F.col("text").alias("__text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, odds = shared.value
        lexicon: Lexicon = held(("lexicon", key), lambda: Lexicon(odds))
        for batch in batches:
            for part in slices(batch, "__text", most=8 << 20):
                rows = [lexicon.features(x) for x in part.column("__text").to_pylist()]
                yield part.drop_columns(["__text"]).append_column("features", pa.array(rows, pa.list_(pa.float64())))

    fields = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes if n != "__text")
    return kept.mapInArrow(extract, f"{fields}, features array<double>")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton's method; the last column is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """From at most `sample_rows` labelled documents; of several labels of one document the highest."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = pinned(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    # A broadcast of at most `sample_rows` rows: the texts need no shuffle.
    sample = documents.select("doc_id", "text").join(F.broadcast(first), "doc_id").withColumn("key", F.struct(F.xxhash64("doc_id").alias("a"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("b")))
    # An id may have several rows: the bound holds for rows, of which equal ones count once. Only keys are ordered.
    last = sample.select("key").distinct().orderBy("key").limit(sample_rows).agg(F.max("key").alias("key")).first().key
    if last is not None:
        sample = sample.where(F.col("key") <= F.struct(*[F.lit(x).cast("long").alias(name) for name, x in last.asDict().items()]))
    sample = pinned(sample.groupBy("key", "toxic").agg(F.first("text").alias("text")).select("text", "toxic"))
    toxic, clean = sample.where("toxic = 1"), sample.where("toxic = 0")
    n_toxic, n_clean = toxic.count(), clean.count()
    if not n_toxic or not n_clean:
        return Model({}, None)
    common = _form_counts(toxic, None).where(F.col("n") >= max(3, math.ceil(0.0015 * n_toxic)))
    in_toxic = {r.form: r.n for r in common.orderBy(F.desc("n"), "form").limit(MOST_FORMS).collect()}
    in_clean = {r.form: r.n for r in _form_counts(clean, set(in_toxic)).collect()}
    odds = {}
    for form, a in in_toxic.items():
        c = in_clean.get(form, 0)
        rate = math.log((a + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
        low = rate - ERRORS * math.sqrt(1 / (a + 0.5) + 1 / (c + 0.5))
        if low > LEAST_ODDS:
            odds[form] = low
    model = Model(odds, None)
    rows = _featured(sample, odds, model.key, ["toxic"]).collect()  # FEATURES numbers a row
    release(first, sample)
    model.weights = fit_logistic(np.asarray([r.features for r in rows]), np.asarray([float(r.toxic) for r in rows]))
    return model


def score(documents: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and score, in [0, 1]."""
    found = _featured(documents, model.odds, model.key, list(keep))
    if model.weights is None:
        return found.select(*keep, F.lit(0.0).alias("score"))
    z = sum(F.col("features")[i] * F.lit(float(w)) for i, w in enumerate(model.weights))
    return found.select(*keep, (1 / (1 + F.exp(-z))).alias("score"))


def held_out(modulus: int = 5, remainder: int = 0) -> Column:
    return fold(modulus) == remainder


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", held_out().alias("held_out"))
    model = learn(documents, table(spark, sf_dir, "labels").where(~held_out()))
    return score(documents, model, ("doc_id", "held_out")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
