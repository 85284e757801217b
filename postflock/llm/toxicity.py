"""Toxicity of texts: a lexicon learned from labelled documents, found also where terms are misspelled.

1. From a bounded sample of labelled documents, words and word beginnings (stems) are weighted by how much
   more often they occur in toxic documents (lower bound of the log-odds). The clear ones are the lexicon: chance
   alone would bring about one term at most among all that were looked at.
2. The Levenshtein automaton is intersected with the lexicon's trie: a state of the product is the set of trie nodes
   that a word's letters so far can have reached, each with the fewest edits. States and steps are made as words
   meet them and kept, so words share what they have in common, and a word ends where its state dies. How many edits
   a term bears: none below five letters and for stems, one below eight letters, two from there on, however rare
   the term is.
3. A found term counts with its weight, less by the edits needed, and less where the words around it show
   that it is quoted: quotation marks that enclose it, words of reporting in front of it.
4. A logistic curve, fitted on other labelled documents than the lexicon, turns the sums into 0 to 1.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from postflock.llm.common import bound_batches, remainder, stored, texts

HELD_OUT = 2
LEXICON_FOLDS = (0, 1)
LABELLED_ROWS = 20_000
LEAST_WEIGHT = 1.5
LEAST_DOCUMENTS = 3
STEM_LETTERS = (4, 5, 6, 7, 8)
THRESHOLD = 0.3
EDIT_FACTOR = 0.5
QUOTED_FACTOR = 0.4
REPORTED_FACTOR = 0.7
CONTEXT = 80
CACHED_WORDS = 500_000
COUNTED_TERMS = 500_000
KEPT_STATES = 200_000

WORD = re.compile(r"\w+")
#: Words of reporting or mention, in the four languages of the corpus.
REPORTING = re.compile(
    r"\b(said|says|wrote|called|calls|quote|quoted|word|term|insult|sagte|sagt|schrieb|nannte|wort|"
    r"dit|écrit|appelé|mot|terme|dijo|dice|escribió|llamó|palabra|término)\b", re.IGNORECASE)
PAIRED_MARKS = ("“”", "«»", "„“", "‘’")


@dataclass(frozen=True)
class Term:
    text: str
    weight: float
    stem: bool = False

    @property
    def edits(self) -> int:
        """Edits at which a whole word still counts, however rare it is; stems must stand as they are."""
        if self.stem or len(self.text) < 5:
            return 0
        return 1 if len(self.text) < 8 else 2


@dataclass
class _Node:
    next: dict[str, _Node] = field(default_factory=dict)
    word: float = 0.0
    stem: float = 0.0


class Product:
    """Levenshtein automaton and trie of the terms that bear edits, intersected. A state is a set of (node, edits),
    the fewest edits for each node; from there a letter of the word leads to the child of that letter, with one edit
    more to any child (another letter) or to the node itself (a letter too many), and with one edit more without a
    letter read to any child (a letter too few). A node is only kept while a term below it bears so many edits.
    States are made when a word first comes to them; beyond KEPT_STATES all are made anew, which costs time only."""

    def __init__(self, terms: list[Term]) -> None:
        self._children: list[dict[str, int]] = [{}]
        self._ends: list[tuple[float, int]] = [(0.0, -1)]
        self._bears = [0]
        for term in terms:
            node = 0
            self._bears[0] = max(self._bears[0], term.edits)
            for letter in term.text:
                if letter not in self._children[node]:
                    self._children[node][letter] = len(self._children)
                    self._children.append({})
                    self._ends.append((0.0, -1))
                    self._bears.append(0)
                node = self._children[node][letter]
                self._bears[node] = max(self._bears[node], term.edits)
            self._ends[node] = max(self._ends[node], (term.weight, term.edits))
        self._reset()

    def _reset(self) -> None:
        self._states: list[tuple[tuple[int, int], ...]] = []
        self._ids: dict[tuple[tuple[int, int], ...], int] = {}
        self._steps: list[dict[str, int]] = []
        self._values: list[float] = []
        self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        """The state of these nodes and of those that missing letters lead to; -1 if there is none."""
        work = list(reached.items())
        for node, edits in work:
            if reached[node] == edits:
                for child in self._children[node].values():
                    if edits < self._bears[child] and edits + 1 < reached.get(child, self._bears[child] + 1):
                        reached[child] = edits + 1
                        work.append((child, edits + 1))
        if not reached:
            return -1
        key = tuple(sorted(reached.items()))
        if key not in self._ids:
            self._ids[key] = len(self._states)
            self._states.append(key)
            self._steps.append({})
            self._values.append(max([0.0, *(self._ends[n][0] * EDIT_FACTOR ** e for n, e in key if e <= self._ends[n][1])]))
        return self._ids[key]

    def _step(self, state: int, letter: str) -> int:
        reached: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self._bears[node] and edits < reached.get(node, edits + 1):
                reached[node] = edits

        for node, edits in self._states[state]:
            reach(node, edits + 1)
            for own, child in self._children[node].items():
                reach(child, edits if own == letter else edits + 1)
        after = self._state(reached)
        self._steps[state][letter] = after
        return after

    def weight(self, word: str) -> float:
        """The largest weight of a term within its edits of the word, less by EDIT_FACTOR for each edit; 0 for none."""
        if len(self._states) > KEPT_STATES:
            self._reset()
        state, steps = 0, self._steps
        for letter in word:
            after = steps[state].get(letter)
            if after is None:
                after = self._step(state, letter)
            if after < 0:
                return 0.0
            state = after
        return self._values[state]


class Matcher:
    """Weights of words by the lexicon; (exact weight, weight with edits), or None."""

    def __init__(self, terms: list[Term]) -> None:
        self._root = _Node()
        for term in terms:
            node = self._root
            for letter in term.text:
                node = node.next.setdefault(letter, _Node())
            if term.stem:
                node.stem = max(node.stem, term.weight)
            else:
                node.word = max(node.word, term.weight)
        self._near = Product([t for t in terms if t.edits])

    def _exact(self, word: str) -> float:
        node, stem = self._root, 0.0
        for letter in word:
            if (node := node.next.get(letter)) is None:
                return stem
            stem = max(stem, node.stem)
        return max(stem, node.word)

    def weights(self, word: str) -> tuple[float, float] | None:
        if exact := self._exact(word):
            return exact, 0.0
        near = self._near.weight(word)
        return (0.0, near) if near else None


def reduced(terms: list[Term]) -> list[Term]:
    """Without stems for which one word or one longer stem stands as well, and without longer stems and short
    words that a stem covers. Words that may be misspelled all stay: a stem has no edits."""
    words = {t.text: t for t in terms if not t.stem}
    stems: dict[str, Term] = {}
    for t in sorted((t for t in terms if t.stem), key=lambda t: (len(t.text), t.text)):
        if any(o.text != t.text and o.text.startswith(t.text) and o.weight >= t.weight - 0.1 or
               o.text == t.text and not o.stem and o.weight >= t.weight - 0.1 for o in terms):
            continue
        if not any(t.text.startswith(s) and v.weight >= t.weight - 0.5 for s, v in stems.items()):
            stems[t.text] = t
    kept = [t for w, t in words.items()
            if t.edits or not any(w.startswith(s) and v.weight >= t.weight - 0.5 for s, v in stems.items())]
    return sorted([*kept, *stems.values()], key=lambda t: (t.text, t.stem))


def quotation(text: str, start: int, end: int) -> float:
    """What is left of a term's weight in its context: 1 in plain speech."""
    left, right = text[max(0, start - CONTEXT):start], text[end:end + CONTEXT]
    factor = 1.0
    if (left.count('"') % 2 and '"' in right) or any(
        left.rfind(a) > left.rfind(b) and b in right for a, b in PAIRED_MARKS
    ):
        factor *= QUOTED_FACTOR
    if REPORTING.search(left[-CONTEXT // 2:]):
        factor *= REPORTED_FACTOR
    return factor


class Scorer:
    """Features of a text, and its score by the fitted curve."""

    def __init__(self, terms: list[Term], curve: list[float] | None = None) -> None:
        self._matcher = Matcher(terms)
        self._curve = np.array(curve) if curve else None
        self._known: dict[str, tuple[float, float] | None] = {}

    def _weights(self, word: str) -> tuple[float, float] | None:
        found = self._matcher.weights(word)
        if len(self._known) < CACHED_WORDS:
            self._known[word] = found
        return found

    def features(self, text: str) -> tuple[float, float, float, float]:
        """(strongest term, log of 1 + all weights, the same per 100 words, strongest misspelled term)."""
        low = text.lower()
        known = self._known
        words = WORD.findall(low)
        hits = {}
        for word in words:
            try:
                found = known[word]
            except KeyError:
                found = self._weights(word)
            if found is not None:
                hits[word] = found
        most = total = near = 0.0
        if hits:
            for m in WORD.finditer(low):
                if m.group() in hits:
                    exact, edited = hits[m.group()]
                    factor = quotation(low, m.start(), m.end())
                    most, near = max(most, exact * factor), max(near, edited * factor)
                    total += (exact + edited) * factor
        return most, math.log1p(total), math.log1p(100 * total / max(100, len(words))), near

    def score(self, text: str) -> float:
        z = self._curve[0] + float(np.dot(self._curve[1:], self.features(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


@functools.lru_cache(maxsize=2)
def _scorer(terms: tuple[Term, ...], curve: tuple[float, ...]) -> Scorer:
    """One per Python worker: its known words serve all tasks that the worker runs."""
    return Scorer(list(terms), list(curve))


@dataclass(frozen=True)
class Model:
    terms: list[Term]
    curve: list[float]


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic, fold) of at most ``rows`` labelled documents, chosen by hash, none of the held-out part."""
    known = (
        labels.filter("doc_id is not null and toxic is not null")
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .withColumn("fold", remainder(F.col("doc_id"), 4)).filter(F.col("fold") != HELD_OUT)
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    joined = texts(docs).join(F.broadcast(known), "doc_id")
    return stored(joined.select("text", "toxic", "fold"), "toxicity-sample")


def _count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts, given out whenever COUNTED_TERMS different terms have come together."""
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def partial() -> pd.DataFrame:
        keys = counts[0].keys() | counts[1].keys()
        out = [(t, s, counts[1][t, s], counts[0][t, s]) for t, s in keys]
        counts[0].clear()
        counts[1].clear()
        return pd.DataFrame(out, columns=["term", "stem", "toxic", "clean"])

    for rows in batches:
        for text, toxic in zip(rows.text, rows.toxic):
            words = set(WORD.findall(text.lower()))
            stems = {(w[:n], True) for w in words for n in STEM_LETTERS if len(w) > n}
            counts[int(toxic > 0)].update(stems | {(w, False) for w in words})
            if len(counts[0]) + len(counts[1]) > COUNTED_TERMS:
                yield partial()
    yield partial()


def learn_lexicon(sample: DataFrame) -> list[Term]:
    """All terms whose lower bound of log-odds is ``LEAST_WEIGHT`` or more and whose share of toxic documents is beyond
    chance: by Chernoff's bound a term that is as frequent in both kinds would come so far with a probability below
    one over the number of terms looked at. Their number is bounded by the sample's."""
    sizes = sample.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()
    size = {bool(r["toxic"]): r["count"] for r in sizes}
    if not size.get(True) or not size.get(False):
        return []
    counted = stored(
        sample.select("text", "toxic").mapInPandas(_count_terms, "term string, stem boolean, toxic long, clean long")
        .groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter(F.col("toxic") >= LEAST_DOCUMENTS), "toxicity-terms")
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    weight = F.log(a / (size[True] + 1)) - F.log(b / (size[False] + 1)) - 1.64 * F.sqrt(1 / a + 1 / b)
    share, usual = F.col("toxic") / (F.col("toxic") + F.col("clean")), size[True] / (size[True] + size[False])
    clean = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - usual))).otherwise(0.0)
    surprise = (F.col("toxic") + F.col("clean")) * (share * F.log(share / usual) + clean)
    best = counted.withColumn("weight", weight).filter(
        (F.col("weight") >= LEAST_WEIGHT) & (share > usual) & (surprise >= math.log(max(1, counted.count()))))
    return reduced([Term(r["term"], round(r["weight"], 6), r["stem"]) for r in best.orderBy("term", "stem").collect()])


def _fitted(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag([1e-3, *[ridge] * (x.shape[1] - 1)])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> list[float]:
    """Logistic regression by Newton's method, intercept first and free of the ridge. No feature may speak for a text:
    one whose weight would be negative is left out, and the rest are fitted again."""
    used = list(range(x.shape[1] if x.ndim == 2 else 4))
    if not y.size:
        return [-2.0, *[0.0] * len(used)]
    while True:
        w = _fitted(x[:, used], y, ridge, rounds)
        if not used or w[1:].min() >= 0:
            break
        used.pop(int(w[1:].argmin()))
    whole = np.zeros(1 + x.shape[1])
    whole[[0, *(i + 1 for i in used)]] = w
    return [float(v) for v in whole]


def train(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Model:
    """Learns from ``labels(doc_id, toxic)`` and the texts they name. Only features of the sample (four
    numbers a row, at most ``rows`` rows) and the lexicon come to the driver. Without labels of both kinds
    the lexicon is empty and every text gets the same low score."""
    bound_batches(docs.sparkSession)
    sample = _sample(docs, labels, rows)
    terms = learn_lexicon(sample.filter(F.col("fold").isin(*LEXICON_FOLDS)))

    @F.pandas_udf("array<double>")
    def features(batch: pd.Series) -> pd.Series:
        return batch.map(_scorer(tuple(terms), ()).features)

    rest = sample.filter(~F.col("fold").isin(*LEXICON_FOLDS)).select(features("text").alias("x"), "toxic").collect()
    x = np.array([r["x"] for r in rest]).reshape(-1, 4)
    return Model(terms, fit_curve(x, np.array([float(r["toxic"] > 0) for r in rest])))


def score(text: Column | str, model: Model) -> Column:
    """0 to 1 for a text; an empty or null text scores as one without any term."""
    terms, curve = tuple(model.terms), tuple(model.curve)

    @F.pandas_udf("double")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(_scorer(terms, curve).score).astype("float64")

    return run(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``. Null and empty texts score as texts without any term; repeated rows and null ids are
    kept, each with its score; other columns are not read; an empty table gives no rows."""
    scored = docs.select("doc_id", score("text", train(docs, labels)).alias("score"))
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), 4) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with all their columns as they are, whatever their names.
    Null and empty texts have no term and stay unless the labels say that most texts are toxic; repeated rows fare
    alike; rows without an id are judged like others; an empty table stays empty."""
    return docs.filter(score("text", train(docs, labels)) < THRESHOLD)
