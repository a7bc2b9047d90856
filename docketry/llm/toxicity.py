"""Toxicity by a weighted lexicon.

Texts are folded: lower case, compatibility forms composed, look-alike letters and digits mapped
to Latin letters, everything that is no letter a space. A lexicon of folded words with log-odds weights, and exception
phrases in which a word counts nothing, are learnt from labelled rows and matched by one
Aho-Corasick pass. The summed weight, by itself and per hundred words, gives the score through a
logistic curve.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, spare, table_rows

#: Labelled rows that a model is fitted on, at most about so many, and the longest text among them.
TRAIN_ROWS, TRAIN_CHARS = 6000, 100_000
#: Lengths of stems.
STEMS = range(4, 11)
#: Terms kept, the heaviest first. Exception phrases are all kept; the training sample bounds them.
MAX_TERMS = 2000

# Letters that look like Latin ones, and digits and signs that stand for letters.
_LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i",
}
_FOLD = str.maketrans(_LOOKALIKES | {c: None for c in "​‌‍⁠﻿­"})
# Signs that end sentences or fill tables are letters only inside a word.
_OUTER = re.compile(r"(?<![^\W_])[@$!|]+|[@$!|]+(?![^\W_])")
_REST = re.compile(r"[\W\d_]+")


def fold(text: str | None) -> str:
    """The text's folded words, with a space before and after each; one space if there are none."""
    text = (text or "").lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = _OUTER.sub(" ", text).translate(_FOLD)
    return f" {_REST.sub(' ', text).strip()} ".replace("  ", " ")


def _pattern(term: str) -> str:
    return f" {term[:-1]}" if term.endswith("*") else f" {term} "


def _forms(word: str) -> list[str]:
    """A word's possible lexicon entries: itself, and its stems marked by a star."""
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) >= k)]


@dataclass
class Model:
    """Terms are folded words, or stems that end in a star and stand for all words that begin so."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-3.0, 0.0, 0.0)

    def automaton(self):
        """Patterns with (weight, length); an exception phrase has no weight."""
        import ahocorasick

        built = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            built.add_word(_pattern(term), (weight, len(_pattern(term))))
        for phrase in self.exceptions:
            built.add_word(f" {phrase} ", (None, len(phrase) + 2))
        if len(built):
            built.make_automaton()
        return built

    def total(self, folded: str, automaton) -> float:
        """The weights of all occurrences of terms that no exception phrase covers."""
        hits, harmless = [], []
        for end, (weight, length) in automaton.iter(folded) if len(automaton) else ():
            if weight is None:
                harmless.append((end - length, end))
            else:
                hits.append((end - length, end, weight))
        return sum(w for a, b, w in hits if not any(x <= a and b <= y for x, y in harmless))

    def features(self, folded: str, automaton) -> tuple[float, float]:
        total = max(0.0, self.total(folded, automaton))
        return np.log1p(total), np.log1p(100 * total / max(1, folded.count(" ") - 1))

    def score(self, text: str | None, automaton) -> float:
        return float(_logistic(self.curve[0] + np.dot(self.curve[1:], self.features(fold(text), automaton))))


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[str | None], toxic: list[int]) -> Model:
    """Learn terms, exceptions and curve. Without rows of both labels nothing is toxic."""
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        return Model(curve=(-3.0 if not len(y) or y.max() == 0 else 3.0, 0.0, 0.0))
    folded = [fold(t) for t in texts]
    n_bad, n_good = y.sum(), (1 - y).sum()
    bad, good = Counter(), Counter()
    for text, label in zip(folded, toxic, strict=True):
        (bad if label else good).update({f for w in set(text.split()) for f in _forms(w)})
    least = max(3, 0.004 * n_bad)
    odds = {w: float(np.log((k + 0.5) / (n_bad + 1)) - np.log((good[w] + 0.5) / (n_good + 1))) for w, k in bad.items() if k >= least}
    # The best evidence first; what a chosen stem covers, or what covers a chosen term, adds nothing new.
    terms: dict[str, float] = {}
    covered: set[str] = set()

    def evidence(w: str) -> float:
        """The G statistic of having w and being toxic."""
        table = np.array([[bad[w], n_bad - bad[w]], [good[w], n_good - good[w]]], float)
        share = table * table.sum() / (table.sum(1, keepdims=True) * table.sum(0, keepdims=True))
        return float(round(2 * (table * np.log(np.where(table > 0, share, 1))).sum(), 9))

    for w, v in sorted(odds.items(), key=lambda x: (-evidence(x[0]), len(x[0]), x[0])):
        if v < 1.5 or len(terms) >= MAX_TERMS:
            continue
        stem = w.rstrip("*")
        if w in covered or any(f"{stem[:k]}*" in terms for k in STEMS if k <= len(stem)):
            continue
        terms[w] = round(v, 4)
        covered.update(_forms(stem))
    # A term next to a word that makes it harmless.
    seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for text, label in zip(folded, toxic, strict=True):
        words = text.split()
        for i, w in enumerate(words):
            if any(f in terms for f in _forms(w)):
                for phrase in {" ".join(words[max(0, i - 1) : i + 1]), " ".join(words[i : i + 2])}:
                    if " " in phrase:
                        seen[phrase][label] += 1
    exceptions = tuple(sorted(p for p, (clean, hit) in seen.items() if clean >= 8 and hit <= 0.15 * clean))
    model = Model(terms, exceptions)
    automaton = model.automaton()
    x = np.array([[1.0, *model.features(t, automaton)] for t in folded])
    w, ridge = np.zeros(3), np.diag([0.0, 0.05, 0.05])
    for _ in range(50):
        p = _logistic(x @ w)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge + 1e-9 * np.eye(3), x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(terms, exceptions, tuple(float(v) for v in w))


def train(docs: DataFrame, labels: DataFrame, rows: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAIN_ROWS) -> Model:
    """A model from labelled rows (those where `rows` holds), a hashed sample of about `most` of them.

    Rows with null ids, texts or labels, and texts over TRAIN_CHARS, are not trained on.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    if rows is not None:
        known = known.where(rows)
    known = table_rows(known, F.col("id"), most, known.count())
    sample = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") <= TRAIN_CHARS)
    found = sorted(((r["id"], r["text"], r["y"]) for r in sample.join(F.broadcast(known), "id").toLocalIterator()), key=lambda r: (r[0], r[1], r[2]))
    return fit([t for _, t, _ in found], [int(y > 0) for _, _, y in found])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): a row per row of docs; null texts score as empty ones, null ids stay null, other columns are not read."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            scores = [model.score(t, automaton) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(each, "doc_id long, score double")


def clean(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold.

    Null texts score as empty ones; equal texts go or stay together; ids are not read.
    """
    import pandas as pd

    def score(batches):
        automaton = model.automaton()
        for texts in batches:
            yield pd.Series([model.score(t, automaton) for t in texts], dtype="float64")

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    small_batches(docs.sparkSession)
    name = spare(docs, "toxicity")
    return docs.withColumn(name, F.pandas_udf(score, "double")(F.col(text_col).cast("string"))).where(F.col(name) < threshold).select(*docs.columns)
