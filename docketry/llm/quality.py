"""Quality by a sparse rule ensemble.

Shallow trees are grown on resampled labelled rows over statistics of the texts. Every path from
a root is a rule, a conjunction of bounds on statistics; a logistic regression with an L1 penalty
keeps few rules. What is left compiles into one Spark column expression over the statistics.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table_rows

#: Labelled rows that a model is fitted on, at most about so many.
TRAIN_ROWS = 8000
TREES, DEPTH, LEAF, BINS = 60, 3, 15, 32

STATISTICS = (
    "chars", "words", "lines", "word_length", "upper", "digit", "sign", "wide", "space", "distinct_words", "top_word", "repeated_next",
    "signed_words", "upper_words", "short_words", "line_length", "distinct_lines", "ended_lines", "long_words", "packed",
)

_KIND = np.zeros(256, np.int64)  # 0 lower case, 1 upper case, 2 digit, 3 sign, 4 white space, 5 part of a wide character
_KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 5
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 3
_KIND[[*range(0, 33), 127]] = 4


def statistics(text: str | None) -> tuple[float, ...]:
    """The text's STATISTICS; all zero for null, empty and blank texts."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return (0.0,) * len(STATISTICS)
    n, k = len(raw), len(words)
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=6) / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = Counter(words)
    signs = set(range(33, 127)) - {c for c in range(128) if chr(c).isalnum()} - set(b".,;:'")
    return (
        float(np.log1p(n)), float(np.log1p(k)), float(np.log1p(len(lines))), (n - k) / k, float(kinds[1]), float(kinds[2]), float(kinds[3]), float(kinds[5]), float(kinds[4]),
        len(counts) / k, max(counts.values()) / k, sum(a == b for a, b in zip(words, words[1:], strict=False)) / k,
        sum(w[-1] in signs for w in words) / k, sum(w.isupper() for w in words) / k, sum(len(w) <= 3 for w in words) / k, n / len(lines),
        len(set(lines)) / len(lines), sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines), sum(len(w) > 14 for w in words) / k, len(zlib.compress(raw, 1)) / n,
    )


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, STATISTICS...): a row per row of docs."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(t) for t in batch.column(1).to_pylist()], float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in rows.T.copy())], ["doc_id", *STATISTICS])

    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(each, ", ".join(["doc_id long", *(f"{s} double" for s in STATISTICS)]))


#: (statistic, bound, above): the statistic is above the bound, or at or below it.
Condition = tuple[int, float, bool]


@dataclass
class Rules:
    bias: float
    weighted: list[tuple[tuple[Condition, ...], float]]

    def column(self) -> Column:
        """The score, from 0 to 1, over the columns STATISTICS."""

        def holds(rule: tuple[Condition, ...]) -> Column:
            return reduce(Column.__and__, (F.col(STATISTICS[j]) > b if above else F.col(STATISTICS[j]) <= b for j, b, above in rule))

        z = reduce(Column.__add__, (F.when(holds(rule), w).otherwise(0.0) for rule, w in self.weighted), F.lit(self.bias))
        return 1 / (1 + F.exp(-z))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{STATISTICS[j]} {'>' if above else '<='} {b:.4g}" for j, b, above in rule) for rule, w in self.weighted]


def _grow(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], rng: np.random.Generator, rows: np.ndarray, path: tuple[Condition, ...], depth: int, found: set) -> None:
    if path:
        found.add(tuple(sorted(path)))
    if depth == 0 or len(rows) < 2 * LEAF:
        return
    best = None
    base = np.var(y[rows]) * len(rows)
    for j in rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False):
        if not len(cuts[j]):
            continue
        left = x[rows, j][:, None] <= cuts[j][None]
        n, total = left.sum(0), y[rows].sum()
        s = (left * y[rows][:, None]).sum(0)
        fits = (n >= LEAF) & (len(rows) - n >= LEAF)
        if not fits.any():
            continue
        gain = np.where(fits, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(len(rows) - n, 1) - total**2 / len(rows), -1)
        c = int(np.argmax(gain))
        if best is None or gain[c] > best[0]:
            best = (gain[c], int(j), float(cuts[j][c]))
    if best is None or best[0] < 1e-3 * max(base, 1e-12):
        return
    _, j, bound = best
    low = x[rows, j] <= bound
    _grow(x, y, cuts, rng, rows[low], (*path, (j, bound, False)), depth - 1, found)
    _grow(x, y, cuts, rng, rows[~low], (*path, (j, bound, True)), depth - 1, found)


def _matrix(x: np.ndarray, rules: list[tuple[Condition, ...]]) -> np.ndarray:
    return np.stack([np.logical_and.reduce([(x[:, j] > b) == above for j, b, above in rule]) for rule in rules], axis=1).astype(float)


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7, penalty: float = 0.004) -> Rules:
    """Grow trees, then weigh their paths by L1-penalised logistic regression (accelerated proximal steps)."""
    if not len(y) or y.min() == y.max():
        return Rules(0.0 if not len(y) else (3.0 if y.max() else -3.0), [])
    rng, n = np.random.default_rng(seed), len(y)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 2)[1:-1]).round(6)) for j in range(x.shape[1])]
    found: set = set()
    for _ in range(TREES):
        _grow(x, y, cuts, rng, rng.choice(n, max(2 * LEAF, n // 2), replace=True), (), DEPTH, found)
    if not found:
        return Rules(float(np.log(y.mean() / (1 - y.mean()))), [])
    rules = sorted(found)
    a = _matrix(x, rules)
    share = a.mean(0)
    scale = np.sqrt(np.maximum(share * (1 - share), 1e-4))
    z = (a - share) / scale
    w, v, b, t = np.zeros(len(rules)), np.zeros(len(rules)), float(np.log(y.mean() / (1 - y.mean()))), 1.0
    probe = rng.normal(size=len(rules))
    for _ in range(20):
        probe = z.T @ (z @ probe)
        probe /= np.linalg.norm(probe)
    rate = 4 * n / max(1e-9, float(np.linalg.norm(z.T @ (z @ probe)))) * 0.95
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(z @ v + b, -30, 30)))
        b -= 2 * (p - y).mean()
        step = v - rate * (z.T @ (p - y)) / n
        new = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    weights = w[kept] / scale[kept]
    return Rules(float(b - (weights * share[kept]).sum()), [(rules[i], float(c)) for i, c in zip(kept, weights, strict=True)])


def train(docs: DataFrame, labels: DataFrame, rows: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_ROWS) -> Rules:
    """Rules from labelled rows (those where `rows` holds), a hashed sample of about `most` of them; null ids and labels are left out."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    if rows is not None:
        known = known.where(rows)
    known = table_rows(known, F.col("id"), most, known.count())
    sample = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known.select("id").distinct()), "id", "left_semi")
    found = with_statistics(sample, "id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("id")).select("doc_id", "y", *STATISTICS).collect()
    data = np.array(sorted(map(tuple, found)), float).reshape(-1, 2 + len(STATISTICS))
    return fit(data[:, 2:], (data[:, 1] > 0).astype(float))


def scored(docs: DataFrame, rules: Rules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): a row per row of docs; null texts score as empty ones, null ids stay null; extra columns are not read; an empty table gives no rows."""
    return with_statistics(docs, id_col, text_col).select("doc_id", rules.column().alias("score"))
