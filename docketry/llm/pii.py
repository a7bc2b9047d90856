"""Personal data: fixed patterns, and a character-level BiLSTM with CRF transitions beside them.

The network is trained in numpy from labelled spans: those that the patterns find in a bounded
sample of the corpus, and written variants that the patterns do not know (separators, "at" for
the sign, numbers without prefix). Texts are read in overlapping windows wherever a digit, an @ or
an "(at)" stands; no span of any kind is without one. Windows are decoded by Viterbi, and each
character takes its tag from the window in which it is farthest from a border. A decoded span
that is valid for its kind and touches no pattern's span is added; the patterns' spans all stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end in code points

#: Documents that training spans are taken from, training windows, and words to write variants among: each at most so many, chosen by hash.
TRAIN_DOCS, TRAIN_WINDOWS, TRAIN_WORDS = 4000, 1200, 2000
WINDOW, STRIDE, HIDDEN = 96, 48, 12

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A run of digits is taken whole or not at all, so that matching stays linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT = re.compile(r"[\[({]\s?at\s?[\])}]", re.IGNORECASE)
_TRIGGER = re.compile(r"[0-9@]|[\[({]\s?at\s?[\])}]", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and non-overlapping for each kind, by start, then kind."""
    found: list[Span] = []
    at, low = text.find("@"), 0
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append((0, start, match.end()))
            low = match.end()
        at = text.find("@", max(at + 1, low))
    if "." in text:
        found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(x := part.lstrip("0")) < 4 and int(x or 0) < 256 for part in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40 and 12 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], s[0]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], s[0])))


# ---- the network -------------------------------------------------------------------------

_CLASSES = 16
_CLASS = {**dict.fromkeys("0123456789", 1), "@": 2, ".": 3, "-": 4, "_": 5, "+": 6, "(": 7, ")": 7, "[": 8, "]": 8, "{": 8, "}": 8, " ": 9, "\n": 10, ",": 11, ":": 11, ";": 11}
_LUT = np.array([_CLASS.get(chr(c), 12 if chr(c).islower() else 13 if chr(c).isupper() else 14) for c in range(128)] + [15], np.int64)
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind


def _classes(text: str) -> np.ndarray:
    return _LUT[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 128)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _initial(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {}
    for way in "fb":
        p[f"w{way}"] = rng.normal(0, 0.3, (_CLASSES, 4 * HIDDEN))
        p[f"u{way}"] = rng.normal(0, 0.3, (HIDDEN, 4 * HIDDEN))
        p[f"w{way}"][:, HIDDEN : 2 * HIDDEN] += 1  # remember at first
    p["o"], p["c"] = rng.normal(0, 0.3, (2 * HIDDEN, TAGS)), np.zeros(TAGS)
    p["t"], p["s"] = np.zeros((TAGS, TAGS)), np.zeros(TAGS)
    return p


def _lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    n, steps = x.shape
    h, c = np.zeros((n, HIDDEN), w.dtype), np.zeros((n, HIDDEN), w.dtype)
    out, saved = np.empty((steps, n, HIDDEN), w.dtype), []
    for t in range(steps):
        z = w[x[:, t]] + h @ u
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
        before, c = c, f * c + i * g
        squashed = np.tanh(c)
        if keep:
            saved.append((i, f, o, g, before, squashed, h))
        h = o * squashed
        out[t] = h
    return out, saved


def _lstm_back(x: np.ndarray, u: np.ndarray, saved: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dw, du = np.zeros((_CLASSES, 4 * HIDDEN)), np.zeros_like(u)
    dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
    for t in range(len(saved) - 1, -1, -1):
        i, f, o, g, before, squashed, h = saved[t]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - squashed**2)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)], axis=1)
        np.add.at(dw, x[:, t], dz)
        du += h.T @ dz
        dh, dc = dz @ u.T, dc * f
    return dw, du


def _emissions(p: dict[str, np.ndarray], x: np.ndarray, keep: bool = False):
    forward, a = _lstm(x, p["wf"], p["uf"], keep)
    backward, b = _lstm(x[:, ::-1], p["wb"], p["ub"], keep)
    h = np.concatenate([forward, backward[::-1]], axis=2)
    return h @ p["o"] + p["c"], h, a, b


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def _gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss of the tag sequences y (windows by steps) and its gradients, by the forward-backward algorithm."""
    e, h, a, b = _emissions(p, x, keep=True)
    steps, n, _ = e.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0] + p["s"]
    for t in range(1, steps):
        alpha[t] = e[t] + _log_sum(alpha[t - 1][:, :, None] + p["t"], 1)
    for t in range(steps - 2, -1, -1):
        beta[t] = _log_sum(p["t"][None] + (e[t + 1] + beta[t + 1])[:, None], 2)
    z = _log_sum(alpha[-1], 1)
    rows, tags = np.arange(n), y.T
    gold = p["s"][tags[0]] + sum(e[t, rows, tags[t]] for t in range(steps)) + sum(p["t"][tags[t - 1], tags[t]] for t in range(1, steps))
    de = np.exp(alpha + beta - z[None, :, None])
    grads = {"s": de[0].sum(0) - np.bincount(tags[0], minlength=TAGS), "t": np.zeros_like(p["t"])}
    for t in range(1, steps):
        grads["t"] += np.exp(alpha[t - 1][:, :, None] + p["t"] + (e[t] + beta[t])[:, None] - z[:, None, None]).sum(0)
        np.add.at(grads["t"], (tags[t - 1], tags[t]), -1)
    for t in range(steps):
        de[t, rows, tags[t]] -= 1
    grads["o"], grads["c"] = np.einsum("tnh,tnk->hk", h, de), de.sum((0, 1))
    dh = de @ p["o"].T
    grads["wf"], grads["uf"] = _lstm_back(x, p["uf"], a, dh[:, :, :HIDDEN])
    grads["wb"], grads["ub"] = _lstm_back(x[:, ::-1], p["ub"], b, dh[::-1, :, HIDDEN:])
    return float((z - gold).mean()), {k: v / n for k, v in grads.items()}


def fit(windows: list[tuple[str, list[Span]]], seed: int = 5, epochs: int = 8, batch: int = 64, rate: float = 0.02) -> dict[str, np.ndarray]:
    """Weights from windows of WINDOW code points (shorter ones are padded) and the spans in them."""
    x = np.stack([_classes(t.ljust(WINDOW)[:WINDOW]) for t, _ in windows])
    y = np.zeros((len(windows), WINDOW), np.int64)
    for row, (_, spans) in enumerate(windows):
        for kind, a, b in spans:
            y[row, max(0, a) : b] = 2 + 2 * kind
            if 0 <= a < WINDOW:
                y[row, a] = 1 + 2 * kind
    rng, p = np.random.default_rng(seed), _initial(seed)
    first, second, n = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            _, grads = _gradients(p, x[rows], y[rows])
            n += 1
            size = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 5 / max(size, 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g**2
                p[k] -= rate * (1 - 0.1 * epoch) * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in p.items()}


def decode(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The best tag sequences (windows by steps)."""
    e = _emissions(p, x)[0]
    steps, n, _ = e.shape
    best, back = e[0] + p["s"], np.empty((steps, n, TAGS), np.int8)
    for t in range(1, steps):
        paths = best[:, :, None] + p["t"]
        back[t] = paths.argmax(1)
        best = paths.max(1) + e[t]
    tags = np.empty((n, steps), np.int8)
    tags[:, -1] = best.argmax(1)
    for t in range(steps - 1, 0, -1):
        tags[:, t - 1] = back[t, np.arange(n), tags[:, t]]
    return tags


def windows_of(text: str) -> list[int]:
    """Starts of overlapping windows that cover STRIDE code points on either side of every trigger."""
    starts: list[int] = []
    for m in _TRIGGER.finditer(text):
        low, high = max(0, m.start() - STRIDE), min(len(text), m.end() + STRIDE)
        at = starts[-1] + STRIDE if starts and starts[-1] + WINDOW > low else low
        while not starts or starts[-1] + WINDOW < high:
            starts.append(at)
            at += STRIDE
    return starts


def _valid(kind: int, text: str) -> bool:
    digits = _digits(text)
    if kind == 0:
        return bool("@" in text or _AT.search(text)) and bool(re.search(r"\w\s?([.]|\W(dot|punkt|point|punto)\W)\s?\w", text.rpartition("@")[2] or text, re.IGNORECASE)) and "\n" not in text
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(x) < 4 and int(x) < 256 for x in parts)
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and bool(re.search(r"[0-9][ ().-]+[0-9]", text)) and not re.search(r"[A-Za-z]", text)


def find(texts: list[str], p: dict[str, np.ndarray] | None, chunk: int = 2048) -> list[tuple[list[Span], list[Span]]]:
    """For each text: the patterns' spans, and what the network adds to them."""
    base = [base_spans(t) for t in texts]
    added: list[list[Span]] = [[] for _ in texts]
    if p is None:
        return list(zip(base, added, strict=True))
    todo = [(i, s) for i, t in enumerate(texts) for s in windows_of(t)]
    classes = {i: _classes(texts[i]) for i in {i for i, _ in todo}}
    held: dict[int, list[tuple[int, np.ndarray]]] = {}
    for at in range(0, len(todo), chunk):
        part = todo[at : at + chunk]
        x = np.full((len(part), WINDOW), _LUT[32])
        for row, (i, s) in enumerate(part):
            piece = classes[i][s : s + WINDOW]
            x[row, : len(piece)] = piece
        for (i, s), tags in zip(part, decode(p, x), strict=True):
            held.setdefault(i, []).append((s, tags))
    for i, parts in held.items():
        text, n = texts[i], len(texts[i])
        low = parts[0][0]
        size = min(n, parts[-1][0] + WINDOW) - low
        tags, inner = np.zeros(size + 1, np.int8), np.full(size + 1, -1)
        for s, own in parts:
            a, b = s - low, min(s + WINDOW, n) - low
            # Distance to the window's borders; a border of the text itself is none.
            left = np.arange(b - a) + (WINDOW if s == 0 else 0)
            right = np.arange(b - a)[::-1] + (WINDOW if s + WINDOW >= n else 0)
            depth = np.minimum(left, right)
            better = depth > inner[a:b]
            tags[a:b][better], inner[a:b][better] = own[: b - a][better], depth[better]
        kinds = np.where(tags > 0, (tags + 1) // 2, 0)
        starts = np.flatnonzero((kinds > 0) & ((tags % 2 == 1) | (np.concatenate([[0], kinds[:-1]]) != kinds)))
        taken = base[i]
        for s in starts.tolist():
            e = s + 1
            while e < size and kinds[e] == kinds[s] and tags[e] % 2 == 0:
                e += 1
            a, b, kind = low + s, low + e, int(kinds[s]) - 1
            while a < b and text[a].isspace():
                a += 1
            while b > a and (text[b - 1].isspace() or text[b - 1] in ",;:!?"):
                b -= 1
            if b > a and not any(x < b and a < y for _, x, y in taken) and _valid(kind, text[a:b]):
                added[i].append((kind, a, b))
    return list(zip(base, added, strict=True))


# ---- training windows --------------------------------------------------------------------


def _cut(text: str, spans: list[Span], centre: int, shift: int) -> tuple[str, list[Span]]:
    low = max(0, centre - shift)
    return text[low : low + WINDOW], [(k, a - low, b - low) for k, a, b in spans if a < low + WINDOW and b > low]


def invented(n: int, words: list[str], seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Windows of plain words with written variants of each kind, and numbers that are none."""
    rng = np.random.default_rng(seed)
    pick, num = (lambda xs: xs[int(rng.integers(len(xs)))]), (lambda a, b: int(rng.integers(a, b)))

    def card() -> str:
        digits = "".join(str(num(0, 10)) for _ in range(15))
        digits += next(c for c in "0123456789" if luhn(digits + c))
        sep = pick(["", " ", "-", ".", "  "])
        return sep.join(digits[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = num(200, 999), num(200, 999), num(1000, 9999)
        return pick([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{num(10, 99)} {a} {b} {c}", f"{a}.{b}.{c}", f"00{num(10, 99)} {a} {b} {c}"])

    def email() -> str:
        user, host, end = f"{pick(words).lower()}.{num(1, 99)}", pick(words).lower(), pick(["com", "org", "net", "example.com"])
        at, dot = pick([("@", "."), ("@", "."), (" @ ", "."), (" (at) ", "."), ("[at]", "."), (" (at) ", " (dot) ")])
        return f"{user}{at}{host}{dot}{end}"

    def ip() -> str:
        return pick([".", ".", " . ", "[.]"]).join(str(num(1, 255)) for _ in range(4))

    def other() -> str:
        return pick([f"{num(1, 9999)}", f"{num(1, 12)}.{num(1, 31)}", f"{num(1900, 2030)}-{num(10, 13)}-{num(10, 30)}", f"v{num(1, 9)}.{num(0, 9)}.{num(0, 9)}", f"{num(1, 99)},{num(100, 999)}", f'token = "{rng.bytes(12).hex()}"', f"{num(10**9, 2 * 10**9)}", f"@{pick(words)}"])

    out = []
    for i in range(n):
        before = " ".join(pick(words) for _ in range(num(2, 7)))
        kind = i % 5
        item = (email, ip, card, phone, other)[kind]()
        text = f"{before} {item}{pick(['', '.', ','])} " + " ".join(pick(words) for _ in range(12))
        out.append((text[:WINDOW], [(kind, len(before) + 1, len(before) + 1 + len(item))] if kind < 4 else []))
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_docs: int = TRAIN_DOCS, most: int = TRAIN_WINDOWS) -> dict[str, np.ndarray]:
    """Weights for a corpus: windows around the patterns' spans in a hashed sample of its texts, and invented ones.

    Null and empty texts give no windows, repeated rows repeated ones; an empty table leaves the invented ones.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                spans = base_spans(text)
                for _, a, _ in spans:
                    own, inside = _cut(text, spans, a, 8 + a % 40)
                    rows.append((hashlib.sha256(own.encode()).hexdigest(), own, [list(s) for s in inside]))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.list_(pa.list_(pa.int64()))), strict=True)], ["key", "text", "spans"])

    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = texts.count()
    share = min(1 << 20, int(most_docs / max(1, total) * (1 << 20)) + 1)
    sample = texts.where((F.pmod(F.xxhash64("id", F.lit("pii sample")), F.lit(1 << 20)) < share) & F.col("text").rlike("[0-9@]")).select("text")
    found = sample.mapInArrow(each, "key string, text string, spans array<array<bigint>>").orderBy("key").limit(most).collect()
    windows = [(r["text"], [tuple(s) for s in r["spans"]]) for r in found]
    words = {w for t, _ in windows for w in t.split() if w.isalpha()}
    words = sorted(words, key=lambda w: hashlib.sha256(w.encode()).digest())[:TRAIN_WORDS] or ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it"]
    return fit(windows + invented(800, words))


# ---- operators ---------------------------------------------------------------------------

_OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_added long"


def find_personal_data(docs: DataFrame, weights: dict[str, np.ndarray] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, n_added): a row per row of docs.

    The first counts and base_sha256 are of the patterns' spans, `spans` and n_spans of all. Null
    texts are empty: no spans, and the digest of the empty string. Null ids stay null, repeated
    rows are rows like others, an empty table gives no rows. Extra columns are not read.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find([t or "" for t in batch.column(1).to_pylist()], weights)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)]
            digests = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string())
            spans = pa.array([written(base + more) for base, more in found], pa.string())
            totals = [pa.array([len(base) + len(more) for base, more in found], pa.int64()), pa.array([len(more) for _, more in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, spans, *totals], [c.split()[0] for c in _OUT.split(", ")])

    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(each, _OUT)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[0])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind]}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


@dataclass
class Masker:
    weights: dict[str, np.ndarray] | None

    def __call__(self, batches: Iterator) -> Iterator:
        for texts in batches:
            values = [None if t is None else t for t in texts]
            found = find([t or "" for t in values], self.weights)
            yield pd.Series([None if t is None else masked(t, base + more) for t, (base, more) in zip(values, found, strict=True)], dtype=object)


def mask(docs: DataFrame, weights: dict[str, np.ndarray] | None, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with the spans in its texts replaced; null stays null; a column of lengths, if there is one, follows.

    All rows and columns stay; ids are not read; an empty table gives no rows.
    """
    run = Masker(weights)

    def replace(batches):
        yield from run(batches)

    replace.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    small_batches(docs.sparkSession)
    out = docs.withColumn(text_col, F.pandas_udf(replace, "string")(F.col(text_col).cast("string")))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns)
