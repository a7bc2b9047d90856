"""The network against spans that training has no part in: other templates, words, separators and contexts."""

import itertools
import random

import numpy as np
import pytest

from docketry.llm import pii
from docketry.llm.common import load

FOLDER = "/root/testdata/sf0.01"
WORDS = "harbour ledger winter copper garden meeting invoice orchard station bridge lantern basket river letter window market".split()
FRAMES = ("Please write to {} before noon", "{} is what they left at the desk", "our records name {}; nothing else", "call or send ({}) if in doubt", "Kontakt: {}.", "the old entry, {}, was struck out")


def held_out(n: int, seed: int = 41) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with a labelled span that the fixed patterns do not know, or with something that only looks like one."""
    rng = random.Random(seed)
    pick, num = rng.choice, rng.randint

    def email() -> str:
        user, host = f"{pick(WORDS)}_{pick(WORDS)}", f"{pick(WORDS)}-{num(2, 9)}"
        return pick([f"{user} @ {host}.net", f"{user} (at) {host}.org", f"{user}[at]{host}.com", f"{user} (at) {host} (dot) org"])

    def ip() -> str:
        return pick([" . ", "[.]"]).join(str(num(2, 250)) for _ in range(4))

    def card() -> str:
        digits = pick("3456") + "".join(str(num(0, 9)) for _ in range(14))
        digits += next(c for c in "0123456789" if pii.luhn(digits + c))
        return pick([".", "  "]).join(digits[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = num(201, 989), num(210, 989), num(1000, 9999)
        return pick([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{num(31, 49)} {a} {b} {c}"])

    def decoy() -> str:
        return pick([f"chapter {num(1, 40)}.{num(1, 9)}", f"{num(1, 28)}/{num(1, 12)}/{num(1950, 2030)}", f"{num(10, 99)} x {num(10, 99)} cm", f"page {num(100, 999)}", f"@{pick(WORDS)}", f"{num(1, 9)},{num(100, 999)},{num(100, 999)} words", f"section {num(1, 9)}.{num(1, 9)}.{num(1, 9)}", f"{num(1, 12)}:{num(10, 59)}"])

    out = []
    for i in range(n):
        before, item = " ".join(rng.choices(WORDS, k=num(0, 8))), (email, ip, card, phone, decoy)[i % 5]()
        frame = pick(FRAMES)
        text = f"{before} {frame.format(item)} " + " ".join(rng.choices(WORDS, k=num(0, 20)))
        at = len(before) + 1 + frame.index("{}")
        out.append((text, [(i % 5, at, at + len(item))] if i % 5 < 4 else []))
    return out


def judged(weights, tests) -> tuple[float, float]:
    """(precision, recall) of what the network adds: an addition is right if it overlaps a span of its kind."""
    found = pii.find([t for t, _ in tests], weights)
    added = [(kind, a, b, own) for (_, own), (_, more) in zip(tests, found, strict=True) for kind, a, b in more]
    right = sum(any(k == kind and a < y and x < b for k, x, y in own) for kind, a, b, own in added)
    wanted = [(s, more, base) for (_, own), (base, more) in zip(tests, found, strict=True) for s in own]
    unknown = [(s, more) for s, more, base in wanted if not any(x < s[2] and s[1] < y for _, x, y in base)]
    hit = sum(any(k == s[0] and a < s[2] and s[1] < b for k, a, b in more) for s, more in unknown)
    return right / max(1, len(added)), hit / max(1, len(unknown))


def test_additions_on_spans_from_another_generator(spark):
    weights = pii.train(load(spark, FOLDER, "documents"))
    precision, recall = judged(weights, held_out(600))
    print(f"precision {precision:.3f}, recall {recall:.3f}")
    assert precision >= 0.9 and recall >= 0.5


def test_viterbi_equals_trying_all_tags():
    rng = np.random.default_rng(3)
    p = pii._initial(2)
    p["t"], p["s"] = rng.normal(size=p["t"].shape), rng.normal(size=p["s"].shape)
    x = rng.integers(0, 16, (3, 4))
    scores = pii._emissions(p, x)[0]
    for row, tags in enumerate(pii.decode(p, x)):
        best = max(itertools.product(range(pii.TAGS), repeat=4), key=lambda y: p["s"][y[0]] + sum(scores[t, row, y[t]] for t in range(4)) + sum(p["t"][y[t - 1], y[t]] for t in range(1, 4)))
        assert tuple(tags.tolist()) == best


@pytest.mark.parametrize("text", ["", "no data", "a.b@c.org", "1.2.3.4 and +1 (555) 123-4567"])
def test_registered_digest(spark, text):
    import hashlib

    row = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string"), None).first()
    base = pii.base_spans(text)
    want = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
    assert row["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and row["spans"] == want and row["n_spans"] == len(base) == row["n_email"] + row["n_ip"] + row["n_card"] + row["n_phone"]
