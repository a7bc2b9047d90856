import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import groups, nearcopies
from docketry.llm.common import load
from docketry.llm.simhash import shingle_hashes, simhash

FOLDER = "/root/testdata/sf0.001"


def brute_force(rows):
    """The smallest id of each row's group, by all pairs."""
    sets = [set(shingle_hashes(t, nearcopies.WIDTH).tolist()) for _, t in rows]
    fps = [simhash(shingle_hashes(t, nearcopies.WIDTH)) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            either = len(sets[i] | sets[j])
            if sets[i] == sets[j] or (fps[i] ^ fps[j]).bit_count() <= nearcopies.RADIUS or len(sets[i] & sets[j]) >= nearcopies.SIMILARITY * either:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for (doc_id, _), g in zip(rows, group, strict=True):
        least[g] = min(doc_id, least.get(g, doc_id))
    return {doc_id: least[g] for (doc_id, _), g in zip(rows, group, strict=True)}


def test_table_equals_brute_force(spark):
    docs = load(spark, FOLDER, "documents")
    want = brute_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs).collect()}
    assert got == want


@pytest.mark.parametrize("bounds", [(4096, 1 << 19), (5, 400)])
def test_copies_of_one_text(spark, monkeypatch, bounds):
    """Copies that are near the first text, not near each other; with small blocks too."""
    monkeypatch.setattr(nearcopies, "BLOCK_ROWS", bounds[0])
    monkeypatch.setattr(nearcopies, "BLOCK_SHINGLES", bounds[1])
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = [(500, " ".join(base))]
    for n in range(30):
        words = list(base)
        for _ in range(2 + n % 3):
            words[rng.randrange(len(words))] = f"x{rng.randrange(5000)}"
        rows.append((400 - n, " ".join(words)))
    rows += [(1000 + n, " ".join(f"y{rng.randrange(5000)}" for _ in range(60))) for n in range(20)]
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_force(rows)


def test_odd_rows(spark):
    long = " ".join(f"word{n}" for n in range(30000))
    rows = [(1, None, 1), (2, "", 2), (3, " \t", 3), (4, "one two", 4), (5, "ONE  two", 5), (6, "one three", 6), (7, long, 7), (8, long + " end", 8), (None, "one two", 9), (4, "one two", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    kept = nearcopies.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text and r.text[:9]) for r in kept.collect()) == [(0, "one two"), (1, None), (4, "one two"), (6, "one three"), (7, "word0 wor")]
    assert nearcopies.keep_one(docs.limit(0)).count() == 0


def test_forest_links_only_what_is_similar():
    sets = [np.arange(100, dtype=np.int64), np.arange(10, 110, dtype=np.int64), np.arange(50, 150, dtype=np.int64)]
    lanes = np.zeros((3, 96), np.uint8)
    assert nearcopies.forest(lanes).tolist() == [0, 0, 0]
    assert nearcopies.forest(lanes, sets).tolist() == [0, 0, 2]


def test_forest_keeps_what_is_connected():
    sets = [np.arange(k, k + 100, dtype=np.int64) for k in (0, 500, 510, 900)]
    assert nearcopies.forest(np.zeros((4, 96), np.uint8), sets, 2).tolist() == [0, 0, 0, 3]


def test_large_group_in_blocks(spark):
    """A group in many blocks: a chain, whose rows are near their neighbours only, and copies of one text."""
    rng = np.random.default_rng(4)
    rows = [(int(n), [int(x) for x in range(10 * k, 10 * k + 100)]) for k, n in enumerate(rng.choice(10**6, 40, replace=False))]
    for n in rng.choice(10**6, 60, replace=False) + 10**6:
        rows.append((int(n), sorted({*range(5000, 5100)} - {int(x) for x in rng.integers(5000, 5100, 5)})))
    rows += [(3 * 10**6 + n, list(range(10**4 * n, 10**4 * n + 50))) for n in range(1, 8)]
    frame = spark.createDataFrame([(7, n, len(s), bytes(96), s) for n, s in rows], "key long, node long, n long, lanes binary, shingles array<long>")
    links = groups.linked(frame, F.col("n"), 700, 2000, nearcopies._by_shingles, len(rows)).collect()
    group = {n: n for n, _ in rows}
    for link in links:
        a, b = group[link.a], group[link.b]
        group = {n: b if g == a else g for n, g in group.items()}
    got = sorted(sorted(n for n in group if group[n] == g) for g in set(group.values()))
    assert got == sorted([sorted(n for n, _ in rows[:40]), sorted(n for n, _ in rows[40:100]), *([n] for n, _ in rows[100:])])
