import random

from docketry.operators import evidence, reconcile


def in_a_row(spans):
    """Whether the spans, sorted, each begin where the one before ended, the first at 0."""
    at = 0
    for start, end in sorted(spans):
        if start != at or end < start:
            return False
        at = end
    return True


def test_chains_equal_sorting(spark):
    """Whole chains, holes, overlaps, repeated and empty records, cycles of nothing, nulls, and stated sizes."""
    rng, rows, want = random.Random(5), [], {}
    for part in range(400):
        cuts = sorted(rng.sample(range(1, 9), rng.randint(0, 4)))
        spans = list(zip([0, *cuts], [*cuts, 9], strict=True))
        for _ in range(rng.choice([0, 0, 1, 2])):
            change = rng.randint(0, 4)
            if change == 0 and len(spans) > 1:
                spans.pop(rng.randrange(len(spans)))
            elif change == 1:
                spans.append(rng.choice(spans))
            elif change == 2:
                at = rng.randint(0, 9)
                spans.append((at, at))
            elif change == 3:
                a, b = sorted(rng.sample(range(10), 2))
                spans.append((a, b))
        rng.shuffle(spans)
        size = rng.choice([9, 9, 8])
        rows += [(part, a, b, size) for a, b in spans]
        want[part] = in_a_row(spans), in_a_row(spans) and max(b for _, b in spans) == size
    rows += [(900, 0, None, 9), (901, None, None, 9), (902, 0, 0, 0), (903, 3, 3, 3), (904, 0, 5, 5), (904, 5, 3, 5)]
    want |= {900: (False, False), 901: (False, False), 902: (True, True), 903: (False, False), 904: (False, False)}
    records = spark.createDataFrame(rows, "part_id long, start long, end long, size long")
    for n, size in enumerate((None, "size")):
        found = {r["part_id"]: r["complete"] for r in evidence.contiguous(records, size=size).collect()}
        assert found == {part: answers[n] for part, answers in want.items()}
    assert 50 < sum(a for a, _ in want.values()) < 350
    assert evidence.contiguous(records.where("false")).count() == 0


def test_current_versions_equal_sorting(spark):
    """The last by revision, date and arrival, of equal ones the smallest version; uncertain where something tells neither."""
    rng = random.Random(6)
    rows = [(rng.randrange(60), f"v{n}", rng.choice([None, 1, 2]), rng.choice([None, "2024-01-01", "2024-02-01"]), rng.randrange(4)) for n in range(200)]
    want = {}
    for source in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == source), key=lambda r: r[1])
        last = max(own, key=lambda r: (r[2] or 0, r[3] or "", r[4]))
        unsure = len(own) > 1 and any(r[2] is None and r[3] is None for r in own)
        want[source] = last[1], unsure, "arrival_fallback" if unsure else "date" if last[2] is None else "revision"
    versions = spark.createDataFrame(rows, "source_id long, version_id string, revision int, date string, arrival int")
    found = {r["source_id"]: (r["version_id"], r["ordering_uncertain"], r["order_basis"]) for r in reconcile.current_versions(versions).collect()}
    assert found == want


def test_bytes_are_found_across_records_and_tasks(spark):
    """Parts of a few letters in records of 0 to 3 bytes, one part with most rows, needles of several lengths."""
    rng, rows, texts = random.Random(7), [], {}
    for part in range(40):
        text, at = b"".join(rng.choice([b"a", b"b"]) for _ in range(2000 if part == 3 else rng.randint(0, 12))), 0
        texts[part] = text
        rows.append((part, 0, None))
        while at < len(text):
            size = rng.randint(1, 3)
            rows.append((part, at, bytearray(text[at : at + size])))
            at += size
    rng.shuffle(rows)
    records = spark.createDataFrame(rows, "part_id long, start long, data binary")
    for needle in (b"", b"a", b"ab", b"abba", b"aaabbbab", texts[3][990:1010], texts[3][990:1010][::-1]):
        found = {r["part_id"]: r["found"] for r in evidence.holds_bytes(records, needle).collect()}
        assert found == {part: needle in text for part, text in texts.items()}, needle
