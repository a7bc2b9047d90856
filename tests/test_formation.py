import pytest

from docketry.functions import text
from docketry.operators import formation

NOTE = """For Observation V17: The visit total should read 15, not 12. This corrects the count only.
Ann Lee, a warden, observed 12 visits at River Delta on May 17, 2024 for 30minutes. #field-nöte "Possibly 7 visits" was an estimate.
Observer: ann Bob Kee counted visits: possibly 12. The date is unknown. Survey ABC-1 and Survey ABC-1. June 2024.
[DOCX paragraph 1; channel=reference] see https://b.example/y, now
"""


def test_candidates_of_a_note():
    found = formation.candidates_in(NOTE)
    raw = NOTE.encode()
    told = [(kind, value, qualifier) for kind, value, _, _, qualifier, _ in found]
    assert told == [
        ("event", "Observation V17", ""), ("count", "15 visits", ""), ("person", "Ann Lee", ""), ("date", "May 17, 2024", ""), ("count", "12 visits", ""), ("duration", "30 minutes", ""), ("place", "River Delta", ""),
        ("tag", "field-nöte", ""), ("count", "7 visits", formation.POSSIBLE_ESTIMATE), ("count", "12 visits", "possibly"), ("person", "Bob Kee", ""), ("unknown_date", "unknown", formation.NO_DATE),
        ("event", "Survey ABC-1", ""), ("date", "June 2024", formation.MONTH_PRECISION), ("reference", "https://b.example/y", ""),
    ]
    assert all(raw[a:b].decode().strip() for _, _, a, b, _, _ in found)
    assert {c[5] for c in found if c[1] == "7 visits"} == {"quoted"} and found[0][5] == "observed"
    assert formation.corrections_in(NOTE)[0][:4] == ("Observation V17", "visit_count", "12 visits", "15 visits")


def test_event_names_need_capitals():
    assert [c[1] for c in formation.candidates_in("v17 and event x1, observation A_1, SURVEY B2.") if c[0] == "event"] == ["Observation A_1", "SURVEY B2"]


def test_persons_by_verb_and_by_role():
    found = [c for c in formation.candidates_in("observer: Ann Lee. Bo Ek, of the club, filed it. They reported. It recorded.") if c[0] == "person"]
    assert [(c[1], c[2], c[3]) for c in found] == [("Ann Lee", 0, 17), ("Bo Ek", 19, 44)]


def test_records_questions_and_prose():
    record = "# ADR-7: Use it\n\n## Decision\n\n We do é.\n### Next\n## Open questions\n* Why?\n- no\n"
    assert [(c[1], record.encode()[c[2] : c[3]].decode()) for c in formation.decisions_in(record)] == [("Use it", "We do é.")]
    assert [c[1] for c in formation.questions_in(record)] == ["Why?"] and formation.decisions_in("## Decision\nx") == []
    assert [c[:2] for c in formation.prose_in("Á 2024-02-30 or 2024-02-28. End")] == [("prose", "Á 2024-02-30 or 2024-02-28."), ("prose", "End"), ("date", "2024-02-28")]
    assert formation.ordering_in("Revision 3 of Sept 4, 2020; 2020-13-01, revision 0") == [("revision", "3", 0, 10), ("date", "2020-09-04", 14, 26)]
    assert formation.subject_of("The 12 gauge-B river was high") == "gauge-b-river" and formation.subject_of("is the") == ""


def test_sentences_and_origin():
    assert text.sentence_around('a. "Yes!" b', 4, 5) == (3, 9)
    assert text.origin('say "x X y" z', 7, 8) == "quoted" and text.origin("Quoted: X", 8, 9) == "quoted" and text.origin("a: X", 3, 4) == "observed"
    assert text.stream_holds([b"ab", b"c", b"d"], b"bcd") and not text.stream_holds([b"ab"], b"ba") and text.stream_holds([], b"")


@pytest.mark.parametrize(("rows", "want"), [([("s", 1, "x"), ("s", 2, "X"), ("s", 3, "x (2)"), ("t", 1, "x")], {("s", 1, "x"), ("s", 2, "X (2)"), ("s", 3, "x (2) (2)"), ("t", 1, "x")})])
def test_numbered_labels_never_collide(spark, rows, want):
    frame = spark.createDataFrame(rows, "source_id string, position int, label string")
    assert {tuple(r) for r in formation.distinct_labels(frame).collect()} == want


def test_candidates_are_looked_for_once_and_all_are_judged(spark):
    from docketry.plans import queries_formation as q
    from docketry.plans.model import Collection

    c = Collection(spark, "/root/testdata/sf0.001")
    assert q._taken(c)._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert q.candidates(c).agg({"position": "max"}).first()[0] <= q.NOTE_CANDIDATES
