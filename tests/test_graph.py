import pytest

from docketry.operators import boolean as B
from docketry.operators import paths

PAGES = "page_id string, title string, kind string, event_date string, format string, processing_status string"
EDGES = "relationship_id string, from_page_id string, to_page_id string, kind string, supported boolean"


@pytest.fixture(scope="module")
def graph(spark):
    rows = [("maya", "person", None), ("theo", "person", None), ("v17", "event", "2024-05-17"), ("v18", "event", "2024-06-18"), ("riverside", "place", None), ("paris", "place", None)]
    pages = spark.createDataFrame([(i, i.title(), k, d, "txt", "complete") for i, k, d in rows] + [("note", "note", "source", None, "txt", "pending")], PAGES)
    edges = spark.createDataFrame([
        ("r1", "v17", "maya", "observed_by", True), ("r2", "v18", "maya", "observed_by", True), ("r3", "v17", "riverside", "occurred_at", True),
        ("r4", "v18", "paris", "occurred_at", True), ("r5", "riverside", "maya", "links_to", True), ("r6", "riverside", "riverside", "related_to", True),
    ], EDGES)
    return pages, edges


SEEN, AT = B.Hop("observed_by", False), B.Hop("occurred_at")
RIVERSIDE = B.Path("maya", (SEEN, AT), intermediate=B.Constraint(date_from="2024-05-17", date_to="2024-05-17"))
LATER = B.Path("maya", (SEEN, AT), intermediate=B.Constraint(date_from="2024-06-18"))


@pytest.mark.parametrize(
    ("tree", "expected"),
    [
        (RIVERSIDE, {"riverside"}),
        (B.Or((RIVERSIDE, LATER)), {"riverside", "paris"}),
        (B.And((RIVERSIDE, LATER)), set()),
        (B.And((B.Or((RIVERSIDE, LATER)), B.Not(RIVERSIDE))), {"paris"}),
        (B.Not(B.Constraint(processing_status="pending")), {"maya", "theo", "v17", "v18", "riverside", "paris"}),
        (B.And(()), {"maya", "theo", "v17", "v18", "riverside", "paris", "note"}),
        (B.Or(()), set()),
        (B.Not(B.And(())), set()),
        (B.Path("maya", (SEEN, AT, B.Hop("links_to"))), {"maya"}),
        (B.Path("maya", (SEEN, B.Hop("occurred_at", False))), set()),
        (B.Not(B.Constraint(date_from="2024-06-01")), {"maya", "theo", "v17", "riverside", "paris", "note"}),
    ],
)
def test_boolean_queries(graph, tree, expected):
    assert {r["page_id"] for r in B.query_pages(*graph, tree).collect()} == expected


def test_evidence_survives_double_negation(graph):
    tree = B.Not(B.And((B.Not(RIVERSIDE), B.Not(B.Path("theo", (SEEN,))))))
    row = B.query_pages(*graph, tree).first()
    assert row["page_id"] == "riverside" and [list(e["route"]) for e in row["evidence"]] == [["r1", "r3"]]


def test_limits_and_errors(graph):
    leaf = B.Constraint()
    B.leaves(B.And((leaf,) * 63))
    with pytest.raises(ValueError):
        B.leaves(B.And((leaf,) * 64))
    with pytest.raises(ValueError):
        B.query_pages(*graph, B.Path("nobody", (SEEN,)))
    with pytest.raises(ValueError):
        B.Constraint(processing_status="done").validate()


def test_missing_endpoint_is_told(graph):
    pages, edges = graph
    rows = B.diagnostics(RIVERSIDE, pages.where("page_id <> 'riverside'"), edges).collect()
    assert [(r["depth"], r["relationship_id"], r["issue"]) for r in rows] == [(2, "r3", "missing_endpoint")]


def test_exploration_reaches_each_page_once(graph):
    found = {r["page_id"]: (r["depth"], [s["relationship_id"] for s in r["steps"]]) for r in paths.explore(*graph, "maya", 2).collect()}
    assert found == {"v17": (1, ["r1"]), "v18": (1, ["r2"]), "riverside": (1, ["r5"]), "paris": (2, ["r2", "r4"])}


def test_long_chain(spark):
    n = 9
    pages = spark.createDataFrame([(f"n{i}", "", "", None, "txt", "complete") for i in range(n)], PAGES)
    edges = spark.createDataFrame([(f"r{i}", f"n{i}", f"n{i + 1}", "next", True) for i in range(n - 1)], EDGES)
    assert {(r["page_id"], r["depth"]) for r in paths.explore(pages, edges, "n0", 8).collect()} == {(f"n{i}", i) for i in range(1, n)}
