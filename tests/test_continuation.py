import pytest

from docketry.operators import boolean as B
from docketry.operators import paths
from docketry.operators.adjacency import Adjacency
from docketry.operators.continuation import IDLE_MS, QueryError, Store

PAGES = "page_id string, title string, kind string, event_date string, format string, processing_status string"
EDGES = "relationship_id string, from_page_id string, to_page_id string, kind string, supported boolean"


@pytest.fixture(scope="module")
def star(spark):
    pages = spark.createDataFrame([(p, p, "x", None, "txt", "complete") for p in ["hub", *(f"n{i:02}" for i in range(20))]], PAGES)
    edges = spark.createDataFrame([(f"r{i:02}", "hub", f"n{i:02}" if i != 7 else "gone", "to", i != 9) for i in range(20)], EDGES)
    return pages, edges


def collected(ask):
    found, problems, token, calls = [], [], None, 0
    while True:
        answer = ask(token)
        found, problems, token, calls = found + answer.results, problems + answer.diagnostics, answer.next_cursor, calls + 1
        assert (token is None) == answer.complete
        if answer.complete:
            return found, problems, calls


def test_budgets_change_calls_and_not_the_result(spark, star, tmp_path):
    queries = B.Queries(Store(spark, str(tmp_path / "b"), "boolean"), *star)
    tree = B.Or((B.Path("hub", (B.Hop("to"),)), B.Path("hub", (B.Hop("none"),))))
    results = {}
    for budget, size in ((50, 50), (7, 3)):
        found, problems, calls = collected(lambda t, b=budget, s=size: queries.query(tree, "r", continuation=t, work_budget=b, page_size=s))
        results[budget] = [r["page_id"] for r in found], problems
    assert results[50] == results[7] and calls > 5
    assert results[7][0] == sorted(f"n{i:02}" for i in range(20) if i not in (7, 9))
    assert [(p[2], p[3]) for p in results[7][1]] == [("r07", "missing_endpoint"), ("r09", "missing_support")]


def test_explorations_examine_no_more_than_their_budget(spark, star, tmp_path):
    explorations = paths.Explorations(Store(spark, str(tmp_path / "p"), "paths"), *star)
    found, _, calls = collected(lambda t: explorations.explore("hub", 1, "r", t, work_budget=7, page_size=50))
    assert sorted(found) == sorted(f"n{i:02}" for i in range(20) if i not in (7, 9)) and calls == 3
    first = explorations.explore("hub", 1, "r", work_budget=7)
    assert [s["relationship_id"] for s in explorations.details(first.next_cursor, "r", "n00")] == ["r00"]


def test_what_ends_a_query(spark, star, tmp_path):
    now = [0]
    store = Store(spark, str(tmp_path / "e"), "boolean", clock=lambda: now[0])
    queries = B.Queries(store, *star)
    tree = B.Path("hub", (B.Hop("to"),))
    token = queries.query(tree, "r", work_budget=1).next_cursor
    assert len(token.encode()) <= 128 and "hub" not in token
    for wrong, why in (({"revision": "s"}, "stale"), ({"expression": B.Not(tree)}, "changed"), ({"continuation": "boolean-v1:x"}, "invalid"), ({"continuation": token.replace("boolean", "paths")}, "invalid"), ({"work_budget": 51}, "units"), ({"page_size": 0}, "results")):
        with pytest.raises(QueryError, match=why):
            queries.query(**{"expression": tree, "revision": "r", "continuation": token, **wrong})
    now[0] = IDLE_MS + 1
    with pytest.raises(QueryError, match="expired"):
        queries.query(tree, "r", continuation=token)
    now[0] = 0
    queries.cancel(token)
    with pytest.raises(QueryError, match="canceled"):
        queries.query(tree, "r", continuation=token)
    assert store.retire() == 1
    with pytest.raises(QueryError, match="invalid"):
        queries.query(tree, "r", continuation=token)


def test_one_path_written_twice_is_two_leaves(star):
    path = B.Path("hub", (B.Hop("to"),))
    row = B.query_pages(*star, B.And((path, path))).orderBy("page_id").first()
    assert [(e["leaf"], list(e["route"])) for e in row["evidence"]] == [(0, ["r00"]), (1, ["r00"])]
    assert B.targets(B.And((path, B.Not(path)))) == ["hub"]


def test_a_chain_beyond_one_plan(spark):
    n = 20
    pages = spark.createDataFrame([(f"n{i:02}", "", "", None, "txt", "complete") for i in range(n)], PAGES)
    edges = spark.createDataFrame([(f"r{i:02}", f"n{i:02}", f"n{i + 1:02}", "next", True) for i in range(n - 1)], EDGES)
    found = paths.explore(pages, edges, "n00", 256)
    assert {(r["page_id"], r["depth"]) for r in found.collect()} == {(f"n{i:02}", i) for i in range(1, n)}
    assert [r["page_id"] for r in B.reached(B.Path("n00", (B.Hop("next"),) * 17), Adjacency.of(pages, edges)).collect()] == ["n17"]


def test_calls_read_ahead_and_go_on_anywhere():
    from docketry.operators.continuation import AHEAD_ROWS, Ahead

    asked, ahead = [], Ahead()

    def take(query, last, count, end):
        def read(n):
            asked.append(n)
            return list(range(0 if last is None else last + 1, end))[:n]

        return ahead.after(query, last, count, lambda r: r, read)

    last, seen = None, []
    while rows := take("a", last, 7, 3000):
        seen, last = seen + rows, rows[-1]
    assert seen == list(range(3000)) and asked == [7, AHEAD_ROWS, AHEAD_ROWS]
    assert take("a", 5, 3, 3000) == [6, 7, 8] and take("b", None, 2, 3) == [0, 1] and take("b", 1, 2, 3) == [2] and take("b", 0, 2, 3) == [1, 2]
