import json
import uuid

import pytest
from pyspark.sql import functions as F

from docketry.plans.commands import COMMANDS, Commands, tree
from docketry.plans.model import Collection

FOLDER = "/root/testdata/sf0.001"
VIEW = str(uuid.uuid5(uuid.NAMESPACE_URL, "view"))


@pytest.fixture(scope="module")
def commands(spark):
    views = {"v.md": json.dumps({"schema": 1, "view_id": VIEW, "name": "Places", "definition": {"references": ["page-nation-3", "gone"]}}), "w.md": "{}"}

    def judge(goal, rows):
        return rows.select("page_id", F.col("title").alias("label"), F.lit(0.9).alias("probability"), "fingerprint")

    segments = spark.createDataFrame([("0", 5, 9)], "source_id string, start long, end long")
    return Commands(Collection(spark, FOLDER), {"segments": segments}, views, judge)


def value(commands, name, **arguments):
    answer = json.loads(next(iter(commands.serve([json.dumps({"command": name, **arguments})]))))
    assert "error" not in answer, answer
    return answer["value"]


def error(commands, name, **arguments):
    return commands.call({"command": name, **arguments})["error"]


def test_searching_and_listing(commands):
    pages = commands.c.pages
    nation = pages.where("page_id = 'page-nation-3'").first()["title"]
    assert "page-nation-3" in [r["page_id"] for r in value(commands, "search_pages", query=nation.lower())]
    assert value(commands, "search_pages", query="nowhere-to-be-found") == []
    groups = value(commands, "collection_groups", axis="place")
    assert [r["id"] for r in groups["rows"]][:1] and groups["next_offset"] is None and len(groups["rows"]) == 30
    orders = value(commands, "collection_members", group_id="format:md")
    assert len(orders["rows"]) == 50 and orders["next_offset"] == 50
    assert value(commands, "collection_members", group_id="format:md", offset=50, seen="other")["changed"]
    assert sum(r["pages"] for r in value(commands, "collection_status")) == pages.count()
    newest = value(commands, "timeline", descending=True)["rows"]
    assert [r["start"] for r in newest] == sorted((r["start"] for r in newest), reverse=True) and len(newest) == 50
    assert len(value(commands, "timeline", mode="collection_activity")["rows"]) == 50
    assert "no messages" in error(commands, "timeline", mode="reasoning_event") and "no timeline" in error(commands, "timeline", mode="x")


def test_sources_and_trails(commands):
    first = value(commands, "list_sources")["rows"][0]
    opened = value(commands, "open_source", source_id=first["source_id"])
    assert opened["text"] and not opened["truncated"]
    body = opened["text"]
    quote = next(body[i : i + 30] for i in range(len(body)) if body.count(body[i : i + 30]) == 1)
    passage = value(commands, "trail_selected_passage", source_id=first["source_id"], quote=quote)
    assert body.encode()[passage["start"] : passage["end"]].decode() == quote
    stop = lambda n, p, source: {"stop_id": str(uuid.uuid5(uuid.NAMESPACE_URL, n)), "source_id": source, "version_id": source, "passage": p}
    moved = {**passage, "start": passage["start"] + 1, "end": passage["end"] + 1}
    states = value(commands, "resolve_trail", stops=[stop("a", passage, first["source_id"]), stop("b", moved, first["source_id"]), stop("c", passage, "gone")])
    assert [r["state"] for r in states] == ["available", "changed", "unavailable"]
    kinds = {r["kind"] for r in value(commands, "trail_source_choices", source_id="0")["rows"]}
    assert kinds == {"message", "segment"}
    assert "exactly once" in error(commands, "trail_selected_passage", source_id=first["source_id"], quote="")
    assert error(commands, "open_source", source_id="gone") == "no such source"
    assert 0 < len(value(commands, "suggest_trail_stops", goal="order")) <= 5


def test_paths_in_calls(commands):
    form = {"path": {"start": "page-region-1", "hops": [{"kind": "part_of", "with_arrow": False}]}}
    found, token = [], None
    while True:
        answer = value(commands, "query_pages", expression={"and": [form, {"not": {"constraint": {"format": "txt"}}}]}, continuation=token)
        found, token = found + answer["results"], answer["next_cursor"]
        if answer["complete"] or found:
            break
    assert all(r["kind"] == "place" for r in found) and answer["revision"] == value(commands, "path_graph_revision")
    near = value(commands, "explore_paths", start="page-region-1", max_hops=1, work_budget=2)
    assert len(near["results"]) == 2 and near["next_cursor"]
    steps = value(commands, "explore_path_details", continuation=near["next_cursor"], target=near["results"][0])
    assert steps[0]["page_id"] == near["results"][0]
    first = value(commands, "query_pages", expression=form, work_budget=1)
    value(commands, "cancel_query", continuation=first["next_cursor"])
    assert "canceled" in error(commands, "query_pages", expression=form, continuation=first["next_cursor"])
    page = value(commands, "open_knowledge_page", page_id="page-region-1")
    assert {r["kind"] for r in page["relationships"]} == {"part_of"} and not any(r["with_arrow"] for r in page["relationships"])


def test_views_links_and_errors(commands):
    assert [v["state"] for v in value(commands, "list_saved_views")] == ["invalid", "available"]
    assert [p["state"] for p in value(commands, "open_saved_view", view_id=VIEW)["pages"]] == ["available", "unavailable"]
    assert value(commands, "resolve_page_link", page="pages/a.md", link="page-nation-3.md#x") == "page-nation-3"
    assert value(commands, "resolve_page_link", page="pages/a.md", link="none.md") is None
    assert "no command" in error(commands, "drop") and "no compared" in error(commands, "comparison_side", source_id="a") and "no gap_sources" in error(commands, "inspect_gaps", page_id="a")
    assert "error" in commands.call({"command": "explore_paths"}) and list(commands.serve(["", "[]", "{"]))[0] == '{"error": "a request is an object"}'
    with pytest.raises(ValueError):
        tree({"xor": []})
    assert len(COMMANDS) == 22


def test_gaps_and_sides_of_given_tables(spark):
    sources = spark.createDataFrame(
        [("p1", "s1", True, False, "partial", "half", False, None, "failed", None, 5, False), ("p2", "s2", False, True, "empty", "", False, None, "complete", None, None, False)],
        "page_id string, source_id string, available boolean, original boolean, extraction string, detail string, ambiguous boolean, update_status string, state string, error string, retry_at long, edited boolean",
    )
    coverage = spark.createDataFrame([("p1", "page 2", "partial", "unread")], "page_id string, location string, status string, detail string")
    relationships = spark.createDataFrame([("p2", "r1", "", False)], "page_id string, relationship_id string, qualifier string, supported boolean")
    compared = spark.createDataFrame([("s1", "v1", "T", "a\nb\nc", None, None, True, False, True, True, False)], "source_id string, version_id string, title string, text string, coverage struct<a:int>, linked array<string>, available boolean, superseded boolean, original boolean, intact boolean, timed boolean")
    given = Commands(Collection(spark, FOLDER), {"gap_sources": sources, "coverage": coverage, "relationships": relationships, "compared": compared})
    found = value(given, "inspect_gaps", page_id="p1")
    assert [g["rule"] for g in found["gaps"]] == [2, 5, 6, 8] and not found["truncated"]
    assert found["gaps"][1]["recovery"] == {"how": "scheduled", "retry_at": 5}
    assert [g["rule"] for g in value(given, "inspect_gaps", page_id="p2")["gaps"]] == [1, 9]
    side = value(given, "comparison_side", source_id="s1", line=2)
    assert side["state"] == "fresh" and side["passage"]["text"] == "b\nc"
    assert value(given, "comparison_side", source_id="s1", expected="other")["state"] == "stale"
    assert error(given, "comparison_side", source_id="s9") == "no such source"
