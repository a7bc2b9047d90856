"""A collection's commands by name, with JSON in and out.

    echo '{"command": "explore_paths", "start": "page-nation-3", "max_hops": 1}' | python -m docketry.plans.commands FOLDER

A request is an object with `command` and the command's arguments; the answer has `value` or `error`.
Lists are at most a page long; longer ones go on by an offset or a continuation.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Callable, Iterable
from dataclasses import is_dataclass
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from docketry.functions import text
from docketry.operators import boolean, collection, inspect, paths, reconcile, search, timeline
from docketry.operators.continuation import Store
from docketry.plans.model import Collection
from docketry.session import shared_dir

#: Bytes of a source's text that a reader is shown. Fixed value.
PREVIEW = 2 << 20
_STOP = "stop_id string, position int, source_id string, version_id string, quote string, start long, end long"

COMMANDS: dict[str, Callable] = {}


def command(f: Callable) -> Callable:
    COMMANDS[f.__name__] = f
    return f


def plain(value: Any) -> Any:
    """Rows, pages and answers as JSON has them."""
    if isinstance(value, Row):
        return value.asDict(recursive=True)
    if is_dataclass(value):
        return plain({name: getattr(value, name) for name in value.__dataclass_fields__})
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def tree(form: dict) -> boolean.Expression:
    """{"path": ...}, {"constraint": ...}, {"and": [...]}, {"or": [...]} or {"not": ...} as a query tree."""
    if not isinstance(form, dict) or len(form) != 1:
        raise ValueError("an expression has one form")
    (name, body), = form.items()
    if name == "path":
        hops = tuple(boolean.Hop(**hop) for hop in body["hops"])
        return boolean.Path(body["start"], hops, boolean.Constraint(**body.get("endpoint", {})), boolean.Constraint(**body.get("intermediate", {})))
    if name == "constraint":
        return boolean.Constraint(**body)
    if name == "not":
        return boolean.Not(tree(body))
    if name in ("and", "or"):
        return (boolean.And if name == "and" else boolean.Or)(tuple(tree(e) for e in body))
    raise ValueError(f"no expression {name}")


class Commands:
    """Commands over a collection.

    `tables` may give what the warehouse tables lack: `compared` (see inspect.side), `gap_sources`,
    `coverage` and `relationships` (see inspect.gaps), `messages` (see timeline.reasoning_events),
    `segments` and `frames` (see inspect.source_choices). `views` are saved views' files by path;
    `judge` gives probabilities for a goal and rows (page_id, title, fingerprint), as
    inspect.suggestions takes them.
    """

    def __init__(self, c: Collection, tables: dict[str, DataFrame] | None = None, views: dict[str, str] | None = None, judge: Callable[[str, DataFrame], DataFrame] | None = None) -> None:
        self.c, self.tables, self.views, self.judge = c, tables or {}, views or {}, judge
        # What the collection's files are decides whether a list or a continuation is stale, without reading a row.
        self.revision = hashlib.sha256(c.stamp.encode()).hexdigest()

    def call(self, request: dict) -> dict:
        arguments = dict(request)
        name = arguments.pop("command", None)
        if name not in COMMANDS:
            return {"error": f"no command {name}"}
        try:
            return {"value": plain(COMMANDS[name](self, **arguments))}
        except (ValueError, TypeError, KeyError) as error:
            return {"error": str(error)}

    def serve(self, lines: Iterable[str]) -> Iterable[str]:
        """One answer a line for one request a line."""
        for line in lines:
            if line.strip():
                try:
                    request = json.loads(line)
                except ValueError as error:
                    yield json.dumps({"error": str(error)})
                    continue
                yield json.dumps(self.call(request) if isinstance(request, dict) else {"error": "a request is an object"}, default=str)

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise ValueError(f"the collection has no {name}")
        return self.tables[name]

    def store(self, kind: str) -> Store:
        return Store(self.c.spark, f"{shared_dir(self.c.spark).rstrip('/')}/{kind}-queries", kind)

    @property
    def source_rows(self) -> DataFrame:
        """sources without their texts, stored."""
        return self.c.stored("source_rows", lambda: self.c.sources.drop("text"), ["source_id"])

    def source_text(self, source_id: str) -> tuple[Row, str]:
        row = self.source_rows.where(F.col("source_id") == source_id).first()
        if row is None:
            raise ValueError("no such source")
        return row, self.c.table("documents").where(F.col("doc_id") == row["first_doc"]).first()["text"] or ""

    def keyword(self, query: str, filters: dict) -> DataFrame:
        def words() -> DataFrame:
            texts = self.c.sources.select("source_id", F.col("text").alias("content"))
            return search.inverted(self.c.pages.join(texts, "source_id", "left").select("page_id", "title", "content"))

        wanted = search.Filters(**{**filters, "tags": tuple(filters.get("tags", ()))})
        return search.keyword(self.c.stored("page_words", words, ["word"]), self.c.pages, self.c.tags, query, wanted)

    # ---- searching and following paths -----------------------------------------------

    @command
    def search_pages(self, query: str = "", offset: int = 0, **filters: Any) -> list:
        return search.ranked(self.keyword(query, filters), offset).collect()

    @command
    def query_pages(self, expression: dict, returned: dict | None = None, continuation: str | None = None, **limits: int) -> boolean.Answer:
        queries = boolean.Queries(self.store("boolean"), self.c.pages, self.c.adjacency)
        return queries.query(tree(expression), self.revision, boolean.Constraint(**(returned or {})), continuation, **limits)

    @command
    def cancel_query(self, continuation: str) -> None:
        self.store("boolean").cancel(continuation)

    @command
    def path_graph_revision(self) -> str:
        return self.revision

    @command
    def explore_paths(self, start: str, max_hops: int, continuation: str | None = None, **limits: int) -> boolean.Answer:
        return paths.Explorations(self.store("paths"), self.c.pages, self.c.adjacency).explore(start, max_hops, self.revision, continuation, **limits)

    @command
    def explore_path_details(self, continuation: str, target: str, offset: int = 0) -> list:
        return paths.Explorations(self.store("paths"), self.c.pages, self.c.adjacency).details(continuation, self.revision, target, offset)

    # ---- lists -----------------------------------------------------------------------

    @command
    def timeline(self, mode: str = "source_event", query: str = "", tags: list[str] | None = None, descending: bool = False, offset: int = 0) -> dict:
        dated = self.c.pages.where("kind = 'event'")
        entries = {
            "source_event": lambda: timeline.source_events(dated.select("page_id", "title"), dated.select("page_id", F.col("event_date").alias("value"))),
            "reasoning_event": lambda: timeline.reasoning_events(self.table("messages")), "collection_activity": lambda: timeline.collection_activity(self.c.acquisitions),
        }
        if mode not in entries:
            raise ValueError(f"no timeline {mode}")
        rows, following = timeline.page(timeline.search(entries[mode](), query, tags, self.c.tags), descending, offset)
        return {"rows": rows, "next_offset": following}

    @command
    def collection_groups(self, axis: str, query: str = "", offset: int = 0) -> collection.Page:
        return collection.page(collection.groups(self.c.pages, self.c.tags, self.c.source_links, axis, query), ["label", "id"], offset)

    @command
    def collection_members(self, group_id: str, offset: int = 0, seen: str | None = None) -> dict:
        out = collection.member_page(self.c.pages, self.c.tags, self.c.source_links, group_id, offset, seen, self.revision)
        return {**plain(out), "revision": self.revision}

    @command
    def list_sources(self, offset: int = 0) -> collection.Page:
        return collection.page(self.source_rows, ["source_id"], offset)

    @command
    def open_source(self, source_id: str) -> dict:
        row, body = self.source_text(source_id)
        shown = text.cut_utf8(body, PREVIEW)
        return {**row.asDict(), "text": shown, "truncated": len(shown) < len(body)}

    @command
    def open_knowledge_page(self, page_id: str) -> dict:
        page = self.c.pages.where(F.col("page_id") == page_id).first()
        if page is None:
            raise ValueError("no such page")
        around = self.c.adjacency.around([page_id]).where("supported").orderBy("kind", "way", "relationship_id").limit(collection.PAGE_SIZE)
        tags = self.c.tags.where(F.col("page_id") == page_id).orderBy("normalized").limit(collection.PAGE_SIZE)
        return {**page.asDict(), "tags": [r["label"] for r in tags.collect()], "relationships": around.select("relationship_id", "kind", (F.col("way") == 1).alias("with_arrow"), F.col("next").alias("page_id")).collect()}

    @command
    def collection_status(self) -> list:
        return self.c.pages.groupBy("page_type", "processing_status").agg(F.count("*").alias("pages")).orderBy("page_type", "processing_status").collect()

    @command
    def resolve_page_link(self, page: str, link: str) -> str | None:
        path = text.resolve_relative(page, link)
        if path is None:
            return None
        asked = self.c.spark.createDataFrame([(page, link, path)], "page string, link string, path string")
        places = self.c.pages.select(F.concat(F.lit("pages/"), "page_id", F.lit(".md")).alias("path"), "page_id").where(F.col("path") == path)
        return reconcile.resolve_links(asked, places).first()["page_id"]

    # ---- comparison, gaps, trails and views ------------------------------------------

    @command
    def comparison_side(self, source_id: str, line: int = 1, expected: str | None = None) -> Row:
        found = inspect.side(self.table("compared").where(F.col("source_id") == source_id), line, None if expected is None else F.lit(expected)).first()
        if found is None:
            raise ValueError("no such source")
        return found

    @command
    def inspect_gaps(self, page_id: str) -> dict:
        mine = [self.table(name).where(F.col("page_id") == page_id) for name in ("gap_sources", "coverage", "relationships")]
        rows, truncated = inspect.inspect(inspect.gaps(*mine), page_id)
        return {"gaps": rows, "truncated": truncated}

    @command
    def resolve_trail(self, stops: list[dict]) -> list:
        """Stops at passages: stop_id, source_id, version_id, and `passage` (quote, start, end)."""
        inspect.validate_stops(stops)
        rows = [(s["stop_id"], n, s["source_id"], s.get("version_id"), *(s["passage"].get(k) for k in ("quote", "start", "end"))) for n, s in enumerate(stops) if s.get("passage") is not None]
        named = sorted({r[2] for r in rows})
        places = self.source_rows.where(F.col("source_id").isin(named)).select("source_id", F.col("first_doc").alias("doc_id"))
        texts = self.c.table("documents").where(F.col("doc_id").isin([r["doc_id"] for r in places.collect()])).join(places, "doc_id")
        sources = texts.select("source_id", F.col("source_id").alias("version_id"), F.coalesce("text", F.lit("")).alias("text"))
        return inspect.resolve_trail(self.c.spark.createDataFrame(rows, _STOP), sources).orderBy("position").collect()

    @command
    def trail_source_choices(self, source_id: str, offset: int = 0) -> collection.Page:
        mine = lambda frame: frame.where(F.col("source_id").cast("string") == source_id)
        messages = self.c.passages.select(F.col("session").alias("source_id"), "message", "position")
        none = self.c.spark.createDataFrame([], "source_id string, start long, end long, at long")
        choices = inspect.source_choices(mine(messages), mine(self.tables.get("segments", none)), mine(self.tables.get("frames", none)))
        return collection.page(choices, ["kind", "at", "locator"], offset)

    @command
    def trail_selected_passage(self, source_id: str, quote: str) -> dict:
        start, end = text.locate(self.source_text(source_id)[1], quote)
        return {"source_id": source_id, "version_id": source_id, "quote": quote, "start": start, "end": end}

    @command
    def suggest_trail_stops(self, goal: str) -> list:
        if self.judge is None:
            raise ValueError("no judge was given")
        if not goal.strip() or len(goal.encode()) > inspect.MAX_GOAL:
            raise ValueError("a goal has 1 to 1024 bytes")
        hits = self.keyword(goal, {}).withColumn("fingerprint", F.sha2(F.concat_ws("\n", "page_id", "title"), 256))
        asked = search.ranked(hits, 0, inspect.ASKED)
        return inspect.suggestions(asked, self.judge(goal, asked.select("page_id", "title", "fingerprint"))).collect()

    @command
    def list_saved_views(self, offset: int = 0) -> list:
        rows = inspect.list_views(self.views)[offset : offset + collection.PAGE_SIZE]
        return [dict(zip(("name", "view_id", "path", "state"), row, strict=True)) for row in rows]

    @command
    def open_saved_view(self, view_id: str) -> dict:
        view = inspect.open_view(self.views, view_id)
        return {**view, "pages": inspect.resolve_view(view, self.c.pages).orderBy("position").collect()}


def main() -> None:
    from docketry.session import ship

    spark = ship(SparkSession.builder.appName("docketry").getOrCreate())
    for answer in Commands(Collection(spark, sys.argv[1])).serve(sys.stdin):
        print(answer, flush=True)


if __name__ == "__main__":
    main()
