"""Looking at sources side by side, at what is missing, and along trails; saved views."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import frame_hash, passage
from docketry.session import ship

# Fixed values.
MAX_GAPS, MAX_STOPS, MAX_QUOTE, MAX_GOAL, MAX_VIEW, MAX_NAME, MAX_TAGS = 100, 50, 2048, 1024, 256 << 10, 120, 32
JUDGED, SUGGESTED, ASKED = 0.7, 5, 12


# ---- comparison --------------------------------------------------------------------------


def signature(sources: DataFrame) -> DataFrame:
    """sources (version_id, title, text, coverage, linked) with the digest of all that a comparison shows."""
    return sources.withColumn("signature", frame_hash(F.col("version_id"), F.col("title"), F.col("text"), F.to_json("coverage"), F.array_join(F.array_sort("linked"), "\n")))


def side(sources: DataFrame, line: int, expected: Column | None = None) -> DataFrame:
    """(source_id, state, reason, signature, passage): a source's side of a comparison, from one line on.

    Reasons in order: unavailable page, superseded, missing original, integrity, no text, stale, missing
    passage. sources: source_id, available, superseded, original, intact, timed, and signature()'s columns.
    """

    def cut(texts: pd.Series) -> pd.DataFrame:
        found = [passage(t, line) if t else None for t in texts]
        return pd.DataFrame([p or {"text": None, "start": None, "end": None, "next_line": None, "truncated": None} for p in found])

    cut.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    ship(sources.sparkSession)
    rows = signature(sources).withColumn("p", F.pandas_udf(cut, "text string, start long, end long, next_line long, truncated boolean")(F.when(~F.col("timed"), F.col("text"))))
    reason = (
        F.when(~F.col("available"), "unavailable_page").when(F.col("superseded"), "superseded").when(~F.col("original"), "missing_original").when(~F.col("intact"), "integrity")
        .when(F.coalesce(F.length("text"), F.lit(0)) == 0, "no_text")
    )
    if expected is not None:
        reason = reason.when(F.col("signature") != expected, "stale")
    reason = reason.when(F.col("p.text").isNull(), "missing_passage")
    state = F.when(reason.isNull(), "fresh").when(reason == "stale", "stale").otherwise("unavailable")
    return rows.select("source_id", state.alias("state"), reason.alias("reason"), "signature", F.when(reason.isNull(), F.col("p")).alias("passage"))


# ---- gaps --------------------------------------------------------------------------------


def update_category(status: Column, error: Column) -> Column:
    ambiguous = (status == "uncertain") & F.coalesce(error.contains("identity") | error.contains("ambiguous"), F.lit(False))
    return F.when(ambiguous, "identity_ambiguous").when(status.isin("failed", "incomplete", "uncertain"), "update_failed").when(status.isNotNull(), "update_pending")


def recovery(state: Column, retry_at: Column) -> Column:
    """struct(how, retry_at): whether a retry is scheduled (and when, in epoch milliseconds), queued, or neither."""
    how = F.when(retry_at.isNotNull(), "scheduled").when(state.isin("pending", "processing"), "queued").otherwise("none")
    return F.struct(how.alias("how"), retry_at.cast("long").alias("retry_at"))


def gaps(sources: DataFrame, coverage: DataFrame, relationships: DataFrame) -> DataFrame:
    """(page_id, category, scope, detail, recovery, rule): everything that keeps a page's knowledge incomplete.

    sources: page_id, source_id, available, original, extraction, detail, ambiguous, update_status, state,
    error, retry_at, edited (outside, and uncertain). coverage: page_id, location, status, detail. relationships: page_id,
    relationship_id, qualifier, supported.
    """

    def rule(n: int, rows: DataFrame, category: Column | str, scope: str, detail: Column, how: Column | None = None) -> DataFrame:
        category = F.lit(category) if isinstance(category, str) else category
        return rows.select("page_id", category.alias("category"), F.col(scope).alias("scope"), detail.alias("detail"), (F.lit(None).cast("struct<how:string,retry_at:bigint>") if how is None else how).alias("recovery"), F.lit(n).alias("rule"))

    how = recovery(F.col("state"), F.col("retry_at"))
    there = sources.where("available")
    complete = F.col("extraction").isin("empty", "text_preserved", "structured_text")
    stuck = F.when(F.col("state") == "failed", "update_failed").when(F.col("state") == "unavailable", "insufficient_support").otherwise("update_pending")
    open_ = there.where((F.col("extraction") != "empty") | F.col("update_status").isNotNull())
    parts = [
        rule(1, sources.where("NOT available"), "source_unavailable", "source_id", F.lit("The source page is unavailable")),
        rule(2, there.where("NOT original"), "source_unavailable", "source_id", F.lit("The retained original is unavailable")),
        rule(3, there.where("extraction = 'empty'"), "empty_source", "source_id", F.col("detail")),
        rule(4, there.where("ambiguous"), "identity_ambiguous", "source_id", F.lit("Several pages claim this identity")),
        rule(5, open_.where(~complete), "extraction_incomplete", "source_id", F.col("detail"), how),
        rule(6, coverage.where("status <> 'complete'"), "extraction_incomplete", "location", F.col("detail")),
        rule(7, open_.where("update_status IS NOT NULL"), update_category(F.col("update_status"), F.col("error")), "source_id", F.coalesce("error", F.lit("The replacement has not completed")), how),
        rule(8, open_.where("update_status IS NULL AND state <> 'complete'"), stuck, "source_id", F.coalesce("error", F.lit("Processing has not completed")), how),
        rule(9, relationships.where("NOT supported"), "insufficient_support", "relationship_id", F.lit("No support of the relationship is left")),
        rule(10, relationships.where("supported AND trim(qualifier) <> ''"), "insufficient_support", "relationship_id", F.col("qualifier")),
        rule(11, there.where("edited"), "insufficient_support", "source_id", F.lit("An edit made outside could not become current facts")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def with_sources(found: DataFrame, knowledge: DataFrame) -> DataFrame:
    """gaps() with those of knowledge pages' sources added to the pages (page_id, source_page_id), the sources' first."""
    of_source = knowledge.join(found.withColumnRenamed("page_id", "source_page_id"), "source_page_id").select("page_id", "category", "scope", "detail", "recovery", "rule", F.lit(0).alias("part"))
    return found.withColumn("part", F.lit(1)).unionByName(of_source)


def first_gaps(found: DataFrame) -> DataFrame:
    """The first MAX_GAPS gaps of each page, numbered by rule and scope, and whether there may be more."""
    by = Window.partitionBy("page_id")
    order = [*(["part"] if "part" in found.columns else []), "rule", "scope", "detail"]
    rows = found.withColumn("position", F.row_number().over(by.orderBy(*order))).where(F.col("position") <= MAX_GAPS)
    return rows.withColumn("truncated", F.count("*").over(by) >= MAX_GAPS)


def inspect(found: DataFrame, page_id: str) -> tuple[list, bool]:
    """A page's first MAX_GAPS gaps by rule and scope, and whether there may be more."""
    rows = found.where(F.col("page_id") == page_id).orderBy("rule", "scope", "detail").limit(MAX_GAPS).collect()
    return rows, len(rows) >= MAX_GAPS


# ---- trails ------------------------------------------------------------------------------


def source_choices(messages: DataFrame, segments: DataFrame, frames: DataFrame) -> DataFrame:
    """(source_id, kind, locator, at): what of a source a trail can stop at."""
    return (
        messages.select("source_id", F.lit("message").alias("kind"), F.col("message").cast("string").alias("locator"), F.col("position").cast("long").alias("at"))
        .unionByName(segments.select("source_id", F.lit("segment").alias("kind"), F.concat_ws("-", "start", "end").alias("locator"), F.col("start").cast("long").alias("at")))
        .unionByName(frames.select("source_id", F.lit("frame").alias("kind"), F.col("at").cast("string").alias("locator"), F.col("at").cast("long").alias("at")))
    )


def validate_stops(stops: list[dict]) -> None:
    """At most MAX_STOPS, unique UUIDs, one target each (a page, a passage or a moment), quotes of bounded size."""
    if len(stops) > MAX_STOPS:
        raise ValueError("too many stops")
    if len({str(uuid.UUID(s["stop_id"])) for s in stops}) != len(stops):
        raise ValueError("stops repeat an identity")
    for stop in stops:
        if sum(stop.get(k) is not None for k in ("page_id", "passage", "moment")) != 1:
            raise ValueError("a stop has one target")
        if len((stop.get("passage") or {}).get("quote", "").encode()) > MAX_QUOTE:
            raise ValueError("the quote is too long")


def resolve_trail(stops: DataFrame, sources: DataFrame) -> DataFrame:
    """Stops (stop_id, position, source_id, version_id, quote, start, end) with `state` against sources (source_id, version_id, text).

    available: the version is current, or the same bytes still stand there; changed: they do not; unavailable:
    the source is gone. Similar text elsewhere is never taken instead.
    """
    from docketry.operators.evidence import quote_holds

    now = sources.select("source_id", F.col("version_id").alias("now"), "text")
    rows = stops.join(now, "source_id", "left")
    holds = F.col("quote").isNull() | quote_holds(F.col("text"), F.col("quote"), F.col("start"), F.col("end"))
    same = F.col("now") == F.col("version_id")
    state = F.when(F.col("now").isNull(), "unavailable").when(same & holds, "available").otherwise("changed")
    return rows.select("stop_id", "position", "source_id", state.alias("state"))


def suggestions(hits: DataFrame, judgments: DataFrame) -> DataFrame:
    """The SUGGESTED likeliest of the first ASKED hits (page_id, title, rank, fingerprint) that a judge (page_id, label, probability, fingerprint) finds likely; a changed page is not suggested."""
    asked = hits.orderBy("rank", "title", "page_id").limit(ASKED)
    return asked.join(judgments, ["page_id", "fingerprint"]).where(F.col("probability") >= JUDGED).orderBy(F.desc("probability"), "label").limit(SUGGESTED).select("page_id", "label", "probability")


# ---- saved views -------------------------------------------------------------------------


def parse_view(text: str) -> dict:
    """A saved view's JSON definition, validated."""
    if len(text.encode()) > MAX_VIEW:
        raise ValueError("the view is too large")
    view = json.loads(text)
    if view.get("schema") != 1 or set(view) - {"schema", "view_id", "name", "definition"}:
        raise ValueError("not a view of schema 1")
    uuid.UUID(view["view_id"])
    if not view["name"].strip() or len(view["name"]) > MAX_NAME:
        raise ValueError("a view needs a name of at most 120 characters")
    search = view["definition"].get("search") or {}
    if len(search.get("query", "")) > MAX_GOAL or len(search.get("tags", [])) > MAX_TAGS:
        raise ValueError("the search is too large")
    return view


def list_views(files: dict[str, str]) -> list[tuple[str, str, str, str]]:
    """(name, view_id, path, state) of view files by name, id and path; views that share an id are duplicates and none is opened."""
    rows, count = [], {}
    for path, text in files.items():
        try:
            view = parse_view(text)
        except (ValueError, KeyError, TypeError, AttributeError):
            rows.append(("", "", path, "invalid"))
            continue
        count[view["view_id"]] = count.get(view["view_id"], 0) + 1
        rows.append((view["name"], view["view_id"], path, "available"))
    rows = [(n, i, p, "duplicate" if count.get(i, 0) > 1 else s) for n, i, p, s in rows]
    return sorted(rows, key=lambda r: (r[0].lower(), r[1], r[2]))


def open_view(files: dict[str, str], view_id: str) -> dict:
    """The one view of an identity; a missing or duplicate one is an error, and no file is chosen."""
    uuid.UUID(view_id)
    hits = []
    for text in files.values():
        try:
            view = parse_view(text)
        except (ValueError, KeyError, TypeError, AttributeError):
            continue
        if view["view_id"] == view_id:
            hits.append(view)
    if len(hits) != 1:
        raise ValueError("the view is missing or its identity is ambiguous")
    return hits[0]


def resolve_view(view: dict, pages: DataFrame) -> DataFrame:
    """(reference, title, kind, state) of the pages that a view names; one that is gone is unavailable, and nothing takes its place."""
    definition = view["definition"]
    named = list(dict.fromkeys([*definition.get("references", []), *([definition["target"]] if definition.get("target") else []), *(s["page_id"] for s in definition.get("trail", []) if s.get("page_id"))]))
    rows = pages.sparkSession.createDataFrame([(n, r) for n, r in enumerate(named)], "position int, reference string")
    known = pages.select(F.col("page_id").alias("reference"), "title", "kind", F.lit("available").alias("state"))
    return rows.join(known, "reference", "left").select("position", "reference", "title", "kind", F.coalesce("state", F.lit("unavailable")).alias("state"))
