"""Grouping a collection, listing a group's members, and its revision."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import contains_literal, fold, is_true, sum_of_hashes

PAGE_SIZE = 50
AXES = ("topic", "person", "place", "date", "format")
MAX_QUERY_BYTES, MAX_GROUP_BYTES = 512, 1024


def groups(pages: DataFrame, tags: DataFrame, links: DataFrame, axis: str, query: str = "") -> DataFrame:
    """(id, label, members) of an axis whose labels hold the query; unordered, see page().

    A subject counts itself and its source pages. Missing dates are one group.
    """
    if axis not in AXES:
        raise ValueError(f"no axis {axis}")
    if len(query.encode()) > MAX_QUERY_BYTES:
        raise ValueError("the filter is too long")
    counts = links.groupBy(F.col("knowledge_page_id").alias("page_id")).agg(F.count("*").alias("n"))

    def subjects(kinds: list[str] | None) -> DataFrame:
        found = pages.where(F.col("page_type") == "knowledge")
        found = found.where(F.col("kind").isin(kinds)) if kinds else found
        return found.join(counts, "page_id", "left").select(F.concat(F.lit("subject:"), "page_id").alias("id"), F.col("title").alias("label"), (1 + F.coalesce("n", F.lit(0))).cast("long").alias("members"))

    if axis == "topic":
        tagged = tags.groupBy("normalized").agg(F.min("label").alias("label"), F.countDistinct("page_id").alias("members"))
        loose = unclassified(pages, tags, links).agg(F.count("*").alias("members")).where("members > 0")
        out = subjects(None).unionByName(tagged.select(F.concat(F.lit("tag:"), "normalized").alias("id"), "label", "members"))
        out = out.unionByName(loose.select(F.lit("unclassified:").alias("id"), F.lit("Unclassified").alias("label"), "members"))
    elif axis in ("person", "place"):
        out = subjects([axis])
    elif axis == "date":
        dated = pages.groupBy("event_date").agg(F.count("*").alias("members"))
        out = dated.select(F.concat(F.lit("date:"), F.coalesce("event_date", F.lit(""))).alias("id"), F.coalesce("event_date", F.lit("Unknown event date")).alias("label"), "members")
    else:
        out = pages.groupBy("format").agg(F.count("*").alias("members")).select(F.concat(F.lit("format:"), "format").alias("id"), F.upper("format").alias("label"), "members")
    return out.where(contains_literal("label", query))


def unclassified(pages: DataFrame, tags: DataFrame, links: DataFrame) -> DataFrame:
    """Source pages without tags that no knowledge page comes from."""
    sources = pages.where(F.col("page_type") == "source")
    return sources.join(tags.select("page_id").distinct(), "page_id", "left_anti").join(links.select(F.col("source_page_id").alias("page_id")).distinct(), "page_id", "left_anti")


def members(pages: DataFrame, tags: DataFrame, links: DataFrame, group_id: str) -> DataFrame:
    """The pages of a group."""
    if len(group_id.encode()) > MAX_GROUP_BYTES or ":" not in group_id:
        raise ValueError("no such group")
    kind, _, value = group_id.partition(":")
    if kind == "subject":
        near = links.where(F.col("knowledge_page_id") == value).select(F.col("source_page_id").alias("page_id")).distinct()
        return pages.where(F.col("page_id") == value).unionByName(pages.where(F.col("page_id") != value).join(near, "page_id", "left_semi"))
    if kind == "source":
        return pages.where(is_true(F.col("source_id") == value))
    if kind == "tag":
        return pages.join(tags.where(F.col("normalized") == value).select("page_id"), "page_id", "left_semi")
    if kind == "date":
        return pages.where(F.col("event_date") == value if value else F.col("event_date").isNull())
    if kind == "format":
        return pages.where(F.col("format") == value)
    if kind == "unclassified":
        return unclassified(pages, tags, links)
    raise ValueError("no such group")


@dataclass
class Page:
    rows: list
    next_offset: int | None
    changed: bool = False


def page(frame: DataFrame, by: list[str], offset: int = 0, size: int = PAGE_SIZE) -> Page:
    """A page of rows in ASCII-folded order of the first column, then the others; one row more tells whether another page follows."""
    rows = frame.orderBy(fold(by[0]), *by[1:]).offset(offset).limit(size + 1).collect()
    return Page(rows[:size], offset + size if len(rows) > size else None)


def member_page(pages: DataFrame, tags: DataFrame, links: DataFrame, group_id: str, offset: int, seen: str | None, revision: str) -> Page:
    """members() by title; a list that began under another revision starts anew."""
    changed = seen is not None and seen != revision
    out = page(members(pages, tags, links, group_id), ["title", "page_id"], 0 if changed else offset)
    return Page(out.rows, out.next_offset, changed)


def revision(pages: DataFrame, tags: DataFrame) -> str:
    """A digest of all rows that groups depend on, whatever their order."""
    told = sum_of_hashes(pages, ["page_id", "page_type", "title", "kind", "event_date", "format", "processing_status"])
    return hashlib.sha256(f"{told}|{sum_of_hashes(tags, ['page_id', 'normalized', 'label'])}".encode()).hexdigest()


def membership_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows to delete and to add, so that unchanged memberships are not written again."""
    return before.exceptAll(after).withColumn("change", F.lit("delete")).unionByName(after.exceptAll(before).withColumn("change", F.lit("add")))
