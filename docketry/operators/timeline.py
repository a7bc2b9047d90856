"""Timelines: dated entries that keep their precision, undated ones last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.dates import qualify
from docketry.functions.text import contains_literal, normalized_tag


def source_events(events: DataFrame, facts: DataFrame) -> DataFrame:
    """(entry_id, title, label, start, end, precision, status): one entry per event page, its date facts qualified together.

    events: page_id, title. facts: page_id, value.
    """
    dates = facts.where("value IS NOT NULL").groupBy("page_id").agg(F.collect_set("value").alias("dates"))
    rows = events.join(dates, "page_id", "left").select(F.col("page_id").alias("entry_id"), "title", qualify(F.col("dates")).alias("q"))
    return rows.select("entry_id", "title", "q.*")


def reasoning_events(messages: DataFrame) -> DataFrame:
    """Reasoning messages and recorded decisions by their own dates; messages without one stay undated.

    messages: entry_id, title, intent, date ('unknown' or null without one).
    """
    kept = messages.where(F.col("intent").isin("reasoning", "decision"))
    dates = F.when(F.col("date").isNotNull() & (F.col("date") != "unknown"), F.array("date"))
    return kept.select("entry_id", "title", qualify(dates).alias("q")).select("entry_id", "title", "q.*")


def collection_activity(acquisitions: DataFrame) -> DataFrame:
    """One entry per acquisition (acquisition_id, method, at), however many share a source."""
    rows = acquisitions.select(F.col("acquisition_id").alias("entry_id"), F.col("method").alias("title"), qualify(F.array("at")).alias("q"))
    return rows.select("entry_id", "title", "q.*")


def search(entries: DataFrame, words: str = "", tags: list[str] | None = None, page_tags: DataFrame | None = None) -> DataFrame:
    """Entries whose title holds every word and that have one of the tags."""
    for word in words.split():
        entries = entries.where(contains_literal("title", word))
    if tags and page_tags is not None:
        wanted = [t.strip().lstrip("#").lower() for t in tags]
        having = page_tags.where(normalized_tag("normalized").isin(wanted)).select(F.col("page_id").alias("entry_id"))
        entries = entries.join(having, "entry_id", "left_semi")
    return entries


def order(descending: bool = False) -> list[Column]:
    """By start, then end, unknown and conflicting entries last either way; ties by identity."""
    by = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last() for c in ("start", "end")]
    return [*by, F.col("entry_id")]


def page(entries: DataFrame, descending: bool = False, offset: int = 0, size: int = 50) -> tuple[list, int | None]:
    rows = entries.orderBy(*order(descending)).offset(offset).limit(size + 1).collect()
    return rows[:size], offset + size if len(rows) > size else None


def current_support(supports: DataFrame) -> DataFrame:
    """One support per entry that still resolves, the earliest in its list (entry_id, position, resolves, ...)."""
    return supports.where("resolves").groupBy("entry_id").agg(F.min_by(F.struct(*supports.columns), "position").alias("s")).select("s.*")


def described(entries: DataFrame, pages: DataFrame, supports: DataFrame) -> DataFrame:
    """Entries with their pages' kind (an entry is named by its page) and the source, qualifier and position of the support that holds them up, if any does."""
    held = current_support(supports).select("entry_id", "source_id", "qualifier", "position")
    rows = entries.withColumn("page_id", F.col("entry_id")).join(pages.select("page_id", "kind"), "page_id", "left")
    return rows.join(held, "entry_id", "left")
