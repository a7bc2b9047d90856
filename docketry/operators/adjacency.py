"""Edges as seen from either end, with what constraints ask of the page that they lead to.

Stored by kind, direction and a bucket of the page at hand, a hop is one join of the pages reached so
far with this table, and a hop from few pages reads only these pages' buckets. Derived, nothing is
stored: edges are narrowed to those that a hop meets, and only these get their identities and look up
the page that they lead to. Where they are few, so are the pages: then no other page is moved.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.session import durable

#: A frontier of at most so many pages is a filter on the edges; of one of at most so many, the page ids are broadcast to them.
#: As many edges at most have the ids of the pages that they lead to broadcast, and these pages' asked columns.
FEW_PAGES, BROADCAST_PAGES = 500, 1 << 18
#: The columns of a page that constraints ask for.
ASKED = ("event_date", "format", "processing_status")


def both_ways(edges: DataFrame) -> DataFrame:
    """(at, next, relationship_id, kind, way, supported): every edge once with its arrow (way 1) and once against it (way 0)."""

    def seen(here: str, there: str, way: int) -> DataFrame:
        return edges.select(F.col(here).alias("at"), F.col(there).alias("next"), "relationship_id", "kind", F.lit(way).alias("way"), "supported")

    return seen("from_page_id", "to_page_id", 1).unionByName(seen("to_page_id", "from_page_id", 0))


def with_pages(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """both_ways() with `there`, whether the next page exists, and that page's asked columns as n_*."""
    return look_up(both_ways(edges), pages)


def look_up(rows: DataFrame, pages: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Rows (next, ...) with `there` and n_*. `ends` (next, ...), if given, has all next pages and is small enough to be broadcast."""
    if ends is not None:
        pages = pages.join(F.broadcast(ends.select(F.col("next").alias("page_id"))), "page_id", "left_semi")
    around = pages.select(F.col("page_id").alias("next"), F.lit(True).alias("there_"), *(F.col(name).alias(f"n_{name}") for name in ASKED))
    return rows.join(around if ends is None else F.broadcast(around), "next", "left").withColumn("there", F.coalesce("there_", F.lit(False))).drop("there_")


def identity(kind: Column, start: Column, end: Column) -> Column:
    """The relationship_id of an edge that has none of its own."""
    return F.sha2(F.concat_ws("|", kind, start, end).cast("binary"), 256)


def from_page() -> Column:
    """The page that the arrow of a row of both_ways() comes from."""
    return F.when(F.col("way") == 1, F.col("at")).otherwise(F.col("next"))


def bucket(page: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(page.cast("binary")), F.lit(buckets)).cast("int")


def sized(frontier: DataFrame) -> tuple[DataFrame, int, list[str] | None]:
    """A frontier (at, ...) of distinct pages, written once; how many they are, and which if they are few."""
    frontier = durable(frontier)
    size = frontier.count()
    return frontier, size, [r["at"] for r in frontier.select("at").collect()] if size <= FEW_PAGES else None


@dataclass(frozen=True)
class Adjacency:
    """Rows of with_pages(); stored ones have a column `bucket`, of which there are `buckets`."""

    rows: DataFrame
    buckets: int = 0

    @classmethod
    def of(cls, pages: DataFrame, edges: DataFrame | Adjacency) -> Adjacency:
        """What is an adjacency already, or else one that derives its rows from the edges."""
        return edges if isinstance(edges, Adjacency) else Derived(both_ways(edges), pages=pages)

    def around(self, here: list[str] | None = None) -> DataFrame:
        """The rows at the pages `here`, from their buckets alone; all rows if none are given."""
        if here is None:
            return self.rows
        found = self.rows.where(F.col("at").isin(here))
        return found.where(F.col("bucket").isin(sorted({zlib.crc32(page.encode()) % self.buckets for page in here}))) if self.buckets else found

    def meets(self, frontier: DataFrame, size: int, here: list[str] | None, hop: tuple[str, int] | None = None) -> int | None:
        """How many rows met() gives at most, where that is counted."""
        return None

    def met(self, frontier: DataFrame, size: int, here: list[str] | None, hop: tuple[str, int] | None = None, once: bool = True, meets: int | None = None) -> DataFrame:
        """The frontier (at, ...), of `size` distinct pages, `here` if given, with the rows at them: all, or those of a hop's kind and way.

        Unless `once`, a row may come several times. `meets` is what meets() gave of the same, if it was asked.
        """
        return frontier.join(_of(self.around(here), hop), "at")


def _of(rows: DataFrame, hop: tuple[str, int] | None) -> DataFrame:
    return rows if hop is None else rows.where((F.col("kind") == hop[0]) & (F.col("way") == hop[1]))


@dataclass(frozen=True)
class Derived(Adjacency):
    """An adjacency whose rows are those of both_ways(), without relationship_id where identity() gives it; `repeated` if an edge may come several times.

    `leads_to` has the kinds of the pages that lie a kind's edges' way, for every (kind, way): only
    pages of these kinds are looked up. `settle` gives rows that a hop meets the right `supported`;
    it is told whether they are known to be at most BROADCAST_PAGES.
    """

    pages: DataFrame | None = None
    repeated: bool = False
    leads_to: dict[tuple[str, int], set[str]] | None = None
    settle: Callable[[DataFrame, bool], DataFrame] | None = None

    def around(self, here: list[str] | None = None) -> DataFrame:
        rows = self.rows if here is None else self.rows.where(F.col("at").isin(here))
        return self._told(rows.distinct() if self.repeated else rows)

    def meets(self, frontier: DataFrame, size: int, here: list[str] | None, hop: tuple[str, int] | None = None) -> int | None:
        return self._at(frontier, size, here, hop).count() if here is not None or size <= BROADCAST_PAGES else None

    def met(self, frontier: DataFrame, size: int, here: list[str] | None, hop: tuple[str, int] | None = None, once: bool = True, meets: int | None = None) -> DataFrame:
        rows = self._at(frontier, size, here, hop)
        meets = self.meets(frontier, size, here, hop) if meets is None else meets
        met = (frontier if here is None else F.broadcast(frontier)).join(rows.distinct() if once and self.repeated else rows, "at")
        return self._told(met, hop, rows if meets is not None and meets <= BROADCAST_PAGES else None)

    def _at(self, frontier: DataFrame, size: int, here: list[str] | None, hop: tuple[str, int] | None) -> DataFrame:
        """The rows at a frontier's pages, or all of a hop's if it is too large to tell them without moving them."""
        rows = _of(self.rows, hop)
        if here is not None:
            return rows.where(F.col("at").isin(here))
        return rows.join(F.broadcast(frontier.select("at")), "at", "left_semi") if size <= BROADCAST_PAGES else rows

    def _told(self, rows: DataFrame, hop: tuple[str, int] | None = None, ends: DataFrame | None = None) -> DataFrame:
        if "relationship_id" not in rows.columns:
            along, at, after = F.col("way") == 1, F.col("at"), F.col("next")
            rows = rows.withColumn("relationship_id", identity(F.col("kind"), F.when(along, at).otherwise(after), F.when(along, after).otherwise(at)))
        if self.settle:
            rows = self.settle(rows, ends is not None)
            ends = None if ends is None else rows
        return look_up(rows, self._asked(hop), ends)

    def _asked(self, hop: tuple[str, int] | None) -> DataFrame:
        """The pages that may lie behind a hop."""
        if self.leads_to is None:
            return self.pages
        kinds = set().union(*self.leads_to.values()) if hop is None else self.leads_to.get(hop, set())
        return self.pages.where(F.col("kind").isin(sorted(kinds)))
