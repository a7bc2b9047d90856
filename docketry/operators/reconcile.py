"""Current knowledge from versions and supports: ordering, withdrawal, correction, identity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.operators.adjacency import BROADCAST_PAGES
from docketry.session import durable

ROLES = ("complete_replacement", "supplement", "targeted_correction", "conditional", "unknown")


def current_versions(versions: DataFrame) -> DataFrame:
    """Each source's current version, of (source_id, version_id, revision, date, arrival).

    Revision decides, then date, then arrival; a choice by arrival alone is marked as uncertain.
    """
    # Two aggregations with map-side parts, so that a source's many versions never meet in one sort.
    told = F.coalesce(F.col("revision").cast("string"), F.col("date"))
    equal = versions.groupBy("source_id", "revision", "date", "arrival").agg(F.min("version_id").alias("version_id"), F.count("*").alias("n"), F.bool_or(told.isNull()).alias("untold"))
    last = F.max_by(F.struct("version_id", "revision"), F.struct("revision", "date", "arrival"))
    out = equal.groupBy("source_id").agg(last.alias("last"), (F.bool_or("untold") & (F.sum("n") > 1)).alias("ordering_uncertain"))
    basis = F.when(F.col("ordering_uncertain"), "arrival_fallback").when(F.col("last.revision").isNotNull(), "revision").otherwise("date")
    return out.select("source_id", "last.version_id", "ordering_uncertain", basis.alias("order_basis"))


def latest_if_certain(candidates: DataFrame, precedes: DataFrame) -> DataFrame:
    """(source_id, version_id): the one candidate that every other strictly precedes; sources without such a one give none.

    candidates: source_id, version_id. precedes: earlier, later, a strict partial order.
    """
    others = candidates.groupBy("source_id").agg(F.count("*").alias("n"))
    beaten = candidates.select("source_id", F.col("version_id").alias("earlier")).join(precedes.distinct(), "earlier")
    wins = beaten.join(candidates.select("source_id", F.col("version_id").alias("later")), ["source_id", "later"]).groupBy("source_id", F.col("later").alias("version_id")).agg(F.countDistinct("earlier").alias("wins"))
    return candidates.join(wins, ["source_id", "version_id"], "left").join(others, "source_id").where(F.coalesce("wins", F.lit(0)) == F.col("n") - 1).select("source_id", "version_id")


def surviving_supports(supports: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """Supports (item_id, source_id, version_id, ...) without those of withdrawn versions (source_id, version_id)."""
    return supports.join(withdrawn, ["source_id", "version_id"], "left_anti")


def apply_updates(supports: DataFrame, updates: DataFrame) -> DataFrame:
    """Supports with `valid`: what each source's updates (source_id, version_id, ordinal, role, property) leave of them.

    A complete replacement withdraws the source's earlier supports; a targeted correction withdraws
    them for its property alone; a supplement, and conditional and unknown updates, withdraw nothing.
    supports: item_id, source_id, ordinal, property, value, ...
    """
    breaking = updates.where(F.col("role").isin("complete_replacement", "targeted_correction"))
    whole = breaking.where("role = 'complete_replacement'").groupBy("source_id").agg(F.max("ordinal").alias("replaced"))
    single = breaking.where("role = 'targeted_correction'").groupBy("source_id", "property").agg(F.max("ordinal").alias("corrected"))
    rows = supports.join(whole, "source_id", "left").join(single, ["source_id", "property"], "left")
    gone = (F.col("ordinal") < F.coalesce("replaced", F.lit(-1))) | (F.col("ordinal") < F.coalesce("corrected", F.lit(-1)))
    return rows.withColumn("valid", ~gone).drop("replaced", "corrected")


def current_items(supports: DataFrame) -> DataFrame:
    """Items that at least one valid support, from whatever source, still holds up."""
    return supports.where("valid").groupBy("item_id").agg(F.count("*").alias("supports"))


def accepted_corrections(corrections: DataFrame, facts: DataFrame) -> DataFrame:
    """Corrections (event_id, property, previous, value, aligned) whose stated previous value is current and that are aligned independently."""
    now = facts.where("current").select("event_id", "property", F.col("value").alias("previous")).distinct()
    return corrections.where("aligned").join(now, ["event_id", "property", "previous"], "left_semi")


def owned_versions(acquisitions: DataFrame) -> DataFrame:
    """(version_id, owners, state): an origin owns the version that it supplied last; versions without owners are withdrawn.

    acquisitions: origin, version_id, arrival.
    """
    last = acquisitions.groupBy("origin").agg(F.max_by("version_id", F.struct("arrival", "version_id")).alias("version_id"))
    owners = last.groupBy("version_id").agg(F.count("*").alias("owners"))
    known = acquisitions.select("version_id").distinct().join(owners, "version_id", "left").select("version_id", F.coalesce("owners", F.lit(0)).alias("owners"))
    return known.withColumn("state", F.when(F.col("owners") > 0, "owned").otherwise("withdrawn"))


def removable_pages(pages: DataFrame, content: DataFrame, relationships: DataFrame) -> DataFrame:
    """Pages without facts, relationships, tags or owner content (content: page_id) that no surviving relationship (from_page_id, to_page_id) names."""
    named = relationships.select(F.col("from_page_id").alias("page_id")).unionByName(relationships.select(F.col("to_page_id").alias("page_id")))
    return pages.join(content.select("page_id").distinct(), "page_id", "left_anti").join(named.distinct(), "page_id", "left_anti")


def new_owners(pages: DataFrame, supports: DataFrame) -> DataFrame:
    """(page_id, source_id): the first remaining support of each page, facts before relationships, tags and references, then by position."""
    rank = F.array_position(F.array(*(F.lit(k) for k in ("fact", "relationship", "tag", "reference"))), F.col("kind"))
    first = supports.groupBy("page_id").agg(F.min_by("source_id", F.struct(rank, "position", "source_id")).alias("source_id"))
    return pages.select("page_id").join(first, "page_id")


def identities(found: DataFrame, ledger: DataFrame) -> DataFrame:
    """(page_id, path, state) of page files (page_id, path) against the last unambiguous places (page_id, path).

    One place is resolved, several are a duplicate identity and none is chosen; a page at a place
    that another page had is ambiguous.
    """
    places = found.groupBy("page_id").agg(F.countDistinct("path").alias("n"), F.min("path").alias("path"))
    before = ledger.select(F.col("page_id").alias("owner"), "path").groupBy("path").agg(F.min("owner").alias("owner"))
    rows = places.join(before, "path", "left")
    state = F.when(F.col("n") > 1, "duplicate_identity").when(F.col("owner").isNotNull() & (F.col("owner") != F.col("page_id")), "identity_ambiguous").otherwise("resolved")
    return rows.select("page_id", F.when(F.col("n") == 1, F.col("path")).alias("path"), state.alias("state"))


def unchanged(before: DataFrame, now: DataFrame) -> bool:
    """Whether every input fingerprint (path, fingerprint) that a build read is still the same."""
    key = ["path", "fingerprint"]
    left = before.select(*key).exceptAll(now.select(*key)).limit(1).unionAll(now.select(*key).exceptAll(before.select(*key)).limit(1))
    return left.isEmpty()


def resolve_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, link, page_id): links (page, link, path) by the pages' places (path, page_id); two pages at a place resolve to none."""
    one = pages.groupBy("path").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n")).where("n = 1").select("path", "page_id")
    return links.join(one, "path", "left").select("page", "link", "page_id")


def withdraw(sources: DataFrame, acquisitions: DataFrame, removed: DataFrame, precedes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, versions) after removed origins' acquisitions are gone.

    sources: source_id, current, pending (version ids or null). acquisitions: source_id, version_id, origin, method,
    registration. removed: origin, method, registration, a null method or registration standing for any.
    precedes: earlier, later, a strict partial order of versions.

    A version without owners is withdrawn. A source whose current version (or pending one, if it has
    no current) still has an owner keeps its knowledge and drops a pending version without owner
    (`keep`). Otherwise the one version that all other owned ones precede becomes pending
    (`fallback`); without such a one nothing is guessed (`uncertain`); without owners nothing is
    left (`removed`).
    """
    any_of = lambda c: F.col(f"r.{c}").isNull() | F.col(f"a.{c}").eqNullSafe(F.col(f"r.{c}"))
    a, r = acquisitions.alias("a"), removed.alias("r")
    left = a.join(r, (F.col("a.origin") == F.col("r.origin")) & any_of("method") & any_of("registration"), "left_anti")
    owners = left.groupBy("source_id", "version_id").agg(F.count("*").alias("owners"))
    versions = acquisitions.select("source_id", "version_id").distinct().join(owners, ["source_id", "version_id"], "left")
    versions = versions.select("source_id", "version_id", F.coalesce("owners", F.lit(0)).alias("owners"), F.when(F.col("owners") > 0, "owned").otherwise("withdrawn").alias("state"))
    owned = versions.where("state = 'owned'").select("source_id", "version_id")
    last = latest_if_certain(owned, precedes).withColumnRenamed("version_id", "fallback")
    has = lambda c: owned.select("source_id", F.col("version_id").alias(c), F.lit(True).alias(f"{c}_owned"))
    rows = sources.join(has("current"), ["source_id", "current"], "left").join(has("pending"), ["source_id", "pending"], "left")
    rows = rows.join(last, "source_id", "left").join(owned.select("source_id", F.lit(True).alias("any_owned")).distinct(), "source_id", "left")
    keep = F.coalesce(F.when(F.col("current").isNotNull(), F.col("current_owned")).otherwise(F.col("pending_owned")), F.lit(False))
    action = F.when(keep, "keep").when(F.col("any_owned").isNull(), "removed").when(F.col("fallback").isNotNull(), "fallback").otherwise("uncertain")
    pending = F.when(action == "keep", F.when(F.col("pending_owned"), F.col("pending"))).when(action == "fallback", F.col("fallback"))
    return rows.select("source_id", F.when(action == "keep", F.col("current")).alias("current"), pending.alias("pending"), action.alias("action")), versions


def restore(acquisitions: DataFrame, supplied: DataFrame) -> DataFrame:
    """Acquisitions with those that are supplied again; what is there already is not doubled."""
    return acquisitions.unionByName(supplied).distinct()


def withdrawn_supports(supports: DataFrame, sources: DataFrame) -> DataFrame:
    """Supports (item_id, source_id, ...) without those of sources that withdraw() did not keep."""
    return supports.join(sources.where("action <> 'keep'").select("source_id"), "source_id", "left_anti").select(*supports.columns)


def supported_edges(edges: DataFrame, supports: DataFrame) -> DataFrame:
    """Edges with `supported` as the supports (item_id, ...) that are left say."""
    left = supports.select(F.col("item_id").alias("relationship_id"), F.lit(True).alias("held")).distinct()
    return edges.join(left, "relationship_id", "left").withColumn("supported", F.coalesce("held", F.lit(False))).drop("held")


def settled(supports: DataFrame | Column, sources: DataFrame) -> Callable[[DataFrame, bool], DataFrame]:
    """What tells `supported` of any edges, as supported_edges() with withdrawn_supports() does of all.

    A table of supports (item_id, source_id) is read for the edges given, which are written once.
    Only their supports, and only these supports' sources, are looked at: those of at most
    BROADCAST_PAGES edges without moving the others; for more, all supports are moved by item_id.
    Where each edge has one support and its own row tells the source, `supports` is that column.
    Then no support is looked for, and edges that are not few are neither written nor need identities.
    """
    if isinstance(supports, Column):
        return _settled_by(supports, sources)

    def narrowed(rows: DataFrame, name: str, by: DataFrame, size: int) -> DataFrame:
        return rows.join(F.broadcast(by) if size <= BROADCAST_PAGES else by, name, "left_semi")

    def settle(edges: DataFrame, few: bool = False) -> DataFrame:
        edges = durable(edges)
        near = durable(narrowed(supports, "item_id", edges.select(F.col("relationship_id").alias("item_id")), edges.count()))
        around = narrowed(sources, "source_id", near.select("source_id"), near.count())
        return supported_edges(edges.drop("supported"), withdrawn_supports(near, around))

    return settle


def _settled_by(source: Column, sources: DataFrame) -> Callable[[DataFrame, bool], DataFrame]:
    def settle(edges: DataFrame, few: bool = False) -> DataFrame:
        rows = edges.withColumn("source_", source)
        around = sources
        if few:
            rows = durable(rows)
            around = sources.join(F.broadcast(rows.select(F.col("source_").alias("source_id"))), "source_id", "left_semi")
        gone = around.where("action <> 'keep'").select(F.col("source_id").alias("source_"), F.lit(True).alias("gone_")).distinct()
        told = rows.join(F.broadcast(gone) if few else gone, "source_", "left")
        return told.withColumn("supported", F.col("gone_").isNull()).select(*edges.columns)

    return settle
