"""Exploring the relationship graph breadth-first from a page, against or with the arrows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import sum_of_hashes
from docketry.operators.adjacency import FEW_PAGES, Adjacency
from docketry.operators.continuation import MAX_PAGE, MAX_WORK, Ahead, Answer, QueryError, Store, check_limits
from docketry.session import durable


STEPS = "array<struct<relationship_id:string,kind:string,with_arrow:boolean,page_id:string>>"


def _links(rows: DataFrame) -> DataFrame:
    """Supported edges other than self-links, with with_arrow."""
    return rows.where("supported AND at <> next").withColumn("with_arrow", F.col("way") == 1)


def explore(pages: DataFrame, edges: DataFrame | Adjacency, start: str, max_hops: int) -> DataFrame:
    """(page_id, depth, steps): each page within reach once, at its least depth, with its first route.

    Routes are ordered by their relationship ids. The start is not reached. A level is one join and
    one aggregation, written before the next begins; levels already reached are taken out by an
    anti-join. The last level is not written: it is made as the result is read, and its routes only if they are. A frontier of few pages is put to the edges as a filter, which stored edges answer
    from those pages' buckets; a larger one is joined, see Adjacency.met().
    """
    if not 1 <= max_hops <= 256:
        raise ValueError("1 to 256 hops")
    spark, near = pages.sparkSession, Adjacency.of(pages, edges)
    frontier = spark.createDataFrame([(start, 0, [])], f"page_id string, depth int, steps {STEPS}")
    reached, here, size, total = frontier, [start], 1, 1
    for depth in range(1, max_hops + 1):
        step = F.struct("relationship_id", "kind", "with_arrow", F.col("next").alias("page_id"))
        met = near.met(frontier.select(F.col("page_id").alias("at"), "steps"), size, here, once=False)
        found = _links(met).where("there").select("next", F.concat("steps", F.array(step)).alias("steps"))
        found = found.join(reached.select(F.col("page_id").alias("next")), "next", "left_anti").groupBy("next").agg(F.min("steps").alias("steps"))
        frontier = found.select(F.col("next").alias("page_id"), F.lit(depth).alias("depth"), "steps")
        if depth == max_hops:
            reached = reached.unionByName(frontier)
            break
        # Every other level is read twice, by the next join and by the anti-joins after it: it is written once.
        frontier = durable(frontier)
        size = frontier.count()
        if not size:
            break
        total += size
        here = [r["page_id"] for r in frontier.select("page_id").collect()] if size <= FEW_PAGES else None
        reached = reached.unionByName(frontier)
        if depth % 16 == 0:
            reached = durable(reached, total)
    return reached.where("depth > 0")


def examined(near: Adjacency, explored: DataFrame, start: str, max_hops: int) -> DataFrame:
    """(depth, at, relationship_id, page_id): the edges that exploring examines, and the page that each discovers, if any."""
    inner = explored.where(F.col("depth") < max_hops).select(F.col("page_id").alias("at"), F.col("depth").alias("from_depth"))
    inner = inner.unionByName(explored.sparkSession.createDataFrame([(start, 0)], "at string, from_depth int"))
    last, before = F.get("steps", F.size("steps") - 1), F.coalesce(F.get("steps", F.size("steps") - 2)["page_id"], F.lit(start))
    found = explored.select("page_id", F.col("depth").alias("d"), last["relationship_id"].alias("r"), before.alias("b"))
    rows = _links(near.met(inner, inner.count(), None))
    hit = (F.col("next") == F.col("page_id")) & (F.col("d") == F.col("from_depth") + 1) & (F.col("r") == F.col("relationship_id")) & (F.col("b") == F.col("at"))
    return rows.join(found, hit, "left").select((F.col("from_depth") + 1).alias("depth"), "at", "relationship_id", "page_id")


class Explorations:
    """Explorations in calls of bounded work: each examines at most so many edges, and gives the pages that these discover."""

    def __init__(self, store: Store, pages: DataFrame, edges: DataFrame | Adjacency) -> None:
        self.store, self.pages, self.near, self.ahead = store, pages, Adjacency.of(pages, edges), Ahead()

    def explore(self, start: str, max_hops: int, revision: str, continuation: str | None = None, work_budget: int = MAX_WORK, page_size: int = MAX_PAGE) -> Answer:
        check_limits(work_budget, page_size)
        asked = f"{max_hops} {start}"
        spark = self.pages.sparkSession
        if continuation is None:
            if self.pages.where(F.col("page_id") == start).isEmpty():
                raise QueryError("invalid: the start page does not exist")
            name, state = self.store.begin({"signature": asked, "revision": revision}), {"edge": None, "waiting": []}
            found = explore(self.pages, self.near, start, max_hops)
            found.write.parquet(f"{self.store.tables(name)}/found")
            found = spark.read.parquet(f"{self.store.tables(name)}/found")
            examined(self.near, found, start, max_hops).repartitionByRange("depth", "at", "relationship_id").sortWithinPartitions("depth", "at", "relationship_id").write.parquet(f"{self.store.tables(name)}/examined")
        else:
            name, state = self.store.resume(continuation, revision, asked)
        self.store.retire()
        key = ["depth", "at", "relationship_id"]
        waiting, edge = state["waiting"], state["edge"]

        def behind(count: int) -> list:
            rows = spark.read.parquet(f"{self.store.tables(name)}/examined")
            if edge is not None:
                rows = rows.where(F.struct(*key) > F.struct(*(F.lit(v).cast(rows.schema[k].dataType) for k, v in zip(key, edge, strict=True))))
            return rows.orderBy(*key).limit(count).collect()

        batch = self.ahead.after(name, edge and tuple(edge), work_budget + 1, lambda r: tuple(r[k] for k in key), behind) if len(waiting) < page_size else []
        more = len(batch) > work_budget or len(waiting) >= page_size
        batch = batch[:work_budget]
        waiting = waiting + [r["page_id"] for r in batch if r["page_id"] is not None]
        edge = [batch[-1][k] for k in key] if batch else edge
        results, waiting = waiting[:page_size], waiting[page_size:]
        complete = not more and not waiting
        self.store.save(name, {"signature": asked, "revision": revision, "canceled": False, "edge": edge, "waiting": waiting})
        return Answer(results, revision, None if complete else self.store.token(name), complete, len(batch))

    def details(self, continuation: str, revision: str, target: str, offset: int = 0, size: int = MAX_PAGE) -> list:
        """Steps of a discovered page's route from the page back to the start, a page of them at a time."""
        name, _ = self.store.resume(continuation, revision)
        return details(self.pages.sparkSession.read.parquet(f"{self.store.tables(name)}/found"), target, offset, size)


def details(explored: DataFrame, target: str, offset: int = 0, size: int = 50) -> list:
    """The steps of a target's route from the target back to the start, a page at a time."""
    row = explored.where(F.col("page_id") == target).select(F.slice(F.reverse("steps"), offset + 1, size).alias("steps")).first()
    if row is None:
        raise ValueError("the page is not reached")
    return row["steps"]


def graph_revision(edges: DataFrame) -> str:
    """A digest of the supported edges, whatever their order; see functions.text.sum_of_hashes."""
    return sum_of_hashes(edges.where("supported"), ["relationship_id", "from_page_id", "to_page_id", "kind"])
