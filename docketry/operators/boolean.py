"""Boolean queries over multi-hop relationship paths.

Each hop of a path leaf is one join with the edges at the pages reached so far, which are written and counted before the
next; each constraint is a column, and the tree a column expression over a flag per leaf. A page reached
several ways at one depth keeps the first route in breadth-first order, which is the order of the
routes' relationship ids, hop by hop; so the route itself, compared as an array, decides.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import is_true
from docketry.operators import adjacency
from docketry.operators.adjacency import Adjacency, sized
from docketry.operators.continuation import MAX_PAGE, MAX_WORK, Ahead, Answer, Store, check_limits

STATUSES = ("pending", "processing", "complete", "failed", "unavailable", "update_pending", "update_failed", "identity_ambiguous", "extraction_incomplete", "source_unavailable")
MAX_NODES, MAX_DEPTH, MAX_HOPS, MAX_KIND_BYTES = 64, 16, 32, 128
_DAY = re.compile(r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])")


@dataclass(frozen=True)
class Constraint:
    date_from: str | None = None
    date_to: str | None = None
    format: str | None = None
    processing_status: str | None = None

    def validate(self) -> None:
        for day in (self.date_from, self.date_to):
            if day is not None and not _DAY.fullmatch(day):
                raise ValueError(f"{day} is no ISO day")
        if self.date_from and self.date_to and self.date_from > self.date_to:
            raise ValueError("the first day is after the last")
        if self.processing_status is not None and self.processing_status not in STATUSES:
            raise ValueError(f"no status {self.processing_status}")

    def column(self, prefix: str = "") -> Column:
        tests = [
            (self.date_from, lambda v: F.col(f"{prefix}event_date") >= v), (self.date_to, lambda v: F.col(f"{prefix}event_date") <= v),
            (self.format, lambda v: F.col(f"{prefix}format") == v), (self.processing_status, lambda v: F.col(f"{prefix}processing_status") == v),
        ]
        out = F.lit(True)
        for value, test in tests:
            if value is not None:
                out = out & is_true(test(value))
        return out

    def __str__(self) -> str:
        return " ".join(f"{k}={v}" for k, v in asdict(self).items() if v is not None) or "any page"


@dataclass(frozen=True)
class Hop:
    kind: str
    with_arrow: bool = True


@dataclass(frozen=True)
class Path:
    start: str
    hops: tuple[Hop, ...]
    endpoint: Constraint = field(default_factory=Constraint)
    intermediate: Constraint = field(default_factory=Constraint)

    def __str__(self) -> str:
        return self.start + "".join(f" -{h.kind}->" if h.with_arrow else f" <-{h.kind}-" for h in self.hops) + f" [{self.endpoint}]"


@dataclass(frozen=True)
class And:
    of: tuple = ()

    def __str__(self) -> str:
        return "(" + " AND ".join(map(str, self.of)) + ")" if self.of else "every page"


@dataclass(frozen=True)
class Or:
    of: tuple = ()

    def __str__(self) -> str:
        return "(" + " OR ".join(map(str, self.of)) + ")" if self.of else "no page"


@dataclass(frozen=True)
class Not:
    of: object

    def __str__(self) -> str:
        return f"NOT {self.of}"


Expression = Path | Constraint | And | Or | Not


def leaves(expression: Expression) -> list[Path]:
    """Validate the tree; its paths in the order in which they are written."""
    found: list[Path] = []
    nodes = 0

    def walk(node: Expression, depth: int) -> None:
        nonlocal nodes
        nodes += 1
        if nodes > MAX_NODES or depth > MAX_DEPTH:
            raise ValueError("the expression is too large")
        if isinstance(node, Path):
            if not 1 <= len(node.hops) <= MAX_HOPS:
                raise ValueError("a path has 1 to 32 hops")
            for hop in node.hops:
                if not hop.kind.strip() or len(hop.kind.encode()) > MAX_KIND_BYTES:
                    raise ValueError("a hop needs a kind")
            node.endpoint.validate(), node.intermediate.validate()
            found.append(node)
        elif isinstance(node, Constraint):
            node.validate()
        elif isinstance(node, Not):
            walk(node.of, depth + 1)
        else:
            for child in node.of:
                walk(child, depth + 1)

    walk(expression, 1)
    return found


def signature(expression: Expression, returned: Constraint) -> str:
    def plain(x: object) -> object:
        if isinstance(x, (And, Or)):
            return {type(x).__name__: [plain(c) for c in x.of]}
        return {"Not": plain(x.of)} if isinstance(x, Not) else {type(x).__name__: asdict(x)}

    return json.dumps([plain(expression), asdict(returned)], sort_keys=True)


def _allowed(path: Path, depth: int) -> Column:
    return (path.endpoint if depth == len(path.hops) else path.intermediate).column("n_")


def reached(path: Path, near: Adjacency, routes: bool = True) -> DataFrame:
    """(page_id, route): the pages at a path's end, each with its first route, or an empty one unless `routes` are asked for.

    Few of them, the ids of their routes counted as pages, are marked to be broadcast.
    """
    frontier, size, here = near.rows.sparkSession.createDataFrame([(path.start, [])], "at string, route array<string>"), 1, [path.start]
    for depth, hop in enumerate(path.hops, 1):
        way = hop.kind, int(hop.with_arrow)
        meets = near.meets(frontier, size, here, way)
        step = near.met(frontier, size, here, way, once=False, meets=meets).where("supported AND there").where(_allowed(path, depth))
        if routes:
            step = step.select("next", F.concat("route", F.array("relationship_id")).alias("route"))
            # The least route is the first discovered: an aggregate with a map-side part, where a window would move every route.
            frontier = step.groupBy(F.col("next").alias("at")).agg(F.min("route").alias("route"))
        else:
            frontier = step.select(F.col("next").alias("at")).distinct().withColumn("route", F.array().cast("array<string>"))
        if depth < len(path.hops):
            frontier, size, here = sized(frontier)
    found = frontier.select(F.col("at").alias("page_id"), "route")
    return F.broadcast(found) if meets is not None and meets * (len(path.hops) if routes else 1) <= adjacency.BROADCAST_PAGES else found


def _spoken(node: Expression, negated: bool = False) -> set[Path]:
    """The paths whose routes can be evidence: those under an even number of negations."""
    if isinstance(node, Not):
        return _spoken(node.of, not negated)
    if isinstance(node, (And, Or)):
        return set().union(*(_spoken(child, negated) for child in node.of))
    return {node} if isinstance(node, Path) and not negated else set()


def _examined(path: Path, near: Adjacency) -> DataFrame:
    """(depth, at, relationship_id, issue): the edges of the path's kinds that it meets, and what is wrong with them."""
    spark = near.rows.sparkSession
    frontier, size, here = spark.createDataFrame([(path.start,)], "at string"), 1, [path.start]
    out = spark.createDataFrame([], "depth int, at string, relationship_id string, issue string")
    for depth, hop in enumerate(path.hops, 1):
        step = near.met(frontier, size, here, (hop.kind, int(hop.with_arrow)))
        issue = F.when(~F.col("there"), "missing_endpoint").when(~F.col("supported"), "missing_support")
        out = out.unionByName(step.select(F.lit(depth).alias("depth"), "at", "relationship_id", issue.alias("issue")))
        if depth < len(path.hops):
            frontier, size, here = sized(step.where("there AND supported").where(_allowed(path, depth)).select(F.col("next").alias("at")).distinct())
    return out


def diagnostics(path: Path, pages: DataFrame, edges: DataFrame | Adjacency) -> DataFrame:
    """(depth, relationship_id, issue): edges of the path's kinds that lead nowhere or have no support left."""
    return _examined(path, Adjacency.of(pages, edges)).where("issue IS NOT NULL").select("depth", "relationship_id", "issue").distinct()


def query_pages(pages: DataFrame, edges: DataFrame | Adjacency, expression: Expression, returned: Constraint | None = None) -> DataFrame:
    """All result pages with `evidence`, the routes of leaves that speak for them, as (leaf, route)."""
    paths, near = leaves(expression), Adjacency.of(pages, edges)
    starts = {p.start for p in paths}
    if starts and pages.where(F.col("page_id").isin(list(starts))).select("page_id").distinct().count() < len(starts):
        raise ValueError("a start page does not exist")
    # Leaves are numbered as they are written; equal ones share a join.
    found, distinct, spoken = pages, list(dict.fromkeys(paths)), _spoken(expression)
    for n, path in enumerate(distinct):
        found = found.join(reached(path, near, path in spoken).withColumnRenamed("route", f"path_{n}"), "page_id", "left")
    column = [F.col(f"path_{distinct.index(path)}") for path in paths]
    numbers = iter(range(len(paths)))

    def holds(node: Expression, negated: bool) -> tuple[Column, list[tuple[int, Column]]]:
        """Whether the node, or its negation, is true of a page, and which leaves speak for it when it is."""
        if isinstance(node, Not):
            return holds(node.of, not negated)
        if isinstance(node, Path):
            n = next(numbers)
            hit = column[n].isNotNull()
            return (~hit, []) if negated else (hit, [(n, hit)])
        if isinstance(node, Constraint):
            return (~node.column() if negated else node.column()), []
        every = isinstance(node, And) != negated
        total, evidence = F.lit(every), []
        below = [holds(child, negated) for child in node.of]
        for test, _ in below:
            total = total & test if every else total | test
        for test, own in below:
            evidence += [(n, total & test & hit) for n, hit in own]
        return total, evidence

    matches, evidence = holds(expression, False)
    told = F.array(*(F.when(hit, F.struct(F.lit(n).alias("leaf"), column[n].alias("route"))) for n, hit in evidence)) if evidence else F.array().cast("array<struct<leaf:int,route:array<string>>>")
    out = found.where(matches).where((returned or Constraint()).column())
    return out.select(*pages.columns, F.filter(told, lambda x: x.isNotNull()).alias("evidence"))


def relationship_text(kind: Column, source: Column, target: Column, qualifier: Column) -> Column:
    return F.concat_ws(" ", source, kind, target, F.when(F.length(F.trim(qualifier)) > 0, F.concat(F.lit("("), qualifier, F.lit(")"))))


def targets(expression: Expression, returned: Constraint | None = None) -> list[str]:
    """The start pages that a saved query names, once each and in order, after validation."""
    (returned or Constraint()).validate()
    return list(dict.fromkeys(path.start for path in leaves(expression)))


class Queries:
    """query_pages in calls of bounded work, over stored tables.

    The first call finds the result and stores it with the examined edges. Each call then goes on
    through the edges (a unit of work each, with what is wrong with them) and, when none is left,
    through the pages in order of page_id (a unit each). So budgets change how many calls a result
    takes, never the result, and NOT never speaks before all paths are known.
    """

    def __init__(self, store: Store, pages: DataFrame, edges: DataFrame | Adjacency) -> None:
        self.store, self.pages, self.near = store, pages, Adjacency.of(pages, edges)
        self.edges_ahead, self.pages_ahead = Ahead(), Ahead()

    def query(self, expression: Expression, revision: str, returned: Constraint | None = None, continuation: str | None = None, work_budget: int = MAX_WORK, page_size: int = MAX_PAGE) -> Answer:
        check_limits(work_budget, page_size)
        returned = returned or Constraint()
        returned.validate()
        paths, asked = leaves(expression), signature(expression, returned)
        if continuation is None:
            name, state = self._begin(expression, returned, paths, revision, asked), {"edge": None, "page": ""}
        else:
            name, state = self.store.resume(continuation, revision, asked)
        self.store.retire()
        spark, folder = self.pages.sparkSession, self.store.tables(name)
        work, diagnostics, results = 0, [], []
        edge, last = state["edge"], state["page"]
        if edge != "done":
            key = ["leaf", "depth", "at", "relationship_id"]

            def edges_behind(count: int) -> list:
                examined = spark.read.parquet(f"{folder}/examined")
                later = examined if edge is None else examined.where(F.struct(*key) > F.struct(*(F.lit(v).cast(examined.schema[k].dataType) for k, v in zip(key, edge, strict=True))))
                return later.orderBy(*key).limit(count).collect()

            rows = self.edges_ahead.after(name, edge and tuple(edge), work_budget, lambda r: tuple(r[k] for k in key), edges_behind)
            work = len(rows)
            diagnostics = [(r["leaf"], r["depth"], r["relationship_id"], r["issue"]) for r in rows if r["issue"]]
            edge = [rows[-1][k] for k in key] if work == work_budget else "done"
        complete = False
        if edge == "done" and work < work_budget:

            def pages_behind(count: int) -> list:
                found = spark.read.parquet(f"{folder}/found")
                around = self.pages.where(F.col("page_id") > last).select("page_id").orderBy("page_id").limit(count)
                return around.join(found.withColumn("hit", F.lit(True)), "page_id", "left").orderBy("page_id").collect()

            rows = self.pages_ahead.after(name, last, work_budget - work + 1, lambda r: r["page_id"], pages_behind)
            scanned = 0
            for row in rows[: work_budget - work]:
                if len(results) == page_size:
                    break
                last, scanned = row["page_id"], scanned + 1
                if row["hit"]:
                    results.append(row)
            work += scanned
            complete = scanned == len(rows)
        self.store.save(name, {"signature": asked, "revision": revision, "canceled": False, "edge": edge, "page": last})
        return Answer(results, revision, None if complete else self.store.token(name), complete, work, diagnostics)

    def _begin(self, expression: Expression, returned: Constraint, paths: list[Path], revision: str, asked: str) -> str:
        name = self.store.begin({"signature": asked, "revision": revision})
        folder = self.store.tables(name)
        query_pages(self.pages, self.near, expression, returned).write.parquet(f"{folder}/found")
        examined = self.pages.sparkSession.createDataFrame([], "leaf int, depth int, at string, relationship_id string, issue string")
        for n, path in enumerate(paths):
            examined = examined.unionByName(_examined(path, self.near).select(F.lit(n).alias("leaf"), "depth", "at", "relationship_id", "issue"))
        examined.write.parquet(f"{folder}/examined")
        return name

    def cancel(self, continuation: str) -> None:
        self.store.cancel(continuation)


def latest_support(supports: DataFrame) -> DataFrame:
    """The last resolvable support of each relationship (relationship_id, position, resolves, ...)."""
    last = Window.partitionBy("relationship_id").orderBy(F.desc("position"))
    return supports.where("resolves").withColumn("rank_", F.row_number().over(last)).where("rank_ = 1").drop("rank_")
