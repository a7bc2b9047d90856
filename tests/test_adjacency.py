from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docketry.operators import boolean as B
from docketry.operators import paths, reconcile
from docketry.operators import adjacency
from docketry.operators.adjacency import Adjacency, Derived, both_ways, bucket, with_pages
from docketry.plans import queries, queries_upkeep  # noqa: F401
from docketry.plans.model import Collection
from docketry.session import shared_dir

PAGES = "page_id string, title string, kind string, event_date string, format string, processing_status string"
EDGES = "relationship_id string, from_page_id string, to_page_id string, kind string, supported boolean"


def graph(spark):
    """A ring with chords; one edge leads nowhere, one is unsupported, one is a self-link, and one kind looks like a number."""
    pages = spark.createDataFrame([(f"pé{i}", f"{i}", "x", f"2024-01-{i + 1:02}", "txt", "complete") for i in range(20)], PAGES)
    edges = [(f"r{i:02}", f"pé{i}", f"pé{(i + 1) % 20}", "next", i != 9) for i in range(20)] + [(f"s{i:02}", f"pé{i}", f"pé{i * 7 % 20}", "7", True) for i in range(20)]
    return pages, spark.createDataFrame([*edges, ("t", "pé3", "gone", "next", True)], EDGES)


def test_stored_rows_answer_as_the_edges_do(spark, tmp_path):
    pages, edges = graph(spark)
    rows = with_pages(pages, edges).withColumn("bucket", bucket(F.col("at"), 5))
    rows.write.partitionBy("kind", "way", "bucket").parquet(str(tmp_path / "near"))
    near = Adjacency(spark.read.schema(rows.schema).parquet(str(tmp_path / "near")), 5)
    path = B.Path("pé2", (B.Hop("next"), B.Hop("7", False), B.Hop("next")), intermediate=B.Constraint(date_to="2024-01-15"))
    for ask in (
        lambda e: B.query_pages(pages, e, B.Or((path, B.Path("pé8", (B.Hop("7"),))))).select("page_id", F.col("evidence").cast("string")),
        lambda e: B.diagnostics(B.Path("pé3", (B.Hop("next"),)), pages, e),
        lambda e: paths.explore(pages, e, "pé0", 3).select("page_id", "depth", F.col("steps").cast("string")),
    ):
        want = sorted(map(tuple, ask(edges).collect()))
        assert want and sorted(map(tuple, ask(near).collect())) == want


def test_hops_read_their_buckets_and_push_constraints_down(spark, tmp_path):
    pages, edges = graph(spark)
    rows = with_pages(pages, edges).withColumn("bucket", bucket(F.col("at"), 5))
    rows.write.partitionBy("kind", "way", "bucket").parquet(str(tmp_path / "near"))
    near = Adjacency(spark.read.schema(rows.schema).parquet(str(tmp_path / "near")), 5)
    found = B.reached(B.Path("pé2", (B.Hop("next"),), endpoint=B.Constraint(date_from="2024-01-02")), near)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    filters, pushed = scan.split("PartitionFilters: ")[1].split("], PushedFilters: ")
    assert all(name in filters for name in ("kind#", "way#", "bucket#")) and "n_event_date" in pushed and "EqualTo(at,pé2)" in pushed
    assert plan.count("FileScan") == 1


def test_tables_that_change_are_derived_anew(spark, tmp_path):
    def write(count):
        pq.write_table(pa.table({"k": list(range(count))}), tmp_path / "things.parquet")

    def seen():
        c = Collection(spark, str(tmp_path))
        return c.stored("things", lambda: c.table("things"), ["k"]).count()

    write(3)
    assert seen() == 3 and seen() == 3
    write(50)
    spark.catalog.refreshByPath(str(tmp_path))
    assert seen() == 50


@pytest.mark.parametrize(("few", "broadcast"), [(500, 1 << 17), (0, 1 << 17), (0, 0)])
def test_derived_rows_answer_as_stored_ones_do(spark, monkeypatch, few, broadcast):
    """Whether a frontier is a filter, broadcast or joined, and though edges come twice."""
    pages, edges = graph(spark)
    stored, near = Adjacency(with_pages(pages, edges)), Derived(both_ways(edges.unionByName(edges)), pages=pages, repeated=True)
    for module in (adjacency, paths):
        monkeypatch.setattr(module, "FEW_PAGES", few)
    monkeypatch.setattr(adjacency, "BROADCAST_PAGES", broadcast)
    path = B.Path("pé0", (B.Hop("next"), B.Hop("7", False), B.Hop("next")), intermediate=B.Constraint(date_to="2024-01-15"))
    for ask in (
        lambda e: B.reached(path, e).select("page_id", F.col("route").cast("string")),
        lambda e: B._examined(B.Path("pé3", (B.Hop("next"), B.Hop("7"))), e),
        lambda e: paths.explore(pages, e, "pé0", 3).select("page_id", "depth", F.col("steps").cast("string")),
        lambda e: paths.examined(e, paths.explore(pages, e, "pé0", 2), "pé0", 2),
    ):
        want = sorted(map(repr, ask(stored).collect()))
        assert want and sorted(map(repr, ask(near).collect())) == want


def test_following_edges_stores_none(spark):
    c = Collection(spark, "/root/testdata/sf0.001")
    assert paths.explore(c.pages, c.adjacency, "page-customer-1", 2).count()
    near = c.adjacency.around(["page-nation-3"]).where("kind = 'located_in'")
    assert {r["relationship_id"] for r in near.collect()} == {r["relationship_id"] for r in c.edges.where("kind = 'located_in' AND to_page_id = 'page-nation-3'").collect()}
    assert not {name for folder, name in spark.sparkContext._docketry_stored if folder == c.folder} & {"edges", "adjacency"}


def test_following_edges_stores_no_pages(spark, tmp_path):
    """Nor are tables read that a hop, or a graph of some kinds of pages, does not ask for."""
    for file in Path("/root/testdata/sf0.001").iterdir():
        (tmp_path / file.name).symlink_to(file)
    for name in ("boolean_two_hops", "boolean_missing_support", "explore_against_arrows", "path_details", "paths_after_withdrawal"):
        assert queries.QUERIES[name](spark, str(tmp_path)).columns
    assert not [name for folder, name in spark.sparkContext.__dict__.get("_docketry_stored", {}) if folder == str(tmp_path)]
    c = Collection(spark, str(tmp_path))
    hop = c.adjacency.met(spark.createDataFrame([("page-nation-3",)], "at string"), 1, ["page-nation-3"], ("located_in", 0))
    for frame, keys in ((hop, ("c_custkey", "s_suppkey")), (c.edges_among(["place", "organization"]), ("s_suppkey", "n_nationkey"))):
        files = frame._jdf.queryExecution().optimizedPlan().toString()
        assert all(key in files for key in keys)
        assert not [key for key in ("l_orderkey", "o_orderkey", "p_partkey", "doc_id") if key in files]


def test_read_pages_are_the_stored_ones(spark):
    c = Collection(spark, "/root/testdata/sf0.001")
    assert sorted(map(repr, c.read_pages.collect())) == sorted(map(repr, c.pages.collect()))
    found = c.adjacency.around().select("next", "there", *(f"n_{name}" for name in adjacency.ASKED))
    around = both_ways(c.edges).join(c.pages.withColumnRenamed("page_id", "next"), "next", "left")
    assert sorted(map(repr, found.collect())) == sorted(repr(r) for r in around.select("next", F.col("title").isNotNull().alias("there"), *(F.col(name).alias(f"n_{name}") for name in adjacency.ASKED)).collect())


def test_settled_supports_are_those_of_all(spark, monkeypatch):
    """Edges that several supports hold, that none holds, and whose sources are not told of."""
    pages, edges = graph(spark)
    supports = spark.createDataFrame([(f"r{i:02}", f"s{i % 5}") for i in range(15)] + [(f"r{i:02}", "s9") for i in range(0, 20, 4)] + [(f"s{i:02}", f"s{i % 5}") for i in range(20)] + [("s03", "s1"), ("none", "s2")], "item_id string, source_id string")
    sources = spark.createDataFrame([("s0", "keep"), ("s1", "removed"), ("s2", "uncertain"), ("s9", "keep")], "source_id string, action string")
    whole = reconcile.supported_edges(edges, reconcile.withdrawn_supports(supports, sources))
    want = sorted(map(repr, paths.explore(pages, whole, "pé0", 4).collect()))
    assert len(want) > 2
    for broadcast in (reconcile.BROADCAST_PAGES, 0):
        monkeypatch.setattr(reconcile, "BROADCAST_PAGES", broadcast)
        near = Derived(both_ways(edges), pages=pages, settle=reconcile.settled(supports, sources))
        assert sorted(map(repr, paths.explore(pages, near, "pé0", 4).collect())) == want


@pytest.fixture
def unbroadcast(spark):
    """Without a size under which Spark broadcasts a table unasked."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_few_edges_move_no_pages(unbroadcast, spark):
    """Neither the pages that a hop looks up nor those that a path is or is not found at are dealt by their ids."""
    plan = _plan(queries.QUERIES["boolean_not_path"](spark, "/root/testdata/sf0.001"))
    assert "LeftOuter" in plan and "SortMergeJoin" not in plan


def test_few_settled_edges_move_no_pages(unbroadcast, spark):
    c = Collection(spark, "/root/testdata/sf0.001")
    edges = c.edges.where("kind = 'placed_by'")
    supports = edges.select(F.col("relationship_id").alias("item_id"), F.col("from_page_id").alias("source_id"))
    near = c.near(edges, reconcile.settled(supports, supports.select("source_id", F.lit("keep").alias("action")).distinct()))
    plan = _plan(near.met(spark.createDataFrame([("page-customer-1",)], "at string"), 1, ["page-customer-1"]))
    assert "LeftOuter" in plan and "SortMergeJoin [next" not in plan


@pytest.mark.parametrize("broadcast", [1 << 17, 3, 0])
def test_sources_in_the_edges_rows_are_those_of_a_table(spark, monkeypatch, broadcast):
    """Though edges run in a ring, are met from either end, are few or many, and sources are told of twice or not at all."""
    pages, edges = graph(spark)
    supports = edges.select(F.col("relationship_id").alias("item_id"), F.col("from_page_id").alias("source_id"))
    sources = spark.createDataFrame([(f"pé{i}", "removed" if i % 3 == 0 else "keep") for i in range(15)] + [("pé6", "uncertain"), ("other", "removed")], "source_id string, action string")
    whole = reconcile.supported_edges(edges, reconcile.withdrawn_supports(supports, sources))
    monkeypatch.setattr(adjacency, "BROADCAST_PAGES", broadcast)
    near = Derived(both_ways(edges), pages=pages, settle=reconcile.settled(adjacency.from_page(), sources))
    for ask in (lambda e: paths.explore(pages, e, "pé1", 3), lambda e: B._examined(B.Path("pé2", (B.Hop("next"), B.Hop("7", False))), Adjacency.of(pages, e))):
        want = sorted(map(repr, ask(whole).collect()))
        assert len(want) > 1 and sorted(map(repr, ask(near).collect())) == want


def test_many_settled_edges_are_not_stored_nor_their_supports_moved(unbroadcast, spark, monkeypatch):
    """A page with too many edges to be broadcast: nothing is written, no supports are joined by identities, and none are made."""
    for module in (adjacency, reconcile):
        monkeypatch.setattr(module, "BROADCAST_PAGES", 0)
    folder = "/root/testdata/sf0.001"
    orders = pq.read_table(f"{folder}/orders.parquet", columns=["o_orderkey", "o_custkey"]).to_pylist()
    shared_dir(spark)
    written = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    before = set(written.rglob("*"))
    found = queries.QUERIES["paths_after_withdrawal"](spark, folder)
    got = sorted(r["page_id"] for r in found.collect())
    assert got and got == sorted(f"page-order-{r['o_orderkey']}" for r in orders if r["o_custkey"] == 1 and r["o_orderkey"] % 3)
    assert not set(written.rglob("*")) - before
    assert "sha2" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("broadcast", [1 << 17, 3, 0])
def test_routes_are_kept_where_they_are_evidence(spark, monkeypatch, broadcast):
    """Under an even number of negations, and though the same path is denied elsewhere."""
    pages, edges = graph(spark)
    monkeypatch.setattr(adjacency, "BROADCAST_PAGES", broadcast)
    path, other = B.Path("pé2", (B.Hop("next"), B.Hop("7"))), B.Path("pé8", (B.Hop("next", False),))
    for near in (Adjacency(with_pages(pages, edges)), Derived(both_ways(edges), pages=pages)):
        ask = lambda tree: sorted(map(repr, B.query_pages(pages, near, tree).select("page_id", "evidence").collect()))  # noqa: B023, E731
        assert "route=['r02', 's03']" in ask(path)[0] and ask(B.Not(B.Not(path))) == ask(path)
        denied = ask(B.Not(path))
        assert len(denied) == 19 and all("evidence=[]" in row for row in denied)
        assert ask(B.And((B.Or((path, other)), B.Not(B.And((path, B.Not(other))))))) == ["Row(page_id='pé7', evidence=[Row(leaf=1, route=['r07']), Row(leaf=3, route=['r07'])])"]
