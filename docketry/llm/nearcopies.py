"""Near copies: one document of each group of texts that share most of their five-word shingles.

Groups are linked in two ways. SimHash fingerprints within the radius are found through the
vantage-point trees of `simhash`. Texts with a Jaccard similarity of 0.8 or more are often 5 to 14
bits apart, where no bound of such a tree prunes; they are found by min-hash bands and verified.

Candidates: 24 bands of 4 min-hashes. A pair at 0.8 misses all bands with a probability of 3e-6.
Pairs that share a band and agree in at least 60 of 96 lanes are candidates; their components are
found first, so each text's shingles travel once, to the verification of its own component. Both
steps go through `groups`: no task holds more than two blocks of a group, and no pair that could
add a link is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compact, durable, small, small_batches, text_digest
from .groups import Forest, linked
from .simhash import close_links, components, keep_first, shingle_hashes, simhash

WIDTH, SIMILARITY, RADIUS = 5, 0.8, 2
BANDS, BAND_LANES = 24, 4
#: Lanes that a candidate pair must share: at 0.8, 5e-6 of the pairs share fewer.
LEAST_LANES = 60
#: What a block of a group holds: band members, and shingles.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 18
#: What makes a task of its own: band members, and shingles.
TASK_ROWS, TASK_SHINGLES = 1 << 13, 1 << 18
#: A row of nodes has 24 bands and 96 lanes, so many times what a row of a small table has.
WIDE = 12

_random = np.random.default_rng(42)
_FACTORS = _random.integers(0, 1 << 63, BANDS * BAND_LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _random.integers(0, 1 << 63, BANDS * BAND_LANES, dtype=np.uint64)


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of each lane over all hashes (at least one)."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[at : at + 4096, None] * _FACTORS + _TERMS).min(axis=0))
    return least


def _node(distinct: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(distinct.tobytes(), 42)).view(np.int64)) if len(distinct) else 0


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, fp, node, n, bands, lanes): a row per row of docs.

    node is a hash of the set of n distinct shingles; null and blank texts have none, node 0 and
    no bands. Texts with fewer words than a shingle have one shingle, their words.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, nodes, sizes, bands, lanes = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingle_hashes(text, WIDTH)
                distinct = np.unique(hashes)
                fps.append(simhash(hashes))
                nodes.append(_node(distinct))
                sizes.append(len(distinct))
                least = min_hashes(distinct) if len(distinct) else np.empty(0, np.uint64)
                rows = least.reshape(-1, BAND_LANES)
                bands.append(np.array([xxhash.xxh64_intdigest(r.tobytes(), b) for b, r in enumerate(rows)], np.uint64).view(np.int64))
                lanes.append((least >> np.uint64(56)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(lanes, pa.binary())],
                ["doc_id", "digest", "fp", "node", "n", "bands", "lanes"],
            )

    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), text_digest(text_col).alias("digest"))
    return narrow.mapInArrow(each, "doc_id long, digest binary, fp long, node long, n long, bands array<long>, lanes binary")


def _order(lanes: np.ndarray) -> np.ndarray:
    """The most typical rows first: a text that its copies were made from comes before them."""
    if len(lanes) < 9:
        return np.arange(len(lanes))
    usual = np.array([np.bincount(lane, minlength=256).argmax() for lane in lanes.T], np.uint8)
    return np.argsort(-(lanes == usual).sum(axis=1), kind="stable")


def forest(lanes: np.ndarray, sets: list[np.ndarray] | None = None, joined: int = 0) -> np.ndarray:
    """Each row's root in the graph of pairs that share LEAST_LANES and, with sets, are similar enough.

    The first `joined` rows are known to be connected. Pairs already connected are not looked at.
    """
    found, order = Forest(len(lanes)), _order(lanes)
    found.parent[:joined] = 0
    for at, mine in enumerate(order[:-1]):
        rest = order[at + 1 :]
        rest = rest[found.parent[rest] != found.parent[mine]]
        if not len(rest):
            if (found.parent == found.parent[mine]).all():
                break
            continue
        near = rest[(lanes[rest] == lanes[mine]).sum(axis=1) >= LEAST_LANES]
        if sets is not None:
            near = np.array([x for x in near.tolist() if similar(sets[mine], sets[x])], np.int64)
        if len(near):
            found.join(np.full(len(near), mine), near)
    return found.roots(found.parent)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of at least SIMILARITY."""
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)) - 1e-9:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= SIMILARITY * (len(a) + len(b) - shared) - 1e-9


def _by_lanes(columns: dict, joined: int) -> np.ndarray:
    return forest(columns["lanes"], None, joined)


def _by_shingles(columns: dict, joined: int) -> np.ndarray:
    return forest(columns["lanes"], columns["shingles"], joined)


def _shingles(docs: DataFrame, wanted: DataFrame, rows: int, id_col: str, text_col: str) -> DataFrame:
    """wanted (node, first, ...) with the shingles of the row that `first` (doc_id, digest) names."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, WIDTH)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "shingles"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(text_col).alias("digest"), F.col(text_col).cast("string").alias("text"))
    named = durable(wanted.select("first.doc_id", "first.digest"), rows)
    sets = texts.join(small(named, named.count()), ["doc_id", "digest"], "left_semi").select("text").mapInArrow(each, "node long, shingles array<long>")
    return wanted.drop("first").join(sets, "node").dropDuplicates(["node"])


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id): a row per row of docs whose id is not null; the smallest id of its group.

    A group is a component of the links between texts with equal shingle sets (blank and null
    texts among them), fingerprints of at most RADIUS differing bits, and similarities of at least
    SIMILARITY. An empty table gives no rows.
    """
    return _grouped(docs, id_col, text_col)[0].select("doc_id", F.col("kept.doc_id").alias("component_id"))


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(doc_id, digest, kept): a row per row of docs whose id is not null, with its group's smallest (doc_id, digest); and their number."""
    of_doc = durable(sketches(docs.where(F.col(id_col).isNotNull()), id_col, text_col))
    rows = max(1, of_doc.count())
    nodes = of_doc.groupBy("node").agg(F.min(F.struct("doc_id", "digest")).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("lanes").alias("lanes"))
    nodes = durable(nodes, WIDE * rows)

    pairs = durable(of_doc.select("fp", "node").distinct(), rows)
    by_fp = durable(pairs.groupBy("fp").agg(F.min("node").alias("rep")), rows)
    same_fp = pairs.join(by_fp, "fp").select(F.col("node").alias("a"), F.col("rep").alias("b")).where("a <> b")
    near_fp = close_links(by_fp.select("fp"), RADIUS)
    near_fp = near_fp.join(by_fp.withColumnsRenamed({"fp": "a", "rep": "x"}), "a").join(by_fp.withColumnsRenamed({"fp": "b", "rep": "y"}), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))

    # Sketches travel only for bands that several texts share.
    shared = durable(nodes.select(F.explode("bands").alias("key")).groupBy("key").count().where("count > 1").select("key"), BANDS * rows)
    banded = durable(nodes.select("node", "lanes", F.explode("bands").alias("key")).join(shared, "key", "left_semi"), BANDS * rows)
    members = banded.count()
    alike = linked(banded, F.lit(1), BLOCK_ROWS, TASK_ROWS, _by_lanes, members)
    candidates = components(alike, members).select(F.col("fp").alias("node"), F.col("root").alias("key"))
    wanted = durable(nodes.select("node", "first", "n", "lanes").join(candidates, "node"), WIDE * rows)
    verified = linked(durable(_shingles(docs, wanted, rows, id_col, text_col)), F.col("n"), BLOCK_SHINGLES, TASK_SHINGLES, _by_shingles, rows)

    joined = durable(nodes.select("node", "first").join(components(same_fp.unionAll(near_fp).unionAll(verified), 4 * rows).withColumnRenamed("fp", "node"), "node"), WIDE * rows)
    least = durable(joined.groupBy("root").agg(F.min("first").alias("kept")), WIDE * rows)
    moved = joined.join(least, "root").select("node", "kept")
    kept = durable(nodes.select("node", "first").join(moved, "node", "left").select("node", F.coalesce("kept", "first").alias("kept")), WIDE * rows)
    return of_doc.select("doc_id", "digest", "node").join(kept, "node").select("doc_id", "digest", "kept"), rows


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all columns, with one row of each group, of the smallest id and then the smallest text digest; rows with null ids stay."""
    total = docs.count()
    docs = compact(docs, total)
    return compact(keep_first(docs, *_grouped(docs, id_col, text_col), id_col, text_col), total)
