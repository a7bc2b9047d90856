"""SimHash near-duplicates, linked through vantage-point trees.

Fingerprints lie in a metric space under Hamming distance. A vantage-point tree, built from a
bounded sample, deals all distinct fingerprints to shards: at each node a fingerprint is inside
if its distance to the node's vantage point is at most the node's bound, else outside. Two
fingerprints within the radius differ by at most the radius in that distance (triangle
inequality), so only those just outside a bound are also sent inside as guests, and each shard
compares its own members with its members and guests. No pair is lost or seen in two shards.

Inside a shard the same recursion goes on down to blocks that are compared by XOR and popcount.
A shard returns a spanning forest of its links, not the links: a group of n copies costs n rows.
Components of all shards' forests are found by repeated contraction in DataFrame operations, until
so few links are left that one task closes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.session import FILE_ROWS

from .common import compact, durable, small, small_batches, spare, text_digest
from .groups import Forest, linked

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ONES = np.uint64(0x0101010101010101)

#: Fingerprints sampled for each shard to place vantage points, and in all (8 bytes each on the driver; twice as many at most).
SAMPLE_PER_SHARD, SAMPLE_ROWS = 64, 1 << 20
#: The tree has at most 2**17 leaves; it is broadcast with 10 bytes a node.
MAX_DEPTH = 17
#: Rows of a shard that a task holds at once, 17 bytes each; and links that one task may close, 16 bytes each.
BLOCK_ROWS, TASK_LINKS = 1 << 18, 1 << 18


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `width` words, A-Z lower-cased, joined by spaces.

    Fewer words than that make one shingle of them all; no words (or null) make none.
    """
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], 42) for a, b in pairs], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """64 bits; a bit is 1 if over half the hashes have it. No hashes: 0."""
    n = len(hashes)
    if not n:
        return 0
    # Eight byte lanes are counted at once, in runs of at most 255 hashes.
    pad = -n % 255
    rows = np.concatenate([hashes, np.zeros(pad, np.uint64)]).reshape(-1, 255) if n > 255 else hashes.reshape(1, -1)
    counts = np.empty((8, 8), np.int64)
    for bit in range(8):
        lanes = ((rows >> np.uint64(bit)) & _ONES).sum(axis=1, dtype=np.uint64)
        counts[:, bit] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts.reshape(64) > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, keyed: bool = False) -> DataFrame:
    """(doc_id, fp): one row per row of docs, the fingerprint as a signed 64-bit integer; with `keyed` also the text's digest.

    Null and blank texts have fingerprint 0. Other columns of docs are not read.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(shingle_hashes(t, width)) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *["digest"] * keyed])

    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[text_digest(text_col).alias("digest")] * keyed)
    return narrow.mapInArrow(each, "doc_id long, fp long" + ", digest binary" * keyed)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def _choose(points: np.ndarray, radius: int, tries: int = 12) -> tuple[np.uint64, int]:
    """A vantage point and bound: near the median, with few points just outside the bound."""
    best = (2.0, points[0], 64)
    for vantage in points[np.linspace(0, len(points) - 1, min(tries, len(points))).astype(int)]:
        d = np.sort(_distance(points, vantage))
        for bound in np.unique(d[[len(d) // 3, len(d) // 2, 2 * len(d) // 3]]):
            inside, band = np.searchsorted(d, [bound, bound + radius], side="right")
            share = inside / len(d)
            cost = (band - inside) / len(d) + 2 * max(0.0, abs(share - 0.5) - 0.15)
            if cost < best[0]:
                best = (cost, vantage, int(bound))
    return best[1], best[2]


def build_tree(sample: np.ndarray, depth: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and bounds of a complete binary tree, node i's children at 2i+1 and 2i+2."""
    vantage, bound = np.zeros(2**depth - 1, np.uint64), np.full(2**depth - 1, 64, np.int16)
    held = {0: sample}
    for node in range(2**depth - 1):
        points = held.pop(node, sample[:0])
        if len(points) < 2:
            continue
        vantage[node], bound[node] = _choose(points, radius)
        inside = _distance(points, vantage[node]) <= bound[node]
        held[2 * node + 1], held[2 * node + 2] = points[inside], points[~inside]
    return vantage, bound


def route(fps: np.ndarray, tree: tuple[np.ndarray, np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, own): each fingerprint's own shard, and the shards that it visits as a guest."""
    vantage, bound = tree
    row, node, own = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
    while len(node) and node[0] < len(vantage):
        d, edge = _distance(fps[row], vantage[node]), bound[node]
        inside = d <= edge
        goes_in = np.where(own, inside | (d <= edge + radius), d - radius <= edge)
        goes_out = np.where(own, ~inside, d + radius > edge)
        row, own, node = (
            np.concatenate([row[goes_in], row[goes_out]]),
            np.concatenate([(own & inside)[goes_in], own[goes_out]]),
            np.concatenate([2 * node[goes_in] + 1, 2 * node[goes_out] + 2]),
        )
    return row, node - len(vantage), own


def link_points(points: np.ndarray, own: np.ndarray, joined: int, radius: int, block: int = 1 << 20) -> np.ndarray:
    """Each point's root in the graph of links within the radius: all of own points with any point.

    The first `joined` points are known to be connected; if there are any, every other point counts as own.
    """
    forest = Forest(len(points))
    if joined:
        forest.parent[:joined] = 0
        own = np.arange(len(points)) >= joined
    todo = [(np.flatnonzero(own), np.flatnonzero(~own))]
    while todo:
        mine, other = todo.pop()
        if not len(mine):
            continue
        if len(mine) * (len(mine) + len(other)) > 4 * block:
            vantage, bound = _choose(points[mine], radius)
            d = _distance(points[mine], vantage)
            inside = d <= bound
            if 0.02 < inside.mean() < 0.98:
                near = mine[~inside & (d <= bound + radius)]
                e = _distance(points[other], vantage) if len(other) else np.empty(0, np.int16)
                todo.append((mine[inside], np.concatenate([other[e - radius <= bound], near])))
                todo.append((mine[~inside], other[e + radius > bound]))
                continue
        both = np.concatenate([mine, other])
        step = max(1, block // len(both))
        for at in range(0, len(mine), step):
            rows, rest = mine[at : at + step], both[at:]
            # A crowd soon hangs together; what does is not compared again.
            usual = np.bincount(forest.parent[rows]).argmax()
            same = forest.parent[rows] == usual
            for a, b in ((rows[same], rest[forest.parent[rest] != usual]), (rows[~same], rest)):
                i, j = np.nonzero(np.bitwise_count(points[a, None] ^ points[None, b]) <= radius)
                forest.join(a[i], b[j])
    return forest.parent


def close_links(distinct: DataFrame, radius: int = 2, shard_rows: int = 8192, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b): links whose components equal those of all pairs within the radius.

    `distinct` has a column fp without repeats. Shards get about `shard_rows` members, more once
    there would be over 512 shards, and up to 2**16 until there are 2**MAX_DEPTH. The tree is built
    on the driver from a bounded sample. Where fingerprints crowd within a few bits no bound
    separates them; a shard of over `block_rows` rows goes in blocks of that size (see groups).
    """
    spark = distinct.sparkSession
    total = distinct.count()
    shard_rows = max(shard_rows, min(total // 512, 1 << 16))
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(1, total / shard_rows))))))
    wanted = min(SAMPLE_PER_SHARD << depth, SAMPLE_ROWS)
    sample = np.empty(0, np.uint64)
    if depth:
        share = min(1 << 20, int(wanted / total * (1 << 20)) + 1)
        picked = distinct.select("fp").where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < share).limit(2 * wanted)
        sample = np.sort(picked.toArrow().column(0).to_numpy()).view(np.uint64)
    tree = spark.sparkContext.broadcast(build_tree(sample, depth, radius))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            row, shard, own = route(fps, tree.value, radius)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int64)), pa.array(fps[row].view(np.int64)), pa.array(own)], ["key", "node", "own"])

    def roots(columns: dict, joined: int) -> np.ndarray:
        return link_points(columns["node"].view(np.uint64), columns["own"], joined, radius)

    small_batches(spark)
    dealt = distinct.select("fp").mapInArrow(deal, "key long, node long, own boolean")
    return linked(dealt, F.lit(1), block_rows, BLOCK_ROWS >> 3, roots, total)


def _close(links: DataFrame) -> DataFrame:
    """(fp, root) of links that one task holds; the root is an end of the component."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if len(b)]
        if ends:
            nodes, at = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
            forest, (a, b) = Forest(len(nodes)), at.reshape(2, -1)
            forest.join(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[forest.parent])], ["fp", "root"])

    small_batches(links.sparkSession)
    return links.select("a", "b").coalesce(1).mapInArrow(each, "fp long, root long")


def components(links: DataFrame, rows: int, task_links: int = TASK_LINKS) -> DataFrame:
    """(fp, root): for each end of a link, of which there are `rows` at most, one end that all of its component share.

    Each round maps every node to the smallest of its neighbours and itself and contracts the
    links accordingly. Ends are hashes, so their order is unrelated to the links and a constant
    share of the nodes goes in each round. Every step is an aggregation or an equi-join. Once at
    most `task_links` links are left, one task of that size closes them.
    """
    links = durable(links.where("a <> b"), rows)
    rounds: list[DataFrame] = []
    while (n := links.count()) > task_links:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        to = durable(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("to")), 2 * n)
        rounds.append(to)
        links = durable(
            links.join(to.withColumnsRenamed({"u": "a", "to": "x"}), "a").join(to.withColumnsRenamed({"u": "b", "to": "y"}), "b")
            .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), n
        )
    left = durable(_close(links), 1)
    if not rounds:
        return left
    found = rounds[0].select(F.col("u").alias("fp"), F.col("to").alias("root"))
    for to in [*rounds[1:], left.select(F.col("fp").alias("u"), F.col("root").alias("to"))]:
        found = found.join(to.select(F.col("u").alias("root"), "to"), "root", "left").select("fp", F.coalesce("to", "root").alias("root"))
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id): a row per row of docs.

    component_id is the smallest doc_id that links of at most `radius` differing bits reach; null
    ids are passed over there, so a component whose ids are all null has a null component_id.
    Empty and null texts share fingerprint 0 and link like others; equal rows stay separate rows;
    an empty table gives no rows.
    """
    rows = docs.count()
    of_doc = durable(fingerprints(compact(docs, rows), id_col, text_col, width))
    found = _grouped(of_doc, rows, F.col("doc_id"), radius)
    return compact(found, rows, FILE_ROWS).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("kept").alias("component_id"))


def _grouped(of_doc: DataFrame, rows: int, value: Column, radius: int) -> DataFrame:
    """of_doc (fp, ...), of `rows` rows, with kept, the smallest value in each row's component."""
    distinct = durable(of_doc.groupBy("fp").agg(F.min(value).alias("least")), rows)
    joined = durable(distinct.join(components(close_links(distinct, radius), rows), "fp"), rows)
    least = durable(joined.groupBy("root").agg(F.min("least").alias("kept")), rows)
    moved = joined.join(least, "root").select("fp", "kept")
    # Written before it meets the rows: with an exchange of its own on either side, a join on a fingerprint that many rows share can be split.
    by_fp = durable(distinct.join(moved, "fp", "left").select("fp", F.coalesce("kept", "least").alias("kept")), rows)
    return of_doc.join(by_fp, "fp")


def keep_first(docs: DataFrame, found: DataFrame, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that are not their component's kept one; found has (doc_id, digest, kept), a
    row per row of docs whose id is not null, `rows` at most, kept being a (doc_id, digest).

    Each row is judged by its id and text. Rows that repeat both are reduced to one; rows with null ids stay.
    """
    id_name, text_name = spare(docs, "copy"), spare(docs, "copy_digest")
    counted = found.groupBy("doc_id", "digest").agg(F.first("kept").alias("kept"), F.count("*").alias("n"))
    counted = counted.select(F.col("doc_id").alias(id_name), F.col("digest").alias(text_name), "n", ((F.col("kept.doc_id") == F.col("doc_id")) & (F.col("kept.digest") == F.col("digest"))).alias("stays"))
    counted = durable(counted.where("NOT stays OR n > 1"), rows)
    copies, repeated = (counted.where(which).select(id_name, text_name) for which in ("NOT stays", "stays"))
    several, n = repeated.count(), counted.count()
    same = (F.col(id_col).cast("long") == F.col(id_name)) & (text_digest(text_col) == F.col(text_name))
    left = docs.join(small(copies, n), same, "left_anti")
    if not several:
        return left
    keyed = left.withColumns({id_name: F.col(id_col).cast("long"), text_name: text_digest(text_col)})
    one = keyed.join(small(repeated, several), [id_name, text_name], "left_semi").dropDuplicates([id_name, text_name])
    return left.join(small(repeated, several), same, "left_anti").unionAll(one.select(*docs.columns))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """docs with one row of each component, of the smallest id and then the smallest text digest, with all columns.

    Rows with null ids stay. Rows that repeat both id and text are reduced to one.
    """
    rows = docs.count()
    docs = compact(docs, rows)
    of_doc = durable(fingerprints(docs, id_col, text_col, width, keyed=True))
    value = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "digest"))
    return compact(keep_first(docs, _grouped(of_doc, rows, value, radius).where("doc_id IS NOT NULL"), rows, id_col, text_col), rows)
