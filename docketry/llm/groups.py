"""Links within groups of any size, in tasks of bounded size.

Rows (key, node, payload) of one key are a group. Groups beyond a bound are dealt to blocks, each
with one row of the group as its hub. What a block connects to the hub is connected; only what it
does not is compared with the group's other blocks too. Rows reach a task sorted by group, and a
task holds one group, or two blocks of one, at a time. It returns spanning forests, never pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, small_batches, tasks

#: roots(payload columns of a group's rows, n): each row's root, the smallest row that it is connected to. The first n rows are known to be connected.
Roots = Callable[[dict[str, object], int], np.ndarray]


class Forest:
    """Disjoint sets of 0 to n - 1; a set's root is its smallest number."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        p = self.parent
        while True:
            up = p[x]
            if np.array_equal(up, x):
                return x
            x = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.roots(a), self.roots(b)
        differ = a != b
        if not differ.any():
            return
        n = len(self.parent)
        pairs = np.unique(np.minimum(a, b)[differ] * n + np.maximum(a, b)[differ])
        parent = self.parent
        for x, y in zip((pairs // n).tolist(), (pairs % n).tolist(), strict=True):
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)
        self.parent = self.roots(np.arange(n))


def _column(values: pa.ChunkedArray) -> object:
    """Numbers as an array, byte strings of one length as rows of bytes, lists as a list of arrays."""
    if pa.types.is_list(values.type):
        chunk = values.combine_chunks()
        chunk = chunk.chunk(0) if isinstance(chunk, pa.ChunkedArray) else chunk
        flat, at = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
        return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    if pa.types.is_binary(values.type):
        return np.frombuffer(b"".join(values.to_pylist()), np.uint8).reshape(len(values), -1)
    return values.to_numpy()


def forests(dealt: DataFrame, roots: Roots) -> DataFrame:
    """(a, b, key, open) of each group of equal key, i, j: the links of its forest, and, if some of its rows
    are `settled` (known to be connected), a row (node, node) for each that is not connected to them."""
    payload = [c for c in dealt.columns if c not in ("key", "i", "j", "settled")]
    shape = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("open", pa.bool_())])

    def solved(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        """Of the groups that begin at starts; the last one ends with the rows."""
        found: list[tuple] = []
        columns = {c: _column(rows[c]) for c in payload}
        nodes, keys, settled = columns["node"], rows["key"].to_numpy(), rows["settled"].to_numpy()
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
            if end - start == 1:
                continue
            joined, own = int(settled[start:end].sum()), nodes[start:end]
            root = roots({c: v[start:end] for c, v in columns.items()}, joined)
            moved = joined + np.flatnonzero(root[joined:] != np.arange(joined, end - start))
            found.append((own[moved], own[root[moved]], np.full(len(moved), keys[start]), np.zeros(len(moved), bool)))
            if joined:
                free = np.flatnonzero(root != 0)
                found.append((own[free], own[free], np.full(len(free), keys[start]), np.ones(len(free), bool)))
        parts = [np.concatenate(x) for x in zip(*found, strict=True)] or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(parts, shape, strict=True)], schema=shape)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of a group that is not over yet
        last = None
        for batch in batches:
            if not len(batch):
                continue
            marks = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")])
            starts = np.flatnonzero(np.r_[last is None or (marks[:, 0] != last).any(), (marks[:, 1:] != marks[:, :-1]).any(axis=0)])
            last = marks[:, -1]
            if not len(starts) or (not held and starts[-1] == 0):
                held.append(batch)
                continue
            before = sum(map(len, held))
            whole = pa.Table.from_batches([*held, batch.slice(0, starts[-1])])
            begun = starts[:-1] + before
            yield solved(whole, np.r_[0, begun[begun > 0]].astype(int))
            held = [batch.slice(starts[-1])]
        if held:
            yield solved(pa.Table.from_batches(held), np.zeros(1, int))

    small_batches(dealt.sparkSession)
    ordered = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", F.desc("settled"), "node")
    return ordered.mapInArrow(each, "a long, b long, key long, open boolean")


def linked(frame: DataFrame, weight: Column, bound: int, task: int, roots: Roots, rows: int) -> DataFrame:
    """(a, b): forests of the links within each group of equal `key`, whose nodes are distinct.

    `rows` bounds the frame's rows; `task` is the weight that makes a task of its own. A group beyond the bound of weight is dealt to blocks of about
    that weight, each with the group's hub (its smallest node). What a block does not connect to
    the hub is compared with the other blocks.
    """
    payload = [c for c in frame.columns if c not in ("key", "node")]
    columns = ["key", "i", "j", "settled", "node", *payload]
    groups = frame.groupBy("key").agg(F.count("*").alias("rows"), F.sum(weight).alias("weight"), F.min("node").alias("hub")).where("rows > 1")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("weight") / bound)).cast("int")
    groups = durable(groups.select("key", "hub", "weight", blocks.alias("blocks")), rows)

    def over(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def into_blocks(of_group: DataFrame) -> DataFrame:
        """One join on the key, with a written table, so that it can be split where a key has many rows."""
        return frame.join(of_group, "key").withColumn("i", F.pmod(F.xxhash64("node"), "blocks").cast("int"))

    dealt = into_blocks(groups.select("key", "blocks"))
    hubs = frame.join(groups.where("blocks > 1").select("key", F.col("hub").alias("node"), "blocks"), ["key", "node"]).withColumn("i", over("blocks"))
    first = dealt.withColumn("settled", F.lit(False)).unionByName(hubs.withColumn("settled", F.lit(True))).withColumn("j", F.lit(0))
    width = tasks(frame.sparkSession, groups.agg(F.sum("weight")).first()[0] or 0, task)
    first = durable(forests(first.select(columns), roots).coalesce(width))
    links, apart = first.where("NOT open").select("a", "b"), first.where("open").select("key", F.col("a").alias("node"))
    if apart.isEmpty():
        return links

    apart = apart.distinct()
    pieces = frame.join(apart, ["key", "node"]).groupBy("key").agg(F.sum(weight).alias("loose"))
    pieces = durable(pieces.join(groups, "key").select("key", "blocks", F.ceil(F.col("loose") / bound).cast("int").alias("pieces")), rows)
    marked = into_blocks(pieces).join(apart.withColumn("apart", F.lit(True)), ["key", "node"], "left")
    marked = marked.withColumn("settled", F.col("apart").isNull())
    hosts = marked.withColumn("j", over("pieces"))
    guests = marked.where("apart").withColumn("j", F.pmod(F.xxhash64("node", F.lit(1)), "pieces").cast("int"))
    guests = guests.withColumn("other", over("blocks")).where("other <> i").withColumn("i", F.col("other"))
    second = forests(hosts.select(columns).unionAll(guests.select(columns)), roots)
    return links.unionAll(second.where("NOT open").select("a", "b"))
