"""Benchmark decontamination by size-partitioned MinHash containment.

An item is its set of distinct five-word shingles (of all its words in a row, if it has fewer than
five); a document holds the item if it has at least 80 % of them. Items are partitioned by size.
In a partition each item is sketched by its smallest shingle hashes, as many as the partition's
upper size bound requires: a document may lack floor(0.2 n) of n shingles, so a sketch longer than
that cannot be missed altogether. Long documents are not sketched; each of their shingle hashes is
looked up among the sketches, so a short item weighs as much in a long document as in a short one.
Candidates whose sketch hits allow 80 % are verified by the exact shingles. No pair at or above
the threshold is lost.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, small_batches, spare, text_digest
from .simhash import _LOWER, shingle_hashes

WIDTH, THRESHOLD = 5, 0.8
#: Sketches are longer than the shingles that may be missing by so many, to leave fewer false candidates.
SPARE = 4
#: Benchmark text in a broadcast block; a larger benchmark takes several passes over the documents.
BLOCK_BYTES = 32 << 20


def _words(text: str | None) -> list[bytes]:
    """Words, A-Z lower-cased."""
    return (text or "").encode().translate(_LOWER).split()


def shingles(text: str | None, width: int = WIDTH) -> set[bytes]:
    """Distinct runs of `width` words; fewer words than that have none."""
    words = _words(text)
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)} if width else set()


class _Sketches:
    """Items whose shingles have one width, ready to be looked up."""

    def __init__(self, items: list[tuple[int, set[bytes]]], threshold: float, width: int) -> None:
        self.threshold, self.width, self.items = threshold, width, items
        hashes, owners, self.needed = [], [], []
        for i, (_, found) in enumerate(items):
            n = len(found)
            upper = 1 << (n - 1).bit_length()  # the partition holds sizes in (upper / 2, upper]
            missing = n - ceil(threshold * n - 1e-9)
            sketch = min(n, upper - ceil(threshold * upper - 1e-9) + SPARE)
            own = np.sort(np.concatenate([shingle_hashes(s.decode(), width) for s in found]))
            hashes.append(own[:sketch])
            owners.append(np.full(sketch, i))
            self.needed.append(sketch - missing)
        flat = np.concatenate(hashes)
        order = np.argsort(flat, kind="stable")
        self.hashes, self.owners = flat[order], np.concatenate(owners)[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def held_by(self, text: str) -> list[tuple[int, int, int]]:
        hashes = shingle_hashes(text, self.width)
        hashes = hashes[self.maybe[(hashes >> np.uint64(44)).astype(np.int64)]]
        if not len(hashes):
            return []
        hashes = np.unique(hashes)
        low, high = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        hits = Counter(i for a, b in zip(low.tolist(), high.tolist(), strict=True) if b > a for i in self.owners[a:b].tolist())
        candidates = [i for i, n in hits.items() if n >= self.needed[i]]
        if not candidates:
            return []
        of_text = shingles(text, self.width)
        found = []
        for i in sorted(candidates):
            item, own = self.items[i]
            shared = len(own & of_text)
            if shared >= self.threshold * len(own) - 1e-9:
                found.append((item, len(own), shared))
        return found


class Sketches:
    """The items (item, text) of a block; an item of fewer words than the width is looked up by runs of as many."""

    def __init__(self, items: list[tuple[int, str | None]], threshold: float = THRESHOLD, width: int = WIDTH) -> None:
        of_width: dict[int, list[tuple[int, set[bytes]]]] = {}
        for item, text in items:
            n = min(width, len(_words(text)))
            if n:
                of_width.setdefault(n, []).append((item, shingles(text, n)))
        self.parts = [_Sketches(own, threshold, n) for n, own in sorted(of_width.items())]

    def held_by(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, shingles, shared) of the items that the text holds."""
        return [hit for part in self.parts for hit in part.held_by(text or "")]


def _distinct(benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """(id, item, text): item is a number that equal texts share."""
    text = F.coalesce(F.col(item_text).cast("string"), F.lit(""))
    return benchmark.select(F.col(item_col).cast("long").alias("id"), F.xxhash64(text).alias("item"), text.alias("text"))


def _blocks(items: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """Distinct items (item, text), and the number of blocks of bounded size that hold them."""
    small_batches(items.sparkSession)
    items = items.groupBy("item", "text").count().select("item", "text")
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return items, 1 + total // block_bytes


def _sent(items: DataFrame, block: int, blocks: int) -> Broadcast:
    """A block of the items; which one a text is in is chosen by hash, so blocks stay near their size."""
    rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
    return items.sparkSession.sparkContext.broadcast([(r["item"], r["text"]) for r in rows])


def _passes(items: DataFrame, blocks: int, run: Callable[[Broadcast], DataFrame]) -> DataFrame:
    """The union of run(block) over all blocks.

    One block needs one lazy pass. With more, each pass is written before the next block is sent,
    so that never more than one block is out.
    """
    found = None
    for block in range(blocks):
        sent = _sent(items, block, blocks)
        part = run(sent)
        if blocks > 1:
            part = durable(part)
            sent.unpersist()
        found = part if found is None else found.unionAll(part)
    return found


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment): a row per document row and item row that it holds.

    Items without words hold nothing and are held by nothing, as are null texts. An item with
    fewer than five words is held by documents in which these words follow each other. Equal
    documents or items give equal rows each; null ids stay null. Empty tables give no rows; other
    columns are not read. Distinct items are taken in blocks of bounded size, each broadcast for
    one pass over the documents.
    """
    schema = "doc_id long, item long, n_shingles int, n_shared int"
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = _distinct(benchmark, item_col, item_text)

    def run(sketches: Broadcast) -> DataFrame:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Sketches(sketches.value, threshold, width)
            for batch in batches:
                out = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in known.held_by(t)]
                columns = list(zip(*out, strict=True)) or [()] * 4
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item", "n_shingles", "n_shared"])

        return narrow.mapInArrow(each, schema)

    found = _passes(*_blocks(items, block_bytes), run).join(items.select("item", F.col("id").alias("item_id")), "item")
    return found.select("doc_id", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item: each is judged by its own text.

    Null and empty texts hold nothing and stay; rows that repeat go or stay together; ids are not
    read, so null and repeated ids change nothing; without items all rows stay. A benchmark of one
    block is a filter and moves no text; more blocks mark the digests of the texts that go.
    """
    name = spare(docs, "held")
    items, blocks = _blocks(_distinct(benchmark, item_col, item_text), block_bytes)
    if blocks == 1:
        sent = _sent(items, 0, 1)

        def holds(batches):
            known = Sketches(sent.value)
            for texts in batches:
                yield pd.Series([bool(known.held_by(t)) for t in texts], dtype=bool)

        holds.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return docs.withColumn(name, F.pandas_udf(holds, "boolean")(F.col(text_col).cast("string"))).where(~F.col(name)).select(*docs.columns)

    narrow = docs.select(text_digest(text_col).alias(name), F.col(text_col).cast("string").alias("text"))

    def run(sketches: Broadcast) -> DataFrame:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Sketches(sketches.value)
            for batch in batches:
                hit = pa.array([bool(known.held_by(t)) for t in batch.column(1).to_pylist()], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(hit)], [name])

        return narrow.mapInArrow(each, f"{name} binary")

    held = durable(_passes(items, blocks, run).distinct())
    return docs.join(held, text_digest(text_col) == F.col(name), "left_anti")


def _side(table: str, key: str) -> str:
    return f"""
  {table}_words AS (SELECT {key}, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT {key}, text FROM {table}))"""


def _runs(key: str, words: str, width: str, source: str) -> str:
    return f"SELECT DISTINCT {key}, {width} AS width, unnest(CASE WHEN len({words}) < {width} THEN [] ELSE list_transform(generate_series(1, len({words}) - {width} + 1), lambda i: array_to_string({words}[i:i + {width} - 1], ' ')) END) AS s FROM {source}"


SQL = f"""
WITH {_side("documents", "doc_id")}, {_side("benchmark", "item_id")},
  items AS (SELECT item_id, w, least({WIDTH}, len(w)) AS width FROM benchmark_words WHERE len(w) > 0),
  item_runs AS ({_runs("item_id", "w", "width", "items")}),
  document_runs AS ({_runs("doc_id", "w", "width", "documents_words, (SELECT DISTINCT width FROM items)")}),
  sizes AS (SELECT item_id, count(*) AS n FROM item_runs GROUP BY item_id),
  shared AS (SELECT doc_id, item_id, count(*) AS k FROM document_runs JOIN item_runs USING (s, width) GROUP BY ALL)
SELECT doc_id, item_id, n::INTEGER AS n_shingles, k::INTEGER AS n_shared, k / n AS containment
FROM shared JOIN sizes USING (item_id) WHERE k >= {THRESHOLD} * n - 1e-9
"""
