"""Winnowed document fingerprints.

Each run of K code points has a rolling hash; of every W consecutive hashes the smallest is kept,
the rightmost of equal ones, with its position. Two texts that share K + W - 1 code points in a
row share at least one kept hash; shorter matches than K are never reported.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tasks

K, W = 20, 31
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: While there are fewer ranges than shuffle partitions, ranges get smaller, down to about so many bytes.
SMALL_BUCKET_BYTES = 1 << 20
#: Ranges at most, and rows sampled for each to place its end (16 bytes each on the driver).
MAX_BUCKETS, SAMPLE_PER_BUCKET = 20_000, 32
#: Hashes have 40 bits and share a 64-bit word with the position in the block; a block's positions fit 24 bits.
BLOCK = 1 << 22


def _powers(base: int, n: int, cache: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    if len(cache.get(base, ())) < n:
        out = np.full(max(n, 4096), base, np.uint64)
        out[0] = 1
        cache[base] = np.multiply.accumulate(out)
    return cache[base][:n]


def rolling_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """40-bit hashes of all runs of k codes (of the whole, if it has fewer than k; none if empty)."""
    n = len(codes)
    if not n:
        return np.empty(0, np.uint64)
    k = min(k, n)
    # Sum of code * base**i over the run, divided by base**start: all modulo 2**64, where an odd base has an inverse.
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n))])
    h = (sums[k:] - sums[:-k]) * _powers(_INVERSE, n - k + 1)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h >> np.uint64(24)


def _window_minima(keys: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while 2 * span <= w:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    rest = w - span
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


def winnow(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) that the text keeps, by position."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    hashes = rolling_hashes(codes, k)
    n = len(hashes)
    if not n:
        return np.empty(0, np.int64), hashes
    found = []
    for at in range(0, max(1, n - w + 1), BLOCK):  # blocks overlap by w - 1 hashes
        block = hashes[at : at + BLOCK + w - 1]
        back = np.uint64(0xFFFFFF) - np.arange(len(block), dtype=np.uint64)  # the rightmost of equal hashes is least
        least = _window_minima((block << np.uint64(24)) | back, min(w, len(block)))
        least = least[np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))]
        found.append(at + (np.uint64(0xFFFFFF) - (least & np.uint64(0xFFFFFF))).astype(np.int64))
    positions = np.unique(np.concatenate(found))
    return positions, hashes[positions]


def digest(positions: np.ndarray, hashes: np.ndarray) -> str:
    """A short name of a fingerprint: equal for equal positions and hashes."""
    return hashlib.sha256(positions.astype("<i8").tobytes() + hashes.astype("<u8").tobytes()).hexdigest()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of kept hashes (sorted, without repeats); 1 if both are empty."""
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """(doc_id, positions, hashes): the operator's own output, a row per row of docs; null texts are empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [winnow(t or "", k, w) for t in batch.column(1).to_pylist()]
            arrays = [batch.column(0), *(pa.array([x[i].astype(np.int64) for x in kept], pa.list_(pa.int64())) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "positions", "hashes"])

    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(each, "doc_id long, positions array<long>, hashes array<long>")


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as many of the following text's code points."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


class _Row:
    def __init__(self, bucket: int, guest: bool, doc_id: int | None, text: str) -> None:
        self.bucket, self.guest, self.doc_id, self.text = bucket, guest, doc_id, text
        self.kept = winnow(text)
        self.set = np.unique(self.kept[1])


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_kept long"


class Ranges:
    """Ranges of (rank, tie), each up to and including its end, an entry of the sorted array `ends` (n, 2)."""

    def __init__(self, ends: np.ndarray) -> None:
        self.rank, self.tie = ends[:, 0], ends[:, 1]

    def __len__(self) -> int:
        return len(self.rank)

    def of(self, rank: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """The range of each pair; none is beyond the last end."""
        low, high = np.searchsorted(self.rank, rank, "left"), np.searchsorted(self.rank, rank, "right")
        among = np.flatnonzero(low < high)  # several ranges may end within one rank
        for a in np.unique(low[among]):
            rows = among[low[among] == a]
            low[rows] = a + np.searchsorted(self.tie[a : high[rows[0]]], tie[rows], "left")
        return low


def range_ends(keyed: DataFrame, parts: int, top: tuple[int, int]) -> np.ndarray:
    """Ends of about `parts` ranges of keyed (rank, tie), the last of them `top`; from a bounded sample by hash of what the rows hold."""
    wanted = SAMPLE_PER_BUCKET * parts
    share = int(min(1.0, wanted / max(1, keyed.count())) * (1 << 30)) + 1
    sample = keyed.where(F.pmod(F.xxhash64("rank", "tie", F.lit("range ends")), F.lit(1 << 30)) < share).limit(4 * wanted).toArrow()
    found = np.unique(np.stack([sample.column(c).to_numpy() for c in (0, 1)], axis=1), axis=0)
    ends = found[np.linspace(0, len(found) - 1, parts + 1).astype(int)[1:-1]] if len(found) > 1 and parts > 1 else found[:0]
    return np.unique(np.concatenate([ends, np.array([top], np.int64)]), axis=0)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 16 << 20) -> DataFrame:
    """Fingerprints of texts and of their edited texts; see edited() and the columns at the end.

    The next document is that with the next smaller id; after the smallest comes the largest.
    Null ids come after all others; rows of equal ids follow each other by a hash of their texts;
    the only row of a table is its own next. Null texts are empty; an empty table gives no rows.

    Rows are dealt to ranges of (id, hash of the text) that end at rows of the table, so one id with
    a third of all rows spreads over many ranges; only rows that repeat both stay together. The row
    at the end of a range also goes to the range above as its guest, since the smallest row there
    needs it as next. So each text is shuffled once, rows stream in order, and only one is held back.
    """
    spark = docs.sparkSession
    small_batches(spark)
    lowest = -(1 << 63)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("rank"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    narrow = narrow.select("doc_id", "rank", F.xxhash64("text").alias("tie"), "text")
    size = narrow.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.max(F.struct("rank", "tie")).alias("top")).first()
    if size["top"] is None:
        return spark.createDataFrame([], _OUT)
    total = size["bytes"]
    parts = int(min(MAX_BUCKETS, max(1 + total // bucket_bytes, tasks(spark, total, SMALL_BUCKET_BYTES))))
    ranges = Ranges(range_ends(narrow.select("rank", "tie"), parts, tuple(size["top"])))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, tie = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            bucket = ranges.of(rank, tie)
            ends_one = np.flatnonzero((ranges.rank[bucket] == rank) & (ranges.tie[bucket] == tie))
            rows = pa.array(np.concatenate([np.arange(len(rank)), ends_one]))
            to = np.concatenate([bucket, (bucket[ends_one] + 1) % len(ranges)]).astype(np.int32)
            guest = np.arange(len(to)) >= len(rank)
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(guest), *batch.take(rows).columns], ["bucket", "guest", *batch.schema.names])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(row: _Row, after: _Row) -> dict:
            changed = edited(row.text, after.text)
            kept = winnow(changed)
            return {
                "doc_id": row.doc_id, "n_chars": len(row.text), "edited_sha256": hashlib.sha256(changed.encode()).hexdigest(),
                "fingerprint": digest(*row.kept), "edited_fingerprint": digest(*kept), "near_edited": likeness(row.set, np.unique(kept[1])),
                "near_next": likeness(row.set, after.set), "n_kept": len(row.kept[0]),
            }

        last: _Row | None = None
        for batch in batches:
            out = []
            for bucket, guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text")), strict=True):
                if last is not None and last.bucket == bucket and last.guest:
                    continue  # further rows like the guest
                row = _Row(bucket, guest, doc_id, text)
                if last is not None and not last.guest:
                    out.append(finish(last, row))
                last = row
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_kept", pa.int64())])
    dealt = narrow.mapInArrow(deal, "bucket int, guest boolean, doc_id long, rank long, tie long, text string")
    ordered = dealt.repartitionById(len(ranges), F.col("bucket")).sortWithinPartitions("bucket", "guest", F.desc("rank"), F.desc("tie"), F.desc("text"))
    return ordered.mapInArrow(follow, _OUT)
