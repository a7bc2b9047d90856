"""Token counts through a digest cache.

A text's count depends on its content and the tokenizer alone, so counts are stored under
(SHA-256 of the tokenizer's file, SHA-256 of the text). A run joins its texts' digests to the
stored counts, encodes each distinct text that is missing once, and appends those counts. The
content is taken as it is: a byte-level vocabulary tells apart any two texts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.session import FILE_ROWS

from .common import compact, durable, scratch_dir, small_batches

#: Longer texts are encoded in pieces of about so many characters.
PIECE_CHARS = 1 << 20
#: A single space between two letters or digits of ASCII always starts a new word for byte-level BPE; see _has_seams.
_SEAM = re.compile(r"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")


def _has_seams(tokenizer_json: str) -> bool:
    """Whether texts may be cut at _SEAM: byte-level BPE with its own splitting pattern, no normalizer, no added token with white space."""
    spec = json.loads(tokenizer_json)
    before = spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    return bool(plain and not spec.get("normalizer") and (spec.get("model") or {}).get("type") == "BPE" and not any(re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens") or []))


def encoder(tokenizer_json: str):
    """count(text) for a tokenizer file's content, by the library's defaults. Long texts are cut only where that changes no token."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(tokenizer_json)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    seams = _has_seams(tokenizer_json)
    encode = tokenizer.encode_batch_fast if hasattr(tokenizer, "encode_batch_fast") else tokenizer.encode_batch

    def count(text: str) -> int:
        total, at = 0, 0
        while seams and len(text) - at > PIECE_CHARS:
            seam = _SEAM.search(text, at + PIECE_CHARS)
            if not seam:
                break
            total += len(encode([text[at : seam.start()]], add_special_tokens=False)[0])
            at = seam.start()
        return total + len(encode([text[at:] if at else text], add_special_tokens=False)[0])

    return count


def _known(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """Stored counts of a tokenizer, each digest once, or None if there are none yet.

    Every run appends a folder of its own, in which a digest is once. Runs at the same time may
    both have encoded a text; only then are their rows reduced to one.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/tokenizer={version}")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return None
    found = spark.read.schema("digest binary, n_tokens long").parquet(f"{cache}/tokenizer={version}/run=*")
    if len(store.listStatus(path)) > 1 and not found.groupBy("digest").count().where("count > 1").isEmpty():
        found = durable(found.dropDuplicates(["digest"]))
    return found


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): a row per row of docs.

    `cache` is a folder that all executors reach; without it the counts live for this run only.
    Runs may share it, also at the same time. Null texts count as empty ones, which have 0 tokens; copies are
    encoded once; rows with equal or null ids stay separate rows; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    cache = cache or scratch_dir(spark, "token-counts")
    with open(tokenizer_path, encoding="utf-8") as file:
        source = file.read()
    version = hashlib.sha256(source.encode()).hexdigest()
    shared = spark.sparkContext.broadcast(source)  # a vocabulary file: a few MB, whatever the input

    rows = docs.count()
    docs = compact(docs, rows)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("digest"))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for i, key in enumerate(batch.column(0).to_pylist()):
                if key not in seen:
                    seen.add(key)
                    rows.append(i)
            yield batch.take(pa.array(rows, pa.int32()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in once(batches):
            count = count or encoder(shared.value)
            counts = [count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    texts = docs.select(digest.alias("digest"), text.alias("text"))
    known = _known(spark, cache, version)
    if known is not None:
        texts = texts.join(known, "digest", "left_anti")
    # Copies go before the shuffle, one a task, so that a text with many copies is no hot key after it.
    fresh = texts.mapInArrow(once, "digest binary, text string").repartition("digest").mapInArrow(encode, "digest binary, n_tokens long")
    compact(fresh, rows).write.parquet(f"{cache}/tokenizer={version}/run={uuid.uuid4().hex}")
    counts = _known(spark, cache, version)
    return compact(narrow.join(counts, "digest"), rows, FILE_ROWS).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
