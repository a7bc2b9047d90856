"""WARC archives with a two-level capture index.

Writing: tasks append records, one gzip member each, to archive files of their own and return a
capture row per record. Index: captures sorted by reversed-host URL key go into compressed blocks;
each sorted run of blocks has a directory, a line per block, and a root names the directories.
Looking up a key: the root is bisected for the directories whose key range holds it, a directory
is fetched by a range read and bisected for blocks, a block is fetched by a range read and
bisected for captures, and each record is fetched by a range read. A retried task writes new files
and returns new rows, which a checkpoint fixes; files of lost attempts are referred to by nothing.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, qualified, scratch_dir, small_batches, tasks

CRLF = b"\r\n"
#: An archive file is closed once it has so many bytes; an index block has so many captures at most.
ARCHIVE_BYTES = 256 << 20
BLOCK_CAPTURES = 2000
#: Bytes fetched at once when archives are read in order.
READ_BYTES = 4 << 20
#: What makes a task of its own: payload bytes to write, captures to index, keys to look up, archive bytes to read.
WRITE_TASK, INDEX_TASK, KEY_TASK, READ_TASK = 4 << 20, 8000, 50_000, 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_TABS = re.compile(r"[\x00-\x20\x7f]")

CAPTURE = "key string, page_id long, file string, at long, length long"
ROOT = "first_key string, last_key string, file string, at long, length long, blocks long, captures long"
OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """The URL without scheme and fragment, its host's labels reversed: com,example,www)/path?query.

    Null gives the empty key; an unreadable URL keeps its text.
    """
    if not url:
        return ""
    clean = _TABS.sub(lambda m: quote(m[0]), url.strip())
    try:
        parts = urlsplit(clean if "//" in clean else f"//{clean}")
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return clean
    kept = f":{port}" if port and port not in (80, 443) else ""
    return ",".join(reversed(host.split("."))) + kept + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A WARC/1.1 record: a response with the payload, or a revisit without it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_record_id(page_id)}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {_TABS.sub(lambda m: quote(m[0]), url) if url else 'about:blank'}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_record_id(refers_to)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + CRLF * 2 + block + CRLF * 2


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes

    @property
    def page_id(self) -> int | None:
        return _number(self.headers["warc-record-id"])

    @property
    def refers_to(self) -> int | None:
        return _number(self.headers["warc-refers-to"]) if "warc-refers-to" in self.headers else None


def _number(urn: str) -> int | None:
    tail = urn.strip("<>").rpartition(":")[2]
    return None if tail == "null" else int(tail)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in head.split(CRLF)[1:])
    return {k.strip().lower().decode(): v.strip().decode() for k, _, v in pairs}


def parse(raw: bytes) -> Record:
    """A record from its gzip member; a payload that contradicts its digest is an error."""
    data = gzip.decompress(raw)
    head, _, rest = data.partition(CRLF * 2)
    headers = _fields(head)
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(CRLF * 2)
    if headers["warc-type"] == "response" and headers["warc-payload-digest"] != f"sha1:{payload_digest(payload)}":
        raise ValueError(f"payload of {headers['warc-record-id']} does not have its digest")
    return Record(headers, _fields(http), payload)


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that `qualified` made."""
    scheme, _, rest = folder.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"s3:{rest}" if scheme in ("s3a", "s3n") else folder)


class _Writer:
    """Appends byte strings to files below a folder; a new file once one is full."""

    def __init__(self, folder: str, ending: str, first: bytes = b"", limit: int = ARCHIVE_BYTES) -> None:
        self.store, self.folder = _store(folder)
        self.store.create_dir(self.folder, recursive=True)
        self.ending, self.first, self.limit, self.out = ending, first, limit, None

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at >= self.limit:
            self.close()
            self.name = f"{uuid.uuid4().hex}{self.ending}"
            self.out, self.at = self.store.open_output_stream(f"{self.folder}/{self.name}", compression=None), 0
            if self.first:
                self.out.write(self.first)
                self.at = len(self.first)
        self.out.write(data)
        self.at += len(data)
        return self.name, self.at - len(data), len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


class _Ranges:
    """Range reads; those that follow each other in a file share one fetch."""

    def __init__(self, folder: str) -> None:
        self.store, self.folder = _store(folder)
        self.name, self.file, self.start, self.held = None, None, 0, b""

    def read(self, name: str, at: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            self.file, self.name, self.held = self.store.open_input_file(f"{self.folder}/{name}"), name, b""
        if not self.start <= at <= at + length <= self.start + len(self.held):
            self.file.seek(at)
            self.start, self.held = at, self.file.read(max(length, READ_BYTES))
        return self.held[at - self.start : at - self.start + length]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def write(pages: DataFrame, folder: str, minimum: int = 0, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archive every row of pages below `folder`/warc; returns the captures (CAPTURE), written once.

    Of rows whose payloads are equal and have at least `minimum` bytes, that with the smallest
    page_id is the response and the others revisit it. Null html is an empty payload. Rows that
    repeat both page_id and payload are all responses; a null page_id revisits any row that has
    one. Null URLs have the empty key. An empty table has no captures.

    What repeats is worked out on ids and digests; payloads move once, dealt by both, so that a
    payload with very many pages is no hot key.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = qualified(spark, folder)
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("html"), F.unhex(F.sha2(payload.cast("binary"), 256)).alias("same"))
    each_id = durable(rows.select("page_id", "same", F.octet_length("html").cast("long").alias("bytes")).groupBy("same", "page_id").agg(F.first("bytes").alias("bytes"), F.count("*").alias("n")), pages.count())
    size = each_id.agg(F.sum(F.col("bytes") * F.col("n")).alias("bytes"), F.count("*").alias("rows")).first()
    firsts = each_id.where(F.col("bytes") >= minimum).groupBy("same").agg(F.min("page_id").alias("first"), F.sum("n").alias("n")).where("n > 1")
    marks = each_id.join(durable(firsts.select("same", "first"), size["rows"]), "same").select(F.col("page_id").alias("p"), F.col("same").alias("s"), "first")
    marked = rows.join(marks, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("same") == F.col("s")), "left")
    marked = marked.select("page_id", "url", "html", F.expr("first IS NOT NULL AND NOT first <=> page_id").alias("revisit"), "first").coalesce(tasks(spark, size["bytes"] or 0, WRITE_TASK))
    info = gzip.compress(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:docketry:info>\r\nWARC-Date: %b\r\nContent-Type: application/warc-fields\r\nContent-Length: 18\r\n\r\nsoftware: docketry\r\n\r\n" % date.encode(), 6, mtime=0)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(f"{folder}/warc", ".warc.gz", info)
        for batch in batches:
            found = []
            for page_id, url, html, revisit, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = gzip.compress(record(page_id, url, html.encode(), first, revisit, date), 4, mtime=0)
                found.append((url_key(url), page_id, *out.add(data)))
            yield _batch(found, CAPTURE)
        out.close()

    return durable(marked.mapInArrow(each, CAPTURE))


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.strip().split() for f in schema.split(",")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def _packed(lines: list[str]) -> bytes:
    return zlib.compress("\n".join(lines).encode())


def _unpacked(data: bytes) -> list[list[str]]:
    return [line.split("\t") for line in zlib.decompress(data).decode().split("\n")]


def build_index(captures: DataFrame, folder: str, block: int = BLOCK_CAPTURES) -> DataFrame:
    """Sort captures by key into compressed blocks and directories below `folder`/index; returns the root (ROOT), written once.

    Captures are dealt by ranges of (key, page_id, file, at), so one host or one URL with a third
    of all captures spreads over many tasks. A line of a block is: key, page_id, file, at, length;
    of a directory: first key, last key, file, at, length. The root has a row per range.
    """
    spark = captures.sparkSession
    small_batches(spark)
    folder = qualified(spark, folder)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, run, done = _Writer(f"{folder}/index", ".cdx.z"), None, []
        lines, keys, directory, captured = [], [], [], 0

        def end_block() -> None:
            file, at, length = out.add(_packed(lines))
            directory.append(f"{keys[0]}\t{keys[-1]}\t{file}\t{at}\t{length}")
            lines.clear(), keys.clear()

        def end_run() -> None:
            if lines:
                end_block()
            if directory:
                done.append((directory[0].split("\t")[0], directory[-1].split("\t")[1], *out.add(_packed(directory)), len(directory), captured))
            directory.clear()

        for batch in batches:
            for key, page_id, file, at, length, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != run:
                    end_run()
                    run, captured = part, 0
                lines.append(f"{key}\t{'' if page_id is None else page_id}\t{file}\t{at}\t{length}")
                keys.append(key)
                captured += 1
                if len(lines) == block:
                    end_block()
        end_run()
        out.close()
        yield _batch(done, ROOT)

    by = ["key", "page_id", "file", "at"]
    n = tasks(spark, captures.count(), INDEX_TASK)
    # A task may take several ranges; a run ends with its range.
    ranges = captures.repartitionByRange(n, *by).sortWithinPartitions(*by).select("key", "page_id", "file", "at", "length", F.spark_partition_id().alias("part"))
    return durable(ranges.coalesce(n).mapInArrow(each, ROOT))


class Directory:
    """Finds the index blocks that hold a key."""

    def __init__(self, folder: str, root: list[tuple[str, str, str, int, int]]) -> None:
        self.index, self.root = _Ranges(f"{folder}/index"), sorted(root)
        self.first, self.last = [r[0] for r in self.root], [r[1] for r in self.root]
        self.lines = lru_cache(8)(self._lines)

    def _lines(self, n: int) -> tuple[list[str], list[str], list[list[str]]]:
        lines = _unpacked(self.index.read(*self.root[n][2:]))
        return [x[0] for x in lines], [x[1] for x in lines], lines

    def blocks(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(file, at, length), by bisection of the root and of each directory whose range holds the key."""
        for n in range(bisect.bisect_left(self.last, key), bisect.bisect_right(self.first, key)):
            first, last, lines = self.lines(n)
            for line in lines[bisect.bisect_left(last, key) : bisect.bisect_right(first, key)]:
                yield line[2], int(line[3]), int(line[4])


def captures_of(block: list[list[str]], keys: list[str], key: str) -> list[tuple[str, int, int]]:
    """(file, at, length) of a block's captures of a key, by bisection."""
    found = block[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]
    return [(x[2], int(x[3]), int(x[4])) for x in found]


def lookup(root: DataFrame, folder: str, keys: DataFrame) -> DataFrame:
    """(key, page_id, payload_bytes, payload_digest, record_type, refers_to) of all records of the URL keys in `keys` (key).

    Repeated keys are looked up once, keys without captures give no rows. A key's blocks are dealt
    to tasks one by one, and so are the archives' stretches: a key with a third of all captures
    spreads like any other. The root's rows, one per range of the index, are all that is broadcast.
    """
    spark = root.sparkSession
    small_batches(spark)
    folder = qualified(spark, folder)
    size = root.agg(F.sum("captures")).first()[0] or 0
    known = spark.sparkContext.broadcast([tuple(r) for r in root.select("first_key", "last_key", "file", "at", "length").collect()])
    where, capture = "key string, file string, at long, length long", "key string, file string, at long, length long"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory = Directory(folder, known.value)
        for batch in batches:
            rows: list[tuple] = []
            for key in batch.column(0).to_pylist():
                for found in directory.blocks(key):
                    rows.append((key, *found))
                    if len(rows) >= 10_000:
                        yield _batch(rows, where)
                        rows = []
            yield _batch(rows, where)
        directory.index.close()

    def captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, last, block, of_block = _Ranges(f"{folder}/index"), None, [], []
        for batch in batches:
            rows = []
            for key, *place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != last:
                    block, last = _unpacked(index.read(*place)), place
                    of_block = [x[0] for x in block]
                rows += [(key, *found) for found in captures_of(block, of_block, key)]
            yield _batch(rows, capture)
        index.close()

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = _Ranges(f"{folder}/warc")
        for batch in batches:
            rows = []
            for key, file, at, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                r = parse(archive.read(file, at, length))
                rows.append((key, r.page_id, int(r.http["content-length"]), r.headers["warc-payload-digest"].removeprefix("sha1:"), r.headers["warc-type"], r.refers_to))
            yield _batch(rows, f"key string, {OUT}")
        archive.close()

    asked = keys.select("key").where("key IS NOT NULL").distinct().repartitionByRange("key").sortWithinPartitions("key")
    found = asked.mapInArrow(blocks, where).repartition("file", "at").sortWithinPartitions("file", "at", "key").coalesce(tasks(spark, size, KEY_TASK))
    named = durable(found.mapInArrow(captures, capture))
    n = tasks(spark, named.agg(F.sum("length")).first()[0] or 0, READ_TASK)
    return named.repartitionByRange(n, "file", "at").sortWithinPartitions("file", "at").coalesce(n).mapInArrow(records, f"key string, {OUT}")


def url_keys(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """(key): a row per row of pages."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([(url_key(u),) for u in batch.column(0).to_pylist()], "key string")

    small_batches(pages.sparkSession)
    return pages.select(F.col(url_col).cast("string")).mapInArrow(each, "key string")


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages, index the captures, and look every page's URL up: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    folder = folder or scratch_dir(pages.sparkSession, "archive")
    return lookup(build_index(write(pages, folder), folder), folder, url_keys(pages)).drop("key")
