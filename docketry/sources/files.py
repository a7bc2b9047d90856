"""Files to located lines: format dispatch, text, mail, archives, office packages, repositories, media."""

from __future__ import annotations

import email
import email.policy
import io
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from urllib.parse import quote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions.text import source_id
from docketry.session import ship

# Fixed values.
TEXT_BYTES, CONTAINER_BYTES, PART_BYTES, PARTS, OFFICE_BYTES, CELLS, SHEETS = 32 << 20, 8 << 20, 1 << 20, 256, 32 << 20, 100_000, 100
PROJECTION_BYTES, MAIL_LINES, SEGMENT_MS, FRAME_MS = 2 << 20, 10_000, 30_000, 3_000
ARCHIVE_TEXT = ("txt", "md", "csv", "tsv", "json", "jsonl", "xml", "yaml", "yml", "toml", "html", "htm", "log")
STRUCTURED = ("docx", "pptx", "xlsx", "pdf", "eml", "zip", "jpg", "jpeg", "png", "heic", "tif", "tiff", "webp")
TEXT = ("txt", "md", "csv", "tsv", "xml", "yaml", "yml", "toml", "log", "py", "rs", "ts", "js", "c", "h", "java", "go", "sql", "sh", "html", "htm")


def route(name: Column) -> Column:
    """structured, conversation, text or unsupported, by a file's extension."""
    ending = F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))
    return F.when(ending.isin(*STRUCTURED), "structured").when(ending.isin("json", "jsonl"), "conversation").when(ending.isin(*TEXT), "text").otherwise("unsupported")


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, format, content, source_id, modified): every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    ending = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    identity = F.concat(F.lit("source-"), F.sha2(F.concat(ending, F.char(F.lit(0)), F.sha2("content", 256)).cast("binary"), 256))
    return files.select("path", ending.alias("format"), "content", identity.alias("source_id"), F.col("modificationTime").alias("modified"))


def repository(files: DataFrame, root: str) -> DataFrame:
    """Repository files by relative path; version control data is excluded, with the reason."""
    relative = F.regexp_replace("path", f"^.*?{re.escape(root.rstrip('/'))}/", "")
    reason = F.when(relative.rlike(r"(^|/)\.git(/|$)"), "version control data").when(F.octet_length("content") > TEXT_BYTES, "too large")
    return files.select(relative.alias("relative_path"), "format", "content", F.sha2(F.concat(F.lit(root), F.char(F.lit(0)), relative, F.char(F.lit(0)), F.col("source_id")).cast("binary"), 256).alias("scoped_id"), reason.alias("excluded"))


def texts(files: DataFrame) -> DataFrame:
    """(path, source_id, text, problem): UTF-8 text files in full; others say why not."""
    decoded = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    problem = F.when(F.octet_length("content") > TEXT_BYTES, "too large").when(decoded.isNull(), "not UTF-8").when(decoded.rlike("[\\x00-\\x08\\x0E-\\x1F]"), "binary control characters")
    return files.select("path", source_id(F.col("format"), F.col("content")).alias("source_id"), F.when(problem.isNull(), decoded).alias("text"), problem.alias("problem"))


# ---- mail, archives, office: one line per located piece ----------------------------------

Line = tuple[str, str, str]  # locator, channel, text


def mail_lines(data: bytes) -> tuple[list[Line], list[str]]:
    """Headers, then text/plain parts that are no attachments, in depth-first part order."""
    if len(data) > CONTAINER_BYTES:
        return [], ["the message is too large"]
    message = email.message_from_bytes(data, policy=email.policy.default)
    out: list[Line] = [(f"header {h}", "header", " ".join(str(message[h]).split())) for h in ("From", "To", "Cc", "Date", "Subject") if message[h]]
    gaps: list[str] = []
    number = 0

    def walk(part, name: str) -> None:
        nonlocal number
        number += 1
        if number > PARTS:
            if number == PARTS + 1:
                gaps.append("further parts are not read")
            return
        if part.is_multipart():
            for i, below in enumerate(part.iter_parts() if hasattr(part, "iter_parts") else part.get_payload(), 1):
                walk(below, f"{name}.{i}" if name else str(i))
        elif part.get_content_disposition() == "attachment" or part.get_content_type() != "text/plain":
            gaps.append(f"part {name or '1'} is not read")
        else:
            raw = part.get_payload(decode=True) or b""
            if len(raw) > PART_BYTES:
                gaps.append(f"part {name or '1'} is too large")
                return
            try:
                body = raw.decode(part.get_content_charset() or "utf-8")
            except (UnicodeDecodeError, LookupError):
                gaps.append(f"part {name or '1'} is not readable")
                return
            out.extend((f"part {name or '1'} line {i}", "body", line) for i, line in enumerate(body.splitlines(), 1) if line.strip())

    walk(message, "")
    if len(out) > MAIL_LINES:
        gaps.append("further lines are not read")
    return out[:MAIL_LINES], gaps


def safe_member(name: str) -> bool:
    return bool(name) and not name.startswith(("/", "\\")) and ":" not in name and "\\" not in name and ".." not in name.split("/")


def archive_lines(data: bytes) -> tuple[list[Line], list[str]]:
    """Lines of an archive's text members; unsafe, large and other members are gaps."""
    if len(data) > CONTAINER_BYTES:
        return [], ["the archive is too large"]
    out, gaps, expanded = [], [], 0
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return [], ["the archive is not readable"]
    members = archive.infolist()
    if len(members) > PARTS:
        gaps.append("further members are not read")
    for info in members[:PARTS]:
        name = info.filename
        if info.is_dir():
            continue
        if not safe_member(name) or info.flag_bits & 1 or name.rpartition(".")[2].lower() not in ARCHIVE_TEXT or info.file_size > PART_BYTES or expanded + info.file_size > CONTAINER_BYTES:
            gaps.append(f"member {quote(name, safe='')} is not read")
            continue
        expanded += info.file_size
        try:
            body = archive.read(info).decode("utf-8")
        except (UnicodeDecodeError, zipfile.BadZipFile, RuntimeError):
            gaps.append(f"member {quote(name, safe='')} is not readable")
            continue
        out.extend((f"member {quote(name, safe='')} line {i}", "member", line) for i, line in enumerate(body.splitlines(), 1) if line.strip())
    return out, gaps


#: Of a zip archive's member: its name, and its flags, method, crc, packed and whole size, and place.
Member = tuple[str, bytes, int, int, int, int, int, int]
_ENTRY, _LOCAL, _END = struct.Struct("<4sBBBBHHIIIIHHHHHII"), struct.Struct("<4s22xHH"), struct.Struct("<4s8xIIH")


def _members(data: bytes) -> list[Member] | None:
    """A zip archive's members from its bytes, if all of its directory is plain; None leaves it to zipfile."""
    end = len(data) - _END.size
    if end < 0:
        return None
    mark, size, at, comment = _END.unpack_from(data, end)
    if mark != b"PK\x05\x06" or comment or at + size != end or data[end - 20 : end - 16] == b"PK\x06\x07":
        return None
    found = []
    while at < end:
        if at + _ENTRY.size > end:
            return None
        mark, _, _, version, _, flags, method, _, crc, packed, whole, length, extra, comment, *_, place = _ENTRY.unpack_from(data, at)
        key = data[at + _ENTRY.size : at + _ENTRY.size + length]
        if mark != b"PK\x01\x02" or version > 45 or extra or 0 in key or not key.isascii() and not flags & 0x800:
            return None
        try:
            found.append((key.decode(), key, flags, method, crc, packed, whole, place))
        except UnicodeDecodeError:
            return None
        at += _ENTRY.size + length + comment
    return found if at == end else None


def _member(data: bytes, archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> bytes:
    """archive.read(info), of the archive's own bytes: plain members in one step, all that is odd about others left to the archive."""
    key = info.orig_filename.encode("utf-8" if info.flag_bits & 0x800 else "cp437", "replace")
    packed = _packed(data, (info.filename, key, info.flag_bits, info.compress_type, info.CRC, info.compress_size, info.file_size, info.header_offset))
    raw = None if packed is None else _unpacked(packed, info.compress_type, info.CRC, info.file_size)
    return archive.read(info) if raw is None else raw


def _packed(data: bytes, member: Member) -> bytes | None:
    """A plain member's packed bytes; None leaves it to zipfile."""
    _, key, flags, method, _, packed, _, at = member
    if at + _LOCAL.size > len(data) or flags & ~0x80E or method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        return None
    mark, length, extra = _LOCAL.unpack_from(data, at)
    start = at + _LOCAL.size + length + extra
    return data[start : start + packed] if mark == b"PK\x03\x04" and data[at + _LOCAL.size : at + _LOCAL.size + length] == key else None


def _unpacked(packed: bytes, method: int, crc: int, whole: int) -> bytes | None:
    """A member's bytes, or None if they are not those that its entry tells of."""
    if method == zipfile.ZIP_DEFLATED:
        try:
            packed = zlib.decompressobj(-15).decompress(packed, whole + 1)
        except zlib.error:
            return None
    return packed if len(packed) == whole and zlib.crc32(packed) == crc else None


def _xml(raw: bytes) -> ElementTree.Element | str:
    """An XML part, its tags without namespaces, or why there is none."""
    if b"<!DOCTYPE" in raw:
        return "declares entities"
    try:
        parser = ElementTree.XMLParser()
        parser.feed(raw)
        root = parser.close()
    except ElementTree.ParseError:
        return "is not readable"
    for node in root.iter():
        if "}" in node.tag:
            node.tag = node.tag.rpartition("}")[2]
    return root


#: Parts of at most so many packed and whole bytes are kept, the last so many, since packages of one maker share most of theirs.
SMALL_PACKED, SMALL_PART, KEPT_PARTS = 1 << 10, 1 << 13, 64


@lru_cache(KEPT_PARTS)
def _small_part(packed: bytes, method: int, crc: int, whole: int) -> ElementTree.Element | str | None:
    """_xml() of a member; nobody changes it."""
    raw = _unpacked(packed, method, crc, whole)
    return None if raw is None else _xml(raw)


def _part(data: bytes, member: Member) -> ElementTree.Element | str | None:
    packed = _packed(data, member)
    if packed is None:
        return None
    if len(packed) <= SMALL_PACKED and member[6] <= SMALL_PART:
        return _small_part(packed, member[3], member[4], member[6])
    raw = _unpacked(packed, member[3], member[4], member[6])
    return None if raw is None else _xml(raw)


def _parts(data: bytes) -> tuple[dict[str, ElementTree.Element], list[str]]:
    """XML parts of an office package by name, their tags without namespaces. Encrypted, unsafe or duplicate parts are gaps.

    Plain archives and members are read from their bytes, all that is odd about others is left to zipfile.
    """
    gaps: list[str] = []
    if len(data) > OFFICE_BYTES:
        return {}, ["the package is too large"]
    if data[:4] == b"\xd0\xcf\x11\xe0":
        return {}, ["the package is encrypted"]
    archive, members = None, _members(data)
    if members is None:
        try:
            archive = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile:
            return {}, ["the package is not readable"]
    found: dict[str, ElementTree.Element] = {}
    for n, name in enumerate([m[0] for m in members] if archive is None else archive.namelist()):
        if not safe_member(name) or name in found:
            gaps.append(f"part {name} is unsafe or repeated")
        elif name.startswith(("word/embeddings/", "ppt/embeddings/", "xl/embeddings/")):
            gaps.append(f"embedded object {name} is not read")
        elif name.endswith((".xml", ".rels")):
            part = _part(data, members[n]) if members is not None else None
            if part is None:
                archive = archive or zipfile.ZipFile(io.BytesIO(data))
                part = _xml(_member(data, archive, archive.infolist()[n]))
            if isinstance(part, str):
                gaps.append(f"part {name} {part}")
            else:
                found[name] = part
    return found, gaps


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _find(node: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return list(node.iter(name))


def _text(node: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in node.iter("t"))


def _relations(parts: dict, part: str) -> dict[str, tuple[str, bool]]:
    folder, _, file = part.rpartition("/")
    rels = parts.get(f"{folder}/_rels/{file}.rels")
    return {} if rels is None else {r.get("Id"): (r.get("Target", ""), r.get("TargetMode") == "External") for r in rels}


def sheet_lines(data: bytes) -> tuple[list[Line], list[str]]:
    """Every cell with a value. Formulas give their cached value on a channel of its own."""
    parts, gaps = _parts(data)
    book = parts.get("xl/workbook.xml")
    if book is None:
        return [], gaps or ["there is no workbook"]
    shared = [_text(s) for s in _find(parts["xl/sharedStrings.xml"], "si")] if "xl/sharedStrings.xml" in parts else []
    relations, out = _relations(parts, "xl/workbook.xml"), []
    for n, sheet in enumerate(_find(book, "sheet")):
        key = next((v for k, v in sheet.attrib.items() if _name(k) == "id"), "")
        part = parts.get("xl/" + relations.get(key, ("", False))[0].removeprefix("/xl/"))
        if n >= SHEETS or part is None:
            gaps.append(f"sheet {sheet.get('name')} is not read")
            continue
        title = sheet.get("name")
        for cell in part.iter("c"):
            held, kind = cell.find("v"), cell.get("t")
            value = None if held is None else held.text
            try:
                text = shared[int(value)] if kind == "s" and value else _text(cell) if kind == "inlineStr" else ("TRUE" if value == "1" else "FALSE") if kind == "b" else value
            except (ValueError, IndexError):
                gaps.append(f"cell {cell.get('r')} of {title} is not readable")
                continue
            if text:
                if len(out) >= CELLS:
                    gaps.append("further cells are not read")
                    return out, gaps
                out.append((f'sheet "{title}" cell {cell.get("r")}', "cell" if cell.find("f") is None else "cached_formula_value", text))
    return out, [*gaps, "charts, comments and formats are not read"]


def document_lines(data: bytes) -> tuple[list[Line], list[str]]:
    """Paragraphs and headings in order, table rows paired with the table's first row, and links."""
    parts, gaps = _parts(data)
    main = parts.get("word/document.xml")
    if main is None:
        return [], gaps or ["there is no document"]
    relations, out, tables, paragraphs = _relations(parts, "word/document.xml"), [], 0, 0
    body = next(iter(_find(main, "body")), main)
    for block in body:
        if block.tag == "p":
            paragraphs += 1
            text = _text(block).strip()
            style = next((v for s in _find(block, "pStyle") for k, v in s.attrib.items() if _name(k) == "val"), "")
            if text:
                out.append((f"paragraph {paragraphs}", "heading" if style.lower().startswith(("title", "heading")) else "paragraph", text))
            for link in _find(block, "hyperlink"):
                target, external = relations.get(next((v for k, v in link.attrib.items() if _name(k) == "id"), ""), ("", False))
                if external:
                    out.append((f"paragraph {paragraphs}", "reference", f"{_text(link)} ({target})"))
        elif block.tag == "tbl":
            tables += 1
            rows = [[_text(c).strip() for c in r if c.tag == "tc"] for r in block if r.tag == "tr"]
            for n, row in enumerate(rows[1:], 2):
                out.append((f"table {tables} row {n}", "table", "; ".join(f"{h}: {c}" for h, c in zip(rows[0], row, strict=False))))
    return out, gaps


def slide_lines(data: bytes) -> tuple[list[Line], list[str]]:
    """Slide text, slide tables and speaker notes, each on its channel."""
    parts, gaps = _parts(data)
    slides = sorted((p for p in parts if re.fullmatch(r"ppt/slides/slide\d+\.xml", p)), key=lambda p: int(re.search(r"\d+", p)[0]))
    out: list[Line] = []
    for n, name in enumerate(slides, 1):
        held = {id(p) for table in _find(parts[name], "tbl") for p in _find(table, "p")}
        out += [(f"slide {n}", "slide_text", t) for p in _find(parts[name], "p") if id(p) not in held and (t := _text(p).strip())]
        for k, table in enumerate(_find(parts[name], "tbl"), 1):
            out += [(f"slide {n} table {k} row {i}", "slide_table", "; ".join(_text(c).strip() for c in _find(row, "tc"))) for i, row in enumerate(_find(table, "tr"), 1)]
        for target, _ in _relations(parts, name).values():
            if "notesSlide" in target:
                notes = parts.get("ppt/notesSlides/" + target.rpartition("/")[2])
                if notes is None:
                    gaps.append(f"notes of slide {n} are missing")
                else:
                    out += [(f"slide {n}", "speaker_notes", t) for p in _find(notes, "p") if (t := _text(p).strip())]
    return out, gaps if slides else gaps or ["there are no slides"]


#: The columns of lines(), and the rows that are handed on at once.
LINE, OUT_ROWS = ["path", "position", "locator", "channel", "text", "gap"], 4096
READERS = {"eml": mail_lines, "zip": archive_lines, "xlsx": sheet_lines, "docx": document_lines, "pptx": slide_lines}


File = tuple[str, str, bytes | None]  # path, format, content


def _files(batch: pd.DataFrame) -> Iterable[File]:
    return zip(batch["path"], batch["format"], batch["content"], strict=True)


def lines(files: DataFrame, made: Callable[[pd.DataFrame], Iterable[File]] | None = None) -> DataFrame:
    """(path, position, locator, channel, text, gap) of structured files (path, format, content).

    A file's text is cut at PROJECTION_BYTES with a gap; gaps are rows without text. Rows of small files leave together.
    With `made`, `files` are rows of any columns of which it makes the files, one at a time: each is read where it is made.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held = [], 0
        for batch in batches:
            for path, kind, data in (made or _files)(batch):
                if kind not in READERS:
                    continue
                found, gaps = READERS[kind](bytes(data or b""))
                rows, size = [], 0
                for n, (locator, channel, text) in enumerate(found, 1):
                    size += len(text.encode()) + 1
                    if size > PROJECTION_BYTES:
                        gaps = [*gaps, "further text is not projected"]
                        break
                    rows.append((path, n, locator, channel, text, None))
                rows += [(path, len(rows) + n, None, "gap", None, g) for n, g in enumerate(gaps if found else [*gaps, "there is no text"], 1)]
                out.extend(rows)
                held += size
                if len(out) >= OUT_ROWS or held >= PROJECTION_BYTES:
                    yield pd.DataFrame(out, columns=LINE)
                    out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=LINE)

    spark = files.sparkSession
    ship(spark)
    kept = files if made else files.where(F.col("format").isin(*READERS)).select("path", "format", "content")
    return kept.mapInPandas(each, "path string, position int, locator string, channel string, text string, gap string")


# ---- helper output as tables -------------------------------------------------------------


def regions(helper: DataFrame) -> DataFrame:
    """(path, page, channel, text, qualifier) from a PDF or photo helper's JSON (path, body): recognised text is qualified, the rest is not."""
    schema = "struct<regions:array<struct<page:int,text:string,channel:string,box:array<double>,column:int,confidence:double,revision:string>>>"
    rows = helper.select("path", F.posexplode(F.from_json("body", schema)["regions"]).alias("at", "r"))
    qualifier = F.when(F.col("r.channel") == "ocr", F.concat(F.lit("recognised text, confidence "), F.format_number(F.coalesce("r.confidence", F.lit(0.0)), 2)))
    return rows.select("path", "r.page", (F.col("at") + 1).alias("position"), "r.channel", "r.text", "r.column", qualifier.alias("qualifier"))


def segments(media: DataFrame) -> DataFrame:
    """(path, start, end): spans of at most SEGMENT_MS that cover media (path, duration_ms)."""
    starts = media.where("duration_ms > 0").select("path", "duration_ms", F.explode(F.sequence(F.lit(0).cast("long"), F.col("duration_ms").cast("long") - 1, F.lit(SEGMENT_MS).cast("long"))).alias("start"))
    return starts.select("path", "start", F.least(F.col("start") + SEGMENT_MS, F.col("duration_ms")).alias("end"))


def frames(media: DataFrame) -> DataFrame:
    """(path, at): one frame each FRAME_MS."""
    return media.where("duration_ms > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("duration_ms").cast("long") - 1, F.lit(FRAME_MS).cast("long"))).alias("at"))


def gaps_in(spans: DataFrame, media: DataFrame) -> DataFrame:
    """(path, start, end): what no span (path, start, end) of media (path, duration_ms) covers."""
    ends = media.select("path", F.col("duration_ms").cast("long").alias("start"), F.col("duration_ms").cast("long").alias("end"))
    before = F.max("end").over(Window.partitionBy("path").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.select("path", "start", "end").unionByName(ends).withColumn("through", F.coalesce(before, F.lit(0).cast("long")))
    return rows.where("through < start").select("path", F.col("through").alias("start"), F.col("start").alias("end"))


def at_moment(spans: DataFrame, moments: DataFrame) -> DataFrame:
    """(path, at, start, end): for each moment (path, at) the first span whose closed interval holds it.

    Spans are at most SEGMENT_MS long, so both sides meet on (path, bucket): a span is in two buckets at most.
    """
    buckets = spans.select("path", "start", "end", F.explode(F.array_distinct(F.array(F.floor(F.col("start") / SEGMENT_MS), F.floor(F.col("end") / SEGMENT_MS)))).alias("bucket"))
    pairs = moments.withColumn("bucket", F.floor(F.col("at") / SEGMENT_MS)).join(buckets, ["path", "bucket"]).where("start <= at AND at <= end")
    return pairs.groupBy("path", "at").agg(F.min(F.struct("start", "end")).alias("s")).select("path", "at", "s.*")


def part_stream(records: DataFrame) -> DataFrame:
    """(part_id, complete, bytes): decoded records (part_id, start, end, is_end, total) must be contiguous and end at the announced length."""
    from docketry.operators.evidence import contiguous

    ends = records.groupBy("part_id").agg(F.max("end").alias("bytes"), F.max(F.when(F.col("is_end"), F.col("total"))).alias("total"))
    return contiguous(records.where(~F.col("is_end"))).join(ends, "part_id").select("part_id", (F.col("complete") & (F.col("bytes") == F.col("total"))).alias("complete"), "bytes")


def publish(frame: DataFrame, folder: str) -> None:
    """Write a new version below the folder, then let its pointer name it.

    Replacing the pointer is one atomic step, so published() reads the old version or the new one
    at any time. Writers share no names; the last one to point wins. Older versions stay.
    """
    spark, version = frame.sparkSession, uuid.uuid4().hex
    frame.write.parquet(f"{folder}/version={version}")
    hadoop, jvm = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs
    staged, pointer = jvm.Path(f"{folder}/_{version}"), jvm.Path(f"{folder}/_current")
    out = staged.getFileSystem(hadoop).create(staged, True)
    out.write(bytearray(version.encode()))
    out.close()
    files = jvm.FileContext.getFileContext(staged.getFileSystem(hadoop).getUri(), hadoop)
    over = spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 1)
    over[0] = getattr(jvm, "Options$Rename").OVERWRITE
    files.rename(files.makeQualified(staged), files.makeQualified(pointer), over)


def published(spark: SparkSession, folder: str) -> DataFrame:
    """The version that the folder's pointer names."""
    pointer = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_current")
    read = pointer.getFileSystem(spark._jsc.hadoopConfiguration()).open(pointer)
    version = bytes(read.readNBytes(64)).decode()
    read.close()
    return spark.read.parquet(f"{folder}/version={version}")
