"""Sources read from files, exports, archives and office packages that are made of the tables."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions import text
from docketry.plans.model import Collection
from docketry.plans.queries_formation import _string
from docketry.plans.registry import query
from docketry.session import dealt, ship
from docketry.sources import conversation, files, web

_ENDINGS = ("docx", "PDF", "json", "txt", "rs", "exe", "jpeg", "jsonl")


@query(
    f"""SELECT doc_id, CASE WHEN e IN ('docx', 'PDF', 'jpeg') THEN 'structured' WHEN e IN ('json', 'jsonl') THEN 'conversation' WHEN e IN ('txt', 'rs') THEN 'text' ELSE 'unsupported' END AS route
    FROM (SELECT doc_id, {list(_ENDINGS)}[doc_id % 8 + 1] AS e FROM documents)"""
)
def file_routes(c: Collection) -> DataFrame:
    ending = F.element_at(F.array(*(F.lit(e) for e in _ENDINGS)), (F.col("doc_id") % 8 + 1).cast("int"))
    return c.table("documents").select("doc_id", files.route(F.concat(F.lit("a.b/c."), ending)).alias("route"))


@query(
    """SELECT doc_id::VARCHAR AS path, CASE doc_id % 10 WHEN 1 THEN 'not UTF-8' WHEN 2 THEN 'binary control characters' END AS problem, CASE WHEN doc_id % 10 NOT IN (1, 2) THEN strlen(text) END AS bytes,
    CASE WHEN doc_id % 10 NOT IN (1, 2) THEN 'source-' || sha256('txt' || chr(0) || sha256(text)) END AS source_id FROM documents"""
)
def text_sources(c: Collection) -> DataFrame:
    n, raw = F.col("doc_id") % 10, F.col("text").cast("binary")
    content = F.when(n == 1, F.concat(raw, F.unhex(F.lit("FF")))).when(n == 2, F.concat(raw, F.unhex(F.lit("01")))).otherwise(raw)
    found = files.texts(c.table("documents").select(F.col("doc_id").cast("string").alias("path"), F.lit("txt").alias("format"), content.alias("content")))
    return found.select("path", "problem", F.octet_length("text").cast("long").alias("bytes"), F.when(F.col("problem").isNull(), F.col("source_id")).alias("source_id"))


@query(
    """SELECT CASE WHEN doc_id % 6 = 0 THEN 'src/.git/' || doc_id ELSE 'src/.gitignore/' || doc_id END || '.txt' AS relative_path, CASE WHEN doc_id % 6 = 0 THEN 'version control data' END AS excluded,
    sha256('/repo' || chr(0) || (CASE WHEN doc_id % 6 = 0 THEN 'src/.git/' || doc_id ELSE 'src/.gitignore/' || doc_id END || '.txt') || chr(0) || 'source-' || doc_id) AS scoped_id FROM documents"""
)
def repository_files(c: Collection) -> DataFrame:
    n = F.col("doc_id")
    path = _string("file:/repo/src/", F.when(n % 6 == 0, ".git/").otherwise(".gitignore/"), n, ".txt")
    rows = c.table("documents").select(path.alias("path"), F.lit("txt").alias("format"), F.col("text").cast("binary").alias("content"), _string("source-", n).alias("source_id"))
    return files.repository(rows, "/repo").select("relative_path", "excluded", "scoped_id")


@query(
    r"""WITH d AS (SELECT doc_id, replace(text, chr(13), ' ') AS text FROM documents WHERE text IS NOT NULL),
    b AS (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'n': i, 'x': x})) AS l FROM d)
    SELECT doc_id::VARCHAR AS path, 'header ' || h AS locator, 'header' AS channel, v AS text FROM (SELECT doc_id, unnest(['From', 'To', 'Date', 'Subject']) AS h, unnest(['a' || doc_id || '@x.example', 'b@x.example', 'Fri, 17 May 2024 10:00:00 +0000', 'Note ' || doc_id]) AS v FROM d)
    UNION ALL SELECT doc_id::VARCHAR, 'part 1 line ' || l.n, 'body', l.x FROM b WHERE trim(l.x) <> ''
    UNION ALL SELECT doc_id::VARCHAR, NULL, 'gap', NULL FROM d"""
)
def mail_lines(c: Collection) -> DataFrame:
    """Every document as the plain part of a message, with an attachment that is not read."""
    n = F.col("doc_id")
    head = _string("From: a", n, "@x.example\r\nTo: b@x.example\r\nDate: Fri, 17 May 2024 10:00:00 +0000\r\nSubject: Note\r\n ", n, "\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=qq\r\n\r\n")
    body = F.concat(head, F.lit("--qq\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"), F.replace("text", F.lit("\r"), F.lit(" ")), F.lit("\r\n--qq\r\nContent-Type: text/plain\r\nContent-Disposition: attachment\r\n\r\nx\r\n--qq--\r\n"))
    mails = c.table("documents").where("text IS NOT NULL").select(n.cast("string").alias("path"), F.lit("eml").alias("format"), body.cast("binary").alias("content"))
    return files.lines(mails).select("path", "locator", "channel", "text")


def _packed(name: str, body: str) -> tuple[bytes, bytes, bytes]:
    """What an archive's entry and index say of a deflated part, its name, and the part."""
    key, raw = name.encode(), body.encode()
    # Small parts need no large window, which costs more to set up than they cost to deflate.
    packer = zlib.compressobj(wbits=-15) if len(raw) > 1 << 12 else zlib.compressobj(1, wbits=-9, memLevel=1)
    packed = packer.compress(raw) + packer.flush()
    # Version 2.0, UTF-8 names, deflated, the first of January 1980.
    return struct.pack("<5H3I2H", 20, 0 if key.isascii() else 0x800, 8, 0, 33, zlib.crc32(raw), len(packed), len(raw), len(key), 0), key, packed


#: Parts that many packages share are deflated once.
_packed_once = lru_cache(64)(_packed)


def _package(parts: dict[str, str]) -> bytes:
    """A zip archive of deflated parts."""
    out, index = io.BytesIO(), []
    for name, body in parts.items():
        head, key, packed = (_packed_once if len(body) <= 1 << 12 else _packed)(name, body)
        at = out.tell()
        out.write(b"PK\x03\x04" + head + key + packed)
        index.append(b"PK\x01\x02\x14\x00" + head + struct.pack("<3H2I", 0, 0, 0, 0, at) + key)
    start, held = out.tell(), b"".join(index)
    out.write(held + b"PK\x05\x06" + struct.pack("<4H2IH", 0, 0, len(index), len(index), len(held), start, 0))
    return out.getvalue()


Build = Callable[[int, str, str], dict[str, str]]


def _made(ending: str, build: Build) -> Callable[[pd.DataFrame], Iterator[files.File]]:
    """What makes a package for every customer of a batch."""

    def each(batch: pd.DataFrame) -> Iterator[files.File]:
        for k, n, s in zip(batch["c_custkey"], batch["c_name"], batch["c_mktsegment"], strict=True):
            yield str(k), ending, _package(build(k, n, s))

    return each


def _customers(c: Collection) -> DataFrame:
    ship(c.spark)
    customers = c.table("customer").select("c_custkey", "c_name", "c_mktsegment")
    return dealt(customers, customers.count())


def _packages(c: Collection, ending: str, build: Build) -> DataFrame:
    """(path, format, content): a package for every customer."""
    made = _made(ending, build)

    def each(batches):
        for batch in batches:
            yield pd.DataFrame(list(made(batch)), columns=["path", "format", "content"])

    return _customers(c).mapInPandas(each, "path string, format string, content binary")


def _lines(c: Collection, ending: str, build: Build) -> DataFrame:
    """files.lines() of _packages(), each package read by the Python that makes it."""
    return files.lines(_customers(c), _made(ending, build))


@query(
    """SELECT c_custkey::VARCHAR AS path, locator, text, gap FROM customer, (VALUES ('member a%2Fn%20%C3%A9.txt line 1', 1, NULL), ('member a%2Fn%20%C3%A9.txt line 3', 2, NULL), (NULL, 0, 'member ..%2Fx.txt is not read'), (NULL, 0, 'member b.exe is not read')) v(locator, w, gap_),
    LATERAL (SELECT CASE w WHEN 1 THEN c_name WHEN 2 THEN c_mktsegment END AS text, gap_ AS gap)"""
)
def archive_lines(c: Collection) -> DataFrame:
    found = _lines(c, "zip", lambda k, n, s: {"a/n é.txt": f"{n}\n\n{s}\n", "../x.txt": "no", "b.exe": "no"})
    return found.select("path", "locator", "text", "gap")


_REL = '<Relationships xmlns="r"><Relationship Id="rId1" Target="{0}"{1}/></Relationships>'


def _workbook(k: int, name: str, segment: str) -> dict[str, str]:
    cells = f'<c r="A1" t="s"><v>0</v></c><c r="B1"><v>{k}</v></c><c r="C1"><f>B1*2</f><v>{2 * k}</v></c><c r="D1" t="b"><v>1</v></c><c r="E1" t="inlineStr"><is><t>{segment}</t></is></c><c r="F1"/>'
    return {
        "xl/workbook.xml": '<workbook xmlns:r="x"><sheets><sheet name="Notes" sheetId="1" r:id="rId1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": _REL.format("worksheets/sheet1.xml", ""),
        "xl/sharedStrings.xml": f"<sst><si><t>{name}</t></si></sst>", "xl/worksheets/sheet1.xml": f"<worksheet><sheetData><row>{cells}</row></sheetData></worksheet>",
    }


@query(
    """SELECT c_custkey::VARCHAR AS path, 'sheet "Notes" cell ' || l || '1' AS locator, channel, CASE l WHEN 'A' THEN c_name WHEN 'B' THEN c_custkey::VARCHAR WHEN 'C' THEN (2 * c_custkey)::VARCHAR WHEN 'D' THEN 'TRUE' ELSE c_mktsegment END AS text
    FROM customer, (VALUES ('A', 'cell'), ('B', 'cell'), ('C', 'cached_formula_value'), ('D', 'cell'), ('E', 'cell')) v(l, channel)"""
)
def sheet_cells(c: Collection) -> DataFrame:
    return _lines(c, "xlsx", _workbook).where("gap IS NULL").select("path", "locator", "channel", "text")


def _document(k: int, name: str, segment: str) -> dict[str, str]:
    def paragraph(inner: str) -> str:
        return f"<w:p>{inner}</w:p>"

    def run(words: str) -> str:
        return f"<w:r><w:t>{words}</w:t></w:r>"

    def row(*cells: str) -> str:
        return "<w:tr>" + "".join(f"<w:tc>{paragraph(run(x))}</w:tc>" for x in cells) + "</w:tr>"

    body = paragraph('<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>' + run("About ") + run(name)) + paragraph("") + paragraph(run(segment))
    body += f"<w:tbl>{row('Name', 'Segment')}{row(name, segment)}{row(str(k))}</w:tbl>" + paragraph(run("See ") + '<w:hyperlink r:id="rId1">' + run("here") + "</w:hyperlink>")
    return {"word/document.xml": f'<w:document xmlns:w="w" xmlns:r="x"><w:body>{body}</w:body></w:document>', "word/_rels/document.xml.rels": _REL.format(f"https://x.example/{k}", ' TargetMode="External"')}


@query(
    """SELECT c_custkey::VARCHAR AS path, locator, channel, CASE n WHEN 1 THEN 'About ' || c_name WHEN 2 THEN c_mktsegment WHEN 3 THEN 'Name: ' || c_name || '; Segment: ' || c_mktsegment WHEN 4 THEN 'Name: ' || c_custkey WHEN 5 THEN 'See here' ELSE 'here (https://x.example/' || c_custkey || ')' END AS text
    FROM customer, (VALUES (1, 'paragraph 1', 'heading'), (2, 'paragraph 3', 'paragraph'), (3, 'table 1 row 2', 'table'), (4, 'table 1 row 3', 'table'), (5, 'paragraph 4', 'paragraph'), (6, 'paragraph 4', 'reference')) v(n, locator, channel)"""
)
def document_lines(c: Collection) -> DataFrame:
    return _lines(c, "docx", _document).where("gap IS NULL").select("path", "locator", "channel", "text")


def _slides(k: int, name: str, segment: str) -> dict[str, str]:
    line = "<a:p><a:r><a:t>{}</a:t></a:r></a:p>"
    table = f"<a:tbl><a:tr><a:tc>{line.format(segment)}</a:tc><a:tc>{line.format(k)}</a:tc></a:tr></a:tbl>"
    return {
        "ppt/slides/slide1.xml": f'<p:sld xmlns:p="p" xmlns:a="a">{line.format(name)}{table}</p:sld>', "ppt/slides/slide2.xml": f'<p:sld xmlns:p="p" xmlns:a="a">{line.format("End")}</p:sld>',
        "ppt/slides/_rels/slide1.xml.rels": _REL.format("../notesSlides/notesSlide1.xml", ""), "ppt/notesSlides/notesSlide1.xml": f'<p:notes xmlns:p="p" xmlns:a="a">{line.format("Say " + str(k))}</p:notes>',
    }


@query(
    """SELECT c_custkey::VARCHAR AS path, locator, channel, CASE n WHEN 1 THEN c_name WHEN 2 THEN c_mktsegment || '; ' || c_custkey WHEN 3 THEN 'Say ' || c_custkey ELSE 'End' END AS text
    FROM customer, (VALUES (1, 'slide 1', 'slide_text'), (2, 'slide 1 table 1 row 1', 'slide_table'), (3, 'slide 1', 'speaker_notes'), (4, 'slide 2', 'slide_text')) v(n, locator, channel)"""
)
def slide_lines(c: Collection) -> DataFrame:
    return _lines(c, "pptx", _slides).where("gap IS NULL").select("path", "locator", "channel", "text")


@query("SELECT c_custkey::VARCHAR AS path, CASE c_custkey % 3 WHEN 0 THEN 'part ../x.xml is unsafe or repeated' WHEN 1 THEN 'embedded object word/embeddings/o.bin is not read' ELSE 'part word/document.xml declares entities' END AS gap FROM customer")
def package_gaps(c: Collection) -> DataFrame:
    """Unsafe part names, embedded objects and entity declarations, each told of once."""

    def build(k: int, name: str, segment: str) -> dict[str, str]:
        whole = _document(k, name, segment)
        if k % 3 == 2:
            return {**whole, "word/document.xml": "<!DOCTYPE x>" + whole["word/document.xml"]}
        return {**whole, **({"../x.xml": "<x/>"} if k % 3 == 0 else {"word/embeddings/o.bin": "x"})}

    return _lines(c, "docx", build).where("gap IS NOT NULL AND gap <> 'there is no text'").select("path", "gap")


@query("SELECT c_custkey::VARCHAR AS path, count(*) FILTER (WHERE i * 1001 <= 2097152) AS lines, true AS cut FROM customer, generate_series(1, 2200) t(i) WHERE c_custkey % 50 = 0 GROUP BY 1")
def projection_cap(c: Collection) -> DataFrame:
    """Archives of more text than is projected, of every fiftieth customer: the stated set of large ones."""
    large = _packages(c, "zip", lambda k, n, s: {f"{p}.txt": ("x" * 1000 + "\n") * 1000 for p in range(2)} | {"z.txt": ("x" * 1000 + "\n") * 200} if k % 50 == 0 else {"a.txt": "x"})
    found = files.lines(large.where("CAST(path AS BIGINT) % 50 = 0"))
    return found.groupBy("path").agg(F.count("text").alias("lines"), F.bool_or(F.col("gap") == "further text is not projected").alias("cut"))


def _turns(c: Collection) -> DataFrame:
    """(path, line, value): every conversation as a rollout of messages, calls and their outputs."""
    turns = c.table("conversations").select(_string("r", F.col("conv_id")).alias("path"), (F.col("turn") + 2).cast("int").alias("line"), "turn", "role", "text", "conv_id")
    n = F.col("turn") % 3
    none = F.lit(None).cast("string")
    payload = F.struct(
        F.when(n == 0, "message").when(n == 1, "function_call").otherwise("function_call_output").alias("type"), F.when(n == 0, F.col("role")).alias("role"), F.when(n == 1, "run").alias("name"),
        F.when(n == 1, _string("c", F.col("turn"))).when(n == 2, _string("c", F.col("turn") - 1)).alias("call_id"), F.when(n == 1, F.lit("{}")).alias("arguments"), F.when(n == 2, F.col("text")).otherwise(none).alias("output"),
        F.when(n == 0, F.array(F.struct(F.lit("input_text").alias("type"), F.col("text").alias("text")))).alias("content"),
    )
    items = turns.select("path", "line", F.to_json(F.struct(F.lit("response_item").alias("type"), payload.alias("payload"))).alias("value"))
    meta = turns.where("conv_id % 4 <> 0").select("path", "conv_id").distinct().select("path", F.lit(1).alias("line"), F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(_string("s", F.col("conv_id")).alias("id")).alias("payload"))).alias("value"))
    return items.unionByName(meta)


@query(
    """SELECT 'r' || conv_id AS path, 's' || conv_id AS session, 'entry-' || (turn + 2) AS message, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS position,
    CASE turn % 3 WHEN 1 THEN 'assistant_tool_call' WHEN 2 THEN 'tool' ELSE role END AS role, CASE turn % 3 WHEN 1 THEN 'tool_call' WHEN 2 THEN 'tool_output' ELSE CASE role WHEN 'user' THEN 'user_message' WHEN 'assistant' THEN 'assistant_message' ELSE 'system_message' END END AS channel,
    CASE turn % 3 WHEN 1 THEN 'run {}' WHEN 2 THEN 'run: ' || text ELSE text END AS text FROM conversations WHERE conv_id % 4 <> 0"""
)
def rollout_messages(c: Collection) -> DataFrame:
    return conversation.rollout(_turns(c)).select("path", "session", "message", "position", "role", "channel", "text")


@query("SELECT 'r' || conv_id AS path, conv_id % 4 <> 0 AND bool_or(turn % 3 <> 2) AS supported FROM conversations GROUP BY conv_id")
def supported_exports(c: Collection) -> DataFrame:
    return conversation.supported(_turns(c))


@query("SELECT conv_id::VARCHAR AS session, turn::VARCHAR AS message, role, 'a b' AS author, 'unknown' AS date, replace(replace(text, chr(13), '\\r'), chr(10), '\\n') AS text FROM conversations")
def located_passages(c: Collection) -> DataFrame:
    """Lines written and read back; lines with a missing or repeated key give nothing."""
    rows = c.table("conversations").select(F.lit("p").alias("path"), F.col("conv_id").alias("session"), F.col("turn").alias("message"), F.col("turn").alias("position"), "role", F.lit("a b").alias("author"), F.lit("unknown").alias("date"), conversation.channel(F.col("role")).alias("channel"), "text")
    lines = conversation.located(rows)
    broken = lines.withColumn("line", F.regexp_replace("line", "; role=[^;]*", "")).unionByName(lines.withColumn("line", F.regexp_replace("line", "; role=", "; role=x; role=")))
    return conversation.parsed(lines.unionByName(broken)).select("session", "message", "role", "author", "date", "text")


@query("SELECT 'page-message-' || conv_id || '-' || turn AS page_id, CASE WHEN turn % 2 = 0 THEN 'question' ELSE 'uncertain' END AS intent, 'page-conversation-' || conv_id AS to_page_id FROM conversations WHERE text IS NOT NULL")
def conversation_knowledge(c: Collection) -> DataFrame:
    rows = c.table("conversations").select(F.col("conv_id").cast("string").alias("session"), F.col("turn").cast("string").alias("message"), "role", "text", F.lit("unknown").alias("date"))
    judged = rows.select("session", "message", F.lit("question").alias("intent"), F.when(F.col("message").cast("int") % 2 == 0, 0.9).otherwise(0.84).alias("score"))
    pages, edges = conversation.knowledge(rows, judged)
    return pages.select("page_id", "intent").join(edges.select(F.col("from_page_id").alias("page_id"), "to_page_id"), "page_id")


@query("SELECT p_partkey::VARCHAR AS path, 1 AS page, n::INT AS position, CASE n WHEN 1 THEN 'pdf_text' ELSE 'ocr' END AS channel, CASE n WHEN 1 THEN p_name ELSE p_brand END AS text, CASE n WHEN 2 THEN 'recognised text, confidence 0.50' END AS qualifier FROM part, (VALUES (1), (2)) v(n)")
def recognised_regions(c: Collection) -> DataFrame:
    region = lambda words, channel: F.struct(F.lit(1).alias("page"), F.col(words).alias("text"), F.lit(channel).alias("channel"), F.lit(0.5).alias("confidence"), F.lit(2).alias("column"))
    rows = c.table("part").select(F.col("p_partkey").cast("string").alias("path"), F.to_json(F.struct(F.array(region("p_name", "pdf_text"), region("p_brand", "ocr")).alias("regions"))).alias("body"))
    return files.regions(rows).select("path", "page", "position", "channel", "text", "qualifier")


_MEDIA = "m AS (SELECT 'm' || event_id AS path, (event_id % 7) * 2500 AS d FROM events)"


def _media(c: Collection) -> DataFrame:
    return c.table("events").select(_string("m", F.col("event_id")).alias("path"), ((F.col("event_id") % 7) * 2500).alias("duration_ms"))


@query(f"WITH {_MEDIA} SELECT path, unnest(generate_series(0, d - 1, 3000)) AS at FROM m WHERE d > 0")
def media_frames(c: Collection) -> DataFrame:
    return files.frames(_media(c))


@query(f'WITH {_MEDIA} SELECT path, 0::BIGINT AS "start", 1000::BIGINT AS "end" FROM m WHERE d > 1000 UNION ALL SELECT path, 3000, 4000 FROM m WHERE d > 5000 UNION ALL SELECT path, 6000, d FROM m WHERE d > 6000')
def media_gaps(c: Collection) -> DataFrame:
    """Spans from 1 to 3 and 4 to 6 seconds of all media that are over 5 seconds long; the first alone of shorter ones."""
    media = _media(c).where("duration_ms > 1000")
    spans = media.select("path", F.explode(F.when(F.col("duration_ms") > 5000, F.array(F.struct(F.lit(1000).alias("start"), F.lit(3000).alias("end")), F.struct(F.lit(4000).alias("start"), F.lit(6000).alias("end")))).otherwise(F.array(F.struct(F.lit(1000).alias("start"), F.col("duration_ms").cast("int").alias("end"))))).alias("s")).select("path", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))
    return files.gaps_in(spans, media)


@query("SELECT event_id % 500 AS part_id, event_id % 500 % 3 = 0 AS complete, 1000 * count(*) AS bytes FROM events GROUP BY 1, 2")
def part_streams(c: Collection) -> DataFrame:
    """Streams of decoded records, of which some announce another length and some have a hole."""
    from pyspark.sql import Window

    part = F.col("event_id") % 500
    n = F.row_number().over(Window.partitionBy(part).orderBy("event_id"))
    rows = c.table("events").select(part.alias("part_id"), n.alias("n"))
    size = rows.groupBy("part_id").agg((1000 * F.max("n")).cast("long").alias("bytes"))
    start = (1000 * (F.col("n") - 1)).cast("long") + F.when((F.col("part_id") % 3 == 1) & (F.col("n") == 2), 1).otherwise(0)
    data = rows.select("part_id", start.alias("start"), (1000 * F.col("n")).cast("long").alias("end"), F.lit(False).alias("is_end"), F.lit(None).cast("long").alias("total"))
    ends = size.select("part_id", F.col("bytes").alias("start"), F.col("bytes").alias("end"), F.lit(True).alias("is_end"), (F.col("bytes") + F.when(F.col("part_id") % 3 == 2, 1).otherwise(0)).alias("total"))
    return files.part_stream(data.unionByName(ends))


@query(
    """WITH RECURSIVE a AS (SELECT page_id, page_id % 12 AS hops FROM pages)
    SELECT url, CASE WHEN hops < 8 THEN url || '~0' ELSE url || '~' || (hops - 7) END AS final_url, least(hops + 1, 8)::INT AS attempts, CASE WHEN hops >= 8 THEN 'too many redirects' WHEN page_id % 5 = 0 THEN 'status 404' END AS problem,
    CASE WHEN hops < 8 AND page_id % 5 <> 0 THEN strlen(html) END AS bytes FROM (SELECT min(page_id) AS page_id FROM pages GROUP BY url) JOIN pages USING (page_id) JOIN a USING (page_id)"""
)
def url_imports(c: Collection) -> DataFrame:
    """Every URL behind 0 to 11 redirects, of which eight requests reach seven."""
    pages = c.table("pages")
    first = pages.groupBy("url").agg(F.min("page_id").alias("page_id")).join(pages.select("page_id", "html"), "page_id")
    hops = (F.col("page_id") % 12).cast("int")
    steps = first.select("url", "page_id", "html", hops.alias("hops"), F.explode(F.sequence(F.lit(0), hops)).alias("i"))
    here, there = _string(F.col("url"), "~", F.col("i")), _string(F.col("url"), "~", F.col("i") - 1)
    status = F.when(F.col("i") > 0, 302).when(F.col("page_id") % 5 == 0, 404).otherwise(200)
    answers = steps.select(here.alias("url"), status.alias("status"), F.when(F.col("i") > 0, there).alias("location"), F.when(F.col("i") == 0, F.col("html")).alias("html"))
    found = web.imported(first.select(_string(F.col("url"), "~", hops).alias("url")), answers)
    return found.select(F.regexp_replace("url", "~[0-9]+$", "").alias("url"), "final_url", "attempts", "problem", F.octet_length("html").cast("long").alias("bytes"))


# ---- functions on text -------------------------------------------------------------------


@query(
    r"""SELECT c_custkey AS id, translate(n, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded, 'É ' || c_custkey || ' x' AS collapsed, 'field é' AS tag, '\# ' || c_custkey || ' \[x\]\(y\)' AS escaped,
    sha256(strlen(n) || ':' || n || CASE WHEN c_custkey % 2 = 0 THEN '0:' ELSE 'null:' END) AS framed FROM (SELECT c_custkey, 'É' || c_name AS n FROM customer)"""
)
def text_functions(c: Collection) -> DataFrame:
    key, name = F.col("c_custkey"), F.concat(F.lit("É"), "c_name")
    return c.table("customer").select(
        key.alias("id"), text.fold(name).alias("folded"), text.collapse(_string("\t É \n", key, "  x ")).alias("collapsed"), text.normalized_tag(F.lit(" ##Field É ")).alias("tag"),
        text.markdown_escape(_string("# ", key, " [x](y)")).alias("escaped"), text.frame_hash(name, F.when(key % 2 == 0, "")).alias("framed"),
    )


def _python(f: Callable, kind: str):
    """A column function of a plain one, over batches."""

    def each(values: pd.Series) -> pd.Series:
        return values.map(f)

    each.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(each, kind)


@query(
    """SELECT c_custkey AS id, 'https://www.example.com/p%20' || c_custkey || '?q=%C3%A9' AS resolved, 'https://www.example.com/a/b' AS base, 'mailto:x' || c_custkey AS foreign_link, 'https://a.example/x_(' || c_custkey || ') http://b.example/z. http://c.example/d' AS urls,
    'c d' || c_custkey || '.md' AS path, '../e/' || c_custkey || '.md' AS relative, '../../a/' || c_custkey || '.md#t' AS rebased, 'é' || substr(c_custkey::VARCHAR, 1, 1) AS cut, 3 + strlen(c_custkey::VARCHAR) AS found_at FROM customer"""
)
def link_functions(c: Collection) -> DataFrame:
    ship(c.spark)
    key, base = F.col("c_custkey"), "HTTPS://WWW.Example.com:443/a/b#top"
    return c.table("customer").select(
        key.alias("id"), _python(lambda h: text.resolve_url(base, h), "string")(_string("../p ", key, "?q=é")).alias("resolved"), _python(lambda h: text.resolve_url(base, h), "string")(F.substring(_string(key), 1, 0)).alias("base"),
        _python(lambda h: text.resolve_url(base, h), "string")(_string("mailto:x", key)).alias("foreign_link"),
        _python(lambda t: " ".join(text.linked_urls(t)), "string")(_string("see (https://a.example/x_(", key, ")). <http://b.example/z.> or http://c.example/d;,")).alias("urls"),
        _python(lambda link: text.resolve_relative("a/b/page.md", link), "string")(_string("../../c%20d", key, ".md#x")).alias("path"), _python(lambda t: text.relative_link("a/b/page.md", t), "string")(_string("a/e/", key, ".md")).alias("relative"),
        _python(lambda link: text.rebased_link(link, "a/page.md", "x/y/page.md"), "string")(_string(key, ".md#t")).alias("rebased"),
        _python(lambda t: text.cut_utf8(t, 3), "string")(_string("é", key, "é")).alias("cut"), _python(lambda t: text.locate(t, "qu")[0], "long")(_string("é ", key, "quote")).alias("found_at"),
    )


@query("SELECT doc_id, octet_length(encode(text)) AS bytes, instr(text, 'the') > 0 AS found FROM documents WHERE text IS NOT NULL")
def byte_search(c: Collection) -> DataFrame:
    """A word in every document's bytes, which are cut into records of 64 bytes."""
    from docketry.operators import evidence

    raw = F.encode("text", "UTF-8")
    docs = c.table("documents").where("text IS NOT NULL")
    size = F.octet_length("text")
    records = docs.select(F.col("doc_id").alias("part_id"), raw.alias("raw"), F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), size - 1), F.lit(64))).alias("start")).select("part_id", "start", F.substring("raw", F.col("start") + 1, F.lit(64)).alias("data"))
    found = evidence.holds_bytes(records, b"the")
    return docs.select("doc_id", size.cast("long").alias("bytes")).join(found.withColumnRenamed("part_id", "doc_id"), "doc_id")
