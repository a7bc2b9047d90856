"""Formation over texts that are written from the orders, so that SQL knows what stands where in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import text
from docketry.operators import formation
from docketry.plans.model import Collection
from docketry.plans.registry import query
from docketry.session import dealt


#: Notes that one task reads, and most candidates of a note: two events and counts, and one tag, date, duration, person and place.
NOTES_A_TASK, NOTE_CANDIDATES = 1 << 14, 9


def _key() -> Column:
    return F.col("o_orderkey")


def _string(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _notes(c: Collection) -> DataFrame:
    """(source_id, text): an observation's log, with an accent so that bytes and characters differ."""
    n, m = _key() % 90 + 1, _key() % 50 + 5
    hedge = F.when(_key() % 5 == 0, "possibly ").otherwise("")
    said = _string("Observation A-", _key(), " was logged: café. Ann Lee ", hedge, "counted ", n, " visits at River Delta on ", F.date_format("o_orderdate", "MMMM d, yyyy"), " for ", m, "minutes. #field-", _key() % 7)
    said = F.when(_key() % 3 == 0, _string(said, " For Survey B-", _key(), ": The visit total should read ", n + 1, ", not ", n, ".")).otherwise(said)
    orders = c.table("orders").select("o_orderkey", "o_orderdate")
    return dealt(orders, orders.count(), NOTES_A_TASK).select(_key().cast("string").alias("source_id"), said.alias("text"))


_NOTE_PARTS = """o AS (SELECT o_orderkey AS k, o_orderkey % 90 + 1 AS n, o_orderkey % 50 + 5 AS m, o_orderkey % 5 = 0 AS hedged, strftime(o_orderdate, '%B %-d, %Y') AS day FROM orders),
  s AS (SELECT *, 'Observation A-' || k || ' was logged: café.' AS s1, 'Ann Lee ' || CASE WHEN hedged THEN 'possibly ' ELSE '' END || 'counted ' || n || ' visits at River Delta on ' || day || ' for ' || m || 'minutes.' AS s2,
        '#field-' || (k % 7) AS tag, 'For Survey B-' || k || ': The visit total should read ' || (n + 1) || ', not ' || n || '.' AS s3 FROM o),
  p AS (SELECT *, strlen(s1) + 1 AS b2, strlen(s1) + 1 + strlen(s2) AS e2, strlen(s1) + strlen(s2) + 2 AS b3, strlen(s1) + strlen(s2) + 3 + strlen(tag) AS b4 FROM s),
  f AS (SELECT k, 1 AS ord, 'event' AS kind, 'Observation A-' || k AS value, 0 AS "start", strlen(s1) AS "end", '' AS qualifier FROM p
    UNION ALL SELECT k, 2, 'tag', 'field-' || (k % 7), b3, b3 + strlen(tag), '' FROM p
    UNION ALL SELECT k, 3, 'date', day, b2, e2, '' FROM p
    UNION ALL SELECT k, 4, 'count', n || ' visits', b2, e2, CASE WHEN hedged THEN 'possibly' ELSE '' END FROM p
    UNION ALL SELECT k, 6, 'duration', m || ' minutes', b2, e2, '' FROM p
    UNION ALL SELECT k, 7, 'person', 'Ann Lee', b2, b2 + strlen('Ann Lee counted'), '' FROM p WHERE NOT hedged
    UNION ALL SELECT k, 8, 'place', 'River Delta', b2, e2, CASE WHEN hedged THEN 'possibly' ELSE '' END FROM p
    UNION ALL SELECT k, 1, 'event', 'Survey B-' || k, b3, b4 + strlen(s3), '' FROM p WHERE k % 3 = 0
    UNION ALL SELECT k, 5, 'count', (n + 1) || ' visits', b3, b4 + strlen(s3), '' FROM p WHERE k % 3 = 0),
  found AS (SELECT k::VARCHAR AS source_id, kind, value, "start", "end", qualifier, 'observed' AS origin, row_number() OVER (PARTITION BY k ORDER BY "start", "end", ord)::INT AS position, false AS incomplete FROM f)"""


@query(f"WITH {_NOTE_PARTS} SELECT * FROM found")
def candidates(c: Collection) -> DataFrame:
    return formation.candidates(_notes(c))


_JUDGED = """j AS (SELECT *, (source_id::BIGINT * 7 + position * 13) % 100 / 100.0 AS probability, (source_id::BIGINT + position) % 2 = 0 AS corroborated FROM found),
  taken AS (SELECT * FROM j WHERE probability >= CASE kind WHEN 'event' THEN 0.55 WHEN 'person' THEN 0.9 ELSE 0.6 END AND (kind <> 'person' OR corroborated))"""


def _taken(c: Collection) -> DataFrame:
    """Judgments are a table of their own: one for every place that a note can have, so that candidates are looked for once."""
    n = _key()
    places = c.table("orders").select(n, F.explode(F.sequence(F.lit(1), F.lit(NOTE_CANDIDATES))).alias("position"))
    judged = places.select(n.cast("string").alias("source_id"), "position", ((n * 7 + F.col("position") * 13) % 100 / 100).alias("probability"), ((n + F.col("position")) % 2 == 0).alias("corroborated"))
    return formation.accepted(formation.candidates(_notes(c)), judged)


@query(f"WITH {_NOTE_PARTS}, {_JUDGED} SELECT source_id, kind, value, position FROM taken")
def accepted_candidates(c: Collection) -> DataFrame:
    return _taken(c).select("source_id", "kind", "value", "position")


@query(f"""WITH {_NOTE_PARTS}, {_JUDGED} SELECT 'page-' || source_id AS subject, CASE kind WHEN 'date' THEN 'event_date' WHEN 'count' THEN 'visit_count' ELSE 'duration' END AS property, value, "start", "end", qualifier FROM taken WHERE kind IN ('date', 'count', 'duration')""")
def formed_facts(c: Collection) -> DataFrame:
    return formation.facts(_taken(c), _string("page-", F.col("source_id")))


@query(f"WITH {_NOTE_PARTS}, {_JUDGED} SELECT 'page-' || source_id AS from_page_id, CASE kind WHEN 'person' THEN 'observed_by' ELSE 'occurred_at' END AS kind, value AS to_label, qualifier FROM taken WHERE kind IN ('person', 'place')")
def formed_relationships(c: Collection) -> DataFrame:
    return formation.relationships(_taken(c), _string("page-", F.col("source_id")))


@query(
    f"""WITH {_NOTE_PARTS} SELECT k::VARCHAR AS source_id, 'Survey B-' || k AS event, 'visit_count' AS property, n || ' visits' AS previous, (n + 1) || ' visits' AS value, b3 AS "start", b4 + strlen(s3) AS "end" FROM p WHERE k % 3 = 0"""
)
def corrections(c: Collection) -> DataFrame:
    return formation.corrections(_notes(c)).select("source_id", "event", "property", "previous", "value", "start", "end")


def _prose(c: Collection) -> DataFrame:
    said = _string('Order "', _key(), '" came in. Was it été on ', F.date_format("o_orderdate", "yyyy-MM-dd"), "? \n  Not on 2024-02-31")
    return c.table("orders").select(_key().cast("string").alias("source_id"), said.alias("text"))


_PROSE = """o AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS day, 'Order "' || o_orderkey || '" came in.' AS s1, 'Was it été on ' || strftime(o_orderdate, '%Y-%m-%d') || '?' AS s2, 'Not on 2024-02-31' AS s3 FROM orders),
  p AS (SELECT *, strlen(s1) + 1 AS b2, strlen(s1) + 5 + strlen(s2) AS b3 FROM o),
  sentences AS (SELECT k, 1 AS position, s1 AS text, 0 AS "start" FROM p UNION ALL SELECT k, 2, s2, b2 FROM p UNION ALL SELECT k, 3, s3, b3 FROM p)"""


@query(f"""WITH {_PROSE} SELECT k::VARCHAR AS source_id, position::INT AS position, "start"::INT AS "start", ("start" + strlen(text))::INT AS "end", text FROM sentences""")
def sentence_spans(c: Collection) -> DataFrame:
    return formation.spans(_prose(c))


@query(
    f"""WITH {_PROSE} SELECT k::VARCHAR AS source_id, 'prose' AS kind, text AS value, "start", "start" + strlen(text) AS "end", position::INT AS position FROM sentences
    UNION ALL SELECT k::VARCHAR, 'date', day, b2, b2 + strlen(s2), 4 FROM p"""
)
def prose_candidates(c: Collection) -> DataFrame:
    return formation.prose(_prose(c)).select("source_id", "kind", "value", "start", "end", "position")


@query(f"WITH {_PROSE} SELECT k::VARCHAR AS source_id, 2 AS position, day AS value FROM p UNION ALL SELECT k::VARCHAR, 3, '2024-02-31' FROM p")
def dates_in_sentences(c: Collection) -> DataFrame:
    """Days found by pattern, in characters of their place in bytes, joined to the sentences that hold them."""
    texts = _prose(c)
    days = texts.select("source_id", F.explode(F.regexp_extract_all("text", F.lit(r"([0-9]{4}-[0-9]{2}-[0-9]{2})"), F.lit(1))).alias("value"), "text").distinct()
    at = F.octet_length(F.expr("left(text, instr(text, value) - 1)"))
    found = days.select("source_id", "value", at.alias("at"), (at + 10).alias("until"))
    return formation.dates_in_spans(formation.spans(texts), found).select("source_id", "position", "value")


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'quoted' WHEN 1 THEN 'quoted' ELSE 'observed' END AS origin FROM orders")
def origins(c: Collection) -> DataFrame:
    import pandas as pd

    def each(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: text.origin(t, t.index("X"), t.index("X") + 1))

    each.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    said = F.when(_key() % 3 == 0, _string('He said "', _key(), ' X" and left')).when(_key() % 3 == 1, _string("As QUOTED in ", _key(), ": X")).otherwise(_string('"', _key(), "” X: quoted"))
    return c.table("orders").select(_key().alias("id"), F.pandas_udf(each, "string")(said).alias("origin"))


@query(
    """SELECT c_custkey::VARCHAR AS source_id, 'decision' AS kind, c_name AS value, strlen('# ADR-' || c_custkey || ': ' || c_name || '  ') + 15 AS "start", strlen('# ADR-' || c_custkey || ': ' || c_name || '  ') + 15 + strlen('Take ' || c_mktsegment || '.') AS "end", 'observed' AS origin, 1 AS position FROM customer
    UNION ALL SELECT c_custkey::VARCHAR, 'question', 'Why ' || c_custkey || '?', strlen('# ADR-' || c_custkey || ': ' || c_name || '  ' || 'Take ' || c_mktsegment || '.') + 38, strlen('# ADR-' || c_custkey || ': ' || c_name || '  ' || 'Take ' || c_mktsegment || '.') + 38 + strlen('Why ' || c_custkey || '?'), 'observed', 2 FROM customer"""
)
def decision_records(c: Collection) -> DataFrame:
    key, name = F.col("c_custkey"), F.col("c_name")
    said = _string("# ADR-", key, ": ", name, "  \n\n## Decision\n\nTake ", F.col("c_mktsegment"), ".\n\n## Open questions\n\n- Why ", key, "?\n* none\n# End\n- Not this?\n")
    return formation.documents(c.table("customer").select(key.cast("string").alias("source_id"), said.alias("text"))).select("source_id", "kind", "value", "start", "end", "origin", "position")


@query("""SELECT c_custkey::VARCHAR AS source_id, 'code_concept' AS kind, 'Thing' || c_custkey AS value, 2::BIGINT AS "start", 2 + strlen('/// About ' || c_nationkey || chr(10) || '/// é') AS "end" FROM customer""")
def code_concepts(c: Collection) -> DataFrame:
    said = _string("\n\n/// About ", F.col("c_nationkey"), "\n/// é\n  pub struct Thing", F.col("c_custkey"), " {\n//// none\nenum Other {")
    return formation.candidates(c.table("customer").select(F.col("c_custkey").cast("string").alias("source_id"), said.alias("text"))).select("source_id", "kind", "value", "start", "end")


_LINE = "strlen('[XLSX sheet \"Nötes\" cell A' || c_custkey || '; channel=cell] ')"


@query(
    f"""SELECT c_custkey::VARCHAR AS source_id, c_mktsegment AS value, {_LINE} AS "start", '' AS qualifier, 'table_cell' AS origin FROM customer
    UNION ALL SELECT c_custkey::VARCHAR, c_custkey::VARCHAR, {_LINE} + strlen(c_mktsegment) + 2 + strlen('[XLSX sheet "N" cell B1; channel=cached_formula_value] '), 'Cached formula value; the formula was not evaluated and this value may be stale', 'cached_formula_value' FROM customer
    UNION ALL SELECT c_custkey::VARCHAR, 'Level not confirmed, possibly.', {_LINE} + strlen(c_mktsegment) + 3 + strlen('[XLSX sheet "N" cell B1; channel=cached_formula_value] ' || c_custkey) + strlen('[PDF page 1 region 2; column=1; channel=ocr] '), 'OCR transcription; unverified; not confirmed; possibly', 'ocr' FROM customer"""
)
def located_statements(c: Collection) -> DataFrame:
    key = F.col("c_custkey")
    said = _string('[XLSX sheet "Nötes" cell A', key, "; channel=cell] ", F.col("c_mktsegment"), ' \n[XLSX sheet "N" cell B1; channel=cached_formula_value] ', key, "\n[PDF page 1 region 2; column=1; channel=ocr] Level not confirmed, possibly.\nordinary text\n[DOCX paragraph 1; channel=reference] a link")
    return formation.documents(c.table("customer").select(key.cast("string").alias("source_id"), said.alias("text"))).select("source_id", "value", "start", "qualifier", "origin")


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'not confirmed; possibly; reported' WHEN 1 THEN 'estimated level ' || p_size WHEN 2 THEN 'gauge calibration pending; may be wrong' END AS found FROM part""")
def qualifying_phrases(c: Collection) -> DataFrame:
    key = F.col("p_partkey")
    said = F.when(key % 4 == 0, _string("Size ", F.col("p_size"), " not confirmed, Possibly; as reported")).when(key % 4 == 1, _string("an estimated level ", F.col("p_size"), "; so")).when(key % 4 == 2, _string("gauge  calibration pending: it may be wrong")).otherwise(F.col("p_name"))
    told = F.lower(F.regexp_replace(formation.qualification(said), "  ", " "))
    return c.table("part").select(key.alias("id"), told.alias("found"))


@query(
    """SELECT o_orderkey::VARCHAR AS source_id, 'date' AS kind, strftime(o_orderdate, '%Y-%m-%d') AS value, strlen('Révision ' || o_orderkey || ' of ') AS "start" FROM orders WHERE o_orderkey % 2 = 0
    UNION ALL SELECT o_orderkey::VARCHAR, 'revision', (o_orderkey % 9 + 1)::VARCHAR, strlen('Révision ' || o_orderkey || ' of ' || strftime(o_orderdate, '%b %-d %Y') || ': ') FROM orders WHERE o_orderkey % 2 = 0"""
)
def ordering_candidates(c: Collection) -> DataFrame:
    day = F.date_format("o_orderdate", "MMM d yyyy")
    said = F.when(_key() % 2 == 0, _string("Révision ", _key(), " of ", day, ": revision ", _key() % 9 + 1, ", revision 0")).otherwise(_string("[PHOTO 1; channel=file_metadata] ", day, " revision 3"))
    return formation.ordering(c.table("orders").select(_key().cast("string").alias("source_id"), said.alias("text"))).select("source_id", "kind", "value", "start")


@query("SELECT event_id AS segment_id, event_type AS text, CASE WHEN event_id % 4 = 0 THEN 'spoken_message' WHEN event_id % 100 >= 60 THEN 'question' ELSE 'spoken_message' END AS act FROM events")
def speech_acts(c: Collection) -> DataFrame:
    n = F.col("event_id")
    rows = c.table("events").select(n.alias("segment_id"), F.col("event_type").alias("text"))
    return formation.speech_acts(rows, rows.where("segment_id % 4 <> 0").select("segment_id", F.lit("question").alias("act"), (F.col("segment_id") % 100 / 100).alias("probability")))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'complete_replacement' WHEN 1 THEN 'targeted_correction' WHEN 2 THEN 'supplement' WHEN 3 THEN 'conditional' ELSE 'unknown' END AS role FROM orders")
def update_roles(c: Collection) -> DataFrame:
    n = _key() % 5
    said = F.when(n == 0, _string(_key(), " supersedes the earlier list")).when(n == 1, _string("It was ", _key(), ", not 12")).when(n == 2, _string("In addition ", _key())).when(n == 3, _string("valid unless confirmed ", _key())).otherwise(_string("note ", _key()))
    return c.table("orders").select(_key().alias("id"), formation.update_roles(said).alias("role"))


@query("SELECT l_suppkey AS source_id, l_returnflag AS value, count(*) AS mentions FROM lineitem GROUP BY ALL")
def persons_of_one_name(c: Collection) -> DataFrame:
    key = F.struct("l_orderkey", "l_linenumber")
    rows = c.table("lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_returnflag").alias("value"), key.alias("start"), key.alias("end"))
    return formation.same_names(rows)


@query(
    """WITH m AS (SELECT o_custkey AS source_id, o_orderpriority AS name, o_orderkey AS "start", o_orderkey + 400 AS "end" FROM orders),
    g AS (SELECT *, CASE WHEN "start" < max("end") OVER (PARTITION BY source_id, name ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM m),
    h AS (SELECT *, sum(fresh) OVER (PARTITION BY source_id, name ORDER BY "start", "end") AS n FROM g)
    SELECT source_id, name AS value, min("start") AS "start", max("end") AS "end" FROM h GROUP BY source_id, name, n"""
)
def overlapping_mentions(c: Collection) -> DataFrame:
    rows = c.table("orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderpriority").alias("value"), _key().alias("start"), (_key() + 400).alias("end"))
    return formation.merged_persons(rows)


@query(
    """SELECT l_orderkey::VARCHAR AS path, l_linenumber AS position, 'Line ' || l_partkey AS quote FROM lineitem a
    WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber AND b.l_linenumber % 3 <> 0 AND b.l_returnflag <> 'N' AND instr('A Line ' || b.l_partkey || '.', 'Line ' || a.l_partkey) > 0)"""
)
def rejected_claims(c: Collection) -> DataFrame:
    """Claims of every line, of which some quote what is not there and some are on another channel."""
    rows = c.table("lineitem").select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").alias("position"), _string("A Line ", F.col("l_partkey"), ".").alias("text"), F.when(F.col("l_returnflag") == "N", "ocr").otherwise("table").alias("channel"), "l_partkey", "l_linenumber")
    claims = rows.select("path", "position", _string("Line ", F.col("l_partkey")).alias("quote"), F.lit("table").alias("channel"))
    lines = rows.select("path", F.when(F.col("l_linenumber") % 3 == 0, _string("Nothing ", F.col("position"))).otherwise(F.col("text")).alias("text"), "channel", "position")
    held = lines.withColumn("path", _string(F.col("path"), "/", F.col("position")))
    return formation.rejected(claims.withColumn("path", _string(F.col("path"), "/", F.col("position"))), held).select(F.substring_index("path", "/", 1).alias("path"), "position", "quote")


@query(
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
    t AS (SELECT o_custkey, n, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS h, o_orderpriority || ' line' AS text FROM o)
    SELECT o_custkey AS path, n::INT AS position, last_value(h IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading,
      row_number() OVER (PARTITION BY o_custkey, array_to_string(string_split(coalesce(h, text), ' ')[1:2], ' ') ORDER BY n)::INT AS occurrence FROM t"""
)
def statements_under_headings(c: Collection) -> DataFrame:
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    heading = F.col("o_orderstatus") == "F"
    rows = c.table("orders").select(F.col("o_custkey").alias("path"), n.alias("position"), F.lit("x").alias("locator"), F.when(heading, "heading").otherwise("paragraph").alias("channel"), F.when(heading, F.col("o_orderpriority")).otherwise(_string(F.col("o_orderpriority"), " line")).alias("text"))
    return formation.statements(rows).select("path", "position", "heading", "occurrence")


@query(
    """SELECT c_custkey::VARCHAR AS source_id, 1 AS line, 'spreadsheet:' || sha256('sheet "N" cell A' || c_custkey) AS record_key FROM customer
    UNION ALL SELECT c_custkey::VARCHAR, 2, 'pdf:page-1:column-2:water-level:occurrence-1' FROM customer UNION ALL SELECT c_custkey::VARCHAR, 3, 'pdf:page-1:column-2:water-level:occurrence-2' FROM customer
    UNION ALL SELECT c_custkey::VARCHAR, 5, 'office-field:table:field-report::river-' || lower(c_mktsegment) FROM customer UNION ALL SELECT c_custkey::VARCHAR, 6, 'office-subject:main_document:field-report:gauge-' || c_custkey || 'a' FROM customer
    UNION ALL SELECT c_custkey::VARCHAR, 4, 'office-subject:main_document::field-report' FROM customer UNION ALL SELECT c_custkey::VARCHAR, 7, 'office-object:field-report:slide_text:ppt-slides-slide1-xml-shape-id-' || c_custkey FROM customer"""
)
def record_keys(c: Collection) -> DataFrame:
    key = F.col("c_custkey")
    lines = (
        _string('[XLSX sheet "N" cell A', key, "; channel=cell] 84"), F.lit("[PDF page 1 region 1; column=2; channel=pdf_text] Water level 3"), _string("[PDF page 1 region 4; column=2; channel=pdf_text] water Level ", key),
        F.lit("[DOCX paragraph 1 style Heading1; channel=main_document] Field report"), _string("[DOCX table 1 row 2; channel=table] River: ", F.col("c_mktsegment"), "; Level: 3"),
        _string("[DOCX paragraph 2; channel=main_document] The gauge ", key, "A was 12"), _string("[PPTX slide 1 OOXML part ppt/slides/slide1.xml shape id ", key, " name x; channel=slide_text] Any"),
    )
    return formation.keys(c.table("customer").select(key.cast("string").alias("source_id"), F.concat_ws("\n", *lines).alias("text")))
