"""Candidates in text by pattern, judged acceptance, and the facts and relationships they give.

Patterns find candidates with byte spans; judgments (of a model or a person) are a table that the
candidates join. Nothing is accepted without one. A kind of candidate is a row of KINDS: where it
is found, what of it is its value, how much of the text is its quote and what qualifies it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import bytes_at, fold, origin, sentence_around, sentences
from docketry.session import ship

# Limits and thresholds.
MAX_CANDIDATES, SUPPORT, EVENT, INTENT, PERSON = 64, 0.6, 0.55, 0.85, 0.9

# Patterns, and the texts of qualifiers.
CODE_CONCEPT = r"(?m)^\ufeff?((?:[ \t]*///(?:[^/\r\n][^\r\n]*)?\r?\n)+)[ \t]*(?:pub[ \t]+)?(?:struct|enum|trait)[ \t]+([A-Z][A-Za-z0-9_]*)\b"
EVENT_NAME = r"\b(?:V[0-9]+|(?i:observation|survey|event)\s+[A-Z][A-Z0-9_-]*)\b"
HASHTAG = r"#[\w-]+\b"
MONTH_DATE = r"\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+(?:[0-9]{1,2},?\s+[0-9]{4}|[0-9]{4})\b"
ISO_DATE = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"
UNKNOWN_DATE = r"(?i)\b(?:(?:the\s+)?(?:observation\s+)?date\s+(?:is\s+unknown|was\s+unknown|was\s+not\s+supplied)|no\s+(?:observation\s+)?date\s+was\s+supplied)\b"
HEDGE = r"(?:(?:[A-Z][a-z]+\s+)?estimated\s+)?(?:possibly\s+(?:counted\s+)?)?"
COUNT = rf"(?i)\b{HEDGE}(?:[0-9]+\s+visits?|visits?\s*:\s*(?:possibly\s+)?[0-9]+)\b"
COUNT_CORRECTION = r"(?i)\bvisit\s+total\s+(?:should\s+)?(?:read|be\s+corrected\s+to)\s+([0-9]+)\s*,?\s+not\s+([0-9]+)\b"
DURATION = r"(?i)\b([0-9]+)\s*(minutes?|hours?|seconds?|days?)\b"
NAME = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}"
PERSON_NAME = rf"\b({NAME})(?:,\s+[^.;]{{0,48}})?\s+(?i:observed|attended|filed|estimated|recorded|reported|counted)\b|\b(?i:observer)\s*:?\s*({NAME})|\b(?:a different person named|another person named)\s+({NAME})"
PRONOUNS = ("i", "we", "you", "he", "she", "they", "it")
PLACE = rf"\b(?i:at|location:?|occurred at)\s+({NAME})"
URL = r"https?://[^\s)>]+"
DECISION_TITLE = r"(?im)^#[ \t]+ADR-[0-9A-Za-z_-]+\s*:\s*(.+?)\s*$"
DECISION_HEADING = r"(?im)^##[ \t]+Decision[ \t]*\r?\n"
ANY_HEADING = r"(?m)^#{1,6}[ \t]+"
QUESTIONS_HEADING = r"(?i)^##[ \t]+(?:open[ \t]+)?questions[ \t]*$"
REVISION = r"(?i)\brevision\s+([0-9]+)\b"
REPORT_DATE = r"(?i)\b(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)\s+[0-9]{1,2},?\s+[0-9]{4})\b"
QUALIFIERS = (
    r"\b(?:gauge\s+calibration\s+pending|calibration\s+pending|not\s+a\s+record(?:[\s-]+[\w-]+){0,5}|not\s+confirmed|not\s+verified|unconfirmed(?:[\s-]+[\w-]+){0,2}"
    r"|unverified(?:[\s-]+[\w-]+){0,2}|possibly|possible|estimated(?:[\s-]+[\w-]+){0,2}|estimate|excluding(?:[\s-]+[\w-]+){0,3}|except(?:[\s-]+[\w-]+){0,3}|alleged|reported"
    r"|provisional(?:[\s-]+[\w-]+){0,6}|uncalibrated(?:[\s-]+[\w-]+){0,2}|conditional|pending(?:[\s-]+[\w-]+){0,6}|unknown|may\s+be\s+\w+)"
)
MONTH_PRECISION, NO_DATE = "Source supplies month precision; day is not supplied.", "date not supplied or stated unknown"
POSSIBLE_ESTIMATE, POSSIBLE, ESTIMATE = "possibly; estimate, not confirmed", "possibly", "estimate; not confirmed"
STALE_FORMULA = "Cached formula value; the formula was not evaluated and this value may be stale"

#: (kind, value, start, end, qualifier, origin): the quote's place, first in characters and at last in bytes.
Candidate = tuple[str, str, int, int, str, str]


@dataclass(frozen=True)
class Kind:
    """value: of a match; quote: "sentence", "match" or the number of a group; qualifier: of the quote and the text behind the match."""

    name: str
    pattern: re.Pattern
    value: Callable[[re.Match], str | None]
    quote: str | int = "sentence"
    qualifier: Callable[[re.Match, str, str], str] = lambda match, quote, behind: ""


def _event(match: re.Match) -> str:
    kind, _, name = " ".join(match[0].split()).rpartition(" ")
    return f"{kind[:1].upper()}{kind[1:]} {name}" if kind else f"Observation {name}"


def _count(match: re.Match) -> str:
    if "visits:" in match[0].lower():
        return f"{re.search('[0-9]+', match[0])[0]} visits"
    return re.sub(f"(?i)^{HEDGE}", "", match[0])


def _hedged(match: re.Match, quote: str, behind: str) -> str:
    quote, behind = quote.lower(), behind[:90].lower()
    possible, estimate = "possibly" in quote, "estimate" in behind or "not a confirmed" in behind
    if possible and ("estimated" in quote or estimate):
        return POSSIBLE_ESTIMATE
    return POSSIBLE if possible else ESTIMATE if "estimate" in quote or estimate else ""


def _person(match: re.Match) -> str | None:
    name = match[1] or match[2] or match[3]
    return None if name.lower() in PRONOUNS else name


KINDS = (
    Kind("code_concept", re.compile(CODE_CONCEPT), lambda m: m[2], 1),
    Kind("event", re.compile(EVENT_NAME), _event),
    Kind("tag", re.compile(HASHTAG), lambda m: m[0].lstrip("#"), "match"),
    Kind("date", re.compile(MONTH_DATE), lambda m: m[0], "sentence", lambda m, quote, behind: MONTH_PRECISION if len(m[0].split()) == 2 else ""),
    Kind("unknown_date", re.compile(UNKNOWN_DATE), lambda m: "unknown", "sentence", lambda m, quote, behind: NO_DATE),
    Kind("count", re.compile(COUNT), _count, "sentence", _hedged),
    Kind("correction", re.compile(COUNT_CORRECTION), lambda m: f"{m[1]} visits"),
    Kind("duration", re.compile(DURATION), lambda m: f"{m[1]} {m[2].lower()}"),
    Kind("person", re.compile(PERSON_NAME), _person, "match"),
    Kind("place", re.compile(PLACE), lambda m: m[1], "sentence", lambda m, quote, behind: POSSIBLE if "possibly" in quote.lower() else ""),
    Kind("reference", re.compile(URL), lambda m: m[0].rstrip(".,")),
)


def _quoted(text: str, kind: Kind, match: re.Match) -> tuple[int, int]:
    if kind.quote == "match":
        return match.span()
    if isinstance(kind.quote, int):
        start, end = match.span(kind.quote)
        return start, start + len(text[start:end].rstrip("\r\n"))
    if kind.name == "reference":
        low, high = text.rfind("\n", 0, match.start()) + 1, text.find("\n", match.start())
        found = located(text[low : high if high >= 0 else len(text)])
        if found and found[0] == "reference":
            return low + found[1], high if high >= 0 else len(text)
    return sentence_around(text, *match.span())


def _found(text: str) -> Iterator[Candidate]:
    for kind in KINDS:
        for match in kind.pattern.finditer(text):
            value = kind.value(match)
            if value is not None:
                start, end = _quoted(text, kind, match)
                yield kind.name, value, start, end, kind.qualifier(match, text[start:end], text[match.end() : match.end() + 90]), origin(text, *(match.span(kind.quote) if isinstance(kind.quote, int) else match.span()))


def _in_bytes(text: str, found: list[Candidate]) -> list[Candidate]:
    at = bytes_at(text)
    return [(kind, value, at(a), at(b), *rest) for kind, value, a, b, *rest in found]


def candidates_in(text: str) -> list[Candidate]:
    """(kind, value, start, end, qualifier, origin), the quotes' byte spans, by span.

    A correction is a count and takes the place of counts in its sentence; of an event's mentions
    the first stays; overlapping mentions of one person are one.
    """
    found = list(_found(text))
    corrected = [c[2:4] for c in found if c[0] == "correction"]
    found = [c for c in found if c[0] != "count" or not any(c[2] < b and a < c[3] for a, b in corrected)]
    out: list[Candidate] = []
    events: set[str] = set()
    persons: dict[str, list[int]] = {}
    for kind, value, a, b, *rest in sorted(found, key=lambda c: c[2:4]):
        if kind == "event":
            if value in events:
                continue
            events.add(value)
        elif kind == "person":
            name = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in value)
            same = next((n for n in persons.get(name, []) if out[n][2] < b and a < out[n][3]), None)
            if same is not None:
                _, first, x, y, *_ = out[same]
                out[same] = ("person", first, min(x, a), max(y, b), "", origin(text, min(x, a), max(y, b)))
                continue
            persons.setdefault(name, []).append(len(out))
        out.append(("count" if kind == "correction" else kind, value, a, b, *rest))
    return _in_bytes(text, out)


def corrections_in(text: str) -> list[tuple[str, str, str, str, int, int, str]]:
    """(event, property, previous, value, start, end, origin) of corrections whose sentence names an event."""
    at = bytes_at(text)
    events = {(a, b): value for kind, value, a, b, *_ in reversed(candidates_in(text)) if kind == "event"}
    out = []
    for m in re.finditer(COUNT_CORRECTION, text):
        start, end = (at(x) for x in sentence_around(text, *m.span()))
        if (start, end) in events:
            out.append((events[start, end], "visit_count", f"{m[2]} visits", f"{m[1]} visits", start, end, origin(text, *m.span())))
    return out


def decisions_in(text: str) -> list[Candidate]:
    """Sections headed Decision of a text that is titled as a decision record; their value is the title."""
    title = re.search(DECISION_TITLE, text)
    if not title or not title[1].strip():
        return []
    found = []
    for heading in re.finditer(DECISION_HEADING, text):
        following = re.search(ANY_HEADING, text[heading.end() :])
        section = text[heading.end() : heading.end() + following.start()] if following else text[heading.end() :]
        start = heading.end() + len(section) - len(section.lstrip())
        if section.strip():
            end = start + len(section.strip())
            found.append(("decision", title[1].strip(), start, end, "", origin(text, start, end)))
    return _in_bytes(text, found)


def questions_in(text: str) -> list[Candidate]:
    """Bullets that end with a question mark, in sections headed Questions or Open questions."""
    found, at, inside = [], 0, False
    for raw in text.split("\n"):
        line = raw.rstrip("\r\n")
        if re.search(QUESTIONS_HEADING, line):
            inside = True
        elif line.startswith("#"):
            inside = False
        elif inside and line.lstrip().startswith(("- ", "* ", "+ ")):
            question = line.lstrip()[2:].strip()
            if question.endswith("?"):
                start = at + len(line) - len(line.lstrip()) + 2
                found.append(("question", question, start, start + len(question), "", origin(text, start, start + len(question))))
        at += len(raw) + 1
    return _in_bytes(text, found)


def prose_in(text: str) -> list[Candidate]:
    """Sentences as statements, and calendar days written as numbers, once a sentence."""
    found = [("prose", text[a:b], a, b, "", origin(text, a, b)) for a, b in sentences(text)]
    for m in re.finditer(ISO_DATE, text):
        try:
            date.fromisoformat(m[0])
        except ValueError:
            continue
        a, b = sentence_around(text, *m.span())
        if not any(c[0] == "date" and c[1:4] == (m[0], a, b) for c in found):
            found.append(("date", m[0], a, b, "", origin(text, *m.span())))
    return _in_bytes(text, found)


# What stands before a located line's channel, and the origin that a channel gives.
LOCATED = ("PPTX ", "DOCX ", "XLSX ", "PHOTO ", "VIDEO FRAME ", "PDF ")
ORIGINS = {
    "main_document": "document_body", "pdf_text": "pdf_text", "table": "table_cell", "cell": "table_cell", "cached_formula_value": "cached_formula_value", "slide_text": "slide_visible",
    "slide_text_table": "slide_table_cell", "speaker_notes": "speaker_note", "observed_pixels": "observed_pixels", "file_metadata": "file_metadata", "supplied_caption": "supplied_caption",
    "ocr": "ocr", "generated_interpretation": "generated_interpretation",
}


def located(line: str) -> tuple[str, int] | None:
    """(channel, start of the text) of a located line: [PDF ...; channel=x] text."""
    end = line.find("] ")
    marker = line[1:end] if end > 0 else ""
    if not marker.startswith(LOCATED) or "; channel=" not in marker:
        return None
    return marker.rpartition("; channel=")[2], end + 2


def qualifiers_in(text: str) -> str:
    return "; ".join(m[0].strip().rstrip(",") for m in re.finditer(f"(?i){QUALIFIERS}", text))


def statements_in(text: str) -> list[Candidate]:
    """What located lines state, with the origin and qualification that their channel and wording give."""
    found, at = [], 0
    for line in text.split("\n"):
        channel, start = located(line) or (None, 0)
        body = line[start:].strip()
        if channel in ORIGINS and body:
            own = at + start + len(line[start:]) - len(line[start:].lstrip())
            told = qualifiers_in(body)
            if line.startswith("[PDF ") and channel == "ocr":
                told = f"OCR transcription; unverified{f'; {told}' if told else ''}"
            elif channel == "cached_formula_value":
                told = STALE_FORMULA
            elif line.startswith(("[PHOTO ", "[VIDEO FRAME ")):
                told = {"observed_pixels": "", "ocr": "recognised text, unverified"}.get(channel, f"{channel.replace('_', ' ')}, unverified")
            found.append(("photo_statement" if line.startswith(("[PHOTO ", "[VIDEO FRAME ")) else "statement", body, own, own + len(body), told, ORIGINS[channel]))
        at += len(line) + 1
    return _in_bytes(text, found)


_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def iso_day(value: str) -> str | None:
    """A day written as numbers or with a month's name, if the calendar has it."""
    words = value.replace(",", " ").split()
    try:
        year, month, day = (words[2], 1 + _MONTHS.index(words[0][:3].lower()), words[1]) if len(words) == 3 else value.strip().split("-")
        return date(int(year), int(month), int(day)).isoformat()
    except (ValueError, IndexError):
        return None


def ordering_in(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, value, start, end) of days and revision numbers that may date a report; none in photographs and sampled frames, no revision in recognised text."""
    if text.startswith("[PHOTO "):
        return []
    at, out = bytes_at(text), []

    def line_before(place: int) -> str:
        return text[text.rfind("\n", 0, place) + 1 : place]

    for m in re.finditer(REPORT_DATE, text):
        if not line_before(m.start()).startswith("[VIDEO FRAME ") and (day := iso_day(m[0])):
            out.append(("date", day, at(m.start()), at(m.end())))
    for m in re.finditer(REVISION, text):
        line = line_before(m.start())
        recognised = text.startswith("[PDF ") and " (OCR transcription;" in line
        if not line.startswith("[VIDEO FRAME ") and not recognised and int(m[1]) > 0:
            out.append(("revision", str(int(m[1])), at(m.start()), at(m.end())))
    return sorted(out, key=lambda c: c[2:])


def _rows(texts: DataFrame, find: Callable[[str], list[tuple]], columns: str) -> DataFrame:
    """texts (source_id, text) with a row per tuple that is found, numbered, and whether a text has over MAX_CANDIDATES."""
    names = ["source_id", *(c.split()[0] for c in columns.split(", ")), "position", "incomplete"]

    def each(batches):
        for batch in batches:
            rows = []
            for source, text in zip(batch["source_id"], batch["text"], strict=True):
                own = find(text or "")
                rows += [(source, *c, n, len(own) > MAX_CANDIDATES) for n, c in enumerate(own, 1)]
            yield pd.DataFrame(rows, columns=names)

    ship(texts.sparkSession)
    return texts.select("source_id", "text").mapInPandas(each, f"source_id string, {columns}, position int, incomplete boolean")


_CANDIDATE = "kind string, value string, start long, end long, qualifier string, origin string"


def candidates(texts: DataFrame) -> DataFrame:
    """(source_id, kind, value, start, end, qualifier, origin, position, incomplete) of texts (source_id, text).

    Every candidate is given; a text with more than MAX_CANDIDATES is marked incomplete.
    """
    return _rows(texts, candidates_in, _CANDIDATE)


def documents(texts: DataFrame) -> DataFrame:
    """candidates() of decision records, open questions and located lines."""
    return _rows(texts, lambda text: decisions_in(text) + questions_in(text) + statements_in(text), _CANDIDATE)


def prose(texts: DataFrame) -> DataFrame:
    """candidates() of ordinary prose."""
    return _rows(texts, prose_in, _CANDIDATE)


def corrections(texts: DataFrame) -> DataFrame:
    """(source_id, event, property, previous, value, start, end, origin, position, incomplete) of texts (source_id, text)."""
    return _rows(texts, corrections_in, "event string, property string, previous string, value string, start long, end long, origin string")


def ordering(texts: DataFrame) -> DataFrame:
    """(source_id, kind, value, start, end, position, incomplete): days and revisions that may order versions."""
    return _rows(texts, ordering_in, "kind string, value string, start long, end long")


def spans(texts: DataFrame) -> DataFrame:
    """(source_id, position, start, end, text): one row per sentence, in bytes."""

    def each(batches):
        for batch in batches:
            rows = []
            for source, text in zip(batch["source_id"], batch["text"], strict=True):
                at = bytes_at(text or "")
                rows += [(source, n, at(a), at(b), text[a:b]) for n, (a, b) in enumerate(sentences(text or ""), 1)]
            yield pd.DataFrame(rows, columns=["source_id", "position", "start", "end", "text"])

    ship(texts.sparkSession)
    return texts.select("source_id", "text").mapInPandas(each, "source_id string, position int, start int, end int, text string")


def dates_in_spans(found: DataFrame, dates: DataFrame) -> DataFrame:
    """Dates (source_id, at, until, value) inside the spans (source_id, position, start, end) of their source.

    Spans do not overlap: a date is in the last span that begins at or before it, if in any. One pass
    over each source's spans and dates in order finds it, so no span meets all dates.
    """
    none = F.lit(None)
    rows = found.select("source_id", F.col("start").cast("long").alias("place"), F.lit(0).alias("is_date"), F.struct("position", F.col("end").cast("long").alias("end")).alias("span"), none.cast("string").alias("value"), none.cast("long").alias("until"))
    rows = rows.unionByName(dates.select("source_id", F.col("at").cast("long").alias("place"), F.lit(1).alias("is_date"), none.cast(rows.schema["span"].dataType).alias("span"), F.col("value").cast("string"), F.col("until").cast("long")))
    last = Window.partitionBy("source_id").orderBy("place", "is_date").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("span", F.last("span", True).over(last)).where("is_date = 1 AND until <= span.end")
    return rows.select("source_id", "span.position", "value", F.col("place").alias("at"), "until")


def hashtags(text: Column) -> Column:
    """The distinct hashtags of a text, without their signs."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)#([\p{L}\p{N}_-]+)\b"), F.lit(1)))


def qualification(text: Column) -> Column:
    """The qualifying phrases of a text, in order, joined by semicolons; null without any."""
    words = F.regexp_extract_all(text, F.lit(f"(?iU){QUALIFIERS}"), F.lit(0))
    return F.when(F.size(words) > 0, F.array_join(F.transform(words, lambda w: F.rtrim(F.trim(w), F.lit(","))), "; "))


def merged_persons(mentions: DataFrame) -> DataFrame:
    """Person mentions (source_id, value, start, end) whose spans overlap and whose names agree, ASCII case aside, as one."""
    by = Window.partitionBy("source_id", "name").orderBy("start", "end")
    rows = mentions.withColumn("name", fold("value")).withColumn("through", F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("group_", F.sum(F.when(F.col("start") < F.col("through"), 0).otherwise(1)).over(by))
    return rows.groupBy("source_id", "name", "group_").agg(F.min_by("value", "start").alias("value"), F.min("start").alias("start"), F.max("end").alias("end")).drop("group_", "name")


def same_names(mentions: DataFrame) -> DataFrame:
    """(source_id, value, mentions): classes of person mentions of one name, ASCII case aside, instead of their pairs."""
    return mentions.groupBy("source_id", fold("value").alias("name")).agg(F.min_by("value", "start").alias("value"), F.count("*").alias("mentions")).drop("name")


def accepted(found: DataFrame, judgments: DataFrame) -> DataFrame:
    """Candidates whose judgment (source_id, position, probability, corroborated) reaches their kind's threshold; persons need corroboration in the text too."""
    least = F.when(F.col("kind") == "event", EVENT).when(F.col("kind") == "person", PERSON).otherwise(SUPPORT)
    rows = found.join(judgments, ["source_id", "position"])
    return rows.where((F.col("probability") >= least) & ((F.col("kind") != "person") | F.coalesce("corroborated", F.lit(False))))


# The properties that candidates give facts of.
_PROPERTY = {"date": "event_date", "unknown_date": "event_date", "count": "visit_count", "duration": "duration"}


def facts(taken: DataFrame, subject: Column) -> DataFrame:
    """(subject, property, value, start, end, qualifier) of accepted dates, counts and durations."""
    names = F.create_map(*(F.lit(x) for p in _PROPERTY.items() for x in p))
    return taken.where(F.col("kind").isin(*_PROPERTY)).select(subject.alias("subject"), names[F.col("kind")].alias("property"), "value", "start", "end", "qualifier")


def relationships(taken: DataFrame, subject: Column, observed: bool = True) -> DataFrame:
    """(from_page_id, kind, to_label, qualifier): observers and places of an event."""
    kind = F.when(F.col("kind") == "person", "observed_by" if observed else "attended_by").otherwise("occurred_at")
    return taken.where(F.col("kind").isin("person", "place")).select(subject.alias("from_page_id"), kind.alias("kind"), F.col("value").alias("to_label"), "qualifier")


def speech_acts(segments: DataFrame, judgments: DataFrame) -> DataFrame:
    """Spoken segments (segment_id, text) as question, decision or reasoning where judged (segment_id, act, probability), else as spoken messages."""
    act = F.when(F.col("probability") >= SUPPORT, F.col("act")).otherwise("spoken_message")
    return segments.join(judgments, "segment_id", "left").select("segment_id", "text", act.alias("act"))


def update_roles(text: Column) -> Column:
    """The update role that a text's wording proposes, for a judgment to confirm."""
    return (
        F.when(text.rlike(r"(?i)\b(replaces|supersedes) (the|all) (previous|earlier)\b|\bcomplete replacement\b"), "complete_replacement")
        .when(text.rlike(r"(?i)\bcorrection\b|\bnot\s+[0-9]+\b"), "targeted_correction")
        .when(text.rlike(r"(?i)\b(in addition|supplement)\b"), "supplement")
        .when(text.rlike(r"(?i)\b(if|unless) confirmed\b"), "conditional")
        .otherwise("unknown")
    )


def statements(lines: DataFrame) -> DataFrame:
    """(path, position, channel, text, heading, occurrence): located lines under their nearest heading above, repeated openings numbered."""
    above = Window.partitionBy("path").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    opening = F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, 2), " ")
    rows = lines.where("text IS NOT NULL").withColumn("heading", F.last(F.when(F.col("channel") == "heading", F.col("text")), True).over(above)).withColumn("opening", opening)
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy("path", "opening").orderBy("position"))).select("path", "position", "locator", "channel", "text", "heading", "opening", "occurrence")


# Words that a statement's subject does not begin with, or ends before.
NO_SUBJECT = (
    "a", "an", "the", "this", "that", "these", "those", "unconfirmed", "unverified", "provisional", "conditional", "reported", "possibly", "estimated", "is", "are", "was", "were", "be", "been", "being",
    "left", "remains", "remained", "measured", "measures", "recorded", "reports", "shows", "showed", "suggests", "suggested", "confirms", "confirmed", "indicates", "indicated", "occurred", "happened", "has", "have", "had",
)


def plain_slug(value: str) -> str:
    return "-".join("".join(c.lower() if c.isalnum() else " " for c in value).split())


def subject_of(text: str) -> str:
    """The first three words of a statement's subject; numbers and words before the subject do not count."""
    words: list[str] = []
    for word in re.findall(r"(?:[^\W_]|-)+", text):
        word = word.lower()
        if word.isnumeric() or (word in NO_SUBJECT and not words):
            continue
        if word in NO_SUBJECT or len(words) == 3:
            break
        words.append(word)
    return "-".join(words)


def _object(marker: str) -> str:
    """The identity that a package gives a paragraph or shape, with its part."""
    found = re.search(r"OOXML part (\S+) (?:.*?)(paragraph id |shape id )(\S+)", marker)
    return f"{found[1]}:{found[2]}{found[3]}" if found else ""


def keys_in(text: str) -> list[tuple[int, str]]:
    """(line, record key) of located lines that have one: an identity that stays when what they state changes.

    Sheet cells go by their place; PDF lines by page, column, first two words and how often these came
    before; package objects by their identity under the nearest heading; table rows and slide fields by
    field and subject; what is left by its subject.
    """
    heading, seen, out = "", {}, []
    for n, line in enumerate(text.split("\n"), 1):
        channel, start = located(line) or (None, 0)
        body = line[start:].strip()
        if channel not in ORIGINS or not body:
            continue
        kind, _, marker = line[1 : start - 2].partition(" ")
        place, under, key = marker.rpartition("; channel=")[0], plain_slug(heading), ""
        field, colon, subject = body.split(";")[0].partition(":")
        if kind == "PDF":
            page, column = place.split(" region ")[0], re.search(r"; column=([^;]*)", place)
            if column:
                prefix = plain_slug(" ".join(body.split(" (OCR transcription;")[0].split()[:2]))
                seen[page, column[1], prefix] = seen.get((page, column[1], prefix), 0) + 1
                key = f"pdf:{plain_slug(page)}:column-{column[1]}:{prefix}:occurrence-{seen[page, column[1], prefix]}"
        elif kind == "XLSX":
            key = f"spreadsheet:{hashlib.sha256(place.encode()).hexdigest()}"
        elif _object(place) and channel != "slide_text_table":
            key = f"office-object:{under}:{channel}:{plain_slug(_object(place))}"
        elif channel in ("table", "slide_text_table") and not colon:
            continue
        elif channel in ("table", "slide_text_table") and plain_slug(field) and plain_slug(subject):
            key = f"office-field:{channel}:{under}:{plain_slug(_object(place))}:{plain_slug(field)}-{plain_slug(subject)}"
        elif channel.startswith("slide_text") and ":" in body and plain_slug(body.split(":")[0]):
            key = f"office-slide-field:{under}:{plain_slug(body.split(':')[0])}"
        elif subject_of(body):
            key = f"office-subject:{channel}:{under}:{subject_of(body)}"
        if key:
            out.append((n, key))
        if channel == "main_document" and ("style Title" in place or "style Heading" in place):
            heading = body
    return out


def keys(texts: DataFrame) -> DataFrame:
    """(source_id, line, record_key) of texts (source_id, text); see keys_in()."""
    return _rows(texts, keys_in, "line int, record_key string").select("source_id", "line", "record_key")


def _numbered(part: pd.DataFrame) -> pd.DataFrame:
    used, labels = set(), []
    part = part.sort_values("position")
    for label in part["label"]:
        n, name = 2, label
        while name.lower() in used:
            name, n = f"{label} ({n})", n + 1
        used.add(name.lower())
        labels.append(name)
    return part.assign(label=labels)[["source_id", "position", "label"]]


def distinct_labels(entities: DataFrame) -> DataFrame:
    """Labels of entities (source_id, position, label) that an earlier one of the source has, case aside, get (2), (3) and so on, in order.

    A numbered label may be one that the source gives itself. Only such sources are gone through
    label by label; the others need a count alone.
    """
    ship(entities.sparkSession)
    n = F.row_number().over(Window.partitionBy("source_id", F.lower("label")).orderBy("position"))
    rows = entities.select("source_id", "position", "label", n.alias("n"))
    made = F.when(F.col("n") == 1, F.col("label")).otherwise(F.concat("label", F.lit(" ("), F.col("n").cast("string"), F.lit(")")))
    given = entities.select("source_id", F.lower("label").alias("made")).distinct()
    clash = rows.where("n > 1").select("source_id", F.lower(made).alias("made")).join(given, ["source_id", "made"], "left_semi").select("source_id").distinct()
    plain = rows.join(clash, "source_id", "left_anti").select("source_id", "position", made.alias("label"))
    types = {c: entities.schema[c].dataType.simpleString() for c in ("source_id", "position")}
    again = entities.join(clash, "source_id", "left_semi").select("source_id", "position", "label")
    return plain.unionByName(again.groupBy("source_id").applyInPandas(_numbered, f"source_id {types['source_id']}, position {types['position']}, label string"))


def rejected(claims: DataFrame, lines: DataFrame) -> DataFrame:
    """Claims (path, quote, channel, property) that no acquired line (path, text, channel) holds on their channel."""
    held = claims.join(lines.select("path", "channel", "text"), ["path", "channel"]).where(F.contains("text", "quote")).select(*claims.columns).distinct()
    return claims.join(held, claims.columns, "left_anti")
