"""Conversation exports to located messages, as DataFrames."""

from __future__ import annotations

from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import linked_urls, percent_field
from docketry.session import ship

# Fixed values.
MAX_BYTES, MAX_MESSAGES, MAX_ROLLOUT_ROWS = 8 << 20, 1000, 4000
CHANNELS = {
    "user": "user_message", "assistant": "assistant_message", "assistant_tool_call": "tool_call", "tool": "tool_output",
    "reasoning": "reasoning_summary", "system": "system_message", "developer": "developer_message",
}
EXPORT = "struct<format:string,conversation_id:string,title:string,messages:array<struct<id:string,role:string,author:string,date:string,content:string>>>"
ROLLOUT = (
    "struct<timestamp:string,type:string,payload:struct<id:string,type:string,role:string,author:string,name:string,call_id:string,arguments:string,output:string,"
    "content:array<struct<type:string,text:string>>,summary:array<struct<type:string,text:string>>>>"
)
#: The end of the format field of exports that are understood.
FORMAT = "conversation-v1"
_RFC = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def channel(role: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in CHANNELS.items() for x in pair))
    return F.coalesce(names[role], F.lit("unknown_message"))


def percent_encoded(column: Column) -> Column:
    def each(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else percent_field(v))

    each.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(each, "string")(column)


def urls(column: Column) -> Column:
    def each(values: pd.Series) -> pd.Series:
        return values.map(lambda v: linked_urls(v or ""))

    each.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(each, "array<string>")(column)


def messages(exports: DataFrame) -> DataFrame:
    """Messages of JSON exports (path, body): session, message, position, role, author, date, channel, text, gap.

    At most MAX_MESSAGES a conversation, none of an export over MAX_BYTES; a row without message and
    text says so in its gap, at the position where reading ended. Of equal ids the first stays; a
    message without usable content has a gap and no text. Unknown roles, dates and authors are "unknown".
    """
    over = F.octet_length("body") > MAX_BYTES
    read = exports.select("path", over.alias("over"), F.from_json(F.when(~over, F.col("body")), EXPORT).alias("e"))
    read = read.where(F.col("over") | F.endswith(F.col("e.format"), F.lit(FORMAT)) & (F.trim("e.conversation_id") != ""))
    some = F.slice("e.messages", 1, MAX_MESSAGES + 1)
    rows = read.select("path", "over", F.col("e.conversation_id").alias("session"), F.size("e.messages").alias("n"), F.posexplode(F.when(F.col("over"), F.array(F.get(some, F.lit(0)))).otherwise(some)).alias("at", "m"))
    left_out = F.when(F.col("over"), F.lit(f"export over {MAX_BYTES} bytes, no message read")).when(F.col("at") == MAX_MESSAGES, F.concat(F.lit(f"only the first {MAX_MESSAGES} of "), F.col("n").cast("string"), F.lit(" messages read")))
    empty = F.lit(None).cast("string")
    return described(rows.select("path", "session", (F.col("at") + 1).alias("position"), *(F.when(left_out.isNull(), F.col(f"m.{k}")).otherwise(empty).alias(k) for k in ("id", "role", "author", "date", "content")), left_out.alias("left_out")))


def described(rows: DataFrame) -> DataFrame:
    """The columns of messages(), without its limits: a row per row (path, session, position, id, role, author, date, content, left_out).

    left_out, null for a message, is the gap of a row that stands for what was not read.
    """
    named = F.when(F.trim("id") != "", F.col("id"))
    message = F.when(F.col("left_out").isNull(), F.coalesce(named, F.concat(F.lit("entry-"), F.col("position").cast("string"))))
    rows = rows.withColumns({"message": message, "unnamed": named.isNull()})
    first = F.min("position").over(Window.partitionBy("path", "session", "message"))
    rows = rows.withColumn("repeated", F.col("position") > first)
    known = F.col("role").isin(*CHANNELS)
    dated = F.when(F.col("date").rlike(_RFC) & F.try_to_timestamp(F.upper("date")).isNotNull(), F.col("date"))
    supplied = F.col("date").isNotNull() & ~F.col("date").isin("", "unknown")
    gap = F.concat_ws("; ", F.when(F.col("repeated"), "duplicate identity"), F.when(F.col("unnamed"), "no identity"), F.when(F.col("content").isNull(), "no text"), F.when(~F.coalesce(known, F.lit(False)), "unsupported role"), F.when(supplied & dated.isNull(), "malformed date"))
    role = F.when(known, F.col("role")).otherwise("unknown")
    return rows.select(
        "path", "session", "message", "position", role.alias("role"), F.coalesce("author", F.lit("unknown")).alias("author"), F.coalesce(dated, F.lit("unknown")).alias("date"),
        channel(role).alias("channel"), F.when(~F.col("repeated"), F.col("content")).alias("text"), F.coalesce("left_out", F.when(gap != "", gap)).alias("gap"),
    )


def rollout(lines: DataFrame) -> DataFrame:
    """Messages of JSONL rollouts (path, line, value), in the columns of messages().

    Tool outputs take the name of the call with their call_id. A path with several session ids, or
    none, gives nothing; rows after MAX_ROLLOUT_ROWS are not read.
    """
    read = lines.where(F.col("line") <= MAX_ROLLOUT_ROWS).select("path", "line", F.from_json("value", ROLLOUT).alias("r"))
    sessions = read.where("r.type = 'session_meta'").where(F.trim("r.payload.id") != "").groupBy("path").agg(F.countDistinct("r.payload.id").alias("n"), F.min("r.payload.id").alias("session")).where("n = 1")
    items = read.where("r.type = 'response_item'").select("path", "line", F.col("r.timestamp").alias("at"), "r.payload.*")
    calls = items.where("type = 'function_call'").groupBy("path", "call_id").agg(F.min_by("name", "line").alias("called"))
    items = items.join(calls, ["path", "call_id"], "left").join(sessions.select("path", "session"), "path")
    joined = lambda c: F.array_join(F.filter(F.transform(c, lambda x: x["text"]), lambda t: t.isNotNull()), "\n")
    role = F.when(F.col("type") == "function_call", "assistant_tool_call").when(F.col("type") == "function_call_output", "tool").when(F.col("type") == "reasoning", "reasoning").when(F.col("role").isin(*CHANNELS), F.col("role")).otherwise("unknown")
    text = F.when(F.col("type") == "function_call", F.concat_ws(" ", "name", "arguments")).when(F.col("type") == "function_call_output", F.concat_ws(": ", "called", "output")).when(F.col("type") == "reasoning", joined(F.col("summary"))).otherwise(joined(F.col("content")))
    position = F.row_number().over(Window.partitionBy("path").orderBy("line"))
    dated = F.when(F.col("at").rlike(_RFC), F.col("at")).otherwise("unknown")
    named = F.coalesce(F.when(F.trim("id") != "", F.col("id")), F.concat(F.lit("entry-"), F.col("line").cast("string")))
    out = items.select("path", "session", named.alias("message"), position.alias("position"), role.alias("role"), F.coalesce("author", F.lit("unknown")).alias("author"), dated.alias("date"), text.alias("text"))
    return out.select("path", "session", "message", "position", "role", "author", "date", channel(F.col("role")).alias("channel"), "text", F.when(F.col("text").isNull() | (F.col("text") == ""), "no text").alias("gap"))


def supported(lines: DataFrame) -> DataFrame:
    """(path, supported): JSONL files (path, value) with a session id and a message or call are conversations; others are ordinary files."""
    r = F.from_json("value", ROLLOUT)
    rows = lines.select("path", ((r["type"] == "session_meta") & (F.trim(r["payload"]["id"]) != "")).alias("s"), ((r["type"] == "response_item") & r["payload"]["type"].isin("message", "function_call")).alias("m"))
    return rows.groupBy("path").agg((F.coalesce(F.bool_or("s"), F.lit(False)) & F.coalesce(F.bool_or("m"), F.lit(False))).alias("supported"))


def located(found: DataFrame) -> DataFrame:
    """(path, position, line): each message as one line behind its percent-encoded locator."""
    ship(found.sparkSession)
    text = F.replace(F.replace("text", F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))
    parts = [("session", F.col("session").cast("string")), ("message", F.col("message").cast("string")), ("order", F.col("position").cast("string")), ("role", F.col("role")), ("author", F.col("author")), ("date", F.col("date")), ("channel", F.col("channel"))]
    locator = F.when(F.col("session").isNotNull(), F.concat_ws("; ", *(F.concat(F.lit(f"{k}="), v if k in ("order", "channel") else percent_encoded(v)) for k, v in parts)))
    return found.where("text IS NOT NULL").select("path", "position", F.concat(F.lit("[CONVERSATION "), locator, F.lit("] "), text).alias("line"))


def parse_located(line: str) -> dict | None:
    """The fields of a located line, or None if a key is missing, repeated or unknown."""
    head, end, text = line.partition("] ")
    if not end or not head.startswith("[CONVERSATION "):
        return None
    pairs = [p.partition("=") for p in head[len("[CONVERSATION ") :].split("; ")]
    keys = ["session", "message", "order", "role", "author", "date", "channel"]
    if sorted(k for k, _, _ in pairs) != sorted(keys):
        return None
    return {k: unquote(v) for k, _, v in pairs} | {"text": text}


def parsed(lines: DataFrame) -> DataFrame:
    """located() lines (path, position, line) read back: session, message, order, role, author, date, channel, text; other lines are left out."""
    keys = ["session", "message", "order", "role", "author", "date", "channel", "text"]

    def each(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_located(v or "") or dict.fromkeys(keys) for v in values], columns=keys)

    each.__annotations__ = {"values": pd.Series, "return": pd.DataFrame}
    ship(lines.sparkSession)
    rows = lines.select("path", F.pandas_udf(each, ", ".join(f"{k} string" for k in keys))("line").alias("p"))
    return rows.select("path", "p.*").where("session IS NOT NULL")


def knowledge(found: DataFrame, intents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, edges): messages whose judged intent (session, message, intent, score) is certain enough become pages of their conversation."""
    judged = found.where("text IS NOT NULL").join(intents, ["session", "message"], "left")
    intent = F.when(F.col("score") >= 0.85, F.col("intent")).otherwise("uncertain")
    pages = judged.select(F.concat_ws("-", F.lit("page-message"), "session", "message").alias("page_id"), F.concat(F.lit("page-conversation-"), "session").alias("conversation"), "role", intent.alias("intent"), "date")
    return pages, pages.select(F.col("page_id").alias("from_page_id"), F.col("conversation").alias("to_page_id"), F.lit("message_in_conversation").alias("kind"))
