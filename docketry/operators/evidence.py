"""Evidence: byte spans, windows of long texts, and what staged chunks add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of one source's aggregate. Fixed values.
LIMITS = {"entities": 500, "facts": 2000, "relationships": 2000, "tags": 2000, "decisions": 4096}
MAX_BYTES = 8 << 20


def quote_holds(text: Column, quote: Column, start: Column, end: Column) -> Column:
    """Whether the bytes of the text from start to end are the quote."""
    raw = F.encode(text, "UTF-8")
    fits = (start >= 0) & (end >= start) & (end <= F.octet_length(text))
    return F.coalesce(fits & (F.substring(raw, start + 1, end - start) == F.encode(quote, "UTF-8")), F.lit(False))


def rebase(drafts: DataFrame) -> DataFrame:
    """Evidence of windows (draft_id, window, base, quote, start, end) in the whole text's bytes; a draft with any wrong span is rejected whole."""
    held = drafts.withColumn("holds", quote_holds(F.col("window"), F.col("quote"), F.col("start"), F.col("end")))
    good = held.groupBy("draft_id").agg(F.bool_and("holds").alias("accepted"))
    return held.join(good, "draft_id").where("accepted").select("draft_id", "quote", (F.col("base") + F.col("start")).alias("start"), (F.col("base") + F.col("end")).alias("end"))


def windows(texts: DataFrame, size: int = 32 << 10, overlap: int = 1 << 10) -> DataFrame:
    """(source_id, start, end, context_start, text): UTF-8 windows of texts (source_id, text), see functions.text.utf8_windows."""
    import pandas as pd

    from docketry.functions.text import utf8_windows
    from docketry.session import ship

    ship(texts.sparkSession)

    def each(batches):
        for batch in batches:
            for source, text in zip(batch["source_id"], batch["text"], strict=True):
                rows = utf8_windows((text or "").encode(), size, overlap)
                if rows:
                    yield pd.DataFrame(rows).assign(source_id=source)[["source_id", "start", "end", "context_start", "text"]]

    return texts.select("source_id", "text").mapInPandas(each, "source_id string, start long, end long, context_start long, text string")


def contiguous(records: DataFrame, key: str = "part_id", size: str | None = None) -> DataFrame:
    """(key, complete): whether records (key, start, end) follow each other from 0 without holes, up to the stated size if there is one.

    Records are a chain if as many begin as end at every point, but for one more that begins at 0 and
    one more that ends at the last: counted, not sorted, so a part of any size is spread over tasks.
    Empty records may stand at points of the chain; null and backward spans belong to none.
    """
    good, empty = F.coalesce(F.col("start") <= F.col("end"), F.lit(False)), F.coalesce(F.col("start") == F.col("end"), F.lit(False))
    ends = F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))
    total = F.col(size) if size else F.lit(None).cast("long")
    points = records.select(key, total.alias("size_"), good.alias("good"), empty.alias("empty"), F.explode(ends).alias("e")).select(key, "size_", "good", "empty", "e.*")
    at = points.groupBy(key, "at").agg(F.sum(F.when(F.col("empty"), 0).otherwise(F.col("d"))).alias("d"), F.bool_and("good").alias("good"), F.bool_or(~F.col("empty")).alias("on_chain"), F.bool_or("empty").alias("empty"), F.max("size_").alias("size_"))
    # Spans run forward, so with these excesses all of them lie on one path, from 0 to the one point of -1.
    fits = F.col("good") & (~F.col("empty") | F.col("on_chain") | (F.col("at") == 0)) & F.when(F.col("at") == 0, F.col("d").isin(0, 1)).otherwise(F.col("d").isin(0, -1))
    whole = at.groupBy(key).agg(F.bool_and(F.coalesce(fits, F.lit(False))).alias("fits"), F.count_if(F.col("d") > 0).alias("begun"), F.count_if(F.col("d") < 0).alias("ended"), F.count_if(F.col("on_chain")).alias("chain"), F.min("at").alias("first"), F.max("at").alias("last"), F.max("size_").alias("size_"))
    one = F.when(F.col("chain") > 0, (F.col("begun") == 1) & (F.col("ended") == 1)).otherwise(F.lit(True))
    sized = F.coalesce(F.col("last") == F.col("size_"), F.lit(False)) if size else F.lit(True)
    return whole.select(key, F.coalesce(F.col("fits") & one & (F.col("first") == 0) & sized, F.lit(False)).alias("complete"))


def aggregate(drafts: DataFrame) -> DataFrame:
    """One row per source from staged drafts (source_id, start, end, entities, facts, relationships, tags, decisions, update).

    Drafts must be contiguous and within LIMITS and MAX_BYTES, entities (kind, label) keep their first
    mention, and the drafts must agree on one update; otherwise `problem` says what is wrong.
    """
    chain = contiguous(drafts, "source_id")
    sums = drafts.groupBy("source_id").agg(
        *(F.sum(F.size(k)).alias(f"n_{k}") for k in LIMITS if k != "entities"), (F.max("end") - F.min("start")).alias("bytes"), F.collect_set("update").alias("updates"),
    )
    mentions = drafts.select("source_id", "start", F.posexplode("entities").alias("position", "entity"))
    first = mentions.groupBy("source_id", F.col("entity.kind").alias("kind"), F.col("entity.label").alias("label")).agg(F.min(F.struct("start", "position")).alias("first"))
    entities = first.groupBy("source_id").agg(F.count("*").alias("n_entities"))
    rows = sums.join(chain, "source_id").join(entities, "source_id", "left").withColumn("n_entities", F.coalesce("n_entities", F.lit(0)))
    problem = F.when(~F.col("complete"), "gap").when(F.col("bytes") > MAX_BYTES, "bytes")
    for k, most in LIMITS.items():
        problem = problem.when(F.col(f"n_{k}") > most, k)
    problem = problem.when(F.size("updates") > 1, "update")
    return rows.select("source_id", *(f"n_{k}" for k in LIMITS), "bytes", F.get("updates", F.lit(0)).alias("update"), problem.alias("problem"))


def commit(staged: DataFrame, stored: DataFrame, key: list[str], payload: str) -> tuple[DataFrame, DataFrame]:
    """(to append, conflicts): immutable records by key; repeating a record changes nothing, other content under a stored key conflicts."""
    fresh = staged.dropDuplicates([*key, payload]).join(stored.select(*key), key, "left_anti")
    clash = staged.join(stored.select(*key, F.col(payload).alias("stored_")), key).where(F.col(payload) != F.col("stored_")).drop("stored_")
    return fresh, clash


def chained(drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(content, entities) of the sources whose aggregate() has no problem.

    content: source_id, text, the drafts' texts joined in order. entities: source_id, kind, label,
    start, each once, where it was first mentioned. Aggregates are within LIMITS and MAX_BYTES, so
    a source's text and entities fit a row and a group.
    """
    good = aggregate(drafts).where("problem IS NULL").select("source_id")
    kept = drafts.join(good, "source_id", "left_semi")
    parts = kept.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("parts"))
    mentions = kept.select("source_id", "start", F.posexplode("entities").alias("position", "entity"))
    first = mentions.groupBy("source_id", F.col("entity.kind").alias("kind"), F.col("entity.label").alias("label")).agg(F.min(F.struct("start", "position")).alias("first"))
    return parts.select("source_id", F.array_join(F.col("parts.text"), "").alias("text")), first.select("source_id", "kind", "label", F.col("first.start").alias("start"))


def holds_bytes(records: DataFrame, needle: bytes) -> DataFrame:
    """(part_id, found): whether the stored records (part_id, start, data) of a part hold a byte string, across records too.

    Records are dealt by ranges of part and start, so a long part is read by several tasks; each streams
    its stretches and passes on their first and last bytes, as many as a match across an end may need.
    Null data are empty.
    """
    import pandas as pd

    from docketry.session import ship

    ship(records.sparkSession)
    more = max(0, len(needle) - 1)
    part_type = records.schema["part_id"].dataType.simpleString()

    def stretches(batches):
        part, start, head, tail, found = None, None, b"", b"", False
        long = began = False

        def told():
            return (part, start, found, [head, tail] if long else [head])

        for batch in batches:
            rows = []
            for now, at, data in zip(batch["part_id"], batch["start"], batch["data"], strict=True):
                data = bytes(data or b"")
                if not began or now != part:
                    rows += [told()] if began else []
                    part, start, head, tail, found, long, began = now, at, b"", b"", not needle, False, True
                found = found or needle in tail + data
                if not long:
                    # A short stretch is passed on whole; a longer one keeps its two ends.
                    head += data
                    if len(head) > 2 * more:
                        head, long = head[:more], True
                tail = (tail + data)[-more:] if more else b""
            yield pd.DataFrame(rows, columns=["part_id", "start", "found", "ends"])
        if began:
            yield pd.DataFrame([told()], columns=["part_id", "start", "found", "ends"])

    def across(stretches: pd.Series) -> pd.Series:
        def one(rows: list) -> bool:
            run = b""
            for row in rows:
                run += bytes(row["ends"][0])
                if needle in run:
                    return True
                run = bytes(row["ends"][1]) if len(row["ends"]) == 2 else run
            return needle in run

        return stretches.map(one)

    across.__annotations__ = {"stretches": pd.Series, "return": pd.Series}
    ordered = records.where("part_id IS NOT NULL").select("part_id", "start", "data").repartitionByRange("part_id", "start").sortWithinPartitions("part_id", "start")
    found = ordered.mapInPandas(stretches, f"part_id {part_type}, start {records.schema['start'].dataType.simpleString()}, found boolean, ends array<binary>")
    whole = found.groupBy("part_id").agg(F.bool_or("found").alias("found"), F.array_sort(F.collect_list(F.struct("start", "ends"))).alias("ends"))
    return whole.select("part_id", (F.col("found") | F.pandas_udf(across, "boolean")("ends")).alias("found"))


def percentiles(samples: DataFrame, column: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(share, value): the sample at position floor((n - 1) * share) of the sorted ones, from counts of the distinct values."""
    kind = samples.schema[column].dataType.simpleString()
    n = samples.where(F.col(column).isNotNull()).count()
    if not n:
        return samples.sparkSession.createDataFrame([], f"share double, value {kind}")
    at = [int((n - 1) * round(100 * s)) // 100 for s in shares]
    wanted = F.array(*(F.lit(s) for s in shares))
    values = samples.agg(F.percentile(column, F.array(*(F.lit(k / (n - 1) if n > 1 else 0.0) for k in at))).alias("v"))
    return values.select(F.explode(F.arrays_zip(wanted.alias("share"), F.col("v").alias("value"))).alias("p")).select("p.share", F.round("p.value", 9).cast(kind).alias("value"))
