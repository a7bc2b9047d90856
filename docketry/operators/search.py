"""Keyword and vector search; filters come before ranking."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import chunk_key, fold, is_true, normalized_tag
from docketry.session import shared_dir, ship

CUTOFF = 0.45
PAGE_SIZE = 50
#: Bytes of a block of queries, which all tasks get, and queries that a task scores at once.
BLOCK_BYTES, TILE = 32 << 20, 512


@dataclass(frozen=True)
class Filters:
    """Tags match if any does; formats match whatever their case; dates are inclusive and must be there."""

    tags: tuple[str, ...] = field(default_factory=tuple)
    date_from: str | None = None
    date_to: str | None = None
    format: str | None = None
    processing_status: str | None = None

    def apply(self, pages: DataFrame, tags: DataFrame) -> DataFrame:
        if self.tags:
            wanted = [t.strip().lstrip("#").lower() for t in self.tags]
            pages = pages.join(tags.where(normalized_tag("normalized").isin(wanted)).select("page_id"), "page_id", "left_semi")
        if self.date_from:
            pages = pages.where(is_true(F.col("event_date") >= self.date_from))
        if self.date_to:
            pages = pages.where(is_true(F.col("event_date") <= self.date_to))
        if self.format:
            pages = pages.where(is_true(F.lower("format") == self.format.lower()))
        return pages.where(is_true(F.col("processing_status") == self.processing_status)) if self.processing_status else pages


def words(column: Column | str) -> Column:
    """The distinct runs of letters and digits, lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def inverted(content: DataFrame) -> DataFrame:
    """(word, page_id, place) of pages (page_id, title, content): place 0 for titles, 2 for content. Built once, partitioned by nothing but its rows."""
    title = content.select("page_id", F.explode(words("title")).alias("word"), F.lit(0).alias("place"))
    return title.unionByName(content.select("page_id", F.explode(words("content")).alias("word"), F.lit(2).alias("place")))


def keyword(index: DataFrame, pages: DataFrame, tags: DataFrame, query: str, filters: Filters = Filters(), superseded: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """(page_id, title, matched_by, rank): pages that have every word of the query, in title, tags or content; none that is superseded (page_id).

    Pages whose title has all of them rank before those that need a tag, and these before those
    that need content; within a rank by title, then page_id. No words match every page.
    """
    wanted = sorted({w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split()})
    eligible = filters.apply(pages, tags)
    if superseded is not None:
        eligible = eligible.join(superseded.select("page_id"), "page_id", "left_anti")
    if not wanted:
        return eligible.select("page_id", "title", F.lit("title").alias("matched_by"), F.lit(0).alias("rank"))
    tagged = tags.select("page_id", F.explode(words("normalized")).alias("word"), F.lit(1).alias("place"))
    hits = index.unionByName(tagged).where(F.col("word").isin(wanted)).groupBy("page_id", "word").agg(F.min("place").alias("place"))
    scored = hits.groupBy("page_id").agg(F.count("*").alias("n"), F.max("place").alias("rank")).where(F.col("n") == len(wanted))
    name = F.element_at(F.array(F.lit("title"), F.lit("tag"), F.lit("keyword")), F.col("rank") + 1)
    return eligible.join(scored, "page_id").select("page_id", "title", name.alias("matched_by"), "rank")


def ranked(found: DataFrame, offset: int = 0, size: int = PAGE_SIZE) -> DataFrame:
    return found.orderBy("rank", fold("title"), "page_id").offset(offset).limit(size)


def facets(pages: DataFrame, tags: DataFrame) -> DataFrame:
    """(facet, value): the tags, formats and statuses that pages have."""
    one = lambda f, name, column: f.select(F.lit(name).alias("facet"), F.col(column).alias("value")).where("value IS NOT NULL").distinct()
    return one(tags, "tag", "normalized").unionByName(one(pages, "format", "format")).unionByName(one(pages, "processing_status", "processing_status"))


def locations(found: DataFrame, facts: DataFrame, query: str) -> DataFrame:
    """The current facts of found pages whose quote has a word of the query, with their byte spans (page_id, quote, start, end, current)."""
    wanted = F.array(*(F.lit(w) for w in sorted(set(query.lower().split()))))
    return facts.where("current").join(found.select("page_id"), "page_id", "left_semi").where(F.arrays_overlap(words("quote"), wanted.cast("array<string>"))).select("page_id", "quote", "start", "end")


# ---- vectors -----------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(vector: Column) -> Column:
    norm = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def nearest(vectors: DataFrame, query: list[float], k: int, eligible: DataFrame | None = None, cutoff: float = CUTOFF) -> DataFrame:
    """(page_id, score): the k pages with the best chunk, at or above the cutoff.

    Ineligible pages go before ranking, so a page behind any number of them is found. Exact: every
    chunk is scored where it lies, and a top-k of each task goes on.
    """
    rows = vectors if eligible is None else vectors.join(eligible.select("page_id").distinct(), "page_id", "left_semi")
    size = sum(x * x for x in query) ** 0.5 or 1.0
    asked = F.array(*(F.lit(float(x) / size) for x in query))
    best = rows.select("page_id", F.round(dot(normalized(F.col("vector")), asked), 6).alias("score")).groupBy("page_id").agg(F.max("score").alias("score"))
    return best.where(F.col("score") >= cutoff).orderBy(F.desc("score"), "page_id").limit(k)


def best_rows(scores: np.ndarray, k: int) -> np.ndarray:
    """Which k entries of each column are the largest, earlier rows first among equal ones; a mask."""
    if len(scores) <= k:
        return np.ones(scores.shape, bool)
    kth = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
    above, equal = scores > kth, scores == kth
    return above | (equal & (np.cumsum(equal, axis=0, dtype=np.int32) <= k - above.sum(axis=0)))


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)


def nearest_of_each(vectors: DataFrame, queries: DataFrame, k: int, cutoff: float = CUTOFF, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, page_id, score) for a stated set of queries (query_id, vector) of any size; equal scores by page_id.

    Queries go in blocks of about `block_bytes`, one after another: each is sent to all tasks, which
    multiply their vectors with it in tiles and keep k pages a query, and an aggregation keeps the k
    best. Only one block is held at a time, and what several blocks find is appended to a table in the
    shared folder. Null vectors are near nothing.
    """
    spark = vectors.sparkSession
    asked = queries.where("vector IS NOT NULL").select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    total, width = asked.agg(F.count("*"), F.max(F.size("vector"))).first()
    blocks = max(1, -(-total * (width or 1) * 8 // block_bytes))
    if blocks == 1:
        return _nearest_of_block(vectors, asked, k, cutoff)[0]
    folder = f"{shared_dir(spark).rstrip('/')}/nearest-{uuid.uuid4().hex}"
    for n in range(blocks):
        found, held = _nearest_of_block(vectors, asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n), k, cutoff)
        found.write.mode("append").parquet(folder)
        held.destroy()
    return spark.read.parquet(folder)


def _nearest_of_block(vectors: DataFrame, asked: DataFrame, k: int, cutoff: float) -> tuple[DataFrame, Broadcast]:
    rows = asked.toArrow()
    values = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    held = vectors.sparkSession.sparkContext.broadcast((rows.column("query_id").to_numpy(), _unit(values.reshape(len(rows), -1) if len(rows) else np.empty((0, 1)))))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = held.value
        best: dict[int, pd.DataFrame] = {}
        for batch in batches:
            if not len(ids) or not len(batch):
                continue
            own = _unit(np.stack(batch["vector"].to_numpy()).astype(np.float64))
            # Chunks of one page are together at last; before that a batch gives each query its best score a page.
            pages, at = np.unique(batch["page_id"].to_numpy(), return_inverse=True)
            for tile in range(0, len(ids), TILE):
                scores = np.round(own @ matrix[tile : tile + TILE].T, 6)
                of_page = np.full((len(pages), scores.shape[1]), -np.inf)
                if len(pages) < len(at):
                    np.maximum.at(of_page, at, scores)
                else:
                    of_page[at] = scores
                row, col = np.nonzero(best_rows(of_page, k) & (of_page >= cutoff))
                part = pd.DataFrame({"query_id": ids[tile + col], "page_id": pages[row], "score": of_page[row, col]})
                if tile in best:
                    part = pd.concat([best[tile], part]).groupby(["query_id", "page_id"], as_index=False)["score"].max()
                    part = part.sort_values(["query_id", "score", "page_id"], ascending=[True, False, True]).groupby("query_id").head(k)
                best[tile] = part
        yield from best.values()

    ship(vectors.sparkSession)
    found = vectors.where("vector IS NOT NULL").select("page_id", "vector").mapInPandas(score, "query_id long, page_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "page_id"))
    merged = found.groupBy("query_id", "page_id").agg(F.max("score").alias("score"))
    return merged.withColumn("rank_", rank).where(F.col("rank_") <= k).drop("rank_"), held


def chunks(pages: DataFrame, size: int = 510, tokens: Column | None = None) -> DataFrame:
    """(page_id, chunk_index, vector_key, content_hash, body): title, kind and content cut into runs of `size` tokens, to be embedded.

    `tokens` makes an array of tokens of the column `body`, as the embedding model's tokenizer would;
    without it tokens are runs other than white space. No text is left out, whichever it is.
    """
    pages = pages.withColumn("body", F.concat_ws("\n", "title", "kind", "content"))
    cut = F.split(F.trim("body"), r"\s+") if tokens is None else tokens
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(cut) / size) - 1)), lambda i: F.struct(i.cast("int").alias("chunk_index"), F.array_join(F.slice(cut, (i * size + 1).cast("int"), size), " ").alias("body")))
    rows = pages.select("page_id", F.explode(pieces).alias("c")).select("page_id", "c.*")
    return rows.select("page_id", "chunk_index", chunk_key(F.col("page_id").cast("string"), F.col("chunk_index")).alias("vector_key"), F.sha2(F.col("body").cast("binary"), 256).alias("content_hash"), "body")


def embedded(chunked: DataFrame, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """(page_id, chunk_index, content_hash, vector): chunks() through a model, which is given lists of texts and returns their vectors; normalised."""
    def each(bodies: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in v] for v in embed(bodies.tolist())])

    each.__annotations__ = {"bodies": pd.Series, "return": pd.Series}
    ship(chunked.sparkSession)
    rows = chunked.select("page_id", "chunk_index", "content_hash", F.pandas_udf(each, "array<double>")("body").alias("raw"))
    return rows.select("page_id", "chunk_index", "content_hash", normalized(F.col("raw")).alias("vector"))


def sync(current: DataFrame, stored: DataFrame) -> DataFrame:
    """What a vector store must do: `embed` chunks that are new or changed, `delete` those that are gone (page_id, chunk_index, content_hash)."""
    key = ["page_id", "chunk_index"]
    fresh = current.join(stored.select(*key, "content_hash"), [*key, "content_hash"], "left_anti").select(*key, F.lit("embed").alias("action"))
    return fresh.unionByName(stored.join(current, key, "left_anti").select(*key, F.lit("delete").alias("action")))


def index_state(assets: bool, current: DataFrame, stored: DataFrame) -> str:
    if not assets:
        return "missing_assets: the embedding model is not available"
    left = sync(current, stored).limit(1).count()
    return "incomplete_index: chunks wait to be embedded" if left else "ready"
