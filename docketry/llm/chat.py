"""Chat formatting after cumulative-snapshot collapse, in DataFrame functions only.

A log that saves a conversation after every turn holds each as a prefix of the next. Every turn
gets a hash of all turns up to it: the sum of hashes of (position, role, text), kept exactly in
two decimals from independent hashes, so sums over blocks of turns add up to the sum over the
conversation and a conversation of any length spreads over tasks. A conversation whose whole hash
is a longer one's prefix hash goes; of equal conversations the one with the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Turn numbers in a block; a block is what one task sorts.
BLOCK_TURNS = 1024


def _clean(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def turn_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, position, h1, h2): position counts a conversation's turns from 1; h1 and h2
    are its prefix hash up to there. Turns of equal number follow by role, then text; null ones come first."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.floor(F.coalesce(F.col("turn").cast("double"), F.lit(0.0)) / BLOCK_TURNS).alias("block"),
        _clean("role").alias("role"), F.unhex(F.sha2(_clean("text").cast("binary"), 256)).alias("of_text"),
    )
    same = [F.col("conv_id").eqNullSafe(F.col("c")), F.col("block") == F.col("b")]
    through = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)

    def before(sums: dict[str, Column]) -> DataFrame:
        blocks = placed.groupBy(F.col("conv_id").alias("c"), F.col("block").alias("b")).agg(*(v.alias(k) for k, v in sums.items()))
        return blocks.select("c", "b", *(F.coalesce(F.sum(k).over(through), F.lit(0)).alias(k) for k in sums))

    within = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "of_text")
    placed = rows
    placed = rows.withColumn("n", F.row_number().over(within)).join(before({"rows_before": F.count("*")}), same).withColumn("position", F.col("n") + F.col("rows_before"))
    term = [F.xxhash64(F.lit(salt), "position", "role", "of_text").cast("decimal(38,0)") for salt in ("one", "two")]
    placed = durable(placed.select("conv_id", "block", "turn", "position", term[0].alias("t1"), term[1].alias("t2")))
    up_to = Window.partitionBy("conv_id", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    sums = {"s1": F.sum("t1"), "s2": F.sum("t2")}
    return placed.join(before(sums), same).select(
        "conv_id", "turn", "position", *((F.sum(f"t{i}").over(up_to) + F.col(f"s{i}")).cast("decimal(38,0)").alias(f"h{i}") for i in (1, 2))
    )


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns): conversations that no longer one begins with, the smallest id of equal ones."""
    prefixes = durable(turn_hashes(turns))
    whole = durable(prefixes.groupBy("conv_id").agg(F.max_by(F.struct("position", "h1", "h2"), "position").alias("end")).select("conv_id", "end.*"))
    classes = whole.groupBy("position", "h1", "h2").agg(F.min(F.struct(F.col("conv_id").isNull().alias("no_id"), "conv_id")).alias("kept"))
    # A prefix that ends inside its conversation; grouped, since one first turn may begin a third of them.
    longer = prefixes.join(whole.select(F.col("conv_id").alias("c"), F.col("position").alias("n_turns")), F.col("conv_id").eqNullSafe(F.col("c")))
    inner = longer.where("position < n_turns").select("position", "h1", "h2").distinct()
    return classes.join(inner, ["position", "h1", "h2"], "left_anti").select("kept.conv_id", F.col("position").cast("long").alias("n_turns"))


def render(role: Column, text: Column) -> Column:
    """A turn in the template: <|role|>, a new line, the text, a new line, <|end|>. Markers in texts and roles are escaped."""
    safe = [F.replace(c, F.lit("<|"), F.lit("<\\|")) for c in (role, text)]
    return F.concat(F.lit("<|"), safe[0], F.lit("|>\n"), safe[1], F.lit("\n<|end|>\n"))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, chat): the maximal conversations of turns, rendered.

    A conversation is all rows of a conv_id (null is an id of its own) by turn, then role, then
    text; null roles and texts are empty; repeated rows are turns like others. An empty table
    gives no rows; columns besides conv_id, turn, role and text are not read.
    """
    kept = maximal(turns).withColumnsRenamed({"conv_id": "c"})
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _clean("role").alias("role"), _clean("text").alias("text"))
    of_text = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    each = rows.select("conv_id", F.struct(F.coalesce("turn", F.lit(-(1 << 63))).alias("turn"), "role", of_text.alias("of_text"), render(F.col("role"), F.col("text")).alias("said")).alias("one"))
    chats = each.join(kept, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi").groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("all"))
    return chats.select("conv_id", F.size("all").cast("long").alias("n_turns"), F.concat_ws("", F.col("all.said")).alias("chat"))


SQL = r"""
WITH whole AS (
  SELECT conv_id, count(*) AS n_turns,
         list(coalesce(role, '') || chr(1) || coalesce(text, '') ORDER BY turn NULLS FIRST, coalesce(role, ''), unhex(sha256(coalesce(text, '')))) AS turns,
         string_agg('<|' || replace(coalesce(role, ''), '<|', '<\|') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '<\|') || chr(10) || '<|end|>' || chr(10), ''
                    ORDER BY turn NULLS FIRST, coalesce(role, ''), unhex(sha256(coalesce(text, '')))) AS chat
  FROM conversations GROUP BY conv_id
)
SELECT a.conv_id, a.n_turns, a.chat FROM whole a
WHERE NOT EXISTS (
  SELECT 1 FROM whole b
  WHERE b.turns[1] = a.turns[1] AND b.turns[1:a.n_turns] = a.turns
    AND (b.n_turns > a.n_turns OR (b.n_turns = a.n_turns AND (b.conv_id < a.conv_id OR (a.conv_id IS NULL AND b.conv_id IS NOT NULL)))))
"""
