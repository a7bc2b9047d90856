"""What the corpus operators share: durable checkpoints, batch sizes, spare column names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.session import durable, shared_dir, ship

__all__ = ["compact", "crc_mod", "durable", "load", "qualified", "scratch_dir", "shared_dir", "small", "small_batches", "spare", "table_rows", "tasks", "text_digest"]

#: Rows in an Arrow batch. Texts can be long; a batch of default size could outgrow a worker.
BATCH_ROWS = 256

#: Rows of ids and digests that may be broadcast, at most (about 10 MB); more are joined by a shuffle.
BROADCAST_ROWS = 1 << 17
#: Texts that a task takes at least: tables in many small files are read by fewer tasks than files.
TASK_TEXTS = 2000

#: White space that separates words.
SPACE = "\x20\x09-\x0d"


def scratch_dir(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder. What is written there stays until that folder is cleared."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with scheme and authority, as Spark's own readers and writers take it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def small_batches(spark: SparkSession) -> None:
    """For Python stages: bounded Arrow batches, and this package on the executors.

    Spark reads the bounds from the session when a frame runs, so they are set there and stay set.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def tasks(spark: SparkSession, size: int, each: int) -> int:
    """Tasks for work of a size, of which a task takes `each` or more: at most as many as Spark shuffles to."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each)))


def compact(frame: DataFrame, rows: int, each: int = TASK_TEXTS) -> DataFrame:
    """The frame of `rows` rows in no more partitions than give each task `each` rows. Nothing moves for it."""
    return frame.coalesce(max(1, -(-rows // each)))


def small(frame: DataFrame, rows: int) -> DataFrame:
    """A narrow frame of at most `rows` rows as a join's side: broadcast if that is few."""
    return F.broadcast(frame) if rows <= BROADCAST_ROWS else frame


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spare(frame: DataFrame, base: str) -> str:
    """A column name that the frame does not have, whatever its case."""
    taken = {c.lower() for c in frame.columns}
    name = f"__{base}"
    while name in taken:
        name += "_"
    return name


def text_digest(text_col: str) -> Column:
    """SHA-256 of the text, by which a decision about a text finds its rows again; null counts as empty text."""
    return F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256))


def crc_mod(column: Column | str, n: int) -> Column:
    """crc32 of the value's decimal text, modulo n (null counts as empty text)."""
    value = F.col(column) if isinstance(column, str) else column
    return (F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def table_rows(frame: DataFrame, fraction_key: Column, rows: int, total: int) -> DataFrame:
    """About `rows` of the frame's `total` rows, chosen by the hash of a key, so that reruns agree."""
    if total <= rows:
        return frame
    share = int(rows / total * 1_000_000)
    return frame.where(F.pmod(F.xxhash64(fraction_key, F.lit("docketry sample")), F.lit(1_000_000)) < share)
