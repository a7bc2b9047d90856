"""Watched folders, retries, leases and staged rebuilds over tables of state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Milliseconds.
FILE_RETRY, FILE_RETRY_MOST, VISUAL_RETRY_MOST, LEASE, ATTEMPTS, INTERRUPTIONS = 5_000, 300_000, 3_600_000, 400_000, 5, 3


def watch(spark: SparkSession, folder: str, state: str, arrived: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Give every new file below a folder to `arrived`, once, in batches whose number is the generation; ends when none is left."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    return files.writeStream.foreachBatch(arrived).option("checkpointLocation", state).trigger(availableNow=True).start()


def scan(receipts: DataFrame, listing: DataFrame, generation: int, complete: bool) -> DataFrame:
    """Receipts (path, fingerprint, seen, missing) after a listing (path, fingerprint) of one generation, with `action`.

    New and changed files are processed. A file is deleted when two complete listings in a row lack it;
    an incomplete listing says nothing about absence.
    """
    now = listing.select("path", F.col("fingerprint").alias("now"))
    rows = receipts.join(now, "path", "full_outer")
    here = F.col("now").isNotNull()
    action = F.when(here & F.col("seen").isNull(), "new").when(here & (F.col("now") != F.col("fingerprint")), "changed").when(here, "unchanged")
    if complete:
        action = action.when(F.col("missing").isNotNull(), "delete")
    action = action.otherwise("missing")
    missing = F.when(here, F.lit(None).cast("int")).otherwise(F.coalesce("missing", F.lit(generation).cast("int")) if complete else F.col("missing").cast("int"))
    return rows.select("path", F.coalesce("now", "fingerprint").alias("fingerprint"), F.when(here, F.lit(generation).cast("int")).otherwise(F.col("seen").cast("int")).alias("seen"), missing.alias("missing"), action.alias("action"))


def without_suppressed(listing: DataFrame, suppressed: DataFrame) -> DataFrame:
    """A listing without removed origins."""
    return listing.join(suppressed.select("path"), "path", "left_anti")


def file_retry(attempts: Column) -> Column:
    """Milliseconds until the next try of a file: doubled each time, within a bound."""
    return F.least(F.lit(FILE_RETRY) * F.pow(F.lit(2), F.least(attempts - 1, F.lit(6))).cast("long"), F.lit(FILE_RETRY_MOST)).cast("long")


def visual_retry(attempts: Column) -> Column:
    """Milliseconds until the next try of a visual job; null after the last."""
    wait = F.least(F.lit(1000) * F.pow(F.lit(2), F.least(attempts, F.lit(10))).cast("long"), F.lit(VISUAL_RETRY_MOST))
    return F.when(attempts < ATTEMPTS, wait.cast("long"))


def claim(jobs: DataFrame, now: int, most: int = 2) -> DataFrame:
    """The jobs (job_id, state, retry_at, lease_until, attempt) to work on next, leased and with their next attempt number."""
    free = (F.col("state") == "pending") & (F.coalesce("retry_at", F.lit(0)) <= now) | (F.col("state") == "processing") & (F.col("lease_until") < now)
    return jobs.where(free).orderBy(F.coalesce("retry_at", F.lit(0)), "job_id").limit(most).withColumn("attempt", F.col("attempt") + 1).withColumn("lease_until", F.lit(now + LEASE)).withColumn("state", F.lit("processing"))


def finished(results: DataFrame, jobs: DataFrame) -> DataFrame:
    """Results whose fence (job_id, version_id, generation, attempt) still is the job's, while it is being processed."""
    fence = ["job_id", "version_id", "generation", "attempt"]
    return results.join(jobs.where("state = 'processing'").select(*fence), fence, "left_semi")


def may_retry(versions: DataFrame) -> DataFrame:
    """Versions (source_id, version_id, ordinal, interruptions) that are their source's newest and were interrupted less than three times."""
    newest = versions.groupBy("source_id").agg(F.max("ordinal").alias("ordinal"))
    return versions.join(newest, ["source_id", "ordinal"], "left_semi").where(F.col("interruptions") < INTERRUPTIONS)


def rebuild(inputs: Callable[[], DataFrame], build: Callable[[DataFrame], DataFrame], folder: str) -> bool:
    """Build beside the target and publish only if no input changed meanwhile; False asks for another try."""
    from docketry.operators.reconcile import unchanged
    from docketry.session import durable
    from docketry.sources.files import publish

    before = durable(inputs())
    built = durable(build(before))
    if not unchanged(before, inputs()):
        return False
    publish(built, folder)
    return True


def turn(steps: list[tuple[str, Callable[[int], int]]], budgets: dict[str, int]) -> dict[str, int]:
    """One background turn: each step in order with its budget of units; what each has done."""
    return {name: step(budgets[name]) for name, step in steps}


def windowed(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Event counts and sums per window and type; batch and streaming frames alike, late rows within the watermark counted."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")


def fair_share(budget: int, watches: list[str], first: int) -> dict[str, int]:
    """A budget split evenly over watches, beginning with another each time; remainders go to those that come first."""
    order, left, out = watches[first % len(watches) :] + watches[: first % len(watches)] if watches else [], budget, {}
    for n, name in enumerate(order):
        out[name] = left // (len(order) - n)
        left -= out[name]
    return out
