"""Sessions, and the package's way to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("docketry")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each context, so that their Python finds it."""
    context = spark.sparkContext
    if not getattr(context, "_docketry_shipped", False):
        here = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="docketry-code-"), "docketry_code.zip")
        with zipfile.ZipFile(path, "w") as out:
            for file in sorted(here.rglob("*.py")):
                out.write(file, file.relative_to(here.parent))
        context.addPyFile(path)
        context._docketry_shipped = True
    return spark


def ship_active() -> None:
    """ship() for the session at work, for functions that make columns and are given none."""
    ship(SparkSession.active())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset and Spark runs in one process, a temporary folder does; on a cluster that
    is an error, since executors could not see each other's files there.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        found = context._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="docketry-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


#: Rows that one task gets of a table whose rows are few bytes and much work.
TASK_ROWS = 4096


def dealt(frame: DataFrame, rows: int, each: int = TASK_ROWS) -> DataFrame:
    """The frame's `rows` rows over tasks of about `each`: a small file, read by one task, gives work to all."""
    return frame.repartition(max(1, -(-rows // each)))


#: Rows of a few numbers each that one file of a small table holds.
FILE_ROWS = 1 << 17


def durable(frame: DataFrame, rows: int | None = None) -> DataFrame:
    """The frame, written once to the shared folder; its lineage ends there.

    With `rows`, an upper bound of the frame's rows, it is written to no more files than such rows
    need. Small tables then cost a few files and tasks instead of one for each shuffle partition.
    """
    shared_dir(frame.sparkSession)
    return (frame if rows is None else frame.coalesce(max(1, -(-rows // FILE_ROWS)))).checkpoint()
