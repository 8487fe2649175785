"""Session settings and the shared folder for lineage cuts and round trips."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
STAYS = "_stays"      # a column: false for rows that only the next step reads


def local_session(cores: str | int = "*", app: str = "modlens") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", "4m")      # small files on one machine; a cluster keeps its own
        .config("spark.sql.files.openCostInBytes", "0")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``.  Only a session on one machine may leave
    it unset: a temporary folder is made, set, and removed when the process ends.  Elsewhere
    executors would each write to a folder of their own, so that is refused.

    Tables written below it belong to the query that wrote them and are read until its
    result is consumed; ``spark.cleaner`` does not know them, so a job that runs for long
    clears the folder between runs.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = named.get() if named.isDefined() else None
    if not named:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^,\]]+(,[^\]]+)?\])?", master):
            raise ValueError(f"master is {master}: set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="modlens-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for the jobs that run inside."""
    before = {c: spark.conf.get(c, None) for c in values}
    try:
        for c, value in values.items():
            spark.conf.set(c, value)
        yield
    finally:
        for c, value in before.items():
            spark.conf.set(c, value) if value is not None else spark.conf.unset(c)


def arrow_batch(spark: SparkSession, rows: int):
    """A Python task of the jobs inside gets so many rows at once."""
    return settings(spark, {_BATCH: str(rows)})


def freed_after(spark: SparkSession):
    """Shuffle files of the writes inside go when a write ends."""
    return settings(spark, {_CLEANUP: "true"})


def cut_lineage(df: DataFrame, name: str = "cut", batch: int | None = None) -> DataFrame:
    """Write once to the shared folder and go on from there.

    Used where several later branches read the same expensive result: the
    branches then see one materialised table instead of recomputing it, and a
    lost executor costs a re-read only.  Shuffle files of the write are not needed behind
    it and go with it.  ``batch``: rows that a Python task of the write gets at once, where one row is large.
    Rows with and without the flag ``STAYS``, if there is one, are written to files of their own (see ``forget_passing``).
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    flags = [STAYS] if STAYS in df.columns else []
    with settings(spark, {_CLEANUP: "true", _WRITERS: "2"} | ({_BATCH: str(batch)} if batch else {})):      # so no sort by the flag
        df.write.option("compression", "zstd").partitionBy(*flags).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget_passing(df: DataFrame) -> None:
    """Remove the files of the rows without the flag ``STAYS`` of a table written by ``cut_lineage``.

    Later reads must ask for the flag; then they do not look for these files."""
    spark = df.sparkSession
    for folder in {os.path.dirname(f) for f in df.inputFiles() if f"/{STAYS}=false/" in f}:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
