"""Session settings, shared tables and numbering that the operators have in common."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import words

#: Rows and bytes that one Arrow batch may hold; they bound the memory of a Python worker, whatever the texts' lengths.
BATCH_ROWS = 1024
BATCH_BYTES = 2 << 20

_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches, and let Python workers import this package from where the driver has it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    here, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if here not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (here, known) if x)


def release_memory() -> None:
    """Give what a task has freed back to the system: Python workers are kept for other stages, beside those of their executor."""
    words.forget()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """A function over Arrow batches that releases memory when its partition is done."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return whole


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the time of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a temporary one
    (tests), and a cluster is an error: its executors would each write to a disk of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = Path(tempfile.mkdtemp(prefix="shared-")).as_uri()
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Workspace:
    """Tables of one operator run below the shared folder. Writing a table cuts lineage, and a lost executor costs
    no more than the tasks since the last table. What an operator returns reads some of them, so they stay until
    `dropped_behind` or the owner of the folder removes them."""

    made: ClassVar[list[Workspace]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        Workspace.made.append(self)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back. The shuffle files behind it are removed as soon as it is written."""
        path = f"{self.root}/{name}"
        with setting(self.spark, _CLEAN_SHUFFLES, "true"):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Remove a table that nothing reads any more."""
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def dropped_behind() -> Iterator[None]:
    """Remove the workspaces that were made in a block when it is left: whatever was worked out there has to be written by then."""
    mark = len(Workspace.made)
    try:
        yield
    finally:
        for workspace in Workspace.made[mark:]:
            workspace.drop()
        del Workspace.made[mark:]


def number_rows(df: DataFrame, group: list[str], bucket: str, order: list, out: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, and without one task per group.

    The rows of a group are dealt over `bucket` (an integer column with a bounded number of values), numbered within
    it, and moved up by the rows of the buckets before. Only the counts, groups times buckets rows, meet in one window.
    """
    keys = [*group, bucket]
    counts = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    before = counts.withColumn(
        "_before",
        F.coalesce(F.sum("_rows").over(Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).drop("_rows")
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    joined = ranked.join(before.withColumnsRenamed({k: f"_{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return joined.withColumn(out, F.col("_before") + F.col("_rank") - 1).drop("_before", "_rank", *(f"_{k}" for k in keys))


def kept_rows(df: DataFrame, text_col: str, keeper: Callable[[str], Callable]) -> DataFrame:
    """df without the rows that a function over Arrow batches leaves out; keeper makes it from the name that the text has there. Columns
    go through it under plain names, as theirs may be any."""
    plain = [f"c{i}" for i in range(len(df.columns))]
    renamed = df.toDF(*plain)
    return renamed.mapInArrow(tidy(keeper(plain[df.columns.index(text_col)])), renamed.schema).toDF(*df.columns)


def own_columns(df: DataFrame, id_col: str, text_col: str | None = None) -> DataFrame:
    """Only the columns that an operator reads, under fixed names, so that further ones never clash."""
    cols = [F.col(f"`{id_col}`").cast("long").alias("doc_id")]
    if text_col is not None:
        cols.append(F.col(f"`{text_col}`").cast("string").alias("text"))
    return df.select(*cols)
