"""Tables laid out by application: a change reads and writes the partitions of the applications that it touches.

They are Spark's own tables, partitioned by app_id. An upsert is one dynamic partition overwrite; clearing an application
drops its partition. Others' files stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BY = "app_id"
_MODE = "spark.sql.sources.partitionOverwriteMode"
#: Applications that an upsert names in its filter; beyond them it is joined with those that are touched.
MOST_NAMED = 1000


def create(rows: DataFrame, table: str) -> None:
    """A new table of the rows. Each application's are dealt over tasks by their amount, so that a large one has several files."""
    rows.select(*(c for c in rows.columns if c != BY), BY).hint("rebalance", BY).write.partitionBy(BY).format("parquet").saveAsTable(table)


def touched(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """The stored rows of the applications that changes have rows of: the filter is on the partitions."""
    own = changes.select(BY).where(F.col(BY).isNotNull()).distinct()
    few = [r[0] for r in own.limit(MOST_NAMED + 1).collect()]
    return stored.where(F.col(BY).isin(few)) if len(few) <= MOST_NAMED else stored.join(own, BY, "left_semi")


def upsert(spark: SparkSession, table: str, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """Put changes into a table: merge takes the stored rows of their applications and the changes, and gives those applications' rows.

    It writes beside the old files, which go when all of it is there; a task or executor that is lost is done again. An
    application of which merge gives no row stays as it is: `clear` is for that. A row without an application is an error.
    """
    stored = spark.table(table)
    checked = changes.withColumn(BY, F.coalesce(BY, F.raise_error(F.lit("a row without an application")).cast(changes.schema[BY].dataType)))
    merged = merge(touched(stored, changes), checked).select(*stored.columns)
    before = spark.conf.get(_MODE)
    spark.conf.set(_MODE, "dynamic")
    try:
        merged.hint("rebalance", BY).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(_MODE, before)


def clear(spark: SparkSession, table: str, app_id: str) -> None:
    """All of one application goes."""
    value = app_id.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({BY} = '{value}')")
