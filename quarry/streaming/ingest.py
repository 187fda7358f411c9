"""Ingest jobs by event time: repeated reports are dropped within a watermark, and a job without news runs out.

A job's run is a session of its events: it lasts until nothing came for the time to live. Both stateful steps are Spark's own; the
watermark says when a run can't change any more, and its state goes then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How late an event may come, and after how long without news a job has run out.
LATE, TTL = "1 hour", "6 hours"
#: States by which a job is over.
OVER = ("done", "failed")


def runs(events: DataFrame, *, late: str = LATE, ttl: str = TTL) -> DataFrame:
    """(job_id, started_at, ended_at, status, changes, expired) of each run in a stream or table of events (event_id, job_id, status, at).

    An event that comes again within the watermark counts once; events may come out of order within it, and later ones go. status
    is that of the last event, of several at one time the greatest id's. expired: the run ended by silence and not by one of OVER.
    A stream gives a run when the watermark has passed its end, a table gives all of them. An event without a time or job goes.
    """
    rows = events.where("at is not null and job_id is not null").select("event_id", "job_id", "status", "at")
    if rows.isStreaming:
        rows = rows.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
    else:
        rows = rows.dropDuplicates(["event_id"])
    order = F.struct("at", "event_id")
    folded = rows.groupBy("job_id", F.session_window("at", ttl).alias("run")).agg(F.min("at").alias("started_at"), F.max("at").alias("ended_at"), F.max_by("status", order).alias("status"), F.count("*").alias("changes"))
    return folded.select("job_id", "started_at", "ended_at", "status", "changes", (~F.coalesce(F.col("status").isin(*OVER), F.lit(False))).alias("expired"))


def start(events: DataFrame, checkpoint: str, sink: str, *, late: str = LATE, ttl: str = TTL, once: bool = True):
    """Write the runs that are over to a folder of Parquet files, by Spark's own sink: each of them once, also after a restart."""
    writer = runs(events, late=late, ttl=ttl).writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
