"""Streams of jobs and messages: graph maintenance by micro-batches, job states, sessions with a time to live."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.operators import maintenance as M
from quarry.operators.store import TableStore
from quarry.schemas import schema

TTL_SECONDS = 86_400


def apply_jobs(store: TableStore, jobs: DataFrame) -> int:
    """Apply a batch of deletion jobs as one merge; returns how many were new.

    Entities, edges and the ledger of done jobs change in one commit, so a batch that fails midway has changed nothing,
    and a job that comes twice is applied once. A job's payload says what it takes away: mentions by chunk and entity.
    """
    change = store.begin()
    done = change.read("graph_job").where("status = 'done'").select("job_id")
    fresh = jobs.dropDuplicates(["job_id"]).join(done, "job_id", "left_anti")
    n = fresh.count()
    if not n:
        return 0
    lost = fresh.select(F.explode("payload.mentions").alias("m")).select("m.chunk_id", "m.entity_id", F.col("m.mention_count").cast("long").alias("mention_count"))
    entities, edges = change.read("entity"), change.read("entity_edge")
    change.replace("entity", M.decrement_entities(entities, lost))
    change.replace("entity_edge", M.decrement_edges(edges, lost))
    change.append("graph_job", fresh.withColumn("status", F.lit("done")).withColumn("finished_at", F.current_timestamp()))
    change.commit()
    return n


def maintain(spark: SparkSession, source: str, store: TableStore, checkpoint: str, *, once: bool = False, interval: str = "10 seconds"):
    """A stream over a folder of job files (JSON rows of graph_job). once: what is there now, then stop."""
    jobs = spark.readStream.schema(schema("graph_job")).json(source)
    writer = jobs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: apply_jobs(store, batch))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def live(states: DataFrame, now, ttl: int = TTL_SECONDS) -> DataFrame:
    """States (at: timestamp) that have not run out."""
    return states.where(F.unix_timestamp("at") > F.unix_timestamp(now) - ttl)


def _session_step(ttl: int):
    """The messages of a session so far, in order of their turns. The role `clear` forgets what came before it, and a session
    without news for `ttl` seconds is forgotten whole."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = {tuple(m) for m in json.loads(state.get[0])} if state.exists else set()
        for frame in frames:
            held |= set(zip(frame["turn"].tolist(), frame["role"].tolist(), frame["text"].tolist(), strict=True))
        cleared = max((m[0] for m in held if m[1] == "clear"), default=None)
        messages = sorted(m for m in held if cleared is None or m[0] > cleared)
        state.update((json.dumps(messages),))
        state.setTimeoutDuration(ttl * 1000)
        yield pd.DataFrame({"session_id": [key[0]], "messages": [len(messages)], "last_turn": [messages[-1][0] if messages else -1]})

    return step


def sessions(messages: DataFrame, ttl: int = TTL_SECONDS) -> DataFrame:
    """A stream of messages (session_id, turn, role, text) as a stream of session states, in update mode."""
    out = "session_id long, messages long, last_turn long"
    return messages.groupBy("session_id").applyInPandasWithState(_session_step(ttl), out, "messages string", "update", GroupStateTimeout.ProcessingTimeTimeout)


def session_contents(messages: DataFrame) -> DataFrame:
    """(session_id, messages, content) of messages (session_id, turn, role, text) that are there: the batch form of `sessions`."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    return messages.groupBy("session_id").agg(F.count("*").alias("messages"), F.array_join(ordered, "\n").alias("content"))


def run_jobs(jobs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(job_id, status, at) log rows of jobs that were worked on: running, then done, or failed where `work` gives ok = false."""
    done = work(jobs).select("job_id", F.when(F.col("ok"), "done").otherwise("failed").alias("status"), F.lit(2).alias("step"))
    return jobs.select("job_id", F.lit("running").alias("status"), F.lit(1).alias("step")).unionByName(done)
