"""Keeping the graph in step with deletions: jobs as rows, and what a batch of them does as one merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import models as M
from quarry.operators import graph as G


def pending(jobs: DataFrame, limit: int = 10, status: str = "pending") -> DataFrame:
    """Jobs in the order in which they came."""
    return jobs.where(F.col("status") == status).orderBy("created_at", "job_id").limit(limit)


def claim(jobs: DataFrame, now: Column, limit: int = 10) -> DataFrame:
    """The jobs, the first pending ones of them set to running: what a worker takes in one commit, so that two don't take the same."""
    taken = pending(jobs, limit).select(F.col("job_id").alias("_taken"))
    both = jobs.join(taken, F.col("job_id") == F.col("_taken"), "left")
    mine = F.col("_taken").isNotNull()
    return both.withColumn("status", F.when(mine, "running").otherwise(F.col("status"))).withColumn("started_at", F.when(mine, now).otherwise(F.col("started_at"))).drop("_taken")


def listed(jobs: DataFrame, status: str, limit: int = 50) -> DataFrame:
    """Jobs of a state, the newest first."""
    return jobs.where(F.col("status") == status).orderBy(F.desc("created_at"), "job_id").limit(limit)


#: How far a job of a state is, in percent.
PROGRESS = {"pending": 0, "running": 50, "done": 100}


def progress(status: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in PROGRESS.items() for x in pair))
    return F.coalesce(table[status], F.lit(0))


def latest_status(log: DataFrame) -> DataFrame:
    """The present state of each job in an append-only log (job_id, status, at)."""
    return log.groupBy("job_id").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"), F.count("*").alias("changes"))


def payloads(doc_ids: DataFrame, chunks: DataFrame, mentions: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """(doc_id, chunk_id, entity_id, mention_count) that deleting documents takes away; versions: of these alone."""
    own = chunks.join(doc_ids, "doc_id", "left_semi")
    if versions is not None:
        own = own.join(versions, "version_id", "left_semi")
    return own.select("doc_id", "chunk_id").join(mentions, "chunk_id").select("doc_id", "chunk_id", "entity_id", "mention_count")


def entity_decrements(lost: DataFrame) -> DataFrame:
    """By entity: mentions lost."""
    return lost.groupBy("entity_id").agg(F.sum("mention_count").alias("n"))


def pair_decrements(lost: DataFrame) -> DataFrame:
    """By unordered pair of entities (a, b), a < b: chunks lost that mention both."""
    return G.pairs(lost).groupBy("a", "b").agg(F.count("*").alias("n"))


def edge_decrements(lost: DataFrame) -> DataFrame:
    """By ordered pair of entities: chunks lost that mention both."""
    return G.both_ways(pair_decrements(lost))


def decrement_entities(entities: DataFrame, lost: DataFrame) -> DataFrame:
    """Occurrences less what was lost, not below 0; entities that were touched and have none left are switched off."""
    both = entities.join(entity_decrements(lost), "entity_id", "left")
    left = F.greatest(F.col("occurrence_count") - F.coalesce("n", F.lit(0)), F.lit(0))
    over = F.col("n").isNotNull() & (F.col("occurrence_count") <= 0)
    return (
        both.withColumn("occurrence_count", left)
        .withColumn("is_active", F.when(over, F.lit(False)).otherwise(F.col("is_active")))
        .withColumn("confidence", F.when(over, "low").otherwise(F.col("confidence")))
        .select(*entities.columns)
    )


def decrement_edges(edges: DataFrame, lost: DataFrame) -> DataFrame:
    """Evidence less what was lost, not below 0; weights and evidence ids stay."""
    both = edges.join(edge_decrements(lost), ["src_entity_id", "dst_entity_id"], "left")
    return both.withColumn("evidence_count", F.greatest(F.col("evidence_count") - F.coalesce("n", F.lit(0)), F.lit(0))).select(*edges.columns)


def decrement_pairs(folded: DataFrame, lost: DataFrame) -> DataFrame:
    """The same for edges that are there both ways, by their unordered pairs: rows (a, b, evidence_count) before they are made two edges."""
    both = folded.join(pair_decrements(lost), ["a", "b"], "left")
    return both.withColumn("evidence_count", F.greatest(F.col("evidence_count") - F.coalesce("n", F.lit(0)), F.lit(0))).select(*folded.columns)


def backfill_texts(entities: DataFrame) -> DataFrame:
    """(entity_id, text) of active entities without a vector: name and aliases in one line."""
    aliases = F.filter(F.transform("aliases", lambda a: F.trim(a)), lambda a: a != "")
    return entities.where("is_active and embedding is null").select("entity_id", F.array_join(F.concat(F.array(F.trim("name")), aliases), " | ").alias("text"))


def backfill(entities: DataFrame, embedder: M.Embedder) -> DataFrame:
    """The entities with a vector for each active one that had none."""
    made = backfill_texts(entities).select(F.col("entity_id").alias("_id"), M.embed(embedder)("text").alias("_vector"))
    both = entities.join(made, F.col("entity_id") == F.col("_id"), "left")
    return both.withColumn("embedding", F.coalesce("embedding", F.col("_vector").cast(entities.schema["embedding"].dataType))).select(*entities.columns)


def parse_aliases(raw):
    """Aliases from a JSON array or a comma-separated string."""
    array = F.from_json(raw, "array<string>")
    return F.when(F.trim(raw).startswith("["), array).otherwise(F.filter(F.transform(F.split(raw, ","), lambda a: F.trim(a)), lambda a: a != ""))
