"""From pages to documents, versions, chunks and the graph, as plans over all documents at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import chunking as C
from quarry.functions import models as M
from quarry.functions import text as X
from quarry.operators import graph as G

DEFAULT_CLASSIFICATION = 1


@dataclass
class Ingested:
    docs: DataFrame
    versions: DataFrame
    chunks: DataFrame


def stable_id(*parts: Column) -> Column:
    """An id from what a row is: the same run gives the same ids."""
    return X.sha256(*parts)


def ingest(pages: DataFrame, app_id: str, bucket: str, now: Column, *, embedder: M.Embedder | None = None, mode: str = "blocks", parser: str = "pages", classification: int = DEFAULT_CLASSIFICATION, method: str = "recursive") -> Ingested:
    """Rows of the three tables for page rows (doc_key, page_no, text, tables, figures).

    mode "blocks": chunks under META headers by page; "std": windows over the whole text. Pages with an error make none.
    """
    embedder = embedder or M.HashedEmbedder()
    good = pages.where("page_no > 0")
    uri = F.concat(F.lit(f"s3://{bucket}/{app_id}/"), F.col("doc_key"), F.lit("/source/"), F.col("doc_key"))
    docs = good.select("doc_key").distinct().select(
        stable_id(F.lit(app_id), F.col("doc_key")).alias("doc_id"),
        F.lit(app_id).alias("app_id"),
        F.col("doc_key").alias("title"),
        uri.alias("source_uri"),
        F.lit(classification).cast("short").alias("classification"),
        now.alias("created_at"),
        "doc_key",
    )
    versions = docs.select(
        stable_id(F.col("doc_id"), F.lit("1")).alias("version_id"), "doc_id", F.lit(1).alias("version_no"), X.sha256(F.col("title"), F.col("source_uri")).alias("content_hash"), F.lit(parser).alias("parser_ver"), now.alias("created_at")
    )
    if mode == "std":
        whole = C.full_text(good, "doc_key")
        cut = whole.select("doc_key", F.posexplode(C.sliding_chunks(F.col("full_text"))).alias("chunk_index", "chunk_text"))
    else:
        cut = C.pages_to_chunks(good, "doc_key", method).select("doc_key", "chunk_index", "chunk_text")
    chunks = cut.join(docs.select("doc_key", "doc_id", "app_id", "classification"), "doc_key").select(
        stable_id(F.col("doc_id"), F.lit("1"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        "doc_id",
        stable_id(F.col("doc_id"), F.lit("1")).alias("version_id"),
        "app_id",
        "classification",
        F.col("chunk_index").cast("int").alias("chunk_index"),
        "chunk_text",
        F.sha2("chunk_text", 256).alias("chunk_hash"),
        M.embed(embedder)("chunk_text").alias("embedding"),
        now.alias("created_at"),
    )
    return Ingested(docs.drop("doc_key"), versions, chunks)


def build_graph(chunks: DataFrame, extractor: M.EntityExtractor, embedder: M.Embedder | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, mentions, edges) of chunks: one pass of the extractor, then three aggregations. An entity is known by
    application, name, type and classification, and counts once a chunk."""
    embedder = embedder or M.HashedEmbedder()
    found = chunks.select("app_id", "classification", "chunk_id", "chunk_index", F.explode(M.extract_entities(extractor)("chunk_text")).alias("e"))
    key = ["app_id", "name", "type", "classification"]
    log = found.select("app_id", "classification", "chunk_id", "chunk_index", "e.*").withColumn("name", F.trim("name")).dropDuplicates(["chunk_id", *key])
    log = log.withColumn("entity_id", stable_id(*(F.col(k).cast("string") for k in key)))
    folded = G.fold_entities(log, [*key, "entity_id"], F.struct("chunk_index", "chunk_id"))
    entities = folded.withColumn("embedding", M.embed(embedder)(F.array_join(F.concat(F.array("name"), F.col("aliases")), " | "))).withColumn("is_active", F.lit(True))
    mentions = G.fold_mentions(log.select("app_id", "entity_id", "chunk_id", F.lit(1).cast("long").alias("mention_count")))
    return entities, mentions, G.cooccurrence(mentions)
