"""Deleting documents: what the graph loses is gathered first, then objects and rows go, and a job is left for the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.context import AccessContext
from quarry.functions import text as X
from quarry.operators import maintenance as M
from quarry.operators.search import latest_versions, vector_topk, with_query
from quarry.operators.security import secure
from quarry.operators.store import TableStore
from quarry.plans.ingest import stable_id


#: Documents that a person can be asked to confirm.
FOUND = 50


def deletion_jobs(lost: DataFrame, app_id: str, now: Column) -> DataFrame:
    """A job for each document: its chunks and their mentions."""
    mention = F.struct(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("entity_id").cast("string").alias("entity_id"), F.col("mention_count").cast("int").alias("mention_count"))
    per = lost.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.col("chunk_id").cast("string"))).alias("chunks"), F.array_sort(F.collect_list(mention)).alias("mentions"))
    payload = F.struct(F.col("doc_id").cast("string").alias("doc_id"), "chunks", "mentions")
    return per.select(stable_id(F.lit("delete"), F.col("doc_id").cast("string")).alias("job_id"), F.lit(app_id).alias("app_id"), F.lit("delete_doc").alias("job_type"), payload.alias("payload"), F.lit("pending").alias("status"), now.alias("created_at"))


def remove_prefix(spark: SparkSession, prefix: str) -> bool:
    """Delete a folder of objects; false if there was none."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(prefix)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def delete_documents(store: TableStore, doc_ids: DataFrame, ctx: AccessContext, now: Column, object_root: str | None = None, all_versions: bool = True, confirm: list[str] | None = None) -> int:
    """Delete what the context sees of some documents, over all versions or the latest one's chunks for the graph; returns how many.

    confirm: the ids that whoever asks has seen and means, at most FOUND of them; where they are given and are not exactly
    the documents that would go, nothing is deleted.
    """
    seen = secure(store.read("docs"), ctx).join(doc_ids, "doc_id", "left_semi")
    if confirm is not None:
        ids = [r["doc_id"] for r in seen.select("doc_id").distinct().limit(FOUND + 1).collect()]
        if sorted(ids) != sorted(set(confirm)):
            raise ValueError("the confirmed documents are not those that would be deleted")
    versions = None
    if not all_versions:
        versions = latest_versions(store.read("doc_versions")).select("version_id")
    lost = M.payloads(seen.select("doc_id"), store.read("chunks"), store.read("entity_chunk"), versions)
    # Objects go first: if this stops before the commit, the documents are still there and a second run deletes them.
    if object_root is not None:
        for row in seen.select("app_id", X.doc_folder(F.col("source_uri"), F.col("app_id")).alias("folder")).where("folder <> ''").distinct().toLocalIterator():
            remove_prefix(store.spark, f"{object_root}/{row['app_id']}/{row['folder']}")
    return store.delete_docs(seen.select("doc_id"), ctx, deletion_jobs(lost, ctx.app_id, now))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Chunks by application and classification."""
    return chunks.groupBy("app_id", "classification").agg(F.count("*").alias("chunks")).orderBy("app_id", "classification")


def diagnostics(chunks: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunk counts, the five most similar ones to the vector of a one-row table)."""
    return chunk_counts(chunks), vector_topk(with_query(chunks, queries), F.col("query"), 5, metric="cosine")
