"""Selections in order: vectors, names, dates, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions import vector as V
from quarry.operators.nearest import nearest

DEFAULT_K = 5


def vector_topk(rows: DataFrame, query: Column, k: int = DEFAULT_K, *, metric: str = "l2", id_col: str = "chunk_id", vector_col: str = "embedding", min_similarity: float | None = None) -> DataFrame:
    """The k nearest rows of one query, ties by id. metric l2 adds `distance`, cosine `similarity` (greatest first)."""
    k = k if k > 0 else DEFAULT_K
    rows = rows.where(F.col(vector_col).isNotNull() & query.isNotNull())
    if metric == "l2":
        return rows.withColumn("distance", V.l2(F.col(vector_col), query)).orderBy("distance", id_col).limit(k)
    rows = rows.withColumn("similarity", V.cosine_similarity(F.col(vector_col), query))
    if min_similarity is not None:
        rows = rows.where(F.col("similarity") >= min_similarity)
    # Rounded, so that the order of equal vectors doesn't hang on the order in which products were added.
    return rows.orderBy(F.desc(F.round("similarity", 9)), id_col).limit(k)


def with_query(rows: DataFrame, queries: DataFrame, vector_col: str = "embedding", dim: int | None = None) -> DataFrame:
    """Rows beside the vector of a one-row table, as `query`: a join with one row, that an aggregate guarantees. More rows than
    one, or a vector of another dimension than `dim`, are an error; without a row the query is null."""
    one = queries.agg(F.count("*").alias("_n"), F.first(F.col(vector_col)).alias("query"))
    query = F.when(F.col("_n") > 1, F.raise_error(F.lit("more than one query vector")).cast(one.schema["query"].dataType)).otherwise(F.col("query"))
    if dim is not None:
        query = V.checked(query, dim)
    return rows.crossJoin(F.broadcast(one.select(query.alias("query"))))


def vector_topk_batch(rows: DataFrame, queries: DataFrame, k: int = DEFAULT_K, *, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, distance) of all queries (query_id, query): in blocks, each against all rows."""
    return nearest(rows, queries, k, id_col=id_col, vector_col=vector_col).withColumnRenamed("score", "distance")


def name_matches(term: str, escape: bool = False) -> Column:
    """Name or any alias holds the term. Aliases are compared as the text of their JSON array."""
    pattern = X.like_pattern(term, escape)
    aliases = F.concat(F.lit("["), F.array_join(F.transform("aliases", lambda a: F.concat(F.lit('"'), a, F.lit('"'))), ", "), F.lit("]"))
    return F.col("name").ilike(pattern) | aliases.ilike(pattern)


def search_entities(entities: DataFrame, term: str = "", entity_type: str | Column | None = None, active_only: bool = False, limit: int = 50, escape: bool = False) -> DataFrame:
    """By name or alias, type and state, the most frequent first. An empty term or the type ALL filters nothing."""
    out = entities
    if term:
        out = out.where(name_matches(term, escape))
    if isinstance(entity_type, Column) or (entity_type and entity_type != "ALL"):
        out = out.where(F.col("type") == entity_type)
    if active_only:
        out = out.where("is_active")
    return out.orderBy(F.desc("occurrence_count"), "entity_id").limit(limit)


def find_docs(docs: DataFrame, folder: str, limit: int = 10, app_id: str | None = None) -> DataFrame:
    """Documents, of one application or all that are given, whose title or place holds the folder's name, the newest first."""
    if app_id is not None:
        docs = docs.where(F.col("app_id") == app_id)
    if not folder.strip():
        raise ValueError("a folder is needed")
    pattern = X.like_pattern(folder.strip())
    return docs.where(F.col("title").ilike(pattern) | F.col("source_uri").ilike(pattern)).orderBy(F.desc_nulls_last("created_at"), "doc_id").limit(limit)


def in_given_order(rows: DataFrame, ids: list, id_col: str = "chunk_id") -> DataFrame:
    """The rows with these ids, in this order."""
    place = F.array_position(F.array(*(F.lit(i) for i in ids)), F.col(id_col))
    return rows.where(F.col(id_col).isin(list(ids))).withColumn("position", place).orderBy("position")


def latest_versions(versions: DataFrame) -> DataFrame:
    """The newest version of each document; of equally new ones that of the highest number."""
    return versions.groupBy("doc_id").agg(F.max_by("version_id", F.struct(F.col("created_at"), F.col("version_no"))).alias("version_id"), F.max("version_no").alias("max_version_no"))


def page_chunks(chunks: DataFrame, page: int) -> DataFrame:
    return chunks.where(X.meta_page(F.col("chunk_text")) == page).orderBy("chunk_index")


def page_review(docs: DataFrame, versions: DataFrame, chunks: DataFrame, folder: str, page: int) -> DataFrame:
    """The chunks of one page of the newest document found, in its latest version, as one plan."""
    doc = find_docs(docs, folder, 1).select("doc_id")
    latest = latest_versions(versions.join(doc, "doc_id", "left_semi"))
    return page_chunks(chunks.join(latest.select("version_id"), "version_id", "left_semi"), page)
