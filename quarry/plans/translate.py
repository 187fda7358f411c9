"""Translating a document's pages into a further version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import chunking as C
from quarry.functions import models as M
from quarry.operators import store
from quarry.plans.ingest import stable_id

LANGUAGES = ("ar", "ch", "en")


def translate_pages(pages: DataFrame, model: M.Translator, language: str) -> DataFrame:
    """Pages with text, tables and figures in the language. A page whose text comes back empty has `failed` set and is skipped later."""
    if language not in LANGUAGES:
        raise ValueError(f"language must be one of {LANGUAGES}: {language}")
    run = M.translate(model, language)
    before = pages.withColumn("_had_text", F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    out = before.withColumns({c: run(F.coalesce(F.col(c), F.lit(""))) for c in ("text", "tables", "figures")})
    return out.withColumn("failed", F.col("_had_text") & (F.length(F.trim("text")) == 0)).drop("_had_text")


def translated_version(docs: DataFrame, versions: DataFrame, pages: DataFrame, model: M.Translator, language: str, now: Column, embedder: M.Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """(versions, chunks) to add for documents with pages (doc_id, page_no, text, tables, figures): number max + 1, parser translate/<language>."""
    embedder = embedder or M.HashedEmbedder()
    own = pages.select("doc_id").distinct()
    number = versions.groupBy("doc_id").agg((F.max("version_no") + 1).alias("version_no"))
    content, parser = store.new_version(F.col("doc_id"), F.col("version_no"), f"translate/{language}")
    new = docs.join(own, "doc_id", "left_semi").select("doc_id").join(number, "doc_id").select(
        stable_id(F.col("doc_id").cast("string"), F.col("version_no").cast("string")).alias("version_id"), "doc_id", "version_no", content.alias("content_hash"), parser.alias("parser_ver"), now.alias("created_at")
    )
    good = translate_pages(pages, model, language).where("not failed")
    cut = C.pages_to_chunks(good, "doc_id", "recursive").select("doc_id", "chunk_index", "chunk_text")
    chunks = store.chunk_rows(docs, cut.join(new.select("doc_id", "version_id"), "doc_id")).withColumn("embedding", M.embed(embedder)("chunk_text"))
    return new, chunks.withColumn("chunk_id", stable_id(F.col("version_id"), F.col("chunk_index").cast("string"))).withColumn("created_at", now)
