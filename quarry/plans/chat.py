"""Questions to answers: all questions of a batch go through one plan."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.context import AccessContext
from quarry.functions import models as M
from quarry.operators import retrieval as R
from quarry.operators import search as S
from quarry.operators.security import secure

#: Entities taken a name, and neighbours of each.
ENTITIES_A_NAME, NEIGHBOURS = 3, 10
SYSTEM = "Answer from the context. Say so if it does not hold the answer."


@dataclass
class Services:
    embedder: M.Embedder = field(default_factory=M.HashedEmbedder)
    reranker: M.Reranker = field(default_factory=M.OverlapReranker)
    extractor: M.EntityExtractor = field(default_factory=lambda: M.DictionaryExtractor({}))
    chat: M.Chat = field(default_factory=M.ExtractiveChat)


def _answers(model: M.Chat):
    @F.pandas_udf("string")
    def run(messages: pd.Series) -> pd.Series:
        return messages.map(lambda m: model.answer([dict(x) for x in m]))

    return run


def retrieve(questions: DataFrame, chunks: DataFrame, docs: DataFrame, ctx: AccessContext, services: Services | None = None, *, entities: DataFrame | None = None, mentions: DataFrame | None = None, edges: DataFrame | None = None, scope: str = "doc", latest: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits, sources, contexts) of questions (query_id, text), which are a stated set.

    Names in a question lead to entities, their neighbours and the chunks that mention them; the question with these
    names leads to near chunks; both lists are merged, pages put together, reranked and cut. latest: versions to keep to.
    """
    services = services or Services()
    own = secure(chunks, ctx)
    if latest is not None:
        own = own.join(latest.select("version_id"), "version_id", "left_semi")
    asked = questions.select("query_id", F.col("text").alias("question"))
    empty = own.sparkSession.createDataFrame([], "query_id long, chunk_id string, rank int").withColumn("query_id", F.col("query_id").cast(asked.schema["query_id"].dataType))
    graph_hits, terms = empty, None
    if entities is not None and mentions is not None:
        named = asked.select("query_id", F.explode(M.extract_entities(services.extractor)("question")).alias("e")).select("query_id", "e.name")
        seen = secure(entities, ctx).where("is_active")
        by_count = Window.partitionBy("query_id", "name").orderBy(F.desc("occurrence_count"), "entity_id")
        ends = seen.select(F.lower("name").alias("_name"), "entity_id", "occurrence_count", F.col("name").alias("entity_name"))
        seeds = named.join(ends, F.lower("name") == F.col("_name")).withColumn("n", F.row_number().over(by_count)).where(F.col("n") <= ENTITIES_A_NAME).select("query_id", "entity_id", "entity_name").distinct()
        score = seeds.join(mentions.select("entity_id", "chunk_id", "mention_count"), "entity_id").groupBy("query_id", "chunk_id").agg(F.sum("mention_count").alias("score"))
        score = score.join(own.select("chunk_id"), "chunk_id", "left_semi")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
        graph_hits = score.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= R.GRAPH_K).select("query_id", "chunk_id", "rank")
        names = seeds.groupBy("query_id").agg(F.array_sort(F.collect_set("entity_name")).alias("names"))
        if edges is not None:
            by_weight = Window.partitionBy("query_id").orderBy(F.desc("weight"), "dst_entity_id")
            near = seeds.join(edges, F.col("entity_id") == F.col("src_entity_id")).join(seen.select(F.col("entity_id").alias("dst_entity_id"), F.col("name").alias("near")), "dst_entity_id")
            near = near.withColumn("n", F.row_number().over(by_weight)).where(F.col("n") <= NEIGHBOURS).groupBy("query_id").agg(F.array_sort(F.collect_set("near")).alias("near"))
            names = names.join(near, "query_id", "left")
        else:
            names = names.withColumn("near", F.array().cast("array<string>"))
        none = F.array().cast("array<string>")
        terms = names.select("query_id", F.coalesce("names", none).alias("names"), F.coalesce("near", none).alias("near"))
    if terms is not None:
        none = F.array().cast("array<string>")
        asked = asked.join(terms, "query_id", "left").withColumn("rewritten", R.expanded_query(F.col("question"), F.coalesce("names", none), F.coalesce("near", none))).drop("names", "near")
    else:
        asked = asked.withColumn("rewritten", F.col("question"))
    vectors = asked.select("query_id", M.embed(services.embedder)("rewritten").alias("query"))
    near_hits = S.vector_topk_batch(own, vectors, R.VECTOR_K).select("query_id", "chunk_id", "rank")
    merged = R.merge_candidates(graph_hits, near_hits)
    hits = merged.join(own.select("chunk_id", "doc_id", "chunk_text"), "chunk_id").select("query_id", "chunk_id", "doc_id", "chunk_text", F.col("position").alias("rank"))
    hits = R.merge_pages(hits, scope).join(asked.select("query_id", "question"), "query_id").withColumn("score", M.rerank_scores(services.reranker)("question", "chunk_text"))
    ranked = R.rerank(hits).drop("rank").withColumnRenamed("final_rank", "rank")
    return ranked, R.sources(ranked, docs), R.context(ranked)


def chat(questions: DataFrame, chunks: DataFrame, docs: DataFrame, ctx: AccessContext, services: Services | None = None, **options) -> DataFrame:
    """(query_id, text, context, answer). A question without hits has an empty context."""
    services = services or Services()
    _, _, contexts = retrieve(questions, chunks, docs, ctx, services, **options)
    rows = questions.join(contexts, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    return rows.withColumn("answer", _answers(services.chat)(R.messages(SYSTEM, F.col("context"), F.col("text"))))


