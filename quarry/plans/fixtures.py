"""The engine's tables as views of the driver's ones, in Spark and in DuckDB SQL side by side."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import chunking as C
from quarry.streaming.runs import shared


class Tables:
    """The driver's tables in one folder, and what is derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def docs(self) -> DataFrame:
        return self.raw("documents").selectExpr(
            "doc_id", "source AS app_id", "concat('doc_', doc_id, '.txt') AS title",
            "concat('s3://bucket/', source, '/doc_', doc_id, '/source/doc_', doc_id, '.txt') AS source_uri",
            "doc_id % 4 AS classification", "1704067200 + doc_id AS created_at",
        )

    def doc_versions(self) -> DataFrame:
        d = self.docs()
        first = d.selectExpr("doc_id * 10 + 1 AS version_id", "doc_id", "1 AS version_no", "sha2(concat_ws('|', title, source_uri), 256) AS content_hash", "'txt' AS parser_ver", "created_at")
        good = self.raw("labels").where("quality = 1").select("doc_id").distinct()
        second = d.join(good, "doc_id", "left_semi").selectExpr("doc_id * 10 + 2 AS version_id", "doc_id", "2 AS version_no", "sha2(concat_ws('|', doc_id, 2), 256) AS content_hash", "'translate/en' AS parser_ver", "created_at")
        return first.unionByName(second)

    def chunks(self) -> DataFrame:
        cut = self.raw("documents").select("doc_id", F.col("source").alias("app_id"), F.posexplode(C.sliding_chunks(F.col("text"))).alias("chunk_index", "chunk_text"))
        return cut.selectExpr("doc_id * 10000 + chunk_index AS chunk_id", "doc_id", "doc_id * 10 + 1 AS version_id", "app_id", "doc_id % 4 AS classification", "cast(chunk_index AS bigint) AS chunk_index", "chunk_text", "sha2(chunk_text, 256) AS chunk_hash")

    def vector_chunks(self) -> DataFrame:
        return self.raw("embeddings").selectExpr("vec_id AS chunk_id", f"vec_id % {self.raw('documents').count()} AS doc_id", "vec_id % 7 + 1 AS page_no", "concat('[[META type=text page=', vec_id % 7 + 1, ']]\\nchunk ', vec_id) AS chunk_text", "embedding")

    def pages(self) -> DataFrame:
        cut = self.raw("documents").select("doc_id", F.posexplode(C.closed_pages(F.col("text"))).alias("n", "text"))
        return cut.selectExpr("doc_id", "cast(n + 1 AS bigint) AS page_no", "text", "CASE WHEN (n + 1) % 3 = 0 THEN concat('| a | b |\\n| ', doc_id, ' | ', n + 1, ' |') ELSE '' END AS tables", "CASE WHEN (n + 1) % 3 = 1 THEN concat('figure ', n + 1) ELSE '' END AS figures")

    def entity(self) -> DataFrame:
        seen = self.raw("lineitem").groupBy("l_partkey").agg(F.count("*").alias("occurrence_count"))
        vec = self.raw("embeddings").selectExpr("vec_id AS _v", "embedding")
        p = self.raw("part").join(seen, F.col("p_partkey") == F.col("l_partkey"), "left").join(vec, F.col("p_partkey") % self.raw("embeddings").count() == F.col("_v"), "left")
        return p.selectExpr(
            "p_partkey AS entity_id", "concat('app', p_partkey % 2) AS app_id", "p_name AS name", "p_type AS type", "array(p_brand) AS aliases",
            "CASE WHEN p_size > 30 THEN 'high' WHEN p_size > 10 THEN 'medium' ELSE 'low' END AS confidence", "cast(p_size % 4 AS bigint) AS classification",
            "coalesce(occurrence_count, 0) AS occurrence_count", "p_size > 5 AS is_active", "embedding",
        )

    def stored(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows as a table of a folder that driver and executors share, for queries that read them several times."""
        folder = shared(self.spark, name)
        rows.write.parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def entity_chunk(self) -> DataFrame:
        return self.raw("lineitem").groupBy(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("chunk_id")).agg(F.count("*").alias("mention_count")).withColumn("app_id", F.lit("app0"))

    def mentions(self) -> DataFrame:
        """Mentions as they are found, an entity as often as a chunk names it: for what makes them distinct itself."""
        return self.raw("lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("chunk_id"), F.lit("app0").alias("app_id"))

    def entity_pair(self, of: Sequence | None = None, by: Sequence[str] = ("a", "b")) -> DataFrame:
        """All edges, or those that begin or end at some entities: one row (a, b) for both directions."""
        from quarry.operators.graph import cooccurring

        return cooccurring(self.mentions(), of=of, by=by)

    def entity_edge(self, of: Sequence | None = None) -> DataFrame:
        from quarry.operators.graph import both_ways

        return self.with_confidence(both_ways(self.entity_pair(of)))

    def with_confidence(self, edges: DataFrame) -> DataFrame:
        return edges.withColumn("confidence", F.when(F.col("evidence_count") > 1, "high").when(F.col("src_entity_id") % 2 == 0, "medium").otherwise("low"))

    def jobs(self) -> DataFrame:
        return self.raw("events").selectExpr("event_id AS job_id", "event_type AS job_type", "concat('app', user_id % 2) AS app_id", "CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'done' ELSE 'failed' END AS status", "unix_micros(cast(ts AS timestamp)) AS created_at")

    def searches(self) -> DataFrame:
        return self.raw("events").selectExpr("event_id AS search_id", "concat('app', user_id % 2) AS app_id", "user_id % 4 AS clearance", "value AS score")

    def hits(self) -> DataFrame:
        """Hits of each query: an order asks, and its lines are what is found."""
        first = Window.partitionBy("query_id", "chunk_id").orderBy("rank")
        # Texts are made of what is left, so that the sorts don't carry them.
        rows = self.raw("lineitem").selectExpr(
            "l_orderkey AS query_id", "l_linenumber * 1000000 + l_partkey AS chunk_id", "l_suppkey AS doc_id", "l_linenumber", "l_partkey", "l_discount",
            "cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS bigint) AS rank",
        )
        return rows.withColumn("n", F.row_number().over(first)).where("n = 1").selectExpr(
            "query_id", "chunk_id", "doc_id", "round(l_discount * 10, 3) AS score",
            "concat('[[META type=', CASE l_linenumber % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'text' ELSE 'figure' END, ' page=', l_partkey % 4, CASE WHEN l_partkey % 5 = 0 THEN ' caption=c' || l_partkey % 2 ELSE '' END, ']]\\npart ', l_partkey, ' of ', doc_id) AS chunk_text",
            "rank",
        )


#: The same views for DuckDB.
VIEWS = {
    "docs": """SELECT doc_id, source AS app_id, 'doc_' || doc_id || '.txt' AS title,
        's3://bucket/' || source || '/doc_' || doc_id || '/source/doc_' || doc_id || '.txt' AS source_uri,
        doc_id % 4 AS classification, 1704067200 + doc_id AS created_at FROM documents""",
    "doc_versions": """SELECT doc_id * 10 + 1 AS version_id, doc_id, 1 AS version_no, sha256(title || '|' || source_uri) AS content_hash, 'txt' AS parser_ver, created_at FROM docs
        UNION ALL SELECT doc_id * 10 + 2, doc_id, 2, sha256(doc_id || '|2'), 'translate/en', created_at FROM docs WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
    "chunks": """SELECT doc_id * 10000 + i AS chunk_id, doc_id, doc_id * 10 + 1 AS version_id, source AS app_id, doc_id % 4 AS classification, i AS chunk_index,
        substring(text, i * 3800 + 1, 4000) AS chunk_text, sha256(substring(text, i * 3800 + 1, 4000)) AS chunk_hash
        FROM (SELECT *, unnest(range(CASE WHEN length(text) <= 4000 THEN 1 ELSE CAST(ceil((length(text) - 200) / 3800.0) AS BIGINT) END)) AS i FROM documents WHERE length(text) > 0)""",
    "vector_chunks": """SELECT vec_id AS chunk_id, vec_id % (SELECT count(*) FROM documents) AS doc_id, vec_id % 7 + 1 AS page_no, '[[META type=text page=' || (vec_id % 7 + 1) || ']]' || chr(10) || 'chunk ' || vec_id AS chunk_text,
        CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings""",
    "page_rows": """SELECT doc_id, n + 1 AS page_no, substring(text, n * 5000 + 1, 5000) AS text,
        CASE WHEN (n + 1) % 3 = 0 THEN '| a | b |' || chr(10) || '| ' || doc_id || ' | ' || (n + 1) || ' |' ELSE '' END AS tables,
        CASE WHEN (n + 1) % 3 = 1 THEN 'figure ' || (n + 1) ELSE '' END AS figures
        FROM (SELECT *, unnest(range(greatest(1, CAST(ceil(length(text) / 5000.0) AS BIGINT)))) AS n FROM documents)""",
    "entity": """SELECT p_partkey AS entity_id, 'app' || (p_partkey % 2) AS app_id, p_name AS name, p_type AS type, [p_brand] AS aliases,
        CASE WHEN p_size > 30 THEN 'high' WHEN p_size > 10 THEN 'medium' ELSE 'low' END AS confidence, CAST(p_size % 4 AS BIGINT) AS classification,
        coalesce(n, 0) AS occurrence_count, p_size > 5 AS is_active, CAST(embedding AS DOUBLE[]) AS embedding
        FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey LEFT JOIN embeddings ON p_partkey % (SELECT count(*) FROM embeddings) = vec_id""",
    "entity_chunk": "SELECT l_partkey AS entity_id, l_orderkey AS chunk_id, count(*) AS mention_count, 'app0' AS app_id FROM lineitem GROUP BY 1, 2",
    "entity_edge": """SELECT *, CASE WHEN evidence_count > 1 THEN 'high' WHEN src_entity_id % 2 = 0 THEN 'medium' ELSE 'low' END AS confidence FROM (
        SELECT a.app_id, a.entity_id AS src_entity_id, b.entity_id AS dst_entity_id, CAST(least(0.5 * count(*), 1) AS DOUBLE) AS weight, count(*) AS evidence_count,
        list_sort(list(a.chunk_id)) AS evidence_chunk_ids, 'co_occurs' AS edge_type
        FROM entity_chunk a JOIN entity_chunk b ON a.chunk_id = b.chunk_id AND a.entity_id <> b.entity_id GROUP BY 1, 2, 3)""",
    "jobs": """SELECT event_id AS job_id, event_type AS job_type, 'app' || (user_id % 2) AS app_id, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'done' ELSE 'failed' END AS status,
        epoch_us(ts) AS created_at FROM events""",
    "searches": "SELECT event_id AS search_id, 'app' || (user_id % 2) AS app_id, user_id % 4 AS clearance, value AS score FROM events",
    "hits": """SELECT query_id, chunk_id, doc_id, score, chunk_text, rank FROM (SELECT l_orderkey AS query_id, l_linenumber * 1000000 + l_partkey AS chunk_id, l_suppkey AS doc_id, round(l_discount * 10, 3) AS score,
        '[[META type=' || CASE l_linenumber % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'text' ELSE 'figure' END || ' page=' || (l_partkey % 4) || CASE WHEN l_partkey % 5 = 0 THEN ' caption=c' || (l_partkey % 2) ELSE '' END || ']]' || chr(10) || 'part ' || l_partkey || ' of ' || l_suppkey AS chunk_text,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rank FROM lineitem)
        QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank) = 1""",
}
_NEEDS = {"doc_versions": ["docs"], "entity_edge": ["entity_chunk"]}


def with_views(*names: str) -> str:
    """A WITH clause of some views and of those that they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)


Query = Callable[[SparkSession, str], DataFrame]
