"""Queries over streams and stored state: sessions, ingest jobs, merged statistics, the index of names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import by_application as A
from quarry.operators import graph as G
from quarry.operators import name_index, sketches
from quarry.plans.catalog import query
from quarry.plans.fixtures import Tables
from quarry.sources import artefact_source
from quarry.streaming import ingest, sessions
from quarry.streaming.jobs import session_contents
from quarry.streaming.runs import shared


def _stream(t: Tables, name: str) -> DataFrame:
    """A table as a stream of its files. The file is named by a pattern, as a stream reads a folder or what a pattern matches."""
    return t.spark.readStream.schema(t.raw(name).schema).parquet(f"{t.dir}/{name}.parque[t]*")


@query("SELECT conv_id AS session_id, count(*) AS messages, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn, role, text)) AS content FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1")
def session_state(t: Tables) -> DataFrame:
    """The sessions' messages as the stream's state holds them after all conversations went through it."""
    folder = shared(t.spark, "sessions")
    sessions.start(_stream(t, "conversations").withColumnRenamed("conv_id", "session_id"), f"{folder}/checkpoint", f"{folder}/changes").awaitTermination()
    return session_contents(sessions.held(t.spark, f"{folder}/checkpoint")).withColumn("content", F.sha2("content", 256))


_STATUS = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END"


@query(
    f"""WITH e AS (SELECT event_id, user_id AS job_id, {_STATUS} AS status, ts FROM events), g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM e),
    r AS (SELECT *, sum(new) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS run FROM g),
    f AS (SELECT job_id, min(ts) AS a, max(ts) AS z, arg_max(status, row(ts, event_id)) AS status, count(*) AS changes FROM r GROUP BY job_id, run)
    SELECT job_id, epoch_us(a) AS started_at, epoch_us(z) AS ended_at, status, changes, status NOT IN ('done', 'failed') AS expired FROM f WHERE z + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""
)
def ingest_runs(t: Tables) -> DataFrame:
    """The runs of jobs that the stream has closed by the time of their events; every event comes twice."""
    rows = _stream(t, "events").select("event_id", F.col("user_id").alias("job_id"), F.expr(_STATUS).alias("status"), F.col("ts").cast("timestamp").alias("at"))
    twice = rows.withColumn("_", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_")
    folder = shared(t.spark, "ingest")
    ingest.start(twice, f"{folder}/checkpoint", f"{folder}/runs").awaitTermination()
    done = t.spark.read.schema("job_id long, started_at timestamp, ended_at timestamp, status string, changes long, expired boolean").parquet(f"{folder}/runs")
    return done.select("job_id", F.unix_micros("started_at").alias("started_at"), F.unix_micros("ended_at").alias("ended_at"), "status", "changes", "expired")


@query(
    """SELECT app_id, count(*) AS rows, CAST(sum(occurrence_count) AS BIGINT) AS occurrences, count(*) FILTER (confidence = 'high') AS high_confidence, count(DISTINCT entity_id) AS entities, count(DISTINCT type) AS types,
    true AS entities_close, true AS types_close, true AS median_close FROM entity WHERE is_active GROUP BY 1""",
    "entity",
)
def entity_sketches(t: Tables) -> DataFrame:
    """Statistics from states of ten parts, written and merged, beside the exact ones: within three standard errors, and the
    median within three hundredths of the ranks."""
    entities = t.entity().withColumn("part", F.col("entity_id") % 10)
    folder = shared(t.spark, "sketches")
    sketches.entity_state(entities, "part").write.parquet(folder)
    merged = sketches.estimates(sketches.merge(t.spark.read.parquet(folder), ["app_id"]))
    median = F.element_at("occurrence_count_quantiles", 1)
    merged = merged.select("app_id", "rows", F.col("occurrence_count_sum").alias("occurrences"), F.col("high_confidence_sum").alias("high_confidence"), F.col("entity_id_distinct").alias("_e"), F.col("type_distinct").alias("_t"), median.alias("_m"))
    active = entities.where("is_active").join(F.broadcast(merged.select("app_id", "_m")), "app_id")
    ranks = [F.avg(F.when(F.col("occurrence_count") < F.col("_m"), 1.0).otherwise(0.0)).alias("_below"), F.avg(F.when(F.col("occurrence_count") <= F.col("_m"), 1.0).otherwise(0.0)).alias("_upto")]
    exact = active.groupBy("app_id").agg(F.countDistinct("entity_id").alias("entities"), F.countDistinct("type").alias("types"), *ranks)
    both = merged.join(exact, "app_id")

    def close(estimate: str, count: str):
        return F.abs(F.col(estimate) - F.col(count)) <= F.greatest(F.lit(1.0), 3 * 1.04 / 2 ** (sketches.REGISTERS / 2) * F.col(count))

    return both.select(
        "app_id", "rows", "occurrences", "high_confidence", "entities", "types",
        close("_e", "entities").alias("entities_close"), close("_t", "types").alias("types_close"), ((F.col("_below") <= 0.53) & (F.col("_upto") >= 0.47)).alias("median_close"),
    )


_TERMS = """SELECT DISTINCT term FROM (SELECT split_part(p_name, ' ', 1) AS term FROM part UNION ALL SELECT left(p_name, 2) FROM part UNION ALL SELECT right(p_name, 1) FROM part
    UNION ALL SELECT left(p_name, 2) || '%' || right(p_name, 3) FROM part UNION ALL SELECT upper(left(p_name, 5)) FROM part UNION ALL SELECT 'no such name' UNION ALL SELECT '_' UNION ALL SELECT 'b_')"""


@query(f", t AS ({_TERMS}) SELECT lower(term) AS term, count(*) AS entities, min(entity_id) AS first_id FROM (SELECT DISTINCT lower(term) AS term FROM t) JOIN entity ON name ILIKE '%' || term || '%' GROUP BY 1", "entity")
def name_lookup(t: Tables) -> DataFrame:
    """Words, beginnings, ends, wildcards and absent terms, looked up in a stored index of all entities' names."""
    entities = t.stored(t.entity().select("entity_id", "name"), "entities")
    index = name_index.build(entities).write(shared(t.spark, "names"))
    part = t.raw("part")
    kinds = ["split_part(p_name, ' ', 1)", "left(p_name, 2)", "right(p_name, 1)", "concat(left(p_name, 2), '%', right(p_name, 3))", "upper(left(p_name, 5))", "'no such name'", "'_'", "'b_'"]
    terms = part.select(F.explode(F.array(*(F.expr(k) for k in kinds))).alias("term")).distinct()
    found = name_index.lookup(index, terms)
    return found.join(entities.withColumn("low", F.lower("name")), F.col("low") == found["name"]).groupBy("term").agg(F.count("*").alias("entities"), F.min("entity_id").alias("first_id"))


# Layout by application


@query(
    """WITH p AS (SELECT 'app' || (p_partkey % 5) AS app_id, p_name AS name, p_type AS type FROM part), old AS (SELECT DISTINCT app_id, name, type FROM p WHERE app_id <> 'app4'),
    new AS (SELECT app_id, name, type, count(*) AS n, max('d' || l_orderkey) AS description FROM lineitem JOIN (SELECT *, 'app' || (p_partkey % 5) AS app_id, p_name AS name, p_type AS type FROM part) ON l_partkey = p_partkey WHERE app_id IN ('app1', 'app4') GROUP BY 1, 2, 3)
    SELECT coalesce(old.app_id, new.app_id) AS app_id, coalesce(old.name, new.name) AS name, coalesce(old.type, new.type) AS type, coalesce(new.description, 'old') AS description, CASE WHEN old.name IS NULL THEN 0 ELSE 5 END + coalesce(n, 0) AS occurrence_count
    FROM old FULL OUTER JOIN new ON old.app_id = new.app_id AND old.name = new.name AND old.type = new.type WHERE coalesce(old.app_id, new.app_id) <> 'app0'"""
)
def upsert_by_application(t: Tables) -> DataFrame:
    """Upserts of two applications, one of them new, into a table of four, of which one is cleared then."""
    key = ["app_id", "name", "type"]
    part = t.raw("part").select(F.concat(F.lit("app"), F.col("p_partkey") % 5).alias("app_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), "p_partkey")
    table = f"entities_{uuid.uuid4().hex}"
    stored = part.where("app_id <> 'app4'").select(*key).distinct().withColumns({"description": F.lit("old"), "occurrence_count": F.lit(5).cast("long")})
    A.create(stored, table)
    log = part.where("app_id in ('app1', 'app4')").join(t.raw("lineitem"), F.col("p_partkey") == F.col("l_partkey"))
    description = F.concat(F.lit("d"), F.col("l_orderkey"))
    folded = G.fold_entities(log.select(*key, description.alias("description"), description.alias("seq")), key, F.col("seq"))
    A.upsert(t.spark, table, folded, lambda old, new: G.merge_entities(old, new, key))
    A.clear(t.spark, table, "app0")
    return t.spark.table(table).select(*key, "description", "occurrence_count")


@query(
    "SELECT doc_id, page_no, sha256(tables) AS content FROM page_rows WHERE tables <> '' AND doc_id % 4 IN (1, 2) AND page_no BETWEEN 3 AND 6",
    "page_rows",
)
def stored_tables(t: Tables) -> DataFrame:
    """Tables of pages stored as files, of which two applications' and some pages' are asked for."""
    pages = t.pages().where("tables <> ''").select(F.concat(F.lit("app"), F.col("doc_id") % 4).alias("app_id"), F.concat(F.lit("doc_"), F.col("doc_id")).alias("folder"), "page_no", F.col("tables").alias("content"))
    root = shared(t.spark, "artefacts")
    artefact_source.write(pages, root, "table")
    found = artefact_source.artefacts(t.spark, root, "table").where("app_id in ('app1', 'app2') and page_no >= 3 and page_no <= 6")
    return found.select(F.substring_index("folder", "_", -1).cast("long").alias("doc_id"), F.col("page_no").cast("long").alias("page_no"), F.sha2("content", 256).alias("content"))
