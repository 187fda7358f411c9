import json
import pickle
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.config import Config
from quarry.context import AccessContext
from quarry.functions.models import HashedEmbedder, PerWorker, embed
from quarry.operators import ivf
from quarry.operators.store import Conflict, TableStore, change_audit, reviewed_chunks
from quarry.plans.delete import delete_documents
from quarry.sources.objects import ObjectStore
from quarry.streaming import jobs as J

NOW = "timestamp'2024-01-01'"


def fill(spark, root):
    store = TableStore(spark, str(root))
    sql = spark.sql
    store.append("docs", sql(f"SELECT doc_id, app_id, doc_id AS title, 'u' AS source_uri, cast(c AS smallint) AS classification, {NOW} AS created_at, 'x' AS created_by FROM VALUES ('d1','a',1), ('d2','a',3), ('d3','b',1) t(doc_id, app_id, c)"))
    store.append("chunks", sql(f"SELECT concat('c', n) AS chunk_id, d AS doc_id, concat(d, 'v') AS version_id, a AS app_id, cast(1 AS smallint) AS classification, n AS chunk_index, 't' AS chunk_text, 'h' AS chunk_hash, cast(null AS array<float>) AS embedding, {NOW} AS created_at FROM VALUES (1,'d1','a'), (2,'d2','a'), (3,'d3','b') t(n, d, a)"))
    store.append("entity", sql("SELECT id AS entity_id, 'a' AS app_id, id AS name, 't' AS type, cast(array() AS array<string>) AS aliases, 'high' AS confidence, cast(1 AS smallint) AS classification, n AS occurrence_count, true AS is_active FROM VALUES ('x', 2), ('y', 1) t(id, n)"))
    store.append("entity_edge", sql("SELECT 'a' AS app_id, s AS src_entity_id, d AS dst_entity_id, 'co_occurs' AS edge_type, cast(0.5 AS decimal(5,3)) AS weight, 1 AS evidence_count FROM VALUES ('x','y'), ('y','x') t(s, d)"))
    store.append("entity_chunk", sql("SELECT 'a' AS app_id, e AS entity_id, 'c1' AS chunk_id, 1 AS mention_count FROM VALUES ('x'), ('y') t(e)"))
    return store


def test_reads_are_secured_and_deletes_cascade(spark, tmp_path):
    store = fill(spark, tmp_path)
    assert store.read("docs", AccessContext("a", 1)).count() == 1
    assert store.read("doc_versions").count() == 0
    gone = store.delete_docs(spark.createDataFrame([("d1",), ("d2",), ("d3",)], "doc_id string"), AccessContext("a", 2))
    assert gone == 1  # d2 is above the clearance, d3 of another application
    assert [r.chunk_id for r in store.read("chunks").orderBy("chunk_id").collect()] == ["c2", "c3"]
    assert store.read("entity_chunk").count() == 0
    assert store.clear_app("a") == 1
    with pytest.raises(Exception, match="another application"):
        store.append("docs", store.read("docs"), AccessContext("a", 3))


def test_merge_replaces_by_key_and_is_audited(spark, tmp_path):
    store = fill(spark, tmp_path)
    store.merge("docs", store.read("docs").where("doc_id = 'd1'").withColumn("title", F.lit("new")))
    assert {r.doc_id: r.title for r in store.read("docs").collect()} == {"d1": "new", "d2": "d2", "d3": "d3"}
    rows = store.read("docs").where("doc_id <> 'd2'").withColumn("title", F.when(F.col("doc_id") == "d3", "T").otherwise(F.col("title")))
    store.audited("docs", rows, "me", F.lit("2024-01-02"))
    log = {r.row_pk: (r.action, r.new_data) for r in store.read("audit_mutations").collect()}
    assert log["d2"] == ("DELETE", None) and log["d3"][0] == "UPDATE" and json.loads(log["d3"][1])["title"] == "T" and len(log) == 2


def test_audit_of_inserts(spark):
    before, after = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a")], [(1, "a"), (2, None)]))
    assert [(r.action, r.row_pk) for r in change_audit(before, after, "t", ["k"], "me", F.lit(0)).collect()] == [("INSERT", "2")]


def test_jobs_that_come_twice_are_applied_once(spark, tmp_path):
    store = fill(spark, tmp_path / "tables")
    source = tmp_path / "jobs"
    source.mkdir()
    job = {"job_id": "j1", "app_id": "a", "job_type": "delete", "status": "pending", "payload": {"doc_id": "d1", "chunks": ["c1"], "mentions": [{"chunk_id": "c1", "entity_id": e, "mention_count": 1} for e in "xy"]}}
    for n in range(2):
        (source / f"{n}.json").write_text(json.dumps(job))
        J.maintain(spark, str(source), store, str(tmp_path / "check"), once=True).awaitTermination()
    state = {r.entity_id: (r.occurrence_count, r.is_active, r.confidence) for r in store.read("entity").collect()}
    assert state == {"x": (1, True, "high"), "y": (0, False, "low")}
    assert {r.evidence_count for r in store.read("entity_edge").collect()} == {0}
    assert store.read("graph_job").count() == 1


@pytest.mark.parametrize("fails_at", [1, 2, 3, "publish"])
def test_a_batch_of_jobs_that_stops_midway_changes_nothing(spark, tmp_path, monkeypatch, fails_at):
    store = fill(spark, tmp_path)
    payload = {"doc_id": "d1", "chunks": ["c1"], "mentions": [("c1", e, 1) for e in "xy"]}
    jobs = spark.createDataFrame([("j1", (payload["doc_id"], payload["chunks"], payload["mentions"]))], "job_id string, payload struct<doc_id:string,chunks:array<string>,mentions:array<struct<chunk_id:string,entity_id:string,mention_count:int>>>")
    before, calls = store.state(), []

    def broken(kind):
        real = getattr(TableStore, kind)

        def step(self, *args):
            calls.append(kind)
            if kind == fails_at or len(calls) == fails_at:
                raise OSError("lost")
            return real(self, *args)

        return step

    with monkeypatch.context() as m:
        for kind in ("publish",) if fails_at == "publish" else ("write_part",):
            m.setattr(TableStore, kind, broken(kind))
        with pytest.raises(OSError):
            J.apply_jobs(store, jobs)
    assert store.state() == before
    assert J.apply_jobs(store, jobs) == 1 and J.apply_jobs(store, jobs) == 0
    assert {r.entity_id: r.occurrence_count for r in store.read("entity").collect()} == {"x": 1, "y": 0}


def test_of_two_writers_one_fails_and_appends_both_count(spark, tmp_path):
    store = fill(spark, tmp_path)
    first, second = store.begin(), store.begin()
    for change in (first, second):
        change.replace("docs", change.read("docs").where("doc_id = 'd1'"))
    first.commit()
    with pytest.raises(Conflict):
        second.commit()
    assert store.read("docs").count() == 1
    row = store.read("docs")
    late = store.begin()
    store.append("docs", row)
    store.append("docs", row)
    assert store.read("docs").count() == 3 and late.read("docs").count() == 1  # a transaction reads the state it began with
    for _ in range(3):
        store.compact("docs")
    assert len(store.current("docs")) == 1 and store.read("docs").count() == 3


def test_deletion_is_confirmed_and_clears_objects(spark, tmp_path):
    store = fill(spark, tmp_path / "tables")
    ids, ctx = spark.createDataFrame([("d1",), ("d2",)], "doc_id string"), AccessContext("a", 3)
    for wrong in ([], ["d1"], ["d1", "d2", "d3"]):
        with pytest.raises(ValueError, match="confirmed"):
            delete_documents(store, ids, ctx, F.expr(NOW), confirm=wrong)
    assert store.read("docs").count() == 3
    assert delete_documents(store, ids, ctx, F.expr(NOW), confirm=["d2", "d1"]) == 2
    assert store.read("graph_job").count() == 1 and [r.doc_id for r in store.read("docs").collect()] == ["d3"]
    objects = ObjectStore(spark, f"{tmp_path}/objects")
    objects.put("b/x", "1")
    objects.put("c/x", "1")
    assert store.clear_app("b", objects.root) == 1 and not objects.exists("b/x") and objects.exists("c/x")


def test_reviewed_chunks_follow_their_texts(spark):
    chunks = spark.createDataFrame([("c1", "old", "h", [1.0]), ("c2", "other", "h", [1.0])], "chunk_id string, chunk_text string, chunk_hash string, embedding array<float>")
    changes = spark.createDataFrame([("c1", " new ")], "chunk_id string, new_text string")
    kept = {r.chunk_id: r for r in reviewed_chunks(chunks, changes).collect()}
    assert kept["c1"].chunk_text == "new" and kept["c1"].embedding == [1.0] and kept["c2"].chunk_hash == "h"
    model = HashedEmbedder(4)
    again = {r.chunk_id: r.embedding for r in reviewed_chunks(chunks, changes, model).collect()}
    assert again["c1"] == pytest.approx(model.embed(["new"])[0].tolist()) and again["c2"] == [1.0]


def test_summaries_are_replaced_and_touched(spark, tmp_path):
    store = fill(spark, tmp_path)
    ctx = AccessContext("a", 2)
    say = lambda text: spark.createDataFrame([("a", "x", text, 1), ("a", "x", text, 1)], "app_id string, entity_id string, summary_text string, classification short")
    store.upsert_summary(say("one"), ctx, F.expr("timestamp'2024-01-01'"))
    store.upsert_summary(say("two"), ctx, F.expr("timestamp'2024-01-02'"))
    ids = spark.createDataFrame([("x",), ("y",)], "entity_id string")
    got = store.summary(ctx, ids).collect()
    assert [(r.summary_text, str(r.last_updated_at)) for r in got] == [("two", "2024-01-02 00:00:00")]
    assert store.summary(AccessContext("a", 0), ids).count() == 0
    entities = store.read("entity").withColumn("name", F.when(F.col("entity_id") == "x", "new").otherwise(F.col("name")))
    store.merge("entity", entities, now=F.expr("timestamp'2024-01-03'"))
    assert {r.entity_id: str(r.updated_at) for r in store.read("entity").collect()} == {"x": "2024-01-03 00:00:00", "y": "None"}


def test_sessions_keep_and_clear_messages(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    kind = "session_id long, turn long, role string, text string"
    spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "c")], kind).coalesce(1).write.mode("append").json(str(source))
    stream = spark.readStream.schema(kind).json(str(source))
    # A processing-time timeout asks for batches without data for ever; a run to the end of the input is wanted here.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    out = []
    def take(df, _):
        out.extend(tuple(r) for r in df.collect())
    def go():
        J.sessions(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).foreachBatch(take).trigger(availableNow=True).start().awaitTermination()
    go()
    assert sorted(out) == [(1, 2, 1), (2, 1, 0)]
    spark.createDataFrame([(1, 2, "clear", ""), (1, 3, "user", "d")], kind).coalesce(1).write.mode("append").json(str(source))
    out.clear()
    go()
    assert out == [(1, 1, 3)]


def test_states_run_out(spark):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS at UNION ALL SELECT timestamp'2024-01-02 12:00:00'")
    assert J.live(rows, F.expr("timestamp'2024-01-02 13:00:00'")).count() == 1


def test_appends_add_parts_and_compaction_joins_them(spark, tmp_path):
    store = fill(spark, tmp_path)
    before = store.current("docs")
    store.append("docs", store.read("docs").where("doc_id = 'd1'").withColumn("doc_id", F.lit("d9")))
    assert store.current("docs")[:-1] == before and store.read("docs").count() == 4
    store.compact("docs")
    assert len(store.current("docs")) == 1 and store.read("docs").count() == 4


def test_whole_deletion(spark, tmp_path):
    store = fill(spark, tmp_path / "t")
    (tmp_path / "objects/a/d1").mkdir(parents=True)
    store.replace("docs", store.read("docs").withColumn("source_uri", F.concat(F.lit("s3://b/"), "app_id", F.lit("/"), "doc_id", F.lit("/x"))))
    ids = spark.createDataFrame([("d1",), ("d3",)], "doc_id string")
    assert delete_documents(store, ids, AccessContext("a", 2), F.expr(NOW), str(tmp_path / "objects")) == 1
    assert not (tmp_path / "objects/a/d1").exists()
    job = store.read("graph_job").first()
    assert job.status == "pending" and job.payload.chunks == ["c1"] and len(job.payload.mentions) == 2
    assert J.apply_jobs(store, store.read("graph_job")) == 1
    assert {r.entity_id: r.occurrence_count for r in store.read("entity").collect()} == {"x": 1, "y": 0}


def test_settings():
    assert Config.load(env={"QUARRY_CHUNK_SIZE": "7", "QUARRY_RERANK_LEAST": "bad", "QUARRY_GRAPH_ENABLED": "no"}) == Config(chunk_size=7, graph_enabled=False)


def test_cells(spark):
    rows = spark.createDataFrame([(i, [float(i % 4) * 10, float(i)]) for i in range(40)], "chunk_id long, embedding array<double>")
    centre = ivf.centres(rows, 4)
    found = ivf.search(ivf.assign(rows, centre), centre, [0.0, 3.0], 2, n_probe=4)
    assert [r.chunk_id for r in found.orderBy("rank").collect()] == [4, 0]


def test_recall_of_the_inverted_file(spark):
    """Clusters and vectors without structure: with a quarter and three quarters of the cells nine in ten neighbours are found."""
    rng = np.random.default_rng(3)
    shapes = {"clusters": (np.repeat(rng.normal(size=(20, 8)), 30, 0) + 0.1 * rng.normal(size=(600, 8)), 4), "none": (rng.normal(size=(600, 8)), 12)}
    for flat, probes in shapes.values():
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(flat)], "chunk_id long, embedding array<double>")
        centre = ivf.centres(rows, 16).cache()
        assigned, hits = ivf.assign(rows, centre).cache(), 0
        for i in range(0, 600, 60):
            true = set(np.argsort(((flat - flat[i]) ** 2).sum(1), kind="stable")[:10].tolist())
            hits += len(true & {r.chunk_id for r in ivf.search(assigned, centre, flat[i].tolist(), 10, n_probe=probes).collect()})
        assert hits >= 90


def test_a_model_is_made_once_a_worker(spark):
    def make():
        model = HashedEmbedder(4)
        model.made = uuid.uuid4().hex
        return model

    held = PerWorker(f"test-{uuid.uuid4().hex}", make)
    again = pickle.loads(pickle.dumps(PerWorker(held.name, HashedEmbedder)))
    assert held.made == held.made and again.dim == 4 and again.made == held.made
    rows = spark.createDataFrame([("a",), ("b",)], "t string")
    wide = PerWorker("test-wide", HashedEmbedder)
    assert {len(r.v) for r in rows.select(embed(wide)("t").alias("v")).collect()} == {64}
