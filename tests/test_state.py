"""Streams, stored statistics and the index of names."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import name_index, sketches
from quarry.operators.graph import entity_stats
from quarry.streaming import ingest, sessions
from quarry.streaming.runs import shared

MESSAGES = "session_id long, turn long, role string, text string"
EVENTS = "event_id long, job_id long, status string, at timestamp"


def held(spark, checkpoint):
    return sorted((r.session_id, r.turn, r.role, r.text) for r in sessions.held(spark, checkpoint).collect())


def test_sessions_over_batches(spark):
    """Rows in any order, a session cleared, late messages of cleared turns, odd rows, a stream that is begun again."""
    folder = shared(spark, "t-sessions")

    def send(*rows):
        spark.createDataFrame(list(rows), MESSAGES).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        sessions.start(stream, f"{folder}/cp", f"{folder}/out").awaitTermination()

    send((1, 2, "assistant", "b"), (1, 1, "user", "a"), (2, 1, "user", "x"), (None, 1, "user", "nowhere"), (3, None, None, None))
    assert held(spark, f"{folder}/cp") == [(1, 1, "user", "a"), (1, 2, "assistant", "b"), (2, 1, "user", "x"), (3, 0, "", "")]
    send((1, 3, "clear", ""), (1, 4, "user", "c"), (2, 1, "user", "x"))
    assert held(spark, f"{folder}/cp") == [(1, 4, "user", "c"), (2, 1, "user", "x"), (2, 1, "user", "x"), (3, 0, "", "")]
    send((1, 2, "user", "too late"), (1, 5, "user", "d" * 100_000))
    assert [r[:2] for r in held(spark, f"{folder}/cp")] == [(1, 4), (1, 5), (2, 1), (2, 1), (3, 0)]
    changes = spark.read.parquet(f"{folder}/out")
    assert {(r.batch, r.session_id, r.kind, r.messages) for r in changes.collect()} == {(0, 1, "added", 2), (0, 2, "added", 1), (0, 3, "added", 1), (1, 1, "cleared", 1), (1, 2, "added", 2), (2, 1, "added", 2)}


def test_sessions_run_out(spark):
    folder = shared(spark, "t-expiry")
    spark.createDataFrame([(1, 1, "user", "a"), (1, 2, "user", "b")], MESSAGES).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(MESSAGES).parquet(f"{folder}/in")
    run = sessions.start(stream, f"{folder}/cp", f"{folder}/out", ttl=2, once=False)
    try:
        for _ in range(60):
            run.awaitTermination(1)
            if run.lastProgress and spark.read.parquet(f"{folder}/out").where("kind = 'expired'").count():
                break
    finally:
        run.stop()
    assert [(r.kind, r.messages) for r in spark.read.parquet(f"{folder}/out").orderBy("batch").collect()] == [("added", 2), ("expired", 2)]
    assert held(spark, f"{folder}/cp") == []


def at(hour, minute=0):
    from datetime import datetime, timedelta

    return datetime(2024, 1, 1) + timedelta(hours=hour, minutes=minute)


def run_of(r):
    return (r.job_id, r.started_at, r.ended_at, r.status, r.changes, r.expired)


def test_ingest_runs_by_event_time(spark):
    """Events out of order and again, over several batches; runs close when the watermark has passed them, a late event goes."""
    folder = shared(spark, "t-ingest")

    def send(*rows):
        spark.createDataFrame(list(rows), EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        ingest.start(stream, f"{folder}/cp", f"{folder}/runs").awaitTermination()
        return sorted(run_of(r) for r in spark.read.parquet(f"{folder}/runs").collect())

    spark.createDataFrame([], "job_id long, started_at timestamp, ended_at timestamp, status string, changes long, expired boolean").write.parquet(f"{folder}/runs")
    assert send((2, 1, "running", at(2)), (1, 1, "pending", at(1)), (2, 1, "running", at(2)), (3, 2, "done", at(1)), (9, None, "done", at(1)), (10, 1, "done", None)) == []
    # The first event comes once more, an earlier one comes late but in time, and a later one moves the watermark on.
    first = send((1, 1, "pending", at(1)), (4, 1, "pending", at(1, 30)), (5, 3, "running", at(12)))
    assert first == [(1, at(1), at(2), "running", 3, True), (2, at(1), at(1), "done", 1, False)]
    # Too late for its run: dropped. A new run of a job that had run out.
    assert send((6, 2, "failed", at(2)), (7, 1, "failed", at(13)), (8, 4, "done", at(30))) == [*first[:1], (1, at(13), at(13), "failed", 1, False), first[1], (3, at(12), at(12), "running", 1, True)]


def test_ingest_runs_of_a_table(spark):
    rows = [(1, 1, "pending", at(1)), (1, 1, "pending", at(1)), (2, 1, "done", at(3)), (3, 1, "running", at(20))]
    got = sorted(run_of(r) for r in ingest.runs(spark.createDataFrame(rows, EVENTS)).collect())
    assert got == [(1, at(1), at(3), "done", 2, False), (1, at(20), at(20), "running", 1, True)]


# Statistics as state


@pytest.fixture(scope="module")
def entities(spark):
    rng = random.Random(2)
    rows = [(i, f"app{i % 3}", f"type{rng.randrange(300)}", rng.choice(["high", "medium", "low", None]), rng.randrange(1000), rng.random() < 0.9, i % 7) for i in range(30_000)]
    return spark.createDataFrame(rows, "entity_id long, app_id string, type string, confidence string, occurrence_count long, is_active boolean, day int")


def test_merged_states_are_the_state_of_all(spark, entities):
    """Days merged one after the other, or all at once, or none apart: the same numbers, and near the exact ones."""
    daily = sketches.entity_state(entities, "day")
    whole = {r.app_id: r for r in sketches.estimates(sketches.entity_state(entities), (0.5, 0.9)).collect()}
    merged = {r.app_id: r for r in sketches.estimates(sketches.merge(daily, ["app_id"]), (0.5, 0.9)).collect()}
    before = sketches.merge(daily.where("day < 6"), ["app_id"])
    added = {r.app_id: r for r in sketches.estimates(sketches.merge(before.unionByName(daily.where("day = 6").drop("day")), ["app_id"]), (0.5, 0.9)).collect()}
    exact = {r.app_id: r for r in entity_stats(entities).collect()}
    for app, real in exact.items():
        for state in (whole[app], merged[app], added[app]):
            assert (state.rows, state.high_confidence_sum, state.low_confidence_sum) == (real.entities, real.high_confidence, real.low_confidence)
            assert state.occurrence_count_sum / state.rows == pytest.approx(real.mean_occurrence)
            assert abs(state.entity_id_distinct / real.entities - 1) < 0.025 and abs(state.type_distinct / real.types - 1) < 0.025
            assert abs(state.occurrence_count_quantiles[0] - 500) < 30 and abs(state.occurrence_count_quantiles[1] - 900) < 30
        assert added[app].entity_id_distinct == pytest.approx(merged[app].entity_id_distinct, rel=0.005)


def test_states_of_nothing(spark):
    none = spark.createDataFrame([(None, "a", None)], "x long, g string, m long")
    got = sketches.estimates(sketches.merge(sketches.partial(none, ["g"], distinct=["x"]), ["g"])).first()
    assert (got.rows, got.x_distinct) == (1, 0)
    assert sketches.merge(sketches.partial(none.limit(0), ["g"], distinct=["x"]), ["g"]).count() == 0


# Names


def brute(names, terms):
    import re

    out = set()
    for t in terms:
        if t is None:
            continue
        pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in t.lower())
        out |= {(t.lower(), n.lower()) for n in names if n is not None and re.search(pattern, n.lower(), re.S)}
    return out


@pytest.mark.parametrize("block", [2, 4096])
def test_name_index(spark, monkeypatch, block):
    """Any terms, short ones and wildcards too, against all names; with blocks of two even rare groups are cut."""
    monkeypatch.setattr(name_index, "BLOCK", block)
    rng = random.Random(9)
    names = ["".join(rng.choice("abcé_%\\ ") for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None, "", "A", "ab", "x" * 3000, "Straße"]
    terms = ["".join(rng.choice("abcé%_\\ ") for _ in range(rng.randint(0, 5))) for _ in range(120)] + [None, "", "%", "zz", "xxxx", "ABC", "a%c", "b_c", "ß"]
    index = name_index.build(spark.createDataFrame([(n,) for n in names], "name string"))
    if block > 2:
        index = index.write(shared(spark, "t-names"))
    got = {(r.term, r.name) for r in name_index.lookup(index, spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    assert got == brute(names, terms)


def test_name_index_splits_common_groups(spark, monkeypatch):
    monkeypatch.setattr(name_index, "BLOCK", 100)
    index = name_index.build(spark.range(5000).select(F.format_string("item %05d", "id").alias("name")))
    sizes = index.postings.select("gram", F.size("ids").alias("n")).groupBy("gram").agg(F.max("n").alias("n"), F.count("*").alias("blocks")).collect()
    assert max(r.n for r in sizes) < 200 and max(r.blocks for r in sizes) >= 50
    terms = spark.createDataFrame([("m 0123",), ("item",), ("i%4999",)], "term string")
    found = name_index.lookup(index, terms)
    assert {r.term: r.n for r in found.groupBy("term").agg(F.count("*").alias("n")).collect()} == {"m 0123": 10, "item": 5000, "i%4999": 1}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    # The rarest groups decide: few names are compared.
    assert name_index.candidates(index, terms.where("term = 'i%4999'")).count() < 10
