"""Tables by application, and artefacts read by their keys."""

import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarry.operators import by_application as A
from quarry.operators import graph as G
from quarry.sources import artefact_source
from quarry.streaming.runs import shared

ROWS = "app_id string, name string, type string, description string, occurrence_count long"
KEY = ["app_id", "name", "type"]


def files_of(spark, table):
    return {(r.app_id, r.path) for r in spark.table(table).select("app_id", F.col("_metadata.file_path").alias("path")).distinct().collect()}


@pytest.mark.parametrize("named", [1000, 0])
def test_upsert_touches_its_applications_alone(spark, monkeypatch, named):
    monkeypatch.setattr(A, "MOST_NAMED", named)
    table = f"t_{uuid.uuid4().hex}"
    A.create(spark.createDataFrame([(f"app{i % 4}", f"n{i}", "t", "old", 1) for i in range(40)] + [("it's", "n", "t", None, 1)], ROWS), table)
    before = files_of(spark, table)
    log = [("app1", "n1", "t", "new", 1), ("app1", "n1", "t", "newer", 2), ("app9", "x", "t", None, 3)]
    folded = G.fold_entities(spark.createDataFrame(log, "app_id string, name string, type string, description string, seq int"), KEY, F.col("seq"))
    A.upsert(spark, table, folded, lambda old, new: G.merge_entities(old, new, KEY))
    after = files_of(spark, table)
    assert {f for f in before if f[0] != "app1"} < after and not {f for f in before if f[0] == "app1"} & after
    got = {(r.app_id, r.name): (r.description, r.occurrence_count) for r in spark.table(table).collect()}
    assert len(got) == 42 and got["app1", "n1"] == ("newer", 3) and got["app9", "x"] == (None, 1) and got["app1", "n5"] == ("old", 1)
    A.clear(spark, table, "app2")
    A.clear(spark, table, "it's")
    A.clear(spark, table, "not there")
    assert {r.app_id for r in spark.table(table).select("app_id").distinct().collect()} == {"app0", "app1", "app3", "app9"}
    with pytest.raises(Exception, match="without an application"):
        A.upsert(spark, table, spark.createDataFrame([(None, "a", "t", "d", 1)], ROWS), lambda old, new: old.unionByName(new))
    spark.sql(f"DROP TABLE {table}")


def test_filters_are_on_partitions(spark):
    table = f"t_{uuid.uuid4().hex}"
    A.create(spark.createDataFrame([(f"app{i}", "n", "t", "d", 1) for i in range(5)], ROWS), table)
    own = A.touched(spark.table(table), spark.createDataFrame([("app1",), (None,), ("app1",)], "app_id string"))
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(app_id" in plan and "= app1" in plan or "IN (app1)" in plan
    assert A.touched(spark.table(table), spark.createDataFrame([], "app_id string")).count() == 0
    spark.sql(f"DROP TABLE {table}")


def test_only_asked_artefacts_are_opened(spark):
    """Files that nobody asks for can't be read as text: opening one fails."""
    root = shared(spark, "t-artefacts")
    rows = [(f"app{a}", f"doc{d}", p, f"{a} {d} {p} é") for a in range(3) for d in range(3) for p in (1, 2, 10)] + [("app0", "doc0", 3, None)]
    artefact_source.write(spark.createDataFrame(rows, "app_id string, folder string, page_no int, content string"), root, "table")
    base = Path(root.removeprefix("file://"))
    (base / "app0/doc0/ocr/tab/readme.txt").write_bytes(b"\xff")
    everything = artefact_source.artefacts(spark, root, "table")
    assert sorted(tuple(r) for r in everything.collect()) == sorted((a, d, p, c or "") for a, d, p, c in rows)
    for name in base.rglob("*_page*"):
        if "app1/doc2" not in str(name) or not name.stem.endswith(("page2", "page10")):
            name.write_bytes(b"\xff")
    asked = artefact_source.artefacts(spark, root, "table").where("app_id = 'app1' and folder in ('doc2', 'none') and page_no > 1")
    assert sorted(tuple(r) for r in asked.collect()) == [("app1", "doc2", 2, "1 2 2 é"), ("app1", "doc2", 10, "1 2 10 é")]
    assert artefact_source.artefacts(spark, root, "table").where("app_id = 'nobody'").count() == 0
    with pytest.raises(Exception, match="utf-8"):
        everything.where("app_id = 'app1'").collect()
    with pytest.raises(ValueError, match="kind"):
        artefact_source.artefacts(spark, root, "image")
