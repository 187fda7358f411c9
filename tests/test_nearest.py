"""The blocked search for nearest rows against brute force, pairs of large chunks, header values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import graph as G
from quarry.operators import nearest as N
from quarry.operators import retrieval as R
from quarry.operators import search as S
from quarry.operators.nearest import nearest

ROWS, ASKED = "chunk_id string, embedding array<float>", "query_id long, query array<double>"


def brute(rows, asked, k, metric, least=None):
    out = []
    for q, a in asked:
        if a is None:
            continue
        found = []
        for i, v in rows:
            if v is None or len(v) != len(a) or any(x is None or x != x for x in v):
                continue
            v, w = np.array(v, np.float32).astype(float), np.array(a, float)
            if metric == "l2":
                found.append((np.sqrt(((v - w) ** 2).sum()), i))
            elif v.any() and w.any():
                s = float(v @ w / np.sqrt((v @ v) * (w @ w)))
                if least is None or s >= least:
                    found.append((-round(s, 9), i))
        out += [(q, n + 1, i) for n, (_, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    v = np.round(rng.normal(size=(400, 6)), 2)
    rows = [(f"c{i:03}", [float(x) for x in v[i % 350]]) for i in range(400)]  # fifty come twice
    return rows + [("n1", None), ("n2", [1.0, 2.0]), ("n3", [None] * 6), ("n4", [float("nan")] * 6), ("z", [0.0] * 6), ("far", [1e15] * 6), ("two", [2.0, 1.0])]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("sent", [1, 1 << 20])
def test_nearest(spark, vectors, metric, sent):
    rng = random.Random(1)
    asked = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(7)] + [(50, vectors[3][1]), (51, None), (52, [1.0, 1.0]), (53, [0.0] * 6), (54, [1.0])]
    rows, queries = spark.createDataFrame(vectors, ROWS).repartition(5), spark.createDataFrame(asked, ASKED)
    got = nearest(rows, queries, 4, metric=metric, sent_bytes=sent)
    assert sorted((r.query_id, r.rank, r.chunk_id) for r in got.collect()) == brute(vectors, asked, 4, metric)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nearest_of_little(spark, vectors):
    rows, queries = spark.createDataFrame(vectors, ROWS), spark.createDataFrame([(1, [1.0] * 6)], ASKED)
    assert nearest(rows.limit(0), queries, 3).count() == 0 and nearest(rows, queries.limit(0), 3).count() == 0
    got = nearest(rows, queries, 500, metric="cosine", min_similarity=0.5).collect()
    assert sorted((r.query_id, r.rank, r.chunk_id) for r in got) == brute(vectors, [(1, [1.0] * 6)], 500, "cosine", 0.5)
    exact = {r.chunk_id: r.distance for r in S.vector_topk(rows.where("size(embedding) = 6 and chunk_id like 'c%'"), F.array(*(F.lit(1.0) for _ in range(6))), 5).collect()}
    assert exact == {r.chunk_id: r.distance for r in S.vector_topk_batch(rows.where("chunk_id like 'c%'"), queries, 5).collect()}
    with pytest.raises(ValueError, match="metric"):
        nearest(rows, queries, 0)


@pytest.mark.parametrize("block", [2, 5, 256])
def test_pairs_of_large_chunks(spark, monkeypatch, block):
    monkeypatch.setattr(G, "PAIR_BLOCK", block)
    rows = [("c1", i % 23) for i in range(60)] + [("c2", 1), ("c2", 2), ("c3", 7), ("c3", 7)]
    got = sorted((r.chunk_id, r.a, r.b) for r in G.pairs(spark.createDataFrame(rows, "chunk_id string, entity_id long")).collect())
    assert got == [("c1", a, b) for a in range(23) for b in range(a + 1, 23)] + [("c2", 1, 2)]


def test_header_values(spark):
    """As the map of all values has them."""
    texts = ["[[META type=text page=3]]\nbody", "[[META type=table page=2 caption=a=b page=5]]", "[[META page=]]x]]", "[[META  page=1\tcaption=c]d ]]]\r\nbody page=9", "no header page=1", "", None, "[[META]]", "  [[META type=x]]  \nb", "[[METApage=1]]", "[[META xpage=7 type=]]", "[[META type=a]] type=b"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    meta = X.meta_fields(F.col("t"))
    got = rows.select("i", *(F.struct(X.meta_value(F.col("t"), k).alias("a"), meta[k].alias("b")).alias(k) for k in ("type", "page", "caption"))).collect()
    for r in got:
        for k in ("type", "page", "caption"):
            assert r[k].a == r[k].b, (texts[r.i], k, r[k])


def test_texts_that_hold_passages(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["ab", "b", "a", "", "abc\n", "b  a"]) for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, "", "x" * 5000, "a b a b a b a b a b"]
    passages = [t[i:j] for t in texts[:60] for i, j in [sorted(rng.choices(range(len(t) + 1), k=2))]] + [None, "", "nowhere at all to be found here", "b a b a b a", " ", "\n"]
    rows, asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(passages)), "query_id long, passage string")
    want = sorted((q, i) for q, p in enumerate(passages) for i, t in enumerate(texts) if p is not None and t is not None and p in t)
    got = R.texts_with(rows, asked)
    assert sorted((r.query_id, r.doc_id) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_candidates_are_those_that_better_what_is_there():
    """Once a query has its k best, a batch of further rows gives no pairs; before, each batch gave k for every query."""
    rng = np.random.default_rng(2)
    near, far, asked = rng.normal(size=(50, 4)), 100 + rng.normal(size=(50, 4)), rng.normal(size=(9, 4))
    kept = N._Kept(9, 3, "l2")
    row, query = N._candidates(near, asked, 3, "l2", kept.worst)
    kept.add(query, row, N._scores(near, asked, row, query, "l2"))
    assert len(kept.rows()[0]) == 27 and not len(N._candidates(far, asked, 3, "l2", kept.worst)[0])
