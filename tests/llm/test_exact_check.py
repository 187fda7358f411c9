"""Rows on which a walk alone misses the nearest: ties, queries far from all, neighbourhoods without structure, ids of many rows."""

import numpy as np
import pytest

from quarry.llm import hnsw


def rows_of(kind):
    rng = np.random.default_rng(12)
    v = rng.normal(size=(1500, 24))
    if kind == "ties":
        return rng.integers(0, 2, size=(1500, 14)).astype(float)
    if kind == "far queries":
        v[::100] *= 1e20
    if kind == "flat":
        v = rng.normal(size=(1500, 300))
    if kind == "heavy tails":
        v *= np.exp(3 * rng.normal(size=(1500, 1)))
    return v


@pytest.mark.parametrize("kind", ["ties", "far queries", "flat", "heavy tails"])
def test_nothing_is_missed_within_a_shard(kind):
    v = rows_of(kind)
    ids = np.random.default_rng(1).permutation(len(v))
    graph = hnsw.Graph.build(ids, v)
    asked = np.arange(0, len(v), 100)
    got = hnsw._best(graph, asked, v[asked], 10, hnsw.BEAM).to_pydict()
    for q in asked:
        d = hnsw._length(v - v[q])
        best = np.lexsort((ids, d))[:11]
        found = [(i, s) for r, i, s in zip(got["rep"], got["vec_id"], got["score"], strict=True) if r == q]
        assert found == [(int(ids[i]), float(d[i])) for i in best]


def test_ids_of_many_rows(spark):
    """Twelve rows of one id beside a query, equal ones and others, don't push its other neighbours out."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 6))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(7, v[0].tolist())] * 12 + [(9, (v[0] + 1e-6 * j).tolist()) for j in range(1, 13)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in hnsw.search(hnsw.build_index(df, shard_rows=40), df.where("vec_id = 100 or vec_id = 0")).where("query_id = 0").orderBy("rank").collect()]
    least = {}
    for i, x in rows:
        if i:
            least[i] = min(least.get(i, np.inf), float(hnsw._length(np.array([x]) - v[0])[0]))
    assert [i for i, _ in got] == [i for i, _ in sorted(least.items(), key=lambda x: (x[1], x[0]))[:10]]
