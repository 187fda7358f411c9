"""Column names that need quoting, at every stage that gives the caller's columns back, and vectors of very different lengths."""

import numpy as np
import pytest

from quarry.llm import decontaminate, hnsw, language_id, simhash, substring_dedup, suffix_dedup
from quarry.llm.substring_dedup import without_spans

NAMES = "doc_id long, text string, lang string, `my col` string, `n-words` int, `a.b` int, `` ` `` int, _place long, place long, rest string, spans string"
WORDS = " ".join(f"w{i}" for i in range(70))


@pytest.fixture(scope="module")
def docs(spark):
    more = ("m", 1, 2, 3, 4, 5, "r", "s")
    rows = [(1, WORDS, "en", *more), (2, WORDS, "en", *more), (3, f"other {WORDS} words", "en", *more), (4, None, None, *more), (5, "short", "en", *more)]
    return spark.createDataFrame(rows, NAMES.replace("`` ` ``", "`tick`"))


def same_rows(df, docs, ids):
    got = {r.doc_id: r for r in df.collect()}
    assert sorted(got) == ids and df.columns == docs.columns
    for r in docs.collect():
        if r.doc_id in got:
            assert [v for c, v in zip(docs.columns, got[r.doc_id], strict=True) if c != "text"] == [v for c, v in zip(docs.columns, r, strict=True) if c != "text"]


def test_substring_stages(docs):
    same_rows(substring_dedup.deduplicate(docs), docs, [1, 3, 4, 5])
    same_rows(without_spans(docs, substring_dedup.repeated_spans(docs), 20), docs, [1, 3, 4, 5])
    same_rows(suffix_dedup.deduplicate(docs), docs, [1, 3, 4, 5])


def test_near_duplicates(docs):
    same_rows(simhash.deduplicate(docs), docs, [1, 4, 5])


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_decontamination_at_any_block_size(spark, docs, block):
    benchmark = spark.createDataFrame([(1, "nothing of this"), (2, f"x {' '.join(WORDS.split()[:30])} y"), (3, "short")], "item_id long, text string")
    same_rows(decontaminate.decontaminate(docs, benchmark, block_bytes=block), docs, [4])


def test_language_stage(docs):
    kept = language_id.keep_known(docs, language_id.train(docs))
    same_rows(kept, docs, sorted(r.doc_id for r in kept.select("doc_id").collect()))


def recall(vectors, asked, k=10, shard_rows=8192):
    graph = hnsw.Graph.build(np.arange(len(vectors)), vectors)
    hit = 0
    for q in asked:
        found = hnsw._best(graph, np.array([q]), vectors[q : q + 1], k, 128).to_pydict()["vec_id"]
        with np.errstate(over="ignore"):
            best = np.lexsort((np.arange(len(vectors)), hnsw._length(vectors - vectors[q])))[: k + 1]
        hit += len(set(found) & set(best.tolist()))
    return hit / (len(asked) * (k + 1)), graph


@pytest.mark.parametrize("far", [1e15, 1e20, 1e25, 1e70])
def test_one_far_vector_spoils_no_graph(far):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(2000, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[77] *= far
    found, graph = recall(v, range(0, 2000, 50))
    assert found >= 0.9 and max(x.shape[1] for x in graph.neighbours) <= 2 * hnsw.LINKS + hnsw._ADOPTED


def test_narrow_clusters():
    """Fifty clusters whose members are a billionth of the distance between clusters apart."""
    rng = np.random.default_rng(6)
    v = np.repeat(rng.normal(size=(50, 16)), 40, axis=0) + 1e-9 * rng.normal(size=(2000, 16))
    found, graph = recall(v, range(0, 2000, 50))
    assert found >= 0.9 and max(x.shape[1] for x in graph.neighbours) <= 2 * hnsw.LINKS + hnsw._ADOPTED


def test_lost_nodes_are_shared_out():
    """More nodes that no walk gets to than one row may take are reached over each other."""
    rows = np.full((200, 4), -1, np.int32)
    points = np.arange(200, dtype=float)[:, None]
    out = hnsw._reachable(points, rows, 0, 8)
    assert hnsw._reach(out, 0).all() and out.shape[1] == 4 + hnsw._ADOPTED


def test_index_with_vectors_of_any_length(spark):
    """Lengths that one graph can't hold are in shards of their own, and all are found."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8)) * np.repeat([1.0, 1e150, 1e-150], 100)[:, None]
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    asked = frame.where("vec_id % 20 = 0")
    got = {}
    for r in hnsw.search(hnsw.build_index(frame, shard_rows=64), asked, k=5).collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    hit = 0
    for q in range(0, 300, 20):
        with np.errstate(over="ignore"):
            d = hnsw._length(v - v[q])
        best = [(d[i], i) for i in np.lexsort((np.arange(300), d)) if i != q][:5]
        hit += len({i for _, i in got[q]} & {i for _, i in best})
        assert all(s == d[i] for s, i in got[q])
    assert hit / 75 >= 0.9
