"""Merging hits: what is shuffled and carried."""

from quarry.operators import retrieval as R


def test_hits_of_a_query_meet_once(spark):
    """Merging candidates takes one exchange; merging pages carries a hit's text once."""
    hits = spark.createDataFrame([(1, 1, "a", "d", "[[META type=text page=1]]\nx"), (1, 2, "b", "d", "[[META type=text page=1]]\ny")], "query_id long, rank long, chunk_id string, doc_id string, chunk_text string")
    merged = R.merge_candidates(hits, hits)
    merged.collect()
    assert merged._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
    pages = R.merge_pages(hits)
    assert [(r.rank, r.chunk_id, r.parts, r.chunk_text) for r in pages.collect()] == [(1, "a", 2, "[[META type=text page=1]]\nx\n\ny")]
    assert "min_by" not in pages._jdf.queryExecution().optimizedPlan().toString()
