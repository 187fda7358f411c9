import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.context import AccessContext
from quarry.functions import chunking as C
from quarry.functions import models as M
from quarry.functions import text as X
from quarry.operators import graph as G
from quarry.operators import maintenance
from quarry.operators import retrieval as R
from quarry.operators import search as S
from quarry.operators import security as Z
from quarry.plans import catalog, docgen
from quarry.plans.chat import Services, chat, retrieve
from quarry.plans.ingest import build_graph, ingest
from quarry.plans.translate import translated_version
from quarry.streaming import jobs as J


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("x")).first().x


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_clearance_zero_is_not_the_default():
    assert AccessContext.of("a", 0).clearance == 0
    assert AccessContext.of("a").clearance == 2
    with pytest.raises(ValueError):
        AccessContext.of("a", 4)


def test_row_security(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 3), ("b", 0), ("a", None), (None, 0)], "app_id string, classification int")
    seen = [Z.secure(rows, AccessContext("a", c)).count() for c in (None, 0, 1, 3)]
    assert seen == [0, 1, 1, 2]
    with pytest.raises(Exception, match="another application"):
        Z.check_writes(rows, AccessContext("a", 3)).collect()


def test_secured_scan_carries_the_filter(spark, tmp_path):
    spark.createDataFrame([("a", 1, "x")], "app_id string, classification int, t string").write.parquet(str(tmp_path / "t"))
    assert "PushedFilters: [IsNotNull(app_id), IsNotNull(classification), EqualTo(app_id,a)" in plan(Z.secure(spark.read.parquet(str(tmp_path / "t")), AccessContext("a", 2)))


def test_headers(spark):
    assert one(spark, lambda v: X.meta_header(F.lit("text"), F.lit(3), v), "a]b\nc") == "[[META type=text page=3 caption=ab c]]"
    assert one(spark, lambda v: X.meta_header(F.lit("text"), F.lit(3), v), "") == "[[META type=text page=3]]"
    assert len(one(spark, lambda v: X.meta_header(v), "y" * 200)) == len("[[META type=]]") + 121
    parse = lambda t: one(spark, X.meta_fields, t)
    assert parse("[[META type=text page=2 caption=one two page=7]]\nx") == {"type": "text", "page": "7", "caption": "one"}
    assert parse("no header\n[[META type=a]]") == {} == parse("[[META type=a\nx]]")
    page = lambda t: one(spark, X.meta_page, t)
    assert page("[[META type=excel page = 12]]\nx") == 12
    assert page("x\n[[META page=3]]") is None and page("[[META page=x]]") is None


def test_languages_and_paths(spark):
    assert [one(spark, X.query_language, t) for t in ("سؤال", "what", "سؤال what", "12", "", None)] == ["ar", "en", "ar", "auto", "auto", "auto"]
    folder = lambda u: one(spark, lambda v: X.doc_folder(v, F.lit("app")), u)
    assert folder("s3://bucket/app/d1/source/x.txt") == "d1"
    assert folder("http://h/app/d2/x") == "d2" and folder("elsewhere") == ""


def test_sliding_chunks_rebuild_the_text(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab\n é") for _ in range(n)) for n in (0, 1, 9, 10, 11, 18, 19, 57)]
    for size, overlap in ((10, 0), (10, 2), (3, 2)):
        for text in texts:
            cuts = one(spark, lambda v, s=size, o=overlap: C.sliding_chunks(v, s, o), text)
            assert "".join(c if i == 0 else c[overlap:] for i, c in enumerate(cuts)) == text
            assert all(len(c) <= size for c in cuts)
    with pytest.raises(ValueError):
        C.sliding_chunks(F.lit("x"), 5, 5)


def test_blocks_come_text_tables_figures(spark):
    pages = spark.createDataFrame([("d", 1, " t1 ", "tab", None), ("d", 2, "t2", "", "fig")], "doc_id string, page_no int, text string, tables string, figures string")
    rows = [r.chunk_text for r in C.pages_to_chunks(pages).orderBy("chunk_index").collect()]
    assert rows == ["[[META type=text page=1]]\nt1", "[[META type=text page=2]]\nt2", "[[META type=Tables page=1]]\ntab", "[[META type=Figures page=2]]\nfig"]


def test_upserts_in_batches_equal_one_by_one(spark):
    rng = random.Random(3)
    log = [(n, rng.choice("xyz"), rng.choice(["high", "low"]), rng.choice([None, f"d{n}"]), [f"a{n}"]) for n in range(60)]
    state = {}
    for _, name, confidence, description, aliases in log:
        old = state.get(name, (0, None, None, None))
        state[name] = (old[0] + 1, confidence, description or old[2], aliases)
    df = spark.createDataFrame(log, "seq int, name string, confidence string, description string, aliases array<string>")
    half = G.fold_entities(df.where("seq < 30"), ["name"], F.col("seq")).withColumn("is_active", F.lit(False))
    merged = G.merge_entities(half, G.fold_entities(df.where("seq >= 30"), ["name"], F.col("seq")), ["name"])
    assert {r.name: (r.occurrence_count, r.confidence, r.description, r.aliases) for r in merged.collect()} == state
    assert all(r.is_active for r in merged.collect())


def test_edges_never_weigh_over_one(spark):
    log = spark.createDataFrame([("a", "x", "y", "t", 0.5, ["c1"]), ("a", "x", "y", "t", 0.5, ["c2"]), ("a", "x", "y", "t", 0.5, ["c1"])], "app_id string, src_entity_id string, dst_entity_id string, edge_type string, weight double, evidence_chunk_ids array<string>")
    folded = G.fold_edges(log)
    assert folded.first()[4:] == (1.0, 3, ["c1", "c2"])
    merged = G.merge_edges(folded.drop("x"), G.fold_edges(log.limit(1))).first()
    assert (merged.weight, merged.evidence_count) == (1.0, 4)


def test_cooccurrence_has_no_self_pairs(spark):
    mentions = spark.createDataFrame([("a", "c", "x"), ("a", "c", "x"), ("a", "c", "y")], "app_id string, chunk_id string, entity_id string")
    assert sorted((r.src_entity_id, r.dst_entity_id) for r in G.cooccurrence(mentions).collect()) == [("x", "y"), ("y", "x")]


def test_isolated_is_no_nested_loop(spark):
    e = spark.range(10).withColumnRenamed("id", "entity_id")
    edges = spark.createDataFrame([(1, 2)], "src_entity_id long, dst_entity_id long")
    found = G.isolated(e, edges)
    assert found.count() == 8 and "NestedLoop" not in plan(found)


def test_topk_is_one_operator(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "chunk_id long, embedding array<float>")
    best = S.vector_topk(rows, F.array(F.lit(3.2), F.lit(1.0)), 3)
    assert [r.chunk_id for r in best.collect()] == [3, 4, 2] and "TakeOrderedAndProject" in plan(best)
    assert S.vector_topk(rows, F.array(F.lit(3.2), F.lit(1.0)), 0).count() == 5
    near = S.vector_topk(rows, F.array(F.lit(1.0), F.lit(0.0)), 2, metric="cosine", min_similarity=0.99)
    assert [r.chunk_id for r in near.collect()] == [19, 18]


def test_names_with_wildcards(spark):
    rows = spark.createDataFrame([("a%b", []), ("axb", ["q"])], "name string, aliases array<string>")
    assert rows.where(S.name_matches("a%b")).count() == 2
    assert rows.where(S.name_matches("a%b", escape=True)).count() == 1
    assert rows.where(S.name_matches('["q"')).count() == 1


HITS = "query_id int, rank int, chunk_id string, doc_id string, chunk_text string"


def test_page_merge_scopes(spark):
    hits = spark.createDataFrame([(1, 1, "a", "d1", "[[META type=text page=1]]\nA"), (1, 2, "b", "d2", "[[META type=Tables page=1]]\nB"), (1, 3, "c", "d1", "plain"), (1, 4, "d", "d1", "other"), (1, 5, "e", "d1", "[[META type=text page=1]]\nE")], HITS)
    reference = [r.chunk_text for r in R.merge_pages(hits, "reference").orderBy("rank").collect()]
    assert reference == ["[[META type=text page=1]]\nA\n\nB\n\nE", "plain\n\nother"]
    own = [r.chunk_text for r in R.merge_pages(hits, "doc").orderBy("rank").collect()]
    assert own == ["[[META type=text page=1]]\nA\n\nE", "[[META type=Tables page=1]]\nB", "plain", "other"]
    cut = R.merge_pages(spark.createDataFrame([(1, 1, "a", "d", "x" * 9001)], HITS)).first().chunk_text
    assert cut == "x" * 9000 + "\n...(merged truncated)"


def test_rerank_falls_back_to_everything(spark):
    rows = [(1, n, f"c{n}", s) for n, s in enumerate([0.9, 0.1, 0.5, 0.45, 0.41])] + [(2, n, f"c{n}", 0.1 * n) for n in range(4)]
    out = R.rerank(spark.createDataFrame(rows, "query_id int, rank int, chunk_id string, score double"))
    got = {q: [r.chunk_id for r in out.where(F.col("query_id") == q).orderBy("final_rank").collect()] for q in (1, 2)}
    assert got == {1: ["c0", "c2", "c3"], 2: ["c0", "c1", "c2", "c3"]}


def test_entities_from_answers(spark):
    parse = lambda t: [tuple(e) for e in one(spark, M.entities_from_json, t)]
    assert parse('x [{"name":"A","type":"t","aliases":"no","confidence":"HIGH"},{"name":"","type":"t"}] y') == [("A", "t", [], "high")]
    assert parse('{"name":"A","type":"t","aliases":["b"],"confidence":"odd"}') == [("A", "t", ["b"], "medium")]
    assert parse("nothing") == [] == parse("[broken")
    assert len(parse("[" + ",".join('{"name":"n","type":"t"}' for _ in range(13)) + "]")) == 12


def test_ingest_chat_and_translate(spark):
    pages = spark.createDataFrame([("a.txt", 1, "Ada Lovelace met Charles Babbage in London.", "", ""), ("b.txt", 1, "The engine weaves patterns.", "| x |", ""), ("bad", 0, None, None, None)], "doc_key string, page_no int, text string, tables string, figures string")
    now = F.lit("2024-01-01").cast("timestamp")
    done = ingest(pages, "app", "bucket", now)
    assert (done.docs.count(), done.versions.count(), done.chunks.count()) == (2, 2, 3)
    assert ingest(pages, "app", "bucket", now, mode="std").chunks.count() == 2
    names = M.DictionaryExtractor({"Ada Lovelace": "person", "Charles Babbage": "person"})
    entities, mentions, edges = build_graph(done.chunks, names)
    assert (entities.count(), mentions.count(), edges.count()) == (2, 2, 2)
    questions = spark.createDataFrame([(1, "Who met Ada Lovelace in London?"), (2, "engine patterns")], "query_id long, text string")
    services = Services(extractor=names)
    hits, sources, contexts = retrieve(questions, done.chunks, done.docs, AccessContext("app", 2), services, entities=entities, mentions=mentions, edges=edges)
    assert contexts.where("query_id = 1 and context like '%Babbage%'").count() == 1
    assert sources.where("query_id = 1 and source_no = 1 and title = 'a.txt'").count() == 1
    assert hits.where("score is null").count() == 0
    answers = {r.query_id: r.answer for r in chat(questions, done.chunks, done.docs, AccessContext("app", 0), services).collect()}
    assert set(answers) == {1, 2} and "Babbage" not in answers[1]
    own = pages.where("page_no > 0").join(done.docs.select("doc_id", F.col("title").alias("doc_key")), "doc_key").drop("doc_key")
    versions, chunks = translated_version(done.docs, done.versions, own, M.MarkingTranslator(), "en", now)
    assert {r.version_no for r in versions.collect()} == {2}
    assert chunks.where("chunk_text like '%[en] Ada%'").count() == 1


def test_docgen(spark):
    payload = '{"title":"T","doc_no":"7","sections":[{"key":"A","text":"alpha {{B}}"},{"key":"X","text":"see page 3"}],"evidence_notes":[{"topic":"K","items":[{"claim":"c","evidence":[{"source":"s","page":0,"excerpt":"e"}]}]}]}'
    rows = spark.createDataFrame([("{{TITLE}}: {{ A }} / {{B}}\n{{EVIDENCE_NOTES}}", payload)], "template string, raw string").select("template", F.from_json("raw", docgen.PAYLOAD).alias("payload"))
    out = docgen.render(rows).withColumn("problems", docgen.problems(F.col("payload"))).first()
    assert out.text == "T: alpha {{B}} / （待补充）\nK\n- c\n    - s, p. 0: e"
    assert (out.missing, out.extra) == (["B"], ["X"])
    assert out.problems == ["citation in a section", "page below 1"]


def test_retrieval_evaluation_takes_every_question(spark, tmp_path):
    n = 10_300
    spark.range(n).selectExpr("id AS item_id", "concat('<', id, '>') AS text").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.range(0, n, 100).selectExpr("id AS doc_id", "concat('on <', id, '> and <', id + 1, '>') AS text", "if(id < 500, 'src0', 'other') AS source").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in catalog.QUERIES["retrieval_evaluation"](spark, str(tmp_path)).collect())
    assert got == [(i, int(i % 100 < 2), int(i % 100 < 2 and i < 500)) for i in range(n)]


def test_edges_are_folded_without_repeated_evidence(spark):
    log = spark.createDataFrame([("a", 1, 2, "t", 0.4, ["x", "y"]), ("a", 1, 2, "t", 0.5, ["y"]), ("a", 1, 2, "t", 0.4, []), ("a", 2, 1, "t", 0.1, [])], "app_id string, src_entity_id long, dst_entity_id long, edge_type string, weight double, evidence_chunk_ids array<string>")
    got = {r.src_entity_id: (r.weight, r.evidence_count, r.evidence_chunk_ids) for r in G.fold_edges(log).collect()}
    assert got == {1: (1.0, 3, ["x", "y"]), 2: (0.1, 1, [])}


def test_pairs_of_entities(spark):
    mentions = spark.createDataFrame([("a", c, e) for c, es in ((1, [3, 1, 2, 1]), (2, [1, 2]), (3, [5]), (4, [])) for e in es], "app_id string, chunk_id long, entity_id long")
    got = {(r.src_entity_id, r.dst_entity_id): (r.weight, r.evidence_chunk_ids) for r in G.cooccurrence(mentions).collect()}
    one, two = (0.5, [1]), (1.0, [1, 2])
    assert got == {(1, 2): two, (2, 1): two, (1, 3): one, (3, 1): one, (2, 3): one, (3, 2): one}


def test_backfill_gives_vectors_to_active_entities_without_one(spark):
    rows = [(1, "one", ["a"], None, True, 3), (2, "two", [], [1.0, 0.0], True, 1), (3, "three", [], None, False, 1)]
    entities = spark.createDataFrame(rows, "entity_id long, name string, aliases array<string>, embedding array<float>, is_active boolean, occurrence_count long")
    model = M.HashedEmbedder(8)
    got = {r.entity_id: r.embedding for r in maintenance.backfill(entities, model).collect()}
    assert got[1] == pytest.approx(model.embed(["one | a"])[0].tolist()) and got[2] == [1.0, 0.0] and got[3] is None


def test_one_query_vector_of_the_right_size(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, None)], "chunk_id long, embedding array<double>")
    asked = rows.where("chunk_id = 1").select("embedding")
    assert [r.chunk_id for r in S.vector_topk(S.with_query(rows, asked, dim=2), F.col("query")).collect()] == [1, 2]
    assert S.vector_topk(S.with_query(rows, asked.limit(0)), F.col("query")).count() == 0
    for bad in (S.with_query(rows, rows.select("embedding")), S.with_query(rows, asked, dim=3)):
        with pytest.raises(Exception, match="query vector|dimension"):
            S.vector_topk(bad, F.col("query")).collect()


def test_roles(spark):
    with pytest.raises(ValueError, match="role"):
        AccessContext("a", 1, role="king")
    rows = spark.createDataFrame([("a", 3)], "app_id string, classification int")
    with pytest.raises(PermissionError):
        Z.check_writes(rows, AccessContext("a", 1, role="reader"))
    assert Z.check_writes(rows, AccessContext("a", 1)).count() == 1  # above the writer's clearance, but of the application
    assert Z.open_bases(rows.withColumnRenamed("classification", "required_clearance"), AccessContext("a", None)).count() == 0


def test_batches_of_sessions_and_sources(spark):
    messages = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", "c")], "session_id long, turn long, role string, text string")
    assert {r.session_id: (r.messages, r.content) for r in J.session_contents(messages).collect()} == {1: (2, "user:a\nassistant:b"), 2: (1, "user:c")}
    sources = spark.createDataFrame([(1, 2, "", "u2"), (1, 1, "T", "u1")], "query_id long, source_no int, title string, source_uri string")
    assert R.source_lines(sources).first().lines == "[1] T | u1\n[2] (no title) | u2"


def test_names_like_terms(spark):
    names = ["Alpha beta", "alp", "BETA", "a_b", "xbe%ta", "", None, "al"]
    entities = spark.createDataFrame(list(enumerate(names)), "entity_id long, name string")
    terms = ["beta", "al", "a_b", "be%ta", "alpha beta gamma", "", "p_a", "et"]
    got = {(r.term, r.entity_id) for r in G.names_like(entities, spark.createDataFrame([(t,) for t in [*terms, *terms]], "term string")).collect()}
    pattern = lambda t: re.compile(".*" + re.escape(t).replace("%", ".*").replace("_", ".") + ".*", re.S)
    assert got == {(t, i) for t in terms for i, n in enumerate(names) if n is not None and pattern(t).fullmatch(n.lower())}
