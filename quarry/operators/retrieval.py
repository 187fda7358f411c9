"""From candidates to context: merging, page merging, reranking, sources, audit. All per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X

RECALL_K, GRAPH_K, VECTOR_K = 10, 20, 40
RERANK_K, RERANK_LEAST = 3, 0.4
MERGE_CAP, CONTEXT_CAP = 9000, 8000


def merge_candidates(first: DataFrame, second: DataFrame, id_col: str = "chunk_id", limit: int = RECALL_K, query_col: str = "query_id") -> DataFrame:
    """Both candidate lists (with `rank`), the first one's ahead; of one chunk the first stays; `limit` a query."""
    # A query's candidates meet once; both windows are over what is there then.
    rows = first.withColumn("list", F.lit(0)).unionByName(second.withColumn("list", F.lit(1))).repartition(query_col)
    once = Window.partitionBy(query_col, id_col).orderBy("list", "rank")
    order = Window.partitionBy(query_col).orderBy("list", "rank", id_col)
    kept = rows.withColumn("n", F.row_number().over(once)).where("n = 1").drop("n")
    return kept.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def page_key(text: Column, scope: str = "doc") -> Column:
    """What hits are merged by. scope "reference": table and figure by page and caption, anything else by its page whatever the
    document; "doc": within a document, headerless chunks by themselves."""
    return key_of(X.meta_inside(text), scope)


def key_of(inside: Column, scope: str = "doc") -> Column:
    """page_key of a header's fields (see `meta_inside`)."""
    kind, page, caption = F.coalesce(X.field_value(inside, "type"), F.lit("")), X.field_value(inside, "page"), F.coalesce(X.field_value(inside, "caption"), F.lit(""))
    if scope == "reference":
        page = F.coalesce(F.coalesce(page.try_cast("int").cast("string"), page), F.lit("None"))
        special = F.when(caption != "", F.concat_ws(":", kind, page, caption)).otherwise(F.concat_ws(":", kind, page))
        return F.when(kind.isin("table", "figure"), special).otherwise(F.concat(F.lit("text:"), page))
    return F.when(page.isNull(), F.concat(F.lit("chunk:"), F.col("chunk_id").cast("string"))).otherwise(F.concat_ws(":", F.col("doc_id").cast("string"), F.lower(kind), page, caption))


def merge_pages(hits: DataFrame, scope: str = "doc", cap: int = MERGE_CAP, query_col: str = "query_id") -> DataFrame:
    """Hits (query_id, rank, chunk_id, doc_id, chunk_text) of one page put together: the first is the base, the others follow without
    their headers."""
    # The header is looked for once; a body is made only of hits that follow another one.
    rows = hits.withColumn("_inside", X.meta_inside(F.col("chunk_text"))).withColumn("key", key_of(F.col("_inside"), scope))
    grouped = rows.groupBy(query_col, "key").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "doc_id", "chunk_text"))).alias("own"))
    first = F.col("own")[0]
    others = F.transform(F.slice("own", 2, F.greatest(F.size("own") - 1, F.lit(0))), lambda x: X.strip_header(x["chunk_text"]))
    text = F.when(F.size("own") == 1, first["chunk_text"]).otherwise(F.array_join(F.concat(F.array(first["chunk_text"]), others), "\n\n"))
    return grouped.select(
        query_col,
        first["rank"].alias("rank"),
        first["chunk_id"].alias("chunk_id"),
        first["doc_id"].alias("doc_id"),
        F.size("own").cast("long").alias("parts"),
        X.cut(F.coalesce(text, F.lit("")), cap, "\n...(merged truncated)").alias("chunk_text"),
    )


def rerank(hits: DataFrame, k: int = RERANK_K, least: float | None = RERANK_LEAST, query_col: str = "query_id") -> DataFrame:
    """Hits with a `score`: the best k of at least `least`. Where none reaches it, all in their old order. least None: the
    best k, then the rest in their old order."""
    by_score = Window.partitionBy(query_col).orderBy(F.desc("score"), "rank")
    everything = Window.partitionBy(query_col)
    rows = hits.withColumn("place", F.row_number().over(by_score))
    if least is None:
        order = Window.partitionBy(query_col).orderBy(F.when(F.col("place") <= k, F.col("place")).otherwise(F.col("rank") + (1 << 30)))
        return rows.withColumn("final_rank", F.row_number().over(order)).drop("place")
    rows = rows.withColumn("best", F.max("score").over(everything))
    kept = rows.where(((F.col("place") <= k) & (F.col("score") >= least)) | F.coalesce(F.col("best") < least, F.lit(True)))
    return kept.withColumn("final_rank", F.when(F.col("best") >= least, F.col("place")).otherwise(F.row_number().over(Window.partitionBy(query_col).orderBy("rank")))).drop("place", "best")


def sources(hits: DataFrame, docs: DataFrame, query_col: str = "query_id") -> DataFrame:
    """Each document of the hits once, in the order in which they come, with title and place."""
    first = hits.groupBy(query_col, "doc_id").agg(F.min("rank").alias("first_rank"))
    order = Window.partitionBy(query_col).orderBy("first_rank", "doc_id")
    named = first.withColumn("source_no", F.row_number().over(order)).join(docs.select("doc_id", "title", "source_uri"), "doc_id", "left")
    return named.select(query_col, "source_no", "doc_id", X.clean(F.col("title")).alias("title"), X.clean(F.col("source_uri")).alias("source_uri"))


def citations(hits: DataFrame, docs: DataFrame, query_col: str = "query_id") -> DataFrame:
    """(query_id, doc_id, page_no): the distinct pages of known documents that each query's hits name, by their META headers."""
    named = hits.withColumn("page_no", X.meta_page(F.col("chunk_text"))).where("page_no is not null")
    return named.join(docs.select("doc_id"), "doc_id", "left_semi").select(query_col, "doc_id", "page_no").distinct()


def cited_pages(cited: DataFrame, assets: DataFrame) -> DataFrame:
    """Citations with what is stored of their pages (doc_id, page_no, ...); a page without anything stored stays, empty."""
    others = [c for c in assets.columns if c not in ("doc_id", "page_no")]
    return cited.join(assets, ["doc_id", "page_no"], "left").withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in others})


def source_lines(sources_: DataFrame, query_col: str = "query_id") -> DataFrame:
    """(query_id, lines): the sources as numbered lines, as they stand below an answer."""
    line = F.concat(F.lit("["), F.col("source_no").cast("string"), F.lit("] "), F.concat_ws(" | ", F.when(F.col("title") == "", "(no title)").otherwise(F.col("title")), F.col("source_uri")))
    ordered = F.array_sort(F.collect_list(F.struct("source_no", line.alias("line"))))
    return sources_.groupBy(query_col).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("lines"))


def context(hits: DataFrame, cap: int = CONTEXT_CAP, query_col: str = "query_id") -> DataFrame:
    """The hits' texts in order, joined by blank lines and cut."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_text"))), lambda x: x["chunk_text"])
    return hits.groupBy(query_col).agg(X.cut(F.array_join(texts, "\n\n"), cap, "\n...(截断)").alias("context"))


def search_audit(hits: DataFrame, queries: DataFrame, top_k: int, query_col: str = "query_id") -> DataFrame:
    """A row for each query, also those without hits: ids in order, lowest and highest score."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "doc_id")))
    per = hits.groupBy(query_col).agg(
        F.transform(ordered, lambda x: x["chunk_id"].cast("string")).alias("hit_chunk_ids"),
        F.transform(ordered, lambda x: x["doc_id"].cast("string")).alias("hit_doc_ids"),
        F.min("score").alias("score_min"),
        F.max("score").alias("score_max"),
    )
    none = F.array().cast("array<string>")
    return queries.join(per, query_col, "left").withColumn("top_k", F.lit(top_k)).withColumn("hit_chunk_ids", F.coalesce("hit_chunk_ids", none)).withColumn("hit_doc_ids", F.coalesce("hit_doc_ids", none))


def first_named(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """(key, terms): the names of a group in the order in which they come first, each once."""
    first = rows.groupBy(key, name).agg(F.min(order).alias("_first"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", name))), lambda x: x[name]).alias("terms"))


def expanded_query(text: Column, terms: Column, neighbours: Column) -> Column:
    """The question with the distinct names around it, in order, below."""
    names = F.array_distinct(F.concat(terms, neighbours))
    return F.when(F.size(names) > 0, F.concat(text, F.lit("\n\n"), F.array_join(names, " "))).otherwise(text)


def messages(system: str, context_: Column, question: Column) -> Column:
    """What a chat model is given; the answer's language follows the question's."""
    #: Fixed value by language.
    ask = F.when(X.query_language(question) == "ar", "Answer in Arabic.").when(X.query_language(question) == "en", "Answer in English.").otherwise("Answer in the language of the question.")
    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(turn("system", F.lit(system)), turn("user", F.concat_ws("\n\n", context_, ask, question)))


#: Words of a passage, all with a space on either side, that bring it and texts together.
PROBE_WORDS = 3


def texts_with(texts: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, id) of each passage (query_id, passage) and each text that holds it, character for character. Ids of texts are unique.

    A text that holds a passage has its inner words, those between two of its spaces, one after the other; so passages and
    texts are joined by the hash of the first PROBE_WORDS of them, and what meets is compared. Passages with fewer inner words
    are joined by their first letters, three at most, with the letter groups of the texts. A null holds nothing and is in
    nothing; the empty passage is in every text.
    """
    own = passages.where("passage is not null").select("query_id", "passage").withColumn("words", F.split("passage", " ", -1))
    rows = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    long_, short = (F.size("words") >= PROBE_WORDS + 2), (F.size("words") < PROBE_WORDS + 2)

    def hashed(words: Column, at: Column | int) -> Column:
        return F.xxhash64(F.array_join(F.slice(words, at, PROBE_WORDS), " "))

    asked = own.where(long_).select("query_id", "passage", hashed(F.col("words"), 2).alias("probe"))
    words = F.split("_text", " ", -1)
    # The words are one element of an array, so that a text is split once.
    probes = F.flatten(F.transform(F.array(words), lambda w: F.transform(F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: i + PROBE_WORDS - 1 <= F.size(w)), lambda i: hashed(w, i))))
    met = rows.select("_id", F.explode(F.array_distinct(probes)).alias("probe")).join(asked, "probe").select("query_id", "passage", "_id")
    few = own.where(short).select("query_id", "passage", F.left("passage", F.lit(3)).alias("probe"))
    if few.take(1):
        letters = F.concat(F.array(F.lit("")), *(X.windows(F.col("_text"), n) for n in (1, 2, 3)))
        met = met.unionByName(rows.select("_id", F.explode(F.array_distinct(letters)).alias("probe")).join(few, "probe").select("query_id", "passage", "_id"))
    return met.join(rows, "_id").where(F.contains("_text", F.col("passage"))).select("query_id", F.col("_id").alias(id_col))
