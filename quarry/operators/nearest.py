"""Exact nearest rows of many queries: blocks of queries against all rows, a matrix product a batch, the k best kept by task.

The queries are a stated set. They are sent to the tasks in blocks of a bounded size, one pass over the rows for each; a task
gives k rows a query at most, and the few of all tasks are ranked in the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of query vectors that are sent at once, numbers of one product, and pairs that are compared at once. They bound what a task
#: holds, however many rows and queries there are.
SENT_BYTES, PRODUCT, PAIRS = 8 << 20, 1 << 20, 1 << 15


def _blocks(queries: DataFrame, most: int) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, vectors) of the queries, by dimension, each block of `most` bytes or one query at least."""
    held: dict[int, list] = {}
    for r in queries.where("query is not null").select("query_id", F.col("query").cast("array<double>").alias("query")).toLocalIterator(prefetchPartitions=True):
        own = held.setdefault(len(r["query"]), [])
        own.append((r["query_id"], r["query"]))
        if len(own) * 8 * max(1, len(r["query"])) >= most:
            yield [q for q, _ in own], np.array([v for _, v in own], float)
            own.clear()
    for dim, own in held.items():
        if own and dim:
            yield [q for q, _ in own], np.array([v for _, v in own], float)


def _added(a: np.ndarray, b: np.ndarray, product) -> np.ndarray:
    """Sums over the components of pairs of rows, from the first to the last: every task and batch adds alike."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += product(a[:, i], b[:, i])
    return out


def _scores(vectors: np.ndarray, asked: np.ndarray, row: np.ndarray, query: np.ndarray, metric: str) -> np.ndarray:
    v, q = vectors[row], asked[query]
    if metric == "l2":
        return np.sqrt(_added(v, q, lambda x, y: (x - y) * (x - y)))
    with np.errstate(invalid="ignore", divide="ignore"):
        return _added(v, q, np.multiply) / np.sqrt(_added(v, v, np.multiply) * _added(q, q, np.multiply))


def _candidates(vectors: np.ndarray, asked: np.ndarray, k: int, metric: str, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) of all pairs that may be among the k best, so far and of a batch: a product says so up to its rounding.
    worst: the product that a pair has to reach to be better than the k that a query has."""
    own, there = (vectors**2).sum(1), (asked**2).sum(1)
    near = vectors @ asked.T
    if metric == "l2":
        near *= 2
        near -= own[:, None]
        near -= there  # the negative square
        slack = 1e-12 * vectors.shape[1] * there
        rounding = 1e-12 * vectors.shape[1] * own[:, None]
        near += rounding
    else:
        with np.errstate(invalid="ignore", divide="ignore"):
            near /= np.sqrt(own)[:, None]
            near /= np.sqrt(there)
        slack, rounding = np.full(len(asked), 2e-9), 0.0
    near[np.isnan(near)] = -np.inf
    least = worst - slack
    if len(near) > k and np.isneginf(worst).any():
        # k rows are at least as near as this.
        least = np.maximum(least, np.partition(near - 2 * rounding, -k, axis=0)[-k] - 2 * slack)
    return np.nonzero((near >= least) & (near > -np.inf))


class _Kept:
    """The k best of each query so far, nearest first: places that are free have no number as their key."""

    def __init__(self, queries: int, k: int, metric: str):
        self.k, self.metric = k, metric
        self.key, self.score = np.full((queries, k), np.inf), np.zeros((queries, k))
        self.id, self.worst = None, np.full(queries, -np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Similarities are compared rounded, as the order of their sums must not show; ties by id."""
        if not len(query):
            return
        if self.id is None:
            self.id = np.zeros(self.key.shape, ids.dtype)
        touched = np.unique(query)
        r, c = np.nonzero(np.isfinite(self.key[touched]))
        query = np.concatenate([query, touched[r]])
        key = score if self.metric == "l2" else -np.round(score, 9)
        key = np.concatenate([key, self.key[touched[r], c]])
        ids, score = np.concatenate([ids, self.id[touched[r], c]]), np.concatenate([score, self.score[touched[r], c]])
        order = np.lexsort((ids, key, query))
        query, key, ids, score = query[order], key[order], ids[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        best = place < self.k
        to = query[best], place[best]
        self.key[to], self.id[to], self.score[to] = key[best], ids[best], score[best]
        last = self.key[touched, -1]
        self.worst[touched] = -(last**2) * (1 + 1e-12) if self.metric == "l2" else np.where(np.isinf(last), -np.inf, -last - 1e-9)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, place = np.nonzero(np.isfinite(self.key))
        return query, self.id[query, place] if self.id is not None else place, self.score[query, place]


def _searcher(sent, k: int, metric: str, least: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked = sent.value
        kept = _Kept(len(asked), k, metric)
        step = max(1, PRODUCT // len(asked))
        for batch in batches:
            lists = batch.column("vector")
            fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(lists), asked.shape[1]), False))
            own = batch.filter(pa.array(fits))
            vectors = np.asarray(own.column("vector").flatten().to_numpy(zero_copy_only=False), float).reshape(-1, asked.shape[1])
            ids = own.column("id").to_numpy(zero_copy_only=False)
            whole = np.isfinite(vectors).all(1)
            vectors, ids = vectors[whole], ids[whole]
            for lo in range(0, len(vectors), step):
                some = vectors[lo : lo + step]
                row, query = _candidates(some, asked, k, metric, kept.worst)
                for at in range(0, len(row), PAIRS):
                    r, q = row[at : at + PAIRS], query[at : at + PAIRS]
                    score = _scores(some, asked, r, q, metric)
                    fine = ~np.isnan(score) if least is None else score >= least
                    kept.add(q[fine], ids[lo + r[fine]], score[fine])
        query, ids, score = kept.rows()
        for lo in range(0, len(query), PAIRS):
            part = slice(lo, lo + PAIRS)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in query[part].tolist()]), pa.array(ids[part]), pa.array(score[part])], ["query_id", "id", "score"])

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int, *, metric: str = "l2", id_col: str = "chunk_id", vector_col: str = "embedding", min_similarity: float | None = None, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(query_id, rank, id, score) of queries (query_id, query): the k rows of least distance, or of greatest cosine similarity, ties by id.

    Vectors that are null, have another dimension than a query or components that are null or not finite are none of its rows; zero
    vectors have no similarity. Every row and query takes part; a query without rows has none.
    """
    if k < 1 or metric not in ("l2", "cosine"):
        raise ValueError("k is from 1, metric l2 or cosine")
    spark = rows.sparkSession
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", rows.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    own = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    found = spark.createDataFrame([], schema)
    for block in _blocks(queries, sent_bytes):
        found = found.unionByName(own.mapInArrow(_searcher(spark.sparkContext.broadcast(block), k, metric, min_similarity), schema))
    by = F.col("score") if metric == "l2" else F.desc(F.round("score", 9))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(by, "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
