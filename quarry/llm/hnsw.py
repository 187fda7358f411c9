"""Approximate nearest neighbours with a hierarchical navigable small-world graph per shard.

Equal vectors are one node. Nodes are dealt over cells around centres, and a cell over shards of about SHARD_ROWS nodes.
A shard's graph grows by insertion: on each of its layers a node searches the graph that is there for its nearest ones,
is linked to a diverse choice of them, and they are linked back, with a new choice where that makes too many. Nodes come
in batches that are searched together, nodes of the upper layers first. What a search from the top would not reach at the
end gets a link from its nearest node that it does reach. A graph is stored as flat arrays.

A query goes to the shards of its nearest cell first. Its k-th distance there then rules out each cell whose ball around
its centre, or whose side of the plane half-way to the nearest centre, is further away; it goes to the others, and the
results are merged. So routing itself loses no neighbour. What the walk over a shard's graph found is checked against the shard, by a
matrix product, and what it missed is put in: that takes less than the walk, whose shards are the only ones that are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.runtime import Workspace, prepare, tidy

SHARD_ROWS = 8192
#: Centres at most, and rows a centre that they are fitted on: at most MOST_CELLS * SAMPLE_PER_CELL rows are sampled.
MOST_CELLS, SAMPLE_PER_CELL = 1024, 32
LINKS = 16
CONSTRUCTION = 64
BEAM = 128
MOST_NEIGHBOURS = 10
#: Queries of a shard that are searched in one row of a task.
QUERY_BLOCK = 2048
_TOGETHER, _AHEAD, _FIRST = 256, 4, 64
#: Links that a node gets to nodes that no walk gets to otherwise.
_ADOPTED = 16


@dataclass
class Graph:
    vectors: np.ndarray  # node by dimension
    ids: np.ndarray  # of all nodes, one after the other
    bounds: np.ndarray  # node i has ids[bounds[i]:bounds[i + 1]], ascending
    nodes: list[np.ndarray]  # of each layer, from the lowest
    neighbours: list[np.ndarray]  # of each layer: a row for every node of the shard on it, -1 where there is none

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, links: int = LINKS, candidates: int = CONSTRUCTION, seed: int = 7) -> Graph:
        distinct, node = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, node.ravel()))
        n = len(distinct)
        bounds = np.searchsorted(node.ravel()[order], np.arange(n + 1))
        rng = np.random.default_rng(seed)
        level = np.floor(-np.log(1 - rng.random(n)) / np.log(links)).astype(int)
        turn = rng.permutation(n)
        out = cls(distinct, ids[order], bounds, [], [])
        points = _points(distinct, distinct)[0]
        for layer in range(int(level.max(initial=0)), -1, -1):
            own = np.flatnonzero(level >= layer)
            # Nodes that are on the layer above, too, come first; others in a random order.
            order = own[np.lexsort((turn[own], -np.minimum(level[own], layer + 1)))]
            entry = None
            if out.nodes:
                above = np.concatenate([out._layers(points, points[order[i : i + _TOGETHER]], CONSTRUCTION, links) for i in range(0, len(order), _TOGETHER)])
                entry = np.where(above >= 0, np.searchsorted(own, out.nodes[0][above]), -1)
            rows = _insert(points[own], np.searchsorted(own, order), entry, links, 2 * links if layer == 0 else links, candidates)
            out.nodes.insert(0, own)
            out.neighbours.insert(0, rows)
        return out

    def _layers(self, points: np.ndarray, queries: np.ndarray, beam: int, keep: int, to: int = 0) -> np.ndarray:
        """Rows on layer `to` of the nearest nodes there to each query, after a descent from the top."""
        found = np.zeros((len(queries), 1), np.int64)
        for layer in range(len(self.nodes) - 1, to - 1, -1):
            own = self.nodes[layer]
            found, _ = _descend(points[own], self.neighbours[layer], queries, found, beam)
            found = found[:, :keep] if layer == to else np.where(found >= 0, np.searchsorted(self.nodes[layer - 1], own[found]), -1)
        return found

    def search(self, queries: np.ndarray, beam: int) -> np.ndarray:
        """The nearest nodes found, by query; -1 where there are no more."""
        if not len(self.vectors):
            return np.full((len(queries), 1), -1, np.int64)
        points, asked = _points(self.vectors, queries)
        return self._layers(points, asked, beam, beam)


#: Queries that are so many times as long as the longest vector are shortened: in double precision all vectors are equally far.
_FARTHEST = 1e100


def _points(vectors: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and queries as a walk compares them: of unit scale, in double precision. Single precision would not tell the
    members of a narrow cluster apart, nor anything beside a vector that is much longer than the others."""
    scale = np.abs(vectors).max(initial=0) or 1.0
    with np.errstate(over="ignore"):
        reach = np.abs(queries).max(1, initial=0) / scale
        far = reach > _FARTHEST
        asked = queries / scale
    if far.any():
        asked[far] = queries[far] / np.abs(queries[far]).max(1, keepdims=True) * _FARTHEST
    return vectors / scale, asked


#: Vectors of one graph have lengths between two powers of 2**MAGNITUDE: then the squares of differences stay in range.
MAGNITUDE = 256


def _squares(points: np.ndarray, a: np.ndarray, others: np.ndarray, b: np.ndarray) -> np.ndarray:
    step = points[a] - others[b]
    return np.einsum("ij,ij->i", step, step)


def _choose(points: np.ndarray, near: np.ndarray, distance: np.ndarray, most: int) -> np.ndarray:
    """Which of each row's candidates (nearest first, -1 for none) are kept: those nearer to the row's node than to any
    kept before, up to `most`."""
    n, k = near.shape
    v = points[np.maximum(near, 0)]
    v -= v[:, :1].copy()  # from the nearest one: differences of near points keep their digits
    norm = np.einsum("ijk,ijk->ij", v, v)
    chosen = np.zeros((n, k), bool)
    blocked = near < 0
    for j in range(k):
        take = ~blocked[:, j] & (chosen.sum(1) < most)
        chosen[:, j] = take
        rows = np.flatnonzero(take)
        if len(rows) and j + 1 < k:
            between = norm[rows, j + 1 :] + norm[rows, j, None] - 2 * np.einsum("ijk,ik->ij", v[rows, j + 1 :], v[rows, j])
            blocked[rows, j + 1 :] |= between < distance[rows, j + 1 :]
    return chosen


def _left_packed(values: np.ndarray, chosen: np.ndarray, width: int) -> np.ndarray:
    """The chosen values of each row, moved to its beginning; -1 behind them."""
    order = np.argsort(~chosen, axis=1, kind="stable")[:, :width]
    return np.where(np.take_along_axis(chosen, order, 1), np.take_along_axis(values, order, 1), -1)


def _insert(points: np.ndarray, order: np.ndarray, entry: np.ndarray | None, links: int, most: int, candidates: int) -> np.ndarray:
    """Neighbours of each node of a layer after all were inserted in an order. entry: nodes from which each insertion's search
    begins, in that order; those that are not there yet don't count."""
    n = len(points)
    out = np.full((n, most), -1, np.int32)
    there = np.zeros(n, bool)
    done = 0
    while done < n:
        batch = order[done : done + (_FIRST if not done else min(done, _TOGETHER))]
        # What the graph has near each node, and what else is in the batch.
        between = np.array([_squares(points, np.full(len(batch), b), points, batch) for b in batch]).reshape(len(batch), len(batch))
        np.fill_diagonal(between, np.inf)
        some = np.argsort(between, axis=1, kind="stable")[:, : links * 2 if done else candidates]
        near, distance = batch[some], np.take_along_axis(between, some, 1)
        if done:
            first = np.full((len(batch), 1), order[0])
            if entry is not None:
                own = entry[done : done + len(batch)]
                first = np.concatenate([np.where((own >= 0) & there[own], own, -1), first], 1)
                first[:, -1] = np.where((first[:, :-1] == order[0]).any(1), -1, order[0])
            found, d = _descend(points, out, points[batch], first, candidates)
            near, distance = np.concatenate([near, found], 1), np.concatenate([distance, d], 1)
        near = np.where(np.isfinite(distance), near, -1)
        by = np.argsort(distance, axis=1, kind="stable")[:, :candidates]
        near, distance = np.take_along_axis(near, by, 1), np.take_along_axis(distance, by, 1)
        chosen = _choose(points, near, distance, links)
        out[batch, : min(most, near.shape[1])] = _left_packed(near, chosen, most)
        r, c = np.nonzero(chosen)
        _link_back(points, out, near[r, c], batch[r], distance[r, c])
        there[batch] = True
        done += len(batch)
    return out if not n else _reachable(points, out, order[0] if entry is None else np.unique(entry[entry >= 0]), candidates)


def _link_back(points: np.ndarray, out: np.ndarray, to: np.ndarray, new: np.ndarray, distance: np.ndarray) -> None:
    """Put each new node among the neighbours of the one that it was linked to; where there are too many, choose again."""
    most = out.shape[1]
    have = (out[to] == new[:, None]).any(1)
    to, new, distance = to[~have], new[~have], distance[~have]
    order = np.lexsort((distance, to))
    to, new = to[order], new[order]
    nodes, first, many = np.unique(to, return_index=True, return_counts=True)
    for lo in range(0, len(nodes), _TOGETHER):
        own = nodes[lo : lo + _TOGETHER]
        count = np.minimum(many[lo : lo + _TOGETHER], 3 * most)
        width = int(count.max())
        at = np.arange(width)
        more = np.where(at < count[:, None], new[np.minimum(first[lo : lo + _TOGETHER, None] + at, len(new) - 1)], -1)
        near = np.concatenate([out[own], more], 1).astype(np.int64)
        r, c = np.nonzero(near >= 0)
        d = np.full(near.shape, np.inf, points.dtype)
        d[r, c] = _squares(points, near[r, c], points, own[r])
        by = np.argsort(d, axis=1, kind="stable")
        near, d = np.take_along_axis(near, by, 1), np.take_along_axis(d, by, 1)
        full = (near >= 0).sum(1) > most
        chosen = near >= 0
        if full.any():
            chosen[full] = _choose(points, near[full], d[full], most)
        out[own] = _left_packed(near, chosen, most)


def _reach(rows: np.ndarray, begin) -> np.ndarray:
    """Which nodes a walk over neighbours gets to."""
    seen = np.zeros(len(rows), bool)
    seen[begin] = True
    front = np.flatnonzero(seen)
    while len(front):
        near = rows[front].ravel()
        near = np.unique(near[near >= 0])
        front = near[~seen[near]]
        seen[front] = True
    return seen


def _reachable(points: np.ndarray, rows: np.ndarray, begin, beam: int) -> np.ndarray:
    """Neighbours with a link to every node that no walk gets to, from the nearest node that one does get to."""
    begin = np.atleast_1d(begin)
    lost = np.flatnonzero(~_reach(rows, begin))
    if not len(lost):
        return rows
    entry = np.broadcast_to(begin[:16], (len(lost), len(begin[:16])))
    nearest = np.concatenate([_descend(points, rows, points[lost[i : i + _TOGETHER]], entry[i : i + _TOGETHER], beam)[0][:, 0] for i in range(0, len(lost), _TOGETHER)])
    order = np.argsort(nearest, kind="stable")
    nearest, lost = nearest[order], lost[order]
    # A node takes a few of them; the others are linked from these, and so on, so that rows stay short.
    first = np.searchsorted(nearest, nearest)
    place = np.arange(len(lost)) - first
    parent = np.where(place < _ADOPTED, nearest, lost[first + np.maximum(place - _ADOPTED, 0) // _ADOPTED])
    more = np.full((len(rows), min(_ADOPTED, int(place.max()) + 1)), -1, np.int32)
    free = np.full(len(rows), 0)
    for own, node in zip(parent.tolist(), lost.tolist(), strict=True):
        more[own, free[own]] = node
        free[own] += 1
    return np.concatenate([rows, more], 1)


def _descend(points: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search with a beam, of all queries together, some nodes of each a step. Returns (nodes, squared distances) of
    the beams, nearest first, -1 and infinity behind them. entry: distinct nodes of each query, -1 for none."""
    q, n = len(queries), len(points)
    width = max(beam, entry.shape[1])
    pool = np.full((q, width), -1, np.int64)
    distance = np.full((q, width), np.inf, points.dtype)
    pool[:, : entry.shape[1]] = entry
    seen = np.zeros((q, n), bool)
    r, c = np.nonzero(entry >= 0)
    seen[r, entry[r, c]] = True
    distance[r, c] = _squares(points, entry[r, c], queries, r)
    open_ = pool >= 0
    active = np.arange(q)
    while True:
        ahead = np.where(open_[active], distance[active], np.inf)
        live = np.isfinite(ahead).any(1)
        active, ahead = active[live], ahead[live]
        if not len(active):
            break
        step = min(_AHEAD, width)
        at = np.argpartition(ahead, step - 1, axis=1)[:, :step] if step < width else np.broadcast_to(np.arange(width), ahead.shape)
        fine = np.isfinite(np.take_along_axis(ahead, at, 1))
        current = np.where(fine, np.take_along_axis(pool[active], at, 1), -1)
        open_[active[:, None], at] = False
        near = np.where(current[:, :, None] >= 0, neighbours[current], -1).reshape(len(active), -1).astype(np.int64)
        near.sort(axis=1)
        fresh = (near >= 0) & ~seen[active[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        r, c = np.nonzero(fresh)
        node = near[r, c]
        seen[active[r], node] = True
        d = np.full(near.shape, np.inf, points.dtype)
        d[r, c] = _squares(points, node, queries, active[r])
        all_d = np.concatenate([distance[active], d], 1)
        all_p = np.concatenate([pool[active], np.where(fresh, near, -1)], 1)
        all_o = np.concatenate([open_[active], fresh], 1)
        best = np.argpartition(all_d, width - 1, axis=1)[:, :width]
        distance[active], pool[active], open_[active] = (np.take_along_axis(x, best, 1) for x in (all_d, all_p, all_o))
    by = np.argsort(distance, axis=1, kind="stable")[:, :beam]
    return np.take_along_axis(pool, by, 1), np.take_along_axis(distance, by, 1)


# Cells


def _gaps(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of points to centres, without the cancellation of squares for near ones."""
    out = np.empty((len(points), len(centres)))
    for lo in range(0, len(points), 64):
        out[lo : lo + 64] = np.sqrt(((points[lo : lo + 64, None] - centres) ** 2).sum(2))
    return out


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k-means; a centre that is left without points goes."""
    sample = np.unique(sample, axis=0)
    centres = sample[np.random.default_rng(seed).permutation(len(sample))[:cells]]
    for _ in range(rounds):
        own = np.concatenate([_gaps(sample[i : i + 1024], centres).argmin(1) for i in range(0, len(sample), 1024)])
        centres = np.stack([sample[own == c].mean(0) for c in np.unique(own)])
    return centres


@dataclass
class Index:
    """shards: a row for each graph. cells: (dim, cell, shards, radius). centres: by dimension, where there are several cells.
    k: neighbours that may be asked for."""

    shards: DataFrame
    cells: DataFrame
    centres: dict[int, np.ndarray]
    k: int


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector, dim) of the rows that take part: with an id, and a vector that isn't null or zero and has finite
    components alone."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.withColumn("vector", F.transform("vector", lambda x: x + 0.0)).withColumn("dim", F.size("vector"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(-1, dim)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = np.asarray(batch.column("dim"))
    for dim in np.unique(dims).tolist():
        yield dim, batch.filter(pa.array(dims == dim))


def _assigner(sent):
    """Rows with their nearest centre and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, own in _by_dim(batch):
                centres = sent.value.get(dim)
                cell, far = np.zeros(own.num_rows, np.int32), np.zeros(own.num_rows)
                if centres is not None:
                    gaps = _gaps(_matrix(own.column("vector"), dim), centres)
                    cell = gaps.argmin(1).astype(np.int32)
                    far = gaps[np.arange(len(cell)), cell]
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cell), pa.array(far)], [*own.schema.names, "cell", "far"])

    return run


_GRAPH = "dim int, cell int, shard int, nodes array<binary>, neighbours array<binary>, widths array<int>, vectors binary, ids binary, bounds binary"


def _build_group(key: tuple, table: pa.Table) -> pa.Table:
    dim = key[0].as_py()
    g = Graph.build(np.asarray(table.column("vec_id").combine_chunks()), _matrix(table.column("vector"), dim))
    return pa.table(
        {
            "dim": pa.array([dim], pa.int32()),
            "cell": pa.array([key[1].as_py()], pa.int32()),
            "shard": pa.array([key[2].as_py()], pa.int32()),
            "nodes": pa.array([[x.astype("<i8").tobytes() for x in g.nodes]], pa.list_(pa.binary())),
            "neighbours": pa.array([[x.astype("<i4").tobytes() for x in g.neighbours]], pa.list_(pa.binary())),
            "widths": pa.array([[x.shape[1] for x in g.neighbours]], pa.list_(pa.int32())),
            "vectors": pa.array([g.vectors.astype("<f8").tobytes()], pa.binary()),
            "ids": pa.array([g.ids.astype("<i8").tobytes()], pa.binary()),
            "bounds": pa.array([g.bounds.astype("<i8").tobytes()], pa.binary()),
        }
    )


def _load(row: dict) -> Graph:
    return Graph(
        np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"]),
        np.frombuffer(row["ids"], "<i8"),
        np.frombuffer(row["bounds"], "<i8"),
        [np.frombuffer(x, "<i8") for x in row["nodes"]],
        [np.frombuffer(x, "<i4").reshape(-1, w) for x, w in zip(row["neighbours"], row["widths"], strict=True)],
    )


def build_index(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, k: int = MOST_NEIGHBOURS, workspace: Workspace | None = None) -> Index:
    """Graphs over every distinct vector. Vectors of different dimension are in different shards.

    Of the rows with equal vectors the node lists the k + 1 of least ids: as ties go to the smaller id, and one of them may
    be the query itself, the others can be among no query's k nearest. Rows with one id are rows of their own. Centres are
    fitted on at most MOST_CELLS * SAMPLE_PER_CELL rows, drawn by a hash of their vectors; every row is indexed.
    """
    spark = vectors.sparkSession
    prepare(spark)
    ws = workspace or Workspace(spark, "hnsw")
    copies = Window.partitionBy("vector").orderBy("vec_id")
    # An id that has a vector several times has it once.
    counted = usable(vectors, id_col, vector_col).withColumns({"copy": F.dense_rank().over(copies), "before": F.lag("vec_id").over(copies)})
    rows = ws.table(counted.where((F.col("copy") <= k + 1) & ~F.col("before").eqNullSafe(F.col("vec_id"))).drop("before"), "rows")
    large = rows.groupBy("dim").agg(F.count("*").alias("n")).where(F.col("n") > shard_rows).collect()
    centres = {}
    for r in large:
        cells = min(MOST_CELLS, -(-r["n"] // shard_rows))
        drawn = rows.where((F.col("dim") == r["dim"]) & (F.col("copy") == 1)).select("vector").orderBy(F.xxhash64("vector")).limit(cells * SAMPLE_PER_CELL)
        centres[r["dim"]] = fit_centres(np.array([x["vector"] for x in drawn.toLocalIterator()]), cells)
    sent = spark.sparkContext.broadcast(centres)
    placed = ws.table(rows.drop("copy").mapInArrow(tidy(_assigner(sent)), "vec_id long, vector array<double>, dim int, cell int, far double"), "placed")
    magnitude = F.floor(F.log2(F.array_max(F.transform("vector", lambda x: F.abs(x)))) / MAGNITUDE).cast("int")
    placed = placed.withColumn("magnitude", magnitude)
    parts = placed.groupBy("dim", "cell", "magnitude").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("own"), F.max("far").alias("radius"))
    upto = Window.partitionBy("dim", "cell").orderBy("magnitude").rowsBetween(Window.unboundedPreceding, -1)
    parts = ws.table(parts.withColumn("before", F.coalesce(F.sum("own").over(upto), F.lit(0))), "parts")
    cells = ws.table(parts.groupBy("dim", "cell").agg(F.sum("own").cast("int").alias("shards"), F.max("radius").alias("radius")), "cells")
    shard = (F.col("before") + F.pmod(F.xxhash64("vector"), F.col("own"))).cast("int")
    dealt = placed.join(parts.drop("radius"), ["dim", "cell", "magnitude"]).select("dim", "cell", shard.alias("shard"), "vec_id", "vector")
    shards = ws.table(dealt.groupBy("dim", "cell", "shard").applyInArrow(_build_group, _GRAPH), "shards")
    ws.drop("rows")
    ws.drop("placed")
    return Index(shards, cells, centres, k)


# Search


def _searcher(k: int, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                graph = _load(row)
                reps = np.array([x["rep"] for x in row["asked"]])
                queries = np.array([x["vector"] for x in row["asked"]], float)
                for lo in range(0, len(reps), _TOGETHER):
                    yield _best(graph, reps[lo : lo + _TOGETHER], queries[lo : lo + _TOGETHER], k, max(beam, 2 * k))

    return run


def _length(step: np.ndarray) -> np.ndarray:
    """Euclidean lengths, the squares added from the first to the last, also where they leave the range of numbers."""
    out = np.zeros(len(step))
    with np.errstate(over="ignore"):
        for column in step.T:
            out += column * column
        out = np.sqrt(out)
    odd = ~np.isfinite(out)
    if odd.any():
        most = np.abs(step[odd]).max(1)
        out[odd] = most * np.sqrt(((step[odd] / most[:, None]) ** 2).sum(1))
    return out


def _nearest_rows(graph: Graph, vector: np.ndarray, nodes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k + 1 nearest rows of some nodes, ties by id; an id that has several comes once, with its least score."""
    many = np.minimum(np.diff(graph.bounds)[nodes], k + 1)
    ids = np.concatenate([np.zeros(0, np.int64), *(graph.ids[graph.bounds[x] : graph.bounds[x] + m] for x, m in zip(nodes.tolist(), many.tolist(), strict=True))])
    score = np.repeat(_length(graph.vectors[nodes] - vector), many)
    order = np.lexsort((ids, score))
    ids, score = ids[order], score[order]
    first = np.unique(ids, return_index=True)[1]
    first.sort()
    return ids[first[: k + 1]], score[first[: k + 1]]


def _missed(graph: Graph, queries: np.ndarray, nodes: np.ndarray, reached: np.ndarray) -> list[np.ndarray]:
    """The exact check behind a walk: by query, the nodes of the shard that it did not give and that may be as near as what it reached,
    up to the rounding of a product. Where distances tie, or a query is so far away that they all look alike, a walk can't tell which to follow."""
    points, asked = _points(graph.vectors, queries)
    scale = np.abs(graph.vectors).max(initial=0) or 1.0
    own, there = np.einsum("ij,ij->i", points, points), np.einsum("ij,ij->i", asked, asked)
    with np.errstate(over="ignore", invalid="ignore"):
        square = there[:, None] + own - 2 * (asked @ points.T)
        square -= 1e-14 * (points.shape[1] + 16) * (there[:, None] + own)
        may = ~(square > ((reached / scale) ** 2 * (1 + 1e-9))[:, None])
        may |= (np.abs(queries).max(1, initial=0) / scale > _FARTHEST)[:, None]
    r, c = np.nonzero(nodes >= 0)
    may[r, nodes[r, c]] = False
    return [np.flatnonzero(x) for x in may]


def _best(graph: Graph, reps: np.ndarray, queries: np.ndarray, k: int, beam: int) -> pa.RecordBatch:
    """The k + 1 nearest rows of a shard to each query: its own may be one of them. What a walk found is checked against the shard."""
    nodes = graph.search(queries, beam)
    found = [_nearest_rows(graph, vector, own[own >= 0], k) for vector, own in zip(queries, nodes, strict=True)]
    reached = np.array([score[k] if len(score) > k else np.inf for _, score in found])
    out = []
    for i, more in enumerate(_missed(graph, queries, nodes, reached)):
        if len(more):
            found[i] = _nearest_rows(graph, queries[i], np.concatenate([nodes[i][nodes[i] >= 0], more]), k)
        out.append((np.full(len(found[i][0]), reps[i]), *found[i]))
    q, v, s = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], ["rep", "vec_id", "score"])


def _further(sent):
    """(rep, vector, dim, cell) of the other cells that may hold one of the nearest, from the distance that was reached."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radius = sent.value
        for batch in batches:
            for dim, own in _by_dim(batch):
                if dim not in centres:
                    continue
                points, c = _matrix(own.column("vector"), dim), centres[dim]
                gaps = _gaps(points, c)
                nearest = np.asarray(own.column("cell"))
                between = _gaps(c, c)[nearest]
                with np.errstate(invalid="ignore", divide="ignore"):
                    plane = (gaps**2 - (gaps[np.arange(len(gaps)), nearest] ** 2)[:, None]) / (2 * between)
                with np.errstate(invalid="ignore"):
                    least = np.fmax(plane, gaps - radius[dim])
                # What is no number, beyond the range of squares, rules nothing out.
                may = ~(least * (1 - 1e-9) > np.asarray(own.column("reached"))[:, None])
                may &= radius[dim] >= 0
                may[np.arange(len(gaps)), nearest] = False
                r, cell = np.nonzero(may)
                some = own.take(pa.array(r))
                yield pa.RecordBatch.from_arrays([some.column("rep"), some.column("vector"), some.column("dim"), pa.array(cell.astype(np.int32))], ["rep", "vector", "dim", "cell"])

    return run


def _ask(index: Index, pairs: DataFrame, k: int, beam: int, block: int) -> DataFrame:
    """(rep, vec_id, score) of queries (rep, vector, dim, cell) in the shards of their cells. pairs: a table."""
    key = ["dim", "cell"]
    blocks = pairs.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    # The shards of a cell are rows to join: a cell of many shards has its queries copied to each.
    each = index.cells.join(blocks, key).select(*key, "blocks", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    asked = pairs.join(each, key).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    grouped = asked.groupBy(*key, "shard", "block").agg(F.collect_list(F.struct("rep", "vector")).alias("asked"))
    return grouped.join(index.shards, [*key, "shard"]).mapInArrow(tidy(_searcher(k, beam)), "rep long, vec_id long, score double")


def search(index: Index, queries: DataFrame, *, k: int = MOST_NEIGHBOURS, beam: int = BEAM, id_col: str = "vec_id", vector_col: str = "embedding", block: int = QUERY_BLOCK, workspace: Workspace | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, nearest first, ties by smaller id, with their exact
    Euclidean distances. A query's own id is no candidate. Queries that take no part (see `usable`) have no rows; of query
    rows with one id the least vector counts; a candidate id that has several rows comes once, with its least distance;
    vectors of another dimension than a query's are no candidates. Equal queries are searched once.
    """
    if k > index.k:
        raise ValueError(f"the index was built for {index.k} neighbours")
    spark = queries.sparkSession
    prepare(spark)
    ws = workspace or Workspace(spark, "hnsw-search")
    own = ws.table(usable(queries, id_col, vector_col).groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumnRenamed("vec_id", "query_id"), "queries")
    reps = own.groupBy("vector").agg(F.min("query_id").alias("rep")).withColumn("dim", F.size("vector"))
    sent = spark.sparkContext.broadcast(index.centres)
    placed = ws.table(reps.select("rep", "vector", "dim").mapInArrow(tidy(_assigner(sent)), "rep long, vector array<double>, dim int, cell int, far double").drop("far"), "placed")
    found = ws.table(_ask(index, placed, k, beam, block), "near")
    if index.centres:
        radius = {dim: np.full(len(c), -1.0) for dim, c in index.centres.items()}
        for r in index.cells.where(F.col("dim").isin(*index.centres)).collect():  # MOST_CELLS rows a dimension at most
            radius[r["dim"]][r["cell"]] = r["radius"]
        last = Window.partitionBy("rep").orderBy("score", "vec_id")
        reached = found.groupBy("rep", "vec_id").agg(F.min("score").alias("score")).withColumn("n", F.row_number().over(last)).where(F.col("n") == k + 1).select("rep", F.col("score").alias("reached"))
        bound = placed.join(reached, "rep", "left").withColumn("reached", F.coalesce("reached", F.lit(float("inf"))))
        routing = spark.sparkContext.broadcast((index.centres, radius))
        more = ws.table(bound.mapInArrow(_further(routing), "rep long, vector array<double>, dim int, cell int"), "more")
        found = found.unionByName(ws.table(_ask(index, more, k, beam, block), "far"))
    members = own.join(placed.select("rep", "vector"), "vector").select("rep", "query_id")
    once = found.groupBy("rep", "vec_id").agg(F.min("score").alias("score"))
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    pairs = once.join(members, "rep").where("vec_id <> query_id")
    return pairs.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
