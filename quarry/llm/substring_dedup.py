"""Removal of repeated word windows by compaction of a De Bruijn graph.

A window of 20 words is an edge of the graph, from its first 19 words to its last 19. Consecutive edges of a document
that share one minimiser (the least hash of the 8-word runs in the window) are taken together before anything is shuffled:
such a piece is a path from one node to another, about one row for seven edges. Equal pieces are one piece of the graph.

1. count the pieces of each minimiser (combined before the shuffle) and keep those of repeated minimisers, by a join;
2. of equal pieces take the smallest document and the place there: the source coordinates;
3. compaction: join the repeated pieces with the degrees of the nodes that they begin at; pieces that follow each other at
   their sources over a node that one repeated piece enters and one leaves, and that occur as often, are one path;
4. all occurrences but the source's are repeats; those of one compacted path that follow each other in a document are one
   span, and its words are verified at the source coordinates: both are read again and compared by a digest;
5. where a minimiser has different pieces, the graph branches within them: the single edges of their first occurrences are
   read at the source coordinates and compared, so that every edge's first document is known;
6. join the repeated spans with the documents, add what repeats within a document, and remove.

Pieces and edges count as equal if both their minimisers and their contents have the same 64-bit hashes; spans are verified
with a 128-bit BLAKE2 digest of their words, and one that fails is no repeat. A hot piece is one row per document at most
and its aggregation is combined before the shuffle; joins have plain exchanges or tables on both sides, so that adaptive
execution splits them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.runtime import Workspace, own_columns, prepare, tidy
from quarry.llm.words import SPACE, Grid, Rolling, mix, ranges, slices, sliding_min, take_runs, within, words

WINDOW = 20
ANCHOR = 8

_SPANS = "array<struct<start:int,n:int>>"
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _in_text(owner: np.ndarray, *hashes: np.ndarray) -> np.ndarray:
    """One key of a text and hashes."""
    key = owner.astype(np.uint64) * _GOLD
    for h in hashes:
        key = mix(key ^ h)
    return key


def paths(grid: Grid, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, first word, edges, minimiser, content, first node, last node) of each run of consecutive windows with one
    minimiser; of equal runs in a text the first."""
    rolling = Rolling(grid.hashes())
    least = sliding_min(rolling.windows(anchor), window - anchor + 1)
    at = within(grid, window)
    owner = np.repeat(np.arange(len(grid.first) - 1), np.maximum(grid.counts - window + 1, 0))
    m = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (m[1:] != m[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    start, owner, m = at[first], owner[first], m[first]
    content = rolling.of(start, start + n - 1 + window)
    _, kept = np.unique(_in_text(owner, m, content), return_index=True)
    kept.sort()
    owner, start, n, m, content = owner[kept], start[kept], n[kept], m[kept], content[kept]
    return owner, start, n, m, content, rolling.of(start, start + window - 1), rolling.of(start + n, start + n + window - 1)


def _repeats_inside(grid: Grid, window: int) -> np.ndarray:
    """Starts of the windows that start earlier in their own text, too."""
    at = within(grid, window)
    owner = np.repeat(np.arange(len(grid.first) - 1), np.maximum(grid.counts - window + 1, 0))
    keys = _in_text(owner, Rolling(grid.hashes()).windows(window)[at])
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return at[:0]
    twice = np.unique(twice)
    place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    some = np.flatnonzero(twice[place] == keys)
    _, first = np.unique(keys[some], return_index=True)
    later = np.ones(len(some), bool)
    later[first] = False
    return at[some[later]]


_PIECES = "m long, h long, doc_id long, start int, n int, enters long, leaves long"


def _path_batches(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, data, bounds in slices(batch.column("text")):
                grid = words(data, bounds, SPACE)
                owner, start, n, *hashes = paths(grid, window, anchor)
                m, content, first, last = (pa.array(x.view(np.int64)) for x in hashes)
                yield pa.RecordBatch.from_arrays(
                    [m, content, ids.slice(lo, hi - lo).take(pa.array(owner)), pa.array((start - grid.first[owner]).astype(np.int32)), pa.array(n.astype(np.int32)), first, last],
                    ["m", "h", "doc_id", "start", "n", "enters", "leaves"],
                )

    return run


def _span_arrays(column: pa.Array, rows: int, *fields: str) -> tuple[np.ndarray, ...]:
    """(text, and each field) of a column of lists of structs; null lists have none, and null numbers are -1."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    owner = np.repeat(np.arange(rows), np.asarray(column.value_lengths().fill_null(0)))
    flat = column.flatten()
    return owner, *(np.asarray(flat.field(f).fill_null(-1)).astype(np.int64) for f in fields)


def _digests(grid: Grid, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """A 128-bit digest of the words start[i] to end[i], joined by a space."""
    return pa.array([hashlib.blake2b(take_runs(grid.data, grid.start[a:b], grid.end[a:b]), digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)], pa.binary())


_READ = "kind int, doc_id long, start int, n int, source long, source_start int, digest binary, m long, h long"


def _read_batches(window: int, anchor: int):
    """What is asked of a document: its repeats (with a source), those of one path joined to spans (kind 0) with a digest of their
    words; and the single edges (kind 1) of the pieces without a source, equal ones of a document once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, data, bounds in slices(batch.column("text")):
                grid = words(data, bounds, SPACE)
                own = ids.slice(lo, hi - lo)
                owner, start, n, source, there, head = _span_arrays(batch.column("asked").slice(lo, hi - lo), hi - lo, "start", "n", "source", "source_start", "head")
                # Rows that share an id are asked the same: each answers for what lies within its own words.
                fits = start + n - 1 + window <= grid.counts[owner]
                owner, start, n, source, there, head = (x[fits] for x in (owner, start, n, source, there, head))
                repeat = there >= 0

                o, s, k, d, t, g = (x[repeat] for x in (owner, start, n, source, there, head))
                order = np.lexsort((s, s - t, g, d, o))
                o, s, k, d, t, g = (x[order] for x in (o, s, k, d, t, g))
                new = np.ones(len(o), bool)
                new[1:] = (o[1:] != o[:-1]) | (d[1:] != d[:-1]) | (g[1:] != g[:-1]) | (s[1:] - t[1:] != s[:-1] - t[:-1]) | (s[1:] != s[:-1] + k[:-1])
                first = np.flatnonzero(new)
                edges = np.add.reduceat(k, first) if len(first) else k[:0]
                o, s, d, t = o[first], s[first], d[first], t[first]
                begin = s + grid.first[o]
                zeros = pa.array(np.zeros(len(o), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(o), np.int32)), own.take(pa.array(o)), pa.array(s.astype(np.int32)), pa.array(edges.astype(np.int32)), pa.array(d), pa.array(t.astype(np.int32)), _digests(grid, begin, begin + edges - 1 + window), zeros, zeros],
                    _names(_READ),
                )

                o, at = np.repeat(owner[~repeat], n[~repeat]), ranges((start + grid.first[owner])[~repeat], n[~repeat])
                rolling = Rolling(grid.hashes())
                m = sliding_min(rolling.windows(anchor), window - anchor + 1)[at]
                h = rolling.of(at, at + window)
                _, kept = np.unique(_in_text(o, m, h), return_index=True)
                ones, size = pa.array(np.ones(len(kept), np.int32)), len(kept)
                yield pa.RecordBatch.from_arrays(
                    [ones, own.take(pa.array(o[kept])), pa.array((at - grid.first[o])[kept].astype(np.int32)), ones, pa.nulls(size, pa.int64()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary()), pa.array(m[kept].view(np.int64)), pa.array(h[kept].view(np.int64))],
                    _names(_READ),
                )

    return run


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


_PROOF = "source long, source_start int, n int, digest binary"


def _proof_batches(window: int):
    """Digests of the words at source coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in slices(batch.column("text")):
                grid = words(data, bounds, SPACE)
                owner, start, n = _span_arrays(batch.column("asked").slice(lo, hi - lo), hi - lo, "source_start", "n")
                fits = start + n - 1 + window <= grid.counts[owner]
                owner, start, n = owner[fits], start[fits], n[fits]
                begin = start + grid.first[owner]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo).take(pa.array(owner)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), _digests(grid, begin, begin + n - 1 + window)],
                    _names(_PROOF),
                )

    return run


def compacted(pieces: DataFrame) -> DataFrame:
    """The pieces (m, h, source, source_start, n, times, enters, leaves) with `head`: where, at its source, the path begins that a
    repeated piece is part of; null for a piece that occurs once.

    A node is simple if one repeated piece leads to it and one away from it. Over such a node a piece continues the path of
    the piece before it, if that is the one before it at its source, too, and both occur equally often.
    """
    repeated = pieces.where("times > 1")
    to, away = (repeated.groupBy(F.col(c).alias("node")).agg(F.count("*").alias(c)).where(F.col(c) == 1) for c in ("leaves", "enters"))
    simple = to.join(away, "node").select("node", F.lit(True).alias("simple"))
    joined = repeated.join(simple, F.col("enters") == F.col("node"), "left")
    at_source = Window.partitionBy("source").orderBy("source_start")
    before = F.lag(F.struct((F.col("source_start") + F.col("n")).alias("end"), "times", "leaves")).over(at_source)
    follows = F.coalesce(F.col("simple") & (before["end"] == F.col("source_start")) & (before["times"] == F.col("times")) & (before["leaves"] == F.col("enters")), F.lit(False))
    heads = joined.withColumn("_begins", F.when(~follows, F.col("source_start"))).withColumn("head", F.last("_begins", True).over(at_source))
    columns = ["m", "h", "source", "source_start"]
    return heads.select(*columns, "head").unionByName(pieces.where("times = 1").select(*columns, F.lit(None).cast("int").alias("head")))


def repeated_spans(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", workspace: Workspace | None = None) -> DataFrame:
    """(doc_id, spans): for each document with windows that a document of smaller id has, too, their ranges as (start, n): n
    windows from word `start` on. Of windows that are equal within a document only the first need be there."""
    spark = docs.sparkSession
    prepare(spark)
    ws = workspace or Workspace(spark, "substring-dedup")
    source = own_columns(docs, id_col, text_col).where("doc_id is not null and text is not null")
    found = source.mapInArrow(tidy(_path_batches(window, anchor)), _PIECES)

    minimisers = ws.table(found.groupBy("m").agg(F.count("*").alias("rows")).where("rows > 1").select("m"), "minimisers")
    occurrences = ws.table(found.join(minimisers, "m"), "occurrences")
    ws.drop("minimisers")
    first = F.min(F.struct("doc_id", "start")).alias("first")
    grouped = occurrences.groupBy("m", "h").agg(first, F.count("*").alias("times"), *(F.min(c).alias(c) for c in ("n", "enters", "leaves")))
    pieces = ws.table(grouped.select("m", "h", F.col("first.doc_id").alias("source"), F.col("first.start").alias("source_start"), "n", "times", "enters", "leaves"), "pieces")
    paths_ = ws.table(compacted(pieces), "paths")
    branching = ws.table(pieces.groupBy("m").agg(F.count("*").alias("rows")).where("rows > 1").select("m"), "branching")
    judged = ws.table(occurrences.select("m", "h", "doc_id", "start", "n").join(paths_, ["m", "h"]).drop("h"), "judged")
    for name in ("occurrences", "pieces", "paths"):
        ws.drop(name)

    again = judged.where("doc_id > source").select("doc_id", "start", "n", "source", "source_start", "head")
    edged = judged.where("doc_id = source").join(branching, "m").select("doc_id", "start", "n", *(F.lit(None).cast(t).alias(c) for c, t in (("source", "long"), ("source_start", "int"), ("head", "int"))))
    asked = again.unionByName(edged).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "source", "source_start", "head")).alias("asked"))
    read = ws.table(source.join(asked, "doc_id").mapInArrow(tidy(_read_batches(window, anchor)), _READ), "read")
    for name in ("judged", "branching"):
        ws.drop(name)
    repeats = read.where("kind = 0")
    places = repeats.select("source", "source_start", "n").distinct().groupBy(F.col("source").alias("doc_id")).agg(F.collect_list(F.struct("source_start", "n")).alias("asked"))
    proofs = ws.table(source.join(places, "doc_id").mapInArrow(tidy(_proof_batches(window)), _PROOF).distinct(), "proofs")
    verified = repeats.join(proofs, ["source", "source_start", "n", "digest"]).select("doc_id", "start", "n")
    edges = read.where("kind = 1").select("m", "h", "doc_id", "start")
    # Two aggregates of the key's documents, not one count: equal edges of one document are one row already.
    shared = ws.table(edges.groupBy("m", "h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("m", "h", "first"), "shared-edges")
    single = edges.join(shared, ["m", "h"]).where("doc_id > first").select("doc_id", "start", F.lit(1).alias("n"))
    spans = ws.table(verified.unionByName(single).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).cast(_SPANS).alias("spans")), "spans")
    for name in ("read", "proofs", "shared-edges"):
        ws.drop(name)
    return spans


def _remove_batches(window: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in slices(batch.column("text")):
                grid = words(data, bounds, SPACE)
                owner, start, n = _span_arrays(batch.column("spans").slice(lo, hi - lo), hi - lo, "start", "n")
                change = np.zeros(len(grid.start) + 1, np.int64)
                # Rows that share an id share its spans: each takes what lies within its own words.
                to = np.minimum(start + n - 1 + window, grid.counts[owner])
                start = np.minimum(start, to)
                np.add.at(change, start + grid.first[owner], 1)
                np.add.at(change, to + grid.first[owner], -1)
                inside = _repeats_inside(grid, window)
                np.add.at(change, inside, 1)
                np.add.at(change, inside + window, -1)
                kept = np.flatnonzero(np.cumsum(change)[:-1] == 0)
                total = np.searchsorted(kept, grid.first)
                length = grid.end[kept] - grid.start[kept] + 1
                joined = data[np.minimum(ranges(grid.start[kept], length), max(0, len(data) - 1))]
                ends = np.cumsum(length)
                joined[ends - 1] = 0x20
                # Each text's last space is cut away: texts with kept words end one byte earlier.
                some = np.diff(total) > 0
                joined = np.delete(joined, ends[total[1:][some] - 1] - 1)
                size = np.append(0, ends)[total[1:]] - np.append(0, ends)[total[:-1]] - some
                offsets = np.append(0, np.cumsum(size)).astype(np.int32)
                columns = {name: batch.column(name).slice(lo, hi - lo) for name in batch.schema.names if name not in ("text", "spans")}
                columns |= {
                    "n_words": pa.array(grid.counts, pa.int64()),
                    "n_removed": pa.array(grid.counts - np.diff(total), pa.int64()),
                    "kept": pa.StringArray.from_buffers(hi - lo, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(joined))),
                }
                if whole:
                    columns["kept"] = pc.if_else(pc.equal(columns["n_removed"], 0), batch.column("text").slice(lo, hi - lo), columns["kept"])
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, whole: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and kept, the words that no repeated window covers, joined by a space.

    A window of `window` words is repeated if its words also start in a document of smaller id, or earlier in its own.
    All windows are judged on the input. A null text has no words; one of fewer than `window` words loses none. A null
    id takes no part across documents. Rows with one id are equal in rank: neither repeats the other, and the spans
    found in one are removed from all. carry: columns to take along in a struct `rest`. whole: a text that loses nothing
    is kept as it is, white space and all.
    """
    spans = repeated_spans(docs, window=window, anchor=anchor, id_col=id_col, text_col=text_col)
    return _removed(docs, spans, window, id_col, text_col, carry, whole)


def _removed(docs: DataFrame, spans: DataFrame, window: int, id_col: str, text_col: str, carry: list[str] | None, whole: bool) -> DataFrame:
    source = own_columns(docs, id_col, text_col)
    if carry is not None:
        source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in carry)).alias("rest"))
    # Built from fields, as names of carried columns may be any.
    rest = [] if carry is None else [source.schema["rest"]]
    fields = [T.StructField("doc_id", T.LongType()), *rest, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    return source.join(spans, "doc_id", "left").mapInArrow(tidy(_remove_batches(window, whole)), T.StructType(fields))


def without_spans(docs: DataFrame, spans: DataFrame, window: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all their columns, without the words that windows of their spans (doc_id, spans) cover, nor those of windows
    that come earlier in the same text; those that had words and lose all of them go."""
    other = [c for c in docs.columns if c != text_col]
    found = _removed(docs, spans, window, id_col, text_col, other, True).where("n_removed = 0 or n_removed < n_words")
    return found.select(*(F.col("kept").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in docs.columns))


def deduplicate(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all their columns, with the text that is left; those that had words and lose all of them go."""
    spans = repeated_spans(docs, window=window, anchor=anchor, id_col=id_col, text_col=text_col)
    return without_spans(docs, spans, window, id_col=id_col, text_col=text_col)
