"""Repeated passages by the hashes of all 50-word windows, around content-selected places.

A sparse suffix array whose sorted neighbours are compared misses passages: suffixes at minimisers are sorted by what
follows, a match needs words before and behind, and others that agree further on one side alone stand in between. So
all windows take part here, and the sparse places bring them together.

Every window belongs to its minimiser: the place of the least hash among its 8-word runs, the leftmost of equals, chosen
by content alone, so that equal windows have it at the same word. The windows of one minimiser that begin well before it
share the words from there to its end, those that begin later the words from it on: these 29 or 30 words are the key
that brings equal windows together, and a row carries the hashes of all windows of one key in a row. Rows are shuffled
and sorted by key once; a window that occurs more than once is part of a repeated passage, whatever else is alike
around it. Equal windows have equal keys, so none is missed; two 64-bit hashes (key and window) decide equality.

A window's places within one slice of text are compared before the shuffle, and one of them stands for all; so a very
common passage sends one row a slice, not one a place. Keys of more rows than a bounded number are hot: their windows
become rows, which are combined before the shuffle and joined with their places, so that no task gets all of a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.runtime import Workspace, own_columns, prepare, tidy
from quarry.llm.substring_dedup import without_spans
from quarry.llm.words import SPACE, Rolling, mix, ranges, slices, within, words

PASSAGE = 50
ANCHOR = 8
#: A key of more rows than this, and than a part of 1 / MOST_HOT of all rows, is hot: there are MOST_HOT of them at most.
HOT, MOST_HOT = 20_000, 100_000


def _least_places(v: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of each `width` values in a row, the leftmost of equals."""
    place, have = np.arange(len(v)), 1
    while have < width:
        step = min(have, width - have)
        a, b = place[:-step], place[step:]
        place, have = np.where(v[a] <= v[b], a, b), have + step
    return place


_MATCH = "doc_id long, start int, n int, other long, later boolean"
_ROWS = "key long, " + _MATCH + ", windows array<long>"


def _first(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _again(doc: np.ndarray, start: np.ndarray, first: np.ndarray, passage: int) -> tuple[np.ndarray, ...]:
    """(doc, start, words, other, later) of the windows that are not alone, those that follow each other as one; first: where the
    places of each window begin, which ascend by doc and start. A place's other is the document of the first of them, and
    the first one's that of the last; all but the first are later."""
    many = np.diff(np.append(first, len(doc)))
    head, tail = np.repeat(doc[first], many), np.repeat(doc[first + many - 1], many)
    later = np.ones(len(doc), bool)
    later[first] = False
    again = np.repeat(many > 1, many)
    doc, start, later, other = doc[again], start[again], later[again], np.where(doc != head, head, tail)[again]
    order = np.lexsort((start, later, other, doc))
    doc, start, other, later = doc[order], start[order], other[order], later[order]
    run = np.ones(len(doc), bool)
    run[1:] = (doc[1:] != doc[:-1]) | (other[1:] != other[:-1]) | (later[1:] != later[:-1]) | (start[1:] > start[:-1] + 1)
    begin = np.flatnonzero(run)
    last = np.append(begin[1:], len(doc))[: len(begin)] - 1
    return doc[begin], start[begin], start[last] - start[begin] + passage, other[begin], later[begin]


def _window_batches(passage: int, anchor: int):
    """Rows of windows: their key, their document, where the first begins, and the hashes of it and those behind it. Of a window
    that occurs again in the same slice only one place has such a row; the ranges of all of them are rows without windows."""
    middle = (passage - anchor + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in slices(batch.column("text")):
                grid = words(data, bounds, SPACE)
                at = within(grid, passage)
                if not len(at):
                    continue
                ids = np.asarray(batch.column("doc_id").slice(lo, hi - lo))
                rolling = Rolling(grid.hashes())
                place = _least_places(rolling.windows(anchor), passage - anchor + 1)[at]
                early = place - at >= middle
                key = rolling.of(np.where(early, place - middle, place), np.where(early, place + anchor, place + passage - middle + 1)).view(np.int64)
                window = rolling.windows(passage)[at].view(np.int64)
                owner = np.searchsorted(grid.first, at, "right") - 1
                doc, start = ids[owner], at - grid.first[owner]
                order = np.lexsort((start, doc, key, window))
                first = _first(window[order], key[order])
                again = _again(doc[order], start[order], first, passage)
                kept = np.sort(order[first])
                key, window, doc, start, at, place = (x[kept] for x in (key, window, doc, start, at, place))
                row = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)))
                n, m = len(row), len(again[0])
                spread = mix(again[0].astype(np.uint64) + again[1].astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([key[row], spread])),
                        pa.array(np.concatenate([doc[row], again[0]])),
                        pa.array(np.concatenate([start[row], again[1]]).astype(np.int32)),
                        pa.array(np.concatenate([np.zeros(n, np.int32), again[2].astype(np.int32)])),
                        pa.array(np.concatenate([np.zeros(n, np.int64), again[3]])),
                        pa.array(np.concatenate([np.zeros(n, bool), again[4]])),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([row, np.full(m + 1, len(key))]).astype(np.int32)), pa.array(window)),
                    ],
                    ["key", "doc_id", "start", "n", "other", "later", "windows"],
                )

    return run


def _repeated(passage: int):
    """Ranges of the windows that occur more than once, of rows sorted by key, and those found before."""
    names = ["doc_id", "start", "n", "other", "later"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            before = np.asarray(batch.column("n")) > 0
            if before.any():
                yield batch.select(names).filter(pa.array(before))
                batch = batch.filter(pa.array(~before))
            if not batch.num_rows:
                continue
            key = np.asarray(batch.column("key"))
            same = key[1:] == key[:-1]
            rows = np.append(False, same) | np.append(same, False)
            rows[0] |= len(held[0]) > 0 and held[0][0] == key[0]
            rows[-1] = True  # the next batch may have its key
            own = batch.filter(pa.array(rows))
            n = np.asarray(own.column("windows").value_lengths())
            starts = ranges(np.asarray(own.column("start")).astype(np.int64), n)
            flat = [np.repeat(key[rows], n), np.asarray(own.column("windows").flatten()), np.repeat(np.asarray(own.column("doc_id")), n), starts]
            key, window, doc, start = (np.concatenate(x) for x in zip(held, flat, strict=True))
            order = np.lexsort((start, doc, window, key))
            key, window, doc, start = key[order], window[order], doc[order], start[order]
            first = _first(key, window)
            again = _again(doc, start, first, passage)
            if len(again[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in zip(again, (np.int64, np.int32, np.int32, np.int64, bool), strict=True)], names)
            keep = first[key[first] == flat[0][-1]]
            held = [key[keep], window[keep], doc[keep], start[keep]]

    return run


def _ranges(docs: DataFrame, passage: int, anchor: int, id_col: str, text_col: str, hot: int) -> DataFrame:
    """(doc_id, start, n, other, later): ranges of words of windows that occur more than once; later: not for the first time."""
    spark = docs.sparkSession
    prepare(spark)
    source = own_columns(docs, id_col, text_col).where("doc_id is not null and text is not null")
    windows = source.mapInArrow(tidy(_window_batches(passage, anchor)), _ROWS)
    keys = windows.where("n = 0").groupBy("key").agg(F.count("*").alias("rows"))
    counted = Workspace(spark, "suffix-dedup").table(keys.where(F.col("rows") > hot), "hot")
    total = counted.agg(F.sum("rows")).first()[0] or 0
    # Of rows in hot keys, so that there are at most MOST_HOT of the hottest; the others are below this part of all rows.
    over = counted.where(F.col("rows") > total / MOST_HOT).select("key")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cool = windows.join(F.broadcast(over), "key", "left_anti") if total else windows
    rows = cool.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(tidy(_repeated(passage)), _MATCH)
    if not total:
        return rows
    single = windows.join(F.broadcast(over), "key", "left_semi").select("key", "doc_id", "start", F.posexplode("windows").alias("at", "window"))
    places = single.select("key", "window", F.struct("doc_id", (F.col("start") + F.col("at")).alias("start")).alias("place"))
    ends = places.groupBy("key", "window").agg(F.min("place").alias("head"), F.max("place").alias("tail")).where("head <> tail")
    met = places.join(ends, ["key", "window"])
    other = F.when(F.col("place.doc_id") != F.col("head.doc_id"), F.col("head.doc_id")).otherwise(F.col("tail.doc_id"))
    return rows.unionByName(met.select("place.doc_id", "place.start", F.lit(passage).alias("n"), other.alias("other"), (F.col("place") != F.col("head")).alias("later")))


def repeated_passages(docs: DataFrame, *, passage: int = PASSAGE, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, spans, others) of each document with a passage of at least `passage` words that occurs elsewhere, in another
    document or again in itself.

    spans: the word ranges [start, end) of its passages, joined where they overlap, ascending; others: the ids of
    documents that share one, ascending (of many copies not all are named, but all are linked). Words are runs of other
    characters than ASCII white space. Null texts and ids take no part; rows with one id are one document here, and equal
    places in them one place. Documents without such a passage have no row.
    """
    rows = _ranges(docs, passage, anchor, id_col, text_col, hot)
    joined = F.expr(
        """aggregate(ranges, cast(array() as array<struct<start:int,end:int>>), (a, x) ->
             if(size(a) > 0 and element_at(a, -1).end >= x.start,
                concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end)))),
                concat(a, array(x))))"""
    )
    per_doc = rows.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("ranges"), F.sort_array(F.collect_set("other")).alias("others"))
    return per_doc.select("doc_id", joined.alias("spans"), "others")


def deduplicate(docs: DataFrame, *, passage: int = PASSAGE, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """The documents, all their columns, without the passages that a document of smaller id has, too, or that come earlier in
    their own; a text that loses words is joined anew by single spaces, and one that loses all of them goes with its row.

    Rows with one id lose what is found in any of them, as far as it lies within their words; a null text or id loses nothing
    to other documents.
    """
    rows = _ranges(docs, passage, anchor, id_col, text_col, hot).where("later")
    spans = rows.select("doc_id", "start", (F.col("n") - passage + 1).alias("n")).distinct().groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    spans = Workspace(docs.sparkSession, "suffix-dedup").table(spans, "spans")
    return without_spans(docs, spans, passage, id_col=id_col, text_col=text_col)
