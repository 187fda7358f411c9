"""Benchmark decontamination with suffix arrays over the training documents.

Each slice of documents is a shard. Its suffix array is sorted by the first four words of every suffix, as one 64-bit
key of word codes, and every test suffix of the benchmark (a window of its words) is searched in it by bisection. The
suffixes that a search leaves are sorted and searched by their next four words, and so on to the window's end: the
array is ordered only as deep as the searches need. Words that no benchmark item has get code 0, which matches none.

Windows of one item that follow each other in a document as they do in the item are one verbatim match. So every longest
match of at least a window is known with its places in the document and in the item, and no match is made up of several.

The benchmark is sent to the executors in blocks of at most BLOCK_BYTES of text, each with its own pass over the
documents, so that what is broadcast does not grow with the data. Documents are never shuffled in the search; where there
are several blocks they are written once with their place, which tells equal rows apart, and only what was found is joined.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.runtime import Workspace, kept_rows, own_columns, prepare, tidy
from quarry.llm.words import LOWER, NOT_WORD, Grid, ranges, slices, words

#: Words of a test suffix that must be found together.
WINDOW = 13
#: Most bytes of benchmark text in one broadcast.
BLOCK_BYTES = 32 << 20
_CODE_BITS, _CODES_PER_KEY = 16, 4
_TOP = np.uint64(_CODE_BITS)


@dataclass
class TestSuffixes:
    """Windows of the benchmark items of one block, as codes of a vocabulary of their own.

    vocabulary: sorted hashes of the words; a word's code is its place in it plus 1. windows: by length, an array of
    codes with a row for each distinct window. items: by length, (first, item row, offset) of the places of each window.
    """

    vocabulary: np.ndarray
    item_ids: list[str]
    windows: dict[int, np.ndarray] = field(default_factory=dict)
    items: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def build(cls, ids: list[str], texts: pa.Array, window: int) -> TestSuffixes:
        hashed = []
        for lo, hi, data, bounds in slices(texts):
            grid = words(LOWER[data], bounds, NOT_WORD)
            h = grid.hashes()
            hashed += [h[grid.first[i] : grid.first[i + 1]] for i in range(hi - lo)]
        out = cls(np.unique(np.concatenate([*hashed, np.zeros(0, np.uint64)])), ids)
        found = defaultdict(list)
        for row, h in enumerate(hashed):
            if len(h):
                n = min(window, len(h))
                codes = np.searchsorted(out.vocabulary, h).astype(np.uint32) + 1
                found[n] += [(codes[i : i + n].tobytes(), row, i) for i in range(len(h) - n + 1)]
        for n, triples in found.items():
            places = defaultdict(list)
            for w, row, i in triples:
                places[w].append((row, i))
            keys = sorted(places)
            out.windows[n] = np.frombuffer(b"".join(keys), np.uint32).reshape(-1, n)
            flat = np.array([x for k in keys for x in places[k]], np.int64).reshape(-1, 2)
            out.items[n] = (np.cumsum([0, *(len(places[k]) for k in keys)]), flat[:, 0], flat[:, 1])
        return out


class _Lookup:
    """Codes of word hashes: a table over the top bits of a hash leads into the sorted vocabulary."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        self.bits = np.uint64(64 - min(22, max(8, int(len(vocabulary)).bit_length() + 4)))
        self.place = np.searchsorted(vocabulary >> self.bits, np.arange(1 << (64 - int(self.bits)), dtype=np.uint64)).astype(np.int32)
        bucket = np.diff(np.append(self.place, len(vocabulary)))
        self.deep = int(bucket.max(initial=0))

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.uint32)
        if not len(self.vocabulary):
            return out
        at = self.place[(hashes >> self.bits).astype(np.int64)]
        for step in range(self.deep):
            here = np.minimum(at + step, len(self.vocabulary) - 1)
            same = self.vocabulary[here] == hashes
            out[same] = here[same] + 1
        return out


class SuffixArray:
    """Suffixes of a shard's documents, in the order of their first words."""

    def __init__(self, codes: np.ndarray, grid: Grid, wide: bool):
        """wide: codes don't fit 16 bits; keys then hold two words."""
        self.per_key = 2 if wide else _CODES_PER_KEY
        self.width = np.uint64(64 // self.per_key)
        left = np.repeat(grid.first[1:], grid.counts) - np.arange(len(codes))
        self.codes, self.left = np.append(codes, np.zeros(WINDOW * 2, np.uint32)).astype(np.uint64), left
        at = np.flatnonzero(codes)  # a suffix that begins with another word matches no test suffix
        keys = self._keys(at, 0, self.per_key)
        order = np.argsort(keys)
        self.suffixes, self.keys = at[order], keys[order]

    def _keys(self, at: np.ndarray, depth: int, n: int) -> np.ndarray:
        """n words from `depth` words behind `at` on; what lies in the next document counts as 0."""
        out = np.zeros(len(at), np.uint64)
        for j in range(self.per_key):
            out <<= self.width
            if j < n:
                out |= np.where(self.left[at] > depth + j, self.codes[at + depth + j], np.uint64(0))
        return out

    def _pack(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.uint64)
        for j in range(self.per_key):
            out <<= self.width
            if j < rows.shape[1]:
                out |= rows[:, j].astype(np.uint64)
        return out

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(suffix, window row) of every suffix that begins with a whole window. windows: distinct, of one length."""
        n = windows.shape[1]
        step = self.per_key
        keys = self._pack(windows[:, :step])
        distinct, rank = np.unique(keys, return_inverse=True)
        spread = np.uint64(1) << (self.width * np.uint64(max(0, step - n)))
        lo = np.searchsorted(self.keys, distinct)
        hi = np.searchsorted(self.keys, distinct + (spread - np.uint64(1)), "right")
        at = self.suffixes[ranges(lo, hi - lo)]
        state = np.repeat(np.arange(len(distinct)), hi - lo)
        for depth in range(step, n, step):
            if not len(at):
                break
            # The windows that agree so far differ in their next words: (rank so far, next key) gets a new rank.
            nxt = self._pack(windows[:, depth : depth + step])
            pairs = np.unique(np.stack([rank.astype(np.uint64), nxt], 1), axis=0)
            position = {(int(a), int(b)): i for i, (a, b) in enumerate(pairs)}
            rank = np.array([position[a, b] for a, b in zip(rank.tolist(), nxt.tolist(), strict=True)])
            own = self._keys(at, depth, min(step, n - depth))
            order = np.lexsort((own, state))
            at, state, own = at[order], state[order], own[order]
            # Bisect the pairs among the suffixes: equal states are contiguous, and their keys ascend.
            edge = np.searchsorted(state, np.stack([pairs[:, 0], pairs[:, 0] + np.uint64(1)]).astype(np.int64))
            lo, hi = _bisect(own, edge[0], edge[1], pairs[:, 1], False), _bisect(own, edge[0], edge[1], pairs[:, 1], True)
            at, state = at[ranges(lo, hi - lo)], np.repeat(np.arange(len(pairs)), hi - lo)
        row = np.zeros(int(rank.max(initial=-1)) + 1, np.int64)
        row[rank] = np.arange(len(windows))
        return at, row[state]


def _bisect(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
    """searchsorted of each wanted value within its own part of values."""
    lo, hi = lo.copy(), hi.copy()
    while len(live := np.flatnonzero(lo < hi)):
        mid = (lo[live] + hi[live]) // 2
        below = values[mid] <= wanted[live] if right else values[mid] < wanted[live]
        lo[live] = np.where(below, mid + 1, lo[live])
        hi[live] = np.where(below, hi[live], mid)
    return lo


def _matches(tests: TestSuffixes, lookup: _Lookup, data: np.ndarray, bounds: np.ndarray) -> tuple[Grid, np.ndarray, np.ndarray]:
    """The grid of a shard, a mark for each hit word, and a row (text, item row, first word, first word in the item, words) for
    each verbatim match of a window at least, as long as it goes on, in the order of the texts."""
    grid = words(LOWER[data], bounds, NOT_WORD)
    array = SuffixArray(lookup.codes(grid.hashes()), grid, len(tests.vocabulary) >= 1 << _CODE_BITS)
    change = np.zeros(len(grid.start) + 1, np.int64)
    found = [np.zeros((0, 5), np.int64)]
    for n, windows in tests.windows.items():
        at, row = array.search(windows)
        np.add.at(change, at, 1)
        np.add.at(change, at + n, -1)
        first, item, offset = tests.items[n]
        many = first[row + 1] - first[row]
        here, of = np.repeat(at, many), ranges(first[row], many)
        item, offset = item[of], offset[of]
        order = np.lexsort((here, here - offset, item))
        here, item, offset = here[order], item[order], offset[order]
        new = np.ones(len(here), bool)
        new[1:] = (item[1:] != item[:-1]) | (here[1:] != here[:-1] + 1) | (offset[1:] != offset[:-1] + 1)
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(here))) - 1 + n
        text = np.searchsorted(grid.first, here[begin], "right") - 1
        found.append(np.stack([text, item[begin], here[begin] - grid.first[text], offset[begin], length], 1))
    found = np.concatenate(found)
    return grid, np.cumsum(change)[:-1] > 0, found[np.lexsort((found[:, 3], found[:, 1], found[:, 2], found[:, 0]))]


def _runs(hit: np.ndarray, grid: Grid, i: int) -> list[tuple[int, int]]:
    """[from, to) of the hit words of text i."""
    own = np.concatenate([[False], hit[grid.first[i] : grid.first[i + 1]], [False]])
    edge = np.flatnonzero(own[1:] != own[:-1])
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[tuple[list[str], list[str]]]:
    """Items in blocks of at most `most` bytes (one item at least)."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col(f"`{id_col}`").cast("string"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).toLocalIterator()
    for item, text in rows:
        if ids and size + len(text) * 4 > most:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append("" if item is None else item)
        texts.append(text)
        size += len(text) * 4
    yield ids, texts


_RANGES, _VERBATIM = "array<struct<start:int,end:int>>", "array<struct<item_id:string,start:int,item_start:int,words:int>>"
_FOUND = f"doc_id long, n_words long, n_hit long, item_ids array<string>, hits {_RANGES}, matches {_VERBATIM}, longest int"
_PART = f"_place long, n_words long, hits {_RANGES}, matches {_VERBATIM}"


def matches(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, item_ids (of the items that have a window in it, ascending), hits (word ranges
    [start, end) that windows cover, ascending), matches (verbatim matches with single items, as long as they go on: item_id,
    start in the document, item_start in the item, words; ascending) and longest (words of the longest of them).

    Words are runs of letters and digits after lower-casing A-Z (whatever isn't ASCII counts as a letter). An item of
    fewer than `window` words, but not none, must occur whole. A null text has no words; an empty benchmark or one
    without words hits nothing; a null item id counts as ''. Repeated rows and ids are treated one by one, with any number
    of benchmark blocks.
    """
    prepare(docs.sparkSession)
    source = own_columns(docs, id_col, text_col)
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return source.mapInArrow(tidy(_searcher(_send(docs.sparkSession, first, window))), _FOUND)
    ws = Workspace(docs.sparkSession, "decontaminate")
    numbered = ws.table(source.withColumn("_place", F.monotonically_increasing_id()), "documents")
    found = _united(ws, numbered, "text", chain([first, second], blocks), window)
    sums = F.expr("aggregate(hits, 0L, (a, x) -> a + x.end - x.start)")
    out = numbered.select("doc_id", "_place").join(found, "_place", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce(sums, F.lit(0).cast("long")).alias("n_hit"),
        F.array_sort(F.array_distinct(F.col("matches.item_id"))).alias("item_ids"),
        "hits",
        "matches",
        F.coalesce(F.array_max("matches.words"), F.lit(0)).alias("longest"),
    )


def _send(spark: SparkSession, block: tuple[list[str], list[str]], window: int):
    ids, texts = block
    return spark.sparkContext.broadcast(TestSuffixes.build(ids, pa.array(texts, pa.string()), window))


def _united(ws: Workspace, numbered: DataFrame, text_col: str, blocks: Iterator, window: int) -> DataFrame:
    """(_place, n_words, hits, matches) of every row of a table with places: one pass for each block, of which all but the first
    write only rows with something found."""
    parts = []
    for k, block in enumerate(blocks):
        sent = _send(ws.spark, block, window)
        rows = numbered.select("_place", F.col(f"`{text_col}`").cast("string").alias("text"))
        parts.append(ws.table(rows.mapInArrow(tidy(_part_searcher(sent, k == 0)), _PART), f"block-{k}"))
        sent.unpersist()
    united = reduce(DataFrame.unionByName, parts).groupBy("_place").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("hits"))).alias("all_hits"),  # a list a block
        F.sort_array(F.flatten(F.collect_list("matches"))).alias("all_matches"),
    )
    joined = F.expr(
        f"""aggregate(all_hits, cast(array() as {_RANGES}), (a, x) ->
             if(size(a) > 0 and element_at(a, -1).end >= x.start,
                concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end)))),
                concat(a, array(x))))"""
    )
    order = F.expr("array_sort(all_matches, (a, b) -> if(a.start <> b.start, a.start - b.start, if(a.item_id <> b.item_id, if(a.item_id < b.item_id, -1, 1), a.item_start - b.item_start)))")
    return united.select("_place", "n_words", joined.alias("hits"), order.alias("matches"))


def _listed(tests: TestSuffixes, grid: Grid, hit: np.ndarray, found: np.ndarray, rows: np.ndarray) -> tuple[pa.Array, pa.Array, list[list[str]]]:
    """(hits, matches, distinct item ids) of some texts of a shard."""
    at = np.searchsorted(found[:, 0], rows), np.searchsorted(found[:, 0], rows, "right")
    hits, listed, names = [], [], []
    for i, a, b in zip(rows.tolist(), *(x.tolist() for x in at), strict=True):
        own = sorted(({"item_id": tests.item_ids[row], "start": s, "item_start": t, "words": n} for _, row, s, t, n in found[a:b].tolist()), key=lambda m: (m["start"], m["item_id"], m["item_start"]))
        listed.append(own)
        names.append(sorted({m["item_id"] for m in own}))
        hits.append([{"start": x, "end": y} for x, y in _runs(hit, grid, i)] if b > a else [])
    ranges_ = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    verbatim = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int32()), ("item_start", pa.int32()), ("words", pa.int32())]))
    return pa.array(hits, ranges_), pa.array(listed, verbatim), names


def _searched(sent, batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple]:
    """(batch part, grid, hit marks, matches) of shards."""
    tests = sent.value
    lookup = _Lookup(tests.vocabulary)
    for batch in batches:
        for lo, hi, data, bounds in slices(batch.column(column)):
            yield tests, batch.slice(lo, hi - lo), *_matches(tests, lookup, data, bounds)


def _counts(grid: Grid, hit: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(hit))
    return total[grid.first[1:]] - total[grid.first[:-1]]


def _searcher(sent):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tests, part, grid, hit, found in _searched(sent, batches, "text"):
            hits, listed, names = _listed(tests, grid, hit, found, np.arange(part.num_rows))
            longest = np.zeros(part.num_rows, np.int32)
            np.maximum.at(longest, found[:, 0], found[:, 4].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(grid.counts, pa.int64()), pa.array(_counts(grid, hit), pa.int64()), pa.array(names, pa.list_(pa.string())), hits, listed, pa.array(longest)],
                ["doc_id", "n_words", "n_hit", "item_ids", "hits", "matches", "longest"],
            )

    return search


def _part_searcher(sent, every: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tests, part, grid, hit, found in _searched(sent, batches, "text"):
            rows = np.arange(part.num_rows) if every else np.unique(found[:, 0])
            hits, listed, _ = _listed(tests, grid, hit, found, rows)
            yield pa.RecordBatch.from_arrays([part.column("_place").take(pa.array(rows)), pa.array(grid.counts[rows], pa.int64()), hits, listed], ["_place", "n_words", "hits", "matches"])

    return search


def contaminated(n_hit, n_words, share: int = 20):
    """The rule: some word is hit, and one in `share` at least."""
    return (n_hit > 0) & (n_hit * share >= n_words)


def _keeper(sent, text_col: str):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, grid, hit, _ in _searched(sent, batches, text_col):
            yield part.filter(pa.array(~contaminated(_counts(grid, hit), grid.counts)))

    return keep


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all their columns unchanged, that aren't contaminated. They are judged row by row, whatever their ids."""
    spark = docs.sparkSession
    prepare(spark)
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        sent = _send(spark, first, window)
        return kept_rows(docs, text_col, lambda name: _keeper(sent, name))
    place = "_place"
    while place in docs.columns:
        place += "_"
    ws = Workspace(spark, "decontaminate")
    numbered = ws.table(docs.withColumn(place, F.monotonically_increasing_id()), "documents")
    texts = numbered.select(F.col(place).alias("_place"), F.col(f"`{text_col}`").alias("text"))
    found = _united(ws, texts, "text", chain([first, second], blocks), window)
    hit = F.expr("aggregate(hits, 0L, (a, x) -> a + x.end - x.start)")
    bad = found.where(contaminated(hit, F.col("n_words"))).select(F.col("_place").alias(place))
    return numbered.join(bad, place, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
