"""MinHash near-duplicates whose candidates are verified by odd sketches (Mitzenmacher, Pagh and Pham, 2014).

A document is the set of its shingles. Equal sets shrink to one representative. Bands of MinHash values bring candidates
together; a second sample, the least hash of each of SAMPLES parts of the hash range, is folded into a bitmap of parities.
Where two samples differ the parities flip, so the population count of two bitmaps' XOR tells how far apart the sets are, and
a pair that can't reach the threshold goes before any set is read. What remains is confirmed on the full sets.

Pairs are not listed within a bucket. First its most central member is compared with each other one; most buckets are in
one component then. Members of different components are compared by their bitmaps, a block of a bucket with another one; what
looks alike is put into one cluster, of which a task says no more than a tree. Members of a cluster that are in different
components are compared on their full sets, again by blocks, and a task gives a tree of the links that it finds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import words
from quarry.llm.components import components
from quarry.llm.runtime import Workspace, own_columns, prepare, tidy

SHINGLE = 5
#: Sets are linked at this share of common shingles, in hundredths.
PERCENT = 85
#: With 42 bands of 6 values a pair at 0.85 shares none once in 4 * 10**8 times.
BANDS, ROWS = 42, 6
SAMPLES, BITS = 1024, 2048
#: Standard deviations by which a pair at the threshold may look worse than it is.
DEVIATIONS = 6.5
#: Members of a block, and shingles of it where whole sets are compared, about; a task compares two blocks.
BLOCK, BLOCK_SHINGLES = 256, 1 << 18
#: Pairs of one document that read one copy of its set.
SPREAD = 1000

_RANDOM = np.random.default_rng(0x0DD)
_FLIP, _ODD = (_RANDOM.integers(0, 2**63, BANDS * ROWS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_SALTS = _RANDOM.integers(0, 2**63, 4, dtype=np.int64).astype(np.uint64)
_MORE = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the sorted distinct shingles of each text, one text after the other. Of fewer words than `size` the whole
    sequence is one shingle; a text without words has none."""
    grid = words.words(words.LOWER[data], bounds, words.SPACE)
    rolling, n = words.Rolling(grid.hashes()), grid.counts
    at = words.within(grid, size)
    short = np.flatnonzero((n > 0) & (n < size))
    first = np.concatenate([at, grid.first[short]])
    last = np.concatenate([at + size, grid.first[short + 1]])
    owner = np.concatenate([np.repeat(np.arange(len(n)), np.maximum(n - size + 1, 0)), short])
    hashes = rolling.of(first, last)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=len(n))


def _per_set(values: np.ndarray, counts: np.ndarray, reduce: np.ufunc) -> np.ndarray:
    """A reduction of the values of each set; the sets that are empty have 0."""
    out = np.zeros(len(counts), values.dtype)
    full = np.flatnonzero(counts)
    if len(full):
        out[full] = reduce.reduceat(values, (np.cumsum(counts) - counts)[full])
    return out


def digests(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set."""
    return tuple(_per_set(words.mix(hashes ^ salt), counts, np.add) for salt in _SALTS[:2])


def bands(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each set."""
    out = np.zeros((len(counts), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        least = _per_set((hashes ^ _FLIP[k]) * _ODD[k], counts, np.minimum)
        out[:, k // ROWS] = words.mix(out[:, k // ROWS] * _MORE + least)
    return out


def odd_sketches(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of BITS / 64 words for each set: the parities of its sample."""
    owner, h = np.repeat(np.arange(len(counts)), counts), words.mix(hashes ^ _SALTS[2])
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    part = owner * SAMPLES + (h >> np.uint64(64 - SAMPLES.bit_length() + 1)).astype(np.int64)
    least = np.ones(len(h), bool)
    least[1:] = part[1:] != part[:-1]
    bit = (words.mix(h[least] ^ _SALTS[3]) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
    odd = np.bincount(owner[least] * BITS + bit, minlength=len(counts) * BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(counts), BITS), axis=1, bitorder="little").view("<u8")


def most_flips(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The highest population count that sets of a and b shingles may have and still be linked.

    At the threshold d shingles are in one set alone. Of a part with l of them on average, one changes 2 (1 - e^-l) / l - e^-l
    samples on average; the second moment is that of its three cases. Then the bits: two changes at one bit cancel out.
    """
    both = (a + b).astype(float)
    d = both * (100 - percent) / (100 + percent)
    load = np.maximum(both / (2 * SAMPLES), 1e-9)
    none, any_ = np.exp(-load), -np.expm1(-load) / load
    mean, second = 2 * any_ - none, 4 * any_ - 3 * none
    changed = d * mean + DEVIATIONS * np.sqrt(np.maximum(d * (second - mean**2), 0)) + 2
    left = np.exp(-4 * changed / BITS)
    spread = np.sqrt(np.maximum(BITS / 4 * (1 - left) - changed * left, 0))
    return np.minimum(changed, BITS / 2 * -np.expm1(-2 * changed / BITS) + DEVIATIONS * spread + 1)


def could_link(a: np.ndarray, b: np.ndarray, flips: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (flips <= most_flips(a, b, percent))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()).astype(np.int64, copy=False).view(np.uint64).reshape(-1, width)


def _lists(values: np.ndarray) -> pa.Array:
    """A list of longs for each row of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1] or 1, dtype=np.int32)), pa.array(values.ravel().view(np.int64)))


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in words.slices(batch.column("text")):
                hashes, counts = shingle_sets(data, bounds, size)
                one, two = digests(hashes, counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(counts, pa.int64()), *(pa.array(x.view(np.int64)) for x in (one, two)), _lists(bands(hashes, counts)), _lists(odd_sketches(hashes, counts))],
                    ["doc_id", "n", "one", "two", "bands", "sketch"],
                )

    return run


def signatures(docs: DataFrame, *, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, one, two, bands, sketch) of each row: the size of its set, a digest of it, its bands and its odd sketch."""
    prepare(docs.sparkSession)
    schema = "doc_id long, n long, one long, two long, bands array<long>, sketch array<long>"
    return own_columns(docs, id_col, text_col).mapInArrow(tidy(_signatures(size)), schema)


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in words.slices(batch.column("text")):
                hashes, counts = shingle_sets(data, bounds, size)
                one, two = (x.view(np.int64) for x in digests(hashes, counts))
                own = (one == np.asarray(batch.column("one"))[lo:hi]) & (two == np.asarray(batch.column("two"))[lo:hi])
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("sid").slice(lo, hi - lo), lists], ["sid", "set"]).filter(pa.array(own))

    return run


def _near(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_matrix(batch.column(c), BITS // 64) for c in ("sketch_a", "sketch_b"))
            na, nb = (np.asarray(batch.column(c)) for c in ("n_a", "n_b"))
            near = could_link(na, nb, np.bitwise_count(a ^ b).sum(1), percent)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(near))

    return run


class _Forest:
    """Groups that grow together; labels are small integers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j

    def labels(self, of: np.ndarray) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))])[of]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted arrays of distinct values share."""
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _across(percent: int, exact: bool):
    """A tree of the pairs of two blocks that lie in different components and could be linked; exact: that are linked. What such a
    pair joins is one component from then on, so most pairs of a group that is alike are never compared."""

    def run(table: pa.Table) -> pa.Table:
        ids, of, n, first = (np.asarray(table.column(c)) for c in ("sid", "component", "n", "first"))
        sketch = _matrix(table.column("sketch"), BITS // 64)
        if exact:
            sets = table.column("set").combine_chunks()
            bounds, values = np.asarray(sets.offsets), np.asarray(sets.values)
        left = np.flatnonzero(first)
        right = left if first.all() else np.flatnonzero(~first)
        own = np.unique(of, return_inverse=True)[1].ravel()
        forest, group = _Forest(int(own.max(initial=-1)) + 1), own
        pairs = []
        for lo in range(0, len(left), 16):
            some = left[lo : lo + 16]
            x, y = np.nonzero(group[some][:, None] != group[right][None, :])
            x, y = some[x], right[y]
            sized = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
            x, y = x[sized], y[sized]
            near = could_link(n[x], n[y], np.bitwise_count(sketch[x] ^ sketch[y]).sum(1), percent)
            for i, j in zip(x[near].tolist(), y[near].tolist(), strict=True):
                if forest.root(int(own[i])) == forest.root(int(own[j])):
                    continue
                if exact:
                    common = _common(values[bounds[i] : bounds[i + 1]], values[bounds[j] : bounds[j + 1]])
                    if 100 * common < percent * (n[i] + n[j] - common):
                        continue
                forest.join(int(own[i]), int(own[j]))
                pairs.append((ids[i], ids[j]))
            group = forest.labels(own)
        found = np.array(pairs, np.int64).reshape(-1, 2)
        return pa.table({"a": found.min(1, initial=np.iinfo(np.int64).max), "b": found.max(1, initial=np.iinfo(np.int64).min)})

    return run


def _with(pairs: DataFrame, side: str, table: DataFrame, *columns: str) -> DataFrame:
    """pairs with columns of one of their sides."""
    return pairs.join(table.select(F.col("sid").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)), side)


class _Run:
    """The tables of one search for links between representatives."""

    def __init__(self, docs: DataFrame, reps: DataFrame, workspace: Workspace, size: int, percent: int):
        self.docs, self.reps, self.workspace, self.size, self.percent = docs, reps, workspace, size, percent

    def members(self) -> DataFrame:
        """(band, key, sid) of the buckets with several representatives, and how many those are (m)."""
        exploded = self.reps.select("sid", F.posexplode("bands").alias("band", "key"))
        shared = exploded.groupBy("band", "key").agg(F.count("*").alias("m")).where("m > 1")
        return self.workspace.table(exploded.join(shared, ["band", "key"]), "members")

    def stars(self, members: DataFrame) -> DataFrame:
        """Pairs of each member with the one of its bucket that meets the most others in all its buckets."""
        weight = members.groupBy("sid").agg(F.sum("m").alias("weight"))
        centre = members.join(weight, "sid").groupBy("band", "key").agg(F.max(F.struct("weight", (-F.col("sid")).alias("minus"))).alias("centre"))
        star = members.join(centre.select("band", "key", (-F.col("centre.minus")).alias("centre")), ["band", "key"]).where("sid <> centre")
        pairs = star.select(F.least("sid", "centre").alias("a"), F.greatest("sid", "centre").alias("b")).distinct()
        met = _with(_with(pairs, "a", self.reps, "n", "sketch"), "b", self.reps, "n", "sketch")
        return self.workspace.table(met.mapInArrow(tidy(_near(self.percent)), "a long, b long"), "near")

    def sets(self, ids: DataFrame, name: str) -> DataFrame:
        """(sid, set) of some representatives, read from one text of each."""
        needed = self.reps.join(ids, "sid").select("sid", "least", "one", "two")
        texts = self.docs.join(needed, F.col("doc_id").eqNullSafe(F.col("least"))).select("sid", "one", "two", "text")
        return self.workspace.table(texts.mapInArrow(tidy(_full_sets(self.size)), "sid long, set array<long>").dropDuplicates(["sid"]), f"sets-{name}")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose full sets are alike enough. Both sets are read once for each pair, the texts once."""
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "star")
        # A representative of many pairs: its set is copied, and the pairs are dealt over the copies.
        copies = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("copies"))
        salted = pairs.join(copies, "a").withColumn("salt", F.pmod(F.hash("b"), F.col("copies")))
        left = sets.join(copies, sets["sid"] == copies["a"]).select("a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.col("set").alias("set_a"))
        both = _with(salted, "b", sets, "set").join(left, ["a", "salt"])
        common = F.size(F.array_intersect("set_a", "set_b"))
        both = both.select("a", "b", common.alias("common"), (F.size("set_a") + F.size("set_b") - common).alias("union"))
        return self.workspace.table(both.where(F.col("common") * 100 >= F.col("union") * self.percent).select("a", "b"), "links-star")

    def blocked(self, of: DataFrame, key: list[str], weight: Column, name: str) -> DataFrame:
        """Rows (key, sid, component, n, ...) as the tasks that compare all of a key across its components: (task, first, ...), a row
        for each task of its block, `first` where it is on the left.

        A component with more than a block of members has blocks of its own, whose members aren't compared with each other;
        the members of smaller ones share blocks.
        """
        share = of.groupBy(*key, "component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(weight) / BLOCK_SHINGLES)).cast("int").alias("k"), F.count("*").alias("c"), F.sum(weight).alias("w"))
        share = self.workspace.table(share, f"share-{name}")
        little = F.col("k") < 2
        small = F.greatest(F.ceil(F.sum(F.when(little, F.col("c")).otherwise(0)) / BLOCK), F.ceil(F.sum(F.when(little, F.col("w")).otherwise(0)) / BLOCK_SHINGLES)).cast("int")
        large = F.collect_list(F.when(~little, F.struct("component", "k")))
        buckets = self.workspace.table(share.groupBy(*key).agg(F.count("*").alias("groups"), small.alias("small"), large.alias("large")).where("groups > 1"), f"buckets-{name}")
        mixed = F.expr("transform(filter(sequence(0, small), i -> i < small), i -> named_struct('group', cast(null AS long), 'part', i))")
        alone = F.expr("flatten(transform(large, g -> transform(sequence(0, g.k - 1), i -> named_struct('group', g.component, 'part', i))))")
        blocks = buckets.select(*key, F.concat(mixed, alone).alias("blocks"))
        tasks = blocks.select(*key, "blocks", F.explode("blocks").alias("x")).select(*key, "x", F.explode("blocks").alias("y"))
        tasks = tasks.where("x <= y and not (x.`group` is not null and y.`group` is not null and x.`group` = y.`group`)")
        tasks = tasks.withColumn("first", F.explode(F.when(F.expr("x <=> y"), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))))
        tasks = tasks.select(*key, F.xxhash64(*key, "x", "y").alias("task"), "first", F.when(F.col("first"), F.col("x")).otherwise(F.col("y")).alias("block"))
        block = F.struct(
            F.when(~little, F.col("component")).alias("group"),
            F.when(~little, F.pmod(F.xxhash64("sid"), F.col("k"))).otherwise(F.pmod(F.xxhash64("component"), F.col("small"))).cast("int").alias("part"),
        )
        own = of.join(share, [*key, "component"]).join(buckets.select(*key, "small"), key).select(*of.columns, block.alias("block")).join(self.reps.select("sid", "sketch"), "sid")
        same = [F.col(f"t.{c}") == F.col(f"o.{c}") for c in key] + [F.col("t.block.part") == F.col("o.block.part"), F.col("t.block.group").eqNullSafe(F.col("o.block.group"))]
        return tasks.alias("t").join(own.alias("o"), same).select("task", "first", *(F.col(f"o.{c}") for c in ("sid", "component", "n", "sketch")))

    def clusters(self, members: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
        """(node, component): what the links join, and what pairs of a bucket that look alike would join, too."""
        of = members.select("band", "key", "sid").join(self.reps.select("sid", "n"), "sid").join(nodes.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
        rows = self.blocked(self.workspace.table(of, "of"), ["band", "key"], F.lit(0), "bands")
        alike = self.workspace.table(rows.groupBy("task").applyInArrow(_across(self.percent, False), "a long, b long").distinct(), "alike")
        return components(links.unionByName(alike), Workspace(self.docs.sparkSession, "oddsketch-alike"))

    def across(self, clusters: DataFrame, nodes: DataFrame) -> DataFrame:
        """Links between members of one cluster that are in different components."""
        of = clusters.select(F.col("node").alias("sid"), F.col("component").alias("cluster")).join(nodes.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
        of = of.join(self.reps.select("sid", "n"), "sid")
        several = of.groupBy("cluster").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("cluster")
        of = self.workspace.table(of.join(several, "cluster"), "clusters")
        sets = self.sets(of.select("sid"), "across")
        rows = self.blocked(of, ["cluster"], F.col("n"), "clusters").join(sets, "sid")
        return self.workspace.table(rows.groupBy("task").applyInArrow(_across(self.percent, True), "a long, b long"), "links-across")


def near_duplicates(docs: DataFrame, *, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row. Sets that share `percent` hundredths of their union are linked, and component_id
    is the smallest doc_id that a row reaches over links, its own included.

    A null text or one without words has no shingles and is linked with nothing. Repeated rows and ids stay apart, as rows. A null
    doc_id counts in no minimum: it gets its component's smallest id, or null where all are null. percent is from 80 to 100: the
    bands are made for that. Two 64-bit hashes decide that sets are equal, one that shingles are.
    """
    if not 80 <= percent <= 100:
        raise ValueError("bands find links from 80 to 100 hundredths")
    workspace = Workspace(docs.sparkSession, "oddsketch")
    rows = workspace.table(signatures(docs, size=size, id_col=id_col, text_col=text_col).withColumn("place", F.monotonically_increasing_id()), "rows")
    same = rows.where("n > 0").groupBy("one", "two", "n").agg(F.min("doc_id").alias("least"), F.min("place").alias("sid"))
    reps = workspace.table(same.join(rows.select(F.col("place").alias("sid"), "bands", "sketch"), "sid"), "reps")
    run = _Run(own_columns(docs, id_col, text_col), reps, workspace, size, percent)
    members = run.members()
    near = run.stars(members)
    first = run.confirm(near)
    nodes = components(first, workspace)
    second = run.across(run.clusters(members, nodes, first), nodes)
    nodes = components(first.unionByName(second), Workspace(docs.sparkSession, "oddsketch-all"))
    of = reps.select("sid", "one", "two", "least").join(nodes.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    of = workspace.table(of, "classes")
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = workspace.table(of.join(least, "component").select("one", "two", "component_id"), "labels")
    full = rows.where("n > 0").join(labels, ["one", "two"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def kept(doc_id: Column, component_id: Column) -> Column:
    """Whether a row stands for its component; one without an id where all others have none, too."""
    return doc_id.eqNullSafe(component_id)
