"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Equal texts are a group. Each group goes to the shard where the dot product of its sizes with what is left of the shard's
capacity is highest, large groups first. Groups of over 1 / LARGE of all bytes, tokens or rows, of which there are at most
3 * LARGE, are placed on the driver. The others are dealt over tasks by a hash of their text; each task has its part of
what the large ones have left of every shard, and packs its groups into that, one by one.

A group stays together unless it alone exceeds 1 / SPLIT of a shard's capacity in one of the three sizes. Near equal
shards can't hold such a group, so it is cut into pieces of at most that size; the output says into how many.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.runtime import Workspace, number_rows, prepare

SHARDS = 8
#: A group of over 1 / LARGE of all bytes, tokens or rows is placed before the others.
LARGE = 4096
#: A group of over 1 / SPLIT of a shard's capacity is cut.
SPLIT = 4
#: Groups that a task packs, about.
GROUPS_PER_TASK = 100_000
#: Parts over which a shard's rows are numbered.
PARTS = 4096
_SIZES = ("size", "tokens", "rows")
_WORD = r"[^\x20\x09-\x0D]+"


def pack_vectors(items: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """The bin of each item (a row of sizes), by the dot-product rule, the item with the largest size first. capacity: what
    each bin has room for, of which the items' part is taken away in place."""
    total = items.sum(0)
    unit = np.where(total > 0, total, 1)
    share, left = items / unit, capacity / unit
    out = np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -share.max(1, initial=0))).tolist():
        out[i] = best = int(np.argmax(left @ share[i]))  # the first of equal ones
        left[best] -= share[i]
    capacity[:] = left * unit
    return out


def _packer(room: np.ndarray) -> Callable[[tuple, pa.Table], pa.Table]:
    """room: the part of each size that each shard has of what is left."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("text_crc32", "ascending")])
        items = np.stack([np.asarray(table.column(c).combine_chunks()) for c in _SIZES], 1).astype(float)
        shard = pack_vectors(items, room * items.sum(0))
        return table.select(["key", "text_crc32"]).append_column("shard", pa.array(shard.astype(np.int32)))

    return run


def shard(docs: DataFrame, *, shards: int = SHARDS, large: int = LARGE, split: int = SPLIT, groups_per_task: int = GROUPS_PER_TASK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes plus 1), tokens (words), text_crc32, shard, slot (its place in the shard,
    from 0 without gaps) and group_pieces (1 where all documents of its text are in its shard, else the pieces that the
    group was cut into, as it exceeds 1 / split of a shard's bytes, tokens or rows).

    A null text counts as empty, and so do equal. Repeated rows and null ids take their places like any other row; rows are
    told apart by their place in a table, so that no task gets all of one id.
    """
    spark = docs.sparkSession
    prepare(spark)
    ws = Workspace(spark, "sharding")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("tokens"),
        F.lit(1).cast("long").alias("rows"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.monotonically_increasing_id().alias("place"),
    )
    rows = ws.table(rows, "rows")
    group = ["key", "text_crc32"]
    groups = ws.table(rows.groupBy(*group).agg(*(F.sum(c).alias(c) for c in _SIZES)), "groups")
    total = groups.agg(*(F.sum(c).alias(c) for c in _SIZES), F.count("*").alias("groups")).first()
    if not total["rows"]:
        return rows.select("doc_id", "size", "tokens", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(1).alias("group_pieces"))
    share = F.greatest(*(F.col(c) / F.lit(max(1, total[c])) for c in _SIZES))
    found = groups.where(share > 1 / large).withColumn("pieces", F.greatest(F.lit(1), F.ceil(share * (shards * split))).cast("int")).orderBy(*group).collect()
    room = np.array([total[c] for c in _SIZES], float)[None] / shards * np.ones((shards, 1))
    pieces = [(r, n) for r in found for n in range(r["pieces"])]
    items = np.array([[r[c] / r["pieces"] for c in _SIZES] for r, _ in pieces], float).reshape(-1, 3)
    bins = pack_vectors(items, room)
    listed = [(r["key"], r["text_crc32"], r["pieces"], n, int(b)) for (r, n), b in zip(pieces, bins, strict=True)]
    own = spark.createDataFrame(listed, "key long, text_crc32 long, group_pieces int, piece int, shard int")  # 3 * LARGE groups at most
    names = own.where("piece = 0").select(*group, "group_pieces")

    room = room.clip(0)
    room /= np.where(room.sum(0) > 0, room.sum(0), 1)
    tasks = max(1, -(-total["groups"] // groups_per_task))
    small = groups.join(F.broadcast(names), group, "left_anti").withColumn("task", F.pmod(F.xxhash64("key", F.lit("task")), F.lit(tasks)))
    placed = ws.table(small.groupBy("task").applyInArrow(_packer(room), "key long, text_crc32 long, shard int"), "placed")

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("place"), F.lit(PARTS)).cast("int"))
    marked = dealt.join(F.broadcast(names), group, "left")
    # The rows of a cut group are numbered, so that its pieces are equal.
    cut = number_rows(marked.where("group_pieces > 1"), group, "part", ["place"], "at").withColumn("piece", (F.col("at") % F.col("group_pieces")).cast("int")).drop("at")
    whole = marked.where("group_pieces = 1").withColumn("piece", F.lit(0))
    of_large = cut.unionByName(whole).join(F.broadcast(own.drop("group_pieces")), [*group, "piece"]).drop("piece")
    of_small = marked.where("group_pieces is null").join(placed, group).withColumn("group_pieces", F.lit(1))
    both = ws.table(of_large.unionByName(of_small), "both")
    for name in ("rows", "groups", "placed"):
        ws.drop(name)
    return number_rows(both, ["shard"], "part", ["doc_id", "key", "text_crc32", "place"], "slot").select("doc_id", "size", "tokens", "text_crc32", "shard", "slot", "group_pieces")
