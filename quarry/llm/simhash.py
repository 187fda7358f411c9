"""SimHash near-duplicates, found by meet-in-the-middle ball hashing.

Two fingerprints within the radius r have a point in common that is within r / 2 bits of either. So every distinct
fingerprint emits all its variants within half the radius, equal variants meet in a shuffle, and the fingerprints that
met are verified by their real distance. A variant has at most as many distinct fingerprints around it as it has
variants itself (65 at radius 2), whatever the copies in the corpus: groups are bounded without any cap.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.runtime import Workspace, prepare, tidy

SHINGLE = 3
RADIUS = 2
SEED = 42
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float32)


def _shingles(text: str, size: int) -> list[int]:
    parts = text.encode().lower().split()  # both treat ASCII alone
    if not parts:
        return []
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(parts) - size + 1)
    last = ends[min(size, len(parts)) - 1 :] - 1
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)]


def fingerprints_of(texts: list[str | None], size: int = SHINGLE) -> np.ndarray:
    """64-bit SimHash of each text: a bit is 1 if it is set in over half of the shingles' XXH64 (seed 42)."""
    out = np.zeros(len(texts), np.uint64)
    at = 0
    while at < len(texts):  # so many texts at once that the shingles stay in the cache
        to, hashes, counts = at, [], []
        while to < len(texts) and len(hashes) < 200_000 and to - at < 512:
            own = _shingles(texts[to] or "", size)
            hashes += own
            counts.append(len(own))
            to += 1
        h = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
        counts = np.array(counts)
        row = np.repeat(np.arange(to - at) * 256, counts)
        votes = np.stack([np.bincount(row + h[:, j], minlength=256 * (to - at)).reshape(-1, 256).astype(np.float32) @ _BITS_OF_BYTE for j in range(8)], 1)
        bits = (2 * votes.reshape(to - at, 64) > counts[:, None]).astype(np.uint8)
        out[at:to] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
        at = to
    return out


def _fingerprint_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = fingerprints_of(batch.column("text").to_pylist(), size)
            others = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in others), pa.array(prints.view(np.int64))], [*others, "bits"])

    return run


def fingerprints(docs: DataFrame, *, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", place_col: str | None = None) -> DataFrame:
    """(doc_id, bits): the fingerprint of each row as a signed long. A null text and one without words have 0. place_col: a long
    column to take along, as `place`."""
    prepare(docs.sparkSession)
    columns = [F.col(f"`{id_col}`").cast("long").alias("doc_id"), *([F.col(f"`{place_col}`").alias("place")] if place_col else []), F.col(f"`{text_col}`").cast("string").alias("text")]
    return docs.select(*columns).mapInArrow(tidy(_fingerprint_batches(size)), "doc_id long, " + ("place long, " if place_col else "") + "bits long")


def ball_masks(radius: int) -> list[int]:
    """What a fingerprint is XORed with to get all its variants within half the radius, rounded up."""
    half = (radius + 1) // 2
    masks = [sum(1 << b for b in bits) for r in range(half + 1) for bits in combinations(range(64), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b, distance): pairs of distinct fingerprints within the radius that met at a variant, a < b as signed longs.

    prints: a column `bits` of distinct values. Within a variant's group each fingerprint is paired with the smallest
    one (a star); for an odd or larger radius, where members of a group may be further apart than the radius, and so
    a star may miss a link, with all others of the group, which has at most as many as there are variants.
    """
    # Few bytes grow into many: dealt out by another key than before, or adaptive execution would leave them to a few tasks.
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = (
        prints.select("bits").repartition(parts, F.xxhash64("bits")).select("bits", F.explode(F.array(*(F.col("bits").bitwiseXOR(F.lit(m)) for m in ball_masks(radius)))).alias("variant"))
        .groupBy("variant")
        .agg(F.sort_array(F.collect_list("bits")).alias("group"))
        .where(F.size("group") > 1)
    )
    if radius <= 2 and radius % 2 == 0:
        pairs = met.select(F.element_at("group", 1).alias("a"), F.explode(F.slice("group", 2, 1 << 16)).alias("b"))
    else:
        pairs = met.select(F.explode("group").alias("a"), "group").select("a", F.explode("group").alias("b")).where("a < b")
    pairs = pairs.distinct()
    return pairs.withColumn("distance", F.bit_count(F.col("a").bitwiseXOR(F.col("b")))).where(F.col("distance") <= radius)


def classes(distinct: DataFrame, radius: int, workspace: Workspace) -> DataFrame:
    """The rows of distinct fingerprints (bits, ...) with `component`: the smallest fingerprint that each reaches over links."""
    edges = workspace.table(links(distinct.select("bits"), radius).select("a", "b"), "links")
    nodes = components(edges, workspace)
    joined = distinct.join(nodes.withColumnRenamed("node", "bits"), "bits", "left").withColumn("component", F.coalesce("component", "bits"))
    return workspace.table(joined, "classes")


def near_duplicates(docs: DataFrame, *, size: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, bits, component_id) of every row. Rows whose fingerprints differ in at most `radius` bits are linked, and
    component_id is the smallest doc_id that a row reaches over links, its own included.

    A null or empty text has fingerprint 0 and is linked like any other. Repeated rows and ids stay apart, as rows. A null
    doc_id counts in no minimum: it gets its component's smallest id, or null where all ids are null.
    """
    workspace = Workspace(docs.sparkSession, "simhash")
    rows = workspace.table(fingerprints(docs, size=size, id_col=id_col, text_col=text_col), "prints")
    of = classes(rows.groupBy("bits").agg(F.min("doc_id").alias("least")), radius, workspace)
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = workspace.table(of.join(least, "component").select("bits", "component_id"), "labels")
    return rows.join(labels, "bits").select("doc_id", "bits", "component_id")


def hex_digits(bits):
    """16 lower-case hex digits of a signed long."""
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def deduplicate(docs: DataFrame, *, size: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all its columns unchanged: that of the smallest id, of rows with one id the first in the table,
    and one without an id only where none has one."""
    place = "_place"
    while place in docs.columns:
        place += "_"
    workspace = Workspace(docs.sparkSession, "simhash")
    rows = workspace.table(docs.withColumn(place, F.monotonically_increasing_id()), "documents")
    prints = workspace.table(fingerprints(rows, size=size, id_col=id_col, text_col=text_col, place_col=place), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "place")).alias("first")
    of = classes(prints.groupBy("bits").agg(first), radius, workspace)
    kept = workspace.table(of.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.place").alias(place)), "kept")
    return rows.join(kept, place, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
