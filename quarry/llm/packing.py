"""Packing by power-of-two decomposition.

A document of n ids is cut into whole sequences of the largest length and one piece for each binary digit of the rest,
long ones first. Pieces of equal length are in one bucket and each is a sequence of its own: a sequence never crosses
documents, and none is padded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.runtime import Workspace, number_rows, own_columns, prepare, tidy
from quarry.llm.tokenizing import encode_with_end

LENGTH = 1024
#: Parts over which each bucket is numbered.
PARTS = 4096


def binary_pieces(n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, length) of the pieces of documents of n ids, in order; length is a power of two."""
    whole, rest = n // length, n % length
    digits = 1 << np.arange(length.bit_length() - 2, -1, -1) if length > 1 else np.zeros(0, np.int64)
    counts = np.concatenate([whole[:, None], (rest[:, None] & digits) > 0], 1).astype(np.int64)
    lengths = np.broadcast_to(np.append(length, digits), counts.shape)
    owner = np.broadcast_to(np.arange(len(n))[:, None], counts.shape)
    return np.repeat(owner.ravel(), counts.ravel()), np.repeat(lengths.ravel(), counts.ravel())


def _piece_batches(vocabulary: str, end_id: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bounds = encode_with_end(batch.column("text"), vocabulary, end_id)
            n = np.diff(bounds)
            owner, size = binary_pieces(n, length)
            at = np.cumsum(size) - size
            flat = ids.astype("<u4")
            offsets = np.append(4 * at, 4 * len(flat)).astype(np.int32)
            pieces = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner)), pa.array(at - bounds[owner]), pa.array(size.astype(np.int64)), pa.array(n[owner]), pieces],
                ["doc_id", "start", "length", "doc_tokens", "ids"],
            )

    return run


def pieces(docs: DataFrame, *, vocabulary: str, end_id: int = 0, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start (ids of its document before it), length, doc_tokens and ids (little-endian unsigned 32-bit).

    A null text is empty: a piece with the end id alone. Repeated rows and null ids are packed like any other row.
    """
    if length & (length - 1) or length < 1:
        raise ValueError("length must be a power of two")
    prepare(docs.sparkSession)
    return own_columns(docs, id_col, text_col).mapInArrow(tidy(_piece_batches(vocabulary, end_id, length)), "doc_id long, start long, length long, doc_tokens long, ids binary")


def number_sequences(cut: DataFrame, parts: int = PARTS) -> DataFrame:
    """Add sequence_id, without gaps from 0 and bucket after bucket, the longest first, and offset (0) to pieces with a `place`.

    Reads its input twice: pass a table. The number comes from counts by bucket and part and a rank in each; parts follow
    the rows' places, so that many rows of one id are in many parts.
    """
    lengths = cut.groupBy("length").agg(F.count("*").alias("_n"))  # as many rows as there are powers of two
    larger = lengths.select(F.col("length").alias("_length"), F.col("_n").alias("_larger"))
    first = lengths.join(F.broadcast(larger), F.col("_length") > F.col("length"), "left").groupBy("length").agg(F.coalesce(F.sum("_larger"), F.lit(0)).alias("_first"))
    dealt = cut.withColumn("_part", F.pmod(F.xxhash64("place"), F.lit(parts)).cast("int"))
    numbered = number_rows(dealt, ["length"], "_part", ["doc_id", "start", "place"], "_within")
    return numbered.join(F.broadcast(first), "length").withColumn("sequence_id", F.col("_first") + F.col("_within")).withColumn("offset", F.lit(0).cast("long")).drop("_part", "_first", "_within", "place")


def pack(docs: DataFrame, **options) -> DataFrame:
    """The pieces with their ids and sequences, from a table in the shared folder."""
    return number_sequences(_placed(pieces(docs, **options)))


def _placed(cut: DataFrame) -> DataFrame:
    """A table of pieces, each with a number of its own."""
    return Workspace(cut.sparkSession, "packing").table(cut.withColumn("place", F.monotonically_increasing_id()), "pieces")


def pack_index(docs: DataFrame, **options) -> DataFrame:
    """As `pack`, with the unsigned crc32 of the ids in place of the ids themselves."""
    cut = pieces(docs, **options).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return number_sequences(_placed(cut))


def unpack(packed: DataFrame) -> DataFrame:
    """(doc_id, ids) of each document, its pieces joined in order. Expects unique ids."""
    return packed.groupBy("doc_id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(start, ids))), x -> hex(x.ids)), '')").alias("_hex")).select("doc_id", F.unhex("_hex").alias("ids"))
