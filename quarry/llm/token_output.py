"""Token ids in binary shards: one concatenated id array with Elias-Fano document boundaries.

A shard file is, all little-endian:

    8 bytes   magic b"TOKENS02"
    5 x u64   documents, those of them without an id, bytes an id (2 or 4), bytes of the document ids, bytes of the boundaries
    i64       the least document id
    document ids: Elias-Fano of the distances from the least one, ascending; documents without an id come last
    boundaries: Elias-Fano of the n + 1 offsets into the id array
    ids       u16 or u32, document after document, each with the end id

Both codes hold their select samples, so that a document's offsets are read from a few bytes of a mapped file, without a
table of 64-bit numbers. The documents are dealt by ranges of their ids, so that the shards' names are in their order, and
each task writes one shard. A shard is written under a name of its attempt and then moved, so a lost or repeated task does
no harm.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.elias_fano import EliasFano
from quarry.llm.runtime import own_columns, prepare, shared_folder, tidy
from quarry.llm.tokenizing import encode_with_end

MAGIC = b"TOKENS02"
_HEAD = struct.Struct("<8sQQQQQq")
#: Bytes of text that a shard holds, about: the memory of the task that writes it grows with it.
SHARD_BYTES = 16 << 20


def shard_bytes(doc_ids: np.ndarray, unnamed: int, bounds: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    """doc_ids: ascending, of the documents that have one; unnamed: documents behind them."""
    least = int(doc_ids[0]) if len(doc_ids) else 0
    names = EliasFano.encode(doc_ids.astype(np.int64).view(np.uint64) - np.array(least, np.int64).view(np.uint64)).to_bytes()
    boundaries = EliasFano.encode(bounds).to_bytes()
    return _HEAD.pack(MAGIC, len(doc_ids) + unnamed, unnamed, width, len(names), len(boundaries), least) + names + boundaries + ids.astype(f"<u{width}").tobytes()


class Shard:
    """A shard read back. ids(i) are those of its i-th document, found by selection."""

    def __init__(self, data: bytes):
        magic, self.n, unnamed, self.width, names, boundaries, self.least = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.named, at = self.n - unnamed, _HEAD.size
        self.names = EliasFano.from_bytes(memoryview(data)[at : at + names])
        self.boundaries = EliasFano.from_bytes(memoryview(data)[at + names : at + names + boundaries])
        self.all_ids = np.frombuffer(data, f"<u{self.width}", offset=at + names + boundaries)

    def doc_ids(self, begin: int, end: int) -> pa.Array:
        """The ids of documents begin to end, null for those without."""
        found = self.names.slice(begin, end) + np.array(self.least, np.int64).view(np.uint64)
        return pa.concat_arrays([pa.array(found.view(np.int64)), pa.nulls(max(0, end - max(begin, self.named)), pa.int64())])

    def ids(self, i: int) -> np.ndarray:
        begin, end = self.boundaries.slice(i, i + 2).tolist()
        return self.all_ids[begin:end]


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _writer(folder: str, vocabulary: str, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        doc_ids, lengths, chunks = [], [], []
        for batch in batches:
            ids, bounds = encode_with_end(batch.column("text"), vocabulary, end_id)
            if len(ids) and int(ids.max()) >> (8 * width):
                raise ValueError(f"ids don't fit {width} bytes")
            doc_ids.append(batch.column("doc_id"))
            lengths.append(np.diff(bounds))
            chunks.append(ids.astype(f"<u{width}"))
        n = sum(map(len, doc_ids))
        if not n:
            return
        total = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        where, root = _open(folder)
        name = f"{root}/shard-{part:08d}.tok"
        where.create_dir(root, recursive=True)
        own = f"{root}/.{uuid.uuid4().hex}"
        names = pa.chunked_array(doc_ids, pa.int64())
        with where.open_output_stream(own) as out:
            out.write(shard_bytes(np.asarray(names.drop_null().combine_chunks()), names.null_count, total, np.concatenate(chunks), width))
        where.move(own, name)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{folder}/shard-{part:08d}.tok"], "n_docs": pa.array([n], pa.int64()), "n_ids": pa.array([int(total[-1])], pa.int64())})

    return run


def write_tokens(docs: DataFrame, folder: str, *, vocabulary: str, end_id: int = 0, id_width: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_bytes_: int = SHARD_BYTES) -> DataFrame:
    """Encode all documents into shards below folder, in ascending id order. Returns (part, path, n_docs, n_ids, start) of each
    shard, start being the ids of all shards before it.

    folder: a URI that executors can write to. id_width: bytes an id. A null text is empty and has the end id alone.
    Rows without an id come behind all others; repeated rows stay, and so many that they don't fit a shard are dealt over several.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = own_columns(docs, id_col, text_col)
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    shards = max(1, -(-size // shard_bytes_))
    # Equal rows may trade places, so their place in the input may tell them apart.
    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text"), "place"]
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    dealt = placed.repartitionByRange(int(shards), *order).sortWithinPartitions(*order).select("doc_id", "text")
    written = dealt.mapInArrow(tidy(_writer(folder, vocabulary, end_id, id_width)), "part int, path string, n_docs long, n_ids long")
    manifest = f"{folder}/manifest"
    written.write.mode("overwrite").parquet(manifest)
    listed = spark.read.schema(written.schema).parquet(manifest)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    return listed.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            where, name = _open(path)
            with where.open_input_file(name) as f:
                shard = Shard(f.read())
            for lo in range(0, shard.n, 4096):
                hi = min(shard.n, lo + 4096)
                bounds = shard.boundaries.slice(lo, hi + 1).astype(np.int64)
                flat = shard.all_ids[bounds[0] : bounds[-1]].astype("<u4")
                offsets = bounds - bounds[0]
                yield pa.RecordBatch.from_arrays(
                    [
                        shard.doc_ids(lo, hi),
                        pa.array(start + bounds[:-1]),
                        pa.array(np.diff(offsets)),
                        pa.array([zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def read_index(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shard files."""
    prepare(manifest.sparkSession)
    few = manifest.select("path", "start")
    return few.repartition(max(1, min(few.count(), 4096)), "path").mapInArrow(tidy(_reader), "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
