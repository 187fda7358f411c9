"""Objects below one root, by key: through Hadoop's file systems on the driver, and many at once on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ObjectStore:
    """root: a folder or bucket, as a URI or a path; it is made where it is missing."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        folder, fs = self._path("")
        fs.mkdirs(folder)

    def _path(self, key: str):
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.uri(key))
        return path, path.getFileSystem(sc._jsc.hadoopConfiguration())

    def uri(self, key: str) -> str:
        if ".." in key.split("/"):
            raise ValueError(f"not a key: {key}")
        return f"{self.root}/{key.lstrip('/')}".rstrip("/")

    def put(self, key: str, data: bytes | str) -> str:
        path, fs = self._path(key)
        out = fs.create(path, True)
        out.write(bytearray(data.encode() if isinstance(data, str) else data))
        out.close()
        return self.uri(key)

    def get(self, key: str) -> bytes:
        """An object's bytes; a missing one is a KeyError."""
        path, fs = self._path(key)
        if not fs.exists(path):
            raise KeyError(key)
        rows = self.spark.read.format("binaryFile").load(self.uri(key)).select("content").collect()
        return bytes(rows[0][0])

    def exists(self, key: str) -> bool:
        path, fs = self._path(key)
        return bool(fs.exists(path))

    def clear(self, prefix: str) -> bool:
        """Delete all below a prefix; false if there was nothing. The root itself is never a prefix."""
        if not prefix.strip("/"):
            raise ValueError("a prefix is needed")
        path, fs = self._path(prefix)
        return bool(fs.delete(path, True))

    def put_all(self, rows: DataFrame, key_col: str = "key", content_col: str = "content") -> DataFrame:
        """Write an object for each row, on the executors; returns (key, uri, n_bytes). Equal keys: any one of them stays. Nothing is
        written before the result is read."""
        root = self.root if "://" in self.root or self.root.startswith("file:") else f"file://{self.root}"

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            where, base = afs.FileSystem.from_uri(root)
            for frame in frames:
                for key, content in zip(frame["key"], frame["content"], strict=True):
                    place = f"{base}/{key}"
                    where.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    with where.open_output_stream(place) as out:
                        out.write(bytes(content))
                yield pd.DataFrame({"key": frame["key"], "uri": [f"{root}/{k}" for k in frame["key"]], "n_bytes": [len(c) for c in frame["content"]]})

        own = rows.select(F.col(key_col).alias("key"), F.col(content_col).cast("binary").alias("content")).where("key is not null and content is not null and not contains(key, '..')")
        return own.mapInPandas(run, "key string, uri string, n_bytes long")
