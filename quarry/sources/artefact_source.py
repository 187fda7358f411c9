"""Stored artefacts as a data source: files <root>/<app>/<folder>/<place>/<folder>_page<n>.<end> as rows.

Filters on application, folder and page are answered from the names of files, and those on application and folder
from the names of folders: what isn't asked for is not opened, and where both are given not even listed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from quarry.sources.files import KINDS

#: Files that one task opens.
FILES_A_TASK = 64
_TESTS = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


@dataclass
class Files(InputPartition):
    #: (app_id, folder, page_no, place) of some files.
    keys: list[tuple[str, str, int, str]]


class ArtefactReader(DataSourceReader):
    def __init__(self, root: str, kind: str):
        self.root, self.place, self.asked = root, KINDS[kind][0], []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("app_id",), ("folder",), ("page_no",)):
                self.asked.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def _fits(self, column: str, value) -> bool:
        return all(value is not None and _TESTS[kind](value, against) for name, kind, against in self.asked if name == column)

    def _named(self, column: str) -> list[str] | None:
        """The only values of a column that fit, where a filter names them."""
        named = [set(against if kind is In else [against]) for name, kind, against in self.asked if name == column and kind in (EqualTo, In)]
        return sorted(v for v in set.intersection(*named) if isinstance(v, str) and self._fits(column, v)) if named else None

    def _below(self, files: fs.FileSystem, path: str, column: str) -> list[str]:
        named = self._named(column)
        if named is not None:
            return named
        found = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.Directory and self._fits(column, f.base_name))

    def partitions(self) -> list[InputPartition]:
        files, root = fs.FileSystem.from_uri(self.root)
        keys = []
        for app in self._below(files, root, "app_id"):
            for folder in self._below(files, f"{root}/{app}", "folder"):
                for f in files.get_file_info(fs.FileSelector(f"{root}/{app}/{folder}/{self.place}", allow_not_found=True)):
                    page = re.search(r"_page(\d+)\.[a-z]+$", f.base_name)
                    if page and self._fits("page_no", int(page[1])):
                        keys.append((app, folder, int(page[1]), f.path))
        return [Files(keys[i : i + FILES_A_TASK]) for i in range(0, len(keys), FILES_A_TASK)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        files = fs.FileSystem.from_uri(self.root)[0]
        for app, folder, page, path in partition.keys:
            with files.open_input_stream(path) as stream:
                yield app, folder, page, stream.read().decode("utf-8")


class ArtefactSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "artefacts"

    def schema(self) -> str:
        return "app_id string, folder string, page_no int, content string"

    def reader(self, schema) -> DataSourceReader:
        return ArtefactReader(self.options["path"], self.options.get("kind", "text"))


def artefacts(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """(app_id, folder, page_no, content) of the stored texts of one kind below a root, a URI. A file whose name has no page is none."""
    if kind not in KINDS or kind == "image":
        raise ValueError(f"no texts of kind {kind!r}")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArtefactSource)
    return spark.read.format("artefacts").option("kind", kind).load(root)


def write(rows: DataFrame, root: str, kind: str) -> None:
    """Store texts (app_id, folder, page_no, content) as files, from the tasks that have them. A file that is there is replaced, so
    that a task can be done again."""
    place, end = KINDS[kind]

    def store(own: Iterator) -> None:
        files, base = fs.FileSystem.from_uri(root)
        made = set()
        for r in own:
            folder = f"{base}/{r.app_id}/{r.folder}/{place}"
            if folder not in made:
                files.create_dir(folder)
                made.add(folder)
            with files.open_output_stream(f"{folder}/{r.folder}_page{r.page_no}.{end}") as stream:
                stream.write((r.content or "").encode("utf-8"))

    rows.select("app_id", "folder", "page_no", "content").foreachPartition(store)
