"""The first bytes of files, as a Spark data source that never reads more of them.

``spark.read.format("file_heads").load(folder)`` gives (path, length, head,
error).  Planning looks at one level of the folder: each subfolder is a split that
its task lists itself, and loose files are grouped, so the driver never holds the
names of a whole tree.  A task opens each file, reads ``bytes`` bytes and closes it: a
file of any size costs one small read.  A file that cannot be read gives a row
with an error.

The folder's store must be one that Arrow's file systems open: local files, or
HDFS, S3 and GCS where their libraries are installed.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, length bigint, head binary, error string"
#: Loose files of one split, rows of one batch, and files that a task opens at a time.
GROUP, BATCH, OPEN = 1000, 1000, 16


@dataclass
class Split(InputPartition):
    """Files, or a folder to be listed by the task."""

    files: list[tuple[str, int]]
    folder: str | None = None

    def __init__(self, files: list[tuple[str, int]], folder: str | None = None):
        super().__init__(None)
        self.files, self.folder = files, folder


class HeadReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.glob, self.size = options["path"], options.get("glob", "*"), int(options.get("bytes", 512))
        self.scheme = self.root.split(":", 1)[0] + "://" if "://" in self.root else "file://"

    def _store(self):
        from pyarrow import fs

        root = self.root.removeprefix("file:") if self.root.startswith("file:/") and not self.root.startswith("file://") else self.root
        return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)

    def _listed(self, folder: str, deep: bool) -> Iterator:
        from pyarrow import fs

        store, _ = self._store()
        for info in store.get_file_info(fs.FileSelector(folder, recursive=deep)):
            name = info.path[len(folder) :].strip("/")
            # what Spark's own file sources pass over
            if not any(part[:1] in "._" for part in name.split("/")):
                yield info

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = self._store()
        here = store.get_file_info(root)
        if here.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        if here.type == fs.FileType.File:
            return [Split([(here.path, here.size)])]
        splits, loose = [], []
        for info in self._listed(root, False):
            if info.type == fs.FileType.Directory:
                splits.append(Split([], info.path))
            elif fnmatch.fnmatchcase(info.base_name, self.glob):
                loose.append((info.path, info.size))
        loose.sort()
        splits += [Split(loose[a : a + GROUP]) for a in range(0, len(loose), GROUP)]
        return splits or [Split([])]

    def _files(self, split: Split) -> Iterator[tuple[str, int]]:
        from pyarrow import fs

        yield from split.files
        if split.folder is not None:
            for info in self._listed(split.folder, True):
                if info.type == fs.FileType.File and fnmatch.fnmatchcase(info.base_name, self.glob):
                    yield info.path, info.size

    def read(self, split: Split) -> Iterator:
        import itertools

        import pyarrow as pa

        store, _ = self._store()

        def head(file: tuple[str, int]) -> tuple:
            path, length = file
            try:
                with store.open_input_file(path) as opened:
                    return self.scheme + path, length, opened.read_at(min(self.size, length), 0), None
            except OSError as e:
                return self.scheme + path, length, None, f"I/O error: {e}"

        types, files = [pa.string(), pa.int64(), pa.binary(), pa.string()], self._files(split)
        with ThreadPoolExecutor(OPEN) as pool:
            while some := list(itertools.islice(files, BATCH)):
                columns = zip(*pool.map(head, some), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "length", "head", "error"])


class FileHeads(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return HeadReader(dict(self.options))


def read_heads(spark: SparkSession, path: str, glob: str = "*", size: int = 512) -> DataFrame:
    """(path, length, head, error) of every file under ``path`` whose name fits ``glob``."""
    spark.dataSource.register(FileHeads)
    return spark.read.format("file_heads").option("glob", glob).option("bytes", size).load(path)
