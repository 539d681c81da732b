"""Files of a directory tree as a Spark data source, names that begin with _ or a dot included.

Spark's own file sources leave such names out. The driver looks at the roots' own entries; each directory there is a
partition, which walks its tree when Spark runs it. Contents are read in a step of their own, dealt out anew by file.
File systems are those that Arrow opens by URI: local ones, HDFS and object stores.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "docloom_tree"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it; what has no scheme is local."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _entries(system: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    return sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda i: i.path)


class _Part(InputPartition):
    """Directories to walk and files that are there, below a root; ``below`` is where the root's own path ends in theirs."""

    def __init__(self, root: str, below: int, folders: list[str], files: list[tuple[str, int]]) -> None:
        super().__init__(None)
        self.root, self.below, self.folders, self.files = root, below, folders, files


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.roots, self.skip, self.ending = json.loads(options["roots"]), set(json.loads(options["skip"])), options["ending"]

    def _walked(self, name: str) -> bool:
        return not name.startswith(".") and name not in self.skip

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for root in self.roots:
            system, path = opened(root.rstrip("/") or "/")
            if system.get_file_info(path).type != fs.FileType.Directory:
                continue
            entries = _entries(system, path)
            out += [_Part(root, len(path), [e.path], []) for e in entries if e.type == fs.FileType.Directory and self._walked(e.base_name)]
            if files := [(e.path, e.size) for e in entries if e.type == fs.FileType.File and e.base_name.endswith(self.ending)]:
                out.append(_Part(root, len(path), [], files))
        return out or [_Part("", 0, [], [])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        def told(path: str, size: int) -> tuple:
            return partition.root.rstrip("/") + "/" + path[partition.below :].lstrip("/"), size

        yield from (told(*f) for f in partition.files)
        folders = list(partition.folders)
        system = opened(partition.root)[0] if folders else None
        while folders:
            for e in _entries(system, folders.pop()):
                if e.type == fs.FileType.Directory:
                    if self._walked(e.base_name):
                        folders.append(e.path)
                elif e.base_name.endswith(self.ending):
                    yield told(e.path, e.size)


class Tree(DataSource):
    """Options: ``roots`` and ``skip`` (JSON arrays; skip has names of directories), ``ending`` of file names."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, size long"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


def list_files(spark: SparkSession, roots: list[str], skip: tuple[str, ...] = (), ending: str = "") -> DataFrame:
    """(path, size) of the files below the roots that exist, but for hidden directories and those named in ``skip``."""
    spark.dataSource.register(Tree)
    return spark.read.format(FORMAT).options(roots=json.dumps(list(roots)), skip=json.dumps(list(skip)), ending=ending).load()


def with_texts(files: DataFrame, most: int = 64 << 20) -> DataFrame:
    """(path, text) of files (path, size), read where Spark deals them; bytes that are no UTF-8 become the replacement character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, texts, held = [], [], 0
            for path in batch.column(0).to_pylist():
                system, inner = opened(path)
                with system.open_input_stream(inner) as f:
                    texts.append(f.read().decode("utf-8", "replace"))
                paths.append(path)
                held += len(texts[-1])
                if held > most:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], ["path", "text"])
                    paths, texts, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], ["path", "text"])

    spread = files.select("path").repartition(F.xxhash64("path"))
    return spread.mapInArrow(run, "path string, text string")
