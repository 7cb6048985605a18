"""SC1: a directory tree as a Python data source.

Spark's own file sources skip names that start with ``_`` or ``.``, so ``__init__.py`` would
be lost. The driver lists the upper directories only, until there are enough of them to share;
each task walks the trees below its own. Ignored names are not entered. Contents of Python files
are always read, since analyzers parse them at any size; other files above the limit come without
content. A file that cannot be read is a row with the reason in ``error``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from projectpulse.functions import fixed


class DirectoryBatch(InputPartition):
    """Directories to read; ``deep`` also those below them."""

    def __init__(self, directories: list[str], deep: bool):
        self.directories, self.deep = directories, deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.limit = int(options.get("maxbytes", fixed.MAX_CONTENT_BYTES))
        self.wanted = int(options.get("partitions", 256))
        self.ignored = set(fixed.IGNORED_DIRECTORIES)

    def partitions(self) -> list[InputPartition]:
        if not os.path.isdir(self.root):
            raise ValueError(f"inspection root is not a directory: {self.root}")
        upper, level = [], [self.root]
        while level and len(level) < self.wanted:  # one level deeper at a time
            upper += level
            level = [d for current in level for d in self._below(current)]
        return [DirectoryBatch([d], False) for d in upper] + [DirectoryBatch([d], True) for d in level]

    def _below(self, directory: str) -> list[str]:
        try:
            return sorted(e.path for e in os.scandir(directory) if e.is_dir(follow_symlinks=False) and e.name not in self.ignored)
        except OSError:
            return []

    def read(self, partition: DirectoryBatch):
        pending = list(partition.directories)
        while pending:
            directory = pending.pop()
            if partition.deep:
                pending += self._below(directory)
            try:
                entries = [e for e in os.scandir(directory) if e.is_file()]
            except OSError as reason:
                yield self._relative(directory), directory, None, None, str(reason)
                continue
            for entry in entries:
                size = content = error = None
                try:
                    size = entry.stat().st_size
                    if size <= self.limit or entry.name.endswith(".py"):
                        with open(entry.path, "rb") as handle:
                            content = handle.read()
                except OSError as reason:
                    error = str(reason)
                yield self._relative(entry.path), entry.path, size, content, error

    def _relative(self, path: str) -> str:
        return os.path.relpath(path, self.root).replace(os.sep, "/")


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "project_tree"

    def schema(self) -> str:
        return "path string, absolute_path string, size_bytes bigint, content binary, error string"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, root: str, **options) -> DataFrame:
    """Files below ``root`` with their contents; see the module for null contents and ``error``."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("project_tree").options(**options).load(root)
