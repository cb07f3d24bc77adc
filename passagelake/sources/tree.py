"""A tree of Markdown units as a data source: partitions of whole files, and a writer that commits all of its files or none.

format("markdown_tree"): rows (source, path, content); path is below the root and names its source's folder. Option `sources`, a
JSON list, reads those folders only. A task writes to a folder of its own attempt below `_staging`; the commit
moves the files of the attempts that Spark took to their places, an abort removes the staging folder. So an attempt that
failed, or that ran twice, leaves no unit behind, and a reader never sees half a unit.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "source string, path string, content string"
STAGING = "_staging"
#: Bytes of a partition's files; a larger file is a partition alone.
PARTITION_BYTES = 32 << 20


def _files(root: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(root)


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, str]]


@dataclass
class Written(WriterCommitMessage):
    folder: str
    paths: list[str]


class MarkdownTree(DataSource):
    """unit-*.md below a root, a folder a source."""

    @classmethod
    def name(cls) -> str:
        return "markdown_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options["path"], json.loads(self.options.get("sources", "null")))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return TreeWriter(self.options["path"])


class TreeReader(DataSourceReader):
    def __init__(self, root: str, sources: list[str] | None):
        self.root, self.sources = root, sources

    def partitions(self) -> list[Files]:
        """Files in order of their paths, by size."""
        import pyarrow.fs as pafs

        fs, base = _files(self.root)
        folders = [base] if self.sources is None else [posixpath.join(base, s) for s in self.sources]
        found = []
        for folder in folders:
            for f in fs.get_file_info(pafs.FileSelector(folder, recursive=True, allow_not_found=True)):
                path = posixpath.relpath(f.path, base)
                name = posixpath.basename(path)
                if f.is_file and name.startswith("unit-") and name.endswith(".md") and not path.startswith(STAGING):
                    found.append((path, f.size or 0))
        out, size = [], 0
        for path, n in sorted(found):
            if not out or size + n > PARTITION_BYTES:
                out.append(Files([]))
                size = 0
            out[-1].paths.append((path.partition("/")[0] if "/" in path else "", path))
            size += n
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple[str, str, str]]:
        fs, base = _files(self.root)
        for source, path in partition.paths:
            with fs.open_input_stream(posixpath.join(base, path)) as f:
                yield source, path, f.read().decode("utf-8")


class TreeWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.run = root, uuid.uuid4().hex

    def write(self, iterator) -> Written:
        fs, base = _files(self.root)
        folder = posixpath.join(STAGING, self.run, str(TaskContext.get().taskAttemptId()))
        paths = []
        for row in iterator:
            at = posixpath.join(base, folder, row.path)
            fs.create_dir(posixpath.dirname(at), recursive=True)
            with fs.open_output_stream(at) as f:
                f.write(row.content.encode("utf-8"))
            paths.append(row.path)
        return Written(folder, paths)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = _files(self.root)
        for m in messages:
            for path in m.paths if m else ():
                at = posixpath.join(base, path)
                fs.create_dir(posixpath.dirname(at), recursive=True)
                fs.move(posixpath.join(base, m.folder, path), at)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        import pyarrow.fs as pafs

        fs, base = _files(self.root)
        folder = posixpath.join(base, STAGING, self.run)
        if fs.get_file_info(folder).type != pafs.FileType.NotFound:
            fs.delete_dir(folder)
        rest = posixpath.join(base, STAGING)
        if fs.get_file_info(rest).type != pafs.FileType.NotFound and not fs.get_file_info(pafs.FileSelector(rest)):
            fs.delete_dir(rest)


def read_tree(spark: SparkSession, root: str, sources: list[str] | None = None) -> DataFrame:
    """The units below root, or those of some sources only: (source, path, content)."""
    spark.dataSource.register(MarkdownTree)
    reader = spark.read.format(MarkdownTree.name())
    return (reader if sources is None else reader.option("sources", json.dumps(sources))).load(root)


def write_tree(units: DataFrame, root: str) -> None:
    """units (source, path, content), all of them or none; a unit that is there already is replaced."""
    units.sparkSession.dataSource.register(MarkdownTree)
    units.select("source", "path", "content").write.format(MarkdownTree.name()).mode("append").save(root)
