"""Graph formats as data sources: df.write.format("gfa").save(path).

Tasks write the lines of their rows to files of their own in a folder of the attempt; when all have
succeeded the files are moved to their names, and the lines before and after all others get files
that sort first and last. A failed job removes its folder and leaves what was there before.

    formats.register(spark)
    export.gfa_lines(graph).write.format("gfa").mode("append").save("s3://bucket/graph")
    spark.read.format("gfa").load("s3://bucket/graph")     # the lines, files in order
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .export import GFA_HEADER

#: Folders and files that are not part of a result begin with it, as everywhere in Spark.
HIDDEN = "_"


@dataclass
class Written(WriterCommitMessage):
    """A task's file, by its number, and what it holds."""

    task: int
    file: str
    lines: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class LinesWriter(DataSourceWriter):
    """Writes the column `line`; rows that are a first or last line are left to commit()."""

    def __init__(self, options: dict[str, str], schema, source: type[LinesSource], overwrite: bool):
        if "line" not in schema.fieldNames():
            raise ValueError("a column `line` is needed")
        self.at, self.source, self.overwrite = schema.fieldNames().index("line"), source, overwrite
        self.path = options["path"].rstrip("/")
        self.attempt = posixpath.join(self.path, f"{HIDDEN}attempt-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, folder = opened(self.attempt)
        system.create_dir(folder, recursive=True)
        # An attempt of a task has a name of its own, so a repeated one takes nothing over.
        name, n = f"{context.partitionId():05d}-{uuid.uuid4().hex}", 0
        with system.open_output_stream(posixpath.join(folder, name)) as out:
            for row in iterator:
                line = row[self.at]
                if line is not None and line not in self.source.frame:
                    out.write(f"{line}\n".encode())
                    n += 1
        return Written(context.partitionId(), name, n)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = opened(self.path)
        old = [f.path for f in system.get_file_info(fs.FileSelector(folder)) if not f.base_name.startswith(HIDDEN)] if self.overwrite else []
        _, attempt = opened(self.attempt)
        system.create_dir(folder, recursive=True)
        stamp, end = uuid.uuid4().hex, self.source.extension
        for m in messages:
            if m is not None and m.lines:
                system.move(posixpath.join(attempt, m.file), posixpath.join(folder, f"part-{m.task:05d}-{stamp}.{end}"))
        for name, lines in (("head", self.source.first), ("tail", self.source.last)):
            # One header, however often rows are appended.
            own = posixpath.join(folder, f"{'a' if name == 'head' else 'z'}-{name}.{end}")
            if lines:
                with system.open_output_stream(own) as out:
                    out.write("".join(f"{x}\n" for x in lines).encode())
                old = [f for f in old if f != own]
        for file in old:
            system.delete_file(file)
        self._clear(system, attempt)

    def abort(self, messages: list[Written | None]) -> None:
        system, attempt = opened(self.attempt)
        self._clear(system, attempt)

    @staticmethod
    def _clear(system: fs.FileSystem, folder: str) -> None:
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


@dataclass
class File(InputPartition):
    path: str


class LinesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")

    def partitions(self) -> list[File]:
        system, folder = opened(self.path)
        return [File(name) for name in sorted(f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.is_file and not f.base_name.startswith(HIDDEN))] or [File("")]

    def read(self, part: File) -> Iterator[tuple[str]]:
        if not part.path:
            return
        system, _ = opened(self.path)
        with system.open_input_stream(part.path) as stream:
            rest = b""
            while block := stream.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                yield from ((line.decode(),) for line in lines)
            if rest:
                yield (rest.decode(),)


class LinesSource(DataSource):
    """Lines with `first` and `last` around them; rows that are such lines themselves are left to them."""

    extension = "txt"
    first: tuple[str, ...] = ()
    last: tuple[str, ...] = ()
    frame: frozenset[str] = frozenset()

    @classmethod
    def name(cls) -> str:
        return cls.extension

    def schema(self) -> str:
        return "line string"

    def reader(self, schema) -> LinesReader:
        return LinesReader(self.options)

    def writer(self, schema, overwrite: bool) -> LinesWriter:
        return LinesWriter(self.options, schema, type(self), overwrite)


class Gfa(LinesSource):
    """Of export.gfa_lines()."""

    extension = "gfa"
    first = (GFA_HEADER,)
    frame = frozenset(first)


class Dot(LinesSource):
    """Of export.dot_lines()."""

    extension = "dot"
    first, last = ("digraph {",), ("}",)
    frame = frozenset(first + last)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    for source in (Gfa, Dot):
        spark.dataSource.register(source)
