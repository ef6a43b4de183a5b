"""Folders as a data source: listing in partitions, and text files written with commit and abort.

    spark.read.format("folder").option("path", "...").load()         path, length, is_link
    df.write.format("text_files").option("path", "...").save()       a file per row of name and text

Both work on any file system that Arrow knows; a path without a scheme is local. register(spark) makes them known.
"""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

#: The driver lists folders level by level until it has so many, and leaves what is below them to tasks.
SPREAD = 64
#: Files that a commit moves at a time.
MOVERS = 16
#: Times that an abort tries to remove a folder into which tasks still write.
ABORTS = 20


def system_of(folder: str) -> tuple[Any, str]:
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + os.path.abspath(folder))


def entries(system: Any, folder: str) -> Iterator[tuple[str, bool, bool, int]]:
    """path, whether it is a folder, whether it is a link, and length, of what is in a folder; links aren't followed. A
    folder that is gone or can't be read is empty."""
    import pyarrow.fs

    if isinstance(system, pyarrow.fs.LocalFileSystem):
        try:
            with os.scandir(folder) as found:
                for e in sorted(found, key=lambda e: e.name):
                    yield e.path, e.is_dir(follow_symlinks=False), e.is_symlink(), e.stat(follow_symlinks=False).st_size
        except OSError:
            return
        return
    for e in system.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True)):
        yield e.path, e.type == pyarrow.fs.FileType.Directory, False, e.size or 0


@dataclass
class Below(InputPartition):
    """A folder to list; whether what is below its folders too."""

    folder: str
    deep: bool

    def __post_init__(self) -> None:
        super().__init__(None)


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.endings = tuple(x.strip().lower() for x in options.get("endings", "").split(",") if x.strip())
        self.hidden = options.get("hidden", "false").lower() == "true"

    def seen(self, path: str) -> bool:
        return self.hidden or not posixpath.basename(path).startswith(".")

    def partitions(self) -> list[Below]:
        system, root = system_of(self.path)
        listed, level = [], [root]
        while level and len(level) < SPREAD:
            listed += [Below(f, False) for f in level]
            level = [p for f in level for p, is_folder, _, _ in entries(system, f) if is_folder and self.seen(p)]
        return [*listed, *(Below(f, True) for f in level)]

    def read(self, partition: Below) -> Iterator[tuple[str, int, bool]]:
        system, _ = system_of(self.path)
        ahead = [partition.folder]
        while ahead:
            for path, is_folder, is_link, length in entries(system, ahead.pop()):
                if not self.seen(path):
                    continue
                if is_folder:
                    ahead += [path] if partition.deep else []
                elif not self.endings or path.rsplit(".", 1)[-1].lower() in self.endings:
                    yield path, length, is_link


class FolderSource(DataSource):
    """Options: path, endings (comma-separated; others aren't given), hidden (true to list names that begin with a dot)."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return "path string, length long, is_link boolean"

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader(dict(self.options))


@dataclass
class Staged(WriterCommitMessage):
    """The folder that a task's attempt has written to, and its files."""

    folder: str
    files: int


class TextFileWriter(DataSourceWriter):
    """Each attempt of a task writes to a folder of its own, below one of the job. A commit moves the files of the attempts
    that Spark has taken to their places; an abort, and a commit's end, removes the job's folder. So a repeated task
    leaves one file, and a failed job none. A commit that is cut short can be run again: what is moved stays.

    The driver makes the job's folder, and tasks make none above their own: one that still runs after an abort fails."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        system, root = system_of(self.path)
        self.staging = posixpath.join(root, f".staging-{uuid.uuid4().hex}")
        system.create_dir(self.staging)

    def write(self, iterator: Iterator[Row]) -> Staged:
        system, _ = system_of(self.path)
        folder, n, made = posixpath.join(self.staging, str(TaskContext.get().taskAttemptId())), 0, set()
        for row in iterator:
            if os.path.isabs(row.name) or ".." in row.name.split("/"):
                raise ValueError(f"a name leads out of the folder: {row.name}")
            at = posixpath.join(folder, row.name)
            if (above := posixpath.dirname(at)) not in made:
                names = posixpath.relpath(above, self.staging).split("/")
                for k in range(1, len(names) + 1):
                    system.create_dir(posixpath.join(self.staging, *names[:k]), recursive=False)
                made.add(above)
            with system.open_output_stream(at) as out:
                out.write((row.text or "").encode())
            n += 1
        return Staged(folder, n)

    def commit(self, messages: list[Staged | None]) -> None:
        import pyarrow.fs

        system, root = system_of(self.path)
        for message in messages:
            if not message or not message.files:
                continue
            found = system.get_file_info(pyarrow.fs.FileSelector(message.folder, recursive=True))
            names = [f.path[len(message.folder) :].lstrip("/") for f in found if f.type == pyarrow.fs.FileType.File]
            for above in {posixpath.dirname(n) for n in names}:
                system.create_dir(posixpath.join(root, above))
            with ThreadPoolExecutor(MOVERS) as pool:
                list(pool.map(lambda n, f=message.folder: system.move(posixpath.join(f, n), posixpath.join(root, n)), names))
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        import pyarrow.fs

        system, _ = system_of(self.path)
        for left in reversed(range(ABORTS)):
            if system.get_file_info(self.staging).type == pyarrow.fs.FileType.NotFound:
                return
            try:
                system.delete_dir(self.staging)
            except OSError:  # a task that still runs has put a file into it
                if not left:
                    raise


class TextFiles(DataSource):
    """Option: path. Rows have name (below the path, which may have folders) and text; a null text is an empty file."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> TextFileWriter:
        return TextFileWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FolderSource)
    spark.dataSource.register(TextFiles)
