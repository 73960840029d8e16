"""One JSON file per thread: tasks stage files, and a commit shows all of them or none.

Spark's own writers choose file names, so this is a data source of its own. Each task writes its threads
below a staging folder next to the target, every file under a temporary name first, and moves it to its
staged place when it is whole. A task that is run again writes the same bytes to the same place. The
commit moves the staged tree to the target in one step; an aborted job removes it, and the
target stays as it was. That step must be a rename: a folder shared by all machines, or HDFS.

A thread comes in parts in order and is streamed, so no task holds a long one.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

SOURCE = "thread_files"
SCHEMA = "file string, part long, info string, entries string"


def file_system(path: str):
    """The file system of a path and the path in it."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    scheme, found, _ = path.partition(":/")
    if not found or scheme == "file":
        return LocalFileSystem(), "/" + re.sub(r"^file:/*", "", path).lstrip("/") if found else path
    if scheme not in ("hdfs",):
        raise ValueError(f"thread files need a file system that can rename folders, not {scheme}")
    return FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    files: int


class ThreadFileWriter(DataSourceArrowWriter):
    """Rows ``file, part, info, entries``, those of a file together and in order, to one file each."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path.rstrip("/"), overwrite
        head, name = posixpath.split(self.path)
        self.stage = posixpath.join(head, f".{name}-{uuid.uuid4().hex}")
        system, place = file_system(self.path)
        from pyarrow.fs import FileType

        if system.get_file_info(place).type != FileType.NotFound and not overwrite:
            raise ValueError(f"{path} exists")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, stage = file_system(self.stage)
        own = f"{stage}/open/{uuid.uuid4().hex}"
        system.create_dir(own, recursive=True)
        name, last, out, files, begun = None, None, None, 0, False

        def close() -> None:
            out.write(b"]}")
            out.close()
            target = f"{stage}/tree/{name}"
            system.create_dir(posixpath.dirname(target), recursive=True)
            system.move(f"{own}/file", target)

        for batch in iterator:
            for file, part, info, entries in zip(*[batch.column(c).to_pylist() for c in ("file", "part", "info", "entries")]):
                if file != name:
                    if out is not None:
                        close()
                    if not file or file.startswith("/") or ".." in file.split("/"):
                        raise ValueError(f"{file!r} is no place below the target")
                    name, last, files, begun = file, None, files + 1, False
                    out = system.open_output_stream(f"{own}/file")
                    out.write(info[:-1].encode() + (b"" if info == "{}" else b", ") + b'"entries": [')
                elif part == last:
                    raise ValueError(f"two threads go to {file}")
                inner = entries.strip()[1:-1].encode()
                out.write((b", " if inner and begun else b"") + inner)
                begun, last = begun or bool(inner), part
        if out is not None:
            close()
        system.delete_dir(own)
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow.fs import FileType

        system, stage = file_system(self.stage)
        _, target = file_system(self.path)
        system.create_dir(f"{stage}/tree", recursive=True)
        if system.get_file_info(target).type != FileType.NotFound:
            system.move(target, f"{stage}/replaced")
        system.move(f"{stage}/tree", target)
        system.delete_dir(stage)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow.fs import FileType

        system, stage = file_system(self.stage)
        if system.get_file_info(stage).type != FileType.NotFound:
            system.delete_dir(stage)


class ThreadFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> ThreadFileWriter:
        return ThreadFileWriter(self.options["path"], overwrite)


def write_thread_files(nested: DataFrame, file: Column, scrape_info: Column, path: str, overwrite: bool = False) -> None:
    """Threads, or their parts as ``nest_entries`` gives them, as one JSON file each at ``path``/``file``.

    An existing target is an error unless ``overwrite``. Two threads for one file are an error, too.
    """
    nested.sparkSession.dataSource.register(ThreadFiles)
    part = F.col("part") if "part" in nested.columns else F.lit(0)
    rows = nested.select(
        file.alias("file"), part.cast("long").alias("part"), F.to_json(F.struct(scrape_info.alias("scrape_info"))).alias("info"),
        F.to_json("entries").alias("entries"))
    ordered = rows.repartition("file").sortWithinPartitions("file", "part")
    ordered.write.format(SOURCE).mode("overwrite" if overwrite else "append").save(path)
