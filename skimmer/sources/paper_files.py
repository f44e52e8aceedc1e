"""A data source of one text file for each paper: ``df.write.format("paper_files")`` and ``spark.read.format("paper_files")``.

A task writes its papers into a folder of its own below ``_open``; the job's commit renames these folders, one rename for each task, and an abort removes them.
So of a failed task, or a failed job, no file is ever read; a task that is being killed while the job is aborted may leave some below ``_open``. The path may be of any file system that pyarrow knows and that renames folders.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

OPEN = "_open"


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(uri)
    return system, path.rstrip("/")


class PaperFiles(DataSource):
    """(paper, text). Options: ``path``, and ``extension`` (txt). The id of a paper is its file's name, percent-encoded; rows without text or id are left out, papers of
    equal ids in one task are one file, the last of them."""

    @classmethod
    def name(cls) -> str:
        return "paper_files"

    def schema(self) -> str:
        return "paper string, text string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("extension", "txt"))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("extension", "txt"), overwrite, schema.fieldNames())


@dataclass
class _Folder(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    folder: str


class _Reader(DataSourceReader):
    def __init__(self, uri: str, extension: str):
        self.uri, self.extension = uri, extension

    def partitions(self) -> list[_Folder]:
        system, path = _place(self.uri)
        return [_Folder(f.path) for f in system.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.Directory and not f.base_name.startswith("_")]

    def read(self, partition: _Folder) -> Iterator[tuple[str, str]]:
        system, _ = _place(self.uri)
        for f in system.get_file_info(fs.FileSelector(partition.path)):
            if f.base_name.endswith(f".{self.extension}"):
                with system.open_input_stream(f.path) as file:
                    yield unquote(f.base_name.removesuffix(f".{self.extension}")), file.read().decode()


class _Writer(DataSourceWriter):
    def __init__(self, uri: str, extension: str, overwrite: bool, columns: list[str]):
        if missing := {"paper", "text"} - set(columns):
            raise ValueError(f"paper files need the columns {sorted(missing)}")
        self.uri, self.extension, self.overwrite, self.job = uri, extension, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> _Written:
        system, path = _place(self.uri)
        folder = f"{OPEN}/{self.job}/part-{uuid.uuid4().hex}"
        system.create_dir(f"{path}/{folder}", recursive=True)
        for row in iterator:
            if row["paper"] is not None and row["text"] is not None:
                with system.open_output_stream(f"{path}/{folder}/{quote(row['paper'], safe='')}.{self.extension}") as file:
                    file.write(row["text"].encode())
        return _Written(folder)

    def commit(self, messages: list[_Written | None]) -> None:
        system, path = _place(self.uri)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if f.type == fs.FileType.Directory and not f.base_name.startswith("_"):
                    system.delete_dir(f.path)
        for message in messages:
            if message is not None:
                system.move(f"{path}/{message.folder}", f"{path}/{message.folder.rpartition('/')[2]}")
        self._clear(system, path)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*_place(self.uri))

    def _clear(self, system: fs.FileSystem, path: str) -> None:
        """Removes what tasks of this job, failed attempts among them, have left open."""
        if system.get_file_info(f"{path}/{OPEN}/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{path}/{OPEN}/{self.job}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PaperFiles)
