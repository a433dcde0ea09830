"""Folders of small files as a data source: read with the filters that spare opening files, and written all or nothing.

``spark.read.format("smallfiles")`` gives one row a file: path, basename, suffix, bytes, content and text. Options: ``path``
(the folder), ``listing`` (a file of relative paths, one a line, used instead of a listing if it can be read and names
anything), ``suffixes`` (separated by commas, of any case), ``files`` (files a task reads). Filters on path, basename,
suffix or bytes are applied to the names and sizes before any file is opened, columns that only names give cost no
opening either. Text that is no UTF-8 is read as Latin-1.

``df.write.format("smallfiles")`` writes rows (name, content) as one file each. A task writes into a folder of its own
attempt under ``_staging``; the driver moves the files of the attempts that Spark accepts when the job commits, and removes
the rest. So a failed or repeated attempt, or a failed job, leaves no file in the folder, and a reader never sees half of
one; what a task that is killed may leave lies under ``_staging``, which no reader lists. Mode ``overwrite`` replaces files of the same name, and leaves others.

Folders are URIs or local paths that the driver and all executors share. The driver holds the names and sizes of a folder,
not their contents. With Spark's file pushdown for Python sources off (its default) filters still hold, but open all files:
``registered`` turns it on.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "path string, basename string, suffix string, bytes long, content binary, text string"
#: Files that one task reads.
FILES = 256


class File(NamedTuple):
    path: str
    size: int

    def value(self, column: str) -> str | int:
        base = self.path.rpartition("/")[2]
        return {"path": self.path, "basename": base, "suffix": base.rpartition(".")[2].lower() if "." in base else "", "bytes": self.size}[column]


TESTS = {
    EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, StringEndsWith: lambda a, b: a.endswith(b), StringStartsWith: lambda a, b: a.startswith(b),
    GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b,
}


def located(folder: str) -> tuple[pafs.FileSystem, str]:
    fs, base = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
    return fs, base.rstrip("/")


class Some(InputPartition):
    def __init__(self, files: list[File]) -> None:
        self.files = files


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.folder, self.columns = options["path"], schema.names
        self.listing, self.size = options.get("listing"), int(options.get("files", FILES))
        self.suffixes = [s.strip().lower().lstrip(".") for s in options.get("suffixes", "").split(",") if s.strip()]
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Filters on what the name and size tell are kept, the others go back to Spark."""
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in ("path", "basename", "suffix", "bytes"):
                self.filters.append(f)
            else:
                yield f

    def files(self) -> list[File]:
        fs, base = located(self.folder)
        names: list[str] = []
        if self.listing:
            own, at = located(self.listing)
            try:
                with own.open_input_stream(at) as stream:
                    names = [f"{base}/{x.strip()}" for x in stream.read().decode("utf-8", "replace").splitlines() if x.strip()]
            except FileNotFoundError:
                names = []
        infos = fs.get_file_info(names) if names else fs.get_file_info(pafs.FileSelector(base, recursive=False, allow_not_found=True))
        found = [File(i.path, i.size) for i in infos if i.type == pafs.FileType.File]
        if self.suffixes:
            found = [f for f in found if f.value("suffix") in self.suffixes]
        for t in self.filters:
            found = [f for f in found if TESTS[type(t)](f.value(t.attribute[0]), t.value)]
        return sorted(found)

    def partitions(self) -> list[Some]:
        found = self.files()
        return [Some(found[i : i + self.size]) for i in range(0, len(found), self.size)] or [Some([])]

    def read(self, partition: Some) -> Iterator[pa.RecordBatch]:
        fs, _ = located(self.folder)
        opened = {"content", "text"} & set(self.columns)
        for f in partition.files:
            row = {c: f.value(c) for c in ("path", "basename", "suffix", "bytes")}
            if opened:
                with fs.open_input_stream(f.path, compression=None) as stream:
                    row["content"] = stream.read()
                try:
                    row["text"] = row["content"].decode()
                except UnicodeDecodeError:
                    row["text"] = row["content"].decode("latin-1")
            kinds = {"bytes": pa.int64(), "content": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array([row[c]], kinds.get(c, pa.string())) for c in self.columns], names=self.columns)


class Staged(WriterCommitMessage):
    def __init__(self, folder: str, names: list[str]) -> None:
        self.folder, self.names = folder, names


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.folder, self.job = options["path"], uuid.uuid4().hex
        self.at = schema.names.index("name"), schema.names.index("content")

    def staging(self) -> tuple[pafs.FileSystem, str, str]:
        fs, base = located(self.folder)
        return fs, base, f"{base}/_staging/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        fs, _, staging = self.staging()
        own, names = f"{staging}/{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}", []
        fs.create_dir(own, recursive=True)
        try:
            for b in iterator:
                for name, content in zip(*(b.column(i).to_pylist() for i in self.at), strict=True):
                    if name is None or content is None:
                        continue
                    if "/" in name or name in ("", ".", ".."):
                        raise ValueError(f"not a file name: {name!r}")
                    with fs.open_output_stream(f"{own}/{name}", compression=None) as out:
                        out.write(bytes(content))
                    names.append(name)
        except BaseException:
            fs.delete_dir(own)
            raise
        return Staged(own, names)

    def commit(self, messages: list[Staged | None]) -> None:
        """Names that come twice are an error before anything is moved."""
        fs, base, _ = self.staging()
        moves = [(f"{m.folder}/{n}", n) for m in messages if m for n in m.names]
        if len({n for _, n in moves}) < len(moves):
            self.cleaned()
            raise ValueError("a file name comes twice")
        for staged, name in moves:
            fs.move(staged, f"{base}/{name}")
        self.cleaned()

    def abort(self, messages: list[Staged | None]) -> None:
        self.cleaned()

    def cleaned(self) -> None:
        """Remove what this job staged, and the staging folder if no other job uses it."""
        fs, base, staging = self.staging()
        if fs.get_file_info(staging).type == pafs.FileType.Directory:
            fs.delete_dir(staging)
        top = f"{base}/_staging"
        if fs.get_file_info(top).type == pafs.FileType.Directory and not fs.get_file_info(pafs.FileSelector(top)):
            fs.delete_dir(top)


class SmallFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "smallfiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, schema)


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(SmallFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark
