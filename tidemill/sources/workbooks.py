"""Spreadsheets as a Spark data source: `spark.read.format("workbook")` and `df.write.format("workbook")`.

A read has one partition for each file, or for each few of many. A write makes one file a task under a name of its own attempt;
the commit makes the files of the attempts that Spark counts visible by renaming them, and the others are removed, so that a
retried task leaves nothing twice. Folders are those that all executors see.
"""

from __future__ import annotations

import os
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .xlsx import first_sheet, template_bytes

#: Partitions of a read at most; of more files, some share one.
MOST_PARTITIONS = 10_000


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    path: str | None
    rows: int


class WorkbookReader(DataSourceReader):
    """path, row (from 1), cells and error, as xlsx.read_xlsx gives them."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        paths = [self.folder] if os.path.isfile(self.folder) else sorted(os.path.join(d, f) for d, _, names in os.walk(self.folder) for f in names if f.lower().endswith(".xlsx") and not f.startswith((".", "_")))
        n = max(1, min(MOST_PARTITIONS, len(paths)))
        return [Files(paths[i::n]) for i in range(n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                with open(path, "rb") as f:
                    rows = first_sheet(f.read())
            except (OSError, zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError) as e:
                yield path, None, None, str(e)
                continue
            yield from ((path, i, cells, None) for i, cells in enumerate(rows, 1))


class WorkbookWriter(DataSourceWriter):
    """One workbook a task, with a row of column names above. Nothing is visible before the commit."""

    def __init__(self, folder: str, names: list[str], overwrite: bool) -> None:
        self.folder, self.names, self.overwrite = folder, names, overwrite

    def write(self, rows: Iterator) -> WriterCommitMessage:
        got = [["" if v is None else str(v) for v in r] for r in rows]
        if not got:
            return Written(None, 0)
        os.makedirs(self.folder, exist_ok=True)
        path = os.path.join(self.folder, f"_attempt-{uuid.uuid4().hex}.tmp")
        with open(path, "wb") as f:
            f.write(template_bytes([self.names, *got]))
        return Written(path, len(got))

    def _left(self) -> list[str]:
        return [os.path.join(self.folder, f) for f in os.listdir(self.folder) if f.startswith("_attempt-")] if os.path.isdir(self.folder) else []

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        os.makedirs(self.folder, exist_ok=True)
        before = [os.path.join(self.folder, f) for f in os.listdir(self.folder) if f.lower().endswith(".xlsx")] if self.overwrite else []
        run = uuid.uuid4().hex
        for i, m in enumerate(m for m in messages if m is not None and m.path):
            os.replace(m.path, os.path.join(self.folder, f"part-{i:05d}-{run}.xlsx"))
        for path in before + self._left():
            os.remove(path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for path in self._left():
            os.remove(path)


class WorkbookSource(DataSource):
    """Options: path, a file or a folder for reads and a folder for writes. Writes append, or overwrite what workbooks are there."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "path string, row long, cells array<string>, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return WorkbookReader(self.options["path"].removeprefix("file:"))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WorkbookWriter(self.options["path"].removeprefix("file:"), schema.names, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)
