"""Uploads land in two phases, and extraction runs keep a ledger of attempts.

Bytes are written by tasks under names of their own attempt; the driver then writes the metadata of the attempts that count, which
alone makes an upload exist. A task that fails or is run again leaves bytes that no row names, and `sweep` removes them.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: Upload cap of documents in MB.
CAP_MB = 25
#: Bytes of contents after which a batch of them goes on, and paths of a batch.
READ_BYTES, PATHS = 32 << 20, 10_000

_META = "companyId string, declarationId string, type string, fileName string, filePath string, length long, extractionStatus string, parseErrors array<string>, batch string"


def safe_name(name: str | None) -> str:
    """The last part of a name, without path signs; `file` if nothing is left."""
    return re.split(r"[/\\]", name or "")[-1].strip(". \0") or "file"


def land(uploads: DataFrame, folder: str, most_mb: int = CAP_MB, before_write=None) -> DataFrame:
    """Land uploads (companyId, declarationId, type, fileName, content) below `folder`, which all executors see; the new metadata rows.

    Phase one writes each content to bytes/company/declaration/<attempt>-<name>; phase two appends the metadata to `folder`/meta as one
    batch. Contents over the cap, empty or null, and rows without company or declaration, are not written and give a FAILED row with the
    reason. Null names become `file`; equal names stay apart. before_write(row number) is a hook for tests of failures.
    """
    spark, batch = uploads.sparkSession, uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for rows in batches:
            out: list[list] = [[] for _ in range(9)]
            for company, declaration, kind, name, content in zip(*(rows[c].to_pylist() for c in ("companyId", "declarationId", "type", "fileName", "content")), strict=True):
                n += 1
                if before_write:
                    before_write(n)
                name, path = safe_name(name), None
                reason = "company and declaration are needed" if not company or not declaration else "empty file" if not content else "too large" if len(content) > most_mb << 20 else None
                if reason is None:
                    where = os.path.join(folder, "bytes", safe_name(company), safe_name(declaration))
                    os.makedirs(where, exist_ok=True)
                    path = os.path.join(where, f"{uuid.uuid4().hex}-{name}")
                    with open(path, "wb") as f:
                        f.write(content)
                for col, v in zip(out, (company, declaration, kind, name, path, len(content or b""), "FAILED" if reason else "PENDING", [reason] if reason else [], batch), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

    kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.list_(pa.string()), pa.string()]
    names = [x.split()[0] for x in _META.split(", ")]
    rows = uploads.select("companyId", "declarationId", "type", "fileName", "content").mapInArrow(write, _META)
    # the writer commits the files of the attempts that count, at once
    rows.write.mode("append").partitionBy("batch").parquet(f"{folder}/meta")
    return stored_uploads(spark, folder).where(F.col("batch") == batch)


def stored_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata of all uploads that exist."""
    return spark.read.schema(_META).parquet(f"{folder}/meta")


def contents(uploads: DataFrame) -> DataFrame:
    """uploads with content, the bytes that lie at their filePath; null without a path, or where nothing lies.

    The tasks that hold the rows open the files, so that no folder is listed, and a batch of bytes goes on at READ_BYTES.
    """

    def content(path: str | None) -> bytes | None:
        if path is None or not os.path.exists(path):
            return None
        with open(path, "rb") as f:
            return f.read()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            held, size = [], 0
            for i, path in enumerate(rows["filePath"].to_pylist(), 1):
                held.append(content(path))
                size += len(held[-1] or b"")
                if size >= READ_BYTES or i == rows.num_rows:
                    part = rows.slice(i - len(held), len(held))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], [*part.schema.names, "content"])
                    held, size = [], 0

    return uploads.mapInArrow(read, StructType([*uploads.schema.fields, StructField("content", BinaryType())]))


def stored_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """filePath of all files below `folder`/bytes/company/declaration. Tasks list one level after another, and none holds a whole level."""

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        for b in batches:
            for path in b["filePath"].to_pylist():
                if not os.path.isdir(path):
                    continue
                with os.scandir(path) as entries:
                    for e in entries:
                        names.append(e.path)
                        if len(names) == PATHS:
                            yield pa.RecordBatch.from_arrays([pa.array(names)], ["filePath"])
                            names = []
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["filePath"])

    level = spark.range(1, numPartitions=1).select(F.lit(os.path.join(folder, "bytes")).alias("filePath"))
    for _ in range(3):
        # the names of a level are dealt out over the tasks that list the next
        level = level.repartition(spark.sparkContext.defaultParallelism).mapInArrow(below, "filePath string")
    return level


def sweep(spark: SparkSession, folder: str) -> int:
    """Remove bytes that no metadata row names, as failed tasks leave them; how many there were. Not while uploads land."""
    # by company, declaration and name, which hold whatever way the folder is written
    own = F.substring_index("filePath", "/", -3).alias("own")
    lost = stored_bytes(spark, folder).select("filePath", own).join(stored_uploads(spark, folder).select(own), "own", "left_anti").select("filePath")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b["filePath"].to_pylist():
                if os.path.exists(path):  # a task that runs again finds its files gone
                    os.remove(path)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return lost.mapInArrow(remove, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


class Ledger:
    """Attempts at documents: doc_id, attempt (from 1), extractedData (JSON text), extractionStatus and parseErrors, a batch for each run."""

    SCHEMA = "doc_id string, attempt int, extractedData string, extractionStatus string, parseErrors array<string>, run int"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        os.makedirs(folder, exist_ok=True)

    def attempts(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.folder)

    def latest(self) -> DataFrame:
        """The last attempt at each document."""
        last = self.attempts().groupBy("doc_id").agg(F.max_by(F.struct("attempt", "extractedData", "extractionStatus", "parseErrors", "run"), "attempt").alias("a"))
        return last.select("doc_id", "a.*")

    def open(self, docs: DataFrame, most: int | None = None) -> DataFrame:
        """docs (doc_id and others) that no attempt succeeded for, with the number of attempts so far; those with `most` failures are given up."""
        tries = self.attempts().groupBy("doc_id").agg(F.max("attempt").alias("tries"), F.bool_or(F.col("extractionStatus") == "SUCCESS").alias("done"))
        rows = docs.join(tries, "doc_id", "left").where(~F.coalesce("done", F.lit(False))).withColumn("tries", F.coalesce("tries", F.lit(0))).drop("done")
        return rows if most is None else rows.where(F.col("tries") < most)

    def run(self, docs: DataFrame, extract: Callable[[DataFrame], tuple[Column, Column]], most: int | None = None) -> DataFrame:
        """Try all open documents once and append the outcomes in one commit; the rows of this run.

        extract(docs) gives two columns: the data as JSON text and an error. A document fails with its error, or without data, and stops no
        other. A document that is there twice counts once; null ids take no part. A run over nothing writes nothing.
        """
        number = (self.attempts().agg(F.max("run")).first()[0] or 0) + 1
        todo = self.open(docs.where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("string")).dropDuplicates(["doc_id"]), most)
        data, error = extract(todo)
        failed = error.isNotNull() | data.isNull()
        rows = todo.select("doc_id", (F.col("tries") + 1).alias("attempt"), F.when(~failed, data).alias("extractedData"), F.when(failed, "FAILED").otherwise("SUCCESS").alias("extractionStatus"), F.when(failed, F.array(F.coalesce(error, F.lit("Çıkarma hatası")))).otherwise(F.array().cast("array<string>")).alias("parseErrors"))
        rows.withColumn("run", F.lit(number)).write.mode("append").partitionBy("run").parquet(self.folder)
        return self.attempts().where(F.col("run") == number)
