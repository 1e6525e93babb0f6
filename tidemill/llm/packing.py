"""Packing by concatenate and cut: two-pass prefix sums over partition token totals, then fixed windows.

Pass one encodes each document once and stores its ids with the partition and the tokens before it in that partition.
The partitions' totals give every partition its global offset. Pass two cuts what was stored at multiples of the window;
a document that crosses a boundary leaves one record for each window it touches. Nothing is sorted or shuffled but one
total per partition.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SLICE, stored, table

WINDOW = 2048
#: Partition totals up to which their offsets are broadcast (16 bytes each); beyond it they are joined by a shuffle.
BROADCAST_PARTITIONS = 500_000

END_MARK = "<|endoftext|>"
# Without two white-space characters in a row, the tokenizer's pattern needs no look-ahead, and an automaton can run it.
_GAP = re.compile(r"\s\s")
_SHORT = public_tokenizers.PATTERN.replace(r"\s+(?!\S)|", "")


class Encoder:
    """Text to ids as little-endian 16-bit bytes, as the tokenizers library gives them, through the faster rank coder."""

    def __init__(self) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.any, self.plain = (tiktoken.Encoding("ranks", pat_str=p, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary for p in (public_tokenizers.PATTERN, _SHORT))

    def encode(self, text: str) -> bytes:
        if END_MARK in text:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            ids = (self.any if _GAP.search(text) else self.plain)(text)
        return np.array(ids, "<u2").tobytes()


def encoded(docs: DataFrame, end_id: int = 1) -> DataFrame:
    """part, before, doc_id, n, ids: each document's ids (16-bit, with end_id at the end), tokens before it in its partition. Stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before, end = Encoder(), TaskContext.get().partitionId(), 0, np.array([end_id], "<u2").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                ids = [encoder.encode(t or "") + end for t in rows["text"].to_pylist()]
                n = np.array([len(x) // 2 for x in ids], np.int64)
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(starts), rows["doc_id"].cast(pa.int64()), pa.array(n), pa.array(ids, pa.binary())], ["part", "before", "doc_id", "n", "ids"])

    return stored(docs.select("doc_id", "text").mapInArrow(run, "part int, before long, doc_id long, n long, ids binary"), "encoded")


def offsets(ids: DataFrame) -> DataFrame:
    """part, base: tokens in all partitions before each; one row per partition, summed in one task as partitions are few."""
    totals = ids.groupBy("part").agg(F.sum("n").alias("total"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(w), F.lit(0)).alias("base"))


def pack(docs: DataFrame, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids) of sequences of `window` tokens.

    All sequences are full but the last. A null or empty text is its end id alone; ids may be null or repeat, each row is
    packed; an empty table gives no piece. Texts are encoded whole.
    """
    ids = encoded(docs)
    spark = ids.sparkSession
    # one row per partition; written so that its size is known before it is broadcast
    base = stored(offsets(ids), "offsets")
    if base.count() <= BROADCAST_PARTITIONS:
        base = F.broadcast(base)
    placed = ids.join(base, "part").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "ids")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                rows = batch.slice(lo, SLICE)
                out: list[list] = [[] for _ in range(7 + with_ids)]
                for doc, at, raw in zip(rows["doc_id"].to_pylist(), rows["at"].to_pylist(), rows["ids"].to_pylist(), strict=True):
                    wide = memoryview(np.frombuffer(raw, "<u2").astype("<u4").tobytes())
                    n, start = len(raw) // 2, 0
                    while start < n:
                        seq, off = divmod(at + start, window)
                        length = min(window - off, n - start)
                        piece = wide[4 * start : 4 * (start + length)]
                        for col, v in zip(out, (doc, start, length, zlib.crc32(piece), n, seq, off, *((bytes(piece),) * with_ids)), strict=True):
                            col.append(v)
                        start += length
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out[:7]] + [pa.array(c, pa.binary()) for c in out[7:]], names)

    names = [x.split()[0] for x in schema.split(", ")]
    return placed.mapInArrow(run, schema)


def op8_packing(spark, sf_dir):
    """Pack every row of documents; odd rows as in pack."""
    return pack(table(spark, sf_dir, "documents"))
