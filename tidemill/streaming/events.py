"""Streams of events: the stateless helpers work as they are; summaries need a watermark and a window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Rows of each kind in each window; rows later than the watermark are left out, and state is bounded by it."""
    w = F.window(F.col(at).cast("timestamp"), width)
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(w.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def first_seen(events: DataFrame, key: list[str], at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Keep-first over a stream: repeats of a key within the watermark are dropped."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(key)
