"""Stored collections: Parquet by tenant, JSON and XML as text, and binary documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import collection


def read_collection(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A collection with its fixed schema; a tenant filter prunes partitions."""
    return spark.read.schema(collection(name)).parquet(path)


def write_collection(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).partitionBy("companyId").parquet(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str, whole_file: bool = True) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=whole_file)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_xml(df: DataFrame, path: str, key: str, xml: Column) -> None:
    """One XML document a row, below a folder for each key."""
    df.select(F.col(key), xml.alias("value")).write.partitionBy(key).option("lineSep", "\u0000").text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content and is_pdf (by its first bytes and its name)."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", "length", "modificationTime", "content", ((F.substring("content", 1, 4) == F.lit(b"%PDF")) & F.endswith(F.lower("path"), F.lit(".pdf"))).alias("is_pdf"))


def landed(files: DataFrame, tenant: str, most_mb: int = 25) -> DataFrame:
    """Metadata rows of uploaded files, pending; files over the cap are refused with a reason."""
    over = F.col("length") > most_mb * 1024 * 1024
    return files.select(F.lit(tenant).alias("companyId"), F.element_at(F.split("path", "/"), -1).alias("fileName"), F.col("path").alias("storagePath"), F.when(over, "FAILED").otherwise("PENDING").alias("extractionStatus"), F.when(over, F.array(F.lit("too large"))).otherwise(F.array().cast("array<string>")).alias("parseErrors"))


def with_fallback(df: DataFrame, primary: Column, error: Column, fallback: Column) -> DataFrame:
    """The primary result, or the fallback and the recorded error where it failed."""
    return df.withColumn("result", F.coalesce(primary, fallback)).withColumn("extract_error", F.when(primary.isNull(), error))


def dispatch(df: DataFrame, type_col: str, extractors: dict[str, Column], empty: Column) -> DataFrame:
    """The extractor's expression for each document type; types without one get an empty struct and the type OTHER."""
    out = empty
    for t, e in extractors.items():
        out = F.when(F.col(type_col) == t, e).otherwise(out)
    known = F.col(type_col).isin(*extractors)
    return df.withColumn("data", out).withColumn("source_type", F.when(known, F.col(type_col)).otherwise("OTHER"))


def extraction_outcome(df: DataFrame, data: Column, error: Column) -> DataFrame:
    """Rows with extractedData, extractionStatus and parseErrors: one document's failure is a FAILED row with its message, and stops no other."""
    failed = error.isNotNull() | data.isNull()
    message = F.coalesce(error, F.lit("Çıkarma hatası"))
    kept = [c for c in df.columns if c not in ("extractedData", "extractionStatus", "parseErrors")]
    return df.select(*kept, F.when(~failed, data).alias("extractedData"), F.when(failed, "FAILED").otherwise("SUCCESS").alias("extractionStatus"), F.when(failed, F.array(message)).otherwise(F.array().cast("array<string>")).alias("parseErrors"))
