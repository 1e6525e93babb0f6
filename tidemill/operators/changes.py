"""Changes of collections, as new rows: inserts, patches, upserts, deletes, and list upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Literal defaults for columns that are missing or null."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def bulk_insert(stored: DataFrame, new: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """(rows after the insert, refused keys with a reason): a batch with any refused key is refused whole."""
    k = new.withColumn("_k", key)
    twice = k.groupBy("_k").agg(F.count("*").alias("n")).where("n > 1").select("_k", F.lit("duplicate").alias("reason"))
    there = k.select("_k").distinct().join(stored.withColumn("_k", key).select("_k"), "_k", "left_semi").select("_k", F.lit("existing").alias("reason"))
    refused = twice.unionByName(there)
    fine = refused.agg((F.count("*") == 0).alias("_fine"))
    return stored.unionByName(new.crossJoin(fine).where("_fine").drop("_fine"), allowMissingColumns=True), refused.withColumnRenamed("_k", "key")


def patched(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Columns of the patch over those of the base where the patch has a value. Of patch rows that repeat a key, each column takes the greatest value."""
    cols = [c for c in patch.columns if c != key]
    p = patch.groupBy(key).agg(*(F.max(c).alias(f"_p_{c}") for c in cols))
    return base.join(p, key, "left").select(*(F.coalesce(f"_p_{c}", c).alias(c) if c in cols else F.col(c) for c in base.columns))


def upserted(base: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows replace those of the same key; others stay."""
    return base.join(rows.select(*key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def deleted(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key), key, "left_anti")


def cascade_delete(tables: dict[str, DataFrame], keys: DataFrame, key: str, own: tuple[str, str]) -> dict[str, DataFrame]:
    """The parent table (name, key column) and its children without the given keys."""
    name, own_key = own
    return {t: deleted(df, keys.select(F.col(key).alias(own_key if t == name else key)), own_key if t == name else key) for t, df in tables.items()}


def toggled(df: DataFrame, flag: str, where: Column) -> DataFrame:
    return df.withColumn(flag, F.when(where, ~F.col(flag)).otherwise(F.col(flag)))


def merged_by_confidence(base: DataFrame, other: DataFrame, key: list[str], confidence: str) -> DataFrame:
    """Rows of both sides by key; where both have one, the other side's only if its confidence is higher."""
    o = other.select(*key, *(F.col(c).alias(f"_o_{c}") for c in base.columns if c not in key))
    both = base.withColumn("_b", F.lit(True)).join(o, key, "full")
    take = F.col("_b").isNull() | F.coalesce(F.col(confidence) < F.col(f"_o_{confidence}"), F.lit(False))
    return both.select(*key, *(F.when(take, F.col(f"_o_{c}")).otherwise(F.col(c)).alias(c) for c in base.columns if c not in key))


def appended(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, by column name; columns that a part lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def list_upsert(items: Column, new: Column, field: str) -> Column:
    """An array of structs with `new` in place of the element of the same field, or at the end."""
    there = F.exists(items, lambda x: x[field] == new[field])
    return F.when(there, F.transform(items, lambda x: F.when(x[field] == new[field], new).otherwise(x))).otherwise(F.concat(items, F.array(new)))


def checks(rules: list[tuple[Column, str]]) -> Column:
    """Messages of all failed checks, in order; a check is (whether it fails, message)."""
    return F.array_compact(F.array(*(F.when(F.coalesce(fails, F.lit(True)), F.lit(m)) for fails, m in rules)))
