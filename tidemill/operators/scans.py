"""Scans of tenant collections. The tenant is a mandatory filter, and the natural partition column of a stored table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tenant_scan(df: DataFrame, tenant: object, tenant_col: str = "companyId", order: list[Column] | None = None) -> DataFrame:
    """Rows of one tenant, in the given order (default: newest update first)."""
    rows = df.where(F.col(tenant_col) == F.lit(tenant))
    return rows.orderBy(*(order if order is not None else [F.desc("updatedAt")]))


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as run at once, if its scan has fewer: for heavy work on the texts of a small file, whose one row group would be one task.

    A table with partitions enough is left as it lies.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def child_scan(df: DataFrame, key_col: str, key: object, order: list[Column]) -> DataFrame:
    return df.where(F.col(key_col) == F.lit(key)).orderBy(*order)


def point_lookup(df: DataFrame, **keys: object) -> DataFrame:
    """At most one row with all the given keys; none if there is no such row."""
    for c, v in keys.items():
        df = df.where(F.col(c) == F.lit(v))
    return df.limit(1)


def singleton_or_default(tenants: DataFrame, rows: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """One row for each tenant: its stored values, or literal defaults where it has no row or a null."""
    return tenants.select(key).join(rows.select(key, *defaults), key, "left").select(key, *(F.coalesce(c, F.lit(v)).alias(c) for c, v in defaults.items()))


def page_of(df: DataFrame, page: int, size: int, order: list[Column]) -> DataFrame:
    """One page of a total order, numbered from 1: a bounded offset and limit, which Spark runs as a top-n of each partition."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def total_pages(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(size))).cast("long").alias("total_pages"))


def first_per_group(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group by a total order."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str = "line_no") -> DataFrame:
    """Ordinal numbers from 1 within each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))


def neighbours(df: DataFrame, group: list[str], order: list[Column], value: str) -> DataFrame:
    """Adds before and after: the value of the row before and of the row after in the group's order."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("before", F.lag(value).over(w)).withColumn("after", F.lead(value).over(w))


def around(df: DataFrame, group: list[str], order: list[Column], measures: dict[str, Column], reach: int = 3) -> DataFrame:
    """Adds aggregates over the rows at most `reach` places away in the group's order."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(-reach, reach)
    return df.withColumns({n: c.over(w) for n, c in measures.items()})


def before_first(df: DataFrame, group: list[str], order: list[Column], stop: Column) -> DataFrame:
    """Rows of each group before the first that stops it."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_stopped", F.max(F.coalesce(stop, F.lit(False)).cast("int")).over(w)).where("_stopped = 0").drop("_stopped")
