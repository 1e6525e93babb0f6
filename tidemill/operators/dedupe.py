"""Keep-first with reasons, and uniqueness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_first(df: DataFrame, key: Column, order: list[Column], stored: DataFrame | None = None, stored_key: Column | None = None, tie: list[Column] | None = None) -> DataFrame:
    """Rows with `outcome`: existing (its key is stored), duplicate (an earlier row has it), or sent. The stored check comes first.

    A row whose key is null equals no other, so it is sent. The earliest row of a key is found by an aggregation, not by a window
    over all rows of the key. Where `order` is no total order, `tie` says which of equal rows is the first; rows that are alike in key,
    order and tie are all first.
    """
    rows = df.withColumn("_k", key).withColumn("_at", F.struct(*order, *(tie or [])))
    if stored is not None:
        rows = rows.join(stored.select(stored_key.alias("_k")).distinct().withColumn("_stored", F.lit(True)), "_k", "left")
    else:
        rows = rows.withColumn("_stored", F.lit(None).cast("boolean"))
    rows = rows.join(rows.where("_k is not null").groupBy("_k").agg(F.min("_at").alias("_first")), "_k", "left")
    late = F.coalesce(F.col("_at") > F.col("_first"), F.lit(False))
    return rows.withColumn("outcome", F.when(F.col("_stored"), "existing").when(late, "duplicate").otherwise("sent")).drop("_k", "_stored", "_at", "_first")


def outcome_counts(df: DataFrame) -> DataFrame:
    """sent, skipped, skipped_duplicates, skipped_existing of keep_first's rows."""
    n = lambda x: F.count_if(F.col("outcome") == x)
    return df.agg(n("sent").alias("sent"), F.count_if(F.col("outcome") != "sent").alias("skipped"), n("duplicate").alias("skipped_duplicates"), n("existing").alias("skipped_existing"))


def violations(df: DataFrame, key: list[Column]) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def reference_numbers(new: DataFrame, stored: DataFrame, group: list[str], order: list[Column], step: Column) -> DataFrame:
    """New rows with `number`: how many stored rows their group has, plus their place among the new ones.

    Groups are few and large, so rows are numbered within steps, and moved on by what the steps before hold of their group: one count
    for each group and step is all that a single task sees. `step` is a coarse value that never falls along the order, such as a day.
    """
    counts = stored.groupBy(*group).agg(F.count("*").alias("_had"))
    rows = new.withColumn("_step", step)
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1))
    steps = rows.groupBy(*group, "_step").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*group, "_step").orderBy(*order)))
    numbered = rows.join(steps, [*group, "_step"]).join(counts, group, "left")
    return numbered.withColumn("number", F.coalesce("_had", F.lit(0)) + F.col("_before") + F.col("_place")).drop("_had", "_place", "_before", "_step")
