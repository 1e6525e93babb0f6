"""Summaries. Bundles of conditional counts are one aggregation over one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_bundle(df: DataFrame, counters: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """How many rows meet each condition, in one pass."""
    return df.groupBy(*(by or [])).agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counters.items()))


def status_counts(df: DataFrame, status: str, names: dict[str, str]) -> DataFrame:
    """All rows, and rows of each status."""
    return count_bundle(df, {"total": F.lit(True)} | {n: F.col(status) == s for n, s in names.items()})


def sums_as_text(df: DataFrame, parent: list[str], currency: str, amount: Column, order: Column, fmt) -> DataFrame:
    """Per parent "amount CUR / amount CUR", currencies by their first row. Currencies are summed first, so few are gathered."""
    per = df.groupBy(*parent, currency).agg(F.sum(amount).alias("total"), F.min(order).alias("first"))
    rows = F.array_sort(F.collect_list(F.struct("first", F.col(currency).alias("cur"), "total")))
    return per.groupBy(*parent).agg(F.array_join(F.transform(rows, lambda r: F.concat(fmt(r["total"]), F.lit(" "), r["cur"])), " / ").alias("totals"))


def distinct_over_arrays(df: DataFrame, items: str, active: Column) -> DataFrame:
    """total, active, passive and the number of distinct items of all arrays; only distinct items are shuffled."""
    heads = count_bundle(df, {"total": F.lit(True), "active": active, "passive": ~active})
    return heads.crossJoin(df.select(F.explode(items).alias("x")).distinct().agg(F.count("*").alias("distinct_items")))


def group_count(df: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias(name))


def count_where(df: DataFrame, where: Column, name: str = "n") -> DataFrame:
    """One row: how many rows meet a condition, which reaches the scan."""
    return df.where(where).agg(F.count("*").alias(name))


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    """Distinct values in order of their code units."""
    return df.select(column).distinct().orderBy(column)


def extremes(df: DataFrame, by: list[str], value: str, least: int = 4, where: Column | None = None) -> DataFrame:
    """low, high and high_if (the greatest value where the condition holds) of groups with enough rows."""
    v = F.col(value)
    g = df.groupBy(*by).agg(F.min(v).alias("low"), F.max(v).alias("high"), F.max(F.when(where if where is not None else F.lit(True), v)).alias("high_if"), F.count("*").alias("_n"))
    return g.where(F.col("_n") >= least).drop("_n")


def template_stats(df: DataFrame, active: Column, step: str) -> DataFrame:
    """total, active, passive and the number of distinct steps."""
    on = F.coalesce(active, F.lit(False))
    return df.agg(F.count("*").alias("total"), F.count_if(on).alias("active"), F.count_if(~on).alias("passive"), F.count_distinct(step).alias("steps"))


def bounding_box(points: Column) -> Column:
    """struct(x0, y0, x1, y1) of an array of points."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def median_if(df: DataFrame, by: list[str], value: str, least: int, name: str = "median") -> DataFrame:
    """The median of groups with enough rows."""
    return df.groupBy(*by).agg(F.median(value).alias(name), F.count(value).alias("n")).where(F.col("n") >= least)


def section_counts(df: DataFrame, section: str, value: Column, mapped: Column, conflict: Column) -> DataFrame:
    return count_bundle(df, {"filled": value.isNotNull() & (value != ""), "mapped": mapped, "conflicted": conflict}, [section])
