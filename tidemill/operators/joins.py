"""Joins: outer with defaults, existence, lookups, and joins by nearness.

Joins by nearness never meet all rows of two sides: they go through an equality on group and bucket, so that they shuffle
and split like any other join. No side is forced to be broadcast; adaptive execution does so where one is measured small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_merge(df: DataFrame) -> DataFrame:
    """df as a side of a join that sorts both sides. For exploded rows: Spark takes their size from the file that they come from, and would broadcast them whole."""
    return df.hint("merge")


def left_with_default(left: DataFrame, right: DataFrame, on: str, defaults: dict[str, object]) -> DataFrame:
    """All left rows with the right side's columns, or defaults where there is no match."""
    return left.join(right.select(on, *defaults), on, "left").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def child_counts(parents: DataFrame, key: str, children: DataFrame, child_key: str, name: str = "n") -> DataFrame:
    """Parents with the number of their children, 0 without; children are counted before they are joined."""
    return left_with_default(parents, children.groupBy(F.col(child_key).alias(key)).agg(F.count("*").alias(name)), key, {name: 0})


def missing_from(df: DataFrame, stored: DataFrame, key: Column, stored_key: Column) -> DataFrame:
    """Rows whose key is not among the stored keys."""
    return df.withColumn("_k", key).join(stored.select(stored_key.alias("_k")).distinct(), "_k", "left_anti").drop("_k")


def existing_in(df: DataFrame, other: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(other, on, "left_semi")


def labelled(c: Column, labels: dict[str, str], default: Column | None = None) -> Column:
    """A code's label from a literal map; the code itself, or a default, where the map has none."""
    table = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    return F.coalesce(F.element_at(table, c), default if default is not None else c)


def near_pairs(a: DataFrame, b: DataFrame, group: list[str], at: str, reach: float, ids: tuple[str, str]) -> DataFrame:
    """Pairs of a's and b's rows (columns of b prefixed b_) of a group whose `at` differs by `reach` at most.

    b's rows are dealt to the bucket of their own place and its two neighbours, so that every pair meets in one bucket.
    """
    bucket = F.floor(F.col(at) / F.lit(reach)).cast("long")
    left = a.withColumn("_bucket", bucket)
    right = b.withColumn("_bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: bucket + d)))
    right = right.select("_bucket", *group, *(F.col(c).alias(f"b_{c}") for c in b.columns if c not in group))
    return left.join(right, [*group, "_bucket"]).where(F.abs(F.col(at) - F.col(f"b_{at}")) <= reach).drop("_bucket").where(F.col(ids[0]) != F.col(f"b_{ids[1]}"))


def next_matching(df: DataFrame, group: list[str], at: str, wanted: Column, name: str) -> DataFrame:
    """The least `at` greater than a row's own among the group's wanted rows: one window, no self-join."""
    w = Window.partitionBy(*group).orderBy(F.col(at)).rangeBetween(1, Window.unboundedFollowing)
    return df.withColumn(name, F.min(F.when(wanted, F.col(at))).over(w))


def nearest_other(df: DataFrame, group: list[str], at: str, ident: str) -> DataFrame:
    """The other row of the group that is nearest in `at` (ties: earlier, then the smaller id): neighbours in order suffice."""
    w = Window.partitionBy(*group).orderBy(at, ident)
    # of rows at the same place the order is by id, so the earlier neighbour of a tie needs the first id of its place
    before = F.lag(F.struct(at, ident)).over(w)
    after = F.lead(F.struct(at, ident)).over(w)
    same = Window.partitionBy(*group, at).orderBy(ident)
    first_here = F.first(ident).over(same)
    cand = lambda s: F.when(s.isNotNull(), F.struct(F.abs(s[at] - F.col(at)).alias("gap"), s[at].alias("place"), s[ident].alias("other")))
    out = df.withColumn("_first", first_here).withColumn("_b", before).withColumn("_a", after)
    # the greatest place before this one, and of that the first id
    w_place = Window.partitionBy(*group).orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("_p", F.max(F.struct(F.col(at), F.col("_first"))).over(w_place)).withColumn("_pid", F.col("_p._first")).withColumn("_p", F.col("_p")[at])
    here = F.when(F.col("_first") != F.col(ident), F.struct(F.lit(0).cast("long").alias("gap"), F.col(at).alias("place"), F.col("_first").alias("other"))).when(F.col("_a")[at] == F.col(at), cand(F.col("_a")))
    earlier = F.when(F.col("_p").isNotNull(), F.struct((F.col(at) - F.col("_p")).alias("gap"), F.col("_p").alias("place"), F.col("_pid").alias("other")))
    out = out.withColumn("_best", F.coalesce(here, F.least(earlier, cand(F.col("_a")))))
    return out.withColumn("nearest_id", F.col("_best.other")).withColumn("nearest_gap", F.col("_best.gap")).drop("_first", "_b", "_a", "_p", "_pid", "_best")


def nearest_in_column(probes: DataFrame, words: DataFrame, group: list[str], ident: list[str], reach: float, cell: float = 200.0) -> DataFrame:
    """ident of each probe with the nearest word of its group and value, if there is one: x0, y0, pos, and its distances dy and dx.

    Probes have value, y, x_min and x_max (both null: anywhere), words value, x0, y0 and pos. A word counts within `reach` of y, and from
    x_min to x_max. The nearest has the least |y0 - y|, then the least |x0 - x_min| (x0 where there is no column), then the
    least pos. Both sides meet on group, value and a cell of a grid over the page; a probe asks the cells that its column and reach
    cover, and an argmin of each task's words goes on. Probes that repeat in ident count once.
    """
    band = lambda c: F.floor(c / F.lit(reach)).cast("long")
    column = lambda c: F.floor(c / F.lit(cell)).cast("long")
    bands = F.sequence(band(F.col("y") - reach), band(F.col("y") + reach))
    asked = probes.select(*ident, *(c for c in [*group, "value", "y", "x_min", "x_max"] if c not in ident)).withColumn("_band", F.explode(bands))
    placed = words.select(*group, "value", "x0", "y0", "pos", band(F.col("y0")).alias("_band"), column(F.col("x0")).alias("_column"))
    narrow = asked.where("x_min is not null").withColumn("_column", F.explode(F.sequence(column(F.col("x_min")), column(F.greatest("x_min", "x_max")))))
    wide = asked.where("x_min is null")
    met = narrow.join(placed, [*group, "value", "_band", "_column"]).where("x0 between x_min and x_max").drop("_column")
    met = met.unionByName(wide.join(placed.drop("_column"), [*group, "value", "_band"]))
    dy, dx = F.abs(F.col("y0") - F.col("y")), F.coalesce(F.abs(F.col("x0") - F.col("x_min")), F.col("x0"))
    best = met.where(dy <= reach).groupBy(*ident).agg(F.min(F.struct(dy.alias("dy"), dx.alias("dx"), "pos", "x0", "y0")).alias("best"))
    return best.select(*ident, "best.*")
