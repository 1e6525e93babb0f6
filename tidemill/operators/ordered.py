"""Order within groups of any size: medians, neighbours, next events and deep pages without one task that sees a whole group.

Groups of more than BLOCK rows are cut into blocks by quantiles of the order column. Blocks give summaries (counts, first wanted
places, border rows) that are few, and what a row needs from other blocks comes from those.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

#: Rows of a group up to which it stays one block.
BLOCK = 1_000_000
#: Blocks of a group at most, and the accuracy of the quantiles that part them.
MOST_BLOCKS, ACCURACY = 1000, 20_000
#: Groups of more than BLOCK rows up to which their cuts (8 bytes each) are broadcast, MOST_BLOCKS cuts a group at most.
BROADCAST_GROUPS = 2000


def in_blocks(df: DataFrame, group: list[str], at: str, rows: int | None = None) -> DataFrame:
    """df with _block: the number of a block of its group in the order of the numeric column `at`; 0 throughout in groups of `rows` rows or fewer.

    Rows that are equal in `at` share a block. Rows with a null in group or at are in block 0 of their group.
    """
    rows = rows or BLOCK
    hot = df.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > rows)
    n_hot = hot.count()
    if not n_hot:
        return df.withColumn("_block", F.lit(0))
    hot = F.broadcast(hot) if n_hot <= BROADCAST_GROUPS * MOST_BLOCKS else hot
    shares = [i / MOST_BLOCKS for i in range(1, MOST_BLOCKS)]
    cuts = df.join(hot, group).groupBy(*group).agg(F.first("_n").alias("_n"), F.percentile_approx(at, shares, ACCURACY).alias("_q"))
    # every so many of the quantiles, so that a block has about `rows` rows
    wanted = F.least(F.ceil(F.col("_n") / rows), F.lit(MOST_BLOCKS)).cast("int")
    cuts = cuts.select(*group, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(wanted - 1, F.lit(1))), lambda i: F.get("_q", F.least(F.floor(i * MOST_BLOCKS / wanted).cast("int"), F.lit(MOST_BLOCKS - 1)) - 1))).alias("_cuts"))
    cuts = F.broadcast(cuts) if n_hot <= BROADCAST_GROUPS else cuts
    return df.join(cuts, group, "left").withColumn("_block", places_upto(F.col("_cuts"), F.col(at))).drop("_cuts")


def places_upto(cuts: Column, value: Column) -> Column:
    """How many of ascending cuts, MOST_BLOCKS at most, are not above a value: by halves, ten looks for a thousand. 0 for null."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(MOST_BLOCKS.bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(cuts, n + step - 1) <= value, n + step).otherwise(n))


def next_wanted(df: DataFrame, group: list[str], at: str, wanted: Column, name: str, rows: int | None = None) -> DataFrame:
    """df with `name`: the least `at` above a row's own among the group's wanted rows, null without one or without a place.

    Inside a block a window finds it; what no row of the block has is carried back from the first wanted place of the blocks behind.
    Windows run from the end back, as Spark adds to a frame that grows, and makes one anew for every row that shrinks.
    """
    parts = in_blocks(df, group, at, rows).withColumn("_wanted", F.when(wanted, F.col(at)))
    firsts = parts.groupBy(*group, "_block").agg(F.min("_wanted").alias("_first"))
    behind = Window.partitionBy(*group).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = firsts.withColumn("_carried", F.min("_first").over(behind)).where("_carried is not null").drop("_first")
    here = Window.partitionBy(*group, "_block").orderBy(F.desc(at)).rangeBetween(Window.unboundedPreceding, -1)
    out = parts.withColumn(name, F.min("_wanted").over(here)).join(carried, [*group, "_block"], "left")
    return out.withColumn(name, F.when(F.col(at).isNotNull(), F.coalesce(name, "_carried"))).drop("_carried", "_wanted", "_block")


def around_at(df: DataFrame, group: list[str], at: str, tie: str, measures: dict[str, Column], reach: int = 3, rows: int | None = None) -> DataFrame:
    """df with aggregates over the rows at most `reach` places away in the group's order by at, then tie (together unique in a group).

    Each block also gets the nearest `reach` rows of the blocks beside it, a halo that is used and not given back. Blocks hold a
    row at least, so as many blocks to each side are enough.
    """
    parts = in_blocks(df, group, at, rows)
    up = Window.partitionBy(*group, "_block").orderBy(at, tie)
    down = Window.partitionBy(*group, "_block").orderBy(F.desc(at), F.desc(tie))
    ends = parts.withColumns({"_up": F.row_number().over(up), "_down": F.row_number().over(down)})
    steps = lambda sign: F.array(*(F.lit(sign * k) for k in range(1, reach + 1)))
    away = F.concat(F.when(F.col("_up") <= reach, steps(-1)).otherwise(F.array().cast("array<int>")), F.when(F.col("_down") <= reach, steps(1)).otherwise(F.array().cast("array<int>")))
    dealt = ends.withColumn("_step", F.explode(F.concat(F.array(F.lit(0)), away))).withColumn("_block", F.col("_block") + F.col("_step"))
    w = Window.partitionBy(*group, "_block").orderBy(at, tie).rowsBetween(-reach, reach)
    return dealt.withColumns({n: c.over(w) for n, c in measures.items()}).where("_step = 0").drop("_up", "_down", "_step", "_block")


#: Bins of a round, and values of an interval from which they are taken one by one.
BINS, FEW = 256, 10_000


def exact_median(df: DataFrame, group: list[str], value: str, few: int | None = None) -> DataFrame:
    """group and median (double) of the non-null values: the mean of the two middle ones. Groups without a value are left out; NaN counts as null.

    Both middle ranks are followed by histograms: each round keeps the bin that holds a rank, with the least and greatest value
    in it, until few values are left, which are then sorted. A round moves BINS sums a rank and task, whatever the group's size.
    """
    few = few or FEW
    v = F.col(value).cast("double")
    values = df.select(*group, v.alias("_v")).where("_v is not null and not isnan(_v)")
    # one struct as key, so that null keys are a group of their own, as in groupBy
    values = values.select(F.struct(*group).alias("_g"), "_v")
    sizes = values.groupBy("_g").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    ranks = F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1))
    targets = sizes.select("_g", F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("below"), "n", "lo", "hi")
    targets = kept(targets, "median")
    while targets.where((F.col("n") > few) & (F.col("lo") < F.col("hi"))).limit(1).count():
        wide = targets.where((F.col("n") > few) & (F.col("lo") < F.col("hi")))
        rest = targets.where(~((F.col("n") > few) & (F.col("lo") < F.col("hi"))))
        met = values.join(wide, values["_g"].eqNullSafe(wide["_g"])).where("_v between lo and hi").drop(values["_g"])
        bin_ = F.least(F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
        bins = met.groupBy("_g", "rank", "below", bin_.alias("bin")).agg(F.count("*").alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        before = F.sum("c").over(Window.partitionBy("_g", "rank").orderBy("bin")) - F.col("c") + F.col("below")
        hit = bins.withColumn("at", before).where((F.col("at") < F.col("rank")) & (F.col("rank") <= F.col("at") + F.col("c")))
        targets = kept(rest.unionByName(hit.select("_g", "rank", F.col("at").alias("below"), F.col("c").alias("n"), "lo", "hi")), "median")
    done = targets.where("lo = hi").select("_g", F.col("lo").alias("_v"))
    open_ = targets.where("lo < hi")
    met = values.join(open_, values["_g"].eqNullSafe(open_["_g"])).where("_v between lo and hi").drop(values["_g"])
    nth = F.get(F.array_sort(F.collect_list("_v")), (F.col("rank") - F.col("below") - 1).cast("int"))
    found = met.groupBy("_g", "rank", "below").agg(nth.alias("_v")).select("_g", "_v")
    out = done.unionByName(found).groupBy("_g").agg(F.avg("_v").alias("median"))
    return out.select(*(F.col("_g").getField(c).alias(c) for c in group), "median")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; on one machine, the warehouse if that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir", None)
    if not where:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{where.rstrip('/')}/tidemill"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet into the shared folder and read it back: rounds start from a table, not from a growing plan."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Pages:
    """Pages of a total order over a table that is written once in ranges of the order, with the rows of each range.

    A page reads the ranges that hold it and no other, however deep it lies; `offset` would sort and pass all rows before it.
    """

    def __init__(self, spark: SparkSession, path: str, order: list[str], schema: StructType | None = None) -> None:
        self.rows, self.order = (spark.read.schema(schema) if schema else spark.read).parquet(path), order
        counts = {r[0]: r[1] for r in self.rows.groupBy("_range").count().collect()}  # one row a range
        self.ranges, self.total = [], 0
        for part in sorted(counts):
            self.ranges.append((part, self.total))
            self.total += counts[part]

    @classmethod
    def write(cls, df: DataFrame, order: list[str], path: str, ranges: int) -> Pages:
        """Sort df into `ranges` ranges at `path`. `order` names the columns of a total order; nulls come first."""
        parts = df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
        parts.sortWithinPartitions("_range", *order).write.partitionBy("_range").parquet(path)
        return cls(df.sparkSession, path, order, StructType([*df.schema.fields, StructField("_range", IntegerType())]))

    def count(self, size: int) -> int:
        return max(1, math.ceil(self.total / size))

    def page(self, number: int, size: int) -> DataFrame:
        """Rows of a page, numbered from 1, in order; none behind the last."""
        first, last = (number - 1) * size, number * size
        ends = [at for _, at in self.ranges[1:]] + [self.total] * bool(self.ranges)
        held = [(p, at, end) for (p, at), end in zip(self.ranges, ends, strict=True) if at < last and end > first]
        rows = self.rows.where(F.col("_range").isin([p for p, _, _ in held]))
        skip = first - held[0][1] if held else 0
        return rows.orderBy(*self.order).offset(skip).limit(size).drop("_range")
