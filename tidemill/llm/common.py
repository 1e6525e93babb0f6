"""What the operators share: tables in the shared folder, batches of texts, folds, samples, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that are worked on at a time: bounds what a worker holds besides the batch.
SLICE = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; one of our own only where it is unset and all run on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = jvm_dir.get() if jvm_dir.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="tidemill-checkpoint-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tidemill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that nothing will read again, as what was made of them is stored itself."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as run at once, if its scan has fewer: a small file of one row group would be one task's work.

    A table with partitions enough is left as it lies, so nothing large is shuffled.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string")) % n


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow schema of a DDL string. Asks the session, so it is for the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def map_slices(df: DataFrame, work: Callable[[dict[str, list]], dict[str, list]], schema: str, setup: Callable | None = None) -> DataFrame:
    """mapInArrow over slices of at most SLICE rows: work gets columns as lists (with setup's result first, if there is one)."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (setup(),) if setup else ()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                got = work(*held, batch.slice(at, SLICE).to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


#: Values of `by` that a sample has at most, the most frequent ones: bounds what the driver gathers and what a model learns to tell apart.
MOST_CLASSES = 64


def bounded_sample(df: DataFrame, by: str, keys: list[str], per_class: int, total: int | None = None, classes: int = MOST_CLASSES) -> DataFrame:
    """At most about per_class different rows of each of the `classes` most frequent values of `by` (and `total` of all), the same on every run.

    Rows are chosen by a hash of `keys`; those that repeat by and keys count once, so that neither one repeated id nor one repeated
    row can fill or empty the sample. One pass counts a class's different keys, about; a class of n then keeps hashes below
    per_class / n. Ties between classes: the lesser value. Nulls of `by` take no part.
    """
    key = F.xxhash64(*keys, F.lit(17))
    sizes = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.approx_count_distinct(key, 0.02).alias("n"))
    counts = {r[0]: r[1] for r in sizes.orderBy(F.desc("n"), by).limit(classes).collect()}
    if not counts:
        return df.limit(0)
    if total:
        per_class = min(per_class, max(1, total // len(counts)))
    spread = 1 << 40
    below = F.create_map(*(F.lit(x) for value, n in sorted(counts.items()) for x in (value, int(min(1.0, per_class / max(n, 1)) * spread))))
    return df.where(F.pmod(key, F.lit(spread)) < F.coalesce(F.try_element_at(below, F.col(by)), F.lit(0))).dropDuplicates([by, *keys])


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of edges (a, b) by alternating large-star and small-star: rows (id, root), root the least id.

    Every round moves only edges, is written to the shared folder, and gathers nothing at one vertex but a minimum.
    """
    e = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    for _ in range(rounds):
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        nxt = stored(small, "edges")
        tally = [F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")]
        same = e.agg(*tally).first() == nxt.agg(*tally).first()
        discard(e)
        e = nxt
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
