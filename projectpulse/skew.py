"""Building blocks that keep one hot key from becoming one hot task.

A window partitioned by project alone puts a project with a third of all rows into one
task. The helpers below order such data in two levels: inside ``(project, chunk)``, where
the chunk is a slice of time, and once more over one summary row per chunk.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession, Window
from pyspark.sql import functions as F


def time_chunk(ts: str, hours: int) -> Column:
    """Number of the time slice that a timestamp falls into."""
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / (3600 * hours))


def prefix_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, values: dict[str, Column]
) -> DataFrame:
    """Add running sums over all earlier rows of the same keys (the row itself excluded).

    Rows are ordered inside ``(keys, chunk)`` only; the chunks' totals, one row each, are
    ordered over the keys and joined back. The join finds the rows already partitioned by
    ``(keys, chunk)``, so the detail side is shuffled once.
    """
    named = df.withColumn("_chunk", chunk)
    for name, value in values.items():
        named = named.withColumn(f"_v_{name}", value)
    cells = [*keys, "_chunk"]
    totals = named.groupBy(*cells).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    over_chunks = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*cells, *[F.sum(f"_t_{n}").over(over_chunks).alias(f"_c_{n}") for n in values])
    inside = Window.partitionBy(*cells).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = named.select("*", *[F.sum(f"_v_{n}").over(inside).alias(f"_l_{n}") for n in values])
    joined = local.join(carried, cells, "left")
    result = joined.select(
        *df.columns,
        *[
            (F.coalesce(F.col(f"_c_{n}"), F.lit(0)) + F.coalesce(F.col(f"_l_{n}"), F.lit(0))).alias(n)
            for n in values
        ],
    )
    return result


def previous_values(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, values: Sequence[str]
) -> DataFrame:
    """Add ``prev_<value>``: the value of the row before, across chunk borders."""
    named = df.withColumn("_chunk", chunk)
    cells = [*keys, "_chunk"]
    packed = F.struct(*values)
    # the largest of one number is hashed, other last rows need a sort
    last = F.struct(*[F.max(v).alias(v) for v in values]) if list(values) == list(order) and len(order) == 1 else F.max_by(packed, F.struct(*order))
    tails = named.groupBy(*cells).agg(last.alias("_tail"))
    over_chunks = Window.partitionBy(*keys).orderBy("_chunk")
    carried = tails.select(*cells, F.lag("_tail").over(over_chunks).alias("_carried"))
    inside = Window.partitionBy(*cells).orderBy(*order)
    local = named.withColumn("_local", F.lag(packed).over(inside))
    joined = local.join(carried, cells, "left").withColumn("_prev", F.coalesce("_local", "_carried"))
    return joined.select(*df.columns, *[F.col(f"_prev.{v}").alias(f"prev_{v}") for v in values])


def shared_folder(spark: SparkSession) -> str:
    """The reliable checkpoint folder of the session; a temporary one in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="projectpulse-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


_scopes: list[list[str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a fresh table or stream checkpoint below the shared folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _scopes:
        made.append(path)
    return path


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the tables that operators have written inside; write or collect results before."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in made:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def write_table(df: DataFrame, name: str = "table") -> str:
    """Write a DataFrame as a new table in the shared folder; returns its path."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return path


def read_tables(df: DataFrame, paths: Sequence[str]) -> DataFrame:
    """One scan over tables of the same columns as ``df``."""
    return df.sparkSession.read.schema(df.schema).parquet(*paths)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a loop's state as a table in the shared folder and read it back.

    A table survives lost executors, and unlike a checkpointed plan it has a true size:
    size estimates that multiply with every join would otherwise grow without bound over
    the rounds of a loop, and small states are broadcast because they are known to be small.
    """
    return read_tables(df, [write_table(df)])


def spread(scan: DataFrame) -> DataFrame:
    """Split a file scan of fewer tasks than cores before work that is heavy per row.

    A table of many files or row groups is left alone, so no shuffle is added at scale.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def block_pairs(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str, left_rows: int, right_rows: int
) -> tuple[GroupedData, GroupedData]:
    """Both sides grouped into cells (keys, block of left, block of right) of bounded size, to be cogrouped.

    Every row of a key meets every row of the other side with the same key in exactly one
    cell, so a hot key is many cells. Rows whose key the other side lacks are left out.
    """
    count = lambda df, rows, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / rows).cast("int").alias(name))
    blocks = cut_lineage(count(left, left_rows, "_ln").join(count(right, right_rows, "_rn"), list(keys)))
    number = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = left.join(blocks, list(keys)).withColumn("_l", number(left_id, "_ln")).withColumn("_r", every("_rn"))
    two = right.join(blocks, list(keys)).withColumn("_r", number(right_id, "_rn")).withColumn("_l", every("_ln"))
    cell = [*keys, "_l", "_r"]
    return one.drop("_ln", "_rn").groupBy(*cell), two.drop("_ln", "_rn").groupBy(*cell)
