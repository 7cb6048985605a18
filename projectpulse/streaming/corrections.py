"""ST8: sessions in a stored table that late rows correct.

Rows may arrive in any order, however late. Every micro-batch names the (project, time) points
it touches; only the runs within one gap of such a point are derived again, from the stored
snapshots of just these stretches of time, and replaced. A run far from all new rows is not read.

The table is a log of changes, one folder per micro-batch: new runs, and removals of runs that
have merged with others. A batch reads the log before it and overwrites its own folders, so a
batch replayed after a failure leaves the same table. Rows without project or time belong to no
run and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from projectpulse.operators import sessions
from projectpulse.skew import time_chunk

SLICE_HOURS = 24


def _slices(low: Column, high: Column, hours: int) -> Column:
    """Numbers of all time slices from one moment to another, one row each."""
    width = 3600 * hours
    return F.explode(F.sequence(F.floor(F.unix_seconds(low) / width), F.floor(F.unix_seconds(high) / width)))


def touched_runs(runs: DataFrame, points: DataFrame, max_gap_minutes: float, hours: int = SLICE_HOURS) -> DataFrame:
    """Runs with a point (project_id, recorded_at) inside or within one gap.

    Both sides meet on (project, slice of time), so a hot project is spread over its slices.
    """
    gap = F.make_dt_interval(secs=F.lit(max_gap_minutes * 60).cast("decimal(18,6)"))
    wide = runs.withColumns({"_low": F.col("started_at") - gap, "_high": F.col("ended_at") + gap})
    wide = wide.withColumn("_slice", _slices(F.col("_low"), F.col("_high"), hours))
    at = points.select(F.col("project_id").alias("_project"), F.col("recorded_at").alias("_at"), time_chunk("recorded_at", hours).alias("_point_slice"))
    near = (F.col("project_id") == F.col("_project")) & (F.col("_slice") == F.col("_point_slice")) & F.col("_at").between(F.col("_low"), F.col("_high"))
    return wide.join(at, near, "left_semi").drop("_low", "_high", "_slice").dropDuplicates(["project_id", "started_at"])


def rows_within(snapshots: DataFrame, ranges: DataFrame, hours: int = SLICE_HOURS) -> DataFrame:
    """Snapshots inside any range (project_id, low, high), each once."""
    spans = ranges.select(F.col("project_id").alias("_project"), "low", "high", _slices(F.col("low"), F.col("high"), hours).alias("_slice"))
    inside = (
        (F.col("project_id") == F.col("_project")) & (time_chunk("recorded_at", hours) == F.col("_slice"))
        & F.col("recorded_at").between(F.col("low"), F.col("high"))
    )
    return snapshots.join(spans, inside, "left_semi")


def correction(runs: DataFrame, snapshots: DataFrame, points: DataFrame, max_gap_minutes: float = 15.0) -> DataFrame:
    """Changes that turn ``runs`` into the runs of all ``snapshots``, where ``points`` are the new ones.

    ``snapshots`` holds the new rows too. A change is a run with ``removed`` false, or the key of a
    run that is no more with ``removed`` true. A new row links only runs within one gap, so what is
    derived from the touched runs and the points is final.
    """
    points = points.select("project_id", "recorded_at").distinct()
    stale = touched_runs(runs, points, max_gap_minutes)
    ranges = stale.select("project_id", F.col("started_at").alias("low"), F.col("ended_at").alias("high")).unionByName(
        points.select("project_id", F.col("recorded_at").alias("low"), F.col("recorded_at").alias("high"))
    )
    fresh = sessions.activity_runs(rows_within(snapshots, ranges), max_gap_minutes)
    both = fresh.withColumn("removed", F.lit(False)).unionByName(stale.withColumn("removed", F.lit(True)))
    # a touched run is removed unless a new one starts where it did
    order = Window.partitionBy("project_id", "started_at").orderBy("removed")
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def read_runs(changes: DataFrame) -> DataFrame:
    """The present runs: the newest change of every (project, start), unless it is a removal."""
    newest = changes.groupBy("project_id", "started_at").agg(F.max("change_batch").alias("change_batch"))
    present = changes.join(newest, ["project_id", "started_at", "change_batch"], "left_semi")
    return present.where("NOT removed").drop("removed", "change_batch")


def _batches(spark: SparkSession, path: str, schema: StructType, batch: str) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields, StructField(batch, LongType())])).parquet(path)


def stream_corrections(
    rows: DataFrame, snapshots: str, changes: str, checkpoint: str, max_gap_minutes: float = 15.0, **trigger
) -> StreamingQuery:
    """Append every micro-batch to the folder ``snapshots`` and correct the runs in the folder ``changes``.

    Read the sessions with ``corrected_sessions``. The stream runs on until the caller stops it,
    unless a ``trigger`` such as ``availableNow=True`` says otherwise.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        runs = sessions.activity_runs(batch, max_gap_minutes).withColumn("removed", F.lit(False)).schema
        arrived = batch.where("project_id IS NOT NULL AND recorded_at IS NOT NULL")
        arrived.write.mode("overwrite").parquet(f"{snapshots}/ingest_batch={batch_id}")
        spark.createDataFrame([], runs).write.mode("ignore").parquet(f"{changes}/change_batch=-1")
        stored = _batches(spark, snapshots, batch.schema, "ingest_batch").where(F.col("ingest_batch") <= batch_id)
        points = stored.where(F.col("ingest_batch") == batch_id)
        known = read_runs(_batches(spark, changes, runs, "change_batch").where(F.col("change_batch") < batch_id))
        changed = correction(known, stored.drop("ingest_batch"), points, max_gap_minutes)
        changed.write.mode("overwrite").parquet(f"{changes}/change_batch={batch_id}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def corrected_sessions(changes: DataFrame) -> DataFrame:
    """WN1, AG9 over the corrected runs: the rows that ``derive_sessions`` gives for all snapshots so far."""
    return sessions.qualified(read_runs(changes))
