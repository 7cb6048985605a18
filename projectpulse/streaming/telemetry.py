"""Streaming twins of the telemetry operators.

Every function takes a streaming DataFrame with (project_id, recorded_at, seq, metrics...)
and returns a streaming DataFrame; the caller chooses sink, trigger and checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from projectpulse.operators import sessions as batch
from projectpulse.operators import telemetry

DEFAULT_DELAY = "1 hour"


def stream_ingest(raw: DataFrame, accepted: str, rejected: str, checkpoint: str, stamp: bool = False, **trigger) -> StreamingQuery:
    """ST1, SC2: accepted snapshots and quarantined rows into two Parquet tables.

    Each micro-batch writes to its own batch folder with overwrite, so a batch replayed
    after a failure replaces itself. With ``stamp`` rows get the time of their batch and all
    metric columns, and accepted ones are foldered by project hash. The stream runs on until
    the caller stops it, unless a ``trigger`` such as ``availableNow=True`` says otherwise.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()
        good, bad = telemetry.validate_ranges(rows)
        if stamp:
            telemetry.append_snapshots(telemetry.stamped(good), f"{accepted}/ingest_batch={batch_id}", "overwrite")
        else:
            good.write.mode("overwrite").parquet(f"{accepted}/ingest_batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{rejected}/ingest_batch={batch_id}")
        rows.unpersist()

    writer = raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def stream_sessions(rows: DataFrame, gap: str = "15 minutes", delay: str = DEFAULT_DELAY) -> DataFrame:
    """ST2: gap sessions; append mode emits a session once the watermark has passed it.

    The local merge of sessions before the shuffle (set in the session settings) keeps the
    rows of a busy project from travelling one by one.
    """
    code = telemetry.activity_code()
    grouped = rows.withWatermark("recorded_at", delay).groupBy(
        "project_id", F.session_window("recorded_at", gap).alias("w")
    ).agg(
        F.min("recorded_at").alias("started_at"),
        F.max("recorded_at").alias("ended_at"),
        F.count("*").alias("snapshot_count"),
        F.count_if(code == 1).alias("active_count"),
        F.avg("typing_speed_cpm").alias("avg_typing_speed_cpm"),
        F.stddev_samp("typing_speed_cpm").alias("typing_speed_stdev"),
        F.avg("mouse_activity_rate").alias("avg_mouse_activity_rate"),
        F.stddev_samp("mouse_activity_rate").alias("mouse_activity_stdev"),
    )
    minutes = (F.unix_micros("ended_at") - F.unix_micros("started_at")) / 60_000_000.0
    kept = grouped.where("snapshot_count >= 2 AND active_count >= 1")
    return kept.withColumn("duration_minutes", batch.rounded(minutes, 2)).drop("w", "active_count")


def stream_current_state(rows: DataFrame) -> DataFrame:
    """ST3: latest present value per metric; the state is one row per project."""
    return telemetry.current_state(rows)


def write_state_changes(state: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """ST3 sink: each micro-batch writes only the projects it has changed, to a folder of its own."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/state_batch={batch_id}")

    writer = state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_state(changes: DataFrame) -> DataFrame:
    """ST3: the newest row of each project among the changes written so far."""
    newest = changes.groupBy("project_id").agg(F.max("state_batch").alias("state_batch"))
    return changes.join(newest, ["project_id", "state_batch"], "left_semi").drop("state_batch")


def stream_rate(rows: DataFrame, seconds: int = 30, delay: str = DEFAULT_DELAY) -> DataFrame:
    """ST5"""
    return telemetry.activity_rate(rows.withWatermark("recorded_at", delay), seconds)


def stream_likelihood(rows: DataFrame, delay: str = DEFAULT_DELAY) -> DataFrame:
    """ST6: was a project active in the hour that ends at each five-minute mark?"""
    active = F.coalesce(telemetry.activity_code(), F.lit(0)) == 1
    grouped = rows.withWatermark("recorded_at", delay).groupBy(
        "project_id", F.window("recorded_at", "1 hour", "5 minutes").alias("w")
    ).agg(F.count("*").alias("snapshots"), F.bool_or(active).alias("active"))
    return grouped.select("project_id", F.col("w.end").alias("as_of"), "snapshots", "active")


def stream_dedupe(records: DataFrame, delay: str = DEFAULT_DELAY) -> DataFrame:
    """ST7: re-delivered records are dropped while the watermark remembers their id."""
    return records.withWatermark("recorded_at", delay).dropDuplicatesWithinWatermark(["project_id", "record_id"])


def late_rows(rows: DataFrame, delay: str = DEFAULT_DELAY, now: str = "ingested_at") -> DataFrame:
    """ST8: rows that arrive later than the allowed delay, for a counter of their own."""
    limit = F.unix_micros(now) - F.lit(int(pd.Timedelta(delay).value // 1000))
    return rows.withColumn("is_late", F.unix_micros("recorded_at") < limit)


BREAK_SCHEMA = (
    "project_id string, started_at timestamp, ended_at timestamp, snapshot_count bigint, break_count bigint"
)
_STATE_SCHEMA = (
    "times array<bigint>, seqs array<bigint>, codes array<int>, opened bigint, last bigint, n bigint, "
    "active bigint, breaks bigint, known int"
)


def stream_breaks(rows: DataFrame, gap_minutes: float = 15.0, delay: str = DEFAULT_DELAY) -> DataFrame:
    """ST4, WN2: sessions with their inactive stretches, which need the order of rows.

    Rows wait in the state until the watermark has passed them, then fold into the open
    session in order. An event-time timer closes a session when its gap has run out. The
    waiting rows of a project are those of one watermark delay, never its history.
    """
    gap = int(gap_minutes * 60_000_000)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        blank = ([], [], [], None, None, 0, 0, 0, -1)
        times, seqs, codes, opened, last, n, active, breaks, known = state.get if state.exists else blank
        waiting = list(zip(times, seqs, codes))
        for frame in frames:
            waiting += zip(frame["micros"].tolist(), frame["seq"].tolist(), frame["code"].tolist())
        passed = state.getCurrentWatermarkMs() * 1000
        waiting.sort()
        closed = []

        def close() -> None:
            if n >= 2 and active >= 1:
                closed.append((key[0], opened, last, n, breaks))

        ready = [row for row in waiting if row[0] < passed]
        waiting = waiting[len(ready):]
        for at, _, code in ready:
            if opened is None or at - last > gap:
                if opened is not None:
                    close()
                opened, n, active, breaks, known = at, 0, 0, 0, -1
            last, n = at, n + 1
            if code >= 0:
                breaks += int(code == 0 and known != 0)
                active += int(code == 1)
                known = code
        if opened is not None and passed - last > gap:
            close()
            opened, last, n, active, breaks, known = None, None, 0, 0, 0, -1
        if waiting or opened is not None:
            state.update((
                [w[0] for w in waiting], [w[1] for w in waiting], [w[2] for w in waiting],
                opened, last, n, active, breaks, known,
            ))
            wake = waiting[0][0] if waiting else last + gap
            state.setTimeoutTimestamp(max(wake // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        result = pd.DataFrame(closed, columns=["project_id", "started_at", "ended_at", "snapshot_count", "break_count"])
        for column in ("started_at", "ended_at"):
            result[column] = pd.to_datetime(result[column], unit="us", utc=True)
        yield result

    coded = rows.withWatermark("recorded_at", delay).select(
        "project_id", "recorded_at", F.coalesce("seq", F.lit(0)).alias("seq"),
        F.unix_micros("recorded_at").alias("micros"),
        F.coalesce(telemetry.activity_code(), F.lit(-1)).cast("int").alias("code"),
    )
    return coded.groupBy("project_id").applyInPandasWithState(
        fold, BREAK_SCHEMA, _STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout
    )
