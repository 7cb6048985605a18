"""Registered streaming queries: each runs its stream over ``events`` to the end.

The stream reads the events file, writes Parquet below the shared checkpoint folder, and
the query returns that table. In append mode a window or session is emitted once the
watermark (newest row minus one hour) has passed it; the SQL says the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from projectpulse.catalog import inputs
from projectpulse.catalog.registry import cte, query, shown, sql_round, sql_ts, table
from projectpulse.skew import new_folder
from projectpulse.streaming import breaks as SB
from projectpulse.streaming import corrections as SC
from projectpulse.streaming import telemetry as ST

GAP = inputs.SESSION_GAP_MINUTES
cte("watermark", "SELECT date_trunc('milliseconds', max(ts) - INTERVAL 1 HOUR) AS wm FROM events")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def telemetry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.events_as_telemetry(events_stream(spark, sf_dir))


def finished(stream: DataFrame, name: str) -> DataFrame:
    """Append the stream to a Parquet table, wait for its end, and read the table."""
    spark = stream.sparkSession
    target = new_folder(spark, name)
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", target)
    writer.option("checkpointLocation", new_folder(spark, f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


@query("st1_stream_ingest", """
SELECT seq, CASE WHEN value / 10 > 24 THEN 'sleep_hours' WHEN k * 1.2 > 100 THEN 'cpu_usage_percent' WHEN event_type = 'signup' THEN 'source' END AS rejected_field
FROM (SELECT event_id AS seq, value, event_type, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
""")
def _(spark, sf_dir):
    raw = events_stream(spark, sf_dir).select(
        F.col("event_id").alias("seq"), (F.col("value") / 10).alias("sleep_hours"),
        (F.get_json_object("props", "$.k").cast("double") * 1.2).alias("cpu_usage_percent"),
        F.when(F.col("event_type") == "signup", "guessed").otherwise("hardware").alias("source"))
    good, bad = new_folder(spark, "accepted"), new_folder(spark, "rejected")
    ST.stream_ingest(raw, good, bad, new_folder(spark, "ingest-state"), availableNow=True).awaitTermination()
    accepted = spark.read.parquet(good).withColumn("rejected_field", F.lit(None).cast("string"))
    return accepted.select("seq", "rejected_field").unionByName(spark.read.parquet(bad).select("seq", "rejected_field"))


@query("st1_stamped_ingest", """
SELECT project_id, count(*) AS snapshots, count(typing) AS typed FROM telemetry WHERE cpu IS NULL OR cpu <= 100 GROUP BY project_id
""", ("telemetry",))
def _(spark, sf_dir):
    """Snapshots as agents send them, without a time: stamped, completed, appended per bucket."""
    raw = telemetry_stream(spark, sf_dir).drop("recorded_at")
    good, bad = new_folder(spark, "stamped"), new_folder(spark, "rejected")
    ST.stream_ingest(raw, good, bad, new_folder(spark, "stamp-state"), stamp=True, availableNow=True).awaitTermination()
    stored = spark.read.parquet(good).where(F.abs(F.unix_seconds("recorded_at") - F.unix_seconds(F.current_timestamp())) < 86400)
    return stored.groupBy("project_id").agg(F.count("*").alias("snapshots"), F.count("typing_speed_cpm").alias("typed"))


@query("st2_stream_sessions", f"""
SELECT project_id, {sql_ts('started_at')} AS started_at, {sql_ts('ended_at')} AS ended_at, duration_minutes, snapshot_count,
  {sql_round('avg_typing', 6)} AS avg_typing_speed_cpm, {sql_round('sd_mouse', 6)} AS mouse_activity_stdev
FROM sessions, watermark WHERE ended_at + INTERVAL 360 MINUTE <= wm
""", ("sessions", "watermark"))
def _(spark, sf_dir):
    rows = finished(ST.stream_sessions(telemetry_stream(spark, sf_dir), f"{int(GAP)} minutes"), "sessions")
    return shown(rows.select("project_id", "started_at", "ended_at", "duration_minutes", "snapshot_count",
                             "avg_typing_speed_cpm", "mouse_activity_stdev"))


@query("st3_stream_current_state", f"""
SELECT project_id, {sql_ts('max(recorded_at)')} AS recorded_at, round(arg_max(typing, {{'a': recorded_at, 'b': seq}}) FILTER (WHERE typing IS NOT NULL), 6) AS typing_speed_cpm,
  round(arg_max(cpu, {{'a': recorded_at, 'b': seq}}) FILTER (WHERE cpu IS NOT NULL), 6) AS cpu_usage_percent FROM telemetry GROUP BY project_id
""", ("telemetry",))
def _(spark, sf_dir):
    target = new_folder(spark, "state")
    state = ST.stream_current_state(telemetry_stream(spark, sf_dir))
    ST.write_state_changes(state, target, new_folder(spark, "state-state"), availableNow=True).awaitTermination()
    return shown(ST.read_state(spark.read.parquet(target)).select("project_id", "recorded_at", "typing_speed_cpm", "cpu_usage_percent"))


@query("st4_stream_breaks", f"""
SELECT project_id, {sql_ts('started_at')} AS started_at, {sql_ts('ended_at')} AS ended_at, snapshot_count, break_count
FROM sessions, watermark WHERE ended_at + INTERVAL 360 MINUTE < wm
""", ("sessions", "watermark"))
def _(spark, sf_dir):
    return shown(finished(ST.stream_breaks(telemetry_stream(spark, sf_dir), GAP), "breaks"))


@query("st4_sliced_breaks", f"""
SELECT project_id, {sql_ts('started_at')} AS started_at, {sql_ts('ended_at')} AS ended_at, snapshot_count, break_count
FROM sessions, watermark WHERE ended_at + INTERVAL 360 MINUTE < wm
""", ("sessions", "watermark"))
def _(spark, sf_dir):
    """The same sessions, the rows of a project spread over slices of four weeks."""
    return shown(finished(SB.stream_sliced_breaks(telemetry_stream(spark, sf_dir), GAP, slice_hours=672), "sliced"))


@query("st5_stream_rate", f"""
SELECT project_id, {sql_ts('b')} AS interval_start, count(*) AS n, {sql_round('count(*) / 30.0 * 60.0', 2)} AS rate_per_minute
FROM (SELECT *, time_bucket(INTERVAL 30 SECOND, recorded_at, TIMESTAMP '1970-01-01') AS b FROM telemetry), watermark
WHERE b + INTERVAL 30 SECOND <= wm GROUP BY project_id, b
""", ("telemetry", "watermark"))
def _(spark, sf_dir):
    return shown(finished(ST.stream_rate(telemetry_stream(spark, sf_dir)), "rate"))


@query("st6_stream_likelihood", f"""
SELECT project_id, {sql_ts('e')} AS as_of, count(*) AS snapshots, bool_or(coalesce(code, 0) = 1) AS active
FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, recorded_at, TIMESTAMP '1970-01-01') + INTERVAL 5 MINUTE * k AS e FROM activity, generate_series(1, 12) AS g(k)), watermark
WHERE e <= wm GROUP BY project_id, e
""", ("activity", "watermark"))
def _(spark, sf_dir):
    return shown(finished(ST.stream_likelihood(telemetry_stream(spark, sf_dir)), "likelihood"))


@query("st7_stream_dedupe", "SELECT 'rec-' || event_id AS record_id, 'user-' || user_id AS project_id FROM events")
def _(spark, sf_dir):
    once = events_stream(spark, sf_dir).select(
        F.concat(F.lit("rec-"), F.col("event_id").cast("string")).alias("record_id"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("project_id"), F.col("ts").cast("timestamp").alias("recorded_at"))
    twice = once.withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2))))
    return finished(ST.stream_dedupe(twice), "dedupe").select("record_id", "project_id")


@query("st8_late_data", "SELECT event_id AS seq, value > 60 AS is_late FROM events")
def _(spark, sf_dir):
    rows = events_stream(spark, sf_dir).select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("recorded_at"),
        (F.col("ts").cast("timestamp") + F.make_dt_interval(mins=F.lit(0), secs=(F.col("value") * 60).cast("decimal(18,6)"))).alias("ingested_at"))
    return finished(ST.late_rows(rows), "late").select("seq", "is_late")


@query("st8_corrected_sessions", f"""
SELECT project_id, {sql_ts('started_at')} AS started_at, {sql_ts('ended_at')} AS ended_at, duration_minutes, snapshot_count, break_count FROM sessions
""", ("sessions",))
def _(spark, sf_dir):
    """Events in three files by a hash, one per micro-batch, so that two thirds of the rows come late."""
    mixed, snapshots, changes = (new_folder(spark, name) for name in ("mixed", "snapshots", "changes"))
    inputs.events_as_telemetry(table(spark, sf_dir, "events")).repartition(3, "seq").write.parquet(mixed)
    stream = spark.readStream.schema(spark.read.parquet(mixed).schema).option("maxFilesPerTrigger", 1).parquet(mixed)
    SC.stream_corrections(stream, snapshots, changes, new_folder(spark, "correct-state"), GAP, availableNow=True).awaitTermination()
    sessions = SC.corrected_sessions(spark.read.parquet(changes))
    return shown(sessions.select("project_id", "started_at", "ended_at", "duration_minutes", "snapshot_count", "break_count"))
