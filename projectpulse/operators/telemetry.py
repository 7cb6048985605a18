"""Telemetry snapshots: checks, readings, current state, rates, deadlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from projectpulse.functions import fixed
from projectpulse.functions.scalars import packed_order, rounded, strip
from projectpulse.skew import previous_values, time_chunk

METRICS = {name: unit for units in fixed.METRIC_SECTIONS.values() for name, unit in units.items()}
SECTION_OF = {name: section for section, units in fixed.METRIC_SECTIONS.items() for name in units}
RAW_SCHEMA = (
    "project_id string, recorded_at timestamp, seq bigint, "
    + ", ".join(f"{name} double" for name in METRICS)
    + ", source string"
)


def complete_columns(df: DataFrame) -> DataFrame:
    """Give a sparse telemetry table every metric column, absent ones as null."""
    missing = {name: F.lit(None).cast("double") for name in METRICS if name not in df.columns}
    if "source" not in df.columns:
        missing["source"] = F.lit(None).cast("string")
    return df.withColumns(missing) if missing else df


def normalize_utc(value) -> Column:
    """PR4: a timestamp without zone is UTC; one with an offset is converted to UTC."""
    return F.col(value).cast("timestamp") if isinstance(value, str) else value.cast("timestamp")


def range_error(columns: list[str]) -> Column:
    """PR1: name of the first metric out of range, or null for a good row."""
    checks = []
    for name in METRICS:
        if name not in columns or name in fixed.UNBOUNDED_METRICS:
            continue
        bad = F.col(name) < 0
        if name in fixed.METRIC_UPPER_LIMITS:
            bad = bad | (F.col(name) > fixed.METRIC_UPPER_LIMITS[name])
        checks.append(F.when(bad | F.isnan(name), F.lit(name)))
    if "source" in columns:
        checks.append(F.when(~F.col("source").isin(fixed.ENVIRONMENTAL_SOURCES), F.lit("source")))
    return F.coalesce(*checks, F.lit(None).cast("string"))


def validate_ranges(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PR1: split into accepted rows and quarantined rows with the reason."""
    marked = df.withColumn("rejected_field", range_error(df.columns))
    good = marked.where(F.col("rejected_field").isNull()).drop("rejected_field")
    return good, marked.where(F.col("rejected_field").isNotNull())


def unknown_keys(body) -> Column:
    """PR1: keys of a JSON ingest body that no section or metric is named after."""
    body = F.col(body) if isinstance(body, str) else body
    empty = F.array().cast("array<string>")
    found = F.array_except(F.json_object_keys(body), F.array(*[F.lit(s) for s in fixed.METRIC_SECTIONS]))
    parts = [F.coalesce(found, empty)]
    for section, units in fixed.METRIC_SECTIONS.items():
        allowed = [*units, "source"] if section == "environmental" else [*units]
        inner = F.json_object_keys(F.get_json_object(body, f"$.{section}"))
        parts.append(F.coalesce(F.array_except(inner, F.array(*[F.lit(a) for a in allowed])), empty))
    return F.concat(*parts)


def reading(name: str) -> Column:
    """PR2: a nullable metric as {status, value, unit, source}."""
    environmental = SECTION_OF[name] == "environmental"
    return F.struct(
        F.when(F.col(name).isNull(), "missing").otherwise("present").alias("status"),
        F.col(name).alias("value"),
        F.lit(METRICS[name]).alias("unit"),
        (F.col("source") if environmental else F.lit(None).cast("string")).alias("source"),
    )


def wrap_missing(df: DataFrame) -> DataFrame:
    """PR2: nest the metrics into the three sections of readings."""
    df = complete_columns(df)
    keep = [c for c in ("project_id", "recorded_at", "seq") if c in df.columns]
    sections = [
        F.struct(*[reading(name).alias(name) for name in units]).alias(section)
        for section, units in fixed.METRIC_SECTIONS.items()
    ]
    return df.select(*keep, *sections)


def stamped(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """SC2: snapshots with every metric column and the time of their arrival (UTC), whatever the sender says."""
    return complete_columns(rows).withColumn("recorded_at", F.current_timestamp() if now is None else now)


def append_snapshots(rows: DataFrame, path: str, mode: str = "append", buckets: int = 64) -> None:
    """SC2 sink: snapshots below ``path``, foldered by a hash of the project.

    Equal buckets come together before the write, and a large one is split again, so a batch
    leaves few files per folder and a hot project no huge one.
    """
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64("project_id"), F.lit(buckets)).cast("int"))
    placed.hint("rebalance", "bucket").write.mode(mode).partitionBy("bucket").parquet(path)


def readings_long(df: DataFrame) -> DataFrame:
    """One row per snapshot and metric: section, field, value, unit, source."""
    df = complete_columns(df)
    cells = F.array(*[
        F.struct(F.lit(SECTION_OF[n]).alias("section"), F.lit(n).alias("field"), reading(n).alias("r"))
        for n in METRICS
    ])
    keep = [c for c in ("project_id", "recorded_at", "seq") if c in df.columns]
    return df.select(*keep, F.explode(cells).alias("cell")).select(*keep, "cell.section", "cell.field", "cell.r.*")


def activity_code() -> Column:
    """PR3 as a number: 1 active, 0 inactive, null unknown."""
    typing, mouse = F.col("typing_speed_cpm"), F.col("mouse_activity_rate")
    active = (F.coalesce(typing, F.lit(0.0)) > 0) | (F.coalesce(mouse, F.lit(0.0)) > 0)
    return F.when(typing.isNull() & mouse.isNull(), F.lit(None)).when(active, 1).otherwise(0).cast("bigint")


def classify_activity() -> Column:
    """PR3: active, inactive or unknown."""
    code = activity_code()
    return F.when(code.isNull(), "unknown").when(code == 1, "active").otherwise("inactive")


def telemetry_history(df: DataFrame, since=None) -> DataFrame:
    """SC3: snapshots oldest first, optionally from ``since`` on (inclusive)."""
    if since is not None:
        df = df.where(F.col("recorded_at") >= F.lit(since).cast("timestamp"))
    return df.orderBy("project_id", "recorded_at", "seq")


def last_hour(df: DataFrame, now) -> DataFrame:
    """PR13: snapshots of the hour before ``now``; there is no upper bound."""
    return df.where(F.col("recorded_at") >= F.lit(now).cast("timestamp") - F.expr("INTERVAL 1 HOUR"))


def newest_first(df: DataFrame, limit: int) -> DataFrame:
    """WN8: the newest rows of each project by (recorded_at, seq)."""
    order = Window.partitionBy("project_id").orderBy(F.desc("recorded_at"), F.desc("seq"))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def current_state(df: DataFrame) -> DataFrame:
    """AG10: latest present value of each metric over the whole history of a project.

    One hash aggregate, combined before the shuffle: times are packed into fixed-width numbers and
    sources are numbers of the list of legal ones, so that no raw row is sorted and no project's
    rows meet in one task. A source that ingest rejects counts as none.
    """
    df = complete_columns(df)
    order, number = packed_order("recorded_at", "seq"), F.lit(None).cast("int")
    for at, name in enumerate(fixed.ENVIRONMENTAL_SOURCES):
        number = F.when(F.col("source") == name, at).otherwise(number)
    latest, sources = [], {}
    for name in METRICS:
        seen = F.when(F.col(name).isNotNull(), order)
        latest.append(F.max_by(F.col(name), seen).alias(name))
        if SECTION_OF[name] == "environmental":
            latest.append(F.max_by(number, seen).alias(f"{name}_source"))
            sources[f"{name}_source"] = F.get(F.array(*[F.lit(s) for s in fixed.ENVIRONMENTAL_SOURCES]), F.col(f"{name}_source"))
    return df.groupBy("project_id").agg(F.max("recorded_at").alias("recorded_at"), *latest).withColumns(sources)


def current_readings(state: DataFrame) -> DataFrame:
    """The current state as rows of readings; never reported metrics stay missing."""
    cells = F.array(*[
        F.struct(
            F.lit(SECTION_OF[n]).alias("section"),
            F.lit(n).alias("field"),
            F.when(F.col(n).isNull(), "missing").otherwise("present").alias("status"),
            F.col(n).alias("value"),
            F.lit(METRICS[n]).alias("unit"),
            (F.col(f"{n}_source") if SECTION_OF[n] == "environmental" else F.lit(None).cast("string")).alias("source"),
        )
        for n in METRICS
    ])
    return state.select("project_id", "recorded_at", F.explode(cells).alias("c")).select(
        "project_id", "recorded_at", "c.*"
    )


def counter_rate(df: DataFrame, counter: str, chunk_hours: int = 24) -> DataFrame:
    """WN5: growth of a byte counter since the row before, in KiB per second."""
    order = ["recorded_at", "seq"]
    stepped = previous_values(df, ["project_id"], order, time_chunk("recorded_at", chunk_hours), [counter, "recorded_at"])
    elapsed = (F.unix_micros("recorded_at") - F.unix_micros("prev_recorded_at")) / 1e6
    growth = F.greatest(F.col(counter) - F.col(f"prev_{counter}"), F.lit(0))
    rate = F.when(elapsed > 0, rounded(growth / elapsed / 1024.0, 2))
    return stepped.withColumn("rate_kbps", rate).drop(f"prev_{counter}", "prev_recorded_at")


def activity_rate(df: DataFrame, seconds: int = 30, ts: str = "recorded_at") -> DataFrame:
    """AG29: rows per interval as a rate per minute."""
    counted = df.groupBy("project_id", F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    rate = rounded(F.col("n") / seconds * 60.0, 2)
    return counted.select("project_id", F.col("w.start").alias("interval_start"), "n", rate.alias("rate_per_minute"))


def parse_sensor_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """SC4: one JSON object per line; keys that are absent or no numbers become null.

    Lines that are no JSON object give a row with ``is_object`` false and no values.
    """
    names = list(fixed.ENVIRONMENTAL_UNITS)
    schema = ", ".join(f"{name} double" for name in names)
    variant = F.try_parse_json(F.col(line))
    is_object = F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))
    parsed = df.withColumn("is_object", is_object).withColumn("_row", F.from_json(F.col(line), schema))
    values = [F.when(F.col("is_object"), F.col(f"_row.{name}")).alias(name) for name in names]
    return parsed.select(*df.columns, "is_object", *values)


def add_deadlines(df: DataFrame) -> DataFrame:
    """SC8: deadlines with a trimmed, non-blank title."""
    return df.withColumn("title", strip("title")).where(F.col("title") != "")


def list_deadlines(df: DataFrame) -> DataFrame:
    """SC8: soonest first."""
    return df.orderBy("project_id", "due_at", "deadline_id")


def upcoming_deadlines(df: DataFrame, now) -> DataFrame:
    """PR12: deadlines not yet past, with the weekday of ``now``."""
    now = F.lit(now).cast("timestamp")
    upcoming = df.where(F.col("due_at") >= now).withColumn("weekday", F.date_format(now, "EEEE"))
    return list_deadlines(upcoming)
