import random
from datetime import datetime, timedelta

from conftest import rows
from projectpulse.operators import sessions as S
from projectpulse.streaming import breaks as SB
from projectpulse.streaming import corrections as SC
from projectpulse.streaming import telemetry as ST

BASE = datetime(2026, 1, 5, 9)
SCHEMA = "project_id string, recorded_at timestamp, seq bigint, typing_speed_cpm double, mouse_activity_rate double"


def batches(spark, folder, parts):
    """One Parquet file per micro-batch."""
    for part in parts:
        data = [(p, BASE + timedelta(minutes=m), i, t, None) for p, m, i, t in part]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder)), spark.read.parquet(str(folder))


def run(stream, folder, name):
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", str(folder / name))
    writer.option("checkpointLocation", str(folder / f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(folder / name))


def points():
    rng, parts, seq = random.Random(8), [], 0
    minute = {"a": 0, "b": 3}
    for _ in range(3):
        part = []
        for p in minute:
            for _ in range(40):
                minute[p] += rng.choice([2, 5, 15, 16, 40])
                part.append((p, minute[p], seq, rng.choice([0.0, 0.0, 4.0, None])))
                seq += 1
        rng.shuffle(part)  # rows of a batch arrive in any order
        parts.append(part)
    # a last row far ahead lets the watermark pass everything before it
    end = max(minute.values()) + 10_000
    return parts + [[("end", end, seq, 1.0)], [("end", end + 1, seq + 1, 1.0)]]


def test_breaks_and_sessions_match_batch(spark, tmp_path):
    stream, table = batches(spark, tmp_path / "in", points())
    expected = S.derive_sessions(table).where("project_id <> 'end'")
    breaks = run(ST.stream_breaks(stream, 15.0, "2000 minutes"), tmp_path, "breaks")
    columns = ["project_id", "started_at", "ended_at", "snapshot_count"]
    assert rows(breaks, *columns, "break_count") == rows(expected, *columns, "break_count")
    found = run(ST.stream_sessions(stream, "15 minutes", "2000 minutes"), tmp_path, "sessions")
    assert rows(found, *columns, "duration_minutes") == rows(expected, *columns, "duration_minutes")


def test_dedupe(spark, tmp_path):
    parts = [[("a", 0, 1, 1.0), ("a", 0, 1, 1.0)], [("a", 0, 1, 1.0), ("a", 1, 2, 1.0)]]
    stream, _ = batches(spark, tmp_path / "in", parts)
    assert rows(run(ST.stream_dedupe(stream.withColumnRenamed("seq", "record_id")), tmp_path, "out"), "record_id") == [(1,), (2,)]


def test_ingest_replay_writes_no_row_twice(spark, tmp_path):
    parts = [[("a", 0, 1, 1.0)], [("a", 1, 2, -1.0)]]
    stream, _ = batches(spark, tmp_path / "in", parts)
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    for state in ("s1", "s2"):  # the second stream starts over, as after a lost checkpoint
        ST.stream_ingest(stream, good, bad, str(tmp_path / state), availableNow=True).awaitTermination()
    assert rows(spark.read.parquet(good), "seq") == [(1,)]
    assert rows(spark.read.parquet(bad), "seq", "rejected_field") == [(2, "typing_speed_cpm")]


def test_sliced_breaks_match_batch_across_borders(spark, tmp_path):
    """Slices of one hour: most sessions cross several of them, and some fill whole slices."""
    rng, parts, seq, minute = random.Random(5), [], 0, {"a": 0, "b": 30, "c": 59}
    for _ in range(3):
        part = []
        for p in minute:
            for _ in range(60):
                minute[p] += rng.choice([1, 3, 10, 15, 15, 16, 70])
                part.append((p, minute[p], seq, rng.choice([0.0, 0.0, 4.0, None])))
                seq += 1
        rng.shuffle(part)
        parts.append(part)
    end = max(minute.values()) + 10_000
    stream, table = batches(spark, tmp_path / "in", [*parts, [("end", end, seq, 1.0)], [("end", end + 1, seq + 1, 1.0)]])
    columns = ["project_id", "started_at", "ended_at", "snapshot_count", "break_count"]
    expected = rows(S.derive_sessions(table).where("project_id <> 'end'"), *columns)
    assert any(r[1].hour != r[2].hour for r in expected)
    assert rows(run(SB.stream_sliced_breaks(stream, 15.0, "2000 minutes", 1), tmp_path, "late"), *columns) == expected
    # with a short delay the watermark moves inside the data; the plain operator sees the same rows
    quick = sorted(r for part in parts for r in part)
    quick.sort(key=lambda r: r[1])
    few = [quick[i:i + 45] for i in range(0, len(quick), 45)]
    stream, _ = batches(spark, tmp_path / "quick", [*few, [("end", end, seq, 1.0)], [("end", end + 1, seq + 1, 1.0)]])
    plain = rows(run(ST.stream_breaks(stream, 15.0, "20 minutes"), tmp_path, "plain"), *columns)
    assert rows(run(SB.stream_sliced_breaks(stream, 15.0, "20 minutes", 1), tmp_path, "sliced"), *columns) == plain == expected


def test_sliced_breaks_keep_state_per_bucket_and_projects_apart(spark, tmp_path):
    """Forty projects, one without a name, in three buckets; equal times, and times between milliseconds."""
    rng, data, seq = random.Random(11), [], 0
    for p in [None, *(f"p{i}" for i in range(39))]:
        minute = rng.choice([0, 30, 59.99])
        for _ in range(60):
            minute += rng.choice([0, 1, 10, 15, 15, 15.00001, 16, 70]) + rng.choice([0, 0, 0.000013])
            data.append((p, minute, seq, rng.choice([0.0, 0.0, 4.0, None])))
            seq += 1
    data.sort(key=lambda r: r[1])
    end = data[-1][1] + 10_000
    parts = [data[i:i + 800] for i in range(0, len(data), 800)]
    for part in parts:
        rng.shuffle(part)
    stream, table = batches(spark, tmp_path / "in", [*parts, [("end", end, seq, 1.0)], [("end", end + 1, seq + 1, 1.0)]])
    columns = ["project_id", "started_at", "ended_at", "snapshot_count", "break_count"]
    expected = rows(S.derive_sessions(table).where("project_id IS DISTINCT FROM 'end'"), *columns)
    assert any(r[0] is None for r in expected)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    found = SB.stream_sliced_breaks(stream, 15.0, "20 minutes", 4, buckets=3)
    writer = found.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows(spark.read.schema(found.schema).parquet(out), *columns) == expected
    # records of the state are columns of a bucket, not rows: far fewer than rows, whatever the number of projects
    first_steps = [max(progress["stateOperators"], key=lambda o: o["numRowsUpdated"]) for progress in query.recentProgress if progress["numInputRows"]]
    assert max(step["numRowsUpdated"] for step in first_steps) < 150


def test_sliced_breaks_close_in_the_first_millisecond_beyond_the_gap(spark, tmp_path):
    end, micro = 600.0, 1 / 60_000_000
    last = {"a": end - 60 - 15 - 500 * micro, "b": end - 60 - 15, "c": end - 60 - 15 - micro}  # the watermark ends at 540 minutes
    data = [(p, m, i, 1.0) for p in last for i, m in enumerate((last[p] - 10, last[p]))]
    stream, _ = batches(spark, tmp_path / "in", [data, [("end", end, 9, 1.0)]])
    found = run(SB.stream_sliced_breaks(stream, 15.0, "60 minutes"), tmp_path, "out")
    assert rows(found, "project_id", "snapshot_count") == [("a", 2), ("c", 2)]


def test_corrections_of_shuffled_input_match_batch(spark, tmp_path):
    """Rows of all times come in every micro-batch; runs grow, merge and start earlier."""
    rng, data, seq, minute = random.Random(9), [], 0, {"a": 0, "b": 7}
    for p in minute:
        for _ in range(90):
            minute[p] += rng.choice([0, 3, 10, 15, 16, 400])
            data.append((p, minute[p], seq, rng.choice([0.0, 0.0, 4.0, None])))
            seq += 1
    rng.shuffle(data)
    stream, table = batches(spark, tmp_path / "in", [data[:100], data[100:101], data[101:140], data[140:]])
    snapshots, changes, state = (str(tmp_path / n) for n in ("snapshots", "changes", "state"))
    for place in (state, f"{state}2"):  # the second stream replays every batch over the same tables
        SC.stream_corrections(stream, snapshots, changes, place, availableNow=True).awaitTermination()
        found = SC.corrected_sessions(spark.read.parquet(changes))
        expected = S.derive_sessions(table)
        columns = ["project_id", "started_at", "ended_at", "snapshot_count", "break_count", "breaks_per_hour", "duration_minutes"]
        assert rows(found, *columns) == rows(expected, *columns)
        assert len(rows(expected)) > 8
    # one late row changes the runs near it and no others
    single = spark.read.parquet(changes).where("change_batch = 1")
    assert 1 <= single.count() <= 3


def test_a_late_row_joins_two_runs(spark):
    at = lambda m: BASE + timedelta(minutes=m)
    old = spark.createDataFrame([("a", at(m), m, 1.0, None) for m in (0, 5, 30, 35, 90)] + [("b", at(10), 1, 1.0, None)], SCHEMA)
    late = spark.createDataFrame([("a", at(18), 99, 0.0, None)], SCHEMA)
    runs = S.activity_runs(old)
    changed = SC.correction(runs, old.unionByName(late), late)
    assert rows(changed, "started_at", "ended_at", "removed") == [(at(0), at(35), False), (at(30), at(35), True)]
    assert rows(SC.correction(runs, old, late.where("false"))) == []
    first = SC.correction(runs.where("false"), late, late)
    assert rows(first, "started_at", "snapshot_count", "removed") == [(at(18), 1, False)]
