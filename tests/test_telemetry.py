from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from projectpulse.operators import sessions as S
from projectpulse.operators import telemetry as T

BASE = datetime(2026, 1, 5, 9)  # a Monday
SCHEMA = "project_id string, recorded_at timestamp, seq bigint, typing_speed_cpm double, mouse_activity_rate double"


def table(spark, points, project="p"):
    """points: (minute, typing, mouse)"""
    data = [(project, BASE + timedelta(minutes=m), i, t, o) for i, (m, t, o) in enumerate(points)]
    return spark.createDataFrame(data, SCHEMA)


def brute_sessions(points, gap):
    runs, current = [], []
    for m, t, o in sorted(points):
        if current and m - current[-1][0] > gap:
            runs.append(current)
            current = []
        current.append((m, t, o))
    runs.append(current)
    found = []
    for run in runs:
        codes = [None if t is None and o is None else int((t or 0) > 0 or (o or 0) > 0) for _, t, o in run]
        if len(run) < 2 or 1 not in codes:
            continue
        known = [c for c in codes if c is not None]
        breaks = sum(1 for i, c in enumerate(known) if c == 0 and (i == 0 or known[i - 1] != 0))
        found.append((round(run[-1][0] - run[0][0], 2), len(run), breaks))
    return sorted(found, key=lambda t: tuple(map(str, t)))


def test_one_session_of_twenty_minutes(spark):
    session = S.derive_sessions(table(spark, [(m, 40.0, None) for m in (0, 5, 10, 15, 20)])).first()
    assert (session.duration_minutes, session.snapshot_count, session.break_count) == (20.0, 5, 0)
    assert session.started_at == BASE


def test_gap_must_exceed_fifteen_minutes(spark):
    together = table(spark, [(0, 1.0, None), (15, 1.0, None), (30, 1.0, None)])
    apart = table(spark, [(0, 1.0, None), (5, 1.0, None), (20.5, 1.0, None), (25, 1.0, None)])
    assert S.derive_sessions(together).count() == 1
    assert S.derive_sessions(apart).count() == 2


def test_breaks_and_unknown_rows(spark):
    one = table(spark, [(0, 5.0, 0.0), (5, 0.0, 0.0), (10, None, None), (15, 0.0, 0.0), (20, 5.0, 0.0)])
    assert S.derive_sessions(one).first().break_count == 1
    assert S.derive_sessions(table(spark, [(0, 0.0, 0.0), (5, None, None)])).count() == 0
    assert S.derive_sessions(table(spark, [(0, 5.0, 0.0)])).count() == 0


@pytest.mark.parametrize("chunk", [1, 3, 24])
def test_sessions_across_chunk_borders_match_brute_force(spark, chunk):
    import random

    rng = random.Random(chunk)
    minute, points = 0.0, []
    for _ in range(400):
        minute += rng.choice([1, 5, 14, 15, 16, 30, 100])
        points.append((minute, rng.choice([None, 0.0, 0.0, 3.0]), rng.choice([None, 0.0, 0.0, 2.0])))
    found = S.derive_sessions(table(spark, points), 15.0, chunk)
    assert rows(found, "duration_minutes", "snapshot_count", "break_count") == brute_sessions(points, 15)


def test_deviation_is_merged_across_chunks(spark):
    points = [(m * 10.0, float(m % 7) + 1, None) for m in range(30)]
    fine = S.derive_sessions(table(spark, points), 15.0, 1).first()
    coarse = S.derive_sessions(table(spark, points), 15.0, 240).first()
    assert fine.typing_speed_stdev == pytest.approx(coarse.typing_speed_stdev, abs=1e-9)
    assert fine.avg_typing_speed_cpm == pytest.approx(coarse.avg_typing_speed_cpm, abs=1e-9)


def score(spark, earlier, **given):
    fields = {"duration_minutes": 33.0, "breaks_per_hour": None, "avg_typing_speed_cpm": None, "typing_speed_stdev": None,
              "avg_mouse_activity_rate": None, "mouse_activity_stdev": None, "earlier_mean": earlier, **given}
    schema = ", ".join(f"{name} double" for name in fields)
    return S.score_parts(spark.createDataFrame([tuple(fields.values())], schema), "earlier_mean").first()


def test_success_score_parts(spark):
    assert score(spark, 30.0).success_score == 90.0
    assert score(spark, None, avg_typing_speed_cpm=50.0, typing_speed_stdev=5.0).success_score == 90.0
    assert score(spark, None, breaks_per_hour=2.0).success_score == 100.0
    assert score(spark, None, breaks_per_hour=0.0).success_score == 20.0
    assert score(spark, None, breaks_per_hour=6.0).success_score == 0.0
    full = score(spark, 30.0, avg_typing_speed_cpm=50.0, typing_speed_stdev=5.0, breaks_per_hour=2.0)
    assert full.success_score == 92.5 and full.success_score_basis.startswith("Scored from all 3 signals")
    empty = score(spark, None)
    assert empty.success_score is None and empty.success_score_basis.startswith("No scoring signal")


def test_scores_use_earlier_sessions_only(spark):
    points = [(m, 5.0, None) for m in (0, 10)] + [(m, 5.0, None) for m in (1000, 1010, 1020)]
    scored = S.success_scores(S.derive_sessions(table(spark, points)), chunk_hours=1).orderBy("started_at").collect()
    assert scored[0].earlier_mean_minutes is None and scored[1].earlier_mean_minutes == 10.0


def week(spark):
    monday = [(m, 5.0, None) for m in range(0, 25, 5)]
    wednesday = [(2 * 1440 + 60 + m, 5.0, None) for m in range(0, 35, 5)]
    return table(spark, monday + wednesday)


def test_weekly_report_has_seven_days(spark):
    telemetry = week(spark)
    found = S.weekly_minutes(S.derive_sessions(telemetry), telemetry.select("project_id").distinct(), "2026-01-07 15:00:00")
    days = {r.day_of_week: (r.total_minutes, r.session_count) for r in found.collect()}
    assert len(days) == 7 and days["Monday"] == (20.0, 1) and days["Wednesday"] == (30.0, 1)
    assert all(days[d] == (0.0, 0) for d in ("Tuesday", "Thursday", "Friday", "Saturday", "Sunday"))


def test_likelihood(spark):
    telemetry = week(spark)
    scored = S.success_scores(S.derive_sessions(telemetry))
    cold = S.session_likelihood(telemetry, scored.limit(0), "2026-01-07 15:00:00").first()
    assert cold.likelihood_score == 20.0 and cold.confidence == "none"
    warm = S.session_likelihood(telemetry, scored, "2026-01-07 10:20:00").first()
    assert warm.likelihood_score == round(0.6 * 100 + 0.4 * 50, 1) and warm.confidence == "low"
    assert warm.predicted_duration_minutes == 25.0


def test_recent_sessions_message(spark):
    telemetry = week(spark)
    projects = telemetry.select("project_id").distinct().unionByName(spark.createDataFrame([("other",)], "project_id string"))
    found = {r.project_id: r for r in S.recent_sessions(S.success_scores(S.derive_sessions(telemetry)), projects).collect()}
    assert found["p"].message == "Average of 2 session(s) - fewer than 5 exist so far."
    assert found["other"].message == "No sessions have been recorded yet." and found["other"].average_success_score is None


def test_current_state_merges_by_field(spark):
    names = list(T.METRICS)
    full = ["p", BASE, 0] + [float(i + 1) for i in range(len(names))] + ["hardware"]
    sparse = ["p", BASE + timedelta(minutes=5), 1] + [8.0 if n == "sleep_hours" else None for n in names] + [None]
    state = T.current_state(spark.createDataFrame([full, sparse], T.RAW_SCHEMA))
    row = state.first()
    assert row.sleep_hours == 8.0 and row.recorded_at == BASE + timedelta(minutes=5)
    assert row.typing_speed_cpm == names.index("typing_speed_cpm") + 1 and row.noise_level_db_source == "hardware"
    bare = T.current_readings(T.current_state(spark.createDataFrame([sparse], T.RAW_SCHEMA)))
    status = {r.field: (r.status, r.unit) for r in bare.collect()}
    assert status["sleep_hours"] == ("present", "hours") and status["noise_level_db"] == ("missing", "db")


def test_ranges_and_unknown_keys(spark):
    schema = "sleep_hours double, cpu_usage_percent double, temperature_celsius double, source string"
    data = [(8.0, 100.0, -300.0, None), (24.5, 1.0, 1.0, None), (1.0, 101.0, 1.0, None), (1.0, 1.0, 1.0, "guess"), (-1.0, None, None, None)]
    good, bad = T.validate_ranges(spark.createDataFrame(data, schema))
    assert good.count() == 1
    assert rows(bad, "rejected_field") == [("cpu_usage_percent",), ("sleep_hours",), ("sleep_hours",), ("source",)]
    bodies = spark.createDataFrame([('{"personal": {"sleep_hours": 1}}',), ('{"personal": {"mood": 1}, "extra": 2}',)], "body string")
    assert rows(bodies.select(F.sort_array(T.unknown_keys("body")).alias("k"))) == [(["extra", "mood"],), ([],)]


def test_readings_keep_the_environmental_source(spark):
    data = [("p", BASE, 1, 20.5, "hardware")]
    df = spark.createDataFrame(data, "project_id string, recorded_at timestamp, seq bigint, temperature_celsius double, source string")
    row = T.wrap_missing(df).first()
    assert row.environmental.temperature_celsius.asDict() == {"status": "present", "value": 20.5, "unit": "celsius", "source": "hardware"}
    assert row.environmental.noise_level_db.asDict() == {"status": "missing", "value": None, "unit": "db", "source": "hardware"}
    assert row.personal.sleep_hours.source is None


def test_sensor_lines(spark):
    lines = ['{"temperature_celsius": 24.3, "noise_level_db": 1}', '{"temperature_celsius": "24.3", "humidity_percent": true}',
             "[1, 2]", "5", "not json", "{}"]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    found = {r.i: r for r in T.parse_sensor_lines(df).collect()}
    assert found[0].temperature_celsius == 24.3 and found[0].noise_level_db == 1.0 and found[0].is_object
    assert found[1].is_object and found[1].temperature_celsius is None and found[1].humidity_percent is None
    assert [found[i].is_object for i in (2, 3, 4, 5)] == [False, False, False, True]


def test_counter_rate_across_chunks(spark):
    data = [("p", BASE + timedelta(hours=h), h, c) for h, c in enumerate([0, 3600 * 1024, 1000, 1000 + 7200 * 1024])]
    df = spark.createDataFrame(data, "project_id string, recorded_at timestamp, seq bigint, bytes bigint")
    found = [r.rate_kbps for r in T.counter_rate(df, "bytes", 1).orderBy("seq").collect()]
    assert found == [None, 1.0, 0.0, 2.0]


def test_deadlines(spark):
    data = [("1", "p", "  ", BASE), ("2", "p", " a ", BASE + timedelta(days=2)), ("3", "p", "b", BASE - timedelta(days=2))]
    df = T.add_deadlines(spark.createDataFrame(data, "deadline_id string, project_id string, title string, due_at timestamp"))
    assert [r.title for r in T.list_deadlines(df).collect()] == ["b", "a"]
    upcoming = T.upcoming_deadlines(df, "2026-01-05 10:00:00").collect()
    assert [(r.title, r.weekday) for r in upcoming] == [("a", "Monday")]
