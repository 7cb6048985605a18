"""Registered telemetry queries over ``events`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from projectpulse.catalog import inputs
from projectpulse.catalog.registry import query, shown, sql_round, sql_ts, table
from projectpulse.functions import fixed
from projectpulse.functions.scalars import band, hour_of_day, rounded, time_bucket_match
from projectpulse.operators import sessions as S
from projectpulse.operators import telemetry as T
from projectpulse.plans import reports

GAP, NOW = inputs.SESSION_GAP_MINUTES, inputs.NOW
SINCE = "2024-01-10 00:00:00"


def derived(spark, sf_dir):
    return S.derive_sessions(inputs.telemetry(spark, sf_dir), GAP)


def scored(spark, sf_dir):
    return S.success_scores(derived(spark, sf_dir))


def projects(spark, sf_dir):
    return inputs.telemetry(spark, sf_dir).select("project_id").distinct()


@query("sc2_ingest_telemetry", f"""
SELECT project_id, {sql_ts('recorded_at')} AS recorded_at, seq, CAST(count(*) FILTER (WHERE v IS NOT NULL) AS BIGINT) AS present,
  CAST(14 - count(*) FILTER (WHERE v IS NOT NULL) AS BIGINT) AS missing
FROM (SELECT project_id, recorded_at, seq, unnest([typing, mouse, cpu]) AS v FROM telemetry) GROUP BY ALL
""", ("telemetry",))
def _(spark, sf_dir):
    nested = T.wrap_missing(inputs.telemetry(spark, sf_dir))
    present = sum(
        F.when(F.col(f"{s}.{f}.status") == "present", 1).otherwise(0) for s, u in fixed.METRIC_SECTIONS.items() for f in u
    )
    return shown(nested.select("project_id", "recorded_at", "seq", present.cast("bigint").alias("present"),
                               (14 - present).cast("bigint").alias("missing")))


@query("sc3_telemetry_history", f"""
SELECT project_id, {sql_ts('recorded_at')} AS recorded_at, seq, round(typing, 6) AS typing_speed_cpm FROM telemetry
WHERE recorded_at >= TIMESTAMP '{SINCE}'
""", ("telemetry",))
def _(spark, sf_dir):
    rows = T.telemetry_history(inputs.telemetry(spark, sf_dir), SINCE)
    return shown(rows.select("project_id", "recorded_at", "seq", "typing_speed_cpm"))


@query("pr1_validate_ranges", """
SELECT seq, CASE WHEN value / 10 > 24 THEN 'sleep_hours' WHEN k * 1.2 > 100 THEN 'cpu_usage_percent'
  WHEN event_type = 'signup' THEN 'source' END AS rejected_field
FROM (SELECT event_id AS seq, value, event_type, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
""")
def _(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), (F.col("value") / 10).alias("sleep_hours"),
        (F.get_json_object("props", "$.k").cast("double") * 1.2).alias("cpu_usage_percent"),
        (F.col("value") - 400).alias("temperature_celsius"),
        F.when(F.col("event_type") == "signup", "guessed").otherwise("hardware").alias("source"),
    )
    good, bad = T.validate_ranges(raw)
    good = good.withColumn("rejected_field", F.lit(None).cast("string"))
    return good.unionByName(bad).select("seq", "rejected_field")


@query("pr2_wrap_missing", "\nUNION ALL ".join(
    f"SELECT project_id, seq, '{section}' AS section, '{name}' AS field, "
    + {"typing_speed_cpm": "CASE WHEN typing IS NULL THEN 'missing' ELSE 'present' END AS status, round(typing, 6) AS value",
       "mouse_activity_rate": "CASE WHEN mouse IS NULL THEN 'missing' ELSE 'present' END AS status, round(mouse, 6) AS value",
       "cpu_usage_percent": "CASE WHEN cpu IS NULL THEN 'missing' ELSE 'present' END AS status, round(cpu, 6) AS value",
       }.get(name, "'missing' AS status, CAST(NULL AS DOUBLE) AS value")
    + f", '{unit}' AS unit FROM telemetry"
    for section, units in fixed.METRIC_SECTIONS.items() for name, unit in units.items()
), ("telemetry",))
def _(spark, sf_dir):
    rows = T.readings_long(inputs.telemetry(spark, sf_dir))
    return shown(rows.select("project_id", "seq", "section", "field", "status", "value", "unit"))


@query("pr3_classify_activity", """
SELECT seq, CASE WHEN code IS NULL THEN 'unknown' WHEN code = 1 THEN 'active' ELSE 'inactive' END AS activity FROM activity
""", ("activity",))
def _(spark, sf_dir):
    return inputs.telemetry(spark, sf_dir).select("seq", T.classify_activity().alias("activity"))


@query("pr4_normalize_utc", f"""
SELECT o_orderkey, {sql_ts('o_orderdate')} AS naive, {sql_ts("o_orderdate - INTERVAL 330 MINUTE")} AS converted FROM orders
""")
def _(spark, sf_dir):
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("n"), F.concat(text, F.lit("+05:30")).alias("c"))
    return shown(rows.select("o_orderkey", T.normalize_utc("n").alias("naive"), T.normalize_utc("c").alias("converted")))


def _deadlines(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("deadline_id"),
        F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("project_id"),
        F.when(F.col("o_orderstatus") == "P", "  ").otherwise(F.concat(F.lit(" "), "o_orderpriority")).alias("title"),
        F.col("o_orderdate").cast("timestamp").alias("due_at"),
    )


@query("sc8_deadlines", f"""
SELECT o_orderkey AS deadline_id, 'customer-' || o_custkey AS project_id, o_orderpriority AS title, {sql_ts('o_orderdate')} AS due_at
FROM orders WHERE o_orderstatus <> 'P'
""")
def _(spark, sf_dir):
    return shown(T.list_deadlines(T.add_deadlines(_deadlines(spark, sf_dir))))


@query("pr12_upcoming_deadlines", f"""
SELECT o_orderkey AS deadline_id, 'customer-' || o_custkey AS project_id, o_orderpriority AS title, {sql_ts('o_orderdate')} AS due_at,
  dayname(TIMESTAMP '1998-01-07 15:00:00') AS weekday
FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate >= TIMESTAMP '1998-01-07 15:00:00'
""")
def _(spark, sf_dir):
    return shown(T.upcoming_deadlines(T.add_deadlines(_deadlines(spark, sf_dir)), "1998-01-07 15:00:00"))


@query("pr13_last_hour", f"""
SELECT project_id, count(*) AS snapshots, count(*) FILTER (WHERE code = 1) AS active_snapshots FROM activity
WHERE recorded_at >= TIMESTAMP '{NOW}' - INTERVAL 1 HOUR GROUP BY ALL
""", ("activity",))
def _(spark, sf_dir):
    return S.recent_activity(inputs.telemetry(spark, sf_dir), NOW)


@query("pr14_time_bucket_match", f"""
SELECT seq, isodow(recorded_at) = isodow(TIMESTAMP '{NOW}') AND least(d, 24 - d) <= 2 AS matches, {sql_round('h', 6)} AS hour_of_day
FROM (SELECT seq, recorded_at, h, abs(h - 15.0) AS d FROM (SELECT seq, recorded_at,
  hour(recorded_at) + minute(recorded_at) / 60.0 + second(recorded_at) / 3600.0 AS h FROM telemetry))
""", ("telemetry",))
def _(spark, sf_dir):
    rows = inputs.telemetry(spark, sf_dir)
    now = F.lit(NOW).cast("timestamp")
    return shown(rows.select("seq", time_bucket_match("recorded_at", now).alias("matches"), hour_of_day("recorded_at").alias("hour_of_day")))


@query("fn21_week_bounds", """
SELECT seq, strftime(date_trunc('week', recorded_at), '%Y-%m-%d') AS week_start,
  strftime(date_trunc('week', recorded_at) + INTERVAL 6 DAY, '%Y-%m-%d') AS week_end, dayname(recorded_at) AS weekday FROM telemetry
""", ("telemetry",))
def _(spark, sf_dir):
    monday = F.to_date(F.date_trunc("week", "recorded_at"))
    return shown(inputs.telemetry(spark, sf_dir).select(
        "seq", monday.alias("week_start"), F.date_add(monday, 6).alias("week_end"), F.date_format("recorded_at", "EEEE").alias("weekday")))


@query("wn1_derive_sessions", f"""
SELECT project_id, {sql_ts('started_at')} AS started_at, {sql_ts('ended_at')} AS ended_at, duration_minutes, snapshot_count FROM sessions
""", ("sessions",))
def _(spark, sf_dir):
    return shown(derived(spark, sf_dir).select("project_id", "started_at", "ended_at", "duration_minutes", "snapshot_count"))


@query("wn2_break_count", f"""
SELECT project_id, {sql_ts('started_at')} AS started_at, break_count, breaks_per_hour FROM sessions
""", ("sessions",))
def _(spark, sf_dir):
    return shown(derived(spark, sf_dir).select("project_id", "started_at", "break_count", "breaks_per_hour"))


@query("ag9_session_stats", f"""
SELECT project_id, {sql_ts('started_at')} AS started_at, {sql_round('avg_typing', 6)} AS avg_typing_speed_cpm,
  {sql_round('sd_typing', 6)} AS typing_speed_stdev, {sql_round('avg_mouse', 6)} AS avg_mouse_activity_rate,
  {sql_round('sd_mouse', 6)} AS mouse_activity_stdev FROM sessions
""", ("sessions",))
def _(spark, sf_dir):
    return shown(derived(spark, sf_dir).select(
        "project_id", "started_at", "avg_typing_speed_cpm", "typing_speed_stdev", "avg_mouse_activity_rate", "mouse_activity_stdev"))


@query("wn3_success_score", f"""
SELECT project_id, {sql_ts('started_at')} AS started_at, {sql_round('earlier_mean', 6)} AS earlier_mean_minutes, success_score FROM scored
""", ("scored",))
def _(spark, sf_dir):
    return shown(scored(spark, sf_dir).select("project_id", "started_at", "earlier_mean_minutes", "success_score"))


@query("fn22_score_parts", f"""
SELECT project_id, {sql_ts('started_at')} AS started_at, {sql_round('a', 6)} AS duration_score, {sql_round('b', 6)} AS consistency_score,
  {sql_round('c', 6)} AS break_score FROM scored
""", ("scored",))
def _(spark, sf_dir):
    return shown(scored(spark, sf_dir).select("project_id", "started_at", "duration_score", "consistency_score", "break_score"))


@query("fn23_score_basis", f"""
SELECT project_id, {sql_ts('started_at')} AS started_at, CASE len(used)
  WHEN 3 THEN 'Scored from all 3 signals (' || array_to_string(used, ', ') || ').'
  WHEN 0 THEN 'No scoring signal was available (no prior session to compare duration against, and no typing/mouse activity or break data on this session) - Success Score was left unscored rather than fabricated.'
  ELSE 'Scored from ' || len(used) || ' of 3 available signal(s) (' || array_to_string(used, ', ') || '), reweighted to sum to 1.0 since the remaining signal(s) were unavailable.' END AS basis
FROM (SELECT *, list_filter([CASE WHEN a IS NOT NULL THEN 'duration-closeness' END, CASE WHEN b IS NOT NULL THEN 'activity-consistency' END,
  CASE WHEN c IS NOT NULL THEN 'break-frequency-health' END], lambda x: x IS NOT NULL) AS used FROM scored)
""", ("scored",))
def _(spark, sf_dir):
    return shown(scored(spark, sf_dir).select("project_id", "started_at", F.col("success_score_basis").alias("basis")))


@query("wn4_last_n", f"""
SELECT project_id, {sql_ts('started_at')} AS started_at, CAST(r AS BIGINT) AS recency FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, ended_at DESC) AS r FROM sessions) WHERE r <= 5
""", ("sessions",))
def _(spark, sf_dir):
    return shown(S.last_sessions(derived(spark, sf_dir)).select("project_id", "started_at", "recency"))


@query("wn4_last_session", f"""
SELECT project_id, {sql_ts('started_at')} AS started_at, {sql_ts('ended_at')} AS ended_at, duration_minutes, success_score FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, ended_at DESC) AS r FROM scored) WHERE r = 1
""", ("scored",))
def _(spark, sf_dir):
    return shown(S.last_session(scored(spark, sf_dir)).drop("message"))


_CURRENT = {"typing_speed_cpm": "typing", "mouse_activity_rate": "mouse", "cpu_usage_percent": "cpu"}


@query("ag10_current_state", f"""
SELECT project_id, {sql_ts('max(recorded_at)')} AS recorded_at, """ + ", ".join(
    f"round(arg_max({c}, {{'a': recorded_at, 'b': seq}}) FILTER (WHERE {c} IS NOT NULL), 6) AS {n}" for n, c in _CURRENT.items()
) + ", CAST(NULL AS DOUBLE) AS sleep_hours FROM telemetry GROUP BY ALL", ("telemetry",))
def _(spark, sf_dir):
    state = T.current_state(inputs.telemetry(spark, sf_dir))
    return shown(state.select("project_id", "recorded_at", *_CURRENT, "sleep_hours"))


@query("ag11_weekly_minutes", f"""
SELECT p.project_id, strftime(d.day, '%Y-%m-%d') AS date, dayname(d.day) AS day_of_week,
  {sql_round('coalesce(sum(s.duration_minutes), 0)', 2)} AS total_minutes, count(s.project_id) AS session_count
FROM (SELECT DISTINCT project_id FROM telemetry) p
CROSS JOIN (SELECT CAST(unnest(generate_series(date_trunc('week', TIMESTAMP '{NOW}'), date_trunc('week', TIMESTAMP '{NOW}') + INTERVAL 6 DAY, INTERVAL 1 DAY)) AS DATE) AS day) d
LEFT JOIN sessions s ON s.project_id = p.project_id AND CAST(s.started_at AS DATE) = d.day GROUP BY ALL
""", ("sessions",))
def _(spark, sf_dir):
    return shown(S.weekly_minutes(derived(spark, sf_dir), projects(spark, sf_dir), NOW))


@query("jn13_week_spine", f"""
SELECT p.project_id, count(*) AS days, {sql_round('sum(coalesce(s.m, 0))', 2)} AS week_minutes
FROM (SELECT DISTINCT project_id FROM telemetry) p
CROSS JOIN (SELECT CAST(unnest(generate_series(date_trunc('week', TIMESTAMP '{NOW}'), date_trunc('week', TIMESTAMP '{NOW}') + INTERVAL 6 DAY, INTERVAL 1 DAY)) AS DATE) AS day) d
LEFT JOIN (SELECT project_id, CAST(started_at AS DATE) AS day, sum(duration_minutes) AS m FROM sessions GROUP BY ALL) s
  ON s.project_id = p.project_id AND s.day = d.day GROUP BY ALL
""", ("sessions",))
def _(spark, sf_dir):
    week = S.weekly_minutes(derived(spark, sf_dir), projects(spark, sf_dir), NOW)
    return week.groupBy("project_id").agg(F.count("*").alias("days"), rounded(F.sum("total_minutes"), 2).alias("week_minutes"))


@query("ag12_recent_sessions", f"""
SELECT p.project_id, coalesce(n, 0) AS sessions_considered, coalesce(array_to_string(l, ' '), '') AS success_scores, {sql_round('m', 2)} AS average_success_score,
  CASE WHEN coalesce(n, 0) = 0 THEN 'No sessions have been recorded yet.'
    WHEN k = 0 THEN n || ' recent session(s) considered, but none have a computed Success Score yet.'
    WHEN n < 5 THEN 'Average of ' || k || ' session(s) - fewer than 5 exist so far.'
    ELSE 'Average of the ' || k || ' most recent sessions.' END AS message
FROM (SELECT DISTINCT project_id FROM telemetry) p LEFT JOIN (
  SELECT project_id, count(*) AS n, count(success_score) AS k, avg(success_score) AS m, list(success_score ORDER BY r DESC) FILTER (WHERE success_score IS NOT NULL) AS l FROM (
    SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, ended_at DESC) AS r FROM scored) WHERE r <= 5 GROUP BY ALL) s
  USING (project_id)
""", ("scored",))
def _(spark, sf_dir):
    rows = S.recent_sessions(scored(spark, sf_dir), projects(spark, sf_dir))
    return rows.withColumn("success_scores", F.array_join(F.col("success_scores").cast("array<string>"), " "))


@query("ag13_session_likelihood", f"""
SELECT t.project_id, CASE WHEN coalesce(h.n, 0) = 0 THEN CASE WHEN NOT recent THEN 20.0 WHEN active THEN 70.0 ELSE 30.0 END
    ELSE {sql_round('0.6 * CASE WHEN active THEN 100 WHEN recent THEN 15 ELSE 0 END + 0.4 * (100.0 * h.m / h.n)', 1)} END AS likelihood_score,
  {sql_round('l.d', 2)} AS predicted_duration_minutes, {sql_round('l.s', 2)} AS predicted_success_score,
  CASE WHEN coalesce(h.n, 0) >= 20 THEN 'high' WHEN coalesce(h.n, 0) >= 5 THEN 'medium' WHEN coalesce(h.n, 0) >= 1 THEN 'low' ELSE 'none' END AS confidence
FROM (SELECT project_id, bool_or(recorded_at >= TIMESTAMP '{NOW}' - INTERVAL 1 HOUR) AS recent,
    bool_or(recorded_at >= TIMESTAMP '{NOW}' - INTERVAL 1 HOUR AND coalesce(code, 0) = 1) AS active FROM activity GROUP BY ALL) t
LEFT JOIN (SELECT project_id, count(*) AS n, count(*) FILTER (WHERE isodow(started_at) = isodow(TIMESTAMP '{NOW}') AND least(d, 24 - d) <= 2) AS m
  FROM (SELECT *, abs(hour(started_at) + minute(started_at) / 60.0 + second(started_at) / 3600.0 - 15.0) AS d FROM scored) GROUP BY ALL) h USING (project_id)
LEFT JOIN (SELECT project_id, avg(duration_minutes) AS d, avg(success_score) AS s FROM (
    SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, ended_at DESC) AS r FROM scored) WHERE r <= 5 GROUP BY ALL) l USING (project_id)
""", ("scored",))
def _(spark, sf_dir):
    return S.session_likelihood(inputs.telemetry(spark, sf_dir), scored(spark, sf_dir), NOW).drop("basis")


@query("pr10_confidence_bands", """
SELECT project_id, count(*) AS sessions, CASE WHEN count(*) >= 20 THEN 'high' WHEN count(*) >= 5 THEN 'medium' ELSE 'low' END AS confidence
FROM sessions GROUP BY ALL
""", ("sessions",))
def _(spark, sf_dir):
    counts = derived(spark, sf_dir).groupBy("project_id").agg(F.count("*").alias("sessions"))
    return counts.withColumn("confidence", band("sessions", fixed.CONFIDENCE_BANDS))


@query("wn5_counter_rate", f"""
SELECT seq, CASE WHEN e > 0 THEN {sql_round('greatest(counter - prev, 0) / e / 1024.0', 2)} END AS rate_kbps FROM (
  SELECT seq, counter, lag(counter) OVER w AS prev, (epoch_us(recorded_at) - epoch_us(lag(recorded_at) OVER w)) / 1000000.0 AS e
  FROM (SELECT 'user-' || user_id AS project_id, ts AS recorded_at, event_id AS seq, CAST(value * 1000000 AS BIGINT) AS counter FROM events)
  WINDOW w AS (PARTITION BY project_id ORDER BY recorded_at, seq))
""")
def _(spark, sf_dir):
    counters = table(spark, sf_dir, "events").select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("project_id"),
        F.col("ts").cast("timestamp").alias("recorded_at"), F.col("event_id").alias("seq"),
        F.round(F.col("value") * 1000000).cast("bigint").alias("counter"))
    return T.counter_rate(counters, "counter").select("seq", "rate_kbps")


@query("wn8_newest_first", f"""
SELECT project_id, {sql_ts('recorded_at')} AS recorded_at, seq, CAST(r AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY recorded_at DESC, seq DESC) AS r FROM telemetry) WHERE r <= 3
""", ("telemetry",))
def _(spark, sf_dir):
    return shown(T.newest_first(inputs.telemetry(spark, sf_dir), 3).select("project_id", "recorded_at", "seq", "rank"))


@query("ag29_activity_rate", f"""
SELECT project_id, {sql_ts("time_bucket(INTERVAL 30 SECOND, recorded_at, TIMESTAMP '1970-01-01')")} AS interval_start, count(*) AS n,
  {sql_round('count(*) / 30.0 * 60.0', 2)} AS rate_per_minute
FROM telemetry GROUP BY project_id, time_bucket(INTERVAL 30 SECOND, recorded_at, TIMESTAMP '1970-01-01')
""", ("telemetry",))
def _(spark, sf_dir):
    return shown(T.activity_rate(inputs.telemetry(spark, sf_dir)))


@query("sc4_parse_sensor_line", """
SELECT event_id, event_type <> 'error' AS is_object,
  CASE WHEN event_type IN ('click', 'view') THEN value END AS temperature_celsius,
  CASE WHEN event_type = 'view' THEN k END AS humidity_percent
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
""")
def _(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    line = (
        F.when(F.col("event_type") == "click", F.format_string('{"temperature_celsius": %s}', F.col("value").cast("string")))
        .when(F.col("event_type") == "view", F.format_string('{"temperature_celsius": %s, "humidity_percent": %s, "extra": 1}',
              F.col("value").cast("string"), "k"))
        .when(F.col("event_type") == "purchase", F.format_string('{"temperature_celsius": "%s", "humidity_percent": true}', F.col("value").cast("string")))
        .when(F.col("event_type") == "signup", F.lit("{}"))
        .otherwise(F.format_string("[%s]", "k"))
    )
    parsed = T.parse_sensor_lines(events.select("event_id", line.alias("line")))
    return parsed.select("event_id", "is_object", "temperature_celsius", "humidity_percent")


@query("rp6_telemetry_report", f"""
SELECT project_id, count(*) AS sessions, {sql_round('sum(duration_minutes)', 2)} AS total_minutes,
  CAST(sum(break_count) AS BIGINT) AS breaks, {sql_round('avg(success_score)', 4)} AS mean_score
FROM scored GROUP BY ALL
""", ("scored",))
def _(spark, sf_dir):
    return reports.telemetry_report(inputs.telemetry(spark, sf_dir), NOW, GAP)["totals"]


LATER = "2024-01-25 08:30:00"


@query("ud4_clock", f"""
SELECT project_id, count(*) AS snapshots, count(*) FILTER (WHERE code = 1) AS active_snapshots FROM activity
WHERE recorded_at >= TIMESTAMP '{LATER}' - INTERVAL 1 HOUR GROUP BY ALL
""", ("activity",))
def _(spark, sf_dir):
    return S.recent_activity(inputs.telemetry(spark, sf_dir), LATER)


@query("fn23_prediction_basis", f"""
SELECT t.project_id, CASE WHEN coalesce(h.n, 0) > 0 THEN 'Statistical estimate from ' || h.n || ' derived historical session(s): ' || h.m
    || ' started around this day-of-week/time-of-day, and the last-hour telemetry window ' || CASE WHEN active THEN 'shows' ELSE 'does not show' END
    || ' an active signal. Predicted duration/success score are the mean of the ' || least(h.n, 5) || ' most recent session(s).'
  WHEN recent THEN 'No historical sessions have been derived yet, so the likelihood is based only on whether the last-hour telemetry window shows an active typing/mouse signal - not a trained-model prediction.'
  ELSE 'No historical sessions have been derived yet and no telemetry was ingested in the last hour; this is a low-confidence baseline heuristic, not a trained-model prediction.' END AS basis
FROM (SELECT project_id, bool_or(recorded_at >= TIMESTAMP '{NOW}' - INTERVAL 1 HOUR) AS recent,
    bool_or(recorded_at >= TIMESTAMP '{NOW}' - INTERVAL 1 HOUR AND coalesce(code, 0) = 1) AS active FROM activity GROUP BY ALL) t
LEFT JOIN (SELECT project_id, count(*) AS n, count(*) FILTER (WHERE isodow(started_at) = isodow(TIMESTAMP '{NOW}') AND least(d, 24 - d) <= 2) AS m
  FROM (SELECT *, abs(hour(started_at) + minute(started_at) / 60.0 + second(started_at) / 3600.0 - 15.0) AS d FROM sessions) GROUP BY ALL) h USING (project_id)
""", ("sessions",))
def _(spark, sf_dir):
    return S.session_likelihood(inputs.telemetry(spark, sf_dir), scored(spark, sf_dir), NOW).select("project_id", "basis")
