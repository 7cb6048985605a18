"""Working sessions derived from telemetry, their scores and the reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from projectpulse.functions import fixed
from projectpulse.functions.scalars import as_col, band, clamp, rounded, time_bucket_match
from projectpulse.operators.telemetry import activity_code, last_hour
from projectpulse.skew import prefix_totals, time_chunk

SIGNALS = {"typing": "typing_speed_cpm", "mouse": "mouse_activity_rate"}
RECENT_SESSIONS = 5


def _gap_exceeds(later: Column, earlier: Column, minutes: float) -> Column:
    return F.unix_micros(later) - F.unix_micros(earlier) > F.lit(int(minutes * 60_000_000))


def _fragments(telemetry: DataFrame, max_gap: float, chunk_hours: int) -> DataFrame:
    """Gap-free stretches inside one (project, chunk), with mergeable statistics."""
    rows = telemetry.select(
        "project_id",
        "recorded_at",
        "seq",
        time_chunk("recorded_at", chunk_hours).alias("chunk"),
        activity_code().alias("code"),
        *[F.col(c).alias(s) for s, c in SIGNALS.items()],
    )
    ordered = Window.partitionBy("project_id", "chunk").orderBy("recorded_at", "seq")
    before = F.lag("recorded_at").over(ordered)
    opens = before.isNull() | _gap_exceeds(F.col("recorded_at"), before, max_gap)
    rows = rows.withColumn("opens", opens.cast("int")).withColumn("rn", F.row_number().over(ordered))
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("fragment", F.sum("opens").over(so_far))
    known = F.when(F.col("code").isNotNull(), F.struct("fragment", "code"))
    rows = rows.withColumn("seen", F.last(known, ignorenulls=True).over(earlier))
    continues = F.coalesce((F.col("seen.fragment") == F.col("fragment")) & (F.col("seen.code") == 0), F.lit(False))
    break_starts = (F.col("code") == 0) & ~continues
    # order number and activity code packed into one long: min/max give the code of the
    # first/last known row and stay in a hash aggregate
    packed = F.when(F.col("code").isNotNull(), F.col("rn") * 2 + F.col("code"))
    statistics = [
        stat
        for s in SIGNALS
        for stat in (
            F.count(s).alias(f"{s}_n"),
            F.avg(s).alias(f"{s}_mean"),
            (F.var_pop(s) * F.count(s)).alias(f"{s}_m2"),
        )
    ]
    return rows.groupBy("project_id", "chunk", "fragment").agg(
        F.min("recorded_at").alias("started_at"),
        F.max("recorded_at").alias("ended_at"),
        F.count("*").alias("snapshot_count"),
        F.count_if(F.col("code") == 1).alias("active_count"),
        F.count_if(break_starts).alias("break_count"),
        (F.min(packed) % 2).alias("first_code"),
        (F.max(packed) % 2).alias("last_code"),
        *statistics,
    )


def activity_runs(telemetry: DataFrame, max_gap_minutes: float = 15.0, chunk_hours: int = 24) -> DataFrame:
    """WN1 before qualification: runs of snapshots whose gaps never exceed the limit.

    Only the first and the last stretch of a time slice can touch another slice. They meet
    in one small bucket per project; all others stay in a bucket of their own slice, so the
    second shuffle carries stretches, not rows, and a hot project is spread over its slices.
    """
    parts = _fragments(telemetry, max_gap_minutes, chunk_hours)
    in_chunk = Window.partitionBy("project_id", "chunk")
    at_edge = (F.col("fragment") == 1) | (F.col("fragment") == F.max("fragment").over(in_chunk))
    parts = parts.withColumn("bucket", F.when(at_edge, F.lit(None)).otherwise(F.col("chunk")))
    ordered = Window.partitionBy("project_id", "bucket").orderBy("started_at", "ended_at")
    before = F.lag("ended_at").over(ordered)
    opens = before.isNull() | _gap_exceeds(F.col("started_at"), before, max_gap_minutes)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(so_far))
    cells = ["project_id", "bucket", "run"]
    in_run = Window.partitionBy(*cells).orderBy("started_at", "ended_at")
    seen = F.last("last_code", ignorenulls=True).over(in_run.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("joined", F.coalesce((F.col("first_code") == 0) & (seen == 0), F.lit(False)))
    whole = Window.partitionBy(*cells)
    for s in SIGNALS:
        mean = F.sum(F.col(f"{s}_n") * F.col(f"{s}_mean")).over(whole) / F.nullif(F.sum(f"{s}_n").over(whole), F.lit(0))
        parts = parts.withColumn(f"{s}_all", mean)
    merged = []
    for s in SIGNALS:
        shift = F.col(f"{s}_mean") - F.col(f"{s}_all")
        squares = F.sum(F.col(f"{s}_m2") + F.col(f"{s}_n") * shift * shift)
        n = F.sum(f"{s}_n")
        merged.append(F.max(f"{s}_all").alias(f"{s}_mean"))
        merged.append(F.when(n >= 2, F.sqrt(squares / (n - 1))).alias(f"{s}_stdev"))
    return parts.groupBy(*cells).agg(
        F.min("started_at").alias("started_at"),
        F.max("ended_at").alias("ended_at"),
        F.sum("snapshot_count").alias("snapshot_count"),
        F.sum("active_count").alias("active_count"),
        (F.sum("break_count") - F.count_if("joined")).alias("break_count"),
        *merged,
    ).drop("bucket", "run")


def derive_sessions(telemetry: DataFrame, max_gap_minutes: float = 15.0, chunk_hours: int = 24) -> DataFrame:
    """WN1, WN2, AG9: runs with at least two snapshots, one of them active."""
    return qualified(activity_runs(telemetry, max_gap_minutes, chunk_hours))


def qualified(runs: DataFrame) -> DataFrame:
    """WN1: sessions among the runs, with duration and breaks per hour."""
    minutes = (F.unix_micros("ended_at") - F.unix_micros("started_at")) / 60_000_000.0
    kept = runs.where((F.col("snapshot_count") >= 2) & (F.col("active_count") >= 1)).withColumn("_m", minutes)
    per_hour = F.when(F.col("_m") > 0, rounded(F.col("break_count") / (F.col("_m") / 60.0), 4))
    return kept.select(
        "project_id",
        "started_at",
        "ended_at",
        rounded("_m", 2).alias("duration_minutes"),
        "snapshot_count",
        "break_count",
        per_hour.alias("breaks_per_hour"),
        F.col("typing_mean").alias("avg_typing_speed_cpm"),
        F.col("typing_stdev").alias("typing_speed_stdev"),
        F.col("mouse_mean").alias("avg_mouse_activity_rate"),
        F.col("mouse_stdev").alias("mouse_activity_stdev"),
    )


def duration_closeness(duration, earlier_mean) -> Column:
    """FN22: 100 at the mean of the earlier sessions, 0 at twice or none of it."""
    deviation = clamp(F.abs(1.0 - as_col(duration) / as_col(earlier_mean)), 0.0, 1.0)
    return F.when(as_col(earlier_mean) > 0, 100.0 * (1.0 - deviation))


def consistency(mean, stdev) -> Column:
    """FN22: 100 minus the coefficient of variation in percent."""
    usable = (as_col(mean) > 0) & as_col(stdev).isNotNull()
    return F.when(usable, 100.0 * (1.0 - clamp(as_col(stdev) / as_col(mean), 0.0, 1.0)))


def break_health(per_hour) -> Column:
    """FN22: best at two breaks an hour."""
    return F.when(
        as_col(per_hour).isNotNull(), clamp(100.0 - 40.0 * F.abs(as_col(per_hour) - 2.0), 0.0, 100.0)
    )


def _mean_of_present(*parts: Column) -> Column:
    present = F.array_compact(F.array(*parts))
    total = F.aggregate(present, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(present) > 0, total / F.size(present))


def score_parts(sessions: DataFrame, earlier_mean: str) -> DataFrame:
    """WN3 on given columns: the three parts, their weighted mean and its explanation."""
    parts = sessions.withColumns({
        "duration_score": duration_closeness("duration_minutes", earlier_mean),
        "consistency_score": _mean_of_present(
            consistency("avg_typing_speed_cpm", "typing_speed_stdev"),
            consistency("avg_mouse_activity_rate", "mouse_activity_stdev"),
        ),
        "break_score": break_health("breaks_per_hour"),
    })
    weights = {"duration_score": 0.40, "consistency_score": 0.35, "break_score": 0.25}
    names = {
        "duration_score": "duration-closeness",
        "consistency_score": "activity-consistency",
        "break_score": "break-frequency-health",
    }
    total = sum(F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in weights.items())
    value = sum(F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items())
    used = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(n)) for c, n in names.items()]))
    parts = parts.withColumn("_used", used)
    count, listed = F.size("_used"), F.array_join("_used", ", ")
    basis = (
        F.when(count == 3, F.format_string("Scored from all 3 signals (%s).", listed))
        .when(
            count > 0,
            F.format_string(
                "Scored from %d of 3 available signal(s) (%s), reweighted to sum to 1.0 since the "
                "remaining signal(s) were unavailable.",
                count,
                listed,
            ),
        )
        .otherwise(
            "No scoring signal was available (no prior session to compare duration against, and no "
            "typing/mouse activity or break data on this session) - Success Score was left unscored "
            "rather than fabricated."
        )
    )
    return parts.withColumns({
        "success_score": F.when(count > 0, rounded(value / total, 2)),
        "success_score_basis": basis,
    }).drop("_used")


def success_scores(sessions: DataFrame, chunk_hours: int = 24 * 30) -> DataFrame:
    """WN3: each session against the mean duration of the project's earlier sessions."""
    history = prefix_totals(
        sessions,
        ["project_id"],
        ["started_at", "ended_at"],
        time_chunk("started_at", chunk_hours),
        {"_minutes": F.col("duration_minutes"), "_count": F.lit(1)},
    )
    mean = F.when(F.col("_count") > 0, F.col("_minutes") / F.col("_count"))
    scored = score_parts(history.withColumn("earlier_mean_minutes", mean), "earlier_mean_minutes")
    return scored.drop("_minutes", "_count")


def last_sessions(sessions: DataFrame, n: int = RECENT_SESSIONS) -> DataFrame:
    """WN4: the n newest sessions of each project."""
    order = Window.partitionBy("project_id").orderBy(F.desc("started_at"), F.desc("ended_at"))
    return sessions.withColumn("recency", F.row_number().over(order)).where(F.col("recency") <= n)


def last_session(scored: DataFrame) -> DataFrame:
    """The newest session of each project and its sentence."""
    clause = F.when(
        F.col("success_score").isNotNull(), F.format_string(" with a Success Score of %.1f.", "success_score")
    ).otherwise(" (Success Score unavailable - see success_score_basis).")
    message = F.concat(F.format_string("Last session ran %.1f minute(s)", "duration_minutes"), clause)
    return last_sessions(scored, 1).select(
        "project_id", "started_at", "ended_at", "duration_minutes", "success_score", message.alias("message")
    )


def recent_sessions(scored: DataFrame, projects: DataFrame) -> DataFrame:
    """AG12: mean score of up to five newest sessions, with an honest sentence."""
    recent = last_sessions(scored).groupBy("project_id").agg(
        F.count("*").alias("sessions_considered"),
        F.count("success_score").alias("scored"),
        F.avg("success_score").alias("mean"),
        # at most five elements, oldest first
        F.array_sort(F.collect_list(F.when(
            F.col("success_score").isNotNull(), F.struct((-F.col("recency")).alias("o"), F.col("success_score").alias("s"))
        ))).alias("listed"),
    )
    considered, scored_n = F.col("sessions_considered"), F.col("scored")
    message = (
        F.when(considered == 0, "No sessions have been recorded yet.")
        .when(
            scored_n == 0,
            F.format_string("%d recent session(s) considered, but none have a computed Success Score yet.", considered),
        )
        .when(
            considered < RECENT_SESSIONS,
            F.format_string(f"Average of %d session(s) - fewer than {RECENT_SESSIONS} exist so far.", scored_n),
        )
        .otherwise(F.format_string("Average of the %d most recent sessions.", scored_n))
    )
    return (
        projects.select("project_id")
        .join(recent, "project_id", "left")
        .fillna(0, ["sessions_considered", "scored"])
        .select(
            "project_id",
            considered,
            F.coalesce(F.transform("listed", lambda x: x.s), F.array().cast("array<double>")).alias("success_scores"),
            rounded("mean", 2).alias("average_success_score"),
            message.alias("message"),
        )
    )


def weekly_minutes(sessions: DataFrame, projects: DataFrame, now) -> DataFrame:
    """AG11, JN13: Monday to Sunday of the week of ``now``, zeros where nothing happened.

    The seven days are seven conditional sums of one aggregate, so the spine needs no join
    of its own; sessions outside the week never reach the shuffle.
    """
    monday = F.to_date(F.date_trunc("week", F.lit(now).cast("timestamp")))
    day = F.to_date("started_at")
    offset = F.datediff(day, monday)
    in_week = sessions.where((day >= monday) & (day <= F.date_add(monday, 6)))
    totals = []
    for i in range(7):
        totals.append(F.sum(F.when(offset == i, F.col("duration_minutes"))).alias(f"m{i}"))
        totals.append(F.count_if(offset == i).alias(f"n{i}"))
    by_project = projects.select("project_id").join(in_week.groupBy("project_id").agg(*totals), "project_id", "left")
    days = F.array(*[
        F.struct(
            F.date_add(monday, i).alias("date"),
            F.date_format(F.date_add(monday, i), "EEEE").alias("day_of_week"),
            rounded(F.coalesce(F.col(f"m{i}"), F.lit(0.0)), 2).alias("total_minutes"),
            F.coalesce(F.col(f"n{i}"), F.lit(0)).alias("session_count"),
        )
        for i in range(7)
    ])
    return by_project.select("project_id", F.explode(days).alias("d")).select("project_id", "d.*")


def session_likelihood(telemetry: DataFrame, scored: DataFrame, now) -> DataFrame:
    """AG13: how likely a session is about to start, and what it may look like."""
    moment = F.lit(now).cast("timestamp")
    recent = F.col("recorded_at") >= moment - F.expr("INTERVAL 1 HOUR")
    signals = telemetry.groupBy("project_id").agg(
        F.bool_or(recent).alias("has_recent"),
        F.bool_or(recent & (F.coalesce(activity_code(), F.lit(0)) == 1)).alias("active"),
    )
    history = scored.groupBy("project_id").agg(
        F.count("*").alias("sessions"),
        F.count_if(time_bucket_match("started_at", moment)).alias("matching"),
    )
    tail = last_sessions(scored).groupBy("project_id").agg(
        F.count("*").alias("recent"),
        F.avg("duration_minutes").alias("duration"),
        F.avg("success_score").alias("score"),
    )
    facts = signals.join(history, "project_id", "left").join(tail, "project_id", "left")
    facts = facts.fillna(0, ["sessions", "matching", "recent"])
    cold = F.when(~F.col("has_recent"), 20.0).when(F.col("active"), 70.0).otherwise(30.0)
    activity = F.when(F.col("active"), 100.0).when(F.col("has_recent"), 15.0).otherwise(0.0)
    warm = rounded(0.6 * activity + 0.4 * (100.0 * F.col("matching") / F.col("sessions")), 1)
    basis = (
        F.when(
            F.col("sessions") > 0,
            F.format_string(
                "Statistical estimate from %d derived historical session(s): %d started around this "
                "day-of-week/time-of-day, and the last-hour telemetry window %s an active signal. "
                "Predicted duration/success score are the mean of the %d most recent session(s).",
                F.col("sessions"),
                F.col("matching"),
                F.when(F.col("active"), "shows").otherwise("does not show"),
                F.col("recent"),
            ),
        )
        .when(
            F.col("has_recent"),
            "No historical sessions have been derived yet, so the likelihood is based only on whether "
            "the last-hour telemetry window shows an active typing/mouse signal - not a trained-model "
            "prediction.",
        )
        .otherwise(
            "No historical sessions have been derived yet and no telemetry was ingested in the last "
            "hour; this is a low-confidence baseline heuristic, not a trained-model prediction."
        )
    )
    return facts.select(
        "project_id",
        F.when(F.col("sessions") == 0, cold).otherwise(warm).alias("likelihood_score"),
        rounded("duration", 2).alias("predicted_duration_minutes"),
        rounded("score", 2).alias("predicted_success_score"),
        band("sessions", fixed.CONFIDENCE_BANDS).alias("confidence"),
        basis.alias("basis"),
    )


def recent_activity(telemetry: DataFrame, now) -> DataFrame:
    """PR13: per project, the number of snapshots in the last hour and the active ones."""
    return last_hour(telemetry, now).groupBy("project_id").agg(
        F.count("*").alias("snapshots"), F.count_if(activity_code() == 1).alias("active_snapshots")
    )
