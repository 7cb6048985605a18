"""Correlated issues, blast radius, hypotheses, drift insight and recommendations.

Lists that may grow with the data (files of a group, codes of a group, dependents) are
tables with one row per element; headers carry their counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from projectpulse.functions import fixed
from projectpulse.functions.scalars import band, priority_weight, rounded, severity_weight, strip
from projectpulse.operators import graph, inspection
from projectpulse.skew import cut_lineage

RUN = ["project_id", "run_id"]
REC_COLUMNS = [*RUN, "priority", "category", "title", "description"]


def same_file_groups(findings: DataFrame) -> DataFrame:
    """AG3: files with at least two findings."""
    grouped = findings.where(F.col("file_path").isNotNull()).groupBy(*RUN, F.col("file_path").alias("group_key")).agg(
        F.count("*").alias("finding_count"), F.sum(severity_weight("severity")).alias("weight")
    )
    summary = F.format_string(
        "%d findings are concentrated in '%s'; the file likely needs focused review rather than a "
        "series of independent fixes.",
        "finding_count",
        "group_key",
    )
    return grouped.where("finding_count >= 2").select(
        *RUN, F.lit("same_file").alias("basis"), "group_key", "finding_count",
        F.lit(1).cast("bigint").alias("file_count"), "weight", summary.alias("summary"),
    )


def code_totals(findings: DataFrame) -> DataFrame:
    """Findings, distinct files and weight per code.

    The first aggregate is keyed by (code, file), the second merges its rows per code, so a
    code with a third of all findings is combined in many tasks before it meets in one.
    """
    by_file = findings.groupBy(*RUN, "code", "file_path").agg(
        F.count("*").alias("n"), F.sum(severity_weight("severity")).alias("w")
    )
    return by_file.groupBy(*RUN, "code").agg(
        F.sum("n").alias("finding_count"), F.count("file_path").alias("file_count"), F.sum("w").alias("weight")
    )


def same_code_groups(findings: DataFrame) -> DataFrame:
    """AG4: codes seen in at least two distinct files."""
    summary = F.format_string(
        "'%s' recurs across %d files, suggesting a systemic pattern rather than an isolated issue.",
        "group_key",
        "file_count",
    )
    groups = code_totals(findings).where("file_count >= 2").withColumnRenamed("code", "group_key")
    return groups.select(
        *RUN, F.lit("same_code").alias("basis"), "group_key", "finding_count", "file_count", "weight",
        summary.alias("summary"),
    )


def correlation_groups(findings: DataFrame) -> DataFrame:
    """AG3 and AG4 in one table; SO1 is ``correlation_order``."""
    return same_file_groups(findings).unionByName(same_code_groups(findings))


def correlation_order(groups: DataFrame) -> DataFrame:
    """SO1"""
    return groups.orderBy(*RUN, F.desc("weight"), "basis", "group_key")


def group_members(groups: DataFrame, findings: DataFrame) -> DataFrame:
    """Distinct (code, file) pairs behind every group, as rows."""
    pairs = findings.select(*RUN, "code", "file_path").distinct()
    keyed = pairs.select(
        *RUN, "code", "file_path",
        F.explode(F.array(
            F.struct(F.lit("same_file").alias("basis"), F.col("file_path").alias("group_key")),
            F.struct(F.lit("same_code").alias("basis"), F.col("code").alias("group_key")),
        )).alias("g"),
    ).select(*RUN, "g.*", "code", "file_path")
    return keyed.join(groups.select(*RUN, "basis", "group_key"), [*RUN, "basis", "group_key"], "left_semi")


def _knowledge_columns(code: Column) -> dict[str, Column]:
    """JN11: exact code, then the marker prefix, then the generic entry.

    The table of explanations is a fixed handful of entries, so the lookup is a CASE inside
    the row and needs no join.
    """
    marker = F.substr(code, F.lit(len(fixed.MARKER_CODE_PREFIX) + 1))
    cause, explanation, steps = F, F, F
    for name, (c, e, s) in fixed.FINDING_KNOWLEDGE.items():
        cause, explanation = cause.when(code == name, F.lit(c)), explanation.when(code == name, F.lit(e))
        steps = steps.when(code == name, F.array(*[F.lit(x) for x in s]))
    is_marker = code.startswith(fixed.MARKER_CODE_PREFIX)
    c, e, s = fixed.MARKER_KNOWLEDGE
    filled = F.array(*[F.format_string(x, marker) if "%s" in x else F.lit(x) for x in s])
    generic = fixed.GENERIC_KNOWLEDGE
    return {
        "probable_cause": cause.when(is_marker, F.format_string(c, marker)).otherwise(generic[0]),
        "explanation": explanation.when(is_marker, F.format_string(e, marker)).otherwise(generic[1]),
        "suggested_next_steps": steps.when(is_marker, filled).otherwise(F.array(*[F.lit(x) for x in generic[2]])),
    }


def hypotheses(findings: DataFrame) -> DataFrame:
    """AG5, JN11: one explained row per finding code; its files are in ``code_files``."""
    totals = code_totals(findings)
    return totals.select(
        *RUN, F.col("code").alias("finding_code"), F.col("finding_count").alias("occurrence_count"), "file_count"
    ).withColumns(_knowledge_columns(F.col("finding_code")))


def code_files(findings: DataFrame) -> DataFrame:
    """AG5: distinct files of each code, as rows."""
    return findings.where(F.col("file_path").isNotNull()).select(*RUN, "code", "file_path").distinct()


def hypothesis_order(rows: DataFrame) -> DataFrame:
    """SO3"""
    return rows.orderBy(*RUN, F.desc("occurrence_count"), "finding_code")


def dependency_impact(findings: DataFrame, nodes: DataFrame, direct: DataFrame, reach: DataFrame) -> DataFrame:
    """AG6: blast radius of each file of the import graph that has findings; ``reach`` are the rows of ``graph.dependent_counts``."""
    own = findings.groupBy(*RUN, F.col("file_path").alias("node")).agg(
        F.count("*").alias("finding_count"), F.sum(severity_weight("severity")).alias("weight")
    )
    facts = (
        own.join(nodes.select(*RUN, "node").distinct(), [*RUN, "node"], "left_semi")
        .join(direct, [*RUN, "node"], "left")
        .join(reach, [*RUN, "node"], "left")
        .fillna(0, ["direct_dependents", "transitive_dependents"])
    )
    return _with_risk(facts)


def _with_risk(facts: DataFrame) -> DataFrame:
    return facts.select(
        *RUN, F.col("node").alias("file_path"), "direct_dependents", "transitive_dependents", "finding_count",
        _risk().alias("risk_score"),
    )


def _risk() -> Column:
    return rounded(F.col("transitive_dependents") + F.col("weight") * 0.5, 2)


def judged_files(files: DataFrame) -> DataFrame:
    """AG6 for one row per file that brings its edges (``graph.add_dependents_listed``), finding_count and weight; the risk of a file without findings is null."""
    return graph.add_dependents_listed(files).withColumn("risk_score", F.when(F.col("finding_count") > 0, _risk()))


def file_totals(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sums of ``judged_files`` that have the columns of ``inspection.with_sightings``, per run: (files and findings, drift).

    Files of a run that were seen last and next in the same runs are summed first, without any join.
    The drift has drift_count, added_count, removed_count, modified_count and high_impact_count of every run with changes.
    """
    risky = F.coalesce(F.col("risk_score") >= 2.0, F.lit(False))
    means = {"avg_c": "max_cyclomatic_complexity", "doc": "docstring_coverage", "avg_r": "risk_score"}
    sums = {"finding_count": F.sum("finding_count"), "weight": F.sum("weight"), "max_c": F.max("max_cyclomatic_complexity"), "max_r": F.max("risk_score")}
    cells = cut_lineage(files.groupBy(*RUN, "seen", "next_seen", "changed").agg(
        F.count("*").alias("files"), F.count_if(risky).alias("risky"), *[value.alias(name) for name, value in sums.items()],
        *[part(column).alias(f"{kind}_{name}") for name, column in means.items() for kind, part in (("sum", F.sum), ("n", F.count))],
    ))
    runs = cut_lineage(cells.groupBy(*RUN).agg(
        F.sum("files").alias("file_count"), *[F.sum(name).alias(name) for name in ("finding_count", "weight")],
        *[F.max(name).alias(name) for name in ("max_c", "max_r")],
        *[(F.sum(f"sum_{name}") / F.nullif(F.sum(f"n_{name}"), F.lit(0))).alias(name) for name in means],
    ))
    changes = inspection.drift_changes(cells.join(cut_lineage(inspection.run_steps(runs)), RUN))
    removed = F.col("code") == "FILE_REMOVED"
    counts = [F.sum(F.when(F.col("code") == f"FILE_{v.upper()}", F.col("files")).otherwise(0)).alias(f"{v}_count") for v in ("added", "removed", "modified")]
    hot = F.sum(F.when(removed, F.col("files")).otherwise(F.col("risky"))).alias("high_impact_count")
    return runs, changes.groupBy(*RUN).agg(F.sum("files").alias("drift_count"), *counts, hot)


def blast_radius(findings: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """AG6: the rows of ``dependency_impact`` straight from the edges; totals of findings travel with their file through the graph search.

    ``nodes`` (project_id, run_id, node) are the files of the import graph, each once.
    """
    key = [*RUN, "node"]
    totals = findings.groupBy(*RUN, F.col("file_path").alias("node")).agg(
        F.count("*").alias("finding_count"), F.sum(severity_weight("severity")).alias("weight")
    )
    return _with_risk(graph.add_dependents(totals.join(nodes.select(*key), key, "left_semi"), edges))


def impact_order(impact: DataFrame) -> DataFrame:
    """SO2"""
    return impact.orderBy(*RUN, F.desc("risk_score"), "file_path")


def high_impact_drift(drift: DataFrame, impact: DataFrame) -> DataFrame:
    """JN12: removed files, and added or modified ones with a risk of at least 2."""
    risky = impact.where("risk_score >= 2.0").select(*RUN, "file_path", F.lit(True).alias("risky"))
    named = drift.where((F.col("category") == "drift") & F.col("file_path").isNotNull())
    joined = named.join(risky, [*RUN, "file_path"], "left")
    kept = (F.col("code") == "FILE_REMOVED") | F.col("risky")
    return joined.where(kept).select(*RUN, "file_path").distinct()


def drift_insight(drift: DataFrame, runs: DataFrame, high_impact: DataFrame) -> DataFrame:
    """AG7: one row per run with drift; ``runs`` has (project_id, run_id, file_count)."""
    counts = drift.where(F.col("category") == "drift").groupBy(*RUN).agg(
        F.count("*").alias("drift_count"),
        *[F.count_if(F.col("code") == f"FILE_{v.upper()}").alias(f"{v}_count") for v in ("added", "removed", "modified")],
    )
    hot = high_impact.groupBy(*RUN).agg(F.count("*").alias("high_impact_count"))
    return insight_of_counts(counts.join(hot, RUN, "left").fillna(0, ["high_impact_count"]), runs)


def insight_of_counts(counts: DataFrame, runs: DataFrame) -> DataFrame:
    """AG7 from the drift counts of each run."""
    joined = counts.join(runs.select(*RUN, "file_count"), RUN)
    joined = joined.withColumn("churn_ratio", F.col("drift_count") / F.greatest("file_count", F.lit(1)))
    joined = joined.withColumn("churn_level", band("churn_ratio", fixed.CHURN_BANDS))
    summary = F.format_string(
        "%d of %d files drifted since the previous inspection (%d added, %d removed, %d modified), "
        "classified as %s churn.",
        "drift_count", "file_count", "added_count", "removed_count", "modified_count", "churn_level",
    )
    extra = F.format_string(
        " %d drifted file(s) also carry a significant dependency blast radius and warrant priority review.",
        "high_impact_count",
    )
    text = F.concat(summary, F.when(F.col("high_impact_count") > 0, extra).otherwise(""))
    return joined.select(
        *RUN, "churn_level", "added_count", "removed_count", "modified_count", "high_impact_count",
        rounded("churn_ratio", 4).alias("churn_ratio"), text.alias("summary"),
    )


def _rec(rows: DataFrame, priority: Column, category: str, title: Column, description: Column, ref: str) -> DataFrame:
    return rows.select(
        *RUN,
        priority.alias("priority"),
        F.lit(category).alias("category"),
        title.alias("title"),
        description.alias("description"),
        F.col(ref).alias("reference") if ref else F.lit(None).cast("string").alias("reference"),
    )


def correlation_recommendations(groups: DataFrame) -> DataFrame:
    """FN16; the group's rows in ``group_members`` are its codes and files."""
    title = F.when(
        F.col("basis") == "same_file", F.format_string("Review concentrated issues in '%s'", "group_key")
    ).otherwise(F.format_string("Address the recurring '%s' pattern", "group_key"))
    return _rec(groups, band("weight", fixed.PRIORITY_BANDS), "issue_correlation", title, F.col("summary"), "group_key")


def impact_recommendations(impact: DataFrame) -> DataFrame:
    """FN16: risk of at least 1; affected files are the file and its closure rows."""
    title = F.format_string("Prioritize fixes in '%s'", "file_path")
    description = F.format_string(
        "'%s' has %d finding(s) and %d internal file(s) depend on it transitively, so issues here can "
        "propagate further than an equivalent issue in an unused file.",
        "file_path", "finding_count", "transitive_dependents",
    )
    rows = impact.where("risk_score >= 1.0")
    return _rec(rows, band("risk_score", fixed.PRIORITY_BANDS), "dependency_impact", title, description, "file_path")


def hypothesis_recommendations(rows: DataFrame) -> DataFrame:
    """FN16: codes with two or more hits; affected files are in ``code_files``."""
    title = F.format_string("Investigate recurring '%s' findings", "finding_code")
    description = F.format_string(
        "%s %s Suggested next steps: %s", "probable_cause", "explanation", F.array_join("suggested_next_steps", "; ")
    )
    priority = F.when(F.col("occurrence_count") >= 5, "high").otherwise("medium")
    rows = rows.where("occurrence_count >= 2")
    return _rec(rows, priority, "debugging_assistance", title, description, "finding_code")


def drift_recommendations(insight: DataFrame) -> DataFrame:
    """FN16: skipped for low churn without impact."""
    hot, high = F.col("high_impact_count") > 0, F.col("churn_level") == "high"
    priority = F.when(hot & high, "critical").when(hot | high, "high").otherwise("medium")
    rows = insight.where((F.col("churn_level") != "low") | hot)
    title = F.lit("Review structural drift since the previous inspection")
    return _rec(rows, priority, "drift_significance", title, F.col("summary"), "")


def recommendations(groups: DataFrame, impact: DataFrame, hypo: DataFrame, insight: DataFrame) -> DataFrame:
    """SE5: the four sources in one table; SO4 is ``recommendation_order``."""
    return (
        correlation_recommendations(groups)
        .unionByName(impact_recommendations(impact))
        .unionByName(hypothesis_recommendations(hypo))
        .unionByName(drift_recommendations(insight))
    )


def recommendation_order(rows: DataFrame) -> DataFrame:
    """SO4"""
    return rows.orderBy(*RUN, F.desc(priority_weight("priority")), "category", "title")


def parse_recommendations(responses: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """FN17: JSON texts into valid recommendation rows, and error rows with a reason.

    ``responses`` has (project_id, run_id, body). A list or an object with the key
    ``recommendations`` is accepted; items need a legal priority and category and a
    non-blank title and description.
    """
    text = F.col(body)
    value = F.try_parse_json(text)
    kind = F.coalesce(F.schema_of_variant(value), F.lit(""))
    listed = F.try_variant_get(value, "$.recommendations", "variant")
    listed_kind = F.coalesce(F.schema_of_variant(listed), F.lit(""))
    is_list, is_object = kind.startswith("ARRAY"), kind.startswith("OBJECT")
    items = F.when(is_list, F.try_variant_get(value, "$", "array<variant>")).when(
        is_object & listed_kind.startswith("ARRAY"), F.try_variant_get(value, "$.recommendations", "array<variant>")
    )
    error = (
        F.when(value.isNull(), "response was not valid JSON")
        .when(~is_list & ~is_object, "response was neither a list nor an object")
        .when(is_object & (listed.isNull() | (listed_kind == "VOID")), "no 'recommendations' key")
        .when(is_object & ~listed_kind.startswith("ARRAY"), "'recommendations' was not a list")
    )

    def field(item: Column, name: str) -> Column:
        return strip(F.coalesce(F.try_variant_get(item, f"$.{name}", "string"), F.lit("")))

    def texts(item: Column, name: str) -> Column:
        return F.coalesce(F.try_variant_get(item, f"$.{name}", "array<string>"), F.array().cast("array<string>"))

    def parsed(item: Column) -> Column:
        return F.struct(
            F.lower(field(item, "priority")).alias("priority"),
            F.lower(field(item, "category")).alias("category"),
            field(item, "title").alias("title"),
            field(item, "description").alias("description"),
            texts(item, "supporting_finding_codes").alias("supporting_finding_codes"),
            texts(item, "affected_files").alias("affected_files"),
        )

    def valid(row: Column) -> Column:
        return (
            row.priority.isin(list(fixed.PRIORITY_WEIGHTS))
            & row.category.isin(fixed.RECOMMENDATION_CATEGORIES)
            & (row.title != "")
            & (row.description != "")
        )

    work = responses.withColumn("_items", items).withColumn("_error", error)
    work = work.withColumn("_rows", F.filter(F.transform("_items", parsed), valid))
    all_bad = (F.size("_items") > 0) & (F.size("_rows") == 0)
    work = work.withColumn("_error", F.coalesce("_error", F.when(all_bad, "no item was valid")))
    good = work.where(F.col("_error").isNull()).select(*RUN, F.explode("_rows").alias("r")).select(*RUN, "r.*")
    return good, work.where(F.col("_error").isNotNull()).select(*RUN, F.col("_error").alias("error"))


def _next_starts(ends: np.ndarray, limit: int) -> np.ndarray:
    """For a batch that opens with item i of a slice: the item that opens the next one (the number of items if none does)."""
    before = np.concatenate([[0], ends[:-1]])
    return np.maximum(np.searchsorted(ends, before + limit, side="right"), np.arange(len(ends)) + 1)


def _slice_summary(limit: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What a slice does to an open batch: by the item that closes it, the new batches and the fill at the slice's end."""

    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values("position")
        ends = np.cumsum(items["chars"].to_numpy())
        count, following = len(ends), _next_starts(ends, limit)
        opened, fill = np.zeros(count + 1, np.int64), np.zeros(count + 1, np.int64)
        for i in range(count - 1, -1, -1):
            after = following[i]
            opened[i] = 1 + opened[after]
            fill[i] = fill[after] if after < count else ends[-1] - (ends[i - 1] if i else 0)
        first = int(np.searchsorted(ends, limit, side="right")) + 1  # no open batch lasts beyond this item
        return items.iloc[:1][[*RUN, "slice"]].assign(
            total=int(ends[-1]), ends=[ends[:first].tolist()], opened=[opened[: min(first, count) + 1].tolist()], fill=[fill[: min(first, count) + 1].tolist()]
        )

    return run


def _slice_entries(limit: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Fill and number of the batch that is open when each slice of a run begins: its slices' summaries in turn."""

    def run(slices: pd.DataFrame) -> pd.DataFrame:
        slices = slices.sort_values("slice")
        entries, fill, batch = [], -1, 0  # no batch is open at first
        for row in slices.itertuples(index=False):
            entries.append((fill, batch))
            # the first item of a run opens batch 0, as if it closed an earlier one
            closing = 0 if fill < 0 else int(np.searchsorted(np.asarray(row.ends), limit - fill, side="right"))
            if closing < len(row.opened) - 1 or (closing < len(row.opened) and row.opened[closing]):
                batch, fill = batch + int(row.opened[closing]) - (fill < 0), int(row.fill[closing])
            else:
                fill += int(row.total)
        return slices[[*RUN, "slice"]].assign(fill=[f for f, _ in entries], batch=[b for _, b in entries])

    return run


def _number_items(limit: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values("position").reset_index(drop=True)
        ends, fill = np.cumsum(items["chars"].to_numpy()), int(items["fill"].iat[0])
        following, opens = _next_starts(ends, limit), np.zeros(len(items), np.int64)
        at = 0 if fill < 0 else int(np.searchsorted(ends, limit - fill, side="right"))
        while at < len(items):
            opens[at] = 1
            at = following[at]
        return items[[*RUN, "position", "chars"]].assign(batch=items["batch"].iat[0] + np.cumsum(opens) - (fill < 0))

    return run


def _number_runs(rows: pa.Table, whole_limit: int, limit: int) -> pa.RecordBatch:
    """Batch numbers of the items of many whole runs at once; rows are in order of run and position."""
    chars, count = rows["chars"].to_numpy(), rows.num_rows
    starts = np.concatenate([[0], _run_changes(rows)])
    sizes = np.diff(np.append(starts, count))
    first = np.repeat(starts, sizes)
    # the item that opens the next batch, or the first item of the next run, which opens one anyway
    jump = np.append(np.minimum(_next_starts(np.cumsum(chars), limit), first + np.repeat(sizes, sizes)), count)
    opens = np.zeros(count + 1, bool)
    opens[starts] = True
    while True:  # opening items 1, 2, 4, 8 ... batches ahead
        ahead = jump[np.flatnonzero(opens[:count])]
        if opens[ahead].all() or (ahead[~opens[ahead]] == count).all():
            break
        opens[ahead] = True
        jump = jump[jump]
    opened = np.cumsum(opens[:count])
    whole = np.repeat(np.add.reduceat(chars, starts) <= whole_limit, sizes)
    batch = np.where(whole, 0, opened - opened[first])
    columns = [*[rows[name].combine_chunks() for name in (*RUN, "position", "chars")], pa.array(batch, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=[*RUN, "position", "chars", "batch"])


def _run_changes(rows: pa.Table) -> np.ndarray:
    """Rows whose run is another than that of the row before."""
    last = rows.num_rows - 1
    changed = np.zeros(max(last, 0), bool)
    for name in RUN:
        column = rows[name].combine_chunks()
        changed |= ~pc.fill_null(pc.equal(column.slice(1), column.slice(0, max(last, 0))), False).to_numpy(zero_copy_only=False)
    return np.flatnonzero(changed) + 1


def _number_sorted(whole_limit: int, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Numbers all runs of a partition; the last run of an Arrow batch waits for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            rows = pa.Table.from_batches([*held, batch])
            changes = _run_changes(rows)
            if len(changes):
                yield _number_runs(rows.slice(0, int(changes[-1])), whole_limit, limit)
                rows = rows.slice(int(changes[-1]))
            held = rows.to_batches()
        if held and sum(map(len, held)):
            yield _number_runs(pa.Table.from_batches(held), whole_limit, limit)

    return run


def pack_batches(items: DataFrame, whole_limit: int = 6000, batch_limit: int = 4000, slice_items: int = 10_000) -> DataFrame:
    """WN11: number the batches of each run's items, filled greedily in order.

    ``items`` has (project_id, run_id, position, chars), positions from 0 on. A run of at most
    ``whole_limit`` characters is one batch. Runs of up to ``slice_items`` items are numbered many at
    once: the item after each possible batch is found for all of them by one search over running
    sums, and these pointers are followed by doubling. Longer runs are cut into slices of positions:
    a slice says, for every item that may close the batch open at its begin, how many batches
    follow and how full the last one is. These summaries, one row per slice, are composed in
    order, and then each slice numbers its own items.
    """
    items = cut_lineage(items.select(*RUN, F.col("position").cast("bigint").alias("position"), F.col("chars").cast("bigint").alias("chars")))
    long_runs = cut_lineage(items.groupBy(*RUN).agg(F.count("*").alias("_n")).where(F.col("_n") > slice_items).select(*RUN))
    kinds = dict(items.dtypes)
    run = ", ".join(f"{c} {kinds[c]}" for c in RUN)
    numbered_ddl = f"{run}, position bigint, chars bigint, batch bigint"
    short = items.join(long_runs, RUN, "left_anti").repartition(*RUN).sortWithinPartitions(*RUN, "position")
    short = short.mapInArrow(_number_sorted(whole_limit, batch_limit), numbered_ddl)
    if long_runs.isEmpty():
        return short
    large = items.join(long_runs, RUN, "left_semi").withColumn("slice", F.floor(F.col("position") / slice_items))
    totals = large.groupBy(*RUN).agg((F.sum("chars") <= whole_limit).alias("_whole"))
    summary = f"{run}, slice bigint, total bigint, ends array<bigint>, opened array<bigint>, fill array<bigint>"
    slices = large.groupBy(*RUN, "slice").applyInPandas(_slice_summary(batch_limit), summary)
    entries = slices.groupBy(*RUN).applyInPandas(_slice_entries(batch_limit), f"{run}, slice bigint, fill bigint, batch bigint")
    numbered = large.join(entries, [*RUN, "slice"]).groupBy(*RUN, "slice").applyInPandas(_number_items(batch_limit), numbered_ddl)
    # a long run of tiny items may still be one batch
    numbered = numbered.join(totals, RUN).withColumn("batch", F.when(F.col("_whole"), 0).otherwise(F.col("batch")).cast("bigint")).drop("_whole")
    return short.unionByName(numbered)
