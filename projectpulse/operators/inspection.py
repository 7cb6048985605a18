"""File inventories, code metrics, findings, drift and health of inspected projects.

Findings share one schema: project_id, run_id, category, severity, code, message,
file_path, line. All analyzers return it, so they can be united by name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from projectpulse.functions import files as ff
from projectpulse.functions import fixed
from projectpulse.functions.scalars import as_col, band, clamp, rounded, severity_weight
from projectpulse.skew import cut_lineage
from projectpulse.sources import code

RUN = ["project_id", "run_id"]
FINDING_COLUMNS = [*RUN, "category", "severity", "code", "message", "file_path", "line"]


def _finding(category: str, severity, code, message, path, line=None, **extra) -> list[Column]:
    return [
        *[F.col(c) for c in RUN],
        F.lit(category).alias("category"),
        (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"),
        (code if isinstance(code, Column) else F.lit(code)).alias("code"),
        message.alias("message"),
        as_col(path).alias("file_path"),
        (F.lit(None) if line is None else as_col(line)).cast("bigint").alias("line"),
    ]


def file_records(contents: DataFrame, max_bytes: int = fixed.MAX_CONTENT_BYTES) -> DataFrame:
    """SC1 on rows (project_id, run_id, path, size_bytes, content): the file inventory."""
    return contents.select(*_record_columns(max_bytes))


def _record_columns(max_bytes: int = fixed.MAX_CONTENT_BYTES) -> list[Column]:
    small = F.col("content").isNotNull() & (F.col("size_bytes") <= max_bytes)
    return [
        *[F.col(c) for c in RUN],
        F.col("path").alias("relative_path"),
        F.col("size_bytes"),
        F.when(small, ff.line_count("content")).otherwise(0).cast("bigint").alias("line_count"),
        ff.extension("path").alias("extension"),
        F.when(small, ff.sha256("content")).otherwise("").alias("content_hash"),
    ]


def discover_documents(inventory: DataFrame) -> DataFrame:
    """SC11: readmes, manifests and non-test Python sources."""
    kind = ff.document_kind("relative_path")
    return inventory.withColumn("kind", kind).where(F.col("kind").isNotNull())


def marker_scan(sources: DataFrame, markers: dict[str, str] | None = None, all_files: bool = False) -> DataFrame:
    """JN15, WN12: one finding per line and marker that occurs on it.

    ``sources`` has (project_id, run_id, path, text). Patterns are tried on single lines, inside
    the row of their file; only lines with a hit become rows.
    """
    markers = fixed.FORBIDDEN_MARKERS if markers is None else markers
    if not all_files:
        sources = sources.where(ff.is_python_source("path"))
    return _marker_findings(_marker_hits(sources, list(markers.items())))


def _marked_lines(text, markers: Sequence[tuple[str, str]]) -> Column:
    """Lines with markers as a list of (no, codes): every pattern is tried on every line.

    Where every pattern has a certain literal, a text that holds none of them is not split: the list is null.
    """

    def codes(line: Column) -> Column:
        none = F.lit(None).cast("string")
        return F.array_compact(F.array(none, *[F.when(line.rlike(pattern), F.lit(name)) for name, pattern in markers]))

    text = as_col(text)
    numbered = F.transform(ff.lines_of(text), lambda line, at: F.struct((at + 1).alias("no"), codes(line).alias("codes")))
    lines = F.filter(numbered, lambda line: F.size(line.codes) > 0)
    literals = sorted({required_literal(pattern) for _, pattern in markers})
    if not literals or not all(literal and literal.isascii() for literal in literals):  # other letters change with their surroundings
        return lines
    held = F.lit(False)
    for literal in literals:
        held = held | F.contains(F.lower(text), F.lit(literal))
    return F.when(held, lines)


def _marker_hits(sources: DataFrame, markers: Sequence[tuple[str, str]]) -> DataFrame:
    """(path, no, marker): every pattern tried on every line."""
    return _exploded_hits(sources.select(*RUN, "path", _marked_lines("text", markers).alias("marked")))


def _exploded_hits(files: DataFrame) -> DataFrame:
    lines = files.select(*RUN, "path", F.explode("marked").alias("line"))
    return lines.select(*RUN, "path", F.col("line.no").alias("no"), F.explode("line.codes").alias("marker"))


def file_scan(contents: DataFrame, markers: dict[str, str] | None = None) -> DataFrame:
    """SC1, SC12 and JN15 in one pass over (project_id, run_id, path, size_bytes, content).

    One row per file with its record (``file_records``), its code facts and its lines with markers as lists;
    ``inventory_of``, ``facts_of`` and ``marker_findings_of`` take them apart, so contents are read and parsed once.
    """
    chosen = list((fixed.FORBIDDEN_MARKERS if markers is None else markers).items())
    # null where the bytes are not UTF-8: such a file has a finding of its own, and the run goes on
    texts = contents.select("*", F.when(ff.is_python_source("path"), F.try_validate_utf8(F.col("content").cast("string"))).alias("text"))
    parsed = F.when(ff.extension("path") == "py", F.col("content")).alias("content")
    return code.with_facts(texts.select(*_record_columns(), _marked_lines("text", chosen).alias("marked"), parsed))


def inventory_of(scan: DataFrame) -> DataFrame:
    return scan.drop("marked", "facts")


def facts_of(scan: DataFrame) -> DataFrame:
    return scan.select(*RUN, F.col("relative_path").alias("path"), F.inline("facts"))


def marker_findings_of(scan: DataFrame) -> DataFrame:
    return _marker_findings(_exploded_hits(scan.withColumnRenamed("relative_path", "path")))


def _marker_findings(hits: DataFrame) -> DataFrame:
    message = F.format_string(
        "Line contains a prohibited '%s' marker; Article 30 forbids placeholder/incomplete code.", "marker"
    )
    code = F.concat(F.lit(fixed.MARKER_CODE_PREFIX), "marker")
    return hits.select(*_finding("architecture", "warning", code, message, "path", "no"))


def required_literal(pattern: str) -> str:
    """The longest run of characters, in lower case, that every match of a pattern holds; empty if none is certain.

    Constructs that another regular expression library reads differently, or not at all, count as
    unknown: then the pattern has no literal and is tried on every line.
    """
    try:
        parsed = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return ""
    if parsed.state.flags & ~(re.IGNORECASE | re.MULTILINE | re.DOTALL | re.UNICODE):
        return ""
    best, run = "", ""

    def walk(items) -> None:
        nonlocal best, run
        for kind, value in items:
            name = str(kind)
            if name == "LITERAL":
                run += chr(value)
            elif name == "SUBPATTERN":
                walk(value[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
                walk(value[2])
                cut()
            elif name != "AT":  # a border has no width
                cut()

    def cut() -> None:
        nonlocal best, run
        best, run = max(best, run, key=len), ""

    walk(parsed)
    cut()
    return best.lower()


def _marker_candidates(markers: list[tuple[str, str, str]], batch_bytes: int = 8 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines on which literals of markers (name, pattern, literal) occur, by one automaton over all literals.

    A line is handed on once, with all its markers, and a batch of lines once it holds ``batch_bytes``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        by_literal: dict[str, list[int]] = {}
        for number, (_, _, literal) in enumerate(markers):
            by_literal.setdefault(literal, []).append(number)
        found = ahocorasick.Automaton()
        for literal, numbers in by_literal.items():
            found.add_word(literal, numbers)
        found.make_automaton()
        pair = pa.struct([("marker", pa.string()), ("pattern", pa.string())])
        listed = pa.StructArray.from_arrays([pa.array([m[k] for m in markers], pa.string()) for k in (0, 1)], fields=list(pair))

        def handed_on(batch: pa.RecordBatch, rows: list, numbers: list, lines: list, chosen: list) -> pa.RecordBatch:
            at = pa.array(rows, pa.int64())
            ends = pa.array(np.cumsum([0, *map(len, chosen)]), pa.int32())
            hits = pa.ListArray.from_arrays(ends, listed.take(pa.array([n for own in chosen for n in own], pa.int64())))
            return pa.RecordBatch.from_arrays(
                [*[batch[name].take(at) for name in (*RUN, "path")], pa.array(numbers, pa.int32()), pa.array(lines, pa.string()), hits],
                names=[*RUN, "path", "no", "line", "hits"],
            )

        for batch in batches:
            held, size = ([], [], [], []), 0
            for row, texts in enumerate(batch["lines"]):
                for at, line in enumerate(texts.as_py() or ()):
                    hits = {number for _, own in found.iter((line or "").lower()) for number in own}
                    if not hits:
                        continue
                    for column, value in zip(held, (row, at + 1, line, sorted(hits)), strict=True):
                        column.append(value)
                    size += 4 * len(line) + 64 * len(hits)  # at most four bytes a character
                    if size > batch_bytes:
                        yield handed_on(batch, *held)
                        held, size = ([], [], [], []), 0
            if held[0]:
                yield handed_on(batch, *held)

    return run


def marker_table_scan(sources: DataFrame, markers: DataFrame, all_files: bool = False, block_rows: int = 10_000) -> DataFrame:
    """UD1: ``marker_scan`` with a table of markers (name, pattern), as many as there are.

    The literal parts of all patterns are one automaton, built per task; a pattern runs only on lines
    that hold its literal. Patterns without a certain literal run on every line. Markers go to the
    tasks in blocks of ``block_rows``, of which the driver holds one at a time.
    """
    if not all_files:
        sources = sources.where(ff.is_python_source("path"))
    kinds = dict(sources.dtypes)
    ddl = ", ".join(f"{name} {kinds[name]}" for name in (*RUN, "path")) + ", no int, line string, hits array<struct<marker: string, pattern: string>>"
    listed = cut_lineage(markers.select("name", "pattern").where("name is not null and pattern is not null").distinct())
    blocks = max(1, -(-listed.count() // block_rows))
    parts = []
    for block in range(blocks):
        own = listed.where(F.pmod(F.xxhash64("name", "pattern"), F.lit(blocks)) == block)
        rows = [(r["name"], r["pattern"], required_literal(r["pattern"])) for r in own.collect()]
        with_literal, free = [r for r in rows if r[2]], {(r[0], r[1]) for r in rows if not r[2]}
        if with_literal:
            lines = sources.select(*RUN, "path", ff.lines_of("text").alias("lines"))
            tried = lines.mapInArrow(_marker_candidates(with_literal), ddl).select(*RUN, "path", "no", "line", F.explode("hits").alias("hit"))
            parts.append(tried.where(F.rlike("line", "hit.pattern")).select(*RUN, "path", "no", "hit.marker"))
        if free:
            parts.append(_marker_hits(sources, sorted(free)))
    if not parts:
        parts.append(_marker_hits(sources.limit(0), [("", "a")]))
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    return _marker_findings(hits.distinct())  # patterns of one name count once per line


def missing_package_init(inventory: DataFrame) -> DataFrame:
    """JN5: directories of non-test Python files that hold no __init__.py."""
    python = inventory.where(ff.is_python_source("relative_path"))
    has_init = F.bool_or(ff.file_name("relative_path") == "__init__.py")
    directories = python.groupBy(*RUN, ff.parent("relative_path").alias("directory")).agg(has_init.alias("ok"))
    message = F.format_string(
        "Directory '%s' contains Python source files but no __init__.py, so it is not an importable package.",
        "directory",
    )
    return directories.where(~F.col("ok")).select(
        *_finding("architecture", "warning", "MISSING_INIT_FILE", message, "directory")
    )


def snapshot_drift(previous: DataFrame, current: DataFrame, baselines: DataFrame | None = None) -> DataFrame:
    """JN1, SE2: files added, removed or modified between two inventories of each run.

    Both sides carry the current run's keys. Paths are unique per side, so the full outer
    join has no hot key, and a side that already lies partitioned by its keys is not
    shuffled again. ``baselines`` lists runs that have a previous snapshot; by default
    those of ``previous``.
    """
    keys = [*RUN, "relative_path"]
    old = previous.select(*keys, F.col("content_hash").alias("old_hash"), F.lit(True).alias("was"))
    new = current.select(*keys, F.col("content_hash").alias("new_hash"), F.lit(True).alias("now"))
    sides = new.join(old, keys, "full")
    code = (
        F.when(F.col("was").isNull(), "FILE_ADDED")
        .when(F.col("now").isNull(), "FILE_REMOVED")
        .when(F.col("old_hash") != F.col("new_hash"), "FILE_MODIFIED")
    )
    changed = sides.withColumn("code", code).where(F.col("code").isNotNull())
    known = (previous if baselines is None else baselines).select(*RUN).distinct()
    changed = changed.join(known, RUN, "left_semi")
    return _drift_findings(changed)


def _drift_findings(changed: DataFrame) -> DataFrame:
    verb = F.lower(F.substring_index("code", "_", -1))
    message = F.format_string("File %s since previous inspection: %s", verb, F.col("relative_path"))
    severity = F.when(F.col("code") == "FILE_REMOVED", "warning").otherwise("info")
    return changed.select(*_finding("drift", severity, F.col("code"), message, "relative_path"))


def consecutive_drift(inventory: DataFrame, runs: DataFrame) -> DataFrame:
    """Drift of every run against the run before it, all projects at once.

    ``runs`` is the header table (project_id, run_id). Its neighbours in time are written
    first, so that their size is known. The inventory is then read once and ordered per file:
    a file that the run before lacks is added, one that the next run lacks is removed there.
    """
    rows = inventory.select(*RUN, "relative_path", "content_hash").join(cut_lineage(run_steps(runs)), RUN)
    return _drift_findings(drift_changes(with_sightings(rows, "relative_path", "content_hash")).select("project_id", "relative_path", "run_id", "code"))


def run_steps(runs: DataFrame) -> DataFrame:
    """Every run with the runs of its project before and after it."""
    ordered = Window.partitionBy("project_id").orderBy("run_id")
    return runs.select(*RUN).distinct().select(
        *RUN, F.lag("run_id").over(ordered).alias("before"), F.lead("run_id").over(ordered).alias("after")
    )


def with_sightings(files: DataFrame, path: str, content: str) -> DataFrame:
    """Every file of a run with the runs that have the same file before and after it, and whether its content changed since; ``content`` goes."""
    of_file = Window.partitionBy("project_id", path).orderBy("run_id")
    rows = files.withColumns({
        "seen": F.lag("run_id").over(of_file), "next_seen": F.lead("run_id").over(of_file), "_old": F.lag(content).over(of_file),
    })
    return rows.withColumn("changed", F.coalesce(F.col("_old") != F.col(content), F.lit(False))).drop("_old", content)


def drift_codes() -> dict[str, Column]:
    """What happened to a file that has the columns of ``with_sightings`` and ``run_steps``: conditions by code; a removal belongs to the run ``after``."""
    was, stays = F.col("seen").eqNullSafe(F.col("before")), F.col("next_seen").eqNullSafe(F.col("after"))
    return {
        "FILE_ADDED": F.col("before").isNotNull() & ~was,
        "FILE_MODIFIED": F.col("before").isNotNull() & was & F.col("changed"),
        "FILE_REMOVED": F.col("after").isNotNull() & ~stays,
    }


def drift_changes(files: DataFrame) -> DataFrame:
    """One row per change (run_id of the change, code) with the other columns of the file."""
    change = lambda code, condition: F.when(condition, F.struct(F.col("after" if code == "FILE_REMOVED" else "run_id").alias("run_id"), F.lit(code).alias("code")))
    changes = F.array_compact(F.array(*[change(code, condition) for code, condition in drift_codes().items()]))
    rest = [name for name in files.columns if name not in ("run_id", "before", "after", "seen", "next_seen", "changed")]
    return files.select(*rest, F.explode(changes).alias("_c")).select(*rest, "_c.*")


def latest_snapshot(records: DataFrame) -> DataFrame:
    """SC9: newest inspection payload of each project, the baseline of the next drift."""
    inspections = records.where(F.col("record_type") == "inspection")
    return inspections.groupBy("project_id").agg(
        F.max_by(F.struct("record_id", "recorded_at", "payload"), F.struct("recorded_at", "record_id")).alias("r")
    ).select("project_id", "r.*")


def snapshot_inventory(latest: DataFrame) -> DataFrame:
    """SC9: the files of a stored payload as an inventory (project_id, relative_path, content_hash)."""
    schema = "snapshot struct<files: map<string, struct<content_hash: string>>>"
    files = latest.select("project_id", F.explode(F.from_json("payload", schema)["snapshot"]["files"]).alias("relative_path", "f"))
    return files.select("project_id", "relative_path", "f.content_hash")


def snapshot_payloads(inventory: DataFrame) -> DataFrame:
    """SC9, SC10: (project_id, run_id, snapshot) with the files of a run in the form that ``snapshot_inventory`` reads.

    A stored record holds the files of one run in one value; that is the record's format.
    """
    entry = F.struct("relative_path", F.struct("content_hash").alias("f"))
    files = F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("files")
    return inventory.groupBy(*RUN).agg(F.struct(files).alias("snapshot"))


def union_findings(*parts: DataFrame) -> DataFrame:
    """SE1: findings of all analyzers in one table."""
    result = parts[0].select(*FINDING_COLUMNS)
    for part in parts[1:]:
        result = result.unionByName(part.select(*FINDING_COLUMNS))
    return result


def health_from(weight, findings, file_count) -> Column:
    """AG1 on aggregated columns: rounded first, clamped after."""
    raw = rounded(100.0 - 20.0 * (as_col(weight) / F.greatest(as_col(file_count), F.lit(1))), 2)
    return F.when(F.coalesce(as_col(findings), F.lit(0)) == 0, 100.0).otherwise(clamp(raw, 0.0, 100.0))


def severity_totals(findings: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """AG1, AG2 inputs: one pass for counts per severity, total count and total weight."""
    counts = [F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in fixed.SEVERITY_WEIGHTS]
    return findings.groupBy(*keys).agg(
        F.count("*").alias("finding_count"),
        F.sum(severity_weight("severity")).alias("severity_weight"),
        *counts,
    )


def health_scores(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """AG1: ``runs`` has (project_id, run_id, file_count); a run without findings scores 100."""
    joined = runs.join(severity_totals(findings), RUN, "left")
    return joined.select(
        *RUN,
        "file_count",
        F.coalesce("finding_count", F.lit(0)).alias("finding_count"),
        health_from("severity_weight", "finding_count", "file_count").alias("health_score"),
    )


def count_by_severity(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """AG2: four fixed levels, zeros included."""
    names = [f"{s}_count" for s in fixed.SEVERITY_WEIGHTS]
    joined = runs.select(*RUN).join(severity_totals(findings), RUN, "left")
    return joined.select(*RUN, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def findings_by_severity(findings: DataFrame, severity: str) -> DataFrame:
    """PR16"""
    return findings.where(F.col("severity") == severity)


def file_metrics(facts: DataFrame) -> DataFrame:
    """AG19, AG20 over code facts: one row per Python file.

    A file that does not parse has zero figures and counts as such in project means.
    """
    function, target = F.col("kind") == "function", F.col("kind").isin("module", "function", "class")
    broken = F.bool_or(F.col("kind") == "syntax_error")
    grouped = facts.where(F.col("kind").isin("module", "function", "class", "syntax_error")).groupBy(*RUN, "path").agg(
        F.count_if(function).alias("function_count"),
        F.count_if(F.col("kind") == "class").alias("class_count"),
        F.max(F.when(function, F.col("complexity"))).alias("top"),
        F.avg(F.when(function, F.col("complexity"))).alias("mean"),
        F.avg(F.when(target, F.col("has_doc").cast("double"))).alias("coverage"),
        F.count_if(target).alias("doc_targets"),
        broken.alias("has_syntax_error"),
    )
    bad = F.col("has_syntax_error")
    return grouped.select(
        *RUN,
        F.col("path").alias("relative_path"),
        "function_count",
        "class_count",
        F.when(bad, 0).otherwise(F.coalesce("top", F.lit(1))).cast("bigint").alias("max_cyclomatic_complexity"),
        F.when(bad, 0.0).otherwise(rounded(F.coalesce("mean", F.lit(1.0)), 2)).alias("average_cyclomatic_complexity"),
        F.when(bad, 0.0).otherwise(rounded("coverage", 2)).alias("docstring_coverage"),
        "has_syntax_error",
        F.when(bad, 0).otherwise(F.col("doc_targets")).alias("doc_targets"),
        F.when(bad, 0.0).otherwise(F.col("coverage")).alias("exact_coverage"),
    )


def complexity_findings(facts: DataFrame) -> DataFrame:
    """AG21: functions of complexity 10 and more (warning) or 20 and more (error)."""
    rows = facts.where((F.col("kind") == "function") & (F.col("complexity") >= 10))
    message = F.format_string(
        "Function '%s' has cyclomatic complexity %d, exceeding the threshold of 10.", "name", "complexity"
    )
    severity = band("complexity", fixed.COMPLEXITY_BANDS)
    return rows.select(*_finding("code_quality", severity, "HIGH_COMPLEXITY", message, "path", "line"))


def docstring_findings(metrics: DataFrame) -> DataFrame:
    """AG22: coverage below 0.3 in files with at least three documentable targets."""
    low = metrics.where((F.col("doc_targets") >= 3) & (F.col("exact_coverage") < 0.3))
    message = F.format_string(
        "Docstring coverage is %.0f%%, below the 30%% threshold.", F.col("exact_coverage") * 100.0
    )
    return low.select(*_finding("code_quality", "warning", "LOW_DOCSTRING_COVERAGE", message, "relative_path"))


def syntax_findings(facts: DataFrame) -> DataFrame:
    """Files that do not parse, are not UTF-8, or are beyond the parser (all critical; the run goes on)."""
    rows = facts.where(F.col("kind").isin("syntax_error", "undecodable", "unparsable"))
    broken, unreadable = F.col("kind") == "syntax_error", F.col("kind") == "undecodable"
    code = F.when(broken, "SYNTAX_ERROR").when(unreadable, "UNDECODABLE").otherwise("UNPARSABLE")
    message = (
        F.when(broken, F.format_string("Syntax error in %s: %s", "path", "text"))
        .when(unreadable, F.format_string("File %s is not valid UTF-8: %s", "path", "text"))
        .otherwise(F.format_string("File %s could not be analyzed: %s", "path", "text"))
    )
    return rows.select(*_finding("syntax", "critical", code, message, "path", "line"))


def cycle_findings(chains: DataFrame) -> DataFrame:
    """GR3 as findings: one per strongly connected component, naming a real chain of imports.

    ``chains`` are the rows of ``graph.cycle_chains``; the message is as long as the chain is.
    """
    grouped = chains.groupBy(*RUN, "component").agg(F.array_sort(F.collect_list(F.struct("position", "node"))).alias("steps"))
    chain = F.array_join(F.transform("steps", lambda step: step["node"]), " -> ")
    message = F.concat(F.lit("Circular import dependency detected: "), chain, F.lit(" -> "), F.col("component"))
    return grouped.select(*_finding("dependency", "error", "CIRCULAR_DEPENDENCY", message, "component"))
