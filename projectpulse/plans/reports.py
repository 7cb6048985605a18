"""Composite reports: the operators joined into the pipelines users run.

Each report names DataFrames that share their inputs. A part is built on first access, so
that parts with loops of their own cost nothing to those who do not read them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from projectpulse.functions.scalars import rounded
from projectpulse.operators import graph, inspection, memory, prediction, reasoning, sessions, text, vision
from projectpulse.skew import cut_lineage, time_chunk
from projectpulse.sources import code


class Report:
    def __init__(self, **parts: Callable[[Report], DataFrame]):
        self._makers = parts
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name](self)
        return self._made[name]

    def extended(self, **parts: Callable[[Report], DataFrame]) -> Report:
        """The same report, parts already made included, with more parts."""
        more = Report(**self._makers, **parts)
        more._made = dict(self._made)
        return more

    def made(self, name: str) -> bool:
        return name in self._made

    def names(self) -> list[str]:
        return list(self._makers)


def telemetry_report(telemetry: DataFrame, now, max_gap_minutes: float = 15.0) -> Report:
    """RP6: sessions, scores, likelihood, last and recent sessions, weekly minutes."""
    projects = telemetry.select("project_id").distinct()
    return Report(
        sessions=lambda r: sessions.success_scores(sessions.derive_sessions(telemetry, max_gap_minutes)),
        totals=lambda r: r["sessions"].groupBy("project_id").agg(
            F.count("*").alias("sessions"),
            rounded(F.sum("duration_minutes"), 2).alias("total_minutes"),
            F.sum("break_count").alias("breaks"),
            rounded(F.avg("success_score"), 4).alias("mean_score"),
        ),
        likelihood=lambda r: sessions.session_likelihood(telemetry, r["sessions"], now),
        last=lambda r: sessions.last_session(r["sessions"]),
        recent=lambda r: sessions.recent_sessions(r["sessions"], projects),
        week=lambda r: sessions.weekly_minutes(r["sessions"], projects, now),
    )


def inspection_report(contents: DataFrame, previous: DataFrame | None = None) -> Report:
    """RP1 over (project_id, run_id, path, size_bytes, content): all runs at once.

    ``previous`` is the inventory of the runs' baselines, keyed by the current run. Contents are
    read once: records, code facts and marked lines are written to the checkpoint folder, one row
    per file, since all analyzers read them. The part ``drift`` (null without ``previous``) needs
    hashes only, so who reads it alone has nothing parsed.
    """

    def drift(r: Report) -> DataFrame | None:
        if previous is not None:
            return inspection.snapshot_drift(previous, r["inventory"] if r.made("scan") else inspection.file_records(contents))

    def findings(r: Report) -> DataFrame:
        parts = [
            inspection.syntax_findings(r["facts"]),
            inspection.complexity_findings(r["facts"]),
            inspection.docstring_findings(r["metrics"]),
            inspection.cycle_findings(graph.cycle_chains(r["edges"], graph.strongly_connected(r["edges"]))),
            inspection.marker_findings_of(r["scan"]),
            inspection.missing_package_init(r["inventory"]),
        ]
        if previous is not None:
            parts.append(r["drift"])
        return inspection.union_findings(*parts)

    return Report(
        scan=lambda r: cut_lineage(inspection.file_scan(contents)),
        inventory=lambda r: inspection.inventory_of(r["scan"]),
        facts=lambda r: inspection.facts_of(r["scan"]),
        drift=drift,
        metrics=lambda r: inspection.file_metrics(r["facts"]),
        edges=lambda r: cut_lineage(graph.resolve_imports(r["facts"], r["inventory"])),
        findings=findings,
        runs=lambda r: r["inventory"].groupBy("project_id", "run_id").agg(F.count("*").alias("file_count")),
        health=lambda r: inspection.health_scores(r["runs"], r["findings"]),
        severities=lambda r: inspection.count_by_severity(r["runs"], r["findings"]),
    )


def recorded_inspection(contents: DataFrame, stored: DataFrame, recorded_at: Column, root: str = "") -> Report:
    """RP1 as a service runs it: drift against each project's newest stored inspection, then a record of this run.

    ``contents`` holds one run per project. The report has the parts of ``inspection_report``
    and ``records``, rows to append to the stored ones; the next run finds its baseline there.
    """
    current = contents.select("project_id", "run_id").distinct()
    baseline = inspection.snapshot_inventory(inspection.latest_snapshot(stored)).join(current, "project_id")
    report = inspection_report(contents, cut_lineage(baseline))

    def records(r: Report) -> DataFrame:
        run = ["project_id", "run_id"]
        rows = r["health"].join(inspection.snapshot_payloads(r["inventory"]), run)
        rows = rows.withColumns({
            "record_id": F.concat_ws("-", F.lit("run"), *run), "recorded_at": recorded_at, "seq": F.col("run_id"),
        })
        summary = memory.inspection_summary(F.lit(root), F.lit("completed"), F.col("health_score"), F.col("file_count"), F.col("finding_count"))
        return memory.record_report(rows, "inspection", summary, F.col("health_score"))

    return report.extended(records=records)


def reasoning_report(findings: DataFrame, runs: DataFrame, edges: DataFrame, nodes: DataFrame) -> Report:
    """RP2: groups, blast radius, hypotheses, drift insight and recommendations."""
    seeds = findings.select("project_id", "run_id", F.col("file_path").alias("node")).distinct()
    seeds = seeds.join(nodes, ["project_id", "run_id", "node"], "left_semi")
    return Report(
        groups=lambda r: reasoning.correlation_groups(findings),
        members=lambda r: reasoning.group_members(r["groups"], findings),
        dependents=lambda r: graph.transitive_dependents(edges, seeds),
        impact=lambda r: reasoning.blast_radius(findings, nodes, edges),
        hypotheses=lambda r: reasoning.hypotheses(findings),
        files=lambda r: reasoning.code_files(findings),
        high_impact=lambda r: reasoning.high_impact_drift(findings, r["impact"]),
        insight=lambda r: reasoning.drift_insight(findings, runs, r["high_impact"]),
        recommendations=lambda r: reasoning.recommendations(r["groups"], r["impact"], r["hypotheses"], r["insight"]),
    )


def text_report(documents: DataFrame, facts: DataFrame, inventory: DataFrame, sources: DataFrame) -> Report:
    """RP3: intent, dependency mismatch, traceability and best matches.

    ``documents`` has (project_id, run_id, path, kind, text), ``sources`` the Python texts.
    """
    readmes = documents.where(F.col("kind") == "readme")
    manifests = documents.where(F.col("kind") == "dependency_manifest")
    return Report(
        intent=lambda r: text.merge_intents(documents),
        features=lambda r: text.distinct_features(text.feature_bullets(readmes)),
        requirements=lambda r: text.requirements(readmes),
        packages=lambda r: text.third_party_packages(facts, inventory),
        mismatch=lambda r: text.dependency_mismatch(text.declared_packages(manifests), r["packages"]),
        blobs=lambda r: code.text_blobs(facts, code.comment_lines(sources)).withColumnRenamed("blob", "text"),
        claims=lambda r: text.claims_union(r["features"], r["requirements"]),
        untraceable=lambda r: text.keyword_traceability(r["claims"], r["blobs"]),
        matches=lambda r: text.best_match(r["claims"], r["blobs"]),
    )


def prediction_report(runs: DataFrame, metrics: DataFrame, findings: DataFrame, impact: DataFrame, history: DataFrame) -> Report:
    """RP4: feature vector, risk, debt, failure probability, module ranking and trend."""
    return Report(
        features=lambda r: prediction.feature_vectors(runs, metrics, findings, impact),
        predictions=lambda r: prediction.failure_probability(
            prediction.technical_debt(prediction.regression_risk(r["features"]))
        ),
        modules=lambda r: prediction.module_risk(metrics, impact, findings),
        high_risk_modules=lambda r: prediction.high_risk_modules(r["modules"]),
        trend=lambda r: prediction.trend_two(history),
    )


def project_report(contents: DataFrame, stored: DataFrame, recorded_at: Column, root: str = "", include_reasoning: bool = True, chunk_hours: int = 24 * 365) -> Report:
    """Inspection, reasoning, trend and prediction of a run as one: every part reads the run's own import graph.

    ``contents`` holds one run per project and ``stored`` the records so far. The parts are those of
    ``recorded_inspection``, ``reasoning_report`` and ``prediction_report``; the trend is fitted to
    the stored runs and this one. Findings, scores and impact are written once, since several parts
    read them. Without reasoning no file has a blast radius, and there are no recommendations.
    """
    run = ["project_id", "run_id"]
    inspected = recorded_inspection(contents, stored, recorded_at, root)
    reasoned: list[Report] = []

    def reasoning_of(r: Report) -> Report:
        if not reasoned:
            nodes = r["inventory"].where("extension = 'py'").select(*run, F.col("relative_path").alias("node"))
            reasoned.append(reasoning_report(r["found"], r["runs"], r["edges"], nodes))
        return reasoned[0]

    def history(r: Report) -> DataFrame:
        past = prediction.zip_training_pairs(stored).select("project_id", "record_id", "recorded_at", "health_score", "finding_count")
        current = r["scored"].select(
            "project_id", F.concat_ws("-", F.lit("run"), *run).alias("record_id"), recorded_at.alias("recorded_at"), "health_score", "finding_count")
        series = past.join(current.select("project_id"), "project_id", "left_semi").unionByName(current)
        return prediction.run_index(series, ["recorded_at", "record_id"], time_chunk("recorded_at", chunk_hours))

    def features(r: Report) -> DataFrame:
        return prediction.feature_vectors(r["scored"].select(*run, "file_count", "health_score"), r["metrics"], r["found"], r["impact"])

    def impact(r: Report) -> DataFrame:
        rows = reasoning_of(r)["impact"]
        return cut_lineage(rows if include_reasoning else rows.limit(0))

    parts = {
        "found": lambda r: cut_lineage(r["findings"]),
        "scored": lambda r: cut_lineage(inspection.health_scores(r["runs"], r["found"])),
        "impact": impact,
        "features": features,
        "predictions": lambda r: prediction.failure_probability(prediction.technical_debt(prediction.regression_risk(r["features"]))),
        "modules": lambda r: prediction.module_risk(r["metrics"], r["impact"], r["found"]),
        "history": history,
        "trend": lambda r: prediction.trend_two(r["history"]),
    }
    if include_reasoning:
        parts |= {name: lambda r, name=name: reasoning_of(r)[name] for name in ("groups", "hypotheses", "insight", "recommendations")}
    return inspected.extended(**parts)


def visual_report(
    pairs: DataFrame, embeddings: DataFrame, baseline: DataFrame, current: DataFrame,
    canvas_width: int | None = None, canvas_height: int | None = None,
) -> Report:
    """RP5: all visual findings of every comparison and its verdict."""

    def findings(r: Report) -> DataFrame:
        return (
            vision.embedding_findings(vision.embedding_diff(embeddings))
            .unionByName(vision.pixel_findings(r["pixels"], r["regions"]))
            .unionByName(vision.layout_findings(r["changes"], r["ratios"]))
            .unionByName(vision.consistency_findings(r["issues"]))
        )

    def comparisons() -> DataFrame:
        ids = [pairs.select(F.col("pair_id").alias("c")), embeddings.select(F.col("pair_id").alias("c"))]
        ids += [side.select(F.col("layout_id").alias("c")) for side in (baseline, current)]
        named = [rows.select(F.col("c").cast("string").alias("comparison_id")) for rows in ids]
        return named[0].unionByName(named[1]).unionByName(named[2]).unionByName(named[3]).distinct()

    return Report(
        changed=lambda r: vision.changed_pixels(pairs),
        pixels=lambda r: vision.pixel_diff(r["changed"]),
        regions=lambda r: vision.region_boxes(r["changed"]),
        changes=lambda r: cut_lineage(vision.layout_diff(baseline, current)),  # three readers
        ratios=lambda r: vision.layout_change_ratio(r["changes"], baseline, current),
        issues=lambda r: vision.consistency_issues(current, canvas_width, canvas_height),
        findings=findings,
        verdicts=lambda r: vision.verdicts(comparisons(), r["findings"]),
    )


def recall(records: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """RP7: checked queries, their best records, joined to the full records."""
    good, _ = memory.guard_queries(queries)
    return memory.recall_hydrate(memory.recall_topk(vectors, good), records)


def trend_training(records: DataFrame, chunk: Column, limit: int | None = None) -> Report:
    """RP8: aligned training pairs of each project and both fitted trends."""
    return Report(
        series=lambda r: prediction.run_index(
            prediction.zip_training_pairs(records, limit), ["recorded_at", "record_id"], chunk
        ),
        one=lambda r: prediction.trend_one(r["series"]),
        two=lambda r: prediction.trend_two(r["series"]),
    )
