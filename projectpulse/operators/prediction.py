"""Feature vectors, risk formulas, module ranking and quality trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from projectpulse.functions import fixed
from projectpulse.functions.scalars import band, clamp, per_file, percent_text, rounded, severity_weight
from projectpulse.operators.memory import trend_series
from projectpulse.skew import prefix_totals

RUN = ["project_id", "run_id"]


def feature_vectors(runs: DataFrame, metrics: DataFrame, findings: DataFrame, impact: DataFrame) -> DataFrame:
    """AG8: ten features per run; every side is aggregated to runs before the joins.

    ``runs`` has (project_id, run_id, file_count, health_score).
    """
    complexity = metrics.groupBy(*RUN).agg(
        F.avg("max_cyclomatic_complexity").alias("avg_c"),
        F.max("max_cyclomatic_complexity").alias("max_c"),
        F.avg("docstring_coverage").alias("doc"),
    )
    found = findings.groupBy(*RUN).agg(
        F.count("*").alias("n"),
        F.sum(severity_weight("severity")).alias("w"),
        F.count_if(F.col("category") == "drift").alias("d"),
    )
    risk = impact.groupBy(*RUN).agg(F.avg("risk_score").alias("avg_r"), F.max("risk_score").alias("max_r"))
    return vectors_of_totals(runs.join(complexity, RUN, "left").join(found, RUN, "left").join(risk, RUN, "left"))


def vectors_of_totals(runs: DataFrame) -> DataFrame:
    """AG8 for runs that have file_count, health_score and their totals: avg_c, max_c and doc of the metrics, n, w and d (drift) of the findings, avg_r and max_r of the risks."""
    zero = F.lit(0)
    return runs.select(
        *RUN,
        "file_count",
        rounded(F.coalesce("avg_c", F.lit(0.0)), 4).alias("average_cyclomatic_complexity"),
        F.coalesce("max_c", zero).alias("max_cyclomatic_complexity"),
        rounded(F.coalesce("doc", F.lit(1.0)), 4).alias("average_docstring_coverage"),
        per_file(F.coalesce("n", zero), "file_count").alias("finding_density"),
        per_file(F.coalesce("w", zero), "file_count").alias("severity_weighted_density"),
        per_file(F.coalesce("d", zero), "file_count").alias("drift_churn_ratio"),
        rounded(F.coalesce("avg_r", F.lit(0.0)), 4).alias("average_dependency_risk"),
        F.coalesce("max_r", F.lit(0.0)).alias("max_dependency_risk"),
        "health_score",
    )


def _factors(*pairs: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(test, text) for test, text in pairs]))


def _regression_parts() -> dict[str, Column]:
    capped = lambda name, reference: F.least(F.col(name) / reference, F.lit(2.0))
    return {
        "churn": capped("drift_churn_ratio", 1.0),
        "severity": capped("severity_weighted_density", 5.0),
        "complexity": capped("average_cyclomatic_complexity", 20.0),
        "dependency": capped("max_dependency_risk", 5.0),
    }


def regression_risk(vectors: DataFrame) -> DataFrame:
    """FN11, FN14"""
    part = _regression_parts()
    z = -2.0 + 3.0 * part["churn"] + 1.5 * part["severity"] + part["complexity"] + 1.5 * part["dependency"]
    factors = _factors(
        (part["churn"] >= 0.3, F.format_string("File churn ratio since previous inspection is %.2f.", "drift_churn_ratio")),
        (part["severity"] >= 0.3,
         F.format_string("Severity-weighted finding density is %.2f per file.", "severity_weighted_density")),
        (part["complexity"] >= 0.3,
         F.format_string("Average max cyclomatic complexity is %.2f.", "average_cyclomatic_complexity")),
        (part["dependency"] >= 0.3,
         F.format_string("Highest dependency blast-radius risk score is %.2f.", "max_dependency_risk")),
    )
    scored = vectors.withColumn("regression_probability", rounded(1.0 / (1.0 + F.exp(-z)), 4))
    scored = scored.withColumn("regression_level", band("regression_probability", fixed.PROBABILITY_BANDS))
    summary = F.concat(
        F.lit("Predicted regression probability "), percent_text("regression_probability"), F.lit(" ("),
        F.col("regression_level"), F.format_string(") for this run, based on %d inspected file(s).", "file_count"),
    )
    return scored.withColumns({"regression_factors": factors, "regression_summary": summary})


def technical_debt(vectors: DataFrame) -> DataFrame:
    """FN12, FN14"""
    complexity = F.least(F.col("average_cyclomatic_complexity") / 20.0, F.lit(1.0)) * 40.0
    documentation = F.greatest(F.lit(0.0), 1.0 - F.col("average_docstring_coverage")) * 30.0
    density = F.least(F.col("finding_density") / 0.5, F.lit(1.0)) * 30.0
    factors = _factors(
        (complexity >= 40.0 * 0.3,
         F.format_string("Average max cyclomatic complexity is %.2f.", "average_cyclomatic_complexity")),
        (documentation >= 30.0 * 0.3,
         F.concat(F.lit("Average docstring coverage is only "), percent_text("average_docstring_coverage"), F.lit("."))),
        (density >= 30.0 * 0.3, F.format_string("Finding density is %.2f findings per file.", "finding_density")),
    )
    scored = vectors.withColumn("debt_score", rounded(F.least(complexity + documentation + density, F.lit(100.0)), 2))
    hours = rounded(F.col("debt_score") / 100.0 * F.col("file_count") * 1.5, 1)
    scored = scored.withColumns({"remediation_hours": hours, "debt_level": band("debt_score", fixed.DEBT_BANDS)})
    summary = F.format_string(
        "Predicted technical debt score %.1f/100 (%s), estimated at %.1f remediation hour(s) across %d file(s).",
        "debt_score", "debt_level", "remediation_hours", "file_count",
    )
    return scored.withColumns({"debt_factors": factors, "debt_summary": summary})


def failure_probability(scored: DataFrame) -> DataFrame:
    """FN13, FN14 on rows that carry the regression risk and the debt score."""
    churn = F.least("drift_churn_ratio", F.lit(1.0))
    deficit = F.greatest(F.lit(0.0), (100.0 - F.col("health_score")) / 100.0)
    debt = F.col("debt_score") / 100.0
    raw = rounded(F.col("regression_probability") * 0.4 + debt * 0.25 + churn * 0.15 + deficit * 0.2, 4)
    factors = _factors(
        (F.col("regression_probability") >= 0.3,
         F.concat(F.lit("Regression risk probability is "), percent_text("regression_probability"), F.lit("."))),
        (debt >= 0.3, F.format_string("Technical debt score is %.1f/100.", debt * 100.0)),
        (churn >= 0.3, F.format_string("Drift churn ratio is %.2f.", churn)),
        (deficit >= 0.3, F.concat(F.lit("Health score deficit is "), percent_text(deficit), F.lit(" below full health."))),
    )
    rows = scored.withColumn("failure_probability", clamp(raw, 0.0, 1.0))
    rows = rows.withColumn("failure_level", band("failure_probability", fixed.PROBABILITY_BANDS))
    summary = F.concat(
        F.lit("Predicted overall failure probability "), percent_text("failure_probability"), F.lit(" ("),
        F.col("failure_level"),
        F.lit("), combining regression risk, technical debt, drift churn, and health-score deficit."),
    )
    return rows.withColumns({"failure_factors": factors, "failure_summary": summary})


def module_risk(metrics: DataFrame, impact: DataFrame, findings: DataFrame) -> DataFrame:
    """JN3: every path with metrics, blast radius or findings.

    The three sides are tagged, united and aggregated once: the result of two full outer
    joins with one shuffle and map-side combining.
    """
    none = F.lit(None).cast("double")
    path = F.col("relative_path").alias("file_path")
    parts = (
        metrics.select(*RUN, path, F.col("max_cyclomatic_complexity").cast("double").alias("c"), none.alias("r"), none.alias("w"))
        .unionByName(impact.select(*RUN, "file_path", none.alias("c"), F.col("risk_score").alias("r"), none.alias("w")))
        .unionByName(
            findings.where(F.col("file_path").isNotNull()).select(
                *RUN, "file_path", none.alias("c"), none.alias("r"), severity_weight("severity").cast("double").alias("w")
            )
        )
    )
    merged = parts.groupBy(*RUN, "file_path").agg(F.max("c").alias("c"), F.max("r").alias("r"), F.sum("w").alias("w"))
    return module_scores(merged)


def module_scores(files: DataFrame) -> DataFrame:
    """JN3 on one row per file_path with complexity c, risk r and severity weight w, null where a side lacks the file."""
    axis = lambda name, reference: rounded(F.coalesce(name, F.lit(0.0)) / reference, 4)
    scored = files.select(
        *RUN, "file_path",
        axis("c", 20.0).alias("complexity_score"),
        axis("r", 5.0).alias("dependency_risk_score"),
        axis("w", 10.0).alias("finding_severity_score"),
    )
    composite = rounded(
        F.col("complexity_score") * 0.3 + F.col("dependency_risk_score") * 0.4 + F.col("finding_severity_score") * 0.3, 4
    )
    scored = scored.withColumn("composite_risk_score", composite)
    return scored.withColumn("risk_level", band("composite_risk_score", fixed.MODULE_BANDS))


def module_order(scores: DataFrame) -> DataFrame:
    """SO5"""
    return scores.orderBy(*RUN, F.desc("composite_risk_score"), "file_path")


def high_risk_modules(scores: DataFrame) -> DataFrame:
    """PR16: high and critical modules, in module order."""
    return module_order(scores.where(F.col("risk_level").isin("high", "critical")))


def run_index(history: DataFrame, order: list[str], chunk: Column) -> DataFrame:
    """WN6: 0-based index of a project's runs in time."""
    return prefix_totals(history, ["project_id"], order, chunk, {"run_index": F.lit(1)})


def _trend_texts(rows: DataFrame, clause: Column) -> DataFrame:
    enough = F.col("n") >= 2
    rows = rows.withColumn("slope", F.round("slope", 10))  # noise must not move a slope across a bound or below zero
    direction = F.when(~enough, "unknown").when(F.col("slope") >= 0.5, "improving").when(
        F.col("slope") <= -0.5, "degrading"
    ).otherwise("stable")
    rows = rows.withColumn("direction", direction)
    projected = F.when(enough, rounded(clamp("raw", 0.0, 100.0), 2)).otherwise(F.col("current"))
    rows = rows.withColumn("projected_next_health_score", projected)
    summary = F.when(
        enough,
        F.concat(
            F.format_string("Health score trend is %s (%+.2f point(s) per run over %d data point(s)", F.col("direction"), F.col("slope"), F.col("n")),
            clause,
            F.format_string("); next run projected at %.2f by a trained linear regression model.", "projected_next_health_score"),
        ),
    ).otherwise(
        "No prior health-score history was supplied, so a quality trend model cannot yet be trained; "
        "this is the project's first recorded score."
    )
    return rows.select(
        "project_id", "direction", F.col("current").alias("current_health_score"), "projected_next_health_score",
        F.when(enough, rounded("slope", 4)).otherwise(0.0).alias("slope_per_run"),
        F.col("n").alias("data_points_used"), summary.alias("summary"),
    )


def _duplicated(series: DataFrame) -> DataFrame:
    last = series.groupBy("project_id").agg(
        F.max("run_index").alias("i"), F.max_by(F.struct("health_score", "finding_count"), "run_index").alias("l")
    )
    again = last.select("project_id", (F.col("i") + 1).alias("run_index"), "l.*")
    return series.select("project_id", "run_index", "health_score", "finding_count").unionByName(again)


def trend_one(series: DataFrame, duplicate_current: bool = False) -> DataFrame:
    """AG14: least squares of the health score over the run index, one hash aggregate.

    ``duplicate_current`` counts the newest run twice: once as history, once as current.
    """
    if duplicate_current:
        series = _duplicated(series)
    fitted = series.groupBy("project_id").agg(
        F.count("*").alias("n"),
        F.max_by("health_score", "run_index").alias("current"),
        F.regr_slope("health_score", "run_index").alias("slope"),
        F.regr_intercept("health_score", "run_index").alias("intercept"),
    )
    fitted = fitted.withColumn("raw", F.col("intercept") + F.col("slope") * F.col("n"))
    return _trend_texts(fitted, F.lit(""))


def trend_two(series: DataFrame, duplicate_current: bool = False) -> DataFrame:
    """AG15: run index and finding count as features; the next count is forecast first.

    The normal equations are solved in closed form from co-moments; when the two features
    are collinear the minimum-norm solution is taken.
    """
    if duplicate_current:
        series = _duplicated(series)
    x, f, y = F.col("run_index").cast("double"), F.col("finding_count").cast("double"), F.col("health_score")
    moments = series.groupBy("project_id").agg(
        F.count("*").alias("n"),
        F.max_by("health_score", "run_index").alias("current"),
        F.avg(x).alias("mx"), F.avg(f).alias("mf"), F.avg(y).alias("my"),
        F.var_pop(x).alias("sxx"), F.var_pop(f).alias("sff"),
        F.covar_pop(x, f).alias("sxf"), F.covar_pop(x, y).alias("sxy"), F.covar_pop(f, y).alias("sfy"),
    )
    c = F.col
    determinant = c("sxx") * c("sff") - c("sxf") * c("sxf")
    singular = determinant <= 1e-9 * F.greatest(c("sxx") * c("sff"), F.lit(1e-300))
    trace = c("sxx") + c("sff")
    safe = F.when(~singular, determinant)
    slope = F.when(
        singular, (c("sxx") * c("sxy") + c("sxf") * c("sfy")) / F.nullif(trace * trace, F.lit(0.0))
    ).otherwise((c("sff") * c("sxy") - c("sxf") * c("sfy")) / safe)
    second = F.when(
        singular, (c("sxf") * c("sxy") + c("sff") * c("sfy")) / F.nullif(trace * trace, F.lit(0.0))
    ).otherwise((c("sxx") * c("sfy") - c("sxf") * c("sxy")) / safe)
    next_count = c("mf") + c("sxf") / F.nullif(c("sxx"), F.lit(0.0)) * (c("n") - c("mx"))
    fitted = moments.withColumns({"slope": slope, "second": second, "next_count": next_count})
    raw = c("my") + c("slope") * (c("n") - c("mx")) + c("second") * (c("next_count") - c("mf"))
    return _trend_texts(fitted.withColumn("raw", raw), F.lit(", with finding-count history as a second model feature"))


def zip_training_pairs(records: DataFrame, limit: int | None = None) -> DataFrame:
    """JN16, AG32: (health_score, finding_count) of inspection records, oldest first.

    Payloads list their findings or carry their number. With ``limit`` the oldest N records are kept.
    """
    listed = F.json_array_length(F.get_json_object("payload", "$.findings")).cast("bigint")
    count = F.coalesce(listed, F.get_json_object("payload", "$.finding_count").try_cast("bigint"), F.lit(0).cast("bigint"))
    rows = trend_series(records.withColumn("finding_count", count), ["inspection"], limit)
    return rows.select("project_id", "record_id", "recorded_at", "health_score", "finding_count")
