import pytest

from conftest import rows
from projectpulse.operators import prediction as P

KEYS = "project_id string, run_id bigint, "
VECTOR = KEYS + ("file_count bigint, average_cyclomatic_complexity double, max_cyclomatic_complexity bigint, average_docstring_coverage double, "
                 "finding_density double, severity_weighted_density double, drift_churn_ratio double, average_dependency_risk double, "
                 "max_dependency_risk double, health_score double")
QUIET = (10, 1.0, 1, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 100.0)
RISKY = (10, 40.0, 60, 0.0, 5.0, 20.0, 3.0, 9.0, 20.0, 0.0)


def scored(spark, *vectors):
    df = spark.createDataFrame([("p", i, *v) for i, v in enumerate(vectors)], VECTOR)
    return P.failure_probability(P.technical_debt(P.regression_risk(df))).orderBy("run_id").collect()


def test_risk_formulas(spark):
    quiet, risky = scored(spark, QUIET, RISKY)
    assert quiet.regression_probability == pytest.approx(0.1246) and quiet.regression_level == "low" and quiet.regression_factors == []
    assert quiet.debt_score == 2.0 and quiet.debt_level == "low" and quiet.remediation_hours == 0.3
    assert risky.regression_probability <= 1.0 and risky.regression_level == "critical" and len(risky.regression_factors) == 4
    assert risky.debt_score == 100.0 and risky.remediation_hours == 15.0 and len(risky.debt_factors) == 3
    assert risky.failure_level == "critical" and risky.failure_probability <= 1.0 and len(risky.failure_factors) == 4
    assert quiet.failure_probability == pytest.approx(0.1246 * 0.4 + 0.02 * 0.25, abs=1e-4)


def test_risk_grows_with_churn(spark):
    found = [r.regression_probability for r in scored(spark, *[(*QUIET[:6], churn, *QUIET[7:]) for churn in (0.0, 0.3, 0.9, 1.5)])]
    assert found == sorted(found) and len(set(found)) == 4


def test_module_risk_is_a_full_join(spark):
    metrics = spark.createDataFrame([("p", 1, "a", 20)], KEYS + "relative_path string, max_cyclomatic_complexity bigint")
    impact = spark.createDataFrame([("p", 1, "b", 5.0)], KEYS + "file_path string, risk_score double")
    findings = spark.createDataFrame([("p", 1, "c", "error"), ("p", 1, "c", "warning"), ("p", 1, None, "error")], KEYS + "file_path string, severity string")
    scores = P.module_risk(metrics, impact, findings)
    assert [(r.file_path, r.composite_risk_score, r.risk_level) for r in P.module_order(scores).collect()] == [
        ("b", 0.4, "moderate"), ("a", 0.3, "moderate"), ("c", 0.3, "moderate")]
    assert P.high_risk_modules(scores).count() == 0


def test_feature_vector_defaults(spark):
    runs = spark.createDataFrame([("p", 1, 0, 100.0)], KEYS + "file_count bigint, health_score double")
    metrics = spark.createDataFrame([], KEYS + "max_cyclomatic_complexity bigint, docstring_coverage double")
    findings = spark.createDataFrame([], KEYS + "severity string, category string")
    impact = spark.createDataFrame([], KEYS + "risk_score double")
    row = P.feature_vectors(runs, metrics, findings, impact).first()
    assert row.average_docstring_coverage == 1.0 and row.average_cyclomatic_complexity == 0.0 and row.finding_density == 0.0


SERIES = "project_id string, run_index bigint, health_score double, finding_count bigint"


def series(spark, scores, counts=None):
    return spark.createDataFrame([("p", i, s, (counts or [0] * len(scores))[i]) for i, s in enumerate(scores)], SERIES)


def test_trends(spark):
    up = P.trend_one(series(spark, [60.0, 70.0, 80.0, 90.0])).first()
    assert (up.direction, up.slope_per_run, up.projected_next_health_score) == ("improving", 10.0, 100.0)
    assert up.summary == ("Health score trend is improving (+10.00 point(s) per run over 4 data point(s)); next run projected at "
                          "100.00 by a trained linear regression model.")
    flat = P.trend_one(series(spark, [80.0, 80.0, 80.0])).first()
    assert flat.direction == "stable" and flat.projected_next_health_score == 80.0
    down = P.trend_one(series(spark, [30.0, 15.0, 0.0])).first()
    assert down.direction == "degrading" and down.projected_next_health_score == 0.0
    single = P.trend_one(series(spark, [55.0])).first()
    assert (single.direction, single.projected_next_health_score, single.slope_per_run) == ("unknown", 55.0, 0.0)


@pytest.mark.parametrize("scores,counts", [([60.0, 70.0, 80.0, 90.0], [9, 6, 3, 0]), ([50.0, 61.0, 55.0, 70.0, 72.0], [5, 9, 1, 4, 2]),
                                           ([70.0, 71.0], [3, 3])])
def test_two_feature_trend_matches_least_squares(spark, scores, counts):
    import numpy as np

    x = np.column_stack([np.arange(len(scores)), counts]).astype(float)
    y = np.array(scores)
    coefficients = np.linalg.lstsq(x - x.mean(axis=0), y - y.mean(), rcond=None)[0]
    line = np.polyfit(np.arange(len(counts)), counts, 1)
    following = np.array([len(scores), np.polyval(line, len(scores))])
    expected = float(y.mean() + (following - x.mean(axis=0)) @ coefficients)
    row = P.trend_two(series(spark, scores, counts)).first()
    assert row.slope_per_run == pytest.approx(coefficients[0], abs=1e-4)
    assert row.projected_next_health_score == pytest.approx(min(100.0, max(0.0, expected)), abs=0.01)


def test_duplicate_current_counts_the_last_run_twice(spark):
    once = P.trend_one(series(spark, [60.0, 70.0])).first()
    twice = P.trend_one(series(spark, [60.0, 70.0]), duplicate_current=True).first()
    assert (once.data_points_used, once.slope_per_run) == (2, 10.0) and (twice.data_points_used, twice.slope_per_run) == (3, 5.0)


def test_training_pairs(spark):
    data = [("r1", "p", "inspection", "2026-01-01", 1, '{"findings": [1, 2]}', 80.0), ("r2", "p", "nlp", "2026-01-02", 2, "{}", 50.0),
            ("r3", "p", "inspection", "2026-01-03", 3, "{}", 90.0), ("r4", "p", "inspection", "2026-01-04", 4, "{}", None)]
    df = spark.createDataFrame(data, "record_id string, project_id string, record_type string, d string, seq bigint, payload string, health_score double")
    df = df.selectExpr("*", "cast(d as timestamp) as recorded_at")
    assert rows(P.zip_training_pairs(df), "record_id", "health_score", "finding_count") == [("r1", 80.0, 2), ("r3", 90.0, 0)]
    assert rows(P.zip_training_pairs(df, 1), "record_id") == [("r1",)]


def test_slopes_at_a_bound_and_at_zero(spark):
    """Slopes of exactly 0.5, -0.5 and 0, which sums of doubles miss by a hair."""
    scores = {
        "up": [40.31, 42.21, 41.31], "up6": [40.45, 41.57, 41.77, 40.81, 44.19, 42.57], "down": [44.29, 42.29, 44.05, 42.49, 41.69],
        "down3": [43.24, 42.66, 42.24], "flat": [41.45, 44.7, 40.3, 44.48, 41.56],
    }
    series = [(p, i, v, 5) for p, line in scores.items() for i, v in enumerate(line)]
    df = spark.createDataFrame(series, "project_id string, run_index bigint, health_score double, finding_count bigint").coalesce(1)
    found = {r.project_id: r for r in P.trend_one(df).collect()}
    assert {p: r.direction for p, r in found.items()} == {"up": "improving", "up6": "improving", "down": "degrading", "down3": "degrading", "flat": "stable"}
    assert found["up"].summary.startswith("Health score trend is improving (+0.50 point(s)")
    assert found["flat"].summary.startswith("Health score trend is stable (+0.00 point(s)") and found["flat"].slope_per_run == 0.0
