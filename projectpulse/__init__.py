"""Project-health and telemetry analytics as Spark DataFrame operators."""
