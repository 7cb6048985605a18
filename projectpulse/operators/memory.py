"""Run records: upsert, history, trend series, vector recall.

Records are (record_id, project_id, record_type, recorded_at, seq, summary, payload,
health_score), stored in folders of record_type and a hash of project_id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from projectpulse.functions import fixed
from projectpulse.functions.scalars import as_col, clamp, packed_order, rounded, strip
from projectpulse.skew import block_pairs


def check_record_types(records: DataFrame) -> DataFrame:
    """PR7: fails the query on an unknown record type."""
    legal = F.col("record_type").isin(fixed.RECORD_TYPES)
    message = F.concat(F.lit("unknown record type: "), F.coalesce("record_type", F.lit("null")))
    return records.withColumn("record_type", F.when(legal, F.col("record_type")).otherwise(F.raise_error(message)))


def keep_latest(records: DataFrame) -> DataFrame:
    """SC5: one row per project and record_id, the newest by (recorded_at, seq).

    The newest place in time of every id is found over fixed-width numbers, which a hash
    aggregate combines before the shuffle; the rows at these places are then joined. So whole
    records are never sorted, and a record delivered very often does not gather in one task. Rows
    that agree in time and number are told apart by their hash, equal rows become one.
    """
    key = ["project_id", "record_id"]
    placed = records.withColumns({"_at": packed_order("recorded_at", "seq"), "_hash": F.xxhash64(*records.columns)})
    newest = placed.groupBy(*key).agg(F.max("_at").alias("_top"), F.max_by("_hash", "_at").alias("_this"))
    newest = newest.select(*[F.col(name).alias(f"_{name}") for name in key], "_top", "_this")
    same = [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in key]
    kept = placed.join(newest, [*same, F.col("_at") == F.col("_top"), F.col("_hash") == F.col("_this")])
    return kept.select(*records.columns).distinct()


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """SC5: insert or replace by project and record_id; delivering the same rows twice changes nothing."""
    return keep_latest(stored.unionByName(incoming))


def project_bucket(buckets: int = 64) -> Column:
    return F.pmod(F.xxhash64("project_id"), F.lit(buckets)).cast("int")


def write_records(records: DataFrame, path: str, mode: str = "append", buckets: int = 64) -> None:
    """SC10 sink: Parquet foldered by type and a hash of the project, for pruned reads.

    Equal folders come together before the write and large ones are split again, so there are
    neither a file per task and project nor a single one for a hot project.
    """
    placed = check_record_types(records).withColumn("bucket", project_bucket(buckets))
    placed.hint("rebalance", "record_type", "bucket").write.mode(mode).partitionBy("record_type", "bucket").parquet(path)


def history(records: DataFrame, limit: int, record_type: str | None = None) -> DataFrame:
    """SC6: newest first, at most ``limit`` records per project.

    The limit is the feature; the rank filter lets Spark keep only ``limit`` rows per
    project and task before the shuffle.
    """
    if record_type is not None:
        records = records.where(F.col("record_type") == record_type)
    order = Window.partitionBy("project_id").orderBy(F.desc("recorded_at"), F.desc("seq"))
    return records.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def by_ids(records: DataFrame, ids: DataFrame) -> DataFrame:
    """SC7: records whose (project_id, record_id) is listed."""
    return records.join(ids.select("project_id", "record_id").distinct(), ["project_id", "record_id"], "left_semi")


def trend_series(records: DataFrame, record_types: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """SO6: records that carry a health score, oldest first; a limit keeps the oldest N."""
    rows = records.where(F.col("health_score").isNotNull())
    if record_types:
        rows = rows.where(F.col("record_type").isin(record_types))
    if limit is None:
        return rows
    order = Window.partitionBy("project_id").orderBy("recorded_at", "seq")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("rank")


def series_order(rows: DataFrame) -> DataFrame:
    """SO6, SO8: explicit global order for a consumer that wants one."""
    return rows.orderBy("project_id", "recorded_at", "seq")


def record_report(reports: DataFrame, record_type: str, summary: Column, score: Column | None = None) -> DataFrame:
    """SC10, FN24: reports as records; only inspection and prediction runs carry a score.

    ``reports`` has record_id, project_id, recorded_at, seq; all other columns become the
    JSON payload.
    """
    header = ["record_id", "project_id", "recorded_at", "seq"]
    payload = F.to_json(F.struct(*[c for c in reports.columns if c not in header]))
    scored = score if score is not None and record_type in fixed.SCORED_RECORD_TYPES else F.lit(None)
    return reports.select(
        *header[:2], F.lit(record_type).alias("record_type"), *header[2:], summary.alias("summary"),
        payload.alias("payload"), scored.cast("double").alias("health_score"),
    )


def inspection_summary(root, status, health, file_count, finding_count) -> Column:
    """PR22"""
    return F.format_string(
        "Inspection run for '%s': status=%s, health_score=%.2f, files=%d, findings=%d.",
        root, status, health, file_count, finding_count,
    )


def reasoning_summary(root, groups, assessments, recommended, churn) -> Column:
    """PR22"""
    clause = F.coalesce(F.concat(F.lit("; drift churn="), as_col(churn)), F.lit(""))
    return F.format_string(
        "AI reasoning run for '%s': %d correlation group(s), %d dependency assessment(s), %d recommendation(s)%s.",
        root, groups, assessments, recommended, clause,
    )


def nlp_summary(root, findings, statements) -> Column:
    """PR22"""
    return F.format_string(
        "NLP consistency run for '%s': %d consistency finding(s) against %d documented requirement statement(s).",
        root, findings, statements,
    )


def prediction_summary(root, regression, debt, trend, failure) -> Column:
    """PR22"""
    return F.format_string(
        "ML prediction run for '%s': regression_risk=%s, technical_debt=%s, quality_trend=%s, failure_probability=%s.",
        root, regression, debt, trend, failure,
    )


def visual_summary(baseline, current, verdict, findings) -> Column:
    """PR22"""
    return F.format_string("Visual comparison '%s' -> '%s': verdict=%s, findings=%d.", baseline, current, verdict, findings)


def guard_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PR21: non-blank text and 1 to 50 results; the rest is quarantined."""
    good = (strip(F.coalesce("query_text", F.lit(""))) != "") & F.col("top_k").between(1, 50)
    good = F.coalesce(good, F.lit(False))
    return queries.where(good), queries.where(~good)


def distance_similarity(distance) -> Column:
    """SO7: 1 - clamp(distance, 0, 2) / 2, 4 digits."""
    return rounded(1.0 - clamp(distance, 0.0, 2.0) / 2.0, 4)


def _unit_rows(column: pd.Series) -> np.ndarray:
    matrix = np.array(column.tolist(), dtype=float)
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def _top_of_cell(queries: pd.DataFrame, records: pd.DataFrame) -> pd.DataFrame:
    """Best records per query of one cell: a matrix product, cut to k rows per query at once."""
    if queries.empty or records.empty:
        return pd.DataFrame(columns=["project_id", "query_id", "top_k", "record_id", "cosine"])
    scores = np.round(np.clip(_unit_rows(queries["embedding"]) @ _unit_rows(records["embedding"]).T, -1.0, 1.0), 8)
    names, types = records["record_id"].to_numpy(), records["record_type"].to_numpy()
    parts = []
    for row, query in zip(scores, queries.itertuples(index=False), strict=True):
        if query.record_type is not None:
            row = np.where(types == query.record_type, row, -np.inf)
        k = min(query.top_k, len(row))
        # all rows at or above the k-th score, so that ties are decided by id
        near = np.flatnonzero((row >= np.partition(row, -k)[-k]) & (row > -np.inf))
        found = pd.DataFrame({"record_id": names[near], "cosine": row[near]})
        found = found.sort_values(["cosine", "record_id"], ascending=[False, True]).head(k)
        parts.append(found.assign(project_id=query.project_id, query_id=query.query_id, top_k=query.top_k))
    return pd.concat(parts)[["project_id", "query_id", "top_k", "record_id", "cosine"]]


def recall_topk(records: DataFrame, queries: DataFrame, query_rows: int = 500, record_rows: int = 10_000) -> DataFrame:
    """SO7: the k most similar records of each query's project, exactly.

    ``records`` has record_id, project_id, record_type, embedding; ``queries`` has query_id,
    project_id, embedding, top_k, record_type (null for any); a query is named by its project
    and id. Both sides of a project are cut into blocks, each pair of blocks keeps k rows per
    query, and only those are shuffled and ranked, whatever the size of a project.
    """
    slim = records.select("record_id", "project_id", "record_type", F.col("embedding").cast("array<double>"))
    wanted = queries.select("query_id", "project_id", F.col("embedding").cast("array<double>"), F.col("top_k").cast("int").alias("top_k"), "record_type")
    kinds = dict(slim.dtypes) | {"query_id": dict(wanted.dtypes)["query_id"]}
    left, right = block_pairs(wanted, slim, ["project_id"], "query_id", "record_id", query_rows, record_rows)
    schema = f"project_id {kinds['project_id']}, query_id {kinds['query_id']}, top_k int, record_id {kinds['record_id']}, cosine double"
    found = left.cogroup(right).applyInPandas(_top_of_cell, schema)
    order = Window.partitionBy("project_id", "query_id").orderBy(F.desc("cosine"), "record_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("top_k"))
    similarity = distance_similarity(1.0 - F.col("cosine"))
    return ranked.select("query_id", "project_id", "record_id", "rank", similarity.alias("similarity_score"))


def recall_hydrate(matches: DataFrame, records: DataFrame) -> DataFrame:
    """JN10: matches with their full records; a match without a record is dropped."""
    return matches.join(records, ["project_id", "record_id"])


def normalized_project_ids(rows: DataFrame) -> DataFrame:
    """PR5: trimmed lower-case project ids and whether they are well formed."""
    name = F.lower(strip("project_id"))
    return rows.withColumn("project_id", name).withColumn("valid", F.col("project_id").rlike(fixed.PROJECT_ID_PATTERN))


def cross_project_rows(run: DataFrame, inputs: DataFrame, keys: list[str]) -> DataFrame:
    """PR6: inputs of a run that belong to another project; must be empty for a sound run."""
    other = inputs.withColumnRenamed("project_id", "other_project_id")
    joined = run.join(other, keys).where(F.col("project_id") != F.col("other_project_id"))
    return joined.select(*keys, "project_id", "other_project_id")
