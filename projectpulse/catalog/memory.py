"""Registered memory queries over ``orders``, ``embeddings`` and ``customer``."""

from __future__ import annotations

from pyspark.sql import functions as F

from projectpulse.catalog import inputs
from projectpulse.catalog.inspection import RUN
from projectpulse.catalog.registry import cte, query, shown, sql_round, sql_ts, table
from projectpulse.operators import inspection, memory as M
from projectpulse.plans import reports


# the same order once more, a day later and with another summary, as a re-delivered record
cte("redelivered", """
SELECT * FROM records UNION ALL SELECT record_id, project_id, record_type, recorded_at + INTERVAL 1 DAY, seq, summary || '2', health_score FROM records WHERE summary <> 'P'
UNION ALL SELECT * FROM records
""", ("records",))


def redelivered(spark, sf_dir):
    rows = inputs.records(spark, sf_dir)
    later = rows.where("summary <> 'P'").withColumns({
        "recorded_at": F.col("recorded_at") + F.expr("INTERVAL 1 DAY"), "summary": F.concat("summary", F.lit("2"))})
    return rows, later.unionByName(rows)


@query("sc5_memory_upsert", f"""
SELECT record_id, {sql_ts("max(recorded_at)")} AS recorded_at, arg_max(summary, recorded_at) AS summary FROM redelivered GROUP BY record_id
""", ("redelivered",))
def _(spark, sf_dir):
    return shown(M.upsert(*redelivered(spark, sf_dir)).select("record_id", "recorded_at", "summary"))


@query("sc6_memory_history", """
SELECT project_id, record_id, CAST(r AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY recorded_at DESC, seq DESC) AS r FROM records) WHERE r <= 5
""", ("records",))
def _(spark, sf_dir):
    return shown(M.history(inputs.records(spark, sf_dir), 5).select("project_id", "record_id", "rank"))


@query("sc7_memory_by_ids", """
SELECT record_id, project_id, record_type FROM records WHERE seq IN (SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.095)
""", ("records",))
def _(spark, sf_dir):
    records = inputs.records(spark, sf_dir)
    wanted = table(spark, sf_dir, "lineitem").where("l_discount >= 0.095").select(F.col("l_orderkey").alias("seq")).distinct()
    ids = wanted.join(table(spark, sf_dir, "orders"), F.col("seq") == F.col("o_orderkey")).select(
        F.concat(F.lit("rec-"), F.col("seq").cast("string")).alias("record_id"), F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("project_id"))
    return M.by_ids(records, ids).select("record_id", "project_id", "record_type")


cte("inspected", """
SELECT 'run-' || project_id || '-' || run_id AS record_id, project_id, 'inspection' AS record_type,
  printf('Inspection run for ''/src'': status=completed, health_score=%.2f, files=%d, findings=%d.', health_score, file_count, finding_count) AS summary,
  health_score, finding_count FROM health
""", ("health",))


def inspection_records(spark, sf_dir):
    health = inspection.health_scores(inputs.runs(inputs.inventory(spark, sf_dir)), inputs.findings(spark, sf_dir))
    rows = health.withColumns({
        "record_id": F.concat_ws("-", F.lit("run"), "project_id", "run_id"),
        "recorded_at": F.make_timestamp(F.col("run_id").cast("int"), F.lit(12), F.lit(31), F.lit(0), F.lit(0), F.lit(0)),
        "seq": F.col("run_id"),
    })
    summary = M.inspection_summary(F.lit("/src"), F.lit("completed"), F.col("health_score"), F.col("file_count"), F.col("finding_count"))
    return M.record_report(rows, "inspection", summary, F.col("health_score"))


@query("sc10_record_report", "SELECT record_id, project_id, record_type, health_score, finding_count FROM inspected", ("inspected",))
def _(spark, sf_dir):
    rows = inspection_records(spark, sf_dir)
    count = F.get_json_object("payload", "$.finding_count").cast("bigint")
    return rows.select("record_id", "project_id", "record_type", "health_score", count.alias("finding_count"))


@query("pr22_report_summary", "SELECT record_id, summary FROM inspected", ("inspected",))
def _(spark, sf_dir):
    return inspection_records(spark, sf_dir).select("record_id", "summary")


@query("pr22_other_summaries", """
SELECT o_orderkey, 'AI reasoning run for ''' || o_orderstatus || ''': ' || o_custkey || ' correlation group(s), ' || o_orderkey || ' dependency assessment(s), 3 recommendation(s)'
    || CASE WHEN o_orderstatus = 'F' THEN '; drift churn=high' ELSE '' END || '.' AS reasoning,
  'NLP consistency run for ''' || o_orderstatus || ''': ' || o_custkey || ' consistency finding(s) against ' || o_orderkey || ' documented requirement statement(s).' AS nlp
FROM orders
""")
def _(spark, sf_dir):
    root, churn = F.col("o_orderstatus"), F.when(F.col("o_orderstatus") == "F", "high")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", M.reasoning_summary(root, F.col("o_custkey"), F.col("o_orderkey"), F.lit(3), churn).alias("reasoning"),
        M.nlp_summary(root, F.col("o_custkey"), F.col("o_orderkey")).alias("nlp"))


@query("fn24_to_json_report", """
SELECT record_id, json_extract_string(p, '$.project_id') IS NULL AS header_kept_out, CAST(json_extract_string(p, '$.run_id') AS BIGINT) AS run_id FROM (
  SELECT 'run-' || project_id || '-' || run_id AS record_id, to_json({'run_id': run_id, 'n': finding_count}) AS p FROM health)
""", ("health",))
def _(spark, sf_dir):
    rows = inspection_records(spark, sf_dir)
    value = lambda name: F.get_json_object("payload", f"$.{name}")
    return rows.select("record_id", value("project_id").isNull().alias("header_kept_out"), value("run_id").cast("bigint").alias("run_id"))


@query("so6_trend_series", """
SELECT project_id, record_id, round(health_score, 6) AS health_score FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY recorded_at, seq) AS r FROM records WHERE health_score IS NOT NULL) WHERE r <= 4
""", ("records",))
def _(spark, sf_dir):
    rows = M.series_order(M.trend_series(inputs.records(spark, sf_dir), None, 4))
    return shown(rows.select("project_id", "record_id", "health_score"))


@query("so8_path_order", "SELECT project_id, run_id, relative_path FROM inventory ORDER BY ALL", ("inventory",))
def _(spark, sf_dir):
    return inputs.inventory(spark, sf_dir).select(*RUN, "relative_path").orderBy(*RUN, "relative_path")


@query("pr5_validate_project_id", """
SELECT c_custkey, lower(trim(n)) AS project_id, regexp_full_match(lower(trim(n)), '[a-z0-9][a-z0-9_-]{1,61}[a-z0-9]') AS valid FROM (
  SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_name WHEN c_acctbal < 3000 THEN ' ' || replace(c_name, '#', '-') || ' ' WHEN c_acctbal < 6000 THEN c_mktsegment ELSE '_' || c_mktsegment END AS n FROM customer)
""")
def _(spark, sf_dir):
    balance = F.col("c_acctbal")
    name = (
        F.when(balance < 0, F.col("c_name")).when(balance < 3000, F.concat(F.lit(" "), F.replace("c_name", F.lit("#"), F.lit("-")), F.lit(" ")))
        .when(balance < 6000, F.col("c_mktsegment")).otherwise(F.concat(F.lit("_"), "c_mktsegment"))
    )
    return M.normalized_project_ids(table(spark, sf_dir, "customer").select("c_custkey", name.alias("project_id")))


@query("pr6_cross_project_guard", """
SELECT a.record_id, a.project_id, b.project_id AS other_project_id FROM records a
JOIN (SELECT 'rec-' || l_orderkey AS record_id, 'customer-' || l_suppkey AS project_id FROM lineitem) b ON a.record_id = b.record_id AND a.project_id <> b.project_id
""", ("records",))
def _(spark, sf_dir):
    other = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("rec-"), F.col("l_orderkey").cast("string")).alias("record_id"), F.concat(F.lit("customer-"), F.col("l_suppkey").cast("string")).alias("project_id"))
    return M.cross_project_rows(inputs.records(spark, sf_dir), other, ["record_id"])


@query("pr7_record_type_filter", "SELECT record_type, count(*) AS n FROM records GROUP BY ALL", ("records",))
def _(spark, sf_dir):
    return M.check_record_types(inputs.records(spark, sf_dir)).groupBy("record_type").agg(F.count("*").alias("n"))


@query("pr21_memory_query_guard", """
SELECT item_id, length(trim(t)) > 0 AND k BETWEEN 1 AND 50 AS accepted FROM (SELECT item_id, CASE WHEN length(text) < 150 THEN '  ' ELSE text END AS t, item_id AS k FROM benchmark)
""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(
        "item_id", F.when(F.length("text") < 150, "  ").otherwise(F.col("text")).alias("query_text"), F.col("item_id").alias("top_k"))
    good, bad = M.guard_queries(rows)
    return good.select("item_id", F.lit(True).alias("accepted")).unionByName(bad.select("item_id", F.lit(False).alias("accepted")))


# recall: one query per label, the mean vector of its records, against all records
cte("centroids", """
SELECT label AS query_id, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, generate_series(1, 64) AS g(i) GROUP BY ALL) GROUP BY label
""")
cte("recalled", f"""
SELECT query_id, vec_id AS record_id, r AS rank, {sql_round('1 - least(2, greatest(0, 1 - c)) / 2', 4)} AS similarity_score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS r FROM (
    SELECT q.query_id, e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.v), 8) AS c FROM embeddings e, centroids q)) WHERE r <= 5
""", ("centroids",))


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("record_id"), F.lit("memory").alias("project_id"), F.lit("inspection").alias("record_type"), "embedding", "label")


def centroid_queries(spark, sf_dir):
    cells = vectors(spark, sf_dir).select("label", F.posexplode("embedding").alias("pos", "value"))
    means = cells.groupBy("label", "pos").agg(F.avg(F.col("value").cast("double")).alias("m"))
    whole = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda p: p.m).alias("embedding"))
    return whole.select(F.col("label").cast("bigint").alias("query_id"), F.lit("memory").alias("project_id"), "embedding",
                        F.lit(5).alias("top_k"), F.lit(None).cast("string").alias("record_type"), F.lit("mean of a label").alias("query_text"))


@query("so7_recall_topk", "SELECT CAST(query_id AS BIGINT) AS query_id, record_id, CAST(rank AS BIGINT) AS rank, similarity_score FROM recalled", ("recalled",))
def _(spark, sf_dir):
    found = M.recall_topk(vectors(spark, sf_dir), centroid_queries(spark, sf_dir))
    return found.select("query_id", "record_id", F.col("rank").cast("bigint").alias("rank"), "similarity_score")


@query("jn10_recall_hydrate", """
SELECT CAST(query_id AS BIGINT) AS query_id, record_id, similarity_score, CAST(e.label AS BIGINT) AS label FROM recalled JOIN embeddings e ON e.vec_id = record_id WHERE e.label < 5
""", ("recalled",))
def _(spark, sf_dir):
    kept = vectors(spark, sf_dir).where("label < 5").select("record_id", "project_id", F.col("label").cast("bigint").alias("label"))
    return M.recall_hydrate(M.recall_topk(vectors(spark, sf_dir), centroid_queries(spark, sf_dir)), kept).select(
        "query_id", "record_id", "similarity_score", "label")


@query("rp7_recall", """
SELECT CAST(query_id AS BIGINT) AS query_id, record_id, similarity_score, CAST(e.label AS BIGINT) AS label FROM recalled JOIN embeddings e ON e.vec_id = record_id
""", ("recalled",))
def _(spark, sf_dir):
    records = vectors(spark, sf_dir).select("record_id", "project_id", F.col("label").cast("bigint").alias("label"))
    return reports.recall(records, vectors(spark, sf_dir), centroid_queries(spark, sf_dir)).select("query_id", "record_id", "similarity_score", "label")
