"""Registered inspection queries over ``lineitem``, ``part``, ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from projectpulse.catalog import inputs
from projectpulse.catalog.registry import query, sql_round, table, text_table
from projectpulse.functions import files as ff
from projectpulse.functions import fixed
from projectpulse.functions.scalars import band, per_file, severity_weight
from projectpulse.operators import inspection as I
from projectpulse.sources.code import code_facts, comment_lines, text_blobs

RUN = ["project_id", "run_id"]
BAND_SQL = "CASE WHEN {x} >= {a} THEN '{A}' WHEN {x} >= {b} THEN '{B}' WHEN {x} >= {c} THEN '{C}' ELSE '{D}' END"
MARKERS = {"LICENSE": r"(?i)\blicense\b", "EMAIL": r"[a-z0-9]+@[a-z0-9.]+", "UPPER": r"[A-Z]{5,}"}


def sql_band(x: str, bands) -> str:
    bounds, rest = bands
    tests = " ".join(f"WHEN {x} >= {low} THEN '{label}'" for low, label in bounds)
    return f"CASE {tests} ELSE " + ("NULL" if rest is None else f"'{rest}'") + " END"


def document_files(spark, sf_dir):
    """Every document as a text file: project = source, path = language/id."""
    return text_table(spark, sf_dir, "documents").select(
        F.col("source").alias("project_id"), F.lit(0).cast("bigint").alias("run_id"),
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text",
        F.encode("text", "UTF-8").alias("content"),
    )


@query("sc1_file_inventory", """
SELECT source AS project_id, lang || '/' || doc_id || '.txt' AS relative_path, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes,
  CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN 0 ELSE 1 END AS BIGINT) AS line_count,
  'txt' AS extension, sha256(text) AS content_hash FROM documents
""")
def _(spark, sf_dir):
    contents = document_files(spark, sf_dir).withColumn("size_bytes", F.octet_length("content").cast("bigint"))
    return I.file_records(contents).drop("run_id")


@query("fn2_line_count", """
SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN 0 ELSE 1 END AS BIGINT) AS line_count
FROM documents
""")
def _(spark, sf_dir):
    return text_table(spark, sf_dir, "documents").select("doc_id", ff.line_count(F.encode("text", "UTF-8")).alias("line_count"))


@query("fn3_sha256", "SELECT page_id, sha256(html) AS content_hash FROM pages")
def _(spark, sf_dir):
    return text_table(spark, sf_dir, "pages").select("page_id", ff.sha256(F.encode("html", "UTF-8")).alias("content_hash"))


@query("fn4_paths", """
SELECT project_id, relative_path, coalesce(nullif(regexp_extract(relative_path, '\\.([^./]+)$', 1), ''), '') AS extension,
  regexp_replace(relative_path, '/[^/]*$', '') AS parent,
  regexp_replace(replace(regexp_replace(relative_path, '\\.py$', ''), '/', '.'), '\\.__init__$', '') AS module
FROM paths
""", ("paths",))
def _(spark, sf_dir):
    p = "relative_path"
    return inputs.paths(spark, sf_dir).select(
        "project_id", p, ff.extension(p).alias("extension"), ff.parent(p).alias("parent"), ff.module_name(p).alias("module"))


@query("pr8_exclude_tests", """
SELECT project_id, relative_path FROM paths
WHERE NOT (regexp_matches(relative_path, '(^|/)test_[^/]*$') OR regexp_matches(relative_path, '(^|/)tests(/|$)'))
""", ("paths",))
def _(spark, sf_dir):
    return inputs.paths(spark, sf_dir).where(~ff.is_test_file("relative_path")).select("project_id", "relative_path")


@query("sc11_discover_documents", """
SELECT project_id, relative_path, kind FROM (SELECT *, CASE
  WHEN relative_path LIKE '%/README.md' THEN 'readme'
  WHEN regexp_matches(relative_path, '/requirements[^/]*\\.txt$') THEN 'dependency_manifest'
  WHEN relative_path LIKE '%.py' AND NOT regexp_matches(relative_path, '(^|/)(test_[^/]*$|tests/)') THEN 'python_source' END AS kind FROM paths)
WHERE kind IS NOT NULL
""", ("paths",))
def _(spark, sf_dir):
    return I.discover_documents(inputs.paths(spark, sf_dir)).select("project_id", "relative_path", "kind")


@query("jn5_missing_package_init", """
SELECT project_id, directory AS file_path, 'MISSING_INIT_FILE' AS code,
  'Directory ''' || directory || ''' contains Python source files but no __init__.py, so it is not an importable package.' AS message
FROM (SELECT project_id, regexp_replace(relative_path, '/[^/]*$', '') AS directory, bool_or(relative_path LIKE '%/__init__.py') AS ok FROM paths
  WHERE relative_path LIKE '%.py' AND NOT regexp_matches(relative_path, '(^|/)(test_[^/]*$|tests/)') GROUP BY ALL) WHERE NOT ok
""", ("paths",))
def _(spark, sf_dir):
    return I.missing_package_init(inputs.paths(spark, sf_dir)).select("project_id", "file_path", "code", "message")


@query("jn15_marker_scan", "\nUNION ALL ".join(
    f"""SELECT source AS project_id, lang || '/' || doc_id || '.txt' AS file_path, 'FORBIDDEN_MARKER_{name}' AS code, CAST(i AS BIGINT) AS line
FROM (SELECT *, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (
  SELECT *, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{0085}}\\x{{2028}}\\x{{2029}}]') AS parts FROM documents))
WHERE regexp_matches(part, '{pattern}')""" for name, pattern in MARKERS.items()
))
def _(spark, sf_dir):
    found = I.marker_scan(document_files(spark, sf_dir), MARKERS, all_files=True)
    return found.select("project_id", "file_path", "code", "line")


@query("wn12_line_numbers", """
SELECT doc_id, count(*) AS matched_lines, CAST(min(i) AS BIGINT) AS first_line, CAST(max(i) AS BIGINT) AS last_line
FROM (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (
  SELECT doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{0085}\\x{2028}\\x{2029}]') AS parts FROM documents))
WHERE regexp_matches(part, '[0-9]') GROUP BY ALL
""")
def _(spark, sf_dir):
    lines = text_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(ff.lines_of("text")).alias("pos", "part"))
    hits = lines.where(F.col("part").rlike("[0-9]")).groupBy("doc_id")
    return hits.agg(F.count("*").alias("matched_lines"), (F.min("pos") + 1).cast("bigint").alias("first_line"),
                    (F.max("pos") + 1).cast("bigint").alias("last_line"))


@query("fn10_comment_text", """
SELECT doc_id, count(*) AS comments FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{0085}\\x{2028}\\x{2029}]')) AS part
  FROM (SELECT doc_id, '# ' || replace(text, chr(10), chr(10) || '#  ') AS text FROM documents))
WHERE trim(part) LIKE '#%' AND trim(part) NOT LIKE '#!%' AND trim(regexp_replace(trim(part), '^#+', '')) <> ''
  AND NOT regexp_matches(trim(regexp_replace(trim(part), '^#+', '')), 'coding[:=]\\s*[-\\w.]+') GROUP BY ALL
""")
def _(spark, sf_dir):
    rows = text_table(spark, sf_dir, "documents").select(
        F.lit("p").alias("project_id"), F.lit(0).alias("run_id"), F.col("doc_id").alias("path"), F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n#  "))).alias("text"))
    return comment_lines(rows).groupBy(F.col("path").alias("doc_id")).agg(F.count("*").alias("comments"))


@query("jn1_snapshot_drift", """
SELECT project_id, run_id, code, CASE WHEN code = 'FILE_REMOVED' THEN 'warning' ELSE 'info' END AS severity, file_path,
  'File ' || lower(substr(code, 6)) || ' since previous inspection: ' || file_path AS message FROM drift
""", ("drift",))
def _(spark, sf_dir):
    files = inputs.inventory(spark, sf_dir)
    return I.consecutive_drift(files, files).select(*RUN, "code", "severity", "file_path", "message")


@query("se2_path_sets", """
SELECT project_id, run_id, count(*) FILTER (WHERE code = 'FILE_ADDED') AS added, count(*) FILTER (WHERE code = 'FILE_REMOVED') AS removed,
  count(*) FILTER (WHERE code = 'FILE_MODIFIED') AS modified FROM drift GROUP BY ALL
""", ("drift",))
def _(spark, sf_dir):
    files = inputs.inventory(spark, sf_dir)
    kinds = [F.count_if(F.col("code") == f"FILE_{k.upper()}").alias(k) for k in ("added", "removed", "modified")]
    return I.consecutive_drift(files, files).groupBy(*RUN).agg(*kinds)


@query("sc9_latest_snapshot", """
SELECT project_id, arg_max(record_id, {'a': recorded_at, 'b': record_id}) AS record_id FROM records WHERE record_type = 'inspection' GROUP BY ALL
""", ("records",))
def _(spark, sf_dir):
    records = inputs.records(spark, sf_dir).withColumn("payload", F.col("summary"))
    return I.latest_snapshot(records).select("project_id", "record_id")


@query("ag1_health_score", "SELECT project_id, run_id, file_count, finding_count, health_score FROM health", ("health",))
def _(spark, sf_dir):
    return I.health_scores(inputs.runs(inputs.inventory(spark, sf_dir)), inputs.findings(spark, sf_dir))


@query("ag2_count_by_severity", "SELECT r.project_id, r.run_id, " + ", ".join(
    f"count(*) FILTER (WHERE severity = '{s}') AS {s}_count" for s in fixed.SEVERITY_WEIGHTS
) + " FROM runs r LEFT JOIN findings f USING (project_id, run_id) GROUP BY ALL", ("runs", "findings"))
def _(spark, sf_dir):
    return I.count_by_severity(inputs.runs(inputs.inventory(spark, sf_dir)), inputs.findings(spark, sf_dir))


@query("pr9_severity_weight", """
SELECT project_id, severity, count(*) AS findings, CAST(sum(weight) AS BIGINT) AS weight FROM findings GROUP BY ALL
""", ("findings",))
def _(spark, sf_dir):
    rows = inputs.findings(spark, sf_dir)
    return rows.groupBy("project_id", "severity").agg(F.count("*").alias("findings"), F.sum(severity_weight("severity")).alias("weight"))


@query("pr16_findings_by_severity", "SELECT project_id, run_id, code, file_path FROM findings WHERE severity = 'critical'", ("findings",))
def _(spark, sf_dir):
    return I.findings_by_severity(inputs.findings(spark, sf_dir), "critical").select(*RUN, "code", "file_path")


@query("se1_union_findings", """
SELECT project_id, run_id, category, count(*) AS findings FROM (
  SELECT project_id, run_id, category FROM findings UNION ALL SELECT project_id, run_id, 'drift' FROM drift) GROUP BY ALL
""", ("findings", "drift"))
def _(spark, sf_dir):
    files = inputs.inventory(spark, sf_dir)
    rows = I.union_findings(inputs.findings(spark, sf_dir), I.consecutive_drift(files, files))
    return rows.groupBy(*RUN, "category").agg(F.count("*").alias("findings"))


@query("fn20_churn_ratio", f"""
SELECT r.project_id, r.run_id, {sql_round('count(d.code) / greatest(any_value(r.file_count), 1)', 4)} AS churn_ratio
FROM runs r LEFT JOIN drift d USING (project_id, run_id) GROUP BY ALL
""", ("runs", "drift"))
def _(spark, sf_dir):
    files = inputs.inventory(spark, sf_dir)
    counts = I.consecutive_drift(files, files).groupBy(*RUN).agg(F.count("*").alias("n"))
    joined = inputs.runs(files).join(counts, RUN, "left")
    return joined.select(*RUN, per_file(F.coalesce("n", F.lit(0)), "file_count").alias("churn_ratio"))


_PR10 = {
    "probability": ("l_discount * 10", fixed.PROBABILITY_BANDS), "debt": ("l_quantity * 2", fixed.DEBT_BANDS),
    "module": ("l_tax * 20", fixed.MODULE_BANDS), "churn": ("l_discount * 5", fixed.CHURN_BANDS),
    "pixel": ("l_tax * 5", fixed.PIXEL_BANDS), "layout": ("l_discount * 6", fixed.LAYOUT_BANDS),
    "embedding": ("1 - l_tax * 3", fixed.EMBEDDING_BANDS), "priority": ("l_quantity / 2", fixed.PRIORITY_BANDS),
    "overlap": ("l_discount * 9", fixed.OVERLAP_BANDS),
}


@query("pr10_classify_threshold", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, " + ", ".join(
    f"{sql_band(x, b)} AS {n}" for n, (x, b) in _PR10.items()
) + " FROM lineitem")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    levels = [band(F.expr(x), b).alias(n) for n, (x, b) in _PR10.items()]
    return rows.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey", *levels)


def python_sources(spark, sf_dir):
    """Every document wrapped into a small module: each of its lines is a comment and a branch.

    The function has as many branches as the document has lines; English ones have a docstring,
    German ones do not parse.
    """
    docs = text_table(spark, sf_dir, "documents")
    body = F.concat(
        F.lit("import os\nimport numpy as np\nfrom . import helpers\n\n\ndef work(x):\n"),
        F.array_join(F.transform(ff.lines_of("text"), lambda line: F.concat(
            F.lit("    # "), line, F.lit("\n    if x > "), F.length(line).cast("string"), F.lit(":\n        x += 1"))), "\n"),
        F.lit("\n    return x\n\n\nclass Box:\n    pass\n"),
    )
    source = F.when(F.col("lang") == "en", F.concat(F.lit('"""Document module."""\n'), body)).when(
        F.col("lang") == "de", F.concat(body, F.lit("def broken(:\n"))
    ).otherwise(body)
    return docs.select(
        F.col("source").alias("project_id"), F.lit(0).cast("bigint").alias("run_id"),
        F.concat("lang", F.lit("/m"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
        source.alias("text"), F.encode(source, "UTF-8").alias("content"), "doc_id", "lang",
    )


_MODULE_LINES = """len(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{0085}\\x{2028}\\x{2029}]'))
  - CASE WHEN text = '' OR regexp_matches(text, '[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{0085}\\x{2028}\\x{2029}]\\z') THEN 1 ELSE 0 END"""


@query("ag19_complexity_stats", f"""
SELECT source AS project_id, lang || '/m' || doc_id || '.py' AS relative_path,
  CAST(CASE WHEN lang = 'de' THEN 0 ELSE 1 + {_MODULE_LINES} END AS BIGINT) AS max_cyclomatic_complexity,
  CAST(CASE WHEN lang = 'de' THEN 0 ELSE 1 + {_MODULE_LINES} END AS DOUBLE) AS average_cyclomatic_complexity,
  lang = 'de' AS has_syntax_error FROM documents
""")
def _(spark, sf_dir):
    metrics = I.file_metrics(code_facts(python_sources(spark, sf_dir)))
    return metrics.select("project_id", "relative_path", "max_cyclomatic_complexity", "average_cyclomatic_complexity", "has_syntax_error")


@query("ag20_docstring_coverage", """
SELECT source AS project_id, lang || '/m' || doc_id || '.py' AS relative_path, CAST(CASE lang WHEN 'en' THEN 0.33 ELSE 0.0 END AS DOUBLE) AS docstring_coverage FROM documents
""")
def _(spark, sf_dir):
    return I.file_metrics(code_facts(python_sources(spark, sf_dir))).select("project_id", "relative_path", "docstring_coverage")


@query("ag21_complexity_findings", f"""
SELECT source AS project_id, lang || '/m' || doc_id || '.py' AS file_path, CASE WHEN c >= 20 THEN 'error' ELSE 'warning' END AS severity,
  'Function ''work'' has cyclomatic complexity ' || c || ', exceeding the threshold of 10.' AS message
FROM (SELECT *, 1 + {_MODULE_LINES} AS c FROM documents WHERE lang <> 'de') WHERE c >= 10
""")
def _(spark, sf_dir):
    found = I.complexity_findings(code_facts(python_sources(spark, sf_dir)))
    return found.select("project_id", "file_path", "severity", "message")


@query("ag22_docstring_findings", """
SELECT source AS project_id, lang || '/m' || doc_id || '.py' AS file_path, 'LOW_DOCSTRING_COVERAGE' AS code,
  'Docstring coverage is 0%, below the 30% threshold.' AS message FROM documents WHERE lang NOT IN ('en', 'de')
""")
def _(spark, sf_dir):
    found = I.docstring_findings(I.file_metrics(code_facts(python_sources(spark, sf_dir))))
    return found.select("project_id", "file_path", "code", "message")


@query("sc12_code_facts", """
SELECT source AS project_id, kind, count(*) AS facts FROM (
  SELECT source, unnest(CASE WHEN lang = 'de' THEN ['syntax_error'] ELSE ['module', 'function', 'class', 'import', 'import', 'import_from'] END) AS kind
  FROM documents) GROUP BY ALL
""")
def _(spark, sf_dir):
    return code_facts(python_sources(spark, sf_dir)).groupBy("project_id", "kind").agg(F.count("*").alias("facts"))


@query("ag31_text_blob", f"""
SELECT source AS project_id, lang || '/m' || doc_id || '.py' AS path, CAST(2 + CASE WHEN lang = 'en' THEN 2 ELSE 0 END
  + list_sum(list_transform(lines, lambda x: CASE WHEN x = '' THEN 0 ELSE len(string_split(x, ' ')) END)) AS BIGINT) AS words
FROM (SELECT *, list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{0085}}\\x{{2028}}\\x{{2029}}]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS lines FROM documents WHERE lang <> 'de')
""")
def _(spark, sf_dir):
    sources = python_sources(spark, sf_dir)
    blobs = text_blobs(code_facts(sources), comment_lines(sources))
    return blobs.select("project_id", "path", F.size(F.split("blob", " ")).cast("bigint").alias("words"))


@query("ud1_pattern_overrides", """
SELECT source AS project_id, count(*) AS findings FROM (SELECT source, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{0085}\\x{2028}\\x{2029}]')) AS part FROM documents)
WHERE regexp_matches(part, '[0-9]{3,}') GROUP BY ALL
""")
def _(spark, sf_dir):
    found = I.marker_scan(document_files(spark, sf_dir), {"NUMBER": "[0-9]{3,}"}, all_files=True)
    return found.groupBy("project_id").agg(F.count("*").alias("findings"))


@query("ud1_marker_table", """
WITH markers AS (
  SELECT DISTINCT m AS name, '(^|[ .,])' || m || '($|[ .,])' AS pattern
  FROM (SELECT unnest(regexp_extract_all(text, '[a-z]{4,}')[1:2]) AS m FROM benchmark)
  UNION ALL SELECT 'NUMBER', '[0-9]{3,}'
), lines AS (
  SELECT source, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{0085}\\x{2028}\\x{2029}]')) AS part FROM documents)
SELECT source AS project_id, 'FORBIDDEN_MARKER_' || name AS code, count(*) AS findings FROM lines JOIN markers ON regexp_matches(part, pattern) GROUP BY ALL
""")
def _(spark, sf_dir):
    """Hundreds of markers from a table, one of them without any literal."""
    words = F.slice(F.regexp_extract_all("text", F.lit("[a-z]{4,}"), 0), 1, 2)
    names = table(spark, sf_dir, "benchmark").select(F.explode(words).alias("name")).distinct()
    markers = names.select("name", F.concat(F.lit("(^|[ .,])"), "name", F.lit("($|[ .,])")).alias("pattern"))
    markers = markers.unionByName(spark.range(1).select(F.lit("NUMBER").alias("name"), F.lit("[0-9]{3,}").alias("pattern")))
    found = I.marker_table_scan(document_files(spark, sf_dir), markers, all_files=True)
    return found.groupBy("project_id", "code").agg(F.count("*").alias("findings"))


@query("ud3_code_facts", """
SELECT source AS project_id, name, level, count(*) AS imports FROM (
  SELECT source, unnest([{'name': 'os', 'level': 0}, {'name': 'numpy', 'level': 0}, {'name': '', 'level': 1}], recursive := true) FROM documents WHERE lang <> 'de')
GROUP BY ALL
""".replace("SELECT source AS project_id, name, level,", "SELECT source AS project_id, name, CAST(level AS BIGINT) AS level,"))
def _(spark, sf_dir):
    facts = code_facts(python_sources(spark, sf_dir)).where(F.col("kind").isin("import", "import_from"))
    return facts.groupBy("project_id", "name", F.col("level").cast("bigint").alias("level")).agg(F.count("*").alias("imports"))
