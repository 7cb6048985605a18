"""Registered text queries over ``documents``, ``benchmark``, ``conversations``, ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from projectpulse.catalog import inputs
from projectpulse.catalog.inspection import RUN, python_sources
from projectpulse.catalog.inputs import sql_tokens
from projectpulse.catalog.registry import cte, query, shown, sql_round, table, text_table
from projectpulse.functions import files as ff
from projectpulse.functions import fixed
from projectpulse.functions import text as ft
from projectpulse.operators import text as X
from projectpulse.plans import reports
from projectpulse.sources.code import code_facts

_SPACES = " || ".join(f"chr({ord(c)})" for c in fixed.WHITESPACE)
_BREAKS = "'\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{0085}\\x{2028}\\x{2029}]'"


def sql_lines(text: str) -> str:
    return f"regexp_split_to_array({text}, {_BREAKS})"


def sql_strip(text: str) -> str:
    return f"trim({text}, {_SPACES})"


def derived_documents(spark, sf_dir, text):
    """Documents with a text derived from their own, e.g. as Markdown."""
    return text_table(spark, sf_dir, "documents").select(
        F.col("source").alias("project_id"), F.lit(0).cast("bigint").alias("run_id"),
        F.lpad(F.col("doc_id").cast("string"), 19, "0").alias("path"), text.alias("text"))


@query("fn1_tokenize", """
SELECT doc_id, CAST(len(tokens) AS BIGINT) AS token_count, md5(array_to_string(tokens, ' ')) AS token_hash FROM doc_tokens
""", ("doc_tokens",))
def _(spark, sf_dir):
    rows = text_table(spark, sf_dir, "documents").select("doc_id", ft.tokenize("text").alias("tokens"))
    return rows.select("doc_id", F.size("tokens").cast("bigint").alias("token_count"), F.md5(F.array_join("tokens", " ")).alias("token_hash"))


@query("fn1_tokenize_identifiers", f"""
SELECT page_id, CAST(len(tokens) AS BIGINT) AS token_count, md5(array_to_string(tokens, ' ')) AS token_hash
FROM (SELECT page_id, {sql_tokens('html')} AS tokens FROM pages)
""")
def _(spark, sf_dir):
    rows = text_table(spark, sf_dir, "pages").select("page_id", ft.tokenize("html").alias("tokens"))
    return rows.select("page_id", F.size("tokens").cast("bigint").alias("token_count"), F.md5(F.array_join("tokens", " ")).alias("token_hash"))


@query("se4_keyword_overlap", f"""
SELECT a.conv_id, a.turn, {sql_round('len(list_intersect(a.k, b.k)) / nullif(len(a.k), 0)', 6)} AS overlap
FROM (SELECT conv_id, turn, list_distinct({sql_tokens('text')}) AS k FROM conversations) a
JOIN (SELECT conv_id, turn - 1 AS turn, list_distinct({sql_tokens('text')}) AS k FROM conversations) b USING (conv_id, turn)
""")
def _(spark, sf_dir):
    turns = text_table(spark, sf_dir, "conversations").select("conv_id", "turn", ft.keywords("text").alias("a"))
    answers = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    return shown(turns.join(answers, ["conv_id", "turn"]).select("conv_id", "turn", ft.keyword_overlap("a", "b").alias("overlap")))


@query("fn5_resolve_relative", """
SELECT p_partkey, array_to_string(list_concat(list_slice(parts, 1, greatest(len(parts) - (p_size - CASE WHEN pkg THEN 1 ELSE 0 END), 0)), ['util', 'io']), '.') AS module
FROM (SELECT p_partkey, p_size, p_brand = 'Brand#1' AS pkg, string_split(lower(p_type) || '.' || replace(p_name, ' ', '.'), '.') AS parts FROM part)
""")
def _(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("m", F.concat(F.lower("p_type"), F.lit("."), F.replace("p_name", F.lit(" "), F.lit("."))))
    return part.select("p_partkey", ff.resolve_relative("m", F.col("p_brand") == "Brand#1", F.col("p_size"), F.lit("util.io")).alias("module"))


@query("fn6_extract_title", f"""
SELECT doc_id, nullif({sql_strip("regexp_extract('intro' || chr(10) || '# ' || text, '(?m)^#[ ]+(.+)$', 1)")}, '') AS title FROM documents
""")
def _(spark, sf_dir):
    text = F.concat(F.lit("intro\n# "), "text")
    return text_table(spark, sf_dir, "documents").select("doc_id", ft.extract_title(text).alias("title"))


cte("modal", f"""
SELECT doc_id, source, CAST(i AS BIGINT) AS line, s FROM (
  SELECT doc_id, source, i, {sql_strip('p')} AS s FROM (SELECT doc_id, source, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM (
    SELECT doc_id, source, {sql_lines("replace(text, ' the ', ' must ')")} AS parts FROM documents)))
WHERE s <> '' AND (regexp_matches(s, '(?i)\\b(must|shall|should)\\b') OR regexp_matches(s, '(?i)^as\\s+an?\\s+.+,?\\s*i\\s+want\\b'))
""")
_BULLET_SQL = sql_strip("regexp_extract(s, '^[-*+]\\s+(.+)$', 1)")
_CLEAN = f"CASE WHEN {_BULLET_SQL} <> '' THEN {_BULLET_SQL} ELSE s END"


def modal_documents(spark, sf_dir):
    return derived_documents(spark, sf_dir, F.replace("text", F.lit(" the "), F.lit(" must ")))


@query("fn7_extract_requirements", f"""
SELECT source AS project_id, lpad(CAST(doc_id AS VARCHAR), 19, '0') AS source_path, line, md5(clean) AS text_hash, array_to_string(keywords, ' ') AS keywords
FROM (SELECT *, list_sort(list_distinct({sql_tokens('clean')})) AS keywords FROM (SELECT *, {_CLEAN} AS clean FROM modal)) WHERE len(keywords) > 0
""", ("modal",))
def _(spark, sf_dir):
    rows = X.requirements(modal_documents(spark, sf_dir))
    return rows.select("project_id", "source_path", F.col("line").cast("bigint").alias("line"), F.md5("text").alias("text_hash"),
                       F.array_join("keywords", " ").alias("keywords"))


@query("fn8_extract_packages", f"""
SELECT DISTINCT source AS project_id, package FROM (
  SELECT source, lower(regexp_extract(s, '^([A-Za-z0-9][A-Za-z0-9_.\\-]*)', 1)) AS package FROM (
    SELECT source, {sql_strip('unnest(' + sql_lines('text') + ')')} AS s FROM documents) WHERE s <> '' AND s NOT LIKE '#%' AND s NOT LIKE '-%')
WHERE package <> ''
""")
def _(spark, sf_dir):
    return X.declared_packages(derived_documents(spark, sf_dir, F.col("text"))).select("project_id", "package")


_ALIAS_SQL = "CASE " + " ".join(f"WHEN c = '{a}' THEN '{m}'" for a, m in fixed.DISTRIBUTION_ALIASES.items()) + " ELSE replace(c, '-', '_') END"


@query("fn9_canonical_name", f"""
SELECT p_partkey, c AS canonical, {_ALIAS_SQL} AS module FROM (SELECT p_partkey, regexp_replace(lower(trim(n)), '[-_.]+', '-', 'g') AS c FROM (
  SELECT p_partkey, CASE WHEN p_size = 1 THEN 'PyYAML' WHEN p_size = 2 THEN 'Scikit_Learn' WHEN p_size = 3 THEN ' opencv.python ' WHEN p_size < 20 THEN replace(p_name, ' ', '-_.')
    ELSE replace(p_name, ' ', '.') END AS n FROM part))
""")
def _(spark, sf_dir):
    size = F.col("p_size")
    name = (
        F.when(size == 1, "PyYAML").when(size == 2, "Scikit_Learn").when(size == 3, " opencv.python ")
        .when(size < 20, F.replace("p_name", F.lit(" "), F.lit("-_."))).otherwise(F.replace("p_name", F.lit(" "), F.lit(".")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", ft.canonical_name(name).alias("canonical"), ft.import_name(name).alias("module"))


# every document as a README: its lines become bullets below a Features heading
cte("bullets", f"""
SELECT source AS project_id, doc_id, i, {sql_strip("regexp_extract(s, '^[-*+]\\s+(.+)$', 1)")} AS feature FROM (
  SELECT *, min(CASE WHEN NOT regexp_matches(s, '^[-*+]\\s+(.+)$') THEN i END) OVER (PARTITION BY doc_id) AS stop,
    min(CASE WHEN regexp_matches(s, '^[-*+]\\s+(.+)$') THEN i END) OVER (PARTITION BY doc_id) AS first FROM (
    SELECT doc_id, source, i, {sql_strip('p')} AS s FROM (SELECT doc_id, source, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM (
      SELECT doc_id, source, {sql_lines("'- ' || replace(text, chr(10), chr(10) || '- ')")} AS parts FROM documents))
    QUALIFY i >= min(CASE WHEN regexp_matches(s, '^[-*+]\\s+(.+)$') THEN i END) OVER (PARTITION BY doc_id)))
WHERE stop IS NULL OR i < stop
""")


def feature_documents(spark, sf_dir):
    head = F.lit("# Name\n\n## Features of it\n\nSome words.\n- ")
    return derived_documents(spark, sf_dir, F.concat(head, F.replace("text", F.lit("\n"), F.lit("\n- "))))


@query("wn7_feature_bullets", """
SELECT project_id, lpad(CAST(doc_id AS VARCHAR), 19, '0') AS path, md5(feature) AS feature_hash, count(*) AS n FROM bullets GROUP BY ALL
""", ("bullets",))
def _(spark, sf_dir):
    rows = X.feature_bullets(feature_documents(spark, sf_dir))
    return rows.groupBy("project_id", "path", F.md5("feature").alias("feature_hash")).agg(F.count("*").alias("n"))


@query("se7_distinct_features", """
SELECT project_id, md5(feature) AS feature_hash, min(lpad(CAST(doc_id AS VARCHAR), 19, '0')) AS path FROM bullets GROUP BY project_id, feature
""", ("bullets",))
def _(spark, sf_dir):
    rows = X.distinct_features(X.feature_bullets(feature_documents(spark, sf_dir)))
    return rows.select("project_id", F.md5("feature").alias("feature_hash"), "path")


@query("se3_claims_union", f"""
SELECT project_id, kind, count(*) AS claims FROM (
  SELECT DISTINCT project_id, 'feature' AS kind, feature FROM bullets
  UNION ALL SELECT source, 'requirement', clean FROM (SELECT *, {_CLEAN} AS clean FROM modal) WHERE len({sql_tokens('clean')}) > 0) GROUP BY ALL
""", ("bullets", "modal"))
def _(spark, sf_dir):
    features = X.distinct_features(X.feature_bullets(feature_documents(spark, sf_dir)))
    rows = X.claims_union(features, X.requirements(modal_documents(spark, sf_dir)))
    return rows.groupBy("project_id", "kind").agg(F.count("*").alias("claims"))


@query("ag18_merge_intents", f"""
SELECT s.project_id, 'Name' AS project_title, coalesce(f.n, 0) AS feature_count, coalesce(p.n, 0) AS package_count
FROM (SELECT DISTINCT source AS project_id FROM documents) s
LEFT JOIN (SELECT project_id, count(DISTINCT feature) AS n FROM bullets GROUP BY ALL) f USING (project_id)
LEFT JOIN (SELECT source AS project_id, count(DISTINCT package) AS n FROM (
  SELECT source, lower(regexp_extract(s, '^([A-Za-z0-9][A-Za-z0-9_.\\-]*)', 1)) AS package FROM (
    SELECT source, {sql_strip('unnest(' + sql_lines('text') + ')')} AS s FROM documents) WHERE s <> '' AND s NOT LIKE '#%' AND s NOT LIKE '-%')
  WHERE package <> '' GROUP BY ALL) p USING (project_id)
""", ("bullets",))
def _(spark, sf_dir):
    readmes = feature_documents(spark, sf_dir).withColumn("kind", F.lit("readme"))
    manifests = derived_documents(spark, sf_dir, F.col("text")).withColumn("kind", F.lit("dependency_manifest"))
    return X.merge_intents(readmes.unionByName(manifests)).select("project_id", "project_title", "feature_count", "package_count")


@query("ag30_third_party_packages", "SELECT DISTINCT source AS project_id, 'numpy' AS package FROM documents WHERE lang <> 'de'")
def _(spark, sf_dir):
    sources = python_sources(spark, sf_dir)
    return X.third_party_packages(code_facts(sources), sources.select(*RUN, F.col("path").alias("relative_path"))).select("project_id", "package")


cte("declared", "SELECT DISTINCT p_brand AS project_id, replace(p_name, ' ', '-') AS package, replace(p_name, ' ', '_') AS module FROM part WHERE p_size <= 25")
cte("imported", "SELECT DISTINCT p_brand AS project_id, replace(p_name, ' ', '_') AS module FROM part WHERE p_size > 20")


@query("jn6_dependency_mismatch", """
SELECT project_id, 'DECLARED_DEPENDENCY_UNUSED' AS code, package AS name FROM declared d ANTI JOIN imported i USING (project_id, module)
UNION ALL SELECT project_id, 'UNDECLARED_DEPENDENCY_USED', module FROM imported i ANTI JOIN declared d USING (project_id, module)
WHERE project_id IN (SELECT project_id FROM declared)
""", ("declared", "imported"))
def _(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("project_id"), F.lit(0).cast("bigint").alias("run_id"), "p_name", "p_size")
    declared = part.where("p_size <= 25").select(*RUN, F.replace("p_name", F.lit(" "), F.lit("-")).alias("package")).distinct()
    imported = part.where("p_size > 20").select(*RUN, F.replace("p_name", F.lit(" "), F.lit("_")).alias("package")).distinct()
    return X.dependency_mismatch(declared, imported).select("project_id", "code", "name")


cte("claim_overlap", f"""
SELECT c.item_id, count(*) AS keyword_count, count(t.term) AS matched_count, {sql_round('count(t.term) / count(*)', 6)} AS overlap_ratio
FROM (SELECT DISTINCT item_id, unnest(tokens) AS term FROM claim_tokens) c
LEFT JOIN (SELECT DISTINCT unnest(tokens) AS term FROM page_tokens) t USING (term) GROUP BY ALL
""", ("claim_tokens", "page_tokens"))
cte("page_tokens", f"SELECT page_id, {sql_tokens('html')} AS tokens FROM pages")


def page_documents(spark, sf_dir):
    return text_table(spark, sf_dir, "pages").select(
        F.lit("corpus").alias("project_id"), F.lit(0).cast("bigint").alias("run_id"),
        F.lpad(F.col("page_id").cast("string"), 19, "0").alias("path"), F.col("html").alias("text"))


@query("jn7_claim_overlap", "SELECT CAST(item_id AS VARCHAR) AS claim_id, keyword_count, matched_count, overlap_ratio FROM claim_overlap", ("claim_overlap",))
def _(spark, sf_dir):
    rows = X.claim_overlap(inputs.claims(spark, sf_dir), X.corpus_terms(page_documents(spark, sf_dir)))
    return shown(rows.select("claim_id", "keyword_count", "matched_count", "overlap_ratio"))


@query("jn7_keyword_traceability", """
SELECT CAST(item_id AS VARCHAR) AS claim_id, 'REQUIREMENT_NOT_TRACEABLE' AS code, item_id + 1 AS line, overlap_ratio FROM claim_overlap WHERE overlap_ratio < 0.95
""", ("claim_overlap",))
def _(spark, sf_dir):
    rows = X.keyword_traceability(inputs.claims(spark, sf_dir), page_documents(spark, sf_dir), minimum=0.95)
    return shown(rows.select("claim_id", "code", F.col("line").cast("bigint").alias("line"), "overlap_ratio"))


@query("ud2_second_extractor", """
SELECT CAST(item_id AS VARCHAR) AS claim_id, overlap_ratio FROM claim_overlap WHERE overlap_ratio < 0.95 AND item_id NOT IN (
  SELECT item_id FROM (SELECT c.item_id, count(t.term) / count(*) AS ratio
    FROM (SELECT DISTINCT item_id, unnest(list_transform(tokens, lambda w: substr(w, 1, 7))) AS term FROM claim_tokens) c
    LEFT JOIN (SELECT DISTINCT unnest(list_transform(tokens, lambda w: substr(w, 1, 7))) AS term FROM page_tokens) t USING (term) GROUP BY ALL)
  WHERE ratio >= 0.95)
""", ("claim_overlap", "claim_tokens", "page_tokens"))
def _(spark, sf_dir):
    stems = lambda text: F.transform(ft.tokenize(text), lambda w: F.substring(w, 1, 7))
    rows = X.keyword_traceability(inputs.claims(spark, sf_dir), page_documents(spark, sf_dir), stems, 0.95)
    return shown(rows.select("claim_id", "overlap_ratio"))


@query("ag17_corpus_terms", "SELECT DISTINCT unnest(tokens) AS term FROM doc_tokens", ("doc_tokens",))
def _(spark, sf_dir):
    return X.corpus_terms(inputs.documents(spark, sf_dir)).select("term")


cte("tf", "SELECT doc_id, term, count(*) AS n, count(*) / any_value(total) AS tf FROM (SELECT doc_id, len(tokens) AS total, unnest(tokens) AS term FROM doc_tokens) GROUP BY ALL", ("doc_tokens",))
cte("idf", "SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY ALL", ("tf",))


@query("ag16_tf", f"SELECT lpad(CAST(doc_id AS VARCHAR), 19, '0') AS path, term, n, {sql_round('tf', 6)} AS tf FROM tf", ("tf",))
def _(spark, sf_dir):
    return shown(X.term_frequencies(inputs.documents(spark, sf_dir)).select("path", "term", "n", "tf"))


@query("ag16_idf", f"SELECT term, df, {sql_round('idf', 6)} AS idf FROM idf", ("idf",))
def _(spark, sf_dir):
    docs = inputs.documents(spark, sf_dir)
    return shown(X.inverse_frequencies(X.term_frequencies(docs), docs).select("term", "df", "idf"))


cte("tfidf_best", """
SELECT c.item_id, b.path, coalesce(b.score, 0.0) AS score FROM claim_tokens c LEFT JOIN (
  SELECT item_id, lpad(CAST(doc_id AS VARCHAR), 19, '0') AS path, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM (
      SELECT q.item_id, d.doc_id, round(sum(q.w * d.w) / any_value(qn.norm) / any_value(dn.norm), 9) AS score
      FROM (SELECT item_id, term, count(*) / any_value(total) * any_value(idf) AS w FROM (SELECT item_id, len(tokens) AS total, unnest(tokens) AS term FROM claim_tokens) JOIN idf USING (term) GROUP BY ALL) q
      JOIN (SELECT doc_id, term, tf * idf AS w FROM tf JOIN idf USING (term)) d USING (term)
      JOIN (SELECT item_id, sqrt(sum(w * w)) AS norm FROM (SELECT item_id, term, count(*) / any_value(total) * any_value(idf) AS w FROM (SELECT item_id, len(tokens) AS total, unnest(tokens) AS term FROM claim_tokens) JOIN idf USING (term) GROUP BY ALL) GROUP BY ALL) qn USING (item_id)
      JOIN (SELECT doc_id, sqrt(sum(tf * idf * tf * idf)) AS norm FROM tf JOIN idf USING (term) GROUP BY ALL) dn USING (doc_id)
      GROUP BY ALL)) WHERE r = 1) b USING (item_id)
WHERE len(c.tokens) > 0
""", ("claim_tokens", "tf", "idf"))


@query("jn8_tfidf_best_match", f"SELECT CAST(item_id AS VARCHAR) AS claim_id, path AS best_match_file, {sql_round('score', 4)} AS similarity_score FROM tfidf_best", ("tfidf_best",))
def _(spark, sf_dir):
    return X.best_match(inputs.claims(spark, sf_dir), inputs.documents(spark, sf_dir)).select("claim_id", "best_match_file", "similarity_score")


@query("wn10_best_match", "SELECT CAST(item_id AS VARCHAR) AS claim_id, path AS best_match_file FROM tfidf_best", ("tfidf_best",))
def _(spark, sf_dir):
    """The same with blocks so small that a run has many cells."""
    rows = X.best_match(inputs.claims(spark, sf_dir), inputs.documents(spark, sf_dir), claim_rows=15, document_rows=400)
    return rows.select("claim_id", "best_match_file")


@query("rp3_text_report", """
SELECT project_id, f.n AS features, coalesce(p.n, 0) AS packages FROM (SELECT project_id, count(DISTINCT feature) AS n FROM bullets GROUP BY ALL) f
LEFT JOIN (SELECT DISTINCT source AS project_id, CAST(1 AS BIGINT) AS n FROM documents WHERE lang <> 'de') p USING (project_id)
""", ("bullets",))
def _(spark, sf_dir):
    sources = python_sources(spark, sf_dir)
    readmes = feature_documents(spark, sf_dir).withColumn("kind", F.lit("readme"))
    files = sources.select(*RUN, F.col("path").alias("relative_path"))
    report = reports.text_report(readmes, code_facts(sources), files, sources)
    count = lambda rows, name: rows.groupBy("project_id").agg(F.count("*").alias(name))
    joined = count(report["features"], "features").join(count(report["packages"], "packages"), "project_id", "left")
    return joined.fillna(0, ["packages"])
