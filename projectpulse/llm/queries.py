"""The corpus operators as registered queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from projectpulse.llm import collocations, decontamination, language_id, line_dedup, metric_join, minhash_forest, quality_rules, sentence_pieces, spelling_variants, substring_dedup, suffix_dedup, token_files, url_filters
from projectpulse.llm.common import table
from projectpulse.skew import new_folder

#: the public vocabulary files of the installed package, which executors have as well
PIECE_MODEL, BYTE_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, p, list_aggregate(words[p:p + 49], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS p FROM w WHERE len(words) >= 50)
), least AS (SELECT s, min(doc_id) AS m FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, p FROM windows JOIN least USING (s) WHERE doc_id > m),
gone AS (SELECT DISTINCT doc_id, p + k AS i FROM hit, range(0, 50) AS r(k)),
gone_of AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
  sha256(coalesce(list_aggregate(CASE WHEN g IS NULL THEN words ELSE list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda x: NOT list_contains(g, x[2])), lambda x: x[1]) END, 'string_agg', ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone_of USING (doc_id)
"""


@query("op6_substring_dedup", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeated_windows(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), hot AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT keyed.*, last IS NOT NULL AND doc_id <> last AS gone FROM keyed LEFT JOIN hot USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op7_line_dedup", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH split AS (
  SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split
), rules(rule, rhost, rpath, v) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), fits AS (
  SELECT host, path, rule, v, row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC, rule) AS rn
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, parts.host, parts.path, rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE rn = 1) f ON parts.host = f.host AND parts.path = f.path
"""


@query("op1_url_filters", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filters.rule_table(spark, [url_filters.parse_rule(text, verdict) for text, verdict in URL_RULES])
    return url_filters.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), sh AS (
  SELECT DISTINCT doc_id, hash(list_aggregate(words[p:p + 4], 'string_agg', ' ')) AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS p FROM w WHERE len(words) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes sx ON x = sx.doc_id JOIN sizes sy ON y = sy.doc_id WHERE 100 * c >= 75 * (sx.n + sy.n - c)
), both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(a, b) AS (SELECT x, x FROM both_ways UNION SELECT a, y FROM reach JOIN both_ways ON b = x),
roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(root, w.doc_id) AS component_id, w.doc_id = coalesce(root, w.doc_id) AS kept
FROM w LEFT JOIN sizes ON w.doc_id = sizes.doc_id LEFT JOIN roots ON w.doc_id = a
"""


@query("op2_minhash_dedup", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END), 'sum') = 0
), u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE list_dot_product(e, e) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach(a, b) AS (SELECT x, x FROM links UNION SELECT a, y FROM reach JOIN links ON b = x),
roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(root, vec_id) AS component_id, vec_id = coalesce(root, vec_id) AS kept
FROM embeddings LEFT JOIN counts ON vec_id = x LEFT JOIN roots ON vec_id = a
"""


@query("op3_embedding_dedup", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.link_vectors(table(spark, sf_dir, "embeddings"))


@query("op4_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")


@query("op8_sentence_pieces")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentence_pieces.encode(table(spark, sf_dir, "documents"), PIECE_MODEL)
    decoded = sentence_pieces.decode(encoded, PIECE_MODEL)
    return decoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2(F.encode("decoded_text", "utf-8"), 256).alias("decoded_sha256")
    )


PAGE_TEXT = r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>|&[a-z0-9#]+;"


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages (declared language, address) and documents (declared ``lang``, source as host) in one corpus."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    names, logs = language_id.fit_trigrams(docs, "doc_id", "text", "lang")
    host, _ = url_filters.host_and_path(F.col("_url"))
    none = F.lit(None)
    both = docs.select("doc_id", none.cast("bigint").alias("page_id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit("").alias("suffix"))
    web = pages.select("page_id", "html", F.col("url").alias("_url")).select("page_id", "html", host.alias("host"))
    both = both.unionByName(
        web.select(
            none.cast("bigint").alias("doc_id"), "page_id", F.regexp_replace("html", PAGE_TEXT, " ").alias("text"),
            F.regexp_extract("html", r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]+)""", 1).alias("declared"), "host", F.regexp_extract("host", r"\.([a-z]+)(?::\d+)?$", 1).alias("suffix"),
        )
    )
    found = language_id.identify(both, names, logs, F.struct("doc_id", "page_id"), F.col("text"), F.col("declared"), F.col("host"), F.col("suffix"))
    return found.select("key.doc_id", "key.page_id", "host", "declared", "language", "probability", "kept")


@query("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-shards")
    token_files.write_shards(table(spark, sf_dir, "documents"), folder, BYTE_TOKENIZER, end_id=0)
    return token_files.read_shards(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


OP11_BASE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, coalesce(text, '') AS text,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), windows AS (
  SELECT doc_id, p, words[p] || ' ' || words[p + 1] || ' ' || words[p + 2] AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS p FROM w WHERE len(words) >= 3)
), twice AS (SELECT doc_id, s FROM windows GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT DISTINCT doc_id, p + k AS i FROM windows JOIN twice USING (doc_id, s), range(0, 3) AS r(k)),
repeats AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
base AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, len(list_filter(words, lambda x: regexp_matches(x, '\p{L}')))::BIGINT AS n_letter_words
  FROM w LEFT JOIN repeats USING (doc_id)
), bits AS (
  SELECT *, [n_words < 50, 100 * n_repeat_words > 50 * n_words, word_chars < 3 * n_words OR word_chars > 10 * n_words, 10 * n_symbols > n_words,
    100 * n_letter_words < 80 * n_words, n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines] AS f FROM base
)
"""
OP11_SQL = OP11_BASE + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f[1] OR f[2] AS base_failed, NOT list_contains(f, true) AS kept FROM bits
"""


@query("op11_quality_rules", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(table(spark, sf_dir, "documents"))
    base, prose = (quality_rules.POLICIES[quality_rules.newest(name)] for name in ("base", "prose"))
    kept = quality_rules.passes(base) & quality_rules.passes(prose)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~quality_rules.passes(base)).alias("base_failed"), kept.alias("kept"))


ABLATION_SQL = OP11_BASE + """, masks(policy, version, mask) AS (VALUES ('base', 1, [1, 2]), ('prose', 1, [1, 2, 3, 4]), ('prose', 2, [1, 2, 3, 4, 5, 6])),
rules(rule, r) AS (VALUES ('few_words', 1), ('repeated_windows', 2), ('word_length', 3), ('symbols', 4), ('few_letters', 5), ('repeated_lines', 6)),
each AS (SELECT policy, version, rule, f[r] AS this, len(list_filter(mask, lambda k: f[k])) AS n FROM bits, masks JOIN rules ON list_contains(mask, r))
SELECT policy, version, rule, count(*) AS n_docs, count(*) FILTER (n = 0) AS n_kept, count(*) FILTER (this) AS n_failed, count(*) FILTER (this AND n = 1) AS n_failed_alone
FROM each GROUP BY ALL
"""


@query("quality_ablations", ABLATION_SQL)
def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each version costs, over all documents."""
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents")))


OP12_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS r FROM documents
), each AS (SELECT doc_id, r, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)) AS x FROM runs GROUP BY doc_id, r),
summed AS (
  SELECT r, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM each, tab
), words AS (
  SELECT w, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS w, n FROM summed)
  WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3
), cut AS (SELECT w, i, substr(w, 1, i - 1) || substr(w, i + 1) AS d FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM words)),
shorter AS (SELECT DISTINCT cut.w AS long, words.w AS short FROM cut JOIN words ON d = words.w),
pairs AS (
  SELECT x.w AS a, y.w AS b FROM cut x JOIN cut y ON x.d = y.d AND x.i = y.i AND x.w <> y.w
  UNION SELECT long, short FROM shorter UNION SELECT short, long FROM shorter
), ranked AS (
  SELECT a, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rn, count(*) OVER (PARTITION BY a) AS n_near FROM pairs JOIN words ON b = w
), judged AS (
  SELECT w, words.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN ranked.n >= 2 * words.n THEN b END AS form, CASE WHEN ranked.n >= 2 * words.n THEN ranked.n END AS form_n
  FROM words LEFT JOIN ranked ON a = w AND rn = 1
), chain(w, stop) AS (SELECT w, w FROM judged UNION SELECT chain.w, form FROM chain JOIN judged ON judged.w = stop WHERE form IS NOT NULL)
SELECT judged.w AS word, judged.form, stop AS root, judged.n, judged.n_near, judged.form_n
FROM judged JOIN chain USING (w) JOIN judged ends ON ends.w = stop AND ends.form IS NULL
""".replace("\\u00C0", chr(0xC0)).replace("\\u00FF", chr(0xFF))


@query("op12_spelling_variants", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), split AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces),
grams AS (SELECT lang, m, ws[i:i + m - 1] AS g FROM (SELECT lang, m, ws, unnest(range(1, len(ws) - m + 2)) AS i FROM split, range(1, 5) AS r(m))),
f AS (SELECT lang, m, g, count(*) AS f FROM grams GROUP BY lang, m, g HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM split GROUP BY lang),
cuts AS (
  SELECT c.lang, c.g, c.f AS a, k, l.f AS l, r.f AS r, 2000000::HUGEINT * c.f // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1) c JOIN f l ON l.lang = c.lang AND l.g = c.g[1:k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1:c.m]
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (
  SELECT lang, g[i:i + size - 1] AS g, max(f) AS longer
  FROM (SELECT *, unnest(range(1, m - size + 2)) AS i FROM f, range(2, 4) AS s(size) WHERE m > size) GROUP BY ALL
), kept AS (
  SELECT best.lang, array_to_string(best.g, ' ') AS phrase, a, l, r, score::BIGINT AS score
  FROM best LEFT JOIN inside ON inside.lang = best.lang AND inside.g = best.g WHERE longer IS NULL OR 100 * longer < 80 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""


@query("op13_collocations", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
