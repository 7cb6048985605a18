"""Registered vision queries over ``embeddings`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from projectpulse.catalog import inputs
from projectpulse.catalog.inspection import sql_band
from projectpulse.catalog.registry import cte, query, shown, sql_round, table
from projectpulse.functions import fixed
from projectpulse.operators import vision as V
from projectpulse.plans import reports

CANVAS = (990, 780)


def layouts(spark, sf_dir):
    base = inputs.elements(spark, sf_dir)
    return base, inputs.elements_now(base)


@query("pr17_box_geometry", """
SELECT layout_id, element_id, greatest(w, 0) * greatest(h, 0) AS area, x + w AS "right", y + h AS bottom FROM elements
""", ("elements",))
def _(spark, sf_dir):
    return V.box_geometry(inputs.elements(spark, sf_dir)).select("layout_id", "element_id", "area", "right", "bottom")


cte("zero", "SELECT layout_id, element_id, 'Element ''' || element_id || ''' has non-positive size (' || w || 'x' || h || ').' AS detail FROM elements WHERE w <= 0 OR h <= 0", ("elements",))


@query("pr18_zero_size", "SELECT layout_id, element_id, 'high' AS risk_level, detail FROM zero", ("zero",))
def _(spark, sf_dir):
    return V.zero_size(inputs.elements(spark, sf_dir)).select("layout_id", "element_id", "risk_level", "detail")


@query("pr18_off_canvas", f"""
SELECT layout_id, element_id, 'moderate' AS risk_level, 'Element ''' || element_id || ''' bounds (x=' || x || ', y=' || y || ', right=' || x + w || ', bottom=' || y + h || ') fall outside the canvas.' AS detail
FROM elements WHERE x < 0 OR y < 0 OR x + w > {CANVAS[0]} OR y + h > {CANVAS[1]}
""", ("elements",))
def _(spark, sf_dir):
    return V.off_canvas(inputs.elements(spark, sf_dir), *CANVAS).select("layout_id", "element_id", "risk_level", "detail")


@query("pr19_validate_pixels", """
SELECT vec_id AS pair_id, CASE WHEN label = 0 THEN 'dimensions must be positive' WHEN label * 8 <> 64 THEN 'baseline buffer length does not match its dimensions' END AS error FROM embeddings
""")
def _(spark, sf_dir):
    pixels = F.transform("embedding", lambda v: v.cast("int"))
    pairs = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("pair_id"), F.col("label").alias("width"), F.lit(8).alias("height"), F.lit(1).alias("channels"),
        pixels.alias("baseline"), pixels.alias("current"))
    good, bad = V.validate_pixels(pairs)
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(bad).select("pair_id", "error")


@query("pr19_differing_dimensions", f"""
SELECT vec_id AS pair_id, CASE WHEN label % 3 = 1 THEN '{fixed.DIMENSION_MISMATCH % (8, 8, 1, 4, 16, 1)}'
  WHEN label % 3 = 2 THEN 'current buffer length does not match its dimensions' END AS error FROM embeddings
""")
def _(spark, sf_dir):
    """Images of 8 x 8 against 8 x 8, 4 x 16, and 8 x 8 with three channels claimed."""
    pixels, kind = F.transform("embedding", lambda v: v.cast("int")), F.col("label") % 3
    pairs = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("pair_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(1).alias("channels"),
        F.when(kind == 1, 4).otherwise(8).alias("current_width"), F.when(kind == 1, 16).otherwise(8).alias("current_height"),
        F.when(kind == 2, 3).otherwise(1).alias("current_channels"), pixels.alias("baseline"), pixels.alias("current"))
    good, bad = V.validate_pixels(pairs)
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(bad).select("pair_id", "error")


@query("jn14_three_channels", """
SELECT pair_id, count(*) AS changed, min(p) AS first FROM (
  SELECT pair_id, (i - 1) // 2 AS p, sum(d) AS s FROM (
    SELECT pair_id, i, abs(CAST(floor((CAST(ea[i] AS DOUBLE) + 1) * 127.5 + 0.5) AS BIGINT) - CAST(floor((CAST(eb[i] AS DOUBLE) + 1) * 127.5 + 0.5) AS BIGINT)) AS d
    FROM pairs, generate_series(1, 64) AS g(i)) GROUP BY pair_id, (i - 1) // 2) WHERE s >= 24 GROUP BY pair_id
""", ("pairs",))
def _(spark, sf_dir):
    """The same buffers as 8 x 4 pixels of two channels: channel differences add up per pixel."""
    pairs = inputs.image_pairs(spark, sf_dir).withColumns({"height": F.lit(4), "channels": F.lit(2)})
    changed = V.changed_pixels(pairs).where(F.size("changed") > 0)
    return changed.select("pair_id", F.size("changed").cast("bigint").alias("changed"), F.array_min("changed").cast("bigint").alias("first"))


@query("pr20_paired_presence", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, (l_tax > 0.02) = (l_tax > 0.04) AND (l_discount > 0.02) = (l_discount > 0.05) AND (l_tax > 0.04 OR l_discount > 0.05) AS accepted FROM lineitem
""")
def _(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        (F.col("l_tax") > 0.02).alias("baseline_pixels"), (F.col("l_tax") > 0.04).alias("current_pixels"),
        (F.col("l_discount") > 0.02).alias("baseline_layout"), (F.col("l_discount") > 0.05).alias("current_layout"))
    good, bad = V.paired_presence(runs, ["pixels", "layout"])
    both = good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))
    return both.select("l_orderkey", "l_linenumber", "accepted")


@query("jn14_pixel_pairs", "SELECT pair_id, x, y FROM hot", ("hot",))
def _(spark, sf_dir):
    rows = V.changed_pixels(inputs.image_pairs(spark, sf_dir)).select("pair_id", "width", F.explode("changed").alias("p"))
    return rows.select("pair_id", (F.col("p") % F.col("width")).cast("bigint").alias("x"), F.floor(F.col("p") / F.col("width")).alias("y"))


cte("pixel_diff", f"""
SELECT *, {sql_band('diff_ratio', fixed.PIXEL_BANDS)} AS risk_level FROM (
  SELECT p.pair_id, CAST(64 AS BIGINT) AS total_pixel_count, coalesce(h.n, 0) AS changed_pixel_count, {sql_round('coalesce(h.n, 0) / 64', 4)} AS diff_ratio
  FROM pairs p LEFT JOIN (SELECT pair_id, count(*) AS n FROM hot GROUP BY ALL) h USING (pair_id))
""", ("pairs", "hot"))


@query("ag23_pixel_diff_ratio", "SELECT * FROM pixel_diff", ("pixel_diff",))
def _(spark, sf_dir):
    return V.pixel_diff(V.changed_pixels(inputs.image_pairs(spark, sf_dir)))


@query("gr4_connected_regions", "SELECT pair_id, x, y, width, height, n AS changed_pixel_count FROM boxes", ("boxes",))
def _(spark, sf_dir):
    return V.region_boxes(V.changed_pixels(inputs.image_pairs(spark, sf_dir)), None).drop("region_rank")


@query("gr4_tiled_regions", "SELECT pair_id, x, y, width, height, n AS changed_pixel_count FROM boxes", ("boxes",))
def _(spark, sf_dir):
    """The same regions from tiles of 3 x 3 pixels."""
    return V.tiled_region_boxes(V.cut_tiles(inputs.image_pairs(spark, sf_dir), 3), None)


@query("ag24_region_boxes", """
SELECT pair_id, count(*) AS regions, CAST(sum(n) AS BIGINT) AS pixels, max(width * height) AS largest_box FROM boxes GROUP BY ALL
""", ("boxes",))
def _(spark, sf_dir):
    boxes = V.region_boxes(V.changed_pixels(inputs.image_pairs(spark, sf_dir)), None)
    return boxes.groupBy("pair_id").agg(
        F.count("*").alias("regions"), F.sum("changed_pixel_count").alias("pixels"), F.max(F.col("width") * F.col("height")).alias("largest_box"))


@query("wn9_top_regions", """
SELECT pair_id, CAST(r AS BIGINT) AS region_rank, x, y, n AS changed_pixel_count FROM (
  SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY n DESC, root) AS r FROM boxes) WHERE r <= 3
""", ("boxes",))
def _(spark, sf_dir):
    boxes = V.region_boxes(V.changed_pixels(inputs.image_pairs(spark, sf_dir)), 3)
    return boxes.select("pair_id", "region_rank", "x", "y", "changed_pixel_count")


# an id used twice counts with its last element
cte("sides", """
SELECT coalesce(b.layout_id, c.layout_id) AS layout_id, coalesce(b.element_id, c.element_id) AS element_id, b.ordinal AS bo, c.ordinal AS co,
  b.x AS bx, b.y AS by_, b.w AS bw, b.h AS bh, b.tag AS bt, b.text AS bs, c.x AS cx, c.y AS cy, c.w AS cw, c.h AS ch, c.tag AS ct, c.text AS cs
FROM (SELECT * FROM elements QUALIFY row_number() OVER (PARTITION BY layout_id, element_id ORDER BY ordinal DESC) = 1) b
FULL JOIN (SELECT * FROM elements_now QUALIFY row_number() OVER (PARTITION BY layout_id, element_id ORDER BY ordinal DESC) = 1) c
  ON b.layout_id = c.layout_id AND b.element_id = c.element_id
""", ("elements", "elements_now"))
cte("changes", """
SELECT layout_id, element_id, 'added' AS change_type, 'Element ''' || element_id || ''' is present in the current layout but not the baseline.' AS detail FROM sides WHERE bo IS NULL
UNION ALL SELECT layout_id, element_id, 'removed', 'Element ''' || element_id || ''' is present in the baseline but not the current layout.' FROM sides WHERE co IS NULL
UNION ALL SELECT layout_id, element_id, 'moved', 'Element ''' || element_id || ''' moved by (' || abs(cx - bx) || 'px, ' || abs(cy - by_) || 'px).' FROM sides WHERE abs(cx - bx) >= 2 OR abs(cy - by_) >= 2
UNION ALL SELECT layout_id, element_id, 'resized', 'Element ''' || element_id || ''' resized from ' || bw || 'x' || bh || ' to ' || cw || 'x' || ch || '.' FROM sides WHERE abs(cw - bw) >= 2 OR abs(ch - bh) >= 2
UNION ALL SELECT layout_id, element_id, 'modified', 'Element ''' || element_id || ''' tag/text content changed.' FROM sides WHERE bo IS NOT NULL AND co IS NOT NULL AND (bt IS DISTINCT FROM ct OR bs IS DISTINCT FROM cs)
""", ("sides",))
cte("ratios", f"""
SELECT *, {sql_band('change_ratio', fixed.LAYOUT_BANDS)} AS risk_level FROM (
  SELECT s.layout_id, s.elements, coalesce(c.n, 0) AS change_count, {sql_round('coalesce(c.w, 0) / s.elements', 4)} AS change_ratio
  FROM (SELECT layout_id, count(*) AS elements FROM sides GROUP BY ALL) s
  LEFT JOIN (SELECT layout_id, count(*) AS n, sum(CASE WHEN change_type = 'removed' THEN 2 ELSE 1 END) AS w FROM changes GROUP BY ALL) c USING (layout_id))
""", ("sides", "changes"))


@query("jn2_layout_diff", "SELECT * FROM changes", ("changes",))
def _(spark, sf_dir):
    return V.layout_diff(*layouts(spark, sf_dir))


@query("pr16_changes_of_type", "SELECT layout_id, element_id, detail FROM changes WHERE change_type = 'resized'", ("changes",))
def _(spark, sf_dir):
    return V.changes_of_type(V.layout_diff(*layouts(spark, sf_dir)), "resized").select("layout_id", "element_id", "detail")


@query("ag26_layout_change_ratio", "SELECT * FROM ratios", ("ratios",))
def _(spark, sf_dir):
    base, now = layouts(spark, sf_dir)
    return V.layout_change_ratio(V.layout_diff(base, now), base, now)


@query("pr15_min_risk_filter", "SELECT layout_id, risk_level FROM ratios WHERE risk_level <> 'low'", ("ratios",))
def _(spark, sf_dir):
    base, now = layouts(spark, sf_dir)
    return V.min_risk(V.layout_change_ratio(V.layout_diff(base, now), base, now)).select("layout_id", "risk_level")


@query("ag27_layout_change_counts", """
SELECT layout_id, change_type, count(*) AS n, risk_level FROM changes JOIN ratios USING (layout_id)
WHERE change_type <> 'removed' AND risk_level <> 'low' GROUP BY ALL
""", ("changes", "ratios"))
def _(spark, sf_dir):
    base, now = layouts(spark, sf_dir)
    changes = V.layout_diff(base, now)
    return V.layout_change_counts(changes, V.layout_change_ratio(changes, base, now))


@query("ag25_duplicate_ids", """
SELECT layout_id, element_id, 'high' AS risk_level, 'Element id ''' || element_id || ''' appears ' || count(*) || ' times in the same layout snapshot.' AS detail
FROM elements GROUP BY layout_id, element_id HAVING count(*) > 1
""", ("elements",))
def _(spark, sf_dir):
    return V.duplicate_ids(inputs.elements(spark, sf_dir)).select("layout_id", "element_id", "risk_level", "detail")


def _overlap_sql(source: str) -> str:
    return f"""
SELECT layout_id, first, second, ratio FROM (SELECT a.layout_id, a.element_id AS first, b.element_id AS second,
    greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) / least(a.w * a.h, b.w * b.h) AS ratio
  FROM {source} a JOIN {source} b ON a.layout_id = b.layout_id AND a.ordinal < b.ordinal WHERE a.w > 0 AND a.h > 0 AND b.w > 0 AND b.h > 0)
WHERE ratio >= 0.3"""


# all line items of a supplier and month on one canvas: layouts with some boxes that overlap
cte("canvas", """
SELECT 'supplier-' || l_suppkey || '-' || strftime(l_shipdate, '%Y-%m') AS layout_id, l_orderkey || '-' || l_linenumber AS element_id,
  row_number() OVER (PARTITION BY l_suppkey, strftime(l_shipdate, '%Y-%m') ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice) AS ordinal,
  l_partkey % 97 AS x, l_orderkey % 89 AS y, CAST(l_quantity AS BIGINT) AS w, CAST(round(l_discount * 100 + l_tax * 500) AS BIGINT) AS h FROM lineitem
""")
cte("overlapping", _overlap_sql("canvas"), ("canvas",))


def canvas(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.lit("supplier"), "l_suppkey", F.date_format("l_shipdate", "yyyy-MM")).alias("layout_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("element_id"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice").alias("ordinal"),
        (F.col("l_partkey") % 97).alias("x"), (F.col("l_orderkey") % 89).alias("y"),
        F.col("l_quantity").cast("bigint").alias("w"), F.round(F.col("l_discount") * 100 + F.col("l_tax") * 500).cast("bigint").alias("h"))


@query("jn9_overlap_pairs", """
SELECT layout_id, first AS element_id, second AS second_element_id, CASE WHEN ratio >= 0.7 THEN 'high' ELSE 'moderate' END AS risk_level FROM overlapping
""", ("overlapping",))
def _(spark, sf_dir):
    return V.overlap_pairs(canvas(spark, sf_dir)).select("layout_id", "element_id", "second_element_id", "risk_level")


cte("embedding_diff", f"""
SELECT pair_id, {sql_round('list_cosine_similarity(CAST(ea AS DOUBLE[]), CAST(eb AS DOUBLE[]))', 4)} AS similarity FROM pairs
""", ("pairs",))


@query("fn18_cosine", f"SELECT pair_id, similarity, {sql_band('similarity', fixed.EMBEDDING_BANDS)} AS risk_level FROM embedding_diff", ("embedding_diff",))
def _(spark, sf_dir):
    return V.embedding_diff(inputs.embedding_pairs(spark, sf_dir))


def hashes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("pair_id"),
        (F.col("l_orderkey") * 2654435761).alias("baseline_hash"),
        (F.col("l_orderkey") * 2654435761 + F.col("l_partkey") % 64).alias("current_hash"), (1 - F.col("l_discount") * 4).alias("ssim"))


_HASH_SQL = """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS pair_id,
  CAST(bit_count(xor(l_orderkey * 2654435761, l_orderkey * 2654435761 + l_partkey % 64)) AS BIGINT) AS d, 1 - l_discount * 4 AS s FROM lineitem"""


@query("fn19_hamming", f"SELECT pair_id, d AS phash_distance FROM ({_HASH_SQL})")
def _(spark, sf_dir):
    return shown(V.hash_diff(hashes(spark, sf_dir)).select("pair_id", "phash_distance"))


@query("pr11_classify_two_signal", f"""
SELECT pair_id, CASE WHEN s >= 0.98 AND d <= 2 THEN 'low' WHEN s >= 0.90 AND d <= 8 THEN 'moderate' WHEN s >= 0.70 AND d <= 20 THEN 'high' ELSE 'critical' END AS risk_level FROM ({_HASH_SQL})
""")
def _(spark, sf_dir):
    return V.hash_diff(hashes(spark, sf_dir)).select("pair_id", "risk_level")


cte("visual_findings", f"""
SELECT CAST(pair_id AS VARCHAR) AS comparison_id, 'embedding_diff' AS category, {sql_band('similarity', fixed.EMBEDDING_BANDS)} AS risk_level FROM embedding_diff WHERE similarity < 0.98
UNION ALL SELECT CAST(pair_id AS VARCHAR), 'pixel_diff', risk_level FROM pixel_diff WHERE risk_level <> 'low'
UNION ALL SELECT CAST(layout_id AS VARCHAR), 'layout_diff', 'high' FROM changes WHERE change_type = 'removed'
UNION ALL SELECT CAST(layout_id AS VARCHAR), 'layout_diff', risk_level FROM changes JOIN ratios USING (layout_id) WHERE change_type <> 'removed' AND risk_level <> 'low' GROUP BY layout_id, change_type, risk_level
UNION ALL SELECT CAST(layout_id AS VARCHAR), 'layout_consistency', 'high' FROM elements_now GROUP BY layout_id, element_id HAVING count(*) > 1
UNION ALL SELECT CAST(layout_id AS VARCHAR), 'layout_consistency', 'high' FROM elements_now WHERE w <= 0 OR h <= 0
UNION ALL SELECT CAST(layout_id AS VARCHAR), 'layout_consistency', 'moderate' FROM elements_now WHERE x < 0 OR y < 0 OR x + w > {CANVAS[0]} OR y + h > {CANVAS[1]}
UNION ALL SELECT CAST(layout_id AS VARCHAR), 'layout_consistency', CASE WHEN ratio >= 0.7 THEN 'high' ELSE 'moderate' END FROM ({_overlap_sql('elements_now')})
""", ("embedding_diff", "pixel_diff", "changes", "ratios", "elements_now"))


def report(spark, sf_dir):
    base, now = layouts(spark, sf_dir)
    return reports.visual_report(inputs.image_pairs(spark, sf_dir), inputs.embedding_pairs(spark, sf_dir), base, now, *CANVAS)


@query("se6_visual_findings", "SELECT comparison_id, category, risk_level, count(*) AS n FROM visual_findings GROUP BY ALL", ("visual_findings",))
def _(spark, sf_dir):
    return report(spark, sf_dir)["findings"].groupBy("comparison_id", "category", "risk_level").agg(F.count("*").alias("n"))


cte("verdicts", """
SELECT c.comparison_id, coalesce(f.n, 0) AS finding_count, CASE WHEN f.w >= 3 THEN 'regression' WHEN f.w >= 2 THEN 'minor_difference' ELSE 'match' END AS verdict
FROM (SELECT CAST(pair_id AS VARCHAR) AS comparison_id FROM pairs UNION SELECT CAST(layout_id AS VARCHAR) FROM elements) c
LEFT JOIN (SELECT comparison_id, count(*) AS n, max(CASE risk_level WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END) AS w
  FROM visual_findings GROUP BY ALL) f USING (comparison_id)
""", ("visual_findings", "pairs", "elements"))


@query("ag28_verdict", "SELECT * FROM verdicts", ("verdicts",))
def _(spark, sf_dir):
    return report(spark, sf_dir)["verdicts"]


_TEXTS = " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in fixed.VERDICT_TEXTS.items())


@query("rp5_visual_report", f"""
SELECT comparison_id, CASE verdict {_TEXTS} END || ' Comparing ''before'' to ''after'': ' || finding_count || ' finding(s) across pixel data and layout data.' AS summary FROM verdicts
""", ("verdicts",))
def _(spark, sf_dir):
    rows = V.visual_report(report(spark, sf_dir)["verdicts"], F.lit("before"), F.lit("after"), ["pixel data", "layout data"])
    return rows.select("comparison_id", "summary")
