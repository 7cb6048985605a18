"""Documented intent, traceability of claims, TF-IDF best match.

Documents are (project_id, run_id, path, text), claims (project_id, run_id, claim_id, text).
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from projectpulse.functions import files as ff
from projectpulse.functions import fixed
from projectpulse.functions import text as ft
from projectpulse.functions.scalars import rounded, strip
from projectpulse.skew import block_pairs, cut_lineage

RUN = ["project_id", "run_id"]
CLAIM = [*RUN, "claim_id"]
#: document x claim scores that a task holds at once
SCORES_AT_ONCE = 1_000_000


def document_lines(documents: DataFrame) -> DataFrame:
    lines = documents.select(*RUN, "path", F.posexplode(ff.lines_of("text")).alias("pos", "raw"))
    return lines.select(*RUN, "path", (F.col("pos") + 1).alias("line"), strip("raw").alias("stripped"))


def requirements(documents: DataFrame) -> DataFrame:
    """FN7: requirement lines with their sorted distinct keywords."""
    rows = document_lines(documents).where((F.col("stripped") != "") & ft.is_requirement("stripped"))
    rows = rows.select(*RUN, F.col("path").alias("source_path"), "line", ft.strip_bullet("stripped").alias("text"))
    return rows.withColumn("keywords", ft.keywords("text")).where(F.size("keywords") > 0)


def feature_bullets(documents: DataFrame) -> DataFrame:
    """WN7: bullets below the first Features heading, up to the first stop after a bullet.

    All of it happens inside the row of one document: the position of the heading, of the
    first bullet after it and of the first stop line are array searches.
    """
    lines = F.transform(ff.lines_of("text"), lambda line: strip(line))
    work = documents.where(F.col("text").rlike("(?im)^#{1,6}\\s*Features?\\b")).withColumn("lines", lines)

    def first_position(column: str, test: Callable[[Column], Column]) -> Column:
        marks = F.transform(F.col(column), lambda line: F.when(test(line), 1).otherwise(0))
        return F.array_position(marks, 1)

    def is_bullet(line: Column) -> Column:
        return line.rlike(fixed.BULLET_PATTERN)

    raw_heading = F.transform(ff.lines_of("text"), lambda line: F.when(line.rlike(fixed.FEATURE_HEADING_PATTERN), 1).otherwise(0))
    work = work.withColumn("heading", F.array_position(raw_heading, 1)).where("heading > 0")
    work = work.withColumn("after", F.expr("slice(lines, int(heading) + 1, size(lines))"))
    work = work.withColumn("stop", first_position("after", lambda s: s.startswith("#")))
    work = work.withColumn("head", F.expr("IF(stop > 0, slice(after, 1, int(stop) - 1), after)"))
    work = work.withColumn("first", first_position("head", is_bullet)).where("first > 0")
    work = work.withColumn("body", F.expr("slice(head, int(first), size(head))"))
    work = work.withColumn("end", first_position("body", lambda s: ~is_bullet(s)))
    bullets = F.expr("IF(end > 0, slice(body, 1, int(end) - 1), body)")
    rows = work.select(*RUN, "path", F.posexplode(bullets).alias("pos", "bullet"))
    return rows.select(*RUN, "path", "pos", ft.strip_bullet("bullet").alias("feature"))


def distinct_features(features: DataFrame) -> DataFrame:
    """SE7, AG18: a feature named twice keeps its first place (path, position)."""
    place = F.struct("path", "pos")
    return features.groupBy(*RUN, "feature").agg(F.min(place).alias("p")).select(*RUN, "feature", "p.*")


def declared_packages(manifests: DataFrame) -> DataFrame:
    """FN8 over all manifests of a run."""
    return manifests.select(*RUN, F.explode(ft.package_names("text")).alias("package")).distinct()


def merge_intents(documents: DataFrame) -> DataFrame:
    """AG18: first title per run and the numbers of its features, requirements, packages.

    ``documents`` also has ``kind``. The elements themselves are rows of
    ``distinct_features``, ``requirements`` and ``declared_packages``.
    """
    readmes = documents.where(F.col("kind") == "readme")
    titled = readmes.withColumn("title", ft.extract_title("text"))
    has_title = F.col("title").isNotNull()
    titles = titled.groupBy(*RUN).agg(F.min_by("title", F.when(has_title, F.col("path"))).alias("project_title"))
    count = lambda df, name: df.groupBy(*RUN).agg(F.count("*").alias(name))
    manifests = documents.where(F.col("kind") == "dependency_manifest")
    return (
        documents.select(*RUN).distinct()
        .join(titles, RUN, "left")
        .join(count(distinct_features(feature_bullets(readmes)), "feature_count"), RUN, "left")
        .join(count(requirements(readmes), "requirement_count"), RUN, "left")
        .join(count(declared_packages(manifests), "package_count"), RUN, "left")
        .fillna(0, ["feature_count", "requirement_count", "package_count"])
    )


def claims_union(features: DataFrame, requirement_rows: DataFrame) -> DataFrame:
    """SE3: features first, then requirement texts; claim_id tells kind and place."""
    left = features.select(
        *RUN, F.lit("feature").alias("kind"), F.concat_ws(":", F.lit("f"), "path", F.lpad(F.col("pos").cast("string"), 19, "0")).alias("claim_id"),
        F.col("feature").alias("text"), F.lit(None).cast("string").alias("source_path"), F.lit(None).cast("int").alias("line"),
    )
    right = requirement_rows.select(
        *RUN, F.lit("requirement").alias("kind"), F.concat_ws(":", F.lit("r"), "source_path", F.lpad(F.col("line").cast("string"), 19, "0")).alias("claim_id"),
        "text", "source_path", "line",
    )
    return left.unionByName(right)


def third_party_packages(facts: DataFrame, inventory: DataFrame) -> DataFrame:
    """AG30: top-level absolute imports of non-test files that are neither standard library nor internal."""
    name = F.substring_index("name", ".", 1)
    absolute = (F.col("kind").isin("import", "import_from")) & (F.coalesce("level", F.lit(0)) == 0) & (F.col("name") != "")
    imported = facts.where(absolute & ff.is_python_source("path")).select(*RUN, name.alias("package")).distinct()
    stdlib = sorted(set(sys.stdlib_module_names) | {"__future__"})
    imported = imported.where(~F.col("package").isin(stdlib))
    python = inventory.where(ff.is_python_source("relative_path"))
    internal = python.select(*RUN, F.substring_index("relative_path", "/", 1).alias("package")).distinct()
    return imported.join(internal, [*RUN, "package"], "left_anti")


def dependency_mismatch(declared: DataFrame, imported: DataFrame) -> DataFrame:
    """JN6: declared but not imported, imported but not declared; silent without a manifest."""
    expected = declared.select(*RUN, F.col("package").alias("name"), ft.import_name("package").alias("module"))
    used = imported.select(*RUN, F.lower("package").alias("module")).distinct()
    unused = expected.join(used, [*RUN, "module"], "left_anti").select(
        *RUN, F.lit("DECLARED_DEPENDENCY_UNUSED").alias("code"), "name",
        F.format_string(
            "'%s' is declared in the dependency manifest but no matching import was found in the analyzed "
            "source. Confirm it is still needed.", "name").alias("message"),
    )
    stray = used.join(expected, [*RUN, "module"], "left_anti").join(expected.select(*RUN).distinct(), RUN, "left_semi")
    undeclared = stray.select(
        *RUN, F.lit("UNDECLARED_DEPENDENCY_USED").alias("code"), F.col("module").alias("name"),
        F.format_string(
            "Module '%s' is imported in the analyzed source but no matching entry was found in the "
            "dependency manifest. Confirm it is declared.", "module").alias("message"),
    )
    return unused.unionByName(undeclared).select(
        *RUN, F.lit("dependency_consistency").alias("category"), F.lit("warning").alias("severity"), "code", "name", "message"
    )


def corpus_terms(documents: DataFrame, tokens: Callable[[Column], Column] = ft.tokenize) -> DataFrame:
    """AG17: distinct terms of all documents of a run."""
    words = F.array_distinct(tokens(F.col("text")))
    return documents.select(*RUN, F.explode(words).alias("term")).distinct()


def claim_overlap(claims: DataFrame, terms: DataFrame, tokens: Callable[[Column], Column] = ft.tokenize) -> DataFrame:
    """JN7: share of each claim's distinct keywords that occur in the corpus.

    The corpus side has one row per term; a term that very many claims use only makes the
    claims side skewed, which AQE splits, and its rows are counted before the next shuffle.
    """
    words = claims.select(*CLAIM, F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    hits = words.join(terms.withColumn("hit", F.lit(1)), [*RUN, "term"], "left")
    return hits.groupBy(*CLAIM).agg(
        F.count("*").alias("keyword_count"),
        F.count("hit").alias("matched_count"),
        rounded(F.count("hit") / F.count("*"), 6).alias("overlap_ratio"),
    )


def keyword_traceability(
    claims: DataFrame,
    documents: DataFrame,
    second: Callable[[Column], Column] | None = None,
    minimum: float = 0.5,
) -> DataFrame:
    """JN7: claims below the minimum overlap, unless a second keyword function rescues them.

    ``claims`` also has kind, source_path and line; ``second`` is the pluggable extractor.
    """
    first = claim_overlap(claims, corpus_terms(documents)).where(F.col("overlap_ratio") < minimum)
    if second is not None:
        rescue = claim_overlap(claims, corpus_terms(documents, second), second).where(F.col("overlap_ratio") >= minimum)
        first = first.join(rescue.select(*CLAIM), CLAIM, "left_anti")
    flagged = claims.join(first, CLAIM)
    noun = F.when(F.col("kind") == "requirement", "Requirement statement").otherwise("Declared feature")
    message = F.format_string(
        "%s '%s' has no clear match in the implementation (keyword overlap %.0f%%). Confirm it is "
        "implemented or update the documentation.", noun, F.col("text"), F.col("overlap_ratio") * 100.0,
    )
    kind = F.when(F.col("kind") == "requirement", "REQUIREMENT").otherwise("FEATURE")
    return flagged.select(
        *CLAIM, F.concat(F.lower(kind), F.lit("_traceability")).alias("category"), F.lit("warning").alias("severity"),
        F.concat(kind, F.lit("_NOT_TRACEABLE")).alias("code"), message.alias("message"),
        F.col("source_path").alias("file_path"), "line", "overlap_ratio",
    )


def term_frequencies(documents: DataFrame) -> DataFrame:
    """AG16: occurrences of each term in each document and their share of its tokens."""
    words = documents.select(*RUN, "path", ft.tokenize("text").alias("tokens"))
    counted = words.select(*RUN, "path", F.size("tokens").alias("total"), F.explode(ft.term_counts("tokens")).alias("c"))
    return counted.select(*RUN, "path", "c.term", "c.n", (F.col("c.n") / F.col("total")).alias("tf"))


def inverse_frequencies(frequencies: DataFrame, documents: DataFrame) -> DataFrame:
    """AG16: ln((1+N)/(1+df))+1; N counts all documents of the run, empty ones too."""
    total = documents.groupBy(*RUN).agg(F.count("*").alias("documents"))
    df = frequencies.groupBy(*RUN, "term").agg(F.count("*").alias("df"))
    idf = F.log((1 + F.col("documents")) / (1 + F.col("df"))) + 1.0
    return df.join(total, RUN).select(*RUN, "term", "df", idf.alias("idf"))


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Elements of a column of lists, and the row of each."""
    lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False), pc.list_parent_indices(lists).to_numpy()


def _score_cell(claims: pa.Table, documents: pa.Table) -> pa.Table:
    """Best document per claim of one cell: sparse products over the claims' postings, reduced at once."""
    best, place = np.zeros(claims.num_rows), np.full(claims.num_rows, -1)
    if claims.num_rows and documents.num_rows:
        documents = documents.sort_by("path")
        terms, claim_of = _flat(claims["terms"])
        vocabulary, claim_term = np.unique(terms, return_inverse=True)
        order = np.argsort(claim_term, kind="stable")
        owners, weights = claim_of[order], _flat(claims["weights"])[0][order]
        starts = np.searchsorted(claim_term[order], np.arange(len(vocabulary) + 1))
        step = max(1, SCORES_AT_ONCE // claims.num_rows)
        for low in range(0, documents.num_rows, step):
            some = documents.slice(low, step)
            words, row = _flat(some["terms"])
            term = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
            known = vocabulary[term] == words
            weight, term, row = _flat(some["weights"])[0][known], term[known], row[known]
            size = starts[term + 1] - starts[term]
            at = np.repeat(starts[term] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            cell = np.repeat(row, size) * claims.num_rows + owners[at]
            sums = np.bincount(cell, np.repeat(weight, size) * weights[at], some.num_rows * claims.num_rows).reshape(some.num_rows, claims.num_rows)
            scores = np.round(sums / some["norm"].to_numpy()[:, None], 10)
            top = scores.argmax(axis=0)  # the first of equal ones, and paths are in order
            high = scores[top, np.arange(claims.num_rows)]
            better = high > best
            best[better], place[better] = high[better], top[better] + low
    found = np.flatnonzero(best > 0)
    kept = claims.select(CLAIM).take(pa.array(found))
    return kept.append_column("path", documents["path"].take(pa.array(place[found]))).append_column("score", pa.array(best[found]))


def best_match(claims: DataFrame, documents: DataFrame, claim_rows: int = 1_000, document_rows: int = 5_000) -> DataFrame:
    """JN8, WN10: the document of highest TF-IDF cosine per claim; null and 0.0 without one.

    Documents and claims become one sparse vector row each (documents keep only terms that some
    claim of their run uses, and the norm over all terms). Both sides of a run are cut into blocks
    of bounded size; every pair of blocks is one cell, scored on its own and reduced to one row per
    claim before the last shuffle. Of equal scores the first path wins.
    """
    words = claims.select(*CLAIM, ft.tokenize("text").alias("tokens")).where(F.size("tokens") > 0)
    counted = words.select(*CLAIM, F.size("tokens").alias("total"), F.explode(ft.term_counts("tokens")).alias("c"))
    counted = counted.select(*CLAIM, "c.term", "c.n", "total")
    # terms of claims get numbers, which are all that vectors hold of them
    claim_terms = cut_lineage(counted.select(*RUN, "term").distinct().withColumn("used", F.monotonically_increasing_id()))
    frequencies = cut_lineage(term_frequencies(documents))
    # both sides have one row per term; the postings then need a single join, whose hot terms AQE can split
    idf = inverse_frequencies(frequencies, documents).select(*RUN, "term", "idf")
    idf = cut_lineage(idf.join(claim_terms, [*RUN, "term"], "left"))
    square = F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")
    pairs = lambda pair: F.array_sort(F.collect_list(pair)).alias("pairs")
    weighted = counted.join(idf, [*RUN, "term"]).withColumn("w", F.col("n") / F.col("total") * F.col("idf"))
    claim_rows_of = weighted.groupBy(*CLAIM).agg(square, pairs(F.struct("term", "used", "w")))
    claim_vectors = claim_rows_of.select(*CLAIM, F.col("pairs.used").alias("terms"), F.transform("pairs.w", lambda w: w / F.col("norm")).alias("weights"))
    weights = frequencies.join(idf, [*RUN, "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    shared = weights.groupBy(*RUN, "path").agg(square, pairs(F.when(F.col("used").isNotNull(), F.struct("term", "used", "w"))))
    document_vectors = shared.where(F.size("pairs") > 0).select(*RUN, "path", F.col("pairs.used").alias("terms"), F.col("pairs.w").alias("weights"), "norm")
    left, right = block_pairs(cut_lineage(claim_vectors), cut_lineage(document_vectors), RUN, "claim_id", "path", claim_rows, document_rows)
    kinds = dict(words.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in CLAIM) + ", path string, score double"
    found = left.cogroup(right).applyInArrow(_score_cell, schema)
    top = found.groupBy(*CLAIM).agg(F.min(F.struct((-F.col("score")).alias("s"), "path")).alias("b"))
    joined = words.select(*CLAIM).join(top, CLAIM, "left")
    return joined.select(*CLAIM, F.col("b.path").alias("best_match_file"), rounded(F.coalesce(-F.col("b.s"), F.lit(0.0)), 4).alias("similarity_score"))
