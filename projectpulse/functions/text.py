"""Tokens, requirement lines and package names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from projectpulse.functions import fixed
from projectpulse.functions.files import lines_of
from projectpulse.functions.scalars import as_col, strip


def tokenize(text) -> Column:
    """FN1: lower-case words, identifiers split at underscores and camel case.

    No part of an identifier goes beyond a word or an underscore, and every letter and digit is in one, so
    one search through the text finds them all.
    """
    parts = F.regexp_extract_all(as_col(text), F.lit(fixed.IDENTIFIER_PART_PATTERN), F.lit(0))
    tokens = F.transform(parts, lambda t: F.lower(t))
    return F.filter(tokens, lambda t: (F.length(t) >= fixed.MIN_TOKEN_LENGTH) & ~t.isin(fixed.STOPWORDS))


def term_counts(tokens) -> Column:
    """(term, n) of an array of tokens, counted inside the row: sort, then run lengths.

    A document is one row, so its counts need no shuffle. The one-element arrays bind the
    sorted tokens and the run starts to names, so that both are computed once.
    """

    def runs(ordered: Column) -> Column:
        opens = F.transform(ordered, lambda x, i: F.when((i == 0) | (x != F.get(ordered, i - 1)), i))
        starts = F.filter(opens, lambda i: i.isNotNull())

        def lengths(begin: Column) -> Column:
            return F.transform(begin, lambda p, j: F.struct(
                F.get(ordered, p).alias("term"),
                (F.coalesce(F.get(begin, j + 1), F.size(ordered)) - p).cast("bigint").alias("n"),
            ))

        return F.get(F.transform(F.array(starts), lengths), F.lit(0))

    return F.get(F.transform(F.array(F.sort_array(as_col(tokens))), runs), F.lit(0))


def keywords(text) -> Column:
    """Distinct tokens in sorted order."""
    return F.array_sort(F.array_distinct(tokenize(text)))


def keyword_overlap(a, b) -> Column:
    """SE4: share of the first keyword set that the second one holds."""
    return F.size(F.array_intersect(as_col(a), as_col(b))) / F.nullif(F.size(as_col(a)), F.lit(0))


def extract_title(text) -> Column:
    """FN6: first top-level heading, or null."""
    return F.nullif(strip(F.regexp_extract(as_col(text), fixed.TITLE_PATTERN, 1)), F.lit(""))


def strip_bullet(line) -> Column:
    bullet = strip(F.regexp_extract(as_col(line), fixed.BULLET_PATTERN, 1))
    return F.when(bullet != "", bullet).otherwise(as_col(line))


def is_requirement(line) -> Column:
    return as_col(line).rlike(fixed.MODAL_PATTERN) | as_col(line).rlike(fixed.USER_STORY_PATTERN)


def package_names(text) -> Column:
    """FN8: lower-case names at the start of manifest lines; options and comments are skipped."""
    lines = F.transform(lines_of(text), lambda line: strip(line))
    kept = F.filter(lines, lambda s: (s != "") & ~s.startswith("#") & ~s.startswith("-"))
    names = F.transform(kept, lambda s: F.lower(F.regexp_extract(s, fixed.PACKAGE_NAME_PATTERN, 1)))
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def canonical_name(name) -> Column:
    """FN9: separators unified to '-', lower case."""
    return F.regexp_replace(F.lower(strip(as_col(name))), "[-_.]+", "-")


def import_name(distribution) -> Column:
    """FN9: name under which a declared distribution is imported; the aliases are a fixed few."""
    canonical = canonical_name(distribution)
    chain = F
    for alias, module in fixed.DISTRIBUTION_ALIASES.items():
        chain = chain.when(canonical == alias, F.lit(module))
    return chain.otherwise(F.replace(canonical, F.lit("-"), F.lit("_")))
