"""Column helpers for paths, file contents and lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from projectpulse.functions import fixed
from projectpulse.functions.scalars import as_col


def line_count(content) -> Column:
    """FN2: newline bytes, plus one for an unterminated last line."""
    text = F.decode(as_col(content), "ISO-8859-1")
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    open_end = F.when((F.length(text) > 0) & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)
    return (newlines + open_end).cast("bigint")


def sha256(content) -> Column:
    """FN3"""
    return F.sha2(as_col(content), 256)


def file_name(path) -> Column:
    return F.substring_index(as_col(path), "/", -1)


def extension(path) -> Column:
    """FN4: suffix of the file name without its dot; none for a leading dot only."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1)


def parent(path) -> Column:
    """FN4: directory of a path, '.' for the root."""
    path = as_col(path)
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def module_name(path) -> Column:
    """FN4: dotted name under which a file is imported."""
    dotted = F.replace(F.regexp_replace(as_col(path), r"\.py$", ""), F.lit("/"), F.lit("."))
    return F.regexp_replace(dotted, r"\.__init__$", "")


def is_test_file(path) -> Column:
    """PR8: the name starts with test_ or a path part is exactly tests."""
    path = as_col(path)
    return file_name(path).startswith("test_") | path.rlike("(^|/)tests(/|$)")


def is_python_source(path) -> Column:
    return (extension(path) == "py") & ~is_test_file(path)


def document_kind(path) -> Column:
    """SC11: readme, dependency_manifest, python_source or null."""
    name = F.lower(file_name(path))
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
    return (
        F.when(stem == "readme", "readme")
        .when(name.startswith("requirements") & name.endswith(".txt"), "dependency_manifest")
        .when(is_python_source(path), "python_source")
    )


def lines_of(text) -> Column:
    """Lines as text editors see them; a final line break opens no further line."""
    whole = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.transform(F.array(F.split(as_col(text), fixed.LINE_BREAKS, -1)), whole)[0]  # a variable: the text is split once


def resolve_relative(module, is_package, level, target) -> Column:
    """FN5: absolute dotted name of a relative import."""
    parts = F.split(as_col(module), "[.]")
    drop = as_col(level) - F.when(as_col(is_package), 1).otherwise(0)
    base = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - drop, F.lit(0)))
    tail = F.when(F.coalesce(as_col(target), F.lit("")) != "", F.split(as_col(target), "[.]"))
    joined = F.concat(base, F.coalesce(tail, F.array().cast("array<string>")))
    return F.array_join(F.filter(joined, lambda part: part != ""), ".")
