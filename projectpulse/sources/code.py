"""Facts about Python files, read with the standard parser inside Spark tasks."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from projectpulse.functions import fixed
from projectpulse.functions import files as ff
from projectpulse.functions.scalars import strip

FACT = pa.struct([
    ("ord", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("line", pa.int64()),
    ("complexity", pa.int64()), ("has_doc", pa.bool_()), ("level", pa.int32()), ("text", pa.string()),
])
FACT_SCHEMA = "ord int, kind string, name string, line bigint, complexity bigint, has_doc boolean, level int, text string"
_SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.Assert, ast.IfExp)


#: nodes below which nothing is counted or defined
_LEAVES = (ast.Name, ast.Constant, ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop, ast.alias, ast.Pass, ast.Break, ast.Continue)
#: fields of statements that hold statements
_BLOCKS = ("body", "handlers", "cases", "orelse", "finalbody")


def _below(node: ast.AST) -> Iterator[ast.AST]:
    """Children of a node that are no leaves."""
    for value in vars(node).values():
        if isinstance(value, list):
            yield from (item for item in value if isinstance(item, ast.AST) and not isinstance(item, _LEAVES))
        elif isinstance(value, ast.AST) and not isinstance(value, _LEAVES):
            yield value


def _statements(tree: ast.Module) -> Iterator[ast.AST]:
    """The module and its statements, at any depth, in the order of ``ast.walk``; expressions hold none."""
    level = [tree]
    while level:
        yield from level
        level = [item for node in level for block in _BLOCKS if isinstance(inner := getattr(node, block, None), list) for item in inner]


def _complexity(function) -> int:
    total, pending = 1, list(function.body)
    while pending:
        node = pending.pop()
        if isinstance(node, _SCOPES):
            continue
        if isinstance(node, _BRANCHES):
            total += 1
        elif isinstance(node, ast.BoolOp):
            total += len(node.values) - 1
        elif isinstance(node, ast.comprehension):
            total += 1 + len(node.ifs)
        pending.extend(_below(node))
    return total


def _facts(content: bytes) -> list[tuple]:
    """(kind, name, line, complexity, has_doc, level, text) of one file; one that cannot be taken apart is a single fact with the reason."""
    try:
        return list(_parsed(ast.parse(bytes(content).decode("utf-8"))))
    except UnicodeDecodeError as error:
        return [("undecodable", None, None, None, None, None, str(error.reason))]
    except (RecursionError, MemoryError) as error:
        reason = "nested too deeply" if isinstance(error, RecursionError) else "too large for the parser"
        return [("unparsable", None, None, None, None, None, reason)]
    except (SyntaxError, ValueError) as error:
        return [("syntax_error", None, getattr(error, "lineno", None), None, None, None, getattr(error, "msg", str(error)))]


def _parsed(tree: ast.Module) -> Iterator[tuple]:
    for node in _statements(tree):
        if isinstance(node, (ast.Module, *_SCOPES)):
            doc = ast.get_docstring(node) or ""
            first = doc.splitlines()[0] if doc else None
            if isinstance(node, ast.Module):
                yield "module", None, None, None, bool(doc), None, first
            elif isinstance(node, ast.ClassDef):
                yield "class", node.name, node.lineno, None, bool(doc), None, first
            else:
                yield "function", node.name, node.lineno, _complexity(node), bool(doc), None, first
        elif isinstance(node, ast.Import):
            for alias in node.names:
                yield "import", alias.name, node.lineno, None, None, 0, None
        elif isinstance(node, ast.ImportFrom):
            for alias in node.names:
                yield "import_from", node.module or "", node.lineno, None, None, node.level or 0, alias.name


def _packed(facts: list[list[tuple]]) -> pa.ListArray:
    """The facts of every file as one list, numbered in its order."""
    ends = [0]
    for own in facts:
        ends.append(ends[-1] + len(own))
    rows = [(position, *fact) for own in facts for position, fact in enumerate(own)]
    columns = list(zip(*rows)) or [()] * len(FACT)
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FACT, strict=True)], fields=list(FACT))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def with_facts(files: DataFrame) -> DataFrame:
    """SC12 as a list: every file is parsed once and keeps its row; ``content``, null where nothing is to be parsed, gives way to ``facts``.

    Parsing is per file, so a project of any size spreads over as many tasks as its files fill.
    """
    rest = [name for name in files.columns if name != "content"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts = _packed([_facts(content.as_py()) if content.is_valid else [] for content in batch["content"]])
            yield pa.RecordBatch.from_arrays([*[batch[name] for name in rest], facts], names=[*rest, "facts"])

    schema = StructType(files.select(*rest).schema.fields).add("facts", ArrayType(StructType.fromDDL(FACT_SCHEMA)))
    return files.select(*rest, "content").mapInArrow(parse, schema)


def code_facts(sources: DataFrame) -> DataFrame:
    """SC12: every Python file is parsed once; all metrics are aggregates over the facts.

    ``sources`` has (project_id, run_id, path, content binary).
    """
    python = sources.where(ff.extension("path") == "py")  # a condition on the content would make it twice
    return with_facts(python.select("project_id", "run_id", "path", "content")).select("project_id", "run_id", "path", F.inline("facts"))


def comment_lines(sources: DataFrame) -> DataFrame:
    """FN10: comment texts without shebangs and encoding cookies; ``text`` is the decoded file."""
    lines = sources.select("project_id", "run_id", "path", F.posexplode(ff.lines_of("text")).alias("pos", "raw"))
    bare = strip(F.regexp_replace(strip("raw"), "^#+", ""))
    comments = lines.where(strip("raw").startswith("#") & ~strip("raw").startswith("#!"))
    comments = comments.select("project_id", "run_id", "path", "pos", bare.alias("comment"))
    return comments.where((F.col("comment") != "") & ~F.col("comment").rlike(fixed.ENCODING_COOKIE_PATTERN))


def text_blobs(facts: DataFrame, comments: DataFrame) -> DataFrame:
    """AG31: docstring first lines, symbol names and comments of each parsed file that is no test.

    The list that is collected holds the words of one file, bounded by its size.
    """
    parsed = facts.where(F.col("kind") == "module").select("project_id", "run_id", "path")
    symbols = facts.where(F.col("kind").isin("module", "function", "class")).select(
        "project_id", "run_id", "path", F.lit(0).alias("part"), F.col("ord").alias("pos"),
        F.concat_ws(" ", "name", "text").alias("words"),
    )
    notes = comments.join(parsed, ["project_id", "run_id", "path"], "left_semi").select(
        "project_id", "run_id", "path", F.lit(1).alias("part"), "pos", F.col("comment").alias("words")
    )
    words = symbols.unionByName(notes).where(ff.is_python_source("path"))  # test files implement nothing
    ordered = F.array_sort(F.collect_list(F.struct("part", "pos", "words")))
    filled = F.filter(F.transform(ordered, lambda w: w.words), lambda w: w != "")
    return words.groupBy("project_id", "run_id", "path").agg(F.array_join(filled, " ").alias("blob"))
