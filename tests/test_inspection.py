import pytest
from pyspark.sql import functions as F

from conftest import rows
from projectpulse.functions import files as ff
from projectpulse.operators import graph, inspection as I
from projectpulse.plans import reports
from projectpulse.sources.code import code_facts, comment_lines, text_blobs
from projectpulse.sources.tree import read_tree

KEYS = "project_id string, run_id bigint, "
FINDING = KEYS + "category string, severity string, code string, message string, file_path string, line bigint"


def sources(spark, files):
    data = [("p", 1, path, len(text.encode()), bytearray(text.encode())) for path, text in files.items()]
    return spark.createDataFrame(data, KEYS + "path string, size_bytes bigint, content binary")


def test_tree_scan(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "__init__.py").write_text("")
    (tmp_path / "pkg" / "a.py").write_bytes(b"x = 1\ny = 2")
    (tmp_path / ".hidden").write_text("h\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "skip.js").write_text("no")
    (tmp_path / "big.bin").write_bytes(b"0" * 200)
    found = read_tree(spark, str(tmp_path), maxbytes="100")
    contents = found.withColumns({"project_id": F.lit("p"), "run_id": F.lit(1).cast("bigint")})
    records = {r.relative_path: r for r in I.file_records(contents, 100).collect()}
    assert sorted(records) == [".hidden", "big.bin", "pkg/__init__.py", "pkg/a.py"]
    assert records["pkg/a.py"].line_count == 2 and records["pkg/a.py"].extension == "py"
    assert records["big.bin"].content_hash == "" and records["big.bin"].line_count == 0 and records["big.bin"].size_bytes == 200
    assert records["pkg/__init__.py"].line_count == 0 and len(records["pkg/__init__.py"].content_hash) == 64


def test_paths(spark):
    df = spark.createDataFrame([("a/b/c.tar.gz",), (".gitignore",), ("setup.py",), ("pkg/__init__.py",)], "p string")
    found = rows(df.select("p", ff.extension("p"), ff.parent("p"), ff.module_name("p")))
    assert ("a/b/c.tar.gz", "gz", "a/b", "a.b.c.tar.gz") in found and (".gitignore", "", ".", ".gitignore") in found
    assert ("setup.py", "py", ".", "setup") in found and ("pkg/__init__.py", "py", "pkg", "pkg") in found
    kinds = spark.createDataFrame([("README.md",), ("docs/readme",), ("requirements-dev.txt",), ("a/tests/b.py",), ("a/b.py",), ("c.txt",)], "p string")
    assert [r[0] for r in kinds.select(ff.document_kind("p")).collect()] == ["readme", "readme", "dependency_manifest", None, "python_source", None]


def test_lines(spark):
    df = spark.createDataFrame([("a\r\nb c\n",), ("",), ("a\n\nb",)], "t string")
    assert [r[0] for r in df.select(ff.lines_of("t")).collect()] == [["a", "b", "c"], [], ["a", "", "b"]]


CODE = '''"""Doc."""
import os, numpy.linalg
from . import sibling
from ..up import thing


def busy(a, b):
    """Documented."""
    if a and b or a:
        for i in [x for x in a if x if x]:
            while i:
                assert i
    try:
        pass
    except ValueError:
        return 1 if a else 2
    def inner():
        if a:
            pass


class Box:
    pass
'''


def test_code_facts_and_metrics(spark):
    df = sources(spark, {"pkg/sub/a.py": CODE, "pkg/bad.py": "def x(:\n", "pkg/empty.py": ""})
    facts = code_facts(df).cache()
    functions = {r.name: r.complexity for r in facts.where("kind = 'function'").collect()}
    # if 1, and/or 2, for 1, comprehension 1 + 2 ifs, while 1, assert 1, except 1, conditional 1
    assert functions == {"busy": 12, "inner": 2}
    metrics = {r.relative_path: r for r in I.file_metrics(facts).collect()}
    a = metrics["pkg/sub/a.py"]
    assert (a.function_count, a.class_count, a.max_cyclomatic_complexity, a.average_cyclomatic_complexity) == (2, 1, 12, 7.0)
    assert a.docstring_coverage == 0.5
    bad, empty = metrics["pkg/bad.py"], metrics["pkg/empty.py"]
    assert bad.has_syntax_error and bad.max_cyclomatic_complexity == 0 and bad.docstring_coverage == 0.0
    assert (empty.max_cyclomatic_complexity, empty.average_cyclomatic_complexity) == (1, 1.0)
    assert rows(I.complexity_findings(facts), "severity", "message") == [
        ("warning", "Function 'busy' has cyclomatic complexity 12, exceeding the threshold of 10.")]
    assert [r.code for r in I.syntax_findings(facts).collect()] == ["SYNTAX_ERROR"]


def test_undecodable_file_is_reported(spark):
    df = spark.createDataFrame([("p", 1, "a.py", 3, bytearray(b"\xff\xfe"))], KEYS + "path string, size_bytes bigint, content binary")
    assert [r.code for r in I.syntax_findings(code_facts(df)).collect()] == ["UNDECODABLE"]


def test_import_resolution_and_cycle(spark):
    files = {"pkg/__init__.py": "", "pkg/a.py": "from pkg import b\n", "pkg/b.py": "from .c import thing\n", "pkg/c.py": "import pkg.a.deep\n"}
    df = sources(spark, files)
    edges = graph.resolve_imports(code_facts(df), I.file_records(df))
    assert rows(edges, "src", "dst") == [
        ("pkg/a.py", "pkg/__init__.py"), ("pkg/a.py", "pkg/b.py"), ("pkg/b.py", "pkg/c.py"), ("pkg/c.py", "pkg/a.py")]
    found = I.cycle_findings(graph.cycle_chains(edges, graph.strongly_connected(edges))).collect()
    assert [r.message for r in found] == ["Circular import dependency detected: pkg/a.py -> pkg/b.py -> pkg/c.py -> pkg/a.py"]


def test_markers_skip_tests(spark):
    data = [("p", 1, path, "x = 1\n# todo: later FIXME\nxxx\n") for path in ("a.py", "test_a.py", "tests/b.py", "a.txt")]
    found = I.marker_scan(spark.createDataFrame(data, KEYS + "path string, text string"))
    assert rows(found, "file_path", "code", "line") == [("a.py", "FORBIDDEN_MARKER_FIXME", 2), ("a.py", "FORBIDDEN_MARKER_TODO", 2)]


def test_missing_init(spark):
    data = [("p", 1, path) for path in ("setup.py", "a/__init__.py", "a/x.py", "b/y.py", "tests/z.py")]
    found = I.missing_package_init(spark.createDataFrame(data, KEYS + "relative_path string"))
    assert rows(found, "file_path") == [(".",), ("b",)]


def test_drift(spark):
    schema = KEYS + "relative_path string, content_hash string"
    previous = spark.createDataFrame([("p", 1, "a", "1"), ("p", 1, "b", "1"), ("p", 1, "big", "")], schema)
    current = spark.createDataFrame([("p", 1, "a", "2"), ("p", 1, "c", "1"), ("p", 1, "big", ""), ("new", 1, "x", "1")], schema)
    assert rows(I.snapshot_drift(previous, current), "code", "severity", "file_path") == [
        ("FILE_ADDED", "info", "c"), ("FILE_MODIFIED", "info", "a"), ("FILE_REMOVED", "warning", "b")]


def finding(severity, project="p"):
    return (project, 1, "architecture", severity, "X", "", "a.py", None)


def test_health(spark):
    runs = spark.createDataFrame([("p", 1, 10), ("clean", 1, 3), ("awful", 1, 1)], KEYS + "file_count bigint")
    data = [finding("warning"), finding("error")] + [finding("critical", "awful")] * 9
    scores = dict(rows(I.health_scores(runs, spark.createDataFrame(data, FINDING)), "project_id", "health_score"))
    assert scores == {"p": 80.0, "clean": 100.0, "awful": 0.0}
    counts = I.count_by_severity(runs, spark.createDataFrame(data, FINDING)).where("project_id = 'p'").first()
    assert (counts.info_count, counts.warning_count, counts.error_count, counts.critical_count) == (0, 1, 1, 0)


def test_comments_and_blobs(spark):
    text = '#!/usr/bin/env python\n# -*- coding: utf-8 -*-\n"""First line.\n\nMore."""\n## Note one\ndef run():\n    """Runs."""\n    # inner\n'
    df = sources(spark, {"a.py": text}).withColumn("text", F.decode("content", "UTF-8"))
    assert text_blobs(code_facts(df), comment_lines(df)).first().blob == "First line. run Runs. Note one inner"


def test_inspection_report(spark):
    files = {"pkg/a.py": "from pkg import b\n# TODO\n", "pkg/b.py": "import pkg.a\n", "README.md": "# Title\n"}
    report = reports.inspection_report(sources(spark, files))
    codes = sorted(r.code for r in report["findings"].collect())
    assert codes == ["CIRCULAR_DEPENDENCY", "FORBIDDEN_MARKER_TODO", "MISSING_INIT_FILE"]
    assert report["health"].first().health_score == round(100 - 20 * 13 / 3, 2)


def test_baseline_from_the_newest_record(spark):
    schema = "record_id string, project_id string, record_type string, d string, payload string"
    body = '{"snapshot": {"files": {"a.py": {"content_hash": "%s", "size_bytes": 3}}}}'
    data = [("1", "p", "inspection", "2026-01-01", body % "old"), ("2", "p", "inspection", "2026-01-02", body % "new"), ("3", "p", "nlp", "2026-01-03", "{}")]
    records = spark.createDataFrame(data, schema).selectExpr("*", "cast(d as timestamp) as recorded_at")
    assert rows(I.snapshot_inventory(I.latest_snapshot(records))) == [("p", "a.py", "new")]


def test_big_undecodable_and_anchored_files(spark):
    """A Python file of 6 MB is parsed, bad bytes end no run, markers are tried line by line."""
    from projectpulse.plans import reports

    big = ("# filler\n" * 700_000 + "def late(x):\n    return x\n# TODO: big\n").encode()
    data = [("p", 1, "big.py", big), ("p", 1, "bad.py", b"x=\xff"), ("p", 1, "ok.py", b"one\nHACK here\n")]
    contents = spark.createDataFrame([(*row[:3], len(row[3]), bytearray(row[3])) for row in data], KEYS + "path string, size_bytes bigint, content binary")
    report = reports.inspection_report(contents)
    assert {r.relative_path: r.function_count for r in report["metrics"].collect()}["big.py"] == 1
    codes = {(r.file_path, r.code) for r in report["findings"].collect()}
    assert ("bad.py", "UNDECODABLE") in codes and any(path == "big.py" and "TODO" in code for path, code in codes)
    assert {r.relative_path: r.content_hash for r in report["inventory"].collect()}["big.py"] == ""
    texts = spark.createDataFrame([("p", 1, "ok.py", "one\nHACK here\nno HACK\n")], KEYS + "path string, text string")
    assert [(r.code[-1], r.line) for r in I.marker_scan(texts, {"H": "^HACK"}).collect()] == [("H", 2)]


def test_tree_scan_keeps_big_sources_and_reports_what_it_cannot_read(spark, tmp_path):
    deep = tmp_path
    for name in "abcdef":
        deep = deep / name
        deep.mkdir()
        (deep / f"{name}.py").write_bytes(b"#" * 300)
        (deep / f"{name}.bin").write_bytes(b"#" * 300)
    for wanted in ("1", "256"):
        found = {r.path: r for r in read_tree(spark, str(tmp_path), maxbytes="100", partitions=wanted).collect()}
        assert len(found) == 12 and len(found["a/b/c/c.py"].content) == 300 and found["a/a.bin"].content is None
    (tmp_path / "gone.py").symlink_to(tmp_path / "a" / "loop")
    (tmp_path / "a" / "loop").symlink_to(tmp_path / "gone.py")
    assert read_tree(spark, str(tmp_path)).count() == 12


def test_cycles_are_named_in_full_along_real_imports(spark):
    """Members out of the order of their names, and a member that lies on no shortest cycle."""
    arcs = [("a.py", "c.py"), ("c.py", "b.py"), ("b.py", "d.py"), ("d.py", "a.py"), ("c.py", "e.py"), ("e.py", "c.py")]
    arcs += [(f"m{i:02d}.py", f"m{(i * 7 + 7) % 210 // 7:02d}.py") for i in range(30)] + [(f"r{29 - i:02d}.py", f"r{(28 - i) % 30:02d}.py") for i in range(30)]
    edges = spark.createDataFrame([("p", 1, a, b) for a, b in arcs], KEYS + "src string, dst string")
    found = {r.file_path: r.message for r in I.cycle_findings(graph.cycle_chains(edges, graph.strongly_connected(edges))).collect()}
    assert found["a.py"].endswith(": a.py -> c.py -> b.py -> d.py -> a.py")
    for start, message in found.items():
        chain = message.split(": ")[1].split(" -> ")
        assert chain[0] == chain[-1] == start and set(zip(chain, chain[1:])) <= set(arcs)
    assert found["r00.py"].count(" -> ") == 30


@pytest.mark.parametrize("text", ["x = " + "+".join(["1"] * 20_000), "x = a" + ".b" * 20_000, "x = " + "(" * 5000 + ")" * 5000])
def test_a_file_beyond_the_parser_ends_no_run(spark, text):
    """Its reason is a finding, and other files of its task and of other projects keep theirs."""
    good = "def busy(x):\n" + "    if x:\n        x += 1\n" * 12 + "    return x\n"
    data = [("p", 1, "gen.py", text), ("p", 1, "ok.py", good), ("q", 1, "ok.py", good)]
    contents = spark.createDataFrame([(a, b, c, len(t), bytearray(t.encode())) for a, b, c, t in data], KEYS + "path string, size_bytes bigint, content binary").coalesce(1)
    report = reports.inspection_report(contents)
    codes = {(r.project_id, r.file_path, r.code) for r in report["findings"].collect()}
    assert {("p", "ok.py", "HIGH_COMPLEXITY"), ("q", "ok.py", "HIGH_COMPLEXITY")} <= codes
    assert {code for project, path, code in codes if path == "gen.py"} & {"UNPARSABLE", "SYNTAX_ERROR"}
    assert {r.project_id for r in report["health"].collect()} == {"p", "q"}


def test_required_literals():
    wanted = {
        r"(?i)\bTODO\b": "todo", "^HACK": "hack", "[0-9]{3,}": "", "a|b": "", "(?:FIX){2}ME": "fix", "colou?r": "colo", r"x\.y+z": "x.y", "(": "", r"\Qa\E": "",
        "ab(?=cd)e": "ab", "(foo)bar": "foobar", "(?x) a b": "",
    }
    assert {pattern: I.required_literal(pattern) for pattern in wanted} == wanted


def test_a_table_of_markers_equals_the_scan_line_by_line(spark):
    texts = ["x todo: y\nTODO\nfixme Fixme\n", "HACK here\nno HACK\n\nİTODO", "12345 a.b\nab\n", "", None]
    sources = spark.createDataFrame([("p", 1, f"f{i}.py", t) for i, t in enumerate(texts)] + [("q", 1, "test_x.py", "TODO")], KEYS + "path string, text string")
    markers = {"T": r"(?i)\btodo\b", "H": "^HACK", "N": "[0-9]{3,}", "AB": "a.?b", "F": "Fixme", "OR": "TODO|12"}
    markers |= {f"K{i}": f"word{i}" for i in range(300)}
    table = spark.createDataFrame([*markers.items(), ("T", r"\bTODO\b"), (None, "x")], "name string, pattern string")
    expected = sorted({(r.project_id, r.file_path, r.code, r.line) for r in I.marker_scan(sources, markers).collect()}, key=str)
    for block in (10_000, 50):
        found = [(r.project_id, r.file_path, r.code, r.line) for r in I.marker_table_scan(sources, table, block_rows=block).collect()]
        assert sorted(found, key=str) == expected
    assert I.marker_table_scan(sources, table.limit(0)).collect() == []


def test_many_markers_cost_little_more_than_a_few(spark):
    import time

    text = "\n".join(f"line {i} of some words that no marker names" for i in range(2000))
    sources = spark.createDataFrame([("p", 1, f"f{i}.py", text) for i in range(40)], KEYS + "path string, text string").repartition(4).cache()
    seconds = {}
    for size in (5, 1000):
        table = spark.createDataFrame([(f"K{i}", f"(?i)\\bmark{i}x\\b") for i in range(size)], "name string, pattern string")
        scan = I.marker_table_scan(sources, table)
        assert scan.count() == 0
        start = time.perf_counter()
        scan.count()
        seconds[size] = time.perf_counter() - start
    assert seconds[1000] < 3 * seconds[5] + 0.5


def test_project_report_joins_all_parts_on_the_import_graph(spark):
    """Two runs: the second has drift, a blast radius along real imports, a trend over both, and recommendations."""
    files = {"pkg/__init__.py": "", "pkg/core.py": "# TODO\nVALUE = 1\n", "pkg/a.py": "from pkg.core import VALUE\n", "pkg/b.py": "from pkg import a\n"}
    none = spark.sql("SELECT '' project_id, '' record_id, '' record_type, current_timestamp() recorded_at, 0L seq, '' summary, '' payload, 0D health_score WHERE false")
    day = lambda n: F.make_timestamp(*[F.lit(k) for k in (2026, 1, n, 0, 0, 0)])
    first = reports.project_report(sources(spark, files), none, day(1))
    assert first["trend"].first().direction == "unknown"
    later = sources(spark, files | {"pkg/core.py": "# TODO\nVALUE = 2\n", "pkg/new.py": "X = 1\n"}).withColumn("run_id", F.lit(2).cast("bigint"))
    stored = first["records"].cache()
    report = reports.project_report(later, stored, day(2))
    impact = {r.file_path: (r.direct_dependents, r.transitive_dependents, r.risk_score) for r in report["impact"].collect()}
    assert impact["pkg/core.py"] == (1, 2, 2 + (3 + 1) / 2)  # a marker and a modification
    row = report["predictions"].first()
    assert (row.file_count, row.max_dependency_risk, row.drift_churn_ratio) == (5, 4.0, 0.4)
    assert report["trend"].first().data_points_used == 2
    assert rows(report["history"].orderBy("run_index"), "finding_count") == [(1,), (3,)]
    assert {r.category for r in report["recommendations"].collect()} >= {"dependency_impact", "drift_significance"}
    assert report["insight"].first().high_impact_count == 1
    bare = reports.project_report(later, stored, day(2), include_reasoning=False)
    assert bare["predictions"].first().max_dependency_risk == 0.0 and "recommendations" not in bare.names()


def test_marker_batches_are_bounded():
    """Long lines with many markers: a batch holds each line once, and no more lines than fit its bytes."""
    import pyarrow as pa

    words = [f"word{i:03d}" for i in range(200)]
    line = " ".join(words) + "x" * 2_000
    batch = pa.RecordBatch.from_pydict({"project_id": ["p"] * 50, "run_id": [1] * 50, "path": [f"{i}.py" for i in range(50)], "lines": [[line, "", "none"]] * 50})
    found = list(I._marker_candidates([(w.upper(), w, w) for w in words], 64 << 10)(iter([batch])))
    assert max(b.nbytes for b in found) < 128 << 10 and sum(b.num_rows for b in found) == 50
    assert all([hit["pattern"] for hit in row["hits"]] == words and row["no"] == 1 and row["line"] == line for b in found for row in b.to_pylist())


def test_an_inspection_reads_every_file_once(spark):
    """Records, facts and markers come from one pass over the contents; who reads the drift alone has nothing parsed."""
    files = {"pkg/__init__.py": "", "pkg/a.py": "from pkg import b\n# TODO\n", "pkg/b.py": "X = 1\n", "notes.txt": "TODO\n"}
    read = spark.sparkContext.accumulator(0)

    def counted(content):
        read.add(1)
        return content

    contents = sources(spark, files).withColumn("content", F.udf(counted, "binary").asNondeterministic()("content"))
    report = reports.inspection_report(contents)
    assert report["drift"] is None
    assert report["health"].first().finding_count == 1 and rows(report["runs"], "file_count") == [(4,)]
    assert rows(report["edges"], "src", "dst") == [("pkg/a.py", "pkg/__init__.py"), ("pkg/a.py", "pkg/b.py")]
    assert read.value == len(files)
    old = I.file_records(sources(spark, files | {"pkg/a.py": "", "gone.py": ""}))
    later = reports.inspection_report(sources(spark, files), old)
    expected = [("FILE_MODIFIED", "pkg/a.py"), ("FILE_REMOVED", "gone.py")]
    assert rows(later["drift"], "code", "file_path") == expected and not later.made("scan")
    assert rows(later["findings"].where("category = 'drift'"), "code", "file_path") == expected


def test_facts_keep_the_order_of_a_full_walk(spark):
    """Statements in all kinds of blocks, and branches inside expressions of theirs."""
    import ast

    text = '''"""M."""
import os
try:
    import a.b
except (ValueError if os else KeyError):
    from . import c
else:
    def d(x=1 if os else 2): "D."; return [y for y in x if y if (lambda z: z and 1 or 2)(y)]
finally:
    class E:
        async def f(self):
            async with self as s, s: import g
            async for _ in s: yield {k: v for k, v in s if k or v}
            else: assert s, (1 if s else 2)
match os:
    case [1, *rest] if rest or os:
        while rest and os:
            def h(): from i import j, k
    case _:
        import l
for m in os: from n import *
'''
    named = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}
    expected = []
    for node in ast.walk(ast.parse(text)):
        if type(node) in named:
            expected.append((named[type(node)], node.name))
        elif isinstance(node, ast.Import):
            expected += [("import", alias.name) for alias in node.names]
        elif isinstance(node, ast.ImportFrom):
            expected += [("import_from", node.module or "") for alias in node.names]
    found = code_facts(sources(spark, {"a.py": text, "b.txt": text})).orderBy("ord").collect()
    assert [(r.kind, r.name) for r in found] == [("module", None), *expected]
    # d: comprehension 1 + 2 ifs, and, or; f: for 1, comprehension 1 + 1 if, or, assert, conditional
    assert {r.name: r.complexity for r in found if r.kind == "function"} == {"d": 6, "f": 7, "h": 1}


def test_markers_of_texts_without_their_literals_cost_no_split(spark):
    """A text is skipped only if no pattern can occur: letters beyond ASCII and patterns without a literal skip none."""
    texts = ["a\ntOdO\n", "İ todo\nſpan", "Σ and Σ", "nothing", "12", "", None]
    data = spark.createDataFrame([("p", 1, f"f{i}.py", t) for i, t in enumerate(texts)], KEYS + "path string, text string")
    hits = lambda markers: rows(I.marker_scan(data, markers), "file_path", "line")
    assert hits({"T": r"(?i)\btodo\b"}) == [("f0.py", 2), ("f1.py", 1)]
    assert hits({"S": "and Σ"}) == [("f2.py", 1)]
    assert hits({"T": "(?i)TODO", "N": "[0-9]+"}) == [("f0.py", 2), ("f1.py", 1), ("f4.py", 1)]
    plan = I.marker_scan(data, {"T": r"(?i)\btodo\b"})._jdf.queryExecution().analyzed().toString()
    assert "contains(lower(" in plan.lower()


def test_a_project_report_reads_every_file_once(spark):
    """Predictions, trend and the record of a run share one pass over its contents."""
    files = {"pkg/__init__.py": "", "pkg/a.py": "from pkg import b\n# TODO\n", "pkg/b.py": "X = 1\n"}
    read = spark.sparkContext.accumulator(0)

    def counted(content):
        read.add(1)
        return content

    none = spark.sql("SELECT '' project_id, '' record_id, '' record_type, current_timestamp() recorded_at, 0L seq, '' summary, '' payload, 0D health_score WHERE false")
    contents = sources(spark, files).withColumn("content", F.udf(counted, "binary").asNondeterministic()("content"))
    report = reports.project_report(contents, none, F.make_timestamp(*[F.lit(n) for n in (2026, 1, 1, 0, 0, 0)]))
    assert rows(report["predictions"], "file_count", "max_dependency_risk") == [(3, 1.5)]  # the marker of pkg/a.py: 3 / 2
    assert rows(report["trend"], "data_points_used") == [(1,)] and report["records"].count() == 1
    assert read.value == len(files)
