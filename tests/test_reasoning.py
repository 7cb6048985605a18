import json
import random

import pytest
from conftest import rows
from projectpulse.operators import graph, reasoning as R

KEYS = "project_id string, run_id bigint, "
FINDING = KEYS + "category string, severity string, code string, message string, file_path string, line bigint"


def findings(spark, items):
    return spark.createDataFrame([("p", 1, c, s, code, "", path, None) for c, s, code, path in items], FINDING)


def edges(spark, pairs):
    return spark.createDataFrame([("p", 1, a, b) for a, b in pairs], KEYS + "src string, dst string")


def test_groups(spark):
    df = findings(spark, [("a", "error", "X", "a.py"), ("a", "info", "Y", "a.py"), ("a", "info", "X", "b.py"), ("a", "info", "Z", None)])
    groups = R.correlation_groups(df)
    assert rows(groups, "basis", "group_key", "finding_count", "weight") == [("same_code", "X", 2, 8), ("same_file", "a.py", 2, 8)]
    assert rows(R.group_members(groups, df), "basis", "code", "file_path") == [
        ("same_code", "X", "a.py"), ("same_code", "X", "b.py"), ("same_file", "X", "a.py"), ("same_file", "Y", "a.py")]
    assert [r.basis for r in R.correlation_order(groups).collect()] == ["same_code", "same_file"]


def test_hypotheses(spark):
    df = findings(spark, [("a", "info", "FORBIDDEN_MARKER_TODO", "a.py")] * 2 + [("a", "info", "SYNTAX_ERROR", "b.py"), ("a", "info", "ODD", None)])
    found = {r.finding_code: r for r in R.hypotheses(df).collect()}
    assert found["FORBIDDEN_MARKER_TODO"].probable_cause == "Unfinished or placeholder code marked 'TODO'."
    assert found["SYNTAX_ERROR"].probable_cause == "A Python source file could not be parsed."
    assert found["ODD"].probable_cause.startswith("No specific rule") and found["ODD"].file_count == 0
    assert [r.finding_code for r in R.hypothesis_order(R.hypotheses(df)).collect()][0] == "FORBIDDEN_MARKER_TODO"


def test_blast_radius(spark):
    graph_edges = edges(spark, [("b", "a"), ("c", "b"), ("a", "c"), ("d", "c")])
    nodes = spark.createDataFrame([("p", 1, n) for n in "abcd"], KEYS + "node string")
    df = findings(spark, [("x", "error", "X", "a"), ("x", "info", "X", "outside")])
    closure = graph.transitive_dependents(graph_edges, nodes)
    assert rows(closure.where("seed = 'a'"), "dependent") == [("b",), ("c",), ("d",)]
    impact = R.dependency_impact(df, nodes, graph.direct_dependents(graph_edges), graph.dependent_counts(graph_edges, nodes))
    assert rows(impact, "file_path", "direct_dependents", "transitive_dependents", "risk_score") == [("a", 1, 3, 6.5)]


def random_graph(seed, nodes=40, arcs=55):
    rng = random.Random(seed)
    pairs = {(f"n{rng.randrange(nodes):02d}", f"n{rng.randrange(nodes):02d}") for _ in range(arcs)}
    return {(a, b) for a, b in pairs if a != b}


def reach_of(pairs):
    nodes = sorted({n for p in pairs for n in p})
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            reach[a] |= reach[b]
    return nodes, reach


@pytest.mark.parametrize("whole_edges, bitmap_bytes", [(2_000_000, 64 << 20), (2_000_000, 1), (3, 64 << 20)])  # whole, in buckets, by rounds
def test_graph_searches_match_brute_force(spark, monkeypatch, whole_edges, bitmap_bytes):
    monkeypatch.setattr(graph, "WHOLE_EDGES", whole_edges)
    monkeypatch.setattr(graph, "BITMAP_BYTES", bitmap_bytes)
    pairs = random_graph(5) | {(f"w{i:03d}", f"n{i % 40:02d}") for i in range(90)}
    nodes, reach = reach_of(pairs)
    df = edges(spark, sorted(pairs)).unionByName(spark.createDataFrame([("q", 7, "n01", "n00")], KEYS + "src string, dst string"))
    seeds = spark.createDataFrame([("p", 1, n) for n in [*nodes, "absent"]] + [("q", 7, "n00")], KEYS + "node string")
    closure = graph.transitive_dependents(df, seeds)
    expected = {("p", a, b) for a in nodes for b in reach[a] if a != b} | {("q", "n01", "n00")}
    found = [tuple(r) for r in closure.select("project_id", "dependent", "seed").collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    counts = {(r.project_id, r.node): r.transitive_dependents for r in graph.dependent_counts(df, seeds).collect()}
    wanted = {(project, n): sum(1 for p, _, seed in expected if (p, seed) == (project, n)) for project, n in {(r[0], r[2]) for r in found}}
    assert {k: v for k, v in counts.items() if v} == wanted
    chains = {}
    members = graph.strongly_connected(df)
    for r in graph.cycle_chains(df, members).collect():
        chains.setdefault(r.component, {})[r.position] = r.node
    components = {r.component for r in members.collect()}
    assert set(chains) == components and components
    for start, steps in chains.items():
        chain = [steps[k] for k in range(len(steps))]
        assert chain[0] == start and len(set(chain)) == len(chain)
        assert all(arc in pairs for arc in zip(chain, chain[1:] + chain[:1]))
        assert chain == graph._shortest_cycle(*map(list, zip(*[(a, b) for a, b in pairs if {r.node for r in members.collect() if r.component == start} >= {a, b}])))


def test_components_match_brute_force(spark):
    pairs = random_graph(5)
    nodes, reach = reach_of(pairs)
    df = edges(spark, sorted(pairs))
    expected = {}
    for n in nodes:
        component = sorted(m for m in nodes if m in reach[n] and n in reach[m])
        if len(component) > 1:
            expected[n] = component[0]
    assert dict(map(tuple, graph.strongly_connected(df).select("node", "component").collect())) == expected
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert dict(map(tuple, graph.connected_components(df).select("node", "component").collect())) == label


def test_a_long_chain_needs_no_rounds(spark):
    chain = [(f"m{i:04d}", f"m{i + 1:04d}") for i in range(1000)]
    df = edges(spark, chain)
    seeds = spark.createDataFrame([("p", 1, "m1000"), ("p", 1, "m0500"), ("p", 1, "m0000")], KEYS + "node string")
    counts = graph.dependent_counts(df, seeds)
    assert {r.node: r.transitive_dependents for r in counts.collect()} == {"m1000": 1000, "m0500": 500, "m0000": 0}
    ring = edges(spark, [*chain, ("m1000", "m0000")])
    members = spark.createDataFrame([("p", 1, f"m{i:04d}", "m0000") for i in range(1001)], KEYS + "node string, component string")
    assert [r.node for r in graph.cycle_chains(ring, members).orderBy("position").collect()] == [f"m{i:04d}" for i in range(1001)]


def test_an_empty_graph_has_no_closure(spark):
    none, seeds = edges(spark, []), spark.createDataFrame([("p", 1, "a")], KEYS + "node string")
    assert graph.transitive_dependents(none, seeds).collect() == [] == graph.dependent_counts(none, seeds).collect()
    assert graph.cycle_chains(none, graph.strongly_connected(none)).collect() == []


def test_drift_insight_and_recommendation(spark):
    drift = findings(spark, [("drift", "info", "FILE_ADDED", "a"), ("drift", "warning", "FILE_REMOVED", "b"), ("drift", "info", "FILE_MODIFIED", "c")])
    impact = spark.createDataFrame([("p", 1, "a", 2.0), ("p", 1, "c", 1.9)], KEYS + "file_path string, risk_score double")
    runs = spark.createDataFrame([("p", 1, 10)], KEYS + "file_count bigint")
    hot = R.high_impact_drift(drift, impact)
    assert rows(hot, "file_path") == [("a",), ("b",)]
    insight = R.drift_insight(drift, runs, hot)
    row = insight.first()
    assert (row.churn_level, row.added_count, row.removed_count, row.modified_count, row.high_impact_count) == ("high", 1, 1, 1, 2)
    assert row.summary.startswith("3 of 10 files drifted since the previous inspection (1 added, 1 removed, 1 modified), classified as high churn.")
    assert R.drift_recommendations(insight).first().priority == "critical"


def test_recommendation_thresholds(spark):
    impact = spark.createDataFrame([("p", 1, "a", 1, 1, 0.5), ("p", 1, "b", 1, 1, 7.0)],
                                   KEYS + "file_path string, finding_count bigint, transitive_dependents bigint, risk_score double")
    assert rows(R.impact_recommendations(impact), "title", "priority") == [("Prioritize fixes in 'b'", "high")]
    hypo = R.hypotheses(findings(spark, [("a", "info", "X", "f")] * 5 + [("a", "info", "Y", "f")] * 2 + [("a", "info", "Z", "f")]))
    assert rows(R.hypothesis_recommendations(hypo), "title", "priority") == [
        ("Investigate recurring 'X' findings", "high"), ("Investigate recurring 'Y' findings", "medium")]


def test_parse_recommendations(spark):
    item = {"priority": "High", "category": "drift_significance", "title": "t", "description": "d", "affected_files": ["a", 1]}
    bodies = {1: json.dumps({"recommendations": [item]}), 2: json.dumps([item, {**item, "priority": "urgent"}, 5]), 3: "{bad",
              4: json.dumps({"x": 1}), 5: json.dumps([{**item, "title": " "}]), 6: "[]", 7: json.dumps({"recommendations": 3}), 8: "7",
              9: json.dumps({"recommendations": None})}
    good, bad = R.parse_recommendations(spark.createDataFrame([("p", k, v) for k, v in bodies.items()], KEYS + "body string"))
    assert rows(good, "run_id", "priority", "affected_files") == [(1, "high", ["a", "1"]), (2, "high", ["a", "1"])]
    assert dict(rows(bad, "run_id", "error")) == {
        3: "response was not valid JSON", 4: "no 'recommendations' key", 5: "no item was valid",
        7: "'recommendations' was not a list", 8: "response was neither a list nor an object", 9: "no 'recommendations' key"}


def test_batches_match_greedy_fill(spark):
    rng = random.Random(1)
    data, expected = [], {}
    for run, n in ((1, 200), (2, 10), (3, 60)):
        sizes = [rng.choice([50, 300, 700, 4500 if run == 3 else 900]) for _ in range(n)]
        batch = used = 0
        for i, size in enumerate(sizes):
            if sum(sizes) > 6000 and used and used + size > 4000:
                batch, used = batch + 1, 0
            used += size
            expected[(run, i)] = batch
            data.append(("p", run, i, size))
    rows = spark.createDataFrame(data, KEYS + "position bigint, chars bigint")
    for items in (10_000, 7, 1):  # slices shorter than a batch, too
        found = R.pack_batches(rows, slice_items=items)
        assert {(r.run_id, r.position): r.batch for r in found.collect()} == expected


def test_thousands_of_short_runs_are_numbered_together(spark):
    rng = random.Random(3)
    data, expected = [], {}
    for run in range(3000):
        sizes = [rng.choice([100, 900, 1700, 3900, 4500]) for _ in range(rng.randint(1, 30))]
        batch = used = 0
        for i, size in enumerate(sizes):
            if sum(sizes) > 6000 and used and used + size > 4000:
                batch, used = batch + 1, 0
            used += size
            expected[(f"p{run % 7}", run, i)] = batch
            data.append((f"p{run % 7}", run, i, size))
    rng.shuffle(data)
    items = spark.createDataFrame(data, KEYS + "position bigint, chars bigint")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        found = R.pack_batches(items, slice_items=25).collect()  # the longest runs go by slices
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.project_id, r.run_id, r.position): r.batch for r in found} == expected
    assert R.pack_batches(items.limit(0)).collect() == []


def test_buckets_of_a_run_number_its_nodes_alike_in_any_order():
    """Buckets may lie in different packs, whose rows arrive in different orders."""
    import pyarrow as pa

    pairs = sorted(random_graph(11, 40, 90))
    nodes, reach = reach_of(pairs)
    found = {node: 0 for node in nodes}
    for bucket in range(5):
        rows = [("p", 1, a, b, bucket, 8) for a, b in pairs] + [("p", 1, n, None, bucket, 8) for n in nodes]
        random.Random(bucket).shuffle(rows)
        batch = pa.RecordBatch.from_pylist([dict(zip(("project_id", "run_id", "src", "dst", "bucket", "bits"), r, strict=True)) for r in rows], pa.schema([
            ("project_id", pa.string()), ("run_id", pa.int64()), ("src", pa.string()), ("dst", pa.string()), ("bucket", pa.int64()), ("bits", pa.int64())]))
        for part in graph._search(False, [])(iter([batch])):
            for row in part.to_pylist():
                found[row["node"]] += row["transitive_dependents"]
    assert found == {node: sum(node in reach[other] for other in nodes if other != node) for node in nodes}


@pytest.mark.parametrize("levels", [0, 2, 64])
def test_blast_radius_equals_joined_counts(spark, monkeypatch, levels):
    monkeypatch.setattr(graph, "LEVELS", levels)
    schema = KEYS + "src string, dst string"
    items = [("p", r, a, b) for r in (1, 2, 3) for a, b in random_graph(r, 30, 25 * r)] + [("q", 1, f"c{i:03d}", f"c{i + 1:03d}") for i in range(150)]
    df = spark.createDataFrame(items, schema)
    files = {(p, r, n) for p, r, *ends in items for n in ends} | {("p", 1, "alone"), ("r", 1, "n00")}
    nodes = spark.createDataFrame(sorted(files), KEYS + "node string")
    listed = [(p, r, "a", "error", "X", "", n, None) for p, r, n in sorted(files)] + [("p", 1, "a", "info", "X", "", "outside", None), ("p", 1, "a", "info", "X", "", None, None)]
    rows_ = spark.createDataFrame(listed, FINDING)
    columns = ["project_id", "run_id", "file_path", "direct_dependents", "transitive_dependents", "finding_count", "risk_score"]
    joined = R.dependency_impact(rows_, nodes, graph.direct_dependents(df), graph.dependent_counts(df, nodes))
    found = rows(R.blast_radius(rows_, nodes, df), *columns)
    assert found == rows(joined, *columns) and len(found) == len(files)
    assert ("q", 1, "c150", 1, 150, 1, 153.5) in found and ("r", 1, "n00", 0, 0, 1, 3.5) in found


@pytest.mark.parametrize("seed", range(3))
def test_files_that_bring_their_edges_equal_edges_beside_them(spark, monkeypatch, seed):
    """Edges lie in lists of any row of the run, names are numbers; deep chains, cycles and a run too large for one bucket."""
    rng = random.Random(seed)
    pairs = {(rng.randrange(60), rng.randrange(60)) for _ in range(70)} | {(i, i + 1) for i in range(100, 100 + 40 * seed)} | {(130, 128)}
    nodes = sorted({n for p in pairs for n in p} | {999})
    arcs = {n: [] for n in nodes}
    for run_pair in pairs:
        arcs[rng.choice(nodes)].append(run_pair)
    files = [(p, r, n, arcs[n], n % 7) for p in (1, 2) for r in (1, 2) for n in nodes]
    listed = spark.createDataFrame(files, "project_id bigint, run_id bigint, node bigint, arcs array<struct<src: bigint, dst: bigint>>, weight int")
    apart = spark.createDataFrame([(str(p), r, str(a), str(b)) for p in (1, 2) for r in (1, 2) for a, b in pairs], KEYS + "src string, dst string")
    beside = spark.createDataFrame([(str(p), r, str(n), w) for p, r, n, _, w in files], KEYS + "node string, weight int")
    columns = ["project_id", "run_id", "node", "weight", "direct_dependents", "transitive_dependents"]
    text = lambda found: sorted(tuple(str(v) for v in row) for row in rows(found, *columns))
    wanted = text(graph.add_dependents(beside, apart))
    assert text(graph.add_dependents_listed(listed)) == wanted
    monkeypatch.setattr(graph, "LEVELS", 3)
    monkeypatch.setattr(graph, "BITMAP_BYTES", 64)
    assert text(graph.add_dependents_listed(listed)) == wanted


def test_levels_and_components_one_by_one_agree(monkeypatch):
    import numpy as np
    rng = np.random.default_rng(5)
    src, dst = rng.integers(0, 300, 380), rng.integers(0, 300, 380)
    wanted = graph._reaching(src, dst, np.arange(300), 38)
    monkeypatch.setattr(graph, "LEVELS", 0)
    assert (graph._reaching(src, dst, np.arange(300), 38) == wanted).all()
    reach = np.eye(300, dtype=bool)
    for _ in range(300):
        for a, b in zip(src, dst, strict=True):
            reach[b] |= reach[a]
    assert (np.unpackbits(wanted, axis=1, bitorder="little")[:, :300].astype(bool) == reach).all()


def test_totals_of_files_equal_drift_and_vectors_from_findings(spark, tmp_path):
    """The one row per file that the queries read gives what the operators give on findings, inventory and edges; line items are dealt twice, by file and by run."""
    from projectpulse.catalog import inputs, prediction as queries, reasoning
    from projectpulse.operators import inspection, prediction as P
    rng = random.Random(11)
    items = [(i, rng.randrange(40), rng.randrange(3), 1, float(rng.randrange(1, 51)), 1.0, rng.randrange(11) / 100, 0.0, rng.choice("ANR"), rng.choice("FO"),
              f"{rng.randrange(1994, 1998)}-05-01 00:00:00") for i in range(600)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string"
    table = spark.createDataFrame(items, names)
    table.withColumn("l_shipdate", table.l_shipdate.cast("timestamp_ntz")).write.parquet(f"{tmp_path}/lineitem.parquet")
    folder = str(tmp_path)
    runs, files, found, impact = queries.parts(spark, folder)
    assert rows(queries.vectors(spark, folder)) == rows(P.feature_vectors(runs, files, found, impact))
    drift = inspection.consecutive_drift(files, files)
    insight = R.drift_insight(drift, inputs.runs(files), R.high_impact_drift(drift, impact))
    assert rows(reasoning.insight(spark, folder)) == rows(insight, *reasoning.insight(spark, folder).columns)
    plan = inputs.run_files(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
