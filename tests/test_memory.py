from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from projectpulse.operators import memory as M
from projectpulse.plans import reports
from projectpulse.sources.store import RecordStore

BASE = datetime(2026, 1, 1)
SCHEMA = "record_id string, project_id string, record_type string, recorded_at timestamp, seq bigint, summary string, payload string, health_score double"


def records(spark, items):
    data = [(r, p, t, BASE + timedelta(minutes=m), i, s, "{}", h) for i, (r, p, t, m, s, h) in enumerate(items)]
    return spark.createDataFrame(data, SCHEMA)


def three(spark):
    return records(spark, [("rec-1", "p", "inspection", 0, "a", 1.0), ("rec-2", "p", "nlp", 5, "b", None), ("rec-3", "p", "inspection", 10, "c", 3.0)])


def test_history_and_series(spark):
    df = three(spark)
    assert [r.record_id for r in M.history(df, 2).orderBy("rank").collect()] == ["rec-3", "rec-2"]
    assert [r.record_id for r in M.history(df, 5, "inspection").orderBy("rank").collect()] == ["rec-3", "rec-1"]
    assert rows(M.trend_series(df), "record_id") == [("rec-1",), ("rec-3",)]
    assert rows(M.trend_series(df, None, 1), "record_id") == [("rec-1",)]  # a limit keeps the oldest


def test_upsert_is_idempotent(spark):
    df = three(spark)
    assert M.upsert(df, df).count() == 3
    newer = records(spark, [("rec-1", "p", "inspection", 60, "new", 9.0)])
    assert M.upsert(df, newer).where("record_id = 'rec-1'").first().summary == "new"


def test_write_and_prune(spark, tmp_path):
    M.write_records(three(spark), str(tmp_path / "records"))
    back = spark.read.parquet(str(tmp_path / "records")).where("project_id = 'p' AND record_type = 'nlp'")
    assert rows(back, "record_id") == [("rec-2",)]
    with pytest.raises(Exception, match="unknown record type"):
        M.check_record_types(three(spark).withColumn("record_type", F.lit("iot"))).collect()


def test_by_ids_stays_in_the_project(spark):
    ids = spark.createDataFrame([("p", "rec-1"), ("q", "rec-2")], "project_id string, record_id string")
    assert rows(M.by_ids(three(spark), ids), "record_id") == [("rec-1",)]


def test_project_ids_and_guards(spark):
    df = spark.createDataFrame([(" My-App ",), ("a",), ("_x1",), ("ok_1",), ("a" * 64,)], "project_id string")
    assert rows(M.normalized_project_ids(df)) == [("_x1", False), ("a", False), ("a" * 64, False), ("my-app", True), ("ok_1", True)]
    queries = spark.createDataFrame([("x", 1), (" ", 1), ("x", 51), ("x", 0), (None, 3)], "query_text string, top_k int")
    good, bad = M.guard_queries(queries)
    assert good.count() == 1 and bad.count() == 4


@pytest.mark.parametrize("block", [2, 1000])
def test_recall_matches_brute_force(spark, block):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(60, 8))
    vectors[7] = vectors[8]
    kinds = ["inspection" if i % 2 else "nlp" for i in range(60)]
    data = [(i, "p" if i < 40 else "q", kinds[i], vectors[i].tolist()) for i in range(60)]
    stored = spark.createDataFrame(data, "record_id bigint, project_id string, record_type string, embedding array<double>")
    queries = [(i, "p", rng.normal(size=8).tolist(), 3 + i, "nlp" if i == 2 else None) for i in range(5)]
    asked = spark.createDataFrame(queries, "query_id bigint, project_id string, embedding array<double>, top_k int, record_type string")
    found = M.recall_topk(stored.repartition(4), asked, block).orderBy("query_id", "rank").collect()
    for query, _, vector, k, kind in queries:
        v = np.array(vector)
        scores = [(-round(float(v @ vectors[i] / np.linalg.norm(v) / np.linalg.norm(vectors[i])), 8), i)
                  for i in range(40) if kind is None or kinds[i] == kind]
        expected = [(i, round(1 - (1 + s) / 2, 4)) for s, i in sorted(scores)[:k]]
        assert [(r.record_id, r.similarity_score) for r in found if r.query_id == query] == expected


def test_recall_drops_matches_without_a_record(spark):
    stored = spark.createDataFrame([(1, "p", "nlp", [1.0, 0.0]), (2, "p", "nlp", [0.0, 1.0])], "record_id bigint, project_id string, record_type string, embedding array<double>")
    asked = spark.createDataFrame([(1, "p", [1.0, 0.0], 2, None, "text")], "query_id bigint, project_id string, embedding array<double>, top_k int, record_type string, query_text string")
    full = spark.createDataFrame([(2, "p", "kept")], "record_id bigint, project_id string, summary string")
    assert rows(reports.recall(full, stored, asked), "record_id", "summary", "similarity_score") == [(2, "kept", 0.5)]


def test_summaries_and_records(spark):
    df = spark.createDataFrame([("r", "p", BASE, 1, 97.5, 3)], "record_id string, project_id string, recorded_at timestamp, seq bigint, health double, files bigint")
    summary = M.inspection_summary(F.lit("/src"), F.lit("completed"), F.col("health"), F.col("files"), F.lit(2))
    row = M.record_report(df, "inspection", summary, F.col("health")).first()
    assert row.summary == "Inspection run for '/src': status=completed, health_score=97.50, files=3, findings=2."
    assert row.health_score == 97.5 and row.payload == '{"health":97.5,"files":3}'
    assert M.record_report(df, "nlp", F.lit("s"), F.col("health")).first().health_score is None
    text = df.select(M.reasoning_summary(F.lit("/s"), F.lit(1), F.lit(2), F.lit(3), F.lit(None).cast("string")).alias("a"),
                     M.visual_summary(F.lit("b"), F.lit("c"), F.lit("match"), F.lit(0)).alias("v")).first()
    assert text.a == "AI reasoning run for '/s': 1 correlation group(s), 2 dependency assessment(s), 3 recommendation(s)."
    assert text.v == "Visual comparison 'b' -> 'c': verdict=match, findings=0."


def test_projects_that_share_ids_stay_apart(spark):
    both = records(spark, [("r1", "a", "nlp", 0, "of a", 1.0), ("r1", "b", "nlp", 9, "of b", 2.0)])
    assert rows(M.upsert(both, both), "project_id", "summary") == [("a", "of a"), ("b", "of b")]
    stored = spark.createDataFrame([("a1", "a", "nlp", [1.0, 0.0]), ("b1", "b", "nlp", [1.0, 0.0])], "record_id string, project_id string, record_type string, embedding array<double>")
    asked = spark.createDataFrame([(1, p, [1.0, 0.0], 3, None) for p in "ab"], "query_id bigint, project_id string, embedding array<double>, top_k int, record_type string")
    assert rows(M.recall_topk(stored, asked), "project_id", "record_id") == [("a", "a1"), ("b", "b1")]


def test_the_newest_record_is_found_without_sorting(spark):
    df = three(spark)
    again = records(spark, [("rec-1", "p", "inspection", 0, "a", 1.0)] * 3 + [("rec-3", "p", "inspection", 10, "late", 3.0), (None, "p", "nlp", 1, "x", None), (None, "p", "nlp", 2, "y", None)])
    merged = M.upsert(df, again)
    assert rows(merged, "record_id", "summary") == [("rec-1", "a"), ("rec-2", "b"), ("rec-3", "late"), (None, "y")]
    assert "SortAggregate" not in merged._jdf.queryExecution().executedPlan().toString()


def stored(spark, items, start=0):
    return spark.createDataFrame([(f"rec-{i}", "p", "nlp", BASE + timedelta(minutes=start + k), k, s, "{}", None) for k, (i, s) in enumerate(items)], SCHEMA)


def test_store_rewrites_only_buckets_that_change(spark, tmp_path):
    store = RecordStore(spark, str(tmp_path / "store"), SCHEMA, buckets=16)
    assert store.read().count() == 0 and store.versions() == []
    first = store.merge(stored(spark, [(i, "old") for i in range(200)]))
    assert len(first["folders"]) == 16 and store.read().count() == 200
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / "data").rglob("*.parquet")}
    second = store.merge(stored(spark, [(3, "new"), (500, "more")], start=10_000))
    changed = {b for b in second["folders"] if second["folders"][b] != first["folders"][b]}
    assert 1 <= len(changed) <= 2
    assert {p: p.stat().st_mtime_ns for p in files} == files  # old files are never written again
    assert dict(rows(store.read(), "record_id", "summary"))["rec-3"] == "new" and store.read().count() == 201
    assert store.read(1).count() == 200 and dict(rows(store.read(1), "record_id", "summary"))["rec-3"] == "old"
    third = store.merge(stored(spark, [(3, "new")], start=10_000))  # the same delivery again
    assert store.read().count() == 201 and third["version"] == 3
    store.merge(stored(spark, [(3, "older")], start=-10_000))
    assert dict(rows(store.read(), "record_id", "summary"))["rec-3"] == "new"
    assert store.merge(stored(spark, []))["version"] == 4
    store.vacuum(keep=1)
    assert store.versions() == [4] and store.read().count() == 201
    with pytest.raises(ValueError, match="no version 1"):
        store.read(1)
    assert RecordStore(spark, str(tmp_path / "store"), SCHEMA, buckets=99).merge(stored(spark, [(9, "z")], start=20_000))["buckets"] == 16


def test_a_failed_merge_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = RecordStore(spark, str(tmp_path / "store"), SCHEMA, buckets=4)
    store.merge(stored(spark, [(i, "old") for i in range(20)]))
    with pytest.raises(Exception, match="unknown record type"):
        store.merge(stored(spark, [(1, "bad")]).withColumn("record_type", F.lit("iot")))

    def stop(manifest):
        raise OSError("lost the connection")

    with monkeypatch.context() as patched:
        patched.setattr(store, "_publish", stop)
        with pytest.raises(OSError):
            store.merge(stored(spark, [(1, "new")], start=10_000))
    assert store.versions() == [1] and {r.summary for r in store.read().collect()} == {"old"}
    stale = store.manifest()
    store.merge(stored(spark, [(1, "new")], start=10_000))
    with monkeypatch.context() as patched:  # a merge that started from version 1 as well
        patched.setattr(store, "manifest", lambda version=None: stale)
        with pytest.raises(RuntimeError, match="another merge"):
            store.merge(stored(spark, [(2, "lost")], start=10_000))
    assert store.versions() == [1, 2]
    store.vacuum(keep=2)
    assert dict(rows(store.read(), "record_id", "summary"))["rec-1"] == "new" and store.read().count() == 20
