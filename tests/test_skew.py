from datetime import datetime, timedelta

from pyspark.sql import functions as F

from projectpulse import skew
from projectpulse.catalog import registry
import __spark_entry__ as entry_points

BASE = datetime(2026, 1, 1)


def hot(spark):
    data = [("hot", BASE + timedelta(minutes=7 * i), i, float(i % 5)) for i in range(500)] + [("cold", BASE, 0, 2.0)]
    return spark.createDataFrame(data, "k string, ts timestamp, seq bigint, v double")


def test_prefix_totals_across_chunks(spark):
    found = skew.prefix_totals(hot(spark), ["k"], ["ts", "seq"], skew.time_chunk("ts", 3), {"total": F.col("v"), "n": F.lit(1)})
    total = 0.0
    for i, row in enumerate(found.where("k = 'hot'").orderBy("ts").collect()):
        assert (row.n, row.total) == (i, total)
        total += row.v


def test_previous_values_across_chunks(spark):
    found = skew.previous_values(hot(spark), ["k"], ["ts", "seq"], skew.time_chunk("ts", 2), ["v"])
    values = found.where("k = 'hot'").orderBy("ts").collect()
    assert [r.prev_v for r in values] == [None] + [r.v for r in values[:-1]]


def test_block_pairs_meet_every_row_once(spark):
    left = spark.range(90).selectExpr("id as a", "if(id % 3 = 0, 'cold', 'hot') as k")
    right = spark.range(40).selectExpr("id as b", "if(id % 4 = 0, 'other', 'hot') as k")
    one, two = skew.block_pairs(left, right, ["k"], "a", "b", 11, 7)
    cross = lambda x, y: x[["a"]].merge(y[["b"]], how="cross")
    met = one.cogroup(two).applyInPandas(cross, "a bigint, b bigint").collect()
    expected = [(a, b) for a in range(90) if a % 3 for b in range(40) if b % 4]
    assert sorted((r.a, r.b) for r in met) == expected


def test_written_tables_know_their_size(spark):
    df = skew.cut_lineage(hot(spark).crossJoin(spark.range(2)).drop("id"))
    assert df.count() == 1002 and "FileScan parquet" in df._jdf.queryExecution().executedPlan().toString()


def test_temporary_tables_go_with_their_scope(spark):
    outer = skew.cut_lineage(spark.range(3).toDF("k"))
    with skew.temporary_tables(spark):
        inner = skew.cut_lineage(spark.range(5).toDF("k"))
        assert inner.count() == 5
    assert outer.count() == 3
    spark.catalog.clearCache()
    try:
        left = spark.read.schema("k bigint").parquet(inner.inputFiles()[0]).count()
    except Exception:  # noqa: BLE001
        left = 0
    assert left == 0


def test_every_query_has_sql_and_a_name():
    assert set(registry.ORACLES) == set(registry.QUERIES) <= set(entry_points.queries())
    assert set(registry.ORACLES) <= set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() == 229


def test_session_plan_shuffles_rows_once(spark):
    plan = registry.QUERIES["wn1_derive_sessions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "props" not in plan.split("ReadSchema")[-1]
