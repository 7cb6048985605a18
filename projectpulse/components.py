"""Connected components by alternating large and small stars.

Every round hangs the neighbours of a node below the smallest of them, so the number of rounds
grows with the logarithm of the longest path. The state between rounds is a table in the shared
folder: a lost executor costs a task, not the loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from projectpulse.skew import cut_lineage


def _least(pairs: DataFrame) -> DataFrame:
    """(_u, m): every u with the smallest of u and its v."""
    return pairs.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), F.least("u", "_m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang the larger neighbours of every node below its smallest neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    larger = both.where("v > u").join(_least(both), F.col("u") == F.col("_u"))
    return larger.select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours below the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = _least(down)
    hung = down.join(least, F.col("u") == F.col("_u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("_u").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(own).where("a != b").distinct()


def star_components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Smallest node that every node can reach: rows (node, component) for all nodes with an edge.

    ``edges`` has two comparable columns ``a`` and ``b`` of one type; null ends, loops and
    repeated edges are ignored. The result reads a table in the shared folder. With ``rounds``
    the search stops after so many: nodes of one component may then still differ, but never
    two components be one.
    """
    state = edges.select("a", "b").where("a is not null and b is not null and a != b").distinct()
    before, done = None, 0
    while rounds is None or done < rounds:
        state = cut_lineage(_small_star(_large_star(state)))
        done += 1
        if rounds is None:
            mark = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if mark == before:
                break
            before = mark
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    named = state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    return named if rounds is None else named.groupBy("node").agg(F.min("component").alias("component"))
