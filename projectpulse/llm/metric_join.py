"""Embedding near-duplicates: an exact metric range join.

Cosine c between unit vectors is the distance sqrt(2 - 2c), so links are pairs within a radius r.
Pivots, a bounded sample, divide the vectors into cells by the nearest pivot. By the triangle
inequality a vector of cell p within r of some vector of cell q is at most 2r farther from q's
pivot than from its own, and at most r plus the cell's radius away from it; for Euclidean distance
it also lies within r of the plane between both pivots. A vector is copied to just those cells
with a larger number, so each pair of cells meets once. Cells join independently: their own
vectors against all that are there. Both sides are cut into blocks of bounded size, and each pair of
blocks is a group of its own, so all pairs in reach are compared whatever the crowding. Products in
single precision sort out the pairs; those near the limit are computed in double precision.

How much the pivots save depends on the data: vectors without clusters, in many dimensions, are all
about as far from one pivot as from another, and then half of all pairs are compared.

Equal vectors are one class with a count; links are counted, not listed; each task reports the
number of links per class and a spanning forest of what it has joined.

Cases: vectors that are null, zero, or hold null or non-finite components link with nothing and are
their own component; vectors of different lengths never link; null ids link with nothing and have a null
component; rows that repeat an id count as separate vectors of one node; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from projectpulse.components import star_components
from projectpulse.llm import common
from projectpulse.skew import cut_lineage

#: vectors per pivot aimed at, most pivots, vectors per block
CELL_ROWS, MOST_PIVOTS, BLOCK_ROWS = 4096, 256, 4096
#: of distances, above rounding; of products in single precision, above theirs
SLACK, COARSE = 1e-9, 1e-4


def as_matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim).astype(np.float64)


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors as bytes."""
    for batch in batches:
        ids, out = [], {"vec_id": [], "dim": [], "vector": []}
        ids = batch["vec_id"].to_pylist()
        for name, values in zip(ids, batch["vector"].to_pylist(), strict=True):
            if name is None or not values or None in values:
                continue
            vector = np.array(values, np.float32)
            if np.isfinite(vector).all() and vector.any():
                out["vec_id"].append(name)
                out["dim"].append(len(vector))
                out["vector"].append((vector + np.float32(0)).tobytes())  # one zero for both signs
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("vector", pa.binary())]))


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * np.clip(vectors @ pivots.T, -1, 1), 0))


def _homes(pivots_by_dim: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            home, away = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                gap = _distances(units(as_matrix(batch["vector"].take(pa.array(rows)), dim)), pivots_by_dim[int(dim)])
                home[rows], away[rows] = gap.argmin(axis=1), gap.min(axis=1)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["dim"], batch["vector"], batch["copies"], pa.array(home), pa.array(away)], names=["vec_id", "dim", "vector", "copies", "home", "away"])

    return run


def _copy_out(pivots_by_dim: dict[int, np.ndarray], radii: dict[tuple[int, int], float], reach: float):
    """A row per vector and cell that it has to be compared in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, homes = batch["dim"].to_numpy(), batch["home"].to_numpy()
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                pivots = pivots_by_dim[int(dim)]
                vectors, home = units(as_matrix(batch["vector"].take(pa.array(rows)), dim)), homes[rows]
                gap, between = _distances(vectors, pivots), _distances(pivots, pivots)
                own = gap[np.arange(len(rows)), home][:, None]
                limit = np.array([radii.get((int(dim), q), -1.0) for q in range(len(pivots))])
                wanted = (gap - own <= 2 * reach + SLACK) & (gap <= limit + reach + SLACK) & (limit >= 0)
                apart = between[home]
                wanted &= (gap * gap - own * own) <= 2 * apart * reach + SLACK
                wanted &= np.arange(len(pivots))[None, :] > home[:, None]
                wanted[np.arange(len(rows)), home] = True
                row, cell = np.nonzero(wanted)
                at = pa.array(rows[row])
                yield pa.RecordBatch.from_arrays(
                    [batch["vec_id"].take(at), batch["dim"].take(at), batch["vector"].take(at), batch["copies"].take(at), pa.array(cell.astype(np.int32)), pa.array(cell == home[row])],
                    names=["vec_id", "dim", "vector", "copies", "cell", "resident"],
                )

    return run


def _near(left: np.ndarray, right: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs of unit vectors whose product reaches ``least``."""
    left32, right32 = left.astype(np.float32), right.astype(np.float32).T
    for low in range(0, len(left), 512):
        product = left32[low : low + 512] @ right32
        flat = np.flatnonzero(product >= np.float32(least - COARSE))
        value = product.ravel()[flat]
        i, j = np.divmod(flat, len(right))
        i += low
        sure = value >= least + COARSE
        doubtful = np.flatnonzero(~sure)
        for part in np.array_split(doubtful, -(-len(doubtful) // 65536) or 1):
            sure[part] = np.einsum("ij,ij->i", left[i[part]], right[j[part]]) >= least
        yield i[sure], j[sure]


def _join(least: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        dim = int(key[0].as_py())
        table = table.sort_by("vec_id")
        side, resident = table["left"].to_numpy(), table["resident"].to_numpy()
        ids, names, copies = table["vec_id"].to_numpy(), table["name"].to_numpy(), table["copies"].to_numpy()
        vectors = units(as_matrix(table["vector"], dim))
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
        # a vector may stand on both sides: links are gathered on its first row
        _, place = np.unique(names, return_inverse=True)
        first = np.full(place.max() + 1, len(ids))
        np.minimum.at(first, place, np.arange(len(ids)))
        node = first[place]
        links, labels = np.zeros(len(ids)), np.arange(len(ids))
        for i, j in _near(vectors[left], vectors[right], least) if len(left) and len(right) else []:
            i, j = left[i], right[j]
            once = ~resident[j] | (names[i] < names[j])  # residents meet twice, and themselves
            i, j = i[once], j[once]
            links += np.bincount(node[i], copies[j], len(ids)) + np.bincount(node[j], copies[i], len(ids))
            labels = common.merge_sets(labels, node[i], node[j])
        root, some = np.flatnonzero(labels != np.arange(len(ids))), np.flatnonzero(links)
        linked = np.arange(len(some) + len(root)) < len(some)
        return pa.table({
            "a": pa.array(np.concatenate([ids[some], ids[root]])), "b": pa.array(np.concatenate([ids[some], ids[labels[root]]]), mask=linked),
            "links": pa.array(np.concatenate([links[some], np.zeros(len(root))]).astype(np.int64)),
        })

    return run


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    common.small_batches(spark)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("vector"))
    clean = cut_lineage(rows.mapInArrow(_clean, "vec_id bigint, dim int, vector binary"))
    classes = clean.groupBy("dim", "vector").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    classes = cut_lineage(classes.select("vec_id", "dim", "vector", "copies"))

    sizes = classes.groupBy("dim").count()
    pivots: dict[int, np.ndarray] = {}
    for size in sizes.collect():  # one row per vector length
        wanted = int(min(MOST_PIVOTS, max(1, size["count"] // CELL_ROWS)))
        chosen = classes.where(F.col("dim") == size["dim"]).orderBy(F.xxhash64("vec_id", "vector"), "vector").limit(wanted).select("vector").collect()
        pivots[size["dim"]] = units(np.stack([np.frombuffer(bytes(r["vector"]), np.float32).astype(np.float64) for r in chosen]))
    housed = cut_lineage(classes.mapInArrow(_homes(pivots), "vec_id bigint, dim int, vector binary, copies bigint, home int, away double"))
    radii = {(r["dim"], r["home"]): r["far"] for r in housed.groupBy("dim", "home").agg(F.max("away").alias("far")).collect()}  # one row per pivot
    reach = float(np.sqrt(2 - 2 * least))
    spread = housed.mapInArrow(_copy_out(pivots, radii, reach), "vec_id bigint, dim int, vector binary, copies bigint, cell int, resident boolean")
    spread = cut_lineage(spread)
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK_ROWS), F.lit(1)).cast("int")
    crowds = spread.groupBy("dim", "cell").agg(blocks(F.count_if("resident")).alias("own"), blocks(F.count("*") / 4).alias("all"))
    placed = spread.withColumn("name", F.xxhash64("vec_id", "vector")).join(cut_lineage(crowds), ["dim", "cell"])
    number = lambda n: F.pmod(F.col("name"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ["vec_id", "dim", "vector", "copies", "cell", "resident", "name"]
    lefts = placed.where("resident").select(*kept, F.lit(True).alias("left"), number("own").alias("one"), every("all").alias("two"))
    rights = placed.select(*kept, F.lit(False).alias("left"), number("all").alias("two"), every("own").alias("one"))
    tasks = lefts.unionByName(rights)
    found = cut_lineage(tasks.groupBy("dim", "cell", "one", "two").applyInArrow(_join(least), "a bigint, b bigint, links bigint"))

    member = clean.join(classes.select(F.col("vec_id").alias("class_id"), "dim", "vector", "copies"), ["dim", "vector"]).select("vec_id", "class_id", "copies")
    counted = found.where("b is null").groupBy(F.col("a").alias("class_id")).agg(F.sum("links").alias("links"))
    same_id = clean.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id")
    twins = member.join(same_id, "vec_id", "left_semi")
    twins = twins.join(twins.groupBy("vec_id").agg(F.min("class_id").alias("a")), "vec_id").select("a", F.col("class_id").alias("b"))
    components = star_components(found.where("b is not null").select("a", "b").unionByName(twins))
    known = member.join(counted, "class_id", "left").join(components.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    known = known.groupBy("vec_id").agg(
        F.max(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"), F.min(F.coalesce("component", "class_id")).alias("_component")
    )
    result = rows.select("vec_id").join(known, "vec_id", "left")
    result = result.select("vec_id", F.coalesce("_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("_component", "vec_id").alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
