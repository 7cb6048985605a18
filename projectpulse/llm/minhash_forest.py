"""Near-duplicate documents by MinHash and an LSH forest, confirmed on whole shingle sets.

Every document gets ``TREES`` labels of ``DEPTH`` minimum hashes. Each tree is one sorted order of
all labels: documents that share the first two hashes form a region, and inside it the order goes
on by the deeper hashes, so the neighbours of a document are those with the longest common prefix.
Crowded regions are thus compared at a greater depth than sparse ones. Every document proposes its
best neighbour per tree, judged by one bit of each hash; proposals are confirmed by the exact
overlap of the sets. All neighbours that look alike also form clusters, wider than the components.
Where a cluster still has several components, all its pairs between two of them that look alike are
compared, in cells of two blocks of documents, so that no pair is left to the choice of neighbours.

A pair at the threshold shares a region in at least one tree but for about 1 in 10**7 cases, and
its bits agree at the level asked for but for about 1 in 10**5.

Documents with the same set are one class and enter with their smallest id. Sorted orders are
range-partitioned by region, label and id, so a hot region spreads over tasks; neighbours across
borders meet in a small extra step.

Cases: null and blank texts have no shingles and no links; fewer words than a shingle make one
shingle of the whole sequence; null ids link with nothing, have a null component and are kept; rows
that repeat an id are one node; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from projectpulse.components import star_components
from projectpulse.llm import common
from projectpulse.skew import cut_lineage

TREES, DEPTH = 20, 6
#: neighbours looked at; least estimated similarity of a proposal; documents per block of a crowded cluster
NEAR, LEAST, BLOCK_DOCS = 32, 0.5, 512
_RANDOM = np.random.default_rng(7)
FACTORS = _RANDOM.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TREE_SALT = _RANDOM.integers(1, 2**63, TREES, dtype=np.uint64)
ENTRY = [("region", pa.int64()), ("label1", pa.int64()), ("label2", pa.int64()), ("bits1", pa.int64()), ("bits2", pa.int64()), ("n", pa.int32()), ("doc_id", pa.int64())]
ENTRY_DDL = "region bigint, label1 bigint, label2 bigint, bits1 bigint, bits2 bigint, n int, doc_id bigint"
CROWD_DDL = "doc_id bigint, cluster bigint, component bigint, blocks int, shingles binary, n int, bits1 bigint, bits2 bigint"
#: documents (once per block they meet) of a task that settles clusters
TASK_DOCS = 4096
ORDER = ["region", "label1", "label2", "doc_id"]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text of a block."""
    data = common.LOWER[data]
    starts, ends, texts = common.word_spans(data, offsets)
    words = common.span_hashes(data, starts, ends)
    windows = common.window_hashes(words, width)
    first = np.searchsorted(texts, np.arange(len(offsets)))
    for low, high in zip(first[:-1], first[1:], strict=True):
        if high - low >= width:
            yield np.unique(windows[low : high - width + 1])
        elif high > low:
            yield common.window_hashes(words[low:high], int(high - low)) ^ np.uint64(high - low)
        else:
            yield np.zeros(0, np.uint64)


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.blocks(batches):
            sets = list(shingle_sets(data, offsets, width))
            sizes = np.array([len(s) for s in sets], np.int64)
            every = np.concatenate(sets)
            filled = sizes > 0
            heads = (np.cumsum(sizes) - sizes)[filled]
            least = np.zeros((len(sets), TREES * DEPTH), np.uint32)
            sums, xors = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            if len(every):
                for k, factor in enumerate(FACTORS):
                    least[filled, k] = np.minimum.reduceat(every * factor >> np.uint64(32), heads)
                sums[filled] = np.add.reduceat(every, heads)
                xors[filled] = np.bitwise_xor.reduceat(common.mix(every), heads)
            yield pa.RecordBatch.from_arrays(
                [rows["doc_id"], pa.array(sizes.astype(np.int32)), pa.array(sums.view(np.int64)), pa.array(xors.view(np.int64)), pa.array([r.tobytes() for r in least], pa.binary())],
                names=["doc_id", "n", "mark1", "mark2", "signature"],
            )

    return run


def _signatures(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch["signature"].to_pylist()), np.uint32).reshape(-1, TREES, DEPTH)


def _bits(least: np.ndarray) -> np.ndarray:
    """The last bit of every hash, as two numbers per document."""
    bits = np.zeros((len(least), 128), np.uint8)
    bits[:, : TREES * DEPTH] = least.reshape(len(least), -1) & 1
    return np.packbits(bits, axis=1).view(np.int64)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry per document and tree."""
    for batch in batches:
        if not batch.num_rows:
            continue
        least = _signatures(batch)
        wide = least.astype(np.uint64)
        region = common.mix((wide[:, :, 0] << np.uint64(32) | wide[:, :, 1]) ^ TREE_SALT)
        label = [(wide[:, :, i] << np.uint64(32) | wide[:, :, i + 1]).view(np.int64) for i in (2, 4)]
        packed = _bits(least)
        each = lambda values: np.repeat(values, TREES)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (region.view(np.int64).ravel(), label[0].ravel(), label[1].ravel(), each(packed[:, 0]), each(packed[:, 1]), each(batch["n"].to_numpy()), each(batch["doc_id"].to_numpy()))],
            names=[name for name, _ in ENTRY],
        )


def _estimate(bits1: np.ndarray, bits2: np.ndarray) -> np.ndarray:
    """Similarity from differing bits: half of the hashes that differ agree in a bit by chance."""
    odd = sum(np.bitwise_count(bits.view(np.uint64)).astype(np.int32) for bits in (bits1, bits2))
    return 1.0 - 2.0 * odd / (TREES * DEPTH)


def _size_fits(n1: np.ndarray, n2: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)


def _pairs(entries: dict[str, np.ndarray], fresh: int, percent: int) -> dict[str, np.ndarray]:
    """Every entry from ``fresh`` on with its best earlier neighbour, and (alike null) a forest of all that look alike."""
    size = len(entries["region"])
    best, partner = np.full(size, -1.0), np.zeros(size, np.int64)
    near: list[tuple[np.ndarray, np.ndarray]] = []
    for lag in range(1, min(NEAR, size - 1) + 1):
        late = np.flatnonzero(entries["region"][lag:] == entries["region"][:-lag]) + lag
        if not len(late):
            break
        late = late[late >= fresh]
        n = entries["n"].astype(np.int64)
        late = late[_size_fits(n[late], n[late - lag], percent) & (entries["doc_id"][late] != entries["doc_id"][late - lag])]
        alike = _estimate(*(entries[b][late] ^ entries[b][late - lag] for b in ("bits1", "bits2")))
        late, alike = late[alike >= LEAST], alike[alike >= LEAST]
        near.append((late, late - lag))
        better = alike > best[late]
        best[late[better]], partner[late[better]] = alike[better], (late - lag)[better]
    labels = np.arange(size)
    if near:
        labels = common.merge_sets(labels, *(np.concatenate(side) for side in zip(*near, strict=True)))
    late, tied = np.flatnonzero(best >= LEAST), np.flatnonzero(labels != np.arange(size))
    x, y = entries["doc_id"][np.concatenate([late, tied])], entries["doc_id"][np.concatenate([partner[late], labels[tied]])]
    return {"a": np.minimum(x, y), "b": np.maximum(x, y), "alike": np.concatenate([best[late], np.full(len(tied), np.nan)])}


def _scan(percent: int):
    """Pairs inside a sorted partition, and the entries next to its borders under the border's number."""
    names = [name for name, _ in ENTRY]
    schema = pa.schema([("border", pa.int32()), ("late", pa.bool_()), ("a", pa.int64()), ("b", pa.int64()), ("alike", pa.float64()), *ENTRY])

    def whole(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, head = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = {n: batch[n].to_numpy() for n in names}
            entries = new if held is None else {n: np.concatenate([held[n], new[n]]) for n in names}
            fresh = 0 if held is None else len(held["region"])
            pairs = _pairs(entries, fresh, percent)
            if len(pairs["a"]):
                yield whole(pairs)
            head = entries if head is None else head if len(head["region"]) >= NEAR else {n: np.concatenate([head[n], new[n]]) for n in names}
            head = {n: head[n][:NEAR] for n in names}
            held = {n: entries[n][-NEAR:] for n in names}
        if held is not None:
            for rows, border, late in ((head, part, True), (held, part + 1, False)):
                size = len(rows["region"])
                yield whole(rows | {"border": np.full(size, border, np.int32), "late": np.full(size, late)})

    return run


def _border_pairs(percent: int):
    def run(table: pa.Table) -> pa.Table:
        names = [n for n in table.column_names if n not in ("border", "late", "a", "b", "alike")]
        late = table["late"].to_numpy()
        columns = {n: table[n].to_numpy() for n in names}
        sides = []
        for side in (False, True):
            chosen = {n: v[late == side] for n, v in columns.items()}
            order = np.lexsort([chosen[n] for n in reversed(ORDER)])
            sides.append({n: v[order] for n, v in chosen.items()})
        entries = {n: np.concatenate([s[n] for s in sides]) for n in names}
        return pa.table(_pairs(entries, len(sides[0]["region"]), percent))

    return run


def _propose(entries: DataFrame, percent: int) -> DataFrame:
    """Table of pairs a < b with their estimated similarity, or without one where they only tie a cluster."""
    ordered = entries.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    ddl = f"border int, late boolean, a bigint, b bigint, alike double, {ENTRY_DDL}"
    scanned = cut_lineage(ordered.mapInArrow(_scan(percent), ddl))
    inside = scanned.where("border is null").select("a", "b", "alike")
    borders = scanned.where("border is not null").groupBy("border").applyInArrow(_border_pairs(percent), "a bigint, b bigint, alike double")
    every = inside.unionByName(borders).withColumn("alike", F.nanvl("alike", F.lit(None)))
    return cut_lineage(every.where("a != b").groupBy("a", "b").agg(F.max("alike").alias("alike")))


def _make_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.blocks(batches):
            sets = [s.tobytes() for s in shingle_sets(data, offsets, width)]
            yield pa.RecordBatch.from_arrays([rows["doc_id"], pa.array(sets, pa.binary())], names=["doc_id", "shingles"])

    return run


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.sort(np.concatenate([x, y]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared > 0 and 100 * shared >= percent * (len(both) - shared)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch["set_a"], batch["set_b"], strict=True)
            good = pa.array([_similar(*(np.frombuffer(s.as_buffer(), np.uint64) for s in pair), percent) for pair in sides], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(good), batch["b"].filter(good)], names=["a", "b"])

    return run


def _settle_cells(percent: int):
    """Links between components among the pairs of two blocks of a cluster, most alike first."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(n, "ascending") for n in ("cluster", "one", "two", "doc_id")])
        columns = {n: table[n].to_numpy() for n in ("cluster", "one", "two", "block", "doc_id", "component", "n", "bits1", "bits2")}
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table["shingles"]]
        cell = np.stack([columns[n] for n in ("cluster", "one", "two")])
        heads = np.flatnonzero(np.concatenate(([True], (cell[:, 1:] != cell[:, :-1]).any(axis=0)))) if table.num_rows else []
        links = []
        for low, high in zip(heads, [*heads[1:], table.num_rows], strict=True):
            own = {n: v[low:high] for n, v in columns.items()}
            first, second = own["one"][0], own["two"][0]
            left, right = np.flatnonzero(own["block"] == first), np.flatnonzero(own["block"] == second)
            root = {c: c for c in set(own["component"].tolist())}

            def find(node: int, root: dict[int, int] = root) -> int:
                while root[node] != node:
                    root[node] = root[root[node]]
                    node = root[node]
                return node

            n = own["n"].astype(np.int64)
            wanted = own["component"][left][:, None] != own["component"][right][None, :]
            wanted &= _size_fits(n[left][:, None], n[right][None, :], percent)
            if first == second:
                wanted &= left[:, None] < right[None, :]
            i, j = np.nonzero(wanted)
            i, j = left[i], right[j]
            alike = _estimate(own["bits1"][i] ^ own["bits1"][j], own["bits2"][i] ^ own["bits2"][j])
            some = np.flatnonzero(alike >= LEAST)
            for at in some[np.argsort(-alike[some], kind="stable")]:
                x, y = find(int(own["component"][i[at]])), find(int(own["component"][j[at]]))
                if x != y and _similar(sets[low + i[at]], sets[low + j[at]], percent):
                    root[max(x, y)] = min(x, y)
                    links.append((int(own["doc_id"][i[at]]), int(own["doc_id"][j[at]])))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def _with_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the signature by its bits."""
    for batch in batches:
        if batch.num_rows:
            bits = _bits(_signatures(batch))
            kept = [batch[n] for n in ("doc_id", "cluster", "component", "blocks", "shingles", "n")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bits[:, 0]), pa.array(bits[:, 1])], names=["doc_id", "cluster", "component", "blocks", "shingles", "n", "bits1", "bits2"])


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough, as a table."""
    first = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    second = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    both = pairs.select("a", "b").join(first, "a").join(second, "b")
    return cut_lineage(both.select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a bigint, b bigint"))


def _between(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """Pairs that join two components."""
    side = lambda c: components.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    known = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return known.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """One row per document: doc_id, row_key, n_shingles, component_id, kept."""
    common.small_batches(docs.sparkSession)
    keyed = common.with_row_key(docs, id_col, text_col)
    signed = keyed.mapInArrow(_sign(width), "doc_id bigint, n int, mark1 bigint, mark2 bigint, signature binary")
    signed = cut_lineage(signed)
    nodes = signed.where("doc_id is not null and n > 0")
    marks = ["n", "mark1", "mark2"]
    classes = cut_lineage(nodes.groupBy(*marks).agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature")))
    member = nodes.select("doc_id", *marks).join(classes.select(*marks, F.col("doc_id").alias("class_id")), marks)
    member = cut_lineage(member.select("doc_id", "class_id").distinct())
    in_order = Window.partitionBy("doc_id").orderBy("class_id")  # one id with several texts
    own = member.select(F.lag("class_id").over(in_order).alias("a"), F.col("class_id").alias("b")).where("a is not null")

    entries = classes.select("doc_id", "n", "signature").mapInArrow(_entries, ENTRY_DDL)
    found = _propose(entries, percent)
    proposed = found.where("alike is not null")
    taken = cut_lineage(found.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = keyed.join(taken, "doc_id", "left_semi").select("doc_id", "text")
    sets = cut_lineage(texts.mapInArrow(_make_sets(width), "doc_id bigint, shingles binary").where("octet_length(shingles) > 0"))

    # each end's best proposal first: most copies are joined by these
    each = proposed.select(F.explode(F.array("a", "b")).alias("doc_id"), F.struct("alike", (-F.col("a")).alias("x"), (-F.col("b")).alias("y")).alias("p"))
    best = each.groupBy("doc_id").agg(F.max("p").alias("p")).select((-F.col("p.x")).alias("a"), (-F.col("p.y")).alias("b")).distinct()
    tried = cut_lineage(best)
    links = _verify(tried, sets, percent).unionByName(own)
    components = star_components(links, rounds=2)  # these two only spare comparisons inside a component
    open_pairs = _between(proposed, components).join(tried, ["a", "b"], "left_anti")
    links = links.unionByName(_verify(open_pairs, sets, percent))
    components = star_components(links, rounds=2)

    # clusters of several components: all pairs between them, block by block
    clusters = star_components(found.select("a", "b")).withColumnRenamed("component", "cluster")
    placed = clusters.join(components, "node", "left").select(F.col("node").alias("doc_id"), "cluster", F.coalesce("component", "node").alias("component"))
    placed = cut_lineage(placed)
    mixed = placed.groupBy("cluster").agg(F.count("*").alias("_n"), F.min("component").alias("_low"), F.max("component").alias("_high"))
    mixed = cut_lineage(mixed.where("_low != _high").select("cluster", F.ceil(F.col("_n") / BLOCK_DOCS).cast("int").alias("blocks")))
    crowd = placed.join(mixed, "cluster").join(sets, "doc_id").join(classes.select("doc_id", "n", "signature"), "doc_id")
    crowd = crowd.mapInArrow(_with_bits, CROWD_DDL)
    cells = crowd.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    cells = cells.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.withColumn("one", F.least("block", "_o")).withColumn("two", F.greatest("block", "_o")).drop("_o", "blocks")
    tasks = max(8, -(-(placed.join(mixed, "cluster").agg(F.sum("blocks")).first()[0] or 0) // TASK_DOCS))
    cells = cells.groupBy(F.pmod(F.xxhash64("cluster", "one", "two"), F.lit(tasks)).alias("task"))
    links = links.unionByName(cut_lineage(cells.applyInArrow(_settle_cells(percent), "a bigint, b bigint")))
    components = star_components(links)

    roots = member.join(components.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    roots = roots.groupBy("doc_id").agg(F.min(F.coalesce("component", "class_id")).alias("_root"))
    result = signed.select("doc_id", F.col("n").cast("bigint").alias("n_shingles")).join(roots, "doc_id", "left")
    result = result.withColumn("component_id", F.coalesce("_root", "doc_id"))
    return result.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
