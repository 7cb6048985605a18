"""Substring de-duplication by Rabin-Karp hashes of every fixed-length word window.

Every window of ``width`` words gets a 64-bit rolling hash. A task resolves what repeats inside its
own block and sends the rest, packed, to hash ranges; there equal hashes are counted against the
smallest document that holds them. Windows that also start in a smaller document come back as word
positions, overlapping ones merge into maximal intervals, and the words inside them go.

A window's range is that of the smallest hash of its ``GRAM``-word strings, which most neighbouring
windows share: they travel together, and a document's windows reach a number of ranges that
depends on its length only. A hot window costs one entry per block, not one per row. A hot
``GRAM``-word string would draw the different windows of many documents into one range; so windows
are counted by it first, and those of strings with ``HOT_WINDOWS`` or more are dealt by their own
hash. Equal windows still meet. Ranges are sized by the text, so a range fits a task at any size.

Cases: null or empty texts have no words; texts shorter than a window keep all words; a null id is
smaller and larger than nothing, so such rows neither lose words nor make others lose any; rows that
repeat an id are copies of one document and do not remove each other's words; an empty table gives
an empty result. Different windows are taken as equal if their 64-bit hashes agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from projectpulse.llm import common

#: bytes of text whose windows share one hash range; words of the strings that choose it
RANGE_BYTES, GRAM = 12 << 20, 5
#: windows of one such string that are too many for its range (a quarter of it), and bits of the cells that count them
HOT_WINDOWS, CELL_BITS = RANGE_BYTES // 24, 20
PACKED = "bucket int, kind int, ids binary, keys binary, counts binary, positions binary, hashes binary"
HITS = "doc_id bigint, row_key bigint, positions binary"


def _ranges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Number of the range that a hash falls into."""
    return ((hashes >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int32)


def _runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First element and length of each run of equal row numbers."""
    first = common.first_of_runs(rows)
    return first, np.diff(np.append(first, len(rows)))


def _pack(bucket: int, kind: int, rows: np.ndarray, places: np.ndarray, hashes: np.ndarray | None, ids: np.ndarray, keys: np.ndarray) -> dict:
    first, counts = _runs(rows)
    owners = rows[first]
    return {
        "bucket": bucket, "kind": kind, "ids": ids[owners].tobytes(), "keys": keys[owners].tobytes(),
        "counts": counts.astype(np.uint32).tobytes(), "positions": common.planes(places),
        "hashes": b"" if hashes is None else hashes.tobytes(),
    }


def _minimisers(words: np.ndarray, width: int) -> np.ndarray:
    """Per window its smallest hash of ``GRAM`` words."""
    gram = min(GRAM, width)
    return common.mix(common.sliding_min(common.window_hashes(words, gram), width - gram + 1))


def _cells(minimisers: np.ndarray) -> np.ndarray:
    return (minimisers & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64)


def _count_windows(width: int, least: int):
    """(cell, windows of this task) of cells with ``least`` windows here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << CELL_BITS, np.int64)
        for _, data, offsets in common.blocks(batches):
            starts, ends, texts = common.word_spans(data, offsets)
            found = _minimisers(common.span_hashes(data, starts, ends), width)
            whole = texts[: len(found)] == texts[width - 1 :][: len(found)]
            count += np.bincount(_cells(found[whole]), minlength=len(count))
        cell = np.flatnonzero(count >= least)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(count[cell])], names=["cell", "n"])

    return run


def _hot_cells(keyed: DataFrame, width: int) -> np.ndarray:
    """All cells with ``HOT_WINDOWS`` windows; what tasks do not report adds up to less than half of it."""
    tasks = keyed.rdd.getNumPartitions()
    counted = keyed.mapInArrow(_count_windows(width, max(1, HOT_WINDOWS // (2 * max(tasks, 1)))), "cell bigint, n bigint")
    hot = counted.groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_WINDOWS // 2)
    return np.array([r["cell"] for r in hot.collect()], np.int64)  # at most two per HOT_WINDOWS windows, 2**CELL_BITS at all


def _hash_windows(width: int, buckets: int, hot: np.ndarray = np.zeros(0, np.int64)):
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *[(n, pa.binary()) for n in ("ids", "keys", "counts", "positions", "hashes")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_hot = np.zeros(1 << CELL_BITS, bool)
        is_hot[hot] = True
        for rows, data, offsets in common.blocks(batches):
            ids, keys = rows["doc_id"].to_numpy(zero_copy_only=False), rows["row_key"].to_numpy()
            named = ~np.asarray(rows["doc_id"].is_null())
            ids = np.where(named, ids, 0).astype(np.int64)
            starts, ends, texts = common.word_spans(data, offsets)
            words = common.span_hashes(data, starts, ends)
            hashes = common.window_hashes(words, width)
            shared = _minimisers(words, width)
            ranged = np.where(is_hot[_cells(shared)], _ranges(hashes, buckets), _ranges(shared, buckets))
            owner = texts[: len(hashes)]
            whole = (owner == texts[width - 1 :][: len(hashes)]) & named[owner]
            first_word = np.searchsorted(texts, np.arange(len(ids)))
            places = np.flatnonzero(whole)
            hashes, owner, ranged = hashes[places], owner[places], ranged[places]
            places = places - first_word[owner]
            # smallest id of each hash in this block; everything above it is decided here
            order = np.argsort(hashes, kind="stable")
            heads = common.first_of_runs(hashes[order])
            if len(heads):
                least = np.minimum.reduceat(ids[owner[order]], heads)
                above = np.empty(len(order), bool)
                above[order] = ids[owner[order]] > np.repeat(least, np.diff(np.append(heads, len(order))))
            else:
                above = np.zeros(0, bool)
            out = []
            if above.any():
                out.append(_pack(int(keys[owner[above][0]] % buckets), 1, owner[above], places[above], None, ids, keys))
            rest = np.flatnonzero(~above)
            by_range = rest[np.argsort(ranged[rest], kind="stable")]
            heads = common.first_of_runs(ranged[by_range])
            for part in np.split(by_range, heads[1:]):
                if len(part):
                    out.append(_pack(int(ranged[part[0]]), 0, owner[part], places[part], hashes[part], ids, keys))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _unpack(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for row in table.to_batches():
        for i in range(row.num_rows):
            ids, keys, counts, places, hashes = (row[n][i].as_buffer() for n in ("ids", "keys", "counts", "positions", "hashes"))
            yield (np.frombuffer(ids, np.int64), np.frombuffer(keys, np.int64), np.frombuffer(counts, np.uint32), common.from_planes(places), np.frombuffer(hashes, np.uint64))


def _repeated(table: pa.Table) -> pa.Table:
    """Positions whose hash also occurs under a smaller id, one row per document."""
    kinds = table["kind"].to_numpy()
    parts = list(_unpack(table))
    out = {"doc_id": [], "row_key": [], "positions": []}

    def emit(ids: np.ndarray, keys: np.ndarray, counts: np.ndarray, places: np.ndarray, keep: np.ndarray) -> None:
        rows = np.repeat(np.arange(len(ids)), counts)[keep]
        first, sizes = _runs(rows)
        held = places[keep]
        for row, start, size in zip(rows[first], first, sizes, strict=True):
            out["doc_id"].append(int(ids[row]))
            out["row_key"].append(int(keys[row]))
            out["positions"].append(common.planes(held[start : start + size]))

    open_parts = [p for p, kind in zip(parts, kinds, strict=True) if kind == 0]
    for p, kind in zip(parts, kinds, strict=True):
        if kind == 1:
            emit(*p[:4], np.ones(len(p[3]), bool))
    if open_parts:
        hashes = np.concatenate([p[4] for p in open_parts])
        ids = np.concatenate([np.repeat(p[0], p[2]) for p in open_parts])
        order = np.argsort(hashes, kind="stable")
        heads = common.first_of_runs(hashes[order])
        least = np.minimum.reduceat(ids[order], heads)
        above = np.empty(len(order), bool)
        above[order] = ids[order] > np.repeat(least, np.diff(np.append(heads, len(order))))
        at = 0
        for p in open_parts:
            keep = above[at : at + len(p[3])]
            at += len(p[3])
            if keep.any():
                emit(*p[:4], keep)
    return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "row_key": pa.array(out["row_key"], pa.int64()), "positions": pa.array(out["positions"], pa.binary())})


def _keep_words(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_of, removed_of, kept = [], [], []
            for text, hits in zip(batch["text"].to_pylist(), batch["hits"].to_pylist(), strict=True):
                words = (text or "").encode().split()
                words_of.append(len(words))
                if hits:
                    change = np.zeros(len(words) + width + 1, np.int32)
                    for packed in hits:
                        places = common.from_planes(packed)
                        np.add.at(change, places, 1)
                        np.add.at(change, places + np.uint32(width), -1)
                    stays = np.cumsum(change)[: len(words)] == 0
                    words = [words[i] for i in np.flatnonzero(stays)]
                removed_of.append(words_of[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(words_of, pa.int64()), pa.array(removed_of, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )

    return run


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (kept words joined by a space)."""
    common.small_batches(docs.sparkSession)
    keyed = common.with_row_key(docs, id_col, text_col)
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // RANGE_BYTES))
    packed = keyed.mapInArrow(_hash_windows(width, buckets, _hot_cells(keyed, width)), PACKED)
    hits = packed.groupBy("bucket").applyInArrow(_repeated, HITS)
    per_row = hits.groupBy(F.col("row_key").alias("_key"), F.col("doc_id").alias("_id")).agg(F.collect_list("positions").alias("hits"))
    joined = keyed.join(per_row, (F.col("row_key") == F.col("_key")) & (F.col("doc_id") == F.col("_id")), "left")
    return joined.select("doc_id", "text", "hits").mapInArrow(_keep_words(width), "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")
