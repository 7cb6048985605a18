"""Line de-duplication with two Bloom filters.

Tasks send the distinct key hashes of their lines to slices of the hash space. Each slice fills
two Bloom filters: a hash found in the once-seen filter enters the twice-seen one. The twice-seen
filters have a fixed total size (``filter_bits``), whatever the data, and go to all tasks. Only
lines that hit them are shuffled, with their text, for exact confirmation: in how many documents a
key occurs and which is the largest of them. A filter that fills up sends more suspects, it never
changes the result.

A line's key is the line without white space at both ends, A-Z in lower case. Keys of at least
``min_length`` code points that occur in at least ``min_docs`` documents lose all their lines but
those of the largest document.

Cases: null and empty texts are one empty line; rows with a null id count as no document and keep
all lines; rows that repeat an id are one document; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from projectpulse.llm import common
from projectpulse.skew import cut_lineage

FILTER_BITS, SLICES, PROBES = 1 << 26, 64, 4


def line_key(line: bytes) -> bytes:
    return line.strip().lower()  # both only touch ASCII in bytes


def _keys(text: str | None, min_length: int) -> list[tuple[int, bytes]]:
    """(line number, key) of the lines whose keys are long enough."""
    found = []
    for number, line in enumerate((text or "").encode().split(b"\n")):
        key = line_key(line)
        if len(key) >= min_length and (len(key) >= 4 * min_length or len(key.decode()) >= min_length):
            found.append((number, key))
    return found


def _hashes(keys: list[bytes]) -> np.ndarray:
    sizes = np.array([len(k) for k in keys], np.int64)
    ends = np.cumsum(sizes)
    out = np.empty(len(keys), np.uint64)
    low = 0
    while low < len(keys):  # in runs of bounded bytes
        base = ends[low] - sizes[low]
        high = max(low + 1, int(np.searchsorted(ends, base + common.BLOCK_BYTES, side="right")))
        data = np.frombuffer(b"".join(keys[low:high]), np.uint8)
        out[low:high] = common.span_hashes(data, ends[low:high] - sizes[low:high] - base, ends[low:high] - base)
        low = high
    return out


def _slices(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(58)).astype(np.int32)  # 64 slices


def _probe_bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit numbers, one row per probe."""
    step = (hashes >> np.uint64(29)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * step) % np.uint64(bits) for i in range(PROBES)])


def _seen_hashes(min_length: int):
    """Rows (slice, hashes seen once in this batch, hashes seen in two documents of it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owners = [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if doc_id is not None:
                    own = {key for _, key in _keys(text, min_length)}
                    keys.extend(own)
                    owners.extend([doc_id] * len(own))
            if not keys:
                continue
            hashes, owners = _hashes(keys), np.array(owners, np.int64)
            order = np.argsort(hashes, kind="stable")
            hashes, owners = hashes[order], owners[order]
            heads = common.first_of_runs(hashes)
            twice = np.minimum.reduceat(owners, heads) != np.maximum.reduceat(owners, heads)
            hashes = hashes[heads]
            borders = np.searchsorted(_slices(hashes), np.arange(SLICES + 1))
            rows = [
                {"slice": s, "once": hashes[a:b][~twice[a:b]].tobytes(), "twice": hashes[a:b][twice[a:b]].tobytes()}
                for s, (a, b) in enumerate(zip(borders[:-1], borders[1:], strict=True)) if b > a
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("slice", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]))
        common.give_back()

    return run


def _fill(bits: int):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits, bool), np.zeros(bits, bool)
        number = int(key[0].as_py())
        for batch in batches:
            for first, second in zip(batch["once"], batch["twice"], strict=True):
                single = np.frombuffer(first.as_buffer(), np.uint64)
                again = np.frombuffer(second.as_buffer(), np.uint64)
                probes = _probe_bits(single, bits)
                known = once[probes].all(axis=0)
                twice[probes[:, known]] = True
                once[probes] = True
                probes = _probe_bits(again, bits)
                once[probes] = True
                twice[probes] = True
        packed = zlib.compress(np.packbits(twice).tobytes(), 1)
        yield pa.RecordBatch.from_pydict({"slice": pa.array([number], pa.int32()), "filter": pa.array([packed], pa.binary())})

    return run


def _suspects(min_length: int, filters, bits: int):
    """Lines whose key hash is in the twice-seen filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = -(-bits // 8)
        packed = np.zeros(SLICES * wide, np.uint8)
        for s, f in filters.value.items():
            packed[s * wide : (s + 1) * wide] = np.frombuffer(zlib.decompress(f), np.uint8)
        for batch in batches:
            rows, numbers, keys = [], [], []
            for row, (doc_id, text) in enumerate(zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True)):
                if doc_id is not None:
                    own = _keys(text, min_length)
                    rows.extend([row] * len(own))
                    numbers.extend(n for n, _ in own)
                    keys.extend(k for _, k in own)
            if not keys:
                continue
            hashes = _hashes(keys)
            probes = _probe_bits(hashes, bits)
            octet = packed[(probes >> np.uint64(3)) + _slices(hashes).astype(np.uint64) * np.uint64(wide)]
            hit = (octet >> (np.uint8(7) - (probes & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)
            chosen = np.flatnonzero(hit)
            at = pa.array(np.array(rows, np.int64)[chosen])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(at), batch["row_key"].take(at), pa.array(np.array(numbers, np.int32)[chosen]), pa.array([keys[i] for i in chosen], pa.binary()).cast(pa.string())],
                names=["doc_id", "row_key", "line_no", "line_key"],
            )
        common.give_back()

    return run


def _drop_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, dropped, kept = [], [], []
        for text, gone in zip(batch["text"].to_pylist(), batch["gone"].to_pylist(), strict=True):
            lines = (text or "").split("\n")
            counts.append(len(lines))
            if gone:
                away = set(gone)
                lines = [line for number, line in enumerate(lines) if number not in away]
            dropped.append(counts[-1] - len(lines))
            kept.append("\n".join(lines))
        carried = ["carried"] if "carried" in batch.schema.names else []
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["row_key"], pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string()), *[batch[c] for c in carried]],
            names=["doc_id", "row_key", "n_lines", "n_dropped", "kept_text", *carried],
        )


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 40, min_docs: int = 5, filter_bits: int = FILTER_BITS, carry: Sequence[str] = ()
) -> DataFrame:
    """One row per document: doc_id, row_key, n_lines (before), n_dropped, kept_text, and a struct ``carried`` of the columns in ``carry``."""
    spark = docs.sparkSession
    common.small_batches(spark)
    keyed = common.with_row_key(docs, id_col, text_col, carry)
    bits = max(8, filter_bits // SLICES)
    seen = keyed.select("doc_id", "text").mapInArrow(_seen_hashes(min_length), "slice int, once binary, twice binary")
    slices = seen.groupBy("slice").applyInArrow(_fill(bits), "slice int, filter binary").collect()  # filter_bits in all
    filters = spark.sparkContext.broadcast({r["slice"]: bytes(r["filter"]) for r in slices})
    suspects = cut_lineage(keyed.select("doc_id", "text", "row_key").mapInArrow(_suspects(min_length, filters, bits), "doc_id bigint, row_key bigint, line_no int, line_key string"))
    held = suspects.select("line_key", "doc_id").distinct()  # dealt by both, so that a hot line is counted by many tasks
    counted = held.groupBy("line_key").agg(F.count("*").alias("_docs"), F.max("doc_id").alias("_last"))
    counted = cut_lineage(counted.where(F.col("_docs") >= min_docs).select(F.col("line_key").alias("_line"), "_last"))
    gone = suspects.join(counted, F.col("line_key") == F.col("_line")).where("doc_id != _last")
    gone = gone.groupBy(F.col("row_key").alias("_key"), F.col("doc_id").alias("_id")).agg(F.collect_set("line_no").alias("gone"))
    joined = keyed.join(gone, (F.col("row_key") == F.col("_key")) & (F.col("doc_id") == F.col("_id")), "left")
    ddl = "doc_id bigint, row_key bigint, n_lines bigint, n_dropped bigint, kept_text string"
    carried = ["carried"] if carry else []
    if carry:
        ddl += f", carried {keyed.schema['carried'].dataType.simpleString()}"
    return joined.select("doc_id", "row_key", "text", "gone", *carried).mapInArrow(_drop_lines, ddl)
