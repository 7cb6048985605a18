"""Shared pieces of the corpus operators: batches of text as byte arrays, word hashes, row keys.

Rows are identified inside an operator by ``row_key`` (a hash of id and text) together with the
id, so repeated ids with different texts stay apart and null ids need no special case. Operators
pick the columns they are told to and ignore all others, whatever their names.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows and bytes of a batch that a Python worker is handed at once
BATCH_ROWS, BATCH_BYTES = 2000, "8MB"
#: bytes of text that are turned into arrays at once; a longer text is a block of its own
BLOCK_BYTES = 2 << 20

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: one random value per byte, so that words of equal letter sums differ
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds, however long single texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def with_row_key(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, text, row_key) and, if columns are to be carried along, a struct ``carried`` of them."""
    carried = [F.struct(*carry).alias("carried")] if carry else []
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *carried)
    return picked.withColumn("row_key", F.xxhash64("doc_id", "text"))


def mix(values: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0x7FB5D329728EA185)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x81DADEF4BC2DD44D)
    return values ^ (values >> np.uint64(33))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """MULTIPLIER ** 0..n-1 modulo 2**64 (or those of its inverse)."""
    name = "down" if inverse else "up"
    if len(_powers.get(name, ())) < n:
        base = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64)) if inverse else MULTIPLIER
        steps = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array and their borders; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return freed memory at the end of a task: workers live on, and the next task may run in another one."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes: (rows, bytes, borders)."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        low, rows = 0, len(offsets) - 1
        while low < rows:
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
            high = min(high, rows)
            yield batch.slice(low, high - low), data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            low = high
    give_back()


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and text number of every run of non-space bytes; runs end with their text."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    solid = ~SPACE[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    start, stop = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | border[1:-1]
    stop[:-1] &= ~solid[1:] | border[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for every span, from running polynomial sums."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(len(data)), out=sums[1:])
    plain = (sums[ends] - sums[starts]) * powers(len(data) + 1, inverse=True)[starts]
    return mix(plain + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every ``width`` consecutive word hashes (len - width + 1 values)."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(len(words)), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(len(words), inverse=True)[: len(words) - width + 1])


def sliding_min(values: np.ndarray, span: int) -> np.ndarray:
    """Smallest of values[i : i + span] for every whole window."""
    count = len(values) - span + 1
    if count <= 0:
        return np.zeros(0, values.dtype)
    padded = np.full(-(-len(values) // span) * span, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    rows = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[span - 1 : span - 1 + count])


def first_of_runs(values: np.ndarray) -> np.ndarray:
    """Positions at which a sorted array starts a new value."""
    if not len(values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))


def planes(values: np.ndarray) -> bytes:
    """Differences of 32-bit numbers, their four bytes apart: small steps compress to almost nothing."""
    steps = np.diff(values.astype(np.uint32), prepend=np.uint32(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(packed: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
    return np.cumsum(steps, dtype=np.uint32)


def merge_sets(labels: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Join the sets of x and y; labels[i] is the smallest member of i's set."""
    while True:
        a, b = labels[x], labels[y]
        apart = a != b
        if not apart.any():
            return labels
        x, y = x[apart], y[apart]
        np.minimum.at(labels, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            deeper = labels[labels]
            if np.array_equal(deeper, labels):
                break
            labels = deeper
