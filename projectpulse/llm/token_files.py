"""Token ids as wavelet-matrix shards.

Texts are sorted by id over range partitions, tokenized there, and cut into shards of bounded size.
A shard is a wavelet matrix: one bit-plane per bit of the ids, each with the number of its zeros
and rank sums per block, so that single tokens can be read, counted and located without unpacking
the rest. Shards are rows of a Parquet table, one file per partition, written and read by Spark
alone; the planes compress with the file. Documents never span shards unless they are longer than
one, in which case the shard grows with them.

Distinct chunks of a block of texts, told apart by 64-bit hashes, are tokenized once and remembered
in a bounded table per worker: the pre-tokenizer always ends a token before a space that stands
between two other characters, and between a letter and a mark.

Cases: a null or empty text has the end id only; null ids come first; equal ids are ordered by a
hash of the row; an empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from projectpulse.llm import common

SHARD_TOKENS, BLOCK_BITS, TABLE_CHUNKS, ENCODE_BYTES = 4 << 20, 4096, 800_000, 4 << 20
SHARD = "part int, seq int, n_tokens bigint, n_docs bigint, doc_ids binary, has_id binary, lengths binary, zeros array<bigint>, planes array<binary>, ranks array<binary>"
#: how the vocabulary writes a space; words segmented in one call
SPACE_MARK, RUN_WORDS = "\u0120", 1024
#: white space of one byte, and first bytes of white space of three
BLANK, WIDE_BLANK = np.zeros(256, bool), np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F, 0x20]] = True
WIDE_BLANK[[0xE1, 0xE2, 0xE3]] = True
#: a mark ends the run of letters before it
LETTERS, MARKS = np.zeros(256, bool), np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123)]] = True
MARKS[[ord(c) for c in ".,;:!?"]] = True


class WaveletMatrix:
    """Bit-planes, most significant first; each orders the ids by the bits above it."""

    def __init__(self, size: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]) -> None:
        self.size, self.zeros, self.planes = size, zeros, [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, np.uint32) for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        zeros, planes, ranks = [], [], []
        row = ids.astype(np.uint16) if not len(ids) or int(ids.max()) < 1 << 16 else ids.astype(np.uint32)
        for bit in reversed(range(int(row.max(initial=0)).bit_length())):
            ones = (row & row.dtype.type(1 << bit)) != 0
            packed = np.packbits(ones)
            counts = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), BLOCK_BITS // 8), dtype=np.uint32)
            ranks.append((np.cumsum(counts, dtype=np.uint32) - counts).tobytes())
            planes.append(packed.tobytes())
            rest = row.compress(~ones)
            zeros.append(len(rest))
            row = np.concatenate([rest, row.compress(ones)])
        return cls(len(ids), zeros, planes, ranks)

    def rank1(self, level: int, at: int) -> int:
        """Ones before position ``at``."""
        block = min(at // BLOCK_BITS, max(len(self.ranks[level]) - 1, 0))
        low = block * BLOCK_BITS
        bits = np.unpackbits(self.planes[level][low // 8 : -(-at // 8)])[: at - low]
        return (int(self.ranks[level][block]) if len(self.ranks[level]) else 0) + int(bits.sum())

    def access(self, at: int) -> int:
        value = 0
        for level, zeros in enumerate(self.zeros):
            one = int(self.planes[level][at >> 3] >> (7 - (at & 7)) & 1)
            ones = self.rank1(level, at)
            at = zeros + ones if one else at - ones
            value = value << 1 | one
        return value

    def _range(self, symbol: int, low: int, high: int) -> tuple[int, int]:
        """Where the occurrences of a symbol among positions low..high-1 stand below the last plane."""
        if symbol < 0 or symbol >> len(self.zeros):
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            a, b = self.rank1(level, low), self.rank1(level, high)
            low, high = (zeros + a, zeros + b) if symbol >> (len(self.zeros) - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def count(self, symbol: int, low: int = 0, high: int | None = None) -> int:
        first, last = self._range(symbol, low, self.size if high is None else high)
        return last - first

    def select(self, level: int, one: bool, nth: int) -> int:
        """Position of the nth (from 0) zero or one of a plane."""
        low, high = 0, len(self.ranks[level])
        while high - low > 1:  # block by its rank sum
            middle = (low + high) // 2
            before = int(self.ranks[level][middle])
            before = before if one else middle * BLOCK_BITS - before
            low, high = (middle, high) if before <= nth else (low, middle)
        start = low * BLOCK_BITS
        before = int(self.ranks[level][low])
        bits = np.unpackbits(self.planes[level][start // 8 : (start + BLOCK_BITS) // 8])[: self.size - start]
        return start + int(np.flatnonzero(bits == one)[nth - (before if one else start - before)])

    def positions(self, symbol: int) -> list[int]:
        """All places of a symbol, in order."""
        found = []
        for place in range(*self._range(symbol, 0, self.size)):
            for level in reversed(range(len(self.zeros))):
                one = place >= self.zeros[level]
                place = self.select(level, one, place - self.zeros[level] if one else place)
            found.append(place)
        return sorted(found)

    def decode(self) -> np.ndarray:
        """All ids, by undoing the planes from the last to the first."""
        kind = np.uint16 if len(self.zeros) <= 16 else np.uint32
        row = np.zeros(self.size, kind)
        for level in reversed(range(len(self.zeros))):
            ones = np.unpackbits(self.planes[level], count=self.size).view(bool)
            before = np.empty(self.size, kind)
            before[np.flatnonzero(~ones)] = row[: self.zeros[level]]
            before[np.flatnonzero(ones)] = row[self.zeros[level] :] | kind(1 << (len(self.zeros) - 1 - level))
            row = before
        return row.astype(np.uint32)


def _chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of the chunks of all texts: cut before every space between two characters that are no white space, and between a letter and a mark.

    Where a neighbour may be a white space of several bytes, no cut is made; longer chunks give the same ids.
    """
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    space = np.flatnonzero(data == 0x20)
    space = space[~border[space] & ~border[space + 1]]
    after, before = data[space + 1], data[space - 1]
    wide = (before >= 0x80) & ((data[space - 2] == 0xC2) | WIDE_BLANK[data[space - 3]])
    cuts = space[~(BLANK[after] | (after == 0xC2) | WIDE_BLANK[after] | BLANK[before] | wide)]
    marks = np.flatnonzero(MARKS[data])
    marks = marks[LETTERS[data[marks - 1]] & ~border[marks]]
    starts = np.sort(np.concatenate([offsets[:-1][offsets[1:] > offsets[:-1]], cuts, marks]))
    return starts, np.append(starts[1:], len(data))[: len(starts)]


class ChunkTable:
    """Ids (little-endian bytes) of the chunks met so far, by their bytes."""

    def __init__(self, tokenizer_file: str, limit: int = TABLE_CHUNKS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.limit = limit
        self.ids: dict[bytes, bytes] = {}  # chunks met in two blocks or more
        self.fresh: dict[bytes, bytes] = {}  # chunks met once
        names = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(names.values()) + 1, bool)  # tokens that begin with a space
        self.opens[[number for name, number in names.items() if name.startswith(SPACE_MARK)]] = True

    def _segment(self, chunks: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _learned(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Chunks of a word after one space go to the tokenizer many at once and are cut apart where a token begins with a space."""
        alone = [c for c in chunks if c.rfind(b" ")]
        out = dict(zip(alone, self._segment([c.decode() for c in alone]), strict=True))
        words = [c for c in chunks if not c.rfind(b" ")]
        runs = [words[low : low + RUN_WORDS] for low in range(0, len(words), RUN_WORDS)]
        for run, found in zip(runs, self._segment([b"".join(run).decode() for run in runs]), strict=True):
            cuts = (np.flatnonzero(self.opens[np.frombuffer(found, "<u4")]) * 4).tolist()
            if len(cuts) == len(run):
                out.update(zip(run, [found[a:b] for a, b in zip(cuts, [*cuts[1:], len(found)], strict=True)], strict=True))
            else:  # a tokenizer with other rules
                out.update(zip(run, self._segment([c.decode() for c in run]), strict=True))
        return out

    def _ids_of(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of distinct chunks. Rare chunks are forgotten first; both tables stay below ``limit`` in all."""
        out = list(map(self.ids.get, chunks))
        missing = [at for at, found in enumerate(out) if found is None]
        old, unknown = {}, []
        for at in missing:
            chunk = chunks[at]
            found = out[at] = self.fresh.pop(chunk, None)
            if found is None:
                unknown.append(at)
            else:
                old[chunk] = found
        new = self._learned([chunks[at] for at in unknown])
        for at in unknown:
            out[at] = new[chunks[at]]
        if len(self.ids) + len(old) > self.limit // 2:
            self.ids = {}
        self.ids.update(old)
        if len(self.fresh) + len(new) > self.limit // 2:
            self.fresh = {}
        self.fresh.update(new)
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the number of ids of every text."""
        starts, ends = _chunks(data, offsets)
        _, first, which = np.unique(common.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        held = self._ids_of([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
        sizes = np.array([len(h) >> 2 for h in held], np.int64)
        flat = np.frombuffer(b"".join(held), "<u4")
        each = sizes[which]
        shift = (np.cumsum(sizes) - sizes)[which] - (np.cumsum(each) - each)
        ids = flat[np.repeat(shift, each) + np.arange(int(each.sum()))]
        owner = np.searchsorted(offsets, starts, side="right") - 1
        return ids, np.bincount(owner, weights=each, minlength=len(offsets) - 1).astype(np.int64)


_tables: dict[str, ChunkTable] = {}


def _build(tokenizer_file: str, end_id: int, shard_tokens: int):
    schema = pa.schema([
        ("part", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64()), ("n_docs", pa.int64()), ("doc_ids", pa.binary()), ("has_id", pa.binary()), ("lengths", pa.binary()),
        ("zeros", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary())),
    ])

    def shard(part: int, seq: int, names: list[int | None], found: list[np.ndarray]) -> pa.RecordBatch:
        matrix = WaveletMatrix.build(np.concatenate(found))
        row = {
            "part": part, "seq": seq, "n_tokens": matrix.size, "n_docs": len(names),
            "doc_ids": np.array([n or 0 for n in names], np.int64).tobytes(), "has_id": np.array([n is not None for n in names]).tobytes(),
            "lengths": np.array([len(f) for f in found], np.uint32).tobytes(),
            "zeros": matrix.zeros, "planes": [p.tobytes() for p in matrix.planes], "ranks": [r.tobytes() for r in matrix.ranks],
        }
        return pa.RecordBatch.from_pylist([row], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core already
        if tokenizer_file not in _tables:
            _tables[tokenizer_file] = ChunkTable(tokenizer_file)
        table, part, seq = _tables[tokenizer_file], TaskContext.get().partitionId(), 0
        names, found, held = [], [], 0
        for rows, data, offsets in common.blocks(batches, limit=ENCODE_BYTES):
            tokens, sizes = table.encode(data, offsets)
            tokens = np.insert(tokens, np.cumsum(sizes), end_id)
            for name, ids in zip(rows["doc_id"].to_pylist(), np.split(tokens, np.cumsum(sizes + 1)[:-1]), strict=True):
                if found and held + len(ids) > shard_tokens:
                    yield shard(part, seq, names, found)
                    names, found, held, seq = [], [], 0, seq + 1
                names.append(name)
                found.append(ids)
                held += len(ids)
        if found:
            yield shard(part, seq, names, found)
        common.give_back()

    return run


def write_shards(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Tokenize all texts, append ``end_id`` to each, and write the shards in ascending id order."""
    common.small_batches(docs.sparkSession)
    ordered = common.with_row_key(docs, id_col, text_col)
    ordered = ordered.repartitionByRange("doc_id", "row_key").sortWithinPartitions("doc_id", "row_key")
    shards = ordered.select("doc_id", "text").mapInArrow(_build(tokenizer_file, end_id, shard_tokens), SHARD)
    shards.write.option("compression", "zstd").parquet(path)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = WaveletMatrix(row["n_tokens"], row["zeros"], row["planes"], row["ranks"]).decode()
            lengths = np.frombuffer(row["lengths"], np.uint32).astype(np.int64)
            ends = np.cumsum(lengths)
            starts = ends - lengths
            for low in range(0, len(ends), common.BATCH_ROWS):
                some = slice(low, low + common.BATCH_ROWS)
                size = len(ends[some])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(row["doc_ids"], np.int64)[some], mask=~np.frombuffer(row["has_id"], bool)[some]),
                        pa.array(np.full(size, row["part"], np.int32)), pa.array(np.full(size, row["seq"], np.int32)),
                        pa.array(starts[some]), pa.array(lengths[some]),
                        pa.array([ids[a:b].tobytes() for a, b in zip(starts[some], ends[some], strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "part", "seq", "offset", "n_tokens", "tokens"],
                )


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a written table: doc_id, start (ids before it), n_tokens, tokens (little-endian 32-bit ids)."""
    common.small_batches(spark)
    shards = spark.read.schema(SHARD).parquet(path)
    sizes = shards.select("part", "seq", "n_tokens")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = sizes.withColumn("_in", before(Window.partitionBy("part").orderBy("seq")))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))  # one row per file
    parts = parts.select("part", before(Window.orderBy("part")).alias("_over"))
    places = inside.join(parts, "part").select("part", "seq", (F.col("_in") + F.col("_over")).alias("_base"))
    docs = shards.mapInArrow(_unpack, "doc_id bigint, part int, seq int, offset bigint, n_tokens bigint, tokens binary")
    return docs.join(places, ["part", "seq"]).select("doc_id", (F.col("_base") + F.col("offset")).alias("start"), "n_tokens", "tokens")
