"""Groups of spelling variants: words that differ by one code point.

Words are runs of letters of the Latin-1 range, counted over all texts. For the comparison each
word is placed by the half that a single edit leaves alone: with L the longer length, either the
first or the last (L - 1) // 2 code points agree. Words are packed by that half and by L into
tiles of bounded size; a pack with more words than a tile holds is cut into blocks, and every
pair of its blocks is a tile. Inside a tile the words are a padded matrix of code points (one byte
each). All rows of one block meet all rows of the other at once, and two words are near if their
common prefix and common suffix together reach L - 1. A tile returns one row per word (number of
near words, best of them), never the pairs.

A word's form is its most frequent near word, if that is at least ``ratio`` times as frequent. Counts
at least double along forms, so that roots are found by pointer doubling in a few joins.

Cases: a null text has no words; a null id is an empty string in ``<doc_id>:``; repeated rows count
each time; a table without words gives an empty result; other columns are ignored. Long texts are
read in stretches of ``common.BLOCK_BYTES`` that end between runs, so memory grows with the longest run
of letters only, and tiles hold fewer words the longer they are.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from projectpulse.llm import common
from projectpulse.skew import cut_lineage

#: one in so many (document, run) pairs loses a code point
SLIP = 97
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: words and bytes of one block of a tile
TILE_WORDS, TILE_BYTES = 256, 1 << 18
#: tiles of one task
TASK_TILES = 200
#: distinct words that a task counts before it hands them on
HELD_WORDS = 200_000

_crc_steps = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
_letters = np.zeros(256, bool)
_letters[[*range(65, 91), *range(97, 123)]] = True


def _letter_bytes(data: np.ndarray) -> np.ndarray:
    """Bytes of ASCII letters and of U+00C0 to U+00FF, which are C3 and one more byte in UTF-8."""
    found = _letters[data]
    lead = np.flatnonzero(data == 0xC3)
    found[lead] = True
    found[lead + 1] = True
    return found


def _crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Checksum of every data[start:end], continued from ``before``; all spans step together."""
    state, order = ~before, np.argsort(starts - ends, kind="stable")  # longest first
    starts, lengths = starts[order], (ends - starts)[order]
    state = state[order]
    alive, step = len(order), 0
    while alive := int(np.searchsorted(-lengths[:alive], -step, side="left")):
        part = state[:alive]
        state[:alive] = _crc_steps[(part ^ data[starts[:alive] + step]) & np.uint32(255)] ^ (part >> np.uint32(8))
        step += 1
    out = np.empty(len(order), np.uint32)
    out[order] = ~state
    return out


def _stretches(offsets: np.ndarray, letter: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of a batch's bytes of about BLOCK_BYTES that end with a text or beside a byte that is no letter."""
    low, size = 0, len(letter)
    while low < size:
        high = min(low + common.BLOCK_BYTES, size)
        if high < size:
            end = int(offsets[np.searchsorted(offsets, high, side="right") - 1])
            gaps = np.flatnonzero(~letter[low:high])
            high = max(end, low + int(gaps[-1]) + 1 if len(gaps) else low)
            if high <= low:  # one run of letters is longer than a stretch
                gaps = np.flatnonzero(~letter[low:])
                high = min([low + int(gaps[0])] if len(gaps) else [size], default=size)
                later = offsets[np.searchsorted(offsets, low, side="right") :]
                high = min(high, int(later[0])) if len(later) else high
        yield low, high
        low = high


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def handed_on() -> pa.RecordBatch:
        words = pa.array(list(counts.keys()), pa.binary()).cast(pa.string())
        out = pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        data, offsets = common.text_bytes(batch["text"])
        heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch["doc_id"].to_pylist()], np.uint32)
        data = common.LOWER[data]
        letter = _letter_bytes(data)
        for low, high in _stretches(offsets, letter):
            part, solid = data[low:high], letter[low:high]
            border = np.zeros(high - low + 1, bool)
            inner = offsets[(offsets >= low) & (offsets <= high)] - low
            border[inner] = True
            begins, stops = solid.copy(), solid.copy()
            begins[1:] &= ~solid[:-1] | border[1:-1]
            stops[:-1] &= ~solid[1:] | border[1:-1]
            starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
            if not len(starts):
                continue
            owner = np.searchsorted(offsets, starts + low, side="right") - 1
            slips = _crc32(part, starts, ends, heads[owner])
            slipped = slips % SLIP == 0
            wide = np.concatenate(([0], np.cumsum((part & 0xC0) == 0x80)))
            length = ends - starts - (wide[ends] - wide[starts])
            kept = np.flatnonzero(~slipped & (length >= LEAST_LENGTH))
            hashes = common.span_hashes(part, starts[kept], ends[kept])
            _, first, times = np.unique(hashes, return_index=True, return_counts=True)
            raw = part.tobytes()
            for at, n in zip(kept[first].tolist(), times.tolist(), strict=True):
                counts[raw[starts[at] : ends[at]]] += n
            for at in np.flatnonzero(slipped & (length > LEAST_LENGTH)).tolist():
                run, gone = raw[starts[at] : ends[at]].decode(), int(slips[at]) % int(length[at])
                counts[(run[:gone] + run[gone + 1 :]).encode()] += 1
            if len(counts) > HELD_WORDS:
                yield handed_on()
    if counts:
        yield handed_on()
    common.give_back()


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs after slips, of at least LEAST_LENGTH code points, over all texts."""
    common.small_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counted = picked.mapInArrow(_count_runs, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def near_in_tile(left: np.ndarray, left_size: np.ndarray, right: np.ndarray, right_size: np.ndarray, longer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix and suffix lengths of all (left, right) pairs, and which are near with ``longer`` as the longer length.

    Rows are code points padded with zeros to ``longer`` columns; sizes are ``longer`` or one less.
    """
    shape = (len(left), len(right))
    shorter = np.minimum(left_size[:, None], right_size[None, :])
    found, same = [], np.empty(shape, bool)
    for a, b in ((left, right), (_turned(left, left_size), _turned(right, right_size))):
        alive, common_length = np.ones(shape, bool), np.zeros(shape, np.uint8 if longer < 256 else np.int32)
        b = np.where(b == 0, np.uint8(1), b)  # padding equals nothing
        for column in range(longer):
            np.equal(a[:, column, None], b[None, :, column], out=same)
            alive &= same
            common_length += alive
            if column % 8 == 7 and not alive.any():
                break
        found.append(common_length)
    prefix, suffix = found
    equal = (prefix == shorter) & (left_size[:, None] == right_size[None, :])
    near = (np.maximum(left_size[:, None], right_size[None, :]) == longer) & (np.add(prefix, suffix, dtype=np.int32) >= longer - 1) & ~equal
    return prefix, suffix, near


def _turned(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Words from their last code point backwards, padded at the end again."""
    back = rows[:, ::-1]
    if not len(rows):
        return back
    moved = np.arange(rows.shape[1])[None, :] + (rows.shape[1] - sizes)[:, None]
    return np.where(moved < rows.shape[1], np.take_along_axis(back, np.minimum(moved, rows.shape[1] - 1), axis=1), 0)


def _compare(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words inside one tile, reported per word."""
    side, longer, first, second = key[0].as_py(), key[1].as_py(), key[3].as_py(), key[4].as_py()
    rows = pa.Table.from_batches(list(batches)).combine_chunks()
    words = rows["word"].to_pylist()
    codes = [w.encode("latin-1") for w in words]
    sizes = np.array([len(c) for c in codes])
    matrix = np.frombuffer(b"".join(c.ljust(longer, b"\0") for c in codes), np.uint8).reshape(len(codes), longer)
    counts, block = rows["n"].to_numpy(), rows["block"].to_numpy()
    one, two = np.flatnonzero(block == first), np.flatnonzero(block == second)
    prefix, suffix, near = near_in_tile(matrix[one], sizes[one], matrix[two], sizes[two], longer)
    half = (longer - 1) // 2
    near &= prefix >= half if side == 0 else (suffix >= half) & (prefix < half)  # found on one side only
    order = np.array(words, object)
    rank = np.empty(len(words), np.int64)  # most frequent first, then by code points
    rank[sorted(range(len(words)), key=lambda i: (-counts[i], order[i]))] = np.arange(len(words))
    by_rank = np.argsort(rank)
    found = []
    for own, other, pairs in ((one, two, near), *([(two, one, near.T)] if first != second else [])):
        times = pairs.sum(axis=1)
        best = np.where(pairs, rank[other][None, :], len(words)).min(axis=1, initial=len(words))
        found += [(words[own[i]], int(times[i]), words[by_rank[best[i]]], int(counts[by_rank[best[i]]])) for i in np.flatnonzero(times)]
    yield pa.RecordBatch.from_pylist(
        [dict(zip(("word", "n_near", "best", "best_n"), f, strict=True)) for f in found],
        schema=pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best", pa.string()), ("best_n", pa.int64())]),
    )


def near_words(words: DataFrame, tile_words: int = TILE_WORDS) -> DataFrame:
    """(word, n_near, best, best_n) of every word that has a near word; ``words`` is (word, n) with distinct words."""
    size = F.length("word")
    placed = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("longer"))
    half = F.expr("(longer - 1) div 2").cast("int")
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.xxhash64(F.substring("word", F.lit(1), half)).alias("half")),
        F.struct(F.lit(1).alias("side"), F.xxhash64(F.substring("word", F.greatest(F.length("word") - half, F.lit(0)) + 1, half)).alias("half")),
    )
    placed = placed.select("word", "n", "longer", F.explode(sides).alias("s")).select("word", "n", "longer", "s.side", "s.half")
    room = F.greatest(F.lit(1), F.least(F.lit(tile_words), F.expr(f"{TILE_BYTES} div longer"))).cast("bigint")
    # packs of about one tile by the half, so that words that share it stay together
    sizes = cut_lineage(placed.groupBy("side", "longer").agg(F.count("*").alias("_n")).select("side", "longer", F.ceil(F.col("_n") / room).alias("packs")))
    packed = placed.join(sizes, ["side", "longer"]).withColumn("pack", F.pmod("half", "packs")).drop("half", "packs")
    full = packed.groupBy("side", "longer", "pack").agg(F.count("*").alias("_n"), F.max(F.length("word")).alias("_long"), F.min(F.length("word")).alias("_short"))
    full = full.where("_n > 1 and _long = longer")  # without a word of the longer length there is nothing to compare
    full = full.select("side", "longer", "pack", F.ceil(F.col("_n") / room).cast("int").alias("blocks"))
    full = cut_lineage(full)
    n_tiles = full.agg(F.sum(F.expr("blocks * (blocks + 1) div 2"))).first()[0] or 1
    dealt = packed.join(full, ["side", "longer", "pack"]).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = dealt.withColumn("_other", every).select(
        "side", "longer", "pack", F.least("block", "_other").alias("first"), F.greatest("block", "_other").alias("second"), "word", "n", "block"
    )
    cell = ["side", "longer", "pack", "first", "second"]
    tiles = tiles.repartition(max(words.sparkSession.sparkContext.defaultParallelism, -(-n_tiles // TASK_TILES)), *cell)  # by work: few bytes are many comparisons
    found = tiles.groupBy(*cell).applyInArrow(_compare, "word string, n_near bigint, best string, best_n bigint")
    ranked = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("best"))).alias("top"))
    return ranked.select("word", "n_near", "top.best", (-F.col("top.m")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form: the end of the chain of forms, by pointer doubling."""
    state = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = state.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        step = cut_lineage(state.join(onward, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        state = step.select("word", "root")
        if step.where("_moved").isEmpty():
            return state


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_count: int = LEAST_COUNT, ratio: int = RATIO, tile_words: int = TILE_WORDS) -> DataFrame:
    """One row per word: word, n, n_near, form and form_n (null without a form), root."""
    words = cut_lineage(count_words(docs, id_col, text_col).where(F.col("n") >= least_count))
    near = cut_lineage(near_words(words, tile_words))
    strong = F.col("best_n") >= F.lit(ratio) * F.col("n")
    judged = words.join(near, "word", "left")
    judged = judged.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best")).alias("form"), F.when(strong, F.col("best_n")).alias("form_n"))
    judged = cut_lineage(judged)
    ends = roots(judged.where("form is not null"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
