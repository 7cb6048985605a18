"""Collocations: phrases of two to four words whose parts rarely occur apart.

Counts are streams. A word is a 64-bit id of its language and bytes; a phrase is its ids in a row,
and a stream is sorted by them. Every place of a text gives one window of up to four words, and all
phrases that begin at that place are prefixes of the window, so one sorted stream of counted
windows gives the counts of all lengths at once. A window ends before a pair of words that occurs
fewer than ``least`` times, since no frequent phrase holds it; filters of the frequent words and
pairs tell. Filters may be wrong in one direction only, towards longer windows, and results never
depend on them.

The frequent phrases are then kept in two orders, by their words forwards (prefix order) and
backwards (suffix order). In prefix order a phrase's first words stand right before it, in suffix
order its last words do; one pass over each order, merging the four lengths in lockstep, reads off
the counts of all left and right parts and hands every phrase the count of its most frequent
extension by one word. Longer extensions need no look: the words between are a candidate as well, at
least as frequent. Ranges of an order are cut at phrases, not at words, so a frequent first word is
many ranges; the few phrases that continue into the next range are copied there.

Two different words share an id with a probability of about (distinct words)^2 / 2^65.

Cases: a null text is empty; a null language is ``und``; repeated rows count each time; ids are not
looked at; an empty table gives an empty result; other columns are ignored. Long texts are read in
stretches that end between pieces, so memory grows with the longest piece, not the longest text.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from projectpulse.llm import common
from projectpulse.skew import cut_lineage

WIDTH, LEAST, TOP, NO_LANGUAGE = 4, 30, 2000, "und"
#: a filter takes about so many bits a key, up to a bound (64 MB for each broadcast); beyond it windows get longer
KEY_BITS, MOST_BITS, SLICE_BITS, PROBES = 16, 1 << 29, 1 << 20, 3
#: counted rows that a task holds before it hands them on; phrases of one range of an order
HELD, RANGE_ROWS = 1 << 20, 200_000

_blank = np.zeros(256, bool)
_blank[[0x20, 9]] = True
_ends = np.zeros(256, bool)  # bytes that end a piece
_ends[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_ID = [f"w{k}" for k in range(WIDTH)]


class Filter:
    """Bloom filter over 64-bit keys; ``bits`` is a power of two."""

    def __init__(self, packed: np.ndarray) -> None:
        self.packed, self.mask = packed, np.uint64(len(packed) * 8 - 1)

    @staticmethod
    def probes(keys: np.ndarray, mask: np.uint64) -> Iterator[np.ndarray]:
        step = (keys >> np.uint64(32)) | np.uint64(1)
        return ((keys + np.uint64(i) * step) & mask for i in range(PROBES))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in self.probes(keys, self.mask):
            found &= (self.packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
        return found


def _slices_of(mask: int):
    """Bits of keys as rows (slice, places in it); a slice is SLICE_BITS wide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch["key"].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            at = np.unique(np.concatenate(list(Filter.probes(keys, np.uint64(mask))))) if len(keys) else keys
            part = at // np.uint64(SLICE_BITS)
            heads = common.first_of_runs(part)
            ends = [*heads[1:].tolist(), len(at)]
            packed = [(at[a:b] % np.uint64(SLICE_BITS)).astype(np.uint32).tobytes() for a, b in zip(heads.tolist(), ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[heads].astype(np.int32)), pa.array(packed, pa.binary())], names=["slice", "places"])

    return run


def _fill(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(SLICE_BITS, bool)
    for batch in batches:
        for places in batch["places"]:
            bits[np.frombuffer(places.as_buffer(), np.uint32)] = True
    packed = zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([packed], pa.binary())], names=["slice", "filter"])


def broadcast_filter(keys: DataFrame) -> Broadcast:
    """A filter of the column ``key`` (distinct), sized by the number of keys and at most MOST_BITS; made by slices in tasks."""
    bits, wanted = SLICE_BITS, min(MOST_BITS, KEY_BITS * keys.count())
    while bits < wanted:
        bits *= 2
    rows = keys.select("key").mapInArrow(_slices_of(bits - 1), "slice int, places binary").groupBy("slice").applyInArrow(_fill, "slice int, filter binary").collect()
    return keys.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, bits, {r["slice"]: bytes(r["filter"]) for r in rows}))


_filters: dict[str, Filter] = {}


def _opened(sent: Broadcast) -> Filter:
    name, bits, slices = sent.value
    if name not in _filters:
        packed = np.zeros(bits // 8, np.uint8)
        for number, held in slices.items():
            packed[number * SLICE_BITS // 8 : (number + 1) * SLICE_BITS // 8] = np.frombuffer(zlib.decompress(held), np.uint8)
        _filters.clear()  # those of earlier queries
        _filters[name] = Filter(packed)
    return _filters[name]


def _pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return common.mix(first * common.MULTIPLIER + second)


class Words:
    """Words of a stretch of texts: ids, the number of their piece, spans in ``data``, language number."""

    def __init__(self, data: np.ndarray, inner: np.ndarray, seeds: np.ndarray, owner_of: np.ndarray) -> None:
        self.data = data
        stop = _ends[data]
        solid = ~(_blank[data] | stop)
        border = np.zeros(len(data) + 1, bool)
        border[inner] = True
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1] | border[1:-1]
        ends[:-1] &= ~solid[1:] | border[1:-1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        broken = np.cumsum(stop | border[:-1])
        self.piece = broken[self.starts]
        self.owner = owner_of[np.searchsorted(inner, self.starts, side="right") - 1] if len(inner) else np.zeros(0, np.int64)
        self.ids = common.mix(common.span_hashes(data, self.starts, self.ends) ^ seeds[self.owner]) if len(self.starts) else np.zeros(0, np.uint64)
        self.ids[self.ids == 0] = 1  # 0 is "no word"

    def follow(self) -> np.ndarray:
        """True where the next word stands in the same piece."""
        same = np.zeros(len(self.ids), bool)
        same[:-1] = self.piece[1:] == self.piece[:-1]
        return same


def _stretches(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of a batch's bytes of about BLOCK_BYTES that end between pieces."""
    low, size = 0, len(data)
    while low < size:
        high, span = size, common.BLOCK_BYTES
        while low + span < size:
            near = int(offsets[np.searchsorted(offsets, low + span, side="right") - 1])
            stops = np.flatnonzero(_ends[data[low : low + span]])
            near = max(near, low + int(stops[-1]) + 1 if len(stops) else low)
            if near > low:
                high = near
                break
            span *= 2
        yield low, high
        low = high


def _read(batch: pa.RecordBatch) -> Iterator[tuple[Words, list[str]]]:
    """Words of a batch, stretch by stretch, and the names of the languages that owners number."""
    data, offsets = common.text_bytes(batch["text"])
    lang = batch["lang"].dictionary_encode()
    names, codes = lang.dictionary.to_pylist(), lang.indices.to_numpy()
    seeds = np.array([int.from_bytes(name.encode()[:8].ljust(8, b"\0"), "little") ^ (zlib.crc32(name.encode()) << 32) for name in names], np.uint64)
    seeds = common.mix(seeds + common.MULTIPLIER)
    data = common.LOWER[data]
    for low, high in _stretches(data, offsets):
        first = int(np.searchsorted(offsets, low, side="right")) - 1
        last = int(np.searchsorted(offsets, high, side="left"))
        inner = np.maximum(offsets[first:last] - low, 0)
        yield Words(data[low:high], inner, seeds, codes[first:last]), names


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of every stretch with their counts."""
    for batch in batches:
        for words, names in _read(batch):
            ids, first, times = np.unique(words.ids, return_index=True, return_counts=True)
            raw = words.data.tobytes()
            texts = [raw[a:b] for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)]
            lang = pa.array(names, pa.string()).take(pa.array(words.owner[first]))
            yield pa.RecordBatch.from_arrays([lang, pa.array(ids.view(np.int64)), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())], names=["lang", "id", "word", "n"])
    common.give_back()


def _combined(rows: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows (one column a word) counted once, in prefix order."""
    ids, n = np.concatenate(rows), np.concatenate(times)
    order = np.lexsort(ids.T[::-1])
    ids, n = ids[order], n[order]
    heads = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]).any(axis=1)))) if len(ids) else np.zeros(0, np.int64)
    return ids[heads], np.add.reduceat(n, heads) if len(heads) else n


def _counted(extract, names: list[str]):
    """Rows of ``extract(words)``, combined over many stretches before they are handed on."""

    def batch_of(ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(column).view(np.int64)) for column in ids.T], pa.array(n)], names=[*names, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, times, held = [], [], 0
        for batch in batches:
            for words, _ in _read(batch):
                ids = extract(words)
                rows.append(ids)
                times.append(np.ones(len(ids), np.int64))
                held += len(ids)
                if held > 2 * HELD:
                    ids, n = _combined(rows, times)
                    rows, times, held = [ids], [n], len(ids)
                    if held > HELD:  # mostly different rows
                        yield batch_of(ids, n)
                        rows, times, held = [], [], 0
        if held:
            yield batch_of(*_combined(rows, times))
        common.give_back()

    return run


def _pairs(frequent: Broadcast):
    def extract(words: Words) -> np.ndarray:
        good = _opened(frequent).holds(words.ids)
        at = np.flatnonzero(words.follow()[:-1] & good[:-1] & good[1:])
        return _pair_keys(words.ids[at], words.ids[at + 1])[:, None]

    return extract


def _windows(frequent: Broadcast):
    def extract(words: Words) -> np.ndarray:
        count = len(words.ids)
        goes_on = np.zeros(count + WIDTH, bool)
        at = np.flatnonzero(words.follow())
        goes_on[at] = _opened(frequent).holds(_pair_keys(words.ids[at], words.ids[at + 1]))
        heads = np.flatnonzero(goes_on[:count])
        rows = np.zeros((len(heads), WIDTH), np.uint64)
        rows[:, 0] = words.ids[heads]
        alive = np.ones(len(heads), bool)
        for k in range(1, WIDTH):
            alive &= goes_on[heads + k - 1]
            rows[alive, k] = words.ids[heads[alive] + k]
        return rows

    return extract


def _keys_of(ids: np.ndarray) -> np.ndarray:
    """Rows of ids as byte strings whose order is the order of the rows; "no word" comes first."""
    return np.ascontiguousarray(ids.astype(">u8")).view(f"S{8 * WIDTH}").ravel()


def _columns(rows: pa.Table | pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([rows[name].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for name in names], axis=1) if rows.num_rows else np.zeros((0, len(names)), np.uint64)


def _borders(stream: DataFrame, order: list[str]) -> list[bytes]:
    """First phrases of ranges of about RANGE_ROWS rows; one per range comes to the driver."""
    ranges = -(-stream.count() // RANGE_ROWS)
    if ranges < 2:
        return []
    key = F.concat(*[F.lpad(F.hex(name), 16, "0") for name in order])
    dealt = stream.select(key.alias("key")).repartitionByRange(ranges, "key")
    firsts = dealt.groupBy(F.spark_partition_id()).agg(F.min("key").alias("key")).collect()
    return sorted(bytes.fromhex(r["key"]) for r in firsts)[1:]


def _deal(borders: list[bytes], order: list[str], copies: bool):
    """Adds ``part``, the range of a row. With ``copies`` a row also goes to all ranges that its extensions reach into."""
    limits = np.array(borders, f"S{8 * WIDTH}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _columns(batch, order)
            low = np.searchsorted(limits, _keys_of(ids), side="right")
            high = np.searchsorted(limits, _keys_of(np.where(ids == 0, ~np.uint64(0), ids)), side="right") if copies else low
            spans = high - low + 1
            row = np.repeat(np.arange(len(ids)), spans)
            part = low[row] + (np.arange(len(row)) - np.repeat(np.cumsum(spans) - spans, spans))
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), pa.array(part == low[row]), *taken.columns], names=["part", "home", *taken.schema.names])

    return run


def _sorted(batches: Iterator[pa.RecordBatch], order: list[str]) -> tuple[pa.Table, np.ndarray]:
    rows = pa.Table.from_batches(list(batches)).combine_chunks()
    ids = _columns(rows, order)
    at = np.lexsort(ids.T[::-1])
    return rows.take(pa.array(at)), ids[at]


def _groups(ids: np.ndarray) -> list[np.ndarray]:
    """For k = 1..WIDTH: for every row, the first row with the same k leading ids (rows are sorted)."""
    differ = np.zeros(len(ids), bool)
    differ[:1] = True
    found = []
    for k in range(ids.shape[1]):
        differ[1:] |= ids[1:, k] != ids[:-1, k]
        found.append(np.maximum.accumulate(np.where(differ, np.arange(len(ids)), 0)))
    return found


def _phrases(least: int):
    """Counts of all phrases of two words or more that begin the windows of one range; those at its ends may be incomplete."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ids = _sorted(batches, _ID)
        n, groups = rows["n"].to_numpy(), _groups(ids)
        for k in range(2, WIDTH + 1):
            head = np.unique(groups[k - 1])
            total = np.add.reduceat(n, head) if len(head) else n
            whole = ids[head, k - 1] != 0
            ends = np.zeros(len(head), bool)
            ends[[0, -1]] = True
            chosen = np.flatnonzero(whole & ((total >= least) | ends))
            out = np.zeros((len(chosen), WIDTH), np.uint64)
            out[:, :k] = ids[head[chosen], :k]
            yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(c).view(np.int64)) for c in out.T], pa.array(total[chosen])], names=[*_ID, "n"])

    return run


def _lockstep(order: list[str], side: str):
    """One pass over a range of an order: per phrase the counts of its 1, 2 and 3 leading words, and the count of its most frequent extension here."""
    names = [f"{side}{k}" for k in range(1, WIDTH)]

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ids = _sorted(batches, order)
        n, size, groups = rows["n"].to_numpy(), (ids != 0).sum(axis=1), _groups(ids)
        parts = [np.where(size > k, n[groups[k - 1]], 0) for k in range(1, WIDTH)]
        most = np.zeros(len(n), np.int64)
        for k in range(1, WIDTH):
            longer = np.flatnonzero(size == k + 1)
            np.maximum.at(most, groups[k - 1][longer], n[longer])
        home = rows["home"].to_numpy(zero_copy_only=False)
        useful = pa.array(np.flatnonzero(home | (most > 0)))
        parts = [np.where(home, p, 0) for p in parts]
        out = rows.select([*_ID, "n"]).append_column("more", pa.array(most))
        for name, values in zip(names, parts, strict=True):
            out = out.append_column(name, pa.array(values))
        yield from out.take(useful).to_batches()

    return run


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Words (lang, id, word, n), and the stream (w0..w3, n) of all frequent phrases of one to four words."""
    spark: SparkSession = docs.sparkSession
    common.small_batches(spark)
    texts = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit(NO_LANGUAGE)).alias("lang"))
    words = texts.mapInArrow(_count_words, "lang string, id bigint, word string, n bigint")
    words = cut_lineage(words.groupBy("lang", "id", "word").agg(F.sum("n").alias("n")))
    frequent = words.where(F.col("n") >= least)
    known = broadcast_filter(frequent.select(F.col("id").alias("key")))
    pairs = texts.mapInArrow(_counted(_pairs(known), ["key"]), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    going_on = broadcast_filter(cut_lineage(pairs.where(F.col("n") >= least).select("key")))
    ids = ", ".join(f"{name} bigint" for name in _ID)
    windows = cut_lineage(texts.mapInArrow(_counted(_windows(going_on), _ID), f"{ids}, n bigint"))
    dealt = windows.mapInArrow(_deal(_borders(windows, _ID), _ID, copies=False), f"part bigint, home boolean, {ids}, n bigint")
    longer = dealt.groupBy("part").applyInArrow(_phrases(least), f"{ids}, n bigint")
    longer = longer.groupBy(*_ID).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    zero = F.lit(0).cast("bigint")
    single = frequent.select(F.col("id").alias("w0"), zero.alias("w1"), zero.alias("w2"), zero.alias("w3"), "n")
    return words, cut_lineage(single.unionByName(longer))


def with_parts(stream: DataFrame) -> DataFrame:
    """The stream with l1..l3 (counts of a phrase's first k words), r1..r3 (of its last k words) and ``more`` (of its most frequent extension)."""
    ids = ", ".join(f"{name} bigint" for name in _ID)
    zero = F.lit(0).cast("bigint")
    back = F.filter(F.array(*reversed(_ID)), lambda w: w != 0)
    turned = stream.select("*", *[F.coalesce(F.get(back, F.lit(k)), zero).alias(f"b{k}") for k in range(WIDTH)])
    turned = cut_lineage(turned)
    sides = []
    for side, other, order in (("l", "r", _ID), ("r", "l", [f"b{k}" for k in range(WIDTH)])):
        kept = turned if side == "r" else stream
        ddl = f"part bigint, home boolean, {', '.join(f'{name} bigint' for name in kept.columns)}"
        dealt = kept.mapInArrow(_deal(_borders(kept, order), order, copies=True), ddl)
        own = ", ".join(f"{side}{k} bigint" for k in range(1, WIDTH))
        passed = dealt.groupBy("part").applyInArrow(_lockstep(order, side), f"{ids}, n bigint, more bigint, {own}")
        sides.append(passed.select("*", *[zero.alias(f"{other}{k}") for k in range(1, WIDTH)]))
    both = sides[0].unionByName(sides[1])
    counts = ["more", *[f"{s}{k}" for s in "lr" for k in range(1, WIDTH)]]
    return both.groupBy(*_ID, "n").agg(*[F.max(name).alias(name) for name in counts])


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of every language, all counts bigint."""
    words, stream = phrase_counts(docs, text_col, lang_col, least)
    whole = with_parts(stream).where("w1 != 0 and 100 * cast(more as decimal(38, 0)) < 80 * cast(n as decimal(38, 0))")
    cuts = []
    for size in range(2, WIDTH + 1):
        each = []
        for k in range(1, size):
            left, right = F.col(f"l{k}"), F.col(f"r{size - k}")
            score = F.expr(f"cast((cast(2000000 as decimal(38, 0)) * n) div nullif(cast(l{k} as decimal(20, 0)) + r{size - k}, 0) as bigint)")
            each.append(F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
        cuts.append(F.array_min(F.array(*each)))
    size = F.when(F.col("w2") == 0, 2).when(F.col("w3") == 0, 3).otherwise(4)
    best = F.when(size == 2, cuts[0]).when(size == 3, cuts[1]).otherwise(cuts[2])
    scored = whole.select(*_ID, F.col("n").alias("a"), best.alias("cut")).select(*_ID, "a", "cut.l", "cut.r", "cut.score")
    by_id = words.where(F.col("n") >= least).select("lang", "id", "word")
    scored = scored.join(by_id.select(F.col("id").alias("w0"), "lang"), "w0")
    # ties of the last place stay until their texts are known
    leading = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    scored = cut_lineage(scored.withColumn("_place", F.rank().over(leading)).where(F.col("_place") <= top).drop("_place"))
    spelled = scored.withColumn("_w", F.array(*_ID)).select("*", F.posexplode("_w").alias("_at", "id")).where("id != 0")
    spelled = spelled.join(by_id.select("id", "word"), "id").groupBy("lang", *_ID, "a", "l", "r", "score")
    spelled = spelled.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    ordered = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelled.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
