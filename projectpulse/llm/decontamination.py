"""Benchmark decontamination: seeds of rare words, then Smith-Waterman alignment.

A passage and an item are aligned by words (match 2, mismatch and gap -1); the score is a share of
the item's best possible one, so edited and partly paraphrased copies still score high. A document
is contaminated by an item if the score is at least ``least``.

Seeds lose no such pair. A score of ``least`` needs a share of ``least`` of the item's words in
place, within ``3 - 2 * least`` times its length. So among all but a few of its words, whichever
these are, some are in place; they are chosen as the rarest by their document frequency over the
whole corpus. Where enough of them lie together, all words of the item are counted, and where these
are enough the two are aligned. The result is that of aligning every document with every item.

Words are runs of characters other than white space and punctuation (Unicode categories Z and P,
and ASCII symbols), without case (Unicode case folding, the same for items and documents). Items are
taken in blocks of at most ``BLOCK_ITEMS``; a block and its words go to all tasks, and more items
mean more passes, each of which reads the documents twice. Rows of one document travel alone, so an
item that a third of all documents contain makes no hot key.

Cases: null or empty texts have no words; items with fewer than ``gram`` words match nothing; rows
with a null id are judged like others and reported with a null id; repeated rows are reported once per row;
empty tables give an empty result.
"""

from __future__ import annotations

import functools
import itertools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from projectpulse.llm import common

GRAM, LEAST, BLOCK_ITEMS = 4, 0.5, 20_000
MATCH, MISS = 2, 1
NORMAL = common.LOWER.copy()
NORMAL[33:48] = 32
NORMAL[58:65] = 32
NORMAL[91:97] = 32
NORMAL[123:127] = 32
PROBE_BITS = 20
#: code points with case or punctuation are all below
FOLDED = 0x20000
#: (word, item) pairs that are sorted at once
STEP = 1 << 20


def _fold(char: str) -> bytes:
    """A character without case; punctuation and white space as spaces."""
    if char.isspace() or unicodedata.category(char)[0] in "PZ":
        return b" " * len(char.encode())
    return char.casefold().encode()


@functools.cache
def _folds() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 0 for characters that stay, 1 for others, 2 where the length changes; and their new bytes."""
    kind, new = np.zeros(FOLDED, np.uint8), np.zeros((FOLDED, 4), np.uint8)
    for code in itertools.chain(range(128, 0xD800), range(0xE000, FOLDED)):
        own, fold = chr(code).encode(), _fold(chr(code))
        if fold != own:
            kind[code] = 1 if len(fold) == len(own) else 2
            new[code, : len(own)] = np.frombuffer(fold[: len(own)].ljust(len(own)), np.uint8)
    return kind, new


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts beyond ASCII without case, their punctuation as spaces."""
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return data, offsets
    kind, new = _folds()
    data, odd = data.copy(), []
    first = data[lead]
    for size, low, high in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0x100)):
        at = lead[(first >= low) & (first < high)]
        code = (data[at] & (0x7F >> size)).astype(np.int64)
        for step in range(1, size):
            code = code << 6 | data[np.minimum(at + step, len(data) - 1)] & 0x3F
        found = np.where(code < FOLDED, kind[np.minimum(code, FOLDED - 1)], 0)
        odd.append(at[found == 2])
        at, code = at[found == 1], code[found == 1]
        for step in range(size):
            data[np.minimum(at + step, len(data) - 1)] = new[code, step]
    odd = np.unique(np.searchsorted(offsets, np.concatenate(odd), side="right") - 1)
    if not len(odd):
        return data, offsets
    raw = data.tobytes()
    texts = [raw[a:b] for a, b in itertools.pairwise(offsets)]
    for text in odd:
        texts[text] = "".join(_fold(c).decode() for c in texts[text].decode(errors="replace")).encode()
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of all words of a block."""
    data, offsets = folded(data, offsets)
    plain = NORMAL[data]
    starts, ends, texts = common.word_spans(plain, offsets)
    return common.span_hashes(plain, starts, ends), texts


def item_words(texts: list[str]) -> list[np.ndarray]:
    found = []
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        found.append(word_hashes(data, np.array([0, len(data)]))[0])
    return found


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each pair: score as a share of the item's own, and the passage word it ends at."""
    best, ends = np.zeros(len(items)), np.zeros(len(items), np.int64)
    order = np.argsort([len(p) for p in passages], kind="stable")
    for low in range(0, len(order), 128):
        some = order[low : low + 128]
        width, depth = max(len(passages[i]) for i in some), max(len(items[i]) for i in some)
        words = np.zeros((len(some), width), np.uint64)
        taken = np.zeros((len(some), depth), np.uint64)
        for row, i in enumerate(some):
            words[row, : len(passages[i])] = passages[i]
            taken[row, : len(items[i])] = items[i]
        slope = np.arange(width, dtype=np.int32) * MISS
        above = np.zeros((len(some), width), np.int32)
        top, at = np.zeros(len(some), np.int32), np.zeros(len(some), np.int64)
        for step in range(depth):
            word = taken[:, step : step + 1]
            gain = np.where((words == word) & (word != 0), MATCH, -MISS).astype(np.int32)
            gain[:, 1:] += above[:, :-1]
            row = np.maximum(np.maximum(gain, above - MISS), 0)
            row = np.maximum.accumulate(row + slope, axis=1) - slope  # gaps along the passage
            place = row.argmax(axis=1)
            high = row[np.arange(len(some)), place]
            better = high > top
            top[better], at[better] = high[better], place[better]
            above = row
        best[some] = top / np.array([MATCH * len(items[i]) for i in some])
        ends[some] = at
    return best, ends


class Seeds:
    """The distinct words of a block of items, to be looked up in documents."""

    def __init__(self, items: list[np.ndarray]) -> None:
        self.hashes, self.seed = np.unique(np.concatenate([np.zeros(0, np.uint64), *items]), return_inverse=True)
        self.item = np.repeat(np.arange(len(items)), np.array([len(words) for words in items], np.int64))
        self.probe = np.zeros(1 << PROBE_BITS, bool)
        self.probe[self.hashes >> np.uint64(64 - PROBE_BITS)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions that hold one of the words, and its number."""
        maybe = np.flatnonzero(self.probe[hashes >> np.uint64(64 - PROBE_BITS)])
        number = np.searchsorted(self.hashes, hashes[maybe])
        number[number == len(self.hashes)] = 0
        right = self.hashes[number] == hashes[maybe]
        return maybe[right], number[right]


class Rare:
    """Per item its rarest words, how many of them a passage must hold, and within how many words.

    With ``match`` of an item's words in place at least, all but ``match - need`` of its words hold
    ``need`` matches at least, whichever they are; taking the rarest makes the fewest candidates.
    """

    def __init__(self, seeds: Seeds, items: list[np.ndarray], frequency: np.ndarray, gram: int, least: float) -> None:
        sizes = np.array([len(words) for words in items], np.int64)
        self.match = np.maximum(np.ceil(least * sizes - 1e-9).astype(np.int64), 1)
        self.need = np.maximum(self.match // 3, 1)
        self.span = np.floor(sizes * (3 - 2 * least) + 1e-9).astype(np.int64)
        rank = np.lexsort((seeds.seed, frequency[seeds.seed], seeds.item))
        order = np.arange(len(rank)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        taken = rank[(order < np.repeat(sizes - self.match + self.need, sizes)) & np.repeat(sizes >= gram, sizes)]
        pairs = np.unique(seeds.seed[taken] * max(len(items), 1) + seeds.item[taken])
        self.items = pairs % max(len(items), 1)
        self.starts = np.searchsorted(pairs // max(len(items), 1), np.arange(len(seeds.hashes) + 1))
        self.words = [np.unique(words) for words in items]


def _word_counts(seeds: Seeds):
    """(seed, documents of this task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(seeds.hashes), np.int64)
        for _, data, offsets in common.blocks(batches):
            words, texts = word_hashes(data, offsets)
            if len(words) and len(count):
                place, number = seeds.find(words)
                held = np.unique(texts[place] * len(count) + number)
                count += np.bincount(held % len(count), minlength=len(count))
        seed = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(seed.astype(np.int32)), pa.array(count[seed])], names=["seed", "n"])

    return run


def _candidates(rare: Rare, n_items: int, texts: np.ndarray, place: np.ndarray, number: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, first and end word) around ``need`` rare words within reach of each other, overlapping ones merged."""
    times = rare.starts[number + 1] - rare.starts[number]
    place, number, times = place[times > 0], number[times > 0], times[times > 0]
    heads = common.first_of_runs(texts[place])
    before = np.concatenate(([0], np.cumsum(times)))
    at = 0
    while at < len(heads):  # whole texts, of about STEP entries
        stop = max(at + 1, int(np.searchsorted(before[heads], before[heads[at]] + STEP, side="right")) - 1) if before[-1] - before[heads[at]] > STEP else len(heads)
        low, high = heads[at], heads[stop] if stop < len(heads) else len(place)
        at = stop
        some = times[low:high]
        where = np.repeat(place[low:high], some)
        inner = np.arange(len(where)) - np.repeat(np.cumsum(some) - some, some)
        item = rare.items[np.repeat(rare.starts[number[low:high]], some) + inner]
        key = texts[where] * n_items + item
        order = np.argsort(key, kind="stable")
        key, where, item = key[order], where[order], item[order]
        last = np.arange(len(key)) + rare.need[item] - 1
        inside = last < len(key)
        last[~inside] = 0
        close = np.flatnonzero(inside & (key[last] == key) & (where[last] - where < rare.span[item]))
        if not len(close):
            continue
        own, begin = key[close], where[close]
        reach = rare.span[item[close]]
        apart = np.concatenate(([True], (own[1:] != own[:-1]) | (begin[1:] - begin[:-1] > reach[1:])))
        group = np.flatnonzero(apart)
        for a, b in zip(group, np.append(group[1:], len(close)), strict=True):
            span, which = int(reach[a]), int(item[close[a]])
            for first in range(int(begin[a]), int(begin[b - 1]) + 1, 4 * span):  # a long run in pieces; every alignment lies whole in one
                until = min(first + 4 * span - 1, int(begin[b - 1]))
                yield int(texts[begin[a]]), which, first - span + 1, until + span


def _score(seeds: Seeds, rare: Rare, items: list[np.ndarray], ids: list[int], least: float):
    """Documents x items that share enough rare words, aligned where these lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.blocks(batches):
            words, texts = word_hashes(data, offsets)
            if not len(words) or not len(seeds.hashes):
                continue
            first_word = np.searchsorted(texts, np.arange(rows.num_rows + 1))
            row, item, passage, begin = [], [], [], []
            for text, which, low, high in _candidates(rare, len(items), texts, *seeds.find(words)):
                low, high = max(low, int(first_word[text])), min(high, int(first_word[text + 1]))
                part, own = words[low:high], rare.words[which]
                number = np.searchsorted(own, part)
                number[number == len(own)] = 0
                sums = np.concatenate(([0], np.cumsum(own[number] == part)))
                span = min(int(rare.span[which]), len(part))
                if (sums[span:] - sums[: len(sums) - span]).max() >= rare.match[which]:
                    row.append(text)
                    item.append(which)
                    passage.append(part)
                    begin.append(low - int(first_word[text]))
            if not row:
                continue
            score, end = align([items[x] for x in item], passage)
            good = np.flatnonzero(score >= least)
            if len(good):
                at = pa.array([row[g] for g in good], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"].take(at), rows["row_key"].take(at), pa.array([ids[item[g]] for g in good], pa.int64()), pa.array(score[good]), pa.array([begin[g] + int(end[g]) for g in good], pa.int64())],
                    names=["doc_id", "row_key", "item_id", "score", "end_word"],
                )

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", gram: int = GRAM, least: float = LEAST) -> DataFrame:
    """Contaminated documents with their items: doc_id, row_key, item_id, score, end_word (the best passage's last word)."""
    spark = docs.sparkSession
    common.small_batches(spark)
    keyed = common.with_row_key(docs, id_col, text_col)
    named = benchmark.select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text_col).alias("words")).where("item is not null and words is not null")
    passes = max(1, -(-named.count() // BLOCK_ITEMS))
    ddl = "doc_id bigint, row_key bigint, item_id bigint, score double, end_word bigint"
    results = []
    for number in range(passes):
        block = named.where(F.pmod(F.xxhash64("item", "words"), F.lit(passes)) == number).collect()  # about BLOCK_ITEMS rows
        items = item_words([r["words"] for r in block])
        ids = [r["item"] for r in block]
        seeds = Seeds(items)
        counted = keyed.mapInArrow(_word_counts(seeds), "seed int, n bigint").groupBy("seed").agg(F.sum("n").alias("n"))
        frequency = np.zeros(len(seeds.hashes), np.int64)
        for r in counted.collect():  # one row per word of the block at most
            frequency[r["seed"]] = r["n"]
        rare = Rare(seeds, items, frequency, gram, least)
        results.append(keyed.mapInArrow(_score(seeds, rare, items, ids, least), ddl))
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    best = found.groupBy("doc_id", "row_key", "item_id").agg(F.max(F.struct("score", "end_word")).alias("_b"))
    return best.select("doc_id", "row_key", "item_id", F.col("_b.score").alias("score"), F.col("_b.end_word").alias("end_word"))
