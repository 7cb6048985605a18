"""Suffix, substring and line de-duplication against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from projectpulse.llm import common, line_dedup, substring_dedup, suffix_dedup
from tests_llm_helpers import brute_lines, odd_texts, words  # noqa: F401

SCHEMA = "doc_id bigint, text string, n_removed string, hits int, kept_text string"  # names that results use too


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(3)


def passages(words, seed, n_docs, copies):
    """Documents that share passages of many lengths, whole copies and self-repeats."""
    source = random.Random(seed)
    fresh = lambda n: [source.choice(words) for _ in range(n)]
    shared = [fresh(n) for n in (20, 49, 50, 51, 60, 75, 120, 200)]
    docs = []
    for _ in range(n_docs):
        parts = []
        for _ in range(source.randint(1, 4)):
            parts += fresh(source.randint(0, 40))
            if source.random() < 0.6:
                part = source.choice(shared)
                low = source.randint(0, len(part) // 3)
                parts += part[low : low + source.randint(20, len(part))]
        docs.append(" ".join(parts))
    docs += [docs[0]] * copies + [docs[1] + " " + docs[1], docs[2] * 2]
    source.shuffle(docs)
    return docs


# ---- suffix order


def linear_grouping(symbols):
    """General linear grouping, for comparison: groups by Lyndon prefix, then one emission (the last symbol is the smallest and alone)."""
    n = len(symbols)
    group = {i: (s,) for i, s in enumerate(symbols)}  # a group's name orders it
    prev = [-1] * n
    done = set()
    while True:
        left = [g for g in set(group.values()) if g not in done]
        if not left:
            break
        top = max(left)
        done.add(top)
        members = sorted(i for i in range(n) if group[i] == top)
        times = defaultdict(int)
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= top:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                times[j] += 1
        for j, count in times.items():  # the prefix grows by the group's word, count times
            group[j] = group[j] + top * count
    ranked = sorted(set(group.values()))
    buckets = {g: [i for i in range(n) if group[i] == g] for g in ranked}
    start, total = {}, 0
    for g in ranked:
        start[g] = total
        total += len(buckets[g])
    order, placed = [None] * n, set()
    order[0] = n - 1
    placed.add(n - 1)
    for at in range(n):
        if order[at] is None:
            only = [i for g in ranked if start[g] <= at for i in buckets[g] if i not in placed]
            order[at] = only[-1]
            placed.add(order[at])
        j = order[at] - 1
        while j >= 0 and j not in placed:
            order[start[group[j]]] = j
            start[group[j]] += 1
            placed.add(j)
            j = prev[j]
    return order


@pytest.mark.parametrize("seed", range(6))
def test_linear_grouping_sorts_suffixes(seed):
    source = random.Random(seed)
    symbols = [source.randint(1, 3) for _ in range(60)] + [0]
    assert linear_grouping(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@pytest.mark.parametrize("seed", range(4))
def test_columns_emit_the_order_of_linear_grouping(seed):
    """The coding of the module: symbols (column, byte) fall along a context, so groups are symbols."""
    source = random.Random(seed)
    rows = [[source.randint(1, 2) for _ in range(7)] for _ in range(9)]
    symbols = []
    for row in rows:
        symbols += [100 + 10 * (7 - c) + b for c, b in enumerate(row)] + [1]
    symbols[-1] = 0
    order = linear_grouping(symbols)
    by_column = np.arange(len(rows))
    for column in reversed(range(7)):
        if column < 6:
            by_column = by_column[np.argsort([rows[i][column] for i in by_column], kind="stable")]
        else:
            last = [i for i in order if i % 8 == 6]
            by_column = np.array([i // 8 for i in last])  # order of the borders, which hold no window
        assert [i // 8 for i in order if i % 8 == column] == list(by_column)


def brute_bytes(texts, width):
    data = [(t or "").encode() for t in texts]
    places = defaultdict(list)
    for i, d in enumerate(data):
        for p in range(len(d) - width + 1):
            places[d[p : p + width]].append((i, p))
    gone = [bytearray(len(d)) for d in data]
    for found in places.values():
        if len(found) > 1:
            for i, p in found:
                gone[i][p : p + width] = b"\1" * width
    return [(len(d), sum(g), len(re.findall(b"\1+", bytes(g))), bytes(x for x, out in zip(d, g, strict=True) if not out)) for d, g in zip(data, gone, strict=True)]


@pytest.mark.parametrize("seed", range(2))
def test_suffix_dedup_equals_brute_force(spark, words, odd_texts, seed):
    texts = passages(words, seed, 40, 6) + odd_texts + ["ä" * 300, "ß" + "ä" * 300, "ab" * 450]
    got = suffix_dedup.remove_repeated_bytes(frame(spark, enumerate(texts))).collect()
    expected = brute_bytes(texts, 400)
    assert len(got) == len(texts)
    for row in got:
        assert (row.n_bytes, row.n_removed, row.n_spans, bytes(row.kept_bytes)) == expected[row.doc_id]


def test_suffix_dedup_in_small_steps(spark, words, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "ORDER_ROWS", 5)
    texts = passages(words, 9, 30, 12)
    data, offsets = common.text_bytes(__import__("pyarrow").array(texts))
    assert len(suffix_dedup.anchors(data, offsets, 400)[0]) > 0
    contexts, found = [], suffix_dedup._Found()
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        for which, anchor, at, low, high in zip(*suffix_dedup.anchors(raw, np.array([0, len(raw)]), 400), strict=True):
            contexts.append((raw[low : high + 400].tobytes(), len(contexts), int(np.uint64(anchor).view(np.int64)), at - low, high - low + 1, low))
    arrays = [np.array([c[i] for c in contexts], np.int64) for i in range(1, 6)]
    suffix_dedup._settle_chained(found, [c[0] for c in contexts], *arrays, 400)
    counts = defaultdict(int)
    for c in contexts:
        for p in range(c[4]):
            counts[c[0][p : p + 400]] += 1
    marked = defaultdict(set)
    for key, spans in zip(found.rows["row_key"], found.rows["spans"], strict=True):
        for a, b in np.frombuffer(spans, np.int64).reshape(-1, 2):
            marked[key].update(range(a, b - 399))
    for c in contexts:
        assert marked[c[1]] == {c[5] + p for p in range(c[4]) if counts[c[0][p : p + 400]] > 1}


def test_suffix_dedup_repeated_rows_and_nulls(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(700))
    rows = [(1, text), (1, text), (None, text), (2, None), (None, None)]
    got = suffix_dedup.remove_repeated_bytes(frame(spark, rows)).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in got) == [(0, 0), (0, 0), (700, 700), (700, 700), (700, 700)]
    assert suffix_dedup.remove_repeated_bytes(frame(spark, [])).count() == 0


def test_suffix_dedup_spreads_a_hot_line(spark, words, monkeypatch):
    """No task gets all contexts of a line that many documents hold in different surroundings."""
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", 20)
    source = random.Random(31)
    fresh = lambda n: " ".join(source.choice(words) for _ in range(n))
    line = fresh(90)[:300]
    texts = [f"{fresh(90)} {line} {fresh(90)}" for _ in range(60)] + passages(words, 3, 20, 4)
    texts += [texts[0], "x" + texts[1][300:], texts[2][:900] + " end"]
    docs = frame(spark, enumerate(texts))
    dealt = suffix_dedup._dealt_contexts(common.with_row_key(docs, "doc_id", "text"), 400)
    assert max(r["count"] for r in dealt.where("kind = 0").groupBy("anchor").count().collect()) <= 20
    assert dealt.where("kind = 2").select("anchor").distinct().count() > 1
    expected = brute_bytes(texts, 400)
    for row in suffix_dedup.remove_repeated_bytes(docs).collect():
        assert (row.n_bytes, row.n_removed, row.n_spans, bytes(row.kept_bytes)) == expected[row.doc_id]


# ---- substrings


def brute_words(rows, width):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, ws in split:
        for p in range(len(ws) - width + 1):
            if i is not None:
                least[tuple(ws[p : p + width])] = min(i, least.get(tuple(ws[p : p + width]), i))
    out = []
    for i, ws in split:
        gone = set()
        for p in range(len(ws) - width + 1):
            if i is not None and least[tuple(ws[p : p + width])] < i:
                gone.update(range(p, p + width))
        out.append((i, len(ws), len(gone), " ".join(w for n, w in enumerate(ws) if n not in gone)))
    return out


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("seed", range(2))
def test_substring_dedup_equals_brute_force(spark, words, odd_texts, seed):
    rows = list(enumerate(passages(words, seed, 60, 5) + odd_texts))
    rows += [(None, rows[0][1]), (3, rows[3][1]), (3, rows[4][1])]  # null id, repeated row, one id with two texts
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeated_windows(frame(spark, rows)).collect()]
    assert by_id(got) == by_id(brute_words(rows, 50))
    assert substring_dedup.remove_repeated_windows(frame(spark, [])).count() == 0


def test_substring_dedup_spreads_a_hot_phrase(spark, words, monkeypatch):
    """Different windows around one frequent phrase do not all go to one range."""
    monkeypatch.setattr(substring_dedup, "HOT_WINDOWS", 400)
    source = random.Random(41)
    phrase = " ".join(words[:5])
    low = min((" ".join(source.choices(words, k=5)) for _ in range(3000)), key=lambda t: int(_phrase_hash(t)))
    rows = [(i, " ".join([*source.choices(words, k=60), low, *source.choices(words, k=60), phrase])) for i in range(80)]
    rows += [(100 + i, rows[i][1][50:]) for i in range(5)]
    docs = frame(spark, rows)
    hot = substring_dedup._hot_cells(common.with_row_key(docs, "doc_id", "text"), 50)
    assert len(hot)
    sizes = defaultdict(int)
    for batch in substring_dedup._hash_windows(50, 64, hot)(iter(common.with_row_key(docs, "doc_id", "text").toArrow().to_batches())):
        for r in batch.to_pylist():
            sizes[r["bucket"]] += len(r["hashes"]) // 8
    assert max(sizes.values()) < sum(sizes.values()) / 8
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeated_windows(docs).collect()]
    assert by_id(got) == by_id(brute_words(rows, 50))


def _phrase_hash(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = common.word_spans(raw, np.array([0, len(raw)]))
    return common.window_hashes(common.span_hashes(raw, starts, ends), 5)[0]


# ---- lines


@pytest.mark.parametrize("bits", [1 << 26, 64])  # a full filter only sends more suspects
def test_line_dedup_equals_brute_force(spark, words, odd_texts, bits):
    source = random.Random(3)
    lines = [" ".join(source.choice(words) for _ in range(n)) for n in (3, 8, 9, 10, 12, 20)] + ["ä" * 39, "ä" * 40, "Ä" * 40, "y" * 39, "y" * 40]
    rows = []
    for i in range(60):
        own = [source.choice([x, " " + x.upper() + "\t", x + "\r"]) for x in source.choices(lines, k=source.randint(0, 4))]
        own += [" ".join(source.choices(words, k=12)) for _ in range(2)]
        source.shuffle(own)
        rows.append((i, "\n".join(own)))
    rows += [(100 + i, t) for i, t in enumerate(odd_texts)] + [(None, lines[4]), (59, lines[4]), (7, rows[7][1])]
    got = line_dedup.drop_repeated_lines(frame(spark, rows), filter_bits=bits, carry=["hits"]).select("*", F.col("carried.hits").alias("h")).collect()
    assert by_id([(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got]) == by_id(brute_lines(rows))
    assert all(r.h == 1 for r in got) and sum(r.n_dropped for r in got) > 20
    assert line_dedup.drop_repeated_lines(frame(spark, [])).count() == 0
