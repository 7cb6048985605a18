"""Near-duplicates of texts and vectors, and decontamination, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from projectpulse.components import star_components
from projectpulse.llm import common, decontamination, metric_join, minhash_forest
from tests_llm_helpers import components_of, odd_texts, shingles, words  # noqa: F401


@pytest.mark.parametrize("order", [1, -1])
def test_star_components_of_long_chains(spark, order):
    names = list(range(200))[::order]
    edges = list(zip(names, names[1:])) + [(500, 501), (501, 500), (7, 7), (None, 3)]
    got = {r.node: r.component for r in star_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: 0 for n in range(200)} | {500: 500, 501: 500}


def test_hashes_follow_the_words():
    texts = ["a bb  a", "", "bb a", "a bb a"]
    data, offsets = common.text_bytes(pa.array(texts))
    starts, ends, owner = common.word_spans(data, offsets)
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends)] == ["a", "bb", "a", "bb", "a", "a", "bb", "a"]
    assert list(owner) == [0, 0, 0, 2, 2, 3, 3, 3]
    hashes = common.span_hashes(data, starts, ends)
    assert hashes[0] == hashes[2] == hashes[4] != hashes[1] and hashes[1] == hashes[3]
    pairs = common.window_hashes(hashes, 2)
    assert pairs[1] == pairs[3] and pairs[0] == pairs[5] != pairs[1]


def near_copies(words, seed):
    source = random.Random(seed)
    docs = []
    for _ in range(25):
        base = [source.choice(words) for _ in range(source.randint(3, 150))]
        docs.append(" ".join(base))
        for _ in range(source.choice([0, 0, 1, 3, 12])):
            copy = list(base)
            for _ in range(source.randint(0, max(1, len(base) // 25))):
                copy[source.randrange(len(copy))] = source.choice(words)
            docs.append(" ".join(copy).upper() if source.random() < 0.3 else "\n".join(copy))
    hot = [source.choice(words) for _ in range(120)]  # a crowd of near copies
    for _ in range(80):
        copy = list(hot)
        for _ in range(source.randint(0, 3)):
            copy[source.randrange(len(copy))] = source.choice(words)
        docs.append(" ".join(copy))
    docs += [docs[0]] * 30
    source.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", range(2))
def test_minhash_forest_equals_brute_force(spark, words, odd_texts, seed):
    rows = [(1000 - i, t, i, "n", 1) for i, t in enumerate(near_copies(words, seed) + odd_texts)]
    sets = {i: shingles(t) for i, t, *_ in rows}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = components_of(ids, links)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_shingles int, kept string, alike int").repartition(4)
    got = minhash_forest.near_duplicates(docs).collect()
    assert len(got) == len(rows) and len(links) > 500
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root[r.doc_id], root[r.doc_id] == r.doc_id)


def test_minhash_forest_null_ids_repeated_rows_and_borders(spark, words):
    text = " ".join(words[:40])
    rows = [(None, text), (5, text), (5, text), (5, " ".join(words[50:90])), (9, " ".join(words[50:90])), (None, None)]
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(None, 36, None, True), (5, 36, 5, True), (9, 36, 5, False), (None, 0, None, True)}
    assert minhash_forest.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_neighbours_meet_across_borders(spark):
    """One region spread over many partitions gives the pairs that one partition gives."""
    rows = [(1, i // 3, 0, 0, 0, 50, i) for i in range(90)]
    entries = spark.createDataFrame(rows, minhash_forest.ENTRY_DDL)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pairs = {(r.a, r.b) for r in minhash_forest._propose(entries, 75).where("alike is not null").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {b for _, b in pairs} == set(range(1, 90))


def brute_vectors(rows, least=0.9):
    ok = {}
    for n, (_, v) in enumerate(rows):
        if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(np.array(v, np.float32)):
            ok[n] = np.array(v, np.float32).astype(float)
    links = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= least]
    return ok, links


@pytest.mark.parametrize("cell,block", [(2000, 4096), (20, 16)])
def test_metric_join_equals_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(metric_join, "CELL_ROWS", cell)
    monkeypatch.setattr(metric_join, "BLOCK_ROWS", block)
    source = np.random.default_rng(4)
    rows = []
    for _ in range(60):
        base = source.normal(size=8)
        for _ in range(source.integers(1, 6)):
            rows.append((base + source.normal(size=8) * source.choice([0.0, 0.1, 0.35])) * source.uniform(0.1, 9))
    rows += [rows[0]] * 25
    rows = [(1000 - i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [1.0, None] * 4), (2004, [float("nan")] * 8), (2005, [float("inf")] * 8), (2006, [1.0, 0.0]), (2007, [1.0, -0.0]), (None, rows[0][1]), (2008, [-0.0] * 8)]
    ok, links = brute_vectors([r for r in rows if r[0] is not None])
    named = [r for r in rows if r[0] is not None]
    degree = {i: 0 for i, _ in named}
    for a, b in links:
        degree[named[a][0]] += 1
        degree[named[b][0]] += 1
    root = components_of([i for i, _ in named], [(named[a][0], named[b][0]) for a, b in links])
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<float>, links int, cell int").repartition(3)
    got = metric_join.link_vectors(table).collect()
    assert len(got) == len(rows) and len(links) > 300
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        else:
            assert (r.n_links, r.component_id, r.kept) == (degree[r.vec_id], root[r.vec_id], root[r.vec_id] == r.vec_id)


def test_metric_join_empty_and_repeated_ids(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert metric_join.link_vectors(empty).count() == 0
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])]
    got = sorted((r.vec_id, r.component_id) for r in metric_join.link_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect())
    assert set(got) == {(1, 1), (2, 1), (3, 3)}


def smith_waterman(item, passage):
    best = 0
    table = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (2 if item[i - 1] == passage[j - 1] else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
            best = max(best, table[i][j])
    return best / (2 * len(item))


def test_alignment_equals_the_plain_one():
    source = random.Random(2)
    pairs = [([source.randint(1, 9) for _ in range(source.randint(4, 30))], [source.randint(1, 9) for _ in range(source.randint(1, 60))]) for _ in range(200)]
    score, _ = decontamination.align([np.array(a, np.uint64) for a, _ in pairs], [np.array(b, np.uint64) for _, b in pairs])
    assert np.allclose(score, [smith_waterman(a, b) for a, b in pairs])


def plain_words(text):
    table = {c: " " for c in range(33, 127) if not chr(c).isalnum()} | {c: c + 32 for c in range(65, 91)}
    return (text or "").translate(table).split()


def test_decontamination_finds_edited_copies_and_leaves_clean_texts(spark, words, odd_texts):
    source = random.Random(8)
    fresh = lambda n: [source.choice(words) for _ in range(n)]
    items = [(i, " ".join(fresh(source.randint(15, 60)))) for i in range(12)] + [(50, "the a"), (51, None), (None, "x y z u v"), (52, "")]
    rows, dirty = [], set()
    for i in range(120):
        text = fresh(source.randint(0, 200))
        if i % 3 == 0:
            item, copy = i % 12, items[i % 12][1].split()
            for _ in range(len(copy) // 8 if i % 2 else 0):  # edits
                copy[source.randrange(len(copy))] = source.choice(words)
            at = source.randint(0, len(text))
            text = text[:at] + [w.capitalize() + source.choice(["", ",", "."]) for w in copy] + text[at:]
            dirty.add((i, item))
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, t) for i, t in enumerate(odd_texts)] + [(None, items[0][1]), (0, rows[0][1])]
    docs = spark.createDataFrame([(i, t, 1, 2.0) for i, t in rows], "doc_id bigint, text string, item_id int, score double").repartition(3)
    table = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, doc_id int")
    got = decontamination.contaminated(docs, table).collect()
    assert {(r.doc_id, r.item_id) for r in got} == dirty | {(None, 0)}
    by_id, named = dict(rows), dict(items)
    for r in got:
        if r.doc_id is not None:
            assert abs(r.score - smith_waterman(plain_words(named[r.item_id]), plain_words(by_id[r.doc_id]))) < 1e-9
    assert decontamination.contaminated(docs, table.limit(0)).count() == 0
    assert decontamination.contaminated(docs.limit(0), table).count() == 0


def test_decontamination_in_several_passes(spark, words, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 2)
    items = [(i, " ".join(words[20 * i : 20 * i + 20])) for i in range(6)]
    docs = spark.createDataFrame([(i, "zz " * i + t) for i, t in items], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.score) for r in decontamination.contaminated(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {(i, i, 1.0) for i in range(6)}


def test_decontamination_equals_alignment_of_all_pairs(spark, words):
    """Copies with 10 to 30 % of the words edited, once or several times alike, and with every 5th word replaced."""
    source = random.Random(21)
    items = [(i, " ".join(source.choice(words) for _ in range(source.randint(14, 45)))) for i in range(10)]
    texts = []
    for n in range(60):
        copy = items[n % 10][1].split()
        if n < 10:
            copy = [f"new{n}x{p}" if p % 5 == 0 else w for p, w in enumerate(copy)]
        else:
            for _ in range(round(len(copy) * (0.1, 0.2, 0.3)[n % 3])):
                at, edit = source.randrange(len(copy)), source.choice("rid")
                copy[at : at + (edit != "i")] = [] if edit == "d" else [source.choice(words)]
        around = [[source.choice(words) for _ in range(source.randint(0, 80))] for _ in range(2)]
        texts += [" ".join(around[0] + copy + around[1])] * (3 if n % 4 == 0 else 1)
    texts.append(" ".join(w + " x y" * (n % 2) for n, w in enumerate(items[0][1].split())))  # words put in between leave no 4-gram
    expected = {}
    for d, text in enumerate(texts):
        for i, item in items:
            score = smith_waterman(item.split(), text.split())
            if score >= 0.5:
                expected[d, i] = score
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert len(expected) > 70 and got == expected


def test_decontamination_ignores_case_and_punctuation_of_all_scripts(spark):
    items = [(1, "Él niño ñandú corrió árbol último café jamás"), (2, "straße über größe ähnlich öfter mühe"), (3, "один два три четыре пять шесть")]
    docs = [(1, "x É " + items[0][1].upper()), (2, "x " + items[1][1].upper()), (3, "«" + "» — «".join(w.title() for w in items[2][1].split()) + "»…"), (4, "\u00a0".join(f"“{w}”" for w in items[0][1].split())), (5, "él один über"), (6, "İx ẞ. " + items[2][1].upper())]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.score) for r in decontamination.contaminated(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0), (4, 1, 1.0), (6, 3, 1.0)}
