"""Quality rules, spelling variants and collocations against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from projectpulse.llm import collocations, quality_rules, spelling_variants
from tests_llm_helpers import odd_texts, words  # noqa: F401

SCHEMA = "doc_id bigint, text string, lang string, n bigint, word string, failed int, kept boolean, w0 string, lines int"  # names that results use too
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "x", 2, True, "y", 3) for i, t, lang in rows], SCHEMA).repartition(3)


def prose(words, seed, n_docs):
    """Documents with repeated lines and phrases, misspellings, whole copies."""
    source = random.Random(seed)
    common = [" ".join(source.choice(words) for _ in range(k)) for k in (2, 3, 4, 5)]
    docs = []
    for _ in range(n_docs):
        parts = []
        for _ in range(source.randint(1, 12)):
            parts += [source.choice(words) for _ in range(source.randint(0, 9))]
            parts.append(source.choice(common))
            parts.append(source.choice([",", ".", "\n", "\n", "# *", "é;"]))
        docs.append(" ".join(parts))
    return docs + docs[:4] + ["same line here\n" * 30, "a b c " * 40]


# ---- quality rules


def brute_measures(text):
    text = text or ""
    own = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return (
        len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered),
        sum(any(c.isalpha() for c in w) for w in own),
    )


def test_measures_are_those_of_brute_force(spark, words, odd_texts):  # noqa: F811
    rows = [(i if i != 3 else None, t, "en") for i, t in enumerate(odd_texts + prose(words, 1, 40))]
    rows += [rows[20], rows[20]]
    found = quality_rules.measure(frame(spark, rows)).collect()
    expected = sorted([(i is None, i or 0, *brute_measures(t)) for i, t, _ in rows])
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, *[r[m] for m in quality_rules.MEASURES]) for r in found) == expected


def test_a_long_text_is_measured_whole(spark, words):  # noqa: F811
    source = random.Random(2)
    text = " ".join(source.choice(words) for _ in range(400_000)) + "\nlast words\nlast words"
    found = quality_rules.measure(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert tuple(found[m] for m in quality_rules.MEASURES) == brute_measures(text)


def test_policies_and_ablations_follow_the_bits(spark, words):  # noqa: F811
    rows = [(i, t, "en") for i, t in enumerate(prose(words, 3, 60) + [None, "short"])]
    kept = quality_rules.ledger(frame(spark, rows))
    bits = {r["doc_id"]: r["failed"] for r in kept.collect()}
    names = {rule.name: 1 << rule.bit for rule in quality_rules.RULES}
    for i, t, _ in rows:
        n, chars, symbols, lines, dup, rep, letters = brute_measures(t)
        wrong = {
            "few_words": n < 50, "repeated_windows": 100 * rep > 50 * n, "word_length": chars < 3 * n or chars > 10 * n, "symbols": 10 * symbols > n,
            "few_letters": 100 * letters < 80 * n, "repeated_lines": dup >= 3 and 100 * dup > 30 * lines,
        }
        assert bits[i] == sum(names[k] for k, v in wrong.items() if v)
    for r in quality_rules.apply_policies(kept).collect():
        own = {name for name in quality_rules.POLICIES[r["policy"], r["version"]] if bits[r["doc_id"]] & names[name]}
        assert set(r["failed_rules"]) == own and r["kept"] == (not own)
    for r in quality_rules.ablations(kept).collect():
        mask = quality_rules.mask_of(quality_rules.POLICIES[r["policy"], r["version"]])
        own = names[r["rule"]]
        assert r["n_docs"] == len(rows)
        assert r["n_kept"] == sum(not b & mask for b in bits.values())
        assert r["n_failed"] == sum(bool(b & own) for b in bits.values())
        assert r["n_failed_alone"] == sum(b & mask == own for b in bits.values())
    groups = quality_rules.profile(kept.withColumn("g", F.col("doc_id") % 2), ["g"]).collect()
    for r in groups:
        mine = [b for i, b in bits.items() if i % 2 == r["g"]]
        assert set(r["ever"]) == {k for k, v in names.items() if any(b & v for b in mine)}
        assert set(r["always"]) == {k for k, v in names.items() if all(b & v for b in mine)}


def test_bits_of_rules_differ_and_versions_name_known_rules():
    bits = [rule.bit for rule in quality_rules.RULES]
    assert len(set(bits)) == len(bits)
    assert all(quality_rules.mask_of(names) for names in quality_rules.POLICIES.values())
    assert quality_rules.newest("prose") == ("prose", 2)


def test_rules_run_no_python_on_the_executors(spark, words):  # noqa: F811
    plan = quality_rules.ledger(frame(spark, [(1, "a", "en")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- spelling variants


def brute_words(rows):
    counts = Counter()
    for i, t, _ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5}


def single_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    p = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else (a[p + 1 :] == b[p:] if len(a) > len(b) else a[p:] == b[p + 1 :])


def brute_variants(rows, least=3):
    n = {w: k for w, k in brute_words(rows).items() if k >= least}
    near = {w: [v for v in n if single_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def misspelt(seed, n_docs):
    source = random.Random(seed)
    stems = ["".join(source.choice("abcdeéüñ×") for _ in range(source.randint(4, 9))) for _ in range(60)]
    heads = ["inter" + "".join(source.choice("abc") for _ in range(source.randint(1, 4))) for _ in range(80)]  # one hot half
    docs = []
    for _ in range(n_docs):
        out = []
        for _ in range(60):
            w = source.choice(stems[:6] if source.random() < 0.4 else stems + heads)
            if source.random() < 0.2:
                k = source.randrange(len(w))
                w = source.choice([w[:k] + w[k + 1 :], w[:k] + source.choice("abcde") + w[k + 1 :], w[:k] + source.choice("abé") + w[k:]])
            out.append(source.choice([w, w.upper(), w.capitalize()]))
        docs.append(source.choice([" ", ", ", "-", "’"]).join(out))
    return docs


@pytest.mark.parametrize("tile", [256, 3])
def test_variants_are_those_of_all_pairs(spark, odd_texts, tile):  # noqa: F811
    rows = [(i if i != 5 else None, t, "en") for i, t in enumerate(misspelt(4, 60) + odd_texts)]
    rows += rows[:3]
    found = spelling_variants.variants(frame(spark, rows), tile_words=tile)
    assert sorted((tuple(r) for r in found.collect())) == brute_variants(rows)


def test_long_texts_and_words_keep_their_borders(spark):
    text = "x" * 3_000_000 + " " + "letters " * 400_000 + "é" * 40
    rows = [(1, text, "en"), (2, "é" * 39 + " " + "é" * 40, "de")] * 2 + [(3, "é" * 39 + " " + "é" * 40, "de")]
    found = spelling_variants.count_words(frame(spark, rows)).collect()
    assert {r["word"]: r["n"] for r in found} == brute_words(rows)


def test_no_words_no_variants(spark):
    assert spelling_variants.variants(frame(spark, [])).collect() == []
    assert spelling_variants.variants(frame(spark, [(1, None, None), (None, "ab 12", "")])).collect() == []


def test_checksums_of_spans():
    data = np.frombuffer(b"alpha beta g", np.uint8)
    starts, ends = np.array([0, 6, 11]), np.array([5, 10, 12])
    before = np.array([zlib.crc32(b"7:"), zlib.crc32(b""), zlib.crc32(b"x")], np.uint32)
    assert spelling_variants._crc32(data, starts, ends, before).tolist() == [zlib.crc32(b"7:alpha"), zlib.crc32(b"beta"), zlib.crc32(b"xg")]


# ---- collocations


def brute_collocations(rows, least, top):
    f, totals = defaultdict(Counter), Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(UPPER)):
            own = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(own)
            for m in range(1, 5):
                f[lang].update(tuple(own[i : i + m]) for i in range(len(own) - m + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least}
        inside = Counter()
        for p, a in often.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        scored = []
        for p, a in often.items():
            if len(p) > 1 and not 100 * inside[p] >= 80 * a:
                score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("range_rows, top", [(200_000, 2000), (7, 25)])
def test_collocations_are_those_of_brute_force(spark, words, odd_texts, monkeypatch, range_rows, top):  # noqa: F811
    monkeypatch.setattr(collocations, "RANGE_ROWS", range_rows)
    source = random.Random(6)
    texts = prose(words[:40], 5, 80) + odd_texts + ["The of " * 50, "the\x01 x the\x01 x the x"] * 3
    rows = [(i, t, source.choice(["en", "de", None, "und", ""])) for i, t in enumerate(texts)]
    rows += [(None, *rows[4][1:]), *rows[:3]]
    found = collocations.collocations(frame(spark, rows), least=4, top=top)
    assert sorted(tuple(r) for r in found.collect()) == brute_collocations(rows, 4, top)


def test_long_texts_are_cut_between_pieces(spark, words):  # noqa: F811
    source = random.Random(8)
    text = " ".join(source.choice(words[:30]) + source.choice(["", "", "", ","]) for _ in range(700_000))
    rows = [(1, text, "en"), (2, "word " * 600_000, "en")]
    found = collocations.collocations(frame(spark, rows), least=30, top=100)
    assert sorted(tuple(r) for r in found.collect()) == brute_collocations(rows, 30, 100)


def test_filters_never_lose_a_key(spark):
    keys = spark.range(50_000).select(F.xxhash64("id").alias("key"))
    held = collocations._opened(collocations.broadcast_filter(keys))
    own = np.array([r["key"] for r in keys.collect()], np.int64).view(np.uint64)
    assert held.holds(own).all()
    assert held.holds(own * np.uint64(3) + np.uint64(1)).mean() < 0.02


def test_no_texts_no_phrases(spark):
    assert collocations.collocations(frame(spark, [])).collect() == []
    assert collocations.collocations(frame(spark, [(1, None, None), (2, "", "en")])).collect() == []
