"""Tokens and shards against the libraries, URL rules against brute force, languages on held-out rows, the pipeline."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from projectpulse.llm import decontamination, language_id, line_dedup, sentence_pieces, token_files, url_filters
from projectpulse.llm.queries import BYTE_TOKENIZER, PIECE_MODEL, URL_RULES
from projectpulse.skew import new_folder
from tests_llm_helpers import brute_lines, components_of, odd_texts, shingles, words  # noqa: F401

DOCS = "doc_id bigint, text string, ids string, part int"


def spaced(words, seed):
    source = random.Random(seed)
    gaps = [" ", " ", " ", "  ", "   ", "\n", " \n", "\n ", "\t", "\u00a0", "\u3000 ", " \u2003", "\x85", "\x1c ", "▁", " ▁", "\u200b"]
    pieces = [*words[:80], "It's", "we'll", "x1y2", "été", "naïve", "日本", "🙂", "...", "'s", "--", "<|endoftext|>", "<s>", "\u0301"]
    return ["".join(source.choice(gaps) + source.choice(pieces) for _ in range(source.randint(0, 80))) for _ in range(150)]


def test_sentence_pieces_equal_the_library(spark, words, odd_texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    assert sentence_pieces.words_stand_alone(library)
    texts = odd_texts + spaced(words, 1)
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "a b", "x", 1)], DOCS).repartition(3)
    got = sentence_pieces.decode(sentence_pieces.encode(rows, PIECE_MODEL), PIECE_MODEL).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        ids = library.encode(("a b" if r.doc_id is None else texts[r.doc_id]) or "")
        assert list(r.ids) == ids and r.decoded_text == library.decode(ids)
    assert sentence_pieces.encode(rows.limit(0), PIECE_MODEL).count() == 0


def test_a_full_word_table_starts_anew(words):
    table = sentence_pieces.WordTable(PIECE_MODEL, limit=10)
    texts = [" ".join(words[i : i + 7]) for i in range(0, 200, 5)]
    assert [np.frombuffer(x, np.int32).tolist() for x in table.encode(texts)] == table.processor.encode(texts)
    assert [np.frombuffer(table.encode([t])[0], np.int32).tolist() for t in texts] == table.processor.encode(texts)
    assert len(table.ids) <= 10


@pytest.mark.parametrize("size,top", [(0, 1), (1, 0), (1, 7), (1000, 2), (9000, 50256), (5000, 70000)])
def test_wavelet_matrix(size, top):
    ids = np.random.default_rng(size + top).integers(0, top + 1, size) // np.random.default_rng(1).integers(1, 9, size)
    matrix = token_files.WaveletMatrix.build(ids.astype(np.uint32))
    assert np.array_equal(matrix.decode(), ids)
    for at in range(0, size, 97):
        assert matrix.access(at) == ids[at]
    for symbol in [0, 1, 2, int(ids[-1]) if size else 3, top + 5, 1 << 20]:
        assert matrix.count(symbol) == int((ids == symbol).sum())
        assert matrix.count(symbol, size // 3, size // 2) == int((ids[size // 3 : size // 2] == symbol).sum())
        assert matrix.positions(symbol) == np.flatnonzero(ids == symbol).tolist()


def test_token_files_round_trip(spark, words, odd_texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_TOKENIZER)
    texts = odd_texts + spaced(words, 2)
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    rows = spark.createDataFrame([(3 * i, texts[i], "x", 9) for i in order] + [(None, "null id", "x", 9), (6, texts[2], "x", 9)], DOCS).repartition(4)
    folder = new_folder(spark, "shards")
    token_files.write_shards(rows, folder, BYTE_TOKENIZER, end_id=0, shard_tokens=700)
    got = sorted(token_files.read_shards(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, *sorted([3 * i for i in order] + [6])]
    start = 0
    for r in got:
        ids = [*library.encode("null id" if r.doc_id is None else texts[r.doc_id // 3] or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, np.frombuffer(bytes(r.tokens), "<u4").tolist()) == (start, len(ids), ids)
        start += len(ids)
    shards = spark.read.parquet(folder).collect()
    assert len(shards) > 5 and sum(s.n_tokens for s in shards) == start
    matrix = token_files.WaveletMatrix(shards[0].n_tokens, shards[0].zeros, shards[0].planes, shards[0].ranks)
    assert matrix.count(0) >= shards[0].n_docs  # every text ends with 0
    folder = new_folder(spark, "shards")
    token_files.write_shards(rows.limit(0), folder, BYTE_TOKENIZER)
    assert token_files.read_shards(spark, folder).count() == 0


URLS = [
    None, "", "no scheme", "http://", "http://NET", "https://a.Net/x?y#z", "http://net/", "http://xnet/", "http://a.example.net/en/1", "http://example.net/EN/1", "http://example.net/en", "x://y://net/",
    "http://example.com/de/", "http://www.EXAMPLE.com/de/a?b", "http://org/fr/x", "http://a.b.org/fr/#q", "http://a.org?fr/", "http://user@example.com/de/", "http://example.com:80/de/", "http://ÄNET.net/", "http://.net/", "ftp://a.net//en/", "http://a.net\n/x",
]


def brute_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    best = None
    for text, verdict in URL_RULES:
        at, _, rest = text.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + rest) and (best is None or len(text) > len(best[0])):
            best = (text, verdict)
    return (host, path, *(best or (None, "allow")))


def test_url_rules_equal_brute_force(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(0, None, "x", "y"), (None, "http://net/", "x", "y")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, token string")
    rules = url_filters.rule_table(spark, [url_filters.parse_rule(*r) for r in URL_RULES])
    got = url_filters.judge_urls(pages, rules)
    assert got.columns == ["page_id", "url", "token", "host", "path", "rule", "verdict"]
    assert sorted(map(str, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()))) == sorted(map(str, ((i, *brute_verdict(u)) for i, u, *_ in rows)))
    assert url_filters.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filters.judge_urls(pages, url_filters.rule_table(spark, [])).collect()} == {"allow"}


def test_url_rule_without_a_whole_token_and_ties(spark):
    rules = [url_filters.parse_rule("/ab", "block"), url_filters.parse_rule("a/bb", "block"), url_filters.parse_rule("a/b", "allow")]
    assert rules[0]["tokens"] == [url_filters.ANY]
    pages = spark.createDataFrame([("http://q/abc",), ("http://q/a",), ("http://x.a/bbb",), ("http://a/bc",)], "url string")
    got = {r.url: (r.rule, r.verdict) for r in url_filters.judge_urls(pages, url_filters.rule_table(spark, rules)).collect()}
    assert got == {"http://q/abc": ("/ab", "block"), "http://q/a": (None, "allow"), "http://x.a/bbb": ("a/bb", "block"), "http://a/bc": ("a/b", "allow")}


def test_url_rules_look_for_hosts_in_the_host_only(spark):
    """A path that holds a fitting host, as in proxy and archive addresses, fits no rule."""
    urls = ["http://mirror.org/www.example.com/de/x", "http://x.com/www.y.org/fr/", "http://x.com/a.net/", "http://www.example.com/de/x", "http://www.y.org/fr/"]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    rules = url_filters.rule_table(spark, [url_filters.parse_rule(*r) for r in URL_RULES])
    got = {r.url: (r.rule, r.verdict) for r in url_filters.judge_urls(pages, rules).collect()}
    assert got == dict(zip(urls, [(None, "allow")] * 3 + [("example.com/de/", "block"), ("org/fr/", "allow")], strict=True))
    for r in URL_RULES:
        assert not any(re.search(url_filters.parse_rule(*r)["pattern"], u.removeprefix("http://")) for u in urls[:3])


SYLLABLES = {"en": ["the", "ing", "wh", "tion", "ed"], "de": ["sch", "ung", "ein", "üb", "ich"], "fr": ["eau", "que", "ai", "ment", "è"], "es": ["ció", "ñ", "ar", "los", "ez"]}


def prose(source, lang, n):
    return " ".join("".join(source.choices(SYLLABLES[lang], k=source.randint(1, 4))) for _ in range(n))


def test_language_on_held_out_rows_and_evidence(spark):
    source = random.Random(6)
    train = [(i, prose(source, lang, 60), lang) for i, lang in enumerate(list(SYLLABLES) * 40)]
    names, logs = language_id.fit_trigrams(spark.createDataFrame(train, "doc_id bigint, text string, lang string"), "doc_id", "text", "lang", sample_rows=100)
    assert names == sorted(SYLLABLES)
    rows = [(f"{lang}{i}", prose(source, lang, 20), None, f"h{i % 3}", "") for lang in SYLLABLES for i in range(30)]
    rows += [(f"told{i}", None, "de-AT", "quiet", "") for i in range(2)] + [("junk", "qqxjq zzkx wvvq " * 20, "en", "h0", ""), ("junk2", "0101 %% ## 99", None, "h0", "")]
    rows += [(f"host{i}", prose(source, "fr", 30), None, "site.fr", "fr") for i in range(60)] + [("quiet", "", None, "site.fr", "fr"), ("quiet2", None, None, "other.fr", "fr"), ("alone", None, "xx", None, None)]
    table = spark.createDataFrame(rows, "name string, text string, told string, host string, suffix string").repartition(3)
    args = (F.col("name"), F.col("text"), F.col("told"), F.col("host"), F.col("suffix"))
    got = {r.key: r for r in language_id.identify(table, names, logs, *args).collect()}
    assert len(got) == len(rows)
    right = [got[f"{lang}{i}"].language == lang and got[f"{lang}{i}"].kept for lang in SYLLABLES for i in range(30)]
    assert np.mean(right) >= 0.99
    assert got["told0"].language == "de" and got["quiet"].language == "fr" and got["quiet2"].language == "fr"
    assert got["junk"].language == "other" and not got["junk"].kept
    assert got["alone"].language in [*names, "other"]
    assert language_id.identify(table.limit(0), names, logs, *args).count() == 0
    none, empty = language_id.fit_trigrams(table.limit(0).withColumn("doc_id", F.lit(1)), "doc_id", "text", "told")
    assert none == [] and {r.language for r in language_id.identify(table, none, empty, *args).collect()} == {"other"}


def test_pipeline_equals_brute_force(spark, words, tmp_path):
    """Every stage against plain Python over its own input."""
    import sentencepiece

    source = random.Random(12)
    items = [(i, prose(source, "en", 40)) for i in range(5)]
    rows = [(i, "\n".join(prose(source, lang, 30) for _ in range(3)), lang, "s1", 0) for i, lang in enumerate(list(SYLLABLES) * 15)]
    line = prose(source, "de", 15)
    rows = [(i, t + "\n" + line if i % 4 == 1 else t + "\n" + items[i % 5][1] if i % 10 == 4 else t, lang, s, n) for i, t, lang, s, n in rows]
    rows += [(100 + i, rows[i][1], rows[i][2], "s2", 0) for i in range(0, 20, 3)] + [(200, "qqxjq zzkx wvvq " * 30, None, "s1", 0), (201, "", "en", "s1", 0), (202, None, "fr", None, None), (None, prose(source, "es", 40), "es", "s1", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "sentence_pieces":
            assert out.columns == corpus_pipeline.COLUMNS
        seen[name] = [tuple(r) for r in out.collect()]
        folder = f"{tmp_path}/{name}"
        out.write.parquet(folder)
        docs = spark.read.parquet(folder)
    assert {r[0] for r in rows} - {r[0] for r in seen["language_id"]} == {200}
    lines = {(i, t) for i, _, _, t in brute_lines([(r[0], r[1]) for r in seen["language_id"]])}
    assert {(r[0], r[1]) for r in seen["line_dedup"]} == lines
    named = {r[0]: shingles(r[1]) for r in seen["line_dedup"] if r[0] is not None}
    links = [(a, b) for a in named for b in named if a < b and named[a] and named[b] and 100 * len(named[a] & named[b]) >= 75 * len(named[a] | named[b])]
    root = components_of(sorted(named), links)
    assert {r[0] for r in seen["minhash_dedup"]} == {i for i in named if root[i] == i} | {None} and links
    leaks = {i for i in named if root[i] == i and any(t in dict((r[0], r[1]) for r in seen["line_dedup"])[i] for _, t in items)}
    assert leaks and {r[0] for r in seen["decontamination"]} == {r[0] for r in seen["minhash_dedup"]} - leaks
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    texts = {r[0]: r[1] for r in seen["decontamination"]}
    assert len(seen["sentence_pieces"]) == len(texts)
    for i, n, ids, digest in seen["sentence_pieces"]:
        expected = library.encode(texts[i] or "")
        assert list(ids) == expected and n == len(expected) and digest == hashlib.sha256(library.decode(expected).encode()).hexdigest()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(texts)
    assert decontamination.GRAM == 4 and line_dedup.FILTER_BITS == 1 << 26
