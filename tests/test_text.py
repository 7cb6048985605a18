import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import rows
from projectpulse.functions import text as ft
from projectpulse.operators import text as X
from projectpulse.plans import reports

KEYS = "project_id string, run_id bigint, "
DOC = KEYS + "path string, text string"
CLAIM = KEYS + "claim_id string, text string, kind string, source_path string, line int"


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "text string").select(expression.alias("v")).first().v


def test_tokenize(spark):
    assert one(spark, "CodeAnalyzer code_analyzer HTTPServer2 an", ft.tokenize("text")) == ["code", "analyzer", "code", "analyzer", "http", "server2"]
    assert one(spark, "The user must want a JWT", ft.tokenize("text")) == ["jwt"]
    counts = one(spark, "beta alpha beta gamma beta", ft.term_counts(ft.tokenize("text")))
    assert [(r.term, r.n) for r in counts] == [("alpha", 1), ("beta", 3), ("gamma", 1)]
    assert one(spark, "", ft.term_counts(ft.tokenize("text"))) == []


README = """# My Project

Intro must not count? It must.

## Features

- Login with JWT
* Upload
- Login with JWT

- not this one

As a user, I want dashboards.
"""


def documents(spark):
    data = [("p", 1, "README.md", README, "readme"), ("p", 1, "requirements.txt", "PyYAML==6\n# c\n-r x.txt\nfast_api>=1\n\nnumpy", "dependency_manifest")]
    return spark.createDataFrame(data, DOC + ", kind string")


def test_intent(spark):
    docs = documents(spark)
    readme = docs.where("kind = 'readme'")
    assert one(spark, README, ft.extract_title("text")) == "My Project"
    assert [r.feature for r in X.feature_bullets(readme).orderBy("pos").collect()] == ["Login with JWT", "Upload", "Login with JWT"]
    assert rows(X.distinct_features(X.feature_bullets(readme)), "feature") == [("Login with JWT",), ("Upload",)]
    found = X.requirements(readme).orderBy("line").collect()
    assert [(r.line, r.text) for r in found] == [(3, "Intro must not count? It must."), (13, "As a user, I want dashboards.")]
    assert found[0].keywords == ["count", "intro"]
    assert rows(X.declared_packages(docs.where("kind = 'dependency_manifest'")), "package") == [("fast_api",), ("numpy",), ("pyyaml",)]
    merged = X.merge_intents(docs).first()
    assert (merged.project_title, merged.feature_count, merged.requirement_count, merged.package_count) == ("My Project", 2, 2, 3)


def test_dependency_mismatch(spark):
    schema = KEYS + "package string"
    declared = spark.createDataFrame([("p", 1, n) for n in ("pyyaml", "fast_api", "numpy")], schema)
    imported = spark.createDataFrame([("p", 1, n) for n in ("yaml", "Fast_API", "requests")] + [("q", 1, "flask")], schema)
    assert rows(X.dependency_mismatch(declared, imported), "project_id", "code", "name") == [
        ("p", "DECLARED_DEPENDENCY_UNUSED", "numpy"), ("p", "UNDECLARED_DEPENDENCY_USED", "requests")]


def test_traceability_and_rescue(spark):
    claims = spark.createDataFrame([("p", 1, "1", "verify tokens securely", "requirement", "README.md", 3),
                                    ("p", 1, "2", "teleport penguins", "feature", None, None)], CLAIM)
    docs = spark.createDataFrame([("p", 1, "a.py", "verify token handling")], DOC)
    flagged = X.keyword_traceability(claims, docs)
    assert rows(flagged, "claim_id", "code") == [("1", "REQUIREMENT_NOT_TRACEABLE"), ("2", "FEATURE_NOT_TRACEABLE")]
    assert "(keyword overlap 33%)" in flagged.where("claim_id = '1'").first().message
    stem = lambda c: F.transform(ft.tokenize(c), lambda w: F.substring(w, 1, 5))
    assert rows(X.keyword_traceability(claims, docs, stem), "claim_id") == [("2",)]


def brute_best(claims, docs):
    n = len(docs)
    df = Counter(t for words in docs.values() for t in set(words))
    idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df.items()}
    vector = lambda words: {t: c / len(words) * idf.get(t, 0.0) for t, c in Counter(words).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    result = {}
    for key, words in claims.items():
        a, best = vector(words), (0.0, None)
        for path in sorted(docs):
            b = vector(docs[path])
            if norm(a) and norm(b):
                score = round(sum(w * b.get(t, 0.0) for t, w in a.items()) / (norm(a) * norm(b)), 10)
                if score > best[0]:
                    best = (score, path)
        result[key] = (best[1], round(best[0], 4))
    return result


@pytest.mark.parametrize("block", [3, 500_000])
def test_best_match_against_brute_force(spark, block):
    import random

    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "kappa", "omega"]
    docs = {f"d{i}": [rng.choice(words) for _ in range(rng.randrange(1, 9))] for i in range(25)}
    docs["twin1"] = docs["twin2"] = ["alpha", "beta"]
    claims = {str(i): [rng.choice(words + ["unknown"]) for _ in range(rng.randrange(1, 5))] for i in range(12)}
    claims["none"] = ["unknown"]
    claims["tie"] = ["alpha", "beta"]
    claim_df = spark.createDataFrame([("p", 1, k, " ".join(w), "feature", None, None) for k, w in claims.items()], CLAIM)
    doc_df = spark.createDataFrame([("p", 1, k, " ".join(w)) for k, w in docs.items()] + [("p", 1, "blank", "")], DOC)
    docs["blank"] = []
    found = {r.claim_id: (r.best_match_file, r.similarity_score) for r in X.best_match(claim_df, doc_df, block).collect()}
    assert found == brute_best(claims, {k: v for k, v in docs.items()})


def test_projects_do_not_mix(spark):
    claims = spark.createDataFrame([("p", 1, "1", "token service", "feature", None, None)], CLAIM)
    docs = spark.createDataFrame([("q", 1, "a", "token service"), ("p", 1, "b", "other words")], DOC)
    assert rows(X.best_match(claims, docs), "claim_id", "best_match_file", "similarity_score") == [("1", None, 0.0)]


def test_text_report_names(spark):
    schema = KEYS + "path string, ord int, kind string, name string, line bigint, complexity bigint, has_doc boolean, level int, text string"
    report = reports.text_report(documents(spark), spark.createDataFrame([], schema),
                                 spark.createDataFrame([], KEYS + "relative_path string"), spark.createDataFrame([], DOC))
    assert "matches" in report.names() and report["claims"].count() == 4


def test_ties_go_to_the_first_path_even_if_one_begins_the_other(spark):
    claims = spark.createDataFrame([("p", 1, "1", "token service", "feature", None, None)], CLAIM)
    docs = spark.createDataFrame([("p", 1, path, "token service") for path in ("a.pyi", "a.py", "b.py")] + [("p", 1, "z", "other")], DOC)
    assert rows(X.best_match(claims, docs, 1, 1), "best_match_file") == [("a.py",)]
    assert rows(X.best_match(claims, docs), "best_match_file") == [("a.py",)]


def test_test_files_implement_nothing(spark):
    schema = KEYS + "path string, kind string, name string, level int"
    facts = spark.createDataFrame([("p", 1, "a.py", "import", "numpy", 0), ("p", 1, "tests/a.py", "import", "pytest", 0), ("p", 1, "test_b.py", "import", "mock", 0)], schema)
    files = spark.createDataFrame([("p", 1, "a.py")], KEYS + "relative_path string")
    assert rows(X.third_party_packages(facts, files), "package") == [("numpy",)]


def test_cells_are_scored_on_numbers_in_steps(monkeypatch):
    """A cell holds Arrow lists of term numbers; documents scored a few at a time give the rows of one step."""
    import pyarrow as pa
    claims = pa.table({"project_id": ["p"] * 3, "run_id": [1] * 3, "claim_id": ["a", "b", "c"], "terms": [[7, 9], [9], [4]], "weights": [[0.6, 0.8], [1.0], [1.0]]})
    documents = pa.table({"path": ["z", "y", "x", "w"], "terms": [[9], [7, 9], [9, 11], [11]], "weights": [[1.0], [0.6, 0.8], [3.0, 4.0], [1.0]], "norm": [1.0, 1.0, 5.0, 1.0]})
    wanted = [("a", "y", 1.0), ("b", "z", 1.0)]
    for at_once in (1, 3, 1000):
        monkeypatch.setattr(X, "SCORES_AT_ONCE", at_once)
        found = X._score_cell(claims, documents)
        assert [(r["claim_id"], r["path"], r["score"]) for r in found.to_pylist()] == wanted
    assert X._score_cell(claims.slice(0, 0), documents).num_rows == X._score_cell(claims, documents.slice(0, 0)).num_rows == 0


def test_tokens_come_from_one_search_of_the_text(spark):
    text = "ABc x_yZ9 _a__HTTPServer2Go été Überfall A1B snake_case_ID 42nd"
    assert one(spark, text, ft.tokenize("text")) == ["http", "server2", "berfall", "snake", "case", "42nd"]
    searches = spark.createDataFrame([(text,)], "text string").select(ft.tokenize("text"))._jdf.queryExecution().analyzed().toString()
    assert "(?![a-z])" in searches and "[A-Za-z0-9_]+" not in searches  # no search for words first
