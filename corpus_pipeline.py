"""A training-corpus pipeline over the table ``documents``.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the
columns of documents; the last one returns token ids. Stages are written as Parquet below the
shared folder and read again, so a lost executor costs tasks of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from projectpulse.llm import decontamination, language_id, line_dedup, minhash_forest, sentence_pieces
from projectpulse.llm.common import table
from projectpulse.llm.queries import PIECE_MODEL
from projectpulse.skew import new_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: names a row in SQL
KEY = "xxhash64(doc_id, text)"


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents in none of the languages, or in none with confidence, go."""
    names, logs = language_id.fit_trigrams(docs, "doc_id", "text", "lang")
    found = language_id.identify(docs, names, logs, F.expr(KEY), F.col("text"), F.col("lang"), F.col("source"), F.lit(""))
    rejected = found.where("not kept").select(F.col("key").alias("_key")).distinct()
    return docs.join(rejected, F.expr(f"{KEY} = _key"), "left_anti").select(*COLUMNS)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: texts lose the lines that many documents share; ``n_chars`` follows."""
    kept = line_dedup.drop_repeated_lines(docs, carry=["lang", "source"])
    return kept.select("doc_id", F.col("kept_text").alias("text"), "carried.lang", "carried.source", F.length("kept_text").cast("bigint").alias("n_chars"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: the smallest id of every group of near-duplicates stays."""
    copies = minhash_forest.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a test item go."""
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    leaks = found.select(F.col("row_key").alias("_key")).distinct()
    return docs.join(leaks, F.expr(f"{KEY} = _key"), "left_anti").select(*COLUMNS)


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece: ids of every text, and the digest of what they decode to."""
    decoded = sentence_pieces.decode(sentence_pieces.encode(docs, PIECE_MODEL), PIECE_MODEL)
    return decoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2(F.encode("decoded_text", "utf-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_common_lines),
    ("minhash_dedup", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("sentence_pieces", to_token_ids),
]

#: trigram models and token ids are beyond SQL; tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
