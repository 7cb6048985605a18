"""Language identification by fusing evidence after Bayes.

Four kinds of evidence meet per row: the likelihood of its text under byte-trigram models, the
language its markup declares, its address suffix, and its host. The first two give a first
distribution over languages for each row. Summed by host, by suffix and over all rows (grouped
aggregations), these give priors that are smoothed hierarchically: a host leans on its suffix, a
suffix on the whole, each row's own share taken out. The posterior is the first distribution times
the host's prior.

The trigram models are fitted on a bounded sample (``SAMPLE_ROWS`` labelled rows, the smallest by a
hash of their id); everything else covers all rows. A further class, ``other``, spreads evenly over
all trigrams and stands for text in none of the languages. A row is rejected if ``other`` wins or
no language reaches ``least``.

Cases: null or empty texts have no text evidence, null or unknown declared languages no declared
evidence; a null host is a host of its own without a suffix; without any evidence the language with
the largest prior is named; without labelled rows every row is ``other``; repeated rows are judged
alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from projectpulse.llm import common
from projectpulse.skew import cut_lineage

SAMPLE_ROWS, TRIGRAM_BITS = 4000, 15
#: trigrams that a text's evidence counts for at most: neighbouring trigrams are no independent witnesses
WITNESSES = 60
DECLARED_TRUST, OTHER_SHARE = 0.9, 0.01
#: share of trigrams in any text that follow no language (numbers, keys, names): a few odd words do not decide
STRAY_SHARE = 0.2
SUFFIX_WEIGHT, HOST_WEIGHT = 20.0, 20.0
#: bytes that are not part of words count as spaces
PLAIN = common.LOWER.copy()
PLAIN[:65] = 32
PLAIN[91:97] = 32
PLAIN[123:128] = 32


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the trigrams of all texts (runs of spaces give none), and the text of each."""
    plain = PLAIN[data].astype(np.uint32)
    if len(plain) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = plain[:-2] << 16 | plain[1:-1] << 8 | plain[2:]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    valid = (owner[:-2] == owner[2:]) & (plain[1:-1] != 32)
    number = codes[valid] * np.uint32(2654435761) >> np.uint32(32 - TRIGRAM_BITS)
    return number.astype(np.int64), owner[:-2][valid]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in common.blocks(batches):
        number, owner = trigrams(data, offsets)
        names = np.array(rows["label"].to_pylist(), object)
        for name in sorted(set(names)):
            counts = np.bincount(number[names[owner] == name], minlength=1 << TRIGRAM_BITS)
            yield pa.RecordBatch.from_pydict({"label": [name], "counts": pa.array([counts.astype(np.int64).tobytes()], pa.binary())})


def _add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << TRIGRAM_BITS, np.int64)
    for batch in batches:
        for counts in batch["counts"]:
            total += np.frombuffer(counts.as_buffer(), np.int64)
    yield pa.RecordBatch.from_pydict({"label": [key[0].as_py()], "counts": pa.array([total.tobytes()], pa.binary())})


def fit_trigrams(labelled: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities (one row per language), from a bounded sample."""
    common.small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    rows = rows.where("doc_id is not null and label is not null and text is not null")
    chosen = rows.select("doc_id", F.xxhash64("doc_id").alias("_h")).orderBy("_h", "doc_id").limit(sample_rows).select("doc_id").distinct()
    sample = rows.join(chosen, "doc_id", "left_semi").select("text", "label")
    sums = sample.mapInArrow(_count, "label string, counts binary").groupBy("label").applyInArrow(_add, "label string, counts binary")
    found = sorted((r["label"], np.frombuffer(bytes(r["counts"]), np.int64)) for r in sums.collect())  # one row per language
    names = [name for name, _ in found]
    if not names:
        return [], np.zeros((0, 1 << TRIGRAM_BITS))
    counts = np.stack([c for _, c in found]) + 0.05
    shares = counts / counts.sum(axis=1, keepdims=True)
    return names, np.log((1 - STRAY_SHARE) * shares + STRAY_SHARE / (1 << TRIGRAM_BITS))


def _likelihoods(names: list[str], logs: np.ndarray):
    """Log likelihood of text and declared language for every class, and the distribution they give."""
    classes = [*names, "other"]
    table = np.vstack([logs, np.full(1 << TRIGRAM_BITS, -np.log(1 << TRIGRAM_BITS))]) if names else np.zeros((1, 1 << TRIGRAM_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.blocks(batches, limit=common.BLOCK_BYTES // 2):
            number, owner = trigrams(data, offsets)
            size = rows.num_rows
            n = np.bincount(owner, minlength=size)
            sums = np.stack([np.bincount(owner, weights=t[number], minlength=size) for t in table], axis=1)
            text = sums / np.maximum(n, 1)[:, None] * np.minimum(n, WITNESSES)[:, None]
            declared = np.array([names.index(d) if d in names else -1 for d in rows["declared"].to_pylist()])
            told = np.zeros((size, len(classes)))
            known = declared >= 0
            told[known] = np.log((1 - DECLARED_TRUST) / max(len(classes) - 1, 1))
            told[known, declared[known]] = np.log(DECLARED_TRUST)
            # evidence of junk lies in the text alone: what is declared says nothing about it
            told[known, -1] = np.log(1 / len(classes))
            told[:, -1] += np.log(OTHER_SHARE)
            weight = text + told
            weight -= weight.max(axis=1, keepdims=True)
            share = np.exp(weight)
            share /= share.sum(axis=1, keepdims=True)
            listed = lambda x: pa.array(x.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([rows["key"], rows["host"], rows["suffix"], rows["declared"], listed(weight), listed(share)], names=["key", "host", "suffix", "declared", "weight", "share"])

    return run


def _smoothed(counts: str, base: str, strength: float, own: str | None = None) -> str:
    """SQL: (counts [- own] + strength * base) / their sum, class by class."""
    taken = f"zip_with({counts}, {own}, (c, s) -> greatest(c - s, 0D))" if own else counts
    raw = f"zip_with({taken}, {base}, (c, b) -> c + {strength}D * b)"
    return f"transform({raw}, x -> x / (aggregate({taken}, 0D, (a, c) -> a + c) + {strength}D))"


def identify(rows: DataFrame, names: list[str], logs: np.ndarray, key: Column, text: Column, declared: Column, host: Column, suffix: Column, least: float = 0.5) -> DataFrame:
    """One row per input row: key, host, declared, language, probability, kept."""
    common.small_batches(rows.sparkSession)
    spoken = F.lower(F.regexp_extract(F.coalesce(declared, F.lit("")), r"^\s*([A-Za-z]+)", 1))
    picked = rows.select(key.alias("key"), text.alias("text"), spoken.alias("declared"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(suffix, F.lit("")).alias("suffix"))
    key_type = picked.schema["key"].dataType.simpleString()
    first = picked.mapInArrow(_likelihoods(names, logs), f"key {key_type}, host string, suffix string, declared string, weight array<double>, share array<double>")
    first = cut_lineage(first)
    n = len(names) + 1
    add = [F.sum(F.col("share")[i]).alias(f"s{i}") for i in range(n)]
    sums = lambda alias: F.array(*[F.col(f"s{i}") for i in range(n)]).alias(alias)
    hosts = cut_lineage(first.groupBy("host", "suffix").agg(*add))
    add = [F.sum(f"s{i}").alias(f"s{i}") for i in range(n)]
    suffixes = hosts.groupBy("suffix").agg(*add)
    whole = suffixes.agg(*add).first()
    total = sum(x or 0.0 for x in whole) + n
    overall = "array(" + ", ".join(f"{((x or 0.0) + 1) / total!r}D" for x in whole) + ")"
    by_suffix = suffixes.select("suffix", sums("_counts")).withColumn("_base", F.expr(_smoothed("_counts", overall, SUFFIX_WEIGHT))).select("suffix", "_base")
    priors = hosts.select("host", "suffix", sums("_counts")).join(by_suffix, "suffix")
    judged = first.join(priors, ["host", "suffix"]).withColumn("_prior", F.expr(_smoothed("_counts", "_base", HOST_WEIGHT, "share")))
    judged = judged.withColumn("_w", F.expr("zip_with(weight, _prior, (w, p) -> w + ln(greatest(p, 1e-12D)))"))
    judged = judged.withColumn("_e", F.expr("transform(_w, w -> exp(w - array_max(_w)))"))
    judged = judged.withColumn("_best", F.expr("array_position(_w, array_max(_w))").cast("int"))
    judged = judged.withColumn("probability", F.expr("1D / aggregate(_e, 0D, (a, e) -> a + e)"))
    language = F.element_at(F.array(*[F.lit(x) for x in [*names, "other"]]), F.col("_best"))
    judged = judged.select("key", "host", "declared", language.alias("language"), "probability")
    return judged.withColumn("kept", (F.col("language") != "other") & (F.col("probability") >= least))
