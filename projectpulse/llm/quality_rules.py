"""Quality rules as a ledger of bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one number
whose bit ``Rule.bit`` says that the rule failed. Policies are named, versioned sets of rules:
a mask. Judging a document by any version is one bitwise "and", without reading texts again, and
ablations (what would be kept if one rule were left out) come from the counts of equal numbers.
Built-in functions only: no Python runs on the executors.

Repeated 3-word windows are found inside the row: windows of three 64-bit word hashes are sorted
with their places, equal neighbours are marked and the covered words counted. Two different words
of one text share a hash with a probability of about (words of the text)^2 / 2^65. All steps take n
log n time; the arrays of one text take some 200 bytes of heap per word, so a text of 20 MB needs
about 700 MB.

Cases: a null or empty text has no words and fails ``few_words``; null ids and repeated rows are
kept as they are, one row each; an empty table gives an empty ledger; other columns are ignored
unless they are carried.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD, HAS_WORD, HAS_LETTER, SYMBOLS = r"[^\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]", r"\p{L}", "[#*$%&|<>]"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words"]


@dataclass(frozen=True)
class Rule:
    """``failed`` is SQL over the measurements."""

    name: str
    bit: int
    failed: str


#: bits are never given to another rule, so that old ledgers stay readable
RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("word_length", 2, "word_chars < 3 * n_words or word_chars > 10 * n_words"),
    Rule("symbols", 3, "10 * n_symbols > n_words"),
    Rule("few_letters", 4, "100 * n_letter_words < 80 * n_words"),
    Rule("repeated_lines", 5, "n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines"),
)
#: (policy, version): names of its rules
POLICIES: dict[tuple[str, int], tuple[str, ...]] = {
    ("base", 1): ("few_words", "repeated_windows"),
    ("prose", 1): ("few_words", "repeated_windows", "word_length", "symbols"),
    ("prose", 2): ("few_words", "repeated_windows", "word_length", "symbols", "few_letters", "repeated_lines"),
}


def mask_of(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    bits = {rule.name: rule.bit for rule in rules}
    return sum(1 << bits[name] for name in set(names))


def newest(policy: str, policies: Mapping[tuple[str, int], Sequence[str]] = POLICIES) -> tuple[str, int]:
    return max(key for key in policies if key[0] == policy)


def _from(name: str, first: int) -> Column:
    return F.slice(name, first, F.greatest(F.size(name), F.lit(1)))


def measure(docs: DataFrame, text_col: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The carried columns and the measurements of every text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*carry).alias("carried"), text.alias("text"))
    rows = rows.withColumns({
        "words": F.regexp_extract_all("text", F.lit(WORD), 0),
        "lines": F.filter(F.split("text", "\n"), lambda line: line.rlike(HAS_WORD)),
    })
    rows = rows.select(
        "carried", F.size("words").cast("bigint").alias("n_words"), F.transform("words", lambda word: F.xxhash64(word)).alias("hashes"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"), F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.filter("words", lambda word: word.rlike(HAS_LETTER))).cast("bigint").alias("n_letter_words"),
    )
    places = F.sequence(F.lit(0), F.greatest(F.size("hashes") - 1, F.lit(0)))
    windows = F.arrays_zip(F.col("hashes").alias("a"), _from("hashes", 2).alias("b"), _from("hashes", 3).alias("c"), places.alias("at"))
    rows = rows.withColumn("sorted", F.sort_array(F.slice(windows, 1, F.greatest(F.size("hashes") - 2, F.lit(0))))).drop("hashes")
    same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    twins = F.zip_with("sorted", _from("sorted", 2), lambda x, y: F.when(same(x, y), F.array(x["at"], y["at"])))
    rows = rows.withColumn("places", F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda pair: pair.isNotNull()))))).drop("sorted")
    covered = F.zip_with("places", _from("places", 2), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    rows = rows.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("bigint"), lambda total, n: total + n))
    return rows.select("carried.*", *MEASURES)


def ledger(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Measurements and ``failed``: bit ``rule.bit`` is set where the rule failed."""
    bits = F.lit(0).cast("bigint")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.failed), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("bigint"))
    return measure(docs, text_col, carry).withColumn("failed", bits)


def passes(names: Sequence[str], rules: Sequence[Rule] = RULES) -> Column:
    """True where a ledger row fails none of the rules."""
    return F.col("failed").bitwiseAND(F.lit(mask_of(names, rules)).cast("bigint")) == 0


def _policy_array(policies: Mapping[tuple[str, int], Sequence[str]], rules: Sequence[Rule]) -> Column:
    made = [F.struct(F.lit(p).alias("policy"), F.lit(v).alias("version"), F.lit(mask_of(names, rules)).cast("bigint").alias("mask")) for (p, v), names in policies.items()]
    return F.array(*made)


def apply_policies(rows: DataFrame, policies: Mapping[tuple[str, int], Sequence[str]] = POLICIES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """A ledger under several versions at once: one row per ledger row and version, with ``failed_rules`` and ``kept``."""
    each = rows.withColumn("_p", F.explode(_policy_array(policies, rules)))
    each = each.withColumn("_failed", F.col("failed").bitwiseAND(F.col("_p.mask")))
    names = F.array_compact(F.array(*[F.when(F.getbit("_failed", F.lit(rule.bit)) == 1, F.lit(rule.name)) for rule in rules]))
    return each.select(*rows.columns, F.col("_p.policy").alias("policy"), F.col("_p.version").alias("version"), names.alias("failed_rules"), (F.col("_failed") == 0).alias("kept"))


def ablations(rows: DataFrame, policies: Mapping[tuple[str, int], Sequence[str]] = POLICIES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per version and rule of it: documents, those kept, those failing the rule, and those kept only if the rule is left out.

    Ledger rows are first counted per value of ``failed``; there are at most 2 ^ rules such values,
    however many documents there are.
    """
    counted = rows.groupBy("failed").agg(F.count("*").alias("n"))
    each = counted.withColumn("_p", F.explode(_policy_array(policies, rules))).withColumn("_failed", F.col("failed").bitwiseAND(F.col("_p.mask")))
    own = [F.struct(F.lit(rule.name).alias("rule"), F.lit(1 << rule.bit).cast("bigint").alias("bit")) for rule in rules]
    each = each.withColumn("_r", F.explode(F.array(*own))).where(F.col("_p.mask").bitwiseAND(F.col("_r.bit")) != 0)
    where = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0)).alias
    return each.groupBy(F.col("_p.policy").alias("policy"), F.col("_p.version").alias("version"), F.col("_r.rule").alias("rule")).agg(
        F.sum("n").alias("n_docs"), where(F.col("_failed") == 0)("n_kept"),
        where(F.col("_failed").bitwiseAND(F.col("_r.bit")) != 0)("n_failed"), where(F.col("_failed") == F.col("_r.bit"))("n_failed_alone"),
    )


def profile(rows: DataFrame, by: Sequence[str], rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per group: rules that some document fails (``ever``) and that all fail (``always``), by bitwise aggregates."""
    found = rows.groupBy(*by).agg(F.count("*").alias("n_docs"), F.bit_or("failed").alias("_any"), F.bit_and("failed").alias("_all"))
    names = lambda bits: F.array_compact(F.array(*[F.when(F.getbit(bits, F.lit(r.bit)) == 1, F.lit(r.name)) for r in rules]))
    return found.select(*by, "n_docs", names("_any").alias("ever"), names("_all").alias("always"))
