"""Column helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from projectpulse.functions import fixed


def as_col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def strip(value) -> Column:
    """Text without white space of any kind at its ends."""
    return F.btrim(as_col(value), F.lit(fixed.WHITESPACE))


def rounded(value, digits: int) -> Column:
    """Half-up rounding that first drops float noise, so that the order in which
    partial sums were merged cannot move a value across a rounding tie."""
    return F.round(F.round(as_col(value), 10), digits)


def band(value, bands) -> Column:
    """Label of the first lower bound that ``value`` reaches, else the rest label."""
    bounds, rest = bands
    value = as_col(value)
    chain = None
    for lower, label in bounds:
        hit = value >= F.lit(lower)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain.otherwise(F.lit(rest))


def weight_of(label, weights: dict[str, int]) -> Column:
    chain = F
    for name, weight in weights.items():
        chain = chain.when(as_col(label) == name, F.lit(weight))
    return chain.cast("bigint")


def severity_weight(label) -> Column:
    return weight_of(label, fixed.SEVERITY_WEIGHTS)


def risk_weight(label) -> Column:
    return weight_of(label, fixed.RISK_WEIGHTS)


def priority_weight(label) -> Column:
    return weight_of(label, fixed.PRIORITY_WEIGHTS)


def clamp(value, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), as_col(value)))


def per_file(value, file_count) -> Column:
    """FN20: a count divided by the number of files, 4 digits."""
    return rounded(as_col(value) / F.greatest(as_col(file_count), F.lit(1)), 4)


def two_signal_level(ssim, hash_distance) -> Column:
    """PR11: similarity band and hash-distance band must both hold."""
    chain = F
    for lowest, farthest, label in fixed.TWO_SIGNAL_BANDS:
        chain = chain.when((as_col(ssim) >= lowest) & (as_col(hash_distance) <= farthest), label)
    return chain.otherwise("critical")


def hour_of_day(ts) -> Column:
    ts = as_col(ts)
    return F.hour(ts) + F.minute(ts) / 60.0 + F.floor(F.second(ts)) / 3600.0


def time_bucket_match(start, now, hours: float = 2.0) -> Column:
    """PR14: same weekday, circular distance of the time of day within ``hours``."""
    distance = F.abs(hour_of_day(start) - hour_of_day(now))
    near = F.least(distance, 24.0 - distance) <= hours
    return (F.weekday(as_col(start)) == F.weekday(as_col(now))) & near


def dot(a, b) -> Column:
    pairs = F.zip_with(as_col(a).cast("array<double>"), as_col(b).cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a, b) -> Column:
    """FN18: cosine of two vectors, clamped to [-1, 1]; 0 when one has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(clamp(dot(a, b) / norms, -1.0, 1.0))


def hamming(a, b) -> Column:
    """FN19: number of differing bits of two 64-bit hashes."""
    return F.bit_count(as_col(a).bitwiseXOR(as_col(b)))


def percent_text(value, digits: int = 0) -> Column:
    return F.format_string(f"%.{digits}f%%", as_col(value) * 100.0)


def packed_order(time: str, number: str) -> Column:
    """A timestamp and a bigint as one number of fixed width that orders as the pair does; nulls come first.

    Aggregates over such numbers keep their state in a hash table, those over structs sort.
    """
    micros = F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(-(1 << 62))).cast("decimal(19,0)")
    return (micros * F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("decimal(38,0)") + F.coalesce(F.col(number).cast("bigint"), F.lit(-(1 << 63))).cast("decimal(19,0)")
