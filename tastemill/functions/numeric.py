"""Scalar column functions: normalisation, slots, fractions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _blank(value: Column) -> Column:
    return value.isNull() | F.isnan(value)


def min_max_norm(value: Column, low: Column, high: Column) -> Column:
    """Scale into [0, 1]; missing values and empty ranges give 0 (NaN is tested first)."""
    value = value.cast("double")
    scaled = (value - low) / (high - low)
    return F.when(_blank(value) | (high <= low), F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled))
    )


def log1p_or_zero(value: Column) -> Column:
    value = value.cast("double")
    return F.when(_blank(value) | (value < 0), F.lit(0.0)).otherwise(F.log1p(value))


def clamp(value: Column, low: float = 0.0, high: float = 0.8) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def normalize_fractions(main: Column, candidate: Column) -> Column:
    """struct(main, candidate) summing to 1; all traffic to main when nothing is left."""
    total = main + candidate
    return F.struct(
        F.when(total <= 0, F.lit(1.0)).otherwise(main / total).alias("main"),
        F.when(total <= 0, F.lit(0.0)).otherwise(candidate / total).alias("candidate"),
    )


def model_slots(top_k: Column, candidate_fraction: Column, has_candidate: Column) -> Column:
    """struct(main_slots, candidate_slots); halves round to the even slot count."""
    share = F.bround(top_k * candidate_fraction, 0).cast("bigint")
    wanted = F.greatest(F.lit(0), F.least(top_k.cast("bigint"), share))
    candidate = F.when(has_candidate & (candidate_fraction > 0), wanted).otherwise(F.lit(0)).cast("bigint")
    return F.struct((top_k.cast("bigint") - candidate).alias("main_slots"), candidate.alias("candidate_slots"))


def rating_in_range(rating: Column, low: float = 0.5, high: float = 5.0) -> Column:
    return rating.between(low, high)


def adler32(text: Column) -> Column:
    """Adler-32 checksum of the UTF-8 bytes as bigint.

    Both halves are sums: of the bytes, and of the bytes times their distance from the end. Texts
    up to 100 million bytes stay below the range of a bigint.
    """
    modulus = F.lit(65521).cast("bigint")
    size = F.octet_length(text).cast("bigint")
    # One character per byte; its code is the byte.
    letters = F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "")
    weighted = F.transform(letters, lambda c, i: F.struct(F.ascii(c).cast("bigint").alias("code"), (size - i).alias("times")))
    start = F.struct(F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))
    add = lambda acc, x: F.struct((acc["a"] + x["code"]).alias("a"), (acc["b"] + x["code"] * x["times"]).alias("b"))
    total = lambda acc: F.pmod(acc["b"] + size, modulus) * 65536 + F.pmod(acc["a"] + 1, modulus)
    return F.when(size == 0, F.lit(1).cast("bigint")).otherwise(F.aggregate(weighted, start, add, total))


def daily_seed(user_id: Column, day: Column, token: Column | None = None) -> Column:
    """Repeatable per-user seed of one day; a blank token is no token."""
    base = F.concat_ws(":", user_id.cast("string"), F.date_format(day, "yyyy-MM-dd"))
    if token is not None:
        cleaned = F.trim(F.coalesce(token, F.lit("")))
        base = F.when(cleaned == "", base).otherwise(F.concat_ws(":", base, cleaned))
    return F.pmod(adler32(base), F.lit(2**31).cast("bigint"))


def rounded(value: Column, digits: int = 6) -> Column:
    """A double rounded half away from zero by plain arithmetic, without a decimal per row."""
    scale = 10.0**digits
    steps = F.floor(F.abs(value) * scale + 0.5)
    # Values too large for whole steps, infinities and NaN take the general way.
    return F.when(F.abs(value) < 1e12 / scale, F.when(value < 0, -steps).otherwise(steps) / scale).otherwise(F.round(value, digits))
