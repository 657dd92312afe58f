"""Quality rules: robust multivariate outliers by minimum covariance determinant (MCD).

Each text becomes six statistics, transformed so that their spread hardly depends on its length.
For every language and source the MCD estimate is the mean and covariance of the three quarters of
its texts that lie closest together; a text is rejected if its Mahalanobis distance under that
estimate is too large. The estimate is found by concentration steps (Rousseeuw and Van Driessen,
"A Fast Algorithm for the Minimum Covariance Determinant Estimator", 1999) from two deterministic
starts, as in Hubert, Rousseeuw and Verdonck's DetMCD (2012); the smaller determinant wins. Every
step is two grouped aggregations over the narrow table of all texts' statistics: no group is
gathered in a task, and none is sampled.

A fixed least spread is added to every variance, since statistics such as the share of repeated
lines are often equal in nearly all texts of a source.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.llm.frames import row_key
from tastemill.llm.words import mixed, windows, word_hashes
from tastemill.session import ship_package, staged

STATISTICS = ("word_length", "symbols", "dup_lines", "repeats", "capitals", "punctuation")
P = len(STATISTICS)
# Copies of a group's row, so that the rows of one large group meet it in many tasks.
SALTS = 32


@dataclass(frozen=True)
class OutlierRule:
    """`cut`: largest squared distance that stays; with 6 statistics normal data exceed 45 in
    fewer than one of ten million texts. `least_spread`: added standard deviation per statistic.
    `min_group`: texts that a language and source needs for its own estimate; smaller ones are
    pooled by language, what is left then in one pool, and a pool below it rejects nothing."""

    cut: float = 45.0
    share: float = 0.75
    steps: int = 4
    min_group: int = 60
    least_spread: tuple[float, ...] = (0.10, 0.03, 0.10, 0.10, 0.03, 0.03)
    min_words: int = 10
    max_repeat_percent: int = 20


def _classes(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOLS = _classes(b"#*$%&|<>")
_SPACES = _classes(b" \t\n\x0b\x0c\r")
_CAPITALS = _classes(bytes(range(65, 91)))
_PUNCTUATION = _classes(b".,;:!?")
_FOLLOWING = _classes(bytes(range(0x80, 0xC0)))


def repeat_words(values: np.ndarray, bounds: np.ndarray, size: int = 5) -> np.ndarray:
    """Per text, the words that lie in a window of `size` words found twice or more in the text."""
    texts = len(bounds) - 1
    seen, ends = windows(values, bounds, size)
    if not len(seen):
        return np.zeros(texts, np.int64)
    owner = np.repeat(np.arange(texts), np.diff(ends))
    key = seen ^ mixed(owner.astype(np.uint64))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    place = np.flatnonzero(again) - ends[owner[again]] + bounds[owner[again]]
    edges = np.zeros(len(values) + 1, np.int64)
    np.add.at(edges, place, 1)
    np.add.at(edges, place + size, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edges)[:-1] > 0)])
    return covered[bounds[1:]] - covered[bounds[:-1]]


def text_statistics(texts: list[str | None]) -> dict[str, np.ndarray]:
    """Counts of whole texts; a null text has none."""
    values, bounds = word_hashes(texts)
    out = {"n_words": np.diff(bounds), "n_repeat_words": repeat_words(values, bounds)}
    counts = np.zeros((len(texts), 7), np.int64)
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace")
        bytes_seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        lines = [line for line in raw.split(b"\n") if line.split()]
        counts[i] = (
            len(raw) - bytes_seen[_FOLLOWING].sum() - bytes_seen[_SPACES].sum(),
            bytes_seen[_SYMBOLS].sum(), len(lines) - len(set(lines)), len(lines),
            bytes_seen[_CAPITALS].sum(), bytes_seen[_PUNCTUATION].sum(), 0,
        )
    for k, name in enumerate(("word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_capitals", "n_punctuation")):
        out[name] = counts[:, k]
    return out


def transformed(s: dict[str, np.ndarray]) -> np.ndarray:
    """One row of `STATISTICS` per text: a smoothed log of the word length, square roots of smoothed shares."""
    share = lambda count, of: np.sqrt((count + 1) / (of + 50))
    chars = s["word_chars"]
    return np.column_stack([
        np.log((chars + 20) / (s["n_words"] + 4)), share(s["n_symbols"], chars), share(s["n_dup_lines"], s["n_lines"]),
        share(s["n_repeat_words"], s["n_words"]), share(s["n_capitals"], chars), share(s["n_punctuation"], chars),
    ])


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, rule: OutlierRule) -> DataFrame:
    """doc_id, lang, source, row_key, the base counts, base_failed and the statistics x0, x1, … of every row."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            s = text_statistics(part.column(4).to_pylist())
            failed = (s["n_words"] < rule.min_words) | (100 * s["n_repeat_words"] > rule.max_repeat_percent * s["n_words"])
            x = transformed(s)
            columns = [*part.columns[:4], *(pa.array(s[n]) for n in BASE), pa.array(failed), *(pa.array(x[:, k]) for k in range(P))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", "source", "row_key", *BASE, "base_failed", *(f"x{k}" for k in range(P))])

    narrow = docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), row_key("text", "lang", "source").alias("row_key"), F.col("text").cast("string"))
    kinds = [f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}", "lang string", "source string", "row_key long"]
    kinds += [f"{n} long" for n in BASE] + ["base_failed boolean"] + [f"x{k} double" for k in range(P)]
    return narrow.mapInArrow(batches, ", ".join(kinds))


def _with_groups(rows: DataFrame, rule: OutlierRule) -> DataFrame:
    """`rows` with `part`, the name of the group or pool whose estimate judges the row, and a salt."""
    counts = rows.groupBy("lang", "source").agg(F.count(F.when(~F.col("base_failed"), 1)).alias("n"))
    large = F.col("n") >= rule.min_group
    left = counts.where(~large).groupBy("lang").agg(F.sum("n").alias("n_left")).withColumnRenamed("lang", "lang_left")
    counts = counts.join(left, F.col("lang").eqNullSafe(F.col("lang_left")), "left")
    part = (
        F.when(large, F.to_json(F.struct(F.lit("own").alias("of"), "lang", "source")))
        .when(F.col("n_left") >= rule.min_group, F.to_json(F.struct(F.lit("lang").alias("of"), "lang")))
        .otherwise(F.lit("rest"))
    )
    named = counts.select(F.col("lang").alias("lang_"), F.col("source").alias("source_"), part.alias("part"), F.explode(_salts()).alias("salt_"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "x0"), F.lit(SALTS)).cast("int"))
    same = F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_")) & (F.col("salt") == F.col("salt_"))
    return salted.join(named, same, "left").drop("lang_", "source_", "salt_")


def _salts() -> Column:
    return F.sequence(F.lit(0), F.lit(SALTS - 1))


def _chi2(dof: int, x: float) -> float:
    """P(chi-square of an even number of degrees of freedom <= x)."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def consistency(share: float) -> float:
    """The factor that makes the covariance of the inner `share` of normal data the covariance of all."""
    low, high = 0.0, 200.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi2(P, middle) < share else (low, middle)
    return share / _chi2(P + 2, low)


_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def _shape(factor: float, spread: tuple[float, ...]):
    """Sums per group to its estimate: mean, inverse covariance, log determinant."""

    def estimates(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            means, inverses, logs = [], [], []
            for row in frame.itertuples(index=False):
                mean = np.array(row.s, float) / row.n
                cov = np.zeros((P, P))
                for (i, j), total in zip(_PAIRS, row.ss, strict=True):
                    cov[i, j] = cov[j, i] = total / row.n - mean[i] * mean[j]
                cov = factor * cov + np.diag(np.square(spread))
                means.append((mean + np.array(row.center, float)).tolist())
                inverses.append(np.linalg.inv(cov).ravel().tolist())
                logs.append(float(np.linalg.slogdet(cov)[1]))
            yield pd.DataFrame({"part": frame["part"], "start": frame["start"], "mean": means, "inverse": inverses, "log_det": logs})

    return estimates


_ESTIMATE = "part string, start int, mean array<double>, inverse array<double>, log_det double"


def _against(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Rows with the estimates of their part and the squared distance `d2`."""
    wide = estimates.withColumn("salt", F.explode(_salts()))
    gap = [F.col(f"x{k}") - F.col("mean")[k] for k in range(P)]
    d2 = F.lit(0.0)
    for i, j in _PAIRS:
        d2 = d2 + F.col("inverse")[i * P + j] * gap[i] * gap[j] * (1 if i == j else 2)
    return rows.join(wide, ["part", "salt"]).withColumn("d2", d2)


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts, sums and products of the statistics around `center`."""
    gap = [F.col(f"x{k}") - F.col("center")[k] for k in range(P)]
    sums = [F.sum(g).alias(f"s{k}") for k, g in enumerate(gap)]
    products = [F.sum(gap[i] * gap[j]).alias(f"ss{i}_{j}") for i, j in _PAIRS]
    centers = [F.first(F.col("center")[k]).alias(f"c{k}") for k in range(P)]
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), *sums, *products, *centers)
    return out.select(
        *keys, "n",
        F.array(*[f"s{k}" for k in range(P)]).alias("s"),
        F.array(*[f"ss{i}_{j}" for i, j in _PAIRS]).alias("ss"),
        F.array(*[f"c{k}" for k in range(P)]).alias("center"),
    )


def _starts(rows: DataFrame, rule: OutlierRule) -> DataFrame:
    """Start 0: medians and absolute deviations. Start 1: medians and the covariance of spatial signs."""
    medians = rows.groupBy("part").agg(F.count("*").alias("n"), *[F.percentile_approx(f"x{k}", 0.5, 10_000).alias(f"m{k}") for k in range(P)])
    medians = staged(medians.where(F.col("n") >= rule.min_group))
    wide = medians.drop("n").withColumn("salt", F.explode(_salts()))
    centered = rows.join(wide, ["part", "salt"])
    gap = [(F.col(f"x{k}") - F.col(f"m{k}")) / F.lit(rule.least_spread[k]) for k in range(P)]
    length = F.sqrt(sum((g * g for g in gap), F.lit(0.0)))
    signs = [F.when(length > 0, g / length).otherwise(0.0) for g in gap]
    spread = [F.percentile_approx(F.abs(F.col(f"x{k}") - F.col(f"m{k}")), 0.5, 10_000).alias(f"d{k}") for k in range(P)]
    products = [F.avg(signs[i] * signs[j]).alias(f"ss{i}_{j}") for i, j in _PAIRS]
    middle = [F.first(f"m{k}").alias(f"m{k}") for k in range(P)]
    table = centered.groupBy("part").agg(*middle, *spread, *products)

    def shapes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least = np.array(rule.least_spread)
        for frame in parts:
            out = []
            for row in frame.to_dict("records"):
                mean = [row[f"m{k}"] for k in range(P)]
                mad = 1.4826 * np.array([row[f"d{k}"] for k in range(P)])
                sign = np.zeros((P, P))
                for i, j in _PAIRS:
                    sign[i, j] = sign[j, i] = row[f"ss{i}_{j}"]
                scale = np.sqrt(mad**2 + least**2)
                plain = np.diag(scale**2)
                size = np.sqrt(np.diag(sign) + 1e-6)
                signed = sign / np.outer(size, size) * np.outer(mad, mad) + np.diag(least**2)
                for start, cov in enumerate((plain, signed)):
                    out.append((row["part"], start, mean, np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
            yield pd.DataFrame(out, columns=["part", "start", "mean", "inverse", "log_det"])

    return staged(table.mapInPandas(shapes, _ESTIMATE))


def estimates_of(rows: DataFrame, rule: OutlierRule) -> DataFrame:
    """The MCD estimate of each part of `rows` (part, salt, x0, x1, …)."""
    current = _starts(rows, rule)
    factor = consistency(rule.share)
    for _ in range(rule.steps):
        far = _against(rows, current)
        limits = far.groupBy("part", "start").agg(F.percentile_approx("d2", rule.share, 10_000).alias("limit"))
        with_limits = staged(current.join(limits, ["part", "start"]))
        inner = _against(rows, with_limits).where(F.col("d2") <= F.col("limit")).withColumn("center", F.col("mean"))
        current = staged(_summed(inner, "part", "start").mapInPandas(_shape(factor, rule.least_spread), _ESTIMATE))
    best = current.groupBy("part").agg(F.min(F.struct("log_det", "start")).alias("best"))
    return current.join(best.select("part", F.col("best.start").alias("start")), ["part", "start"])


def robust_outliers(docs: DataFrame, rule: OutlierRule = OutlierRule()) -> DataFrame:
    """doc_id, row_key, lang, source, the base counts, base_failed, d2 (squared distance) and kept of every row.

    Uses the columns doc_id, text, lang and source; others play no part. A null or empty text has
    no words and fails the base rule. A null language or source is a value of its own. Texts that
    fail the base rule shape no estimate and have no d2, nor have those of a pool below
    `min_group`, which stay. Repeated rows count as often as they occur; an empty table gives no
    rows. Groups of equal texts (all statistics alike) have the least spread as their only spread.
    """
    ship_package(docs.sparkSession)
    rows = staged(measured(docs, rule))
    rows = staged(_with_groups(rows, rule))
    passed = rows.where(~F.col("base_failed"))
    judged = _against(rows, estimates_of(passed, rule).select("part", "mean", "inverse"))
    # Own groups and pools of a language have enough texts by their choice; the last pool may lack them.
    lacking = passed.where(F.col("part") == "rest").count() < rule.min_group
    others = rows.where((F.col("part") == "rest") & F.lit(lacking)).withColumn("d2", F.lit(None).cast("double"))
    columns = ["doc_id", "row_key", "lang", "source", *BASE, "base_failed"]
    both = judged.select(*columns, "d2").union(others.select(*columns, "d2"))
    d2 = F.when(~F.col("base_failed"), F.col("d2"))
    kept = ~F.col("base_failed") & (d2.isNull() | (d2 <= F.lit(rule.cut)))
    return both.select(*columns, d2.alias("d2"), kept.alias("kept"))

