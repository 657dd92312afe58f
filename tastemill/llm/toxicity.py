"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, strips accents, maps look-alike letters of other scripts and digits or signs
that stand for letters, and leaves words parted by single spaces. The lexicon holds whole words
and word beginnings with a weight each; a longer exception phrase that covers an entry takes its
weight away. The score is a logistic function of the weight found and of that weight per word.

The lexicon's weights are learned by counting, over a bounded sample of the labelled rows of the
training fold, in how many toxic and other texts each folded word and word beginning occurs.
Counting is a grouped aggregation; only entries whose evidence is beyond chance reach the driver,
every one that passes its tests. Exception phrases are learned in the same way: two neighbouring
words of which one has an entry, found beyond chance in texts that are not toxic. The two
logistic terms are fitted on a histogram of bounded size over the same rows, weighted to the
labels' true shares.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tastemill.llm.frames import label_sample, spare_name
from tastemill.session import ship_package

# Letters of other scripts that look like Latin ones, and signs read as letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o",
    "р": "p", "ԛ": "q", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ø": "o", "ł": "l", "đ": "d", "ß": "ss",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}
INVISIBLE = "​‌‍⁠﻿­"


def _fold_table() -> dict[int, str]:
    """One character to its folded form for the first two planes' letters that decompose; others by rule."""
    table = {ord(c): "" for c in INVISIBLE}
    for code in range(0x80, 0x3000):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)).lower() if not unicodedata.combining(c))
        table[code] = "".join(HOMOGLYPHS.get(c, c) for c in plain) if plain != chr(code) or plain in HOMOGLYPHS else chr(code)
    for code in range(0xFF01, 0xFF5F):
        table[code] = chr(code - 0xFEE0).lower()
    table.update({code: "" for code in range(0x300, 0x370)})
    table.update({code: chr(code).lower() for code in range(65, 91)})
    return {code: text for code, text in table.items() if text != chr(code)}


_FOLDED = str.maketrans(_fold_table())
_SIGNS = str.maketrans(SUBSTITUTES)
_EDGE = ".,;:!?\"'()[]{}<>#*$%&|-_/\\«»“”‘’…"


def folded_words(text: str | None) -> list[str]:
    """The folded words of a whole text. Signs and digits become letters only inside words that have a letter."""
    out = []
    for raw in (text or "").translate(_FOLDED).split():
        word = raw if raw.isalpha() else _spelled(raw)
        if word:
            out.append(word)
    return out


def _spelled(raw: str) -> str:
    """A word with marks around it or signs in it; marks behind it are never letters."""
    core = raw.rstrip(_EDGE).lstrip(_EDGE.replace("$", ""))
    if not core.isalpha() and any(c.isalpha() for c in core):
        core = "".join(c for c in core.translate(_SIGNS) if c.isalpha())
    return core if core.isalpha() else ""


@dataclass(frozen=True)
class LexiconPlan:
    """`prefixes`: lengths of word beginnings that may become entries. An entry needs `min_texts`
    toxic texts and a log-likelihood ratio above `evidence`; as the sample is bounded, so are they. `max_texts`: labelled texts per label
    that training may use (the first ones by a hash of their id); scoring has no such bound.
    `phrases`: exception phrases beside the learned ones, read with their words folded."""

    prefixes: tuple[int, ...] = (4, 5, 6)
    min_texts: int = 3
    evidence: float = 16.0
    max_texts: int = 12_000
    seed: int = 11
    phrases: tuple[str, ...] = ("clown fish", "trash can", "trash bin", "loser bracket", "fool proof")


@dataclass(frozen=True)
class Lexicon:
    """Entries begin with '=' (a whole word) or '^' (a word beginning)."""

    weights: dict[str, float]
    bias: float
    per_found: float
    per_share: float
    phrases: tuple[str, ...] = ()

    def probability(self, found: np.ndarray, words: np.ndarray) -> np.ndarray:
        z = self.bias + self.per_found * np.log1p(found) + self.per_share * _share(found, words)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _share(found: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Weight per word, smoothed for short texts, on a log scale."""
    return np.log1p(100 * found / (words + 5))


class Matcher:
    """All entries and exception phrases in one automaton over ' word word '."""

    def __init__(self, weights: dict[str, float], phrases: tuple[str, ...]):
        self.automaton = ahocorasick.Automaton()
        entries: dict[str, float | None] = {}
        for entry, weight in weights.items():
            entries[f" {entry[1:]} " if entry[0] == "=" else f" {entry[1:]}"] = weight
        for phrase in phrases:
            if words := folded_words(phrase):
                entries[f" {' '.join(words)} "] = None
        for key, weight in entries.items():
            self.automaton.add_word(key, (len(key), weight))
        if entries:
            self.automaton.make_automaton()
        self.empty = not entries

    def found(self, words: list[str]) -> float:
        """The weight in a text; of the entries that start at one word the heaviest counts."""
        return sum(self.starts(words).values())

    def neighbours(self, words: list[str]) -> set[str]:
        """The distinct pairs of neighbouring words of which one has weight, parted by a space."""
        starts = self.starts(words)
        places, at = set(), 0
        for place, word in enumerate(words):
            if at in starts:
                places.add(place)
            at += len(word) + 1
        return {f"{words[p]} {words[p + 1]}" for i in places for p in (i - 1, i) if 0 <= p < len(words) - 1}

    def starts(self, words: list[str]) -> dict[int, float]:
        """Weight by the place, in ' word word ', of the space before each word with an entry."""
        if self.empty or not words:
            return {}
        best: dict[int, float] = {}
        exempt: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton.iter(f" {' '.join(words)} "):
            start = end - size + 1
            if weight is None:
                exempt.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        for low, high in exempt:
            for start in [s for s in best if low <= s < high]:
                del best[start]
        return best


def _entries(words: list[str], prefixes: tuple[int, ...]) -> set[str]:
    distinct = set(words)
    out = {"=" + w for w in distinct}
    for size in prefixes:
        out.update("^" + w[:size] for w in distinct if len(w) > size)
    return out


def fit_lexicon(docs: DataFrame, labels: DataFrame, plan: LexiconPlan = LexiconPlan()) -> Lexicon:
    """Learn from the labelled rows outside the held-out fold.

    Rows with a null label or id are not used; a repeated label row counts as often as it occurs.
    Without toxic or without other texts the lexicon is empty and every score is the share of
    toxic rows (one half without any rows).
    """
    sample, totals = label_sample(labels, "toxic", plan.max_texts, plan.seed)
    all_rows = sum(totals.values())
    prior = (totals.get(1, 0) + 0.5) / (all_rows + 1) if all_rows else 0.5
    empty = Lexicon({}, math.log(prior / (1 - prior)), 0.0, 0.0, plan.phrases)
    train = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(sample.withColumnRenamed("label", "toxic"), "doc_id")
    rows, toxic = train.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic or toxic == rows:
        return empty

    counted = _evidence(train, lambda words: _entries(words, plan.prefixes), rows, toxic)
    strong = F.col("evidence") >= plan.evidence
    best = counted.where((F.col("a") >= plan.min_texts) & strong & (F.col("weight") > 2.0)).orderBy(F.desc("evidence"), "entry").collect()
    weights = {r["entry"]: round(float(r["weight"]), 6) for r in best}
    phrases = plan.phrases
    if weights:
        around = _evidence(train, _Neighbours(weights, phrases), rows, toxic)
        harmless = around.where((F.col("n") - F.col("a") >= plan.min_texts) & strong & (F.col("weight") < 0)).orderBy(F.desc("evidence"), "entry")
        phrases += tuple(r["entry"] for r in harmless.collect())
    scales = (totals[0] / (rows - toxic), totals[1] / toxic)
    return _calibrated(train, weights, phrases, empty, scales)


class _Neighbours:
    """`Matcher.neighbours` with its automaton built once in each worker."""

    def __init__(self, weights: dict[str, float], phrases: tuple[str, ...]):
        self.weights, self.phrases, self.matcher = weights, phrases, None

    def __call__(self, words: list[str]) -> set[str]:
        self.matcher = self.matcher or Matcher(self.weights, self.phrases)
        return self.matcher.neighbours(words)


def _evidence(train: DataFrame, features: Callable[[list[str]], set[str]], rows: int, toxic: int) -> DataFrame:
    """(entry, a, n, evidence, weight) of each feature of the texts: toxic and all texts with it, the
    log-likelihood ratio against the share of toxic texts, and the log ratio of its shares in both."""

    def spread(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [features(folded_words(t)) for t in part.column("text").to_pylist()]
            marks = [m for m, t in zip(part.column("toxic").to_pylist(), texts, strict=True) for _ in t]
            yield pa.RecordBatch.from_arrays([pa.array([e for t in texts for e in t], pa.string()), pa.array(marks, pa.int32())], names=["entry", "toxic"])

    counted = train.mapInArrow(spread, "entry string, toxic int").groupBy("entry").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    a, n = F.col("a").cast("double"), F.col("n").cast("double")
    part = lambda k, m: F.when(k > 0, k * F.log(k / m)).otherwise(0.0)
    evidence = 2 * (part(a, n * F.lit(toxic / rows)) + part(n - a, n * F.lit(1 - toxic / rows)))
    weight = F.log((a + 0.2) / F.lit(toxic + 0.4)) - F.log((n - a + 0.2) / F.lit(rows - toxic + 0.4))
    return counted.withColumn("evidence", evidence).withColumn("weight", weight)


def _calibrated(train: DataFrame, weights: dict[str, float], phrases: tuple[str, ...], empty: Lexicon, scales: tuple[float, float]) -> Lexicon:
    """Fit the logistic terms on counts per cell of the two measures; `scales` weigh other and toxic rows.

    Both measures are logarithms cut into steps, so the cells are a few thousand at most.
    """
    if not weights:
        return empty
    measured = _measured(train, weights, phrases, "text").select(
        F.round(F.log1p("found") * 8).alias("x"), F.round(F.log1p(100 * F.col("found") / (F.col("words") + 5)) * 8).alias("y"), "toxic"
    )
    cells = measured.groupBy("x", "y").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).toPandas()
    x = np.column_stack([np.ones(len(cells)), cells["x"] / 8, cells["y"] / 8])
    a = cells["a"].to_numpy(float) * scales[1]
    n = (cells["n"] - cells["a"]).to_numpy(float) * scales[0] + a
    beta = np.zeros(3)
    ridge = np.diag([1e-3, 0.1, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (a - n * p) - ridge @ beta)
        beta = beta + np.clip(step, -2, 2)
    return Lexicon(weights, *(float(b) for b in beta), phrases)


def _measured(docs: DataFrame, weights: dict[str, float], phrases: tuple[str, ...], text_col: str, found: str = "found", words: str = "words") -> DataFrame:
    place = [c.lower() for c in docs.columns].index(text_col.lower())

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(weights, phrases)
        for part in parts:
            split = [folded_words(t) for t in part.column(place).to_pylist()]
            added = [pa.array([matcher.found(w) for w in split], pa.float64()), pa.array([float(len(w)) for w in split], pa.float64())]
            yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*part.schema.names, found, words])

    ship_package(docs.sparkSession)
    return docs.mapInArrow(batches, StructType([*docs.schema.fields, StructField(found, DoubleType()), StructField(words, DoubleType())]))


def toxicity_scores(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", score_name: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1 of each whole text; only the text is read.

    A null or empty text scores as one without any entry. All rows and columns stay; where a
    column already has the score's name, underscores are added to the new one.
    """
    found, words, score_name = (spare_name(docs, n) for n in ("found", "words", score_name))
    rows = _measured(docs, lexicon.weights, lexicon.phrases, text_col, found, words)
    z = F.lit(lexicon.bias) + F.lit(lexicon.per_found) * F.log1p(found) + F.lit(lexicon.per_share) * F.log1p(100 * F.col(found) / (F.col(words) + 5))
    return rows.withColumn(score_name, 1 / (1 + F.exp(-z))).drop(found, words)
