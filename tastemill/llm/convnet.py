"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover it whole. Learned byte vectors pass
learned filters at every few bytes of a chunk; each filter keeps its largest answer. A dense layer
turns a chunk's answers into features, of which the text keeps the largest and the mean over all
its chunks; one logistic unit combines them into a probability. Training is plain gradient descent
(Adam) on a bounded sample of labelled texts on the driver; scoring runs in the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tastemill.llm.frames import label_sample, spare_name
from tastemill.session import ship_package

CHUNK, STEP = 512, 448
# Chunks that pass the filters at once: bounds a worker's memory.
CHUNKS_AT_ONCE = 256


@dataclass(frozen=True)
class NetPlan:
    """`max_texts`: labelled texts per label that training may use (the first ones by a hash of
    their id); scoring has no such bound. `turn_chunks`: chunks of one text in one epoch, more where
    the epochs could not see them all; other ones in each epoch, so training sees whole texts."""

    max_texts: int = 1200
    turn_chunks: int = 24
    vector: int = 6
    width: int = 8
    stride: int = 4
    filters: int = 24
    features: int = 16
    epochs: int = 14
    texts_per_step: int = 32
    rate: float = 0.006
    seed: int = 7


def chunks_of(raw: bytes) -> np.ndarray:
    """All overlapping chunks of a text's bytes; the last is filled up with zeros, an empty text is one of zeros."""
    count = 1 if len(raw) <= CHUNK else 1 + -(-(len(raw) - CHUNK) // STEP)
    padded = np.zeros((count - 1) * STEP + CHUNK, np.uint8)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.as_strided(padded, (count, CHUNK), (STEP, 1)).copy()


def turn_of(count: int, epoch: int, plan: NetPlan) -> np.ndarray:
    """Chunks of a text that an epoch trains on: one of each of equal stretches, the next one in the next epoch."""
    share = min(count, max(plan.turn_chunks, -(-count // plan.epochs)))
    first = np.arange(share) * count // share
    return first + epoch % np.diff(np.append(first, count))


class Net:
    def __init__(self, plan: NetPlan, weights: dict[str, np.ndarray] | None = None):
        self.plan = plan
        rng = np.random.default_rng(plan.seed)
        size = plan.width * plan.vector
        normal = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.w = weights or {
            "vectors": normal(0.5, 256, plan.vector), "filters": normal(1 / math.sqrt(size), size, plan.filters), "filter_bias": normal(0.0, plan.filters),
            "dense": normal(1 / math.sqrt(plan.filters), plan.filters, plan.features), "dense_bias": normal(0.0, plan.features) + np.float32(0.1),
            "out": normal(0.1, 2 * plan.features), "out_bias": np.zeros(1, np.float32),
        }

    def _windows(self, chunks: np.ndarray) -> np.ndarray:
        plan = self.plan
        x = self.w["vectors"][chunks].reshape(len(chunks), -1)
        places = (CHUNK - plan.width) // plan.stride + 1
        shape, item = (len(chunks), places, plan.width * plan.vector), x.itemsize
        return np.lib.stride_tricks.as_strided(x, shape, (x.strides[0], plan.stride * plan.vector * item, item)).reshape(-1, shape[2])

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(windows, each filter's largest answer per chunk, its place)."""
        windows = self._windows(chunks)
        answers = (windows @ self.w["filters"]).reshape(len(chunks), -1, self.plan.filters)
        place = answers.argmax(axis=1)
        return windows, np.take_along_axis(answers, place[:, None, :], 1)[:, 0] + self.w["filter_bias"], place

    def features(self, chunks: np.ndarray) -> np.ndarray:
        parts = []
        for start in range(0, len(chunks), CHUNKS_AT_ONCE):
            windows = self._windows(part := chunks[start : start + CHUNKS_AT_ONCE])
            best = (windows @ self.w["filters"]).reshape(len(part), -1, self.plan.filters).max(axis=1) + self.w["filter_bias"]
            parts.append(np.maximum(np.tanh(best) @ self.w["dense"] + self.w["dense_bias"], 0))
        return np.concatenate(parts)

    def logits(self, features: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One value per text from its chunks' features; `starts` are the texts' first chunks."""
        counts = np.diff(np.append(starts, len(features)))
        both = np.concatenate([np.maximum.reduceat(features, starts), np.add.reduceat(features, starts) / counts[:, None]], axis=1)
        return (both @ self.w["out"] + self.w["out_bias"]).astype(np.float64)

    def gradients(self, chunks: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        plan, w = self.plan, self.w
        windows, best, place = self.pooled(chunks)
        bent = np.tanh(best)
        before = bent @ w["dense"] + w["dense_bias"]
        features = np.maximum(before, 0)
        counts = np.diff(np.append(starts, len(chunks)))
        owner = np.repeat(np.arange(len(starts)), counts)
        largest = np.maximum.reduceat(features, starts)
        both = np.concatenate([largest, np.add.reduceat(features, starts) / counts[:, None]], axis=1)
        p = 1 / (1 + np.exp(-(both @ w["out"] + w["out_bias"])))
        d_logit = ((p - labels) / len(labels)).astype(np.float32)
        d_both = d_logit[:, None] * w["out"]
        is_largest = features == largest[owner]
        ties = np.add.reduceat(is_largest.astype(np.float32), starts)[owner]
        d_features = d_both[owner, : plan.features] * is_largest / ties + d_both[owner, plan.features :] / counts[owner, None]
        d_before = d_features * (before > 0)
        d_best = (d_before @ w["dense"].T) * (1 - bent**2)
        places = windows.shape[0] // len(chunks)
        rows = place + np.arange(len(chunks))[:, None] * places
        chosen = windows[rows]  # chunk, filter, window
        d_filters = np.einsum("cf,cfk->kf", d_best, chosen)
        d_windows = (d_best[:, :, None] * w["filters"].T[None]).reshape(-1, plan.vector)
        at = (place[:, :, None] * plan.stride + np.arange(plan.width)).astype(np.int64)
        codes = chunks[np.arange(len(chunks))[:, None, None], at].ravel()
        d_vectors = np.column_stack([np.bincount(codes, d_windows[:, k], minlength=256) for k in range(plan.vector)])
        return {
            "vectors": d_vectors, "filters": d_filters, "filter_bias": d_best.sum(0), "dense": bent.T @ d_before, "dense_bias": d_before.sum(0),
            "out": both.T @ d_logit, "out_bias": d_logit.sum(keepdims=True),
        }

    def train(self, texts: list[np.ndarray], labels: np.ndarray) -> None:
        plan, rng = self.plan, np.random.default_rng(self.plan.seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step, total = 0, plan.epochs * -(-len(texts) // plan.texts_per_step)
        for epoch in range(plan.epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), plan.texts_per_step):
                batch = order[at : at + plan.texts_per_step]
                parts = [texts[i][turn_of(len(texts[i]), epoch, plan)] for i in batch]
                counts = np.array([len(p) for p in parts])
                grads = self.gradients(np.concatenate(parts), np.cumsum(counts) - counts, labels[batch])
                step += 1
                rate = plan.rate * (1 - step / (total + 1))
                for k, g in grads.items():
                    g = g + 1e-4 * self.w[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.w[k] = (self.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)


@dataclass(frozen=True)
class Classifier:
    """A trained network, the shift to the labels' true shares, or one constant where it could not be trained."""

    plan: NetPlan
    weights: dict[str, np.ndarray] | None
    shift: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.full(len(texts), 1 / (1 + math.exp(-self.shift)))
        net = Net(self.plan, self.weights)
        out = np.zeros(len(texts))
        held, numbers, size = [], [], 0
        for number, text in enumerate(texts):
            chunks = chunks_of((text or "").encode("utf-8", "replace"))
            held.append(chunks)
            numbers.append(number)
            size += len(chunks)
            if size >= CHUNKS_AT_ONCE or number == len(texts) - 1:
                counts = np.array([len(c) for c in held])
                z = net.logits(net.features(np.concatenate(held)), np.cumsum(counts) - counts) + self.shift
                out[numbers] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                held, numbers, size = [], [], 0
        return out


def fit_quality(docs: DataFrame, labels: DataFrame, plan: NetPlan = NetPlan()) -> Classifier:
    """Learn from labelled rows outside the held-out fold, at most `max_texts` of each label.

    Labels are taken in the order of a hash of their id, so reruns agree. Null labels and ids are
    not used. Without texts of both labels the classifier gives the share of label 1, one half
    without any.
    """
    sample, counts = label_sample(labels, "quality", plan.max_texts, plan.seed)
    good, bad = counts.get(1, 0), counts.get(0, 0)
    shift = math.log((good + 0.5) / (bad + 0.5)) if good or bad else 0.0
    if not good or not bad:
        return Classifier(plan, None, shift)
    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(sample, "doc_id")
    # Rows of repeated ids are taken in the order of hashes too, so that the model does not depend on tasks.
    turn = [F.md5(F.concat(F.lit(f"{plan.seed}:"), F.col(c).cast("string")).cast("binary")) for c in ("doc_id", "text")]
    rows = joined.orderBy(*turn, "label").limit(4 * plan.max_texts).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], r["text"] or ""))
    if len({r["label"] for r in rows}) < 2:
        return Classifier(plan, None, shift)
    texts = [chunks_of((r["text"] or "").encode("utf-8", "replace")) for r in rows]
    targets = np.array([r["label"] for r in rows], np.float32)
    net = Net(plan)
    net.train(texts, targets)
    ones = float(targets.sum())
    return Classifier(plan, net.w, shift - math.log(ones / (len(targets) - ones)))


def quality_scores(docs: DataFrame, classifier: Classifier, text_col: str = "text", score_name: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1 of each whole text; only the text is read.

    A null text counts as an empty one, which is a chunk of zeros. All rows and columns stay; where
    a column already has the score's name, underscores are added to the new one.
    """
    score_name = spare_name(docs, score_name)
    place = [c.lower() for c in docs.columns].index(text_col.lower())

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            scores = classifier.scores(part.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=[*part.schema.names, score_name])

    ship_package(docs.sparkSession)
    return docs.mapInArrow(batches, StructType([*docs.schema.fields, StructField(score_name, DoubleType())]))
