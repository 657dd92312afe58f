"""Target-distribution importance resampling over hashed word runs.

After Xie et al., "Data Selection for Language Models via Importance Resampling" (NeurIPS 2023).
The counts of hashed word runs in the raw texts and in texts of the target distribution give each
bucket a gain; a document weighs the mean of its gains, and a document's own Gumbel noise on top of
the weight turns the highest scores into a draw without replacement.

Texts are worked on by Arrow kernels in whole batches: `ascii_lower`, `split_pattern_regex`,
`list_flatten` and `dictionary_encode` give one index per word. A run of n words is the pair of the
index of its first n - 1 words and that of the last, a shift of the index array; the CRC of a pair
goes on from the CRC of its first part, so each distinct pair of a batch is hashed once. Gains are
taken by bucket and summed per document as segments.

Two passes read the texts. What passes between them is one long per bucket.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.llm.frames import row_key
from tastemill.operators.rank import global_rank
from tastemill.session import ship_package, staged

# Fixed value: what parts words, after A-Z are lower-cased.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class ResamplePlan:
    """`longest`: words of the longest run. Drawn are `per_cent` of the documents with at least
    `least_words` words, rounded down."""

    longest: int = 1
    buckets: int = 10_000
    seed: int = 2024
    least_words: int = 20
    per_cent: int = 10


@dataclass(frozen=True)
class BatchFeatures:
    """The buckets of a batch's word runs, document after document, and each document's numbers."""

    buckets: np.ndarray
    owners: np.ndarray
    n_words: np.ndarray


def batch_features(texts: pa.Array, plan: ResamplePlan) -> BatchFeatures:
    """Word runs of a batch of texts; `owners` are the texts' numbers, ascending for each length of run."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN_WORDS)
    words, owners = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(words), 0)  # a separator at either end leaves an empty piece
    coded = words.filter(full).dictionary_encode()
    owners = owners.filter(full).to_numpy(zero_copy_only=False).astype(np.int64)
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    raw = [w.encode("utf-8") for w in coded.dictionary.to_pylist()]
    crc = np.fromiter(map(zlib.crc32, raw), np.int64, len(raw))
    runs, run_owners, found, whose = index, owners, [crc[index]], [owners]
    for length in range(2, plan.longest + 1):
        inside = run_owners[:-1] == owners[length - 1 :]
        pair = runs[:-1][inside] * max(len(raw), 1) + index[length - 1 :][inside]
        distinct, number = np.unique(pair, return_inverse=True)
        first, last = distinct // max(len(raw), 1), distinct % max(len(raw), 1)
        crc = np.fromiter((zlib.crc32(b" " + raw[w], int(c)) for c, w in zip(crc[first], last, strict=True)), np.int64, len(distinct))
        # A run that ends with its text leaves a gap: numbers stay aligned with the words.
        at, spread = np.flatnonzero(inside), np.full(len(inside), -1, np.int64)
        spread[at] = number
        found.append(crc[number])
        whose.append(owners[at])
        runs, run_owners = spread, np.where(inside, run_owners[:-1], -1)
    return BatchFeatures(np.concatenate(found) % plan.buckets, np.concatenate(whose), np.bincount(owners, minlength=len(texts)))


def bucket_counts(texts: DataFrame, plan: ResamplePlan, text_col: str = "text") -> DataFrame:
    """(bucket, n): word runs per bucket of all texts; a task sends one row per bucket at most."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(plan.buckets, np.int64)
        for part in parts:
            total += np.bincount(batch_features(part.column(0), plan).buckets, minlength=plan.buckets)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int64()), pa.array(total[filled], pa.int64())], names=["bucket", "n"])

    found = texts.select(F.col(text_col).cast("string")).mapInArrow(batches, "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, plan: ResamplePlan, text_col: str = "text") -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio of shares) of each bucket; a row per bucket reaches the driver."""
    s, t = ([0] * plan.buckets for _ in range(2))
    for counts, table in ((s, raw), (t, target)):
        for r in bucket_counts(table, plan, text_col).collect():
            counts[r["bucket"]] = r["n"]
    all_s, all_t = float(sum(s) + plan.buckets), float(sum(t) + plan.buckets)
    return np.array([math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s, t, strict=True)], np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, plan: ResamplePlan, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, n_words, n_features, weight) of every row."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = batch_features(part.column(2), plan)
            rows = part.num_rows
            order = np.argsort(found.owners, kind="stable")
            counts = np.bincount(found.owners, minlength=rows)
            some = np.flatnonzero(counts)
            weights = np.zeros(rows, np.int64)
            if len(some):
                starts = (np.cumsum(counts) - counts)[some]
                weights[some] = np.add.reduceat(gains.take(found.buckets[order]), starts) // counts[some]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *(pa.array(a, pa.int64()) for a in (found.n_words, counts, weights))],
                names=["doc_id", "row_key", "n_words", "n_features", "weight"],
            )

    narrow = docs.select(F.col(id_col).alias("doc_id"), row_key(text_col).alias("row_key"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(batches, f"doc_id {kind}, row_key long, n_words long, n_features long, weight long")


def noise(plan: ResamplePlan):
    """A document's Gumbel noise in thousandths, from the digest of seed and id; a null id counts as ''."""
    name = F.concat(F.lit(f"{plan.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def importance_resampled(
    docs: DataFrame, target: DataFrame, plan: ResamplePlan = ResamplePlan(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of `docs`: doc_id, row_key, n_features, weight, score and rank, null where not drawn.

    Both tables have the text column. Null and empty texts, and texts without words, have no
    features and weight 0. Repeated rows are separate documents; equal scores rank by id, then by
    text; a null id ranks behind all others. An empty `docs` gives no rows; an empty `target`
    leaves gains that depend on the raw counts alone. Other columns play no part.
    """
    ship_package(docs.sparkSession)
    gains = bucket_gains(docs, target, plan, text_col)
    rows = weighted(docs, gains, plan, id_col, text_col)
    # A number per row makes equal rows tell apart, as an order over all rows needs; it is written, so it stays.
    rows = staged(rows.withColumn("score", F.col("weight") + noise(plan)).withColumn("__number", F.monotonically_increasing_id()))
    able = rows.where(F.col("n_words") >= plan.least_words)
    drawn = able.count() * plan.per_cent // 100
    keys = {"__down": -F.col("score"), "__named": F.col("doc_id").isNull().cast("int"), "__id": F.coalesce("doc_id", F.lit(0)), "__text": F.col("row_key")}
    ranked = global_rank(able.withColumns(keys), [*keys, "__number"], "__rank")
    rank = F.when(F.col("__rank") <= drawn, F.col("__rank"))
    out = ["doc_id", "row_key", "n_features", "weight", "score"]
    short = rows.where(F.col("n_words") < plan.least_words).select(*out, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*out, rank.alias("rank")).unionByName(short)


def sampled(docs: DataFrame, target: DataFrame, plan: ResamplePlan = ResamplePlan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The drawn rows of `docs`, with their own columns; of rows equal in id and text all or none are drawn."""
    drawn = importance_resampled(docs, target, plan, id_col, text_col).where(F.col("rank").isNotNull())
    drawn = drawn.select(F.col("doc_id").alias("__drawn_id"), F.col("row_key").alias("__drawn_key")).distinct()
    same = F.col(id_col).eqNullSafe(F.col("__drawn_id")) & (row_key(text_col) == F.col("__drawn_key"))
    return docs.join(drawn, same, "left_semi")


SQL = r"""
WITH RECURSIVE c(i, k, v) AS (
  SELECT i, 0, i FROM (SELECT unnest(range(256))::BIGINT AS i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM c WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM c WHERE k = 8),
d AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
dw AS (SELECT n, word, count(*) AS times FROM (SELECT n, unnest(words) AS word FROM d) GROUP BY ALL),
bw AS (SELECT word, count(*) AS times FROM (SELECT unnest(words) AS word FROM b) GROUP BY ALL),
w AS (
  SELECT word, (xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(word) + 1), lambda i: ('0x' || substr(hex(encode(word)), (2 * i - 1)::INT, 2))::BIGINT)),
    lambda a, x: xor(a >> 8, t[xor(a, x) % 256 + 1])), 4294967295) % 10000)::BIGINT AS bucket
  FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc),
s AS (SELECT bucket, sum(times)::BIGINT AS s FROM dw JOIN w USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(times)::BIGINT AS t FROM bw JOIN w USING (word) GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT DISTINCT bucket FROM w) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
x AS (SELECT n, floor(sum(times * gain)::DOUBLE / sum(times))::BIGINT AS weight FROM dw JOIN w USING (word) JOIN g USING (bucket) GROUP BY n),
y AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN x USING (n)),
z AS (SELECT doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score FROM y),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id)::BIGINT AS rank, count(*) OVER () AS able FROM z WHERE n_features >= 20)
SELECT z.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * able // 100 THEN rank END AS rank FROM z LEFT JOIN r USING (doc_id)
"""
