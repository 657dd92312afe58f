"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.llm import licenses, mixing, repeats, resampling, whitening
from tastemill.llm.convnet import fit_quality, quality_scores
from tastemill.llm.frames import held_out, table
from tastemill.llm.html_layout import extract_text
from tastemill.llm.near_dedup import NearDedup, near_duplicates
from tastemill.llm.outliers import robust_outliers
from tastemill.llm.prefix_bpe import Vocabulary, digests, encode_documents
from tastemill.llm.token_counts import section_tokens
from tastemill.llm.toxicity import fit_lexicon, toxicity_scores
from tastemill.llm.vafile import exact_top_k


def op1_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    return exact_top_k(rows, rows.where(F.col("vec_id") % 100 == 0), k=10)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return robust_outliers(table(spark, sf, "documents")).drop("row_key", "lang", "source")


def op3_prefix_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return digests(encode_documents(docs, Vocabulary.public()))


def op4_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = near_duplicates(table(spark, sf, "documents"), NearDedup(words=3, per_cent=85))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def scored(rows: DataFrame, threshold: float) -> DataFrame:
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return scored(quality_scores(docs, fit_quality(docs, table(spark, sf, "labels"))), 0.3)


def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return scored(toxicity_scores(docs, fit_lexicon(docs, table(spark, sf, "labels"))), 0.5)


def op7_licence_scan(spark: SparkSession, sf: str) -> DataFrame:
    joined = lambda c: F.array_join(c, " ").alias(c)
    return licenses.licence_scan(table(spark, sf, "documents")).select("doc_id", "n_sentences", joined("licence_sentences"), joined("licences"))


def op8_mixing(spark: SparkSession, sf: str) -> DataFrame:
    documents, _ = mixing.mixed_documents(table(spark, sf, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


def op9_html_layout(spark: SparkSession, sf: str) -> DataFrame:
    return extract_text(table(spark, sf, "pages").select("page_id", "html")).drop("html")


def op10_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return section_tokens(table(spark, sf, "documents"), Vocabulary.public())


def op11_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.repeated_words(table(spark, sf, "documents")).drop("row_key")


def op12_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return resampling.importance_resampled(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("row_key")


def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    rows = whitening.whitened_vectors(table(spark, sf, "embeddings"))
    # A deviation that no long can hold is null.
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_quality_rules": op2_quality_rules,
    "op3_prefix_bpe": op3_prefix_bpe,
    "op4_near_dedup": op4_near_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_toxicity": op6_toxicity,
    "op7_licence_scan": op7_licence_scan,
    "op8_mixing": op8_mixing,
    "op9_html_layout": op9_html_layout,
    "op10_token_counts": op10_token_counts,
    "op11_repeats": op11_repeats,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_whitening": op13_whitening,
}
SQL: dict[str, str] = {
    "op1_exact_top_k": OP1_SQL,
    "op7_licence_scan": licenses.sql(),
    "op8_mixing": mixing.SQL,
    "op11_repeats": repeats.SQL,
    "op12_importance_resampling": resampling.SQL,
}
