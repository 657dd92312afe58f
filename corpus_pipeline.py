"""A training corpus from raw documents: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. `run` writes what a stage returns
to the shared folder and reads it again for the next one. All stages but the last return the
columns of `documents`; the last returns the encoded rows of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.llm.convnet import fit_quality, quality_scores
from tastemill.llm.frames import keyed, pairs, same_row, small_batches, spare_name, table
from tastemill.llm.mixing import mixed_texts
from tastemill.llm.near_dedup import NearDedup, without_near_duplicates
from tastemill.llm.outliers import robust_outliers
from tastemill.llm.prefix_bpe import Vocabulary, encode_documents
from tastemill.session import staged

# The score below which the quality classifier rejects a document.
LEAST_QUALITY = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of `sf_dir`, does not reject."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    score = spare_name(docs, "score")
    return quality_scores(docs, model, score_name=score).where(F.col(score) >= LEAST_QUALITY).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are no outlier of their language and source."""
    small_batches(spark)
    rejected = staged(pairs(robust_outliers(docs).where(~F.col("kept"))).distinct())
    rows = keyed(docs, "text", "lang", "source")
    return rows.join(rejected, same_row(rows, rejected), "left_anti").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    small_batches(spark)
    return without_near_duplicates(docs, NearDedup(words=5, per_cent=80))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them."""
    small_batches(spark)
    return mixed_texts(docs)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token ids and digests of the ids and of the bytes they decode to."""
    small_batches(spark)
    encoded = encode_documents(docs.select("doc_id", "lang", "source", "text"), Vocabulary.public())
    return encoded.select(
        "doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids",
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("source mix", source_mix),
    ("byte-level BPE", byte_level_bpe),
]
# The network, the iterated estimates and the encoding cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
