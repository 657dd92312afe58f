"""Title search: BM25 over titles plus exact-title matches, for many queries at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.session import spread, staged

# BM25 parameters and the token pattern.
K1 = 1.2
B = 0.75
TOKEN_BREAK = r"[^\p{L}\p{N}]+"
# Queries and titles that meet in one task.
QUERIES_PER_BLOCK = 512
TITLES_PER_BLOCK = 4_096


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TOKEN_BREAK), lambda t: t != "")


def _idf(total: int, frequency: Column) -> Column:
    return F.log(1.0 + (F.lit(float(total)) - frequency + 0.5) / (frequency + 0.5))


def search_titles(
    queries: DataFrame,
    movies: DataFrame,
    k: int = 20,
    *,
    queries_per_block: int = QUERIES_PER_BLOCK,
    titles_per_block: int = TITLES_PER_BLOCK,
) -> DataFrame:
    """(query_id, movie_id, score, rank): best k movies per query by the better of both fields.

    `queries` has (query_id, query), `movies` (movie_id, title) already limited to what may be
    shown. Titles are tokenised once into a table of the tokens that some query has. Blocks of
    queries and blocks of titles meet in tasks, which keep k movies per query, so a word found in
    every title adds no rows and the number of jobs does not depend on the number of queries.
    """
    titles = staged(movies.select(F.col("movie_id").cast("bigint"), "title"))
    asked = staged(queries.where(F.trim("query") != "").select(F.col("query_id").cast("bigint"), F.trim("query").alias("query")))
    count, shown = max(1, asked.count()), max(1, titles.count())
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    query_blocks, title_blocks = -(-count // queries_per_block), -(-shown // titles_per_block)
    terms = asked.select("query_id", block("query_id", query_blocks).alias("query_block"), F.explode(tokens(F.col("query"))).alias("token"))
    terms = staged(terms.groupBy("query_id", "query_block", "token").agg(F.count(F.lit(1)).alias("times")))
    words = spread(titles).select("movie_id", tokens(F.col("title")).alias("tokens"))
    lengths = staged(words.select("movie_id", F.size("tokens").alias("length"), "tokens"))
    total, all_words = lengths.agg(F.count_if(F.col("length") > 0), F.sum("length")).first()
    if not total:
        return queries.sparkSession.createDataFrame([], "query_id bigint, movie_id bigint, score double, rank bigint")
    found = lengths.select("movie_id", "length", F.explode("tokens").alias("token")).join(terms.select("token").distinct(), "token", "left_semi")
    title_block = block("movie_id", title_blocks).alias("title_block")
    postings = staged(found.groupBy("movie_id", "length", "token").agg(F.count(F.lit(1)).alias("times")).select("*", title_block))
    frequency = postings.groupBy("token").agg(F.count(F.lit(1)).alias("found"))
    weights = terms.join(frequency, "token").select("query_id", "query_block", "token", (F.col("times") * _idf(total, F.col("found"))).alias("weight"))
    # A posting goes to the query blocks that ask for its token.
    wanted = terms.select("token", F.col("query_block").alias("query_block")).distinct()
    keys = ["query_block", "title_block"]
    # New names for the columns that both sides of the cogroup inherit from one table.
    cells = postings.join(wanted, "token").select("movie_id", "length", "token", "times", *[F.col(c).alias(c) for c in keys])
    weights = weights.withColumn("title_block", F.explode(F.sequence(F.lit(0), F.lit(title_blocks - 1))))
    scored = weights.groupBy(*keys).cogroup(cells.groupBy(*keys)).applyInPandas(_block_scores(all_words / total, k), _HITS)
    hits = scored.unionByName(_exact_titles(asked, titles, total, k)).groupBy("query_id", "movie_id").agg(F.round(F.max("score"), 9).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "movie_id")
    return hits.where("score > 0").withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= k)


_HITS = "query_id bigint, movie_id bigint, score double"


def _exact_titles(asked: DataFrame, titles: DataFrame, total: int, k: int) -> DataFrame:
    """Queries that are a whole title; of equal titles the k least ids can be in a result."""
    same = titles.join(asked.select(F.col("query").alias("title")).distinct(), "title", "left_semi")
    least = F.row_number().over(Window.partitionBy("title").orderBy("movie_id"))
    first = same.withColumn("turn", least).where(F.col("turn") <= k).drop("turn")
    counts = same.groupBy("title").agg(F.count(F.lit(1)).alias("found"))
    score = (_idf(total, F.col("found")) / (1.0 + K1)).alias("score")
    matched = asked.withColumnRenamed("query", "title").join(counts, "title")
    return matched.join(first, "title").select("query_id", "movie_id", score)


def _block_scores(average: float, k: int):
    """BM25 of one block of titles for one block of queries; k rows per query at most."""

    def scores(weights: pd.DataFrame, postings: pd.DataFrame) -> pd.DataFrame:
        if weights.empty or postings.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "movie_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        queries, asked = np.unique(weights["query_id"], return_inverse=True)
        movies, shown = np.unique(postings["movie_id"], return_inverse=True)
        damp = K1 * (1.0 - B + B * postings["length"].to_numpy() / average)
        times = postings["times"].to_numpy(float)
        share, weight = times / (times + damp), weights["weight"].to_numpy()
        table = np.zeros((len(movies), len(queries)))
        by_token = postings.groupby("token", sort=False).indices
        for token, columns in weights.groupby("token", sort=False).indices.items():
            if (rows := by_token.get(token)) is not None:
                table[np.ix_(shown[rows], asked[columns])] += np.outer(share[rows], weight[columns])
        table = np.round(table, 9)
        found = []
        for at, query in enumerate(queries):
            hit = np.flatnonzero(table[:, at] > 0)
            hit = hit[np.lexsort((movies[hit], -table[hit, at]))[:k]]
            found.append(pd.DataFrame({"query_id": query, "movie_id": movies[hit], "score": table[hit, at]}))
        return pd.concat(found)

    return scores
