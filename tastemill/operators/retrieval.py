"""Candidate retrieval for all users at once: nearest, popular, random and sampled movies."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions.posters import poster_is_safe
from tastemill.operators.vectors import cosine, stack_lists, without_null_lists
from tastemill.session import broadcast_if_small, staged

# Bucket labels in merge order.
KNN, POPULAR, RANDOM_GENRE, RANDOM_KNN = "knn", "popular", "random_genre", "random_knn"
BUCKET_PRIORITY = {KNN: 0, POPULAR: 1, RANDOM_GENRE: 2, RANDOM_KNN: 3}


@dataclass(frozen=True)
class RetrievalSizes:
    """Bucket sizes and quality limits; knn + popular already fill the cap unless they overlap."""

    knn: int = 250
    popular: int = 50
    random_genre: int = 75
    random_knn: int = 75
    knn_pool: int = 400
    random_knn_skip: int = 150
    max_candidates: int = 300
    liked_genres: int = 4
    min_votes: int = 100
    min_average: float = 6.0


def safe_movies(catalog: DataFrame) -> DataFrame:
    return catalog.where(poster_is_safe(F.col("poster_safe")))


def quality_movies(catalog: DataFrame, min_votes: int = 100, min_average: float = 6.0) -> DataFrame:
    return safe_movies(catalog).where(
        (F.col("tmdb_vote_count") >= min_votes) & (F.col("tmdb_vote_average") >= min_average)
    )


def genre_quality_filter(catalog: DataFrame, genres: Column, min_votes: int = 100, min_average: float = 6.0) -> DataFrame:
    return quality_movies(catalog, min_votes, min_average).where(F.arrays_overlap("genres", genres))


# ---------------------------------------------------------------- nearest movies


# Users of one task, users scored at a time, and bytes of movie vectors scored at a time.
USERS_PER_BLOCK = 16_384
USERS_PER_STEP = 256
VECTOR_BLOCK_BYTES = 4 * 1024 * 1024


def knn(
    profiles: DataFrame,
    vectors: DataFrame,
    excluded: DataFrame,
    k: int,
    *,
    profile: str = "content_profile",
    depth: str | None = None,
    block_bytes: int = VECTOR_BLOCK_BYTES,
    users_per_block: int = USERS_PER_BLOCK,
) -> DataFrame:
    """Exact top-k movies by cosine per user, without the excluded pairs.

    Users are dealt into blocks by a hash of their id. A block is one task: it holds its users and
    their best k so far, and the movies stream past in order of their id. So the pairs never exist
    as rows, a task's memory depends on neither table's size, only the final lists leave it, and
    nothing passes the driver. `vectors` has (movie_id, vector) of the movies allowed in results. A
    user without a direction scores 0 everywhere. `depth` may name a profile column with a smaller
    k of that user.
    """
    spark = profiles.sparkSession
    floats = vectors.schema["vector"].dataType.simpleString() == "array<float>"
    items = staged(vectors.select(F.col("movie_id").cast("bigint"), F.col("vector").cast("array<float>" if floats else "array<double>")))
    limit = F.col(depth) if depth else F.lit(k)
    users = staged(profiles.select(F.col("user_id").cast("bigint"), F.col(profile).cast("array<double>").alias("profile"), limit.cast("bigint").alias("k")))
    rows, width = items.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if not rows:
        return spark.createDataFrame([], _KNN_SCHEMA)
    asked = users.count()
    blocks = max(1, -(-asked // users_per_block), min(spark.sparkContext.defaultParallelism, -(-asked // USERS_PER_STEP)))
    block = F.pmod(F.xxhash64("user_id"), F.lit(blocks)).cast("int").alias("block")
    pairs = excluded.select(F.col("user_id").cast("bigint"), F.col("movie_id").cast("bigint"))
    offered = items.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(2).alias("kind"), "movie_id", "vector")
    # Of a block, first the users come, then their exclusions, then all movies.
    told = users.select(block, F.lit(0).alias("kind"), "user_id", "profile", "k").unionByName(
        pairs.join(users.select("user_id"), "user_id", "left_semi").join(items.select("movie_id"), "movie_id", "left_semi").select(
            block, F.lit(1).alias("kind"), "user_id", "movie_id"), allowMissingColumns=True
    ).unionByName(offered, allowMissingColumns=True)
    laid_out = without_null_lists(told).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "kind", "movie_id", "user_id")
    step = max(1, block_bytes // (width * 8 + 8))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, None
        for batch in batches:
            place = batch.column("block").to_numpy() * 3 + batch.column("kind").to_numpy()
            for value in np.unique(place):
                part = batch.slice(int(np.searchsorted(place, value)), int((place == value).sum()))
                if current != value // 3:
                    if held:
                        yield from held.lists()
                    current, held = value // 3, _BlockSearch(width)
                if value % 3 == 0:
                    held.ask(part)
                elif value % 3 == 1:
                    held.exclude(part)
                else:
                    for at in range(0, part.num_rows, step):
                        held.offer(part.slice(at, step))
        if held:
            yield from held.lists()

    return laid_out.mapInArrow(nearest, _KNN_SCHEMA)


_KNN_SCHEMA = "user_id bigint, movie_id bigint, score double, rank bigint"


def _directions(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; zeros stay."""
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.where(lengths > 0, vectors / np.where(lengths > 0, lengths, 1.0), 0.0)


class _BlockSearch:
    """The best movies so far of one block of users, while the movies stream past."""

    def __init__(self, width: int):
        self.width = width
        # A float32 product of two directions is nearer than this to the exact one.
        self.margin = (width + 8) * 2.0**-22
        self.asked, self.gone, self.steps, self.seen = [], [], None, None

    def ask(self, rows: pa.RecordBatch) -> None:
        unit = _directions(stack_lists(rows.column("profile"), self.width).astype(np.float64))
        self.asked.append((rows.column("user_id").to_numpy(), rows.column("k").to_numpy(), unit))

    def exclude(self, rows: pa.RecordBatch) -> None:
        self.gone.append((rows.column("user_id").to_numpy(), rows.column("movie_id").to_numpy()))

    def _begin(self) -> None:
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, self.width)))
        self.users, self.depth, self.unit = (np.concatenate(x) for x in zip(empty, *self.asked, strict=True))
        order = np.argsort(self.users, kind="stable")
        self.users, self.depth, self.unit = self.users[order], self.depth[order], self.unit[order]
        gone = [np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 2, *self.gone, strict=True)]
        # Exclusions came in order of movie, as the movies will.
        self.gone_row, self.gone_movie = np.searchsorted(self.users, gone[0]), gone[1]
        self.asked, self.gone = [], []
        self.steps = [_Best(slice(at, at + USERS_PER_STEP), self.depth[at : at + USERS_PER_STEP]) for at in range(0, len(self.users), USERS_PER_STEP)]

    def offer(self, rows: pa.RecordBatch) -> None:
        if self.steps is None:
            self._begin()
        ids = rows.column("movie_id").to_numpy()
        unit = _directions(stack_lists(rows.column("vector"), self.width).astype(np.float64))
        near = unit.T.astype(np.float32)
        low = 0 if self.seen is None else np.searchsorted(self.gone_movie, self.seen, side="right")
        high = np.searchsorted(self.gone_movie, ids[-1], side="right")
        gone_row, gone_movie = self.gone_row[low:high], self.gone_movie[low:high]
        at = np.minimum(np.searchsorted(ids, gone_movie), len(ids) - 1)
        known = ids[at] == gone_movie
        gone_row, at = gone_row[known], at[known]
        order = np.argsort(gone_row, kind="stable")
        gone_row, at = gone_row[order], at[order]
        self.seen = ids[-1]
        for best in self.steps:
            own = self.unit[best.rows]
            scores = own.astype(np.float32) @ near
            lo, hi = np.searchsorted(gone_row, [best.rows.start, best.rows.stop])
            scores[gone_row[lo:hi] - best.rows.start, at[lo:hi]] = -np.inf
            user, movie = np.divmod(np.flatnonzero(scores >= best.floors(scores, self.margin)), len(ids))
            for cut in range(0, len(user), 65_536):
                u, m = user[cut : cut + 65_536], movie[cut : cut + 65_536]
                # Rounded so that equal similarities tie by movie id whatever the summation order.
                best.add(u.astype(np.int32), ids[m], np.round(np.einsum("ij,ij->i", own[u], unit[m]), 9) + 0.0)

    def lists(self) -> Iterator[pa.RecordBatch]:
        for best in self.steps or []:
            rank = best.settle()
            columns = [self.users[best.rows][best.user], best.movie, best.score, rank]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["user_id", "movie_id", "score", "rank"])


class _Best:
    """The lists of a few users; new hits wait until there are as many as the lists hold."""

    def __init__(self, rows: slice, depth: np.ndarray):
        self.rows, self.depth = rows, depth
        self.user, self.movie, self.score = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.where(depth > 0, -2.0, np.inf)
        self.waiting, self.count = [], 0

    def floors(self, scores: np.ndarray, margin: float) -> np.ndarray:
        """What a float32 score must reach to enter the user's list, as a column."""
        floors = self.least - margin
        most = int(self.depth.max(initial=0))
        if 0 < most < scores.shape[1]:
            open_rows = np.flatnonzero((scores >= floors[:, None]).sum(axis=1) > 2 * most)
            if len(open_rows):
                kth = np.partition(scores[open_rows], scores.shape[1] - most, axis=1)[:, scores.shape[1] - most]
                floors[open_rows] = np.maximum(floors[open_rows], kth - 2 * margin)
        # An excluded movie is at minus infinity, below every floor.
        return np.maximum(floors, -3.0)[:, None]

    def add(self, user: np.ndarray, movie: np.ndarray, score: np.ndarray) -> None:
        self.waiting.append((user, movie, score))
        self.count += len(user)
        if self.count > max(len(self.user), 16_384):
            self.settle()

    def settle(self) -> np.ndarray:
        """Takes the waiting hits in; returns the ranks, from 1."""
        user, movie, score = (np.concatenate(x) for x in zip((self.user, self.movie, self.score), *self.waiting, strict=True))
        self.waiting, self.count = [], 0
        order = np.lexsort((movie, -score, user))
        user, movie, score = user[order], movie[order], score[order]
        starts = np.searchsorted(user, np.arange(len(self.depth)))
        rank = np.arange(1, len(user) + 1) - starts[user]
        kept = rank <= self.depth[user]
        self.user, self.movie, self.score, rank = user[kept], movie[kept], score[kept], rank[kept]
        last = rank == self.depth[self.user]
        self.least[self.user[last]] = self.score[last]
        return rank


def similarity_to(df: DataFrame, left: str, right: str) -> DataFrame:
    return df.withColumn("cosine", cosine(F.col(left), F.col(right)))


# ---------------------------------------------------------------- genre buckets


# Neighbouring places of a genre's list that are joined together.
BAND = 64


def _genre_lists(movies: DataFrame, order: list[Column]) -> DataFrame:
    """(genre, band, place, size, movie_id, tmdb_popularity): each genre's movies in `order`, cut into bands."""
    by_genre = movies.select("movie_id", "tmdb_popularity", F.explode(F.array_distinct("genres")).alias("genre"))
    genre = Window.partitionBy("genre")
    place = F.row_number().over(genre.orderBy(*order)).cast("bigint") - 1
    placed = by_genre.select("*", place.alias("place"), F.count(F.lit(1)).over(genre).alias("size"))
    return placed.withColumn("band", F.floor(F.col("place") / BAND))


def _read_lists(liked: DataFrame, lists: DataFrame, excluded: DataFrame, n: int) -> DataFrame:
    """What each user reads of the lists of liked genres: the first `n` movies and as many as are excluded there.

    Users and lists meet by (genre, band), in as many bands as the user needs, so one who has seen
    most of a genre reads further without anybody else doing so. Returns liked's columns and
    movie_id and tmdb_popularity, without the excluded pairs.
    """
    gone, known = excluded.select("user_id", "movie_id"), broadcast_if_small(lists.select("movie_id", "genre", "band"), 72)
    outs = gone.join(known, "movie_id").groupBy("user_id", "genre", "band").agg(F.collect_set("movie_id").alias("out"), F.count(F.lit(1)).alias("skip"))
    skips = outs.groupBy("user_id", "genre").agg(F.sum("skip").alias("skip"))
    sizes = lists.groupBy("genre").agg(F.max("size").alias("size"))
    asked = liked.join(sizes, "genre").join(skips, ["user_id", "genre"], "left")
    asked = asked.withColumn("depth", F.least("size", F.lit(n) + F.coalesce("skip", F.lit(0))))
    needed = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("depth") - 1) / BAND))
    asked = asked.where("depth > 0").withColumn("band", F.explode(needed)).drop("size", "skip")
    # Dealt by user before the lists make many rows of it: what a user reads stays in one task.
    asked = asked.join(outs.drop("skip"), ["user_id", "genre", "band"], "left").repartition("user_id")
    read = asked.join(broadcast_if_small(lists, 80), ["genre", "band"]).where(F.col("place") < F.col("depth"))
    seen = F.coalesce(F.array_contains("out", F.col("movie_id")), F.lit(False))
    return read.where(~seen).select(*liked.columns, "movie_id", "tmdb_popularity")


def popular_by_genres(
    liked: DataFrame, catalog: DataFrame, excluded: DataFrame, n: int = 50, min_votes: int = 100, min_average: float = 6.0
) -> DataFrame:
    """Most popular good movies sharing a liked genre, per user.

    Within a genre movies are ranked once for everybody. A user needs, per genre, the best
    n + (own exclusions there) of them at most, which bounds the rows made per user and
    still gives the exact result.
    """
    order = [F.col("tmdb_popularity").desc_nulls_last(), F.col("movie_id")]
    lists = staged(_genre_lists(quality_movies(catalog, min_votes, min_average), order))
    read = _read_lists(liked.select("user_id", "genre"), lists, excluded, n).select("user_id", "movie_id", "tmdb_popularity").distinct()
    best = Window.partitionBy("user_id").orderBy(*order)
    return (
        read.withColumn("rank", F.row_number().over(best).cast("bigint"))
        .where(F.col("rank") <= n)
        .select("user_id", "movie_id", F.col("tmdb_popularity").alias("score"), "rank")
    )


# A quadratic generator modulo the prime 2**31 - 1.
PRIME = 2_147_483_647
SEED_FACTOR, MOVIE_FACTOR, MIX_FACTOR, MIX_OFFSET = 48_271, 69_621, 16_807, 12_345


def random_key(seed: Column, movie: Column) -> Column:
    """Repeatable random order of movies under a seed."""
    prime = F.lit(PRIME).cast("bigint")
    mixed = F.pmod(seed.cast("bigint") * SEED_FACTOR + movie.cast("bigint") * MOVIE_FACTOR, prime)
    return F.pmod(mixed * F.pmod(mixed * MIX_FACTOR + MIX_OFFSET, prime), prime)


def random_keys(seed: np.ndarray, movies: np.ndarray) -> np.ndarray:
    """The same keys for many users (a column of seeds) and movies at once."""
    mixed = (seed * SEED_FACTOR + movies * MOVIE_FACTOR) % PRIME
    return mixed * ((mixed * MIX_FACTOR + MIX_OFFSET) % PRIME) % PRIME


# Users and movies that meet in one task.
DRAW_USERS, DRAW_MOVIES = 8_192, 262_144


def random_by_genres(
    liked: DataFrame,
    catalog: DataFrame,
    excluded: DataFrame,
    seeds: DataFrame,
    n: int = 75,
    min_votes: int = 100,
    min_average: float = 6.0,
    *,
    users_per_block: int = DRAW_USERS,
    movies_per_block: int = DRAW_MOVIES,
) -> DataFrame:
    """Seeded random good movies sharing a liked genre, per user; `seeds` has (user_id, seed).

    Every good movie of a user's genres gets its own key under that user's seed, so no shared order
    can cut the list. Users and movies meet in blocks: a task draws, genre by genre, the n lowest keys
    per user of its block, without the excluded movies, and a last rank joins the blocks. The pairs
    themselves never exist as rows.
    """
    movies = quality_movies(catalog, min_votes, min_average)
    by_genre = staged(movies.select(F.col("movie_id").cast("bigint"), F.explode(F.array_distinct("genres")).alias("genre")).dropna().distinct())
    wanted = staged(liked.select("user_id", "genre").distinct().join(seeds.select("user_id", "seed"), "user_id").select(
        F.col("user_id").cast("bigint"), "genre", F.pmod(F.col("seed").cast("bigint"), F.lit(PRIME).cast("bigint")).alias("seed")
    ))
    distinct = lambda rows, key: rows.select(key).distinct().count()
    asking = distinct(wanted, "user_id")
    user_blocks = max(1, -(-asking // users_per_block), min(movies.sparkSession.sparkContext.defaultParallelism, -(-asking // USERS_PER_STEP)))
    movie_blocks = max(1, -(-distinct(by_genre, "movie_id") // movies_per_block))
    user_block = F.pmod(F.xxhash64("user_id"), F.lit(user_blocks)).cast("int").alias("user_block")
    movie_block = F.pmod(F.xxhash64("movie_id"), F.lit(movie_blocks)).cast("int").alias("movie_block")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    gone = excluded.select(F.col("user_id").cast("bigint"), F.col("movie_id").cast("bigint"))
    lists = (
        gone.join(wanted.select("user_id", "genre"), "user_id")
        .join(by_genre, ["movie_id", "genre"], "left_semi")
        .groupBy("user_id", "genre", movie_block)
        .agg(F.collect_set("movie_id").alias("out"))
    )
    asked = wanted.select("*", user_block, each(movie_blocks).alias("movie_block")).join(lists, ["user_id", "genre", "movie_block"], "left")
    offered = by_genre.select("*", movie_block, each(user_blocks).alias("user_block"))
    keys = ["user_block", "movie_block"]

    def draw(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros((0, 3), dtype=np.int64)]
        liking, listing = _rows_by_genre(left), _rows_by_genre(right)
        for genre, places in liking.items():
            if genre in listing:
                ids = np.sort(right.column("movie_id").to_numpy()[listing[genre]])
                found.extend(_draws(left.take(pa.array(places)), ids, n))
        return pa.table(dict(zip(("user_id", "movie_id", "draw"), map(pa.array, _lowest(np.concatenate(found), n).T), strict=True)))

    drawn = asked.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInArrow(draw, "user_id bigint, movie_id bigint, draw bigint")
    best = Window.partitionBy("user_id").orderBy("draw", "movie_id")
    return (
        drawn.withColumn("rank", F.row_number().over(best).cast("bigint"))
        .where(F.col("rank") <= n)
        .select("user_id", "movie_id", F.lit(None).cast("double").alias("score"), "rank")
    )


def _rows_by_genre(table: pa.Table) -> dict[str, np.ndarray]:
    """Places of the rows of each genre."""
    if not table.num_rows:
        return {}
    coded = table.column("genre").combine_chunks().dictionary_encode()
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    ends = np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))
    return dict(zip(coded.dictionary.to_pylist(), np.split(order, ends[:-1]), strict=True))


def _draws(users: pa.Table, ids: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """(user, movie, key) of each user's n lowest keys among the movies of one genre, in steps."""
    user_ids, own = users.column("user_id").to_numpy(), users.column("seed").to_numpy()
    gone = users.column("out").to_pylist()
    rows = max(1, DRAW_CELLS // len(ids))
    for at in range(0, len(user_ids), rows):
        draws = random_keys(own[at : at + rows, None], ids[None])
        for i, skipped in enumerate(gone[at : at + rows]):
            if skipped:
                draws[i, np.searchsorted(ids, np.array(skipped))] = PRIME
        if n < len(ids):
            limit = np.partition(draws, n - 1, axis=1)[:, n - 1, None]
            user, movie = np.nonzero((draws <= limit) & (draws < PRIME))
        else:
            user, movie = np.nonzero(draws < PRIME)
        yield np.stack([user_ids[at + user], ids[movie], draws[user, movie]], axis=1)


def _lowest(found: np.ndarray, n: int) -> np.ndarray:
    """Each user's n rows of lowest key; a movie met in several genres counts once."""
    found = found[np.lexsort((found[:, 1], found[:, 2], found[:, 0]))]
    found = found[np.r_[True, (found[1:] != found[:-1]).any(axis=1)]] if len(found) else found
    starts = np.flatnonzero(np.r_[True, found[1:, 0] != found[:-1, 0]]) if len(found) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[starts, len(found)])
    return found[np.arange(len(found)) - np.repeat(starts, counts) < n]


# Keys that one step of a task holds.
DRAW_CELLS = 1 << 20


def sample_knn_tail(pool: DataFrame, seeds: DataFrame, skip: int = 150, n: int = 75) -> DataFrame:
    """Seeded sample without replacement from the nearest movies after the first `skip`."""
    tail = pool.where(F.col("rank") > skip).join(seeds, "user_id")
    best = Window.partitionBy("user_id").orderBy(random_key(F.col("seed"), F.col("movie_id")), "movie_id")
    return (
        tail.withColumn("draw_rank", F.row_number().over(best).cast("bigint"))
        .where(F.col("draw_rank") <= n)
        .select("user_id", "movie_id", "score", F.col("draw_rank").alias("rank"))
    )


# ---------------------------------------------------------------- merging


def bucket(df: DataFrame, source: str) -> DataFrame:
    return df.select("user_id", "movie_id", "score", "rank", F.lit(source).alias("retrieval_source"))


def merge_buckets(buckets: list[DataFrame], cap: int = 300) -> DataFrame:
    """Concatenate labelled buckets per user, keep the earlier copy of a movie, cut at `cap`."""
    both = buckets[0]
    for other in buckets[1:]:
        both = both.unionByName(other)
    priority = F.lit(len(BUCKET_PRIORITY))
    for source, place in BUCKET_PRIORITY.items():
        priority = F.when(F.col("retrieval_source") == source, F.lit(place)).otherwise(priority)
    placed = both.withColumn("__place", F.struct(priority.alias("p"), F.col("rank").alias("r")))
    first = placed.groupBy("user_id", "movie_id").agg(
        F.min("__place").alias("__place"),
        F.min_by("retrieval_source", "__place").alias("retrieval_source"),
        F.min_by("score", "__place").alias("score"),
    )
    order = Window.partitionBy("user_id").orderBy("__place", "movie_id")
    return (
        first.withColumn("pool_rank", F.row_number().over(order).cast("bigint"))
        .where(F.col("pool_rank") <= cap)
        .select("user_id", "movie_id", "retrieval_source", "score", "pool_rank")
    )


def candidate_pool(
    profiles: DataFrame,
    vectors: DataFrame,
    catalog: DataFrame,
    liked: DataFrame,
    excluded: DataFrame,
    seeds: DataFrame,
    sizes: RetrievalSizes = RetrievalSizes(),
) -> DataFrame:
    """All buckets for all users: with liked genres nearest + popular + random, else nearest + sampled tail."""
    allowed = vectors.join(safe_movies(catalog).select("movie_id"), "movie_id", "left_semi")
    fans = liked.select("user_id").distinct().withColumn("has_liked", F.lit(True))
    pool = max(sizes.knn, sizes.knn_pool)
    asked = profiles.join(fans, "user_id", "left").withColumn(
        "k", F.when(F.col("has_liked"), F.lit(sizes.knn)).otherwise(F.lit(pool))
    )
    near = knn(asked, allowed, excluded, pool, depth="k")
    indexed = catalog.join(vectors.select("movie_id"), "movie_id", "left_semi")
    popular = popular_by_genres(liked, indexed, excluded, sizes.popular, sizes.min_votes, sizes.min_average)
    drawn = random_by_genres(liked, indexed, excluded, seeds, sizes.random_genre, sizes.min_votes, sizes.min_average)
    return merge_buckets(
        [near_buckets(near, fans, seeds, sizes), bucket(popular, POPULAR), bucket(drawn, RANDOM_GENRE)],
        sizes.max_candidates,
    )


def near_buckets(near: DataFrame, fans: DataFrame, seeds: DataFrame, sizes: RetrievalSizes) -> DataFrame:
    """Nearest movies and, for users without liked genres, the sampled tail, from one pass over the hits."""
    flagged = near.join(fans, "user_id", "left").join(seeds, "user_id")
    in_tail = F.col("has_liked").isNull() & F.col("rank").between(sizes.random_knn_skip + 1, sizes.knn_pool)
    labels = F.array(F.when(F.col("rank") <= sizes.knn, KNN), F.when(in_tail, RANDOM_KNN))
    rows = flagged.select("*", F.explode(F.array_compact(labels)).alias("retrieval_source"))
    sampled = F.col("retrieval_source") == RANDOM_KNN
    draw = F.when(sampled, random_key(F.col("seed"), F.col("movie_id"))).otherwise(F.col("rank"))
    order = Window.partitionBy("user_id", "retrieval_source").orderBy(draw, "movie_id")
    placed = rows.withColumn("rank", F.row_number().over(order).cast("bigint"))
    kept = placed.where(~sampled | (F.col("rank") <= sizes.random_knn))
    return kept.select("user_id", "movie_id", "score", "rank", "retrieval_source")
