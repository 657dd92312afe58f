"""Recommendations for all eligible users in one batch, and the feedback loop."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions.events import name_uuid
from tastemill.functions.numeric import daily_seed, model_slots
from tastemill.models.ranker import Layers, forward
from tastemill.operators import experiment as ex
from tastemill.operators import history as h
from tastemill.operators import retrieval as rt
from tastemill.operators.features import assemble_matrix, metadata_space
from tastemill.operators.ranking import merge_model_rankings
from tastemill.operators.vectors import VectorSpace, small_enough, stack_lists, vector_table, with_vector, without_null_lists
from tastemill.session import freed_shuffles, staged


@dataclass(frozen=True)
class RankingModel:
    """Exported layers of one model and the factors it was trained with."""

    version: str
    layers: Layers
    cf: VectorSpace


def eligible_ratings(
    events: DataFrame, catalog: DataFrame, new_ratings: DataFrame | None = None, minimum: int = h.MIN_RATINGS_TO_RECOMMEND
) -> DataFrame:
    """Active ratings, with request ratings laid over, of users having enough of them."""
    columns = ["user_id", "movie_id", "rating", "rating_timestamp", "id"]
    merged = h.active_ratings(events).select(columns)
    if new_ratings is not None:
        merged = h.overlay_ratings(merged, h.known_movies(new_ratings, catalog))
    ready = h.user_rating_counts(merged, minimum).where("can_recommend")
    return h.of_users(merged, ready)


# Pool rows, users and movies that meet in one task, and rows scored at a time.
SCORE_ROWS, SCORE_USERS, SCORE_MOVIES = 1 << 21, 1 << 16, 1 << 17
SCORE_STEP = 8_192


def score_pool(
    pool: DataFrame,
    users: DataFrame,
    content: VectorSpace,
    cf: VectorSpace,
    metadata: VectorSpace,
    models: dict[str, RankingModel],
    *,
    best: int | None = None,
    rows_per_block: int = SCORE_ROWS,
    users_per_block: int = SCORE_USERS,
    movies_per_block: int = SCORE_MOVIES,
) -> DataFrame:
    """Scores of every pool row by each model (role -> model), all fed with the same vectors.

    `users` has user_id, content_profile, cf_profile and behavior. Small movie tables go to the
    tasks whole. Else users and movies are dealt into blocks and a task is one pair of blocks: it
    holds the vectors of both while their pool rows stream past as plain ids. So a vector is
    written once per block that it meets, never once per candidate. With `best`, rows that so many
    of the same user and model are ahead of may be left out; what is returned still has to be ranked.
    """
    spaces = [content, cf, metadata]
    tables = {s.name: vector_table(s) for s in spaces if small_enough(s)}
    joined = [s for s in spaces if s.name not in tables]
    ids = [F.col(c).cast("bigint").alias(c) for c in ("user_id", "movie_id", "pool_rank")]
    rows = pool.where(F.col("user_id").isNotNull()).select(*ids, "retrieval_source")
    known = users.where(F.col("user_id").isNotNull()).select(ids[0], F.concat("content_profile", "cf_profile", "behavior").alias("doubles"))
    kinds = {kind: [s for s in joined if s.kind == kind] for kind in ("float", "double")}
    movies, count = None, 0
    if joined:
        movies = staged(rows.select("movie_id").distinct())
        count = movies.count()
        for space in joined:
            movies = with_vector(movies, space, hint_small=False)
        movies = movies.select("movie_id", *[
            F.concat(*[f"{s.name}_vector" for s in own]).alias(f"{kind}s") for kind, own in kinds.items() if own
        ])
    asked = users.count()
    widths = {"user": (content.dim + cf.dim + 5) * 8, "movie": sum(s.dim * (4 if s.kind == "float" else 8) for s in joined)}
    tasks = max(1, -(-rows.count() // rows_per_block), min(pool.sparkSession.sparkContext.defaultParallelism, -(-asked // 256)))
    user_blocks, movie_blocks = _grid(tasks, asked * widths["user"], count * widths["movie"], -(-asked // users_per_block), -(-count // movies_per_block))
    user_block = F.pmod(F.xxhash64("user_id"), F.lit(user_blocks)).cast("int")
    movie_block = F.pmod(F.xxhash64("movie_id"), F.lit(movie_blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    block = lambda user, movie: (user * movie_blocks + movie).alias("block")
    # Of a block, first the movies come, then the users, then the pool rows.
    told = known.select("*", each(movie_blocks).alias("met")).select(block(user_block, F.col("met")), F.lit(1).alias("kind"), *known.columns)
    told = told.unionByName(rows.select(block(user_block, movie_block), F.lit(2).alias("kind"), "*"), allowMissingColumns=True)
    if joined:
        offered = movies.select("*", each(user_blocks).alias("met"))
        told = told.unionByName(offered.select(block(F.col("met"), movie_block), F.lit(0).alias("kind"), *movies.columns), allowMissingColumns=True)
    told = without_null_lists(told).fillna("", ["retrieval_source"])
    laid_out = told.repartitionById(user_blocks * movie_blocks, F.col("block")).sortWithinPartitions("block", "kind", "user_id")
    shapes = {kind: [(s.name, s.dim) for s in own] for kind, own in kinds.items()}
    dims = {s.name: s.dim for s in spaces}
    shared = pool.sparkSession.sparkContext.broadcast((tables, {r: (m.version, m.layers) for r, m in models.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, nets = shared.value
        current, held = None, None
        for batch in batches:
            place = batch.column("block").to_numpy().astype(np.int64) * 3 + batch.column("kind").to_numpy()
            for value in np.unique(place):
                part = batch.slice(int(np.searchsorted(place, value)), int((place == value).sum()))
                if current != value // 3:
                    current, held = value // 3, _ScoreBlock(tables, dims, shapes)
                if value % 3 == 0:
                    held.offer(part)
                elif value % 3 == 1:
                    held.ask(part)
                else:
                    for at in range(0, part.num_rows, SCORE_STEP):
                        yield from held.score(part.slice(at, SCORE_STEP), nets, best)

    schema = (
        "user_id bigint, movie_id bigint, pool_rank bigint, retrieval_source string, "
        "model_role string, model_version string, predicted_score double"
    )
    return laid_out.mapInArrow(run, schema)


def _grid(tasks: int, user_bytes: int, movie_bytes: int, least_users: int, least_movies: int) -> tuple[int, int]:
    """Blocks of users and of movies, at least so many and `tasks` pairs, that copy the fewest bytes."""
    low = max(1, least_movies)
    sized = [(max(1, least_users, -(-tasks // movies)), movies) for movies in range(low, max(low, tasks if movie_bytes else 1) + 1)]
    return min(sized, key=lambda blocks: user_bytes * blocks[1] + movie_bytes * blocks[0])


def _matches(ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of `keys`, place in the sorted `ids`) of every equal pair."""
    low, high = np.searchsorted(ids, keys), np.searchsorted(ids, keys, side="right")
    row = np.repeat(np.arange(len(keys)), high - low)
    turn = np.arange(len(row)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
    return row, low[row] + turn


class _ScoreBlock:
    """The vectors of one block of users and one of movies, while their pool rows stream past."""

    def __init__(self, tables: dict, dims: dict[str, int], shapes: dict[str, list[tuple[str, int]]]):
        self.tables, self.dims, self.shapes = tables, dims, shapes
        self.asked, self.offered, self.users = [], [], None

    def ask(self, part: pa.RecordBatch) -> None:
        width = self.dims["content"] + self.dims["cf"] + 5
        self.asked.append((part.column("user_id").to_numpy(), stack_lists(part.column("doubles"), width)))

    def offer(self, part: pa.RecordBatch) -> None:
        stacked = [stack_lists(part.column(f"{kind}s"), sum(dim for _, dim in own)) for kind, own in self.shapes.items() if own]
        self.offered.append((part.column("movie_id").to_numpy(), *stacked))

    def _begin(self) -> None:
        self.users, self.profiles = _sorted_by_id(self.asked)
        self.movies, *stacked = _sorted_by_id(self.offered)
        self.vectors = {}
        for own, matrix in zip([own for own in self.shapes.values() if own], stacked, strict=True):
            ends = np.cumsum([dim for _, dim in own])
            self.vectors.update({name: matrix[:, end - dim : end] for (name, dim), end in zip(own, ends, strict=True)})
        self.asked, self.offered = [], []

    def score(self, part: pa.RecordBatch, nets: dict[str, tuple[str, Layers]], best: int | None = None) -> Iterator[pa.RecordBatch]:
        if self.users is None:
            if not self.asked:
                return
            self._begin()
        row, user = _matches(self.users, part.column("user_id").to_numpy())
        movies = part.column("movie_id").to_numpy()[row]
        if any(self.shapes.values()):
            again, movie = _matches(self.movies, movies)
            row, user, movies = row[again], user[again], movies[again]

        def vectors(name: str) -> np.ndarray:
            found = self.tables[name].rows(movies)[0] if name in self.tables else self.vectors[name][movie]
            return found.astype(np.float64)

        content, cf = self.dims["content"], self.dims["cf"]
        own = self.profiles[user].astype(np.float64)
        matrix = assemble_matrix(
            own[:, :content], vectors("content"), own[:, content : content + cf], vectors("cf"), own[:, content + cf :], vectors("metadata")
        )
        named = part.select(["user_id", "movie_id", "pool_rank", "retrieval_source"])
        for role, (version, layers) in nets.items():
            scores = forward(matrix, layers)
            kept = np.arange(len(row)) if best is None else _ahead(self.users[user], scores, named.column("pool_rank").to_numpy()[row], best)
            rows = named.take(pa.array(row[kept]))
            yield pa.RecordBatch.from_pydict(
                {
                    **{c: rows.column(c) for c in named.schema.names},
                    "model_role": pa.array([role] * len(kept), pa.string()),
                    "model_version": pa.array([version] * len(kept), pa.string()),
                    "predicted_score": pa.array(scores[kept]),
                }
            )


def _ahead(users: np.ndarray, scores: np.ndarray, ranks: np.ndarray, best: int) -> np.ndarray:
    """Places of each user's `best` rows by falling score (NaN first, as in Spark), then rank."""
    order = np.lexsort((ranks, np.where(np.isnan(scores), -np.inf, -scores), users))
    starts = np.flatnonzero(np.diff(users[order], prepend=users[order][:1] - 1))
    turn = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[turn < best]


def _sorted_by_id(parts: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """The parts' arrays one behind the other, in order of the first."""
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)] or [np.zeros(0, np.int64)]
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


def user_inputs(ratings: DataFrame, content: VectorSpace, cf: VectorSpace) -> DataFrame:
    """user_id, content_profile, cf_profile and behavior array of every user."""
    profiles = h.weighted_profiles(ratings, [content, cf])
    behavior = h.user_behavior(ratings)
    packed = behavior.select("user_id", F.array(*[F.col(c).cast("double") for c in h.BEHAVIOR_FIELDS]).alias("behavior"))
    return profiles.join(packed, "user_id").select("user_id", "content_profile", "cf_profile", "behavior")


def recommend_batch(
    events: DataFrame,
    catalog: DataFrame,
    content: VectorSpace,
    stats: dict[str, float],
    main: RankingModel,
    now: Column,
    *,
    candidate: RankingModel | None = None,
    candidate_fraction: float = 0.0,
    experiment_id: str | None = None,
    new_ratings: DataFrame | None = None,
    shown: DataFrame | None = None,
    token: str | None = None,
    top_k: int = 20,
    sizes: rt.RetrievalSizes = rt.RetrievalSizes(),
) -> DataFrame:
    """Impression rows (one ranked list per eligible user) ready to be appended to the log.

    The merged ratings, the user inputs, the exclusions and the liked genres feed several
    branches, so they are staged instead of being computed per branch.
    """
    with freed_shuffles(events.sparkSession):
        ratings = staged(eligible_ratings(events, catalog, new_ratings))
        users = staged(user_inputs(ratings, content, main.cf))
        if shown is None:
            excluded = ratings.select("user_id", "movie_id").distinct()
        else:
            excluded = h.exclude_ids(ratings, shown.join(users.select("user_id"), "user_id", "left_semi"))
        excluded, liked = staged(excluded), staged(h.liked_genres(ratings, catalog, sizes.liked_genres))
        seeds = users.select("user_id", daily_seed(F.col("user_id"), now, F.lit(token or "")).alias("seed"))
        pool = staged(rt.candidate_pool(users, content.movies, catalog, liked, excluded, seeds, sizes).drop("score"))
        metadata = metadata_space(catalog, stats, "double")
        challenged = candidate is not None and candidate_fraction > 0
        models = {"main": main}
        if challenged and candidate.cf is main.cf:
            models["candidate"] = candidate
        scored = score_pool(pool, users, content, main.cf, metadata, models, best=top_k)
        if challenged and candidate.cf is not main.cf:
            # The challenger was trained with other factors, so it needs its own profiles.
            inputs = staged(user_inputs(ratings, content, candidate.cf))
            scored = scored.unionByName(score_pool(pool, inputs, content, candidate.cf, metadata, {"candidate": candidate}, best=top_k))
    slots = model_slots(F.lit(top_k), F.lit(float(candidate_fraction)), F.lit(challenged))
    shares = users.select("user_id", slots.alias("s")).select("user_id", "s.main_slots", "s.candidate_slots")
    merged = merge_model_rankings(_ranked(scored, top_k), shares, top_k)
    request = name_uuid(F.concat_ws(":", F.lit("request"), F.col("user_id").cast("string"), F.unix_micros(now).cast("string"), F.lit(token or "")))
    return merged.select(
        F.concat(F.lit("rec-"), request).alias("request_id"),
        "user_id",
        "movie_id",
        "rank_position",
        "model_version",
        "model_role",
        F.lit(experiment_id).cast("string").alias("experiment_id"),
        "predicted_score",
        now.alias("shown_at"),
        "retrieval_source",
    )


def _ranked(scored: DataFrame, top_k: int) -> DataFrame:
    """Each model's best rows per user; no model gets more than top_k slots."""
    best = Window.partitionBy("user_id", "model_role").orderBy(F.col("predicted_score").desc(), "pool_rank")
    ranked = scored.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= top_k)
    return ranked.drop("pool_rank")


@dataclass
class FeedbackResult:
    log: DataFrame
    experiments: DataFrame
    states: DataFrame


def experiment_feedback(
    log: DataFrame, experiments: DataFrame, new: DataFrame, now: Column, policy: ex.SplitPolicy = ex.SplitPolicy()
) -> FeedbackResult:
    """Append new feedback and move the splits of the experiments it belongs to.

    The folded states feed the experiment table and the report, so they are staged.
    """
    states = staged(ex.split_states(new, experiments, policy, earlier=log))
    return FeedbackResult(ex.append_log(log, new), ex.apply_split_states(experiments, states, now), states)
