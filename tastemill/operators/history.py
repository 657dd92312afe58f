"""Rating history: active ratings, user behaviour, and point-in-time features.

Everything ordered per user runs over slices of (user, time, id). Users that continue
across a slice border are the only ones needing a carried-in state, and there are at most
as many of those as slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.operators.slices import SLICE, SlicePlan, carried, edge_rows, plan_slices, with_slice
from tastemill.operators.vectors import (
    VectorSpace,
    VectorTable,
    small_enough,
    stack_lists,
    vector_table,
    with_vector,
)
from tastemill.session import staged

# Rating thresholds of the feature schema.
HIGH_RATING = 4.0
LOW_RATING = 2.0
MIN_RATINGS_TO_RECOMMEND = 5

# Rows walked at a time; bounds the memory for wide feature rows.
WALK_ROWS = 2048
USER_ORDER = ["user_id", "rating_timestamp", "id"]
BEHAVIOR_FIELDS = (
    "num_user_ratings",
    "user_avg_rating",
    "user_rating_std",
    "num_high_rated_movies",
    "num_low_rated_movies",
)
_TOTALS = ("h_count", "h_sum", "h_sum_sq", "h_high", "h_low")


# ---------------------------------------------------------------- active ratings


def latest_per_key(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key; the rank limit keeps one row per key and task before the shuffle."""
    newest_first = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return events.withColumn("__turn", F.row_number().over(newest_first)).where(F.col("__turn") == 1).select(*events.columns)


def latest_ratings(events: DataFrame) -> DataFrame:
    return latest_per_key(events, ["user_id", "movie_id"], ["rating_timestamp", "id"])


def active_ratings(events: DataFrame) -> DataFrame:
    """Ratings in force: the newest event of (user, movie), if it is a rating and not a removal."""
    return latest_ratings(events).where((F.col("event_type") == "rating_created") & F.col("rating").isNotNull())


def select_ratings(events: DataFrame, mode: str = "raw") -> DataFrame:
    """`raw` = every event, `created` = without removals, `latest` = active ratings only."""
    if mode == "raw":
        return events
    if mode == "created":
        return events.where((F.col("event_type") == "rating_created") & F.col("rating").isNotNull())
    if mode == "latest":
        return active_ratings(events)
    raise ValueError(f"unknown rating mode {mode!r}")


def user_rating_counts(active: DataFrame, minimum: int = MIN_RATINGS_TO_RECOMMEND) -> DataFrame:
    return (
        active.groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("rating_count"))
        .withColumn("can_recommend", F.col("rating_count") >= minimum)
    )


def overlay_ratings(history: DataFrame, new: DataFrame) -> DataFrame:
    """Later ratings of the same (user, movie) replace the stored value but keep its place in time."""
    columns = ["user_id", "movie_id", "rating", "rating_timestamp", "id"]
    both = history.select(*columns, F.lit(0).alias("__turn")).unionByName(new.select(*columns, F.lit(1).alias("__turn")))
    place = F.struct("__turn", "rating_timestamp", "id")
    merged = both.groupBy("user_id", "movie_id").agg(
        F.max_by("rating", place).alias("rating"),
        F.min_by(F.struct("rating_timestamp", "id"), place).alias("__first"),
    )
    return merged.select("user_id", "movie_id", "rating", "__first.rating_timestamp", "__first.id")


def ratings_with_catalog(active: DataFrame, catalog: DataFrame) -> DataFrame:
    """Active ratings with display columns of the movie; sort by time descending to show them."""
    shown = catalog.select("movie_id", "title", "year", "genres", "poster_path", "poster_safe", "certification_us")
    return active.join(shown, "movie_id")


def known_movies(df: DataFrame, catalog: DataFrame) -> DataFrame:
    return df.join(catalog.select("movie_id"), "movie_id", "left_semi")


def unknown_movies(df: DataFrame, catalog: DataFrame) -> DataFrame:
    return df.join(catalog.select("movie_id"), "movie_id", "left_anti")


def of_users(df: DataFrame, users: DataFrame) -> DataFrame:
    return df.join(users.select("user_id"), "user_id", "left_semi")


def candidate_users(mapped: DataFrame) -> DataFrame:
    return mapped.select("user_id").distinct()


def mark_targets(ratings: DataFrame, candidates: DataFrame) -> DataFrame:
    """Label each rating with the split it is a target of; NULL means history only."""
    return ratings.join(candidates.select("id", "split"), "id", "left")


def exclude_ids(active: DataFrame, shown: DataFrame, cap: int = 60) -> DataFrame:
    """Rated movies plus the first `cap` distinct ids of each user's recently shown list."""
    recent = shown.select(
        "user_id", F.explode(F.slice(F.array_distinct("shown_movie_ids"), 1, cap)).alias("movie_id")
    )
    return active.select("user_id", "movie_id").unionByName(recent).distinct()


def without_pairs(df: DataFrame, pairs: DataFrame) -> DataFrame:
    return df.join(pairs.select("user_id", "movie_id"), ["user_id", "movie_id"], "left_anti")


# ---------------------------------------------------------------- behaviour


def _total_columns(rating: Column) -> list[Column]:
    return [
        F.count(rating),
        F.sum(rating),
        F.sum(rating * rating),
        F.count_if(rating >= HIGH_RATING),
        F.count_if(rating <= LOW_RATING),
    ]


def behavior_columns(count: Column, total: Column, total_sq: Column, high: Column, low: Column) -> list[Column]:
    """The five behaviour values from running totals (population deviation, 0 below two ratings)."""
    mean = total / count
    variance = F.greatest(F.lit(0.0), total_sq / count - mean * mean)
    return [
        count.alias("num_user_ratings"),
        F.when(count > 0, mean).otherwise(0.0).alias("user_avg_rating"),
        F.when(count > 1, F.sqrt(variance)).otherwise(0.0).alias("user_rating_std"),
        high.alias("num_high_rated_movies"),
        low.alias("num_low_rated_movies"),
    ]


def user_behavior(ratings: DataFrame) -> DataFrame:
    rating = F.col("rating")
    totals = ratings.groupBy("user_id").agg(
        *[c.alias(n) for n, c in zip(_TOTALS, _total_columns(rating), strict=True)]
    )
    return totals.select("user_id", *behavior_columns(*[F.col(n) for n in _TOTALS]))


def pit_behavior(ratings: DataFrame, *, rows_per_slice: int | None = None) -> DataFrame:
    """Behaviour values over each user's strictly earlier ratings."""
    plan = plan_slices(ratings, USER_ORDER, rows_per_slice=rows_per_slice)
    sliced = with_slice(ratings, plan)
    rating = F.col("rating")
    before = (
        Window.partitionBy(SLICE, "user_id")
        .orderBy("rating_timestamp", "id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    named = list(zip(_TOTALS, _total_columns(rating), strict=True))
    walked = sliced.select("*", *[c.over(before).alias(n) for n, c in named])
    if plan.count > 1:
        partial = edge_rows(sliced, plan, "user_id").groupBy(SLICE, "user_id").agg(*[c.alias(n) for n, c in named])
        carry = carried(partial, "user_id", list(_TOTALS)).select(
            SLICE, "user_id", *[F.col(n).alias(f"c_{n}") for n in _TOTALS]
        )
        walked = walked.join(F.broadcast(carry), [SLICE, "user_id"], "left")
        totals = [F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"c_{n}"), F.lit(0)) for n in _TOTALS]
    else:
        totals = [F.coalesce(F.col(n), F.lit(0)) for n in _TOTALS]
    return walked.select(*ratings.columns, *behavior_columns(*totals))


# ---------------------------------------------------------------- profiles by ordered walk


@dataclass(frozen=True)
class SpaceShape:
    """The part of a vector space that tasks need."""

    name: str
    dim: int
    profiled: bool


@dataclass
class WalkBatch:
    """Arrays of one batch: the rows asked for and each user's state before every row."""

    columns: dict[str, np.ndarray]
    count: np.ndarray
    total: np.ndarray
    total_sq: np.ndarray
    high: np.ndarray
    low: np.ndarray
    sums: dict[str, np.ndarray]
    vectors: dict[str, np.ndarray]
    missing: dict[str, np.ndarray]

    def profile(self, space: str) -> np.ndarray:
        """Rating-weighted mean vector before each row; zeros where the weight is not positive."""
        weight = self.total[:, None]
        safe = np.where(weight > 0, weight, 1.0)
        return np.where(weight > 0, self.sums[space] / safe, 0.0)

    def behavior(self) -> np.ndarray:
        n = np.maximum(self.count, 1)
        mean = self.total / n
        variance = np.maximum(0.0, self.total_sq / n - mean * mean)
        deviation = np.where(self.count > 1, np.sqrt(variance), 0.0)
        return np.stack([self.count, mean, deviation, self.high, self.low], axis=1).astype(np.float64)


@dataclass
class _UserState:
    user: int | None = None
    totals: np.ndarray = field(default_factory=lambda: np.zeros(5))
    sums: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, user: int, dims: dict[str, int]) -> None:
        self.user = user
        self.totals = np.zeros(5)
        self.sums = {name: np.zeros(dim) for name, dim in dims.items()}


def _running_before(start: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state before each row, state after the last row) for additive values."""
    after = start + np.cumsum(values, axis=0)
    return np.concatenate([start[None], after[:-1]]), after[-1]


def walk_batches(
    batches: Iterator[pa.RecordBatch],
    shapes: list[SpaceShape],
    tables: dict[str, VectorTable],
    keep: list[str],
) -> Iterator[WalkBatch]:
    """Walk rows sorted by user and time, holding only the current user's running totals.

    A carry row (id NULL) precedes a user's rows where the user began in an earlier slice.
    """
    dims = {s.name: s.dim for s in shapes if s.profiled}
    state = _UserState()
    for batch in (whole.slice(at, WALK_ROWS) for whole in batches for at in range(0, whole.num_rows, WALK_ROWS)):
        users = batch.column("user_id").to_numpy(zero_copy_only=False)
        is_carry = batch.column("carry").to_numpy(zero_copy_only=False).astype(bool)
        rating = np.nan_to_num(batch.column("rating").to_numpy(zero_copy_only=False).astype(np.float64))
        vectors, missing = {}, {}
        movies = np.nan_to_num(batch.column("movie_id").to_numpy(zero_copy_only=False)).astype(np.int64)
        for name, dim in ((s.name, s.dim) for s in shapes):
            if name in tables:
                vectors[name], missing[name] = tables[name].rows(movies)
            else:
                vectors[name] = np.zeros((batch.num_rows, dim))
                joined = batch.column(f"{name}_vector").filter(pa.array(~is_carry))
                vectors[name][~is_carry] = stack_lists(joined, dim)
                missing[name] = np.zeros(batch.num_rows, dtype=bool)
                flags = batch.column(f"missing_{name}").filter(pa.array(~is_carry))
                missing[name][~is_carry] = flags.to_numpy(zero_copy_only=False)
        steps = np.stack(
            [np.ones_like(rating), rating, rating * rating, rating >= HIGH_RATING, rating <= LOW_RATING], axis=1
        ).astype(np.float64)
        steps[is_carry] = 0.0
        before = np.zeros_like(steps)
        sums = {name: np.zeros((batch.num_rows, dim)) for name, dim in dims.items()}
        starts = np.flatnonzero(np.r_[True, users[1:] != users[:-1]])
        for lo, hi in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
            if users[lo] != state.user:
                state.start(users[lo], dims)
            if is_carry[lo]:
                state.totals = np.array([batch.column(c)[lo].as_py() for c in _TOTALS], dtype=np.float64)
                for name in dims:
                    state.sums[name] = np.array(batch.column(f"c_{name}")[lo].as_py(), dtype=np.float64)
            before[lo:hi], state.totals = _running_before(state.totals, steps[lo:hi])
            for name in dims:
                weighted = vectors[name][lo:hi].astype(np.float64) * rating[lo:hi, None]
                weighted[is_carry[lo:hi]] = 0.0
                sums[name][lo:hi], state.sums[name] = _running_before(state.sums[name], weighted)
        wanted = ~is_carry & batch.column("wanted").to_numpy(zero_copy_only=False).astype(bool)
        yield WalkBatch(
            columns={c: batch.column(c).filter(pa.array(wanted)) for c in keep},
            count=before[wanted, 0],
            total=before[wanted, 1],
            total_sq=before[wanted, 2],
            high=before[wanted, 3],
            low=before[wanted, 4],
            sums={n: s[wanted] for n, s in sums.items()},
            vectors={n: v[wanted] for n, v in vectors.items()},
            missing={n: m[wanted] for n, m in missing.items()},
        )


def walk_history(
    ratings: DataFrame,
    spaces: list[VectorSpace],
    build,
    schema: str,
    keep: list[str],
    *,
    wanted: Column | None = None,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Run `build(WalkBatch) -> RecordBatch` over every user's ratings in time order.

    Narrow rows are shuffled once, to their slice; the vectors of the rated movies go to the
    tasks where they are few, else they are joined on before the shuffle.
    """
    spark = ratings.sparkSession
    plan = plan_slices(ratings, USER_ORDER, rows_per_slice=rows_per_slice)
    sliced = with_slice(ratings, plan).withColumn("wanted", F.lit(True) if wanted is None else wanted)
    spaces = _rated(ratings, spaces)
    profiled = [s for s in spaces if s.profiled]
    sliced, tables = _attach_vectors(sliced, spaces)
    rows = sliced.withColumn("carry", F.lit(False))
    if plan.count > 1:
        rows = rows.unionByName(_carry_rows(sliced, plan, profiled), allowMissingColumns=True)
    else:
        empty = [F.lit(None).cast("double").alias(c) for c in _TOTALS]
        empty += [F.lit(None).cast("array<double>").alias(f"c_{s.name}") for s in profiled]
        rows = rows.select("*", *empty)
    shapes = [SpaceShape(s.name, s.dim, s.profiled) for s in spaces]
    shared = spark.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for walked in walk_batches(batches, shapes, shared.value, keep):
            yield build(walked)

    laid_out = rows.repartitionById(plan.count, F.col(SLICE)).sortWithinPartitions(
        F.col(SLICE), F.col("user_id"), F.col("carry").desc(), F.col("rating_timestamp"), F.col("id")
    )
    return laid_out.mapInArrow(run, schema)


def _rated(ratings: DataFrame, spaces: list[VectorSpace]) -> list[VectorSpace]:
    """The spaces with the vectors of rated movies only; others are never looked up."""
    rated = staged(ratings.select("movie_id").distinct())
    return [replace(s, movies=staged(s.movies.join(rated, "movie_id", "left_semi"))) for s in spaces]


def _attach_vectors(rows: DataFrame, spaces: list[VectorSpace]) -> tuple[DataFrame, dict[str, VectorTable]]:
    """Small vector tables as arrays for the tasks; larger ones joined on as columns."""
    tables: dict[str, VectorTable] = {}
    for space in spaces:
        if small_enough(space):
            tables[space.name] = vector_table(space)
        else:
            # One row per movie, as in a table: a repeated vector must not repeat ratings.
            once = replace(space, movies=space.movies.dropDuplicates(["movie_id"]))
            rows = with_vector(rows, once, hint_small=False)
    return rows, tables


def _carry_rows(sliced: DataFrame, plan: SlicePlan, spaces: list[VectorSpace]) -> DataFrame:
    """State at the start of each slice for users who began earlier.

    Ratings are first summed per (slice, user, movie), so one movie vector is weighted once
    however often it was rated.
    """
    edge = edge_rows(sliced, plan, "user_id")
    named = list(zip(_TOTALS, _total_columns(F.col("rating")), strict=True))
    totals = edge.groupBy(SLICE, "user_id").agg(*[c.cast("double").alias(n) for n, c in named])
    carry = carried(totals, "user_id", list(_TOTALS))
    weights = edge.groupBy(SLICE, "user_id", "movie_id").agg(F.sum("rating").alias("weight"))
    for space in spaces:
        placed = with_vector(weights, space).select(
            SLICE, "user_id", "weight", F.posexplode(f"{space.name}_vector").alias("pos", "value")
        )
        sums = placed.groupBy(SLICE, "user_id", "pos").agg(
            F.sum(F.col("weight") * F.col("value").cast("double")).alias("value")
        )
        earlier = Window.partitionBy("user_id", "pos").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        packed = (
            sums.withColumn("value", F.sum("value").over(earlier))
            .where(F.col("value").isNotNull())
            .groupBy(SLICE, "user_id")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("__v"))
            .select(SLICE, "user_id", F.col("__v.value").alias(f"c_{space.name}"))
        )
        carry = carry.join(packed, [SLICE, "user_id"])
    return carry.select("*", F.lit(True).alias("carry"), F.lit(False).alias("wanted"))


def list_column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A 2-d array as an Arrow list column."""
    rows, width = values.shape
    offsets = np.arange(0, (rows + 1) * width, width, dtype=np.int32) if width else np.zeros(rows + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1), type=kind))


def pit_profiles(ratings: DataFrame, spaces: list[VectorSpace], *, rows_per_slice: int | None = None) -> DataFrame:
    """(id, user_id, movie_id, prior_count, prior_weight, <space>_profile…) over strictly earlier ratings."""
    names = [s.name for s in spaces]

    def build(walked: WalkBatch) -> pa.RecordBatch:
        fields = {c: walked.columns[c] for c in ("id", "user_id", "movie_id")}
        fields["prior_count"] = pa.array(walked.count.astype(np.int64))
        fields["prior_weight"] = pa.array(walked.total)
        for name in names:
            fields[f"{name}_profile"] = list_column(walked.profile(name), pa.float64())
        return pa.RecordBatch.from_pydict(fields)

    schema = "id bigint, user_id bigint, movie_id bigint, prior_count bigint, prior_weight double"
    schema += "".join(f", {n}_profile array<double>" for n in names)
    narrow = ratings.select(
        F.col("user_id").cast("bigint"), F.col("movie_id").cast("bigint"), "rating", "rating_timestamp",
        F.col("id").cast("bigint"),
    )
    return walk_history(narrow, spaces, build, schema, ["id", "user_id", "movie_id"], rows_per_slice=rows_per_slice)


# ---------------------------------------------------------------- whole-history profiles


def weighted_profiles(ratings: DataFrame, spaces: list[VectorSpace], *, rows_per_slice: int | None = None) -> DataFrame:
    """Per user: rating_count, total_weight and one `<space>_profile` per space.

    Each slice emits one partial sum per user it holds. Only users at a slice border can
    have several; their sums are added up per array position.
    """
    narrow = ratings.select(F.col("user_id").cast("bigint"), F.col("movie_id").cast("bigint"), "rating")
    plan = plan_slices(narrow, ["user_id", "movie_id"], rows_per_slice=rows_per_slice)
    sliced, tables = _attach_vectors(with_slice(narrow, plan), _rated(narrow, spaces))
    dims = {s.name: s.dim for s in spaces}
    shared = ratings.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _partial_profiles(batches, dims, shared.value)

    schema = "user_id bigint, rating_count bigint, total_weight double"
    schema += "".join(f", {n}_sum array<double>" for n in dims)

    def partials(rows: DataFrame) -> DataFrame:
        laid_out = rows.repartitionById(plan.count, F.col(SLICE)).sortWithinPartitions("user_id")
        return laid_out.mapInArrow(run, schema)

    if plan.count == 1:
        summed = partials(sliced)
    else:
        edges = ratings.sparkSession.createDataFrame([(v,) for v in plan.edge_values()], "user_id bigint")
        inside = partials(sliced.join(F.broadcast(edges), "user_id", "left_anti"))
        across = partials(sliced.join(F.broadcast(edges), "user_id", "left_semi"))
        summed = inside.unionByName(_merge_partials(across, dims))
    weight = F.col("total_weight")
    profiles = [
        F.when(weight > 0, F.transform(F.col(f"{n}_sum"), lambda x: x / weight))
        .otherwise(F.array_repeat(F.lit(0.0), dims[n]))
        .alias(f"{n}_profile")
        for n in dims
    ]
    return summed.select("user_id", "rating_count", "total_weight", *profiles)


def _partial_profiles(batches, dims: dict[str, int], tables: dict[str, VectorTable]) -> Iterator[pa.RecordBatch]:
    """One output row per user run; a run continuing in the next batch is held back."""
    held: tuple | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        users = batch.column("user_id").to_numpy()
        rating = batch.column("rating").to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.flatnonzero(np.r_[True, users[1:] != users[:-1]])
        counts = np.diff(np.r_[starts, len(users)])
        weights = np.add.reduceat(rating, starts)
        sums = {}
        for name, dim in dims.items():
            if name in tables:
                vectors, _ = tables[name].rows(batch.column("movie_id").to_numpy())
            else:
                vectors = stack_lists(batch.column(f"{name}_vector"), dim)
            sums[name] = np.add.reduceat(vectors.astype(np.float64) * rating[:, None], starts, axis=0)
        rows = [users[starts].copy(), counts, weights, sums]
        if held is not None:
            if held[0][0] == rows[0][0]:
                rows[1][0] += held[1][0]
                rows[2][0] += held[2][0]
                for name in dims:
                    rows[3][name][0] += held[3][name][0]
            else:
                yield _partial_batch(*held)
        if len(starts) > 1:
            yield _partial_batch(*[r[:-1] for r in rows[:3]], {n: s[:-1] for n, s in rows[3].items()})
        held = (*[r[-1:] for r in rows[:3]], {n: s[-1:] for n, s in rows[3].items()})
    if held is not None:
        yield _partial_batch(*held)


def _partial_batch(users, counts, weights, sums) -> pa.RecordBatch:
    fields = {
        "user_id": pa.array(users),
        "rating_count": pa.array(counts.astype(np.int64)),
        "total_weight": pa.array(weights),
    }
    fields.update({f"{n}_sum": list_column(s, pa.float64()) for n, s in sums.items()})
    return pa.RecordBatch.from_pydict(fields)


def _merge_partials(partial: DataFrame, dims: dict[str, int]) -> DataFrame:
    """Add up the partial rows of each user: count, weight and all vectors as one summed list."""
    head = F.array(F.col("rating_count").cast("double"), F.col("total_weight"))
    values = F.concat(head, *[F.col(f"{n}_sum") for n in dims])
    packed = (
        partial.select("user_id", F.posexplode(values).alias("pos", "value"))
        .groupBy("user_id", "pos")
        .agg(F.sum("value").alias("value"))
        .groupBy("user_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("__v"))
        .select("user_id", F.col("__v.value").alias("__v"))
    )
    columns, at = [], 3
    for name, dim in dims.items():
        columns.append(F.slice("__v", at, dim).alias(f"{name}_sum"))
        at += dim
    return packed.select(
        "user_id", F.get("__v", 0).cast("bigint").alias("rating_count"), F.get("__v", 1).alias("total_weight"), *columns
    )


# ---------------------------------------------------------------- liked genres


def liked_genres(active: DataFrame, catalog: DataFrame, top_n: int = 4) -> DataFrame:
    """Genres by summed weight max(0, rating - 3); ties go to the genre met first in the history."""
    liked = active.where(F.col("rating") > 3.0)
    listed = catalog.where(F.size("genres") > 0).select("movie_id", "genres")
    placed = liked.join(listed, "movie_id").select(
        "user_id",
        (F.col("rating") - 3.0).alias("weight"),
        "rating_timestamp",
        "id",
        F.posexplode("genres").alias("pos", "genre"),
    )
    scored = placed.groupBy("user_id", "genre").agg(
        F.sum("weight").alias("weight"), F.min(F.struct("rating_timestamp", "id", "pos")).alias("first_seen")
    )
    best = Window.partitionBy("user_id").orderBy(F.col("weight").desc(), "first_seen")
    return (
        scored.withColumn("genre_rank", F.row_number().over(best).cast("bigint"))
        .where(F.col("genre_rank") <= top_n)
        .select("user_id", "genre", "weight", "genre_rank")
    )
