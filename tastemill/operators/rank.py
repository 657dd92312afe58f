"""Global ranks, time splits, dense indexes and part numbers without a single-partition sort."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.operators.slices import (
    SLICE,
    carried,
    constant_array,
    edge_rows,
    key_before,
    keys_at_ranks,
    plan_distinct_slices,
    plan_slices,
    running_offsets,
    slice_counts,
    with_slice,
)
from tastemill.session import broadcast_if_small

TIME_KEY = ("rating_timestamp", "id")


def global_rank(df: DataFrame, keys: list[str], name: str = "rn", *, rows_per_slice: int | None = None) -> DataFrame:
    """1-based position of each row in the total order of `keys` (which must be unique)."""
    return _rank_in_slices(df, keys, name, plan_slices(df, keys, rows_per_slice=rows_per_slice))


def _rank_in_slices(df: DataFrame, keys: list[str], name: str, plan) -> DataFrame:
    sliced = with_slice(df, plan)
    local = F.row_number().over(Window.partitionBy(SLICE).orderBy(*keys)).cast("bigint")
    if plan.count > 1:
        offsets = running_offsets(slice_counts(sliced, plan))
        local = local + F.element_at(constant_array(offsets, "bigint"), F.col(SLICE) + 1)
    return sliced.withColumn(name, local).drop(SLICE)


def rank_in_groups(
    df: DataFrame, group: str, keys: list[str], name: str = "rank", *, rows_per_slice: int | None = None
) -> DataFrame:
    """1-based position inside each group in the order of `keys` (unique within a group).

    Ranks are counted per slice of (group, keys); groups that reach over a slice border add
    the rows of their earlier slices, so one large group is ranked by many tasks.
    """
    plan = plan_slices(df, [group, *keys], rows_per_slice=rows_per_slice)
    sliced = with_slice(df, plan)
    local = F.row_number().over(Window.partitionBy(SLICE, group).orderBy(*keys)).cast("bigint")
    ranked = sliced.withColumn(name, local)
    if plan.count > 1:
        partial = edge_rows(sliced, plan, group).groupBy(SLICE, group).agg(F.count(F.lit(1)).alias("__before"))
        ranked = ranked.join(F.broadcast(carried(partial, group, ["__before"])), [SLICE, group], "left")
        ranked = ranked.withColumn(name, F.col(name) + F.coalesce("__before", F.lit(0))).drop("__before")
    return ranked.drop(SLICE)


def split_rows(total: int, train_fraction: float, validation_fraction: float) -> tuple[int, int]:
    """Last train and last validation row numbers, in exact decimals of the configured values."""
    train_end = int(Decimal(total) * Decimal(str(train_fraction)))
    validation_end = int(Decimal(total) * Decimal(str(train_fraction + validation_fraction)))
    return train_end, validation_end


def check_fractions(train: float, validation: float, test: float) -> None:
    if abs(train + validation + test - 1.0) > 1e-6:
        raise ValueError("train, validation and test fractions must sum to 1")


def temporal_split(
    ratings: DataFrame,
    train_fraction: float = 0.8,
    validation_fraction: float = 0.1,
    keys: tuple[str, ...] = TIME_KEY,
) -> DataFrame:
    """Add `split` by global time order.

    Only the two boundary rows are searched for; the label is then a comparison, so the
    table itself is neither sorted nor shuffled and time filters still reach the scan. A null in
    a key raises: such a row has no place in time.
    """
    order = list(keys)
    nulls = [F.count(F.when(F.col(k).isNull(), 1)) for k in order]
    total, *missing = ratings.agg(F.count(F.lit(1)), *nulls).first()
    if any(missing):
        raise ValueError(f"rows with a null in {', '.join(k for k, n in zip(order, missing, strict=True) if n)} cannot be split by time")
    ends = split_rows(total, train_fraction, validation_fraction)
    found = keys_at_ranks(ratings, order, list(ends), total=total)

    def up_to(end: int) -> Column:
        if end < 1:
            return F.lit(False)
        return key_before(ratings, order, found[end], inclusive=True)

    label = F.when(up_to(ends[0]), "train").when(up_to(ends[1]), "validation").otherwise("test")
    return ratings.withColumn("split", label)


def dense_index(df: DataFrame, key: str, name: str, *, rows_per_slice: int | None = None) -> DataFrame:
    """0-based index of the distinct non-null values of `key`, in key order."""
    plan = plan_distinct_slices(df, key, rows_per_slice=rows_per_slice)
    keys = df.select(key).dropna().distinct()
    ranked = _rank_in_slices(keys, [key], "__rank", plan)
    return ranked.select(key, (F.col("__rank") - 1).alias(name))


def map_to_indexes(
    split_ratings: DataFrame,
    user_map: DataFrame,
    movie_map: DataFrame,
    how: str = "inner",
) -> DataFrame:
    """Attach user_idx and movie_idx; ids, time and split stay so nothing has to be joined back."""
    return split_ratings.join(broadcast_if_small(user_map, 32), "user_id", how).join(
        broadcast_if_small(movie_map, 32), "movie_id", how
    )


def mapping_drops(split_ratings: DataFrame, user_map: DataFrame, movie_map: DataFrame) -> DataFrame:
    """Per split: all rows, mapped rows and why the others were dropped."""
    joined = map_to_indexes(split_ratings, user_map, movie_map, "left")
    no_user, no_movie = F.col("user_idx").isNull(), F.col("movie_idx").isNull()
    return joined.groupBy("split").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(~no_user & ~no_movie).alias("mapped_rows"),
        F.count_if(no_user | no_movie).alias("dropped_rows"),
        F.count_if(no_user).alias("unknown_user_rows"),
        F.count_if(no_movie).alias("unknown_movie_rows"),
    )


def join_back(mapped: DataFrame, user_map: DataFrame, movie_map: DataFrame, ratings: DataFrame) -> DataFrame:
    """Recover rating events for an imported dataset that holds only indexes and ratings.

    Matches on (user, movie, rating), so repeated equal ratings fan out, as the SQL does.
    """
    named = mapped.join(broadcast_if_small(user_map, 32), "user_idx").join(broadcast_if_small(movie_map, 32), "movie_idx")
    return named.join(ratings, ["user_id", "movie_id", "rating"])


def shuffle_key(seed: int) -> Column:
    """Repeatable pseudo-random training order, independent of engine and partitioning."""
    return F.md5(
        F.concat_ws(
            "-",
            F.col("user_id").cast("string"),
            F.col("movie_id").cast("string"),
            F.unix_micros("rating_timestamp").cast("string"),
            F.lit(str(seed)),
        )
    )


def shuffle_order(train: DataFrame, seed: int = 42, epoch: int = 0, *, rows_per_slice: int | None = None) -> DataFrame:
    """Position of every training row in the shuffled order; `epoch` gives a new order."""
    keyed = train.withColumn("shuffle_key", shuffle_key(seed + epoch))
    return global_rank(keyed, ["shuffle_key", "id"], "position", rows_per_slice=rows_per_slice)


def number_parts(df: DataFrame, keys: list[str], part_rows: int, *, rows_per_slice: int | None = None) -> DataFrame:
    """Add `part_idx`: consecutive blocks of `part_rows` rows in key order."""
    ranked = global_rank(df, keys, "__rn", rows_per_slice=rows_per_slice)
    part = F.floor((F.col("__rn") - 1) / F.lit(part_rows)).cast("bigint")
    return ranked.withColumn("part_idx", part).drop("__rn")
