"""Ordered slices: a deterministic range layout that splits hot keys.

A slice plan is a short sorted list of sampled key tuples. Every row belongs to exactly
one slice, found by binary search in a constant array, so the assignment never depends
on how Spark happened to partition the data and survives task or executor loss. Because
the bounds cover the whole sort key (for example user, time, id), one user holding a
third of all rows is spread over many slices.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastemill.session import rows_per_slice as session_rows_per_slice

SLICE = "__slice"
# Most slices of a plan unless the caller names another limit; more rows make larger slices.
MAX_SLICES = 16_384
SAMPLES_PER_SLICE = 20
MIN_ROWS_PER_SLICE = 4_096
SELECT_LIMIT = 100_000


def sortable(df: DataFrame, name: str) -> Column:
    """The column as bigint, double or string, in the same order (doubles must be finite)."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(name))
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if isinstance(kind, T.StringType):
        return F.col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.col(name).cast("double")
    return F.col(name).cast("bigint")


def literal_for(df: DataFrame, name: str, value) -> Column:
    """A sortable value back as a literal of the column's own type, so scans can use it."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(F.lit(int(value)))
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_micros(F.lit(int(value))).cast("timestamp_ntz")
    if isinstance(kind, (T.StringType, T.DoubleType, T.FloatType)):
        return F.lit(value)
    return F.lit(int(value))


def key_before(df: DataFrame, keys: list[str], values: tuple, *, inclusive: bool) -> Column:
    """Row key < values (or <=) in lexicographic order, as plain comparisons."""
    result: Column | None = None
    for name, value in reversed(list(zip(keys, values, strict=True))):
        bound = literal_for(df, name, value)
        if result is None:
            result = F.col(name) <= bound if inclusive else F.col(name) < bound
        else:
            # The leading range is repeated on its own so that the scan can prune by it.
            result = (F.col(name) <= bound) & ((F.col(name) < bound) | result)
    return result


def constant_array(values: list, ddl: str) -> Column:
    """A constant array built from one JSON literal (folded once by the optimizer)."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{ddl}>")


@dataclass(frozen=True)
class SlicePlan:
    keys: tuple[str, ...]
    sort_columns: tuple[Column, ...]
    ddl: str
    bounds: tuple[tuple, ...]

    @property
    def count(self) -> int:
        return len(self.bounds) + 1

    def column(self) -> Column:
        """Slice number of a row: how many bounds are <= its key."""
        if not self.bounds:
            return F.lit(0)
        key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(self.sort_columns)])
        bounds = constant_array([{f"k{i}": v for i, v in enumerate(b)} for b in self.bounds], self.ddl)
        top = len(self.bounds).bit_length() - 1
        strides = constant_array([1 << p for p in range(top, -1, -1)], "int")
        return F.aggregate(
            strides,
            F.lit(0),
            lambda at, stride: F.when(F.try_element_at(bounds, at + stride) <= key, at + stride).otherwise(at),
        )

    def edge_values(self) -> list:
        """Values of the leading key that may continue from one slice into the next."""
        return sorted({bound[0] for bound in self.bounds})


def plan_slices(
    df: DataFrame,
    keys: list[str],
    *,
    rows_per_slice: int | None = None,
    total: int | None = None,
    max_slices: int = MAX_SLICES,
    seed: int = 17,
) -> SlicePlan:
    """Choose slice bounds from a bounded sample of the sort keys."""
    spark = df.sparkSession
    size = rows_per_slice or session_rows_per_slice(spark)
    columns = tuple(sortable(df, k) for k in keys)
    keyed = df.select(*[c.alias(f"k{i}") for i, c in enumerate(columns)])
    ddl = "struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in keyed.schema.fields) + ">"
    total = keyed.count() if total is None else total
    floor = min(spark.sparkContext.defaultParallelism, total // min(size, MIN_ROWS_PER_SLICE))
    wanted = min(max_slices, max(math.ceil(total / size), floor, 1))
    if wanted == 1:
        return SlicePlan(tuple(keys), columns, ddl, ())
    fraction = min(1.0, wanted * SAMPLES_PER_SLICE / total)
    sample = sorted(tuple(r) for r in keyed.dropna().sample(fraction=fraction, seed=seed).collect())
    return SlicePlan(tuple(keys), columns, ddl, _pick_bounds(sample, wanted))


def _pick_bounds(sample: list[tuple], wanted: int) -> tuple[tuple, ...]:
    picked = {sample[i * len(sample) // wanted] for i in range(1, wanted)} if sample else set()
    return tuple(sorted(picked))


def plan_distinct_slices(df: DataFrame, key: str, *, rows_per_slice: int | None = None) -> SlicePlan:
    """Slice bounds balanced over the distinct values of one key, whatever their multiplicity."""
    spark = df.sparkSession
    size = rows_per_slice or session_rows_per_slice(spark)
    column = sortable(df, key)
    keyed = df.select(column.alias("k0")).dropna()
    ddl = f"struct<k0:{keyed.schema['k0'].dataType.simpleString()}>"
    total = keyed.agg(F.approx_count_distinct("k0")).first()[0]
    floor = min(spark.sparkContext.defaultParallelism, total // min(size, MIN_ROWS_PER_SLICE))
    wanted = min(MAX_SLICES, max(math.ceil(total / size), floor, 1))
    if wanted == 1:
        return SlicePlan((key,), (column,), ddl, ())
    stride = max(1, total // (wanted * SAMPLES_PER_SLICE))
    chosen = keyed.where(F.pmod(F.xxhash64("k0"), F.lit(stride)) == 0).distinct().collect()
    return SlicePlan((key,), (column,), ddl, _pick_bounds(sorted(tuple(r) for r in chosen), wanted))


def with_slice(df: DataFrame, plan: SlicePlan) -> DataFrame:
    return df.withColumn(SLICE, plan.column())


def slice_counts(df: DataFrame, plan: SlicePlan) -> list[int]:
    """Rows per slice (a list no longer than the plan)."""
    found = {r[SLICE]: r["n"] for r in df.groupBy(SLICE).agg(F.count(F.lit(1)).alias("n")).collect()}
    return [found.get(i, 0) for i in range(plan.count)]


def running_offsets(counts: list[int]) -> list[int]:
    offsets, seen = [], 0
    for n in counts:
        offsets.append(seen)
        seen += n
    return offsets


def edge_rows(sliced: DataFrame, plan: SlicePlan, key: str) -> DataFrame:
    """Rows of key values that occur as a slice border, hence may span slices."""
    edges = sliced.sparkSession.createDataFrame([(v,) for v in plan.edge_values()], sliced.select(key).schema)
    return sliced.join(F.broadcast(edges), key, "left_semi")


def carried(partial: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Totals of all earlier slices of the same key; at most (borders + slices) rows."""
    earlier = Window.partitionBy(key).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return partial.select(SLICE, key, *[F.sum(c).over(earlier).alias(c) for c in columns]).where(
        F.col(columns[0]).isNotNull()
    )


@dataclass(frozen=True)
class KeyRange:
    """Rows with a key above `low` and below `high` (None: no limit), and how many there are."""

    low: tuple | None
    high: tuple | None
    rows: int

    def holds(self, df: DataFrame, keys: list[str]) -> Column:
        inside = F.lit(True)
        if self.low is not None:
            inside = inside & ~key_before(df, keys, self.low, inclusive=True)
        if self.high is not None:
            inside = inside & key_before(df, keys, self.high, inclusive=False)
        return inside


def keys_at_ranks(df: DataFrame, keys: list[str], ranks: list[int], total: int | None = None) -> dict[int, tuple]:
    """Exact sort keys at the given 1-based ranks, without sorting the table.

    One pass counts rows per slice; then only the slices that hold a rank are read again, cut anew and
    narrowed until each is small enough for one bounded sort. All ranks share every pass. Bounds are
    keys of real rows and are counted apart, so every pass narrows each range, also with equal keys
    and on one core. Null keys have no rank and raise.
    """
    empty = F.lit(False)
    for key in keys:
        empty = empty | F.col(key).isNull()
    count, nulls = df.agg(F.count(F.lit(1)), F.count(F.when(empty, 1))).first() if total is None else (total, 0)
    if nulls:
        raise ValueError(f"{nulls} rows have a null in {', '.join(keys)}")
    found: dict[int, tuple] = {}
    # Where each rank is searched, and its rank there.
    places = {rank: (KeyRange(None, None, count), rank) for rank in ranks if 1 <= rank <= count}
    while large := {place for place, _ in places.values() if place.rows > SELECT_LIMIT}:
        plan, counts = _count_ranges(df, keys, large)
        for rank, (place, within) in list(places.items()):
            if place in large:
                answer = _narrow(plan.bounds, counts, place, within)
                if isinstance(answer[0], KeyRange):
                    places[rank] = answer
                else:
                    found[rank] = answer
                    del places[rank]
    return found | (_select_small(df, keys, places) if places else {})


def _count_ranges(df: DataFrame, keys: list[str], ranges: set[KeyRange]) -> tuple[SlicePlan, dict[int, tuple[int, int]]]:
    """One plan over all ranges, and per slice its rows and those that equal its lower bound."""
    ordered = list(ranges)
    part = df.where(_any_of(r.holds(df, keys) for r in ordered))
    size = max(1, min(SELECT_LIMIT, min(r.rows for r in ordered) // 8))
    plan = plan_slices(part, keys, total=sum(r.rows for r in ordered), rows_per_slice=size)
    bounds = set(plan.bounds)
    uncut = [r for r in ordered if not any((r.low is None or b > r.low) and (r.high is None or b < r.high) for b in bounds)]
    bounds |= set(_least_keys(part, keys, uncut)) | {b for r in ordered for b in (r.low, r.high) if b is not None}
    plan = SlicePlan(plan.keys, plan.sort_columns, plan.ddl, tuple(sorted(bounds)))
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(plan.sort_columns)])
    marks = constant_array([{f"k{i}": v for i, v in enumerate(b)} for b in plan.bounds], plan.ddl)
    at_bound = (F.col(SLICE) > 0) & (F.try_element_at(marks, F.col(SLICE)) == key)
    counted = with_slice(part, plan).groupBy(SLICE).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(at_bound, 1)).alias("equal"))
    return plan, {r[SLICE]: (r["n"], r["equal"]) for r in counted.collect()}


def _any_of(conditions) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def _narrow(bounds: tuple[tuple, ...], counts: dict[int, tuple[int, int]], place: KeyRange, rank: int) -> tuple:
    """The key at a rank of a range where that is a bound, else the slice that holds it and the rank there."""
    at = 0 if place.low is None else bounds.index(place.low) + 1
    while rank > counts.get(at, (0, 0))[0]:
        rank -= counts.get(at, (0, 0))[0]
        at += 1
    rows, equal = counts[at]
    if rank <= equal:
        return bounds[at - 1]
    low = bounds[at - 1] if at > 0 else None
    high = bounds[at] if at < len(bounds) else None
    return KeyRange(low, high, rows - equal), rank - equal


def _least_keys(df: DataFrame, keys: list[str], ranges: list[KeyRange]) -> list[tuple]:
    """The least key of each range, in one pass."""
    if not ranges:
        return []
    key = F.struct(*[sortable(df, k).alias(f"k{i}") for i, k in enumerate(keys)])
    least = df.agg(*[F.min(F.when(r.holds(df, keys), key)).alias(f"r{i}") for i, r in enumerate(ranges)]).first()
    return [tuple(k) for k in least]


def _select_small(df: DataFrame, keys: list[str], places: dict[int, tuple[KeyRange, int]]) -> dict[int, tuple]:
    """Ranks within ranges of at most SELECT_LIMIT rows each: a bounded sort of the keys alone per range."""
    ranges = list({place for place, _ in places.values()})
    number = F.coalesce(*[F.when(r.holds(df, keys), i) for i, r in enumerate(ranges)])
    names = [f"k{i}" for i in range(len(keys))]
    keyed = df.select(*[sortable(df, k).alias(n) for k, n in zip(keys, names, strict=True)], number.alias("range"))
    asked = df.sparkSession.createDataFrame(
        [(rank, ranges.index(place), within) for rank, (place, within) in places.items()], "rank bigint, range int, rn int"
    )
    inside = keyed.where(F.col("range").isNotNull())
    numbered = inside.withColumn("rn", F.row_number().over(Window.partitionBy("range").orderBy(*names)))
    return {r["rank"]: tuple(r[n] for n in names) for r in numbered.join(F.broadcast(asked), ["range", "rn"]).collect()}
