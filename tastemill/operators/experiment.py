"""Adaptive traffic split between a main and a candidate model.

The split reacts to feedback in time order, so it is a sequential fold per experiment. One
experiment may hold a large share of all feedback, therefore the fold runs over slices of
(experiment, time, id). A slice whose starting split is unknown is folded from both extreme
splits at once: the update never swaps two splits, so when both runs end equal, every
start ends there. Each run of slices where they do not is walked once more, in one go, from the end
of the slice before it, which is known. So there are two passes whatever the feedback, and the runs
are walked beside each other.

Whether a rating may promote is known for all rows before (counts and sums do not depend on the
split), so a row is one of ten symbols, and splits are nodes of a graph that grows while it is
walked: a row costs one step along an edge, and rows that change nothing are left out beforehand.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.operators.merge import merge_tables
from tastemill.operators.slices import SLICE, SlicePlan, carried, edge_rows, plan_slices, with_slice

FEEDBACK_ORDER = ["experiment_id", "rated_at", "id"]


@dataclass(frozen=True)
class SplitPolicy:
    initial_main: float = 0.70
    initial_candidate: float = 0.30
    step: float = 0.02
    high_rating: float = 4.0
    low_rating: float = 3.0
    max_fraction: float = 0.80
    min_fraction: float = 0.0
    promotion_ratings: int = 10
    promotion_average: float = 4.0
    freeze_without_candidate: bool = False

    def clamp(self, value: float) -> float:
        return max(self.min_fraction, min(self.max_fraction, value))


@dataclass(frozen=True)
class Split:
    """Traffic fractions and whether a challenger is still running."""

    main: float
    candidate: float
    challenged: bool = True


def next_split(policy: SplitPolicy, now: Split, role: str, rating: float) -> Split:
    """Fractions after one rating of a recommendation by `role`; other roles change nothing."""
    if role not in ("main", "candidate") or (policy.freeze_without_candidate and not now.challenged):
        return now
    if rating >= policy.high_rating:
        change = policy.step
    elif rating <= policy.low_rating:
        change = -policy.step
    else:
        return now
    if role == "main":
        main = policy.clamp(now.main + change)
        candidate = policy.clamp(1.0 - main)
    else:
        candidate = policy.clamp(now.candidate + change)
        main = policy.clamp(1.0 - candidate)
    total = main + candidate
    if total <= 0:
        return Split(1.0, 0.0, now.challenged)
    return Split(main / total, candidate / total, now.challenged)


def rolled_out(policy: SplitPolicy, now: Split) -> bool:
    return now.challenged and now.candidate >= policy.max_fraction - 1e-9


def promotes(policy: SplitPolicy, now: Split, role: str, ratings: int, total: float) -> bool:
    """True when the challenger has full rollout, enough feedback and a good enough average."""
    return (
        role in ("main", "candidate")
        and rolled_out(policy, now)
        and ratings >= policy.promotion_ratings
        and total / ratings >= policy.promotion_average
    )


PROMOTED = Split(1.0, 0.0, False)


# Nodes after which a graph is begun anew; renormalised fractions have no end of different values.
MOST_NODES = 100_000
# Symbols: 1 to 4 are main up, main down, candidate up, candidate down; 5 more where the row may promote.
NEUTRAL, GATED = 5, 5


class SplitGraph:
    """Splits as nodes and symbols as edges. A node is a list: [challenged, successors 1 to 10, split]."""

    def __init__(self, policy: SplitPolicy):
        self.policy = policy
        self.nodes: dict[Split, list] = {}

    def node(self, split: Split) -> list:
        found = self.nodes.get(split)
        if found is None:
            if len(self.nodes) >= MOST_NODES:
                self.nodes.clear()  # nodes in use keep their edges
            found = self.nodes[split] = [split.challenged, *[None] * 10, split]
        return found

    def grow(self, node: list, symbol: int) -> list:
        policy, after = self.policy, node[-1]
        move = (symbol - 1) % GATED + 1
        if move != NEUTRAL:
            after = next_split(policy, after, "main" if move < 3 else "candidate", policy.high_rating if move % 2 else policy.low_rating)
        if symbol > GATED and rolled_out(policy, after):
            after = PROMOTED
        node[symbol] = self.node(after)
        return node[symbol]

    def walk(self, node: list, symbols: bytes) -> list:
        for s in symbols:
            node = node[s] or self.grow(node, s)
        return node

    def promotion(self, node: list, symbols: bytes) -> int | None:
        """Place of the symbol that ends the challenge, which only a promotion does."""
        for place, s in enumerate(symbols):
            before, node = node, node[s] or self.grow(node, s)
            if before[0] and not node[0]:
                return place
        return None


class Fold:
    """Fold of one experiment's rows, block by block, from one start or from a pair of extreme ones."""

    def __init__(self, graph: SplitGraph, *starts: Split):
        self.graph, self.parted, self.promoted_id = graph, False, None
        self.nodes = [graph.node(s) for s in starts]

    def add(self, symbols: bytes, ids: np.ndarray) -> None:
        if self.parted or not len(symbols):
            return
        first, at, low, high = self.nodes[0], 0, self.nodes[0], self.nodes[-1]
        grow = self.graph.grow
        while low is not high and at < len(symbols):
            s = symbols[at]
            low, high, at = low[s] or grow(low, s), high[s] or grow(high, s), at + 1
            if low[0] is not high[0]:  # one of them promotes and the other does not
                self.parted = True
                return
        if low is high:
            low = high = self.graph.walk(low, symbols[at:])
        if first[0] and not low[0]:
            self.promoted_id = int(ids[self.graph.promotion(first, symbols)])
        self.nodes = [low, high]

    @property
    def end(self) -> Split | None:
        """The split that every start ends in, if there is one."""
        return self.nodes[0][-1] if not self.parted and self.nodes[0] is self.nodes[-1] else None


def symbols_of(policy: SplitPolicy, roles: np.ndarray, ratings: np.ndarray, count: int, total: float) -> tuple[np.ndarray, int, float]:
    """(symbol of each row, 0 where it changes nothing; candidate ratings and their sum after the rows)."""
    main, candidate = roles == "main", roles == "candidate"
    counts = count + np.cumsum(candidate)
    totals = np.cumsum(np.concatenate([[total], np.where(candidate, ratings, 0.0)]))[1:]
    gate = (counts >= max(policy.promotion_ratings, 1)) & (totals / np.maximum(counts, 1) >= policy.promotion_average)
    move = np.where(ratings >= policy.high_rating, 1, np.where(ratings <= policy.low_rating, 2, NEUTRAL))
    move = np.where(candidate & (move != NEUTRAL), move + 2, move)
    symbols = np.where(main | candidate, move + GATED * gate, 0).astype(np.uint8)
    symbols[symbols == NEUTRAL] = 0
    return symbols, (int(counts[-1]) if len(counts) else count), (float(totals[-1]) if len(totals) else total)


class Feedback:
    """All folds of one experiment over one slice or run of slices, and its counts."""

    def __init__(self, graph: SplitGraph, ratings: int, total: float, *folds: Fold | None):
        self.graph, self.ratings, self.total, self.rows, self.folds = graph, ratings, total, 0, folds

    def add(self, ids: np.ndarray, roles: np.ndarray, ratings: np.ndarray) -> None:
        symbols, self.ratings, self.total = symbols_of(self.graph.policy, roles, ratings, self.ratings, self.total)
        self.rows += len(ids)
        moving = symbols != 0
        packed, ids = symbols[moving].tobytes(), ids[moving]
        for fold in self.folds:
            if fold is not None:
                fold.add(packed, ids)

    def summary(self, experiment: str, slice_id: int, start_known: bool) -> tuple:
        ends = [x for fold in self.folds for x in (*_flat(fold and fold.end), fold and fold.promoted_id)]
        return (experiment, slice_id, start_known, self.rows, self.ratings, self.total, *ends)


def _flat(split: Split | None) -> tuple:
    return (None, None, None) if split is None else (split.main, split.candidate, split.challenged)


# `main` to `promoted_id`: the end from the known start or from any start with a challenger; `after_`: from
# any start without one. Null where the start decides.
_SUMMARY = [
    ("experiment_id", "string"),
    (SLICE, "int"),
    ("start_known", "boolean"),
    ("rows", "bigint"),
    ("ratings", "bigint"),
    ("total", "double"),
    ("main", "double"),
    ("candidate", "double"),
    ("challenged", "boolean"),
    ("promoted_id", "bigint"),
    ("after_main", "double"),
    ("after_candidate", "double"),
    ("after_challenged", "boolean"),
    ("after_promoted_id", "bigint"),
]
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def split_states(
    feedback: DataFrame,
    experiments: DataFrame | None = None,
    policy: SplitPolicy = SplitPolicy(),
    *,
    earlier: DataFrame | None = None,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """State of every experiment after all its feedback.

    `feedback`: experiment_id, id, rated_at, model_role, rating. `experiments` may give the
    starting fractions and whether there is a candidate, `earlier` the feedback that was
    folded before (it only counts towards the candidate's average). Returns experiment_id, rows,
    candidate_ratings, candidate_avg, main_fraction, candidate_fraction, promoted, promoted_id.
    """
    rows = feedback.select("experiment_id", "rated_at", "id", "model_role", F.col("rating").cast("double"))
    plan = plan_slices(rows, FEEDBACK_ORDER, rows_per_slice=rows_per_slice)
    started = _with_start(with_slice(rows, plan), experiments, earlier, policy)
    if plan.count == 1:
        return _report(_walk(_plain_start(started), plan, policy))
    spark = feedback.sparkSession
    edges = F.broadcast(spark.createDataFrame([(v,) for v in plan.edge_values()], "experiment_id string"))
    inside = _report(_walk(_plain_start(started.join(edges, "experiment_id", "left_anti")), plan, policy))
    across = _resolve(edge_rows(started, plan, "experiment_id"), plan, policy)
    return inside.unionByName(_report(spark.createDataFrame(across, _ddl(_SUMMARY))))


def _ddl(fields: list[tuple[str, str]]) -> str:
    return ", ".join(f"{n} {t}" for n, t in fields)


def _with_start(
    rows: DataFrame, experiments: DataFrame | None, earlier: DataFrame | None, policy: SplitPolicy
) -> DataFrame:
    defaults = {
        "s_main": F.lit(policy.initial_main),
        "s_candidate": F.lit(policy.initial_candidate),
        "s_challenged": F.lit(True),
        "p_ratings": F.lit(0).cast("bigint"),
        "p_total": F.lit(0.0),
    }
    if experiments is not None:
        states = experiments.select(
            "experiment_id",
            F.col("main_split_fraction").alias("s_main"),
            F.col("candidate_split_fraction").alias("s_candidate"),
            F.col("candidate_model_version").isNotNull().alias("s_challenged"),
        )
        rows = rows.join(states, "experiment_id", "left")
    if earlier is not None:
        rated = earlier.where(F.col("model_role") == "candidate").groupBy("experiment_id").agg(
            F.count("rating").alias("p_ratings"), F.sum("rating").alias("p_total")
        )
        rows = rows.join(rated, "experiment_id", "left")
    return rows.withColumns({n: F.coalesce(n, v) if n in rows.columns else v for n, v in defaults.items()})


def _plain_start(rows: DataFrame) -> DataFrame:
    """Every experiment begins inside its slice."""
    return rows.select(
        "*", F.lit(True).alias("start_known"), F.col("p_ratings").alias("c_ratings"), F.col("p_total").alias("c_total")
    )


def _walk(rows: DataFrame, plan: SlicePlan, policy: SplitPolicy) -> DataFrame:
    """One summary row per (slice, experiment); rows arrive sorted, only one fold is open."""
    laid_out = rows.repartitionById(plan.count, F.col(SLICE)).sortWithinPartitions(*FEEDBACK_ORDER)

    def begin(graph: SplitGraph, main, candidate, challenged, known, ratings, total) -> Feedback:
        if known:
            return Feedback(graph, ratings, total, Fold(graph, Split(main, candidate, challenged)), None)
        extremes = [Fold(graph, Split(1.0, 0.0, c), Split(0.0, 1.0, c)) for c in (True, False)]
        return Feedback(graph, ratings, total, *extremes)

    return _folded(laid_out, [SLICE], ["s_main", "s_candidate", "s_challenged", "start_known", "c_ratings", "c_total"], begin, policy)


def _folded(rows: DataFrame, place: list[str], starts: list[str], begin, policy: SplitPolicy) -> DataFrame:
    """Fold sorted rows of each (experiment, place); `begin` makes its folds from the `starts` of its first row."""
    values = ["id", "model_role", "rating"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, done, key, feedback, known = SplitGraph(policy), [], None, None, True
        for batch in batches:
            at = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            ids = batch.column(2).to_numpy(zero_copy_only=False)
            roles = batch.column(3).to_numpy(zero_copy_only=False).astype(object)
            ratings = batch.column(4).to_numpy(zero_copy_only=False)
            borders = [0, *(np.flatnonzero((np.diff(at[0]) != 0) | (np.diff(at[1]) != 0)) + 1), batch.num_rows]
            for low, high in zip(borders, borders[1:], strict=False):
                if low == high:
                    continue
                own = (batch.column(0)[low].as_py(), batch.column(1)[low].as_py())
                if own != key:
                    if feedback is not None:
                        done.append(feedback.summary(*key, known))
                    first = [batch.column(i)[low].as_py() for i in range(5, 5 + len(starts))]
                    key, feedback = own, begin(graph, *first)
                    known = feedback.folds[1] is None
                feedback.add(ids[low:high], roles[low:high], ratings[low:high])
            if len(done) >= 1000:
                yield _summary_batch(done)
                done = []
        if feedback is not None:
            done.append(feedback.summary(*key, known))
        if done:
            yield _summary_batch(done)

    return rows.select("experiment_id", *place, *values, *starts).mapInArrow(run, _ddl(_SUMMARY))


def _summary_batch(rows: Iterable[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=_ARROW[t]) for c, (_, t) in zip(columns, _SUMMARY, strict=True)], names=[n for n, _ in _SUMMARY]
    )


def _resolve(rows: DataFrame, plan: SlicePlan, policy: SplitPolicy) -> list[tuple]:
    """Chain the slices of the experiments that span several; at most two rows per slice come back."""
    partial = rows.groupBy(SLICE, "experiment_id").agg(
        F.count_if(F.col("model_role") == "candidate").alias("c_ratings"),
        F.coalesce(F.sum(F.when(F.col("model_role") == "candidate", F.col("rating"))), F.lit(0.0)).alias("c_total"),
    )
    carry = carried(partial, "experiment_id", ["c_ratings", "c_total"])
    joined = rows.join(F.broadcast(carry), [SLICE, "experiment_id"], "left")
    asked = joined.select(
        *rows.columns,
        F.col("c_ratings").isNull().alias("start_known"),
        (F.coalesce("c_ratings", F.lit(0)) + F.col("p_ratings")).cast("bigint").alias("c_ratings"),
        (F.coalesce("c_total", F.lit(0.0)) + F.col("p_total")).alias("c_total"),
    )
    found: dict[str, list[dict]] = {}
    for r in sorted(_walk(asked, plan, policy).collect(), key=lambda r: (r["experiment_id"], r[SLICE])):
        found.setdefault(r["experiment_id"], []).append(r.asDict())
    runs = _open_runs(found)
    ends = {}
    if runs:
        # Each run is one ordered stream with little memory; runs are walked beside each other.
        members = rows.sparkSession.createDataFrame(
            [(e, s, number, *_flat(a), *_flat(b)) for number, (e, slices, a, b) in enumerate(runs) for s in slices],
            f"experiment_id string, {SLICE} int, __run int, a_main double, a_candidate double, a_challenged boolean, b_main double, b_candidate double, b_challenged boolean",
        )

        def begin(graph: SplitGraph, *v) -> Feedback:
            folds = [Fold(graph, Split(*s)) if s[0] is not None else None for s in (v[:3], v[3:6])]
            return Feedback(graph, v[6], v[7], *folds)

        starts = [*members.columns[3:], "c_ratings", "c_total"]
        again = asked.join(F.broadcast(members), ["experiment_id", SLICE])
        streams = again.repartition(len(runs), "__run").sortWithinPartitions("__run", *FEEDBACK_ORDER)
        for r in _folded(streams, ["__run"], starts, begin, policy).collect():
            experiment, slices, *_ = runs[r[SLICE]]
            ends[experiment, slices[0]] = r.asDict()
    return [_chained(experiment, parts, ends) for experiment, parts in found.items()]


def _split(part: dict, prefix: str = "") -> Split | None:
    return None if part[f"{prefix}main"] is None else Split(part[f"{prefix}main"], part[f"{prefix}candidate"], part[f"{prefix}challenged"])


def _closed(part: dict) -> bool:
    """True where the end is known for every start that can come."""
    return part["start_known"] or (_split(part) is not None and _split(part, "after_") is not None)


def _open_runs(found: dict[str, list[dict]]) -> list[tuple[str, list[int], Split, Split | None]]:
    """(experiment, slices, start with a challenger before, start without) of neighbouring slices that are not closed."""
    runs = []
    for experiment, parts in found.items():
        before = None
        for part in parts:
            if _closed(part):
                before = part
            elif before is not None:
                runs.append((experiment, [part[SLICE]], _split(before), _split(before, "after_")))
                before = None
            else:
                runs[-1][1].append(part[SLICE])
    return runs


def _chained(experiment: str, parts: list[dict], ends: dict[tuple[str, int], dict]) -> tuple:
    """Final summary of an experiment from its slices and, by first slice, the ends of its open runs."""
    state, promoted, prefix = None, None, ""
    for part in parts:
        if _closed(part):
            prefix = "" if part["start_known"] or state.challenged else "after_"
        elif (experiment, part[SLICE]) in ends:
            part = ends[experiment, part[SLICE]]
        else:
            continue  # inside a run
        state = _split(part, prefix)
        promoted = promoted if promoted is not None else part[f"{prefix}promoted_id"]
    last = parts[-1]
    return (experiment, 0, True, sum(p["rows"] for p in parts), last["ratings"], last["total"], *_flat(state), promoted, *[None] * 4)


def _report(summaries: DataFrame) -> DataFrame:
    ratings = F.col("ratings")
    return summaries.select(
        "experiment_id",
        "rows",
        ratings.alias("candidate_ratings"),
        F.when(ratings > 0, F.col("total") / ratings).otherwise(0.0).alias("candidate_avg"),
        F.col("main").alias("main_fraction"),
        F.col("candidate").alias("candidate_fraction"),
        F.col("promoted_id").isNotNull().alias("promoted"),
        "promoted_id",
    )


# ---------------------------------------------------------------- tables


def candidate_stats(feedback: DataFrame) -> DataFrame:
    """Ratings and average per (experiment, role)."""
    return feedback.groupBy("experiment_id", "model_role").agg(
        F.count("rating").alias("ratings"), F.coalesce(F.avg("rating"), F.lit(0.0)).alias("average")
    )


def role_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("experiment_id", "model_role").agg(F.count(F.lit(1)).alias("count"))


def active_splits(experiments: DataFrame) -> DataFrame:
    return experiments.where(F.col("status") == "active").select(
        "experiment_id", "main_split_fraction", "candidate_split_fraction"
    )


def open_experiments(
    experiments: DataFrame, requests: DataFrame, now: Column, policy: SplitPolicy = SplitPolicy()
) -> DataFrame:
    """Get-or-create: new ids start at the initial split, a new challenger resets it, else unchanged.

    `requests`: experiment_id, main_model_version, candidate_model_version.
    """
    asked, known = F.col("change.candidate_model_version"), F.col("base.candidate_model_version")
    inactive = F.col("base.status") != "active"
    challenger = asked.isNotNull() & ~asked.eqNullSafe(known)
    reset = inactive | challenger

    def when_reset(name: str, value: Column) -> Column:
        return F.when(reset, value).otherwise(F.col(f"base.{name}"))

    fresh = {
        "main_model_version": F.col("change.main_model_version"),
        "candidate_model_version": asked,
        "main_split_fraction": F.lit(policy.initial_main),
        "candidate_split_fraction": F.lit(policy.initial_candidate),
        "status": F.lit("active"),
        "updated_at": now,
    }
    matched = {name: when_reset(name, value) for name, value in fresh.items()}
    matched["created_at"] = F.when(inactive, now).otherwise(F.col("base.created_at"))
    return merge_tables(experiments, requests, ["experiment_id"], matched, {**fresh, "created_at": now})


def apply_split_states(experiments: DataFrame, states: DataFrame, now: Column) -> DataFrame:
    """Store folded fractions; after a promotion the candidate version becomes main."""
    promoted = F.col("change.promoted")
    rules = {
        "main_split_fraction": F.col("change.main_fraction"),
        "candidate_split_fraction": F.col("change.candidate_fraction"),
        "main_model_version": F.when(promoted, F.col("base.candidate_model_version")).otherwise(
            F.col("base.main_model_version")
        ),
        "candidate_model_version": F.when(~promoted, F.col("base.candidate_model_version")),
        "updated_at": now,
    }
    return merge_tables(experiments, states, ["experiment_id"], rules, None)


def record_promotions(experiments: DataFrame, promotions: DataFrame, now: Column) -> DataFrame:
    """`promotions`: experiment_id, new_main_version."""
    rules = {
        "main_model_version": F.col("change.new_main_version"),
        "candidate_model_version": F.lit(None),
        "main_split_fraction": F.lit(1.0),
        "candidate_split_fraction": F.lit(0.0),
        "status": F.lit("active"),
        "updated_at": now,
    }
    return merge_tables(experiments, promotions, ["experiment_id"], rules, None)


def append_log(log: DataFrame, rows: DataFrame) -> DataFrame:
    """Impressions and feedback are append-only; columns are matched by name."""
    return log.unionByName(rows.select(*log.columns))
