"""Adaptive split as a stream: one state per experiment, updated per micro-batch."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tastemill.operators.experiment import Feedback, Fold, Split, SplitGraph, SplitPolicy

OUTPUT = (
    "experiment_id string, rows bigint, candidate_ratings bigint, candidate_avg double, "
    "main_fraction double, candidate_fraction double, promoted boolean"
)
STATE = "main double, candidate double, challenged boolean, rows bigint, ratings bigint, total double, promoted boolean"


def split_stream(feedback: DataFrame, policy: SplitPolicy = SplitPolicy()) -> DataFrame:
    """An approximation of `split_states`: late rows are applied on arrival, not in their place.

    Gives the updated experiment states of each micro-batch, whose rows are folded in (rated_at,
    id) order; the end state therefore depends on where batches end. Limit the batch size at the source, since an experiment's
    rows of one batch are sorted together.
    """

    def update(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            main, candidate, challenged, rows, ratings, total, promoted = state.get
        else:
            main, candidate, challenged = policy.initial_main, policy.initial_candidate, True
            rows, ratings, total, promoted = 0, 0, 0.0, False
        graph = SplitGraph(policy)
        walk = Fold(graph, Split(main, candidate, challenged))
        fold = Feedback(graph, ratings, total, walk)
        batch = pd.concat(list(frames)).sort_values(["rated_at", "id"])
        fold.add(batch["id"].to_numpy(), batch["model_role"].to_numpy(object), batch["rating"].to_numpy(float))
        promoted = bool(promoted or walk.promoted_id is not None)
        rows += fold.rows
        end = walk.end
        state.update((end.main, end.candidate, end.challenged, rows, fold.ratings, fold.total, promoted))
        average = fold.total / fold.ratings if fold.ratings else 0.0
        yield pd.DataFrame(
            {
                "experiment_id": [key[0]],
                "rows": [rows],
                "candidate_ratings": [fold.ratings],
                "candidate_avg": [average],
                "main_fraction": [end.main],
                "candidate_fraction": [end.candidate],
                "promoted": [promoted],
            }
        )

    return feedback.groupBy("experiment_id").applyInPandasWithState(
        update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout
    )
