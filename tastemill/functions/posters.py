"""Poster rules: which movies need a check, which posters may be shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MATURE_CERTIFICATIONS = ("R", "NC-17")
IMAGE_BASE = "https://image.tmdb.org/t/p"
SEXUAL_SCORE_LIMIT = 0.35


def is_mature(certification: Column) -> Column:
    return F.coalesce(certification.isin(*MATURE_CERTIFICATIONS), F.lit(False))


def is_questionable(adult: Column, certification: Column) -> Column:
    return F.coalesce(adult, F.lit(False)) | is_mature(certification)


def show_poster(path: Column, safe: Column, checked: Column, adult: Column, certification: Column) -> Column:
    return (
        F.when(F.coalesce(adult, F.lit(False)), F.lit(False))
        .when(F.coalesce(path, F.lit("")) == "", F.lit(False))
        .when(~F.coalesce(checked, F.lit(False)) & is_mature(certification), F.lit(False))
        .otherwise(F.coalesce(safe, F.lit(True)))
    )


def poster_is_safe(safe: Column) -> Column:
    """Retrieval filter; a missing flag counts as safe."""
    return F.coalesce(safe, F.lit(True))


def poster_url(path: Column, size: str = "w342") -> Column:
    rooted = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.concat(F.lit(f"{IMAGE_BASE}/{size}"), rooted)


def moderation_verdict(categories: Column, scores: Column, limit: float = SEXUAL_SCORE_LIMIT) -> Column:
    """struct(poster_safe, score, reason) from the category flags and scores of a checker."""
    sexual = F.coalesce(F.try_element_at(categories, F.lit("sexual")), F.lit(False))
    minors = F.coalesce(F.try_element_at(categories, F.lit("sexual/minors")), F.lit(False))
    score = F.coalesce(F.try_element_at(scores, F.lit("sexual")), F.lit(0.0))
    reasons = F.concat_ws(
        "; ",
        F.when(sexual, "sexual=true"),
        F.when(minors, "sexual/minors=true"),
        F.when(score > limit, F.format_string(f"sexual_score=%.3f>{limit:.3f}", score)),
    )
    return F.struct(
        (~(sexual | minors | (score > limit))).alias("poster_safe"),
        score.alias("score"),
        F.when(reasons == "", F.lit("no_sexual_flags")).otherwise(reasons).alias("reason"),
    )
