"""Catalog text: titles, genres, ids, payloads, certifications, embedding text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NO_GENRES = "(no genres listed)"
TITLE_YEAR = r"^(.*)\s+\((\d{4})\)$"
MAX_TAGS = 10
ERROR_TEXT_LIMIT = 2000

MOVIE_PAYLOAD = (
    "overview string, tagline string, original_language string, runtime string, popularity string, "
    "vote_average string, vote_count string, poster_path string, adult boolean, "
    "keywords struct<keywords:array<struct<name:string>>>, "
    "release_dates struct<results:array<struct<iso_3166_1:string,release_dates:array<struct<certification:string>>>>>, "
    "_corrupt string"
)


def strip(text: Column) -> Column:
    """Trim any white space, not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def parse_title_year(raw: Column) -> Column:
    """struct(title, year) of 'Name (1999)'; year is NULL without a trailing year."""
    cleaned = strip(raw)
    found = cleaned.rlike(TITLE_YEAR)
    return F.struct(
        F.when(found, strip(F.regexp_extract(cleaned, TITLE_YEAR, 1))).otherwise(cleaned).alias("title"),
        F.when(found, F.regexp_extract(cleaned, TITLE_YEAR, 2).try_cast("int")).alias("year"),
    )


def parse_genres(raw: Column) -> Column:
    names = F.filter(F.transform(F.split(raw, r"\|"), strip), lambda g: g != "")
    return F.when(raw.isNull() | raw.isin("", NO_GENRES), F.array().cast("array<string>")).otherwise(names)


def format_imdb_id(raw: Column) -> Column:
    cleaned = blank_to_null(strip(raw))
    return F.when(cleaned.startswith("tt"), cleaned).otherwise(F.concat(F.lit("tt"), cleaned))


def us_certification(release_dates: Column) -> Column:
    """First non-blank certification among the US entries, in document order."""
    us = F.filter(release_dates["results"], lambda country: country["iso_3166_1"] == "US")
    entries = F.flatten(
        F.transform(
            us, lambda c: F.coalesce(c["release_dates"], F.array().cast("array<struct<certification:string>>"))
        )
    )
    names = F.filter(
        F.transform(entries, lambda e: strip(e["certification"])), lambda c: c.isNotNull() & (c != "")
    )
    return F.get(names, 0)


def parse_movie_payload(payload: Column) -> Column:
    """struct of catalog columns from a movie JSON document; NULL when it is not a JSON object.

    The document is parsed once: as the only element of an array it has a name that all columns use.
    """
    parsed = F.from_json(payload, MOVIE_PAYLOAD, {"columnNameOfCorruptRecord": "_corrupt"})
    read = F.struct(payload.alias("text"), parsed.alias("doc"))
    return F.get(F.transform(F.array(read), lambda r: _movie_details(r["text"], r["doc"])), 0)


def _movie_details(payload: Column, doc: Column) -> Column:
    names = F.transform(F.coalesce(doc["keywords"]["keywords"], F.array().cast("array<struct<name:string>>")), lambda k: k["name"])
    details = F.struct(
        blank_to_null(doc["overview"]).alias("overview"),
        blank_to_null(doc["tagline"]).alias("tagline"),
        blank_to_null(doc["original_language"]).alias("original_language"),
        doc["runtime"].try_cast("double").cast("int").alias("runtime"),
        doc["popularity"].try_cast("double").alias("tmdb_popularity"),
        doc["vote_average"].try_cast("double").alias("tmdb_vote_average"),
        doc["vote_count"].try_cast("double").cast("int").alias("tmdb_vote_count"),
        F.filter(names, lambda n: n.isNotNull() & (n != "")).alias("tmdb_keywords"),
        blank_to_null(doc["poster_path"]).alias("poster_path"),
        F.coalesce(doc["adult"], F.lit(False)).alias("adult"),
        us_certification(doc["release_dates"]).alias("certification_us"),
    )
    broken = payload.isNull() | doc["_corrupt"].isNotNull() | ~strip(payload).startswith("{")
    return F.when(~broken, details)


def embedding_text(
    title: Column, overview: Column, tagline: Column, genres: Column, keywords: Column, tags: Column
) -> Column:
    """Sections joined by line breaks, empty ones left out."""

    def listed(label: str, values: Column) -> Column:
        return F.when(F.size(values) > 0, F.concat(F.lit(label), F.array_join(values, ", ")))

    return F.concat_ws(
        "\n",
        blank_to_null(strip(title)),
        blank_to_null(strip(overview)),
        blank_to_null(strip(tagline)),
        listed("Genres: ", genres),
        listed("Keywords: ", keywords),
        listed("Tags: ", F.slice(tags, 1, MAX_TAGS)),
    )


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def embedding_is_stale(stored_hash: Column, stored_vector: Column, text: Column, dim: int) -> Column:
    """Missing, made from another text, or of another width."""
    return stored_hash.isNull() | (stored_hash != text_hash(text)) | (F.coalesce(F.size(stored_vector), F.lit(-1)) != dim)


def error_text(message: Column) -> Column:
    return F.left(message, F.lit(ERROR_TEXT_LIMIT))
