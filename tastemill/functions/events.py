"""Rating and tag events: ids, construction from CSV rows, validation of JSON payloads."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Namespace of the event ids; pass another one to reproduce ids made elsewhere.
EVENT_NAMESPACE = str(uuid.uuid5(uuid.NAMESPACE_DNS, "tastemill.events"))

# Event fields by kind. Types: uuid, text, int, float, time; "?" = optional.
ENVELOPE = {
    "event_id": "uuid",
    "event_type": "text",
    "stream_pipeline_version": "text",
    "source": "text",
    "occurred_at": "time",
    "produced_at": "time",
}
LINEAGE = {"request_id": "text?", "model_version": "text?", "experiment_id": "text?"}
EVENT_FIELDS = {
    "rating_created": {
        **ENVELOPE, "user_id": "int", "movie_id": "int", "rating": "float", "rating_timestamp": "time", **LINEAGE,
    },
    "rating_deleted": {**ENVELOPE, "user_id": "int", "movie_id": "int", "rating_timestamp": "time", **LINEAGE},
    "tag_created": {**ENVELOPE, "user_id": "int", "movie_id": "int", "tag": "text", "tag_timestamp": "time"},
}
TOPIC_EVENTS = {"ratings": ("rating_created", "rating_deleted"), "tags": ("tag_created",)}
EMPTY_PAYLOAD = "empty_payload"
JSON_ERROR = "json_decode_error"
VALIDATION_ERROR = "validation_error"
UUID_PATTERN = r"^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"
INT_PATTERN = r"^[+-]?\d+(\.0+)?$"
FLOAT_PATTERN = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
TIME_PATTERN = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"
TYPE_SUFFIX = r"[dDfF]\s*$"
# Texts that a number, truth value, object or list gives as well, when it is read as a text.
DOUBTFUL_TEXT = r"^([-+0-9{\[]|(true|false|NaN|Infinity|INF)$)"
EPOCH_MILLIS_FROM = 2e10

_SPARK_TYPE = {"uuid": "string", "text": "string", "int": "bigint", "float": "double", "time": "timestamp"}


def unix_to_utc(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def to_epoch_seconds(moment: Column) -> Column:
    return F.unix_seconds(moment)


def iso_utc(moment: Column) -> Column:
    """2024-01-31T10:00:00+00:00, with six decimals only where they are not zero."""
    micros = F.pmod(F.unix_micros(moment), F.lit(1_000_000))
    fraction = F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(F.lit(""))
    return F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def name_uuid(key: Column, namespace: str = EVENT_NAMESPACE) -> Column:
    """UUID version 5 of a text key."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(key, "UTF-8")))
    # The variant digit keeps its two low bits under the bits 10.
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-5"),
        F.substring(digest, 14, 3),
        F.lit("-"),
        variant,
        F.substring(digest, 18, 3),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )


def rating_event_id(user: Column, movie: Column, moment: Column, rating: Column, namespace: str = EVENT_NAMESPACE) -> Column:
    parts = [F.lit("rating"), user.cast("string"), movie.cast("string"), iso_utc(moment), rating.cast("double").cast("string")]
    return name_uuid(F.concat_ws(":", *parts), namespace)


def tag_event_id(user: Column, movie: Column, tag: Column, moment: Column, namespace: str = EVENT_NAMESPACE) -> Column:
    parts = [F.lit("tag"), user.cast("string"), movie.cast("string"), tag, iso_utc(moment)]
    return name_uuid(F.concat_ws(":", *parts), namespace)


def ratings_to_events(rows: DataFrame, produced_at: Column, source: str = "movielens") -> DataFrame:
    """Rating events from CSV rows (userId, movieId, rating, timestamp)."""
    moment = unix_to_utc(F.col("timestamp"))
    return rows.select(
        rating_event_id(F.col("userId"), F.col("movieId"), moment, F.col("rating")).alias("event_id"),
        F.lit("rating_created").alias("event_type"),
        F.lit("ratings-v1").alias("stream_pipeline_version"),
        F.lit(source).alias("source"),
        moment.alias("occurred_at"),
        produced_at.alias("produced_at"),
        F.col("userId").cast("bigint").alias("user_id"),
        F.col("movieId").cast("bigint").alias("movie_id"),
        F.col("rating").cast("double").alias("rating"),
        moment.alias("rating_timestamp"),
    )


def tags_to_events(rows: DataFrame, produced_at: Column, source: str = "movielens") -> DataFrame:
    """Tag events from CSV rows (userId, movieId, tag, timestamp)."""
    moment = unix_to_utc(F.col("timestamp"))
    return rows.select(
        tag_event_id(F.col("userId"), F.col("movieId"), F.col("tag"), moment).alias("event_id"),
        F.lit("tag_created").alias("event_type"),
        F.lit("tags-v1").alias("stream_pipeline_version"),
        F.lit(source).alias("source"),
        moment.alias("occurred_at"),
        produced_at.alias("produced_at"),
        F.col("userId").cast("bigint").alias("user_id"),
        F.col("movieId").cast("bigint").alias("movie_id"),
        F.col("tag").alias("tag"),
        moment.alias("tag_timestamp"),
    )


# ---------------------------------------------------------------- validation


def _field_value(raw: Column, kind: Column, wanted: str) -> tuple[Column, Column]:
    """(typed value, is valid) of one JSON field; `kind` is its JSON type.

    Lenient like a web API: numbers may come as text, whole floats count as integers,
    booleans as numbers, times as ISO text or epoch numbers. Patterns are only tried where
    a plain cast leaves a doubt.
    """
    is_text = kind == "STRING"
    is_number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    if wanted == "text":
        return F.when(is_text, raw), F.coalesce(is_text, F.lit(False))
    if wanted == "uuid":
        bare = F.lower(F.regexp_replace(raw, "-", ""))
        joined = F.concat_ws(
            "-", *[F.substring(bare, start, length) for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        )
        value = F.when(is_text & raw.rlike(UUID_PATTERN), F.when(F.length(raw) == 36, F.lower(raw)).otherwise(joined))
    elif wanted == "int":
        flag = F.when(kind == "BOOLEAN", F.when(raw == "true", F.lit(1)).otherwise(F.lit(0)))
        whole = F.when(F.contains(raw, F.lit(".")) | F.contains(raw, F.lit("E")), _whole_number(F.trim(raw), is_number))
        value = F.coalesce(F.when(is_text | is_number, F.coalesce(F.trim(raw).try_cast("bigint"), whole)), flag)
    elif wanted == "float":
        flag = F.when(kind == "BOOLEAN", F.when(raw == "true", F.lit(1.0)).otherwise(F.lit(0.0)))
        number = F.when(is_number, raw.try_cast("double")).when(
            is_text & ~raw.rlike(TYPE_SUFFIX), F.trim(raw).try_cast("double")
        )
        value = F.coalesce(number, flag)
    else:
        value = F.when(is_text & raw.rlike(TIME_PATTERN), raw.try_cast("timestamp")).when(
            is_number | (is_text & raw.rlike(FLOAT_PATTERN)), _epoch_time(F.trim(raw).try_cast("double"))
        )
    return value.cast(_SPARK_TYPE[wanted]), value.isNotNull()


def _whole_number(text: Column, is_number: Column) -> Column:
    """A float without fraction as integer; as text only in the form 12.0."""
    number = text.try_cast("double")
    return F.when((is_number | text.rlike(INT_PATTERN)) & (number == F.floor(number)), number.cast("bigint"))


def _epoch_time(number: Column) -> Column:
    seconds = F.when(F.abs(number) > EPOCH_MILLIS_FROM, number / 1000).otherwise(number)
    return F.timestamp_micros(F.round(seconds * 1_000_000).cast("bigint"))


def bind(value: Column, build: Callable[[Column], Column]) -> Column:
    """`build(value)` with the value computed once, however often `build` uses it."""
    return F.get(F.transform(F.array(value), build), 0)


def validate_events(messages: DataFrame, topic: str, value: str = "value") -> DataFrame:
    """Add `event` (typed struct), `error_type`, `error_message` and `raw_event_id` to raw messages.

    Exactly one of `event` and `error_type` is set. Well-formed messages are read once by a strict
    typed schema; a message that leaves any doubt there is judged field by field, so one bad
    field does not hide the others.
    """
    kinds = TOPIC_EVENTS[topic]
    fields: dict[str, str] = {}
    for kind in kinds:
        fields.update(EVENT_FIELDS[kind])

    def either(read: Column) -> Column:
        event, certain = _strict_event(read["doc"], fields, kinds)
        sure = certain & F.ltrim(read["text"]).startswith("{")
        none = F.lit(None).cast("string")
        plain = F.struct(event.alias("event"), none.alias("error_type"), none.alias("error_message"), read["doc"]["event_id"].alias("raw_event_id"))
        return F.when(sure, plain).otherwise(_judged(read["text"], fields, kinds))

    text = F.col(value).cast("string")
    options = {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}
    read = F.struct(text.alias("text"), F.from_json(text, _strict_schema(fields), options).alias("doc"))
    return messages.withColumn("__checked", bind(read, either)).select(*messages.columns, "__checked.*")


def _strict_schema(fields: dict[str, str]) -> str:
    kinds = {"int": "bigint", "float": "double"}
    return ", ".join(f"{name} {kinds.get(spec.rstrip('?'), 'string')}" for name, spec in fields.items()) + ", _corrupt string"


def _strict_event(doc: Column, fields: dict[str, str], kinds: tuple[str, ...]) -> tuple[Column, Column]:
    """(typed event, is certain) of a message read by the strict schema.

    Certain are messages whose fields all have the JSON type and form that producers write: whole
    numbers, finite numbers, UUIDs with hyphens, ISO times, and texts that no number, truth
    value, object or list could have been read as.
    """
    event_type = doc["event_type"]
    sure, values = [doc.isNotNull() & doc["_corrupt"].isNull() & event_type.isin(*kinds)], []
    for name, spec in fields.items():
        raw, wanted = doc[name], spec.rstrip("?")
        if wanted == "int":
            value, good = raw, raw.isNotNull()
        elif wanted == "float":
            # Zero has one sign.
            value, good = raw + F.lit(0.0), ~F.isnan(raw) & (F.abs(raw) < float("inf"))
        elif wanted == "uuid":
            value, good = F.lower(raw), (F.length(raw) == 36) & raw.rlike(UUID_PATTERN)
        elif wanted == "text":
            value, good = raw, ~raw.rlike(DOUBTFUL_TEXT)
        else:
            value = F.when(raw.rlike(TIME_PATTERN), raw.try_cast("timestamp"))
            good = value.isNotNull()
        applies = event_type.isin(*[k for k in kinds if name in EVENT_FIELDS[k]])
        fine = F.coalesce(good, F.lit(False)) | raw.isNull() if spec.endswith("?") else F.coalesce(good, F.lit(False))
        sure.append(fine | ~applies)
        values.append(F.when(applies, value.cast(_SPARK_TYPE[wanted])).alias(name))
    certain = sure[0]
    for one in sure[1:]:
        certain = certain & one
    return F.struct(*values), F.coalesce(certain, F.lit(False))


def _judged(message: Column, fields: dict[str, str], kinds: tuple[str, ...]) -> Column:
    """struct(event, error_type, error_message, raw_event_id); every field is a JSON value of its own."""
    ddl = ", ".join(f"{name} variant" for name in fields) + ", _corrupt string"

    def parsed_text(text: Column) -> Column:
        doc = F.from_json(text, ddl, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
        empty = text.isNull() | (F.length(text) == 0)
        return F.struct(doc.alias("doc"), empty.alias("empty"), (~F.ltrim(text).startswith("{")).alias("not_object"))

    def raw_fields(parsed: Column) -> Column:
        doc = parsed["doc"]
        parts = [
            F.struct(doc[n].cast("string").alias("text"), F.schema_of_variant(doc[n]).alias("kind")).alias(n)
            for n in fields
        ]
        broken = doc.isNull() | doc["_corrupt"].isNotNull() | parsed["not_object"]
        return F.struct(parsed["empty"].alias("empty"), broken.alias("broken"), *parts)

    def typed_fields(raw: Column) -> Column:
        parts = []
        for name, spec in fields.items():
            typed, valid = _field_value(raw[name]["text"], raw[name]["kind"], spec.rstrip("?"))
            given = raw[name]["kind"]
            parts.append(F.struct(typed.alias("value"), valid.alias("valid"), given.alias("kind")).alias(name))
        seen = blank_null(raw["event_id"]["text"])
        return F.struct(raw["empty"].alias("empty"), raw["broken"].alias("broken"), seen.alias("seen_id"), *parts)

    def verdict(typed: Column) -> Column:
        event_type = F.when(typed["event_type"]["kind"] == "STRING", typed["event_type"]["value"])
        problems, values = [], []
        for name, spec in fields.items():
            field, wanted = typed[name], spec.rstrip("?")
            applies = event_type.isin(*[k for k in kinds if name in EVENT_FIELDS[k]])
            absent = field["kind"].isNull()
            if spec.endswith("?"):
                bad = ~absent & (field["kind"] != "VOID") & ~field["valid"]
                problem = F.when(bad, F.lit(f"{name}: invalid {wanted}"))
            else:
                problem = F.when(absent, F.lit(f"{name}: missing")).when(
                    ~field["valid"], F.lit(f"{name}: invalid {wanted}")
                )
            problems.append(F.when(applies, problem))
            values.append(F.when(applies, field["value"]).alias(name))
        unknown = ~F.coalesce(event_type.isin(*kinds), F.lit(False))
        message = F.when(
            unknown, F.concat(F.lit("event_type: unknown "), F.coalesce(event_type, F.lit("null")))
        ).otherwise(F.concat_ws("; ", *problems))
        return F.struct(
            F.struct(*values).alias("event"),
            F.when(typed["empty"] | typed["broken"], F.lit("Could not decode JSON payload")).otherwise(message).alias("message"),
            F.when(typed["empty"], EMPTY_PAYLOAD)
            .when(typed["broken"], JSON_ERROR)
            .when(message != "", VALIDATION_ERROR)
            .alias("error_type"),
            typed["seen_id"].alias("seen_id"),
        )

    def outcome(found: Column) -> Column:
        failed = found["error_type"]
        return F.struct(
            F.when(failed.isNull(), found["event"]).alias("event"),
            failed.alias("error_type"),
            F.when(failed.isNotNull(), found["message"]).alias("error_message"),
            F.when(F.coalesce(failed, F.lit("")).isin("", VALIDATION_ERROR), found["seen_id"]).alias("raw_event_id"),
        )

    # The chain reads the message once, so filters on its outcome stay small when pushed down.
    for step in (parsed_text, raw_fields, typed_fields, verdict, outcome):
        message = bind(message, step)
    return message


def blank_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def valid_events(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("error_type").isNull())


def dead_letters(validated: DataFrame, worker: str) -> DataFrame:
    """Rows for the dead-letter table, keyed by (topic, partition, offset)."""
    return validated.where(F.col("error_type").isNotNull()).select(
        F.lit(worker).alias("worker_name"),
        F.col("topic").alias("source_topic"),
        F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"),
        F.col("raw_event_id").alias("event_id"),
        "error_type",
        "error_message",
        F.coalesce(F.col("value").cast("string"), F.lit("")).alias("raw_payload"),
    )


def event_json(df: DataFrame, columns: list[str]) -> Column:
    """Event as JSON text with ISO times; NULL fields are left out."""
    fields = []
    for name in columns:
        is_time = df.schema[name].dataType.typeName() == "timestamp"
        fields.append((iso_utc(F.col(name)) if is_time else F.col(name)).alias(name))
    return F.to_json(F.struct(*fields))
