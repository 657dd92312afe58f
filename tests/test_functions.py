"""Literal cases of the column functions."""

import math
import uuid
import zlib
from datetime import UTC, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tastemill.functions import events as ev
from tastemill.functions import numeric as nu
from tastemill.functions import posters as po
from tastemill.functions import text as tx


def one(spark, column, **values):
    """Value of a column expression over one row of literals."""
    row = spark.range(1).select(*[F.lit(v).alias(n) for n, v in values.items()] or [F.lit(0).alias("_")])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "title", "year"),
    [("Toy Story (1995)", "Toy Story", 1995), ("  Heat  ", "Heat", None), ("A (1990) (2001)", "A (1990)", 2001), ("X (199)", "X (199)", None)],
)
def test_title_year(spark, raw, title, year):
    found = one(spark, tx.parse_title_year(F.col("raw")), raw=raw)
    assert (found.title, found.year) == (title, year)


@pytest.mark.parametrize(
    ("raw", "want"), [("A|B", ["A", "B"]), ("", []), ("(no genres listed)", []), (" A | |B|", ["A", "B"]), (None, [])]
)
def test_genres(spark, raw, want):
    assert one(spark, tx.parse_genres(F.col("raw").cast("string")), raw=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("0114709", "tt0114709"), (" tt1 ", "tt1"), ("  ", None)])
def test_imdb(spark, raw, want):
    assert one(spark, tx.format_imdb_id(F.col("raw")), raw=raw) == want


def test_certification_takes_first_non_blank_us_entry(spark):
    doc = """{"release_dates": {"results": [{"iso_3166_1": "CA", "release_dates": [{"certification": "14A"}]},
      {"iso_3166_1": "US", "release_dates": [{"certification": ""}, {"certification": "PG-13"}, {"certification": "R"}]}]}}"""
    found = one(spark, tx.parse_movie_payload(F.col("doc")), doc=doc)
    assert found.certification_us == "PG-13"
    assert found.adult is False and found.tmdb_keywords == [] and found.overview is None


@pytest.mark.parametrize("doc", ['{"a": ', "[1]", "", "nope", None])
def test_broken_payload(spark, doc):
    assert one(spark, tx.parse_movie_payload(F.col("doc").cast("string")), doc=doc) is None


def test_embedding_text(spark):
    text = tx.embedding_text(
        F.lit(" Heat "), F.lit(""), F.lit("Cops"), F.array(F.lit("Crime"), F.lit("Drama")), F.array().cast("array<string>"),
        F.array(*[F.lit(f"t{i}") for i in range(12)]),
    )
    assert one(spark, text) == "Heat\nCops\nGenres: Crime, Drama\nTags: " + ", ".join(f"t{i}" for i in range(10))


@pytest.mark.parametrize(
    ("value", "low", "high", "want"), [(5.0, 0.0, 10.0, 0.5), (None, 0.0, 1.0, 0.0), (5.0, 5.0, 5.0, 0.0), (math.nan, 0.0, 1.0, 0.0), (12.0, 0.0, 10.0, 1.0)]
)
def test_min_max(spark, value, low, high, want):
    assert one(spark, nu.min_max_norm(F.col("v").cast("double"), F.lit(low), F.lit(high)), v=value) == want


@pytest.mark.parametrize(("value", "want"), [(None, 0.0), (-1.0, 0.0), (math.nan, 0.0), (math.e - 1, 1.0)])
def test_log1p(spark, value, want):
    assert one(spark, nu.log1p_or_zero(F.col("v").cast("double")), v=value) == pytest.approx(want)


@pytest.mark.parametrize(
    ("fraction", "challenged", "want"), [(0.30, True, (14, 6)), (0.125, True, (18, 2)), (0.175, True, (16, 4)), (0.3, False, (20, 0)), (0.0, True, (20, 0))]
)
def test_slots_round_halves_to_even(spark, fraction, challenged, want):
    found = one(spark, nu.model_slots(F.lit(20), F.lit(fraction), F.lit(challenged)))
    assert (found.main_slots, found.candidate_slots) == want
    if challenged and fraction:
        assert want[1] == round(20 * fraction)


def test_daily_seed_is_the_adler_checksum(spark):
    day = F.lit(datetime(2024, 2, 1, 12)).cast("timestamp")
    assert one(spark, nu.daily_seed(F.lit(42), day)) == zlib.adler32(b"42:2024-02-01") & 0x7FFFFFFF
    assert one(spark, nu.daily_seed(F.lit(42), day, F.lit(" x "))) == zlib.adler32(b"42:2024-02-01:x") & 0x7FFFFFFF
    assert one(spark, nu.daily_seed(F.lit(42), day, F.lit("  "))) == zlib.adler32(b"42:2024-02-01") & 0x7FFFFFFF
    assert one(spark, nu.adler32(F.lit("é€" * 300))) == zlib.adler32(("é€" * 300).encode())


@settings(max_examples=15, deadline=None)
@given(st.text(max_size=40))
def test_name_uuid_equals_python(spark, key):
    assert one(spark, ev.name_uuid(F.lit(key))) == str(uuid.uuid5(uuid.UUID(ev.EVENT_NAMESPACE), key))


def test_rating_event_id_uses_iso_time_and_float_text(spark):
    moment = datetime(2021, 1, 1, 0, 0, 0, 250000, tzinfo=UTC)
    made = ev.rating_event_id(F.lit(1), F.lit(2), F.timestamp_micros(F.lit(int(moment.timestamp() * 1e6))), F.lit(3.5))
    want = uuid.uuid5(uuid.UUID(ev.EVENT_NAMESPACE), f"rating:1:2:{moment.isoformat()}:3.5")
    assert one(spark, made) == str(want)


@pytest.mark.parametrize(
    ("path", "safe", "checked", "adult", "cert", "want"),
    [
        ("/a", True, True, True, "G", False), (None, True, True, False, "G", False), ("/a", True, False, False, "R", False),
        ("/a", True, False, False, "PG", True), ("/a", False, True, False, "PG", False), ("/a", True, True, False, "NC-17", True),
        ("/a", None, False, False, None, True),
    ],
)
def test_show_poster(spark, path, safe, checked, adult, cert, want):
    shown = po.show_poster(
        F.lit(path).cast("string"), F.lit(safe).cast("boolean"), F.lit(checked), F.lit(adult), F.lit(cert).cast("string")
    )
    assert one(spark, shown) is want


@pytest.mark.parametrize(
    ("flags", "score", "safe", "reason"),
    [
        ({}, 0.1, True, "no_sexual_flags"),
        ({"sexual": True}, 0.5, False, "sexual=true; sexual_score=0.500>0.350"),
        ({"sexual/minors": True}, 0.0, False, "sexual/minors=true"),
        ({}, 0.35, True, "no_sexual_flags"),
    ],
)
def test_moderation(spark, flags, score, safe, reason):
    row = spark.createDataFrame([(flags, {"sexual": score})], "flags map<string,boolean>, scores map<string,double>")
    found = row.select(po.moderation_verdict(F.col("flags"), F.col("scores")).alias("v")).first().v
    assert (found.poster_safe, found.score, found.reason) == (safe, score, reason)


# ---------------------------------------------------------------- messages

GOOD = {
    "event_id": "0b0e6a5e-6d7c-5f1a-9f0a-1f6c0a2b3c4d", "event_type": "rating_created", "stream_pipeline_version": "ratings-v1",
    "source": "movielens", "occurred_at": "2021-01-01T00:00:00Z", "produced_at": "2021-01-01T00:00:01+00:00",
    "user_id": 1, "movie_id": 2, "rating": 3.5, "rating_timestamp": "2021-01-01T00:00:00Z",
}


def judge(spark, payload, topic="ratings"):
    import json

    text = payload if isinstance(payload, str | None) else json.dumps(payload)
    row = spark.createDataFrame([(None if text is None else bytearray(text.encode()),)], "value binary")
    return ev.validate_events(row, topic).first()


def test_good_rating(spark):
    found = judge(spark, GOOD)
    assert found.error_type is None
    assert (found.event.user_id, found.event.rating, found.event.request_id) == (1, 3.5, None)
    assert found.event.rating_timestamp == datetime(2021, 1, 1)


@pytest.mark.parametrize(
    "change",
    [{"user_id": "1"}, {"user_id": 1.0}, {"rating": "3.5"}, {"rating": 4}, {"extra": [1]}, {"request_id": None}, {"request_id": "r"},
     {"occurred_at": 1609459200}, {"occurred_at": "1609459200"}, {"event_id": GOOD["event_id"].replace("-", "").upper()}],
)
def test_lenient_values_are_accepted(spark, change):
    found = judge(spark, {**GOOD, **change})
    assert found.error_type is None, found.error_message
    assert found.event.event_id == GOOD["event_id"]


@pytest.mark.parametrize(
    ("change", "message"),
    [
        ({"event_type": "rating_updated"}, "event_type: unknown rating_updated"),
        ({"event_id": "not-a-uuid"}, "event_id: invalid uuid"),
        ({"rating": "x"}, "rating: invalid float"),
        ({"user_id": 1.5}, "user_id: invalid int"),
        ({"user_id": None}, "user_id: invalid int"),
        ({"source": 5}, "source: invalid text"),
        ({"occurred_at": "yesterday"}, "occurred_at: invalid time"),
        ({"request_id": 5}, "request_id: invalid text"),
    ],
)
def test_invalid_values_are_reported(spark, change, message):
    found = judge(spark, {**GOOD, **change})
    assert (found.error_type, found.error_message, found.event) == (ev.VALIDATION_ERROR, message, None)


def test_strict_reading_agrees_with_reading_by_field(spark, monkeypatch):
    """All pairs of odd values, through both readings and through the field-wise one alone."""
    import itertools
    import json

    odd = [
        {"user_id": v} for v in (0, -5, "7", " 7 ", 1.0, 1e3, 1.5, True, None, [], 2**63, -(2**63), "x")
    ] + [{"rating": v} for v in (0, -0.0, 4, "3.5", "3.5d", "NaN", "Infinity", "-Infinity", float("nan"), float("inf"), 1e400, 1e-7, True, None, {})
    ] + [{"source": v} for v in ("", " ", "true", "true story", "null", "5", "5 stars", "-", "{", "[1]", "NaN", "INF", 5, 5.5, True, None, {"a": 1}, [1], "é€😀", "a\nb")
    ] + [{"request_id": v} for v in ("", "r", "1", 5, False, None, {})
    ] + [{"event_type": v} for v in ("rating_deleted", "tag_created", "", 5, None, "true")
    ] + [{"occurred_at": v} for v in ("2021-01-01", "2021-01-01 10:00", "2021-02-30T00:00:00Z", "20210101", "1609459200", 1609459200, 1609459200.25, "x", "", None, True)
    ] + [{"event_id": v} for v in (GOOD["event_id"].upper(), GOOD["event_id"].replace("-", ""), 5, None, "")]
    payloads = [{**GOOD, **a} for a in odd] + [{**GOOD, **a, **b} for a, b in itertools.islice(itertools.combinations(odd, 2), 0, None, 7)]
    payloads += [{k: v for k, v in GOOD.items() if k != gone} for gone in GOOD]
    good = json.dumps(GOOD)
    texts = [json.dumps(p) for p in payloads]
    texts += [good, " " + good, f"[{good}]", good + " x", good[:-1], good[:-1] + ', "user_id": "x"}', good[:-1] + ', "user_id": null}', "", "{}", "null", "5", None]
    rows = spark.createDataFrame([(i, None if x is None else bytearray(x.encode())) for i, x in enumerate(texts)], "i int, value binary")
    both = ev.validate_events(rows, "ratings").orderBy("i").collect()
    strict = ev._strict_event
    monkeypatch.setattr(ev, "_strict_event", lambda *a: (strict(*a)[0], F.lit(False)))
    alone = ev.validate_events(rows, "ratings").orderBy("i").collect()
    parts = ("event", "error_type", "error_message", "raw_event_id")
    differ = [(r.value, n, repr(r[n]), repr(o[n])) for r, o in zip(both, alone, strict=True) for n in parts if repr(r[n]) != repr(o[n])]
    assert not differ
    assert sum(r.error_type is None for r in both) > 50 and sum(r.error_type is not None for r in both) > 50


def test_missing_and_several_problems(spark):
    bad = {k: v for k, v in GOOD.items() if k != "movie_id"} | {"rating": "x"}
    found = judge(spark, bad)
    assert set(found.error_message.split("; ")) == {"movie_id: missing", "rating: invalid float"}
    assert found.raw_event_id == GOOD["event_id"]


def test_deletion_needs_no_rating(spark):
    gone = {k: v for k, v in GOOD.items() if k != "rating"} | {"event_type": "rating_deleted"}
    found = judge(spark, gone)
    assert found.error_type is None and found.event.rating is None


@pytest.mark.parametrize(
    ("payload", "error"),
    [(None, ev.EMPTY_PAYLOAD), ("", ev.EMPTY_PAYLOAD), ("{oops", ev.JSON_ERROR), ("[1, 2]", ev.JSON_ERROR), ("5", ev.JSON_ERROR)],
)
def test_undecodable_messages(spark, payload, error):
    found = judge(spark, payload)
    assert (found.error_type, found.event, found.raw_event_id) == (error, None, None)


def test_tag_event(spark):
    tag = {k: GOOD[k] for k in ev.ENVELOPE} | {"event_type": "tag_created", "user_id": 1, "movie_id": 2, "tag": "slow", "tag_timestamp": "2021-01-01"}
    assert judge(spark, tag, "tags").event.tag == "slow"
    assert judge(spark, GOOD, "tags").error_type == ev.VALIDATION_ERROR


def test_a_payload_is_parsed_once(spark):
    rows = spark.createDataFrame([('{"overview": "a"}',)], "doc string").select(tx.parse_movie_payload(F.col("doc")).alias("d"))
    plan = rows.select("d.overview", "d.runtime", "d.adult", "d.certification_us")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_rounded_equals_round(spark):
    values = [0.0, -0.0, 0.0078125, -0.0078125, 1e-9, -1e-9, 4.4999995, 0.1234565, -2.5, 1e300, float("inf"), float("nan"), None]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", nu.rounded(F.col("v")).alias("a"), F.round("v", 6).alias("b"))
    assert [str(r.a) for r in rows.collect()] == [str(r.b) for r in rows.collect()]
