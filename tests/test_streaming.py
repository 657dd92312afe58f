"""Streams over files: replays change nothing, dead letters are kept, tags have their effects."""

import json

import pytest
from pyspark.sql import functions as F

from checks import tables as t
from tastemill.functions import events as ev
from tastemill.sources.datasets import read_current
from tastemill.streaming import health, ingest, replay, seen


def run(spark, source, topic, root, checkpoint, catalog=None, files=1):
    query = ingest.start_ingest(ingest.file_source(spark, source, files), topic, root, checkpoint, catalog)
    query.awaitTermination(300)
    assert query.exception() is None


def test_ratings_stream_and_replay(spark, sf, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    messages = t.rating_messages(spark, sf).persist()
    ingest.write_messages(messages.repartition(2, "partition"), source)
    run(spark, source, "ratings", root, str(tmp_path / "cp1"))
    stored = spark.read.parquet(f"{root}/ratings_events")
    letters = spark.read.parquet(f"{root}/dead_letter_events")
    checked = ev.validate_events(messages, "ratings")
    want = checked.where("error_type is null").select("event.event_id").distinct().count()
    first = (stored.count(), letters.count())
    assert first == (want, checked.where("error_type is not null").count())
    assert stored.select("event_id").distinct().count() == want
    assert {r.error_type for r in letters.select("error_type").distinct().collect()} == {ev.EMPTY_PAYLOAD, ev.JSON_ERROR, ev.VALIDATION_ERROR}
    # A new checkpoint replays everything; batch numbers continue where tables already exist.
    ingest.write_messages(messages.limit(0), str(tmp_path / "none"))
    batch = spark.read.schema("value string, topic string, partition int, offset bigint").json(source).withColumn("value", F.unbase64("value"))
    ingest.ingest_batch(batch, 99, "ratings", root)
    again = (spark.read.parquet(f"{root}/ratings_events").count(), spark.read.parquet(f"{root}/dead_letter_events").count())
    assert again == first
    messages.unpersist()


def test_repeated_batch_rewrites_only_itself(spark, sf, tmp_path):
    root = str(tmp_path / "out")
    messages = t.rating_messages(spark, sf)
    early, late = messages.where("partition < 2"), messages.where("partition >= 2")
    for batch, number in ((early, 0), (late, 1), (late, 1)):
        ingest.ingest_batch(batch, number, "ratings", root)
    stored = spark.read.parquet(f"{root}/ratings_events")
    assert stored.count() == stored.select("event_id").distinct().count()


def tag_messages(spark, rows, start=0):
    events = [
        {
            "event_id": f"00000000-0000-5000-8000-{key:012d}", "event_type": "tag_created", "stream_pipeline_version": "tags-v1", "source": "s",
            "occurred_at": "2021-01-01T00:00:00Z", "produced_at": "2021-01-01T00:00:00Z", "user_id": 1, "movie_id": movie, "tag": tag,
            "tag_timestamp": "2021-01-01T00:00:00Z",
        }
        for key, movie, tag in rows
    ]
    data = [(bytearray(json.dumps(e).encode()), "tags", 0, start + i) for i, e in enumerate(events)]
    return spark.createDataFrame(data, ingest.MESSAGE_SCHEMA)


def test_tags_stream_counts_and_dirty_marks(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    catalog = spark.createDataFrame([(10,), (11,)], "movie_id bigint")
    ingest.write_messages(tag_messages(spark, [(1, 10, "slow"), (2, 10, "slow"), (1, 10, "slow")]).coalesce(1), source)
    ingest.write_messages(tag_messages(spark, [(2, 10, "slow"), (3, 77, "fun")], 10).coalesce(1), source)
    run(spark, source, "tags", root, str(tmp_path / "cp"), catalog)
    counts = ingest.current_tag_counts(spark, root)
    assert {(r.movie_id, r.tag): r["count"] for r in counts.collect()} == {(10, "slow"): 2, (77, "fun"): 1}
    dirty = read_current(spark, f"{root}/catalog_dirty_movies", "movie_id bigint, attempt_count bigint")
    assert [r.movie_id for r in dirty.collect()] == [10]
    # The same files again under a new checkpoint: nothing is counted twice.
    batch = tag_messages(spark, [(1, 10, "slow"), (3, 77, "fun")])
    ingest.ingest_batch(batch, 50, "tags", root, catalog)
    ingest.ingest_batch(tag_messages(spark, [(4, 10, "slow")]), 51, "tags", root, catalog)
    ingest.ingest_batch(tag_messages(spark, [(4, 10, "slow")]), 51, "tags", root, catalog)
    counts = ingest.current_tag_counts(spark, root)
    assert {(r.movie_id, r.tag): r["count"] for r in counts.collect()} == {(10, "slow"): 3, (77, "fun"): 1}


def numbered(spark, keys):
    return spark.createDataFrame([(f"id-{k}", k) for k in keys], "event_id string, offset bigint")


def store(spark, keys, batch_id, path):
    ingest._append_new(numbered(spark, keys), ["event_id"], ["offset"], path, batch_id)


def test_new_ids_open_no_more_files_in_late_batches(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "events")
    reads = []
    plain = type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *paths, **kw: (reads.extend(paths), plain(self, *paths, **kw))[1])
    monkeypatch.setattr(seen, "FOLD_EVERY", 3)
    opened = {}
    for batch in range(13):
        reads.clear()
        store(spark, range(batch * 10, batch * 10 + 10), batch, path)
        opened[batch] = len(seen.seen_hashes(spark, f"{path}_index").inputFiles())
        # New ids: only the index is read, no stored event.
        assert batch == 0 or all(p.startswith(f"{path}_index") for p in reads)
    assert max(opened[b] for b in range(7, 13)) <= max(opened[b] for b in range(1, 7))
    reads.clear()
    store(spark, [*range(35, 45), 1000, 1000], 13, path)
    assert sorted(p for p in reads if not p.startswith(f"{path}_index")) == [f"{path}/batch_id={b}" for b in (3, 4)]
    monkeypatch.undo()
    ids = [r.event_id for r in spark.read.parquet(path).collect()]
    assert len(ids) == len(set(ids)) == 131


def test_index_of_an_old_table_and_a_batch_that_failed(spark, tmp_path):
    path = str(tmp_path / "events")
    numbered(spark, range(5)).write.parquet(f"{path}/batch_id=0")
    store(spark, range(3, 8), 1, path)
    # Indexed but not stored: the ids are still new, also for another batch.
    seen.index_batch(numbered(spark, [20, 21]), ["event_id"], f"{path}_index", 2)
    store(spark, [7, 20, 21], 3, path)
    store(spark, [7, 20, 21], 3, path)
    store(spark, range(5), 0, path)
    kept = spark.read.parquet(path).groupBy("batch_id").agg(F.sort_array(F.collect_list("offset")).alias("k")).collect()
    assert {r.batch_id: r.k for r in kept} == {0: [0, 1, 2, 3, 4], 1: [5, 6, 7], 3: [20, 21]}
    before = spark.read.parquet(path).count()
    store(spark, [], 4, path)
    assert spark.read.parquet(path).count() == before


def test_tag_counts_are_written_per_batch(spark, tmp_path):
    root = str(tmp_path)
    rows = lambda *pairs: spark.createDataFrame(pairs, "movie_id bigint, tag string")
    counts = lambda: {(r.movie_id, r.tag): r["count"] for r in ingest.current_tag_counts(spark, root).collect()}
    assert counts() == {}
    ingest.add_count_changes(rows(*[(m, "old") for m in range(500)]), root, 0, fold_every=2)
    for batch in (1, 2, 3, 3, 4):
        ingest.add_count_changes(rows((7, "old"), (7, "new")), root, batch, fold_every=2)
        # One row per key of the batch, not of the table.
        assert spark.read.parquet(f"{root}/movie_tag_counts/changes/batch_id={batch}").count() == 2
    assert counts()[(7, "old")] == 5 and counts()[(7, "new")] == 4 and len(counts()) == 501
    ingest.add_count_changes(rows((7, "old"), (7, "new")), root, 1, fold_every=2)  # a base holds it
    assert counts()[(7, "old")] == 5
    ingest.add_count_changes(rows((7, "new")), root, 9, fold_every=2)
    assert counts()[(7, "new")] == 5
    with pytest.raises(ValueError, match="continue"):
        ingest.add_count_changes(rows((7, "new")), root, -1, fold_every=2)


def test_csv_rows_become_stored_events(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text("userId,movieId,rating,timestamp\n1,2,3.5,1000\n1,3,4.0,1001\n")

    def publish():
        messages = replay.csv_messages(spark, str(folder), "ratings", 1)
        query = replay.publish_to_files(messages, str(tmp_path / "topic"), str(tmp_path / "cp-publish"))
        query.awaitTermination(120)

    publish()
    (folder / "b.csv").write_text('userId,movieId,rating,timestamp\n2,2,1.5,1002\n')
    publish()
    assert spark.read.json(str(tmp_path / "topic")).count() == 3
    source = ingest.file_source(spark, str(tmp_path / "topic" / "*"), 5)
    query = ingest.start_ingest(source, "ratings", str(tmp_path / "out"), str(tmp_path / "cp-ingest"))
    query.awaitTermination(120)
    stored = spark.read.parquet(str(tmp_path / "out" / "ratings_events"))
    assert sorted((r.user_id, r.movie_id, r.rating) for r in stored.collect()) == [(1, 2, 3.5), (1, 3, 4.0), (2, 2, 1.5)]
    assert replay.first_rows(spark, str(folder / "a.csv"), "ratings", 1).count() == 1


def test_rows_of_a_growing_file_are_published_once(spark, tmp_path):
    path = tmp_path / "ratings.csv"
    publish = lambda: replay.publish_new_rows(spark, str(path), "ratings", str(tmp_path / "topic"), str(tmp_path / "progress"))
    path.write_text("userId,movieId,rating,timestamp\n1,2,3.5,1000\n")
    assert publish() == 1
    assert publish() == 0
    path.write_text(path.read_text() + "1,3,4.0,1001\n2,2,1.5,1002\n")
    assert publish() == 2
    assert publish() == 0
    messages = spark.read.json(str(tmp_path / "topic")).select(F.unbase64("value").cast("string").alias("v"))
    assert messages.count() == messages.distinct().count() == 3


def test_windows_work_on_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("ts").cast("timestamp").alias("handled_at"), F.col("event_type").alias("worker"), F.lit("success").alias("status")
    )
    path = str(tmp_path / "in")
    events.write.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    query = health.event_rates(stream).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.window.start, r.worker): r.events for r in spark.table("rates").collect()}
    want = {(r.window.start, r.worker): r.events for r in health.event_rates(events).collect()}
    assert got == want


def test_bounded_deduplication(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "event_id string, s bigint").select(
        "event_id", F.timestamp_seconds("s").alias("occurred_at")
    )
    path = str(tmp_path / "in")
    rows.write.parquet(path)
    stream = ingest.deduplicated_within(spark.readStream.schema(rows.schema).parquet(path))
    query = stream.writeStream.format("memory").queryName("deduped").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.event_id for r in spark.table("deduped").collect()) == ["a", "b"]


def test_lag_from_progress(spark):
    progress = {"sources": [{"endOffset": {"ratings": {"0": 5, "1": 9}}, "latestOffset": {"ratings": {"0": 8, "1": 7}}}]}
    rows = health.progress_offsets(progress)
    frame = spark.createDataFrame(rows, "topic string, partition int, high bigint, position bigint")
    assert health.consumer_lag(frame).first().lag == 3


@pytest.mark.parametrize("accuracy", [10_000])
def test_percentiles_of_a_known_window(spark, accuracy):
    rows = spark.range(1, 101).select(
        F.timestamp_seconds(F.lit(600)).alias("handled_at"), F.lit("w").alias("worker"), F.col("id").cast("double").alias("latency_ms")
    )
    found = health.latency_percentiles(rows, accuracy).first()
    assert (found.p50, found.p95, found.p99, found.events) == (50.0, 95.0, 99.0, 100)
