"""Repeated passages against a plain search of all windows, word for word."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemill.llm import repeats, words
from tastemill.llm.repeats import RepeatPlan, repeated_words, stretches, without_repeats


def plain(rows, size):
    """(n_words, n_removed, digest) of every row, over all pairs of windows."""
    split = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    least = {}
    for i, own in split:
        for j in range(len(own) - size + 1) if i is not None else ():
            key = tuple(own[j : j + size])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, own in split:
        gone = set()
        for j in range(len(own) - size + 1) if i is not None else ():
            if least[tuple(own[j : j + size])] < i:
                gone.update(range(j, j + size))
        kept = b" ".join(w for n, w in enumerate(own) if n not in gone)
        out.append((i, len(own), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def some_rows(seed=5):
    rng = random.Random(seed)
    prose = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(n))
    passages = [prose(n) for n in (49, 50, 51, 60, 90, 130, 400)]
    rows = []
    for i in range(60):
        parts = [prose(rng.randrange(0, 70))] + [x for p in rng.sample(passages, rng.randrange(0, 4)) for x in (p, prose(rng.randrange(0, 30)))]
        rows.append((rng.randrange(1000), " ".join(parts)))
    for i, text in rows[:20]:  # near copies: single words changed
        own = text.split(" ")
        for _ in range(rng.randrange(0, 3)):
            own[rng.randrange(len(own))] = "new"
        rows.append((rng.randrange(1000), "\n\t ".join(own)))
    rows += [(2000, "same words again " * 200), (2001, "again same words " * 90), (2000, rows[0][1]), (rows[1][0], rows[1][1])]
    rows += [(None, rows[2][1]), (None, "x " * 80), (3000, None), (3001, ""), (3001, ""), (3002, " \n\x0b\x0c\r\t"), (3003, "é   " * 60), (3004, "é   " * 60)]
    return rows


@pytest.mark.parametrize("window, most, starts", [(50, 500, 500_000), (50, 3, 70), (20, 2, 500_000)])
def test_all_windows_against_plain_search(spark, make_docs, monkeypatch, window, most, starts):
    monkeypatch.setattr(repeats, "MOST_STRETCHES", most)
    monkeypatch.setattr(repeats, "STARTS_AT_ONCE", starts)
    rows = some_rows()
    got = repeated_words(make_docs(*rows), RepeatPlan(window, 16 if window == 50 else 4))
    assert got.columns == ["doc_id", "row_key", "n_words", "n_removed", "kept_sha256"]
    assert sorted((tuple(r) for r in got.drop("row_key").collect()), key=str) == plain(rows, window)


def test_shards_of_one_anchor_each(spark, make_docs, monkeypatch):
    rows = some_rows(7)
    monkeypatch.setattr(repeats, "SHARD_WORDS", 1)
    got = repeated_words(make_docs(*rows))
    assert sorted((tuple(r) for r in got.drop("row_key").collect()), key=str) == plain(rows, 50)


def test_a_passage_in_very_many_documents_and_a_long_text(spark, make_docs):
    rng = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(75))
    rows = [(i, f"{rng.random()} {passage} {rng.random()}") for i in range(1500)]
    rows += [(5000, " ".join(str(rng.random()) for _ in range(300_000)) + " " + passage)]
    got = {r["doc_id"]: r for r in repeated_words(make_docs(*rows)).collect()}
    assert got[0]["n_removed"] == 0 and all(got[i]["n_removed"] == 75 and got[i]["n_words"] == 77 for i in range(1, 1500))
    assert got[5000]["n_removed"] == 75 and got[5000]["n_words"] == 300_075


def test_texts_are_cut_and_others_stay(spark, make_docs):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = make_docs((1, f"head  {passage}"), (2, f"other\n{passage} tail"), (3, "alone  here"), (4, None))
    got = {r["doc_id"]: r for r in without_repeats(docs).collect()}
    assert [got[i]["text"] for i in (1, 2, 3, 4)] == [f"head  {passage}", "other tail", "alone  here", None]
    assert without_repeats(docs).columns == docs.columns and got[2]["row_key"] == "old key"
    assert repeated_words(docs.limit(0)).count() == without_repeats(docs.limit(0)).count() == 0
    changed = docs.withColumn("doc_id", F.col("doc_id").cast("int"))
    assert repeated_words(changed).schema["doc_id"].dataType.simpleString() == "int"


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    values[200:300] = values[50:150]
    bounds = np.array([0, 180, 400])
    found = {}
    for text, start, count, _, anchor, digest in zip(*(np.concatenate(c) for c in zip(*stretches(values, bounds, RepeatPlan()), strict=True)), strict=True):
        for j in range(count):
            found[bounds[text] + start + j] = (anchor, digest)
    assert set(found) == {*range(0, 131), *range(180, 351)}
    assert all(found[50 + j][0] == found[200 + j][0] for j in range(51))


def test_long_periodic_words_differ():
    pattern = [0]
    while len(pattern) < 2048:
        pattern += [1 - p for p in pattern]
    one = "".join("ab"[p] for p in pattern)
    other = "".join("ba"[p] for p in pattern)
    values, _ = words.word_hashes([f"{one} {other} {one}"])
    assert values[0] != values[1] and values[0] == values[2]


def test_words_keep_the_order_of_texts_around_a_long_one():
    texts = ["a b", "c " * 700_000, None, "d", "e " * 600_000, "f g"]
    values, bounds = words.word_hashes(texts)
    alone = [words.word_hashes([t])[0] for t in texts]
    assert all((values[bounds[i] : bounds[i + 1]] == own).all() for i, own in enumerate(alone)) and bounds[-1] == len(values)
