"""Importance resampling against plain Python, with runs of several words."""

import hashlib
import math
import re
import zlib

import pyarrow as pa
import pytest

from tastemill.llm.resampling import ResamplePlan, batch_features, importance_resampled, sampled


def runs(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, plan):
    bucket = lambda r: zlib.crc32(r.encode()) % plan.buckets
    s, t = [0] * plan.buckets, [0] * plan.buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for r in runs(text, plan.longest)[1]:
                counts[bucket(r)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + plan.buckets) / ((a + 1) * (sum(t) + plan.buckets)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, text in docs:
        words, own = runs(text, plan.longest)
        weight = sum(gain[bucket(r)] for r in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{plan.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words)])
    able = sorted((r for r in rows if r[4] >= plan.least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    places = {id(r): n + 1 for n, r in enumerate(able[: len(able) * plan.per_cent // 100])}
    return sorted(((*r[:4], places.get(id(r))) for r in rows), key=str)


DOCS = [(i, f"Alpha beta {'gamma ' * (i % 7)} d{i % 11} É{i % 3} x-y_{i} " * (1 + i % 9)) for i in range(90)]
DOCS += [(None, "one two three " * 9), (200, None), (201, ""), (202, "-- !"), (203, "Ünï\x00code 9z" * 20), (3, "A" * 200_000 + " b" * 3000), (3, DOCS[3][1])]
TARGET = ["gamma gamma alpha", "É1 beta", None, "", "x y z"]


@pytest.mark.parametrize("plan", [ResamplePlan(), ResamplePlan(longest=3, buckets=97, seed=5, least_words=4, per_cent=40)])
def test_against_plain_python(spark, make_docs, plan):
    target = spark.createDataFrame([(t, "x") for t in TARGET], "text string, score string")
    got = importance_resampled(make_docs(*DOCS), target, plan)
    assert sorted((tuple(r) for r in got.drop("row_key").collect()), key=str) == plain(DOCS, TARGET, plan)
    drawn = sampled(make_docs(*DOCS), target, plan)
    assert drawn.count() == sum(r[4] is not None for r in plain(DOCS, TARGET, plan)) and drawn.columns == make_docs((1, "a")).columns


def test_runs_stay_inside_their_text():
    found = batch_features(pa.array(["a b c", None, "", "b c", "d"]), ResamplePlan(longest=2))
    want = [zlib.crc32(r.encode()) % 10_000 for r in ["a", "b", "c", "b", "c", "d", "a b", "b c", "b c"]]
    assert found.buckets.tolist() == want and found.owners.tolist() == [0, 0, 0, 3, 3, 4, 0, 0, 3] and found.n_words.tolist() == [3, 0, 0, 2, 1]


def test_equal_scores_and_empty_tables(spark, make_docs):
    target = spark.createDataFrame([("a",)], "text string")
    text = "word " * 30
    got = importance_resampled(make_docs(*[(7, text)] * 30), target, ResamplePlan(per_cent=50)).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 16)) and len(got) == 30
    assert importance_resampled(make_docs((1, text)).limit(0), target).count() == 0
    assert importance_resampled(make_docs((1, text)), target.limit(0)).first()["rank"] is None
