"""Near-dedup against brute force over all pairs."""

import random
import time

import numpy as np
import pandas as pd
import pytest

from tastemill.llm.components import component_roots
from tastemill.llm.frames import table
from tastemill.llm import near_dedup
from tastemill.llm.near_dedup import NearDedup, Sketcher, near_duplicates, shingle_sets, without_near_duplicates
from tastemill.llm.queries import op4_near_dedup

COLUMNS = "doc_id long, text string"


def plain_sets(texts, words):
    out = []
    for text in texts:
        w = (text or "").encode().lower().split()
        if len(w) < words:
            out.append({tuple(w)} if w else set())
        else:
            out.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)})
    return out


def brute(rows, words, per_cent):
    sets = plain_sets([t for _, t in rows], words)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= per_cent * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return {doc_id: (len(sets[i]), least[root(i)]) for i, (doc_id, _) in enumerate(rows)}


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def variants(seed=5):
    """Texts of one base with 0 to 12 changed words each: many pairs lie around the limit."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(rng.randrange(13)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(words)))
    return rows


def test_whole_query_equals_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    out = op4_near_dedup(spark, sf)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert found(out) == brute(rows, 3, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out.collect())


@pytest.mark.parametrize("block", [1_000_000, 900])
def test_links_that_no_star_shows_are_found(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", block)
    rows = variants()
    assert found(near_duplicates(spark.createDataFrame(rows, COLUMNS), NearDedup(3, 85))) == brute(rows, 3, 85)


def test_nulls_empties_ties_and_repeated_rows(make_docs):
    docs = make_docs((5, "Same words here now"), (3, "same  WORDS here\nnow"), (3, "same words here now"), (7, None), (8, ""), (9, " \n"), (1, "two words"), (2, "Two words"), (None, "same words here now"), (None, None))
    rows = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs, NearDedup(3, 85)).collect())
    assert rows == sorted([
        ("5", 2, 3, False), ("3", 2, 3, True), ("3", 2, 3, True), ("7", 0, 7, True), ("8", 0, 8, True), ("9", 0, 9, True),
        ("1", 1, 1, True), ("2", 1, 1, False), ("None", 2, 3, False), ("None", 0, None, True),
    ])
    kept = without_near_duplicates(docs, NearDedup(3, 85))
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "7", "8", "9", "None"]
    assert near_duplicates(docs.limit(0)).count() == 0
    assert without_near_duplicates(docs.limit(0)).count() == 0


def test_only_null_ids_leave_one_row(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "A b c d e f"), (None, "a b c d e f")], COLUMNS)
    assert without_near_duplicates(docs).count() == 1


def test_very_long_text_is_read_whole(spark):
    words = [f"w{i}" for i in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1])), (3, " ".join(words[: len(words) // 2]))]
    assert found(near_duplicates(spark.createDataFrame(rows, COLUMNS), NearDedup(3, 85))) == {1: (299_998, 1), 2: (299_997, 1), 3: (149_998, 3)}


def test_signature_fills_all_bins_from_own_hashes():
    sketcher = Sketcher(NearDedup())
    for shingles in shingle_sets(["one", "a b c d e f g h", " ".join(map(str, range(500)))], 5):
        assert np.isin(sketcher.signature(shingles), shingles).all()


def test_signature_estimates_similarity():
    sketcher, rng = Sketcher(NearDedup()), np.random.default_rng(1)
    agree = []
    for _ in range(60):
        both, a, b = (np.unique(rng.integers(0, 2**64, n, np.uint64)) for n in (340, 30, 30))
        agree.append((sketcher.signature(np.union1d(both, a)) == sketcher.signature(np.union1d(both, b))).mean())
    assert abs(np.mean(agree) - 0.85) < 0.02


def test_components_of_paths_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    roots = {r["node"]: r["root"] for r in component_roots(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert roots == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 160)}}
    assert component_roots(spark.createDataFrame([], "a long, b long")).count() == 0


def bucket(sets, components, blocks=None):
    blocks = np.zeros(len(sets), int) if blocks is None else blocks
    return pd.DataFrame({
        "class": np.arange(len(sets)) + 7, "component": components, "n": [len(s) for s in sets], "block": blocks,
        "low": blocks.min(), "high": blocks.max(), "shingles": [np.sort(s).tobytes() for s in sets],
    })


@pytest.mark.parametrize("seed", range(6))
def test_search_of_a_bucket_joins_what_all_pairs_join(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 60, 40).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(1, 40), False), rng.integers(0, 1 << 60, rng.integers(0, 4)).astype(np.uint64)])) for _ in range(120)]
    sets += [np.unique(np.concatenate([s[1:], s[:1] + np.uint64(1)])) for s in sets[:60] if len(s) > 1]
    components = rng.integers(0, 50, len(sets)) if seed % 2 else np.arange(len(sets))
    blocks = rng.integers(0, 2, len(sets)) if seed > 3 else np.zeros(len(sets), int)
    links = list(near_dedup._block_links(80)(bucket(sets, components, blocks)).itertuples(index=False))
    parents = {int(c): int(c) for c in components}

    def root(x):
        while parents[x] != x:
            x = parents[x]
        return x

    def joined(pairs):
        for c in parents:
            parents[c] = c
        for i, j in pairs:
            parents[root(int(components[i]))] = root(int(components[j]))
        return [root(int(c)) for c in components]

    similar = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
    across = seed > 3
    want = joined([(i, j) for i in range(len(sets)) for j in range(i) if (not across or blocks[i] != blocks[j]) and similar(sets[i], sets[j])])
    got = joined([(a - 7, b - 7) for a, b in links])
    assert len({*zip(want, got, strict=True)}) == len({*want}) == len({*got})
    assert all(similar(sets[a - 7], sets[b - 7]) for a, b in links)


@pytest.mark.parametrize("one_component", [True, False])
def test_a_bucket_of_many_short_texts_takes_seconds(one_component):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 9).astype(np.uint64)
    sets = [np.concatenate([base[: 9 if one_component else 6], rng.integers(0, 1 << 60, 3).astype(np.uint64)]) for _ in range(80_000)]
    components = np.zeros(len(sets), int) if one_component else np.arange(len(sets))
    components[5] = 1 if one_component else 5
    group, began = bucket(sets, components), time.monotonic()
    assert near_dedup._block_links(80)(group).empty and time.monotonic() - began < 20
