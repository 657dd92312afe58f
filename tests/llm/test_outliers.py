"""Robust outliers: base counts against plain Python, estimates against a plain MCD."""

import collections
import random
import re

import numpy as np
import pytest

from tastemill.llm import outliers
from tastemill.llm.frames import table
from tastemill.llm.outliers import BASE, P, OutlierRule, consistency, measured, robust_outliers
from tastemill.llm.queries import op2_quality_rules

WORD = r"[^\x20\x09-\x0D]+"


def plain_base(text):
    text = text or ""
    words = re.findall(WORD, text)
    keys = list(zip(*(words[k:] for k in range(5)), strict=False))
    seen, repeated = collections.Counter(keys), set()
    for i, key in enumerate(keys):
        if seen[key] > 1:
            repeated.update(range(i, i + 5))
    lines = text.split("\n")
    again = sum(1 for i, line in enumerate(lines) if re.search(WORD, line) and line in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(repeated)


def plain_verdicts(rows, rule):
    """Kept per row by concentration steps in numpy; rows: (part, base_failed, x)."""
    kept = {}
    for part in {r[0] for r in rows}:
        own = np.array([r[2] for r in rows if r[0] == part and not r[1]])
        if len(own) < rule.min_group:
            kept.update({i: not r[1] for i, r in enumerate(rows) if r[0] == part})
            continue
        least = np.diag(np.square(rule.least_spread))
        middle = np.array([np.sort(own[:, k])[-(-len(own) // 2) - 1] for k in range(P)])
        spread = np.median(abs(own - middle), axis=0)
        z = (own - middle) / np.array(rule.least_spread)
        z = z / np.maximum(np.sqrt((z**2).sum(1)), 1e-300)[:, None]
        sign = z.T @ z / len(own)
        size = np.sqrt(np.diag(sign) + 1e-6)
        mad = 1.4826 * spread
        best = None
        for cov in (np.diag(mad**2) + least, sign / np.outer(size, size) * np.outer(mad, mad) + least):
            mean = middle
            for _ in range(rule.steps):
                gap = own - mean
                d2 = np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap)
                inner = own[d2 <= np.sort(d2)[-(-int(rule.share * len(own) * 1000) // 1000) - 1]]
                mean, cov = inner.mean(0), np.cov(inner.T, bias=True) * consistency(rule.share) + least
            if best is None or np.linalg.slogdet(cov)[1] < best[0]:
                best = (np.linalg.slogdet(cov)[1], mean, cov)
        for i, r in enumerate(rows):
            if r[0] == part:
                gap = np.array(r[2]) - best[1]
                kept[i] = not r[1] and gap @ np.linalg.inv(best[2]) @ gap <= rule.cut
    return kept


def test_whole_query_equals_plain_python(spark, sf):
    rule = OutlierRule()
    got = {r["doc_id"]: r for r in op2_quality_rules(spark, sf).collect()}
    docs = table(spark, sf, "documents")
    rows = measured(docs, rule).collect()
    assert len(got) == len(rows) == docs.count()
    for r in docs.collect():
        own = got[r["doc_id"]]
        base = plain_base(r["text"])
        assert tuple(own[c] for c in BASE) == base
        assert own["base_failed"] == (base[0] < 10 or 100 * base[4] > 20 * base[0])
    counts = collections.Counter((r["lang"], r["source"]) for r in rows if not r["base_failed"])
    pools = collections.Counter()
    for (lang, source), n in counts.items():
        if n < rule.min_group:
            pools[lang] += n

    def part(r):
        key = (r["lang"], r["source"])
        if counts[key] >= rule.min_group:
            return key
        return r["lang"] if pools[r["lang"]] >= rule.min_group else None

    plain = plain_verdicts([(part(r), r["base_failed"], [r[f"x{k}"] for k in range(P)]) for r in rows], rule)
    differ = [r["doc_id"] for i, r in enumerate(rows) if got[r["doc_id"]]["kept"] != plain[i]]
    assert not differ
    assert 0 < sum(r["kept"] for r in got.values()) < len(got)


def prose(rng, n=60):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n)) + "."


def test_outliers_go_and_clean_texts_stay_in_every_group(make_docs):
    rng = random.Random(4)
    rows = [(i, prose(rng), lang, source) for i, (lang, source) in enumerate([("en", "a"), ("en", None), (None, "b")] * 80)]
    junk = [(1000, " ".join(f"{w}%%% ###" for w in prose(rng).split()), "en", "a"), (1001, prose(rng).upper(), None, "b"), (1002, "x y", "en", "a"), (1003, None, None, None)]
    out = {r["doc_id"]: r for r in robust_outliers(make_docs(*rows, *junk)).collect()}
    assert [i for i in range(240) if not out[i]["kept"]] == []
    assert not any(out[i]["kept"] for i in (1000, 1001, 1002, 1003))
    assert out[1002]["base_failed"] and out[1003]["n_words"] == 0 and not out[1000]["base_failed"]


def test_small_groups_are_pooled_and_the_last_pool_rejects_nothing(make_docs):
    rng = random.Random(5)
    rows = [(i, prose(rng), "en", f"s{i % 40}") for i in range(200)] + [(900, prose(rng).upper(), "en", "s1"), (901, prose(rng).upper(), "xx", "y")]
    out = {r["doc_id"]: r["kept"] for r in robust_outliers(make_docs(*rows)).collect()}
    assert not out[900] and out[901] and sum(out.values()) == 201


def test_equal_texts_ties_repeats_and_empty_tables(make_docs):
    text = "one two three four five six seven eight nine ten eleven"
    out = robust_outliers(make_docs(*[(1, text)] * 100, (None, text)))
    assert out.count() == 101 and all(r["kept"] and r["d2"] < 1 for r in out.collect())
    assert robust_outliers(make_docs((1, text)).limit(0)).count() == 0


def test_very_long_text(make_docs):
    text = " ".join(f"w{i}" for i in range(400_000)) + "\nsame line\nsame line"
    row = robust_outliers(make_docs((1, text))).first()
    assert (row["n_words"], row["n_dup_lines"], row["n_repeat_words"]) == (400_004, 1, 0)


@pytest.mark.parametrize("seed", range(5))
def test_repeat_words_of_random_texts(seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(40))) for _ in range(50)] + [None, ""]
    values, bounds = outliers.word_hashes(texts)
    assert [int(x) for x in outliers.repeat_words(values, bounds)] == [plain_base(t)[4] for t in texts]
