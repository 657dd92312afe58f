"""Search, licences, mixing and page layout: SQL, brute force and edge cases."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import compare
from tastemill.llm import licenses, vafile
from tastemill.llm.html_layout import extract_text, rendered
from tastemill.llm.mixing import MixPlan, mixed_documents, mixed_texts
from tastemill.llm.queries import QUERIES, SQL, op9_html_layout
from tastemill.llm.vafile import exact_top_k

VECTORS = "vec_id long, embedding array<float>, score string"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    good, text = compare(spark, sf, name, QUERIES[name], SQL[name])
    assert good, text


def plain_top_k(rows, asked, k):
    import math

    whole = lambda v: [math.floor(1024 * x) for x in v]
    sound = [(i, whole(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in asked:
        if own := [v for i, v in sound if i == q]:
            scores = sorted((-sum(a * b for a, b in zip(max(own), v, strict=False)), i) for i, v in sound if i != q)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)}
    return out


@pytest.mark.parametrize("blocks", [(8192, 4096), (7, 2)])
def test_search_with_ties_bad_vectors_and_many_copies(spark, monkeypatch, blocks):
    import random

    monkeypatch.setattr(vafile, "BLOCK_ROWS", blocks[0])
    monkeypatch.setattr(vafile, "BLOCK_QUERIES", blocks[1])
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(4)]) for i in range(60)]
    rows += [(100 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(30)] + [(60, None), (61, []), (62, [1.0, None]), (63, [float("nan")] * 4), (64, [float("inf")] * 4)]
    rows += [(None, [9.0] * 4), (200, [2.0, -3.0]), (3, [0.125] * 4), (5, rows[5][1])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], VECTORS)
    asked = [0, 3, 5, 20, 60, 62, 110, 200]
    got = exact_top_k(frame, frame.where(F.col("vec_id").isin(asked)), k=4)
    assert {tuple(r) for r in got.collect()} == plain_top_k(rows, asked, 4)


def test_far_vectors_do_not_widen_the_cells(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(3000, 16))
    seen = []
    exact = vafile._exact
    monkeypatch.setattr(vafile, "_exact", lambda found, *a: seen.append(found.count()) or exact(found, *a))

    def candidates(rows):
        seen.clear()
        frame = spark.createDataFrame([(i, v, "") for i, v in enumerate(rows.tolist())], VECTORS)
        got = {tuple(r) for r in exact_top_k(frame, frame.where("vec_id < 30"), k=10).collect()}
        whole = np.floor(1024 * rows.astype(np.float32).astype(float))
        scores = whole[:30] @ whole.T
        scores[np.arange(30), np.arange(30)] = -np.inf
        order = np.lexsort((np.broadcast_to(np.arange(len(rows)), scores.shape), -scores), axis=1)[:, :10]
        assert got == {(q, r + 1, int(v), int(scores[q, v])) for q in range(30) for r, v in enumerate(order[q])}
        return sum(seen)

    plain = candidates(vectors)
    assert candidates(np.vstack([vectors, np.full((1, 16), 1e4), np.full((1, 16), -1e4)])) < 2 * plain < 3000


def test_search_with_few_or_no_rows_and_large_components(spark):
    frame = spark.createDataFrame([(1, [30000.0, -20000.0], ""), (2, [40000.0, 1.0], ""), (3, [-3e5, 1e5], "")], VECTORS)
    got = {tuple(r) for r in exact_top_k(frame, frame, k=10).collect()}
    assert got == plain_top_k([(r["vec_id"], r["embedding"]) for r in frame.collect()], [1, 2, 3], 10)
    assert exact_top_k(frame.limit(0), frame, 3).count() == exact_top_k(frame, frame.limit(0), 3).count() == 0


def test_licence_rules_match_sequences_in_order(spark, make_docs):
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."
    notice = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    docs = make_docs(
        (1, f"Code.\n{grant}\nSomething else.  {notice}"), (2, f"{notice} {grant}"), (3, " * Licensed under the\tApache License, Version 2.0.\nReleased under the MIT license"),
        (4, None), (5, ""), (5, ""), (6, "I like the MIT License."), (None, "released under the mit license"), (7, "Text. " * 100_000 + "Licensed under CC BY-NC 4.0."),
    )
    out = licenses.licence_scan(docs)
    assert out.columns == [*docs.columns, "licences", "licence_sentences", "n_sentences"]
    rows = collections.defaultdict(list)
    for r in out.collect():
        rows[r["doc_id"]].append(r)
    assert rows[1][0]["licences"] == ["MIT"] and rows[1][0]["licence_sentences"] == ["mit-grant", "mit-condition"]
    assert rows[2][0]["licences"] == ["MIT"] and rows[2][0]["licence_sentences"] == ["mit-condition", "mit-grant"]
    assert rows[3][0]["licences"] == ["Apache-2.0", "MIT"] and rows[None][0]["licences"] == ["MIT"]
    assert rows[4][0]["licences"] == rows[6][0]["licences"] == [] and rows[4][0]["n_sentences"] == 0 and len(rows[5]) == 2
    assert rows[7][0]["licences"] == ["CC-BY-NC-4.0"] and rows[7][0]["n_sentences"] == 100_001
    assert licenses.licence_scan(docs.limit(0)).count() == 0


def test_mix_meets_targets_and_limits(spark, make_docs):
    docs = make_docs(
        *[(i, "w " * (i % 40 + 1), "en", "a") for i in range(300)], *[(1000 + i, "v " * 30, "en", "b") for i in range(40)],
        *[(2000 + i, "u u", None, None) for i in range(5)], (9, None, "en", "b"), (9, "", "en", "c"), (7, "same text", "en", "a"), (7, "same text", "en", "a"), (None, "x y z", "en", "a"),
    )
    documents, pieces = mixed_documents(docs, MixPlan(block_words=64))
    rows = documents.collect()
    assert len(rows) == docs.count()
    by_source = collections.defaultdict(list)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_source[r["source"]].append(r)
    for own in by_source.values():
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert sum(r["taken"] for r in own) == int(own[0]["target"])
    total = sum(r["size"] for r in rows)
    assert abs(sum(own[0]["target"] for own in by_source.values()) - 1.5 * total) < 1e-6
    assert by_source[None][0]["target"] == 20.0
    # Each stretch of the schedule holds the sources close to their shares.
    slots = [r["sid"] for r in pieces.select("slot", "sid").distinct().orderBy("slot").collect()]
    share = by_source["a"][0]["target"] / (1.5 * total)
    for start, stop in ((0, 50), (50, 120), (0, 150)):
        assert slots[start:stop].count(0) == pytest.approx((stop - start) * share, abs=4)
    again, _ = mixed_documents(docs.repartition(7), MixPlan(block_words=64))
    assert sorted(map(str, again.drop("sid").collect())) == sorted(map(str, documents.drop("sid").collect()))
    texts = mixed_texts(docs, MixPlan(block_words=64))
    assert texts.columns == docs.columns
    words = sum(len(r["text"].split()) for r in texts.collect())
    assert words == sum(r["taken"] for r in rows)


def test_mix_of_nothing(make_docs):
    docs = make_docs((1, None), (2, ""))
    rows = mixed_documents(docs)[0].collect()
    assert [(r["size"], r["target"], r["taken"]) for r in rows] == [(0, 0.0, 0)] * 2
    assert mixed_texts(docs).count() == 0
    assert mixed_documents(docs.limit(0))[0].count() == 0 and mixed_texts(docs.limit(0)).count() == 0


PAGES = {
    "<p>One<p>Two <b>bold</b>text": "One\n\nTwo boldtext",
    "a<ul><li>x<li>y<ol start=3><li>n<li>m</ol></ul>b": "a\n\n- x\n- y\n  3. n\n  4. m\n\nb",
    "<table><tr><th>Name<th>Qty<tr><td>Apple pie<td>3</table>": "Name       Qty\nApple pie  3",
    "<table><tr><td>a<td>b<tr><td colspan=2>wide cell<tr><td>c<td>d</table>": "a  b\nwide cell\nc  d",
    "<table>stray<tr><td>a<p>b</table>c": "stray\na\n\nb\n\nc",
    "<div hidden>no</div><div style='color:red; display: NONE'>no</div><script>x<p></script><title>t</title>yes<!-- no -->": "yes",
    "<head><title>t</title><p>body starts": "body starts",
    "<pre> x\n   y</pre>z": " x\n   y\n\nz",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "x &amp; &copy; &lt;b&gt;": "x & © <b>",
    "<dl><dt>T<dd>D<dt>U</dl>": "T\n  D\nU",
    "<p>a</div></span>b</p>c": "ab\n\nc",
    "one\n  two\t<i> three </i> four": "one two three four",
    "<select><option>a<option>b</select>": "a\nb",
    "<textarea>q\n r</textarea>": "q\n r",
    "": "",
    "<html><body></body></html>": "",
    "plain < text": "plain < text",
}


@pytest.mark.parametrize("html", PAGES)
def test_layout(html):
    assert rendered(html) == PAGES[html]


def test_deep_and_broken_pages_end():
    assert rendered("<div>" * 30_000 + "deep") == "deep"
    assert rendered("<table><tr><td>" * 300 + "x").strip() == "x"
    assert rendered("</p></li></td></table><td>x</td>") == "x"


def words_outside_tags(html):
    import re

    import html as entities

    html = re.sub(r"(?s)<(script|style|title)\b.*?</\1>|<!--.*?-->|<!DOCTYPE[^>]*>", " ", html)
    html = re.sub(r"</?(?:b|i|a|em|span|strong)\b[^>]*>", "", html)
    return entities.unescape(re.sub(r"<[^>]*>", " ", html)).split()


def test_whole_query_keeps_all_visible_words(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op9_html_layout(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        words = [w for w in r["text"].split() if w != "-"]
        assert words == [w for w in words_outside_tags(pages[r["page_id"]]) if w != "-"]


def test_pages_with_nulls_and_clashing_names(spark):
    pages = spark.createDataFrame([(1, None, "t"), (1, "<p>a", "t"), (None, "", None)], "page_id long, html string, TEXT string")
    out = extract_text(pages)
    assert out.columns == ["page_id", "html", "TEXT", "text_"]
    assert sorted(r["text_"] for r in out.collect()) == ["", "", "a"]
    assert extract_text(pages.limit(0)).count() == 0
