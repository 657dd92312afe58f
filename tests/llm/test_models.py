"""Quality classifier and toxicity lexicon: held-out accuracy, rules of use, edge cases."""

import numpy as np
import pytest

from tastemill.llm.convnet import CHUNK, Classifier, Net, NetPlan, chunks_of, fit_quality, quality_scores, turn_of
from tastemill.llm.frames import held_out, table
from tastemill.llm.queries import op5_quality_classifier, op6_toxicity
from tastemill.llm.toxicity import Lexicon, Matcher, fit_lexicon, folded_words, toxicity_scores

MIDDLE = "/root/testdata/sf0.01"


def crc_fold(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.mark.parametrize(("query", "label", "threshold", "least"), [(op5_quality_classifier, "quality", 0.3, 0.9), (op6_toxicity, "toxic", 0.5, 0.94)])
def test_whole_query_and_held_out_accuracy(spark, query, label, threshold, least):
    rows = {r["doc_id"]: r for r in query(spark, MIDDLE).collect()}
    assert len(rows) == table(spark, MIDDLE, "documents").count()
    assert all(r["held_out"] == crc_fold(i) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= threshold) for i, r in rows.items())
    labels = table(spark, MIDDLE, "labels").collect()
    right = [rows[r["doc_id"]]["predicted"] == r[label] for r in labels if crc_fold(r["doc_id"])]
    assert len(right) > 50 and np.mean(right) >= least


def test_learned_exception_phrases_change_held_out_scores(spark, make_docs):
    """'rotten' alone marks toxic texts, 'rotten apples' is only said in others."""
    kinds = {True: "you rotten person number {} go", False: "we threw rotten apples number {} out"}
    texts = [(i, (kinds[i % 2 == 0] if i % 4 < 3 else "plain words number {} here").format(f"w{i}")) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(600)], "doc_id long, toxic int")
    # Toxic texts say it alone; the phrase is rare enough among the others for 'rotten' to stay an entry.
    rare = [(i, t if i % 2 == 0 or i % 20 == 1 else f"plain words number w{i} here") for i, t in texts]
    lexicon = fit_lexicon(make_docs(*rare), labels)
    assert "=rotten" in lexicon.weights and any("rotten apples" in p for p in lexicon.phrases)
    unlearned = Lexicon(lexicon.weights, lexicon.bias, lexicon.per_found, lexicon.per_share)
    probe = make_docs((1_001, "many rotten apples lay there"), (1_002, "you rotten person there now"))
    scores = [{r["doc_id"]: r["score_"] for r in toxicity_scores(probe, model).collect()} for model in (lexicon, unlearned)]
    assert scores[0][1_001] < 0.5 <= scores[1][1_001] and scores[0][1_002] >= 0.5


def test_neighbours_against_plain_search():
    matcher = Matcher({"=bad": 2.0, "^wors": 3.0}, ("not bad",))
    cases = {"a bad day": {"a bad", "bad day"}, "bad": set(), "not bad day": set(), "worse bad": {"worse bad"}, "badly done": set(), "x worst": {"x worst"}, "": set()}
    assert {text: matcher.neighbours(text.split()) for text in cases} == cases


@pytest.mark.parametrize("learn", ["quality", "toxic"])
def test_held_out_labels_change_nothing(spark, make_docs, learn):
    docs = make_docs(*[(i, f"clean words number {i} here" if i % 2 else f"vile scum number {i} here") for i in range(120)])
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(120)], "doc_id long, quality int, toxic int")
    turned = labels.selectExpr("doc_id", *[f"CASE WHEN crc32(cast(string(doc_id) as binary)) % 5 = 0 THEN 1 - {c} ELSE {c} END AS {c}" for c in ("quality", "toxic")])
    plan = NetPlan(epochs=2)
    for other in (labels, turned):
        model = fit_quality(docs, other, plan) if learn == "quality" else fit_lexicon(docs, other)
        score = quality_scores if learn == "quality" else toxicity_scores
        name = "score_"
        got = sorted((r["doc_id"], round(r[name], 9)) for r in score(docs, model).collect())
        first = got if other is labels else first  # noqa: F821
        assert got == first
    if learn == "toxic":
        assert all((value >= 0.5) == (i % 2 == 0) for i, value in got)


def test_scores_of_nulls_repeats_and_long_texts(spark, make_docs):
    docs = make_docs((1, None), (1, None), (2, ""), (None, "scum " * 200_000), (4, "a b c"))
    lexicon = Lexicon({"=scum": 5.0}, -4.0, 1.0, 2.0)
    rows = {str(r["doc_id"]): r["score_"] for r in toxicity_scores(docs, lexicon).collect()}
    assert rows["1"] == rows["2"] == rows["4"] < 0.5 < rows["None"]
    net = Classifier(NetPlan(), Net(NetPlan()).w, 0.0)
    out = quality_scores(docs, net)
    assert out.columns == [*docs.columns, "score_"]
    assert all(0 <= r["score_"] <= 1 for r in out.collect()) and out.count() == 5
    assert quality_scores(docs.limit(0), net).count() == 0 and toxicity_scores(docs.limit(0), lexicon).count() == 0


def test_fits_without_labels_of_both_kinds(spark, make_docs):
    docs = make_docs((1, "a"), (2, "b"), (3, None))
    for rows, quality in (([], 0.5), ([(i, 1, 1) for i in (1, 2, 3, 7)], None), ([(None, 1, None), (2, None, 0)], 0.5)):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        model = fit_quality(docs, labels)
        assert model.weights is None and (quality is None or model.scores(["x"])[0] == quality)
        assert fit_lexicon(docs, labels).weights == {}


def test_chunks_cover_the_whole_text():
    for size in (0, 1, CHUNK, CHUNK + 1, 5000, 100_003):
        raw = bytes(1 + i % 250 for i in range(size))
        chunks = chunks_of(raw)
        step = 448
        seen = b"".join(c[: step if k < len(chunks) - 1 else CHUNK].tobytes() for k, c in enumerate(chunks))
        assert seen[:size] == raw and not any(seen[size:])


@pytest.mark.parametrize("count", [1, 23, 24, 25, 47, 300, 336, 337, 5000])
def test_training_sees_every_chunk(count):
    plan = NetPlan()
    turns = [turn_of(count, epoch, plan) for epoch in range(plan.epochs)]
    assert {int(c) for t in turns for c in t} == set(range(count))
    assert all(len(t) <= max(24, -(-count // plan.epochs)) and len(set(t)) == len(t) for t in turns)


def test_features_equal_a_plain_convolution():
    plan = NetPlan(filters=3, features=4, vector=2)
    net, rng = Net(plan), np.random.default_rng(4)
    chunks = rng.integers(0, 256, (3, CHUNK)).astype(np.uint8)
    plain = []
    for chunk in chunks:
        best = [-np.inf] * plan.filters
        for at in range(0, CHUNK - plan.width + 1, plan.stride):
            window = [x for byte in chunk[at : at + plan.width] for x in net.w["vectors"][byte]]
            for f in range(plan.filters):
                best[f] = max(best[f], sum(x * w for x, w in zip(window, net.w["filters"][:, f], strict=True)) + net.w["filter_bias"][f])
        bent = np.tanh(best)
        plain.append([max(0.0, bent @ net.w["dense"][:, k] + net.w["dense_bias"][k]) for k in range(plan.features)])
    np.testing.assert_allclose(net.features(chunks), plain, atol=1e-4)


def test_gradients_equal_differences():
    plan = NetPlan(filters=3, features=4, vector=2)
    net, rng = Net(plan), np.random.default_rng(0)
    net.w = {k: (v + rng.normal(0, 0.1, v.shape)).astype(np.float64) for k, v in net.w.items()}
    chunks, starts, labels = rng.integers(0, 256, (5, CHUNK)).astype(np.uint8), np.array([0, 2]), np.array([1.0, 0.0])

    def loss():
        z = net.logits(net.features(chunks), starts)
        return np.mean(np.log1p(np.exp(z)) - labels * z)

    grads = net.gradients(chunks, starts, labels)
    for name, g in grads.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        before, eps = net.w[name][at], 1e-5
        net.w[name][at] = before + eps
        up = loss()
        net.w[name][at] = before - eps
        down = loss()
        net.w[name][at] = before
        assert abs((up - down) / (2 * eps) - g[at]) < 1e-5 + 1e-2 * abs(g[at])


def test_network_separates_what_its_filters_can_see():
    rng = np.random.default_rng(2)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).tolist()) for _ in range(400)]
    prose = lambda mark: b" ".join(w + mark for w in rng.choice(words, 60))
    texts = [chunks_of(prose(b"!!" if k % 2 else b"")) for k in range(120)]
    net = Net(NetPlan(epochs=6))
    net.train(texts, np.array([0.0 if k % 2 else 1.0 for k in range(120)], np.float32))
    z = [net.logits(net.features(chunks_of(prose(mark))), np.array([0]))[0] for mark in (b"!!", b"") for _ in range(20)]
    assert max(z[:20]) < min(z[20:])


def test_folding():
    assert folded_words("W0RTHLESS ѕсum, M0r0n! p@thetic tr4sh!! $cum stup​id Ｉｄｉｏｔ ídïót") == [
        "worthless", "scum", "moron", "pathetic", "trash", "scum", "stupid", "idiot", "idiot",
    ]
    assert folded_words("12345 %%% 3.14 a.b") == ["ab"] and folded_words(None) == folded_words("") == []


def test_matching_against_plain_search():
    import random

    rng = random.Random(3)
    weights = {"=ab": 2.0, "^ab": 1.0, "^abc": 4.0, "=c": 0.5, "^bca": 3.0}
    matcher = Matcher(weights, ("ab c", "bca x"))
    for _ in range(500):
        words = ["".join(rng.choice("abcx") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(12))]
        exempt = set()
        for phrase in (["ab", "c"], ["bca", "x"]):
            for i in range(len(words) - len(phrase) + 1):
                if words[i : i + len(phrase)] == phrase:
                    exempt |= set(range(i, i + len(phrase)))
        plain = 0.0
        for i, w in enumerate(words):
            fits = [v for k, v in weights.items() if (k[1:] == w if k[0] == "=" else w.startswith(k[1:]))]
            plain += max(fits, default=0.0) if i not in exempt else 0.0
        assert matcher.found(words) == plain


def test_held_out_rule(spark):
    rows = spark.range(300).select("id", held_out("id").alias("h")).collect()
    assert all(r["h"] == crc_fold(r["id"]) for r in rows)
