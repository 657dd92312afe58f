"""The pipeline stage by stage against plain checks of each decision, and as a whole."""

import collections
import hashlib

import pytest

import corpus_pipeline
from tastemill.llm.frames import table
from tastemill.session import staged
from tests.llm.test_near_dedup import brute
from tests.llm.test_prefix_bpe import REFERENCE


@pytest.fixture(scope="module")
def outputs(spark, sf):
    docs = table(spark, sf, "documents")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(staged(stage(spark, frames[-1], sf)))
    return frames


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_keep_columns_and_only_remove(outputs):
    docs = by_id(outputs[0])
    for before, after in zip(outputs[:3], outputs[1:4], strict=True):
        assert after.columns == outputs[0].columns and after.count() <= before.count()
        own = by_id(before)
        assert all(own[i] == r for i, r in by_id(after).items())
    assert len(by_id(outputs[3])) == outputs[3].count() < outputs[0].count() and set(by_id(outputs[3])) <= set(docs)


def test_clean_documents_stay(spark, sf, outputs):
    good = [r["doc_id"] for r in table(spark, sf, "labels").where("quality = 1").collect()]
    texts = by_id(outputs[0])
    clean = [i for i in good if len(texts[i]["text"].split()) >= 30]
    assert len(clean) > 30 and sum(i in by_id(outputs[2]) for i in clean) >= 0.93 * len(clean)


def test_one_document_of_each_group_stays(outputs):
    rows = [(r["doc_id"], r["text"]) for r in outputs[2].collect()]
    groups = brute(rows, 5, 80)
    assert set(by_id(outputs[3])) == {component for _, component in groups.values()}


def test_mix_takes_its_words(outputs):
    words = lambda rows: collections.Counter({r["doc_id"]: 0 for r in rows}) + collections.Counter(
        x for r in rows for x in [r["doc_id"]] * len(r["text"].split())
    )
    sizes, taken = words(outputs[3].collect()), words(outputs[4].collect())
    assert all(taken[i] <= 2 * sizes[i] for i in taken)
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 25
    assert all(r["n_chars"] == len(r["text"]) for r in outputs[4].collect())


def test_encoding_of_the_mix(outputs):
    plain = collections.Counter()
    for r in outputs[4].collect():
        ids = REFERENCE.encode_ordinary(r["text"])
        plain[r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()] += 1
    assert plain == collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in outputs[5].collect())


def test_run_equals_the_stages(spark, sf, outputs):
    key = lambda df: sorted((r["doc_id"], r["ids_sha256"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf)) == key(outputs[5])


def test_stages_take_nulls_repeats_empties_and_clashing_names(spark, sf, make_docs):
    text = " ".join(f"word{i % 37}{'abc'[i % 3]} and{i}" for i in range(40)) + "."
    docs = make_docs((1, text), (1, text), (2, None), (None, text), (None, None), (3, ""), (4, text, None, None), (5, "x" * 300_000))
    for name, stage in corpus_pipeline.STAGES:
        for frame in (docs, docs.limit(0)):
            out = stage(spark, frame, sf)
            rows = out.collect()
            assert not rows or frame is docs
            if name != "byte-level BPE":
                assert out.columns == docs.columns
        if name == "near duplicates":
            assert sorted(str(r["doc_id"]) for r in stage(spark, docs, sf).collect()) == ["1", "2", "3", "5", "None"]
