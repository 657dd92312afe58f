"""The encoder against the tiktoken library, and exact round trips."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tastemill.llm.frames import table
from tastemill.llm.prefix_bpe import Vocabulary, coder, decode_documents, encode_documents
from tastemill.llm.queries import op3_prefix_bpe
from tastemill.llm.token_counts import RULES, Layout, attributed, section_tokens, sections_of, token_spans

VOCABULARY = Vocabulary.public()
BPE = coder(VOCABULARY)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=BPE.ranks, special_tokens={})
TEXT = st.text(st.sampled_from("aabbethinrsd  \n\t'sréñ中12#%€　 TH.,<|>"), max_size=60) | st.text(max_size=30)


def surrogate_free(text):
    return text.encode("utf-8", "replace").decode()


@settings(max_examples=400, deadline=None)
@given(TEXT, TEXT, st.data())
def test_text_appends_and_edits_encode_as_the_library_does(text, more, data):
    text, more = surrogate_free(text), surrogate_free(more)
    assert BPE.encode(text) == REFERENCE.encode_ordinary(text)
    assert BPE.decode(BPE.encode(text)).decode() == text
    held = BPE.table(text)
    assert BPE.ids(held) == REFERENCE.encode_ordinary(text)
    assert BPE.ids(BPE.append(held, more)) == REFERENCE.encode_ordinary(text + more)
    start = data.draw(st.integers(0, len(text)))
    end = data.draw(st.integers(start, len(text)))
    assert BPE.ids(BPE.edit(held, start, end, more)) == REFERENCE.encode_ordinary(text[:start] + more + text[end:])


def test_an_edit_reuses_what_lies_around_it():
    text = " ".join(f"word{i}" for i in range(2000))
    edited = BPE.edit(BPE.table(text), 9000, 9004, "xyz")
    assert edited.reused_bytes > len(edited.text) - 60
    assert BPE.append(BPE.table(text), " more").reused_bytes >= len(text) - 12


def test_every_prefix_table_entry_is_that_prefix_last_token():
    data = "unbelievablyinternationalisation".encode()
    piece = BPE.table(data.decode()).pieces[0]
    assert [REFERENCE.encode_ordinary(data[: k + 1].decode())[-1] for k in range(len(data))] == piece.last


def test_long_piece_without_a_border():
    text = "ab" * 50_000 + "é" * 1000
    assert BPE.encode(text) == REFERENCE.encode_ordinary(text)


def test_edit_outside_raises():
    with pytest.raises(ValueError):
        BPE.edit(BPE.table("abc"), 2, 9, "x")


def test_whole_query_equals_the_library(spark, sf):
    got = {r["doc_id"]: r for r in op3_prefix_bpe(spark, sf).collect()}
    docs = table(spark, sf, "documents").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = REFERENCE.encode_ordinary(r["text"] or "")
        row = got[r["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_nulls_and_clashing_names(spark, make_docs):
    docs = make_docs((1, None), (2, ""), (2, "hello world"), (None, "hello world")).withColumnRenamed("score", "Token_Ids")
    out = encode_documents(docs, VOCABULARY)
    assert out.columns == [*docs.columns, "token_ids_", "decoded"]
    rows = sorted(out.collect(), key=str)
    assert sorted(len(r["token_ids_"]) for r in rows) == [0, 0, 2, 2]
    back = decode_documents(out.drop("decoded"), VOCABULARY, "token_ids_")
    assert sorted(bytes(r["decoded"]) for r in back.collect()) == [b"", b"", b"hello world", b"hello world"]
    assert encode_documents(docs.limit(0), VOCABULARY).count() == 0


def test_an_unknown_id_raises():
    with pytest.raises(ValueError):
        BPE.decode([50_256])


def owner_by_counting(text, spans, ids, rule):
    raw_owner = [i for i, c in enumerate(text) for _ in c.encode()]
    section = [next(k for k, s in enumerate(spans) if s[2] <= i < s[3]) for i in range(len(text))]
    out, at = [], 0
    for i in ids:
        size = len(BPE.bytes_of[i])
        inside = [section[c] for c in sorted(set(raw_owner[at : at + size]))]
        out.append(inside[0] if rule == "first" else min(set(inside), key=lambda k: (-inside.count(k), k)))
        at += size
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, min_size=3, max_size=3), st.sampled_from(RULES))
def test_attribution_equals_counting_characters(values, rule):
    values = [surrogate_free(v) for v in values]
    text, spans = sections_of(Layout(rule=rule), values)
    assert text == "\n".join(values)
    ids = BPE.encode_batch([text])[0]
    starts, ends = token_spans(BPE, text, ids)
    import numpy as np

    at = attributed(rule, starts, ends, np.array([s[3] for s in spans]))
    assert list(at) == owner_by_counting(text, spans, ids, rule)


def test_sections_add_up_to_whole_documents(spark, sf):
    from tastemill.llm.queries import op10_token_counts

    totals = {r["doc_id"]: r["n"] for r in op10_token_counts(spark, sf).groupBy("doc_id").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    for r in table(spark, sf, "documents").collect():
        assert totals[r["doc_id"]] == len(REFERENCE.encode_ordinary("\n".join(x or "" for x in (r["source"], r["lang"], r["text"]))))


def test_attribution_of_nulls_and_unknown_rules(spark, make_docs):
    docs = make_docs((1, None, None, None), (2, "a\n\n\nb", "en", "x"), (2, "a\n\n\nb", "en", "x"))
    rows = section_tokens(docs, VOCABULARY).orderBy("doc_id", "start", "section").collect()
    assert [(r["field"], r["start"], r["stop"]) for r in rows if r["doc_id"] == 1] == [("source", 0, 1), ("lang", 1, 2), ("text", 2, 2)]
    second = [r for r in rows if r["doc_id"] == 2]
    assert sum(r["n_tokens"] for r in second) == 2 * len(REFERENCE.encode_ordinary("x\nen\na\n\n\nb"))
    assert sum(r["n_crossing"] for r in second) == 2
    assert section_tokens(docs.limit(0), VOCABULARY).count() == 0
    with pytest.raises(ValueError):
        section_tokens(docs, VOCABULARY, Layout(rule="last"))
