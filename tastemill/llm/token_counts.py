"""Token counts by offset-mapped attribution.

A document is its fields joined in a given order; it is encoded once, as a whole, and every token
has the span of characters that its bytes cover. Fields, and the sections of a text field, are
spans of the same document. Tokens are joined to the spans that they overlap. A token that crosses
a border is given to one span by a stated rule, so that the counts of all spans add up to the
document's tokens:

* "first": the span that holds the token's first character;
* "most": the span that holds most of its characters, the earlier of equals.

A token whose bytes begin inside a character belongs to that character's span.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tastemill.llm.prefix_bpe import PrefixBpe, Vocabulary, coder
from tastemill.session import ship_package

RULES = ("first", "most")


@dataclass(frozen=True)
class Layout:
    """`fields`: columns in the document's order, each followed by `separator` (which is part of
    its span) but for the last. `sections`: the field that is cut into sections at `cut`, which
    ends the section before it; other fields are one section."""

    fields: tuple[str, ...] = ("source", "lang", "text")
    separator: str = "\n"
    sections: str | None = "text"
    cut: str = "\n"
    rule: str = "first"


def sections_of(layout: Layout, values: list[str | None]) -> tuple[str, list[tuple[str, int, int, int]]]:
    """The document and its spans (field, section, start, stop), in order and without gaps."""
    spans, parts, at = [], [], 0
    for number, (field, value) in enumerate(zip(layout.fields, values, strict=True)):
        text = (value or "") + (layout.separator if number < len(layout.fields) - 1 else "")
        parts.append(text)
        pieces = [text]
        if field == layout.sections and layout.cut:
            pieces = [p + layout.cut for p in text.split(layout.cut)]
            pieces[-1] = pieces[-1][: len(pieces[-1]) - len(layout.cut)]
            if len(pieces) > 1 and not pieces[-1]:
                pieces.pop()
        for section, piece in enumerate(pieces):
            spans.append((field, section, at, at + len(piece)))
            at += len(piece)
    return "".join(parts), spans


def token_spans(bpe: PrefixBpe, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end character of each token: of the characters that its bytes begin or lie in."""
    ends = np.cumsum(bpe.token_sizes[ids])
    starts = ends - bpe.token_sizes[ids]
    if text.isascii():
        return starts, ends
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    return character[starts], character[ends - 1] + 1


def attributed(rule: str, starts: np.ndarray, ends: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """The number of the span that each token counts in; `borders` are the spans' ends, in order.

    Both lists are sorted, so the interval join is two binary searches. Empty spans get nothing.
    """
    first = np.searchsorted(borders, starts, side="right")
    if rule == "first":
        return first
    last = np.searchsorted(borders, ends - 1, side="right")
    best = first.copy()
    for i in np.flatnonzero(last > first):
        edges = np.clip(borders[first[i] : last[i]], starts[i], ends[i])
        shares = np.diff(np.concatenate([[starts[i]], edges, [ends[i]]]))
        best[i] += int(shares.argmax())
    return best


def section_tokens(docs: DataFrame, vocabulary: Vocabulary, layout: Layout = Layout(), id_col: str = "doc_id") -> DataFrame:
    """One row per document and section: id, field, section, start, stop (characters of the
    document), n_tokens, n_crossing (tokens counted here that reach into another span).

    A null field counts as empty; an empty field has one section without tokens, and the fields'
    separators are the only text of a row of nulls. Repeated rows give repeated rows. Other
    columns play no part. An unknown rule raises.
    """
    if layout.rule not in RULES:
        raise ValueError(f"unknown rule {layout.rule!r}")
    narrow = docs.select(F.col(id_col).alias("doc_id"), *[F.col(f).cast("string").alias(f"field_{k}") for k, f in enumerate(layout.fields)])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary)
        for part in parts:
            columns = [c.to_pylist() for c in part.columns[1:]]
            laid = [sections_of(layout, [c[i] for c in columns]) for i in range(part.num_rows)]
            take, rows, counts, crossing = [], [], [], []
            for number, ((text, spans), ids) in enumerate(zip(laid, bpe.encode_batch([t for t, _ in laid]), strict=True)):
                starts, ends = token_spans(bpe, text, ids)
                borders = np.array([s[3] for s in spans])
                at = attributed(layout.rule, starts, ends, borders)
                opens = np.array([s[2] for s in spans])
                over = (starts < opens[at]) | (ends > borders[at])
                counts.append(np.bincount(at, minlength=len(spans)))
                crossing.append(np.bincount(at[over], minlength=len(spans)))
                take += [number] * len(spans)
                rows += spans
            field, section, start, stop = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [])
            whole = lambda x: pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(take, pa.int64())), pa.array(field, pa.string()), pa.array(section, pa.int64()),
                 pa.array(start, pa.int64()), pa.array(stop, pa.int64()), whole(counts), whole(crossing)],
                names=["doc_id", "field", "section", "start", "stop", "n_tokens", "n_crossing"],
            )

    whole = [StructField(n, LongType()) for n in ("section", "start", "stop", "n_tokens", "n_crossing")]
    ship_package(docs.sparkSession)
    return narrow.mapInArrow(batches, StructType([narrow.schema["doc_id"], StructField("field", StringType()), *whole]))
