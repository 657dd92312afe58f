"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece of text exactly one token can be the last of the prefix's encoding: a
token that ends there, whose start has an encoding itself, and that may follow that encoding's
last token. Two tokens may follow each other if the merges turn their joined bytes back into just
these two. Storing the last token of each prefix gives the encoding by walking back from the end,
lets an append continue where the text ended, and lets an edit reuse all prefixes before it.

The text is split into pieces by the tokenizer's pattern first; pieces are encoded one by one.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from tastemill.llm.frames import spare_name
from tastemill.session import ship_package

# Words and token pairs whose results a worker keeps. Words age out in two halves, pairs all at once.
KEPT_WORDS = 400_000
KEPT_PAIRS = 300_000
# A contraction of the pattern looks this many characters ahead of its start.
LOOK_AHEAD = 3
NEVER = 1 << 60


@dataclass(frozen=True)
class Vocabulary:
    """Ranks of byte strings (base64 text lines "token rank") and the pattern that splits texts."""

    path: str
    pattern: str

    @classmethod
    def public(cls, name: str = "byte_bpe_50k.tiktoken") -> Vocabulary:
        import public_tokenizers

        return cls(public_tokenizers.path(name), public_tokenizers.PATTERN)

    def ranks(self) -> dict[bytes, int]:
        with open(self.path, "rb") as lines:
            return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@dataclass
class Piece:
    """A piece's bytes with the last token and the scan state of each prefix."""

    data: bytes
    last: list[int]
    states: list[int]


@dataclass
class Encoding:
    """A text with its pieces; `starts` are the pieces' character offsets."""

    text: str
    starts: list[int]
    pieces: list[Piece]
    reused_bytes: int = field(default=0, compare=False)


class PrefixBpe:
    """Encoder and decoder of one vocabulary; made once per worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.ranks = vocabulary.ranks()
        self.pattern = regex.compile(vocabulary.pattern)
        self.cut = re.compile(r"(?= \S)")
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.sizes = {rank: len(token) for token, rank in self.ranks.items()}
        self.edges: dict[int, tuple] = {}
        self.pairs: dict[int, bool] = {}
        self.kept: dict[str, bytes] = {}  # ids as 32-bit integers
        self.aging: dict[str, bytes] = {}
        tokens = [self.bytes_of.get(rank, b"") for rank in range(max(self.bytes_of) + 1)]
        self.token_sizes = np.array([len(t) for t in tokens], np.int64)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        # States of the scan: the longest end of what was read that begins a token.
        self.begins = {token[:k] for token in self.ranks for k in range(1, len(token) + 1)}
        self.state_of: dict[bytes, int] = {b"": 0}
        self.state_bytes: list[bytes] = [b""]
        self.endings: list[list[tuple[int, int]]] = [[]]
        self.steps: dict[int, int] = {}

    def step(self, state: int, byte: int) -> int:
        """The state after one more byte; its `endings` are the tokens that end there, longest first."""
        read = self.state_bytes[state] + bytes([byte])
        while read and read not in self.begins:
            read = read[1:]
        if (after := self.state_of.get(read)) is None:
            after = self.state_of[read] = len(self.state_bytes)
            self.state_bytes.append(read)
            ends = (self.ranks.get(read[k:]) for k in range(len(read)))
            # A token that no merges reach never stands in an encoding.
            self.endings.append([(r, self.sizes[r]) for r in ends if r is not None and self.edge_parts(r)[0] is not None])
        self.steps[state << 8 | byte] = after
        return after

    def edge_parts(self, token: int) -> tuple[list, list]:
        """What stands at the token's right and left edge while its bytes merge: (part, rank that ends it)."""
        if (known := self.edges.get(token)) is None:
            data = self.bytes_of[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            right, left = [], []
            while len(parts) > 1:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
                if rank == NEVER:
                    break
                if at == 0:
                    left.append((parts[0], rank))
                if at == len(parts) - 2:
                    right.append((parts[-1], rank))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            left.append((parts[0], NEVER))
            right.append((parts[-1], NEVER))
            if len(parts) > 1:  # no merges reach this token: it never stands in an encoding
                left = right = None
            known = self.edges[token] = (right, left)
        return known

    def may_follow(self, left: int, right: int) -> bool:
        """True if the merges of both tokens' joined bytes end in these two tokens.

        A merge over the border happens where the parts on its two sides stand together at the rank
        that joins them. Of equal ranks the left one goes first.
        """
        key = left << 20 | right
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            before, after = self.edge_parts(left)[0], self.edge_parts(right)[1]
            known = before is not None and after is not None
            if known:
                rank_of = self.ranks.get
                for part, until in before:
                    for other, other_until in after:
                        rank = rank_of(part + other, NEVER)
                        if rank < until and rank <= other_until and rank != NEVER:
                            known = False
                            break
                    if not known:
                        break
            self.pairs[key] = known
        return known

    def extend(self, data: bytes, last: list[int], states: list[int]) -> None:
        """Lengthen the tables of the first len(last) bytes of `data` to all its prefixes."""
        steps, endings, pairs, follows = self.steps, self.endings, self.pairs, self.may_follow
        state = states[-1] if states else 0
        for end in range(len(last), len(data)):
            byte = data[end]
            if (after := steps.get(state << 8 | byte)) is None:
                after = self.step(state, byte)
            state = after
            for rank, size in endings[state]:
                if size > end:
                    break
                key = last[end - size] << 20 | rank
                if (fits := pairs.get(key)) or (fits is None and follows(last[end - size], rank)):
                    break
            else:
                raise ValueError(f"no token of the vocabulary ends at byte {end + 1} of {data[:40]!r}")
            last.append(rank)
            states.append(state)

    def walk(self, data: bytes, last: list[int]) -> list[int]:
        """The encoding that a piece's table holds."""
        ids, end, sizes = [], len(data), self.sizes
        while end:
            ids.append(rank := last[end - 1])
            end -= sizes[rank]
        ids.reverse()
        return ids

    def learn(self, words: Iterable[str]) -> None:
        """Encode new words; their pieces go in byte order, so neighbours share a prefix's table."""
        split = {word: self.pattern.findall(word) for word in words}
        ids_of: dict[str, bytes] = {}
        before, last, states = b"", [], []
        for data, piece in sorted((p.encode("utf-8", "replace"), p) for p in set(chain.from_iterable(split.values()))):
            common, most = 0, min(len(data), len(before))
            while common < most and data[common] == before[common]:
                common += 1
            del last[common:], states[common:]
            self.extend(data, last, states)
            before = data
            ids_of[piece] = array("i", self.walk(data, last)).tobytes()
        for word, pieces in split.items():
            self.kept[word] = b"".join(map(ids_of.__getitem__, pieces))

    def words(self, text: str | None) -> list[str]:
        """The text cut before every space that a character other than white space follows.

        A piece of the pattern always begins there, so each part can be split by itself.
        """
        return self.cut.split(text) if text else []

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts; none for a null or empty one."""
        split = [self.words(text) for text in texts]
        needed = set().union(*split)
        if len(self.kept) > KEPT_WORDS // 2:
            self.aging, self.kept = self.kept, {}
        new = needed.difference(self.kept)
        for word in new.intersection(self.aging):
            self.kept[word] = self.aging[word]
        self.learn(new.difference(self.kept))
        return [np.frombuffer(b"".join(map(self.kept.__getitem__, words)), np.int32) for words in split]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids) -> bytes:
        """The bytes of the tokens, joined; an id outside the vocabulary raises."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.token_sizes) or not self.token_sizes[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        sizes = self.token_sizes[ids]
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.token_bytes[within + np.repeat(self.token_starts[ids], sizes)].tobytes()

    # -- tables that are kept for appends and edits -------------------------------------------

    def table(self, text: str) -> Encoding:
        return self._split_on(Encoding("", [], []), text, 0)

    def append(self, encoding: Encoding, more: str) -> Encoding:
        """The encoding of text + more; only the pieces that could change are redone."""
        return self.edit(encoding, len(encoding.text), len(encoding.text), more)

    def edit(self, encoding: Encoding, start: int, end: int, new: str) -> Encoding:
        """The encoding after text[start:end] became `new`.

        Pieces before the edit that do not look at it stay; behind it the old pieces are taken
        again from the first place where an old and a new piece begin together.
        """
        if not 0 <= start <= end <= len(encoding.text):
            raise ValueError("the edit lies outside the text")
        text = encoding.text[:start] + new + encoding.text[end:]
        keep = len(encoding.starts)
        ends = encoding.starts[1:] + [len(encoding.text)]
        while keep and (ends[keep - 1] + 1 > start or encoding.starts[keep - 1] + LOOK_AHEAD > start):
            keep -= 1
        return self._split_on(encoding, text, keep, end, len(text) - len(encoding.text))

    def _split_on(self, old: Encoding, text: str, keep: int, old_end: int = 0, shift: int = 0) -> Encoding:
        starts, pieces = old.starts[:keep], old.pieces[:keep]
        reused = sum(len(p.data) for p in pieces)
        at = old.starts[keep] if keep < len(old.starts) else (len(old.text) if keep else 0)
        known = {s: i for i, s in enumerate(old.starts)}
        while at < len(text):
            same = known.get(at - shift)
            if same is not None and at - shift >= old_end and old.text:
                starts += [s + shift for s in old.starts[same:]]
                pieces += old.pieces[same:]
                reused += sum(len(p.data) for p in old.pieces[same:])
                break
            found = self.pattern.match(text, at)
            data = found.group().encode("utf-8", "replace")
            before = old.pieces[known[at]] if at in known else Piece(b"", [], [])
            common = 0
            while common < min(len(data), len(before.data)) and data[common] == before.data[common]:
                common += 1
            starts.append(at)
            piece = Piece(data, before.last[:common], before.states[:common])
            self.extend(data, piece.last, piece.states)
            pieces.append(piece)
            reused += common
            at = found.end()
        return Encoding(text, starts, pieces, reused)

    def ids(self, encoding: Encoding) -> list[int]:
        return [i for piece in encoding.pieces for i in self.walk(piece.data, piece.last)]


_coders: dict[Vocabulary, PrefixBpe] = {}


def coder(vocabulary: Vocabulary) -> PrefixBpe:
    """The worker's encoder; its tables are built once."""
    if vocabulary not in _coders:
        _coders[vocabulary] = PrefixBpe(vocabulary)
    return _coders[vocabulary]


def encode_documents(
    docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_name: str = "token_ids", decoded_name: str = "decoded"
) -> DataFrame:
    """`docs` with the ids of each whole text and the bytes that the ids decode to.

    A null or empty text has no ids and empty bytes. Rows, their order and all other columns stay
    as they are, repeated rows included; where a column already has a new name, underscores are
    added to the new one. Lone surrogates cannot occur in a Spark string. The vocabulary file must
    be readable on every worker under the same path.
    """
    ids_name, decoded_name = spare_name(docs, ids_name), spare_name(docs, decoded_name)
    place = [c.lower() for c in docs.columns].index(text_col.lower())

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary)
        for part in parts:
            ids = bpe.encode_batch(part.column(place).to_pylist())
            decoded = [bpe.decode(row) for row in ids]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, _lists(ids), pa.array(decoded, pa.binary())],
                names=[*part.schema.names, ids_name, decoded_name],
            )

    added = [StructField(ids_name, ArrayType(IntegerType())), StructField(decoded_name, BinaryType())]
    ship_package(docs.sparkSession)
    return docs.mapInArrow(batches, StructType([*docs.schema.fields, *added]))


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, np.int32)])))


def decode_documents(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "token_ids", decoded_name: str = "decoded") -> DataFrame:
    """`rows` with the bytes of each id list; null ids give null, an id outside the vocabulary raises."""
    decoded_name = spare_name(rows, decoded_name)
    place = [c.lower() for c in rows.columns].index(ids_col.lower())

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary)
        for part in parts:
            decoded = [None if ids is None else bpe.decode(ids) for ids in part.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], names=[*part.schema.names, decoded_name])

    ship_package(rows.sparkSession)
    return rows.mapInArrow(batches, StructType([*rows.schema.fields, StructField(decoded_name, BinaryType())]))


def digests(encoded: DataFrame, ids_col: str = "token_ids", decoded_col: str = "decoded") -> DataFrame:
    """doc_id, n_tokens and the hex digests of ids and decoded bytes."""
    return encoded.select(
        "doc_id",
        F.size(ids_col).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids_col).cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded_col), 256).alias("decoded_sha256"),
    )
