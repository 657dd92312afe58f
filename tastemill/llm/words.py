"""Words of whole texts as numpy arrays: runs of bytes other than space and tab to carriage return.

A word is `[^\\x20\\x09-\\x0D]+`. All texts of a batch are handled together; a word's 64-bit value
depends on its bytes only, so it is the same in every task, batch and run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np

# Odd multipliers of the byte polynomial and of the final mixing (SplitMix64).
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)
# Bytes handled at once; longer texts are cut between words, which leaves every word whole.
SEGMENT_BYTES = 1 << 20
# Bytes beyond which a word's value is a cryptographic digest.
LONG_WORD = 256

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly; a bijection."""
    values = values ^ (values >> np.uint64(30))
    values = values * MIX_1
    values = values ^ (values >> np.uint64(27))
    values = values * MIX_2
    return values ^ (values >> np.uint64(31))


def _powers(count: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, count - 1), BASE, np.uint64)]), dtype=np.uint64)


_POWERS = _powers(64)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words in an array of bytes."""
    inside = np.concatenate([[False], ~SPACE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit value for each span of bytes."""
    lengths = ends - starts
    if not len(lengths):
        return np.zeros(0, np.uint64)
    # A polynomial modulo a power of two tells long periodic words apart badly: those get a digest of their bytes.
    long = lengths > LONG_WORD
    lengths = np.where(long, 1, lengths)
    longest = int(lengths.max())
    powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
    offsets = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(offsets, lengths)
    bytes_in = data[within + np.repeat(starts, lengths)]
    sums = np.add.reduceat((bytes_in.astype(np.uint64) + np.uint64(1)) * powers[within], offsets)
    values = mixed(sums + lengths.astype(np.uint64) * MIX_1)
    for i in np.flatnonzero(long):
        values[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return values


def _segments(texts: Iterable[str | None]):
    """(bytes, ends of the texts within them, their numbers): several short texts or a part of a long one."""
    held, numbers, size = [], [], 0
    for number, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace")
        if len(raw) > SEGMENT_BYTES:
            if held:  # words come in the order of the texts
                yield held, numbers
                held, numbers, size = [], [], 0
            start = 0
            view = np.frombuffer(raw, np.uint8)
            while start < len(raw):
                end = min(start + SEGMENT_BYTES, len(raw))
                while end < len(raw) and not SPACE[view[end]]:
                    end += 1
                yield [raw[start:end]], [number]
                start = end
            continue
        if size + len(raw) > SEGMENT_BYTES and held:
            yield held, numbers
            held, numbers, size = [], [], 0
        held.append(raw)
        numbers.append(number)
        size += len(raw) + 1
    if held:
        yield held, numbers


def word_hashes(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds): the words of text i are values[bounds[i]:bounds[i + 1]], in order.

    `lower` maps A-Z to a-z first. A null or empty text has no words.
    """
    counts = np.zeros(len(texts), np.int64)
    parts = []
    for held, numbers in _segments(texts):
        joined = b"\n".join(held)
        data = np.frombuffer(joined.lower() if lower else joined, np.uint8)
        starts, ends = word_spans(data)
        parts.append(span_hashes(data, starts, ends))
        limits = np.cumsum([len(h) + 1 for h in held])
        owner = np.searchsorted(limits, starts, side="right")
        counts += np.bincount(np.asarray(numbers)[owner], minlength=len(texts)) if len(owner) else 0
    values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return values, np.concatenate([[0], np.cumsum(counts)])


def windows(values: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(window values, bounds) of every run of `size` neighbouring words of one text."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    out_bounds = np.concatenate([[0], np.cumsum(counts)])
    total = int(out_bounds[-1])
    if not total:
        return np.zeros(0, np.uint64), out_bounds
    first = np.arange(total) - np.repeat(out_bounds[:-1], counts) + np.repeat(bounds[:-1], counts)
    out = np.full(total, np.uint64(size))
    for k in range(size):
        out = mixed(out * BASE + values[first + k])
    return out, out_bounds
