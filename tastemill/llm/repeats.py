"""Substring dedup: automata of repeated phrases find every passage that an earlier document holds.

A window is a run of `window` words of one document. A word goes if a window over it also starts in
a document with a smaller id. Windows are never sent one by one:

1. every window has an anchor, the run of `anchor` words in it with the least hash (the first of
   equal ones). Equal windows have equal anchors, and neighbours mostly share theirs, so a document
   is a list of stretches, the windows of one anchor each, and of a stretch only hashes are sent;
2. stretches whose anchor occurs in two documents are recurring; equal ones are one, which keeps its
   least and its largest document. Only these are cut out of the texts;
3. recurring stretches are sent to their anchor's task. There the runs of `GROUP` neighbouring
   windows are phrases: the words that all windows of a run share are a pattern, and the patterns of
   a shard of bounded size are compiled into one Aho-Corasick automaton over word numbers. All the
   shard's stretches are streamed through it; each occurrence is grown to both sides as far as the
   words agree, which confirms, word for word, the windows that it stands for and who has them first;
4. anchors with very many different stretches (a short phrase in all kinds of text, or the border of
   a passage that very many documents share) would fill a task. They are counted apart, in runs of
   windows by digests of their bytes, with partial sums: the exact way for the rest;
5. each document's stretches take what was found for them, which gives its spans of repeated words.

No step needs two documents in one place: a passage in a third of all documents has one stretch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.llm.frames import row_key, spare_name
from tastemill.llm.words import BASE, MIX_1, mixed, word_hashes
from tastemill.session import ship_package, staged

# Neighbouring windows of one pattern: the pattern is so many words, less one, shorter than a window.
GROUP = 10
# Words of the stretches of one automaton, about 100 bytes each.
SHARD_WORDS = 500_000
# Different stretches of one anchor up to which automata are used.
MOST_STRETCHES = 500
# Window starts worked on at once in the first pass.
STARTS_AT_ONCE = 500_000
# Fixed value: the inverse of BASE modulo 2^64.
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


@dataclass(frozen=True)
class RepeatPlan:
    """`anchor` is a power of two and less than `window`."""

    window: int = 50
    anchor: int = 16


def _powers(base: np.uint64, count: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(count, base, np.uint64)]), dtype=np.uint64)[:count]


def _least_at(grams: np.ndarray, width: int) -> np.ndarray:
    """For every run of `width` neighbours the place of its least, the first of equal ones."""
    least, at, reach = grams, np.arange(len(grams)), 1
    while reach < width:
        step = min(reach, width - reach)
        right = least[step:] < least[:-step]
        at = np.where(right, at[step:], at[:-step])
        least = np.where(right, least[step:], least[:-step])
        reach += step
    return at


def stretches(values: np.ndarray, bounds: np.ndarray, plan: RepeatPlan) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, start, windows, words before the anchor, anchor, digest) arrays of the stretches of texts as `word_hashes` gives them."""
    total = len(values) - plan.window + 1
    for begin in range(0, max(total, 0), STARTS_AT_ONCE):
        part = values[begin : begin + STARTS_AT_ONCE + plan.window - 1]
        grams, size = part, 1
        while size < plan.anchor:
            grams = mixed(grams[:-size] * BASE + grams[size:])
            size *= 2
        at = _least_at(grams, plan.window - plan.anchor + 1)
        starts = np.arange(len(at))
        text = np.searchsorted(bounds, starts + begin, side="right") - 1
        inside = starts + begin + plan.window <= bounds[text + 1]
        starts, text, at = starts[inside], text[inside], at[inside]
        if not len(starts):
            continue
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        count = np.diff(np.concatenate([first, [len(starts)]]))
        start, place = starts[first], at[first]
        stop = start + count + plan.window - 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * _powers(BASE, len(part)), dtype=np.uint64)])
        digest = mixed((sums[stop] - sums[start]) * _powers(INVERSE, len(part))[start] + (stop - start).astype(np.uint64) * MIX_1)
        yield text[first], start + begin - bounds[text[first]], count, place - start, grams[place].view(np.int64), digest.view(np.int64)


def occurrences(docs: DataFrame, plan: RepeatPlan) -> DataFrame:
    """(doc_id, row_key, start, n, lead, anchor, digest): the stretches of all documents with an id."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for text, start, count, lead, anchor, digest in stretches(*word_hashes(part.column(2).to_pylist()), plan):
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(1).take(rows), *(pa.array(a, pa.int32()) for a in (start, count, lead)), pa.array(anchor), pa.array(digest)],
                    names=["doc_id", "row_key", "start", "n", "lead", "anchor", "digest"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "row_key", "text")
    return named.mapInArrow(batches, f"doc_id {kind}, row_key long, start int, n int, lead int, anchor long, digest long")


def _packed(docs: DataFrame) -> DataFrame:
    """Texts compressed for the shuffle; null stays null."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for part in parts:
            packed = [None if t is None else press.compress(t.encode("utf-8", "replace")) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed, pa.binary())], names=["doc_id", "row_key", "packed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "row_key", "text").mapInArrow(batches, f"doc_id {kind}, row_key long, packed binary")


def _words(packed: bytes | None, press: zstandard.ZstdDecompressor) -> list[bytes]:
    return press.decompress(packed).split() if packed is not None else []  # splits at the six separators


def _cut(docs: DataFrame, wanted: DataFrame, plan: RepeatPlan) -> DataFrame:
    """(anchor, digest, first, lead, n, hot, words) of the stretches in `wanted`, cut out of the texts that hold them first."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        names = ["anchor", "digest", "first", "lead", "n", "hot", "words"]
        kinds = [pa.int64(), pa.int64(), None, pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
        for part in parts:
            kinds[2] = part.schema.field(0).type
            found = []
            for doc_id, packed, list_of in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                words = _words(packed, press)
                for s in list_of:
                    piece = words[s["start"] : s["start"] + s["n"] + plan.window - 1]
                    found.append((s["anchor"], s["digest"], doc_id, s["lead"], s["n"], s["hot"], b" ".join(piece)))
            columns = zip(*found, strict=True) if found else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    by_text = wanted.groupBy("first", "first_key").agg(F.collect_list(F.struct("anchor", "digest", "start", "n", "lead", "hot")).alias("stretches"))
    joined = _packed(docs).join(by_text, (F.col("doc_id") == F.col("first")) & (F.col("row_key") == F.col("first_key")))
    return joined.select("doc_id", "packed", "stretches").mapInArrow(batches, f"anchor long, digest long, first {kind}, lead int, n int, hot boolean, words binary")


class Shard:
    """Stretches of whole anchors, and for each of their windows the least document that starts it."""

    def __init__(self, plan: RepeatPlan):
        self.plan, self.numbers, self.rows, self.size = plan, {}, [], 0

    def add(self, anchor: int, digest: int, first: int, words: bytes) -> None:
        own = tuple(self.numbers.setdefault(w, len(self.numbers)) for w in words.split(b" "))
        self.rows.append((anchor, digest, first, own))
        self.size += len(own)

    def automaton(self) -> ahocorasick.Automaton:
        """Patterns of all rows; each leads to the (row, first window, last window) that it stands for."""
        found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        size = self.plan.window
        for number, (*_, own) in enumerate(self.rows):
            windows = len(own) - size + 1
            for low in range(0, windows, GROUP):
                high = min(low + GROUP, windows) - 1
                core = own[high : low + size]
                if (known := found.get(core, None)) is None:
                    found.add_word(core, (len(core), [(number, low, high)]))
                else:
                    known[1].append((number, low, high))
        found.make_automaton()
        return found

    def firsts(self) -> Iterator[tuple[int, int, int, int, int]]:
        """(anchor, digest, low, high, first): runs of windows that one document starts first."""
        size, automaton = self.plan.window, self.automaton()
        for anchor, digest, first, own in self.rows:
            windows = len(own) - size + 1
            least = [first] * windows
            for end, (length, phrases) in automaton.iter(own):
                at = end - length + 1
                for number, low, high in phrases:
                    _, _, theirs, other = self.rows[number]
                    if theirs >= first:
                        continue  # nothing earlier than the stretch's own document
                    lead, left, right = high - low, 0, 0
                    while left < lead and left < at and own[at - left - 1] == other[high - left - 1]:
                        left += 1
                    while right < lead and end + right + 1 < len(own) and own[end + right + 1] == other[low + size + right]:
                        right += 1
                    for j in range(at - left, at - max(0, lead - right) + 1):
                        if theirs < least[j]:
                            least[j] = theirs
            low = 0
            for j in range(1, windows + 1):
                if j == windows or least[j] != least[low]:
                    yield anchor, digest, low, j - 1, least[low]
                    low = j


def _name(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


FIRSTS = ["anchor", "digest", "low", "high", "first"]


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), kind]
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=FIRSTS)


def _by_automata(cut: DataFrame, plan: RepeatPlan, kind: str) -> DataFrame:
    """First documents of the windows of anchors with few stretches, shard by shard."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last, ids = Shard(plan), None, None
        for part in parts:
            ids = part.schema.field(2).type
            for row in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                if row[0] != last and shard.size > SHARD_WORDS:
                    yield _batch(list(shard.firsts()), ids)
                    shard = Shard(plan)
                last = row[0]
                shard.add(*row)
        if shard.rows:
            yield _batch(list(shard.firsts()), ids)

    rows = cut.where(~F.col("hot")).select("anchor", "digest", "first", "words")
    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(batches, f"anchor long, digest long, low int, high int, first {kind}")


def _name(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _by_digests(cut: DataFrame, plan: RepeatPlan, kind: str) -> DataFrame:
    """The same for anchors with very many stretches, by 128 bits of digests, with partial sums only.

    A stretch is cut into runs of at most `GROUP` windows by their distance from the anchor; all
    windows of a run share the words of its core. Equal runs are one. Only where different runs
    have one core are windows looked at one by one.
    """
    size = plan.window

    def runs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            row, found = [], []
            for i, (lead, words) in enumerate(zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)):
                own, low = words.split(b" "), 0
                while low <= len(own) - size:
                    nearest = (lead - low) // GROUP * GROUP  # least distance of the run's windows from the anchor
                    high = min(lead - nearest, len(own) - size)
                    piece = own[low : high + size]
                    row.append(i)
                    found.append((low, high, _name(own[lead - nearest : lead - nearest + size - GROUP + 1]), _name(piece), b" ".join(piece)))
                    low = high + 1
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i).take(at) for i in range(3)), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))],
                names=["anchor", "digest", "first", "low", "high", "core", "run", "words"],
            )

    def windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            row, place, names = [], [], []
            for i, words in enumerate(part.column(3).to_pylist()):
                own = words.split(b" ")
                for j in range(len(own) - size + 1):
                    row.append(i)
                    place.append(j)
                    names.append(_name(own[j : j + size]))
            at = pa.array(row, pa.int64())
            columns = [*(part.column(i).take(at) for i in range(3)), pa.array(place, pa.int32()), pa.array(names, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["core", "run", "least", "place", "window"])

    rows = cut.where("hot")
    all_runs = staged(rows.select("anchor", "digest", "first", "lead", "words").mapInArrow(runs, f"anchor long, digest long, first {kind}, low int, high int, core binary, run binary, words binary"))
    distinct = staged(all_runs.groupBy("core", "run").agg(F.min("first").alias("least"), F.any_value("words").alias("words")))
    several = staged(distinct.groupBy("core").count().where(F.col("count") > 1).select("core"))
    singles = staged(distinct.join(several, "core", "left_semi").select("core", "run", "least", "words").mapInArrow(windows, f"core binary, run binary, least {kind}, place int, window binary"))
    earlier = singles.groupBy("window").agg(F.min("least").alias("earlier"))
    better = singles.join(earlier, "window").where(F.col("earlier") < F.col("least")).select("core", "run", "place", F.col("earlier").alias("least"))
    placed = all_runs.select("anchor", "digest", "first", "low", "high", "core", "run")
    low, place = F.col("low"), F.col("low") + F.col("place")
    whole = placed.join(distinct.select("core", "run", "least"), ["core", "run"]).where(F.col("least") < F.col("first"))
    part = placed.join(better, ["core", "run"]).where(F.col("least") < F.col("first"))
    return (
        rows.select("anchor", "digest", F.lit(0).alias("low"), (F.col("n") - 1).alias("high"), "first")
        .unionByName(whole.select("anchor", "digest", low.alias("low"), "high", F.col("least").alias("first")))
        .unionByName(part.select("anchor", "digest", place.alias("low"), place.alias("high"), F.col("least").alias("first")))
    )


def repeated_spans(docs: DataFrame, plan: RepeatPlan) -> DataFrame:
    """(doc_id, row_key, spans): for documents with repeated words the word ranges, from and up to, in no order."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = staged(occurrences(docs, plan))
    # Written first, so that the join may split an anchor of very many documents over many tasks.
    recurring = staged(rows.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor"))
    held = staged(rows.join(recurring, "anchor", "left_semi"))
    source = F.min(F.struct("doc_id", "row_key", "start", "n", "lead")).alias("source")
    distinct = staged(held.groupBy("anchor", "digest").agg(source).select("anchor", "digest", F.col("source.doc_id").alias("first"), F.col("source.row_key").alias("first_key"), "source.start", "source.n", "source.lead"))
    hot = distinct.groupBy("anchor").count().where(F.col("count") > MOST_STRETCHES).select("anchor", F.lit(True).alias("hot"))
    wanted = distinct.join(hot, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    cut = staged(_cut(docs, wanted, plan))
    firsts = staged(_by_automata(cut, plan, kind).unionByName(_by_digests(cut, plan, kind)))
    found = held.join(firsts, ["anchor", "digest"]).where(F.col("first") < F.col("doc_id"))
    span = F.struct((F.col("start") + F.col("low")).alias("from"), (F.col("start") + F.col("high") + plan.window).alias("upto"))
    return found.groupBy("doc_id", "row_key").agg(F.collect_set(span).alias("spans"))


def repeated_words(docs: DataFrame, plan: RepeatPlan = RepeatPlan(), id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, row_key, n_words, n_removed, kept_sha256 and, if asked for,
    `kept`, the words that stay joined by one space.

    Words are runs of bytes other than space and tab to carriage return. Null and empty texts have
    no words, and the digest of ''. Texts shorter than a window keep all. Rows that share an id are
    one document of it each, and no row loses words to another row of its own id. A row with a null
    id keeps all its words and takes none from others. An empty table gives no rows. Other columns
    play no part.
    """
    ship_package(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), row_key(text_col).alias("row_key"), F.col(text_col).cast("string").alias("text"))
    spans = repeated_spans(narrow, plan).select(F.col("doc_id").alias("span_id"), F.col("row_key").alias("span_key"), "spans")
    joined = _packed(narrow).join(spans, (F.col("doc_id") == F.col("span_id")) & (F.col("row_key") == F.col("span_key")), "left")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for part in parts:
            counts, removed, digests, texts = [], [], [], []
            for packed, list_of in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                words = _words(packed, press)
                kept, at = [], 0
                for low, high in sorted((s["from"], s["upto"]) for s in list_of or ()):
                    kept += words[at : max(at, low)]
                    at = max(at, high)
                kept += words[at:]
                text = b" ".join(kept)
                counts.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(text).hexdigest())
                texts.append(text.decode("utf-8", "replace") if with_text else None)
            columns = [part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "row_key", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(texts, pa.string())] if with_text else [])], names=[*names, *(["kept"] if with_text else [])])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row_key long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")
    return joined.select("doc_id", "row_key", "packed", "spans").mapInArrow(batches, schema)


def without_repeats(docs: DataFrame, plan: RepeatPlan = RepeatPlan()) -> DataFrame:
    """`docs` (columns doc_id and text among them) with the words that stay; untouched texts stay as they are."""
    cut = repeated_words(docs, plan, with_text=True).where("n_removed > 0")
    cut = cut.select(F.col("doc_id").alias("__cut_id"), F.col("row_key").alias("__cut_key"), F.col("kept").alias("__kept")).dropDuplicates(["__cut_id", "__cut_key"])
    key = spare_name(docs, "__key")
    rows = docs.withColumn(key, row_key("text"))
    joined = rows.join(cut, (rows["doc_id"] == cut["__cut_id"]) & (rows[key] == cut["__cut_key"]), "left")
    return joined.withColumn("text", F.coalesce("__kept", "text")).select(*docs.columns)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (
  SELECT n, doc_id, i, array_to_string(words[i:i + 49], ' ') AS w FROM (SELECT *, unnest(range(1, len(words) - 48)) AS i FROM d WHERE len(words) >= 50)),
f AS (SELECT w, min(doc_id) AS least FROM w GROUP BY w HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT n, unnest(range(i, i + 50)) AS i FROM w JOIN f USING (w) WHERE least < doc_id),
k AS (
  SELECT n, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n_kept
  FROM (SELECT n, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d) ANTI JOIN r USING (n, i) GROUP BY n)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (n)
"""
