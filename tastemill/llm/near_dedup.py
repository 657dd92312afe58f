"""MinHash near-dedup: one-permutation hashing with optimal densification, bands and star edges.

One 64-bit hash per shingle serves all bins: the hash picks the bin, the least hash of a bin is its
value. An empty bin copies a filled one along its own fixed random probe sequence (Shrivastava,
"Optimal Densification for Fast and Accurate Minwise Hashing", ICML 2017). Bands of bins are
buckets. In a bucket every member is paired with one hub only, so candidate pairs grow with the
members, not with their square:

1. texts with one and the same set are one class; only classes are compared;
2. each class is checked against the hub it shares most buckets with, then, where it is still in
   another component, against its other hubs; every check uses the full sets;
3. what stars cannot see, a link between two members that are in different components and of
   which none is the hub, is searched exactly: the non-hub members of buckets that still hold
   several components are compared with each other in tasks, in blocks of bounded size, skipping
   pairs whose components are already joined. A bucket has no cap.

Components need no link between members that are already connected, so steps 2 and 3 lose none.
Classes are named by 64 bits of their set's digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from tastemill.llm.components import component_roots
from tastemill.llm.frames import each_once, keyed, pairs, row_key, same_row
from tastemill.llm.words import mixed, windows, word_hashes
from tastemill.session import ship_package, staged

# Shingles of one block of a bucket: the memory of a task that compares two blocks.
BLOCK_SHINGLES = 1_000_000


@dataclass(frozen=True)
class NearDedup:
    """`per_cent`: least Jaccard similarity of a link. The defaults miss a pair at 80 % with a
    chance below 1e-4 and one at 85 % below 1e-6."""

    words: int = 5
    per_cent: int = 80
    bands: int = 24
    rows: int = 5

    @property
    def bins(self) -> int:
        return self.bands * self.rows


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes; A-Z lower-cased; a shorter text is one shingle."""
    values, bounds = word_hashes(texts, lower=True)
    shingles, ends = windows(values, bounds, words)
    for i in range(len(texts)):
        count = int(bounds[i + 1] - bounds[i])
        if 0 < count < words:
            yield windows(values[bounds[i] : bounds[i + 1]], np.array([0, count]), count)[0]
        else:
            yield np.unique(shingles[ends[i] : ends[i + 1]])


def _probes(bins: int, tries: int) -> np.ndarray:
    """The fixed random bins that each empty bin asks, one after the other."""
    grid = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(tries, dtype=np.uint64)
    return (mixed(grid + np.uint64(1)) % np.uint64(bins)).astype(np.int64)


class Sketcher:
    """Band values of shingle sets."""

    def __init__(self, plan: NearDedup):
        self.plan = plan
        self.probes = _probes(plan.bins, 32 * plan.bins)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """The densified bins of a sorted set that is not empty."""
        bins = self.plan.bins
        place = ((shingles >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
        first = np.concatenate([[True], place[1:] != place[:-1]])
        filled = np.zeros(bins, bool)
        out = np.zeros(bins, np.uint64)
        spots = place[first].astype(np.int64)
        filled[spots], out[spots] = True, shingles[first]
        empty = np.flatnonzero(~filled)
        for tries in (16, self.probes.shape[1]):
            if not len(empty):
                break
            hits = filled[self.probes[empty, :tries]]
            found = hits.any(axis=1)
            donor = self.probes[empty, hits.argmax(axis=1)]
            out[empty[found]] = out[donor[found]]
            empty = empty[~found]
        out[empty] = shingles[0]  # no filled bin in the whole sequence: the least hash of all
        return out

    def bands(self, shingles: np.ndarray) -> np.ndarray:
        rows = self.signature(shingles).reshape(self.plan.bands, self.plan.rows)
        value = mixed(np.arange(1, self.plan.bands + 1, dtype=np.uint64))
        for k in range(self.plan.rows):
            value = mixed(value + rows[:, k])
        return value.view(np.int64)


def _class(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketches(docs: DataFrame, plan: NearDedup, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, n_shingles, class, bands) of every row; no class and no bands for an empty set."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(plan)
        for part in parts:
            counts, names, bands = [], [], []
            for shingles in shingle_sets(part.column(2).to_pylist(), plan.words):
                counts.append(len(shingles))
                names.append(_class(shingles) if len(shingles) else None)
                bands.append(sketcher.bands(shingles) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(names, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "row_key", "n_shingles", "class", "bands"],
            )

    narrow = docs.select(F.col(id_col).alias("doc_id"), row_key(text_col).alias("row_key"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([narrow.schema["doc_id"], narrow.schema["row_key"], StructField("n_shingles", LongType()), StructField("class", LongType()), StructField("bands", ArrayType(LongType()))])
    return narrow.mapInArrow(batches, schema)


def class_sets(docs: DataFrame, wanted: DataFrame, plan: NearDedup, id_col: str, text_col: str) -> DataFrame:
    """(class, shingles) of the classes of `wanted` (class, doc_id): their texts are read again."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            held = [(_class(s), s.tobytes()) for s in shingle_sets(part.column(0).to_pylist(), plan.words) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.binary())], names=["class", "shingles"]
            )

    ids = wanted.select(F.col("doc_id").alias("wanted_id"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi").select("text")
    found = texts.mapInArrow(batches, StructType([StructField("class", LongType()), StructField("shingles", BinaryType())]))
    # Rows that share an id may bring a class twice or one that nobody asked for.
    return found.join(wanted.select("class"), "class", "left_semi").dropDuplicates(["class"])


def _similar(size_a, size_b, common, per_cent: int):
    return 100 * common >= per_cent * (size_a + size_b - common)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    return int((large[at] == small).sum())


def _verified(pairs: DataFrame, sets: DataFrame, plan: NearDedup) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    size = F.length("shingles")
    a = sets.select(F.col("class").alias("a"), F.col("shingles").alias("set_a"), size.alias("size_a"))
    b = sets.select(F.col("class").alias("b"), F.col("shingles").alias("set_b"), size.alias("size_b"))
    possible = 100 * F.least("size_a", "size_b") >= plan.per_cent * F.greatest("size_a", "size_b")
    rows = pairs.join(a, "a").join(b, "b").where(possible).select("a", "b", "set_a", "set_b")
    per_cent = plan.per_cent

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keep = []
            for x, y in zip(part.column(2), part.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(_similar(len(x), len(y), _common(x, y), per_cent))
            yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(batches, "a long, b long")


class _Members:
    """The members of two blocks of a bucket: their sets, and which are in one component by now."""

    def __init__(self, sets: list[np.ndarray], components: np.ndarray, per_cent: int):
        self.sets, self.sizes = sets, np.array([len(s) for s in sets])
        _, self.component = np.unique(components, return_inverse=True)
        self.of = dict(enumerate(np.split(np.argsort(self.component, kind="stable"), np.cumsum(np.bincount(self.component))[:-1])))
        self.largest = self.component == np.bincount(self.component).argmax()
        self.prefixes(per_cent)

    def prefixes(self, per_cent: int) -> None:
        """Postings of the rarest shingles of each set: similar sets share one of so many."""
        owner = np.repeat(np.arange(len(self.sets)), self.sizes)
        _, code, counts = np.unique(np.concatenate(self.sets), return_inverse=True, return_counts=True)
        order = np.lexsort((code, counts[code], owner))
        owner, code = owner[order], code[order]
        place = np.arange(len(owner)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        inside = place < (self.sizes - -(-self.sizes * per_cent // 100) + 1)[owner]
        owner, code = owner[inside], code[inside]
        self.prefix = np.split(code, np.cumsum(np.bincount(owner, minlength=len(self.sets)))[:-1])
        order = np.argsort(code, kind="stable")
        self.posted = owner[order]
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(counts)))])

    def candidates(self, i: int) -> np.ndarray:
        """Members of other components that share a rare shingle with `i`; each pair is met from one side."""
        lists = [self.posted[self.ends[c] : self.ends[c + 1]] for c in self.prefix[i]]
        found = np.concatenate(lists)
        found = found[(self.component[found] != self.component[i]) & (self.largest[found] | (found > i))]
        return np.unique(found) if len(lists) > 1 else found

    def join(self, i: int, j: int) -> None:
        """Make the components of `i` and `j` one, at the cost of the smaller."""
        one, other = int(self.component[i]), int(self.component[j])
        if one != other:
            if len(self.of[one]) < len(self.of[other]):
                one, other = other, one
            moved = self.of.pop(other)
            self.component[moved] = one
            self.of[one] = np.concatenate([self.of[one], moved])


def _block_links(per_cent: int):
    """Links between members of two blocks of a bucket that are not yet in one component.

    Work starts from the members outside the largest component and goes through the postings of
    rare shingles only, so a bucket whose members are joined already costs next to nothing.
    """

    def links(group: pd.DataFrame) -> pd.DataFrame:
        within = group["low"].iloc[0] == group["high"].iloc[0]
        block, names = group["block"].to_numpy(), group["class"].to_numpy()
        members = _Members([np.frombuffer(s, np.uint64) for s in group["shingles"]], group["component"].to_numpy(), per_cent)
        found = []
        for i in np.flatnonzero(~members.largest):
            own, others = members.sets[i], members.candidates(i)
            sizes = members.sizes[others]
            possible = 100 * np.minimum(sizes, len(own)) >= per_cent * np.maximum(sizes, len(own))
            others = others[possible if within else possible & (block[others] != block[i])]
            if not len(others):
                continue
            joined = np.concatenate([members.sets[j] for j in others])
            at = np.minimum(np.searchsorted(own, joined), len(own) - 1)
            starts = np.cumsum(members.sizes[others]) - members.sizes[others]
            common = np.add.reduceat((own[at] == joined).astype(np.int64), starts)
            for j in others[_similar(len(own), members.sizes[others], common, per_cent)]:
                found.append((int(names[i]), int(names[j])))
                members.join(i, j)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return links


def _left_over(buckets: DataFrame, roots: DataFrame, classes: DataFrame, sets: DataFrame, plan: NearDedup) -> DataFrame:
    """Links that no star can show (step 3)."""
    members = (
        buckets.where(F.col("class") != F.col("hub"))
        .join(roots.withColumnRenamed("node", "class"), "class", "left")
        .withColumn("component", F.coalesce("root", "class"))
        .join(classes.select("class", F.col("n_shingles").alias("n")), "class")
    )
    open_buckets = (
        members.groupBy("bucket")
        .agg(F.min("component").alias("low_c"), F.max("component").alias("high_c"), F.sum("n").alias("total"))
        .where(F.col("low_c") != F.col("high_c"))
        .select("bucket", F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    )
    block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    pairs = (
        members.join(open_buckets, "bucket")
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "class", "component", "n")
    )
    grouped = pairs.join(sets, "class").groupBy("bucket", "low", "high")
    return grouped.applyInPandas(_block_links(plan.per_cent), "a long, b long")


def near_duplicates(docs: DataFrame, plan: NearDedup = NearDedup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, row_key, n_shingles, component_id (least id reachable),
    kept and component (a number of the component, null without shingles).

    Null and empty texts and texts without words have no shingles: they are linked with nothing and
    are their own component. Rows with equal sets are one class, also when their ids repeat; each
    row keeps its own result. A null id counts as larger than all others: it is the component's id
    only where no row of the component has one. An empty table gives no rows; other columns of
    `docs` play no part.
    """
    ship_package(docs.sparkSession)
    rows = staged(sketches(docs, plan, id_col, text_col))
    classes = staged(
        rows.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"))
    )
    buckets = rows.where(F.col("class").isNotNull()).select("class", F.explode("bands").alias("bucket")).distinct()
    hubs = buckets.groupBy("bucket").agg(F.min("class").alias("hub"), F.count("*").alias("members")).where("members > 1")
    buckets = staged(buckets.join(hubs.select("bucket", "hub"), "bucket"))
    edges = buckets.where("class != hub").groupBy(F.col("class").alias("a"), F.col("hub").alias("b")).agg(F.count("*").alias("shared"))
    best = Window.partitionBy("a").orderBy(F.desc("shared"), "b")
    edges = staged(edges.withColumn("turn", F.row_number().over(best)))
    wanted = edges.select("a").union(edges.select("b")).distinct().withColumnRenamed("a", "class")
    wanted = classes.join(wanted, "class", "left_semi").select("class", "doc_id")
    sets = staged(class_sets(docs, wanted, plan, id_col, text_col))

    links = staged(_verified(edges.where("turn = 1").select("a", "b"), sets, plan))
    roots = component_roots(links)
    for candidates in ("stars", "blocks"):
        if candidates == "stars":
            more = _verified(_apart(edges.where("turn > 1").select("a", "b"), roots), sets, plan)
        else:
            more = _left_over(buckets, roots, classes, sets, plan)
        links = links.union(staged(more))
        roots = component_roots(links)
    return _labelled(rows, classes, roots)


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are not yet in one component."""
    out = pairs
    for end in ("a", "b"):
        out = out.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    return out.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _labelled(rows: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    placed = classes.join(roots.withColumnRenamed("node", "class"), "class", "left").select("class", "doc_id", F.coalesce("root", "class").alias("component"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = placed.join(least, "component").select("class", "component", "component_id")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return (
        rows.select("doc_id", "row_key", "n_shingles", "class")
        .join(named, "class", "left")
        .select("doc_id", "row_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "component")
    )


def without_near_duplicates(docs: DataFrame, plan: NearDedup = NearDedup()) -> DataFrame:
    """`docs` with one row of each component: the one of the least id, then of the least row_key.

    Rows without shingles all stay. Of rows that are equal in id and text one stays.
    """
    rows = staged(near_duplicates(docs, plan).select("doc_id", "row_key", "component"))
    linked = rows.where(F.col("component").isNotNull())
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")
    # Written first, so that the join may split a large component over many tasks.
    best = staged(linked.groupBy("component").agg(F.min(order).alias("best")))
    is_best = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("row_key") == F.col("best.row_key"))
    judged = staged(linked.join(best, "component").select("doc_id", "row_key", is_best.alias("stays")))
    dropped = pairs(judged.where("NOT stays"))
    repeated = pairs(judged.where("stays").groupBy("doc_id", "row_key").count().where("count > 1"))
    named = keyed(docs, "text")
    kept = named.join(dropped, same_row(named, dropped), "left_anti")
    return each_once(kept, repeated).select(*docs.columns)
