"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots. Slot i has the golden-ratio point frac((i + 1/2) * phi), which the
cumulative targets map to a source: any stretch of the sequence holds each source close to its
weight. The slots of a source are ranked; slot number r of m takes the r-th of m equal blocks of
words of the source's stream, its documents in a shuffled order, repeated until the target is met.
A block of a source differs from another by one word at most, and its blocks add up to the target.

Ranks and running sums are taken within ranges of the slot number or of the shuffle key and
shifted by the totals of the ranges before, so that a source with a third of all rows is spread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.llm.frames import each_once, keyed, pairs, row_key, same_row
from tastemill.session import staged

WORD = r"[^\x20\x09-\x0D]+"
# Fixed value: the fractional part of the golden ratio.
GOLDEN = 0.6180339887498949
# Ranges of the shuffle key of a source, slots of one range of ranks, copies of a source's row,
# and the least number of cells that points and sources meet in.
KEY_DIGITS, SLOTS_PER_RANGE, SALTS, CELLS = 3, 65_536, 32, 4096


@dataclass(frozen=True)
class MixPlan:
    """`weights` repeat over the sources in code point order, a null source last. The mix has
    `share` times all words; no source gives more than `most` times its own."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    most: int = 2
    block_words: int = 8192
    seed: str = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def sized(docs: DataFrame, plan: MixPlan) -> DataFrame:
    """(doc_id, row_key, source, size, key) of every row; `key` gives the shuffled order."""
    key = F.md5(F.concat(F.lit(plan.seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    same = row_key("text", "source").alias("row_key")
    return docs.select("doc_id", same, F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), key.alias("key"))


def source_targets(rows: DataFrame, plan: MixPlan) -> DataFrame:
    """(sid, source, source_size, weight, target, words, before, slots' first point …) of each source."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = staged(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()))
    sids = _running(placed, F.lit(1), "range", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in plan.weights]), (F.col("sid") % len(plan.weights) + 1).cast("int"))
    table = staged(sids.select(F.col("sum_before").alias("sid"), "source", "source_size").withColumn("weight", weight))
    level = _level(table, plan)
    target = F.least((plan.most * F.col("source_size")).cast("double"), F.lit(level) * F.col("weight"))
    table = table.withColumn("target", target).withColumn("words", F.floor("target").cast("long"))
    return staged(_running(table.withColumn("range", F.floor(F.col("sid") / 10_000)), F.col("words"), "range", F.col("sid").asc()))


def _level(table: DataFrame, plan: MixPlan) -> float:
    """Words per unit of weight for sources below their limit: limits are met one after the other."""
    most, capped = plan.most * F.col("source_size"), F.lit(False)
    everything = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, last = 0.0, -1
    while True:
        n, taken, weight = table.agg(
            F.count(F.when(capped, 1)), F.coalesce(F.sum(F.when(capped, most)), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0))
        ).first()
        if n == last or not weight:
            return level
        last, level = n, (plan.share * everything - taken) / weight
        capped = F.lit(level) * F.col("weight") > most


def _running(rows: DataFrame, amount: Column, part: str, *order: Column, of: tuple[str, ...] = ()) -> DataFrame:
    """`rows` with `sum_before`, the sum of `amount` over the rows before, in ascending `part`, then `order`.

    One window runs over the totals of the parts, another within each part.
    """
    totals = rows.groupBy(*of, part).agg(F.sum(amount).cast("long").alias("part_sum"))
    ahead = Window.partitionBy(*of).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*of, part, F.coalesce(F.sum("part_sum").over(ahead), F.lit(0)).alias("part_before"))
    within = Window.partitionBy(*of, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("inside", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    return out.join(offsets, [*of, part]).withColumn("sum_before", (F.col("inside") + F.col("part_before")).cast("long")).drop("inside", "part_before", part)


def placed_documents(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """`rows` with their source's columns and `offset`, their place in the source's shuffled stream."""
    wide = targets.drop("weight", "sum_before").withColumnRenamed("source", "source_").withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    same = F.col("source").eqNullSafe(F.col("source_")) & (F.col("salt") == F.col("salt_"))
    joined = salted.join(wide, same).drop("source_", "salt", "salt_").withColumn("range", F.substring("key", 1, KEY_DIGITS))
    return _running(joined, F.col("size"), "range", F.col("key").asc(), F.col("doc_id").asc(), F.col("size").asc(), of=("sid",)).withColumnRenamed("sum_before", "offset")


def schedule(targets: DataFrame, plan: MixPlan) -> DataFrame:
    """(slot, sid, rank, slots) in the order of the mix; a source whose target gets no point has one slot at the end."""
    spark = targets.sparkSession
    total, sources = targets.agg(F.coalesce(F.sum("words"), F.lit(0)), F.count("*")).first()
    points, cells = -(-total // plan.block_words), max(CELLS, sources)
    phase = (F.col("id") + 0.5) * F.lit(GOLDEN)
    slots = spark.range(points).select(F.col("id").alias("slot"), ((phase - F.floor(phase)) * float(total)).alias("at"))
    width = F.lit(max(total, 1) / cells)
    ranges = targets.where("words > 0").select("sid", F.col("sum_before").alias("low"), (F.col("sum_before") + F.col("words")).alias("high"))
    cell_of = lambda c: F.floor(c / width).cast("long")
    ranges = ranges.withColumn("cell", F.explode(F.sequence(cell_of(F.col("low")), cell_of(F.col("high")))))
    mapped = slots.withColumn("cell", cell_of(F.col("at"))).join(ranges, "cell").where("at >= low AND at < high").select("slot", "sid")
    bare = targets.where("words > 0").join(mapped.select("sid").distinct(), "sid", "left_anti").select((F.lit(points) + F.col("sid")).alias("slot"), "sid")
    mapped = staged(mapped.union(bare))
    ranked = _running(mapped.withColumn("range", F.floor(F.col("slot") / SLOTS_PER_RANGE)), F.lit(1), "range", F.col("slot").asc(), of=("sid",))
    counts = mapped.groupBy("sid").agg(F.count("*").alias("slots"))
    return ranked.select("slot", "sid", F.col("sum_before").alias("rank")).join(counts, "sid")


def _edge(rank: Column) -> Column:
    """The first word of block `rank` of `slots` equal blocks of `words`; no product exceeds slots squared."""
    size, rest = F.expr("words div slots"), F.expr("words % slots")
    product = rank * rest
    return rank * size + F.floor(product / F.col("slots")).cast("long")


def blocks_of(documents: DataFrame, slots: DataFrame) -> DataFrame:
    """Each document's pieces: (…, pass, rank, start, stop), words of the document, and the slot that takes them."""
    counts = slots.select("sid", "slots").distinct()
    passes = documents.join(counts, "sid").withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1)))).where("pass * source_size < words")
    begin = F.col("offset") + F.col("pass") * F.col("source_size")
    passes = passes.withColumn("begin", begin).withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("words"))).where("begin < end")
    near = lambda c: F.floor(F.col(c) * (F.col("slots") / F.col("words"))).cast("long")
    ranks = F.sequence(F.greatest(near("begin") - 1, F.lit(0)), F.least(near("end") + 1, F.col("slots") - 1))
    pieces = passes.withColumn("rank", F.explode(ranks)).withColumn("from", F.greatest("begin", _edge(F.col("rank")))).withColumn("to", F.least("end", _edge(F.col("rank") + 1)))
    pieces = pieces.where("from < to").select(*documents.columns, "pass", "rank", (F.col("from") - F.col("begin")).alias("start"), (F.col("to") - F.col("begin")).alias("stop"))
    return pieces.join(slots.select("sid", "rank", "slot"), ["sid", "rank"])


def mixed_documents(docs: DataFrame, plan: MixPlan = MixPlan()) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces): every row of `docs` with its size, source_size, target and taken words,
    and the mix itself, one row per slot and document piece (slot, sid, rank, doc_id, pass, start, stop).

    Uses doc_id, text and source. A null text has size 0; rows of size 0 are taken zero times. A
    null source is a source of its own, the last one. Repeated rows are separate documents. An
    empty table, or one without words, gives targets of 0 and no slots. A source's words taken are
    its target without its fraction.
    """
    rows = staged(sized(docs, plan))
    targets = source_targets(rows, plan)
    placed = staged(placed_documents(rows, targets))
    pieces = staged(blocks_of(placed.where("size > 0"), schedule(targets, plan)))
    taken = pieces.groupBy("sid", "offset").agg(F.sum(F.col("stop") - F.col("start")).alias("taken"))
    full = placed.where("size > 0").join(taken, ["sid", "offset"], "left")
    both = full.unionByName(placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    out = both.select("doc_id", "row_key", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "sid", "offset")
    return out, pieces


def _first_words(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the last column's text behind as many words as the column before it says; null: whole."""
    for part in parts:
        texts = []
        for count, text in zip(part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True):
            if count is not None and text is not None:
                stops = islice((m.end() for m in re.finditer(WORD, text)), count - 1, count)
                text = text[: next(stops, len(text))]
            texts.append(text)
        yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=part.schema.names)


def mixed_texts(docs: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:
    """The rows of the mix: a document once for each whole pass over it, and its first words where
    the target ends inside it. Columns as in `docs`; n_chars follows the text.

    Documents that the mix does not take have no row, nor has a text without words.
    """
    documents, _ = mixed_documents(docs, plan)
    whole, rest = F.expr("taken div size"), F.expr("taken % size")
    taken = documents.where("taken > 0").groupBy("doc_id", "row_key").agg(F.sum(whole).alias("__whole"), F.sum(rest).alias("__rest"))
    repeated = staged(pairs(documents.groupBy("doc_id", "row_key").count().where("count > 1")))
    once = each_once(keyed(docs, "text", "source"), repeated)
    taken = staged(pairs(taken, "__whole", "__rest"))
    whole_passes = F.array_repeat(F.lit(None).cast("long"), F.col("__whole").cast("int"))
    last_pass = F.when(F.col("__rest") > 0, F.array("__rest")).otherwise(F.array().cast("array<long>"))
    joined = once.join(taken, same_row(once, taken)).select(*docs.columns, F.explode(F.concat(whole_passes, last_pass)).alias("__cut"), F.col("text").alias("__text"))
    rows = joined.mapInArrow(_first_words, joined.schema).withColumn("text", F.col("__text"))
    if "n_chars" in docs.columns:
        length = F.when(F.col("__cut").isNull(), F.col("n_chars")).otherwise(F.length("text"))
        rows = rows.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
r AS (
  SELECT *, row_number() OVER o AS turn, 2 * source_size / weight AS limit_level, sum(source_size) OVER () AS everything,
    coalesce(sum(2 * source_size) OVER o, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS open_weight
  FROM w WINDOW o AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT coalesce(arg_min((1.5::DOUBLE * everything - capped) / open_weight, turn)
    FILTER (WHERE (1.5::DOUBLE * everything - capped) / open_weight <= limit_level), 0) AS level FROM r),
t AS (
  SELECT source, source_size, least((2 * source_size)::DOUBLE, level * weight) AS target FROM r, l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS words,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(start + size, words) - start) + greatest(0, least(start + size, words - source_size) - start))::BIGINT AS taken
FROM p
"""
