"""Connected components of links between long ids, by alternating large and small stars.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014). Every step is a
minimum per node with map-side combining and a join back, so a node with very many links is summed
before the shuffle and split by the skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.session import staged


def component_roots(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (columns a, b) that is not the least of its component.

    Nodes that have no row are roots themselves. Null ids and self links take no part.
    """
    stars = (
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .distinct()
    )
    before, stars = None, staged(stars)
    while (now := _checksum(stars)) != before:
        before, stars = now, staged(_small_star(_large_star(stars)))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _checksum(stars: DataFrame) -> tuple:
    return tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.min("u"), F.max("v")).first())


def _large_star(stars: DataFrame) -> DataFrame:
    both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    least = stars.groupBy("u").agg(F.min("v").alias("m"))
    moved = stars.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
