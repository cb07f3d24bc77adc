"""Connected components over links, by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Each round is a minimum by
node (aggregated before the shuffle) and an equi-join, so a node with very many links is split by
the skew join; the links go to a written table in the shared folder between rounds, never to the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star round: links (a, b) with a > b, distinct."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    if not large:
        both = both.filter("u > v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return out.filter("a <> b").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """links (a, b: long, a <> b) -> (node, label): label is the least node that can be reached.

    Nodes without a link are not listed. An empty table of links gives an empty table.
    """
    spark = links.sparkSession
    tidy = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now = materialize(tidy, name)
    seen = None
    while True:
        after = materialize(_star(_star(now, large=True), large=False), name)
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    labelled = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return labelled.union(roots)
