"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.session import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(node, root) of ``links(a, b)``: for each linked node the least node it reaches.

    Rounds of large and small stars (Kiveris et al. 2014): every node hands its greater neighbours, then its lesser ones,
    to the least it knows of. That takes a number of rounds in the logarithm of the longest way, and the loop ends only when
    nothing moves. Each step is an aggregation and a join by node, so a node of many links is pre-aggregated.
    """

    def drawn(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def least(rows: DataFrame) -> DataFrame:
        return rows.groupBy("a").agg(F.min("b").alias("m"))

    def turned(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("b").alias("a"), F.col("a").alias("b"))

    now = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was, seen = None, drawn(now)
    while was != seen:
        both = now.unionByName(turned(now))
        star = both.join(least(both).select("a", F.least("a", "m").alias("m")), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = least(star)
        rest = star.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = checkpointed(rest.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        was, seen = seen, drawn(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
