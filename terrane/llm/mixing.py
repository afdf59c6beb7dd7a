"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words; every document an expected number of copies ``e`` whose words add up to
it. The whole part of ``e`` is allocated as certain copies, and the fraction is the inclusion probability ``p`` of
one copy more: documents are ranked by ``(u / (1 - u)) / (p / (1 - p))``, ``u`` a uniform draw that hangs on
``doc_id`` alone, and taken in that order until the source's remaining words are used up (Rosen's Pareto sampling,
with the fixed size counted in words, so no source drifts from its target by chance).

Long documents get smaller expected shares: ``e`` is in proportion to ``floor(5040 / bits)``, ``bits`` the binary
digits of the size, up to the cap, which makes the probabilities unequal inside a source as well.

Cases: a null or blank text has size 0 and takes nothing. A null source is a source of its own, last in order. Rows
that share a ``doc_id`` share a draw, so of equal rows all or none are taken. An empty table gives an empty table.
Columns besides the named ones, whatever they are called, do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, running_sum, words

WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target): ``share`` of all sizes, split by weight, no target above ``cap`` times its source.

    Water filling in closed form: with sources in rising order of ``cap * size / weight``, the first k are capped and
    the rest share what is left by weight; k is the first at which the next source stays below its cap. Works on one
    row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("weight", F.element_at(listed, (F.row_number().over(place) - 1) % len(weights) + 1))
    rise = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({
        "rest": F.lit(share) * F.sum("source_size").over(everything) - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "rest_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    per = per.withColumn("level", F.col("rest") / F.col("rest_weight"))
    fits = F.col("level") * F.col("weight") <= F.lit(cap) * F.col("source_size")
    level = F.min_by(F.when(fits, F.col("level")), F.when(fits, F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source"))).over(everything)
    target = F.least(F.lit(cap) * F.col("source_size"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return per.select("source", "source_size", target.cast("double").alias("target"))


def _expected(cap: int):
    """Expected copies, their whole part, the inclusion probability and the Pareto rank of ``(doc_id, size, f)``."""
    w = F.floor(F.lit(5040) / F.length(F.bin("size"))).cast("long")
    e = F.when(F.col("size") > 0, F.least(F.lit(float(cap)), F.coalesce(F.col("f") * w, F.lit(float(cap))))).otherwise(F.lit(0.0))
    return w, e


def with_rank(df: DataFrame, cap: int, seed: str) -> DataFrame:
    """``df(doc_id, size, f)`` with ``whole`` (certain copies) and ``rank`` (null: no copy beyond those)."""
    name = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    draw = (F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    df = df.withColumn("e", _expected(cap)[1]).withColumn("whole", F.floor("e").cast("long")).withColumn("u", draw)
    p = F.col("e") - F.col("whole")
    return df.withColumn("rank", F.when(p > 0, (F.col("u") / (1 - F.col("u"))) / (p / (1 - p)))).drop("e", "u")


def sizes_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))


def mixing_plan(scratch: Scratch, sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = 2, seed: str = "mix") -> DataFrame:
    """One row a source: source_size, target, the factor ``f`` of its expected copies, and the last place it takes.

    That is all a mix needs: any row can be judged by its source's row alone.
    """
    targets = source_targets(sizes, weights, share, float(cap)).withColumnRenamed("source", "source_")
    # A source's factor f solves sum(min(cap, f * w) * size) = target over its size classes, by water filling.
    classes = sizes.withColumn("w", _expected(cap)[0]).groupBy("source", "w").agg(F.sum("size").alias("n"))
    down = Window.partitionBy("source").orderBy(F.desc("w"))  # a source has at most 64 classes
    above, below = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(0, Window.unboundedFollowing)
    classes = classes.join(targets, F.col("source").eqNullSafe(F.col("source_"))).drop("source_").withColumns({
        "left": F.col("target") - F.lit(float(cap)) * F.coalesce(F.sum("n").over(above), F.lit(0)),
        "wn": F.sum(F.col("w") * F.col("n")).over(below),
    }).withColumn("f", F.when(F.col("wn") > 0, F.col("left") / F.col("wn")))
    good = F.col("f") * F.col("w") <= F.lit(float(cap))
    factors = scratch.write(classes.groupBy("source", "source_size", "target").agg(F.max_by(F.when(good, F.col("f")), F.when(good, F.col("w"))).alias("f")))

    named = factors.withColumnRenamed("source", "source_")
    ranked = with_rank(sizes.join(named, F.col("source").eqNullSafe(F.col("source_"))).drop("source_"), cap, seed)
    sure = ranked.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("sure"))
    # Rows of one draw and doc_id are one place in the order, taken or left together.
    places = ranked.where("rank is not null").groupBy("source", "rank", "doc_id").agg(F.sum("size").alias("extra"))
    places = places.withColumns({"no_source": F.col("source").isNull(), "no_id": F.col("doc_id").isNull()})
    order = ["no_source", "source", "rank", "no_id", "doc_id"]
    summed = scratch.write(running_sum(scratch, places, order, "extra", "upto"))
    starts = summed.groupBy("source").agg(F.min(F.col("upto") - F.col("extra")).alias("start"))
    per = factors
    for other in (sure, starts):
        other = other.withColumnRenamed("source", "source_")
        per = per.join(other, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")
    per = scratch.write(per.withColumn("room", F.col("target") - F.coalesce("sure", F.lit(0)) + F.coalesce("start", F.lit(0))))
    room = per.select(F.col("source").alias("source_"), "room")
    taken = summed.join(room, F.col("source").eqNullSafe(F.col("source_"))).where(F.col("upto") - F.col("extra") / 2 <= F.col("room"))
    last = taken.groupBy(F.col("source").alias("source_")).agg(F.max("rank").alias("last_rank"), F.max_by(F.struct("no_id", "doc_id"), F.struct("rank", "no_id", "doc_id")).alias("last_id"))
    per = per.join(last, F.col("source").eqNullSafe(F.col("source_")), "left")
    return scratch.write(per.select("source", "source_size", "target", "f", "last_rank", "last_id"))


def apply_plan(df: DataFrame, plan: DataFrame, cap: int = 2, seed: str = "mix") -> DataFrame:
    """``df(doc_id, source, size, ...)`` with source_size, target and ``copies``."""
    plan = plan.withColumnRenamed("source", "source_")
    df = with_rank(df.join(plan, F.col("source").eqNullSafe(F.col("source_"))), cap, seed)
    here, last = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id"), F.col("last_id")
    taken = (F.col("rank") < F.col("last_rank")) | ((F.col("rank") == F.col("last_rank")) & (here <= last))
    copies = F.col("whole") + F.when(taken, F.lit(1)).otherwise(F.lit(0))
    return df.withColumn("copies", copies).drop("source_", "f", "whole", "rank", "last_rank", "last_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "mix")
    sizes = scratch.write(sizes_of(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    mixed = apply_plan(sizes, mixing_plan(scratch, sizes))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
