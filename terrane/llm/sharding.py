"""Sharding by balanced label propagation.

Documents of a link group should share a shard, and shards should hold nearly equal bytes. Linked documents start
in shards drawn by hash; in each round every group votes, over the present shards of its members, for the shard that
holds most of them, and members elsewhere move there, as far as the shard's quota (an even share of all bytes)
reaches, those with the largest vote first. A round is one aggregation by (group, shard), one join and one running
sum. What finds no room, and all documents without links, then fill the shards up to even sizes, in an order that
keeps groups together, large documents before small ones.

Cases: a null text counts as no bytes (size 8, checksum 0) and, like an empty one, links with its equals. Equal rows
count one by one, and as they are alike it makes no difference which of them goes where: the result hangs on ids and
texts, not on the order or the files of the input. A group larger than a shard spreads over as many shards as it needs.
Of very long texts only hashes and sizes are kept. An empty table gives none. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, running_sum, text_key


def propagate(scratch: Scratch, linked: DataFrame, shards: int, quota: float, rounds: int) -> DataFrame:
    """``linked(row, doc_id, g, g2, size)`` with a ``shard``, null where the quota left no room."""
    state = scratch.write(linked.withColumn("shard", F.pmod(F.xxhash64("doc_id", "g", "g2"), F.lit(shards)).cast("int")))
    for _ in range(rounds):
        votes = state.where("shard is not null").groupBy("g", "g2", "shard").agg(F.count(F.lit(1)).alias("vote"))
        best = votes.groupBy("g", "g2").agg(F.max_by(F.struct("shard", "vote"), F.struct("vote", F.xxhash64("g", "shard"))).alias("b"))
        asked = state.join(best, ["g", "g2"]).select(
            "row", "doc_id", "g", "g2", "size", F.col("shard").alias("was"), F.col("b.shard").alias("to"), F.col("b.vote").alias("vote")
        ).withColumn("less", -F.col("vote")).withColumn("moves", ~F.col("was").eqNullSafe(F.col("to")))
        order = ["to", "moves", "less", "g", "g2", "doc_id", "row"]
        placed = running_sum(scratch, asked, order, "size", "upto")
        loads = asked.groupBy("to").agg(F.sum("size").alias("load"))  # one row a shard
        before = F.coalesce(F.sum("load").over(Window.orderBy("to").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = loads.select("to", before.alias("start"))
        placed = placed.join(F.broadcast(starts), "to").withColumn("fits", F.col("upto") - F.col("start") <= quota)
        new = scratch.write(placed.select("row", "doc_id", "g", "g2", "size", F.when(F.col("fits"), F.col("to")).alias("shard"), "moves"))
        moved = new.where("moves and shard is not null").limit(1).count()
        scratch.drop(state)
        state = new.drop("moves")
        state.scratch_path = new.scratch_path
        if not moved:
            break
    return state


def fill(scratch: Scratch, free: DataFrame, loads: list[float], quota: float) -> DataFrame:
    """``free(row, doc_id, g, g2, size)`` with a ``shard`` that levels ``loads``; sizes in tiers, so small ones level last."""
    shards = len(loads)
    tier = F.when(F.col("size") > quota / 40, 0).when(F.col("size") > quota / 400, 1).otherwise(2)
    summed = scratch.write(running_sum(scratch, free.withColumn("tier", tier), ["tier", "g", "g2", "doc_id", "row"], "size", "upto"))
    sums = {r["tier"]: r["n"] for r in summed.groupBy("tier").agg(F.sum("size").alias("n")).collect()}
    parts, start = [], 0
    for t in range(3):
        n = sums.get(t, 0)
        if not n:
            continue
        room = [max(0.0, quota - x) for x in loads]
        scale = n / (sum(room) or 1.0)
        edges, at = [], float(start)
        for x in room:
            at += x * scale
            edges.append(at)
        bounds = F.array(*[F.lit(x) for x in edges[:-1]])
        middle = F.col("upto") - F.col("size") / 2
        part = summed.where(F.col("tier") == t).select("row", "size", F.size(F.filter(bounds, lambda b: b <= middle)).alias("shard"))
        parts.append(part)
        if t < 2:
            for r in part.groupBy("shard").agg(F.sum("size").alias("n")).collect():  # one row a shard
                loads[r["shard"]] += r["n"]
        start += n
    out = parts[0] if parts else summed.select("row", "size", F.lit(0).alias("shard"))
    for p in parts[1:]:
        out = out.unionByName(p)
    assert shards == len(loads)
    return out.select("row", "shard")


def shard(spark: SparkSession, docs: DataFrame, shards: int = 24, rounds: int = 4) -> DataFrame:
    """All rows of ``docs`` with row, size, text_crc32, shard and slot; documents of equal text are linked."""
    scratch = Scratch(spark, "shard")
    text = F.col("text")
    table = scratch.write(docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", *[k.alias(n) for k, n in zip(text_key(text), ("g", "g2"))],
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("text_crc32"),
    ))
    total = table.agg(F.sum("size")).first()[0] or 0
    quota = total / shards
    groups = table.groupBy("g", "g2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g", "g2")
    rows = table.select("row", "doc_id", "g", "g2", "size")
    state = propagate(scratch, rows.join(groups, ["g", "g2"]), shards, quota, rounds)
    placed = state.where("shard is not null").select("row", "shard")
    loads = [0.0] * shards
    for r in state.where("shard is not null").groupBy("shard").agg(F.sum("size").alias("n")).collect():  # one row a shard
        loads[r["shard"]] = float(r["n"])
    free = rows.join(placed.select("row"), "row", "left_anti")
    filled = fill(scratch, free, loads, quota)
    all_placed = scratch.write(table.join(placed.unionByName(filled), "row").select("row", "doc_id", "g", "g2", "size", "text_crc32", "shard"))
    counts = all_placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", before.alias("first"))  # one row a shard
    ranked = running_sum(scratch, all_placed.withColumn("one", F.lit(1).cast("long")), ["shard", "doc_id", "g", "g2", "row"], "one", "upto")
    return ranked.join(F.broadcast(starts), "shard").select(
        "row", "doc_id", "size", "text_crc32", "shard", (F.col("upto") - 1 - F.col("first")).cast("long").alias("slot")
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(spark, docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
