"""Benchmark decontamination by a prefix-filtered set join.

Items and documents are word sequences; an item's windows are its runs of ``width`` words (one shorter window for a
shorter item). The tokens of the join are shingles of up to three words. Since a contained window contains all its
shingles, the one shingle that is rarest over all documents is a sufficient prefix: windows are joined to documents
on it alone, the offset of that shingle gives the only place where the window can lie (positional bound), places
that stick out of the document go (length bound), and what is left is verified shingle by shingle, on the words
themselves, position by position. Documents are read once for shingles and once for word counts; only shingles that
occur in some item are ever shuffled.

The item shingles are broadcast if they are ``small`` in rows and bytes; beyond, the same join is a shuffle.

Cases: a null or wordless text has no windows and no words. Equal texts share one result. Null and repeated ids of
documents are kept as rows; items without an id count as one item, which has no name in the list of ids. Very long
texts are exploded word by word. With an empty benchmark nothing is hit; no documents give none. Only doc_id, item_id
and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii, small, text_key

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3


def item_words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def shingles(df: DataFrame, width: int, keep: list[str]) -> DataFrame:
    """(keep..., pos, shingle): every run of ``width`` words of ``w``, joined by a space."""
    n = F.greatest(F.size("w") - (width - 1), F.lit(0))
    zipped = F.arrays_zip(*[F.slice("w", k + 1, n).alias(f"w{k}") for k in range(width)]) if width > 1 else F.transform("w", lambda x: F.struct(x.alias("w0")))
    one = df.select(*keep, F.posexplode(zipped).alias("pos", "s"))
    return one.select(*keep, "pos", F.concat_ws(" ", *[F.col(f"s.w{k}") for k in range(width)]).alias("shingle"))


def hits(spark: SparkSession, docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """(k1, k2, item_id, start, length): every verified occurrence of an item's window in a text, by text key."""
    scratch = Scratch(spark, "decontaminate")
    # Windows, each with its words; equal windows of several items are one window.
    listed = items.select("item_id", item_words(F.col("text")).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    length = F.least(F.col("n"), F.lit(width))
    places = F.transform(F.sequence(F.lit(1), F.col("n") - length + 1), lambda i: F.slice("w", i, length))
    owners = scratch.write(listed.select("item_id", F.explode(places).alias("w")).distinct().withColumn("window", F.array_join("w", " ")))
    windows = owners.select("window", "w").distinct()
    sizes = [r["k"] for r in windows.select(F.least(F.size("w"), F.lit(SHINGLE)).alias("k")).distinct().collect()]  # at most three values
    parts = None
    for k in sizes:
        own = shingles(windows.where(F.least(F.size("w"), F.lit(SHINGLE)) == k).withColumn("length", F.size("w")), k, ["window", "length"]).withColumn("k", F.lit(k))
        parts = own if parts is None else parts.unionByName(own)
    if parts is None:
        return spark.createDataFrame([], "k1 long, k2 long, item_id long, start int, length int")
    parts = scratch.write(parts)

    tokens = scratch.write(parts.select("shingle", "k").distinct())
    few = small(tokens)
    texts = docs.select(*text_key(F.col("text")), item_words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    found = None
    for k in sizes:
        want = tokens.where(F.col("k") == k).select("shingle")
        own = shingles(texts, k, ["k1", "k2", "n"]).join(F.broadcast(want) if few else want, "shingle")
        found = own if found is None else found.unionByName(own)
    counted = found.groupBy("k1", "k2", "n", "pos", "shingle").agg(F.count(F.lit(1)).alias("copies"))
    found = scratch.write(counted)

    rarity = found.groupBy("shingle").agg(F.sum("copies").alias("f"))
    # A shingle that no document has rules its windows out.
    ordered = parts.join(rarity, "shingle", "left")
    first = ordered.groupBy("window", "length").agg(
        F.min(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "shingle", "pos")).alias("p"), F.count(F.lit(1)).alias("need")
    ).where("p.f > 0").select("window", "length", "need", F.col("p.shingle").alias("shingle"), F.col("p.pos").alias("offset"))
    start = F.col("pos") - F.col("offset")
    candidates = found.join(first, "shingle").where((start >= 0) & (start + F.col("length") <= F.col("n"))).select("k1", "k2", start.alias("start"), "window", "length", "need")
    wanted = candidates.join(parts.select("window", "shingle", F.col("pos").alias("at")), "window").select(
        "k1", "k2", "start", "window", "length", "need", "shingle", (F.col("start") + F.col("at")).alias("pos")
    )
    verified = wanted.join(found.select("k1", "k2", "pos", "shingle"), ["k1", "k2", "pos", "shingle"]).groupBy(
        "k1", "k2", "start", "window", "length", "need"
    ).agg(F.count(F.lit(1)).alias("have")).where("have = need")
    return scratch.write(verified.select("k1", "k2", "window", "start", "length")).join(owners.select("item_id", "window"), "window").select("k1", "k2", "item_id", "start", "length")


def contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """(k1, k2, n_hit, n_items, item_ids) of each text that holds some window of some item."""
    found = hits(spark, docs, items, width)
    reach = found.groupBy("k1", "k2", "start").agg(F.max("length").alias("length"))
    covered = reach.select("k1", "k2", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("pos"))
    words = covered.distinct().groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_hit"))
    names = found.select("k1", "k2", F.col("item_id").cast("string").alias("i")).distinct().groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_list("i")).alias("item_ids"))
    return words.join(names, ["k1", "k2"])


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    marks = contaminated(spark, docs, items)
    k1, k2 = text_key(F.col("text"))
    base = docs.select("doc_id", k1, k2, F.size(item_words(F.col("text"))).cast("long").alias("n_words"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    ids = F.coalesce(F.col("item_ids"), F.array().cast("array<string>"))
    return base.join(marks, ["k1", "k2"], "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
