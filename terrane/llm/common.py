"""Pieces the text operators share: word splitting, text keys, scratch tables, ordered prefix sums, components.

Intermediate results are written as Parquet below the folder that ``spark.checkpoint.dir`` names, so they are
shared by all executors, survive the loss of any of them, and cut the lineage of iterative jobs.
"""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.session import batches_of  # noqa: F401

WHITE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space; none for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone. ``lower`` does that for pure ASCII; other texts take the slower character map."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def text_key(text: Column) -> list[Column]:
    """128 bits of a text as two independently seeded 64-bit hashes, ``k1`` and ``k2``; a null has a key of its own."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


_own_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session; only a local session without one gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        _own_roots[app] = tempfile.mkdtemp(prefix="scratch-")
    return _own_roots[app]


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Frames made in here delete their shuffle files as their query ends; else those stay until the driver collects garbage."""
    was = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, was)


#: Of tables of long rows: Parquet looks at the size of what it holds after each row, not after a hundred.
LONG_ROWS = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


class Scratch:
    """Written tables of one operator call; ``drop`` frees those that the result no longer needs."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def write(self, df: DataFrame, *, sort_by: list[str] | None = None, suffix: str = "", long_rows: bool = False) -> DataFrame:
        self._n += 1
        path = f"{self.base}/{self._n:04d}{suffix}"
        with shuffles_dropped(self.spark):
            (df.sortWithinPartitions(*sort_by) if sort_by else df.select("*")).write.options(compression="zstd", **(LONG_ROWS if long_rows else {})).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            if (path := getattr(t, "scratch_path", None)) is not None:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: A key's slice in ``sliced_join`` holds at least this many rows, and at least one in ``SLICES`` of all.
SLICE_ROWS, SLICES = 20_000, 4_096


def sliced_join(rows: DataFrame, counted: DataFrame, on: list[str], spread: list[str], least: int = SLICE_ROWS, hint: str | None = None) -> DataFrame:
    """``rows`` whose key ``on`` is among ``counted(on..., n)``, a written table of keys and how many of the rows each has.

    A key of many rows is dealt, by a hash of ``spread``, to slices of about one size, and its row of ``counted`` goes to
    each of them, so no key is one task's work. As the counts add up to the total, at most ``SLICES`` keys can have more
    than one slice; they alone are broadcast.
    """
    total = counted.agg(F.sum("n")).first()[0] or 0
    size = max(least, -(-total // SLICES))
    slices = F.ceil(F.col("n") / size).cast("int")
    many = counted.where(F.col("n") > size).select(*on, slices.alias("_slices"))
    keys = counted.select(*on, F.lit(0).alias("_slice")).unionByName(many.select(*on, F.explode(F.sequence(F.lit(1), F.col("_slices") - 1)).alias("_slice")))
    dealt = rows.join(F.broadcast(many), on, "left").withColumn("_slice", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_slices")).cast("int"), F.lit(0)))
    return dealt.drop("_slices").join(keys.hint(hint) if hint else keys, [*on, "_slice"]).drop("_slice")


def running_sum(scratch: Scratch, df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows up to and including this one in the total order ``order``.

    The rows are dealt out by ranges of the order, each range is summed, the (few) range sums give each range its
    start, and only inside a range is there a running window. No task sees more than one range, so neither a hot
    key nor the whole table lands in one place; rows that tie in all of ``order`` share a range.
    """
    parts = scratch.write(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = parts.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("_range", before.alias("_start"))  # one row for each partition of the table
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        parts.join(F.broadcast(starts), "_range")
        .withColumn(out, F.col("_start") + F.sum(value).over(inside))
        .drop("_range", "_start")
    )


def components(scratch: Scratch, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Connected components of ``edges(u, v)``: rows (node, root), root the least node reachable, for linked nodes.

    Alternates the large-star and small-star steps of Kiveris et al. (2014). Each step is an aggregation with
    map-side combining and a join with it, so a node of many links is no bottleneck; each round is written out.
    """

    def stamp(t: DataFrame) -> tuple:
        return tuple(t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = scratch.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = stamp(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        )
        new = scratch.write(small)
        was, seen = seen, stamp(new)
        scratch.drop(now)
        now = new
        if was == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
    out.scratch_path = now.scratch_path
    return out


def free(df: DataFrame, name: str) -> str:
    """``name``, or with underscores in front so that ``df`` has no such column, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def beside(keep: list[str], *new: str) -> list[str]:
    """``keep`` without the names that an operator sets itself, whatever their case."""
    return [c for c in keep if c.lower() not in new]


def masked(docs: DataFrame, keep: list[str], *more) -> DataFrame:
    """``keep`` under the names c0, c1, ... and the columns ``more``, so that no name of the table clashes with theirs."""
    return docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], *more)


SMALL_ROWS, SMALL_BYTES = 200_000, 4 << 20


def small(table: DataFrame) -> bool:
    """Whether a table that ``Scratch.write`` returned may be broadcast: by its rows and by its bytes on disk."""
    spark = table.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
    length = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return length <= SMALL_BYTES and table.count() <= SMALL_ROWS


def without(docs: DataFrame, keys: DataFrame, on: list[Column]) -> DataFrame:
    """Rows of ``docs`` whose ``on`` is not in ``keys``, a written table, which is broadcast if it is ``small``."""
    names = [free(docs, f"key{i}") for i in range(len(on))]
    few = small(keys)
    right = keys.toDF(*[n + "_" for n in names])
    right = F.broadcast(right) if few else right
    left = docs.withColumns(dict(zip(names, on)))
    same = left[names[0]].eqNullSafe(right[names[0] + "_"])
    for n in names[1:]:
        same = same & left[n].eqNullSafe(right[n + "_"])
    return left.join(right, same, "left_anti").drop(*names)


def linked_groups(scratch: Scratch, keyed: DataFrame, texts, verify, likely=lambda pairs: pairs, attrs: tuple[str, ...] = (), close: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Connected groups of the rows of ``keyed(key, id)``, distinct rows of two longs, that share a key and are verified.

    ``texts(ids)`` gives what a comparison needs of some ids, ``verify(pairs, texts)`` takes pairs (u, v) to those
    that are links, and ``likely(pairs)`` may leave some out beforehand, without texts. ``close`` does so within the join of a key's members, by the columns
    ``attrs`` of the texts of one and the same with ``o_`` in front of the other. Returns (node, root) for linked ids, root the least of its group, and the written texts.

    All members of a key are compared with its least member. Then groups are formed, and in keys whose members are
    not yet of one group the least member of each group is compared with all members of the others; last, what is
    still of different groups and was a least member in neither comparison. So no two members of a key go unlinked
    uncompared, none that are connected already are compared, and a large group of copies costs a row for each member.
    """
    dealt = keyed.repartition("key")  # one exchange serves the aggregate and the join
    stars = dealt.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = scratch.write(dealt.join(stars, "key"))
    have = scratch.write(texts(scratch.write(met.select("id").distinct())))

    def links(df: DataFrame) -> DataFrame:
        pairs = df.select(F.least("id", "other").alias("u"), F.greatest("id", "other").alias("v")).distinct()
        return scratch.write(verify(scratch.write(likely(pairs)), have))

    found = [links(met.where("id <> rep").withColumnRenamed("rep", "other"))]

    def labelled(rows: DataFrame) -> DataFrame:
        """``rows(key, id, ...)`` with ``label``, without keys that are of one group."""
        roots = components(scratch, functools.reduce(DataFrame.unionByName, found))
        named = rows.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("root", "id")).drop("root")
        named = scratch.write(named)
        mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
        out = scratch.write(named.join(mixed, "key"))
        scratch.drop(named, roots)
        return out

    def done() -> tuple[DataFrame, DataFrame]:
        roots = components(scratch, functools.reduce(DataFrame.unionByName, found))
        scratch.drop(met, *found)
        return roots, have

    rest = labelled(met.where("n > 2").select("key", "id", "rep"))
    if rest.isEmpty():
        return done()
    known = have.select("id", *attrs)
    near = close if close is not None else F.lit(True)

    def told(rows: DataFrame) -> DataFrame:
        return rows.join(known, "id") if attrs else rows

    def others(rows: DataFrame) -> DataFrame:
        return told(rows).select("key", F.col("id").alias("other"), F.col("label").alias("of"), *[F.col(a).alias(f"o_{a}") for a in attrs])

    heads = scratch.write(rest.groupBy("key", "label").agg(F.min("id").alias("id")))
    # The least member of the key was compared with all.
    pairs = told(rest.where("id <> rep")).join(others(heads.join(rest.select("key", "rep").distinct(), "key").where("id <> rep")), "key").where(F.expr("label <> of") & near)
    found.append(links(pairs))
    tested = heads.select("key", "id")
    last = labelled(rest.where("id <> rep").select("key", "id").join(tested, ["key", "id"], "left_anti"))
    if not last.isEmpty():
        found.append(links(told(last).join(others(last), "key").where(F.expr("label < of") & near)))
    scratch.drop(rest, heads, last)
    return done()
