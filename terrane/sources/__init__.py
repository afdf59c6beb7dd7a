"""Inputs: points as ``(id, x array<double>)``, pair distances as ``(i, j, d)``, sparse points as ``(id, x map<int,double>)``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def dense(df: DataFrame, id_col: str, columns: list[str] | None = None, vector: str | None = None) -> DataFrame:
    """Points from numeric columns, or from one array column."""
    x = F.col(vector).cast("array<double>") if vector else F.array(*[F.col(c).cast("double") for c in columns])
    return df.select(F.col(id_col).cast("bigint").alias("id"), x.alias("x"))


def from_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Points of CSV files with a header and numeric columns; ids are the rows' positions from 1, files in order of their paths.

    A piece of a file is one task's, so positions within pieces come from the reading order, and the pieces' counts, a row
    each, give every piece its start.
    """
    df = spark.read.csv(path, header=True, inferSchema=True)
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in columns or df.columns])
    rows = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), x.alias("x"), F.monotonically_increasing_id().alias("read"))
    sums = rows.groupBy("file", "at").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)  # a row a piece
    starts = sums.select("file", "at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("file", "at").orderBy("read"))
    return rows.withColumn("place", place).join(starts, ["file", "at"]).select((F.col("start") + F.col("place")).alias("id"), "x")


def from_distances(df: DataFrame, i: str = "i", j: str = "j", d: str = "d") -> DataFrame:
    """(i, j, sqdist) of a table of distances, which are squared on reading."""
    return df.select(F.col(i).alias("i"), F.col(j).alias("j"), (F.col(d).cast("double") * F.col(d).cast("double")).alias("sqdist"))


def from_distance_rows(df: DataFrame, id_col: str, row: str) -> DataFrame:
    """(i, j, sqdist) of a matrix stored as one array a row; ``j`` counts from 0."""
    long = df.select(F.col(id_col).alias("i"), F.posexplode(row).alias("j", "d"))
    return from_distances(long.withColumn("j", F.col("j").cast("bigint")))


def sparse(df: DataFrame, id_col: str, packed: str) -> DataFrame:
    """Sparse points of packed rows k1, v1, k2, v2, ...: keys are positive, and a key of 0 ends the row."""
    n = (F.size(packed) / 2).cast("int")
    keys = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(packed, 2 * i).cast("int"))
    ends = F.array_position(F.transform(keys, lambda k: (k <= 0).cast("int")), 1)
    used = F.when(ends > 0, ends.cast("int") - 1).otherwise(n)
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(used - 1, F.lit(0))), lambda i: F.struct(F.get(packed, 2 * i).cast("int"), F.get(packed, 2 * i + 1).cast("double")))
    empty = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<double>"))
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.when((n > 0) & (used > 0), F.map_from_entries(pairs)).otherwise(empty).alias("x"))


def long_form(points: DataFrame) -> DataFrame:
    """(id, dim, v), ``dim`` from 0."""
    return points.select("id", F.posexplode("x").alias("dim", "v"))


def shape(points: DataFrame) -> tuple[int, int]:
    """Points and features."""
    r = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("m")).first()
    return r["n"], r["m"] or 0


def duplicated(points: DataFrame) -> DataFrame:
    """Points whose vector occurs more than once, which the mapping methods do not allow."""
    return points.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n > 1").select("id", "n")


def draw(*parts: Column) -> Column:
    """A uniform number from the md5 of its parts, the same in every engine."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def normal(*parts: Column) -> Column:
    """A standard normal number from two draws, by the polar form of two uniform ones."""
    return F.sqrt(-2 * F.log(draw(F.lit("r"), *parts))) * F.cos(2 * np.pi * draw(F.lit("a"), *parts))


def example(spark: SparkSession, n: int = 5000, dims: int = 4, components: int = 16, seed: int = 1, ids: DataFrame | None = None) -> DataFrame:
    """A seeded Gaussian mixture: id, x, label, for ids 0 to n - 1 or those of ``ids(id)``.

    Centres have a deviation of 10, components one of 0.5 to 2. Every number hangs on the seed and the names of what it is
    for, so rows are made where they are, in any order and number.
    """
    s, i, label = F.lit(str(seed)), F.col("id").cast("string"), F.col("label").cast("string")
    rows = (spark.range(n) if ids is None else ids.select(F.col("id").cast("bigint").alias("id"))).withColumn("label", F.floor(draw(s, F.lit("label"), i) * components).cast("int"))
    spread = 0.5 + 1.5 * draw(s, F.lit("spread"), label)
    x = [10 * normal(s, F.lit("centre"), label, F.lit(str(d))) + spread * normal(s, F.lit("x"), i, F.lit(str(d))) for d in range(dims)]
    return rows.select("id", F.array(*x).alias("x"), "label")


def save(parts: dict[str, DataFrame], path: str) -> None:
    """Each part as Parquet below ``path``."""
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
