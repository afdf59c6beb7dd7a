"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has a bit for each of 64 majority votes over the XXH64 values of a text's word shingles. Fingerprints
that differ in at most ``radius`` bits are linked. Following Pagh (2016), every bit position i gets a vector c(i) of
``radius + 1`` bits, none zero, dealt out evenly; for each non-zero vector v the mask m(v) keeps the bits with
<c(i), v> = 1. For any ``radius`` positions some v is orthogonal to all their vectors, so its mask leaves them out:
two fingerprints within the radius agree under at least one of the 2^(radius+1) - 1 masks, without exception.

Distinct fingerprints meet in the buckets (mask, masked value). Buckets of up to ``bucket`` members compare all
members. Fuller ones are not capped: each of their members is sent to itself and to every value one bit away,
and all who meet there are linked to the least of them - a chain of links through shared mid-points that joins
exactly those that pairs within two bits would join, with rows in proportion to the members.

Cases: a null or wordless text has fingerprint zero and links like any other. Equal rows are members one by one. A
component whose doc_ids are all null has a null id. Very long texts are hashed whole, in blocks. An empty table gives
none. Kept columns may have any name; those called fp or component_id are set anew.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, beside, components, free, linked_groups, masked, small, text_key, without
from .wordhash import Words, blocks, mix

BITS = 64
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, width: int = 3, block: int = 1 << 16) -> int:
    """The unsigned fingerprint of one text; votes are counted ``block`` shingles at a time."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - width + 1)
    last = ends[width - 1 :] if len(parts) >= width else ends[-1:]
    digest = functools.partial(xxhash.xxh64_digest, seed=42)
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, block):
        some = b"".join([digest(joined[a:b]) for a, b in zip(starts[at : at + block].tolist(), last[at : at + block].tolist())])
        bits = np.unpackbits(np.frombuffer(some, dtype=np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str], width: int = 3) -> DataFrame:
    """``keep`` and ``fp``, the fingerprint as a signed long; texts stream through in Arrow batches."""

    source = masked(docs, keep, F.col("text").alias("text"))
    own = source.columns[:-1]

    def run(batches):
        for b in batches:
            values = np.array([fingerprint(t.as_py(), width) for t in b.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in own] + [pa.array(values, pa.int64())], names=[*own, "fp"])

    return source.mapInArrow(run, source.select(*own).withColumn("fp", F.lit(0).cast("long")).schema).toDF(*keep, "fp")


@functools.cache
def masks(radius: int) -> list[int]:
    """The covering masks, as signed longs, for a radius of 1 to 6.

    The masks are the words of a linear code of length 64. Up to radius 5 it repeats the simplex code; at 6 it is the
    first-order Reed-Muller code. Either way every mask keeps at least half of the bits, so buckets stay fine.
    """
    if not 1 <= radius <= 6:
        raise ValueError("radius must be 1 to 6")
    size = 1 << (radius + 1)
    vectors = [i % (size - 1) + 1 if radius < 6 else BITS + i for i in range(BITS)]
    out = []
    for v in range(1, size):
        m = sum(1 << i for i, c in enumerate(vectors) if (c & v).bit_count() & 1)
        out.append(m - (1 << BITS) if m >> (BITS - 1) else m)
    return out


def links(scratch: Scratch, fps: DataFrame, radius: int = 2, bucket: int = 64) -> DataFrame:
    """(u, v) between distinct ``fp`` such that the connected components are those of all pairs within ``radius``."""
    if radius > 2:
        raise ValueError("buckets beyond the bound are resolved through mid-points one bit away: radius is at most 2")
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks(radius)])).alias("t", "key"))
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = scratch.write(keyed.join(sizes, ["t", "key"]))
    few = met.where(F.col("n") <= bucket)
    other = few.select("t", "key", F.col("fp").alias("gp"))
    near = few.join(other, ["t", "key"]).where(F.col("fp") < F.col("gp")).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("gp"))) <= radius)
    pairs = near.select(F.col("fp").alias("u"), F.col("gp").alias("v")).distinct()
    many = met.where(F.col("n") > bucket).select("fp").distinct()
    reach = [0, *[1 << i if i < BITS - 1 else -(1 << i) for i in range(BITS)]]
    if radius == 2:  # within two bits of each other: some value is within one bit of both
        places = many.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(x)) for x in reach])).alias("at"))
        least = places.groupBy("at").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
        stars = places.join(least, "at").where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()
    else:  # one bit: the neighbour itself is among the values one bit away
        places = many.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(x)) for x in reach[1:]])).alias("at"))
        stars = places.join(many.select(F.col("fp").alias("at")), "at").select(F.col("fp").alias("u"), F.col("at").alias("v"))
    return pairs.unionByName(stars)


def near_duplicates(spark: SparkSession, docs: DataFrame, keep: list[str], width: int = 3, radius: int = 2) -> DataFrame:
    """``keep``, fp and component_id, the smallest doc_id in the component. ``keep`` must hold doc_id."""
    scratch, keep = Scratch(spark, "simhash"), beside(keep, "fp", "component_id")
    table = scratch.write(fingerprints(docs, keep, width))
    distinct = scratch.write(table.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(scratch, links(scratch, distinct.select("fp"), radius))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    label = named.join(least, "root").select("fp", "component_id")
    return table.join(label, "fp")


def jaccard(a: str | None, b: str | None, width: int) -> float:
    """Similarity of the sets of word shingles; a text of fewer words is one shingle, one of none has none."""
    sets = []
    for t in (a, b):
        w = (t or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    both = len(sets[0] & sets[1])
    return both / (len(sets[0]) + len(sets[1]) - both) if both else float(not sets[0] and not sets[1])


VALUES, BANDS, ROWS, NEAR = 128, 40, 8, 2
#: One bit of each of 1024 other MinHash values, as sixteen longs; texts of similarity 0.8 differ in 102, with a deviation of 10.
BIT_COLUMNS, MOST_BITS = tuple(f"s{i}" for i in range(16)), 134


@functools.cache
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors and addends of the MinHash values, and the values each band takes."""
    rng = np.random.default_rng(42)
    factors, addends = rng.integers(0, 1 << 63, (2, VALUES), dtype=np.uint64)
    return factors | np.uint64(1), addends, np.array([rng.choice(VALUES, ROWS, replace=False) for _ in range(BANDS)])


def sketch(shingles: np.ndarray) -> tuple[int, np.ndarray]:
    """SimHash fingerprint and MinHash values of a text from the hashes of its shingles."""
    factors, addends, _ = _draws()
    votes, least = np.zeros(BITS, dtype=np.int64), np.full(VALUES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        some = shingles[at : at + 4096]
        votes += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        least = np.minimum(least, (some[:, None] * factors + addends).min(axis=0))
    return int.from_bytes(np.packbits(2 * votes > len(shingles)).tobytes(), "big"), least


@functools.cache
def _probes() -> tuple[np.ndarray, np.ndarray]:
    factors, addends = np.random.default_rng(43).integers(0, 1 << 63, (2, 64 * len(BIT_COLUMNS)), dtype=np.uint64)
    return factors | np.uint64(1), addends


def near_bits(shingles: np.ndarray) -> list[int]:
    """One bit of each of many MinHash values."""
    factors, addends = _probes()
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 512):
        least = np.minimum(least, (shingles[at : at + 512, None] * factors + addends).min(axis=0))
    return np.packbits((mix(least) & np.uint64(1)).astype(np.uint8)).view(np.int64).tolist()


def near_keys(shingles: np.ndarray, radius: int = NEAR) -> np.ndarray:
    """The buckets of a text from the hashes of its shingles.

    First those of its fingerprint under the covering masks, in which any two texts within ``radius`` bits meet; then
    ``BANDS`` of ``ROWS`` MinHash values each, since texts of similarity 0.8 are mostly more bits apart than that.
    """
    bands, (fp, least) = _draws()[2], sketch(shingles)
    keys = [xxhash.xxh64_intdigest((fp & m & (1 << BITS) - 1).to_bytes(8, "big"), seed=1000 + t) for t, m in enumerate(masks(radius))]
    keys += [xxhash.xxh64_intdigest(least[b].tobytes(), seed=i) for i, b in enumerate(bands)]
    return np.array(keys, dtype=np.uint64).view(np.int64)


def shingle_hashes(texts: list[str | None], width: int):
    """For each text the hashes of its word shingles; of fewer words the whole, of none a zero."""
    rows = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    for i, j in blocks(rows):
        w = Words(rows[i:j])
        runs = {n: w.runs(n)[0] for n in range(1, width + 1)}
        for a, b in zip(w.first.tolist(), [*w.first[1:].tolist(), len(w.h)]):
            n = min(b - a, width)
            yield runs[n][a : b - n + 1] if n else np.zeros(1, np.uint64)


def hashed(docs: DataFrame, keep: list[str], width: int, of, name: str) -> DataFrame:
    """``keep`` and ``name``, the longs that ``of`` makes of a text's shingles; texts stream through in Arrow batches."""
    source = docs.select(*dict.fromkeys([*keep, "text"]))

    def run(batches):
        for b in batches:
            longs = [list(map(int, of(h))) for h in shingle_hashes(b.column("text").to_pylist(), width)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(longs, pa.list_(pa.int64()))], names=[*keep, name])

    return source.mapInArrow(run, source.select(*keep).withColumn(name, F.array().cast("array<long>")).schema)


def similar_groups(spark: SparkSession, docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, k1, k2, n, first), written: rows by id and text, and whether they are the first of their group of near copies.

    Texts are compared if they share a bucket of ``near_keys`` (by calculation one pair in some 200 at 0.8 shares none,
    fewer above), are not too far apart in ``near_bits`` (one in some 2 000 at 0.8 is) and are linked if their sets of word shingles have the Jaccard similarity asked for. Equal texts are one
    node, and texts without words, null or not, are alike. A node goes by the first 64 bits of its key; should two texts
    share those, the second is left alone.
    """
    scratch = Scratch(spark, "similar")
    keyed = docs.select("doc_id", "text", *text_key(F.col("text")))
    nodes = hashed(keyed, ["k1"], width, near_keys, "keys").groupBy(F.col("k1").alias("id")).agg(F.min("keys").alias("keys"))
    met = nodes.select("id", F.explode(F.array_distinct("keys")).alias("key"))

    def texts(ids: DataFrame) -> DataFrame:
        some = keyed.select(F.col("k1").alias("id"), "k2", "text").join(F.broadcast(ids) if small(ids) else ids, "id", "left_semi")
        chosen = some.groupBy("id").agg(F.min(F.struct("k2", "text")).alias("t")).select("id", "t.k2", "t.text")
        told = hashed(chosen, ["id", "k2", "text"], width, lambda h: [*near_bits(h), *near_keys(h)], "longs")
        n = len(BIT_COLUMNS)
        return told.select("id", "k2", "text", *[F.col("longs")[i].alias(c) for i, c in enumerate(BIT_COLUMNS)], F.slice("longs", n + 1, 1 << 20).alias("keys"))

    def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("id").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("id").alias("v"), F.col("text").alias("b")), "v")

        def run(batches):
            for x in batches:
                ok = pa.array([jaccard(a.as_py(), b.as_py(), width) >= similarity for a, b in zip(x.column("a"), x.column("b"))], pa.bool_())
                yield x.select(["u", "v"]).filter(ok)

        return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")

    apart = functools.reduce(Column.__add__, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"o_{c}"))) for c in BIT_COLUMNS])
    # A pair that shares several keys is compared in the least of them.
    once = F.col("key") == F.array_min(F.array_intersect("keys", "o_keys"))
    roots, have = linked_groups(scratch, met, texts, verify, attrs=(*BIT_COLUMNS, "keys"), close=(apart <= MOST_BITS) & once)
    linked = scratch.write(roots.join(have.select(F.col("id").alias("node"), "k2"), "node").select(F.col("node").alias("k1"), "k2", "root"))
    rows = keyed.groupBy("doc_id", "k1", "k2").agg(F.count(F.lit(1)).alias("n")).join(linked, ["k1", "k2"], "left")
    group = [F.coalesce("root", "k1").alias("g"), F.when(F.col("root").isNull(), F.col("k2")).alias("g2")]
    rows = scratch.write(rows.select("doc_id", "k1", "k2", "n", *group))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")
    firsts = rows.groupBy("g", "g2").agg(F.min(place).alias("place")).select(F.col("g").alias("h"), F.col("g2").alias("h2"), "place")
    joined = rows.join(firsts, (F.col("g") == F.col("h")) & F.col("g2").eqNullSafe(F.col("h2")))
    out = scratch.write(joined.select("doc_id", "k1", "k2", "n", (place == F.col("place")).alias("first")))
    scratch.drop(have, linked, rows, roots)
    return out


def one_of_each(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each group of near copies, that of least doc_id."""
    scratch, rows = Scratch(spark, "one"), similar_groups(spark, docs, **how)
    keys = [F.col("doc_id"), *text_key(F.col("text"))]
    kept = without(docs, scratch.write(rows.where("not first").select("doc_id", "k1", "k2")), keys)
    repeated = scratch.write(rows.where("first and n > 1").select("doc_id", "k1", "k2"))
    if repeated.isEmpty():
        return kept
    # Rows that are equal in id and text: one of them stays.
    single = without(kept, repeated, keys)
    names = [free(kept, f"key{i}") for i in range(3)]
    right = repeated.toDF(*[n + "_" for n in names])
    again = kept.withColumns(dict(zip(names, keys)))
    same = again[names[0]].eqNullSafe(right[names[0] + "_"]) & (again[names[1]] == right[names[1] + "_"]) & (again[names[2]] == right[names[2] + "_"])
    return single.unionByName(again.join(right, same, "left_semi").dropDuplicates(names).drop(*names))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicates(spark, docs, ["doc_id"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
