"""Operators 11 to 13: against SQL on the small tables, brute force on made rows, and the tokenizer library."""

import glob
import hashlib
import math
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import bpe, centroids, ranking, registry

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
TERM = re.compile(ranking.TERM)


@tables
@pytest.mark.parametrize("name", ["op11_search", "op13_centroids"])
def test_same_as_sql(spark, name):
    duck = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    ours, theirs = registry.QUERIES[name](spark, SF), duck.execute(registry.ORACLES[name])
    names = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(names)
    rows = ours.select(*names).collect()
    assert rows and Counter(map(tuple, rows)) == Counter(theirs.fetchall())


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def ranked(docs, items, k):
    """Brute force: (item row, rank, id, score)."""
    split = [(i, Counter(terms_of(t))) for i, t in docs]
    n, total = sum(1 for _, c in split if c), sum(sum(c.values()) for _, c in split)
    df = Counter(t for _, c in split for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in split:
            m = 50 + (50 * sum(c.values()) * n) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms_of(text)) if t in c)
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return Counter(out)


def some_documents():
    rng = random.Random(5)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(300)] + ["Ünï", "日本", "CASE", "case"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))) for i in range(300)]
    docs += [(i, docs[i % 7][1]) for i in range(300, 360)]  # ties
    return docs + [(400, None), (401, ""), (402, " \n-!"), (None, docs[0][1]), (0, docs[3][1]), (403, "w1 " * 30_000)]


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_ranking_is_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(ranking, "SEGMENT_DOCS", 40)  # many segments
    docs = some_documents()
    items = [(1, "w1 w2 w3 case Ünï"), (1, docs[9][1]), (2, None), (3, "nowhere"), (None, "日本, W5!"), (5, docs[20][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit(1)).withColumn("SEG", F.lit(2)).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("row", F.lit(1))
    found = ranking.search(ranking.build_index(spark, frame), asked, k, block_terms=20)
    assert Counter(tuple(r) for r in found.collect()) == ranked(docs, items, k)


def test_only_candidates_are_rescored(spark):
    """The bounds leave out most texts that share a term with an item, and none that counts."""
    docs = some_documents()
    index = ranking.build_index(spark, spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    terms = ranking.weighted_terms(index, spark.createDataFrame([(0, docs[9][1])], "row long, text string")).collect()
    block = spark.sparkContext.broadcast(ranking._Block(terms))
    bounds = {r["at"]: r for r in ranking._bounds(index, block, 5).collect()}
    every = {r["at"]: r for r in ranking._bounds(index, block, 10_000).collect()}
    exact = ranked(docs, [(0, docs[9][1])], 10_000)
    assert len(bounds) < 0.3 * len(every) == 0.3 * len(list(exact.elements()))
    assert all(r["lower"] <= r["upper"] for r in every.values())
    assert sorted(s for *_, s in exact.elements())[-1] <= max(r["upper"] for r in every.values())


def test_ranking_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranking.search(ranking.build_index(spark, docs), items, 5).collect() == []
    assert ranking.search(ranking.build_index(spark, spark.createDataFrame([(1, "a b"), (2, "b c")], docs.schema)), items.limit(0), 5).collect() == []


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    return bpe.Encoder(bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json")), *bpe.patterns())


def test_tokens_of_odd_texts(library, encoder):
    rng = random.Random(3)
    letters = list("abAB  \n\t'’éßñ日本語😀1234२!?.,\x00\x85aaaa") + ["<|endoftext|>", "'ll", "'re", "՘", "\U00010940", "�"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(5000)]
    texts += ["", "<|endoftext|>", "  <|endoftext|>  x", " " * 1000, "a" * 5001, "ab" * 3000, "".join(rng.choices("abcdefgh", k=20_000))]
    for theirs, ours in zip(library.encode_batch(texts, add_special_tokens=False), encoder.encode(texts)):
        assert theirs.ids == ours.tolist()


def test_classes_of_all_characters(library, encoder):
    for low in range(0, 0x110000, 512):
        for text in ("".join(f"a{chr(c)}1{chr(c)}{chr(c)}!{chr(c)} b" for c in range(low, low + 512) if not 0xD800 <= c <= 0xDFFF),):
            want = [text[a:z] for _, (a, z) in library.pre_tokenizer.pre_tokenize_str(text)]
            assert encoder.split(text) == want


def test_words_forgotten_are_encoded_again(library, encoder, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN", 50)
    texts = [" ".join(f"word{i}{j}" for j in range(40)) for i in range(12)]
    assert [encoder.encode([t])[0].tolist() for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_round_trip_keeps_columns(spark, library):
    rows = [(1, "One <|endoftext|> two", 5, "x"), (2, None, 6, "y"), (3, "", 7, None), (1, "One <|endoftext|> two", 5, "x"), (4, "ñ " * 50_000, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens long, c0 string")
    shared = bpe.load(spark)
    coded = bpe.encode(docs, ["doc_id", "c0", "tokens"], shared)
    assert coded.columns == ["doc_id", "c0", "n_tokens", "tokens"]
    back = bpe.decode(coded, coded.columns, shared).collect()
    assert Counter((r["doc_id"], r["c0"], r["decoded"]) for r in back) == Counter((i, c, t or "") for i, t, _, c in rows)
    for r in back:
        assert np.frombuffer(r["tokens"], "<u4").tolist() == library.encode(r["decoded"], add_special_tokens=False).ids and r["n_tokens"] == len(r["tokens"]) // 4
    assert bpe.encode(docs.limit(0), ["doc_id"], shared).collect() == []
    cut = spark.createDataFrame([(1, bytearray(np.array([447], "<u4").tobytes())), (2, None)], "id long, ids binary")  # half of a character
    assert {r["id"]: r["decoded"] for r in bpe.decode(cut, ["id"], shared, "ids").collect()} == {1: library.decode([447]), 2: ""}


@tables
def test_op12_is_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = registry.QUERIES["op12_bpe"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        sums = [hashlib.sha256(b).hexdigest() for b in (np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False).encode())]
        assert [r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]] == [len(ids), *sums]


def lloyd(x, k, rounds, order):
    c = np.array([x[i] for i in order[:k]])
    for r in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        a = d.argmin(axis=1)  # the first of equals
        if r < rounds:
            c = np.array([[s // (a == j).sum() for s in x[a == j].sum(axis=0)] if (a == j).any() else c[j] for j in range(len(c))])
    return a, d.min(axis=1), c


def test_walk_is_nearest_with_ties_and_skips():
    rng = np.random.default_rng(1)
    c = rng.integers(-60, 60, (16, 3))
    c[5] = c[2]  # equal centroids
    near = np.repeat(c, 60, axis=0) + rng.integers(-4, 5, (960, 3))
    x = np.concatenate((near, (c[:8] + c[8:]) // 2, c))
    best, dist, computed = centroids.walk(x, rng.integers(0, 16, len(x)), c)
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (best == d.argmin(axis=1)).all() and (dist == d.min(axis=1)).all()
    _, _, later = centroids.walk(x, best, c)
    assert later < 0.5 * d.size


def test_clusters_are_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-9, 9, (400, 2))
    x[100:300] = x[7]  # half of all rows are one vector
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<long>")
    got, final = centroids.sort_means(spark, points, k=6)
    order = sorted(range(len(x)), key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())
    a, d, c = lloyd(x, 6, 3, order)
    assert {(r["id"], r["cluster"], r["distance"]) for r in got.collect()} == {(i, a[i], d[i]) for i in range(len(x))} and (final == c).all()


def test_which_vectors_count(spark):
    good = [0.5] * 64
    rows = [(1, good), (None, good), (2, good[:63]), (3, None), (4, [None, *good[1:]]), (5, [float("nan"), *good[1:]]), (6, [float("inf"), *good[1:]]), (7, [-0.01] * 64), (1, good)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("own")).withColumn("x", F.lit(1))
    kept = centroids.quantised(df, "vec_id", "embedding")
    assert Counter((r["id"], r["x"][0]) for r in kept.collect()) == {(1, 32): 2, (None, 32): 1, (7, -1): 1}
    got, final = centroids.sort_means(spark, kept)
    assert len(final) == 4 and got.agg(F.sum("distance")).first()[0] == 0
    assert centroids.sort_means(spark, kept.limit(0))[0].collect() == []
    far = spark.createDataFrame([(9, [1e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="out of range: id 9"):
        centroids.quantised(far, "vec_id", "embedding").collect()
