"""Names that clash, tables without rows, and what the operators owe to their methods."""

import collections
import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terrane.llm import common, decontaminate, extraction, lines, mixing, quality, sharding, simhash, substrings, tokencount, toxicity
from terrane.llm.common import Scratch
from terrane.llm.dom import match, parse

CLASHES = ["k1", "_k1", "fp", "component_id", "n_words", "n_tokens", "host", "layout", "own_w", "_w", "score", "place", "key", "c0", "places", "row", "g", "shard", "id", "line_doc"]


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def crowded(spark):
    """Documents with a column of every name the operators use themselves."""
    rng = random.Random(3)
    texts = [prose(rng, 60) + "\n" + prose(rng, 12) for _ in range(6)] + [None, ""]
    rows = [(i, t, "s", f"<article><p>{t}</article>", f"http://h/{i}", *range(len(CLASHES))) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, html string, url string, " + ", ".join(f"{c} int" for c in CLASHES))


CALLS = {
    "lines": lambda spark, d: lines.dedup_lines(spark, d),
    "simhash": lambda spark, d: simhash.near_duplicates(spark, d, d.columns),
    "near": lambda spark, d: simhash.one_of_each(spark, d),
    "tokens": lambda spark, d: tokencount.token_counts(spark, d, d.columns),
    "quality": lambda spark, d: quality.clean_lines(d),
    "substrings": lambda spark, d: substrings.dedup_substrings(spark, d, d.columns),
    "pages": lambda spark, d: extraction.extract_pages(spark, d, [c for c in d.columns if c != "text"]),
    "toxicity": lambda spark, d: toxicity.score(spark, d, toxicity.fit(spark, d, d.select("doc_id", F.lit(1).alias("toxic")).where("1 = 0")), d.columns),
    "hits": lambda spark, d: decontaminate.contaminated(spark, d, d.select(F.col("doc_id").alias("item_id"), "text")),
    "sharding": lambda spark, d: sharding.shard(spark, d, shards=3),
}


@pytest.mark.parametrize("name", CALLS)
def test_clashing_names_and_no_rows(spark, crowded, name):
    out = CALLS[name](spark, crowded)
    rows = out.collect()
    if name not in ("hits", "near"):
        assert len(rows) == crowded.count()
    if name in ("lines", "near", "quality", "simhash", "tokens", "substrings", "pages", "toxicity"):
        for c in set(CLASHES) - {"n_words", "n_tokens", "fp", "component_id", "score"}:
            assert {r[c] for r in rows} == {CLASHES.index(c)}, c
    assert CALLS[name](spark, crowded.where("1 = 0")).collect() == []


def test_stages_take_tables_without_rows_and_null_texts(spark, tmp_path):
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, None, "en", "s", 0), (None, None, None, None, None), (2, "one two three", "en", "s", 13), (2, "one two three", "en", "s", 13), (3, "x a b c d e f g h i j y", "en", None, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    for d in (docs, docs.where("1 = 0")):
        for _, stage in corpus_pipeline.STAGES:
            d = Scratch(spark, "t").write(stage(spark, d, str(tmp_path)))
        assert d.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]


def test_stages_keep_clashing_columns(spark, crowded, tmp_path):
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = crowded
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = Scratch(spark, "t").write(stage(spark, docs, str(tmp_path)))
        assert docs.columns == crowded.columns
        rows = docs.collect()
        assert rows and all(r[c] == i for r in rows for i, c in enumerate(CLASHES))
    manifest = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert manifest.count() == len(rows) and None not in {r["doc_id"] for r in rows}


def test_label_model_finds_rates_and_correlations():
    """Simulated voters of known accuracy, two of which copy each other; no row is pinned to its given label."""
    rng = np.random.default_rng(1)
    n = 8000
    truth = rng.random(n) < 0.3
    v = np.zeros((n, 6), dtype=int)
    right = [0.9, 0.8, 0.75, 0.85, 0.7, 0.7]
    for j, p in enumerate(right):
        says = np.where(rng.random(n) < p, truth, ~truth)
        v[:, j] = np.where(rng.random(n) < 0.8, np.where(says, 1, -1), 0)
    copies = rng.random(n) < 0.9
    v[:, 5] = np.where(copies, v[:, 4], v[:, 5])
    y = np.where(rng.random(n) < 0.1, np.where(rng.random(n) < 0.92, truth, ~truth), -1).astype(int)
    post, about = toxicity.label_model(v, y)
    assert abs(about["prior"] - 0.3) < 0.04 and abs(about["label_accuracy"] - 0.92) < 0.05
    assert np.abs(about["accuracy"] - right)[:4].max() < 0.04
    assert about["parent"][4] == 5 or about["parent"][5] == 4
    assert abs(about["correlation"][[4, 5]]).max() > 0.7 and abs(about["correlation"][:4]).max() < 0.2
    assert ((post > 0.5) == truth).mean() > 0.92
    given = y >= 0
    wrong = given & (y != truth)
    assert ((post > 0.5) == truth)[wrong].mean() > 0.3  # the votes of others outweigh some wrong labels
    assert np.abs(post - y)[given].max() > 0.5


def page(i, lead="", body=4):
    rng = random.Random(i)
    own = "".join(f"<p>{prose(rng, 20)}</p><p class=zz>Always the same words here</p>" for _ in range(body))
    links = "".join(f"<li><a href=x>{prose(rng, 3)}</a></li>" for _ in range(5))
    return f"<html><body><div class=aa><span>Site name</span><p>{'Welcome to all of our many readers. ' * 20}</p></div><div class=bb><h1>{prose(rng, 4)}</h1><p class=ll>{lead}{prose(rng, 9)}</p><div class=cc>{own}</div></div><div class=dd><ul>{links}</ul></div><div class=ee>Imprint and more</div></body></html>"


def wanted(i, body=4):
    rng = random.Random(i)
    paragraphs = [prose(rng, 20) for _ in range(body)]
    [prose(rng, 3) for _ in range(5)]
    return [prose(rng, 4), prose(rng, 9), *paragraphs]


def test_template_decides_without_telling_names(spark):
    """No article, no class that says anything: constant nodes go, headline and lead beside the body stay, also on a rare second layout."""
    rows = [(i, f"http://one/{i}", page(i)) for i in range(30)]
    rows += [(100 + i, f"http://one/{i}", page(100 + i).replace("<body>", "<body><main1><section1>").replace("class=bb", "class=b2")) for i in range(3)]
    got = {r["page_id"]: r["text"] for r in extraction.extract_pages(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    for i, _, html in rows:
        assert got[i].split("\n") == wanted(i), i
        assert extraction.extract(html, None) != got[i]


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, "http://one/", page(1)) for i in range(9)] + [(20, "http://one/", page(2))]
    got = {r["page_id"]: r["text"] for r in extraction.extract_pages(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    assert wanted(1)[0] in got[0] and wanted(1)[-1] in got[0] and wanted(2)[-1] in got[20] and "Welcome" not in got[0]


def test_long_lists_are_matched():
    a, b = (parse("<ul>" + "".join(f"<li>{i * k}</li>" for i in range(20_000)) + "</ul>") for k in (1, 2))
    assert len(match(a, b)) == 20_002


def test_new_batch_against_a_stored_index(spark, tmp_path):
    """Batch after batch through an index that is opened again each time: what goes is what goes when all is one table."""
    rng = random.Random(4)
    shared = [prose(rng, 50, 5000) for _ in range(4)]
    texts = [f"{prose(rng, 20, 5000)} {shared[i % 4] if i % 3 else ''} {prose(rng, 30, 5000)}" for i in range(36)] + [None, ""]
    docs = spark.createDataFrame([(i, t, i % 6) for i, t in enumerate(texts)], "doc_id long, text string, part int")
    for k in range(6):
        index = substrings.FingerprintIndex(Scratch(spark, "t"), fanout=3, folder=f"{tmp_path}/index")
        assert len(index.runs) < 3
        history = docs.where(F.col("part") < k)
        got = substrings.dedup_batch(spark, docs.where(F.col("part") == k), ["doc_id"], index, history).collect()
        both = substrings.dedup_substrings(spark, docs.where(F.col("part") <= k), ["doc_id", "part"]).where(F.col("part") == k).drop("part").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, both))
    assert sum(r["n_removed"] for r in both) > 100


def test_items_without_id(spark, tmp_path):
    spark.createDataFrame([(1, "a b c and x"), (2, "none of it")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, "b c"), (None, "and x"), (7, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in decontaminate.op4_decontamination(spark, str(tmp_path)).collect()}
    assert (got[1]["n_hit"], got[1]["n_items"], got[1]["contaminated"]) == (5, 2, True)
    assert got[1]["items_sha256"] == hashlib.sha256(b"7").hexdigest() and not got[2]["contaminated"]


def test_shards_hang_on_rows_not_on_files(spark):
    rows = [(i if i % 50 else None, f"text {i % 9}" if i % 3 == 0 else f"own {i}" * 5) for i in range(600)] + [(5, "twice"), (5, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted(map(str, sharding.shard(spark, d, shards=5).drop("row").collect())) for d in (docs.coalesce(1), docs.repartition(7))]
    assert got[0] == got[1]


def test_notices_count_as_lost(spark):
    notices = "\n".join(f"Licensed under the terms number {i}, all rights reserved by us and no other soul." for i in range(40))
    some = prose(random.Random(1), 60, 10**6)
    rows = [(1, notices + "\nA few good words here."), (2, some + ".\nLizenziert unter CC BY 4.0."), (3, some + " on javascript and copyright law.")]
    got = {r["doc_id"]: r for r in quality.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not got[1]["kept"] and got[1]["n_lost_words"] > 500 and got[2]["kept"] and got[2]["n_lost_words"] == 5 and got[3]["n_lost_words"] == 0


def test_long_notices_are_notices(spark):
    """By the phrases among a line's words, at any length; a single one in a long paragraph makes no notice of it."""
    notice = "This work is licensed under terms of use that we set out in the next few lines of text, all rights reserved by us."
    some = prose(random.Random(3), 400, 10**6) + ".\n"
    rows = [(k, some + " ".join([notice] * k)) for k in (1, 2, 5, 40)] + [(0, some + prose(random.Random(4), 60, 10**6) + " privacy policy.")]
    got = {r["doc_id"]: r["n_lost_words"] for r in quality.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0} | {k: k * len(notice.split()) for k in (1, 2, 5, 40)}


def test_verdict_by_brute_force(spark):
    """Line by line in Python, over made lines of every kind."""
    rng = random.Random(7)
    kinds = [lambda: prose(rng, 12) + ".", lambda: "Home | News | Help | About", lambda: "# $ % & word", lambda: "LOUD WORDS ALL OVER", lambda: "no end", lambda: "All rights reserved.", lambda: "Short end."]
    rows = [(i, "\n".join(rng.choice(kinds)() for _ in range(rng.randrange(1, 9)))) for i in range(120)]
    got = {r["doc_id"]: r for r in quality.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        kept = 0
        for line in t.split("\n"):
            n = len(line.split())
            junk = line.count(" |") >= max(2, n / 6) or sum(c in "#*$%&|<>" for c in line) > n / 4 or (n >= 4 and sum(c.isupper() for c in line) > sum(c.islower() for c in line))
            if not junk and not (n < 5 and line[-1] not in ".!?") and "all rights reserved" not in line.lower():
                kept += n
        n, w = len(t.split()), t.split()
        grams = collections.Counter(tuple(w[k : k + 5]) for k in range(n - 4))
        again = {j for k in range(n - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        failed = n < 10 or len(again) > 0.2 * n
        assert (got[i]["n_kept_words"], got[i]["base_failed"], got[i]["kept"]) == (kept, failed, not failed and kept >= n / 2 and kept > 0), t


def test_token_counts_of_the_whole_vocabulary():
    """The query's own vocabulary: greedy longest match, piece by piece."""
    pieces = tokencount.read_vocabulary(tokencount.VOCABULARY)
    known, longest, auto = set(pieces), max(map(len, pieces)), tokencount.Automaton(pieces)
    rng = random.Random(2)
    words = [re.sub(rb"\s", b"", rng.choice(pieces) + rng.choice(pieces) + bytes([rng.randrange(33, 255)])) for _ in range(3000)] + ["naïve".encode(), b"x" * 500]
    for w in words:
        w, n, i = b" " + w, 0, 0
        while i < len(w):
            k = next((k for k in range(min(longest, len(w) - i), 0, -1) if w[i : i + k] in known), 0)
            if not k:
                n = 1
                break
            n, i = n + 1, i + k
        assert auto.count(w) == n


def test_mixing_takes_clashing_names(spark, crowded):
    scratch = Scratch(spark, "t")
    sizes = scratch.write(mixing.sizes_of(crowded))
    assert mixing.apply_plan(sizes, mixing.mixing_plan(scratch, sizes)).count() == crowded.count()


def test_scratch_leaves_no_shuffle_files(spark):
    """What a written table was shuffled through goes as soon as it is written."""
    jvm, made = spark.sparkContext._jvm, spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    held = lambda: jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    before = held()
    assert common.Scratch(spark, "test").write(made).count() == 7
    deadline = time.time() + 10
    while held() > before + 1 and time.time() < deadline:  # the count's own
        time.sleep(0.1)
    assert held() <= before + 1 and spark.conf.get(common._CLEAN) == "false"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_no_link_of_lines_is_left_out(spark):
    """Lines as different as a link allows, of every size and also without spaces: what stays is what all pairs say."""
    rng = random.Random(31)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def word():
        return "".join(rng.choices(letters, k=rng.randrange(2, 9)))

    def linked(a, b):
        x, y = (re.sub(r"[.,!]", "", t).split() for t in (a, b))
        size, n = max(len(a), len(b)), max(len(x), len(y))
        part = 0.5 if size <= 64 else 0.4 if size <= 256 else 0.2
        by_words = max(len(a) / len(x), len(b) / len(y)) <= 24 and distance(x, y) <= int(part * n + 1e-9)
        if size > 256 and by_words:
            return True
        alone = size <= 40 or min(len(a) / len(x), len(b) / len(y)) > 16
        return (alone or by_words) and distance(a, b) <= int(0.2 * size + 1e-9)

    texts = {}
    for n in [1, 2, 3, 5, 6, 8, 12, 20, 45, 70] * 5:
        ws = [word() for _ in range(n)]
        texts[" ".join(ws)] = 0
        for _ in range(2):
            other, few = list(ws), n // 5
            for at in rng.sample(range(n), few):
                other[at] = word()
            texts[" ".join(other)] = 0
        chars = list(" ".join(ws)[:250])
        for at in rng.sample(range(len(chars)), len(chars) // 6):
            chars[at] = rng.choice(letters) if chars[at] != " " else " "
        texts["".join(chars).strip()] = 0
    for _ in range(8):
        chars = rng.choices(letters, k=rng.randrange(41, 120))
        texts["".join(chars)] = 0
        for at in rng.sample(range(len(chars)), len(chars) // 5):
            chars[at] = rng.choice(letters)
        texts["".join(chars)] = 0
    texts = list(texts)
    group = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j in range(i + 1, len(texts)):
            if group[i] != group[j] and linked(a, texts[j]):
                group = [group[i] if g == group[j] else g for g in group]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in lines.dedup_lines(spark, docs, min_words=1).where("n_removed = 0").collect()}
    assert kept == {group.index(g) for g in set(group)}


def test_all_pages_of_a_layout_make_its_wrapper(spark):
    """A line that only two of sixty pages have otherwise is no template text."""
    page = "<html><body><div class='menu'><a>Home</a></div><div id=main><h1>Title {0}</h1><p>{1}</p><p>Body {0} of its own, long enough to be more than the rest.</p><p>Printed by all.</p></div></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(f"t{i}", "Second edition" if i in (17, 41) else "First edition")) for i in range(60)]
    got = {r["page_id"]: r["text"] for r in extraction.extract_pages(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    for i in range(60):
        first = "Second edition" if i in (17, 41) else "First edition"
        assert got[i] == f"Title t{i}\n{first}\nBody t{i} of its own, long enough to be more than the rest."


def test_a_key_of_many_rows_is_met_in_slices(spark):
    keys = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 700)
    rows = spark.range(9000).select(keys.alias("k"), F.col("id").alias("at"))
    counted = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 12")
    plain = rows.join(counted.select("k"), "k")
    got = common.sliced_join(rows, counted, ["k"], ["at"], least=200)
    assert got.columns == ["k", "at"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    # What goes by one hash to a task: key and slice.
    dealt = rows.where("k = -1").groupBy(F.pmod(F.xxhash64("at"), F.lit(15))).count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert dealt[1] == 15 and dealt[0] < 300
    assert "_slice" in got._jdf.queryExecution().optimizedPlan().toString()
    assert common.sliced_join(rows, counted.where("1 = 0"), ["k"], ["at"]).count() == 0


@pytest.mark.parametrize("least", [3, 20_000])
def test_substrings_met_in_slices_are_the_same(spark, monkeypatch, least):
    rng = random.Random(8)
    passage, many = prose(rng, 60), 10**9  # words of so many are not shared by chance
    texts = [prose(rng, 30, many) + " " + passage + " " + prose(rng, 25, many) for _ in range(40)] + [passage] * 5 + [prose(rng, 80, many) for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(common.sliced_join, "__defaults__", (least, None))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substrings.dedup_substrings(spark, docs, ["doc_id"]).collect()}
    assert all(got[i] == (115, 60) for i in range(40)) and all(got[i] == (60, 60) for i in range(40, 45)) and all(got[i] == (80, 0) for i in range(45, 55))
