"""The stages against brute force on the smallest tables."""

import os

import pytest

import corpus_pipeline as cp
from terrane.llm.common import Scratch
from terrane.llm.simhash import jaccard

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def brute_marks(texts):
    """Documents that hold a window of an item."""
    import re

    def split(t):
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]

    import pyarrow.parquet as pq

    windows = set()
    for t in pq.read_table(f"{SF}/benchmark.parquet")["text"].to_pylist():
        w = split(t)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n}
    sizes = {len(w) for w in windows}
    return {d for d, t in texts.items() for w in [split(t)] for n in sizes if any(tuple(w[i : i + n]) in windows for i in range(len(w) - n + 1))}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, scratch, seen = docs.columns, Scratch(spark, "t"), {}
    for name, stage in cp.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()} if "text" in docs.columns else {}
        docs = scratch.write(stage(spark, docs, SF))
        seen[name] = docs.count()
        if name != "sharding":
            assert docs.columns == columns
        if name == "near_dedup":
            kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
            for i, t in before.items():
                near = [j for j, u in before.items() if j < i and jaccard(t, u, 5) >= 0.8]
                assert (i in kept) or near
                assert not any(j in kept and before[j] == t for j in near) or i not in kept
                assert not (i in kept and any(j in kept for j in near)), i
        if name == "decontamination":
            marks = brute_marks(before)
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == set(before) - marks
        if name == "mixing":
            times = docs.groupBy("doc_id").count().collect()
            assert {r["doc_id"] for r in times} <= set(before) and max(r["count"] for r in times) <= 2
    assert seen["toxicity"] >= seen["near_dedup"] >= seen["decontamination"] and seen["sharding"] == seen["mixing"]
