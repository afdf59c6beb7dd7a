"""Greedy word-piece counts by a linear longest-match automaton (LinMaxMatch, Song et al. 2021).

The vocabulary is a trie over bytes. A node whose string is no piece has a failure link: the node that is left when
the longest pieces at the front of its string are popped; how many that are is stored with the link. A word is read
once, byte by byte; where the trie has no edge the automaton pops along the links and adds up the stored counts, so
the number of pieces of the greedy longest-match split comes out in linear time and no piece is ever built.

Pieces are raw bytes and words begin with a space, as in the byte-level vocabularies; a word for which the vocabulary
lacks a piece counts as one unknown token. The vocabulary file is read by the driver and its automaton broadcast: it
has at most as many nodes as the vocabulary has bytes.

Cases: null and blank texts have no words and no tokens. Words of any length are read whole. Documents are
independent, so equal rows get equal counts and nothing is shuffled. An empty table gives none. Kept columns may have
any name; those called n_words or n_tokens are set anew.
"""

from __future__ import annotations

import base64
from collections import deque
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, masked

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_vocabulary(path: str) -> list[bytes]:
    """Pieces of a file of lines "base64 rank"."""
    return [base64.b64decode(line.split()[0]) for line in Path(path).read_bytes().splitlines() if line.strip()]


class Automaton:
    """``edge[node << 8 | byte]`` the next node; ``link[node]`` the failure link (-1: none), ``popped[node]`` its count."""

    def __init__(self, pieces: list[bytes]):
        self.edge: dict[int, int] = {}
        ends, depth_first = {0: False}, 1
        parents = [(-1, 0)]
        for p in pieces:
            at = 0
            for b in p:
                key = at << 8 | b
                nxt = self.edge.get(key)
                if nxt is None:
                    nxt = self.edge[key] = depth_first
                    depth_first += 1
                    parents.append((at, b))
                    ends[nxt] = False
                at = nxt
            if at:
                ends[at] = True
        children: list[list[int]] = [[] for _ in parents]
        for v in range(1, len(parents)):
            children[parents[v][0]].append(v)
        self.link, self.popped = [-1] * len(parents), [0] * len(parents)
        queue = deque(children[0])
        while queue:  # by length, as links lead to shorter strings
            v = queue.popleft()
            queue.extend(children[v])
            if ends[v]:
                self.link[v], self.popped[v] = 0, 1
                continue
            u, b = parents[v]
            n, z = self.popped[u], self.link[u]
            while z > 0 and (z << 8 | b) not in self.edge:
                n, z = n + self.popped[z], self.link[z]
            if z >= 0 and (to := self.edge.get(z << 8 | b)) is not None:
                self.link[v], self.popped[v] = to, n

    def count(self, word: bytes) -> int:
        """Pieces of the greedy split; 1 if there is none."""
        edge, link, popped = self.edge, self.link, self.popped
        at = n = 0
        for b in word:
            while (to := edge.get(at << 8 | b)) is None:
                if at == 0 or link[at] < 0:
                    return 1
                n += popped[at]
                at = link[at]
            at = to
        while at > 0:
            n += popped[at]
            at = link[at]
        return n if at == 0 else 1


class _Counts(dict):
    """Counts of the words met so far, emptied when full."""

    def __init__(self, automaton: Automaton, most: int = 300_000):
        super().__init__()
        self.automaton, self.most = automaton, most

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(b" " + word)
        if len(word) <= 48:
            if len(self) >= self.most:
                self.clear()
            self[word] = n
        return n


def token_counts(spark: SparkSession, docs: DataFrame, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep``, n_words and n_tokens."""
    if not Path(vocabulary).is_file():
        raise ValueError(f"no vocabulary file at {vocabulary}: give the path of a file of lines 'base64 rank'")
    shared = spark.sparkContext.broadcast(Automaton(read_vocabulary(vocabulary)))
    keep = beside(keep, "n_words", "n_tokens")
    source = masked(docs, keep, F.col("text").alias("text"))
    own = source.columns[:-1]

    def run(batches):
        counts = _Counts(shared.value)
        for b in batches:
            words, tokens = [], []
            for t in b.column("text"):
                parts = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
                words.append(len(parts))
                tokens.append(sum(map(counts.__getitem__, parts)))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in own] + [pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[*own, "n_words", "n_tokens"])

    zero = F.lit(0).cast("long")
    return source.mapInArrow(run, source.select(*own).withColumns({"n_words": zero, "n_tokens": zero}).schema).toDF(*keep, "n_words", "n_tokens")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
