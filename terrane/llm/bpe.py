"""Byte-level BPE encoding in batched numpy merge rounds, and decoding.

A text is cut at the vocabulary's added tokens, then into words by the byte-level pattern. The words that a task has not
met yet are encoded together: their symbols lie in one flat array, words one behind the other. In each round every pair of
neighbours within a word has a rank, found by binary search over the sorted pair keys when the pair came to be; each word
takes its lowest rank and merges all occurrences of that pair from left to right (of overlapping ones every second); only
the pairs beside a merge are looked up again. Words without a pair left leave the array. That equals merging one pair at a
time, as a merge's result only takes part in merges of higher rank; ``Vocabulary`` refuses a file where that does not hold.

Which characters are letters or digits hangs on the Unicode version of the library that the vocabulary is for; see
``patterns``.

Cases: a null text is an empty one and has no tokens. Texts of any length are encoded whole; words of any length too, each
round of a long word being linear in it. A task remembers at most ``KNOWN`` words. Equal rows get equal tokens, rows are
independent and nothing is shuffled. An empty table gives none. Kept columns may have any name; those called n_tokens,
tokens or decoded are set anew. A null in the packed ids decodes as an empty text.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, masked

KNOWN, SLICE = 150_000, 1 << 20
NONE = np.iinfo(np.int64).max


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: itself if printable in Latin-1, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.cache
def patterns() -> tuple[str, str, str]:
    """(plain, exact, doubt): the word pattern, the same with the tokenizer library's own letters and digits, and a class of characters that call for it.

    The ``regex`` module's Unicode may be newer than the library's, and then knows more letters. Characters on which
    ``unicodedata``, older than both, has nothing are put to the library, and taken off the classes where it says no.
    """
    from public_tokenizers import PATTERN
    from tokenizers import pre_tokenizers

    ask = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    new = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) == "Cn"]
    exact, doubt = PATTERN, []
    for kind, sample in ((r"\p{L}", "a"), (r"\p{N}", "1")):
        known = regex.compile(kind)
        off = [c for c in new if known.match(c) and len(ask(sample + c)) > 1]
        if off:
            doubt += off
            exact = exact.replace(kind, f"[{kind}--[{_ranges(off)}]]")
    low = [c for c in doubt if c < "\U00010000"]
    return PATTERN, "(?V1)" + exact, f"[{_ranges(sorted(low))}\U00010000-\U0010ffff]"


def _ranges(characters: list[str]) -> str:
    out: list[list[int]] = []
    for c in map(ord, characters):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


class Vocabulary:
    """A byte-level BPE vocabulary of a tokenizers file, as arrays."""

    def __init__(self, path: str):
        told = json.loads(Path(path).read_text(encoding="utf-8"))
        model, before = told["model"], told["pre_tokenizer"]
        if model["type"] != "BPE" or model["ignore_merges"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or told["normalizer"] or told["post_processor"]:
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in told["added_tokens"]):
            raise ValueError(f"{path}: added tokens must match as they are")
        byte, ids = byte_characters(), model["vocab"]
        self.added = {a["content"]: a["id"] for a in told["added_tokens"]}
        self.pieces = [b""] * (1 + max([*ids.values(), *self.added.values()]))
        for piece, i in ids.items():
            self.pieces[i] = bytes(byte[c] for c in piece)
        for piece, i in self.added.items():
            self.pieces[i] = piece.encode()
        self.bytes = np.zeros(256, np.int64)
        for c, b in byte.items():
            self.bytes[b] = ids[c]
        self.size = len(self.pieces)
        pairs = [(ids[a], ids[b], ids[a + b]) for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
        left, right, made = (np.array(c, np.int64) for c in zip(*pairs))
        first = np.zeros(self.size, np.int64)
        first[made[::-1]] = np.arange(len(made))[::-1]
        if (np.maximum(np.where(np.isin(left, made), first[left], -1), np.where(np.isin(right, made), first[right], -1)) >= np.arange(len(made))).any():
            raise ValueError(f"{path}: a merge comes before one that makes its parts")
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order, made

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``NONE`` if it is no merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): the tokens of all words one behind the other, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(symbol))  # a symbol's first byte: where it goes in the end
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank = np.full(len(symbol), NONE)  # of the pair that begins here
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self.rank(symbol[inner], symbol[inner + 1])
        while len(symbol):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(rank, starts)
            if (least == NONE).mean() > 0.25 or (least == NONE).all():  # finished words leave, a good many at once
                ended = np.repeat(least == NONE, np.diff(np.append(starts, len(symbol))))
                done.append((place[ended], word[ended], symbol[ended]))
                symbol, word, place, rank = (a[~ended] for a in (symbol, word, place, rank))
                continue
            at = np.flatnonzero((rank == np.repeat(least, np.diff(np.append(starts, len(symbol))))) & (rank != NONE))
            run = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (word[at[1:]] != word[at[:-1]])))
            begin = at[np.flatnonzero(run)][np.cumsum(run) - 1]
            at = at[(at - begin) % 2 == 0]
            symbol[at] = self.made[rank[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            fresh = at - np.arange(len(at))  # where the merged symbols are once the others are gone
            symbol, word, place, rank = (a[keep] for a in (symbol, word, place, rank))
            touched = np.concatenate((fresh, fresh - 1))
            touched = touched[touched >= 0]
            rank[touched] = NONE
            pair = touched[touched < len(symbol) - 1]
            pair = pair[word[pair] == word[pair + 1]]
            rank[pair] = self.rank(symbol[pair], symbol[pair + 1])
        if not done:
            return np.empty(0, np.int64), np.zeros(len(words), np.int64)
        place, word, symbol = (np.concatenate(c) for c in zip(*done))
        return symbol[np.argsort(place)], np.bincount(word, minlength=len(words))


class Encoder:
    """Encodes texts and remembers words."""

    def __init__(self, vocabulary: Vocabulary, plain: str, exact: str, doubt: str):
        self.vocabulary = vocabulary
        self.plain, self.exact, self.doubt = regex.compile(plain), regex.compile(exact), re.compile(doubt)
        self.added = regex.compile("|".join(map(regex.escape, sorted(vocabulary.added, key=len, reverse=True)))) if vocabulary.added else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {t: i for i, t in enumerate(self.vocabulary.added)}
        self.flat = np.fromiter(self.vocabulary.added.values(), np.int64, len(self.known))
        self.count, self.start = np.ones(len(self.known), np.int64), np.arange(len(self.known))

    def split(self, text: str) -> list[str]:
        """The words of a text; an added token is a word, which no other word can equal."""
        pattern = self.plain if text.isascii() or not self.doubt.search(text) else self.exact
        if self.added is None or not self.added.search(text):
            return pattern.findall(text)
        out, at = [], 0
        for m in self.added.finditer(text):
            out += [*pattern.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return out + pattern.findall(text[at:])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.known) > KNOWN or len(self.flat) > 8 * KNOWN:
            self.forget()
        words = [self.split(t) for t in texts]
        new = set().union(*words) - self.known.keys()
        if new:
            flat, count = self.vocabulary.encode_words([w.encode() for w in new])
            self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(count) - count))
            self.flat, self.count = np.concatenate((self.flat, flat)), np.concatenate((self.count, count))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        number = [np.fromiter(map(self.known.__getitem__, own), np.int64, len(own)) for own in words]
        out = []
        for n in number:
            count = self.count[n]
            out.append(self.flat[np.repeat(self.start[n] - (np.cumsum(count) - count), count) + np.arange(count.sum())])
        return out


def _slices(batch: pa.RecordBatch, column: str):
    """Pieces of a batch of about ``SLICE`` bytes, of one row at least."""
    ends = np.cumsum(np.asarray([len(v.as_py() or "") for v in batch.column(column)], np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield batch.slice(at, to - at)
        at = to


def load(spark: SparkSession, vocabulary: str | None = None):
    """The vocabulary at a path of the driver, by default the public 50k one, for all tasks: some 3 MB."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return spark.sparkContext.broadcast((Vocabulary(vocabulary), *patterns()))


def encode(docs: DataFrame, keep: list[str], shared) -> DataFrame:
    """``keep``, n_tokens, and tokens: the ids of ``text``, packed as little-endian unsigned 32-bit integers."""
    keep = beside(keep, "n_tokens", "tokens")
    source = masked(docs, keep, F.col("text").alias("text"))
    own = source.columns[:-1]

    def run(batches):
        encoder = Encoder(*shared.value)
        for b in batches:
            for s in _slices(b, "text"):
                ids = encoder.encode([t or "" for t in s.column("text").to_pylist()])
                counts, packed = pa.array([len(i) for i in ids], pa.int64()), pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([*[s.column(c) for c in own], counts, packed], names=[*own, "n_tokens", "tokens"])

    made = source.select(*own).withColumns({"n_tokens": F.lit(0).cast("long"), "tokens": F.lit(b"")})
    return source.mapInArrow(run, made.schema).toDF(*keep, "n_tokens", "tokens")


def decode(coded: DataFrame, keep: list[str], shared, column: str = "tokens") -> DataFrame:
    """``keep`` and decoded: the text of packed ids, added tokens included; bytes that are no UTF-8 become U+FFFD."""
    keep = beside(keep, "decoded")
    source = masked(coded, keep, F.col(column).alias("ids"))
    own = source.columns[:-1]

    def run(batches):
        pieces = shared.value[0].pieces
        for b in batches:
            texts = [b"".join(map(pieces.__getitem__, np.frombuffer(v or b"", "<u4").tolist())).decode("utf-8", "replace") for v in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in own], pa.array(texts, pa.string())], names=[*own, "decoded"])

    return source.mapInArrow(run, source.select(*own).withColumn("decoded", F.lit("")).schema).toDF(*keep, "decoded")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = load(spark)
    coded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"], shared)
    back = decode(coded, ["doc_id", "n_tokens", "tokens"], shared)
    return back.select("doc_id", "n_tokens", F.sha2("tokens", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
