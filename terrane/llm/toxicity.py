"""Toxicity by weak supervision.

Voters. Patterns of general use (shouting, insults addressed to a reader, masked swear words) and lexicons vote on a
text or abstain. One lexicon is a fixed list of common insults; the others are induced from labelled rows: word
beginnings of four to seven letters and whole words whose documents are far more often toxic than not, split into
``LEXICONS`` lists by their hash so that they err apart. One voter finds nothing from any lexicon and votes clean. The
given label is one more voter, which abstains on the many documents without one; its accuracy is estimated like any.

Label model. The hidden label and the votes are one joint distribution: each voter votes given the label and the vote
of one other voter, its parent. The tree of parents is the one with the most mutual information given the label, so
the strongest correlations are parameters of the model and a crowd that errs together does not count several times.
Expectation maximisation over labelled and unlabelled documents estimates prior, votes and tree; labels only give the
start and their own votes. What comes out are posteriors, which need not side with the given label.

Classifier. A logistic regression on the induced features (damped counts) and the voters is fitted to the posteriors.

Documents are scored whole, in Arrow batches. What is fitted is fitted on a bounded sample of rows of the training
folds, those of least id hash: up to ``LABELS`` rows of either label for the statistics of features, up to ``SAMPLE`` of
those and ``UNLABELLED`` rows without a label for label model and classifier, each kind weighed as in the corpus. The
sampled ids are broadcast, so no text is shuffled.

Cases: a null or blank text has no features and gets the score of such texts; very long ones are read whole. Equal texts
get equal scores. Rows without an id are scored, not learned from, and are not held out; labels of a repeated id count
once as the greatest, and its texts as the least of them. Without labels the fixed voters alone decide. An empty table
gives none. Kept columns may have any name but score, which is set anew.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, beside

FEATURES = 2_000
LABELS = 10_000
SAMPLE = 6_000
UNLABELLED, UNLABELLED_WEIGHT = 4_000, 0.3
#: The classifier takes toxic documents for at least this share of all, however few they are.
LEAST_PRIOR = 0.05
LEXICONS = 12
SHORTEST, LONGEST = 4, 7
FOLDS = 5
TOKEN = re.compile(r"[^\W_]+")
#: Common insults, in alphabetical order.
INSULTS = frozenset(
    "arse arsehole asshole bastard bitch bollocks bullshit clown coward crap creep cretin cunt degenerate dickhead dimwit disgusting dumb dumbass fool freak fuck fucking garbage idiot idiotic imbecile jackass jerk lame liar loser lunatic maggot moron motherfucker nitwit parasite pathetic pig prick psycho rat retard scum scumbag shit shithead shitty slut stupid swine thug traitor trash twat vermin wanker weirdo whore worthless wretch".split()
)
#: Patterns that vote toxic.
PATTERNS = tuple(
    re.compile(p, re.I)
    for p in (
        r"\b(you|u|ur|your|you're)\b(\W+\w+){0,3}?\W+(idiots?|morons?|losers?|trash|scum|stupid|pathetic|worthless|disgusting|clowns?)\b",
        r"\b(shut up|go to hell|kill yourself|drop dead|screw you|get lost)\b",
        r"\b[a-z]{1,3}[*#@$]{2,}[a-z]{0,4}\b",
        r"\b(hate|despise)\s+(you|them|those|these)\b",
    )
)
N_VOTERS = len(PATTERNS) + 1 + LEXICONS + 1


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def features(text: str) -> Counter:
    """Whole words and word beginnings with their counts."""
    out: Counter = Counter()
    for w, n in Counter(TOKEN.findall(text.lower())).items():
        out["=" + w] += n
        for k in range(SHORTEST, min(LONGEST, len(w)) + 1):
            out[w[:k]] += n
    return out


def matches(text: str, known: dict[str, int]) -> tuple[dict[int, int], bool]:
    """Counts of the known features of a text, and whether a word of the fixed list occurs."""
    out: dict[int, int] = {}
    insult = False
    for w, n in Counter(TOKEN.findall(text.lower())).items():
        insult |= w in INSULTS
        if (j := known.get("=" + w)) is not None:
            out[j] = out.get(j, 0) + n
        for k in range(SHORTEST, min(LONGEST, len(w)) + 1):
            if (j := known.get(w[:k])) is not None:
                out[j] = out.get(j, 0) + n
    return out, insult


def votes(text: str, found: dict[int, int], insult: bool, lexicon: np.ndarray) -> np.ndarray:
    """1 toxic, -1 clean, 0 abstains."""
    v = np.zeros(N_VOTERS, dtype=np.int8)
    for i, p in enumerate(PATTERNS):
        v[i] = p.search(text) is not None
    v[len(PATTERNS)] = insult
    for j in found:
        v[len(PATTERNS) + 1 + lexicon[j]] = 1
    v[-1] = 0 if v[:-1].any() else -1
    return v


def induce(training: DataFrame, n_toxic: int, n_clean: int, most: int = FEATURES) -> list[str]:
    """The features of ``training(text, toxic)`` with the highest lower bound on their log-odds of toxicity."""

    def run(batches):
        for b in batches:
            tox, clean = Counter(), Counter()
            for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                (tox if y else clean).update(features(t or "").keys())
            keys = list(tox.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([tox[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], names=["f", "a", "b"])

    seen = training.mapInArrow(run, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / b) - F.log(F.lit((n_toxic + 1) / (n_clean + 1)))
    bound = odds - 1.64 * F.sqrt(1 / a + 1 / b)
    return [r["f"] for r in seen.where("a >= 3").withColumn("s", bound).where("s > 1.0").orderBy(F.desc("s"), "f").limit(most).collect()]


def label_model(v: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 60) -> tuple[np.ndarray, dict]:
    """Posterior of the hidden label for votes ``v`` (rows, voters: 1, -1, 0) and given labels ``y``: 0 or 1, or -1 where unknown.

    Returns it with the parameters: prior, the accuracy of each voter where it votes, that of the labels, the parent of
    each voter (-1: none), and the correlation of each voter with its parent given the label.
    """
    n, m = v.shape
    weight = np.ones(n) if weight is None else weight / weight.mean()
    known, state = y >= 0, v.astype(np.int64) + 1
    onehot = (state[:, :, None] == np.arange(3)).astype(float).reshape(n, 3 * m)
    post = np.where(known, np.where(y == 1, 0.9, 0.1), np.where((v == 1).any(axis=1), 0.5, 0.05)).astype(float)
    parent, tables = np.full(m, -1), None
    for step in range(rounds):
        share = float(np.clip((weight * post).sum() / weight.sum(), 1e-4, 1 - 1e-4))
        joint = []  # [class][voter, vote, voter, vote]: weights of pairs of votes, smoothed
        for w in (1 - post, post):
            pairs = ((onehot * (weight * w)[:, None]).T @ onehot).reshape(m, 3, m, 3) + 0.1
            joint.append(pairs)
        if step in (0, 2, 5, 10):  # the tree follows while posteriors still move, then it stays
            parent = _tree(joint, (1 - share, share))
        logit = np.full(n, np.log(share / (1 - share)))
        for j in range(m):
            up = parent[j]
            if up < 0:
                own = [np.diagonal(t[j, :, j, :]) for t in joint]
                p = [x / x.sum() for x in own]
                logit += np.log(p[1] / p[0])[state[:, j]]
            else:
                given = [t[j, :, up, :] / t[j, :, up, :].sum(axis=0) for t in joint]
                logit += np.log(given[1] / given[0])[state[:, j], state[:, up]]
        said = [((weight * w * known * (y == 1)).sum() + 0.1) / ((weight * w * known).sum() + 0.2) for w in (1 - post, post)]
        given = np.where(y == 1, np.log(said[1] / said[0]), np.log((1 - said[1]) / (1 - said[0])))
        new = 1 / (1 + np.exp(-np.clip(logit + np.where(known, given, 0), -30, 30)))
        moved, post = np.abs(new - post).max(), new
        if moved < 1e-4 and step > 10:
            break
    right = [joint[1][j, 2, j, 2] + joint[0][j, 0, j, 0] for j in range(m)]
    voted = [sum(t[j, s, j, s] for t in joint for s in (0, 2)) for j in range(m)]
    corr = np.array([0.0 if parent[j] < 0 else _correlation(joint, j, parent[j]) for j in range(m)])
    about = {"prior": share, "accuracy": np.array(right) / np.array(voted), "label_accuracy": share * said[1] + (1 - share) * (1 - said[0]), "parent": parent, "correlation": corr}
    return post, about


def _correlation(joint: list[np.ndarray], i: int, j: int) -> float:
    """Of two voters within the classes, the classes weighed by their rows."""
    value, cross, own, other = np.array([-1.0, 0.0, 1.0]), 0.0, 0.0, 0.0
    for t in joint:
        p = t[i, :, j, :] / t[i, :, j, :].sum()
        a, b = p.sum(axis=1), p.sum(axis=0)
        mass = t[i, :, j, :].sum()
        cross += mass * (value @ p @ value - (a @ value) * (b @ value))
        own += mass * (a @ value**2 - (a @ value) ** 2)
        other += mass * (b @ value**2 - (b @ value) ** 2)
    return float(cross / np.sqrt(max(own * other, 1e-12)))


def _tree(joint: list[np.ndarray], shares: tuple[float, float], least: float = 1e-3) -> np.ndarray:
    """Parents of the spanning tree with the most mutual information given the label; ties under ``least`` are cut."""
    m = joint[0].shape[0]
    info = np.zeros((m, m))
    for t, share in zip(joint, shares):
        p = t / t.sum(axis=(1, 3), keepdims=True)
        a, b = p.sum(axis=3, keepdims=True), p.sum(axis=1, keepdims=True)
        info += share * (p * np.log(p / (a * b))).sum(axis=(1, 3))
    parent, best, frm, inside = np.full(m, -1), np.full(m, -1.0), np.full(m, -1), np.zeros(m, dtype=bool)
    for _ in range(m):
        j = int(np.argmax(np.where(inside, -2.0, best)))
        inside[j] = True
        parent[j] = frm[j] if best[j] > least else -1
        closer = ~inside & (info[j] > best)
        best, frm = np.where(closer, info[j], best), np.where(closer, j, frm)
    return parent


def fit_linear(rows: list[np.ndarray], values: list[np.ndarray], dim: int, target: np.ndarray, rows_weigh: np.ndarray, least_prior: float = 0.0, l2: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse rows by accelerated gradient steps; the positive class weighs ``least_prior`` or more."""
    n = len(rows)
    ri = np.repeat(np.arange(n), [len(r) for r in rows])
    ci = np.concatenate(rows) if ri.size else np.zeros(0, int)
    x = np.concatenate(values) if ri.size else np.zeros(0)
    mass = (rows_weigh * target).sum(), (rows_weigh * (1 - target)).sum()
    prior = max(least_prior, mass[0] / max(sum(mass), 1e-9))
    weight = rows_weigh * (prior * target / max(mass[0], 1e-9) + (1 - prior) * (1 - target) / max(mass[1], 1e-9))
    w, b, m, s = np.zeros(dim), 0.0, np.zeros(dim + 1), np.zeros(dim + 1)
    for t in range(1, steps + 1):
        z = np.bincount(ri, x * w[ci], n) + b
        g = (1 / (1 + np.exp(-z)) - target) * weight
        grad = np.append(np.bincount(ci, x * g[ri], dim) + l2 * w, g.sum())
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def _row(text: str, known: dict[str, int], lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns, values and votes of one text; voters follow the features."""
    found, insult = matches(text, known)
    v = votes(text, found, insult, lexicon)
    on = np.flatnonzero(v > 0)
    cols = np.concatenate((np.fromiter(found, dtype=np.int64, count=len(found)), len(known) + on))
    vals = np.concatenate((np.log1p(np.fromiter(found.values(), dtype=float, count=len(found))), np.ones(len(on))))
    return cols, vals, v


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, unlabelled: int = UNLABELLED) -> dict:
    """The model, from ``labels(doc_id, toxic)`` outside the held-out fold."""
    usable = labels.where((fold(F.col("doc_id")) != 0) & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    order, scratch = F.xxhash64("doc_id"), Scratch(spark, "toxicity")
    some = usable.where("toxic = 1").orderBy(order, "doc_id").limit(LABELS).unionByName(usable.where("toxic = 0").orderBy(order, "doc_id").limit(LABELS))
    drawn = scratch.write(docs.where(fold(F.col("doc_id")) != 0).select("doc_id").orderBy(order, "doc_id").limit(2 * unlabelled).distinct())
    has = labels.join(F.broadcast(drawn), "doc_id", "left_semi").select("doc_id").distinct()  # at most 2 * unlabelled ids
    others = drawn.join(F.broadcast(has), "doc_id", "left_anti").orderBy(order, "doc_id").limit(unlabelled).select("doc_id", F.lit(-1).alias("toxic"))
    # At most 2 * LABELS + unlabelled ids: the texts of the corpus stay where they are.
    training = docs.select("doc_id", "text").join(F.broadcast(some.unionByName(others)), "doc_id")
    training = scratch.write(training.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")))
    sampled = {r["toxic"]: r["count"] for r in training.groupBy("toxic").count().collect()}
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    names = induce(training.where("toxic >= 0").select("text", "toxic"), sampled.get(1, 0), sampled.get(0, 0))
    known = {f: j for j, f in enumerate(names)}
    lexicon = np.array([zlib.crc32(f.encode()) % LEXICONS for f in names], dtype=np.int64)
    chosen = [training.where(f"toxic = {y}").orderBy(F.xxhash64("doc_id", "text")).limit(most) for y, most in ((1, sample // 2), (0, sample // 2), (-1, unlabelled))]
    chosen = chosen[0].unionByName(chosen[1]).unionByName(chosen[2])

    def run(batches):
        for b in batches:
            rows = [_row(t or "", known, lexicon) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("toxic"), pa.array([r[0].tolist() for r in rows], pa.list_(pa.int64())), pa.array([r[1].tolist() for r in rows], pa.list_(pa.float64())), pa.array([r[2].tolist() for r in rows], pa.list_(pa.int32()))],
                names=["toxic", "cols", "vals", "votes"],
            )

    got = chosen.select("text", "toxic").mapInArrow(run, "toxic int, cols array<long>, vals array<double>, votes array<int>").collect() if counts else []
    scratch.drop(training, drawn)
    dim = len(names) + N_VOTERS
    if not any(r["toxic"] >= 0 for r in got):
        w = np.zeros(dim)
        w[len(names):-1] = 3.0
        return {"known": known, "lexicon": lexicon, "w": w, "b": -2.0, "labels": {}}
    v, y = np.array([r["votes"] for r in got]), np.array([r["toxic"] for r in got])
    # Labelled rows of either kind weigh as among all labelled rows; the others one each.
    taken = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    scale = (y >= 0).sum() / max(1, sum(counts.values()))
    weight = np.where(y >= 0, np.where(y == 1, counts.get(1, 0) / taken[1], counts.get(0, 0) / taken[0]) * scale, 1.0)
    post, about = label_model(v, y, weight)
    # Rows of which the label model is unsure teach less; of those without a label, whose posteriors rest on votes alone, a part.
    sure = weight * np.abs(2 * post - 1) * np.where(y >= 0, 1.0, UNLABELLED_WEIGHT)
    w, b = fit_linear([np.array(r["cols"], dtype=np.int64) for r in got], [np.array(r["vals"]) for r in got], dim, post, sure, LEAST_PRIOR)
    return {"known": known, "lexicon": lexicon, "w": w, "b": b, "labels": about | {"posterior": post, "given": y}}


def score(spark: SparkSession, docs: DataFrame, model: dict, keep: list[str], below: float | None = None) -> DataFrame:
    """``keep`` and ``score``; with ``below``, the rows of a lower score and ``keep`` alone."""
    keep = beside(keep, "score") if below is None else keep
    shared = spark.sparkContext.broadcast({k: model[k] for k in ("known", "lexicon", "w", "b")})  # at most FEATURES words

    def run(batches):
        m = shared.value
        for batch in batches:
            out = []
            for t in batch.column(place):
                cols, vals, _ = _row(t.as_py() or "", m["known"], m["lexicon"])
                out.append(1 / (1 + np.exp(-np.clip(m["w"][cols] @ vals + m["b"], -30, 30))))
            if below is None:
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(out, pa.float64())], names=[*keep, "score"])
            else:
                yield batch.select(keep).filter(pa.array(np.array(out) < below))

    place = next((i for i, c in enumerate(keep) if c.lower() == "text"), len(keep))
    source = docs.select(*keep) if place < len(keep) else docs.select(*keep, "text")
    schema = docs.select(*keep).schema if below is not None else docs.select(*keep).withColumn("score", F.lit(0.0)).schema
    return source.mapInArrow(run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(spark, docs, fit(spark, docs, labels), ["doc_id"])
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
