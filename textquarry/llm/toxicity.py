"""Toxicity by maximum-scoring segments of token log-odds.

Model.  Of every word and of its 5-byte and 4-byte prefixes, toxic and clean training
documents are counted.  A word is either indifferent or toxic: its share of toxic
documents has one of two Beta (two-class Dirichlet) priors, one tight around the share
among all documents, one near 1.  How many words are toxic is fitted over all counts,
from a prior share of them; what is left of a prefix's counts without the word's own
shifts the word's prior.  The log-odds of the mean share is the word's score, so that a
single toxic document proves little, whatever the sample's size, and unseen inflections
inherit what their stem shows.

Scan.  All maximal scoring segments of a text are found in linear time (Ruzzo and
Tompa, 1999).  Runs of tokens between two positive ones enter as one sum.

Calibration.  Scores of segments in random clean text follow an extreme-value law
E = K n exp(-lambda S) (Karlin and Altschul, 1990).  lambda solves
sum p(s) exp(lambda s) = 1 over clean tokens, K is fitted on clean documents.  A
document's statistic is the sum of max(0, lambda S - ln K n) over its segments (or that
of the best one where none is significant), and a one-dimensional logistic fit on the
training sample turns it into a chance.  Training documents are measured with scores
from which their own count is taken, as new documents would be.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import lgamma

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices, width
from .textnum import NON_WORD, Words, word_runs

#: Bound of the training sample, documents of each class.
SAMPLE_PER_CLASS = 6000
#: Prior of a toxic word's share of toxic documents, and weight of the prior of others.
TOXIC_PRIOR, OTHER_WEIGHT = (8.0, 1.0), 100.0
#: Toxic among all words, and how many words this guess weighs as much as.
TOXIC_SHARE, SHARE_WEIGHT = 0.002, 10_000.0
#: Weight of the longer prefix's chance in the prior of a word.
INHERIT = 0.5
DRIFT = 0.5
LEVELS = (None, 5, 4)
THRESHOLD = 0.7
#: A statistic beyond this (chance below 1e-5) adds nothing to the calibration.
CERTAIN = 12.0
#: Rows of a batch that are worked on at once.
SLICE = 1000

SCHEMA = "doc_id long, score double, n_tokens int, passages array<struct<first:int,last:int,score:double>>"


@dataclass
class Model:
    """Scores by level; ``less`` has those without one toxic (1) or clean (0) document of their count."""

    keys: list[np.ndarray]
    odds: list[np.ndarray]
    less: dict[int, list[np.ndarray]] = field(default_factory=dict)
    lam: float = 1.0
    log_k: float = 0.0
    slope: float = 1.0
    bias: float = 0.0

    def token_scores(self, w: Words, label: np.ndarray | None = None) -> np.ndarray:
        """Log-odds less the drift: of the word if known, else of its longest known prefix.

        ``label``: the class of each text, where the texts are those the model was fitted on.
        """
        out = np.zeros(len(w.hash))
        open_ = np.ones(len(out), bool)
        for level, (keys, odds, n) in enumerate(zip(self.keys, self.odds, LEVELS)):
            if not len(keys):
                continue
            h = w.hash if n is None else w.prefix(n)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = open_ & (keys[at] == h)
            out[hit] = odds[at[hit]] if label is None else np.where(label[w.doc[hit]] > 0, self.less[1][level][at[hit]], self.less[0][level][at[hit]])
            open_ &= ~hit
        return out - DRIFT

    def chance(self, statistic: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * statistic + self.bias, -500, 500))))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first, last, sum), in linear time."""
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    run = np.concatenate(([0.0], np.cumsum(scores)))
    stack: list[list] = []  # first, last, sum before, sum after
    for i in positive.tolist():
        seg = [i, i, run[i], run[i + 1]]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= seg[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= seg[3]:
                stack.append([*seg, j])
                break
            seg = [stack[j][0], seg[1], stack[j][2], seg[3]]
            del stack[j:]
    return [(a, b, float(hi - lo)) for a, b, lo, hi, _ in stack]


def statistic(segments: list[tuple[int, int, float]], n: int, m: Model) -> float:
    if not segments:
        return -m.log_k - np.log(max(n, 1))
    level = m.log_k + np.log(max(n, 1))
    x = [m.lam * s - level for _, _, s in segments]
    good = [v for v in x if v > 0]
    return min(float(sum(good)), CERTAIN) if good else float(max(x))


def _doc_scores(texts, m: Model, label: np.ndarray | None = None):
    """Token scores of every text in order; each is let go of once the words of the next one begin."""
    held: list[np.ndarray] = []
    at, none = 0, np.zeros(0)
    for w in word_runs(texts, NON_WORD):
        s = m.token_scores(w, label)
        cuts = np.flatnonzero(np.diff(w.doc)) + 1
        for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(s)]))) if len(s) else ():
            while at < w.doc[a]:
                yield np.concatenate(held) if held else none
                held, at = [], at + 1
            held.append(s[a:b])
    while at < len(texts):
        yield np.concatenate(held) if held else none
        held, at = [], at + 1


def _sample(docs: DataFrame, labels: DataFrame, learn, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """At most about SAMPLE_PER_CLASS labelled rows of each class, by hash of the id; equal texts of a class count once."""
    marked = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & learn)
    marked = marked.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    sizes = {r["_y"]: r["n"] for r in marked.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    u = F.pmod(F.xxhash64(F.col("_id"), F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    keep = F.lit(False)
    for y, n in sizes.items():
        keep = keep | ((F.col("_y") == y) & (u < SAMPLE_PER_CLASS / max(n, 1)))
    picked = marked.filter(keep)
    # at most 2 x SAMPLE_PER_CLASS rows of two integers
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    rows = texts.filter("_text is not null").join(F.broadcast(picked), F.col("_doc") == F.col("_id"))
    return rows.groupBy("_y", F.xxhash64("_text").alias("_h"), F.crc32("_text").alias("_c")).agg(F.first("_text").alias("_text")).select("_text", "_y")


def _count(batches):
    """Of each feature, how many toxic and clean documents hold it: a partial sum for each slice."""
    for pdf in slices(batches, SLICE // 4):
        y = pdf["_y"].to_numpy()
        runs: list[list[np.ndarray]] = [[] for _ in LEVELS]
        for w in word_runs(pdf["_text"].tolist(), NON_WORD):
            forms = [w.hash if n is None else w.prefix(n) for n in LEVELS] + [np.zeros(len(w.hash), np.uint64)]
            for level, run in enumerate(runs):
                run.append(np.stack([forms[level], w.doc.astype(np.uint64), forms[level + 1]]))
        for level, run in enumerate(runs):
            h, doc, up = np.concatenate(run, axis=1)
            order = np.lexsort((doc, h))
            h, doc, up = h[order], doc[order].astype(np.int64), up[order]
            once = np.ones(len(h), bool)
            once[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            keys, first, inv = np.unique(h[once], return_index=True, return_inverse=True)
            toxic = y[doc[once]].astype(float)
            yield pd.DataFrame(
                {
                    "level": np.full(len(keys), level, np.int32),
                    "key": keys.view(np.int64),
                    "parent": up[once][first].view(np.int64),
                    "a": np.bincount(inv, toxic, len(keys)).astype(np.int64),
                    "b": np.bincount(inv, 1 - toxic, len(keys)).astype(np.int64),
                }
            )


def _ln_beta_ratio(a: np.ndarray, b: np.ndarray, alpha: float, beta: float) -> np.ndarray:
    """ln B(alpha + a, beta + b) / B(alpha, beta), elementwise over distinct pairs."""
    got = {}
    for x, y in set(zip(a.tolist(), b.tolist())):
        got[x, y] = lgamma(alpha + x) + lgamma(beta + y) - lgamma(alpha + beta + x + y) - lgamma(alpha) - lgamma(beta) + lgamma(alpha + beta)
    return np.array([got[k] for k in zip(a.tolist(), b.tolist())])


def toxic_chance(a: np.ndarray, b: np.ndarray, p: float, prior: np.ndarray | float) -> np.ndarray:
    """Chance that a word in a toxic and b clean documents is toxic, where the share p of documents is."""
    other = _ln_beta_ratio(a, b, OTHER_WEIGHT * p, OTHER_WEIGHT * (1 - p))
    ratio = np.exp(np.clip(_ln_beta_ratio(a, b, *TOXIC_PRIOR) - other, -700, 500))
    return prior * ratio / (prior * ratio + 1 - prior)


def log_odds(a: np.ndarray, b: np.ndarray, p: float, chance: np.ndarray) -> np.ndarray:
    """Log-odds of the mean share of toxic documents, less those of all documents."""
    toxic = (a + TOXIC_PRIOR[0]) / (a + b + sum(TOXIC_PRIOR))
    other = (a + OTHER_WEIGHT * p) / (a + b + OTHER_WEIGHT)
    share = chance * toxic + (1 - chance) * other
    return np.log(share / (1 - share)) - np.log(p / (1 - p))


def fit_share(a: np.ndarray, b: np.ndarray, n: np.ndarray, p: float) -> float:
    """Share of toxic words among n words for each pair of counts, by expectation and maximisation."""
    share = TOXIC_SHARE
    for _ in range(30):
        got = float((n * toxic_chance(a, b, p, share)).sum())
        share = (got + SHARE_WEIGHT * TOXIC_SHARE) / (float(n.sum()) + SHARE_WEIGHT)
    return min(share, 0.5)


@dataclass
class Level:
    """Features of one length that score: key, toxic and clean documents, prefix, sorted by key; share of toxic ones."""

    key: np.ndarray
    a: np.ndarray
    b: np.ndarray
    parent: np.ndarray
    share: float

    def scores(self, above: "Level | None", p: float, da: int = 0, db: int = 0) -> np.ndarray:
        """Log-odds with da toxic and db clean documents less; ``above`` are the scoring prefixes."""
        a, b = np.maximum(self.a - da, 0), np.maximum(self.b - db, 0)
        prior = np.full(len(a), self.share)
        if above is not None:
            chance = np.zeros(len(a))
            if len(above.key):
                at = np.minimum(np.searchsorted(above.key, self.parent), len(above.key) - 1)
                known = np.flatnonzero(above.key[at] == self.parent)
                at = at[known]
                # what the prefix shows without this word
                rest = np.maximum(above.a[at] - self.a[known], 0), np.maximum(above.b[at] - self.b[known], 0)
                chance[known] = toxic_chance(*rest, p, above.share)
            prior = (1 - INHERIT) * prior + INHERIT * chance
        return log_odds(a, b, p, toxic_chance(a, b, p, prior))

    def only(self, rows: np.ndarray) -> "Level":
        return Level(self.key[rows], self.a[rows], self.b[rows], self.parent[rows], self.share)


def scoring_features(spark: SparkSession, counts: DataFrame, p: float) -> Model:
    """The features that score above the drift, and those of a prefix that does.

    Levels are read from the shortest prefixes on.  A feature without a scoring prefix scores
    by its counts alone, so that a table of pairs of counts tells which to read.
    """
    hist = counts.groupBy("level", "a", "b").agg(F.count("*").alias("n")).toPandas()
    above, out = None, Model([], [], {0: [], 1: []})
    for level in reversed(range(len(LEVELS))):
        pairs = hist[hist.level == level]
        a, b = pairs.a.to_numpy(np.int64), pairs.b.to_numpy(np.int64)
        share = fit_share(a, b, pairs.n.to_numpy(float), p) if len(pairs) else TOXIC_SHARE
        high = log_odds(a, b, p, toxic_chance(a, b, p, share if above is None else (1 - INHERIT) * share)) > DRIFT
        own = counts.filter(F.col("level") == level)
        # both sides that are sent come from the bounded sample: pairs of counts, and prefixes that score
        some = own.join(F.broadcast(spark.createDataFrame(pa.table({"a": a[high], "b": b[high]}))), ["a", "b"], "left_semi").select("key", "a", "b", "parent")
        if above is not None:
            under = own.join(F.broadcast(spark.createDataFrame(pa.table({"parent": above.key}))), "parent", "left_semi")
            some = some.unionByName(under.select("key", "a", "b", "parent")).distinct()
        got = some.toPandas().sort_values("key")
        table = Level(*(got[c].to_numpy(np.int64) for c in ("key", "a", "b", "parent")), share)
        order = np.argsort(table.key.view(np.uint64))
        odds = table.scores(above, p)
        out.keys.insert(0, table.key.view(np.uint64)[order])
        out.odds.insert(0, odds[order])
        for y in (0, 1):
            out.less[y].insert(0, table.scores(above, p, y, 1 - y)[order])
        above = table.only(odds > DRIFT)
    return out


def fit(docs: DataFrame, labels: DataFrame, learn, id_col="doc_id", text_col="text", label_col="toxic") -> Model:
    """Fit on a bounded sample of the labelled rows for which ``learn`` (over ``labels``) holds."""
    spark = docs.sparkSession
    rows = _sample(docs, labels, learn, id_col, text_col, label_col).repartition(width(spark))
    sizes = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        empty = [np.zeros(0, np.uint64)] * len(LEVELS)
        return Model(empty, [np.zeros(0)] * len(LEVELS), bias=-3.0 if not n1 else 3.0, slope=0.0)
    p = n1 / (n1 + n0)
    counts = rows.mapInPandas(_count, "level int, key long, parent long, a long, b long")
    counts = counts.groupBy("level", "key").agg(F.first("parent").alias("parent"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    scratch = Scratch(spark, "toxicity")
    counts = scratch.save(counts, "counts")
    m = scoring_features(spark, counts, p)
    scratch.drop(counts)

    # token histogram of clean documents, then (segment sums, length, label) of every sampled document
    box = spark.sparkContext.broadcast(m)

    def measure(batches):
        for pdf in slices(batches, SLICE):
            label, out = pdf["_y"].to_numpy(), []
            for i, s in enumerate(_doc_scores(pdf["_text"].tolist(), box.value, label)):
                segs = [x for _, _, x in maximal_segments(s)]
                hist = np.bincount(np.clip(np.round((s + 10) * 10), 0, 200).astype(int), minlength=201)
                out.append((int(label[i]), len(s), segs, hist.tolist()))
            yield pd.DataFrame(out, columns=["y", "n", "segs", "hist"])

    # 2 x SAMPLE_PER_CLASS rows of about a kilobyte
    seen = rows.mapInPandas(measure, "y int, n int, segs array<double>, hist array<int>").toPandas()
    clean = seen[seen.y == 0]
    hist = np.stack(clean["hist"].tolist()).sum(0).astype(float) if len(clean) else np.ones(201)
    at = (np.arange(201) - 100) / 10
    hist = hist + np.where(at > 0, 1e-9 * hist.sum() + 1e-3, 0)
    q = hist / hist.sum()
    lo, hi = 1e-3, 20.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (q * np.exp(np.minimum(mid * at, 700))).sum() < 1 else (lo, mid)
    m.lam = lo
    best = [max(s, default=0.0) for s in clean.segs]
    ratio = np.array([np.exp(-m.lam * b) * max(n, 1) for b, n in zip(best, clean.n)])
    m.log_k = float(-np.log(max(ratio.mean(), 1e-12))) if len(ratio) else 0.0
    x = np.array([statistic([(0, 0, s) for s in segs], n, m) for segs, n in zip(seen.segs, seen.n)])
    y = seen.y.to_numpy(float)
    # labels hold some errors: rows that a first fit flatly contradicts don't shape the second
    m.slope, m.bias = _logistic(x, y)
    chance = 1 / (1 + np.exp(-np.clip(m.slope * x + m.bias, -30, 30)))
    fair = np.abs(chance - y) < 0.9
    if len(set(y[fair])) == 2:
        m.slope, m.bias = _logistic(x[fair], y[fair])
    m.less = {}
    return m


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Newton's method with class-balanced weights and a small ridge."""
    scale = max(float(np.std(x)), 1e-9)
    centre = float(np.mean(x))
    a = np.stack([(x - centre) / scale, np.ones_like(x)], 1)
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = a.T @ (weight * (y - p)) - ridge * len(x) * np.array([b[0], 0]) * 0.01
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag([ridge * len(x) * 0.01 + 1e-9, 1e-9])
        step = np.linalg.solve(h, g)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0] / scale), float(b[1] - b[0] * centre / scale)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's chance of being toxic and its significant passages (word indices, from 0).

    Null and empty texts have no tokens and get the score of a text without evidence.
    Rows, repeated ones too, are kept; other columns are ignored.
    """
    box = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = box.value
        for pdf in slices(batches, SLICE):
            out = []
            for s in _doc_scores(pdf["text"].tolist(), m):
                segs = maximal_segments(s)
                level = m.log_k + np.log(max(len(s), 1))
                good = [(a, b, float(v)) for a, b, v in segs if m.lam * v > level]
                out.append((m.chance(statistic(segs, len(s), m)), len(s), good))
            part = pd.DataFrame(out, columns=["score", "n_tokens", "passages"])
            part.insert(0, "doc_id", pdf["doc_id"].array)
            yield part

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, SCHEMA)


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score below ``threshold``."""
    box = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = box.value
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                scored = (m.chance(statistic(maximal_segments(s), len(s), m)) for s in _doc_scores(batch.column(text_col).to_pylist(), m))
                yield batch.filter(pa.array([x < threshold for x in scored], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, learn, train_docs: DataFrame | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """Fit on ``labels`` where ``learn`` holds (texts from ``train_docs``), then score all of ``docs``."""
    model = fit(docs if train_docs is None else train_docs, labels, learn)
    return score(docs, model).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
