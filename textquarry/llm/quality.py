"""Document quality by co-training two views (Blum and Mitchell, 1998).

View one sees the text's content: shares of character classes, repetition, word shapes
and hashed words.  View two sees the page's metadata: length, layout of lines, language
and source.  Each round both views are fitted, every unlabelled document is scored by both,
and each view hands documents it is sure of, as pseudo-labels, to the other.  At the end
each view is calibrated on labelled rows that neither was fitted on, and their log-odds
are combined by a fit on the same rows.

The pool is all that is unlabelled: features of the whole table are stored once, and a round
reads them.  What a fit learns from is bounded: a sample of labelled rows, and of the
documents that a view is sure of some for each round, dealt by a hash.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch
from .textnum import BLANKS, Words, word_runs

#: Bounds of what a fit learns from: labelled documents of each class, and documents that a view hands over in a round.
LABELLED_PER_CLASS = 3000
HANDED = 300
ROUNDS = 5
SURE = 0.97
PSEUDO_WEIGHT = 0.5
HASHED_WORDS = 64
HASHED_META = 32
RIDGE = 1.0
THRESHOLD = 0.5

_CLASS = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (
        1 if "a" <= _c <= "z" else 2 if "A" <= _c <= "Z" else 3 if "0" <= _c <= "9" else 4 if _c == " " else 5 if _c in "\n\r"
        else 6 if _c in ".,;:?'\"-()" else 7 if _c == "!" else 8 if _c in "|/\\<>[]{}=_~" else 9 if 32 < _b < 127 else 10 if _b >= 128 else 0
    )
N_CLASSES = 11
N_TEXT = N_CLASSES + 7 + HASHED_WORDS
N_META = 6 + 2 * HASHED_META


def _per_doc(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Content features, lines and longest line of every text."""
    n = len(texts)
    classes = np.zeros((n, N_CLASSES))
    lines, longest = np.zeros(n), np.zeros(n)
    for i, t in enumerate(texts):
        if isinstance(t, str) and t:
            b = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
            for at in range(0, len(b), 1 << 20):
                classes[i] += np.bincount(_CLASS[b[at : at + (1 << 20)]], minlength=N_CLASSES)
            cut = np.flatnonzero(b == 10)
            lines[i] = len(cut) + 1
            longest[i] = np.diff(cut, prepend=-1, append=len(b)).max() - 1
    total = np.maximum(classes.sum(1, keepdims=True), 1)
    words, distinct, twice, pairs, length = (np.zeros(n) for _ in range(5))
    bins = np.zeros((n, HASHED_WORDS))
    held: dict[int, list[np.ndarray]] = {}
    for w in word_runs(texts, BLANKS):
        if not len(w.hash):
            continue
        words += np.bincount(w.doc, minlength=n)
        length += np.bincount(w.doc, w.end - w.start, n)
        same = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        twice += np.bincount(w.doc[1:][same], minlength=n)
        np.add.at(bins, (w.doc, (w.hash & np.uint64(HASHED_WORDS - 1)).astype(int)), 1)
        held_here(held, w)
    for i, parts in held.items():
        h = np.concatenate(parts)
        distinct[i] = len(np.unique(h))
        pairs[i] = len(np.unique(h[1:] * np.uint64(3) + h[:-1]))
    m = np.maximum(words, 1)
    letters = np.maximum(classes[:, 1] + classes[:, 2], 1)
    x = np.column_stack(
        [
            classes / total,
            classes[:, 2] / letters,
            twice / m,
            distinct / m,
            distinct / np.maximum(m, 1) ** 0.85,
            pairs / np.maximum(m - 1, 1),
            length / m / 10,
            np.log1p(words) / 5,
            bins / m[:, None],
        ]
    )
    return x, lines, longest


def held_here(held: dict[int, list[np.ndarray]], w: Words) -> None:
    cut = np.flatnonzero(np.diff(w.doc)) + 1
    for a, b in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(w.doc)]))):
        held.setdefault(int(w.doc[a]), []).append(w.hash[a:b])


def _hashed(values, n: int) -> np.ndarray:
    """One column for each of n hash classes; a null has none."""
    h = pd.util.hash_array(np.array([("" if v is None or v != v else str(v)) for v in values], object)) % n
    out = np.zeros((len(h), n))
    ok = np.array([not (v is None or v != v) for v in values], bool)
    out[np.arange(len(h))[ok], h[ok].astype(int)] = 1
    return out


def view_features(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Both views of rows with columns text, lang, source, n_chars."""
    text, lines, longest = _per_doc(pdf["text"].tolist())
    size = pd.to_numeric(pdf["n_chars"], errors="coerce").fillna(0).clip(lower=0).to_numpy(float)
    meta = np.column_stack(
        [
            np.log1p(size) / 5,
            np.log1p(lines) / 5,
            np.log1p(size / np.maximum(lines, 1)) / 5,
            np.log1p(longest) / 5,
            longest / np.maximum(size, 1),
            size == 0,
            _hashed(pdf["lang"].tolist(), HASHED_META),
            _hashed(pdf["source"].tolist(), HASHED_META),
        ]
    )
    return text, np.nan_to_num(meta)


@dataclass
class Linear:
    """A ridge logistic model with standardised inputs and a Platt calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    a: float = 1.0
    b: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight[:-1] + self.weight[-1]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.a * self.raw(x) + self.b, -12, 12)


def _newton(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float) -> np.ndarray:
    z = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    beta = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        g = z.T @ (w * (y - p)) - penalty * beta
        h = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9)
        step = np.linalg.solve(h, g)
        beta += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit_linear(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Linear:
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    return Linear(mean, scale, _newton(np.clip((x - mean) / scale, -8, 8), y, w, RIDGE))


def _platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset for raw scores, with Platt's smoothed targets."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
    b = _newton(raw[:, None], np.where(y > 0, hi, lo), np.ones(len(y)), 1e-2)
    return float(b[0]), float(b[1])


@dataclass
class Model:
    text: Linear | None = None
    meta: Linear | None = None
    blend: np.ndarray = field(default_factory=lambda: np.array([1.0, 1.0, 0.0]))
    prior: float = 0.5
    handed: list[tuple[int, int]] = field(default_factory=list)

    def score(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None:
            same = np.full(len(xt), self.prior)
            return same, same, same
        lt, lm = self.text.logit(xt), self.meta.logit(xm)
        both = np.clip(self.blend[0] * lt + self.blend[1] * lm + self.blend[2], -30, 30)
        return tuple(1 / (1 + np.exp(-v)) for v in (both, lt, lm))


def co_train(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, hand_over) -> Model:
    """Rounds of mutual pseudo-labelling, then calibration and blending on every fourth labelled row.

    ``hand_over(views, given, share)`` gives, for each view ("t", "m"), features and labels of
    documents that the other view is sure of; ``given`` are the rows each view has already.
    """
    if len(set(y.tolist())) < 2:
        return Model(prior=float(y.mean()) if len(y) else 0.5)
    held = np.zeros(len(y), bool)
    for c in (0, 1):
        held[np.flatnonzero(y == c)[::4]] = True
    if len(set(y[~held].tolist())) < 2:
        held[:] = False
    cal = held if held.any() and len(set(y[held].tolist())) == 2 else ~held
    own = {"t": xt[~held], "m": xm[~held]}
    calx = {"t": xt[cal], "m": xm[cal]}
    base = np.where(y[~held] > 0, 0.5 / y[~held].mean(), 0.5 / (1 - y[~held].mean()))
    learned = {v: ([own[v]], [y[~held]]) for v in "tm"}
    given: dict[str, list[int]] = {"t": [], "m": []}
    model = Model()
    views: dict[str, Linear] = {}
    for r in range(ROUNDS + 1):
        for v in "tm":
            x, labels = (np.concatenate(z) for z in learned[v])
            views[v] = fit_linear(x, labels, np.concatenate([base, np.full(len(x) - len(base), PSEUDO_WEIGHT)]))
            views[v].a, views[v].b = _platt(views[v].raw(calx[v]), y[cal].astype(float))
        if r == ROUNDS:
            break
        sent = hand_over(views, given, float(y.mean()))
        for v, (rows, x, labels) in sent.items():
            given[v] += rows
            learned[v][0].append(x)
            learned[v][1].append(labels)
        model.handed.append((len(sent["m"][0]), len(sent["t"][0])))
        if not any(model.handed[-1]):
            break
    model.text, model.meta = views["t"], views["m"]
    z = np.column_stack([views["t"].logit(calx["t"]), views["m"].logit(calx["m"])])
    model.blend = _newton(z, y[cal].astype(float), np.ones(int(cal.sum())), 1.0)
    return model


def _columns(docs: DataFrame) -> list[Column]:
    """The columns a view reads, null where the table lacks one."""
    have = set(docs.columns)
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return [(F.col(c).cast(k) if c in have else F.lit(None).cast(k)).alias(c) for c, k in kinds.items()]


WIDTH = {"t": N_TEXT, "m": N_META}


def _matrix(blobs, view: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float32).reshape(-1, WIDTH[view]).astype(float)


def features(scratch: Scratch, docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """doc_id, rid, free, u, t, m of every row: both views as packed numbers, whether no label is known, and a hash to deal by."""

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                t, m = (x.astype(np.float32) for x in view_features(part))
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "t": [r.tobytes() for r in t], "m": [r.tobytes() for r in m]})

    raw = scratch.save(docs.select(*_columns(docs)).mapInPandas(run, "doc_id long, t binary, m binary"), "features")
    known = labelled.select(F.col("doc_id").cast("long").alias("_id")).filter("_id is not null").distinct().withColumn("_known", F.lit(True))
    rows = raw.join(known, F.col("doc_id") == F.col("_id"), "left")
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("rid"), F.col("_known").isNull().alias("free"), F.xxhash64("doc_id", "t", "m").alias("u"), "t", "m")
    out = scratch.save(rows, "views")
    scratch.drop(raw)
    return out


def _sure(views: dict[str, Linear], given: dict[str, list[int]], most: dict[bool, int]):
    """Of unlabelled documents those that a view is sure of and the other view has not been given: at most ``most`` of a batch."""
    have = {v: np.array(rows, np.int64) for v, rows in given.items()}

    def run(batches):
        for pdf in batches:
            out = []
            for v, to in (("t", "m"), ("m", "t")):
                p = 1 / (1 + np.exp(-views[v].logit(_matrix(pdf[v], v))))
                sure = (np.maximum(p, 1 - p) >= SURE) & ~np.isin(pdf["rid"].to_numpy(), have[to])
                for up, n in most.items():
                    which = np.flatnonzero(sure & ((p >= 0.5) == up))
                    which = which[np.argsort(pdf["u"].to_numpy()[which], kind="stable")[:n]]
                    out.append(pdf.iloc[which][["rid", "u", to]].rename(columns={to: "x"}).assign(view=to, up=up))
            yield pd.concat(out)[["view", "up", "rid", "u", "x"]]

    return run


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", stored: DataFrame | None = None) -> Model:
    """Co-train on a bounded sample of labelled rows where ``learn`` (over ``labels``) holds, and on all unlabelled documents.

    ``stored`` may give the features of ``docs``.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "quality-fit")
    marked = labels.filter(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & learn)
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    sizes = {r["_y"]: r["n"] for r in marked.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    u = F.pmod(F.xxhash64(F.col("_id"), F.lit(41)), F.lit(1 << 30)) / float(1 << 30)
    keep = F.lit(False)
    for c, n in sizes.items():
        keep = keep | ((F.col("_y") == c) & (u < LABELLED_PER_CLASS / max(n, 1)))
    rows = features(scratch, docs, labels) if stored is None else stored
    known = rows.join(F.broadcast(marked.filter(keep)), F.col("doc_id") == F.col("_id"))  # 2 x LABELLED_PER_CLASS ids
    # of rows that share a labelled id one is learned from
    known = known.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("u", "rid"))).filter("n = 1")
    known = known.select("doc_id", "_y", "t", "m").toPandas().sort_values(["_y", "doc_id"], kind="stable")
    pool = rows.filter("free").select("rid", "u", "t", "m")

    def hand_over(views, given, share):
        most = {True: int(HANDED * share) + 1, False: int(HANDED * (1 - share)) + 1}
        sure = pool.mapInPandas(_sure(dict(views), given, most), "view string, up boolean, rid long, u long, x binary")
        sure = sure.withColumn("n", F.row_number().over(Window.partitionBy("view", "up").orderBy("u", "rid")))
        got = sure.filter(F.col("n") <= F.when(F.col("up"), most[True]).otherwise(most[False])).toPandas().sort_values(["view", "up", "n"])
        out = {}
        for v in "tm":
            some = got[got["view"] == v]
            out[v] = some["rid"].tolist(), _matrix(some["x"], v), some["up"].to_numpy(float)
        return out

    model = co_train(_matrix(known["t"], "t"), _matrix(known["m"], "m"), known["_y"].to_numpy(float), hand_over)
    scratch.keep_only()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, text_score, meta_score for every row (chances of good quality).

    Null texts count as empty; a missing or null metadata value has no feature; repeated
    rows are each scored; other columns are ignored.
    """
    box = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                p, t, m = box.value.score(*view_features(part))
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "score": p, "text_score": t, "meta_score": m})

    return docs.select(*_columns(docs)).mapInPandas(run, "doc_id long, score double, text_score double, meta_score double")


def score_stored(rows: DataFrame, model: Model) -> DataFrame:
    """``score`` of rows whose features are stored."""
    box = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pdf in batches:
            p, t, m = box.value.score(_matrix(pdf["t"], "t"), _matrix(pdf["m"], "m"))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "score": p, "text_score": t, "meta_score": m})

    return rows.select("doc_id", "t", "m").mapInPandas(run, "doc_id long, score double, text_score double, meta_score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score at least ``threshold``."""
    box = docs.sparkSession.sparkContext.broadcast(model)
    kinds = {"text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()}

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                have = set(batch.schema.names)
                cols = {c: (batch.column(c).cast(k) if c in have else pa.nulls(batch.num_rows, k)) for c, k in kinds.items()}
                score, _, _ = box.value.score(*view_features(pa.table(cols).to_pandas()))
                yield batch.filter(pa.array(score >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def quality(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, learn: Column, train_docs: DataFrame | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """doc_id, score, text_score, meta_score and predicted of every row; texts are read once, into stored features."""
    if train_docs is not None:
        scored = score(docs, fit(train_docs, labels, learn))
    else:
        rows = features(Scratch(spark, "quality"), docs, labels)
        scored = score_stored(rows, fit(docs, labels, learn, stored=rows))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
