"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton of a bounded amount of labelled text answers, one
symbol at a time, how far the text at hand still occurs in it.  A text is parsed
greedily into longest matches; the language whose automaton needs the fewest phrases
for the text's length is the likeliest (Ziv and Merhav, 1993).

Text is lower-cased, everything but letters and their marks becomes one blank.  An
automaton's edges, at most three for each symbol it was built from whatever its alphabet,
lie in an open hash table, so that many windows of text advance by one symbol in a few
array operations.  Windows of ``WINDOW`` symbols are parsed apart and their phrases added,
which bounds memory and leaves no part of a text out; a cut costs every language one
phrase at most.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bounds of what an automaton is built from: documents and symbols of each language.
TRAIN_DOCS = 48
TRAIN_CHARS = 24_000
CHARS_PER_DOC = 2_000
#: Languages of one model: each has a table of its own in every worker. More make several models, one worker after the other.
MAX_LANGUAGES = 200
#: Names of languages that the driver lists.
MAX_NAMES = 100_000
WINDOW = 2048
#: Windows advanced together.
LANES = 4096
SHARPNESS = 40.0

_LETTER: np.ndarray | None = None
_MARK = np.uint32(1 << 31)
_HASH = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> np.ndarray:
    """For every code point itself if it is a letter, with a high bit if it is a mark on one, else a blank."""
    global _LETTER
    if _LETTER is None:
        table = np.full(0x110000, 32, np.uint32)
        for c in (*range(0x32400), *range(0xE0000, 0xE0200)):  # no letters or marks elsewhere
            kind = unicodedata.category(chr(c))[0]
            if kind in "LM":
                table[c] = c if kind == "L" else _MARK | np.uint32(c)
        _LETTER = table
    return _LETTER


def symbols(text: str | None) -> np.ndarray:
    """Code points of the lower-cased letters and marks with single blanks between runs; empty without a letter."""
    if not isinstance(text, str) or not text:
        return np.zeros(0, np.uint32)
    cps = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = cps == 32
    if not (~blank & (cps < _MARK)).any():
        return np.zeros(0, np.uint32)
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # the first blank after a letter
    return cps[keep] & ~_MARK


@dataclass
class Automaton:
    """Edges in an open hash table: key state * n_symbols + symbol (-1: free), and the state an edge leads to."""

    keys: np.ndarray
    to: np.ndarray
    first: np.ndarray  # state after each symbol from the start, -1 where there is none
    n_symbols: int

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """States after one symbol, -1 where there is no edge."""
        key = state * self.n_symbols + symbol
        mask = len(self.keys) - 1
        at = ((key.view(np.uint64) * _HASH) >> np.uint64(40)).view(np.int64) & mask
        found = self.keys[at]
        out = np.where(found == key, self.to[at], -1)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.to[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


def suffix_automaton(s: np.ndarray, n_symbols: int) -> Automaton:
    """The automaton of all substrings of s."""
    size = 2 * len(s) + 1
    step: list[dict[int, int]] = [{}]
    link, length = [-1] * size, [0] * size
    last = 0
    for c in s.tolist():
        cur = len(step)
        step.append({})
        length[cur] = length[last] + 1
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                length[clone] = length[p] + 1
                link[clone] = link[q]
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    key = np.array([i * n_symbols + c for i, edges in enumerate(step) for c in edges], np.int64)
    to = np.array([x for edges in step for x in edges.values()], np.int32)
    slots = 1 << max(4, (4 * len(key)).bit_length())
    keys, values = np.full(slots, -1, np.int64), np.full(slots, -1, np.int32)
    at = ((key.view(np.uint64) * _HASH) >> np.uint64(40)).view(np.int64) & (slots - 1)
    left = np.arange(len(key))
    while len(left):  # one edge takes each free slot, the others look further on
        free = keys[at[left]] < 0
        take, one = np.unique(at[left[free]], return_index=True)
        won = left[free][one]
        keys[take], values[take] = key[won], to[won]
        left = np.setdiff1d(left, won, assume_unique=True)
        at[left] = np.where(keys[at[left]] >= 0, (at[left] + 1) & (slots - 1), at[left])
    first = np.full(n_symbols, -1, np.int32)
    for c, x in step[0].items():
        first[c] = x
    return Automaton(keys, values, first, n_symbols)


@dataclass
class Model:
    langs: list[str]
    alphabet: np.ndarray  # sorted code points; symbol 0 stands for all others
    tables: list[Automaton]

    def encode(self, cps: np.ndarray) -> np.ndarray:
        if not len(self.alphabet):
            return np.zeros(len(cps), np.int32)
        at = np.minimum(np.searchsorted(self.alphabet, cps), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == cps, at + 1, 0).astype(np.int32)


def phrases(lanes: np.ndarray, lengths: np.ndarray, m: Automaton) -> np.ndarray:
    """Phrases of the greedy parse of every lane [symbols, lanes]; lanes sorted by falling length."""
    n = lanes.shape[1]
    state, count = np.full(n, -1), np.zeros(n, np.int64)  # -1: the next symbol starts a phrase
    live = np.searchsorted(-lengths, -np.arange(1, lanes.shape[0] + 1), "right")
    for t in range(lanes.shape[0]):
        k = live[t]
        c = lanes[t, :k].astype(np.int64)
        to = m.step(state[:k], c)
        end = np.flatnonzero(to < 0)
        if len(end):
            count[end] += 1
            to[end] = m.first[c[end]]  # a symbol that the language lacks is a phrase by itself
        state[:k] = to
    return count


def parse(texts: list, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Phrases [texts, languages] and symbols of every text."""
    total = np.zeros((len(texts), max(len(m.langs), 1)), np.int64)
    sizes = np.zeros(len(texts), np.int64)
    pend: list[np.ndarray] = []
    owner: list[int] = []

    def flush():
        lengths = np.array([len(p) for p in pend])
        order = np.argsort(-lengths, kind="stable")
        lanes = np.zeros((int(lengths.max()), len(pend)), np.int32)
        for j, i in enumerate(order.tolist()):
            lanes[: lengths[i], j] = pend[i]
        who = np.array(owner)[order]
        for k, step in enumerate(m.tables):
            np.add.at(total[:, k], who, phrases(lanes, lengths[order], step))
        pend.clear()
        owner.clear()

    for i, text in enumerate(texts):
        cps = symbols(text)
        sizes[i] = len(cps)
        codes = m.encode(cps)
        for at in range(0, len(codes), WINDOW):
            pend.append(codes[at : at + WINDOW])
            owner.append(i)
            if len(pend) >= LANES:
                flush()
    if pend:
        flush()
    return total, sizes


def _known(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame, list]:
    """Labelled rows to learn from, and their languages with the numbers of rows, the commonest first."""
    u = F.pmod(F.xxhash64(F.col(id_col), F.lit(29)), F.lit(1 << 30))
    known = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text"), u.alias("_u"))
    sizes = known.groupBy("_lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_lang").limit(MAX_NAMES + 1).collect()
    if len(sizes) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} values of {lang_col} to learn")
    return known, sizes


def fit(docs: DataFrame, learn: Column, id_col="doc_id", text_col="text", lang_col="lang") -> Model:
    """One model of all languages among labelled rows for which ``learn`` holds; ValueError if there are more than MAX_LANGUAGES."""
    known, sizes = _known(docs, learn, id_col, text_col, lang_col)
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} values of {lang_col} to learn")
    return _fit(known, sizes)


def fit_groups(docs: DataFrame, learn: Column, id_col="doc_id", text_col="text", lang_col="lang") -> list[Model]:
    """Models of MAX_LANGUAGES languages each, together of all."""
    known, sizes = _known(docs, learn, id_col, text_col, lang_col)
    return [_fit(known, sizes[at : at + MAX_LANGUAGES]) for at in range(0, max(len(sizes), 1), MAX_LANGUAGES)]


def _fit(known: DataFrame, sizes: list) -> Model:
    """Automata of the languages in ``sizes``: a bounded sample by hash of the id.

    Of a sampled text, a window that starts at a place chosen by hash is learned.
    """
    keep = F.lit(False)
    for r in sizes:  # before any shuffle, about four times the documents that are wanted
        keep = keep | ((F.col("_lang") == r["_lang"]) & (F.col("_u") < int(min(1.0, 4 * TRAIN_DOCS / r["n"]) * (1 << 30))))
    nth = F.row_number().over(Window.partitionBy("_lang").orderBy("_u", "_id"))
    turn = F.pmod(F.xxhash64("_id", F.lit(31)), F.lit(1 << 30))
    first = turn % (F.greatest(F.length("_text") - 4 * CHARS_PER_DOC, F.lit(0)) + 1) + 1
    window = F.col("_text").substr(first.cast("int"), F.lit(4 * CHARS_PER_DOC))
    rows = known.filter(keep).select("_lang", "_u", "_id", turn.alias("_turn"), window.alias("_text"))
    rows = rows.withColumn("nth", nth).filter(F.col("nth") <= TRAIN_DOCS).orderBy("_lang", "nth").collect()
    texts: dict[str, list[np.ndarray]] = {}
    for r in rows:
        got = texts.setdefault(r["_lang"], [])
        if sum(map(len, got)) < TRAIN_CHARS:
            part = symbols(r["_text"])
            at = r["_turn"] % (max(len(part) - CHARS_PER_DOC, 0) + 1)
            got.append(part[at : at + CHARS_PER_DOC])
    texts = {k: v for k, v in texts.items() if sum(map(len, v))}
    langs = sorted(texts)
    joined = {k: np.concatenate(texts[k])[:TRAIN_CHARS] for k in langs}
    alphabet = np.unique(np.concatenate(list(joined.values()))) if langs else np.zeros(0, np.uint32)
    m = Model(langs, alphabet, [])
    for k in langs:
        m.tables.append(suffix_automaton(m.encode(joined[k]), len(alphabet) + 1))
    return m


def predict(docs: DataFrame, model: Model | list[Model], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, n_symbols and phrases of the chosen language for every row.

    Null texts and texts without a letter are ``und`` with score 0, as is everything where
    nothing could be learned.  Ties go to the language that sorts first.  Of several models
    each adds what it finds to what those before it have found; the outcome is that of one
    model of all their languages.
    """
    models = model if isinstance(model, list) else [model]
    nothing = [F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("low"), *[F.lit(0).cast(k).alias(c) for c, k in (("odds", "double"), ("size", "long"), ("count", "long"))]]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *nothing)
    found = "doc_id long, lang string, low double, odds double, size long, count long"
    for n, m in enumerate(models, 1):
        last = n == len(models)  # texts go on to the next model
        rows = rows.mapInPandas(_better(docs.sparkSession.sparkContext.broadcast(m), last), found if last else f"text string, {found}")
    ok = F.col("lang").isNotNull()
    return rows.select(
        "doc_id", F.coalesce("lang", F.lit("und")).alias("lang_pred"), F.when(ok, 1 / F.col("odds")).otherwise(0.0).alias("score"),
        F.col("size").alias("n_symbols"), F.when(ok, F.col("count")).otherwise(0).alias("n_phrases"),
    )


def _better(box, last: bool):
    """Rows with the best language of theirs and the model's, its rate, and the sum of all languages' odds against it."""

    def run(batches):
        m = box.value
        names = np.array(m.langs or ["und"], object)
        for pdf in batches:
            count, size = parse(pdf["text"].tolist(), m)
            rate = count / np.maximum(size, 1)[:, None]
            best = rate.argmin(1)
            each = np.arange(len(rate))
            low, lang, own = rate[each, best], names[best], count[each, best]
            ok = (size > 0) & bool(m.langs)
            odds = np.where(ok, np.exp(-SHARPNESS * (rate - low[:, None])).sum(1), 0.0)
            was, old = pdf["low"].fillna(np.inf).to_numpy(float), pdf["lang"].fillna("").to_numpy(object)
            low = np.where(ok, low, np.inf)
            mine = (low < was) | ((low == was) & ok & (lang < old))
            least = np.minimum(low, was)
            known = np.isfinite(least)
            fade = lambda x: np.exp(-SHARPNESS * np.where(known & np.isfinite(x), x - np.where(known, least, 0.0), np.inf))
            odds = odds * fade(low) + pdf["odds"].to_numpy(float) * fade(was)
            pdf = (pdf.drop(columns="text") if last else pdf).assign(low=np.where(known, least, np.nan), odds=odds, size=size, count=np.where(mine, own, pdf["count"]))
            yield pdf.assign(lang=pd.Series(np.where(mine, lang, np.where(known, old, None)), dtype=object).where(lambda x: x.notna(), None))

    return run


def identify(spark: SparkSession, docs: DataFrame, learn: Column, train_docs: DataFrame | None = None) -> DataFrame:
    return predict(docs, fit_groups(docs if train_docs is None else train_docs, learn))
