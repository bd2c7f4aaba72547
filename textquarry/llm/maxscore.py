"""Exact top-k inner products by MaxScore over sharded posting lists.

Vectors become whole numbers; a dimension is a term, and a shard holds one posting list per
term: the values of its candidates, in their order.  A task meets a shard and a block of
queries and does, for each query:

* a term's products lie between the query's weight times the shard's least and greatest
  value.  Terms are put in order of that range.  The last ones, as many as together cannot
  lift a candidate from the least possible score to the threshold, are non-essential;
* the essential lists are traversed, which gives every candidate a part of its score;
* candidates that can still reach the threshold with the greatest values of the terms left
  are probed in those terms, a few terms at a time, and leave when they cannot any more.

The threshold of a query is its k-th best score so far: it starts from one seed shard that
all queries meet and grows with the shards it has met in a cell.  A candidate that only equals it
stays, since a smaller id wins a tie.  What the shards keep is merged by a ranking.

Queries and shards meet in the cells of a grid, groups of shards by groups of query blocks:
both are cogrouped by the cell's number, so that a shard is read once a cell and neither side
ever passes through the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, width

TOP, QUERY_STEP, SCALE = 5, 50, 256
SHARD_ROWS, QUERY_ROWS = 2048, 256
#: Pairs of queries and candidates of a cell: larger tables make more cells, not larger ones.
PAIRS = 1 << 25
#: Terms that are probed before candidates are looked at again.
PROBE = 8
#: Rows with posting lists that pass to a worker at once.
PAIRS_AT_ONCE = 16
#: Whole-number components beyond this count as this, so that sums stay within 64 bits.
LARGEST = 1 << 26


def whole_numbers(vec: str, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null for vectors that are null or hold null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    number = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int")
    return F.when(~F.exists(vec, bad), F.transform(vec, number))


def _pack(rows: int, extra: bool):
    """Blocks of up to ``rows`` vectors: ids, and a posting list per term (term after term)."""

    def block(ids, keys, vecs):
        dims = max((len(v) for v in vecs), default=0)
        m = np.zeros((dims, len(vecs)), np.int32)
        for i, v in enumerate(vecs):
            m[: len(v), i] = v
        out = {"ids": np.asarray(ids, np.int64).tobytes(), "lists": m.tobytes(), "dims": dims}
        return out | ({"keys": np.asarray(keys, np.int64).tobytes()} if extra else {})

    def run(batches):
        ids, keys, vecs = [], [], []
        for pdf in batches:
            ids += pdf["id"].tolist()
            keys += pdf["key"].tolist() if extra else []
            vecs += pdf["v"].tolist()
            while len(ids) >= rows:
                yield pd.DataFrame([block(ids[:rows], keys[:rows], vecs[:rows])])
                ids, keys, vecs = ids[rows:], keys[rows:], vecs[rows:]
        if ids:
            yield pd.DataFrame([block(ids, keys, vecs)])

    return run


def _ints(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def _lists(raw: bytes, dims: int, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.int32).reshape(dims, n)


class Shard:
    """Posting lists of a shard with the bounds of each term; a dense list has an entry for every candidate."""

    def __init__(self, ids: bytes, lists: bytes, dims: int):
        self.ids = _ints(ids)
        own = _lists(lists, dims, len(self.ids))
        self.low, self.high = (f(axis=1).astype(np.int64) if len(self.ids) else np.zeros(dims, np.int64) for f in (own.min, own.max))
        # sums of products below 2^53 are exact in double precision, which numpy multiplies fastest
        self.exact = float(np.abs(own.astype(np.float64)).max(initial=0)) * dims
        self.whole, self.real = own, own.astype(np.float64)

    def best(self, q: np.ndarray, own_id: int, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of up to k candidates of at least the threshold, best first, and how many values were read."""
        terms = min(len(q), len(self.low))
        q = q[:terms].astype(np.int64)
        lists = self.real if self.exact * float(np.abs(q).max(initial=0)) < 2**53 else self.whole.astype(np.int64)
        a, b = q * self.low[:terms], q * self.high[:terms]
        most, least = np.maximum(a, b), np.minimum(a, b)
        order = np.argsort(least - most, kind="stable")
        q, most, span = q[order], most[order], (most - least)[order]
        left = np.append(np.cumsum(most[::-1])[::-1], 0)  # the most that terms i.. can give
        gain = np.append(np.cumsum(span[::-1])[::-1], 0)  # the most that they can give above their least
        # terms from `cut` on are non-essential: their gains alone do not reach the threshold
        cut = int(np.searchsorted(-(gain + int(least.sum())), -threshold, "right")) if threshold > -np.inf else terms
        cut = min(cut, terms)
        if not cut and terms and left[0] < threshold:
            return self.ids[:0], self.ids[:0], 0
        essential = order[:cut]
        score = q[:cut].astype(lists.dtype) @ lists[essential] if cut else np.zeros(len(self.ids), lists.dtype)
        read = cut * len(self.ids)
        who = np.flatnonzero((score + lists.dtype.type(left[cut]) >= threshold) & (self.ids != own_id))
        score = score[who]
        for at in range(cut, terms, PROBE):
            some = order[at : at + PROBE]
            score = score + q[at : at + PROBE].astype(lists.dtype) @ lists[np.ix_(some, who)]
            read += len(some) * len(who)
            if at + PROBE < terms:
                keep = score + lists.dtype.type(left[at + PROBE]) >= threshold
                who, score = who[keep], score[keep]
        keep = score >= threshold
        who, score = self.ids[who[keep]], score[keep].astype(np.int64)
        if len(who) > k:  # ties with the k-th best go to smaller ids
            kth = np.partition(score, -k)[-k]
            who, score = who[score >= kth], score[score >= kth]
        top = np.lexsort((who, -score))[:k]
        return who[top], score[top], read


def _meet(k: int):
    """Of a cell's shards and blocks of queries, the candidates that may be among a query's k best."""

    def run(shards: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none = np.zeros(0, np.int64)
        blocks = []
        for r in asked.itertuples():
            qids = _ints(r.q_ids)
            q = np.ascontiguousarray(_lists(r.q_lists, r.q_dims, len(qids)).T)
            blocks.append((qids, _ints(r.q_keys), q, np.frombuffer(r.seed, np.float64), [(none, none)] * len(qids)))
        for r in shards.itertuples():
            shard = Shard(r.ids, r.lists, r.dims)
            for qids, _, q, seed, best in blocks:
                for i in range(len(qids)):
                    ids, scores = best[i]
                    more, theirs, _ = shard.best(q[i], qids[i], k, max(seed[i], scores[-1] if len(scores) == k else -np.inf))
                    if len(more):
                        ids, scores = np.append(ids, more), np.append(scores, theirs)
                        top = np.lexsort((ids, -scores))[:k]
                        best[i] = ids[top], scores[top]
        cat = lambda x: np.concatenate([none, *x])
        n = cat([[len(ids) for ids, _ in b[4]] for b in blocks]).astype(np.int64)
        each = lambda j: np.repeat(cat([b[j] for b in blocks]), n)
        found = [f for b in blocks for f in b[4]]
        return pd.DataFrame({"query_id": each(0), "key": each(1), "vec_id": cat([f[0] for f in found]), "score": cat([f[1] for f in found])})

    return run


def _seed(k: int):
    """Query blocks with the k-th best score that each query has in the seed shard; -inf if it holds fewer."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                qids = _ints(r.q_ids)
                best = np.full(len(qids), -np.inf)
                if r.ids is not None:
                    shard, q = Shard(r.ids, r.lists, r.dims), _lists(r.q_lists, r.q_dims, len(qids)).T
                    for i in range(len(qids)):
                        scores = shard.best(q[i], qids[i], k, -np.inf)[1]
                        best[i] = scores[-1] if len(scores) == k else -np.inf
                out.append(best.tobytes())
            yield pd.DataFrame({c: pdf[c] for c in ("q_ids", "q_keys", "q_lists", "q_dims")} | {"seed": out})

    return run


def grid(shards: int, candidates: int, blocks: int, queries: int, least: int) -> tuple[int, int]:
    """Into how many groups shards and query blocks are put: about ``PAIRS`` pairs of rows meet in a cell, or there are
    ``least`` cells, and the copies that the cells need of both sides are as few as that allows."""
    cells = max(least, -(-candidates * queries // PAIRS))
    across = max(1, min(shards, math.ceil(math.sqrt(cells * candidates / max(1, queries)))))
    return across, max(1, min(blocks, -(-cells // across)))


def search(spark: SparkSession, queries: DataFrame, candidates: DataFrame, top: int = TOP, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id and score: the ``top`` best candidates of each query by inner product.

    Scores are sums of products of floor(scale * component); components beyond 2^26 after
    scaling count as that.  Ties go to the smaller id.  A candidate that has the query's id
    is its own row and takes no part for it; rows without an id, null vectors and vectors
    that hold null or non-finite components take no part at all.  A vector that ends early
    is zero beyond; an empty one scores 0.  A query row that repeats another asks once; an
    id with several vectors gets the best of each vector.  Repeated candidates count as
    often as they occur.  Without queries or candidates the result is empty.  Other columns
    are ignored.
    """
    scratch, n = Scratch(spark, "maxscore"), width(spark)

    def vectors(df: DataFrame) -> DataFrame:
        v = df.select(F.col(id_col).cast("long").alias("id"), whole_numbers(vec_col, scale).alias("v"))
        return v.filter("id is not null and v is not null")

    asked = vectors(queries).withColumn("key", F.xxhash64("id", "v")).dropDuplicates(["id", "v"])
    blocks = scratch.save(vectors(candidates).repartition(n).mapInPandas(_pack(SHARD_ROWS, False), "ids binary, lists binary, dims int"), "shards")
    asked = scratch.save(asked.mapInPandas(_pack(QUERY_ROWS, True), "ids binary, lists binary, dims int, keys binary"), "queries")
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in ("ids", "keys", "lists", "dims")])
    seed = blocks.limit(1)  # one shard, whatever the number of rows
    first = asked.withColumn("one", F.lit(1)).join(F.broadcast(seed.withColumn("one", F.lit(1))), "one", "left")
    asked = scratch.save(first.drop("one").mapInPandas(_seed(top), "q_ids binary, q_keys binary, q_lists binary, q_dims int, seed binary"), "seeded", PAIRS_AT_ONCE)
    size = lambda df, ids: df.agg(F.count("*"), F.coalesce(F.sum(F.length(ids)) / 8, F.lit(0)).cast("long")).first()
    across, down = grid(*size(blocks, "ids"), *size(asked, "q_ids"), 2 * spark.sparkContext.defaultParallelism)
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    shards = blocks.withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(across))).withColumn("h", number(down))
    turns = asked.withColumn("h", F.pmod(F.xxhash64("q_keys"), F.lit(down))).withColumn("g", number(across))
    cells = [df.withColumn("cell", F.col("g") * down + F.col("h")).drop("g", "h").repartition(across * down, "cell").groupBy("cell") for df in (shards, turns)]
    met = cells[0].cogroup(cells[1]).applyInPandas(_meet(top), "query_id long, key long, vec_id long, score long")
    met = scratch.save(met, "met", PAIRS_AT_ONCE)
    scratch.keep_only(met)
    best = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def every_nth(df: DataFrame, step: int = QUERY_STEP, id_col: str = "vec_id") -> DataFrame:
    """The rows whose id is divisible by ``step``."""
    return df.filter(F.col(id_col) % step == 0)
