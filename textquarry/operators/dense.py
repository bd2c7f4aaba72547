"""Vector index, content-addressed embedding cache and exact cosine search."""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import doubles, l2_normalize
from ..functions.text import fingerprint
from ..store import publish, published, stored

#: Queries that are compared with all vectors at once, and the most numbers in their matrix or among their scores.
BATCH, MATRIX = 4096, 1 << 21
#: Scores are ranked by their value in these units.
KEY = 1e9
#: Hash buckets whose digests tell whether an index is out of date.
BUCKETS = 4096
#: The most rounds that texts are embedded in; each reads its own part of them.
ROUNDS = 64


class EmbeddingProvider(Protocol):
    """Turns texts into vectors; an instance is shipped to executors and used once per batch."""

    model: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass
class DenseIndex:
    """``vectors(scope, doc_id, fingerprint, vector)`` with unit vectors of one dimension."""

    model: str
    vectors: DataFrame
    #: Digests of hash buckets of (doc_id, fingerprint), if they are stored.
    digests: DataFrame | None = None

    def save(self, path: str) -> None:
        """A new version at ``path``, with the digests that a check for staleness reads first."""
        tables = {"vectors": self.vectors.withColumn("model", F.lit(self.model))}
        if "fingerprint" in self.vectors.columns:
            tables["digests"] = bucket_digests(self.vectors)
        publish(self.vectors.sparkSession, path, tables)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "DenseIndex":
        at = published(spark, path)
        table = spark.read.parquet(f"{at}/vectors")
        first = table.select("model").first()
        digests = spark.read.parquet(f"{at}/digests") if "fingerprint" in table.columns else None
        return DenseIndex(first["model"] if first else "", table.drop("model"), digests)

    def dimension(self) -> int:
        """The common length of all vectors; ValueError if there are several."""
        sizes = [r[0] for r in self.vectors.select(F.size("vector")).distinct().limit(2).collect()]
        if len(sizes) > 1:
            raise ValueError("cached embeddings have inconsistent dimensions")
        return sizes[0] if sizes else 0


def from_vectors(vectors: DataFrame, doc_id: str, vector: str, scope: str | None = None, model: str = "given") -> DenseIndex:
    own = F.col(scope).cast("string") if scope else F.lit(None).cast("string")
    return DenseIndex(model, vectors.select(own.alias("scope"), F.col(doc_id).alias("doc_id"), l2_normalize(doubles(F.col(vector))).alias("vector")))


def cache_misses(docs: DataFrame, cache: DataFrame, model: str, text: str = "text") -> DataFrame:
    """(fingerprint, text) of each text, once, that the cache does not hold for this model."""
    asked = docs.select(fingerprint(F.col(text)).alias("fingerprint"), F.col(text).alias("text"))
    held = cache.filter(F.col("model") == model).select("fingerprint")
    return asked.join(held, "fingerprint", "left_anti").dropDuplicates(["fingerprint"])


def embed_missing(missing: DataFrame, provider: EmbeddingProvider, batch_size: int = 32) -> DataFrame:
    """(model, fingerprint, vector) of new texts, ``batch_size`` texts a call."""
    model = provider.model

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), batch_size):
                part = pdf.iloc[at : at + batch_size]
                got = provider.embed(part["text"].tolist())
                if len(got) != len(part):
                    raise ValueError("the provider returned another number of vectors than texts")
                yield pd.DataFrame({"model": model, "fingerprint": part["fingerprint"], "vector": [[float(x) for x in v] for v in got]})

    raw = missing.mapInPandas(run, "model string, fingerprint string, vector array<double>")
    return raw.withColumn("vector", l2_normalize(F.col("vector")))


CACHE_SCHEMA = "model string, fingerprint string, vector array<double>"


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache table, empty where nothing was written yet."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def build(
    docs: DataFrame, provider: EmbeddingProvider, cache_path: str, model: str | None = None, text: str = "text",
    doc_id: str = "doc_id", scope: str | None = None, batch_size: int = 32, round_texts: int = 2_000,
) -> DenseIndex:
    """Index ``docs``; only texts that the cache lacks are embedded, and they are appended to it, about ``round_texts`` or a
    ``ROUNDS``-th of them at a time, whichever is more."""
    spark = docs.sparkSession
    if round_texts < 1:
        raise ValueError("round_texts must be at least 1")
    if model is not None and provider.model != model:
        raise ValueError(f"provider model {provider.model!r} does not match index model {model!r}")
    missing = cache_misses(docs, load_cache(spark, cache_path), provider.model, text)
    missing = stored(missing.withColumn("slot", F.pmod(F.xxhash64("fingerprint"), F.lit(ROUNDS))), "missing", "slot")
    rounds = min(ROUNDS, -(-missing.count() // round_texts))
    for r in range(rounds):  # what a round has paid for is kept if a later one fails
        part = missing.filter(F.col("slot").isin(list(range(r, ROUNDS, rounds)))).select("fingerprint", "text")
        embed_missing(part, provider, batch_size).write.mode("append").parquet(cache_path)
    cache = load_cache(spark, cache_path).filter(F.col("model") == provider.model).dropDuplicates(["fingerprint"])
    own = F.col(scope).cast("string") if scope else F.lit(None).cast("string")
    keyed = docs.select(own.alias("scope"), F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("fingerprint"))
    index = DenseIndex(provider.model, keyed.join(cache.drop("model"), "fingerprint").select("scope", "doc_id", "fingerprint", "vector"))
    index.dimension()
    return index


def bucket_digests(rows: DataFrame) -> DataFrame:
    """(bucket, n, low, high) of rows (doc_id, fingerprint): sums of their hashes, which do not depend on order."""
    h = F.xxhash64("doc_id", "fingerprint")
    halves = [F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftright(h, 32)).alias("high")]
    return rows.groupBy(_bucket().alias("bucket")).agg(F.count("*").alias("n"), *halves)


def _bucket():
    return F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))


def differing(now: DataFrame, then: DataFrame) -> list[int]:
    """The buckets whose digests differ; there are ``BUCKETS`` at most."""
    cols = ("n", "low", "high")
    other = then.select("bucket", *[F.col(c).alias(f"was_{c}") for c in cols])
    same = F.lit(True)
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.col(f"was_{c}"))
    return [r["bucket"] for r in now.join(other, "bucket", "full_outer").filter(~same).select("bucket").collect()]


def stale(index: DenseIndex, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Documents whose id or text differs between the index and ``docs``: (doc_id, kind).

    Digests of hash buckets are compared first; rows meet only in buckets that differ, and
    of an index with stored digests nothing else is read while nothing has changed.
    """
    now = docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("fingerprint"))
    then = index.vectors.select("doc_id", "fingerprint")
    held = bucket_digests(then) if index.digests is None else index.digests
    odd = F.broadcast(docs.sparkSession.createDataFrame([(b,) for b in differing(bucket_digests(now), held)], "bucket long"))
    some = lambda rows, name: rows.withColumn("bucket", _bucket()).join(odd, "bucket", "left_semi").select("doc_id", F.col("fingerprint").alias(name))
    both = some(now, "f_now").join(some(then, "f_then"), "doc_id", "full_outer")
    kind = F.when(F.col("f_then").isNull(), "added").when(F.col("f_now").isNull(), "removed").otherwise("changed")
    return both.filter(~F.col("f_now").eqNullSafe(F.col("f_then"))).select("doc_id", kind.alias("kind"))


def validate(index: DenseIndex, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> None:
    if stale(index, docs, text, doc_id).limit(1).count():
        raise ValueError("the dense index does not match the current chunks; embed them again")


def _nearest(qids: list, matrix: np.ndarray, scopes: list | None, k: int):
    """Of a task's vectors the ``k`` nearest to each query: blocks of vectors times the queries' matrix, and a bounded list."""
    own = {s: np.array([i for i, x in enumerate(scopes) if x == s]) for s in set(scopes)} if scopes is not None else None

    def run(batches):
        best: list[list] = [[] for _ in qids]
        least = np.full(len(qids), np.iinfo(np.int64).min)
        step = max(1, MATRIX // len(qids))  # scores at once
        for pdf in (whole.iloc[at : at + step].reset_index(drop=True) for whole in batches for at in range(0, len(whole), step)):
            parts = [(np.arange(len(qids)), np.arange(len(pdf)))]
            if own is not None:
                rows = pdf.groupby("scope").indices  # null scopes fall out
                parts = [(own[s], rows[s]) for s in rows if s in own]
            ids = pdf["doc_id"].tolist()
            for which, rows in parts:
                if not len(rows):
                    continue
                scores = matrix[which] @ np.stack(pdf["vector"].to_numpy()[rows]).T
                keys = np.floor(scores * KEY + 0.5).astype(np.int64)
                for j in np.flatnonzero((keys >= least[which][:, None]).any(axis=1)):
                    q, row = which[j], keys[j]
                    worst = max(least[q], np.partition(row, -k)[-k]) if len(row) > k else least[q]
                    some = np.flatnonzero(row >= worst)
                    found = best[q] + [(-int(row[i]), ids[rows[i]], float(scores[j, i])) for i in some]
                    best[q] = heapq.nsmallest(k, found)
                    least[q] = -best[q][-1][0] if len(best[q]) == k else least[q]
        out = [(qids[q], ident, score, -key) for q, rows in enumerate(best) for key, ident, score in rows]
        yield pd.DataFrame(out, columns=["qid", "doc_id", "score", "key"])

    return run


def _batches(queries: DataFrame, size: int):
    """The queries in lists of about ``size`` rows; most batches of questions are one."""
    rows = queries.limit(size + 1).collect()
    if len(rows) <= size:
        yield rows
        return
    parts = -(-2 * queries.count() // size)
    for i in range(parts):
        yield queries.filter(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i).collect()


def search(index: DenseIndex, queries: DataFrame, top_k: int = 10, scoped: bool = False, dim: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, score, rank): the ``top_k`` nearest documents of every query, scores to eight places.

    Exact: vectors stay where they are and meet the queries' matrix in blocks, a bounded
    number of queries at a time; each task keeps its best, which are merged.  With
    ``scoped`` a query meets the vectors of its scope.  ``allowed`` (doc_id) restricts the
    search to a set of documents.  Scores are ranked by their value to nine places, ties by id.
    """
    if allowed is not None:
        index = DenseIndex(index.model, index.vectors.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi"))
    dim = index.dimension() if dim is None else dim
    if dim and queries.filter(F.size("vector") != dim).limit(1).count():
        raise ValueError(f"a query has another dimension than the index, {dim}")
    spark, v, asked = index.vectors.sparkSession, index.vectors, queries.select("qid", *(["scope"] if scoped else []), l2_normalize(doubles(F.col("vector"))).alias("q"))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"qid {kind(queries, 'qid')}, doc_id {kind(v, 'doc_id')}, score double, key long"
    rows = v.filter("doc_id is not null and vector is not null").select("doc_id", *(["scope"] if scoped else []), "vector")
    found = []
    for part in _batches(asked.filter("q is not null"), max(1, min(BATCH, MATRIX // max(dim, 1)))):
        if part and dim:
            run = _nearest([r["qid"] for r in part], np.array([r["q"] for r in part]), [r["scope"] for r in part] if scoped else None, top_k)
            found.append(rows.mapInPandas(run, schema))
    hits = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)
    best = Window.partitionBy("qid").orderBy(F.desc("key"), "doc_id")
    hits = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_k)
    return hits.select("qid", "doc_id", F.round("score", 8).alias("score"), "rank")
