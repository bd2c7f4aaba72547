"""Top-k BM25 that reads few postings: blocks by impact, a threshold first, then only what can reach it.

A posting's *part* is what BM25 gives it before the query's weight; it depends on the corpus
alone.  The index keeps, with the parts worked out:

* ``blocks(scope, term, level, salt, most, entries)``: postings of a term whose parts lie in
  one of ``LEVELS`` bands, at most about ``BLOCK`` of them, and the largest part of the block;
* ``terms(scope, term, df, idf, most, shares)``: stored statistics, no search counts them again;
* ``documents(scope, doc_id, parts)``: the same parts by document, to complete a score.

Search takes three steps.  The terms of the largest bounds are read whole; the k-th best sum
of theirs is a threshold that a query's results must reach.  Then terms are put in order of
their bounds; as many of the small ones as cannot reach the threshold together are
non-essential, and of the others only blocks are read from which a document can reach it.
Documents whose sum can still get there are completed from their own parts, and ranked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import ranked
from ..store import publish, published, stored
from .bm25 import BATCH, BM25Index, best_of, corpus_stats, held_terms, idf, query_terms, saturation

LEVELS = 16
BLOCK = 512
#: Terms of a question that are read for its threshold.
SEEDS = 4
#: Scores are ranked to nine places; bounds leave that much room.
SLACK = 1e-8


@dataclass
class ImpactIndex:
    blocks: DataFrame
    terms: DataFrame
    documents: DataFrame
    scoped: bool

    def save(self, path: str) -> None:
        """A new version at ``path``; blocks and terms clustered by term, documents by id, so that a search skips row groups."""
        tables = {
            "blocks": self.blocks.repartitionByRange("term", "level").sortWithinPartitions("term", "scope", "level"),
            "terms": self.terms.repartitionByRange("term").sortWithinPartitions("term", "scope"),
            "documents": self.documents.repartitionByRange("doc_id").sortWithinPartitions("doc_id"),
        }
        publish(self.blocks.sparkSession, path, tables)

    @staticmethod
    def load(spark: SparkSession, path: str, scoped: bool = False) -> "ImpactIndex":
        at = published(spark, path)
        return ImpactIndex(*(spark.read.parquet(f"{at}/{t}") for t in ("blocks", "terms", "documents")), scoped)


def build(index: BM25Index, scoped: bool = False, keep: bool = True) -> ImpactIndex:
    """The impact index of ``index``; with ``scoped`` statistics are those of each scope, else of the whole corpus.

    ``keep`` stores its tables; without, they are plans (to be saved, say).
    """
    scope = F.col("scope") if scoped else F.lit(None).cast("string")
    stats = corpus_stats(index.doc_stats).filter("not whole" if scoped else "whole").select(F.col("scope").alias("_scope"), "n", "avgdl").filter("avgdl > 0")
    posted = index.postings.withColumn("scope", scope)
    # one row a scope
    posted = posted.join(F.broadcast(stats), F.col("scope").eqNullSafe(F.col("_scope"))).drop("_scope")
    parts = posted.select("scope", "doc_id", "term", "n", saturation(F.col("tf"), F.col("dl"), F.col("avgdl"), index.k1, index.b).alias("part"))
    parts = stored(parts, "parts") if keep and index.term_stats is None else parts  # stored postings are read as fast
    terms = parts.groupBy("scope", "term").agg(F.count("*").alias("df"), F.max("part").alias("most"), F.first("n").alias("n"))
    terms = terms.withColumn("idf", idf(F.col("n"), F.col("df"))).withColumn("shares", F.ceil(F.col("df") / (BLOCK * LEVELS)).cast("int"))
    terms = terms.select("scope", "term", "df", "idf", "most", "shares")
    terms = stored(terms, "impact-terms") if keep else terms
    level = F.least(F.floor(F.col("part") / (index.k1 + 1.0) * LEVELS), F.lit(LEVELS - 1)).cast("int")
    # a frequent term is dealt out to as many blocks a level as it needs
    many = terms.filter("shares > 1").select(F.col("scope").alias("_scope"), F.col("term").alias("_term"), "shares")
    dealt = parts.join(many, F.col("scope").eqNullSafe(F.col("_scope")) & (F.col("term") == F.col("_term")), "left")
    salt = F.pmod(F.xxhash64("doc_id"), F.coalesce("shares", F.lit(1))).cast("int")
    entries = F.collect_list(F.struct("doc_id", "part")).alias("entries")
    blocks = dealt.groupBy("scope", "term", level.alias("level"), salt.alias("salt")).agg(F.max("part").alias("most"), entries)
    documents = parts.groupBy("scope", "doc_id").agg(F.collect_list(F.struct("term", "part")).alias("parts"))
    if keep:
        blocks, documents = stored(blocks, "blocks"), stored(documents, "impact-documents")
    return ImpactIndex(blocks, terms, documents, scoped)


def _weights(index: ImpactIndex, queries: DataFrame) -> DataFrame:
    """(qid, scope, term, w, bound, total, place, below): the query's weight of a term, the most the term and all terms can
    give, its place by bound, and what the terms of smaller bounds can give together."""
    asked = query_terms(queries).withColumn("scope", F.col("scope") if index.scoped else F.lit(None).cast("string"))
    known = index.terms.select(F.col("scope").alias("_scope"), F.col("term").alias("_term"), "idf", "most")
    both = asked.join(known, F.col("scope").eqNullSafe(F.col("_scope")) & (F.col("term") == F.col("_term")))
    both = both.select("qid", "scope", "term", (F.col("qtf") * F.col("idf")).alias("w"), (F.col("qtf") * F.col("idf") * F.col("most")).alias("bound"))
    up = Window.partitionBy("qid").orderBy("bound", "term")
    return both.select(
        "*", F.sum("bound").over(Window.partitionBy("qid")).alias("total"), F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), "term")).alias("place"),
        F.sum("bound").over(up.rowsBetween(Window.unboundedPreceding, 0)).alias("below"),
    )


def _read(index: ImpactIndex, weights: DataFrame) -> DataFrame:
    """(qid, doc_id, x) of the postings in the blocks that ``weights`` asks for (need: what a block's largest part must reach)."""
    w = weights.select("qid", F.col("scope").alias("_scope"), F.col("term").alias("_term"), "w", "need")
    blocks = index.blocks.join(w, F.col("scope").eqNullSafe(F.col("_scope")) & (F.col("term") == F.col("_term")) & (F.col("most") * F.col("w") >= F.col("need")))
    return blocks.select("qid", "w", F.explode("entries").alias("e")).select("qid", F.col("e.doc_id").alias("doc_id"), (F.col("w") * F.col("e.part")).alias("x"))


def thresholds(index: ImpactIndex, weights: DataFrame, top_k: int, seeds: int = SEEDS) -> DataFrame:
    """(qid, least): the k-th best of the sums over the terms of the largest bounds; none where fewer documents have those."""
    sums = _read(index, weights.filter(F.col("place") <= seeds).withColumn("need", F.lit(0.0))).groupBy("qid", "doc_id").agg(F.sum("x").alias("x"))
    kth = sums.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("x"))))
    return kth.filter(F.col("n") == top_k).select("qid", (F.col("x") - SLACK).alias("least"))


def plan(index: ImpactIndex, queries: DataFrame, top_k: int = 10) -> DataFrame:
    """Weights with ``least``, ``essential``, what non-essential terms can give (``rest``) and what a block must reach (``need``)."""
    weights = stored(_weights(index, queries), "weights")
    least = stored(thresholds(index, weights, top_k), "thresholds")
    w = weights.join(least, "qid", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    w = w.withColumn("essential", F.col("below") >= F.col("least"))
    rest = F.coalesce(F.max(F.when(~F.col("essential"), F.col("below"))).over(Window.partitionBy("qid")), F.lit(0.0))
    return stored(w.withColumn("rest", rest).withColumn("need", F.col("least") - (F.col("total") - F.col("bound"))), "search-plan")


def search(index: ImpactIndex, queries: DataFrame, top_k: int = 10) -> DataFrame:
    """(qid, doc_id, score, rank): the rows of ``bm25.search`` (of its ``scoped`` form for a scoped index).

    Queries are (qid, text, scope).  Exact: a block, a document or a term is only left out
    where its bound shows that it cannot reach the k-th place.
    """
    return completed(index, plan(index, queries, top_k), top_k)


def candidates(index: ImpactIndex, weights: DataFrame) -> DataFrame:
    """(qid, doc_id) of documents that may reach the threshold, from the essential blocks."""
    sums = _read(index, weights.filter("essential")).groupBy("qid", "doc_id").agg(F.sum("x").alias("x"))
    limits = weights.select("qid", "least", "rest").distinct()
    return sums.join(limits, "qid").filter(F.col("x") + F.col("rest") >= F.col("least")).select("qid", "doc_id")


def completed(index: ImpactIndex, weights: DataFrame, top_k: int) -> DataFrame:
    """Scores of the candidates from their own parts: each document comes once, with the questions that it is a candidate of."""
    asked = weights.select(F.col("scope").alias("_scope"), F.col("term").alias("_term")).distinct()
    same = F.col("scope").eqNullSafe(F.col("_scope")) & (F.col("term") == F.col("_term"))
    terms = stored(index.terms.join(asked, same, "left_semi").select("scope", "term", "df", F.monotonically_increasing_id().alias("t")), "impact-asked")
    count, n = terms.agg(F.sum("df"), F.count("*")).first()
    numbered = terms.select(F.col("scope").alias("_scope"), F.col("term").alias("_term"), "t")
    numbered = F.broadcast(numbered) if n <= BATCH else numbered
    each = index.documents.select("scope", "doc_id", F.explode("parts").alias("p")).select("scope", "doc_id", "p.term", "p.part")
    held = held_terms(each.join(numbered, same), count or 0)
    found = candidates(index, weights).groupBy("doc_id").agg(F.collect_list(F.xxhash64("qid")).alias("only"))
    w = stored(weights.join(numbered, same).select("qid", "t", "w"), "impact-weights")
    out = best_of(held.join(found, "doc_id"), w, top_k).withColumn("rank", ranked(F.col("score"), "doc_id", "qid"))
    return out.filter(F.col("rank") <= top_k).withColumn("score", F.round("score", 6))


def postings_read(index: ImpactIndex, weights: DataFrame) -> int:
    """How many postings the essential blocks hold: the work of ``candidates``."""
    return _read(index, weights.filter("essential")).count()
