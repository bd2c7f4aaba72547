"""Queries of the indexes, search, fusion, diversity and the engine."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..operators import bm25, dense, fusion, impacts
from ..plans.engine import RetrievalEngine, RetrievalOptions
from ..store import passing, scratch_folder, stored
from .base import TERMS, UNIT, bm25_sql, dense_sql, documents, fused_sql, mmr_sql, query, questions, table

POINTS = UNIT


def _terms(spark, sf_dir):
    """Texts are tokenized once; the index and the candidates' terms come from this table."""
    return stored(bm25.doc_terms(documents(spark, sf_dir), "text", "doc_id", "source"), "terms")


def _index(spark, sf_dir):
    with passing(spark) as keep:  # the texts' tokens go
        index = bm25.from_terms(_terms(spark, sf_dir), keep=True)
        keep(index.postings, index.doc_stats, index.term_stats)
        return index


def _impacts(spark, sf_dir, scoped: bool = False):
    with passing(spark) as keep:  # the plain index goes
        index = impacts.build(_index(spark, sf_dir), scoped)
        keep(index.blocks, index.terms, index.documents)
        return index


def _vectors(spark, sf_dir):
    return dense.from_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def _queries(spark, sf_dir, label_scope: bool = False):
    """Questions with a vector: the embedding whose id is the question's."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    q = questions(spark, sf_dir).join(e, "qid")
    return q.withColumn("scope", (F.col("qid") % 10).cast("string")) if label_scope else q


def _engine(spark, sf_dir):
    terms = _terms(spark, sf_dir)
    chunks = terms.select("doc_id", "scope", F.array_distinct("tokens").alias("terms"), (F.col("doc_id") / 4).cast("long").alias("parent_id"))
    return RetrievalEngine(bm25.from_terms(terms, keep=True), chunks, None, _vectors(spark, sf_dir))


@query(f"with {TERMS} select scope, doc_id, term, tf, dl::int as dl from postings")
def term_freq(spark, sf_dir):
    return _index(spark, sf_dir).postings.select("scope", "doc_id", "term", "tf", "dl")


@query(f"with {TERMS} select qid, term, qtf from qterms")
def query_terms(spark, sf_dir):
    return bm25.query_terms(questions(spark, sf_dir)).select("qid", "term", "qtf")


@query(f"with {TERMS} select scope, doc_id, dl::int as dl from doc_stats")
def doc_stats(spark, sf_dir):
    return _index(spark, sf_dir).doc_stats


@query(
    f"with {TERMS} select scope, grouping(scope) = 1 as whole, count(*) as n, round(avg(dl), 6) as avgdl from doc_stats group by grouping sets ((scope), ())"
)
def corpus_stats(spark, sf_dir):
    return bm25.corpus_stats(_index(spark, sf_dir).doc_stats).withColumn("avgdl", F.round("avgdl", 6))


@query(
    f"""with {TERMS}, n as (select scope, count(*) as n from doc_stats group by scope)
select scope, term, df, round(ln(1.0 + (n - df + 0.5) / (df + 0.5)), 8) as idf from (select scope, term, count(*) as df from postings group by all) join n using (scope)"""
)
def idf(spark, sf_dir):
    index = _index(spark, sf_dir)
    df = index.postings.groupBy("scope", "term").agg(F.count("*").alias("df"))
    n = bm25.corpus_stats(index.doc_stats).filter("not whole").select("scope", "n")
    return df.join(n, "scope").select("scope", "term", "df", F.round(bm25.idf(F.col("n"), F.col("df")), 8).alias("idf"))


@query(f"with {TERMS}, {bm25_sql(False, k=10)} select qid, doc_id, score, rank from bm")
def bm25_topk(spark, sf_dir):
    return bm25.search(_index(spark, sf_dir), questions(spark, sf_dir), 10)


@query(f"with {TERMS}, {bm25_sql(True, k=10)} select qid, doc_id, score, rank from bm")
def bm25_scoped_topk(spark, sf_dir):
    """Statistics belong to the scope that is searched."""
    return bm25.search(_index(spark, sf_dir), questions(spark, sf_dir), 10, scoped=True)


def _folder(spark, name: str) -> str:
    return f"{scratch_folder(spark)}/{name}-{uuid4().hex}"


@query(f"with {TERMS}, {bm25_sql(True, k=10)} select qid, doc_id, score, rank from bm")
def bm25_saved_topk(spark, sf_dir):
    """A search of the index as it was saved, in its second version, and loaded."""
    path, index = _folder(spark, "bm25"), _index(spark, sf_dir)
    index.save(path)
    index.save(path)
    return bm25.search(bm25.BM25Index.load(spark, path), questions(spark, sf_dir), 10, scoped=True)


@query(f"with {POINTS}, {dense_sql(True, k=10)} select qid, doc_id, score, rank from dn")
def cosine_saved_topk(spark, sf_dir):
    path = _folder(spark, "dense")
    _vectors(spark, sf_dir).save(path)
    return dense.search(dense.DenseIndex.load(spark, path), _queries(spark, sf_dir, label_scope=True), 10, scoped=True)


@query(f"with {TERMS}, {bm25_sql(False, k=10)} select qid, doc_id, score, rank from bm")
def bm25_impact_topk(spark, sf_dir):
    """The same results from postings in blocks by impact."""
    return impacts.search(_impacts(spark, sf_dir), questions(spark, sf_dir), 10)


@query(f"with {TERMS}, {bm25_sql(True, k=10)} select qid, doc_id, score, rank from bm")
def bm25_impact_scoped_topk(spark, sf_dir):
    return impacts.search(_impacts(spark, sf_dir, scoped=True), questions(spark, sf_dir), 10)


@query(f"with {TERMS.replace('from documents', 'from documents where doc_id % 3 = 0')}, {bm25_sql(False, k=10)} select qid, doc_id, score, rank from bm")
def bm25_allowed_topk(spark, sf_dir):
    """Only every third document may be found, and only those count in the statistics."""
    allowed = documents(spark, sf_dir).filter("doc_id % 3 = 0").select("doc_id")
    return bm25.search(_index(spark, sf_dir), questions(spark, sf_dir), 10, allowed=allowed)


@query(f"with {POINTS.replace('from embeddings', 'from embeddings where vec_id % 3 = 0 or vec_id in (select item_id from benchmark)')}, {dense_sql(False, k=10).replace('cross join vec v', 'cross join (select * from vec where doc_id % 3 = 0) v')} select qid, doc_id, score, rank from dn")
def cosine_allowed_topk(spark, sf_dir):
    allowed = table(spark, sf_dir, "embeddings").filter("vec_id % 3 = 0").select(F.col("vec_id").alias("doc_id"))
    return dense.search(_vectors(spark, sf_dir), _queries(spark, sf_dir), 10, allowed=allowed)


@query(f"with {POINTS}, {dense_sql(False, k=10)} select qid, doc_id, score, rank from dn")
def cosine_topk(spark, sf_dir):
    return dense.search(_vectors(spark, sf_dir), _queries(spark, sf_dir), 10)


@query(f"with {POINTS}, {dense_sql(True, k=10)} select qid, doc_id, score, rank from dn")
def cosine_scoped_topk(spark, sf_dir):
    return dense.search(_vectors(spark, sf_dir), _queries(spark, sf_dir, label_scope=True), 10, scoped=True)


def _fused(spark, sf_dir):
    words = bm25.search(_index(spark, sf_dir), questions(spark, sf_dir), 30)
    return fusion.fuse(words, dense.search(_vectors(spark, sf_dir), _queries(spark, sf_dir), 30))


_BOTH = f"{TERMS}, {POINTS}, {bm25_sql(False)}, {dense_sql(False)}"


@query(f"with {_BOTH}, {fused_sql('hybrid')} select qid, doc_id, bm25, dense, round(rrf, 8) as rrf from fused")
def rrf_fuse(spark, sf_dir):
    return _fused(spark, sf_dir).withColumn("rrf", F.round("rrf", 8))


@query(
    f"with {_BOTH}, {fused_sql('hybrid')} select qid, doc_id, round(bm25_norm, 8) as bm25_norm, round(dense_norm, 8) as dense_norm, round(rrf_norm, 8) as rrf_norm from scaled"
)
def minmax_norm(spark, sf_dir):
    names = ("bm25_norm", "dense_norm", "rrf_norm")
    return fusion.normalized(_fused(spark, sf_dir)).select("qid", "doc_id", *[F.round(n, 8).alias(n) for n in names])


@query(f"with {_BOTH}, {fused_sql('hybrid')} select qid, doc_id, round(coverage, 8) as coverage from normed")
def query_coverage(spark, sf_dir):
    found = _engine(spark, sf_dir).candidates(_queries(spark, sf_dir), RetrievalOptions(), False)
    return found.select("qid", "doc_id", F.round("coverage", 8).alias("coverage"))


_SOURCES = {
    "hybrid": _BOTH,
    "bm25": f"{TERMS}, {bm25_sql(False)}",
    "dense": f"{TERMS}, {POINTS}, {dense_sql(False)}",
}


def _reranked(mode):
    def run(spark, sf_dir):
        found = _engine(spark, sf_dir).candidates(_queries(spark, sf_dir), RetrievalOptions(mode=mode), False)
        return found.select("qid", "doc_id", F.round("base", 8).alias("base"))

    run.__name__ = f"weighted_rerank_{mode}"
    query(f"with {_SOURCES[mode]}, {fused_sql(mode)} select qid, doc_id, round(base, 8) as base from cand")(run)


def _retrieved(mode):
    def run(spark, sf_dir):
        return _engine(spark, sf_dir).retrieve(_queries(spark, sf_dir), RetrievalOptions(mode=mode))

    run.__name__ = f"retrieve_{mode}"
    query(
        f"""with {_SOURCES[mode]}, {fused_sql(mode)}, {mmr_sql(5)}
select qid, doc_id, rank, diversified, round(coalesce(bm25, 0.0), 8) as bm25, round(coalesce(dense, 0.0), 8) as dense_cosine, round(rrf, 8) as rrf,
  round(coverage, 8) as query_coverage, round(base, 8) as rerank from chosen join cand using (qid, doc_id)"""
    )(run)


for _mode in fusion.MODES:
    _reranked(_mode)
    _retrieved(_mode)


_SCOPED = f"{TERMS}, {bm25_sql(True)}, {fused_sql('bm25')}, {mmr_sql(5)}"


@query(f"with {_SCOPED} select qid, doc_id, rank, diversified from chosen")
def mmr_select(spark, sf_dir):
    """Greedy diversity over lexical candidates of the question's own source."""
    found = _engine(spark, sf_dir).retrieve(questions(spark, sf_dir), RetrievalOptions(mode="bm25"), scoped=True)
    return found.select("qid", "doc_id", "rank", "diversified")


@query(
    f"""with {_SCOPED}, p as (select qid, rank, doc_id // 4 as parent_id, row_number() over (partition by qid, doc_id // 4 order by rank) as n from chosen)
select qid, rank, parent_id from p where n = 1"""
)
def llm_context_dedupe(spark, sf_dir):
    """Of results that share a parent (four neighbouring documents) the first stays."""
    engine = _engine(spark, sf_dir)
    found = engine.retrieve(questions(spark, sf_dir), RetrievalOptions(mode="bm25"), scoped=True)
    return fusion.first_of_each_parent(found.join(engine.chunks.select("doc_id", "parent_id"), "doc_id")).select("qid", "rank", "parent_id")
