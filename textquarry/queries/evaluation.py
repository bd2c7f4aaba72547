"""Queries of retrieval evaluation and the benchmark grid."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import bm25, chunking, evaluate
from ..plans.engine import RetrievalEngine, RetrievalOptions
from ..store import passing, stored
from .base import TERMS, bm25_sql, documents, fused_sql, mmr_sql, query, questions, search_form, table
from .chunks import _CHILDREN, BOOK, PACKED, SEGMENTS, pages
from .search import _engine, _index

PAGE = "doc_id % 8 + 1"


def _asked(spark, sf_dir):
    """Questions with relevant pages: pages 1 and 1 + id mod 5 of their source."""
    q = questions(spark, sf_dir)
    return q.withColumn("relevant_pages", F.array(F.lit(1).cast("long"), F.col("qid") % 5 + 1))


def _with_pages(results, spark, sf_dir):
    """A document's page in its source is its id mod 8, from 1."""
    d = documents(spark, sf_dir).select("doc_id", F.array(F.col("doc_id") % 8 + 1).alias("pdf_pages"))
    return results.join(d, "doc_id")


def _ranks(spark, sf_dir):
    found = bm25.search(_index(spark, sf_dir), questions(spark, sf_dir), 10, scoped=True)
    return evaluate.first_relevant(_with_pages(found, spark, sf_dir), _asked(spark, sf_dir))


def _ranks_sql(hits: str) -> str:
    return f"""best as (select qid, min(rank) as rank from {hits} where doc_id % 8 + 1 in (1, qid % 5 + 1) group by qid),
ranks as (select q.qid, q.scope, best.rank from questions q left join best using (qid))"""


_METRICS = """round(avg(case when rank <= 1 then 1.0 else 0.0 end), 4) as recall_at_1, round(avg(case when rank <= 3 then 1.0 else 0.0 end), 4) as recall_at_3,
  round(avg(case when rank <= 5 then 1.0 else 0.0 end), 4) as recall_at_5, round(avg(case when rank <= 10 then 1.0 else 0.0 end), 4) as recall_at_10,
  round(avg(coalesce(1.0::double / rank, 0.0)), 4) as mrr_at_10, count(*) as question_count"""
_DIRECT = f"{TERMS}, {bm25_sql(True, k=10)}, {_ranks_sql('bm')}"


@query(f"with {_DIRECT} select qid, scope, rank from ranks")
def first_relevant_rank(spark, sf_dir):
    return _ranks(spark, sf_dir)


@query(f"with {_DIRECT} select {_METRICS} from ranks")
def recall_mrr(spark, sf_dir):
    return evaluate.metrics(_ranks(spark, sf_dir)).filter("whole").drop("scope", "whole")


@query(f"with {_DIRECT} select scope, grouping(scope) = 1 as whole, {_METRICS} from ranks group by grouping sets ((scope), ())")
def recall_mrr_by_book(spark, sf_dir):
    return evaluate.metrics(_ranks(spark, sf_dir))


@query(
    f"""with {_DIRECT}, top as (select qid, array_to_string(list(doc_id order by rank), ',') as top_doc_ids from bm where rank <= 5 group by qid)
select qid, scope, rank, top_doc_ids from ranks left join top using (qid)"""
)
def evaluate_details(spark, sf_dir):
    found = bm25.search(_index(spark, sf_dir), questions(spark, sf_dir), 10, scoped=True)
    ranks = evaluate.first_relevant(_with_pages(found, spark, sf_dir), _asked(spark, sf_dir))
    out = evaluate.details(ranks, found)
    return out.withColumn("top_doc_ids", F.array_join(F.col("top_doc_ids").cast("array<string>"), ","))


@query(
    f"""with {TERMS}, {bm25_sql(True)}, {fused_sql('bm25')}, {mmr_sql(10)}, {_ranks_sql('chosen')}
select scope, grouping(scope) = 1 as whole, {_METRICS} from ranks group by grouping sets ((scope), ())"""
)
def evaluate_engine(spark, sf_dir):
    """Ten diversified results for each question, from its own source."""
    found = _engine(spark, sf_dir).retrieve(questions(spark, sf_dir), RetrievalOptions(top_k=10, mode="bm25"), scoped=True)
    ranks = evaluate.first_relevant(_with_pages(found, spark, sf_dir), _asked(spark, sf_dir))
    return evaluate.metrics(ranks)


_CHUNK_DOCS = f"""chunk_docs as materialized (select {BOOK} || printf(':chunk-%04d', row_number() over (partition by doc_id order by parent_no, child_group)) as doc_id, 'all' as source,
  {BOOK} || printf(':parent-%04d', parent_no) as parent_id, c.text as text from chi c)"""


def _grid_sql(targets: list[int]) -> str:
    """The chunks of each target size, their index and its metrics; all that depends on the size has it in its name."""
    shared, own = PACKED.split("cfold as (")
    names = "cfold csegs tails chi chunk_docs terms doc_stats postings questions qterms bm bm_df bm_raw best ranks sizes".split()
    parts, runs = [], []
    for run, target in enumerate(targets):
        body = f"""cfold as ({own.replace('240', str(target))}, {_CHILDREN}, {_CHUNK_DOCS}, {TERMS.replace('from documents', 'from chunk_docs')}, {bm25_sql(False, k=10)},
best as (select qid, min(rank) as rank from bm join chunk_docs using (doc_id) join questions q using (qid) where contains({search_form('chunk_docs.text')}, {search_form('q.text')}) group by qid),
ranks as (select qid, rank from questions left join best using (qid)),
sizes as (select count(*) as chunk_count, list_sort(list(token_count))[count(*) // 2 + 1] as median_chunk_tokens, max(token_count) as max_chunk_tokens from chi)"""
        runs.append(f"select 'lexical' as model, {target} as child_target, {run} as run, sizes.*, m.* from sizes, (select {_METRICS} from ranks) m")
        for name in names:
            body, runs[-1] = (re.sub(rf"\b{name}\b", f"{name}_{target}", x) for x in (body, runs[-1]))
        parts.append(body)
    return f"with recursive {SEGMENTS}, {shared} {', '.join(parts)} {' union all '.join(runs)}"


@query(_grid_sql([200, 240, 280]))
def benchmark_grid(spark, sf_dir):
    """Three child sizes over chunks of all documents; a chunk is relevant if its document holds the question's text."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    asked = q.withColumn("scope", F.lit("all"))

    def build(p, target):
        par, chi = chunking.chunks_of(p, target)
        return par, chi.select("chunk_id", "book_id", "search_text", "token_count")

    def run_one(model, par, chi):
        rows = chi
        engine_rows = rows.withColumnRenamed("chunk_id", "doc_id").withColumn("scope", F.lit("all"))
        index = bm25.for_queries(stored(bm25.doc_terms(engine_rows, "search_text", "doc_id", "scope"), "terms"), asked)
        found = bm25.search(index, asked, 10)
        # relevant: one of the chunks that share most of the question's words
        hits = found.join(rows.select(F.col("chunk_id").alias("doc_id"), "search_text"), "doc_id").join(q.withColumnRenamed("text", "q_text"), "qid")
        from ..functions.text import normalize_search

        good = hits.filter(F.contains(F.col("search_text"), normalize_search(F.col("q_text"))))
        ranks = asked.select("qid", "scope").join(good.groupBy("qid").agg(F.min("rank").alias("rank")), "qid", "left")
        return evaluate.metrics(ranks).filter("whole").drop("scope", "whole")

    return evaluate.benchmark(chunking.stored_segments(pages(spark, sf_dir)), [200, 240, 280], ["lexical"], run_one, build)


@query(
    """with runs as (select source, round(avg(n_chars % 7) / 10, 1) as recall_at_5, round(avg(n_chars % 3), 0) as mrr_at_10, min(n_chars) as median_chunk_tokens from documents group by source)
select source, recall_at_5, mrr_at_10, median_chunk_tokens, row_number() over (order by recall_at_5 desc, mrr_at_10 desc, median_chunk_tokens, source) as place from runs"""
)
def benchmark_order(spark, sf_dir):
    """The order of runs, shown on a run for each source: numbered on a table of one row a source."""
    from pyspark.sql import Window

    runs = documents(spark, sf_dir).groupBy("source").agg(
        F.round(F.avg(F.col("n_chars") % 7) / 10, 1).alias("recall_at_5"),
        F.round(F.avg(F.col("n_chars") % 3), 0).alias("mrr_at_10"),
        F.min("n_chars").alias("median_chunk_tokens"),
    )
    order = Window.orderBy(F.desc("recall_at_5"), F.desc("mrr_at_10"), F.asc("median_chunk_tokens"), F.asc("source"))
    return runs.withColumn("place", F.row_number().over(order))


def chunk_engine(spark, sf_dir) -> RetrievalEngine:
    """An engine over chunks whose books are the sources (ids stay unique through their documents)."""
    from ..plans.engine import chunk_rows, engine_over_rows

    with passing(spark) as keep:  # segments go
        par, chi = chunking.build_chunks(pages(spark, sf_dir))
        # chunk rows feed the index, the statistics and the results
        par, chi = keep(stored(par.drop("search_text"), "parents"), chunk_rows(chi, "search_text"))
    return engine_over_rows(chi, par)


@query(
    f"""with recursive {SEGMENTS}, {PACKED}, {_CHILDREN}, {_CHUNK_DOCS}, {TERMS.replace('from documents', 'from chunk_docs')}, {bm25_sql(False)}, {fused_sql('bm25')}, {mmr_sql(5)}
select qid, '1.1' as schema_version, {search_form('q.text')} as normalized, rank, doc_id as chunk_id, parent_id, diversified as score, round(coalesce(bm25, 0.0), 8) as bm25,
  round(coverage, 8) as query_coverage, round(base, 8) as rerank, count(distinct parent_id) over (partition by qid)::int as passages
from chosen join cand using (qid, doc_id) join (select doc_id, parent_id from chunk_docs) using (doc_id) join questions q using (qid)"""
)
def retrieval_response(spark, sf_dir):
    """The results inside the nested responses to every question, over chunks of all documents."""
    out = chunk_engine(spark, sf_dir).responses(questions(spark, sf_dir), RetrievalOptions(mode="bm25"))
    r = out.select("qid", "response.schema_version", "response.query.normalized", F.size("response.llm_context.passages").alias("passages"), F.explode("response.results").alias("r"))
    return r.select(
        "qid", "schema_version", "normalized", "passages", "r.rank", "r.chunk_id", "r.parent_id", "r.score", "r.scores.bm25", "r.scores.query_coverage", "r.scores.rerank"
    )
