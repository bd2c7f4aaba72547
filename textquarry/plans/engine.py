"""Batch retrieval: candidates, fusion, reranking, diversity, passages and the response contract."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import citation_id, nfkc, normalize_search, tokenize
from ..operators import bm25, dense, fusion
from ..store import stored

# fixed values: the response contract's version, the name of the reranker, and the keys of ``responses`` below
SCHEMA_VERSION = "1.1"
RERANKER = "weighted-hybrid-v1"


@dataclass(frozen=True)
class RetrievalOptions:
    top_k: int = 5
    candidate_k: int = 30
    rrf_k: int = 60
    diversity_penalty: float = 0.12
    mode: str = "hybrid"


@dataclass
class RetrievalEngine:
    """Tables of one corpus.

    ``chunks`` has doc_id, scope, terms (distinct tokens) and whatever results should
    carry; the response contract needs the columns of chunk and parent rows.
    """

    index: bm25.BM25Index
    chunks: DataFrame
    parents: DataFrame | None = None
    vectors: dense.DenseIndex | None = None
    dim: int | None = None

    def scopes(self) -> list[str]:
        return sorted(r["scope"] for r in self.chunks.select("scope").distinct().limit(10_000).collect())

    def check(self, options: RetrievalOptions, queries: DataFrame, scope: str | None = None) -> None:
        """ValueError for an unknown mode, a missing index or vector, or an unknown scope."""
        if options.mode not in fusion.MODES:
            raise ValueError("mode must be bm25, dense, or hybrid")
        if options.mode != "bm25" and self.vectors is None:
            raise ValueError("dense or hybrid mode requires a loaded dense index")
        if options.mode != "bm25" and "vector" not in queries.columns:
            raise ValueError("dense or hybrid mode requires query embeddings")
        if scope is not None and not self.chunks.filter(F.col("scope") == scope).limit(1).count():
            raise ValueError(f"unknown book_id {scope!r}; available: {', '.join(self.scopes()) or '(none)'}")

    def candidates(self, queries: DataFrame, options: RetrievalOptions, scoped: bool) -> DataFrame:
        """Fused candidates with their terms, reranked. Only the lists that the mode needs are planned."""
        words = vectors = None
        if options.mode != "dense":
            words = bm25.search(self.index, queries, options.candidate_k, scoped)
        if options.mode != "bm25":
            vectors = dense.search(self.vectors, queries, options.candidate_k, scoped, self.dim)
        fused = fusion.fuse(words, vectors, options.rrf_k)
        asked = queries.select("qid", F.array_distinct(tokenize(nfkc(F.col("text")))).alias("q_terms"))
        fused = fused.join(self.chunks.select("doc_id", "terms"), "doc_id").join(asked, "qid")
        return fusion.rerank(fused, options.mode)

    def retrieve(self, queries: DataFrame, options: RetrievalOptions | None = None, scoped: bool = False) -> DataFrame:
        """(qid, rank, doc_id, score and its parts) for a batch of queries (qid, text[, vector, scope])."""
        options = options or RetrievalOptions()
        self.check(options, queries)
        found = self.candidates(queries, options, scoped)
        parts = found.select(
            "qid",
            "doc_id",
            "base",
            F.transform("terms", lambda t: F.xxhash64(t)).alias("terms"),  # numbers, which sets of are compared much faster
            F.round(F.coalesce("bm25", F.lit(0.0)), 8).alias("bm25"),
            F.round(F.coalesce("dense", F.lit(0.0)), 8).alias("dense_cosine"),
            F.round("rrf", 8).alias("rrf"),
            F.round("coverage", 8).alias("query_coverage"),
            F.round("base", 8).alias("rerank"),
        )
        carry = ("bm25", "dense_cosine", "rrf", "query_coverage", "rerank")
        return fusion.diversify(parts, options.top_k, options.diversity_penalty, carry=carry)

    def context(self, results: DataFrame) -> DataFrame:
        """(qid, rank, citation_id, parent columns): each parent once, at its best result's rank. A missing parent is an error."""
        link = self.chunks.select("doc_id", "parent_id")
        best = fusion.first_of_each_parent(results.join(link, "doc_id")).select("qid", "rank", "parent_id")
        known = self.parents.withColumn("_known", F.lit(True))
        out = best.join(known, "parent_id", "left")
        lost = F.raise_error(F.concat(F.lit("no parent row for "), F.coalesce("parent_id", F.lit("null"))))
        out = out.withColumn("parent_id", F.when(F.col("_known"), F.col("parent_id")).otherwise(lost)).drop("_known")
        return out.withColumn("citation_id", citation_id(F.col("book_id"), F.col("parent_id")))

    def responses(self, queries: DataFrame, options: RetrievalOptions | None = None, scoped: bool = False) -> DataFrame:
        """(qid, response): the nested response of every query, version 1.1."""
        options = options or RetrievalOptions()
        results = stored(self.retrieve(queries, options, scoped), "results")  # both the list and its passages read it
        rows = results.join(self.chunks.drop("terms", "scope"), "doc_id")
        item = F.struct(
            "rank", F.col("doc_id").alias("chunk_id"), "parent_id", F.col("diversified").alias("score"),
            F.struct("bm25", "dense_cosine", "rrf", "query_coverage", "rerank", "diversified").alias("scores"),
            F.struct(
                "book_id", "book_title", "source_file", F.col("book_id").alias("document_id"), "chapter_id", "chapter_title",
                "section_heading", "pdf_pages", "book_pages", "content_type",
            ).alias("source"), "text",
        )
        per_query = rows.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("results"))
        passage = F.struct("rank", F.struct("citation_id", "parent_id", "book_id", "book_title", "source_file", "chapter_title", "pdf_pages", "book_pages", "text").alias("p"))
        passages = self.context(results).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(passage)), lambda x: x["p"]).alias("passages"))
        books = self.chunks.agg(F.sort_array(F.collect_set("scope")).alias("books"))
        scope = F.col("scope").cast("string") if scoped else F.lit(None).cast("string")
        model = self.vectors.model if self.vectors is not None and options.mode != "bm25" else None
        asked = queries.select("qid", F.col("text").alias("q_text"), scope.alias("q_scope"))
        joined = asked.join(per_query, "qid", "left").join(passages, "qid", "left").crossJoin(F.broadcast(books))  # one row
        response = F.struct(
            F.lit(SCHEMA_VERSION).alias("schema_version"),
            F.struct(F.col("q_text").alias("original"), normalize_search(nfkc(F.col("q_text"))).alias("normalized")).alias("query"),
            F.struct(
                F.lit(options.mode).alias("mode"), F.lit(options.top_k).alias("top_k"), F.lit(options.candidate_k).alias("candidate_k"),
                F.lit(options.rrf_k).alias("rrf_k"), F.lit(model).cast("string").alias("embedding_model"), F.lit(RERANKER).alias("reranker"),
                F.col("q_scope").alias("book_id"), F.col("books").alias("available_books"),
            ).alias("retrieval"),
            F.coalesce("results", F.array().cast(per_query.schema["results"].dataType)).alias("results"),
            F.struct(
                F.lit("numbered-passages-v1").alias("format"), F.coalesce("passages", F.array().cast(passages.schema["passages"].dataType)).alias("passages")
            ).alias("llm_context"),
        )
        return joined.select("qid", response.alias("response"))


def chunk_rows(chunks: DataFrame, *drop: str) -> DataFrame:
    """Chunk rows (chunk_id, book_id, search_text, ...) as an engine needs them, with tokens, stored without columns that no result carries."""
    rows = chunks.withColumnRenamed("chunk_id", "doc_id").withColumn("scope", F.coalesce("book_id", F.lit("C110210")))
    return stored(rows.withColumn("tokens", tokenize(nfkc(F.col("search_text")))).drop(*drop), "chunks")


def engine_over_rows(rows: DataFrame, parents: DataFrame, vectors: dense.DenseIndex | None = None, dim: int | None = None) -> RetrievalEngine:
    """An engine over the table of ``chunk_rows`` and parent rows."""
    index = bm25.from_terms(rows.select("scope", "doc_id", "tokens"), keep=True, frequencies=False)
    return RetrievalEngine(index, rows.withColumn("terms", F.array_distinct("tokens")).drop("tokens"), parents, vectors, dim)


def engine_over_chunks(chunks: DataFrame, parents: DataFrame, vectors: dense.DenseIndex | None = None, dim: int | None = None) -> RetrievalEngine:
    """An engine over chunk rows (chunk_id, book_id, search_text, ...) and parent rows."""
    return engine_over_rows(chunk_rows(chunks), parents, vectors, dim)
