"""Command line over an index folder: build, embed, search, retrieve, answer, evaluate, benchmark.

The folder holds ``pages``, ``parents``, ``chunks``, ``bm25`` and, after ``embed``, ``dense``
with its ``embedding_cache``.  Remote models are set by EMBEDDING_* and CHAT_* variables.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import bm25, chunking, dense, evaluate, reports
from .plans.answering import AnswerModels, answer
from .plans.engine import RetrievalEngine, RetrievalOptions, engine_over_chunks
from .sources import io
from .sources.providers import ChatClient, EmbeddingClient, Endpoint, ProviderError


def build(spark: SparkSession, args) -> dict:
    if args.pages:
        raw = io.read_jsonl(spark, args.pages, io.RAW_PAGE)
    else:
        files = io.discover_pdfs(spark, args.corpus)
        if twice := [r["stem"] for r in io.repeated_stems(files).limit(20).collect()]:
            raise ValueError(f"file names that differ in nothing but case or folder: {', '.join(sorted(twice))}")
        raw = io.extract_pdf_pages(files)
    out = args.output
    io.page_rows(raw).write.mode("overwrite").parquet(f"{out}/pages")
    pages = spark.read.parquet(f"{out}/pages")
    parents, chunks = chunking.build_chunks(pages, args.parent_target, args.parent_max, args.child_target, args.child_max, args.overlap)
    parents.write.mode("overwrite").parquet(f"{out}/parents")
    chunks.write.mode("overwrite").parquet(f"{out}/chunks")
    chunks = spark.read.parquet(f"{out}/chunks")
    bm25.build(chunks, "search_text", "chunk_id", "book_id", args.k1, args.b).save(f"{out}/bm25")
    reports.write_review(f"{out}/extraction_review.md", reports.sample_pages(pages, "book_id", "pdf_page"))
    postings = bm25.BM25Index.load(spark, f"{out}/bm25").postings
    return reports.build_summary(pages, spark.read.parquet(f"{out}/parents"), chunks, postings).first().asDict()


def _one(spark: SparkSession, args) -> DataFrame:
    return spark.createDataFrame([(0, args.question, args.book)], "qid int, text string, scope string")


def search(spark: SparkSession, args) -> list[dict]:
    index = bm25.BM25Index.load(spark, f"{args.index}/bm25", args.k1, args.b)
    found = bm25.search(index, _one(spark, args), args.top_k, scoped=args.book is not None)
    chunks = spark.read.parquet(f"{args.index}/chunks").withColumnRenamed("chunk_id", "doc_id")
    return [r.asDict(True) for r in found.drop("qid").join(chunks, "doc_id").orderBy("rank").collect()]


def embed(spark: SparkSession, args) -> dict:
    """Embed the chunks that the cache lacks and store the vector index."""
    client = EmbeddingClient(Endpoint.from_env("EMBEDDING"))
    chunks = spark.read.parquet(f"{args.index}/chunks")
    index = dense.build(chunks, client, f"{args.index}/embedding_cache", None, "text", "chunk_id", "book_id", args.batch_size)
    index.save(f"{args.index}/dense")
    return {"model": client.model, "documents": index.vectors.count(), "dimension": index.dimension()}


def _engine(spark: SparkSession, args, mode: str) -> RetrievalEngine:
    """The stored engine; the vector index only where the mode needs it, and only if it fits the chunks."""
    chunks, vectors = spark.read.parquet(f"{args.index}/chunks"), None
    if mode != "bm25":
        vectors = dense.DenseIndex.load(spark, f"{args.index}/dense")
        dense.validate(vectors, chunks, "text", "chunk_id")
    return engine_over_chunks(chunks, spark.read.parquet(f"{args.index}/parents"), vectors)


def _with_vectors(queries: DataFrame, mode: str) -> DataFrame:
    """Queries with embeddings of their texts, each distinct text embedded once."""
    if mode == "bm25":
        return queries
    client = EmbeddingClient(Endpoint.from_env("EMBEDDING"))
    empty = queries.sparkSession.createDataFrame([], dense.CACHE_SCHEMA)
    new = dense.embed_missing(dense.cache_misses(queries, empty, client.model), client)
    return queries.join(new.select("fingerprint", "vector"), F.sha2("text", 256) == F.col("fingerprint")).drop("fingerprint")


def _options(args, mode: str) -> RetrievalOptions:
    return RetrievalOptions(args.top_k, args.candidate_k, args.rrf_k, args.diversity_penalty, mode)


def retrieve(spark: SparkSession, args) -> dict:
    engine, options = _engine(spark, args, args.mode), _options(args, args.mode)
    queries = _with_vectors(_one(spark, args), args.mode)
    engine.check(options, queries, args.book)
    return engine.responses(queries, options, scoped=args.book is not None).first()["response"].asDict(True)


def run_answer(spark: SparkSession, args) -> dict:
    """Answers over lexical retrieval; the chat model splits the question and writes the answer."""
    end = Endpoint.from_env("CHAT")
    catalog = io.load_catalog(spark, args.book_catalog) if args.book_catalog else spark.createDataFrame([], "book_id string, title string")
    q = spark.createDataFrame([(0, args.question, None, args.book)], "question_id int, typed_text string, ocr_text string, scope string")
    engine, options = _engine(spark, args, "bm25"), _options(args, "bm25")
    out = answer(q, engine, ChatClient(end), catalog, None, options, AnswerModels(end.model, end.model), args.book is not None)
    return out.first().asDict(True)


def evaluate_retrieval(spark: SparkSession, args) -> list[dict]:
    """Metrics of the ten diversified results of every question in its own book."""
    engine, q = _engine(spark, args, args.mode), _questions(spark, args.questions)
    evaluate.check_scopes(q, engine.chunks.select("scope"))
    found = engine.retrieve(_with_vectors(q, args.mode), RetrievalOptions(top_k=10, mode=args.mode), scoped=True)
    ranks = evaluate.first_relevant(found.join(engine.chunks.select("doc_id", "pdf_pages"), "doc_id"), q)
    return _report(ranks)


def benchmark(spark: SparkSession, args) -> list[dict]:
    """Child sizes times embedding models (or lexical retrieval alone without models)."""
    models = [m for m in args.models.split(",") if m]
    if models and not args.confirm_api_cost:
        raise ValueError("embedding every chunk costs calls: repeat with --confirm-api-cost")
    q = _questions(spark, args.questions)
    pages = spark.read.parquet(f"{args.index}/pages")

    def run_one(model, parents, chunks):
        vectors = None
        asked, mode = q, "bm25"
        if model != "bm25":
            client = EmbeddingClient(Endpoint.from_env("EMBEDDING", model))
            vectors = dense.build(chunks, client, f"{args.index}/embedding_cache", model, "text", "chunk_id", "book_id")
            asked, mode = _with_vectors(q, "hybrid"), "hybrid"
        e = engine_over_chunks(chunks, parents, vectors)
        found = e.retrieve(asked, RetrievalOptions(top_k=10, mode=mode), scoped=True)
        ranks = evaluate.first_relevant(found.join(e.chunks.select("doc_id", "pdf_pages"), "doc_id"), q)
        return evaluate.metrics(ranks).filter("whole").drop("scope", "whole")

    targets = [int(t) for t in args.targets.split(",")]
    runs = evaluate.benchmark(pages, targets, models or ["bm25"], run_one, lambda p, t: chunking.build_chunks(p, child_target=t))
    return [r.asDict() for r in runs.collect()]


def _questions(spark: SparkSession, path: str) -> DataFrame:
    schema = "id string, book_id string, question string, category string, relevant_pdf_pages array<int>, answer_hint string"
    q = io.read_jsonl(spark, path, schema)
    book = F.coalesce("book_id", F.lit("C110210")).alias("scope")
    return q.select(F.col("id").alias("qid"), book, F.col("question").alias("text"), F.col("relevant_pdf_pages").alias("relevant_pages"))


def _report(ranks: DataFrame) -> list[dict]:
    return [r.asDict() for r in evaluate.metrics(ranks).orderBy(F.desc("whole"), "scope").collect()]


def run_evaluation(spark: SparkSession, args) -> list[dict]:
    q = _questions(spark, args.questions)
    chunks = spark.read.parquet(f"{args.index}/chunks").withColumnRenamed("chunk_id", "doc_id")
    evaluate.check_scopes(q, chunks.select(F.col("book_id").alias("scope")))
    found = bm25.search(bm25.BM25Index.load(spark, f"{args.index}/bm25", args.k1, args.b), q, 10, scoped=True)
    ranks = evaluate.first_relevant(found.join(chunks.select("doc_id", "pdf_pages"), "doc_id"), q)
    return _report(ranks)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textquarry")
    sub = p.add_subparsers(required=True)

    def command(name, run):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        c.add_argument("--k1", type=float, default=bm25.K1)
        c.add_argument("--b", type=float, default=bm25.B)
        return c

    c = command("build", build)
    c.add_argument("--corpus", default="Books")
    c.add_argument("--pages", help="raw pages as JSON lines, in place of PDF files")
    c.add_argument("--output", required=True)
    for name in ("parent_target", "parent_max", "child_target", "child_max", "overlap"):
        c.add_argument(f"--{name.replace('_', '-')}", type=int, default=getattr(chunking, name.upper()))
    c = command("embed", embed)
    c.add_argument("--index", required=True)
    c.add_argument("--batch-size", type=int, default=32)
    for name, run, k in (("search", search, 5), ("retrieve", retrieve, 5), ("answer", run_answer, 3)):
        c = command(name, run)
        c.add_argument("question")
        c.add_argument("--index", required=True)
        c.add_argument("--book")
        c.add_argument("--top-k", type=int, default=k)
        if name != "search":
            c.add_argument("--candidate-k", type=int, default=30)
            c.add_argument("--rrf-k", type=int, default=60)
            c.add_argument("--diversity-penalty", type=float, default=0.12)
        if name == "retrieve":
            c.add_argument("--mode", default="hybrid", choices=("bm25", "dense", "hybrid"))
        if name == "answer":
            c.add_argument("--book-catalog")
    for name, run in (("evaluate", run_evaluation), ("evaluate-retrieval", evaluate_retrieval), ("benchmark", benchmark)):
        c = command(name, run)
        c.add_argument("--index", required=True)
        c.add_argument("--questions", required=True)
        if name == "evaluate-retrieval":
            c.add_argument("--mode", default="hybrid", choices=("bm25", "dense", "hybrid"))
        if name == "benchmark":
            c.add_argument("--targets", default="200,240,280")
            c.add_argument("--models", default="", help="embedding models, with commas; none: lexical retrieval")
            c.add_argument("--confirm-api-cost", action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    p = parser()
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("textquarry").getOrCreate()
    try:
        print(json.dumps(args.run(spark, args), ensure_ascii=False, indent=2))
    except (ValueError, ProviderError) as error:
        p.error(str(error))


if __name__ == "__main__":
    main()
