"""Hit-rate metrics, retrieval evaluation and the chunk-size benchmark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import passing, stored

CUTOFFS = (1, 3, 5, 10)
#: Parts of a range that are counted at once, and values that are put in order.
BINS, FEW = 1024, 10_000


def first_relevant(results: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, scope, rank): for every question the best rank of a result that has a relevant page, or null.

    ``results`` has (qid, rank, pdf_pages), ``questions`` (qid, scope, relevant_pages).
    """
    hits = results.join(questions.select("qid", "relevant_pages"), "qid").filter(F.arrays_overlap("pdf_pages", "relevant_pages"))
    best = hits.groupBy("qid").agg(F.min("rank").alias("rank"))
    return questions.select("qid", "scope").join(best, "qid", "left")


def metrics(ranks: DataFrame) -> DataFrame:
    """Recall at the cutoffs, MRR and question count, for each scope and (scope null, whole true) overall."""
    measures = [
        F.coalesce(F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 4), F.lit(0.0)).alias(f"recall_at_{k}") for k in CUTOFFS
    ]
    mrr = F.coalesce(F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 4), F.lit(0.0)).alias("mrr_at_10")
    grouped = ranks.groupingSets([[F.col("scope")], []], F.col("scope"))
    return grouped.agg(F.grouping("scope").cast("boolean").alias("whole"), *measures, mrr, F.count("*").alias("question_count"))


def details(ranks: DataFrame, results: DataFrame) -> DataFrame:
    """(qid, scope, rank, top_doc_ids): the five best ids of every question beside its rank."""
    five = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"])
    top = results.filter("rank <= 5").groupBy("qid").agg(five.alias("top_doc_ids"))
    return ranks.join(top, "qid", "left")


def upper_medians(rows: DataFrame, keys: list[str], value: str, name: str = "median", bins: int = BINS, few: int = FEW) -> DataFrame:
    """(keys, name): the middle value of each group, the upper one of an even number; nulls don't count.

    Exact for groups of any size, by counting: a histogram of the group's range shows in which
    bin the middle value lies, which is the next range, until it holds ``few`` values or one
    value many times.  Only those are put in order.
    """
    kind = rows.schema[value].dataType
    v = rows.filter(F.col(value).isNotNull()).select(F.struct(*[F.col(k) for k in keys], F.lit(0).alias("_")).alias("k"), F.col(value).cast("double").alias("v"))
    ranges = v.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    ranges = stored(ranges.select("k", "lo", "hi", "n", F.floor(F.col("n") / 2).alias("rank")), "ranges")
    settled = (F.col("lo") == F.col("hi")) | (F.col("n") <= few)
    while ranges.filter(~settled).limit(1).count():
        within = v.join(ranges.filter(~settled), "k").filter(F.col("v").between(F.col("lo"), F.col("hi")))
        place = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
        counts = within.groupBy("k", "rank", place.alias("bin")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("k").orderBy("bin"))
        inner = counts.withColumn("rank", F.col("rank") - upto + F.col("n")).filter((F.col("rank") >= 0) & (F.col("rank") < F.col("n")))
        ranges = stored(ranges.filter(settled).unionByName(inner.select("k", "lo", "hi", "n", "rank")), "ranges")
    left = v.join(ranges.filter("lo <> hi"), "k").filter(F.col("v").between(F.col("lo"), F.col("hi")))
    left = left.withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("v")) - 1).filter(F.col("i") == F.col("rank"))
    out = left.select("k", "v").unionByName(ranges.filter("lo = hi").select("k", F.col("lo").alias("v")))
    return out.select(*[F.col(f"k.{c}").alias(c) for c in keys], F.col("v").cast(kind).alias(name))


def check_scopes(questions: DataFrame, available: DataFrame) -> None:
    """ValueError if a question names a scope that ``available`` (scope) does not have."""
    lost = questions.join(available.distinct(), "scope", "left_anti").orderBy("qid").first()
    if lost is not None:
        names = ", ".join(sorted(r["scope"] for r in available.distinct().limit(1000).collect()))
        raise ValueError(f"question {lost['qid']} references unknown book_id {lost['scope']!r}; available: {names}")


def benchmark(
    pages: DataFrame, targets: list[int], models: list[str], run_one: Callable[[str, DataFrame, DataFrame], DataFrame], build
) -> DataFrame:
    """One row for each (model, target): chunk statistics beside the metrics of ``run_one``.

    ``build(pages, target)`` gives (parents, chunks); ``run_one(model, parents, chunks)``
    gives a metrics row.  Rows come best first: recall at 5, MRR, then small chunks; the
    first is the recommended run.
    """
    runs, spark = None, pages.sparkSession
    for t, target in enumerate(targets):
        with passing(spark) as keep:  # a size's chunks and indexes go with its rows
            parents, chunks = build(pages, target)
            chunks = stored(chunks, "chunks")  # sizes, medians and each model's index and results read them
            sizes = chunks.agg(
                F.count("*").alias("chunk_count"), F.max("token_count").alias("max_chunk_tokens")
            )
            sizes = sizes.crossJoin(upper_medians(chunks, [], "token_count", "median_chunk_tokens"))
            sizes = sizes.select("chunk_count", "median_chunk_tokens", "max_chunk_tokens")
            rows = None
            for m, model in enumerate(models):
                row = sizes.crossJoin(run_one(model, parents, chunks))  # one row each
                row = row.select(F.lit(model).alias("model"), F.lit(target).alias("child_target"), F.lit(m * len(targets) + t).alias("run"), "*")
                rows = row if rows is None else rows.unionByName(row)
            rows = rows if rows is None else keep(stored(rows, "runs"))
        runs = rows if runs is None else runs.unionByName(rows)
    return ordered_runs(runs)


def ordered_runs(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("recall_at_5"), F.desc("mrr_at_10"), F.asc("median_chunk_tokens"), F.asc("run"))
