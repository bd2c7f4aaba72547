"""Rank fusion, weighted reranking, greedy diversity and passage de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import coverage, jaccard, minmax

MODES = ("bm25", "dense", "hybrid")
# fixed values: weights of the scores in each mode
WEIGHTS = {
    "hybrid": {"dense_norm": 0.36, "bm25_norm": 0.32, "rrf_norm": 0.22, "coverage": 0.10},
    "dense": {"dense_norm": 0.85, "coverage": 0.15},
    "bm25": {"bm25_norm": 0.85, "coverage": 0.15},
}


def fuse(bm25: DataFrame | None, dense: DataFrame | None, rrf_k: int = 60) -> DataFrame:
    """(qid, doc_id, bm25, dense, rrf): both candidate lists as one, in a single grouping.

    Each input has (qid, doc_id, score, rank).  A list that a document is not on leaves null.
    """
    null = F.lit(None).cast("double")
    sides = []
    for name, hits in (("bm25", bm25), ("dense", dense)):
        if hits is not None:
            score = F.col("score")
            sides.append(
                hits.select(
                    "qid",
                    "doc_id",
                    (score if name == "bm25" else null).alias("bm25"),
                    (score if name == "dense" else null).alias("dense"),
                    (1.0 / (rrf_k + F.col("rank"))).alias("rrf"),
                )
            )
    both = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    return both.groupBy("qid", "doc_id").agg(F.max("bm25").alias("bm25"), F.max("dense").alias("dense"), F.sum("rrf").alias("rrf"))


def normalized(fused: DataFrame) -> DataFrame:
    """Scores of each query scaled to 0..1; a document that is not on a list has 0 there."""
    out = fused
    for name in ("bm25", "dense", "rrf"):
        out = out.withColumn(f"{name}_norm", F.coalesce(minmax(F.col(name), "qid"), F.lit(0.0)))
    return out


def rerank(fused: DataFrame, mode: str) -> DataFrame:
    """Adds ``coverage`` and ``base`` to candidates that carry ``q_terms`` and ``terms``."""
    if mode not in MODES:
        raise ValueError("mode must be bm25, dense, or hybrid")
    scored = normalized(fused).withColumn("coverage", coverage(F.col("q_terms"), F.col("terms")))
    base = None
    for name, weight in WEIGHTS[mode].items():
        part = F.lit(weight) * F.col(name)
        base = part if base is None else base + part
    return scored.withColumn("base", base)


def diversify(candidates: DataFrame, top_k: int = 5, penalty: float = 0.12, digits: int = 12, carry: tuple[str, ...] = ()) -> DataFrame:
    """(qid, doc_id, rank, diversified, columns of ``carry``): greedy choice of base less penalty times the largest
    Jaccard similarity to what is chosen; ties by base, then by id.

    A fold over each query's candidates, of which there are at most twice ``candidate_k``.
    """
    def entry(x: Column, red: Column) -> Column:
        """A candidate, led by what orders it, with its similarity to the chosen so far."""
        score = F.round(x["base"] - F.lit(penalty) * red, digits)
        return F.struct(
            (-score).alias("neg"), x["nb"].alias("nb"), x["doc_id"].alias("doc_id"), x["base"].alias("base"), red.alias("red"), x["terms"].alias("terms"),
            x["more"].alias("more"),
        )

    def choose(state: Column, _: Column) -> Column:
        best = F.array(F.array_min(state["rem"]))

        def take(s: Column, m: Column) -> Column:
            others = F.filter(s["rem"], lambda y: y["doc_id"] != m["doc_id"])
            measured = F.transform(others, lambda y: F.struct(y.alias("y"), F.greatest(y["red"], jaccard(y["terms"], m["terms"])).alias("red")))
            return F.struct(
                F.concat(s["sel"], F.array(F.struct(m["doc_id"].alias("doc_id"), (-m["neg"]).alias("score"), m["more"].alias("more")))).alias("sel"),
                F.transform(measured, lambda z: entry(z["y"], z["red"])).alias("rem"),
            )

        # a fold over the one best candidate gives it a name inside the expression
        return F.when(F.size(state["rem"]) == 0, state).otherwise(F.aggregate(best, state, take))

    id_type = candidates.schema["doc_id"].dataType.simpleString()
    more = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    more_type = candidates.select(more.alias("more")).schema["more"].dataType.simpleString()
    first = F.struct((-F.round("base", digits)).alias("nb"), "doc_id", "base", "terms", more.alias("more"))
    per_query = candidates.select("qid", entry(first, F.lit(0.0)).alias("c")).groupBy("qid").agg(F.collect_list("c").alias("c"))
    start = F.struct(F.array().cast(f"array<struct<doc_id:{id_type},score:double,more:{more_type}>>").alias("sel"), F.col("c").alias("rem"))
    chosen = F.aggregate(F.sequence(F.lit(1), F.lit(top_k)), start, choose, lambda s: s["sel"])
    out = per_query.select("qid", F.posexplode(chosen).alias("pos", "x"))
    return out.select("qid", F.col("x.doc_id").alias("doc_id"), (F.col("pos") + 1).alias("rank"), F.round("x.score", 8).alias("diversified"), *[F.col(f"x.more.{c}").alias(c) for c in carry])


def first_of_each_parent(results: DataFrame) -> DataFrame:
    """Results (qid, rank, parent_id, ...) that are the best of their parent."""
    w = Window.partitionBy("qid", "parent_id").orderBy("rank")
    return results.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
