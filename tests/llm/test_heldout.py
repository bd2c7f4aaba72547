"""Quality on labels that a fit has not seen, at two sizes of the given tables."""

import os

import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata"


@pytest.mark.parametrize("sf, recall, wrong", [("sf0.01", 0.75, 0.03), ("sf0.1", 0.9, 0.005)])
def test_toxic_documents_that_were_not_learned(spark, sf, recall, wrong):
    if not os.path.isdir(f"{DATA}/{sf}"):
        pytest.skip("no test tables")
    from textquarry.llm import queries

    out = queries.op3_toxic_segments(spark, f"{DATA}/{sf}").filter("held_out").join(spark.read.parquet(f"{DATA}/{sf}/labels.parquet"), "doc_id")
    rate = {r.toxic: r.rate for r in out.filter("toxic is not null").groupBy("toxic").agg(F.avg("predicted").alias("rate")).collect()}
    assert rate[1] >= recall and rate[0] <= wrong


def test_languages_that_were_not_learned(spark):
    if not os.path.isdir(f"{DATA}/sf0.01"):
        pytest.skip("no test tables")
    from textquarry.llm import queries

    out = queries.op4_cross_parsing(spark, f"{DATA}/sf0.01").join(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = out.filter("held_out and lang is not null and lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.99


def test_quality_that_was_not_learned(spark):
    if not os.path.isdir(f"{DATA}/sf0.01"):
        pytest.skip("no test tables")
    from textquarry.llm import queries

    out = queries.op10_co_training(spark, f"{DATA}/sf0.01").filter("held_out").join(spark.read.parquet(f"{DATA}/sf0.01/labels.parquet"), "doc_id")
    right = out.filter("quality is not null").agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0]
    assert right >= 0.95
