"""Corpus pipeline: drop toxic and poor documents, keep one of each near-duplicate group, mix, tokenize.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as
Parquet and read again as the next stage's docs.  All but the last return the columns of
``documents`` unchanged.

Nulls, empty and repeated rows pass through every stage as rows like others: a null or
empty text is neither toxic nor a copy of anything, its quality is judged by what is left
of it, it has a place in the mixture and no pieces.  Rows that repeat id and text are one
document to the stage on near duplicates.  Further columns stay as they are.  An empty
table gives empty results.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textquarry.llm import jaccard, mixing, pieces, quality, toxicity
from textquarry.llm.common import Scratch, crc_bucket, table

#: Rows with whole texts that pass between Spark and Python at once.
BATCH = 250

#: Tables of earlier stages, by thread and data folder; a later stage of that run removes those that its own input doesn't read.
_left: dict[tuple[int, str], list[Scratch]] = {}


def keep(docs: DataFrame, result: DataFrame, name: str, sf_dir: str) -> DataFrame:
    """``result`` as a table in the scratch folder, written with small batches: whole texts go through Python.

    By contract a stage's result is written before the next stage reads it, so that tables
    of earlier stages can go, unless ``docs`` still reads them.
    """
    left = _left.setdefault((threading.get_ident(), sf_dir), [])
    files = [f.split("://")[-1] for f in docs.inputFiles()] if left else []
    for scratch in left[:]:
        if not any(scratch.base.split("://")[-1] in f for f in files):
            scratch.keep_only()
            left.remove(scratch)
    scratch = Scratch(result.sparkSession, name)
    left.append(scratch)
    return scratch.save(result, name, BATCH)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold go; labels of every third id are left for testing."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_bucket("doc_id", 3) != 1)
    return keep(docs, toxicity.keep_clean(docs, model), "clean", sf_dir)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier holds for poor go; labels of every fifth id are left for testing."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), crc_bucket("doc_id", 5) != 0)
    return keep(docs, quality.keep_good(docs, model), "good", sf_dir)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shingle similarity, the smallest id stays."""
    return jaccard.one_of_each(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in the order of the Pfair schedule; written files follow it."""
    return mixing.in_mixed_order(spark, docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids and the best segmentations of every document, with its place in the mixture (mix_part, mix_row)."""
    return keep(docs, pieces.segment(spark, mixing.stored_place(docs)), "pieces", sf_dir)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: Fitted classifiers and piece lattices have no SQL form; tests compare stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
