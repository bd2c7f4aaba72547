"""Manifests, summaries and review samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def manifest(pages: DataFrame, parents: DataFrame, chunks: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, pdf_pages, parents, chunks): row counts of each book; a kind a book lacks counts 0."""
    kinds = {"pdf_pages": pages, "parents": parents, "chunks": chunks}
    marked = None
    for name, rows in kinds.items():
        one = rows.select(F.col(book), *[F.lit(int(k == name)).alias(k) for k in kinds])
        marked = one if marked is None else marked.unionByName(one)
    return marked.groupBy(book).agg(*[F.sum(k).alias(k) for k in kinds])


def build_summary(pages: DataFrame, parents: DataFrame, chunks: DataFrame, postings: DataFrame) -> DataFrame:
    """One row: books, pages, parents, chunks and distinct terms."""
    one = pages.agg(F.count_distinct("book_id").alias("book_count"), F.count("*").alias("pages"))
    for name, rows in (("parents", parents), ("chunks", chunks)):
        one = one.crossJoin(rows.agg(F.count("*").alias(name)))
    return one.crossJoin(postings.agg(F.count_distinct("term").alias("bm25_terms")))


def sample_pages(pages: DataFrame, book: str, order: str) -> DataFrame:
    """Five evenly spaced pages of each book (all of a book with five or fewer)."""
    w = Window.partitionBy(book)
    numbered = pages.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    n = F.col("_n")
    wanted = F.array(F.lit(0), F.floor(n / 4), F.floor(n / 2), F.floor(3 * n / 4), n - 1)
    return numbered.filter((n <= 5) | F.array_contains(wanted, F.col("_i").cast("long"))).drop("_i", "_n")


def review_rows(samples: DataFrame) -> DataFrame:
    """A Markdown table row and an excerpt for each sampled page."""
    q = F.col("quality")
    page = F.coalesce(F.col("book_page").cast("string"), F.lit("-"))
    row = F.concat(
        F.lit("| "), F.concat_ws(
            " | ", "book_id", F.col("pdf_page").cast("string"), page, "chapter_title", q["characters"].cast("string"), q["tokens"].cast("string"),
            q["span_count"].cast("string"), F.when(q["needs_ocr_review"], "yes").otherwise("no"),
        ), F.lit(" |"),
    )
    excerpt = F.trim(F.replace(F.substring("search_text", 1, 500), F.lit("\n"), F.lit(" ")))
    head = F.concat(F.lit("### "), "book_id", F.lit(": PDF page "), F.col("pdf_page").cast("string"), F.lit(" / book page "), page)
    return samples.select("book_id", "pdf_page", row.alias("row"), head.alias("head"), excerpt.alias("excerpt"))


def write_review(path: str, samples: DataFrame) -> None:
    """The review as one Markdown file; a report is five pages a book, read on the driver."""
    from pathlib import Path

    rows = review_rows(samples).orderBy("book_id", "pdf_page").collect()
    out = ["# Sampled pages", "", "| Id of the book | Page of the file | Printed page | Part | Length | Words | Pieces of layout | Look at it again |", "|---|---:|---:|---|---:|---:|---:|---|"]
    out += [r["row"] for r in rows] + ["", "## How search text begins", ""]
    for r in rows:
        out += [r["head"], "", r["excerpt"], ""]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("\n".join(out), encoding="utf-8")
