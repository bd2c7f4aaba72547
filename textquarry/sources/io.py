"""File sources and sinks of the retrieval engine."""

from __future__ import annotations

import json
import os
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import (
    BOOK_WITH_CHAPTERS, CHAPTERS, clean_page_text, needs_review, nfkc, normalize_search, printed_page, section_heading, token_count,
)

SPANS = "array<struct<text:string,x:double,y:double,font_size:double,font:string>>"
RAW_PAGE = f"book_id string, book_title string, source_file string, pdf_page int, raw_text string, spans {SPANS}"


def write_jsonl(df: DataFrame, path: str, gzip: bool = False) -> None:
    """JSON lines; nulls are written, as a reader without a schema expects every key."""
    df.write.mode("overwrite").option("ignoreNullFields", False).option("compression", "gzip" if gzip else "none").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """JSON lines, plain or compressed; blank lines are skipped."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def discover_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, source_file, book_id, content) of all PDF files below a folder; ValueError if there is none."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    out = found.select("path", name.alias("source_file"), F.regexp_replace(name, r"\.[^.]+$", "").alias("book_id"), "content")
    if not out.select("path").limit(1).count():
        raise ValueError(f"no PDF files in {folder}")
    return out


def repeated_stems(files: DataFrame, stem: str = "book_id") -> DataFrame:
    """(stem, n) of file stems that occur more than once, whatever their case."""
    return files.groupBy(F.lower(stem).alias("stem")).agg(F.count("*").alias("n")).filter("n > 1")


def extract_pdf_pages(files: DataFrame) -> DataFrame:
    """Raw pages of PDF files (one row a page). Needs the optional ``pypdf``."""

    def run(batches):
        from io import BytesIO

        from pypdf import PdfReader

        for pdf in batches:
            for row in pdf.itertuples():
                out = []
                for number, page in enumerate(PdfReader(BytesIO(row.content)).pages, start=1):
                    spans: list[dict] = []

                    def visit(text, _cm, tm, font, size, spans=spans):
                        if text.strip():
                            name = font.get("/BaseFont") if isinstance(font, dict) else None
                            spans.append({"text": text.strip(), "x": round(float(tm[4]), 2), "y": round(float(tm[5]), 2), "font_size": round(float(size), 2), "font": name})

                    page.extract_text(visitor_text=visit)
                    out.append((row.book_id, row.book_id, row.source_file, number, page.extract_text() or "", spans))
                yield pd.DataFrame(out, columns=["book_id", "book_title", "source_file", "pdf_page", "raw_text", "spans"])

    return files.select("book_id", "source_file", "content").mapInPandas(run, RAW_PAGE)


def page_rows(raw: DataFrame) -> DataFrame:
    """Page records of raw pages: chapters, cleaned and search text, heading and quality."""
    spark = raw.sparkSession
    table = spark.createDataFrame(CHAPTERS, "first int, last int, chapter_id string, chapter_title string")
    known = F.lower("book_id") == BOOK_WITH_CHAPTERS
    inside = known & F.col("pdf_page").between(F.col("first"), F.col("last"))
    rows = raw.withColumnRenamed("book_title", "_title").join(F.broadcast(table), inside, "left").withColumnRenamed("_title", "book_title")
    rows = rows.withColumn("chapter_id", F.when(known, F.coalesce("chapter_id", F.lit("unknown"))).otherwise(F.lit("document")))
    rows = rows.withColumn("chapter_title", F.when(known, F.coalesce("chapter_title", F.lit("نامشخص"))).otherwise(F.col("book_title")))
    rows = rows.drop("first", "last").withColumn("book_page", printed_page(F.col("book_id"), F.col("pdf_page")))
    rows = rows.withColumn("display_text", clean_page_text(nfkc(F.col("raw_text")), F.col("book_page")))
    spans = F.col("spans") if "spans" in raw.columns else F.array().cast(SPANS)
    size = F.length("display_text")
    quality = F.struct(
        size.alias("characters"), token_count(F.col("display_text")).alias("tokens"), F.size(spans).alias("span_count"),
        (size > 0).alias("has_text"), needs_review(size, F.col("pdf_page")).alias("needs_ocr_review"),
    )
    heading = section_heading(F.col("display_text"), F.col("chapter_title"))
    return rows.withColumn("section_heading", heading).withColumn("search_text", normalize_search(F.col("display_text"))).withColumn("quality", quality)


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, title) of a JSON object; ValueError unless it maps ids to non-blank titles."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one small file
    value = json.loads(text)
    if not isinstance(value, dict):
        raise ValueError("a book catalog is a JSON object that maps book ids to titles")
    for title in value.values():
        if not isinstance(title, str) or not title.strip():
            raise ValueError("every catalog entry maps an id to a non-empty title")
    return spark.createDataFrame([(k, v.strip()) for k, v in value.items()], "book_id string, title string")


def load_env_file(path: str) -> dict[str, str]:
    """Settings of a KEY=VALUE file that the environment does not have yet; they are set there."""
    out = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines() if Path(path).is_file() else []:
        key, eq, value = line.strip().partition("=")
        if not eq or key.startswith("#"):
            continue
        value = value.strip()
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        if key.strip() not in os.environ:
            out[key.strip()] = os.environ[key.strip()] = value
    return out
