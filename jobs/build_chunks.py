"""Cut a table of documents into parent and child chunks for indexing.

    python -m jobs.build_chunks --documents DIR --output DIR [--config jobs/build_chunks.json]

Every document is a book of one page.  Writes, below the output folder:

* ``chunks``: Parquet, partitioned by the documents' group (their source);
* ``parents``: Parquet, partitioned likewise;
* ``manifest``: JSON lines, one for each document: its parents, chunks and tokens.

Each table is written whole over its older version: a second run over the same documents
leaves the same rows.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import command, read_table
from textquarry.functions.text import nfkc, normalize_display
from textquarry.operators import chunking
from textquarry.store import free_shuffles, passing

log = logging.getLogger("jobs.build_chunks")
DEFAULTS = {
    "format": "parquet", "id": "doc_id", "text": "text", "group": "source", "language": "lang",
    "parent_target": 700, "parent_max": 950, "child_target": 240, "child_max": 320, "overlap": 40,
}


def document_pages(docs: DataFrame, config: dict) -> DataFrame:
    """Documents as books of one page; the group is the book's title and the language its chapter."""
    # a column of its own: what display text is made of looks at it more than once
    docs = docs.withColumn("_nfkc", nfkc(F.col(config["text"])))
    group, lang = F.col(config["group"]).cast("string"), F.col(config["language"]).cast("string")
    return docs.select(
        F.concat(F.lit("D"), F.col(config["id"]).cast("string")).alias("book_id"),
        F.lit(1).alias("pdf_page"), F.lit(None).cast("int").alias("book_page"), lang.alias("chapter_id"), F.upper(lang).alias("chapter_title"),
        group.alias("section_heading"), group.alias("book_title"), F.concat(group, F.lit(".txt")).alias("source_file"),
        normalize_display(F.col("_nfkc")).alias("display_text"),
    )


def run(spark: SparkSession, documents: str, output: str, config: dict | None = None) -> dict:
    """Build the chunks of the documents at one path below another; a summary of what was read and written."""
    config = {**DEFAULTS, **(config or {})}
    with passing(spark):  # what it stores on the way is of no use to anyone once the results are written
        read = Observation()
        docs = read_table(spark, documents, config["format"]).filter(F.col(config["id"]).isNotNull())
        docs = docs.observe(read, F.count(F.lit(1)).alias("rows"), F.sum(F.length(config["text"])).alias("chars"))
        segments = chunking.stored_segments(document_pages(docs, config), config["parent_target"], config["parent_max"])
        log.info("read %s: %d documents, %d characters", documents, read.get["rows"], read.get["chars"] or 0)
        parents, chunks = chunking.chunks_of(segments, config["child_target"], config["child_max"], config["overlap"])
        written = {}
        for name, rows in (("parents", parents), ("chunks", chunks)):
            path = f"{output}/{name}"
            rows.withColumnRenamed("book_title", "group").drop("source_file").write.partitionBy("group").mode("overwrite").parquet(path)
            free_shuffles(spark)
            written[name] = spark.read.parquet(path).count()
            log.info("wrote %s: %d rows", path, written[name])
        back = {name: spark.read.parquet(f"{output}/{name}").groupBy("book_id").agg(F.count("*").alias(name), F.sum("token_count").alias(f"{name}_tokens")) for name in written}
        # a document without words has no chunks, and none in the manifest
        manifest = back["parents"].join(back["chunks"], "book_id").select("book_id", "parents", "chunks", F.col("parents_tokens").alias("tokens"), F.col("chunks_tokens").alias("tokens_with_overlap"))
        manifest.write.mode("overwrite").json(f"{output}/manifest")
        written["manifest"] = read_manifest(spark, output).count()
        log.info("wrote %s/manifest: %d documents", output, written["manifest"])
        return {"documents": read.get["rows"], **written}


def read_manifest(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema("book_id string, parents long, chunks long, tokens long, tokens_with_overlap long").json(f"{output}/manifest")


if __name__ == "__main__":
    command("Build chunks of documents", {"documents": "table of documents", "output": "folder for the results"}, run, DEFAULTS)
