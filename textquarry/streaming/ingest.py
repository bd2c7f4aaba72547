"""Continuous ingestion: new document files become postings as they arrive.

A text that was indexed before (same fingerprint) is dropped, within a batch and against
the index, so that replays and copies cost nothing downstream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import fingerprint
from ..operators import bm25
from ..store import stored

POSTINGS = "scope string, doc_id long, term string, tf long, dl int, batch long"
STATS = "scope string, doc_id long, dl int, fingerprint string, batch long"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def load(spark: SparkSession, path: str) -> bm25.BM25Index:
    postings = _table(spark, f"{path}/postings", POSTINGS).drop("batch")
    return bm25.BM25Index(postings, _table(spark, f"{path}/doc_stats", STATS).drop("batch", "fingerprint"))


def upsert(batch: DataFrame, path: str, batch_id: int = 0) -> None:
    """Add the batch's new documents (doc_id, text, source) to the index at ``path``.

    Each batch overwrites a partition of its own, so that a batch which Structured
    Streaming repeats after a failure leaves one copy.
    """
    spark = batch.sparkSession
    known = _table(spark, f"{path}/doc_stats", STATS).filter(F.col("batch") != batch_id).select("fingerprint")
    docs = batch.withColumn("fingerprint", fingerprint(F.coalesce("text", F.lit("")))).dropDuplicates(["fingerprint"])
    docs = stored(docs.join(known, "fingerprint", "left_anti"), "new-documents")
    index = bm25.build(docs, "text", "doc_id", "source")
    stats = index.doc_stats.join(docs.select("doc_id", "fingerprint"), "doc_id")
    for name, rows in (("postings", index.postings), ("doc_stats", stats)):
        rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")


def start(spark: SparkSession, source_dir: str, path: str, checkpoint: str, files_per_trigger: int = 100, once: bool = False) -> StreamingQuery:
    """Watch ``source_dir`` for document files (Parquet) and keep the index up to date."""
    stream = spark.readStream.schema("doc_id long, text string, lang string, source string, n_chars long").option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir)
    writer = stream.writeStream.foreachBatch(lambda batch, n: upsert(batch, path, n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
