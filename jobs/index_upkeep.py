"""Keep a search index up to date with a folder of document files that grows.

    python -m jobs.index_upkeep --documents DIR --output DIR [--config jobs/index_upkeep.json]

A file stream takes the Parquet files that its checkpoint (``checkpoint`` below the output
folder) has not seen, until there are no more.  Documents in them are new, changed (an id
that the index has, with another text or scope) or deleted (a column ``deleted`` that is
true).  Then the statistics of the scopes they touch are written again.

Output tables: ``postings`` and ``versions``, partitioned by batch, and ``statistics``,
partitioned by scope; ``textquarry.streaming.upkeep`` reads them.  A run without new files
changes nothing.  A run that failed is repeated: the stream goes on at the batch that was
not finished and overwrites what it wrote of it, and statistics are brought up to date from
the last mark.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import command
from textquarry.streaming import upkeep

log = logging.getLogger("jobs.index_upkeep")
DEFAULTS = {"id": "doc_id", "text": "text", "scope": "source", "version": None, "files_per_batch": 1000}


def run(spark: SparkSession, documents: str, output: str, config: dict | None = None) -> dict:
    """Bring the index below ``output`` up to date with the files at ``documents``; a summary of what was read and written."""
    config = {**DEFAULTS, **(config or {})}
    taken = {"batches": 0, "documents": 0}

    def take(batch: DataFrame, number: int) -> None:
        read = Observation()
        upkeep.apply(batch.observe(read, F.count(F.lit(1)).alias("rows")), output, number, config["scope"], config["text"], config["id"], config["version"])
        rows = read.get["rows"]
        kept = upkeep.versions(spark, output).filter(F.col("batch") == number).agg(F.count("*").alias("n"), F.sum(F.col("deleted").cast("int")).alias("gone")).first()
        taken["batches"], taken["documents"] = taken["batches"] + 1, taken["documents"] + rows
        log.info("batch %d: read %d documents, wrote %d versions, %d of them deletions", number, rows, kept["n"], kept["gone"] or 0)

    now = spark.read.parquet(documents)
    files, name = now.inputFiles(), documents.rstrip("/").rpartition("/")[2]
    # a path that is one file is streamed as a pattern which only that file matches
    one = len(files) == 1 and files[0].endswith(f"/{name}")
    path = f"{documents[:-1]}[{documents[-1]}]" if one else documents
    stream = spark.readStream.schema(now.schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(path)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    scopes = upkeep.refresh_statistics(spark, output)
    log.info("read %d documents in %d batches from %s; wrote the statistics of %d scopes", taken["documents"], taken["batches"], documents, scopes)
    return {**taken, "scopes": scopes}


if __name__ == "__main__":
    command("Index upkeep", {"documents": "folder of Parquet files of documents", "output": "folder of the index"}, run, DEFAULTS)
