"""An index that follows its corpus: new, changed and deleted documents, batch by batch.

The folder holds three tables:

* ``versions/batch=N``: what batch N says of each of its documents (scope, length, digest, or that it is deleted);
* ``postings/batch=N``: the postings of those documents;
* ``statistics/scope=S``: document and collection frequency of each term of a scope; the row
  without a term has the scope's documents and tokens.

A document is what its latest batch says.  A batch only writes its own partitions, so that one
which Structured Streaming repeats after a failure leaves one copy, and never rewrites
earlier ones; ``compact`` copies what is current into one partition of a new folder.
Statistics are written again for the scopes that new batches touch; ``marks`` says up to
which batch they go.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fingerprint
from ..operators import bm25
from ..store import stored

POSTINGS = "scope string, doc_id long, term string, tf long, dl int, batch long"
VERSIONS = "doc_id long, scope string, dl int, fingerprint string, deleted boolean, batch long"
STATISTICS = "term string, df long, cf long, upto long, scope string"
MARKS = "upto long"


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path``, empty where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame(spark.sparkContext.emptyRDD(), schema)


def versions(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, f"{path}/versions", VERSIONS)


def latest(rows: DataFrame) -> DataFrame:
    """One row for each document: that of its last batch."""
    last = F.max_by(F.struct("scope", "dl", "fingerprint", "deleted", "batch"), "batch").alias("v")
    return rows.groupBy("doc_id").agg(last).select("doc_id", "v.*")


def _without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Large ``rows`` but those of the stored ``gone``, of which there are few or none: then nothing of ``rows`` moves."""
    n = gone.count()
    if not n:
        return rows
    return rows.join(F.broadcast(gone) if n <= bm25.BATCH else gone, keys, "left_anti")


def _one_of_each(rows: DataFrame) -> DataFrame:
    """Stored rows of a batch, of those that share an id the one that counts; only these meet."""
    often = stored(rows.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "often")
    n = often.count()
    if not n:
        return rows.drop("version")
    order = Window.partitionBy("doc_id").orderBy(F.desc("version"), "deleted", "fingerprint", "scope")
    some = rows.join(F.broadcast(often) if n <= bm25.BATCH else often, "doc_id", "left_semi")
    first = some.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    return stored(_without(rows, often, ["doc_id"]).unionByName(first).drop("version"), "batch")


def _write(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def apply(batch: DataFrame, path: str, batch_id: int, scope: str = "source", text: str = "text", doc_id: str = "doc_id", version: str | None = None) -> None:
    """Take a batch of documents into the index at ``path``.

    Of rows that share an id the one of the largest ``version`` counts, then the one of the
    smallest digest.  A row whose ``deleted`` is true (if there is such a column) removes
    its document.  Documents that are as the index has them are left alone; a null text is
    an empty one; rows without an id cannot be followed and are left out.
    """
    spark = batch.sparkSession
    gone = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in batch.columns else F.lit(False)
    own = batch.filter(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(scope).cast("string").alias("scope"), F.coalesce(F.col(text), F.lit("")).alias("text"),
        fingerprint(F.coalesce(F.col(text), F.lit(""))).alias("fingerprint"), gone.alias("deleted"), (F.col(version) if version else F.lit(0)).alias("version"),
    )
    own = _one_of_each(stored(own, "batch"))
    # most batches bring new ids: the bounds keep the files of older ones unread
    low, high = own.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return
    before = versions(spark, path).filter((F.col("batch") < batch_id) & F.col("doc_id").between(low, high))
    before = latest(before.join(own.select("doc_id"), "doc_id", "left_semi")).select("doc_id", *[F.col(c).alias(f"was_{c}") for c in ("scope", "fingerprint", "deleted")])
    both = own.select("doc_id", "scope", "fingerprint", "deleted").join(before, "doc_id", "left")
    same = F.col("was_deleted").eqNullSafe(F.col("deleted")) & (F.col("deleted") | (F.col("was_scope").eqNullSafe(F.col("scope")) & (F.col("was_fingerprint") == F.col("fingerprint"))))
    unknown = F.col("deleted") & F.col("was_deleted").isNull()
    new = _without(own, stored(both.filter(same | unknown).select("doc_id"), "as-is"), ["doc_id"])
    alive = stored(bm25.doc_terms(new.filter("not deleted"), "text", "doc_id", "scope").withColumn("dl", F.size("tokens")), "terms")
    counted = bm25.term_frequencies(bm25.dealt(alive, alive.agg(F.sum("dl")).first()[0] or 0))
    # into the partition's own folder: writing by a column would sort all postings by it
    counted.write.mode("overwrite").parquet(f"{path}/postings/batch={batch_id}")
    dl = new.select("doc_id", "scope", "fingerprint", "deleted").join(alive.select("doc_id", "dl"), "doc_id", "left").select("doc_id", "scope", "dl", "fingerprint", "deleted")
    _write(dl.withColumn("batch", F.lit(batch_id).cast("long")).sortWithinPartitions("doc_id"), f"{path}/versions", "batch")


def load(spark: SparkSession, path: str) -> bm25.BM25Index:
    """The index of all documents as their last batches left them."""
    seen = versions(spark, path)
    now = latest(seen).filter("not deleted")
    # what is out of date is little beside the postings, which would be sorted where the planner doesn't know
    old = stored(seen.select("doc_id", "batch").join(now.select("doc_id", "batch"), ["doc_id", "batch"], "left_anti"), "out-of-date")
    postings = _without(table(spark, f"{path}/postings", POSTINGS), old, ["doc_id", "batch"])
    return bm25.BM25Index(postings.select("scope", "doc_id", "term", "tf", "dl"), now.select("scope", "doc_id", "dl"))


def refresh_statistics(spark: SparkSession, path: str) -> int:
    """Write the statistics of scopes that batches since the last mark touch; how many scopes that were."""
    upto = table(spark, f"{path}/marks", MARKS).agg(F.coalesce(F.max("upto"), F.lit(-1))).first()[0]
    seen = versions(spark, path)
    last = seen.agg(F.max("batch")).first()[0]
    if last is None or last <= upto:
        return 0
    # of a changed document, all scopes that it was ever in
    changed = seen.filter(F.col("batch") > upto).select("doc_id").distinct()
    scopes = stored(seen.join(changed, "doc_id", "left_semi").select("scope").distinct(), "scopes")
    touched = lambda df: df.join(scopes.withColumnRenamed("scope", "_scope"), F.col("scope").eqNullSafe(F.col("_scope")), "left_semi")
    index = load(spark, path)
    terms = touched(index.postings).groupBy("scope", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    # a scope that lost all its documents is written as well, with none
    none = scopes.select("scope", F.lit(0).alias("n"), F.lit(0).alias("dl"))
    sizes = touched(index.doc_stats).select("scope", F.lit(1).alias("n"), "dl").unionByName(none).groupBy("scope").agg(F.sum("n").alias("df"), F.sum("dl").alias("cf"))
    rows = terms.unionByName(sizes.withColumn("term", F.lit(None).cast("string")))
    _write(rows.select("term", "df", F.col("cf").cast("long"), F.lit(last).cast("long").alias("upto"), "scope"), f"{path}/statistics", "scope")
    spark.range(1).select(F.lit(last).cast("long").alias("upto")).write.mode("append").parquet(f"{path}/marks")
    return scopes.count()


def statistics(spark: SparkSession, path: str) -> DataFrame:
    """(scope, term, df, cf) of all terms."""
    return table(spark, f"{path}/statistics", STATISTICS).filter("term is not null").select("scope", "term", "df", "cf")


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Copy what is current into one partition, that of the last batch, of an index at ``target``; later batches go there.

    Deleted documents keep their row, without which an older batch could not be told from a new one.
    """
    seen = versions(spark, path)
    last = seen.agg(F.max("batch")).first()[0]
    if last is None:
        return
    index = load(spark, path)
    index.postings.repartitionByRange("term").sortWithinPartitions("term", "scope").withColumn("batch", F.lit(last)).write.partitionBy("batch").mode("overwrite").parquet(f"{target}/postings")
    latest(seen).withColumn("batch", F.lit(last)).write.partitionBy("batch").mode("overwrite").parquet(f"{target}/versions")
    refresh_statistics(spark, target)
