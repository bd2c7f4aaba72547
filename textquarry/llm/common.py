"""Shared helpers: scratch tables in the cluster's shared folder, table access, components.

Intermediate results are Parquet tables below ``spark.checkpoint.dir``.  They cut
lineage, survive the loss of any executor and are read again by plain scans.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that pass between the JVM and Python at once while a table is written: both sides hold a batch.
BATCH_ROWS, SMALL_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000

#: Rounds grow with the logarithm of a component's size; more than these would be an error.
MAX_ROUNDS = 200

_OWN_DIR: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of this session; a local one only where none is configured and all tasks run in the driver."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="textquarry-")
    return _OWN_DIR[app]


class Scratch:
    """Tables of one operator run; ``drop`` removes those no result reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: list[str] = []

    def save(self, df: DataFrame, name: str = "t", batch: int = SMALL_BATCH) -> DataFrame:
        """``df`` as a table; at most ``batch`` rows pass to a Python worker at once, fewer where rows are large."""
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{name}"
        conf, was = self.spark.conf, self.spark.conf.get(BATCH_ROWS)
        conf.set(BATCH_ROWS, min(int(was), batch) if int(was) > 0 else batch)
        try:
            df.write.parquet(path)
        finally:
            conf.set(BATCH_ROWS, was)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.paths.append(path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        self._delete([p for p in (getattr(df, "_scratch_path", None) for df in frames) if p])

    def keep_only(self, *frames: DataFrame) -> None:
        """Delete all tables but these, and let the driver find the shuffles that nothing refers to.

        Spark removes a shuffle's files once the driver's collector has met its remains; a
        long operator would else hold the files of all its steps.
        """
        held = {getattr(df, "_scratch_path", None) for df in frames}
        self._delete([p for p in self.paths if p not in held])
        self.paths = [p for p in self.paths if p in held]
        gc.collect()
        self.spark._jvm.System.gc()

    def _delete(self, paths: list[str]) -> None:
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, rows: int = 1000):
    """Smaller frames of a stream of frames: what a worker holds per batch shrinks with them."""
    for pdf in batches:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at : at + rows]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def crc_bucket(id_col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % F.lit(modulus)


def partitions_for(rows: int, per_part: int, least: int) -> int:
    return max(least, -(-rows // per_part))


def width(spark: SparkSession) -> int:
    """Partitions for work that is heavy per row: the configured shuffle width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table as (node, component = smallest node).

    Alternating large-star and small-star steps (Kiveris et al., 2014): every step is
    a grouped minimum and an equi join, the edge table never outgrows the input, and
    rounds grow with the logarithm of a component's size.  A vertex of huge degree is
    met by partial aggregation; its join side is an ordinary equi join that adaptive
    execution can split.  Nodes without edges do not appear.
    """
    spark = scratch.spark
    cur = scratch.save(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges"
    )
    last = None
    for _ in range(MAX_ROUNDS):
        # large star: every neighbour above u is tied to the smallest vertex of u's surroundings
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, "large")
        # small star: u and its lower neighbours are tied to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .filter("u <> v")
            .distinct()
        )
        nxt = scratch.save(small, "small")
        scratch.drop(cur, large)
        mark = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        cur = nxt
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError(f"components are not settled after {MAX_ROUNDS} rounds")
    members = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
