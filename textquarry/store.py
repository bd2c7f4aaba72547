"""Intermediate tables in the cluster's shared folder, read again instead of computed again."""

from __future__ import annotations

import gc
import tempfile
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Folders of the tables that the body of ``passing`` has stored so far.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)
#: Seconds of a write after which its shuffles are worth looking for.
LONG = 5


def scratch_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of this machine only where none is set and all tasks run in the driver."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="textquarry-")
    return _OWN[context.applicationId]


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` as a table of its own: what is built on it reads rows, whatever they cost to make; of one partitioned ``by`` a
    column, only the values asked for.

    A result may read it as long as the session lives; it goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid4().hex}"
    began = time.monotonic()
    (df.write.partitionBy(by) if by else df.write).option("compression", "zstd").parquet(path)
    if time.monotonic() - began > LONG:
        free_shuffles(spark)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    if _PASSING.get() is not None:
        _PASSING.get().append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable]:
    """Tables that are stored in the body go at its end, but for those it keeps: ``keep(table, ...)`` gives them back.

    Nothing may read the others any more.  Kept tables go with the body around this one, if there is one.
    """
    own, kept = [], []

    def keep(*tables: DataFrame):
        kept.extend(t._stored_path for t in tables)
        return tables[0] if len(tables) == 1 else tables

    before = _PASSING.set(own)
    try:
        yield keep
    finally:
        _PASSING.reset(before)
        if _PASSING.get() is not None:
            _PASSING.get().extend(kept)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in own:
            if path not in kept:
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Have the driver look for shuffles that nothing refers to: Spark removes their files once its collector has met them."""
    gc.collect()
    spark._jvm.System.gc()


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame], keep: int = 2) -> str:
    """Write tables as the next version below ``path`` and make it the current one; its folder.

    A version is written beside the others and counts once its number is in the table
    ``published``: a write that fails leaves the version before.  Readers that found a
    version keep it while it is among the ``keep`` last ones.
    """
    have = _numbers(spark, path)
    n = max(have, default=0) + 1
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/v{n:06d}/{name}")
    spark.range(1).select(F.lit(n).cast("long").alias("version")).write.mode("append").parquet(f"{path}/published")
    for old in sorted(have)[: max(0, len(have) + 1 - keep)]:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{old:06d}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return f"{path}/v{n:06d}"


def published(spark: SparkSession, path: str) -> str:
    """The folder of the current version; FileNotFoundError if none was published."""
    have = _numbers(spark, path)
    if not have:
        raise FileNotFoundError(f"nothing is published at {path}")
    return f"{path}/v{max(have):06d}"


def _numbers(spark: SparkSession, path: str) -> list[int]:
    try:
        return [r["version"] for r in spark.read.schema("version long").parquet(f"{path}/published").collect()]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
