"""Byte-balanced range shards from sampled splitters, in DataFrame operations only.

1. One scan reduces each row to (id, size, crc); texts are not moved.
2. Keys are drawn with a chance in proportion to their size; quantiles of the draw
   are the splitters of many narrow ranges.
3. A range that came out overfull (one key with very many rows, or a poor draw) is
   subdivided by a hash of its rows.
4. Ranges are summed, the running sum of bytes over ranges and, inside each, over
   rows places every row on a line of ``total`` bytes; equal pieces of it are shards.

Neighbouring shards differ by at most about one record.  Null ids sort first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

OVERHEAD = 16
DRAWS_PER_RANGE = 64
RANGES_PER_SHARD = 8
ROWS_PER_RANGE = 1_000_000
LOWEST = -(2**63)


def range_index(key: Column, splitters: list[int]) -> Column:
    """How many splitters lie below ``key``: a binary search as a fold, one step per bit."""
    if not splitters:
        return F.lit(0)
    arr = F.lit(splitters) if len(splitters) > 1 else F.array(F.lit(splitters[0]))
    arr = arr.cast("array<bigint>")
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(splitters)).alias("hi"))

    def step(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.get(arr, mid) < key
        open_ = s["lo"] < s["hi"]
        return F.struct(
            F.when(open_ & below, mid + 1).otherwise(s["lo"]).alias("lo"),
            F.when(open_ & ~below, mid).otherwise(s["hi"]).alias("hi"),
        )

    rounds = F.sequence(F.lit(1), F.lit(math.ceil(math.log2(len(splitters) + 1))))
    return F.aggregate(rounds, start, step, lambda s: s["lo"])


def shard(
    spark: SparkSession,
    docs: DataFrame,
    n_shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Place every row of ``docs`` in one of ``n_shards`` shards of nearly equal bytes.

    A row's size is its text's UTF-8 length (null: 0) plus 16; the key is the integer
    id.  Repeated ids and repeated rows are kept, one output row for each; an empty
    table gives an empty result; further columns are ignored.
    Returns id, size, text_crc32, law, shard, slot, grown_shard and range_id.
    """
    scratch = Scratch(spark, "sharding")
    base = scratch.save(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
            F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
            F.monotonically_increasing_id().alias("rid"),
        ),
        "base",
    )
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    total, rows = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = max(n_shards * RANGES_PER_SHARD, -(-rows // ROWS_PER_RANGE))

    # size-weighted draw: the expected number of draws of a row is its size over the sampling step
    expected = F.col("size") * F.lit(ranges * DRAWS_PER_RANGE / max(total, 1))
    chance = F.pmod(F.xxhash64("doc_id", "text_crc32", "rid"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    draws = (F.floor(expected) + (chance < expected - F.floor(expected)).cast("int")).cast("int")
    at = [i / ranges for i in range(1, ranges)]
    picked = (
        base.select(key.alias("key"), draws.alias("draws"))
        .filter("draws > 0")
        .select(F.explode(F.array_repeat("key", F.col("draws"))).alias("key"))
        .agg(F.percentile_approx("key", at, ranges * 20).alias("q"))
        .first()["q"]
    )
    splitters = sorted(set(picked or []))

    placed = base.withColumn("range_id", range_index(key, splitters))
    step = max(total / ranges, 1.0)
    parts = placed.groupBy("range_id").agg(
        F.greatest(F.ceil(F.sum("size") / F.lit(2 * step)), F.ceil(F.count("*") / F.lit(2 * ROWS_PER_RANGE)), F.lit(1)).alias("pieces")
    )
    # a row for each range at most: their number is the parameter above
    placed = placed.join(F.broadcast(parts), "range_id").withColumn(
        "piece",
        F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("text_crc32", "size", "rid"), F.col("pieces"))).otherwise(F.lit(0)),
    )
    along = Window.orderBy("range_id", "piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("range_id", "piece")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        .select(
            "range_id",
            "piece",
            F.coalesce(F.sum("bytes").over(along), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("n").over(along), F.lit(0)).alias("rows_before"),
        )
    )
    inside = Window.partitionBy("range_id", "piece").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size", "rid")
    lined = placed.select(
        "doc_id",
        "size",
        "text_crc32",
        "range_id",
        "piece",
        F.row_number().over(inside).alias("rn"),
        F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
    ).join(F.broadcast(offsets), ["range_id", "piece"])
    middle = F.col("bytes_before") + F.col("upto") - F.col("size") / 2
    lined = scratch.save(
        lined.select(
            "doc_id",
            "size",
            "text_crc32",
            F.least(F.floor(middle * n_shards / F.lit(max(total, 1))), F.lit(n_shards - 1)).cast("int").alias("shard"),
            (F.col("rows_before") + F.col("rn") - 1).alias("pos"),
            "range_id",
        ),
        "lined",
    )
    scratch.drop(base)
    starts = lined.groupBy("shard").agg(F.min("pos").alias("first"))  # n_shards rows at most
    return lined.join(F.broadcast(starts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("pos") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "range_id",
    )
