"""Interleaving sources to target weights by proportionate-fair (Pfair) scheduling.

Documents of a source form blocks.  With weight w, a share of all weights, block k (from
0) is released at floor(k/w) and due at ceil((k+1)/w) on a clock that counts blocks;
earliest deadline first among the released blocks keeps every source within one block of
its target at all times (Baruah et al., 1996; one block at a time needs no more than plain
EDF).  Weights are exact rationals, nothing is rounded.  When a source is used up its
windows stay empty: the clock skips to the next release, so that the others go on in
their own proportions, each within one block.  Every document gets exactly one place.

The schedule holds a row for each block, not for each document: blocks grow with the
corpus so that there are at most ``MAX_BLOCKS`` of them and one for each source.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import gcd, lcm

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, partitions_for

BLOCK_ROWS = 8
MAX_BLOCKS = 1 << 20
MAX_SOURCES = 100_000
ROWS_PER_BUCKET = 20_000
#: A schedule of so many blocks (24 bytes each) is broadcast; a longer one is joined by its key.
BROADCAST_BLOCKS = 1 << 17
BROADCAST_IDS = 500_000


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """The same proportions in whole numbers: a float stands for the decimal number it is written as."""
    exact = {}
    for s, w in weights.items():
        try:
            exact[s] = Fraction(w) if isinstance(w, (int, Fraction)) else Fraction(repr(float(w)))
        except ValueError:
            raise ValueError(f"the target weight of {s} is {w}") from None
        if exact[s] < 0:
            raise ValueError(f"the target weight of {s} is {w}")
    scale = lcm(*(x.denominator for x in exact.values()))
    out = {s: int(x * scale) for s, x in exact.items()}
    shared = gcd(*out.values())
    return {s: x // max(shared, 1) for s, x in out.items()}


def edf(blocks: dict[str, int], weights: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, block, release, slot, deadline) in the order of the mixture.

    The earliest deadline among released blocks runs, then the smaller name.  Sources of
    weight 0 follow when all others are used up, in equal shares.
    """
    out: list[tuple[str, int, int, int, int]] = []
    clock = 0
    first = {s: n for s, n in blocks.items() if n > 0 and weights[s] > 0}
    last = {s: n for s, n in blocks.items() if n > 0 and not weights[s]}
    for group, weight in ((first, weights), (last, dict.fromkeys(last, 1))):
        total, start = sum(weight[s] for s in group), clock
        waiting = [(start, s, 0) for s in sorted(group)]
        heapq.heapify(waiting)
        ready: list[tuple[int, str, int, int]] = []
        while waiting or ready:
            if not ready and waiting[0][0] > clock:
                clock = waiting[0][0]
            while waiting and waiting[0][0] <= clock:
                release, s, k = heapq.heappop(waiting)
                heapq.heappush(ready, (start - (-(k + 1) * total // weight[s]), s, k, release))
            due, s, k, release = heapq.heappop(ready)
            out.append((s, k, release, clock, due))
            clock += 1
            if k + 1 < group[s]:
                # a block waits for the one before it even where their windows overlap
                heapq.heappush(waiting, (start + (k + 1) * total // weight[s], s, k + 1))
    return out


def mix(
    spark: SparkSession,
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    block_rows: int = BLOCK_ROWS,
    temperature: float = 0.5,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """A place in the mixture for every row: doc_id, source, block, release, slot, deadline, position.

    ``weights`` gives a target weight for each source; without it a source weighs its
    number of rows to the power ``temperature``, to the nearest whole number.  Sources
    missing from ``weights``, negative and non-finite weights raise ValueError; sources of
    weight 0 come last.  A null source is a source of its own.  Blocks have ``block_rows``
    rows, or as many as keep their number below MAX_BLOCKS.  Within a source rows are dealt
    to blocks in the order of a hash of the id.  Repeated rows each get a place.
    ``release <= slot < deadline`` holds for every block, ``position`` numbers the rows of
    the mixture, with gaps after blocks that are not full.  An empty table gives an empty
    result.  The number of sources is collected and must stay below MAX_SOURCES.
    """
    rows = docs.withColumn(rid := fresh(docs, "_rid"), F.monotonically_increasing_id())
    out = _mixed(spark, rows, rid, weights, block_rows, temperature, id_col, source_col)
    return out.select("doc_id", "source", "block", "release", "slot", "deadline", "position")


def _mixed(spark: SparkSession, docs: DataFrame, rid: str, weights, block_rows: int, temperature: float, id_col: str, source_col: str) -> DataFrame:
    """``mix`` of rows that have a number, ``rid``, which comes along."""
    scratch = Scratch(spark, "mixing")
    base = scratch.save(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.concat(F.lit("s:"), F.col(source_col).cast("string")), F.lit("null")).alias("src"),
            F.xxhash64(id_col).alias("h"),
            F.col(rid).alias("rid"),
        ),
        "base",
    )
    counts = {r["src"]: r["n"] for r in base.groupBy("src").agg(F.count("*").alias("n")).limit(MAX_SOURCES).collect()}
    if len(counts) >= MAX_SOURCES:
        raise ValueError("too many sources for a target weight each")
    if weights is None:
        targets = {s: max(1, round(n**temperature)) for s, n in counts.items()}
    else:
        given = {("null" if s is None else f"s:{s}"): w for s, w in weights.items()}
        if missing := sorted(set(counts) - set(given)):
            raise ValueError(f"no target weight for {missing}")
        targets = {s: given[s] for s in counts}
    targets = whole_weights(targets)
    block_rows = max(block_rows, -(-sum(counts.values()) // MAX_BLOCKS))

    # place within the source: buckets of a hash are counted, then numbered inside
    buckets = partitions_for(max(counts.values(), default=0), ROWS_PER_BUCKET, 16)
    base = base.withColumn("bucket", F.pmod(F.xxhash64("h", "rid"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        base.groupBy("src", "bucket")
        .agg(F.count("*").alias("n"))
        .select("src", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    )
    inside = Window.partitionBy("src", "bucket").orderBy("h", "doc_id", "rid")
    ranked = base.withColumn("rn", F.row_number().over(inside)).join(sizes, ["src", "bucket"])
    nth = F.col("before") + F.col("rn") - 1
    ranked = ranked.select("doc_id", "source", "src", "rid", F.floor(nth / block_rows).alias("block"), F.pmod(nth, F.lit(block_rows)).alias("inner"))

    plan = edf({s: -(-n // block_rows) for s, n in counts.items()}, targets)
    if plan and max(r[4] for r in plan) >= 1 << 62:
        raise ValueError("target weights too far apart for a clock of 62 bits")
    names = ("src", "block", "release", "slot", "deadline")
    columns = list(zip(*plan)) or [()] * 5
    arrays = [pa.array(columns[0], pa.string()), *(pa.array(np.array(c, np.int64)) for c in columns[1:])]
    schedule = spark.createDataFrame(pa.table([*arrays, pa.array(np.arange(len(plan)))], [*names, "turn"]))
    schedule = scratch.save(schedule, "schedule")
    if len(plan) <= BROADCAST_BLOCKS:
        schedule = F.broadcast(schedule)
    out = ranked.join(schedule, ["src", "block"])
    return out.select("doc_id", "source", "rid", "block", "release", "slot", "deadline", (F.col("turn") * block_rows + F.col("inner")).alias("position"))


def in_mixed_order(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, all columns as they are, sorted by their place in the mixture.

    Every row has a place of its own, also where rows share an id, lack one or repeat.
    """
    scratch = Scratch(spark, "mixed-order")
    key, place, columns = fresh(docs, "_id"), fresh(docs, "_place"), docs.columns
    twice = docs.groupBy(F.xxhash64(id_col), F.col(id_col).isNull()).agg(F.count("*").alias("c")).filter("c > 1")
    if not twice.limit(1).count():  # the id tells the row
        places = mix(spark, docs, id_col=id_col, **options).select(F.col("doc_id").alias(key), F.col("position").alias(place))
        same = docs[id_col].eqNullSafe(F.col(key))
    else:  # rows get numbers, which a stored copy keeps
        docs = scratch.save(docs.withColumn(own := fresh(docs, "_row"), F.monotonically_increasing_id()), "numbered")
        given = {"weights": None, "block_rows": BLOCK_ROWS, "temperature": 0.5, "source_col": "source"} | options
        places = _mixed(spark, docs, own, given["weights"], given["block_rows"], given["temperature"], id_col, given["source_col"])
        places = places.select(F.col("rid").alias(key), F.col("position").alias(place))
        same = docs[own] == F.col(key)
    places = scratch.save(places, "places")
    if places.count() <= BROADCAST_IDS:
        places = F.broadcast(places)
    return docs.join(places, same, "left").orderBy(place).select(*[docs[c] for c in columns])


def stored_place(docs: DataFrame) -> DataFrame:
    """``docs`` with mix_part and mix_row, the file and the row of it where a table written in order holds the row.

    Files are read back in any order, the largest first; these two columns give the order
    in which they were written.  Both are null for tables that aren't read from files.
    """
    part, row = F.lit(None).cast("long"), F.lit(None).cast("long")
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return docs.withColumns({fresh(docs, "mix_part"): part, fresh(docs, "mix_row"): row})
    found = [F.regexp_extract("_metadata.file_name", rx, 1).cast("long") for rx in (r"^part-(\d+)-", r"-c(\d+)\.")]
    part = F.coalesce(found[0], F.lit(0)) * (1 << 20) + F.coalesce(found[1], F.lit(0))
    return docs.withColumns({fresh(docs, "mix_part"): part, fresh(docs, "mix_row"): F.col("_metadata.row_index")})
