"""Embedding near-duplicates by sorted projection passes.

A pass draws random hyperplanes; a vector's signs against them form a key, and vectors
sorted by key (lexicographically by its bits) bring close ones together.  The sorted
line is cut into blocks, and each vector is compared in double precision with all of
its own and both neighbouring blocks.  Hyperplanes go through the mean of the vectors, so
that a direction common to all of them does not keep the planes from splitting the crowd.

How many passes meet a pair at the threshold with chance ``1 - MISS`` is measured: a
sample of vectors is compared with all others, which tells how many bits of a key it takes
until a vector's surroundings fit into a block, and how often a pair at the threshold
agrees on so many bits.  Up to two blocks of vectors take one pass, which compares them all.
Where vectors crowd in a ball hardly wider than the distance at the threshold, no projection
tells them apart: if more than ``MAX_PASSES`` were needed, and more than all pairs cost, blocks
meet all other blocks, and the result is exact.

Each row knows its block in every pass, so that a pass leaves out the pairs that an
earlier one has compared; links are therefore counted, not listed.  What a block sends
on is linear in its rows: its links for each vector and one edge to the smallest member
of its local component.  Components are the union over passes.  Where a component is
larger than a block, so that windows may have missed members, its members are compared
block by block as well, which makes its counts complete.

Equal vectors are one class: passes compare classes, each counts as often as it occurs.
Vectors of different lengths never meet; each length is a table of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, components, union_all

THRESHOLD = 0.95
BLOCK = 1024
BITS = 48
MISS = 1e-3
MAX_PASSES = 128
#: Vectors and passes that the density is measured with.
PROBES, PILOT = 256, 4
#: Rows of a part where all pairs are compared.
PART = 8192
SEED = 20240607


def passes_for(depth: np.ndarray, radius: np.ndarray, rows: int, threshold: float = THRESHOLD, block: int = BLOCK) -> int | None:
    """Passes that meet a pair at the threshold with chance 1 - MISS; None if MAX_PASSES are too few and more cost more than all pairs.

    ``depth`` [probes, passes]: bits until a probe's surroundings fit into a block; ``radius``: its distance from the mean.
    """
    apart = math.sqrt(2 - 2 * threshold) / 2
    agree = 1 - 2 * np.arcsin(np.minimum(1.0, apart / np.maximum(radius, 1e-12))) / math.pi
    met = (agree[:, None] ** depth).mean(1)
    miss = lambda n: ((1 - met) ** n).mean()
    low, high = 1, max(MAX_PASSES, rows // (3 * block))  # a pass compares a vector with three blocks
    if miss(high) > MISS:
        return None
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if miss(mid) <= MISS else (mid + 1, high)
    return low


def unit_rows(vectors, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Normalised rows in double precision, and which of them are usable."""
    out, ok = np.zeros((len(vectors), dim)), np.zeros(len(vectors), bool)
    for i, v in enumerate(vectors):
        if v is None or len(v) != dim:
            continue
        x = np.array([np.nan if c is None else c for c in v] if getattr(v, "dtype", object) == object else v, float)
        if not np.isfinite(x).all():
            continue
        top = np.abs(x).max() if dim else 0.0
        if top > 0:
            x = x / top
            out[i], ok[i] = x / np.sqrt(x @ x), True
    return out, ok


def key_maker(dim: int, passes: int, mean: np.ndarray):
    """Function from unit rows to their keys [rows, passes]."""
    planes = np.random.default_rng(SEED + dim).standard_normal((passes * BITS, dim)).T
    powers = (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)).astype(np.int64)
    return lambda x: ((x - mean) @ planes >= 0).reshape(len(x), passes, BITS) @ powers


def _keys(dim: int, passes: int, mean: np.ndarray):
    make = key_maker(dim, passes, mean)

    def run(batches):
        for pdf in batches:
            x, ok = unit_rows(pdf["v"].tolist(), dim)
            x, keep = x[ok], pdf[ok]
            yield pd.DataFrame({"rid": keep["rid"].array, "m": keep["m"].array, "v": list(x), "keys": list(make(x))})

    return run


def _sums(dim: int):
    """Number and sum of a task's unit rows."""

    def run(batches):
        n, total = 0, np.zeros(dim)
        for pdf in batches:
            x, ok = unit_rows(pdf["v"].tolist(), dim)
            n, total = n + int(ok.sum()), total + x[ok].sum(0)
        yield pd.DataFrame({"n": [n], "total": [total]})

    return run


def _shared_bits(dim: int, mean: np.ndarray, probes: np.ndarray, threshold: float):
    """How many rows, and how many linked ones, agree with a probe on just k bits of a pass's key, by slot (probe, pass, k)."""
    make = key_maker(dim, PILOT, mean)
    own, width = make(probes), BITS + 1

    def run(batches):
        seen, linked = (np.zeros(len(probes) * PILOT * width, np.int64) for _ in range(2))
        for pdf in batches:
            x, ok = unit_rows(pdf["v"].tolist(), dim)
            x = x[ok]
            keys, hit = make(x), x @ probes.T >= threshold
            for p in range(PILOT):
                k = BITS - np.frexp((keys[:, p][:, None] ^ own[:, p][None, :]).astype(float))[1]
                slot = k + (np.arange(len(probes)) * PILOT + p)[None, :] * width
                seen += np.bincount(slot.ravel(), minlength=len(seen))
                linked += np.bincount(slot[hit], minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"slot": at, "seen": seen[at], "linked": linked[at]})

    return run


def depths(seen: np.ndarray, linked: np.ndarray, block: int) -> np.ndarray:
    """Bits until the rows that share them with a probe fit into a block, or are for the most part its links.

    Links more than a block make a component that is compared as a whole once anything in it is met.
    """
    seen, linked = (np.cumsum(x[..., ::-1], -1)[..., ::-1] for x in (seen, linked))
    fits = (seen <= block) | (2 * linked >= seen)
    return np.where(fits.any(-1), fits.argmax(-1), BITS)


def measured_passes(src: DataFrame, dim: int, mean: np.ndarray, rows: int, threshold: float, block: int) -> int | None:
    if rows <= 2 * block:  # each block meets itself and the next
        return 1
    sample = src.filter(F.size("v") == dim).orderBy(F.xxhash64("rid"), "rid").limit(PROBES).select("v").toPandas()
    probes, ok = unit_rows(sample["v"].tolist(), dim)
    probes = probes[ok]
    if not len(probes):
        return 1
    shared = src.mapInPandas(_shared_bits(dim, mean, probes, threshold), "slot long, seen long, linked long")
    shared = shared.groupBy("slot").agg(F.sum("seen").alias("seen"), F.sum("linked").alias("linked")).toPandas()
    seen, linked = (np.zeros(len(probes) * PILOT * (BITS + 1), np.int64) for _ in range(2))
    seen[shared["slot"]], linked[shared["slot"]] = shared["seen"], shared["linked"]
    depth = depths(*(x.reshape(len(probes), PILOT, BITS + 1) for x in (seen, linked)), block)
    return passes_for(depth, np.linalg.norm(probes - mean, axis=1), rows, threshold, block)


def unmet(pairs: np.ndarray, a: np.ndarray, b: np.ndarray, passes: int) -> np.ndarray:
    """The pairs that none of the first passes has compared; a and b are the blocks of either side."""
    for q in range(passes):
        if not len(pairs):
            break
        pairs = pairs[np.abs(a[pairs[:, 0], q] - b[pairs[:, 1], q]) > 1]
    return pairs


def weighed(pairs: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Of each class, how many vectors the classes that it is paired with stand for."""
    count = np.zeros(len(m), np.int64)
    np.add.at(count, pairs[:, 0], m[pairs[:, 1]])
    np.add.at(count, pairs[:, 1], m[pairs[:, 0]])
    return count


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """Smallest index reachable for each of n nodes over index pairs."""
    root = np.arange(n)
    if not len(pairs):
        return root
    a, b = pairs[:, 0], pairs[:, 1]
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _window(pass_no: int, threshold: float):
    """Compare block 0 of the group (``role`` 0) with itself and with the following block (``role`` 1)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["role", "rid"], kind="stable")
        own = int((pdf["role"] == 0).sum())
        x = np.stack(pdf["v"].tolist())
        blocks = np.stack(pdf["blocks"].tolist())
        hit = x[:own] @ x.T >= threshold
        hit[:, :own] = np.triu(hit[:, :own], 1)
        pairs = unmet(np.argwhere(hit), blocks, blocks, pass_no)
        count = weighed(pairs, pdf["m"].to_numpy())
        root = _roots(len(x), pairs)
        ids = pdf["rid"].to_numpy()
        touched = count > 0
        return pd.DataFrame({"rid": ids[touched], "links": count[touched], "root": ids[root[touched]]})

    return run


def _between(passes: int, threshold: float):
    """Compare two blocks of one component, leaving out pairs that some pass has compared."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        a, b = pdf[pdf["part"] == i], pdf[pdf["part"] == j]
        if not len(a) or not len(b):
            return pd.DataFrame({"rid": [], "links": []})
        ba, bb = np.stack(a["blocks"].tolist()), np.stack(b["blocks"].tolist())
        hit = np.stack(a["v"].tolist()) @ np.stack(b["v"].tolist()).T >= threshold
        pairs = unmet(np.argwhere(np.triu(hit, 1) if i == j else hit), ba, bb, passes)
        if i == j:
            return pd.DataFrame({"rid": a["rid"].to_numpy(), "links": weighed(pairs, a["m"].to_numpy())})
        both = pd.concat([a[["rid", "m"]], b[["rid", "m"]]])
        return pd.DataFrame({"rid": both["rid"].to_numpy(), "links": weighed(pairs + [0, len(a)], both["m"].to_numpy())})

    return run


def _units(dim: int):
    def run(batches):
        for pdf in batches:
            x, ok = unit_rows(pdf["v"].tolist(), dim)
            yield pd.DataFrame({"rid": pdf["rid"][ok].array, "m": pdf["m"][ok].array, "v": list(x[ok])})

    return run


def _all_pairs(threshold: float, block: int):
    """Compare all of part i with all of part j, a block of rows at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        a = pdf[pdf["part"] == i]
        b = pdf[pdf["part"] == j] if i != j else a.iloc[:0]
        ids, m, own = np.concatenate([a["rid"], b["rid"]]), np.concatenate([a["m"], b["m"]]), len(a)
        if not own or (i != j and not len(b)):
            return pd.DataFrame({"rid": [], "links": [], "root": []})
        x = np.stack(a["v"].tolist())
        y, off = (x, 0) if i == j else (np.stack(b["v"].tolist()), own)
        count, edges = np.zeros(len(ids), np.int64), []
        for at in range(0, own, block):
            hit = x[at : at + block] @ y.T >= threshold
            pairs = np.argwhere(np.triu(hit, at + 1) if i == j else hit) + [at, off]
            count += weighed(pairs, m)
            root = _roots(len(ids), pairs)
            low = np.flatnonzero(root != np.arange(len(ids)))
            edges.append(np.stack([low, root[low]], 1))
        root, touched = _roots(len(ids), np.concatenate(edges)), count > 0
        return pd.DataFrame({"rid": ids[touched], "links": count[touched], "root": ids[root[touched]]})

    return run


def all_pairs(scratch: Scratch, src: DataFrame, dim: int, rows: int, threshold: float, block: int) -> DataFrame:
    """rid, links and root of linked rows: every pair is compared, in parts that meet each other once."""
    parts = max(math.ceil(rows / PART), min(8, math.ceil(rows / block)))
    part = F.pmod(F.xxhash64("rid"), F.lit(parts)).cast("int")
    units = src.mapInPandas(_units(dim), "rid long, m long, v array<double>").withColumn("part", part)
    meets = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda o: F.struct(F.least(o, F.col("part")).alias("i"), F.greatest(o, F.col("part")).alias("j")))
    units = units.select("rid", "m", "v", "part", F.explode(meets).alias("x")).select("rid", "m", "v", "part", "x.i", "x.j")
    return scratch.save(units.groupBy("i", "j").applyInPandas(_all_pairs(threshold, block), "rid long, links long, root long"), "links")


def by_passes(scratch: Scratch, src: DataFrame, dim: int, rows: int, passes: int, mean: np.ndarray, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(rid, links) and the components (node, component) that the passes find."""
    keyed = src.mapInPandas(_keys(dim, passes, mean), "rid long, m long, v array<double>, keys array<long>")
    keyed = scratch.save(keyed, "keyed")

    # the place of every vector on each pass's sorted line: a key prefix is counted, then rows inside it are numbered
    depth = min(BITS, max(1, math.ceil(math.log2(max(rows, 2) / block)) + 6))
    spread = keyed.select("rid", F.posexplode("keys").alias("p", "key")).withColumn("prefix", F.shiftright("key", BITS - depth))
    sizes = scratch.save(spread.groupBy("p", "prefix").agg(F.count("*").alias("n")).withColumn("coarse", F.shiftright("prefix", depth // 2)), "sizes")
    # in two levels, so that no task numbers all prefixes of a pass
    upto = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    coarse = sizes.groupBy("p", "coarse").agg(F.sum("n").alias("n"))
    coarse = coarse.select("p", "coarse", F.coalesce(F.sum("n").over(upto("p").orderBy("coarse")), F.lit(0)).alias("first"))
    inner = F.coalesce(F.sum("n").over(upto("p", "coarse").orderBy("prefix")), F.lit(0))
    sizes = sizes.withColumn("inner", inner).join(coarse, ["p", "coarse"]).select("p", "prefix", (F.col("first") + F.col("inner")).alias("before"))
    inside = Window.partitionBy("p", "prefix").orderBy("key", "rid")
    placed = spread.withColumn("rn", F.row_number().over(inside)).join(sizes, ["p", "prefix"])
    placed = placed.select("rid", "p", F.floor((F.col("before") + F.col("rn") - 1) / block).cast("int").alias("b"))
    placed = placed.groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "b"))), lambda s: s["b"]).alias("blocks"))
    lined = scratch.save(keyed.drop("keys").join(placed, "rid"), "lined")
    scratch.drop(keyed)

    found = []
    for q in range(passes):
        at = F.col("blocks")[q]
        both = lined.select("rid", "m", "v", "blocks", F.explode(F.array(F.struct(at.alias("g"), F.lit(0).alias("role")), F.struct((at - 1).alias("g"), F.lit(1).alias("role")))).alias("x"))
        both = both.select("rid", "m", "v", "blocks", "x.g", "x.role")
        links = both.groupBy("g").applyInPandas(_window(q, threshold), "rid long, links long, root long")
        found.append(scratch.save(links, f"pass{q}"))
        scratch.keep_only(src, lined, *found)
    found = scratch.save(union_all(found), "links")
    comp = scratch.save(components(scratch, found.select(F.col("rid").alias("a"), F.col("root").alias("b"))), "components")
    links = found.select("rid", "links")

    # components wider than a block
    big = comp.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    big = scratch.save(big.withColumn("parts", F.ceil(F.col("n") / block).cast("int")), "big")
    if big.limit(1).count():
        members = lined.join(comp.join(big, "component").select(F.col("node").alias("rid"), "component", "parts"), "rid")
        members = members.withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))
        # a part meets every other one once: it is sent to the pairs it belongs to
        pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("i"), F.greatest(o, F.col("part")).alias("j")))
        members = members.select("rid", "m", "v", "blocks", "component", "part", F.explode(pairs).alias("x")).select("rid", "m", "v", "blocks", "component", "part", "x.i", "x.j")
        rest = members.groupBy("component", "i", "j").applyInPandas(_between(passes, threshold), "rid long, links long")
        links = links.unionByName(scratch.save(rest, "rest"))
    return links, comp


def linked_classes(scratch: Scratch, classes: DataFrame, dim: int, rows: int, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(rid, links) and components (node, component) of classes (rid, m, v) of one length."""
    sums = classes.mapInPandas(_sums(dim), "n long, total array<double>").toPandas()
    mean = sum(sums["total"], np.zeros(dim)) / max(int(sums["n"].sum()), 1)
    passes = measured_passes(classes, dim, mean, rows, threshold, block)
    if passes is not None:
        return by_passes(scratch, classes, dim, rows, passes, mean, threshold, block)
    found = all_pairs(scratch, classes, dim, rows, threshold, block)
    return found.select("rid", "links"), scratch.save(components(scratch, found.select(F.col("rid").alias("a"), F.col("root").alias("b"))), "components")


def near_duplicates(
    spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors``.

    Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing, and only vectors of one length link with each other (lengths are few: each is
    worked on by itself).  Repeated ids are rows of their own, so a copy of a row links with
    it; a null id keeps its place, is no smallest id, and is its own component when alone.
    Other columns are ignored.
    """
    scratch = Scratch(spark, "vectors")
    v = F.col(vector_col).cast("array<double>")
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.monotonically_increasing_id().alias("rid"))
    # two digests name a class of equal vectors; its smallest row stands for it
    digests = [F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g")]
    usable = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    src = scratch.save(src.select("vec_id", "rid", "v", usable.alias("ok"), *digests), "src")
    classes = src.filter("ok").groupBy("h", "g").agg(F.min("rid").alias("rid"), F.count("*").alias("m"), F.first("v").alias("v"))
    classes = scratch.save(classes.withColumn("dim", F.size("v")), "classes")
    links = comp = None
    for shape in sorted(classes.groupBy("dim").agg(F.count("*").alias("n")).collect()):
        some = classes.filter(F.col("dim") == shape["dim"]).select("rid", "m", "v")
        n, c = linked_classes(Scratch(spark, f"vectors-{shape['dim']}"), some, shape["dim"], shape["n"], threshold, block)
        links, comp = (n, c) if links is None else (links.unionByName(n), comp.unionByName(c))
    alone = src.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), "ok")
    if links is None:
        return alone.drop("ok")
    n_links = links.groupBy("rid").agg(F.sum("links").alias("n_links"))
    named = classes.drop("v", "dim").join(n_links, "rid", "left").join(comp.withColumnRenamed("node", "rid"), "rid", "left")
    named = named.select("h", "g", F.coalesce("component", "rid").alias("component"), (F.coalesce("n_links", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    members = scratch.save(src.filter("ok").select("vec_id", "rid", "h", "g").join(named, ["h", "g"]).select("vec_id", "rid", "component", "n_links"), "members")
    # components are over rows; their name is the smallest vector id inside
    names = members.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    linked = members.join(names, "component").select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    linked = linked.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    return linked.unionByName(alone.filter("not ok").drop("ok"))
