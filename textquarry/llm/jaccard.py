"""Size-aware heavy-light self-join on word-shingle sets by Jaccard similarity.

Sets are split at a size boundary that a cost model picks from the size histogram and
the measured inverted lists (after Deng et al., 2018).

* Light (small) sets enumerate subsets of fixed size.  Sizes s and t need an overlap of
  c(s, t); two sets that produce the same c(s, t)-subset have it, so that a shared
  subset is a link and a group of equal subsets is connected through one member.
* Heavy (large) sets scan inverted lists.  Under a global order of shingles only the
  first s - ceil(0.8 s) + 1 of a set are listed; two linked sets share one of those.  The
  order is a hash, except that shingles found in very many sets come last, which keeps
  passages shared by otherwise different documents out of the lists.

The result is the connected components of the links.  Within a list every set is first
compared with one hub (a linear number of pairs), in a few rounds with other hubs; then
all pairs of a list whose members are still in different components are compared.  Pairs
inside a component need no comparison, so groups of copies cost a linear number of
pairs and no link between components is lost.

Two exact bounds spare most comparisons of whole sets.  Every set has a parity bitmap:
each shingle flips one of 512 bits, so that two sets differ in at least as many shingles
as their bitmaps differ in bits.  And the shared part of two listed prefixes bounds the
overlap from above.

Equal sets are one node.  A set is known by two 64-bit digests: it goes by the first one,
and where unequal sets share that, all but one of them get another name.  Shingles are
62-bit hashes of the words, so that two of a pair's thousand shingles fall together with
a chance of about 1e-13.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, fresh, slices, union_all
from .textnum import BLANKS, mix64, shingles, words_by_doc

WORDS = 5
PERCENT = 80
#: A shingle listed by more sets than this comes last in the order.
HOT = 48
MAX_BOUNDARY = 12
HUB_ROUNDS = 2
BITMAP_WORDS = 8
BROADCAST_IDS = 500_000
LOWEST = -(2**63)
HOT_BIT = 1 << 62


def overlap_needed(s: int, t: int, percent: int = PERCENT) -> int:
    """Least overlap of linked sets of sizes s and t: the smallest i with 100 i >= percent (s + t - i)."""
    return -(-percent * (s + t) // (100 + percent))


def partner_sizes(s: int, percent: int = PERCENT) -> range:
    return range(-(-percent * s // 100), 100 * s // percent + 1)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def view_length(n: int, percent: int = PERCENT) -> int:
    """How much of a set is kept at hand: its prefix and what may come into it as others are put last; small sets whole."""
    p = prefix_length(n, percent)
    return min(n, max(MAX_BOUNDARY, p + p // 2 + 8))


def subset_cost(s: int, percent: int = PERCENT) -> int:
    return sum(math.comb(s, overlap_needed(s, t, percent)) for t in partner_sizes(s, percent) if overlap_needed(s, t, percent) <= s)


def _sets(words: int, percent: int):
    """Of each row the set's size, name (sid), second digest, bitmap and smallest shingles."""

    def run(batches):
        for pdf in slices(batches):
            n, sid, second, pre, bits = [], [], [], [], []
            for _, w in words_by_doc(pdf["text"].tolist(), BLANKS):
                h = set_of(w, words)
                n.append(len(h))
                bits.append(parity_bitmap(h))
                sid.append(digest(h) if len(h) else None)
                second.append(digest(h, 1) if len(h) else None)
                pre.append(h[: view_length(len(h), percent)].copy() if len(h) else h)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "key": pdf["key"].array, "mark": pdf["mark"].array, "n": n, "sid": pd.array(sid, "Int64"), "second": pd.array(second, "Int64"), "bits": bits, "pre": pre})

    return run


def parity_bitmap(h: np.ndarray) -> np.ndarray:
    """Bit b of the bitmap: whether an odd number of shingles falls on b."""
    odd = (np.bincount(h % (64 * BITMAP_WORDS), minlength=64 * BITMAP_WORDS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def set_of(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Sorted distinct shingles as 62-bit numbers."""
    return np.unique(shingles(words, n) >> np.uint64(2)).astype(np.int64)


def digest(h: np.ndarray, salt: int = 0) -> int:
    """One of two independent 64-bit digests of a set."""
    x = mix64((h.astype(np.uint64) + np.uint64(len(h))) ^ np.uint64(salt * 0xD1B54A32D192ED03))
    both = mix64(np.add.reduce(x)[None] ^ mix64(np.bitwise_xor.reduce(x)[None] + np.uint64(len(h))))
    return int(both.astype(np.int64)[0])


def second_digests(words: int):
    """Column function from texts to the second digests of their sets; null for empty ones."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        sets = (set_of(w, words) for _, w in words_by_doc(texts.tolist(), BLANKS))
        return pd.Series([digest(h, 1) if len(h) else None for h in sets], dtype="Int64")

    return run


def _whole(words: int):
    """(sid, h) for rows whose set is the wanted one: repeated ids may have other texts."""

    def run(batches):
        for pdf in slices(batches):
            rows = []
            for (_, w), sid, second in zip(words_by_doc(pdf["text"].tolist(), BLANKS), pdf["sid"], pdf["second"]):
                h = set_of(w, words)
                if len(h) and digest(h, 1) == second:
                    rows.append((sid, h))
            yield pd.DataFrame({"sid": pd.array([r[0] for r in rows], "Int64"), "h": pd.Series([r[1] for r in rows], dtype=object)})

    return run


def _subsets(boundary: int, percent: int):
    """Subset keys of light sets: (lo, hi, sub, sid, side)."""

    def run(batches):
        for pdf in batches:
            out = []
            for sid, h in zip(pdf["sid"], pdf["h"]):
                s = len(h)
                v = mix64(np.asarray(h, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1))
                for t in partner_sizes(s, percent):
                    c = overlap_needed(s, t, percent)
                    if not 1 <= t <= boundary or c > min(s, t):
                        continue
                    for pick in combinations(range(s), c):
                        key = int(mix64(np.add.reduce(v[list(pick)])[None] + np.uint64(c)).astype(np.int64)[0])
                        out.append((min(s, t), max(s, t), key, sid, s))
            yield pd.DataFrame(out, columns=["lo", "hi", "sub", "sid", "s"])

    return run


class Join:
    def __init__(self, spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int):
        self.spark, self.scratch, self.words, self.percent = spark, Scratch(spark, "jaccard"), words, percent
        self.docs = docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("key"),
            F.xxhash64(F.col(text_col).cast("string")).alias("mark"),
            F.col(text_col).alias("text"),
        )

    def fetch(self, wanted: DataFrame, name: str) -> DataFrame:
        """Whole sets (sid, h) of ``wanted`` (sid, and key: id and mark of a row they are found at, second digest), read again from the texts.

        An id and the mark of its text are one row, and its copies at most: rows that share
        an id, or have none, are not met by each other's sets.  Texts stay where they are
        while the list of wanted sets is small enough to send.
        """
        wanted = self.scratch.save(wanted.select("sid", "key.key", "key.mark", "key.second"), f"want-{name}")
        size = wanted.count()
        other = F.broadcast(wanted) if size <= BROADCAST_IDS else wanted
        got = self.docs.join(other, ["key", "mark"]).select("text", "sid", "second").mapInPandas(_whole(self.words), "sid long, h array<long>")
        got = self.scratch.save(got, name)
        if got.count() > size:  # rows that repeat both id and text
            got = self.scratch.save(got.groupBy("sid").agg(F.first("h").alias("h")), f"{name}-once")
        return got

    def linked(self, inter: Column, a: Column, b: Column) -> Column:
        return inter * (100 + self.percent) >= (a + b) * self.percent

    def run(self, *more: str) -> DataFrame:
        """doc_id, n_shingles and component_id; ``more`` may name second, the set's second digest."""
        save, pct = self.scratch.save, self.percent
        schema = "doc_id long, key long, mark long, n int, sid long, second long, bits array<long>, pre array<long>"
        rows = save(self.docs.mapInPandas(_sets(self.words, pct), schema), "rows")
        rows = self.told_apart(rows)
        first = [F.first(c).alias(c) for c in ("n", "bits", "pre")]
        # a set is read again at a row of its smallest id, which also names it; LOWEST stands for copies that all lack one
        own = F.min("doc_id")
        at = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "key", "mark"))
        key = [own.alias("own"), F.struct(at["key"].alias("key"), at["mark"].alias("mark"), F.first("second").alias("second")).alias("key")]
        sets = save(rows.filter("sid is not null").groupBy("sid").agg(*key, *first), "sets")
        ids, reps = save(rows.select("doc_id", "n", "sid", *more), "ids"), save(sets.select("sid", "own", "key", "n"), "reps")
        self.scratch.keep_only(sets, ids, reps)
        boundary = self.boundary(sets)
        edges = [save(e, "links") for e in (self.light(sets, boundary),) if e is not None]
        edges.append(save(self.heavy(sets, -(-pct * (boundary + 1) // 100), [ids, reps, *edges]), "links"))
        self.scratch.keep_only(ids, reps, *edges)
        comp = components(self.scratch, union_all(edges))
        named = save(reps.select("sid", "own").join(comp.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid")), "named")
        # a null id has no place in the order of ids; copies of a set count through its smallest id
        names = save(named.groupBy("component").agg(F.min("own").alias("component_id")), "component-names")
        named = save(named.join(names, "component").select("sid", "component_id"), "names")
        out = ids.join(named, "sid", "left")
        return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *more)

    def told_apart(self, rows: DataFrame) -> DataFrame:
        """``rows`` with another name for sets that share theirs with a set of a smaller second digest."""
        both = rows.filter("sid is not null").groupBy("sid").agg(F.min("second").alias("least"), F.max("second").alias("most"))
        both = self.scratch.save(both.filter("least <> most").select("sid", "least"), "shared-names")
        if not both.limit(1).count():
            return rows
        other = F.when(F.col("second") > F.col("least"), F.xxhash64("sid", "second")).otherwise(F.col("sid"))
        return rows.join(both, "sid", "left").withColumn("sid", other).drop("least")

    def boundary(self, reps: DataFrame) -> int:
        """The size up to which enumerating subsets is cheaper than scanning lists."""
        small = {r["n"]: r["c"] for r in reps.filter(F.col("n") <= 2 * MAX_BOUNDARY).groupBy("n").agg(F.count("*").alias("c")).collect()}
        p = (F.col("n") - F.ceil(F.col("n") * self.percent / 100) + 1).cast("int")
        lists = reps.filter(F.col("n") <= 2 * MAX_BOUNDARY).select(F.explode(F.slice("pre", F.lit(1), p)).alias("e")).groupBy("e").agg(F.count("*").alias("c"))
        met, total = lists.agg(F.sum(F.col("c") * F.col("c")), F.sum("c")).first()
        length = (met or 0) / (total or 1)  # of the list that a listed shingle of a small set meets
        best, least = 0, None
        for x in range(MAX_BOUNDARY + 1):
            cost = sum(c * subset_cost(s, self.percent) for s, c in small.items() if s <= x)
            low = -(-self.percent * (x + 1) // 100)
            cost += sum(c * prefix_length(s, self.percent) * length for s, c in small.items() if s >= low)
            if least is None or cost < least:
                best, least = x, cost
        return best

    def light(self, sets: DataFrame, boundary: int) -> DataFrame | None:
        if not boundary:
            return None
        sets = sets.filter(F.col("n") <= boundary).select("sid", F.col("pre").alias("h"))  # a view of so few shingles is the whole set
        subs = sets.mapInPandas(_subsets(boundary, self.percent), "lo int, hi int, sub long, sid long, s int")
        subs = self.scratch.save(subs, "subsets")
        low = F.min(F.when(F.col("s") == F.col("lo"), F.col("sid"))).alias("a")
        high = F.min(F.when(F.col("s") == F.col("hi"), F.col("sid"))).alias("b")
        hubs = subs.groupBy("lo", "hi", "sub").agg(low, high, F.count("*").alias("c")).filter("c > 1 and a is not null and b is not null")
        hubs = self.scratch.save(hubs.drop("c"), "hubs")
        ties = subs.join(hubs, ["lo", "hi", "sub"])
        # each side is tied to the other side's smallest member
        other = F.when(F.col("s") == F.col("lo"), F.col("b")).otherwise(F.col("a"))
        other = F.when(F.col("lo") == F.col("hi"), F.col("a")).otherwise(other)
        return ties.select(F.col("sid").alias("a"), other.alias("b")).filter("a <> b").distinct()

    def order(self, heavy: DataFrame) -> DataFrame:
        """Sets as (sid, key, n, pre) under the final order, in which frequent shingles come last.

        Only sets that list a frequent shingle look further than their hash prefix, into
        the rest of their view.  What they see is counted again, since more of a shared
        passage comes into sight; that count fixes the order for all sets.
        """
        save = self.scratch.save
        p = (F.col("n") - F.ceil(F.col("n") * self.percent / 100) + 1).cast("int")
        listed = heavy.select("sid", F.explode(F.slice("pre", F.lit(1), p)).alias("e"))
        hot = save(listed.groupBy("e").agg(F.count("*").alias("c")).filter(F.col("c") > HOT).select("e"), "hot")
        touched = save(listed.join(hot, "e", "left_semi").select("sid").distinct(), "touched")
        views = heavy.join(touched, "sid", "left_semi").select("sid", F.explode("pre").alias("e"))
        last = save(views.groupBy("e").agg(F.count("*").alias("c")).filter(F.col("c") > HOT).select("e"), "last")
        both = listed.join(last, "e", "left_semi").select("sid").unionByName(touched).distinct()
        moving = save(heavy.join(both, "sid", "left_semi"), "moving")
        moved = save(self.reorder(heavy, moving.select("sid", F.col("pre").alias("h")), last), "moved")
        # a view that holds too few other shingles: the whole set is ordered
        short = moved.filter("not enough").select("sid")
        whole = self.fetch(heavy.join(short, "sid", "left_semi").select("sid", "key"), "whole")
        moved = moved.filter("enough").unionByName(self.reorder(heavy, whole, last)).select("sid", "key", "n", "pre")
        kept = heavy.select("sid", "key", "n", F.slice("pre", F.lit(1), p).alias("pre")).join(both, "sid", "left_anti")
        ordered = save(kept.unionByName(moved), "ordered")
        self.scratch.drop(hot, touched, last, moving)
        return ordered

    def reorder(self, heavy: DataFrame, views: DataFrame, last: DataFrame) -> DataFrame:
        """Prefixes with the shingles of ``last`` behind all others; enough: the view holds a whole prefix."""
        own = views.select("sid", F.explode("h").alias("e")).join(last, "e").groupBy("sid").agg(F.collect_list("e").alias("late"))
        both = heavy.select("sid", "key", "n").join(views, "sid").join(own, "sid", "left")
        late = F.coalesce("late", F.array().cast("array<long>"))
        length = (F.col("n") - F.ceil(F.col("n") * self.percent / 100) + 1).cast("int")
        both = both.select("sid", "key", "n", F.array_except("h", late).alias("early"), late.alias("late"), length.alias("p"), F.size("h").alias("seen"))
        marked = F.transform(F.array_sort("late"), lambda e: e.bitwiseOR(F.lit(HOT_BIT)))
        enough = (F.size("early") >= F.col("p")) | (F.col("seen") == F.col("n"))
        return both.select("sid", "key", "n", F.slice(F.concat("early", marked), F.lit(1), F.col("p")).alias("pre"), enough.alias("enough"))

    def heavy(self, sets: DataFrame, least: int, held: list[DataFrame]) -> DataFrame:
        """Links found on inverted lists of the sets of at least ``least`` shingles; ``held`` are tables still needed."""
        save = self.scratch.save
        ordered = self.order(sets.filter(F.col("n") >= least).drop("bits"))
        bits = save(sets.select("sid", "bits"), "bits")
        self.scratch.keep_only(*held, ordered, bits)
        listed = ordered.select(F.explode("pre").alias("e"), "sid", "n")
        lists = listed.groupBy("e").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).filter("lo < hi")
        lists = save(lists.select("e"), "lists")
        shared = save(listed.join(lists, "e"), "shared")
        # a set that shares many long lists is the likeliest centre of a group of copies
        weight = shared.join(shared.groupBy("e").agg(F.count("*").alias("m")), "e").groupBy("sid").agg(F.sum("m").alias("weight"))
        centre = save(weight.join(bits, "sid"), "centre")
        shared = save(shared.join(centre, "sid"), "members")
        pre = save(ordered.join(centre.select("sid"), "sid", "left_semi").select("sid", "n", "pre"), "prefixes")
        keys = save(ordered.join(centre.select("sid"), "sid", "left_semi").select("sid", "key"), "keys")
        self.scratch.keep_only(*held, shared, pre, keys)
        edges: list[DataFrame] = []
        tested = comp = have = None
        for r in range(HUB_ROUNDS + 1):
            now = shared if comp is None else shared.join(comp, "sid", "left")
            now = now.withColumn("c", F.coalesce(F.col("component"), F.col("sid")) if comp is not None else F.col("sid"))
            # each round prefers another third of the sets as hubs
            turn = F.struct((F.pmod(F.xxhash64("sid"), F.lit(3)) == r % 3) | F.lit(r == 0), "weight", "sid")
            hub = F.max_by(F.struct("sid", "n", "c", "bits"), turn).alias("hub")
            mixed = now.groupBy("e").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), hub).filter("lo < hi")
            mixed = save(mixed.select("e", *[F.col(f"hub.{x}").alias(f"hub_{x}") for x in ("sid", "n", "c", "bits")]), f"mixed{r}")
            if not mixed.limit(1).count():
                break
            if r < HUB_ROUNDS:
                pairs = now.join(mixed, "e").filter((F.col("c") != F.col("hub_c")) & self.near("n", "bits", "hub_n", "hub_bits"))
                pairs = pairs.select(F.least("sid", "hub_sid").alias("a"), F.greatest("sid", "hub_sid").alias("b"))
            else:
                cols = ("sid", "n", "c", "bits")
                left = save(now.join(mixed.select("e"), "e", "left_semi").select("e", *cols), "left")
                x, y = (left.select("e", *[F.col(c).alias(f"{c}_{side}") for c in cols]) for side in "ab")
                apart = (F.col("sid_a") < F.col("sid_b")) & (F.col("c_a") != F.col("c_b"))
                pairs = x.join(y, (x["e"] == y["e"]) & apart & self.near("n_a", "bits_a", "n_b", "bits_b"))
                pairs = pairs.select(F.col("sid_a").alias("a"), F.col("sid_b").alias("b"))
            pairs = pairs.distinct()
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = save(pairs, f"pairs{r}")
            good, have = self.verify(pairs, pre, keys, r, have)
            edges.append(good)
            tested = pairs if tested is None else tested.unionByName(pairs)
            comp = self.scratch.save(components(self.scratch, union_all(edges)).withColumnRenamed("node", "sid"), f"comp{r}")
        return union_all(edges) if edges else self.spark.createDataFrame([], "a long, b long")

    def near(self, na: str, ba: str, nb: str, bb: str) -> Column:
        """Whether sizes and bitmaps leave room for a link: the sets may differ in (100 - p) / (100 + p) of their sizes."""
        differ = F.expr(" + ".join(f"bit_count({ba}[{i}] ^ {bb}[{i}])" for i in range(BITMAP_WORDS)))
        low = F.abs(F.col(na) - F.col(nb))
        return F.greatest(differ, low) * (100 + self.percent) <= (F.col(na) + F.col(nb)) * (100 - self.percent)

    def verify(self, pairs: DataFrame, pre: DataFrame, keys: DataFrame, r: int, have: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """The linked ones of ``pairs`` (a, b), and the whole sets known now: those of ``have`` are not read again."""
        one = pre.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("pre").alias("pa"))
        two = pre.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("pre").alias("pb"))
        both = pairs.join(one, "a").join(two, "b")
        # up to the end of the prefix that ends first, all that the sets share is seen; the rest is bounded by what is left
        end = F.least(F.element_at("pa", -1), F.element_at("pb", -1))
        seen = lambda p: F.size(F.filter(p, lambda e: e <= end))
        most = F.size(F.array_intersect("pa", "pb")) + F.least(F.col("na") - seen("pa"), F.col("nb") - seen("pb"))
        maybe = self.scratch.save(both.filter(self.linked(most, F.col("na"), F.col("nb"))).select("a", "b", "na", "nb"), f"maybe{r}")
        need = maybe.select(F.col("a").alias("sid")).unionByName(maybe.select(F.col("b").alias("sid"))).distinct()
        wanted = keys.join(need, "sid", "left_semi")
        sets = self.fetch(wanted if have is None else wanted.join(have, "sid", "left_anti"), f"sets{r}")
        sets = sets if have is None else have.unionByName(sets)
        full = maybe.join(sets.select(F.col("sid").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("sid").alias("b"), F.col("h").alias("hb")), "b")
        inter = F.size(F.array_intersect("ha", "hb"))
        return self.scratch.save(full.filter(self.linked(inter, F.col("na"), F.col("nb"))).select("a", "b"), f"good{r}"), sets


def jaccard_classes(
    spark: SparkSession, docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    Words are runs of bytes other than blank, tab, newline, vertical tab, form feed and
    carriage return, with A-Z lower-cased; a text with fewer than ``words`` of them is one
    shingle.  Null and empty texts have no shingle and link with nothing.  Repeated rows are
    linked copies.  A row with a null id takes the smallest id of its component, if there
    is one.  Other columns are ignored.
    """
    return Join(spark, docs, id_col, text_col, words, percent).run()


def one_of_each(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns as they are, less all but the smallest id of each component.

    Rows that repeat an id and a text are one document; rows without an id stay.
    """
    scratch = Scratch(spark, "one-of-each")
    join = Join(spark, docs, id_col, text_col, options.get("words", WORDS), options.get("percent", PERCENT))
    classes = scratch.save(join.run("second"), "classes")
    join.scratch.keep_only()
    key, name, own = fresh(docs, "_gone"), fresh(docs, "_lost_set"), fresh(docs, "_own_set")
    lost = classes.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(key), F.col("second").alias(name))
    gone = lost.select(key).distinct()
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    twice = classes.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1")
    twice = scratch.save(twice.select(F.col("doc_id").alias(key)), "twice")
    if not twice.limit(1).count():
        return docs.join(gone, docs[id_col] == gone[key], "left_anti")
    # rows that share an id: only those go whose own set has a smaller id
    again = docs[id_col] == twice[key]
    left = docs.join(twice, again, "left_anti")
    left = left.join(gone, left[id_col] == gone[key], "left_anti")
    clash = docs.join(twice, again, "left_semi").withColumn(own, second_digests(join.words)(text_col))
    lost = scratch.save(lost.join(twice, key, "left_semi").distinct(), "lost")
    clash = clash.join(lost, (clash[id_col] == lost[key]) & (clash[own] == lost[name]), "left_anti")
    return left.unionByName(clash.drop(own).dropDuplicates([id_col, text_col]))
