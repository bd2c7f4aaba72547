"""Prefix trie of conversations from mergeable partial tries.

A node is a distinct sequence of first turns.  It is known by its depth and two 64-bit
numbers, sum of hash(turn i) * R^i for two hashes and two odd R: such sums continue anywhere,
so that a long conversation is read by several tasks and a spliced one needs no second look
at its turns.

1. Turns are range-partitioned and sorted by conversation and place; each task walks its
   range with running sums, and what the ranges before it hold of the same conversation
   (at most one row a range) is added.
2. Each turn of a conversation is a row of a partial trie.  Tasks combine the nodes they
   have; tree merges keyed by the node, ``FAN`` partial tries at a time, then by the node
   alone, sum members and find the smallest one.  End lists are merged as sorted pieces of
   bounded size, since one sequence may end a third of all conversations.
3. Rollup from the ends to the root.  The nodes whose smallest member is c form one chain,
   the lower end of c's path; what a chain holds is known from the node table.  Each
   conversation adds its chain to all its prefixes through the same tree merges: a subtree's
   leaves are the chains of its members that end childless, and its saving is what members
   but the smallest share with smaller ids below the node.  This takes one merge where
   level by level it would take as many rounds as the longest conversation has turns.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, union_all, width

#: Partial tries that one tree merge brings together.
FAN = 64
#: Turns that a rebuilt conversation may take from another, at most.
HEAD = 5
#: Ids in a piece of an end list.
PIECE = 8192
_R = {"a": 0x9E3779B97F4A7C15, "b": 0xC2B2AE3D27D4EB4F}
_KEY = ["depth", "a", "b"]
_U = np.uint64
_WORD = (1 << 64) - 1
_tables: dict[str, np.ndarray] = {}


def _powers(name: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """R^0.. and R^-0.. up to n."""
    if len(_tables.get(name, ())) <= n:
        for key, base in ((name, _R[name]), (f"-{name}", pow(_R[name], -1, 1 << 64))):
            t = np.full(max(n + 1, 1 << 14), base, _U)
            t[0] = 1
            _tables[key] = np.multiply.accumulate(t)
    return _tables[name], _tables[f"-{name}"]


def _power(name: str, e: np.ndarray) -> np.ndarray:
    """R^e for whole numbers of any size and sign."""
    out, base, left = np.ones(len(e), _U), np.where(e < 0, _U(pow(_R[name], -1, 1 << 64)), _U(_R[name])), np.abs(e)
    while left.any():
        out = np.where(left & 1, out * base, out)
        base, left = base * base, left >> 1
    return out


def _u(x: pd.Series) -> np.ndarray:
    return x.to_numpy(np.int64).view(_U)


def _walk(batches):
    """Turns in order with their number and running sums within this range of one conversation."""
    conv, n, sums, chars = None, 0, {"a": 0, "b": 0}, 0
    for pdf in batches:
        size = len(pdf)
        if not size:
            continue
        ids = pdf["conv_id"].to_numpy()
        new = np.append(ids[0] != conv, ids[1:] != ids[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(size), 0))
        carried = np.cumsum(new) == 0  # rows that go on with the conversation of the batch before
        at = np.arange(size) - first
        out = {"conv_id": ids, "i": at + 1 + np.where(carried, n, 0)}
        for s in "ab":
            up, down = _powers(s, size)
            run = np.concatenate([[_U(0)], np.cumsum(_u(pdf[f"h{s}"]) * up[:size])])
            here = (run[1:] - run[first]) * down[first]  # weights R^0.. from the conversation's first row in the batch
            grown = here * _U(pow(_R[s], n + 1, 1 << 64)) + _U(sums[s])
            out[s] = np.where(carried, grown, here * _U(_R[s])).view(np.int64)
        total = np.concatenate([[0], np.cumsum(pdf["chars"].to_numpy(np.int64))])
        out["upto"] = total[1:] - total[first] + np.where(carried, chars, 0)
        frame = pd.DataFrame(out)
        conv, n, chars = ids[-1], int(frame["i"].iloc[-1]), int(frame["upto"].iloc[-1])
        sums = {s: int(frame[s].iloc[-1]) & _WORD for s in "ab"}
        yield frame.assign(part=pdf["part"], ha=pdf["ha"], hb=pdf["hb"], chars=pdf["chars"])


def _offsets(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one conversation that lies in several ranges, what the ranges before each one hold."""
    rows, n, sums, chars = [], 0, {"a": 0, "b": 0}, 0
    for r in pdf.sort_values("part").to_dict("records"):
        signed = [int(np.array(sums[s], _U).view(np.int64)) for s in "ab"]
        rows.append((r["conv_id"], r["part"], n, *signed, chars))
        sums = {s: (sums[s] + pow(_R[s], n, 1 << 64) * (r[s] & _WORD)) & _WORD for s in "ab"}
        n, chars = n + r["i"], chars + r["upto"]
    return pd.DataFrame(rows, columns=["conv_id", "part", "o_i", "o_a", "o_b", "o_upto"])


def _placed(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    """Sums of first turns as they are in the whole conversation."""
    o = pdf["o_i"].to_numpy(np.int64)
    return {s: _u(pdf[f"o_{s}"]) + _power(s, o) * _u(pdf[s]) for s in "ab"}


def _heads(batches):
    for pdf in batches:
        whole = _placed(pdf)
        yield pdf[["conv_id", "i", "upto", "chars"]].assign(i=pdf["i"] + pdf["o_i"], upto=pdf["upto"] + pdf["o_upto"], a=whole["a"].view(np.int64), b=whole["b"].view(np.int64))


def _own(batches):
    """A conversation's own turns behind the m turns that it starts with, as nodes."""
    for pdf in batches:
        whole, shift = _placed(pdf), (pdf["m"] - pdf["h"]).to_numpy(np.int64)
        depth = (pdf["i"] + pdf["o_i"]).to_numpy(np.int64) + shift
        out = {"conv_id": pdf["conv_id"], "depth": depth}
        for s in "ab":
            key = _u(pdf[f"lead_{s}"]) + _power(s, shift) * (whole[s] - _u(pdf[f"own_{s}"]))
            out[s] = key.view(np.int64)
            out[f"p{s}"] = (key - _power(s, depth) * _u(pdf[f"h{s}"])).view(np.int64)
        before = pdf["lead_upto"] + pdf["upto"] + pdf["o_upto"] - pdf["own_upto"] - pdf["chars"]
        yield pd.DataFrame(out | {"chars": pdf["chars"], "before": before, "ends": depth == pdf["length"].to_numpy()})


def _pieces(batches):
    """Sorted ends as pieces of the list of each node."""

    def piece(pdf):
        k = pdf.groupby(_KEY, sort=False)["conv_id"]
        out = k.agg(first="first", ids=lambda x: ",".join(map(str, x))).reset_index()
        return out[[*_KEY, "first", "ids"]]

    for pdf in batches:
        for at in range(0, len(pdf), PIECE):
            yield piece(pdf.iloc[at : at + PIECE])


def _hashes(batches):
    """SHA-256 of each node's pieces, read in order and joined by commas."""
    key, h = None, None
    for pdf in batches:
        out = []
        for *k, ids in pdf[[*_KEY, "ids"]].itertuples(index=False):
            if k != key:
                if h is not None:
                    out.append((*key, h.hexdigest()))
                key, h = k, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=[*_KEY, "ends_sha256"])
    if h is not None:
        yield pd.DataFrame([(*key, h.hexdigest())], columns=[*_KEY, "ends_sha256"])


class Trie:
    """Node and end tables of the conversations in ``turns`` (conv_id, turn, role, text).

    ``head`` (0 to 5, from conv_id) and ``leader`` (a conv_id) splice conversations: the
    first ``head`` turns are those of ``leader``, as far as it has them, then the own turns
    behind the first ``head`` follow.  Without them conversations are taken as they are.
    """

    def __init__(self, spark: SparkSession, turns: DataFrame, head: Column | None = None, leader: Column | None = None):
        self.spark, self.scratch, self.parts = spark, Scratch(spark, "trie"), width(spark)
        self.head, self.leader = F.lit(0) if head is None else head, F.col("conv_id") if leader is None else leader
        t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
        self.rows = self._rows(t.filter("conv_id is not null"))

    def _rows(self, turns: DataFrame) -> DataFrame:
        """One row for each conversation and node on its path, the root included."""
        save = self.scratch.save
        place = ["conv_id", "turn", "role"]
        # the start of a text deals rows that share all else; among equal starts the whole text decides
        sorted_ = turns.repartitionByRange(self.parts, *place, F.left("text", F.lit(64))).sortWithinPartitions(*place, "text")
        hashed = [F.xxhash64(F.lit(salt), "role", "text").alias(f"h{s}") for salt, s in ((11, "a"), (12, "b"))]
        sorted_ = sorted_.select(F.spark_partition_id().alias("part"), "conv_id", *hashed, F.length("text").cast("long").alias("chars"))
        walked = save(sorted_.mapInPandas(_walk, "part int, conv_id long, i long, a long, b long, upto long, ha long, hb long, chars long"), "walked")
        last = walked.groupBy("conv_id", "part").agg(F.max("i").alias("i"), F.max_by(F.struct("a", "b", "upto"), "i").alias("s"))
        last = save(last.select("conv_id", "part", "i", "s.*"), "last")
        split = last.groupBy("conv_id").agg(F.count("*").alias("c")).filter("c > 1").select("conv_id")
        offsets = last.join(split, "conv_id").groupBy("conv_id").applyInPandas(_offsets, "conv_id long, part int, o_i long, o_a long, o_b long, o_upto long")
        # two conversations at most go on at the bounds of a range: as many rows as ranges, twice
        offsets = F.broadcast(save(offsets.filter("o_i > 0"), "offsets"))
        zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("o_i", "o_a", "o_b", "o_upto")}
        placed = walked.join(offsets, ["conv_id", "part"], "left").withColumns(zero)
        heads = placed.filter(F.col("i") + F.col("o_i") <= HEAD).mapInPandas(_heads, "conv_id long, i long, upto long, chars long, a long, b long")
        heads = heads.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "a", "b", "upto", "chars"))).alias("heads"))
        convs = last.groupBy("conv_id").agg(F.sum("i").alias("n")).join(heads, "conv_id")
        convs = save(convs.withColumn("h", self.head.cast("int")).withColumn("leader", self.leader), "convs")
        lead = convs.select(F.col("conv_id").alias("leader"), F.col("heads").alias("lead"))
        convs = convs.join(lead, "leader", "left").withColumn("m", F.least("h", F.coalesce(F.size("lead"), F.lit(0))))
        convs = convs.withColumn("length", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
        upto = lambda array, k, c: F.coalesce(F.get(F.col(array), F.col(k) - 1)[c], F.lit(0).cast("long"))
        sums = [upto(x, k, c).alias(f"{name}_{c}") for name, x, k in (("lead", "lead", "m"), ("own", "heads", "h")) for c in ("a", "b", "upto")]
        convs = save(convs.select("conv_id", "n", "h", "m", "length", F.slice("lead", F.lit(1), F.col("m")).alias("lead"), *sums), "spliced")
        schema = "conv_id long, depth long, a long, b long, pa long, pb long, chars long, before long, ends boolean"
        own = placed.join(convs.drop("lead", "n"), "conv_id").filter(F.col("i") + F.col("o_i") > F.col("h")).mapInPandas(_own, schema)
        first = convs.select("conv_id", "length", "lead", F.posexplode("lead").alias("k", "t"))
        above = lambda c: F.coalesce(F.get("lead", F.col("k") - 1)[c], F.lit(0).cast("long"))
        first = first.select("conv_id", F.col("t.i").alias("depth"), "t.a", "t.b", above("a").alias("pa"), above("b").alias("pb"), "t.chars", (F.col("t.upto") - F.col("t.chars")).alias("before"), (F.col("t.i") == F.col("length")).alias("ends"))
        zeros = [F.lit(0).cast("long").alias(c) for c in ("depth", "a", "b", "pa", "pb", "chars", "before")]
        root = convs.select("conv_id", *zeros, (F.col("length") == 0).alias("ends"))
        rows = save(union_all([own, first, root]), "rows")
        self.scratch.keep_only(rows)
        return rows

    def merged(self, rows: DataFrame, **how) -> DataFrame:
        """Tables of nodes combined: first what tasks hold, then ``FAN`` tables at a time, then all by node."""
        slots = self.parts
        rows = rows.withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(slots)))
        while slots > FAN:
            slots = -(-slots // FAN)
            rows = rows.groupBy(*_KEY, F.floor(F.col("slot") / FAN).cast("int").alias("slot")).agg(*[f(c).alias(c) for c, f in how.items()])
        return rows.groupBy(*_KEY).agg(*[f(c).alias(c) for c, f in how.items()])

    def nodes(self) -> DataFrame:
        """depth, a, b (the key), conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, chars."""
        save = self.scratch.save
        flat = self.rows.select(*_KEY, "conv_id", "pa", "pb", "chars", "before", F.lit(1).cast("long").alias("n_convs"))
        nodes = save(self.merged(flat, conv_id=F.min, pa=F.max, pb=F.max, chars=F.max, before=F.max, n_convs=F.sum), "nodes")
        up = {"depth": F.col("depth") - 1, "a": F.col("pa"), "b": F.col("pb")}
        kids = nodes.filter("depth > 0").select(*[c.alias(k) for k, c in up.items()]).groupBy(*_KEY).agg(F.count("*").alias("n_children"))
        nodes = save(nodes.join(kids, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "with-children")
        # a conversation without a chain of its own shares all its text
        chain = nodes.groupBy("conv_id").agg(F.min("before").alias("shared"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
        total = self.rows.filter("ends").select("conv_id", (F.col("before") + F.col("chars")).alias("total"))
        convs = total.join(chain, "conv_id", "left").select("conv_id", F.coalesce("shared", "total").alias("shared"), F.coalesce("leaf", F.lit(0).cast("long")).alias("n_leaves"))
        convs = save(convs, "chains")
        each = self.rows.select("conv_id", *_KEY).join(convs, "conv_id").select(*_KEY, "shared", "n_leaves")
        below = save(self.merged(each, shared=F.sum, n_leaves=F.sum), "below")
        out = nodes.join(below, _KEY).join(convs.select("conv_id", F.col("shared").alias("own")), "conv_id")
        saved = F.col("shared") - F.col("own") - (F.col("n_convs") - 1) * F.col("before")
        out = out.withColumn("saved_tokens", saved).drop("shared", "own", "before")
        # inside a chain the parent has the same smallest member; a chain's top asks for it
        tops = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"))
        out = save(out.join(tops, "conv_id"), "rolled")
        inner = out.filter("depth <> top").withColumn("parent_conv_id", F.col("conv_id"))
        root = out.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
        above = nodes.select(*[F.col(c).alias(f"up_{c}") for c in _KEY], F.col("conv_id").alias("parent_conv_id"))
        tops = out.filter("depth = top and depth > 0")
        tops = tops.join(above, (F.col("depth") - 1 == F.col("up_depth")) & (F.col("pa") == F.col("up_a")) & (F.col("pb") == F.col("up_b")))
        out = union_all([inner, tops.drop("up_depth", "up_a", "up_b"), root])
        return out.drop("pa", "pb", "top")

    def ends(self) -> DataFrame:
        """depth, a, b, first and ids: of each node the conversations that end there, as sorted pieces of comma-joined ids."""
        ends = self.rows.filter("ends").select(*_KEY, "conv_id")
        ends = ends.repartitionByRange(self.parts, *_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id")
        return ends.mapInPandas(_pieces, "depth long, a long, b long, first long, ids string")

    def digests(self) -> DataFrame:
        """The nodes, with the digest of each end list instead of keys and lists."""
        pieces = self.scratch.save(self.ends(), "pieces")
        pieces = pieces.repartition(self.parts, *_KEY).sortWithinPartitions(*_KEY, "first")
        hashes = self.scratch.save(pieces.mapInPandas(_hashes, "depth long, a long, b long, ends_sha256 string"), "hashes")
        nodes = self.scratch.save(self.nodes().join(hashes, _KEY, "left"), "trie")
        self.scratch.keep_only(nodes)
        none = F.lit(hashlib.sha256(b"").hexdigest())
        cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
        return nodes.select(*cols, F.coalesce("ends_sha256", none).alias("ends_sha256"))


def rebuilt_trie(spark: SparkSession, conversations: DataFrame) -> Trie:
    """The trie of conversations rebuilt on the first turns of every hundredth one.

    Conversation c starts with the first h turns of conversation c - c % 100 (as many as
    there are; none if it is absent), h = crc32(c as decimal text) % 6, and goes on with its
    own turns behind its first h.  Turns are ordered by turn, null first, then role and
    text; a null role or text is empty; repeated rows are turns of their own.  Rows without
    a conv_id belong to no conversation.  A conversation may come out without turns: it is
    a member of the root and ends there.  An empty table has no nodes, not even the root.
    Other columns are ignored.
    """
    c = F.col("conv_id")
    return Trie(spark, conversations, F.crc32(c.cast("string")) % 6, c - c % 100)

