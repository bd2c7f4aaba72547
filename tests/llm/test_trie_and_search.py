"""Prefix trie and exact top-k search against brute force on small, awkward tables."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from textquarry.llm import maxscore, prefix_trie


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    nodes = defaultdict(list)
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
        for d in range(len(full[c]) + 1):
            nodes[full[c][:d]].append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        ends = ",".join(map(str, sorted(c for c in members if full[c] == path)))
        out.append((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members),
            sum(len(p) == len(path) + 1 for p in below),
            sum(not any(q[: len(p)] == p and len(q) > len(p) for q in below) for p in below),
            sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=lambda r: (r[0], r[1]))


SCHEMA = "part int, conv_id long, turn long, role string, text string, slot string, A string"


@pytest.mark.parametrize("fan", [2, 64])
def test_trie_against_brute_force(spark, monkeypatch, fan):
    monkeypatch.setattr(prefix_trie, "FAN", fan)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rng = random.Random(7)
    words = ["", None, "ja", "nein", "vielleicht ä 🙂"]
    rows = []
    for c in [*range(60), *range(95, 130), -5, -100, -101, 2**62]:
        for turn in range(rng.randrange(1, 9)):
            rows.append((c, rng.choice([turn, turn, turn, 3, None]), rng.choice(["user", "assistant", None]), rng.choice(words)))
    rows += [(7, t, "user", "ja") for t in range(200)] + [(8, t, "user", "ja") for t in range(200)]  # one conversation over several ranges, and its copy
    rows += rows[:20] + [(None, 1, "user", "none")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(0, *r, "x", "y") for r in rows], SCHEMA).repartition(3)
    got = prefix_trie.rebuilt_trie(spark, df).digests()
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0], r[1])) == brute_trie(rows)


def test_walk_goes_on_over_batches_and_ranges():
    import pandas as pd

    rng = np.random.default_rng(1)
    t = pd.DataFrame({"part": 0, "conv_id": np.repeat([1, 2, 3], [3, 50, 7]), "ha": rng.integers(-(2**63), 2**63 - 1, 60), "hb": rng.integers(-(2**63), 2**63 - 1, 60), "chars": rng.integers(0, 9, 60)})
    whole = pd.concat(prefix_trie._walk([t])).reset_index(drop=True)
    parts = pd.concat(prefix_trie._walk(t[a:b].reset_index(drop=True) for a, b in ((0, 1), (1, 20), (20, 21), (21, 55), (55, 60)))).reset_index(drop=True)
    pd.testing.assert_frame_equal(whole, parts)
    want = sum((int(x) % 2**64) * pow(prefix_trie._R["a"], i + 1, 2**64) for i, x in enumerate(t["ha"][3:20])) % 2**64
    assert int(whole["a"][19]) % 2**64 == want and whole["i"][19] == 17 and whole["upto"][19] == t["chars"][3:20].sum()
    cut = [pd.concat(prefix_trie._walk([t[:20]])), pd.concat(prefix_trie._walk([t[20:].reset_index(drop=True).assign(part=1)]))]
    last = pd.concat(x[x["conv_id"] == 2].tail(1) for x in cut)
    o = prefix_trie._offsets(last[["conv_id", "part", "i", "a", "b", "upto"]])
    placed = prefix_trie._placed(last.merge(o, on=["conv_id", "part"]))
    assert placed["a"].view(np.int64)[1] == whole["a"][52] and o["o_i"].tolist() == [0, 17]


def test_trie_of_plain_conversations_and_of_none(spark):
    df = spark.createDataFrame([(1, 0, "u", "a"), (1, 1, "v", "bc"), (2, 0, "u", "a"), (3, 0, "u", "x")], "conv_id long, turn long, role string, text string")
    t = prefix_trie.Trie(spark, df)
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in t.nodes().collect()}
    assert got == {(1, 0): (None, 3, 2, 2, 1), (1, 1): (1, 2, 1, 1, 1), (1, 2): (1, 1, 0, 1, 0), (3, 1): (1, 1, 0, 1, 0)}
    assert sorted((r.depth, r.ids) for r in t.ends().collect()) == [(1, "2"), (1, "3"), (2, "1")]
    assert prefix_trie.rebuilt_trie(spark, df.limit(0)).digests().collect() == []
    assert prefix_trie.rebuilt_trie(spark, df.filter("conv_id = 3")).digests().count() >= 1


def brute_search(queries, rows, k):
    whole = lambda v: [min(max(math.floor(float(x) * 256), -maxscore.LARGEST), maxscore.LARGEST) for x in v]
    good = [(i, whole(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(whole(v))) for i, v in queries if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}:
        s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:k]
        out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, g int, key string, ids string"


@pytest.mark.parametrize("shard", [4, 1000])
def test_search_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", shard)
    monkeypatch.setattr(maxscore, "QUERY_ROWS", 3)
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.choice([-0.5, 0.25, 1.0, 0.003], 6)]) for i in range(300)]
    rows += [(1000, None), (1050, [0.1, None, 0.2]), (1100, [0.1, math.nan]), (1150, [math.inf] * 6), (1200, []), (1250, [0.5]), (None, [1.0] * 6), (1300, [3e9, -3e9, 1.0]), (1350, [0.25] * 9)]
    rows += [(i, rows[50][1]) for i in range(2000, 2200)] + [rows[50], rows[100], (150, [1.0] * 6)]  # many copies of a query, and repeated rows
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], VECTORS)
    got = maxscore.search(spark, maxscore.every_nth(df), df)
    assert sorted(map(tuple, got.collect())) == brute_search([r for r in rows if r[0] is not None and r[0] % 50 == 0], rows, 5)


def test_search_of_nothing_and_of_few(spark):
    df = spark.createDataFrame([(50, [1.0], 1, "", ""), (51, [2.0], 1, "", "")], VECTORS)
    assert [tuple(r) for r in maxscore.search(spark, maxscore.every_nth(df), df).collect()] == [(50, 1, 51, 256 * 512)]
    for none in (df.limit(0), df.filter("vec_id = 51")):
        assert maxscore.search(spark, maxscore.every_nth(none), none).collect() == []
    assert maxscore.search(spark, maxscore.every_nth(df), df.limit(0)).collect() == []


def test_maxscore_reads_few_values_and_loses_none():
    rng = np.random.default_rng(2)
    m = np.floor(256 * rng.dirichlet([0.05] * 64, 2000)).astype(np.int32)  # few large components each
    shard = maxscore.Shard(np.arange(2000).tobytes(), np.ascontiguousarray(m.T).tobytes(), 64)
    read = 0
    for i in range(50):
        want = sorted((-int(x), j) for j, x in enumerate(m @ m[i].astype(np.int64)) if j != i)[:5]
        ids, scores, n = shard.best(m[i], i, 5, -want[-1][0])
        assert [(-s, j) for j, s in zip(ids.tolist(), scores.tolist())] == want
        assert shard.best(m[i], i, 5, 1 - want[0][0])[0].size == 0
        read += n
    assert read < 0.25 * 50 * m.size


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_maxscore"])
def test_queries_equal_their_sql(spark, name):
    import glob
    import os

    import duckdb

    from textquarry.llm import queries

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}{'/*.parquet' if os.path.isdir(f) else ''}')")
    df = queries.QUERIES[name](spark, sf)
    out = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, out.fetchall()))


def test_search_sends_no_copies_of_the_queries_through_the_driver(spark, monkeypatch):
    """Copies for each group of shards were broadcast, which ended in an error above spark.driver.maxResultSize."""
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 4)
    monkeypatch.setattr(maxscore, "QUERY_ROWS", 3)
    monkeypatch.setattr(maxscore, "PAIRS", 800)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5)], 1, "", "") for i in range(0, 1500, 5)]
    df, sent = spark.createDataFrame(rows, VECTORS), []
    save = maxscore.Scratch.save
    monkeypatch.setattr(maxscore.Scratch, "save", lambda self, df, name="t", *a: (sent.append((name, df._jdf.queryExecution().executedPlan().toString())), save(self, df, name, *a))[1])
    got = maxscore.search(spark, maxscore.every_nth(df), df)
    assert sorted(map(tuple, got.collect())) == brute_search([r[:2] for r in rows if r[0] % 50 == 0], [r[:2] for r in rows], 5)
    assert "Broadcast" not in dict(sent)["met"]


def test_cells_of_a_search_keep_their_size():
    for times in (1, 10, 100):
        across, down = maxscore.grid(50 * times, 100_000 * times, 8 * times, 2_000 * times, 16)
        pairs = 100_000 * times * 2_000 * times / (across * down)
        assert pairs <= maxscore.PAIRS and across <= 50 * times and down <= 8 * times
    assert maxscore.grid(0, 0, 0, 0, 16) == (1, 1)
