import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textquarry.functions import text
from textquarry.operators import bm25, dense, fusion, impacts
from textquarry.plans.engine import RetrievalEngine, RetrievalOptions, engine_over_chunks

DOC = "doc_id string, text string, scope string"


def test_matching_document_first(spark):
    d = spark.createDataFrame([("water", "پیوند هیدروژنی میان مولکول های آب", "a"), ("atom", "عدد اتمی و جدول دوره ای عنصرها", "a")], DOC)
    q = spark.createDataFrame([(1, "پیوند هیدروژنی آب")], "qid int, text string")
    assert [r.doc_id for r in bm25.search(bm25.build(d), q).collect()] == ["water"]


def test_scope_has_its_own_statistics(spark):
    rng = random.Random(1)
    rows = [(f"d{i:02}", " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(0, 12))), "xy"[i % 2]) for i in range(30)]
    index = bm25.build(spark.createDataFrame(rows, DOC), scope="scope")
    got = {r.doc_id: r for r in bm25.search(index, spark.createDataFrame([(1, "a b a zz", "x")], "qid int, text string, scope string"), 50, True).collect()}
    docs = {i: t.split() for i, t, s in rows if s == "x"}
    avg, want = sum(map(len, docs.values())) / len(docs), {}
    for term, n in Counter(["a", "b", "a", "zz"]).items():
        df = sum(term in t for t in docs.values())
        for i, t in docs.items():
            if tf := t.count(term):
                w = n * math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avg))
                want[i] = want.get(i, 0) + w
    assert {i: r.score for i, r in got.items()} == pytest.approx(want, abs=1e-6)
    assert [i for i, _ in sorted(want.items(), key=lambda x: (-round(x[1], 9), x[0]))] == sorted(got, key=lambda i: got[i].rank)


def test_empty_index_and_save(spark, tmp_path):
    none = bm25.build(spark.createDataFrame([], DOC), scope="scope")
    q = spark.createDataFrame([(1, "a", "x")], "qid int, text string, scope string")
    assert bm25.search(none, q).count() == 0 and bm25.search(none, q, scoped=True).count() == 0
    index = bm25.build(spark.createDataFrame([("a", "x y x", "s"), ("b", "", "s")], DOC), scope="scope")
    index.save(str(tmp_path / "i"))
    back = bm25.BM25Index.load(spark, str(tmp_path / "i"))
    assert {tuple(r) for r in back.postings.collect()} == {tuple(r) for r in index.postings.collect()} and back.doc_stats.count() == 2


class Counting:
    """Counts three things in a text; notes its calls in a file, as it runs in other processes."""

    model = "counting"

    def __init__(self, log):
        self.log = str(log)

    def embed(self, texts):
        with open(self.log, "a") as f:
            f.write(f"{len(texts)}\n")
        return [[float(t.count("آب")), float(t.count("اتم")), 1.0] for t in texts]


def test_embedding_cache_and_stale_index(spark, tmp_path):
    p, cache = Counting(tmp_path / "calls"), str(tmp_path / "cache")
    d = spark.createDataFrame([("water", "آب آب مولکول", "a"), ("atom", "اتم عنصر", "b"), ("copy", "اتم عنصر", "b")], DOC)
    index = dense.build(d, p, cache, "counting", scope="scope", batch_size=1)
    calls = (tmp_path / "calls").read_text()
    assert calls.split() == ["1", "1"]
    dense.build(d, p, cache, batch_size=1).vectors.count()
    assert (tmp_path / "calls").read_text() == calls
    dense.validate(index, d)
    with pytest.raises(ValueError):
        dense.validate(index, d.withColumn("text", F.concat("text", F.lit("!"))))
    with pytest.raises(ValueError):
        dense.build(d, p, cache, "another model")
    q = spark.createDataFrame([(1, [2.0, 0.0, 1.0], "b")], "qid int, vector array<double>, scope string")
    assert [r.doc_id for r in dense.search(index, q, 1).collect()] == ["water"]
    assert [r.doc_id for r in sorted(dense.search(index, q, 5, scoped=True).collect(), key=lambda r: r.rank)] == ["atom", "copy"]
    with pytest.raises(ValueError):
        dense.search(index, q.withColumn("vector", F.array(F.lit(1.0))), 1).count()
    index.save(str(tmp_path / "dense"))
    assert dense.DenseIndex.load(spark, str(tmp_path / "dense")).model == "counting"


def test_search_among_allowed_documents(spark):
    d = spark.createDataFrame([("a", "water stone", "x"), ("b", "water water fire", "x"), ("c", "fire", "y"), ("d", "water", "y")], "doc_id string, text string, scope string")
    q = spark.createDataFrame([(1, "water", "x")], "qid int, text string, scope string")
    some = spark.createDataFrame([("a",), ("c",), ("a",), ("gone",)], "doc_id string")
    got = {r.doc_id: r.score for r in bm25.search(bm25.build(d, scope="scope"), q, allowed=some).collect()}
    alone = {r.doc_id: r.score for r in bm25.search(bm25.build(d.filter("doc_id in ('a', 'c')"), scope="scope"), q).collect()}
    assert got == alone and set(got) == {"a"}
    assert bm25.search(bm25.build(d, scope="scope"), q, scoped=True, allowed=some.filter("doc_id = 'c'")).count() == 0
    v = dense.from_vectors(spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "d int, v array<double>"), "d", "v")
    near = spark.createDataFrame([(1, [1.0, 0.0])], "qid int, vector array<double>")
    few = spark.createDataFrame([(3,), (4,)], "doc_id int")
    assert [r.doc_id for r in dense.search(v, near, 5, allowed=few).orderBy("rank").collect()] == [3, 4]


def test_large_batches_of_queries_are_cut(spark, monkeypatch):
    v = dense.from_vectors(spark.createDataFrame([(i, [1.0, float(i)]) for i in range(7)], "d int, v array<double>"), "d", "v")
    near = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(11)], "qid int, vector array<double>")
    whole = sorted(map(tuple, dense.search(v, near, 3).collect()))
    monkeypatch.setattr(dense, "BATCH", 4)
    assert sorted(map(tuple, dense.search(v, near, 3).collect())) == whole and len(whole) == 33


class Failing:
    model = "failing"

    def embed(self, texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("provider is down")
        return [[float(len(t)), 1.0] for t in texts]


def test_rounds_do_not_grow_with_the_texts(spark, tmp_path, monkeypatch):
    """Each text is read by one round only, and there are at most so many rounds."""
    asked, embed = [], dense.embed_missing

    def counted(missing, provider, batch_size):
        asked.append(sorted(r["text"] for r in missing.collect()))
        return embed(missing, provider, batch_size)

    class Sizes:
        model = "sizes"

        def embed(self, texts):
            return [[1.0, float(len(t))] for t in texts]

    monkeypatch.setattr(dense, "embed_missing", counted)
    monkeypatch.setattr(dense, "ROUNDS", 4)
    d = spark.createDataFrame([(i, "x" * (i + 1)) for i in range(40)], "doc_id long, text string")
    index = dense.build(d, Sizes(), str(tmp_path / "cache"), round_texts=2)
    assert len(asked) <= 4 and sorted(t for part in asked for t in part) == sorted("x" * (i + 1) for i in range(40))
    assert index.vectors.count() == 40


def test_paid_embeddings_survive_a_failure(spark, tmp_path):
    cache = str(tmp_path / "cache")
    d = spark.createDataFrame([(i, "bad" if i == 7 else f"text {i}") for i in range(12)], "doc_id int, text string")
    with pytest.raises(Exception):
        dense.build(d, Failing(), cache, batch_size=1, round_texts=1)
    held = dense.load_cache(spark, cache).count()
    assert 0 <= held < 12
    again = dense.build(d.filter("doc_id <> 7"), Failing(), cache, batch_size=1, round_texts=3)
    assert again.vectors.count() == 11 and dense.load_cache(spark, cache).count() == 11


def greedy(c, k, penalty):
    left, out = sorted(c, key=lambda x: (-x[1], x[0])), []
    while left and len(out) < k:
        def value(x):
            return x[1] - penalty * max((len(set(x[2]) & set(o[2])) / len(set(x[2]) | set(o[2])) if set(x[2]) | set(o[2]) else 0 for o, _ in out), default=0)

        best = max(left, key=lambda x: round(value(x), 12))
        out.append((best, value(best)))
        left.remove(best)
    return [(x[0], pytest.approx(v, abs=1e-8)) for x, v in out]


def test_diversity_equals_a_plain_greedy_loop(spark):
    rng = random.Random(4)
    sets = {q: [(f"d{i:02}", rng.choice([0.2, 0.5, 0.9, rng.random()]), rng.sample("abcdefgh", rng.randrange(0, 6))) for i in range(12)] for q in range(15)}
    df = spark.createDataFrame([(q, *x) for q, c in sets.items() for x in c], "qid int, doc_id string, base double, terms array<string>")
    got = {}
    for r in sorted(fusion.diversify(df, 5).collect(), key=lambda r: (r.qid, r.rank)):
        got.setdefault(r.qid, []).append((r.doc_id, r.diversified))
    assert got == {q: greedy(c, 5, 0.12) for q, c in sets.items()}
    for rows in got.values():
        assert [s for _, s in rows] == sorted((s for _, s in rows), reverse=True)


CHUNK = (
    "chunk_id string, parent_id string, book_id string, book_title string, source_file string, chapter_id string, chapter_title string, "
    "section_heading string, pdf_pages array<int>, book_pages array<int>, content_type string, text string, search_text string, token_count int"
)
PARENT = "parent_id string, book_id string, book_title string, source_file string, chapter_title string, pdf_pages array<int>, book_pages array<int>, text string"


@pytest.fixture(scope="module")
def engine(spark):
    chunk = lambda c, p, b, page, t: (c, p, b, b.title(), f"{b}.pdf", "ch", "Chapter", None, [page], [page], "prose", t, t, 3)
    chunks = spark.createDataFrame([chunk("c1", "p1", "water-book", 10, "پیوند آب مولکول"), chunk("c2", "p2", "atom-book", 20, "اتم عنصر آب")], CHUNK)
    parents = spark.createDataFrame([(p, b, b.title(), f"{b}.pdf", "Chapter", [n], [n], f"{p} text") for p, b, n in (("p1", "water-book", 10), ("p2", "atom-book", 20))], PARENT)
    vectors = dense.from_vectors(spark.createDataFrame([("c1", [1.0, 0.0], "water-book"), ("c2", [0.0, 1.0], "atom-book")], "d string, v array<double>, s string"), "d", "v", "s", "m")
    return engine_over_chunks(chunks, parents, vectors)


def ask(spark, text="پیوند آب", scope="water-book"):
    return spark.createDataFrame([(1, text, [1.0, 0.0], scope)], "qid int, text string, vector array<double>, scope string")


def test_hybrid_response(spark, engine):
    r = engine.responses(ask(spark)).first()["response"]
    assert r["schema_version"] == "1.1" and r["retrieval"]["embedding_model"] == "m" and r["retrieval"]["available_books"] == ["atom-book", "water-book"]
    assert [x["chunk_id"] for x in r["results"]] == ["c1", "c2"] and r["results"][0]["source"]["document_id"] == "water-book"
    assert r["llm_context"]["passages"][0]["citation_id"] == "water-book:p1" and r["query"]["normalized"] == "پیوند اب".replace("ا", "آ")
    s = r["results"][0]["scores"]
    assert s["rerank"] == pytest.approx(0.36 + 0.32 + 0.22 + 0.10) and s["rrf"] == pytest.approx(2 / 61, abs=1e-8)


def test_scope_and_modes(spark, engine):
    only = engine.responses(ask(spark, scope="atom-book"), RetrievalOptions(mode="bm25"), scoped=True).first()["response"]
    assert [x["chunk_id"] for x in only["results"]] == ["c2"] and only["retrieval"]["book_id"] == "atom-book"
    none = engine.responses(ask(spark, "هیچ"), RetrievalOptions(mode="bm25")).first()["response"]
    assert none["results"] == [] and none["llm_context"]["passages"] == []
    lexical = RetrievalEngine(engine.index, engine.chunks, engine.parents)
    assert lexical.retrieve(ask(spark), RetrievalOptions(mode="bm25")).count() == 2
    for bad in (lambda: lexical.retrieve(ask(spark)), lambda: engine.retrieve(ask(spark), RetrievalOptions(mode="x")),
                lambda: engine.retrieve(ask(spark).drop("vector")), lambda: engine.check(RetrievalOptions(), ask(spark), "no-book")):
        with pytest.raises(ValueError):
            bad()


def test_a_missing_parent_is_an_error(spark, engine):
    from dataclasses import replace

    found = engine.retrieve(spark.createDataFrame([(1, "آب")], "qid int, text string"), RetrievalOptions(mode="bm25"))
    assert engine.context(found).count() == 2
    with pytest.raises(Exception, match="no parent row for p2"):
        replace(engine, parents=engine.parents.filter("parent_id <> 'p2'")).context(found).collect()


def test_presentation_forms_are_found(spark):
    d = spark.createDataFrame([(1, "ﺳﻼم"), (2, "ﬁne １２")], "doc_id int, text string")
    q = spark.createDataFrame([(1, "سلام"), (2, "fine 12")], "qid int, text string")
    assert sorted((r.qid, r.doc_id) for r in bm25.search(bm25.build(d), q).collect()) == [(1, 1), (2, 2)]


def test_search_by_impact_reads_few_postings(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(impacts, "BLOCK", 8)
    rng = np.random.default_rng(4)
    word = lambda n: [f"w{min(int(x), 3000)}" for x in rng.zipf(1.25, n)]
    texts = [" ".join(word(int(rng.integers(1, 60)))) for _ in range(800)]
    texts += texts[:30] + ["", None]
    docs = spark.createDataFrame([(i, t, f"s{i % 2}") for i, t in enumerate(texts)], "doc_id long, text string, scope string")
    asked = [(q, texts[q * 7], f"s{q % 2}") for q in range(40)] + [(100, "w1 w1 w2", "s0"), (101, "nowhere", "s1"), (102, None, "s0"), (103, "w2999 w1", "s9")]
    questions = spark.createDataFrame(asked, "qid long, text string, scope string")
    index = bm25.from_terms(bm25.doc_terms(docs, scope="scope"), keep=True)
    for scoped in (False, True):
        by_impact = impacts.build(index, scoped)
        want = sorted(map(tuple, bm25.search(index, questions, 10, scoped).collect()))
        assert sorted(map(tuple, impacts.search(by_impact, questions, 10).collect())) == want
    by_impact = impacts.build(index)
    plan = impacts.plan(by_impact, questions, 10)
    whole = impacts.postings_read(by_impact, plan.withColumn("essential", F.lit(True)).withColumn("need", F.lit(0.0)))
    assert impacts.postings_read(by_impact, plan) < 0.5 * whole
    assert by_impact.blocks.agg(F.max(F.size("entries"))).first()[0] < 200  # w1 is in most documents


def test_stored_statistics_and_counted_ones_agree(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"a b{i % 3} c{i}", f"s{i % 2}") for i in range(12)], "doc_id long, text string, scope string")
    q = spark.createDataFrame([(1, "a b1", "s0"), (2, "b2 c3", "s1")], "qid long, text string, scope string")
    plain, kept = bm25.build(docs, scope="scope"), bm25.from_terms(bm25.doc_terms(docs, scope="scope"), keep=True)
    plain.save(str(tmp_path / "i"))
    assert plain.term_stats is None and kept.term_stats is not None
    for scoped in (False, True):
        want = sorted(map(tuple, bm25.search(plain, q, 5, scoped).collect()))
        for other in (kept, bm25.BM25Index.load(spark, str(tmp_path / "i"))):
            assert sorted(map(tuple, bm25.search(other, q, 5, scoped).collect())) == want


def test_dense_search_with_ties_over_many_tasks(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5).tolist(), f"s{i % 3}") for i in range(300)]
    rows += [(1000 + i, rows[7][1], f"s{i % 3}") for i in range(100)] + [(None, rows[7][1], "s0"), (2001, rows[3][1], None)]
    df = spark.createDataFrame(rows, "d long, v array<double>, s string").repartition(7)
    asked = [(q, rows[q][1], rows[q][2]) for q in range(0, 40)] + [(50, rows[7][1], None)]
    index = dense.from_vectors(df, "d", "v", "s")
    queries = spark.createDataFrame(asked, "qid long, vector array<double>, scope string")
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    for scoped in (False, True):
        want = []
        for q, v, s in asked:
            near = sorted((-round(float(unit(v) @ unit(w)), 9), i) for i, w, t in rows if i is not None and w is not None and (not scoped or s is not None and s == t))
            want += [(q, n + 1, i) for n, (_, i) in enumerate(near[:12])]
        assert sorted((r.qid, r["rank"], r.doc_id) for r in dense.search(index, queries, 12, scoped).collect()) == sorted(want)


def test_unchanged_corpus_is_told_by_digests(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(500)], "doc_id long, text string")
    index = dense.DenseIndex("m", docs.select("doc_id", text.fingerprint(F.col("text")).alias("fingerprint")))
    index.save(str(tmp_path / "d"))
    back = dense.DenseIndex.load(spark, str(tmp_path / "d"))
    now = dense.bucket_digests(docs.select("doc_id", text.fingerprint(F.col("text")).alias("fingerprint")).repartition(7))
    assert dense.differing(now, back.digests) == []
    # while nothing has changed, the vectors are not read
    back.vectors = back.vectors.withColumn("fingerprint", F.raise_error(F.lit("read")).cast("string"))
    assert dense.stale(back, docs).collect() == []
    back = dense.DenseIndex.load(spark, str(tmp_path / "d"))
    other = docs.filter("doc_id <> 3").withColumn("text", F.when(F.col("doc_id") == 4, "new").otherwise(F.col("text"))).unionByName(docs.filter("doc_id = 5").withColumn("doc_id", F.lit(900).cast("long")))
    assert sorted(map(tuple, dense.stale(back, other).collect())) == [(3, "removed"), (4, "changed"), (900, "added")]


def test_pairs_of_questions_and_documents_are_never_rows(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(8)
    word = lambda n: " ".join(f"w{min(int(x), 400)}" for x in rng.zipf(1.3, n))
    texts = [word(int(rng.integers(1, 50))) for _ in range(300)]
    rows = [(f"d{i}", texts[i % 250], f"s{i % 3}") for i in range(300)] + [(None, texts[0], "s0"), ("none", None, "s1"), ("two", "w1 w2", "s0"), ("two", "w2", "s1")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, scope string")
    asked = spark.createDataFrame([(f"q{i}", texts[i * 5], f"s{i % 3}") for i in range(40)] + [("none", "nowhere", "s0"), (None, "w1 w1 w9", "s1")], "qid string, text string, scope string")
    for scoped in (False, True):
        by = (lambda s: s) if scoped else (lambda s: None)
        held = {}
        for d, t, s in rows:
            for w in (t or "").split():
                held.setdefault((by(s), w), {}).setdefault((s, d), [0, len(t.split())])[0] += 1
        sizes = {}
        for _, t, s in rows:
            sizes.setdefault(by(s), []).append(len((t or "").split()))
        want = []
        for q, t, s in asked.collect():
            mean, got = np.mean(sizes[by(s)]), {}
            for w in t.split():
                docs_of = held.get((by(s), w), {})
                for (_, d), (tf, dl) in docs_of.items():
                    part = np.log(1 + (len(sizes[by(s)]) - len(docs_of) + 0.5) / (len(docs_of) + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))
                    got[d] = got.get(d, 0.0) + part
            best = sorted(got.items(), key=lambda x: (-round(x[1], 9), x[0] is not None, x[0] or ""))[:7]
            want += [(q, n + 1, d, round(round(float(x), 6), 5)) for n, (d, x) in enumerate(best)]
        key = lambda x: (x[0] or "", x[1])
        for batch, shard, spread in ((bm25.BATCH, bm25.SHARD, bm25.SPREAD), (200, 300, 100)):  # at once; in rounds of questions and parts of documents
            for name, value in (("BATCH", batch), ("SHARD", shard), ("SPREAD", spread)):
                monkeypatch.setattr(bm25, name, value)
            index = bm25.from_terms(bm25.doc_terms(docs, scope="scope"), keep=True)
            found = bm25.search(index, asked, 7, scoped)
            assert sorted([(r.qid, r["rank"], r.doc_id, round(r.score, 5)) for r in found.collect()], key=key) == sorted(want, key=key)
            if shard > 300:  # few rows a task and question
                assert bm25.scores(index, asked, scoped, 7).groupBy("qid").count().filter(F.col("count") > 7 * spark.sparkContext.defaultParallelism).count() == 0


def test_impact_candidates_are_completed_once_a_document(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b{i % 3} c{i % 7} d{i}", f"s{i % 2}") for i in range(60)], "doc_id long, text string, scope string")
    q = spark.createDataFrame([(n, f"a a b{n % 3} c{n % 7}", f"s{n % 2}") for n in range(30)], "qid long, text string, scope string")
    index, seen, plain = bm25.from_terms(bm25.doc_terms(docs, scope="scope"), keep=True), [], impacts.best_of

    def spy(held, weights, k):
        seen.append(held)
        return plain(held, weights, k)

    monkeypatch.setattr(impacts, "best_of", spy)
    for scoped in (False, True):
        want = sorted(map(tuple, bm25.search(index, q, 4, scoped).collect()))
        assert sorted(map(tuple, impacts.search(impacts.build(index, scoped), q, 4).collect())) == want
        assert seen[-1].count() == seen[-1].select("doc_id").distinct().count() <= 60


def test_tasks_of_the_index_follow_the_tokens(spark, monkeypatch):
    """A larger corpus is counted by more tasks, not by larger ones, though files and shuffle partitions stay as many."""
    monkeypatch.setattr(bm25, "TOKENS", 200)
    for n in (400, 1600):
        docs = spark.range(n).coalesce(2).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 10), i -> concat('w', id % 7, 'x', i * (id + 1)))) as text")
        index = bm25.build(docs, "text", "doc_id")
        kept = bm25.from_terms(bm25.doc_terms(docs, "text", "doc_id"), keep=True)
        sizes = [r["n"] for r in kept.postings.groupBy(F.col("_metadata.file_path")).agg(F.sum("tf").alias("n")).collect()]
        assert sum(sizes) == 10 * n and len(sizes) >= 10 * n // 200 * 0.9
        assert max(sizes) <= 2 * bm25.TOKENS
        assert not kept.postings.exceptAll(index.postings).count() and kept.postings.count() == index.postings.count()


def test_an_index_for_its_queries_gives_the_same_results(spark):
    rows = [(i, " ".join(f"w{(i * k) % 11}" for k in range(1, 9)), "ab"[i % 2]) for i in range(60)] + [(99, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, scope string")
    q = spark.createDataFrame([(1, "w1 w2 w2", "a"), (2, "w7 nowhere", "b"), (3, "", "a")], "qid long, text string, scope string")
    own = bm25.for_queries(bm25.doc_terms(docs, scope="scope"), q)
    assert {r.term for r in own.postings.select("term").distinct().collect()} == {"w1", "w2", "w7"}
    for scoped in (False, True):
        want = bm25.search(bm25.build(docs, scope="scope"), q, 5, scoped)
        assert sorted(map(tuple, bm25.search(own, q, 5, scoped).collect())) == sorted(map(tuple, want.collect()))
