import random
import time

import pytest
from pyspark.sql import functions as F

from textquarry.operators import bm25, chunking, evaluate, reports
from textquarry.plans.engine import engine_over_chunks

PAGE = "book_id string, pdf_page int, book_page int, chapter_id string, chapter_title string, section_heading string, book_title string, source_file string, display_text string"


def page(text, n=1, chapter="c", book="C110210", heading=None):
    return (book, n, n, chapter, chapter, heading, book, f"{book}.pdf", text)


def test_children_stay_below_the_maximum(spark):
    par, chi = chunking.build_chunks(spark.createDataFrame([page(" ".join(["مولکول آب و پیوند هیدروژنی"] * 70))], PAGE))
    rows = chi.orderBy("chunk_id").collect()
    assert rows and all(r.token_count <= 320 and r.chunk_id.startswith("C110210:") for r in rows)
    assert sum(r.token_count for r in par.collect()) == 350


def plain_pack(sizes, target, most):
    out, size, g = [], 0, 0
    for x in sizes:
        if out and ((size >= target and size + x > target) or size + x > most):
            g, size = g + 1, 0
        out.append(g)
        size += x
    return out


@pytest.mark.parametrize("sizes", [[100, 100, 100, 50, 300, 10], [400], [240, 1, 320, 321, 5], list(range(1, 60))])
def test_packing_fold(spark, sizes):
    got = spark.createDataFrame([(sizes,)], "s array<int>").select(chunking.pack(F.col("s"), 240, 320)).first()[0]
    assert got == plain_pack(sizes, 240, 320)


@pytest.mark.parametrize("block", [1, 7, 64, 4096])
def test_blocks_of_a_book_fold_as_the_whole_book_does(spark, block):
    rng = random.Random(block)
    books = {b: [rng.choice([2, 9, 40, 260, 700, 1200]) for _ in range(n)] for b, n in (("a", 1), ("b", 300), ("c", 64), ("d", 65))}
    chapter = {b: [i // 23 % 3 for i in range(len(x))] for b, x in books.items()}
    rows = [(b, i + 1, x, [None, "x", "y"][chapter[b][i]], "t") for b, v in books.items() for i, x in enumerate(v)]
    segs = spark.createDataFrame(rows, "book_id string, seg int, tokens int, chapter_id string, text string")
    got = chunking.with_children(chunking.with_parents(segs, 700, 950, block), 240, 320, 40, block).orderBy("book_id", "seg").collect()
    for b, sizes in books.items():
        runs, parents, kids, k = [], [], [], 0
        for i, x in enumerate(sizes):
            if not i or chapter[b][i] != chapter[b][i - 1]:
                runs.append([])
            runs[-1].append(x)
        for run in runs:
            first = (parents[-1] + 1) if parents else 1
            parents += [first + g for g in plain_pack(run, 700, 950)]
        for p in sorted(set(parents)):
            own = [x for x, q in zip(sizes, parents) if q == p]
            groups = plain_pack(own, 240, 320)
            for i, (x, g) in enumerate(zip(own, groups)):
                rest = sum(y for y, h in zip(own[i:], groups[i:]) if h == g)
                kids.append((p, g, k + g + 1, rest <= 40 and g < groups[-1]))
            k += groups[-1] + 1
        assert [(r.parent_no, r.child_group, r.child_no, r.repeats) for r in got if r.book_id == b] == kids


def test_a_book_of_a_million_segments_is_many_tasks(spark):
    n = 1_000_000
    segs = spark.range(n).select(F.lit("b").alias("book_id"), (F.col("id") + 1).cast("int").alias("seg"), (2 + F.pmod(F.xxhash64("id"), F.lit(90))).cast("int").alias("tokens"), F.lit(False).alias("forced"))
    began = time.time()
    out = chunking.folded(segs, 240, 320)
    got = out.agg(F.max("number").alias("groups"), F.count("*").alias("n")).first()
    assert got.n == n and time.time() - began < 60
    size = groups = 0
    for x in (r.tokens for r in segs.select("tokens").collect()):
        opens = not groups or (size >= 240 and size + x > 240) or size + x > 320
        size, groups = (x, groups + 1) if opens else (size + x, groups)
    assert got.groups == groups


def test_chapters_part_and_overlap_stays_in_parent(spark):
    lines = [" ".join([f"w{i}x{k}" for k in range(30)]) for i in range(40)]
    rows = [page("\n".join(lines[:20]), 1, "one", heading="H1"), page("\n".join(lines[20:]), 2, "two")]
    segs = chunking.page_segments(spark.createDataFrame(rows, PAGE))
    grouped = chunking.with_children(chunking.with_parents(segs))
    chapters = grouped.groupBy("parent_no").agg(F.count_distinct("chapter_id").alias("n")).collect()
    assert len(chapters) == 2 and all(r.n == 1 for r in chapters)
    assert segs.count() == grouped.select("seg").distinct().count() == 40
    tails = chunking.overlap_tails(grouped).collect()
    assert tails and all(r.child_group > 0 and r.tokens <= 40 for r in tails)
    kids = chunking.children(grouped).orderBy("chunk_id").collect()
    assert kids[0].section_heading == "H1" and kids[0].pdf_pages == [1] and kids[-1].section_heading is None
    assert kids[1].text.split("\n")[0] == kids[0].text.split("\n")[-1]


def test_long_paragraph_falls_apart(spark):
    words = spark.createDataFrame([(1, " ".join(["word"] * 600)), (2, "A b c. " * 150), (3, "short")], "k int, text string")
    got = chunking.split_long_paragraphs(words, ["k"], "text").orderBy("k", "piece").collect()
    assert [len(r.text.split()) for r in got if r.k == 1] == [260, 260, 80]
    assert all(r.text.endswith(".") for r in got if r.k == 2) and [r.text for r in got if r.k == 3] == ["short"]


def test_metrics_of_rank_histograms(spark):
    # histograms of first relevant ranks with known metrics
    ranks = [1] * 53 + [2] * 5 + [3] * 4 + [4] * 3 + [6, 7, 9]
    df = spark.createDataFrame([(i, "b", r) for i, r in enumerate(ranks)], "qid int, scope string, rank int")
    m = evaluate.metrics(df).filter("whole").first()
    assert (m.recall_at_1, m.recall_at_3, m.recall_at_5, m.recall_at_10, m.mrr_at_10, m.question_count) == (0.7794, 0.9118, 0.9559, 1.0, 0.853, 68)
    assert evaluate.metrics(df.filter("qid < 0").withColumn("rank", F.lit(None).cast("int"))).count() <= 1


def test_pages_are_relevant_in_their_own_book(spark):
    docs = spark.createDataFrame([("a1", "آب", "book-a", [9]), ("b1", "آب", "book-b", [10])], "doc_id string, text string, scope string, pdf_pages array<int>")
    q = spark.createDataFrame([(1, "آب", "book-a", [10]), (2, "آب", "book-b", [10])], "qid int, text string, scope string, relevant_pages array<int>")
    found = bm25.search(bm25.build(docs, scope="scope"), q, 10, True).join(docs.select("doc_id", "pdf_pages"), "doc_id")
    ranks = evaluate.first_relevant(found, q)
    assert {r.scope: r.rank for r in ranks.collect()} == {"book-a": None, "book-b": 1}
    m = {r.scope: r.recall_at_1 for r in evaluate.metrics(ranks).collect()}
    assert m == {"book-a": 0.0, "book-b": 1.0, None: 0.5}
    with pytest.raises(ValueError):
        evaluate.check_scopes(q, spark.createDataFrame([("book-a",)], "scope string"))


def test_benchmark_recommends_a_run(spark):
    pages = spark.createDataFrame([page("آب دارای پیوند هیدروژنی است. " * 30, 10, book="b")], PAGE)
    q = spark.createDataFrame([(1, "پیوند آب", "b", [10])], "qid int, text string, scope string, relevant_pages array<int>")

    def run_one(model, par, chi):
        e = engine_over_chunks(chi, par)
        found = bm25.search(e.index, q, 10, True).join(e.chunks.select("doc_id", "pdf_pages"), "doc_id")
        return evaluate.metrics(evaluate.first_relevant(found, q)).filter("whole").drop("scope", "whole")

    runs = evaluate.benchmark(pages, [50, 80], ["m"], run_one, lambda p, t: chunking.build_chunks(p, child_target=t)).collect()
    assert len(runs) == 2 and runs[0].recall_at_1 == 1.0 and runs[0].median_chunk_tokens <= runs[1].median_chunk_tokens


def test_sample_and_manifest(spark):
    pages = spark.createDataFrame([("a", i) for i in range(20)] + [("b", i) for i in range(4)], "book_id string, n int")
    got = sorted((r.book_id, r.n) for r in reports.sample_pages(pages, "book_id", "n").collect())
    assert got == [("a", 0), ("a", 5), ("a", 10), ("a", 15), ("a", 19)] + [("b", i) for i in range(4)]
    m = {r.book_id: tuple(r)[1:] for r in reports.manifest(pages, pages.filter("n < 2"), pages.filter("false")).collect()}
    assert m == {"a": (20, 2, 0), "b": (4, 2, 0)}


def test_medians_of_groups_of_any_size(spark):
    rng = random.Random(2)
    groups = {"a": [rng.randrange(10**9) for _ in range(5000)], "b": [7] * 3000 + [1, 9], "c": [5], None: [3, 1, 2, 8], "d": [rng.gauss(0, 1e-3) for _ in range(999)] + [1e12]}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v] + [("a", None), ("e", None)], "g string, x double")
    want = {g: sorted(map(float, v))[len(v) // 2] for g, v in groups.items()}
    for few in (1, 50, 10_000):
        assert {r.g: r["median"] for r in evaluate.upper_medians(df, ["g"], "x", bins=16, few=few).collect()} == want
    whole = df.filter("x is not null").select(F.col("x").cast("long").alias("x"))
    assert evaluate.upper_medians(whole, [], "x", "m", few=100).collect() == [(sorted(int(x) for v in groups.values() for x in v)[whole.count() // 2],)]
    assert evaluate.upper_medians(df.limit(0), ["g"], "x").collect() == []


def test_a_benchmark_makes_the_chunks_of_a_size_once(spark):
    """Sizes, medians, the index and the results each made them again."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(x):
        made.add(1)
        return x

    pages = spark.range(9).select(F.col("id").cast("int").alias("token_count"))
    one = spark.createDataFrame([(1.0, 1.0)], "recall_at_5 double, mrr_at_10 double")
    runs = evaluate.benchmark(pages, [1, 2], ["m", "n"], lambda m, par, chi: one, lambda p, t: (None, p.select((counted("token_count") * t).alias("token_count")))).collect()
    assert sorted((r.model, r.child_target, r.run, r.chunk_count, r.median_chunk_tokens, r.max_chunk_tokens) for r in runs) == [
        ("m", 1, 0, 9, 4, 8), ("m", 2, 1, 9, 8, 16), ("n", 1, 2, 9, 4, 8), ("n", 2, 3, 9, 8, 16)]
    assert made.value == 18
