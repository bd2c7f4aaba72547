"""The jobs over copies of small tables: twice over the same input, and over input that grows."""

import json
import logging

import pytest
from pyspark.sql import functions as F

from jobs import build_chunks, common, index_upkeep
from textquarry.operators import bm25
from textquarry.streaming import upkeep

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
GROWING = f"{DOCS}, deleted boolean"
WORDS = "water stone river the a hill cloud and rain wind".split()


def text(i, n=60):
    return "".join(WORDS[(i * 7 + k * k) % len(WORDS)] + ("\n" if k % 25 == 24 else " ") for k in range(n))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def rebuilt(spark, docs):
    """Postings and statistics of the documents (doc_id, source, text) as a new index has them."""
    index = bm25.build(spark.createDataFrame(docs, "doc_id long, source string, text string"), "text", "doc_id", "source")
    p = index.postings.select("scope", "doc_id", "term", "tf", "dl")
    return rows_of(p), rows_of(p.groupBy("scope", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")))


def found(spark, path):
    return rows_of(upkeep.load(spark, path).postings), rows_of(upkeep.statistics(spark, path))


def test_chunks_are_the_same_after_a_second_run(spark, tmp_path, caplog):
    docs = [(i, text(i, 900) if i % 3 else None if i == 3 else "", "en", "src a" if i % 2 else "b", 1) for i in range(12)] + [(None, text(1), "en", "b", 1), (40, text(2), None, None, 1)]
    src, out = str(tmp_path / "docs"), str(tmp_path / "out")
    spark.createDataFrame(docs, DOCS).write.parquet(src)
    with caplog.at_level(logging.INFO, "jobs"):
        first = build_chunks.run(spark, src, out)
    tables = {n: rows_of(spark.read.parquet(f"{out}/{n}")) for n in ("chunks", "parents")}
    assert build_chunks.run(spark, src, out, {"child_target": 240}) == first == {"documents": 13, "chunks": len(tables["chunks"]), "parents": len(tables["parents"]), "manifest": 9}
    assert tables == {n: rows_of(spark.read.parquet(f"{out}/{n}")) for n in tables}
    assert {p.name for p in (tmp_path / "out" / "chunks").iterdir() if p.is_dir()} == {"group=src a", "group=b", "group=__HIVE_DEFAULT_PARTITION__"}
    manifest = build_chunks.read_manifest(spark, out)
    assert manifest.agg(F.sum("chunks")).first()[0] == first["chunks"] and all(r.tokens_with_overlap >= r.tokens for r in manifest.collect())
    assert manifest.filter("book_id = 'D1'").first().tokens == 900
    assert "read" in caplog.text and "13 documents" in caplog.text and f"wrote {out}/chunks" in caplog.text
    assert build_chunks.run(spark, src, str(tmp_path / "small"), {"child_target": 50, "child_max": 80, "overlap": 0})["chunks"] > first["chunks"]


def test_chunks_of_other_formats_and_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, text(1, 300), "en", "a", 1)], DOCS)
    df.write.json(str(tmp_path / "json"))
    df.write.option("header", True).csv(str(tmp_path / "csv"))
    df.limit(0).write.parquet(str(tmp_path / "none"))
    out = [build_chunks.run(spark, str(tmp_path / kind), str(tmp_path / f"out-{kind}"), {"format": kind}) for kind in ("json", "csv")]
    assert out[0] == out[1] and out[0]["documents"] == 1
    assert rows_of(spark.read.parquet(str(tmp_path / "out-json/chunks"))) == rows_of(spark.read.parquet(str(tmp_path / "out-csv/chunks")))
    with pytest.raises(ValueError):
        build_chunks.run(spark, str(tmp_path / "json"), str(tmp_path / "x"), {"format": "xml"})


def write(spark, folder, rows):
    spark.createDataFrame(rows, GROWING).coalesce(1).write.mode("append").parquet(folder)


def test_index_follows_input_that_grows(spark, tmp_path):
    src, out = str(tmp_path / "docs"), str(tmp_path / "out")
    write(spark, src, [(i, text(i), "en", f"s{i % 3}", 1, None) for i in range(30)] + [(None, "no id", "en", "s0", 1, None), (30, None, "en", "s1", 1, None)])
    state = {i: (f"s{i % 3}", text(i)) for i in range(30)} | {30: ("s1", None)}
    docs = lambda: [(i, s, t) for i, (s, t) in state.items()]
    assert index_upkeep.run(spark, src, out) == {"batches": 1, "documents": 32, "scopes": 3}
    assert found(spark, out) == rebuilt(spark, docs())
    before = upkeep.table(spark, f"{out}/statistics", upkeep.STATISTICS).filter("scope = 's0'").agg(F.max("upto")).first()[0]
    # a new document, a changed one, one that moves, one that is deleted, one as it was, a deletion of what never was
    write(spark, src, [(100, text(5), "en", "s1", 1, None), (1, "another text", "en", "s1", 1, None), (2, text(2), "en", "s1", 1, False), (4, None, "en", "s1", 1, True), (7, text(7), "en", "s1", 1, None), (999, "x", "en", "s9", 1, True)])
    state |= {100: ("s1", text(5)), 1: ("s1", "another text"), 2: ("s1", text(2))}
    del state[4]
    assert index_upkeep.run(spark, src, out) == {"batches": 1, "documents": 6, "scopes": 2}
    assert found(spark, out) == rebuilt(spark, docs())
    assert sorted(r.doc_id for r in upkeep.versions(spark, out).filter("batch = 1").collect()) == [1, 2, 4, 100]
    # the statistics of a scope that nothing touched are those of the first run
    stats = {r.scope: r.upto for r in upkeep.table(spark, f"{out}/statistics", upkeep.STATISTICS).collect()}
    assert stats == {"s0": before, "s1": 1, "s2": 1}
    assert index_upkeep.run(spark, src, out) == {"batches": 0, "documents": 0, "scopes": 0}
    # a scope that loses all its documents, and a document that comes back
    write(spark, src, [(i, None, "en", None, 1, True) for i, (s, _) in state.items() if s == "s2"] + [(4, "back again", "en", "s1", 1, None)])
    state = {i: x for i, x in state.items() if x[0] != "s2"} | {4: ("s1", "back again")}
    index_upkeep.run(spark, src, out)
    assert found(spark, out) == rebuilt(spark, docs())
    upkeep.compact(spark, out, str(tmp_path / "compact"))
    assert found(spark, str(tmp_path / "compact")) == rebuilt(spark, docs())
    assert upkeep.table(spark, str(tmp_path / "compact/postings"), upkeep.POSTINGS).select("batch").distinct().count() == 1
    upkeep.apply(spark.createDataFrame([(1, "more", "en", "s1", 1, None), (3, text(3), "en", "s0", 1, None)], GROWING), str(tmp_path / "compact"), 9)
    state[1] = ("s1", "more")
    assert rows_of(upkeep.load(spark, str(tmp_path / "compact")).postings) == rebuilt(spark, docs())[0]


@pytest.mark.parametrize("broken", ["versions", "statistics", "marks"])
def test_a_run_that_failed_is_repeated(spark, tmp_path, monkeypatch, broken):
    src, out = str(tmp_path / "docs"), str(tmp_path / "out")
    write(spark, src, [(i, text(i), "en", "s", 1, None) for i in range(8)])
    index_upkeep.run(spark, src, out)
    write(spark, src, [(1, "new text", "en", "s", 1, None), (50, "new too", "en", "t", 1, None)])
    with monkeypatch.context() as m:
        if broken == "marks":
            m.setattr(upkeep, "refresh_statistics", lambda *_: 1 / 0)
        else:
            real = upkeep._write
            m.setattr(upkeep, "_write", lambda rows, path, *by: 1 / 0 if path.endswith(broken) else real(rows, path, *by))
        with pytest.raises(Exception):
            index_upkeep.run(spark, src, out)
    index_upkeep.run(spark, src, out)
    state = {i: text(i) for i in range(8)} | {1: "new text", 50: "new too"}
    assert found(spark, out) == rebuilt(spark, [(i, "t" if i == 50 else "s", t) for i, t in state.items()])


def test_rows_of_one_id_in_a_batch(spark, tmp_path):
    rows = [(1, "older", "en", "s", 1, 5), (1, "newer text", "en", "s", 1, 6), (2, "same", "en", "s", 1, 1), (2, "same", "en", "s", 1, 1)]
    upkeep.apply(spark.createDataFrame(rows, f"{DOCS}, v int"), str(tmp_path), 0, version="v")
    assert found(spark, str(tmp_path))[0] == rebuilt(spark, [(1, "s", "newer text"), (2, "s", "same")])[0]
    upkeep.apply(spark.createDataFrame([], f"{DOCS}, v int"), str(tmp_path), 1)
    assert upkeep.refresh_statistics(spark, str(tmp_path)) == 1 and upkeep.refresh_statistics(spark, str(tmp_path)) == 0


def test_config_files(spark, tmp_path):
    for job in (build_chunks, index_upkeep):
        assert common.read_config(spark, f"jobs/{job.__name__.split('.')[-1]}.json", {k: None for k in job.DEFAULTS}) == job.DEFAULTS
    (tmp_path / "c.json").write_text(json.dumps({"overlap": 3}))
    assert common.read_config(spark, str(tmp_path / "c.json"), build_chunks.DEFAULTS)["overlap"] == 3
    (tmp_path / "c.json").write_text(json.dumps({"overlaps": 3}))
    with pytest.raises(ValueError, match="overlaps"):
        common.read_config(spark, str(tmp_path / "c.json"), build_chunks.DEFAULTS)


def test_postings_stay_where_they_are(spark, tmp_path):
    """Where the planner broadcasts nothing by itself, as of large tables, nothing or little that is out of date doesn't sort all postings."""
    path, kept = str(tmp_path / "out"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for number, changed in enumerate(([], [3, 4])):
            rows = [(i, text(i + (i in changed)), "en", "s", 1) for i in range(8)] + [(3, "older", "en", "s", 0)] * number
            upkeep.apply(spark.createDataFrame(rows, DOCS), path, number, version="n_chars")
            postings = upkeep.load(spark, path).postings
            assert "SortMergeJoin" not in postings._jdf.queryExecution().toString()
            assert rows_of(postings) == rebuilt(spark, [(i, "s", t) for i, t, *_ in rows[:8]])[0]
        assert sorted(r.doc_id for r in upkeep.versions(spark, path).filter("batch = 1").collect()) == [3, 4]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_files_without_rows(spark, tmp_path):
    src, out = str(tmp_path / "docs"), str(tmp_path / "out")
    write(spark, src, [])
    assert index_upkeep.run(spark, src, out)["documents"] == 0
    write(spark, src, [(1, "a text", "en", "s", 1, None), (2, None, "en", "s", 1, True)])
    assert index_upkeep.run(spark, src, out) == {"batches": 1, "documents": 2, "scopes": 1}
    assert found(spark, out) == rebuilt(spark, [(1, "s", "a text")])
