"""The pipeline's stages one after the other, on the small tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_keep_columns_and_take_effect(spark):
    import corpus_pipeline as p

    docs = p.table(spark, SF, "documents")
    columns, n = docs.columns, docs.count()
    scratch = p.Scratch(spark, "test-pipeline")
    for name, stage in p.STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, SF), name)
        assert docs.columns == columns
        rows = docs.count()
        assert rows == n if name == "mixing" else 0.5 * n < rows <= n
        n = rows
    out = p.STAGES[-1][1](spark, docs, SF)
    assert out.count() == n and out.filter("not roundtrip").count() == 0
    labels = p.table(spark, SF, "labels")
    assert docs.join(labels.filter("toxic = 1"), "doc_id").count() <= 0.5 * labels.filter("toxic = 1").count()


WIDE = "doc_id long, text string, lang string, source string, n_chars long, score double, sid long, _gone long, _place string, block int, rid string, v string, mix string"


def odd_documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), 0.5, 7, 1, "p", 2, "r", "v", "m") for i, t, lang, src in rows], WIDE)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder with labels of the odd documents: every fifth is toxic, every fourth poor."""
    path = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, int(i % 4 != 0), int(i % 5 == 0)) for i in range(200)] + [(None, 1, 0), (3, None, None)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def texts_of(n):
    words = "stone water deep rain river cloud field wind light grass night morning road tree house".split()
    return [" ".join([*(words[(i * 7 + k * k + k * (i % 11)) % 15] for k in range(60)), f"number{i}", *(["scum", "filth"] if i % 5 == 0 else []), *(["!!! $$$"] * 20 if i % 4 == 0 else [])]) for i in range(n)]


def test_stages_on_odd_rows(spark, folder):
    import corpus_pipeline as p

    many = texts_of(200)
    rows = [(i, t, "en", "abc"[i % 3]) for i, t in enumerate(many)]
    rows += [(None, many[1], "en", None), (None, None, None, None), (300, None, "en", "a"), (301, "", None, "b"), (302, "   ", "en", "b"), (303, "two words", "en", "c")]
    rows += [(304, "stone " * 60_000, "en", "a"), (305, many[7], "en", "a"), (305, many[7], "en", "a"), (306, "x\u0000y ퟿ ▁", "zz", "a")]
    docs = odd_documents(spark, rows)
    out = {}
    for name, stage in p.STAGES:
        got = p.Scratch(spark, "odd").save(stage(spark, docs, folder), name)
        if name != "pieces":
            assert got.columns == docs.columns and got.schema == docs.schema
        out[name] = got.collect()
    ids = {name: [r.doc_id for r in got] for name, got in out.items()}
    assert sorted(map(str, ids["mixing"])) == sorted(str(r[0]) for r in rows) and len(out["pieces"]) == len(rows)
    assert all(r.roundtrip for r in out["pieces"]) and {r.n_tokens for r in out["pieces"] if r.doc_id in (300, 301)} == {0}
    assert {300, 301, 302, 303, 304} <= set(ids["toxicity"]) and {300, 301, 302, 303, 304} <= set(ids["near_duplicates"])
    assert 305 not in ids["near_duplicates"] and ids["near_duplicates"].count(None) == 2  # a row without an id stays
    assert sum(i is not None and i < 200 and i % 5 == 0 for i in ids["toxicity"]) <= 4


def test_stages_on_empty_tables(spark, folder):
    import corpus_pipeline as p

    empty = odd_documents(spark, [])
    for name, stage in p.STAGES:
        got = stage(spark, empty, folder)
        assert got.count() == 0 and (name == "pieces" or got.columns == empty.columns)
