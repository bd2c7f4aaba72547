import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from textquarry.operators import bm25
from textquarry.store import publish, published

CODE = """
import pathlib
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.checkpoint.dir", sys.argv[1]).config("spark.ui.enabled", "false").getOrCreate()
from textquarry.store import stored
t = stored(spark.range(5), "five")
assert t.count() == 5 and len(list(pathlib.Path(sys.argv[1]).glob("five-*"))) == 1
spark.stop()
"""


def test_stored_tables_go_with_the_driver(tmp_path):
    subprocess.run([sys.executable, "-c", CODE, str(tmp_path)], check=True, timeout=120)
    waited = 0
    while list(tmp_path.glob("five-*")) and waited < 50:
        time.sleep(0.2)
        waited += 1
    assert not list(tmp_path.glob("five-*"))


def test_a_version_that_fails_leaves_the_one_before(spark, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        published(spark, path)
    publish(spark, path, {"a": spark.range(3), "b": spark.range(1)})
    first = published(spark, path)
    broken = spark.range(5).select(F.raise_error(F.lit("lost")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        publish(spark, path, {"a": spark.range(9), "b": broken})
    assert published(spark, path) == first and spark.read.parquet(f"{first}/a").count() == 3
    # the next one takes the failed one's place; a reader of the version before still has its files
    publish(spark, path, {"a": spark.range(9), "b": spark.range(2)})
    second = published(spark, path)
    assert second != first and spark.read.parquet(f"{second}/a").count() == 9 and spark.read.parquet(f"{first}/a").count() == 3
    publish(spark, path, {"a": spark.range(1), "b": spark.range(2)})
    assert not (tmp_path / "index/v000001").exists() and (tmp_path / "index/v000002").exists()


def test_an_index_that_fails_half_way_still_loads(spark, tmp_path):
    docs = spark.createDataFrame([(1, "water and ice"), (2, "stone")], "doc_id long, text string")
    index = bm25.build(docs)
    index.save(str(tmp_path / "i"))
    index.doc_stats = spark.range(1).select(F.raise_error(F.lit("lost")).alias("dl"))
    with pytest.raises(Exception, match="lost"):
        index.save(str(tmp_path / "i"))
    q = spark.createDataFrame([(1, "ice")], "qid long, text string")
    assert [r.doc_id for r in bm25.search(bm25.BM25Index.load(spark, str(tmp_path / "i")), q).collect()] == [1]


def test_tables_that_pass_leave_what_is_kept(spark, tmp_path):
    from pathlib import Path

    from textquarry.store import passing, stored

    there = lambda t: Path(t._stored_path.removeprefix("file://")).exists()
    with passing(spark):
        with passing(spark) as keep:
            a, b = stored(spark.range(3), "a"), stored(spark.range(4), "b")
            assert keep(b) is b
        assert not there(a) and there(b) and b.count() == 4
        with pytest.raises(ValueError):
            with passing(spark):
                c = stored(spark.range(5), "c")
                raise ValueError
        assert not there(c)
    assert not there(b)
    assert there(stored(spark.range(1), "d"))


def test_chunks_and_indexes_leave_no_tables_that_nothing_reads(spark, tmp_path):
    """Everything stored on the way stayed until the driver ended: fifteen times the input for the job of chunks."""
    from jobs import build_chunks
    from textquarry.queries import search
    from textquarry.store import scratch_folder

    from pathlib import Path

    docs = spark.createDataFrame([(i, f"water and ice {i}\nstone {i} and more", "s", "en") for i in range(20)], "doc_id long, text string, source string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    root = Path(scratch_folder(spark).removeprefix("file://"))
    names = lambda before=(): sorted(p.name.rsplit("-", 1)[0] for p in root.iterdir() if p not in before)
    before = set(root.iterdir())
    assert build_chunks.run(spark, str(tmp_path / "documents.parquet"), str(tmp_path / "out"))["chunks"] == 20
    assert names(before) == []
    index = search._impacts(spark, str(tmp_path))
    assert names(before) == ["blocks", "impact-documents", "impact-terms"] and index.documents.count() == 20
