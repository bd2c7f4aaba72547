import json
import os

import pytest
from pyspark.sql import functions as F

from textquarry.operators import answer
from textquarry.plans.answering import answer as answer_all
from textquarry.sources import io
from textquarry.streaming import ingest


def structure(spark, reply, fallback="fb"):
    value, error = answer.parse_structure(F.col("r"), F.col("f"))
    row = spark.createDataFrame([(reply, fallback)], "r string, f string").select(value.alias("v"), error.alias("e")).first()
    return row.v.asDict(True) if row.v else None, row.e


def test_structure_rules(spark):
    v, e = structure(spark, '```json\n{"type":"single","question_text":" ","statements":[{"id":"a","text":"b"}]}\n```')
    assert e is None and v == {"type": "single", "question_text": "fb", "statements": []}
    v, e = structure(spark, '{"type":"multiple_statements","question_text":"q","statements":[{"text":" one "},{"id":"B","text":"two"}]}')
    assert v["statements"] == [{"id": "S1", "text": "one"}, {"id": "B", "text": "two"}]
    for bad in ("no json", "[1]", '{"type":"other"}', '{"type":"multiple_statements","statements":[{"text":"one"}]}', '{"type":"single","statements":[{"text":" "}]}'):
        assert structure(spark, bad)[0] is None and structure(spark, bad)[1]


class Scripted:
    def complete(self, model, messages, response_format=None, temperature=0.0):
        text = messages[-1]["content"]
        if model == "large":
            return "answer to " + str(text.count("Label: ["))
        kind = "multiple_statements" if "؛" in text else "single"
        parts = [{"text": t} for t in text.split("؛")] if kind != "single" else []
        return json.dumps({"type": kind, "question_text": text, "statements": parts}, ensure_ascii=False)


def test_answers_are_grounded(spark, request):
    from tests.test_search import CHUNK, PARENT
    from textquarry.plans.engine import engine_over_chunks

    chunks = spark.createDataFrame([("c1", "b:parent-0001", "b", "B", "b.pdf", "x", "Chapter", None, [56], [56], "prose", "پیوند آب", "پیوند آب", 2)], CHUNK)
    parents = spark.createDataFrame([("b:parent-0001", "b", "B", "b.pdf", "Chapter", [56], [56], "متن پیوند آب")], PARENT)
    catalog = spark.createDataFrame([("b", "Test Book")], "book_id string, title string")
    q = spark.createDataFrame([(1, "پیوند چیست", None), (2, "آب", "پیوند؛ آب"), (3, None, None)], "question_id int, typed_text string, ocr_text string")
    rows = {r.question_id: r for r in answer_all(q, engine_over_chunks(chunks, parents), Scripted(), catalog).collect()}
    assert rows[1].answer == "answer to 1" and rows[2].answer == "answer to 2"
    assert "[Test Book، صفحه ۵۶]" in rows[1].prompt and "parent-0001" not in rows[1].prompt
    assert rows[3].error and rows[3].answer is None


class Seeing(Scripted):
    def complete(self, model, messages, response_format=None, temperature=0.0):
        content = messages[-1]["content"]
        if model == "eyes":
            assert content[1]["type"] == "image_url" and content[1]["image_url"]["url"].startswith("data:image/png;base64,")
            return "پیوند؛ آب"
        if model == "large" and isinstance(content, list):
            return f"{content[1]['type']} {content[0]['text'].count('Label: [')}"
        return super().complete(model, messages)


def test_pictures_are_read_and_shown_to_the_answering_model(spark):
    from tests.test_search import CHUNK, PARENT
    from textquarry.plans.answering import AnswerModels
    from textquarry.plans.engine import engine_over_chunks

    chunks = spark.createDataFrame([("c1", "b:parent-0001", "b", "B", "b.pdf", "x", "Chapter", None, [56], [56], "prose", "پیوند آب", "پیوند آب", 2)], CHUNK)
    parents = spark.createDataFrame([("b:parent-0001", "b", "B", "b.pdf", "Chapter", [56], [56], "متن پیوند آب")], PARENT)
    catalog = spark.createDataFrame([("b", "Test Book")], "book_id string, title string")
    picture = "data:image/png;base64,dGVzdA=="
    q = spark.createDataFrame([(1, None, picture), (2, "آب", None), (3, "آب", "data:text/html;base64,dGVzdA==")], "question_id int, typed_text string, image_data string")
    rows = {r.question_id: r for r in answer_all(q, engine_over_chunks(chunks, parents), Seeing(), catalog, models=AnswerModels(picture="eyes")).collect()}
    assert rows[1].structure.type == "multiple_statements" and rows[1].answer == "image_url 2"
    assert rows[2].answer == "answer to 1" and rows[3].answer is None and "picture" in rows[3].error


def test_history_and_scores(spark):
    turns = spark.createDataFrame([(1, i, ("system", "user", "assistant")[i % 3], f" t{i} " if i != 4 else "  ") for i in range(12)], "conv_id int, turn int, role string, text string")
    assert sorted((r.turn, r.text) for r in answer.recent_history(turns).collect()) == [(5, "t5"), (7, "t7"), (8, "t8"), (10, "t10"), (11, "t11")]
    pairs = spark.createDataFrame([("k1", "q", "pp"), ("k2", "q", "p")], "cache_key string, question string, passage string")
    cache = spark.createDataFrame([("k1", 9.0)], "cache_key string, score double")
    scored, new = answer.cached_scores(pairs, cache, lambda qs, ps: [len(p) for p in ps])
    assert {r.cache_key: r.score for r in scored.collect()} == {"k1": 9.0, "k2": 1.0} and new.count() == 1


def test_json_lines_and_catalog(spark, tmp_path):
    df = spark.createDataFrame([(1, "متن", None), (2, None, [1, 2])], "a int, b string, c array<int>")
    for gzip in (False, True):
        io.write_jsonl(df, str(tmp_path / f"j{gzip}"), gzip)
        assert sorted(map(tuple, io.read_jsonl(spark, str(tmp_path / f"j{gzip}"), df.schema).collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "lines.jsonl").write_text('{"a":1}\n\n{"a":2}\n')
    assert io.read_jsonl(spark, str(tmp_path / "lines.jsonl"), "a int").count() == 2
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text('{"C1": " کتاب "}')
    bad.write_text('{"C1": " "}')
    assert io.load_catalog(spark, str(good)).first().title == "کتاب"
    with pytest.raises(ValueError):
        io.load_catalog(spark, str(bad))


def test_pdf_discovery(spark, tmp_path):
    with pytest.raises(ValueError):
        io.discover_pdfs(spark, str(tmp_path))
    (tmp_path / "sub").mkdir()
    for name in ("a.pdf", "sub/A.PDF", "sub/b.Pdf", "c.txt"):
        (tmp_path / name).write_bytes(b"%PDF")
    files = io.discover_pdfs(spark, str(tmp_path))
    assert sorted(r.source_file for r in files.collect()) == ["A.PDF", "a.pdf", "b.Pdf"]
    assert [tuple(r) for r in io.repeated_stems(files).collect()] == [("a", 2)]


def test_page_rows(spark):
    raw = spark.createDataFrame([("C110210", "B", "f", 12, "یک خط\n2"), ("other", "B", "f", 12, "x"), ("C110210", "B", "f", 900, "")], "book_id string, book_title string, source_file string, pdf_page int, raw_text string")
    rows = {(r.book_id, r.pdf_page): r for r in io.page_rows(raw).collect()}
    a = rows["C110210", 12]
    assert (a.chapter_id, a.book_page, a.display_text, a.quality.needs_ocr_review) == ("chapter-1", 2, "یک خط", True)
    assert rows["other", 12].book_page == 12 and rows["other", 12].chapter_id == "document" and rows["other", 12].chapter_title == "B"
    assert rows["C110210", 900].chapter_id == "unknown" and not rows["C110210", 900].quality.has_text


def test_settings_file(tmp_path, monkeypatch):
    monkeypatch.setenv("TQ_KEPT", "old")
    monkeypatch.delenv("TQ_NEW", raising=False)
    (tmp_path / ".env").write_text("# c\nTQ_KEPT=new\nTQ_NEW='v=1'\nbroken\n")
    assert io.load_env_file(str(tmp_path / ".env")) == {"TQ_NEW": "v=1"} and os.environ["TQ_KEPT"] == "old"
    os.environ.pop("TQ_NEW")


def test_streaming_ingest_drops_known_texts(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "index")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([(1, "a b", "en", "s", 3), (2, "a b", "en", "s", 3)], [(3, "a b", "en", "s", 3), (4, "c", "en", "t", 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = ingest.start(spark, src, path, str(tmp_path / "ck"), once=True)
        q.awaitTermination()
        assert q.exception() is None
    index = ingest.load(spark, path)
    assert index.doc_stats.count() == 2 and index.postings.count() == 3
