import json

from textquarry import cli


def test_build_search_and_evaluate(spark, tmp_path, capsys):
    text = "پیوند هیدروژنی میان مولکول های آب است. "
    pages = [{"book_id": "C110210", "book_title": "شیمی", "source_file": "c.pdf", "pdf_page": p, "raw_text": t, "spans": []} for p, t in ((12, text * 5), (60, "گاز و هوا و زمین " * 5))]
    (tmp_path / "pages.jsonl").write_text("\n".join(json.dumps(p, ensure_ascii=False) for p in pages))
    out = str(tmp_path / "index")
    cli.main(["build", "--pages", str(tmp_path / "pages.jsonl"), "--output", out])
    built = json.loads(capsys.readouterr().out)
    assert built["book_count"] == 1 and built["pages"] == 2 and built["chunks"] == 2
    cli.main(["search", "پیوند آب", "--index", out, "--book", "C110210", "--top-k", "1"])
    assert json.loads(capsys.readouterr().out)[0]["pdf_pages"] == [12]
    cli.main(["retrieve", "پیوند آب", "--index", out, "--mode", "bm25"])
    assert json.loads(capsys.readouterr().out)["llm_context"]["passages"][0]["parent_id"] == "C110210:parent-0001"
    q = {"id": "q1", "book_id": "C110210", "question": "پیوند آب", "relevant_pdf_pages": [12]}
    (tmp_path / "q.jsonl").write_text(json.dumps(q, ensure_ascii=False))
    cli.main(["evaluate", "--index", out, "--questions", str(tmp_path / "q.jsonl")])
    assert json.loads(capsys.readouterr().out)[0]["recall_at_1"] == 1.0
    cli.main(["evaluate-retrieval", "--index", out, "--questions", str(tmp_path / "q.jsonl"), "--mode", "bm25"])
    assert json.loads(capsys.readouterr().out)[0]["mrr_at_10"] == 1.0
    cli.main(["benchmark", "--index", out, "--questions", str(tmp_path / "q.jsonl"), "--targets", "20,240"])
    assert [r["child_target"] for r in json.loads(capsys.readouterr().out)] == [20, 240]
