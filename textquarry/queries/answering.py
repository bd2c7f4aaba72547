"""Queries of conversation history, query fan-out, evidence and prompts."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import functions as F

from ..operators import answer
from ..plans import answering
from ..plans.engine import RetrievalOptions
from .base import QUESTIONS, TERMS, bm25_sql, fused_sql, mmr_sql, query, questions, table
from .chunks import _CHILDREN, _PARENTS, BOOK, PACKED, SEGMENTS
from .evaluation import _CHUNK_DOCS, chunk_engine
from .search import _SCOPED, _engine


@query(
    """select conv_id, turn, role, substring(trim(text), 1, 6000) as text from (
  select *, row_number() over (partition by conv_id order by turn desc) as n from conversations) where n <= 8 and role in ('user', 'assistant') and trim(text) <> ''"""
)
def history_tail(spark, sf_dir):
    """The last eight turns, of which system turns and blank ones go."""
    return answer.recent_history(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "text")


def _structures(spark, sf_dir):
    """Every turn of a user as a question: those of every third conversation with two statements, their halves."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    half = (F.length("text") / 2).cast("int")
    pair = F.array(F.struct(F.lit("S1").alias("id"), F.substring("text", F.lit(1), half).alias("text")), F.struct(F.lit("S2").alias("id"), F.substring(F.col("text"), half + 1, F.length("text")).alias("text")))
    many = F.col("conv_id") % 3 == 0
    none = F.array().cast("array<struct<id:string,text:string>>")
    value = F.struct(F.when(many, "multiple_statements").otherwise("single").alias("type"), F.col("text").alias("question_text"), F.when(many, pair).otherwise(none).alias("statements"))
    return c.select("conv_id", "turn", value.alias("structure"))


@query(
    """with c as (select conv_id, turn, text, length(text) // 2 as h from conversations where role = 'user')
select conv_id, turn, 'Q' as query_id, text as query_text from c where conv_id % 3 <> 0
union all select conv_id, turn, 'S1', substring(text, 1, h) from c where conv_id % 3 = 0 union all select conv_id, turn, 'S2', substring(text, h + 1) from c where conv_id % 3 = 0"""
)
def statement_fanout(spark, sf_dir):
    return answer.fan_out(_structures(spark, sf_dir)).select("conv_id", "turn", "query_id", "query_text")


@query(
    """select conv_id, turn, case when conv_id % 4 = 3 then null when conv_id % 4 = 0 then trim(text) when conv_id % 4 = 1 then 'read ' || conv_id else trim(text) || chr(10) || chr(10) || 'read ' || conv_id end as combined
from conversations where role = 'user'"""
)
def combined_text(spark, sf_dir):
    """Typed only, read from a picture only, both, neither."""
    k = F.col("conv_id") % 4
    typed = F.when(k.isin(0, 2), F.col("text")).when(k == 3, F.lit("  "))
    read = F.when(k.isin(1, 2), F.concat(F.lit("read "), F.col("conv_id").cast("string")))
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", answer.combined_text(typed, read).alias("combined"))


def _evidence(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = _engine(spark, sf_dir).retrieve(questions(spark, sf_dir), RetrievalOptions(mode="bm25"), scoped=True)
    titles = docs.select("source").distinct().select(F.col("source").alias("book_id"), F.concat(F.lit("Title "), "source").alias("title"))
    passages = found.join(docs, "doc_id").select(
        "qid", F.lit(0).alias("query_no"), "rank", F.col("source").alias("book_id"), F.col("source").alias("book_title"),
        F.col("lang").alias("chapter_title"), F.array(F.col("doc_id") % 90 + 1).alias("book_pages"), "text",
    )
    asked = questions(spark, sf_dir).select("qid", F.lit(0).alias("query_no"), F.lit("Q").alias("query_id"), F.col("text").alias("query_text"))
    return asked, answer.evidence(answer.with_catalog_titles(passages, titles), asked, "qid")


_EVIDENCE = f"""with {_SCOPED}, ev as (
  select q.qid, q.text as query_text, string_agg('Label: [Title ' || source || '، صفحه ' || translate((d.doc_id % 90 + 1)::varchar, '0123456789', '۰۱۲۳۴۵۶۷۸۹') || ']' || chr(10)
    || 'Chapter: ' || lang || chr(10) || d.text, chr(10) || chr(10) order by rank) as found
  from questions q left join chosen using (qid) left join documents d using (doc_id) group by q.qid, q.text),
evidence as (select qid, query_text, '## Passages for Q' || chr(10) || 'Looked up: ' || query_text || chr(10) || chr(10) || coalesce(found, 'Nothing was found.') as evidence from ev)"""


@query(f"{_EVIDENCE} select qid, evidence from evidence")
def evidence_format(spark, sf_dir):
    return _evidence(spark, sf_dir)[1]


@query(
    f"""{_EVIDENCE} select qid, '# The question as asked' || chr(10) || query_text || chr(10) || chr(10) || '# What was said before' || chr(10) || '[]' || chr(10) || chr(10)
  || '# How the question is built' || chr(10) || '{{"type":"single","question_text":' || to_json(query_text) || ',"statements":[]}}' || chr(10) || chr(10) || '# Passages found in the books' || chr(10)
  || evidence || chr(10) || chr(10) || 'Reply in Persian to the question as asked, and cite by the labels of book and page given above, nothing else.' as prompt from evidence"""
)
def prompt_assembly(spark, sf_dir):
    asked, proof = _evidence(spark, sf_dir)
    none = F.array().cast("array<struct<id:string,text:string>>")
    structure = F.struct(F.lit("single").alias("type"), F.col("query_text").alias("question_text"), none.alias("statements"))
    text = answer.prompt(F.col("query_text"), F.lit(None).cast("string"), structure, F.col("evidence"))
    return asked.join(proof, "qid").select("qid", text.alias("prompt"))


class StandIn:
    """In the models' place: reads pictures that hold their text, makes two statements of every third text by its length, and
    answers with the digest of what it was asked."""

    def complete(self, model, messages, response_format=None, temperature=0.0):
        content = messages[-1]["content"]
        if model == "eyes":
            return base64.b64decode(content[1]["image_url"]["url"].partition(",")[2]).decode()
        if model == "large":
            text, seen = (content, "") if isinstance(content, str) else (content[0]["text"], "seen ")
            return seen + hashlib.sha256(text.encode()).hexdigest()
        half, two = len(content) // 2, len(content) % 3 == 0
        parts = [{"text": content[:half]}, {"text": content[half:]}] if two else []
        return json.dumps({"type": "multiple_statements" if two else "single", "question_text": content, "statements": parts}, ensure_ascii=False)


_FLOW = f"""with recursive {SEGMENTS}, {PACKED}, {_PARENTS}, {_CHILDREN}, {_CHUNK_DOCS},
said as (select conv_id * 1000 + turn as question_id, conv_id, case when conv_id % 10 in (8, 9) then null when conv_id % 3 = 0 then trim(text) when conv_id % 3 = 1 then text
  else trim(text) || chr(10) || chr(10) || 'read ' || conv_id end as combined from conversations where role = 'user'),
kinds as (select *, length(combined) % 3 = 0 as two, length(combined) // 2 as half from said),
fan as (select question_id, 0 as query_no, 'Q' as query_id, trim(combined) as query_text from kinds where not two
  union all select question_id, 0, 'S1', trim(substring(combined, 1, half)) from kinds where two union all select question_id, 1, 'S2', trim(substring(combined, half + 1)) from kinds where two),
{TERMS.replace(QUESTIONS, "questions as (select question_id || '/' || query_no as qid, query_text as text, null::varchar as scope from fan)").replace('from documents', 'from chunk_docs')},
{bm25_sql(False)}, {fused_sql('bm25')}, {mmr_sql(3)},
best as (select qid, rank, parent_id from (select qid, rank, parent_id, row_number() over (partition by qid, parent_id order by rank) as n from chosen join chunk_docs using (doc_id)) where n = 1),
passages as (select {BOOK} || printf(':parent-%04d', parent_no) as parent_id, case when doc_id % 3 = 1 then 'Title ' || doc_id else source end || case when doc_id % 3 <> 0 then '، صفحه ۱' else '' end as label,
  upper(lang) as chapter, par.text from par join documents d using (doc_id)),
proof as (select qid, string_agg('Label: [' || label || ']' || chr(10) || 'Chapter: ' || chapter || chr(10) || text, chr(10) || chr(10) order by rank) as found from best join passages using (parent_id) group by qid),
proofs as (select question_id, string_agg('## Passages for ' || query_id || chr(10) || 'Looked up: ' || query_text || chr(10) || chr(10) || coalesce(found, 'Nothing was found.'), chr(10) || chr(10) order by query_no) as evidence,
  string_agg('{{"id":"' || query_id || '","text":' || to_json(query_text) || '}}', ',' order by query_no) as listed from fan left join proof on qid = question_id || '/' || query_no group by question_id)
select question_id, case when conv_id % 10 = 9 then 'not a picture''s data URL' when conv_id % 10 = 8 then 'no question text' end as error,
  case when two then 'multiple_statements' when not two then 'single' end as kind,
  case when conv_id % 3 <> 0 then 'seen ' else '' end || sha256('# The question as asked' || chr(10) || combined || chr(10) || chr(10) || '# What was said before' || chr(10) || '[]' || chr(10) || chr(10)
  || '# How the question is built' || chr(10) || '{{"type":"' || case when two then 'multiple_statements' else 'single' end || '","question_text":' || to_json(trim(combined)) || ',"statements":['
  || case when two then listed else '' end || ']}}' || chr(10) || chr(10) || '# Passages found in the books' || chr(10) || evidence || chr(10) || chr(10)
  || 'Reply in Persian to the question as asked, and cite by the labels of book and page given above, nothing else.') as answer
from kinds left join proofs using (question_id)"""


@query(_FLOW)
def answer_flow(spark, sf_dir):
    """Every turn of a user as a question, typed, as a picture, or both: reading, structure, retrieval, passages, prompt and answer."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    k, odd = F.col("conv_id") % 3, F.col("conv_id") % 10
    shown = F.when(k == 1, F.col("text")).when(k == 2, F.concat(F.lit("read "), F.col("conv_id").cast("string")))
    picture = F.concat(F.when(odd == 9, F.lit("data:text/html;base64,")).otherwise(F.lit("data:image/png;base64,")), F.regexp_replace(F.base64(F.encode(F.when(odd == 9, "x").otherwise(shown), "UTF-8")), r"\s", ""))
    asked = c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.when((k != 1) & (odd != 8), F.col("text")).alias("typed_text"), F.when(odd != 8, picture).alias("image_data"),
    )
    d = table(spark, sf_dir, "documents").filter("doc_id % 3 = 1")
    catalog = d.select(F.format_string("D%d", "doc_id").alias("book_id"), F.concat(F.lit("Title "), F.col("doc_id").cast("string")).alias("title"))
    models = answering.AnswerModels(picture="eyes")
    out = answering.answer(asked, chunk_engine(spark, sf_dir), StandIn(), catalog, options=RetrievalOptions(top_k=3, mode="bm25"), models=models)
    return out.select("question_id", "error", F.col("structure.type").alias("kind"), "answer")
