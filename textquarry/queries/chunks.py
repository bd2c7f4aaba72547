"""Queries of segmentation, packing, overlap and chunk rows. Each document is a book of one page."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking, reports
from ..functions.text import nfkc, normalize_display
from .base import display, documents, query, search_form, tokens

BOOK = "printf('D%d', doc_id)"


def pages(spark, sf_dir):
    # a column of its own: what display text is made of looks at it more than once
    d = documents(spark, sf_dir).withColumn("text", nfkc(F.col("text")))
    return d.select(
        F.format_string("D%d", "doc_id").alias("book_id"),
        F.lit(1).alias("pdf_page"),
        F.when(F.col("doc_id") % 3 != 0, F.lit(1)).alias("book_page"),
        F.col("lang").alias("chapter_id"),
        F.upper("lang").alias("chapter_title"),
        F.col("source").alias("section_heading"),
        F.col("source").alias("book_title"),
        F.concat("source", F.lit(".pdf")).alias("source_file"),
        normalize_display(F.col("text")).alias("display_text"),
    )


def _len(x: str) -> str:
    return f"len({tokens(x)})"


# paragraphs, units of long ones, and a recursive fold over the units of each
SEGMENTS = rf"""
paras as (select doc_id, para, trim(line) as line from (
  select doc_id, unnest(l) as line, generate_subscripts(l, 1) - 1 as para from (select doc_id, string_split({display('text')}, chr(10)) as l from documents))
  where trim(line) <> ''),
sized as (select *, {_len('line')} as t, list_filter(list_transform(string_split(regexp_replace(line, '([.!؟?؛])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') as sents from paras),
longs as (select doc_id, para, len(sents) <= 1 as words, case when len(sents) <= 1 then list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '') else sents end as u from sized where t > 260),
units as (select doc_id, para, i, unit, greatest({_len('unit')}, case when words then 1 else 0 end) as w from (select doc_id, para, words, unnest(u) as unit, generate_subscripts(u, 1) as i from longs)),
fold as (
  select doc_id, para, i, unit, w as size, 0 as piece from units where i = 1
  union all
  select n.doc_id, n.para, n.i, n.unit, case when f.size + n.w > 260 then n.w else f.size + n.w end, case when f.size + n.w > 260 then f.piece + 1 else f.piece end
  from fold f join units n on n.doc_id = f.doc_id and n.para = f.para and n.i = f.i + 1),
pieces as (select doc_id, para, 0 as piece, line as text from sized where t <= 260
  union all select doc_id, para, piece, string_agg(unit, ' ' order by i) as text from fold group by doc_id, para, piece),
segs as (select doc_id, row_number() over (partition by doc_id order by para, piece) as seg, text, tokens from (
  select *, {_len('text')} as tokens from pieces) where tokens >= 2)
"""

PACKED = """
pfold as (
  select doc_id, seg, tokens as size, 1 as parent_no from segs where seg = 1
  union all
  select s.doc_id, s.seg, case when (f.size >= 700 and f.size + s.tokens > 700) or f.size + s.tokens > 950 then s.tokens else f.size + s.tokens end,
    case when (f.size >= 700 and f.size + s.tokens > 700) or f.size + s.tokens > 950 then f.parent_no + 1 else f.parent_no end
  from pfold f join segs s on s.doc_id = f.doc_id and s.seg = f.seg + 1),
psegs as (select s.*, p.parent_no from segs s join pfold p using (doc_id, seg)),
cfold as (
  select doc_id, parent_no, seg, tokens as size, 0 as child_group from (select *, min(seg) over (partition by doc_id, parent_no) as low from psegs) where seg = low
  union all
  select s.doc_id, s.parent_no, s.seg, case when (f.size >= 240 and f.size + s.tokens > 240) or f.size + s.tokens > 320 then s.tokens else f.size + s.tokens end,
    case when (f.size >= 240 and f.size + s.tokens > 240) or f.size + s.tokens > 320 then f.child_group + 1 else f.child_group end
  from cfold f join psegs s on s.doc_id = f.doc_id and s.parent_no = f.parent_no and s.seg = f.seg + 1),
csegs as (select p.*, c.child_group from psegs p join cfold c using (doc_id, parent_no, seg)),
tails as (select doc_id, parent_no, child_group + 1 as child_group, seg, text, tokens from (
  select *, sum(tokens) over (partition by doc_id, parent_no, child_group order by seg desc rows unbounded preceding) as back,
    max(child_group) over (partition by doc_id, parent_no) as top from csegs) where back <= 40 and child_group < top)
"""


@query(f"with recursive {SEGMENTS} select {BOOK} as book_id, seg, tokens::int as tokens, text from segs")
def page_segments(spark, sf_dir):
    return chunking.page_segments(pages(spark, sf_dir)).select("book_id", "seg", "tokens", "text")


@query(f"with recursive {SEGMENTS} select doc_id, para, piece, text from pieces where (doc_id, para) in (select (doc_id, para) from longs)")
def split_long_paragraph(spark, sf_dir):
    """Pieces of the paragraphs of more than 260 tokens."""
    from ..functions.text import lines, strip, token_count

    shown = documents(spark, sf_dir).select("doc_id", nfkc(F.col("text")).alias("text")).select("doc_id", normalize_display(F.col("text")).alias("text"))
    paras = shown.select("doc_id", F.posexplode(lines(F.col("text"))).alias("para", "line"))
    paras = paras.withColumn("line", strip(F.col("line"))).filter(token_count(F.col("line")) > chunking.PIECE_LIMIT)
    return chunking.split_long_paragraphs(paras.withColumnRenamed("line", "text"), ["doc_id", "para"], "text")


@query(f"with recursive {SEGMENTS}, {PACKED} select {BOOK} as book_id, seg, parent_no, child_group from csegs")
def greedy_pack(spark, sf_dir):
    segs = chunking.with_parents(chunking.page_segments(pages(spark, sf_dir)))
    return chunking.with_children(segs).select("book_id", "seg", "parent_no", "child_group")


@query(f"with recursive {SEGMENTS}, {PACKED} select {BOOK} as book_id, parent_no, child_group, seg from tails")
def overlap_tail(spark, sf_dir):
    segs = chunking.with_children(chunking.with_parents(chunking.page_segments(pages(spark, sf_dir))))
    return chunking.overlap_tails(segs).select("book_id", "parent_no", "child_group", "seg")


_PARENTS = f"""par as (select doc_id, parent_no, string_agg(text, chr(10) order by seg) as text, sum(tokens)::int as token_count from psegs group by doc_id, parent_no)"""
_CHILDREN = f"""chi as (select doc_id, parent_no, child_group, string_agg(text, chr(10) order by seg) as text, sum(tokens)::int as token_count
  from (select doc_id, parent_no, child_group, seg, text, tokens from csegs union all select doc_id, parent_no, child_group, seg, text, tokens from tails) group by all)"""


@query(
    f"""with recursive {SEGMENTS}, {PACKED}, {_PARENTS} select {BOOK} || printf(':parent-%04d', parent_no) as parent_id, text, {search_form('text')} as search_text, token_count,
  case when doc_id % 3 <> 0 then '1' else '' end as book_pages from par"""
)
def parents(spark, sf_dir):
    rows = chunking.parents(chunking.with_parents(chunking.page_segments(pages(spark, sf_dir))))
    return rows.select("parent_id", "text", "search_text", "token_count", F.array_join(F.col("book_pages").cast("array<string>"), ",").alias("book_pages"))


@query(
    f"""with recursive {SEGMENTS}, {PACKED}, {_CHILDREN}
select {BOOK} || printf(':chunk-%04d', row_number() over (partition by doc_id order by parent_no, child_group)) as chunk_id, {BOOK} || printf(':parent-%04d', parent_no) as parent_id,
  source as section_heading, lang as chapter_id, 'prose' as content_type, c.text, token_count from chi c join documents using (doc_id)"""
)
def children(spark, sf_dir):
    _, rows = chunking.build_chunks(pages(spark, sf_dir))
    return rows.select("chunk_id", "parent_id", "section_heading", "chapter_id", "content_type", "text", "token_count")


@query(
    f"""with recursive {SEGMENTS}, {PACKED}, {_PARENTS}, {_CHILDREN}
select {BOOK} as book_id, 1::bigint as pdf_pages, (select count(*) from par p where p.doc_id = d.doc_id) as parents, (select count(*) from chi c where c.doc_id = d.doc_id) as chunks from documents d"""
)
def manifest(spark, sf_dir):
    p = pages(spark, sf_dir)
    par, chi = chunking.build_chunks(p)
    return reports.manifest(p, par, chi)


@query(
    f"""with recursive {SEGMENTS}, {PACKED}, {_PARENTS}, {_CHILDREN}
select (select count(*) from documents) as book_count, (select count(*) from documents) as pages, (select count(*) from par) as parents, (select count(*) from chi) as chunks,
  (select count(distinct t) from (select unnest({tokens('text')}) as t from chi)) as bm25_terms"""
)
def build_summary(spark, sf_dir):
    from ..operators import bm25

    p = pages(spark, sf_dir)
    par, chi = chunking.build_chunks(p)
    return reports.build_summary(p, par, chi, bm25.build(chi, "search_text", "chunk_id", "book_id").postings)
