"""Queries of the scalar text, JSON and array functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, text
from ..operators import evaluate
from ..operators.answer import parse_structure
from ..sources.io import page_rows
from .base import UNIT, display, documents, query, search_form, table, tokens


@query(f"select doc_id, {display('text')} as display_text from documents")
def normalize_display(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.normalize_display(text.nfkc(F.col("text"))).alias("display_text"))


@query(f"select doc_id, {search_form('text')} as search_text from documents")
def normalize_search(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.normalize_search(text.nfkc(F.col("text"))).alias("search_text"))


# presentation forms, full-width and half-width forms, ligatures, a fraction, and what they stand for
_FORMS = "\nﺳﻼم ﻛﺘﺎب １２３ ﬁne Ⅳ ½ ｶﾞ… Ａｂ ①"
_PLAIN = "\nسلام كتاب 123 fine IV 1⁄2 ガ... Ab 1"


@query(
    f"""with t as (select doc_id, text || '{_PLAIN}' as t from documents)
select doc_id, {display('t')} as display_text, {search_form('t')} as search_text, array_to_string({tokens('t')}, ' ') as tokens, len({tokens('t')})::int as token_count from t"""
)
def nfkc_forms(spark, sf_dir):
    """Texts that end in compatibility forms: the oracle's texts end in what these stand for."""
    t = text.nfkc(F.concat("text", F.lit(_FORMS)))
    rows = documents(spark, sf_dir).select("doc_id", t.alias("t"))
    return rows.select(
        "doc_id", text.normalize_display(F.col("t")).alias("display_text"), text.normalize_search(F.col("t")).alias("search_text"),
        F.array_join(text.tokenize(F.col("t")), " ").alias("tokens"), text.token_count(F.col("t")).alias("token_count"),
    )


@query(f"select doc_id, array_to_string({tokens('text')}, ' ') as tokens from documents")
def tokenize(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.array_join(text.tokenize(text.nfkc(F.col("text"))), " ").alias("tokens"))


@query(f"select doc_id, len({tokens('text')})::bigint as token_count from documents")
def token_count(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.token_count(text.nfkc(F.col("text"))).cast("long").alias("token_count"))


def _pages(spark, sf_dir):
    """Documents as raw pages of books: the source is the book, the id its page."""
    d = documents(spark, sf_dir)
    return d.select(
        F.col("source").alias("book_id"),
        F.concat(F.lit("Book "), "source").alias("book_title"),
        F.concat("source", F.lit(".pdf")).alias("source_file"),
        (F.col("doc_id") % 160 + 1).cast("int").alias("pdf_page"),
        F.col("text").alias("raw_text"),
        "doc_id",
    )


@query(
    rf"""select doc_id, array_to_string(list_filter(string_split({display("text || chr(10) || (doc_id % 160 + 1)")}, chr(10)),
  lambda x: not (regexp_full_match(x, '[0-9]+') and len(x) < 10 and coalesce(try_cast(x as int) = doc_id % 160 + 1, false))), chr(10)) as display_text
from documents"""
)
def clean_page_text(spark, sf_dir):
    """A page number is printed below every text, and goes again."""
    page = (F.col("doc_id") % 160 + 1).cast("int")
    printed = F.concat("text", F.lit("\n"), page.cast("string"))
    return documents(spark, sf_dir).select("doc_id", text.clean_page_text(printed, page).alias("display_text"))


@query(
    rf"""with l as (select doc_id, lang, list_transform(list_slice(string_split({display('text')}, chr(10)), 1, 12), lambda x: regexp_replace(x, '^[ .…]+|[ .…]+$', '', 'g')) as heads from documents)
select doc_id, list_filter(heads, lambda x: x <> '' and length(x) <= 90 and not regexp_full_match(x, '[0-9]+')
  and (contains(x, 'فصل') or contains(x, lang) or (len(regexp_extract_all(x, '\S+')) <= 8 and not regexp_matches(x, '[.!؟?!؛:]$') and not regexp_matches(x, '[=+×÷<>]'))))[1] as section_heading from l"""
)
def section_heading(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("doc_id", text.section_heading(text.normalize_display(F.col("text")), F.col("lang")).alias("section_heading"))


_CHAPTERS = ", ".join(f"({a}, {b}, '{c}', '{t}')" for a, b, c, t in text.CHAPTERS)


@query(
    f"""with p as (select doc_id, doc_id % 160 + 1 as page from documents), c(first, last, chapter_id, chapter_title) as (values {_CHAPTERS})
select doc_id, coalesce(chapter_id, 'unknown') as chapter_id, coalesce(chapter_title, 'نامشخص') as chapter_title from p left join c on page between first and last"""
)
def chapter_range_join(spark, sf_dir):
    pages = _pages(spark, sf_dir).withColumn("book_id", F.lit("C110210"))
    return page_rows(pages).select("doc_id", "chapter_id", "chapter_title")


@query(
    "select doc_id, case when source = 'src0' then (case when doc_id % 160 + 1 between 11 and 149 then doc_id % 160 - 9 end) else doc_id % 160 + 1 end::int as book_page from documents"
)
def printed_page(spark, sf_dir):
    book = F.when(F.col("book_id") == "src0", F.lit("C110210")).otherwise(F.col("book_id"))
    return _pages(spark, sf_dir).select("doc_id", text.printed_page(book, F.col("pdf_page")).alias("book_page"))


@query(
    f"""select doc_id, length(d)::int as characters, len({tokens('d')})::int as tokens, d <> '' as has_text,
  length(d) < 80 and page not in (1, 3, 4, 5, 6, 7, 8, 9, 10, 150) as needs_ocr_review
from (select doc_id, doc_id % 160 + 1 as page, {display('text')} as d from documents)"""
)
def page_quality(spark, sf_dir):
    rows = page_rows(_pages(spark, sf_dir))
    return rows.select("doc_id", *[f"quality.{c}" for c in ("characters", "tokens", "has_text", "needs_ocr_review")])


@query(
    """select doc_id, case when regexp_matches(t, 'خود را بیازمایید|تمرین|پرسش') then 'exercise' when regexp_matches(t, 'جدول|نمودار') then 'table_or_chart'
  when regexp_matches(t, 'شکل|تصویر') and length(t) < 500 then 'caption' else 'prose' end as content_type
from (select doc_id, text || case doc_id % 5 when 0 then ' تمرین' when 1 then ' جدول' when 2 then ' شکل' when 3 then ' شکل جدول' else '' end as t from documents)"""
)
def content_type(spark, sf_dir):
    """Key words of the kinds are added to four of five texts."""
    words = F.element_at(F.array(*[F.lit(w) for w in (" تمرین", " جدول", " شکل", " شکل جدول", "")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return documents(spark, sf_dir).select("doc_id", text.content_type(F.concat("text", words)).alias("content_type"))


@query(
    r"""select doc_id, len(s)::int as n_sentences, array_to_string(s, ' | ') as sentences from (
  select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!؟?؛])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as s from documents)"""
)
def sentence_split(spark, sf_dir):
    s = text.sentences(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", s.alias("s")).select("doc_id", F.size("s").alias("n_sentences"), F.array_join("s", " | ").alias("sentences"))


@query(
    """with g as (select source, list_sort(list_distinct(list(doc_id % 40 + 1))) as pages from documents where doc_id % 7 = 0 group by source),
b as (select distinct source from documents)
select source, 'Book ' || source || coalesce('، ' || case when len(pages) = 1 then 'صفحه' else 'صفحه' || chr(8204) || 'های' end || ' ' ||
  array_to_string(list_transform(pages, lambda p: translate(p::varchar, '0123456789', '۰۱۲۳۴۵۶۷۸۹')), '، '), '') as citation_label from b left join g using (source)"""
)
def citation_label(spark, sf_dir):
    page = F.when(F.col("doc_id") % 7 == 0, F.col("doc_id") % 40 + 1)
    pages = documents(spark, sf_dir).groupBy("source").agg(F.collect_set(page).alias("pages"))
    return pages.select("source", text.citation_label(F.concat(F.lit("Book "), "source"), F.col("pages")).alias("citation_label"))


@query(
    """select doc_id, case when doc_id % 2 = 0 then source || ':' || printf('parent-%04d', doc_id) else source || ':x-' || doc_id end as citation_id,
  source || printf(':chunk-%04d', doc_id) as chunk_id from documents"""
)
def citation_id(spark, sf_dir):
    number = F.col("doc_id").cast("int")
    parent = F.when(F.col("doc_id") % 2 == 0, text.numbered_id(F.col("source"), "parent", number)).otherwise(F.concat(F.lit("x-"), F.col("doc_id").cast("string")))
    return documents(spark, sf_dir).select(
        "doc_id", text.citation_id(F.col("source"), parent).alias("citation_id"), text.numbered_id(F.col("source"), "chunk", number).alias("chunk_id")
    )


@query("select doc_id, sha256(text) as fingerprint, sha256('m1' || chr(31) || source || chr(31) || text) as cache_key from documents")
def fingerprint(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("doc_id", text.fingerprint(F.col("text")).alias("fingerprint"), text.cache_key(F.lit("m1"), F.col("source"), F.col("text")).alias("cache_key"))


@query(r"""select page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'model') as slug from pages""")
def slug(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.slug(F.col("url")).alias("slug"))


@query(
    """select page_id, 'data:image/png;base64,' || base64(encode(url)) as data_url, true as valid, regexp_matches(url, '^data:') as url_valid from pages"""
)
def data_url(spark, sf_dir):
    made = text.image_data_url(F.concat("url", F.lit("/shot.PNG")), F.col("url").cast("binary"))
    return table(spark, sf_dir, "pages").select(
        "page_id", made.alias("data_url"), text.is_image_data_url(made).alias("valid"), text.is_image_data_url(F.col("url")).alias("url_valid")
    )


def _untag(x: str) -> str:
    t = rf"regexp_replace(coalesce({x}, ''), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g')"
    t = rf"regexp_replace({t}, '(?i)<br\s*/?>|</?(?:p|div|li|h[1-6]|tr|article|nav|footer|ul|title)\b[^>]*>', chr(10), 'g')"
    t = f"regexp_replace({t}, '<[^>]*>', '', 'g')"
    for name, value in text.REFERENCES:
        t = f"replace({t}, '{name}', '{value.replace(chr(39), chr(39) * 2)}')"
    return display(t)


@query(f"select page_id, {_untag('html')} as display_text from pages")
def html_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.html_to_text(F.col("html")).alias("display_text"))


@query(f"with {UNIT} select doc_id as vec_id, list_transform(v, lambda x: round(x, 8)) as unit from vec")
def l2_normalize(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform(arrays.l2_normalize(arrays.doubles(F.col("embedding"))), lambda x: F.round(x, 8)).alias("unit"))


@query("select count(*) as n, min(len(embedding))::int as low, max(len(embedding))::int as high, count(distinct len(embedding)) as dimensions from embeddings")
def dimension_check(spark, sf_dir):
    size = F.size("embedding")
    return table(spark, sf_dir, "embeddings").agg(
        F.count("*").alias("n"), F.min(size).alias("low"), F.max(size).alias("high"), F.count_distinct(size).alias("dimensions")
    )


@query(
    """select a.doc_id as left_id, b.doc_id as right_id, case when len(a.t) + len(b.t) = 0 then 0.0
  else round(len(list_intersect(a.t, b.t))::double / len(list_distinct(list_concat(a.t, b.t))), 8) end as jaccard from """
    f"(select doc_id, list_distinct({tokens('text')}) as t from documents) a join (select doc_id, list_distinct({tokens('text')}) as t from documents) b on b.doc_id = a.doc_id + 1"
)
def jaccard_pairs(spark, sf_dir):
    """Each document against the next one."""
    t = documents(spark, sf_dir).select("doc_id", F.array_distinct(text.tokenize(F.col("text"))).alias("t"))
    right = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u"))
    pair = t.join(right, "doc_id")
    return pair.select(F.col("doc_id").alias("left_id"), (F.col("doc_id") + 1).alias("right_id"), F.round(arrays.jaccard(F.col("t"), F.col("u")), 8).alias("jaccard"))


@query(
    """select source, list_sort(list(n_chars))[len(list(n_chars)) // 2 + 1] as median_chars, max(n_chars) as max_chars from documents group by source"""
)
def upper_median(spark, sf_dir):
    """By counting, in bins that narrow; no group is gathered."""
    d = documents(spark, sf_dir)
    top = d.groupBy("source").agg(F.max("n_chars").alias("max_chars"))
    return evaluate.upper_medians(d, ["source"], "n_chars", "median_chars").join(top, "source").select("source", "median_chars", "max_chars")


_REPLY = """case conv_id % 4 when 0 then '{"type":"single","question_text":"","statements":[{"id":"a","text":"b"}]}'
 when 1 then chr(96)||chr(96)||chr(96)||'json'||chr(10)||'{"type":"multiple_statements","question_text":" stem ","statements":[{"text":" one "},{"id":"X","text":"two"}]}'||chr(10)||chr(96)||chr(96)||chr(96)
 when 2 then '{"type":"multiple_statements","statements":[{"text":"one"}]}' else 'no json' end"""


@query(
    f"""with r as (select conv_id, turn, trim(text) as fallback, trim(regexp_replace(replace({_REPLY}, chr(96)||chr(96)||chr(96), ''), '^json', '')) as body
  from conversations),
j as (select *, try_cast(body as json) as v from r),
s as (select *, v->>'$.type' as kind, coalesce(nullif(trim(v->>'$.question_text'), ''), fallback) as question_text,
  coalesce(json_array_length(v->'$.statements'), 0) as n from j)
select conv_id, turn, case when kind is null then null when kind <> 'single' and n < 2 then null else kind end as kind,
  case when kind is null or (kind <> 'single' and n < 2) then null else question_text end as question_text,
  case when kind is null or (kind <> 'single' and n < 2) then null when kind = 'single' then '' else
    coalesce(v->>'$.statements[0].id', 'S1') || ':' || trim(v->>'$.statements[0].text') || '|' || coalesce(v->>'$.statements[1].id', 'S2') || ':' || trim(v->>'$.statements[1].text') end as statements,
  case when v is null then 'invalid JSON' when kind <> 'single' and n < 2 then 'too few statements' end as error from s"""
)
def structure_parse(spark, sf_dir):
    """Four kinds of model reply, dealt over all turns: single, fenced list, short list, no JSON."""
    fence = "```json\n" + '{"type":"multiple_statements","question_text":" stem ","statements":[{"text":" one "},{"id":"X","text":"two"}]}' + "\n```"
    replies = [
        '{"type":"single","question_text":"","statements":[{"id":"a","text":"b"}]}',
        fence,
        '{"type":"multiple_statements","statements":[{"text":"one"}]}',
        "no json",
    ]
    reply = F.element_at(F.array(*[F.lit(x) for x in replies]), (F.col("conv_id") % 4 + 1).cast("int"))
    value, error = parse_structure(reply, F.col("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", value.alias("v"), error.alias("error"))
    listed = F.array_join(F.transform("v.statements", lambda s: F.concat(s["id"], F.lit(":"), s["text"])), "|")
    return rows.select("conv_id", "turn", F.col("v.type").alias("kind"), F.col("v.question_text").alias("question_text"), listed.alias("statements"), "error")
