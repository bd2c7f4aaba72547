"""Queries of caches, staleness, catalogs, samples and files."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..functions.text import citation_label, fingerprint, nfkc, normalize_search
from ..operators import bm25, dense, reports
from ..operators.answer import cached_scores
from ..sources import io
from ..store import scratch_folder, stored
from .base import ORACLE_SQL, TERMS, bm25_sql, questions, display, documents, query, search_form, table, tokens


class HashedWords:
    """A stand-in for a remote embedder: words counted by the first hex digits of their md5."""

    model = "hashed-words-16"

    def embed(self, texts):
        import hashlib
        import re

        out = []
        for t in texts:
            v = [0.0] * 16
            for w in re.findall(r"[0-9a-z]+", t.lower()):
                v[int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 16] += 1.0
            out.append(v)
        return out


def _held(spark, sf_dir):
    """A cache that holds every third document's text, under two models."""
    d = documents(spark, sf_dir).filter("doc_id % 3 = 0")
    model = F.when(F.col("doc_id") % 2 == 0, "m1").otherwise("m2")
    return d.select(model.alias("model"), fingerprint(F.col("text")).alias("fingerprint"))


@query(
    """with held as (select distinct sha256(text) as f from documents where doc_id % 3 = 0 and doc_id % 2 = 0)
select distinct sha256(text) as fingerprint, text from documents where sha256(text) not in (select f from held)"""
)
def cache_miss_anti(spark, sf_dir):
    return dense.cache_misses(documents(spark, sf_dir), _held(spark, sf_dir), "m1")


@query(
    """with w as (select doc_id, sha256(text) as fingerprint, unnest(regexp_extract_all(lower(text), '[0-9a-z]+')) as w from documents),
n as (select doc_id, fingerprint, ('0x' || substr(md5(w), 1, 4))::int % 16 as i, count(*)::double as x from w group by all)
select doc_id, fingerprint, i::int as i, round(x / sqrt(sum(x * x) over (partition by doc_id)), 9) as x from n"""
)
def embedding_cache_build(spark, sf_dir):
    """Misses embedded by a provider in batches, joined back to every document by fingerprint; components that aren't 0."""
    d = documents(spark, sf_dir)
    provider = HashedWords()
    empty = spark.createDataFrame([], dense.CACHE_SCHEMA)
    new = dense.embed_missing(dense.cache_misses(d, empty, provider.model), provider)
    return d.select("doc_id", fingerprint(F.col("text")).alias("fingerprint")).join(new, "fingerprint").select("doc_id", "fingerprint", F.posexplode("vector").alias("i", "x")).filter("x <> 0").withColumn("x", F.round("x", 9))


@query(ORACLE_SQL["embedding_cache_build"])
def embedding_cache_reuse(spark, sf_dir):
    """The index of all documents from a cache that a build over every other document has filled: only new texts are embedded."""
    d, path = documents(spark, sf_dir), f"{scratch_folder(spark)}/cache-{uuid4().hex}"
    dense.build(d.filter("doc_id % 2 = 0"), HashedWords(), path, batch_size=64)
    index = dense.build(d, HashedWords(), path, batch_size=64)
    return index.vectors.select("doc_id", "fingerprint", F.posexplode("vector").alias("i", "x")).filter("x <> 0").withColumn("x", F.round("x", 9))


@query("select source as book_id, 'Title ' || source as title from documents group by source")
def catalog_read(spark, sf_dir):
    """A catalog of all sources, written as one JSON object and loaded."""
    path = f"{scratch_folder(spark)}/catalog-{uuid4().hex}"
    entries = F.map_from_entries(F.collect_set(F.struct("source", F.concat(F.lit(" Title "), "source"))))
    documents(spark, sf_dir).agg(F.to_json(entries).alias("value")).write.text(path)
    return io.load_catalog(spark, path)


@query("select doc_id, case when doc_id % 10 = 0 then 'added' when doc_id % 10 = 1 then 'changed' else 'removed' end as kind from documents where doc_id % 10 < 3")
def stale_check(spark, sf_dir):
    """An index that lacks a tenth of the documents, has a tenth changed, and knows a tenth that is gone."""
    d = documents(spark, sf_dir)
    then = d.filter("doc_id % 10 <> 0").withColumn("text", F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    index = dense.DenseIndex("m1", then.select("doc_id", fingerprint(F.col("text")).alias("fingerprint")))
    return dense.stale(index, d.filter("doc_id % 10 <> 2"))


@query(
    f"""with {TERMS}, {bm25_sql(False, k=10)}
select d.doc_id, b.item_id, case when min(d.doc_id) over (partition by d.text, b.text) % 2 = 0 then 0.5 else round(abs(length(d.text) - length(b.text))::double / greatest(length(d.text), length(b.text)), 6) end as score
from bm join documents d using (doc_id) join benchmark b on b.item_id = bm.qid"""
)
def rerank_cache(spark, sf_dir):
    """Questions and the ten passages found for each: a scorer runs only for pairs that the score cache lacks (odd smallest ids)."""
    from ..functions.text import cache_key
    from .search import _index

    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    found = bm25.search(_index(spark, sf_dir), questions(spark, sf_dir), 10).select(F.col("qid").alias("item_id"), "doc_id")
    pairs = found.join(documents(spark, sf_dir).select("doc_id", F.col("text").alias("passage")), "doc_id").join(b, "item_id")
    pairs = stored(pairs.withColumn("cache_key", cache_key(F.lit("m"), F.col("question"), F.col("passage"))), "pairs")
    held = pairs.groupBy("cache_key").agg(F.min("doc_id").alias("least")).filter("least % 2 = 0").select("cache_key", F.lit(0.5).alias("score"))
    scored, _ = cached_scores(pairs, held, lambda qs, ps: [abs(len(p) - len(q)) / max(len(p), len(q)) for q, p in zip(qs, ps)])
    return scored.select("doc_id", "item_id", F.round("score", 6).alias("score"))


@query(
    """with cat as (select source, 'Title ' || source as title from documents where source <> 'src3' group by source)
select d.source as book_id, coalesce(title, 'Book ' || d.source) as book_title, count(*) as pages from documents d left join cat using (source) group by all"""
)
def catalog_left_join(spark, sf_dir):
    """Catalog title, else the book's own, for the list of books."""
    d = documents(spark, sf_dir)
    catalog = d.filter("source <> 'src3'").select("source", F.concat(F.lit("Title "), "source").alias("title")).distinct()
    books = d.groupBy("source").agg(F.count("*").alias("pages")).join(catalog, "source", "left")
    return books.select(F.col("source").alias("book_id"), F.coalesce("title", F.concat(F.lit("Book "), "source")).alias("book_title"), "pages")


@query("select lower(case when doc_id % 5 = 0 then 'Book' || doc_id // 10 else 'book' || doc_id end) as stem, count(*) as n from documents group by 1 having count(*) > 1")
def repeated_stems(spark, sf_dir):
    name = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Book"), (F.col("doc_id") / 10).cast("long").cast("string"))).otherwise(F.concat(F.lit("book"), F.col("doc_id").cast("string")))
    return io.repeated_stems(documents(spark, sf_dir).select(name.alias("book_id")))


@query("select count(distinct source) as n, array_to_string(list_sort(list(distinct source)), ',') as books from documents")
def book_list(spark, sf_dir):
    books = F.sort_array(F.collect_set("source"))
    return documents(spark, sf_dir).agg(F.count_distinct("source").alias("n"), F.array_join(books, ",").alias("books"))


@query(
    """select source, doc_id from (select source, doc_id, row_number() over (partition by source order by doc_id) - 1 as i, count(*) over (partition by source) as n from documents)
where n <= 5 or i in (0, n // 4, n // 2, 3 * n // 4, n - 1)"""
)
def sample_pages(spark, sf_dir):
    return reports.sample_pages(documents(spark, sf_dir).select("source", "doc_id"), "source", "doc_id")


@query(
    f"""with s as (select * from (select *, row_number() over (partition by source order by doc_id) - 1 as i, count(*) over (partition by source) as n from documents)
  where n <= 5 or i in (0, n // 4, n // 2, 3 * n // 4, n - 1)), p as (select source, doc_id, doc_id % 160 + 1 as page, {display('text')} as d from s)
select source as book_id, page::int as pdf_page, '| ' || source || ' | ' || page || ' | ' || page || ' | ' || 'Book ' || source || ' | ' || length(d) || ' | ' || len({tokens('d')}) || ' | 0 | ' ||
  case when length(d) < 80 and page not in (1, 3, 4, 5, 6, 7, 8, 9, 10, 150) then 'yes' else 'no' end || ' |' as row, trim(substring({search_form('d')}, 1, 500)) as excerpt from p"""
)
def extraction_review(spark, sf_dir):
    from .texts import _pages

    samples = reports.sample_pages(_pages(spark, sf_dir), "book_id", "doc_id")
    return reports.review_rows(io.page_rows(samples)).select("book_id", "pdf_page", "row", "excerpt")


@query(
    """select source, citation from (select distinct source, 'Title ' || source || '، صفحه ' || translate((n % 90 + 10)::varchar, '0123456789', '۰۱۲۳۴۵۶۷۸۹') as citation
from (select source, count(*) as n from documents group by source))"""
)
def book_citations(spark, sf_dir):
    n = documents(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    return n.select("source", citation_label(F.concat(F.lit("Title "), "source"), F.array(F.col("n") % 90 + 10)).alias("citation"))


@query(f"select doc_id, {search_form('text')} as search_text, lang, source from documents")
def jsonl_roundtrip(spark, sf_dir):
    """Rows written as compressed JSON lines and read again under a schema."""
    rows = documents(spark, sf_dir).select("doc_id", normalize_search(nfkc(F.col("text"))).alias("search_text"), "lang", "source")
    path = f"{scratch_folder(spark)}/jsonl-{uuid4().hex}"
    io.write_jsonl(rows, path, gzip=True)
    return io.read_jsonl(spark, path, rows.schema)
