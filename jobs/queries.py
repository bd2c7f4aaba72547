"""The jobs as queries: each runs twice into one new folder, and its whole output is read back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from jobs import build_chunks, index_upkeep
from textquarry.queries.base import TERMS, search_form
from textquarry.queries.chunks import _CHILDREN, _PARENTS, BOOK, PACKED, SEGMENTS
from textquarry.store import scratch_folder
from textquarry.streaming import upkeep


def _folder(spark, name: str) -> str:
    return f"{scratch_folder(spark)}/{name}-{uuid4().hex}"


def job1_build_chunks(spark, sf_dir):
    """Chunks of all documents, each beside the counts of its document in the manifest."""
    out = _folder(spark, "job1")
    for _ in range(2):
        build_chunks.run(spark, f"{sf_dir}/documents.parquet", out)
    chunks = spark.read.parquet(f"{out}/chunks").withColumn("group", F.col("group").cast("string"))
    cols = ["chunk_id", "parent_id", "group", "chapter_id", "text", "search_text", "token_count"]
    return chunks.select("book_id", *cols).join(build_chunks.read_manifest(spark, out), "book_id").select(*cols, "parents", "chunks", "tokens", "tokens_with_overlap")


def job2_index_upkeep(spark, sf_dir):
    """Postings of all documents, each beside the statistics of its term."""
    out = _folder(spark, "job2")
    for _ in range(2):
        index_upkeep.run(spark, f"{sf_dir}/documents.parquet", out)
    # terms of scopes are few beside postings, which need not be sorted then
    stats = upkeep.statistics(spark, out).withColumnRenamed("scope", "_scope").withColumnRenamed("term", "_term").hint("shuffle_hash")
    found = upkeep.load(spark, out).postings.join(stats, F.col("scope").eqNullSafe(F.col("_scope")) & (F.col("term") == F.col("_term")))
    return found.select("scope", "doc_id", "term", "tf", "dl", "df", "cf")


QUERIES = {f.__name__: f for f in (job1_build_chunks, job2_index_upkeep)}

ORACLE_SQL = {
    "job1_build_chunks": f"""with recursive {SEGMENTS}, {PACKED}, {_PARENTS}, {_CHILDREN},
pc as (select doc_id, count(*) as parents, sum(token_count)::bigint as tokens from par group by doc_id),
cc as (select doc_id, count(*) as chunks, sum(token_count)::bigint as tokens_with_overlap from chi group by doc_id)
select {BOOK} || printf(':chunk-%04d', row_number() over (partition by doc_id order by parent_no, child_group)) as chunk_id, {BOOK} || printf(':parent-%04d', parent_no) as parent_id,
  source as "group", lang as chapter_id, c.text, {search_form('c.text')} as search_text, token_count, parents, chunks, tokens, tokens_with_overlap
from chi c join documents using (doc_id) join pc using (doc_id) join cc using (doc_id)""",
    "job2_index_upkeep": f"""with {TERMS} select scope, doc_id, term, tf, dl::int as dl, count(*) over (partition by scope, term) as df, (sum(tf) over (partition by scope, term))::bigint as cf from postings""",
}
