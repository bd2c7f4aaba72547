"""Registration of queries and the SQL fragments that oracles share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import FOLD_FROM, FOLD_TO

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as questions; their scope is one of the twenty sources, dealt by id."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("qid"), "text", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("scope"))


# -- DuckDB fragments ---------------------------------------------------------------

_MARKS = r"[\x{064b}-\x{065f}\x{0670}\x{06d6}-\x{06ed}]"
_SEPARATORS = r"[^0-9A-Za-z\x{0600}-\x{06ff}+\-.]+"
_TOKEN = r"[0-9A-Za-z\x{0600}-\x{06ff}]+(?:[+\-.][0-9A-Za-z\x{0600}-\x{06ff}]+)*"


def fold(x: str) -> str:
    return f"translate(coalesce({x}, ''), '{FOLD_FROM}', '{FOLD_TO}')"


def display(x: str) -> str:
    t = rf"regexp_replace(regexp_replace({fold(x)}, '\r\n?', chr(10), 'g'), '[ \t\f\x0B]+', ' ', 'g')"
    return rf"regexp_replace(regexp_replace({t}, '\s*\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def search_form(x: str) -> str:
    return f"lower(trim(regexp_replace(regexp_replace({fold(x)}, '{_MARKS}', '', 'g'), '{_SEPARATORS}', ' ', 'g')))"


def tokens(x: str) -> str:
    return f"regexp_extract_all({search_form(x)}, '{_TOKEN}')"


QUESTIONS = "questions as (select item_id as qid, text, 'src' || (item_id % 20) as scope from benchmark)"
TERMS = f"""
terms as materialized (select source as scope, doc_id, {tokens('text')} as toks from documents),
doc_stats as (select scope, doc_id, len(toks) as dl from terms),
postings as materialized (select scope, doc_id, term, count(*) as tf, any_value(dl) as dl
  from (select scope, doc_id, len(toks) as dl, unnest(toks) as term from terms) group by all),
{QUESTIONS},
qterms as (select qid, scope, term, count(*) as qtf from (select qid, scope, unnest({tokens('text')}) as term from questions) group by all)
"""


def bm25_sql(scoped: bool, name: str = "bm", k: int = 30) -> str:
    """CTEs that end in ``name`` (qid, doc_id, score, rank)."""
    on = "p.term = q.term" + (" and p.scope = q.scope" if scoped else "")
    keys = "scope, term" if scoped else "term"
    stats = "join (select scope, count(*) as n, avg(dl) as avgdl from doc_stats group by scope) s on s.scope = q.scope" if scoped else (
        "cross join (select count(*) as n, avg(dl) as avgdl from doc_stats) s"
    )
    return f"""
{name}_df as (select {keys}, count(*) as df from postings group by {keys}),
{name}_raw as (
  select q.qid, p.doc_id, sum(q.qtf * ln(1.0 + (s.n - d.df + 0.5) / (d.df + 0.5)) * (p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / s.avgdl)))) as score
  from qterms q {stats} join postings p on {on} join {name}_df d on d.term = q.term {'and d.scope = q.scope' if scoped else ''}
  group by q.qid, p.doc_id),
{name} as materialized (select qid, doc_id, round(score, 6) as score, rank from (
  select *, row_number() over (partition by qid order by round(score, 9) desc, doc_id) as rank from {name}_raw) where rank <= {k})
"""


UNIT = """
vec as (select vec_id as doc_id, cast(label as varchar) as scope,
  list_transform(v, lambda x: case when n = 0 then x else x / n end) as v
  from (select vec_id, label, v, sqrt(list_dot_product(v, v)) as n from (select vec_id, label, embedding::double[] as v from embeddings)))
"""


def dense_sql(scoped: bool, name: str = "dn", k: int = 30) -> str:
    on = "q.qid = qq.doc_id"
    allowed = "where v.scope = q.scope" if scoped else ""
    return f"""
{name}_raw as (select q.qid, v.doc_id, list_dot_product(qq.v, v.v) as score
  from (select item_id as qid, cast(item_id % 10 as varchar) as scope from benchmark) q join vec qq on {on} cross join vec v {allowed}),
{name} as materialized (select qid, doc_id, round(score, 8) as score, rank from (
  select *, row_number() over (partition by qid order by round(score, 9) desc, doc_id) as rank from {name}_raw) where rank <= {k})
"""


def minmax_sql(x: str) -> str:
    lo, hi = f"min({x}) over (partition by qid)", f"max({x}) over (partition by qid)"
    return f"coalesce(case when {x} is null then null when {hi} = {lo} then 1.0 else ({x} - {lo}) / ({hi} - {lo}) end, 0.0)"


BASE = {
    "hybrid": "0.36 * dense_norm + 0.32 * bm25_norm + 0.22 * rrf_norm + 0.10 * coverage",
    "dense": "0.85 * dense_norm + 0.15 * coverage",
    "bm25": "0.85 * bm25_norm + 0.15 * coverage",
}


def fused_sql(mode: str) -> str:
    """CTEs from bm and/or dn to ``cand`` (qid, doc_id, base, terms and parts)."""
    sides = []
    if mode != "dense":
        sides.append("select qid, doc_id, score as bm25, null::double as dense, 1.0::double / (60 + rank) as rrf from bm")
    if mode != "bm25":
        sides.append("select qid, doc_id, null::double as bm25, score as dense, 1.0::double / (60 + rank) as rrf from dn")
    return f"""
fused as (select qid, doc_id, max(bm25) as bm25, max(dense) as dense, sum(rrf) as rrf from ({' union all '.join(sides)}) group by all),
asked as (select qid, list_distinct({tokens('text')}) as q_terms from questions),
held as (select doc_id, list_distinct(toks) as terms from terms),
scaled as (select *, {minmax_sql('bm25')} as bm25_norm, {minmax_sql('dense')} as dense_norm, {minmax_sql('rrf')} as rrf_norm from fused),
normed as (select f.*, {minmax_sql('bm25')} as bm25_norm, {minmax_sql('dense')} as dense_norm, {minmax_sql('rrf')} as rrf_norm, h.terms, case when len(q_terms) = 0 then 0.0 else len(list_intersect(q_terms, terms)) / len(q_terms)::double end as coverage
  from fused f join held h using (doc_id) join asked using (qid)),
cand as materialized (select *, {BASE[mode]} as base from normed)
"""


def mmr_sql(k: int = 5, penalty: float = 0.12) -> str:
    """CTEs from cand to ``chosen`` (qid, doc_id, rank, diversified), one greedy round after the other.

    Terms of candidates become numbers and meet once, which gives the similarity of all
    pairs of a question's candidates; the rounds look it up.
    """
    out = [
        "cand_terms as materialized (select qid, doc_id, dense_rank() over (order by term) as term from (select qid, doc_id, unnest(terms) as term from cand))",
        "cand_sizes as (select qid, doc_id, len(terms) as n from cand)",
        "shared as (select a.qid, a.doc_id as x, b.doc_id as y, count(*) as n from cand_terms a join cand_terms b on a.qid = b.qid and a.term = b.term and a.doc_id <> b.doc_id group by all)",
        "alike as materialized (select shared.qid, x, y, shared.n::double / (a.n + b.n - shared.n) as jac from shared join cand_sizes a on a.qid = shared.qid and a.doc_id = x join cand_sizes b on b.qid = shared.qid and b.doc_id = y)",
        "r0 as materialized (select qid, doc_id, base, 0.0::double as red from cand)",
    ]
    for i in range(1, k + 1):
        out.append(
            f"p{i} as materialized (select * from (select *, base - {penalty} * red as div, row_number() over (partition by qid order by "
            f"round(base - {penalty} * red, 12) desc, round(base, 12) desc, doc_id) as rn from r{i - 1}) where rn = 1)"
        )
        out.append(
            f"r{i} as materialized (select c.qid, c.doc_id, c.base, greatest(c.red, coalesce(jac, 0.0)) as red from r{i - 1} c join p{i} s on c.qid = s.qid and c.doc_id <> s.doc_id "
            f"left join alike on alike.qid = c.qid and x = c.doc_id and y = s.doc_id)"
        )
    parts = " union all ".join(f"select qid, doc_id, {i} as rank, round(div, 8) as diversified from p{i}" for i in range(1, k + 1))
    out.append(f"chosen as ({parts})")
    return ",\n".join(out)
