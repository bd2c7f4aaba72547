"""The opN_ queries and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import Scratch, crc_bucket, table


def op1_pfair_mix(spark, sf_dir):
    from .mixing import mix

    return mix(spark, table(spark, sf_dir, "documents"))


def op2_site_templates(spark, sf_dir):
    from .html import extract

    return extract(spark, table(spark, sf_dir, "pages"))


def op3_toxic_segments(spark, sf_dir):
    from .toxicity import toxicity

    held = crc_bucket("doc_id", 3) == 1
    out = toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held)
    out = Scratch(spark, "toxicity").save(out, "scores")  # written with small batches of texts
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted", "n_tokens", F.size("passages").alias("n_passages"))


def op4_cross_parsing(spark, sf_dir):
    from .language import identify

    held = crc_bucket("doc_id", 4) == 2
    out = identify(spark, table(spark, sf_dir, "documents"), ~held)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_symbols", "n_phrases")


def op5_nbest_pieces(spark, sf_dir):
    from .pieces import segment

    return Scratch(spark, "pieces").save(segment(spark, table(spark, sf_dir, "documents")), "pieces")


def op6_sorted_projections(spark, sf_dir):
    from .neardup_vectors import near_duplicates

    return near_duplicates(spark, table(spark, sf_dir, "embeddings"))


def op7_size_aware_join(spark, sf_dir):
    from .jaccard import jaccard_classes

    return jaccard_classes(spark, table(spark, sf_dir, "documents"))


def op8_transport_stream(spark, sf_dir):
    from .transport import media_column

    return media_column(spark, table(spark, sf_dir, "documents"))


def op9_sampled_splitters(spark, sf_dir):
    from .sharding import shard

    return shard(spark, table(spark, sf_dir, "documents"))


def op10_co_training(spark, sf_dir):
    from .quality import quality

    held = crc_bucket("doc_id", 5) == 0
    out = quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held)
    return out.withColumn("held_out", F.coalesce(held, F.lit(False)))


def op11_prefix_trie(spark, sf_dir):
    from .prefix_trie import rebuilt_trie

    return rebuilt_trie(spark, table(spark, sf_dir, "conversations")).digests()


def op12_maxscore(spark, sf_dir):
    from .maxscore import every_nth, search

    vectors = table(spark, sf_dir, "embeddings")
    return search(spark, every_nth(vectors), vectors)


QUERIES = {
    f.__name__: f
    for f in (
        op1_pfair_mix,
        op2_site_templates,
        op3_toxic_segments,
        op4_cross_parsing,
        op5_nbest_pieces,
        op6_sorted_projections,
        op7_size_aware_join,
        op8_transport_stream,
        op9_sampled_splitters,
        op10_co_training,
        op11_prefix_trie,
        op12_maxscore,
    )
}

# The pages at hand have one shape: an article of headings and paragraphs, cut off in some. For
# that shape SQL can say what the main text is; other markup is covered by tests.
_REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&nbsp;", " "))
_BLOCK = r"regexp_replace(regexp_replace(b, '<br\s*/?>', ' ', 'g'), '<[^>]*>|<[^>]*\z', '', 'g')"
for _name, _value in _REFERENCES:
    _BLOCK = f"replace({_BLOCK}, '{_name}', '{_value}')"
_BLOCK = rf"trim(regexp_replace(regexp_replace({_BLOCK}, '&amp;?', '&', 'g'), '\s+', ' ', 'g'))"

ORACLE_SQL: dict[str, str] = {
    "op2_site_templates": rf"""with t as (
  select page_id, url, array_to_string(list_filter(list_transform(
    string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|\z)', 1), '</?(?:p|h1)\b[^>]*>'), lambda b: {_BLOCK}), lambda b: b <> ''), chr(10) || chr(10)) as text
  from pages)
select page_id, url, text, length(text) as n_chars from t""",
    # all pairs that share a shingle, and the transitive closure of the links
    "op7_size_aware_join": r"""with recursive
w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as sh from w),
e as (select doc_id, len(sh) as n, unnest(sh) as g from s),
pairs as (select a.doc_id as x, b.doc_id as y, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select x, y from pairs where 100 * c >= 80 * (na + nb - c) union all select y, x from pairs where 100 * c >= 80 * (na + nb - c)),
reach(a, b) as (select x, y from links union select r.a, l.y from reach r join links l on r.b = l.x)
select s.doc_id, len(s.sh)::bigint as n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) as component_id from s left join reach r on r.a = s.doc_id group by s.doc_id, s.sh""",
    # crc32 bit by bit; a prefix is the chain of its turns' digests
    "op11_prefix_trie": """with o as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos from conversations where conv_id is not null),
c as (select conv_id, (list_reduce([4294967295::bigint] || list_transform(range(8 * length(conv_id::varchar)), lambda k: case when k % 8 = 0 then 512 + ord(substr(conv_id::varchar, k // 8 + 1, 1)) else 0 end),
    lambda x, k: case when (xor(x, k & 255) & 1) = 1 then xor(xor(x, k & 255) >> 1, 3988292384) else xor(x, k & 255) >> 1 end)) as crc from (select distinct conv_id from o)),
h as (select conv_id, (4294967295 - crc) % 6 as h, conv_id - conv_id % 100 as leader from c),
r as (select h.conv_id, 0 as part, o.pos, o.role, o.text from h join o on o.conv_id = h.leader and o.pos <= h.h
  union all select h.conv_id, 1, o.pos, o.role, o.text from h join o on o.conv_id = h.conv_id and o.pos > h.h),
d as (select conv_id, length(text) as chars, sha256(length(role)::varchar || ':' || role || text) as x, row_number() over (partition by conv_id order by part, pos) as depth from r),
p as (select conv_id, depth, chars, string_agg(x, '') over (partition by conv_id order by depth) as path from d
  union all select conv_id, 0, 0, '' from h),
e as (select conv_id, max(depth) as len from p group by conv_id),
n as (select path, any_value(depth) as depth, any_value(chars) as chars, min(p.conv_id) as conv_id, count(*) as n_convs,
  sha256(coalesce(string_agg(p.conv_id::varchar, ',' order by p.conv_id) filter (where depth = len), '')) as ends_sha256 from p join e using (conv_id) group by path),
k as (select path[:-65] as path, count(*) as n from n where depth > 0 group by 1),
m as (select n.*, coalesce(k.n, 0) as n_children from n left join k using (path)),
s as (select a.path, count(*) filter (where b.n_children = 0) as n_leaves, sum((b.n_convs - 1) * b.chars) as saved from m a join m b on starts_with(b.path, a.path) group by a.path)
select m.conv_id, m.depth, u.conv_id as parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved::bigint as saved_tokens, m.ends_sha256
from m join s using (path) left join m u on m.depth > 0 and u.path = m.path[:-65]""",
    "op12_maxscore": """with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5""",
}
