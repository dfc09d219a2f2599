"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, embeddings, langid, licenses, lmscore, minhash, mix, pages, pieces, quality, ranking, secrets, whitening
from .common import table


def op10_minmax_near_duplicates(spark, sf_dir):
    """Near-duplicate groups of all documents, four-word shingles, similarity 0.8 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, percent=80)


def op1_page_differencing(spark, sf_dir):
    """The main text of every page."""
    return pages.main_text(table(spark, sf_dir, "pages"))


def op2_sentence_rule_licenses(spark, sf_dir):
    """Licences of every whole text, and its known licence sentences in order."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.array_join("sentences", ",").alias("sentences"))


def op3_simhash_leaks(spark, sf_dir):
    """Benchmark items that documents hold, with the best window of each."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_linked_secrets(spark, sf_dir):
    """Secrets in every whole text, certain ones and linked parts."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == secrets.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.as_text(F.col("base")), 256).alias("base_sha256"), secrets.as_text(F.col("spans")).alias("spans"))


def op5_stupid_backoff_scores(spark, sf_dir):
    """The score of every document under the trigram counts of all others."""
    found = lmscore.scores(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round(F.col("log_score") / F.nullif(F.col("n_words"), F.lit(0)), 6).alias("mean_score"))


def op6_apportioned_mix(spark, sf_dir):
    """The words that a mix by weights 5, 2, 1 takes of every document."""
    return mix.mix(table(spark, sf_dir, "documents"))


def op7_kneser_ney_language(spark, sf_dir):
    """The language of every whole text by Kneser-Ney character models."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_ordinal_quality(spark, sf_dir):
    """Expected grade of every document, its chance of the best grade, and whether it is kept."""
    return quality.graded(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_tiled_embedding_duplicates(spark, sf_dir):
    """All links of cosine 0.9 or more between embeddings, as counts and components."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op11_max_tree_search(spark, sf_dir):
    """The 50 best documents of each benchmark item."""
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_agenda_pieces(spark, sf_dir):
    """Ids of every whole text by a public vocabulary, and what they decode to, as digests."""
    import public_tokenizers

    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_upper_triangle_whitening(spark, sf_dir):
    """Whitened leading components of every vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def pipeline(spark, sf_dir):
    """All stages of the corpus pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_page_differencing": op1_page_differencing,
    "op2_sentence_rule_licenses": op2_sentence_rule_licenses,
    "op3_simhash_leaks": op3_simhash_leaks,
    "op7_kneser_ney_language": op7_kneser_ney_language,
    "op8_ordinal_quality": op8_ordinal_quality,
    "op9_tiled_embedding_duplicates": op9_tiled_embedding_duplicates,
    "op4_linked_secrets": op4_linked_secrets,
    "op5_stupid_backoff_scores": op5_stupid_backoff_scores,
    "op6_apportioned_mix": op6_apportioned_mix,
    "op10_minmax_near_duplicates": op10_minmax_near_duplicates,
    "op11_max_tree_search": op11_max_tree_search,
    "op12_agenda_pieces": op12_agenda_pieces,
    "op13_upper_triangle_whitening": op13_upper_triangle_whitening,
}

ORACLE_SQL = {"op2_sentence_rule_licenses": licenses.oracle()}

ORACLE_SQL["op10_minmax_near_duplicates"] = r"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), sets as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s
  from words
), classes as (
  select list_sort(s) as s, min(doc_id) as rep, len(s) as n from sets where len(s) > 0 group by list_sort(s), len(s)
), reps as (
  select rep, n, unnest(s) as g from classes
), pairs as (
  select x.rep as a, y.rep as b, count(*) as shared, any_value(x.n) as na, any_value(y.n) as nb
  from reps x join reps y on x.g = y.g and x.rep < y.rep and 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  group by x.rep, y.rep
), links as (
  select a, b from pairs where 100 * shared >= 80 * (na + nb - shared)
  union all
  select c.rep, s.doc_id from sets s join classes c on list_sort(s.s) = c.s where s.doc_id <> c.rep
), ends as (
  select a, b from links union select b, a from links
), reach(doc_id, other) as (
  select doc_id, doc_id from sets
  union
  select r.doc_id, e.b from reach r join ends e on r.other = e.a
)
select s.doc_id, len(s.s)::bigint as n_shingles, min(r.other) as component_id, min(r.other) = s.doc_id as kept
from sets s join reach r on s.doc_id = r.doc_id group by s.doc_id, len(s.s)
"""

ORACLE_SQL["op6_apportioned_mix"] = r"""
with sized as (
  select doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::bigint as size, md5('mix:' || coalesce(doc_id::varchar, md5(text), '')) as key from documents
), named as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as nth from sized group by source
), capped as (
  select *, 3.0::double * source_size as cap, [5.0, 2.0, 1.0][((nth - 1) % 3 + 1)::int]::double as w, sum(source_size) over ()::double as total from named
), levels as (
  select *, (total - coalesce(sum(cap) over up, 0)) / (sum(w) over () - coalesce(sum(w) over up, 0)) as level
  from capped window up as (order by cap / w, nth rows between unbounded preceding and 1 preceding)
), targets as (
  select *, case when cap / w <= level then cap else w * (select l.level from levels l where l.cap / l.w > l.level order by l.cap / l.w, l.nth limit 1) end as target,
    round(total / 16)::bigint as seats
  from levels
), ranked as (
  select source, row_number() over (order by target / (2 * k - 1) desc, source nulls last, k) as place, seats from (select *, unnest(range(1, seats + 1)) as k from targets)
), quotas as (
  select t.source, t.source_size, t.target, (select count(*) from ranked r where r.source is not distinct from t.source and r.place <= r.seats) as blocks from targets t
), laid as (
  select s.doc_id, s.source, s.size, q.source_size, q.target, q.blocks, s.key,
    ('0x' || substr(s.key, 1, 8))::bigint % greatest(1, ceil(q.source_size / 1048576))::bigint as shard
  from sized s join quotas q on s.source is not distinct from q.source
), shards as (
  select source, shard, blocks, sum(size)::bigint as shard_size from laid group by all
), places as (
  select source, shard, row_number() over (partition by source order by shard_size / (2 * k - 1) desc, shard, k) as place, blocks
  from (select *, unnest(range(1, blocks + 1)) as k from shards where shard_size > 0)
), filled as (
  select s.source, s.shard, s.shard_size, least(3 * s.shard_size, 16 * (select count(*) from places p where p.source is not distinct from s.source and p.shard = s.shard and p.place <= p.blocks)) as quota from shards s
), ordered as (
  select l.*, f.shard_size, f.quota, case when f.shard_size > 0 then f.quota // f.shard_size else 0 end as times,
    coalesce(sum(l.size) over (partition by l.source, l.shard order by l.key, l.doc_id, l.size rows between unbounded preceding and 1 preceding), 0) as before
  from laid l join filled f on l.source is not distinct from f.source and l.shard = f.shard
)
select doc_id, source, size, source_size, target, (times * size + greatest(0, least(size, quota - times * shard_size - before)))::bigint as taken from ordered
"""


def _secret_spans_sql() -> str:
    """DuckDB spans of one kind: list of {start, kind, end}, from the pieces between the matches."""
    kinds = []
    for n, kind in enumerate(secrets.KINDS):
        pattern = secrets.PATTERNS[kind].replace("'", "''")
        keep = "true"
        if kind == "assign":
            keep = f"length(v[i]) >= {secrets.ASSIGN_LEAST}"
        if kind == "weak":
            keep = "regexp_matches(m[i], '[0-9]') and regexp_matches(m[i], '[A-Za-z]')"
        value = f"regexp_extract_all(t, '{pattern}', 2)" if kind == "assign" else "[]"
        kinds.append(f"""
  select n, {n} as kind, s + length(m[i]) as "end", s as start from (
    select n, m, v, i, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::bigint as s
    from (select *, unnest(range(1, len(m) + 1)) as i from (
      select n, regexp_extract_all(t, '{pattern}') as m, {value} as v, string_split_regex(t, '{pattern}') as p from texts where regexp_matches(t, '{pattern}')))
  ) where {keep}""")
    return "\n  union all".join(kinds)


ORACLE_SQL["op4_linked_secrets"] = rf"""
with texts as (
  select row_number() over () as n, doc_id, coalesce(text, '') as t from documents
), raw as ({_secret_spans_sql()}
), base as (
  select * from raw where kind < 3
), endpoints as (
  select * from raw r where kind = 5 and not exists (from base b where b.n = r.n and r.start < b."end" and b.start < r."end")
), idents as (
  select * from raw r where kind = 3 and not exists (from base b where b.n = r.n and r.start < b."end" and b.start < r."end")
), certain as (
  from base union all from endpoints union all from idents
), parts as (
  select *, case kind when 0 then 's' when 1 then 'i' when 2 then 's' when 3 then 'i' when 4 then 's' else 'e' end as role,
    (select len(string_split_regex(t[1:start], '\n[\x20\t]*\r?\n')) from texts where texts.n = c.n) as scope
  from (
    from certain
    union all
    select * from raw r where kind = 4 and not exists (from certain b where b.n = r.n and r.start < b."end" and b.start < r."end")
  ) c
), added as (
  select x.n, x.kind, x."end", x.start from parts x
  where x.kind >= 3 and exists (from parts y where y.n = x.n and y.scope = x.scope
    and x.role <> y.role and (x.role = 's' or y.role = 's'))
), named as (
  select *, ['assign', 'access', 'hex', 'ident', 'weak', 'endpoint'][kind + 1] || ':' || start || ':' || "end" as label from (from base union all from added)
)
select any_value(t.doc_id) as doc_id,
  count(*) filter (kind = 0)::bigint as n_assign, count(*) filter (kind = 1)::bigint as n_access, count(*) filter (kind = 2)::bigint as n_hex,
  sha256(coalesce(string_agg(label, ',' order by start, kind) filter (kind < 3), '')) as base_sha256,
  coalesce(string_agg(label, ',' order by start, kind), '') as spans
from texts t left join named on t.n = named.n group by t.n
"""


ORACLE_SQL["op9_tiled_embedding_duplicates"] = r"""
with recursive vectors as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select x.vec_id as a, y.vec_id as b from vectors x join vectors y on x.vec_id <> y.vec_id and len(x.e) = len(y.e)
  where list_cosine_similarity(x.e, y.e) >= 0.9
), reach(vec_id, other) as (
  select vec_id, vec_id from embeddings
  union
  select r.vec_id, l.b from reach r join links l on r.other = l.a
)
select v.vec_id, (select count(*) from links l where l.a = v.vec_id)::bigint as n_links, min(r.other) as component_id, min(r.other) = v.vec_id as kept
from embeddings v join reach r on v.vec_id = r.vec_id group by v.vec_id
"""


ORACLE_SQL["op3_simhash_leaks"] = r"""
with words as (
  select doc_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents where text is not null
), items as (
  select item_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from benchmark
), held as (
  select doc_id, len(w) as n_words, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) as s from words where len(w) >= 5
), asked as (
  select item_id, len(w) as n_words, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) as t from items where len(w) >= 5
), seeds as (
  select distinct d.doc_id, d.pos, a.item_id from (select doc_id, unnest(s) as g, generate_subscripts(s, 1) as pos from held) d
  join (select item_id, unnest(t) as g from asked) a on d.g = a.g
), windows as (
  select distinct s.doc_id, s.item_id, unnest(range(greatest(1, s.pos - len(a.t) + 1), least(s.pos, len(h.s) - len(a.t) + 1) + 1)) as start
  from seeds s join asked a on s.item_id = a.item_id join held h on s.doc_id = h.doc_id
), shared as (
  select w.doc_id, w.item_id, w.start, a.n_words, len(a.t) as n,
    list_sum(list_transform(list_distinct(a.t), lambda g: least(len(list_filter(a.t, lambda x: x = g)), len(list_filter(h.s[w.start:w.start + len(a.t) - 1], lambda x: x = g))))) as c
  from windows w join asked a on w.item_id = a.item_id join held h on w.doc_id = h.doc_id
), scored as (
  select *, c / (2 * n - c)::double as similarity, row_number() over (partition by doc_id, item_id order by c desc, start) as place from shared
)
select doc_id, item_id, similarity, (start - 1)::bigint as start_word, n_words::bigint as n_words from scored where place = 1 and similarity >= 0.8
"""


ORACLE_SQL["op5_stupid_backoff_scores"] = r"""
with texts as (
  select row_number() over () as r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), places as (
  select r, unnest(range(1, len(w) + 1)) as i, len(w) as size, w from texts
), grams as (
  select r, i, size, w[i] as g1, case when i > 1 then w[i - 1] || ' ' || w[i] end as g2, case when i > 2 then w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] end as g3 from places
), own1 as (select r, g1, count(*) as n from grams group by all), all1 as (select g1, sum(n) as n from own1 group by all
), own2 as (select r, g2, count(*) as n from grams where g2 is not null group by all), all2 as (select g2, sum(n) as n from own2 group by all
), own3 as (select r, g3, count(*) as n from grams where g3 is not null group by all), all3 as (select g3, sum(n) as n from own3 group by all
), others as (
  select g.r, g.i, g.size, a1.n - o1.n as c1, a2.n - o2.n as c2, a3.n - o3.n as c3, (select sum(n) from all1) as total
  from grams g join own1 o1 on g.r = o1.r and g.g1 = o1.g1 join all1 a1 on g.g1 = a1.g1
  left join own2 o2 on g.r = o2.r and g.g2 = o2.g2 left join all2 a2 on g.g2 = a2.g2
  left join own3 o3 on g.r = o3.r and g.g3 = o3.g3 left join all3 a3 on g.g3 = a3.g3
), before as (
  select *, lag(c1) over (partition by r order by i) as b1, lag(c2) over (partition by r order by i) as b2 from others
), one as (
  select *, greatest(c1, 0.5)::double / greatest(1, total - size) as s1 from before
), two as (
  select *, case when i < 2 then s1 when c2 > 0 then c2::double / b1 else 0.4::double * s1 end as s2 from one
), three as (
  select r, ln(case when i < 3 then s2 when c3 > 0 then c3::double / b2 else 0.4::double * s2 end) as s3 from two
), summed as (
  select r, count(*) as n_words, sum(s3) as log_score from three group by r
)
select t.doc_id, coalesce(s.n_words, 0)::bigint as n_words, round(coalesce(s.log_score, 0), 4) as log_score, round(s.log_score / s.n_words, 6) as mean_score
from texts t left join summed s on t.r = s.r
"""


ORACLE_SQL["op11_max_tree_search"] = r"""
with texts as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents where text is not null
), held as (
  select r, doc_id, len(w) as n, w from texts where len(w) > 0
), whole as (
  select count(*) as docs, sum(n)::bigint as words from held
), asked as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark
), postings as (
  select r, any_value(doc_id) as doc_id, any_value(n) as n, t, count(*) as tf from (select r, doc_id, n, unnest(w) as t from held) where t in (select t from asked) group by r, t
), weights as (
  select t, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)))::bigint as w from postings, whole group by t
), scored as (
  select a.item_id, p.r, any_value(p.doc_id) as doc_id, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * p.n * docs) // words))))::bigint as score
  from asked a join postings p on a.t = p.t join weights w on p.t = w.t, whole group by a.item_id, p.r
), ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from scored where score > 0
)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 50
"""
