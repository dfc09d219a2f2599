"""Registered queries: the library's operators on the supplied star-schema tables, with the same in DuckDB's SQL.

The tables stand in for catalogues: customers, orders and parts for records of systems, line items for tracks.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from discoforge.functions import languages, text, values
from discoforge.operators import keys, rollups, search, validation, writes
from discoforge.plans import audio, presence, replicate
from discoforge.sources import sheets

from .registry import query, t

LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_ORDER = ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
LINE_ORDER_SQL = ", ".join(LINE_ORDER)


@query("""
with members as (select 'g' || c_custkey // 50 as grp, c_custkey as k, c_name as title, c_mktsegment as artist from customer),
buyers as (select 'g' || o_custkey // 50 as grp, o_custkey as k, max(o_orderpriority) as title, count(*) as n from orders group by o_custkey),
movers as (select 'g' || o_custkey // 50 as grp, o_custkey as k, max(l_returnflag) as title, count(*) as n from orders join lineitem on o_orderkey = l_orderkey group by o_custkey),
every as (select coalesce(m.grp, b.grp, v.grp) as grp, coalesce(m.k, b.k, v.k) as k, coalesce(m.title, b.title, v.title) as title, m.artist,
  coalesce(b.n, v.n) as sequence_no, m.k is not null as in_members, b.k is not null as in_buyers, v.k is not null as in_movers,
  m.k::varchar as members_id, b.k::varchar as buyers_id, v.k::varchar as movers_id,
  case when m.k is not null then 0 when b.k is not null then 1 else 2 end as rnk
  from members m full join buyers b on m.k = b.k full join movers v on coalesce(m.k, b.k) = v.k)
select grp as "group", 'C' || k as key, 'C' || k as isrc, title, artist, sequence_no::bigint as sequence_no, null::varchar as filename, in_members, in_buyers, in_movers, members_id, buyers_id, movers_id,
  row_number() over (partition by grp order by coalesce(sequence_no, 999), rnk, k)::int as position from every
""")
def presence_matrix_by_key(spark, sf_dir):
    """Customers, customers with orders and customers with line items, joined by code."""
    group = lambda c: F.concat(F.lit("g"), F.floor(F.col(c) / 50).cast("string")).alias("group")
    code = lambda c: F.concat(F.lit("c"), F.col(c).cast("string")).alias("isrc")
    none = F.lit(None).cast("string")
    customer, orders = t(spark, sf_dir, "customer"), t(spark, sf_dir, "orders")
    members = customer.select(group("c_custkey"), code("c_custkey"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("artist"), F.lit(None).cast("long").alias("sequence_no"), none.alias("filename"), F.col("c_custkey").cast("string").alias("record_id"), F.col("c_custkey").alias("ord"))
    side = lambda df, title: df.groupBy("o_custkey").agg(F.max(title).alias("title"), F.count("*").alias("sequence_no")).select(group("o_custkey"), code("o_custkey"), "title", none.alias("artist"), "sequence_no", none.alias("filename"), F.col("o_custkey").cast("string").alias("record_id"), F.col("o_custkey").alias("ord"))
    moved = orders.join(t(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return presence.matrix_by_keys({"members": members, "buyers": side(orders, "o_orderpriority"), "movers": side(moved, "l_returnflag")})


@query("""
select c_custkey, lower(regexp_replace(c_name, '[\\s_#-]+', '', 'g')) as k, min(c_custkey) over (partition by lower(regexp_replace(c_name, '[\\s_#-]+', '', 'g'))) as first_key
from customer
""")
def norm_key_lookup(spark, sf_dir):
    """Names with separators put in find the first record of their normalised name."""
    base = t(spark, sf_dir, "customer").withColumn("k", text.catalogue_key(F.regexp_replace("c_name", "#", " ")))
    heads = keys.first_wins(base, ["k"], ["c_custkey"]).select("k", F.col("c_custkey").alias("first_key"))
    asked = base.select("c_custkey", text.catalogue_key(F.regexp_replace(F.upper("c_name"), "#", " - ")).alias("k"))
    return asked.join(heads, "k").select("c_custkey", "k", "first_key")


@query(f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by {LINE_ORDER_SQL}) = 1")
def first_wins(spark, sf_dir):
    """The first line of each key."""
    return keys.first_wins(t(spark, sf_dir, "lineitem"), LINE_KEY, LINE_ORDER).select(*LINE_KEY, "l_partkey", "l_suppkey", "l_extendedprice")


@query(f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by {', '.join(c + ' desc' for c in LINE_ORDER)}) = 1")
def last_wins(spark, sf_dir):
    """The last line of each key."""
    return keys.last_wins(t(spark, sf_dir, "lineitem"), LINE_KEY, LINE_ORDER).select(*LINE_KEY, "l_partkey", "l_suppkey", "l_extendedprice")


@query(f"""
with by_key as (select distinct on (l_orderkey) l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem order by l_orderkey, l_linenumber desc, {', '.join(c + ' desc' for c in LINE_ORDER)}),
by_part as (select distinct on (l_partkey) l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem order by l_partkey, l_orderkey desc, l_linenumber desc, {', '.join(c + ' desc' for c in LINE_ORDER)})
select o_orderkey, case when k.l_orderkey is not null then 'orderkey' when q.l_partkey is not null then 'partkey' end as match_via,
  case when k.l_orderkey is not null then k.l_linenumber else q.l_linenumber end as line, case when k.l_orderkey is not null then k.l_partkey else q.l_partkey end as part, case when k.l_orderkey is not null then k.l_suppkey else q.l_suppkey end as supplier
from orders left join by_key k on case when o_orderkey % 3 <> 0 then o_orderkey end = k.l_orderkey left join by_part q on o_custkey = q.l_partkey
""")
def prioritised_join(spark, sf_dir):
    """Orders find their last line by their key, every third only by another one."""
    orders = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = t(spark, sf_dir, "lineitem").select(*LINE_KEY, *LINE_ORDER)
    found = keys.prioritised_join(orders, lines, [("orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")), F.col("l_orderkey")), ("partkey", F.col("o_custkey"), F.col("l_partkey"))], [*LINE_KEY, *LINE_ORDER])
    return found.select("o_orderkey", "match_via", F.col("match.l_linenumber").alias("line"), F.col("match.l_partkey").alias("part"), F.col("match.l_suppkey").alias("supplier"))


@query("select c_custkey, s_suppkey from customer join supplier on c_custkey = s_suppkey union select c_custkey, s_suppkey from customer join supplier on c_nationkey = s_nationkey and s_suppkey % 10 = 0")
def or_key_join(spark, sf_dir):
    """Customers and suppliers that share a key, or a nation for some suppliers."""
    customer = t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = t(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 10 == 0, F.col("s_nationkey")).alias("s_nation"))
    return keys.or_key_join(customer, supplier, [("c_custkey", "s_suppkey"), ("c_nationkey", "s_nation")]).select("c_custkey", "s_suppkey")


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null and o_totalprice > 300000)")
def unmatched_left(spark, sf_dir):
    """Customers without large orders."""
    orders = t(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return keys.unmatched(t(spark, sf_dir, "customer"), orders, ["c_custkey"]).select("c_custkey", "c_name")


@query("select p_partkey, p_name from part where p_partkey not in (select l_partkey from lineitem where l_partkey is not null and l_quantity > 49)")
def unmatched_right(spark, sf_dir):
    """Parts that no line names in the largest quantity."""
    lines = t(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return keys.unmatched(t(spark, sf_dir, "part"), lines, ["p_partkey"]).select("p_partkey", "p_name")


@query("""
with names as (select distinct p_name as title, regexp_extract(p_name, '([^ ]+)$', 1) as block from part),
n as (select title, block, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') as k from names),
met as (select x.block, x.title, y.title as r_title, 1 - levenshtein(x.k, y.k)::double / greatest(length(x.k), length(y.k)) as score from n x join n y on x.block = y.block and x.title <> y.title)
select block, title, r_title, score from met where score >= 0.7 qualify row_number() over (partition by title order by score desc, r_title) = 1
""")
def fuzzy_best_match(spark, sf_dir):
    """For each part name the most similar other name with the same last word."""
    names = t(spark, sf_dir, "part").select(F.col("p_name").alias("title"), F.regexp_extract("p_name", "([^ ]+)$", 1).alias("block")).distinct()
    near = keys.fuzzy_matches(names, names, ["block"], "title", "title", ["title"], 0.7, F.col("title") != F.col("r_title"))
    return near.select("block", "title", "r_title", "score")


@query("""
with rows as (
  select 'X' || p_partkey as isrc, p_name as title, p_brand as artist, p_type as album, null as catalogue_no, p_size::bigint as sequence_no, p_partkey as ord, 0 as rank, 'parts' as source from part
  union all select case when c_custkey % 2 = 0 then 'x' || c_custkey end, c_name, c_mktsegment, null, 'cat' || c_nationkey, null, c_custkey, 1, 'customers' from customer
  union all select 'x' || s_suppkey, s_name, null, 'album', null, s_nationkey::bigint, s_suppkey, 2, 'suppliers' from supplier
), keyed as (select *, case when isrc is not null then upper(isrc) else 't:' || lower(title) || '|a:' || lower(coalesce(artist, '')) end as key from rows)
select key, arg_min(title, rank * 1000000000 + ord) filter (title <> '') as title, arg_min(artist, rank * 1000000000 + ord) filter (artist <> '') as artist,
  arg_min(album, rank * 1000000000 + ord) filter (album <> '') as album, arg_min(catalogue_no, rank * 1000000000 + ord) filter (catalogue_no <> '') as catalogue_no,
  max(upper(isrc)) as isrc, (list(sequence_no order by rank, ord))[1] as sequence_no, array_to_string(list(distinct source order by source desc), ',') as sources, count(distinct source)::int as n_sources
from keyed group by key
""")
def federated_search(spark, sf_dir):
    """Q09: parts, customers and suppliers merged by code, else by name, tagged with their sources."""
    none, part, customer, supplier = F.lit(None).cast("string"), t(spark, sf_dir, "part"), t(spark, sf_dir, "customer"), t(spark, sf_dir, "supplier")
    code = lambda c, x="x": F.concat(F.lit(x), F.col(c).cast("string")).alias("isrc")
    songs = search.federated(
        {
            "parts": part.select(code("p_partkey", "X"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_type").alias("album"), none.alias("catalogue_no"), F.col("p_size").cast("long").alias("sequence_no"), F.col("p_partkey").alias("ord")),
            "customers": customer.select(F.when(F.col("c_custkey") % 2 == 0, code("c_custkey")).alias("isrc"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("artist"), none.alias("album"), F.concat(F.lit("cat"), F.col("c_nationkey").cast("string")).alias("catalogue_no"), F.lit(None).cast("long").alias("sequence_no"), F.col("c_custkey").alias("ord")),
            "suppliers": supplier.select(code("s_suppkey"), F.col("s_name").alias("title"), none.alias("artist"), F.lit("album").alias("album"), none.alias("catalogue_no"), F.col("s_nationkey").cast("long").alias("sequence_no"), F.col("s_suppkey").alias("ord")),
        }
    )
    return songs.select("key", "title", "artist", "album", "catalogue_no", "isrc", "sequence_no", F.array_join(F.reverse(F.array_sort("sources")), ",").alias("sources"), "n_sources")


@query("select p_partkey, p_name from part where contains(lower(p_name), 'wid') or contains(lower(p_brand), 'wid') or contains(lower(p_type), 'wid') order by p_partkey limit 20")
def or_substring_search(spark, sf_dir):
    """Q01: a term in any of several columns, the first twenty."""
    return search.holds_any(t(spark, sf_dir, "part"), " WID ", ["p_name", "p_brand", "p_type", "absent"]).orderBy("p_partkey").limit(20).select("p_partkey", "p_name")


@query("select page_id, url from pages where contains(lower(url), 'http') and contains(lower(url), 'example') and contains(lower(url), 'en')")
def and_words_search(spark, sf_dir):
    """Q07: URLs that hold all words."""
    return search.holds_all_words(t(spark, sf_dir, "pages"), "http Example en", "url").select("page_id", "url")


@query("select p_partkey, p_name, (select count(*) from part where p_size > 10) as found_count from part where p_size > 10 order by p_name, p_partkey limit 50 offset 100")
def paged_search_with_total(spark, sf_dir):
    """A page of results with the number found."""
    return search.page(t(spark, sf_dir, "part").where("p_size > 10"), ["p_name", "p_partkey"], 50, 100).select("p_partkey", "p_name", "found_count")


@query("select c_custkey from customer where (lower(c_mktsegment) = 'building' and starts_with(lower(c_name), 'customer#0000001')) or contains(lower(c_name), '77')")
def find_dnf(spark, sf_dir):
    """Any of several sets of conditions."""
    return search.find(t(spark, sf_dir, "customer"), [{"c_mktsegment": "==BUILDING", "c_name": "Customer#0000001*"}, {"c_name": "*77*"}, {"absent": "*"}]).select("c_custkey")


@query("""
with songs as (select p_brand as artist, p_type as album, p_name as title, case when p_size > 25 then 'u' || p_partkey end as url, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate
  from lineitem join part on l_partkey = p_partkey)
select artist, count(*) as songs, count(distinct album) as albums, arg_min(url, l_partkey * 1000000000::hugeint + l_orderkey) filter (url is not null) as sample_url, max(l_orderkey) as last_id from songs group by artist
""")
def artist_rollup(spark, sf_dir):
    """Line items by brand."""
    songs = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    songs = songs.select(F.col("p_brand").alias("artist"), F.col("p_type").alias("album"), F.col("p_name").alias("title"), F.when(F.col("p_size") > 25, F.concat(F.lit("u"), F.col("p_partkey").cast("string"))).alias("url"), F.col("l_orderkey").alias("record_id"), "l_partkey")
    out = rollups.artist_rollup(songs, ["l_partkey", "record_id"])
    return out.select("artist", "songs", "albums", F.col("sample.url").alias("sample_url"), "last_id")


@query("select event_type as tag, count(*) as n from events group by event_type")
def tag_counts(spark, sf_dir):
    """Events by type."""
    return rollups.tag_counts(t(spark, sf_dir, "events").withColumn("event_type", F.concat(F.lit(" "), "event_type", F.lit("\t"))), "event_type")


@query("select lower(c.role) as show_key, arg_min(c.role, c.conv_id * 1000 + c.turn) as show_title, count(*) as episode_count, max(c.turn) as max_episode_number from conversations c group by lower(c.role)")
def show_rollup(spark, sf_dir):
    """Conversations by role, first spelling, turns and highest turn."""
    none = F.lit(None).cast("string")
    rows = t(spark, sf_dir, "conversations").select(F.col("role").alias("show_title"), *[none.alias(c) for c in ("host", "artwork", "category", "language")], F.col("turn").alias("episode_number"), "conv_id")
    return rollups.show_rollup(rows, ["conv_id", "episode_number"]).select("show_key", "show_title", "episode_count", "max_episode_number")


@query("select case when n_chars < 500 then 'short' when n_chars < 5000 then 'middle' else 'long' end as bucket, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 1)::double as pct from documents group by 1")
def audit_buckets(spark, sf_dir):
    """Documents by size."""
    return rollups.audit(t(spark, sf_dir, "documents"), F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "middle").otherwise("long"))


@query("select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as n, greatest(1, count(*) over () // 40) as step from orders) where n % step = 0")
def systematic_sample(spark, sf_dir):
    """Every n-th order for a sample of forty or a few more."""
    return rollups.systematic_sample(t(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 40)


@query(f"select l_orderkey, l_partkey, l_suppkey, l_quantity from lineitem qualify row_number() over (partition by l_orderkey order by l_linenumber, {LINE_ORDER_SQL}) = 1")
def album_from_first(spark, sf_dir):
    """An order's fields from its first line."""
    first = rollups.first_value(F.struct("l_partkey", "l_suppkey", "l_quantity"), ["l_linenumber", *LINE_ORDER])
    return t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(first.alias("h")).select("l_orderkey", "h.*")


@query("select l_orderkey, sum(coalesce(nullif(l_quantity, 10), 0)::bigint)::bigint as seconds, coalesce(bool_or(l_returnflag = 'R'), false) as explicit from lineitem group by l_orderkey")
def album_totals(spark, sf_dir):
    """Total length and any flag of an order."""
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", F.nullif("l_quantity", F.lit(10.0)).alias("duration"), F.when(F.col("l_returnflag") == "R", True).alias("flag"))
    return rollups.album_totals(lines, "l_orderkey", "duration", "flag")


@query(f"select l_orderkey, l_linenumber, l_partkey from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by {LINE_ORDER_SQL}) > 1")
def dup_detect(spark, sf_dir):
    """Lines whose key was there before."""
    return keys.duplicates(t(spark, sf_dir, "lineitem"), LINE_KEY, LINE_ORDER).select(*LINE_KEY, "l_partkey")


@query("""
with base as (select o_orderkey as id, o_orderstatus as status, o_totalprice as price from orders where o_orderkey % 2 = 0),
news as (select o_orderkey as id, case when o_orderkey % 5 <> 0 then 'N' end as status, o_totalprice + 1 as price from orders where o_orderkey % 3 = 0)
select coalesce(n.id, b.id) as id, coalesce(n.status, b.status) as status, coalesce(n.price, b.price) as price, case when n.id is null then 'kept' when b.id is null then 'created' else 'updated' end as action
from base b full join news n on b.id = n.id
""")
def upsert_actions(spark, sf_dir):
    """Every third order, changed, into every second."""
    orders = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    news = orders.where("id % 3 = 0").select("id", F.when(F.col("id") % 5 != 0, F.lit("N")).alias("status"), (F.col("price") + 1).alias("price"))
    return writes.upsert(orders.where("id % 2 = 0"), news, ["id"], ["price"])


@query("""
with base as (select c_custkey as id, 'r' || c_custkey as record_id, 'I' || c_custkey as isrc, 'f' || c_nationkey as filename from customer where c_custkey % 2 = 0)
select o_orderkey, coalesce((select record_id from base where isrc = 'I' || o_custkey), (select record_id from base where filename = f order by id limit 1)) as record_id,
  case when coalesce((select record_id from base where isrc = 'I' || o_custkey), (select record_id from base where filename = f order by id limit 1)) is null then 'created' else 'updated' end as action
from (select *, 'f' || case when o_orderkey % 7 = 0 then o_orderkey % 30 else 99 end as f from orders)
""")
def upsert_by_code_or_name(spark, sf_dir):
    """Orders as tracks: by code, else by file name."""
    text_of = lambda x, c: F.concat(F.lit(x), F.col(c).cast("string"))
    base = t(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("ord"), text_of("r", "c_custkey").alias("record_id"), text_of("I", "c_custkey").alias("isrc"), text_of("f", "c_nationkey").alias("filename"))
    name = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderkey") % 30).otherwise(99)
    tracks = t(spark, sf_dir, "orders").select("o_orderkey", text_of("I", "o_custkey").alias("isrc"), F.concat(F.lit("f"), name.cast("string")).alias("filename"))
    return writes.upsert_by_any(base, tracks, ["isrc", "filename"], ["ord"]).select("o_orderkey", "record_id", "action")


@query("select o_orderkey, c_custkey is not null and c_mktsegment = case when o_orderkey % 2 = 0 then c_mktsegment else 'BUILDING' end as ok from orders left join customer on o_custkey = c_custkey and c_custkey % 4 <> 0")
def guarded_edits(spark, sf_dir):
    """Edits go through where the row is there and as it was seen."""
    customer = t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    edits = t(spark, sf_dir, "orders").join(customer.withColumnRenamed("c_mktsegment", "was"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("was")).otherwise("BUILDING").alias("seen"))
    out = writes.guarded_actions(customer.where("c_custkey % 4 <> 0").withColumnRenamed("c_custkey", "o_custkey"), edits, "o_custkey", "seen", "c_mktsegment")
    return out.select("o_orderkey", "ok")


@query("""
select p_partkey as ord, p_name, p_brand from part where p_partkey <= 100
union all select p_partkey - 101 + (select max(p_partkey) from part where p_partkey <= 100) + 1, p_name, null from part where p_partkey > 100
""")
def append_union(spark, sf_dir):
    """Rows with fewer columns added after the others."""
    part = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), "p_name", "p_brand")
    return writes.append(part.where("ord <= 100"), part.where("ord > 100").select("ord", "p_name"))


@query("select p_partkey, case when p_partkey % 13 = 0 and p_partkey < 500 then 'NEW' else p_type end as p_type from part")
def bulk_retag(spark, sf_dir):
    """A new type for a list of parts."""
    part = t(spark, sf_dir, "part").select("p_partkey", "p_type")
    return writes.retag(part, part.where("p_partkey % 13 = 0 and p_partkey < 500"), "p_partkey", "p_type", "NEW")


_TRACKS_SQL = """
with tracks as (
  select l_orderkey as release, l_linenumber, 'ZA' || 'ABC' || lpad((l_partkey % 10000000)::varchar, case when l_partkey % 9 = 0 then 6 else 7 end, '0') as isrc,
    case when l_suppkey % 11 = 0 then '' else 'T' || l_partkey end as title, case when l_suppkey % 7 <> 0 then 'A' || l_suppkey end as artist_name, (l_quantity * 60)::bigint as duration_sec,
    case when l_returnflag = 'R' then null else 'en' end as language, case when l_linestatus = 'O' then '12-6' else '1996' end as year, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus
  from lineitem
), placed as (select *, row_number() over (partition by release order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) as position from tracks)
"""


@query(
    _TRACKS_SQL
    + r"""
, formed as (select *, regexp_full_match(isrc, '[A-Z]{2}[A-Z0-9]{3}\d{7}') as good from placed),
again as (select *, good and position > min(position) filter (good) over (partition by release, isrc) as dup from formed)
select release, position::int as position, v.rule, v.severity from (
  select release, position, unnest([
    case when not good or dup then {'rule': 'V03', 'severity': 'E'} end,
    case when title = '' then {'rule': 'V04', 'severity': 'E'} end,
    case when artist_name is null then {'rule': 'V04', 'severity': 'E'} end,
    case when duration_sec = 0 then {'rule': 'V04', 'severity': 'E'} end,
    case when language is null then {'rule': 'V05', 'severity': 'W'} end,
    case when year = '12-6' then {'rule': 'V06', 'severity': 'E'} end,
    case when duration_sec <> 0 and duration_sec < 30 then {'rule': 'V08', 'severity': 'W'} end,
    case when duration_sec > 1800 then {'rule': 'V08', 'severity': 'W'} end]) as v from again) where v is not null
"""
)
def validate_rules(spark, sf_dir):
    """Line items as tracks of releases, one row a violation."""
    part = F.col("l_partkey")
    tracks = t(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("release"), "l_linenumber", *LINE_ORDER,
        F.concat(F.lit("ZAABC"), F.when(part % 9 == 0, F.lpad((part % 10000000).cast("string"), 6, "0")).otherwise(F.lpad((part % 10000000).cast("string"), 7, "0"))).alias("isrc"),
        F.when(F.col("l_suppkey") % 11 == 0, "").otherwise(F.concat(F.lit("T"), part.cast("string"))).alias("title"),
        F.when(F.col("l_suppkey") % 7 != 0, F.concat(F.lit("A"), F.col("l_suppkey").cast("string"))).alias("artist_name"),
        (F.col("l_quantity") * 60).cast("long").alias("duration_sec"),
        F.when(F.col("l_returnflag") != "R", "en").alias("language"),
        F.when(F.col("l_linestatus") == "O", "12-6").otherwise("1996").alias("year"),
    )
    placed = validation.with_position(tracks, "release", ["l_linenumber", *LINE_ORDER])
    return validation.violations(placed, validation.track_rules(), ["release", "position"]).select("release", "position", "rule", "severity")


@query("""
with s as (select event_id, (abs(hash_value) % 9000)::bigint as sec from (select event_id, event_id * 7919 as hash_value from events))
select event_id, sec, lpad((sec // 3600)::varchar, 2, '0') || ':' || lpad((sec // 60 % 60)::varchar, 2, '0') || ':' || lpad((sec % 60)::varchar, 2, '0') as clock,
  'PT' || (sec // 3600) || 'H' || (sec // 60 % 60) || 'M' || (sec % 60) || 'S' as full_iso,
  'PT' || case when sec >= 3600 then (sec // 3600) || 'H' else '' end || case when sec // 60 % 60 > 0 then (sec // 60 % 60) || 'M' else '' end || case when sec % 60 > 0 or sec < 60 then (sec % 60) || 'S' else '' end as short_iso,
  sec as from_clock, sec as from_iso, case when sec % 60 = 0 and sec > 3600 then sec // 60 else sec end as from_field from s
""")
def duration_forms(spark, sf_dir):
    """seconds to their written forms and back."""
    s = t(spark, sf_dir, "events").select("event_id", (F.abs(F.col("event_id") * 7919) % 9000).alias("sec"))
    s = s.select("*", values.clock("sec").alias("clock"), values.full_iso("sec").alias("full_iso"), values.short_iso("sec").alias("short_iso"))
    return s.select("*", values.seconds("clock").alias("from_clock"), values.seconds("short_iso").alias("from_iso"), values.seconds_of_time_field("clock").alias("from_field"))


@query("""
select p_partkey, strftime(date '1899-12-30' + (40001 + p_partkey % 29000)::int, '%Y-%m-%d') as day,
  lpad((p_partkey * 37 % 86400 // 3600)::varchar, 2, '0') || ':' || lpad((p_partkey * 37 % 86400 // 60 % 60)::varchar, 2, '0') || ':' || lpad((p_partkey * 37 % 86400 % 60)::varchar, 2, '0') as time_of_day,
  case when p_size > 5 then p_size::varchar end as plain from part
""")
def excel_serials(spark, sf_dir):
    """day numbers and day fractions of a spreadsheet."""
    part = t(spark, sf_dir, "part")
    serial, fraction = (F.lit(40001) + F.col("p_partkey") % 29000).cast("string"), F.format_number((F.col("p_partkey") * 37 % 86400).cast("double") / 86400, 12)
    return part.select("p_partkey", values.sheet_value(serial).alias("day"), values.sheet_value(fraction, duration=True).alias("time_of_day"), values.sheet_value(F.when(F.col("p_size") > 5, F.concat(F.lit("\t"), F.col("p_size").cast("string"))).otherwise("  ")).alias("plain"))


@query("""
select s_suppkey, '60' || s_suppkey as barcode, (s_nationkey + 1)::bigint as seq, s_name as title, 'a' || s_suppkey || '_' || s_name || '_x' as stem from supplier
""")
def filename_parse(spark, sf_dir):
    """Parts of file names."""
    supplier, n = t(spark, sf_dir, "supplier"), F.col("s_suppkey").cast("string")
    coded = F.concat(F.lit("C:\\in\\60"), n, F.lit("_x_"), F.lpad((F.col("s_nationkey") + 1).cast("string"), 3, "0"), F.lit(".WAV"))
    named = F.concat(F.lit("in/a"), n, F.lit("_"), "s_name", F.lit("_x.wav"))
    parsed = supplier.select("s_suppkey", "s_name", values.barcode_and_number(coded).alias("b"), text.basename(named).alias("f"))
    return parsed.select("s_suppkey", "b.barcode", "b.seq", text.title_of_filename("f").alias("title"), text.stem("f").alias("stem"))


@query("""
select p_partkey, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), '; ') as names from (select p_partkey, string_split(p_name || ' ' || p_type || ' ' || p_name, ' ') as w from part)
""")
def names_split(spark, sf_dir):
    """a text of names to distinct names and back."""
    raw = F.regexp_replace(F.concat_ws(" ", "p_name", "p_type", "p_name"), " ", " ;, ")
    return t(spark, sf_dir, "part").select("p_partkey", text.joined(text.split_names(raw)).alias("names"))


@query("select event_id, (props::json->>'k') as k from events")
def json_props(spark, sf_dir):
    """a field of a JSON text."""
    return t(spark, sf_dir, "events").select("event_id", values.json_field("props", "k").alias("k"))


@query("""
select p_partkey, row_number() over (order by coalesce(s, 999), p_partkey) as place_999, row_number() over (order by s nulls last, p_partkey) as place_last
from (select p_partkey, case when p_size % 7 = 0 then null when p_size % 11 = 0 then 1000 + p_size else p_size end as s from part)
""")
def null_seq_sort(spark, sf_dir):
    """Places by sequence number with null as 999 and as last."""
    s = F.when(F.col("p_size") % 7 == 0, None).when(F.col("p_size") % 11 == 0, F.lit(1000) + F.col("p_size")).otherwise(F.col("p_size"))
    rows = rollups.positions(t(spark, sf_dir, "part").select("p_partkey", s.alias("s")), [rollups.by_sequence("s"), "p_partkey"], "place_999")
    return rollups.positions(rows, [rollups.by_sequence("s", None), "p_partkey"], "place_last").select("p_partkey", "place_999", "place_last")


@query("""
select page_id, case page_id % 6 when 0 then 'wav' when 1 then 'mp3' when 2 then 'mp3' when 3 then 'flac' when 4 then 'aiff' else 'unknown' end as format, page_id % 6 = 0 as wave, upper(md5(html)) as md5 from pages
""")
def magic_bytes(spark, sf_dir):
    """file formats by their first bytes, hashes in upper case."""
    heads = F.array(*[F.unhex(F.lit(h)) for h in ("5249464600000000574156450000", "FFFB9000", "494433", "664C6143", "464F524D", "3C21444F")])
    pages = t(spark, sf_dir, "pages").withColumn("content", F.get(heads, (F.col("page_id") % 6).cast("int")))
    return pages.select("page_id", values.audio_format("content").alias("format"), values.is_wave("content").alias("wave"), values.md5_upper("html").alias("md5"))


@query("select page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') as title from pages")
def html_title(spark, sf_dir):
    """one element of a marked-up text, blank ones as null."""
    return t(spark, sf_dir, "pages").select("page_id", text.clean(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query("""
with target as (select c_custkey as ord, 'r' || c_custkey as record_id, 'c' || c_nationkey as catalogue_no, 'I' || c_custkey as isrc, (c_custkey % 40)::bigint as sequence_no from customer),
by_code as (select catalogue_no, isrc, arg_max(record_id, ord) as record_id from target group by 1, 2),
by_seq as (select catalogue_no, sequence_no, arg_max(record_id, ord) as record_id from target group by 1, 2),
source as (select o_orderkey, 'c' || o_custkey % 30 as catalogue_no, case when o_orderkey % 4 = 0 then null when o_custkey % 3 = 1 then 'N' || o_custkey else 'I' || o_custkey end as isrc, case when o_orderkey % 2 = 0 then (o_orderkey % 60)::bigint end as sequence_no from orders),
met as (select x.*, coalesce(c.record_id, s.record_id) as record_id, exists (from target t where t.isrc = x.isrc and t.catalogue_no <> x.catalogue_no) as held
  from source x left join by_code c on x.catalogue_no = c.catalogue_no and x.isrc = c.isrc left join by_seq s on x.catalogue_no = s.catalogue_no and x.sequence_no = s.sequence_no)
select o_orderkey, record_id, case when record_id is not null then 'updated' when held or (isrc is not null and o_orderkey > min(case when record_id is null and not held then o_orderkey end) over (partition by isrc)) then 'exists-other-catalogue' else 'created' end as action
from met
""")
def replicate_actions(spark, sf_dir):
    """Orders as tracks of one system, customers of another; a third of the codes are new and come several times."""
    text_of = lambda x, c: F.concat(F.lit(x), c.cast("string"))
    target = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), text_of("r", F.col("c_custkey")).alias("record_id"), text_of("c", F.col("c_nationkey")).alias("catalogue_no"), text_of("I", F.col("c_custkey")).alias("isrc"), (F.col("c_custkey") % 40).alias("sequence_no"))
    k = F.col("o_orderkey")
    source = t(spark, sf_dir, "orders").select("o_orderkey", text_of("c", F.col("o_custkey") % 30).alias("catalogue_no"), F.when(k % 4 != 0, F.concat(F.when(F.col("o_custkey") % 3 == 1, "N").otherwise("I"), F.col("o_custkey").cast("string"))).alias("isrc"), F.when(k % 2 == 0, k % 60).alias("sequence_no"), F.lit("song").alias("title"))
    return replicate.replicate(source, target, arrival=["o_orderkey"]).select("o_orderkey", "record_id", "action")


@query("""
with best as (select distinct on (l_orderkey) l_orderkey, l_partkey from lineitem order by l_orderkey, l_linenumber desc, l_partkey desc)
select o_orderkey, coalesce(case when o_orderkey % 3 <> 0 then o_orderpriority end, 'p' || l_partkey) as filled, l_partkey is not null as hit from orders left join best on o_orderkey = l_orderkey
""")
def hydrate_blanks(spark, sf_dir):
    """Blanks filled from the matched row."""
    orders = t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).otherwise(" ").alias("filled"))
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("filled"))
    met = keys.prioritised_join(orders, lines, [("order", F.col("o_orderkey"), F.col("l_orderkey"))], ["l_linenumber", "l_partkey"])
    return keys.fill_blanks(met, "match", ["filled"]).select("o_orderkey", "filled", F.col("match").isNotNull().alias("hit"))


@query("""
select event_id, case event_id % 5 when 0 then 'store' when 1 then 'url' when 2 then null when 3 then null else 'store' end as kind,
  case event_id % 5 when 0 then 'masters' when 4 then 'masters' end as bucket, case event_id % 5 when 0 then 'a/' || event_id || '.wav' when 4 then 'b/' || event_id || '.wav' end as key,
  case event_id % 5 when 2 then 'unparseable-path' when 3 then 'no-audio-field' end as reason from events
""")
def path_resolve(spark, sf_dir):
    """Where a record's audio is, by several fields and forms."""
    n, r = F.col("event_id").cast("string"), F.col("event_id") % 5
    file = F.when(r == 0, F.concat(F.lit("movie:x.wav\n  moviemac:/Disk/Mount/masters/a/"), n, F.lit(".wav"))).when(r == 1, F.concat(F.lit("see https://host.example/x/"), n)).when(r == 2, F.lit("somewhere")).when(r == 3, F.lit(" "))
    rows = t(spark, sf_dir, "events").select("event_id", file.alias("file"), F.when(r == 4, F.concat(F.lit("/Volumes/masters/b/"), n, F.lit(".wav"))).alias("pending"))
    out = audio.resolve(rows, [("file", ["file"]), ("pending", ["pending"])], ["link"], "Mount/", ["masters"])
    return out.select("event_id", "audio.kind", "audio.bucket", "audio.key", "audio.reason")


@query("""
select c_custkey, case when c_custkey % 3 = 0 then c_custkey || '-1-2' when c_custkey % 3 = 1 then (c_custkey % 12 + 1) || '/' || (c_custkey % 28 + 1) || '/2024' else 'soon' end as raw,
  case when c_custkey % 3 = 0 then case when c_custkey between 1000 and 9999 then c_custkey || '-01-02' end when c_custkey % 3 = 1 then '2024-' || lpad((c_custkey % 12 + 1)::varchar, 2, '0') || '-' || lpad((c_custkey % 28 + 1)::varchar, 2, '0') end as day from customer
""")
def iso_dates(spark, sf_dir):
    """dates in two forms."""
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit("-1-2"))).when(k % 3 == 1, F.concat_ws("/", (k % 12 + 1).cast("string"), (k % 28 + 1).cast("string"), F.lit("2024"))).otherwise("soon")
    return t(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw"), values.iso_date(raw).alias("day"))


@query("""
select c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') as title_key, left(trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-'), 60) as slug, regexp_replace(c_name, '[^a-zA-Z0-9 ]', '', 'g') as part,
  '&lt;' || c_name || '&amp;&quot;' as escaped, c_nationkey || 'x' as lead_in, c_nationkey::bigint as lead from customer
""")
def text_keys(spark, sf_dir):
    """keys and escaped forms of a name."""
    lead = F.concat(F.col("c_nationkey").cast("string"), F.lit("x"))
    return t(spark, sf_dir, "customer").select("c_custkey", text.title_key("c_name").alias("title_key"), text.slug("c_name").alias("slug"), text.path_part("c_name").alias("part"), text.xml_escape(F.concat(F.lit("<"), "c_name", F.lit('&"'))).alias("escaped"), lead.alias("lead_in"), values.leading_int(lead).alias("lead"))


@query("select doc_id, lang, case lang when 'en' then 'en' when 'fr' then 'fr' when 'de' then 'de' when 'es' then 'es' end as code, case lang when 'en' then 'en' when 'fr' then 'fr' end as of_name from documents")
def language_codes(spark, sf_dir):
    """Names of languages to codes; short names are codes already."""
    name = F.when(F.col("lang") == "en", " English ").when(F.col("lang") == "fr", "FRENCH").when(F.col("lang") == "de", "German").otherwise("Spanish")
    return t(spark, sf_dir, "documents").select("doc_id", "lang", languages.language_code("lang").alias("code"), languages.language_code(name).alias("of_name"))


@query("select event_id from events order by ts desc, event_id desc limit 200")
def latest_events(spark, sf_dir):
    """The latest two hundred."""
    return t(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id")).transform(lambda df: rollups.latest(df, "at")).select("event_id")


@query("""
with part_of as (select o_orderkey, o_custkey, 'I' || o_custkey % 700 as isrc, 'g' || o_orderkey % 10 as grp from orders)
select o_orderkey, (select min(e.grp) from (select distinct isrc, grp from part_of where o_orderkey % 3 = 0) e where e.isrc = p.isrc and e.grp <> p.grp) as other_group from part_of p
""")
def exists_elsewhere(spark, sf_dir):
    """The least other group that holds the same code."""
    rows = t(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("I"), (F.col("o_custkey") % 700).cast("string")).alias("isrc"), F.concat(F.lit("g"), (F.col("o_orderkey") % 10).cast("string")).alias("grp"))
    return keys.elsewhere(rows, rows.where("o_orderkey % 3 = 0"), "isrc", "grp").select("o_orderkey", "other_group")


@query("""
with tracks as (select l_orderkey % 1000 as cat, l_linenumber as sequence_no, 'I' || l_partkey as isrc, l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem),
met as (select p_partkey as id, tr.* from part join tracks tr on cat = p_partkey % 1000 and sequence_no = p_size % 7 + 1
  union all select p_partkey, tr.* from part join tracks tr on isrc = 'I' || p_partkey)
select distinct on (id) id, l_orderkey, l_linenumber, l_partkey, l_suppkey from met order by id, l_orderkey, l_linenumber, l_partkey, l_suppkey
""")
def canonical_track(spark, sf_dir):
    """The first track with a place in a catalogue, or with the code."""
    first = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    tracks = t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1000).alias("catalogue_no"), F.col("l_linenumber").alias("sequence_no"), F.concat(F.lit("I"), F.col("l_partkey").cast("string")).alias("isrc"), F.struct(*first).alias("ord"))
    wanted = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 1000).alias("catalogue_no"), (F.col("p_size") % 7 + 1).alias("sequence_no"), F.concat(F.lit("I"), F.col("p_partkey").cast("string")).alias("isrc"))
    return replicate.canonical_track(tracks, wanted).select("id", "ord.*")


@query("""
select c_custkey as ord, nullif(trim(c_name), '') as title, c_mktsegment as artist_name, upper('za-' || c_custkey) as isrc, nullif(c_nationkey, 0)::bigint as sequence_no, (c_custkey % 9 * 60 + 7)::double as duration_sec, 2024::int as year,
  case when c_custkey % 2 = 0 then true else false end as explicit, 1::int as n_warnings from customer
""")
def track_sheet(spark, sf_dir):
    """A sheet with free headers as typed tracks."""
    k = F.col("c_custkey")
    sheet = t(spark, sf_dir, "customer").select(k.alias("ord"), F.col("c_name").alias("Song_Title"), F.col("c_mktsegment").alias("Main  Artist"), F.concat(F.lit(" za -"), k.cast("string")).alias("ISRC code"), F.col("c_nationkey").alias("Seq #"), F.concat((k % 9).cast("string"), F.lit(":07")).alias("Duration"), F.lit("2024-05-06").alias("Release Date"), F.when(k % 2 == 0, " Yes ").otherwise("no").alias("Explicit"), F.lit("?").alias("Odd column"))
    out = sheets.track_sheet(sheet)
    return out.select("ord", text.clean("title").alias("title"), "artist_name", "isrc", "sequence_no", "duration_sec", "year", "explicit", F.size("warnings").alias("n_warnings"))


@query("""
select p_partkey as ord, p_name as track_name, p_brand || '; ' || p_type as composer, nullif(p_size, 0)::bigint as seq, p_brand as album_artist, p_brand as track_artist, strftime(date '1899-12-30' + (40001 + p_size)::int, '%Y-%m-%d') as release_date from part where p_brand is not null
""")
def mapped_sheet(spark, sf_dir):
    """An explicit mapping with several headers to one field."""
    sheet = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("Name"), F.col("p_brand").alias("C1"), F.col("p_type").alias("C2"), F.col("p_size").alias("No"), (F.lit(40001) + F.col("p_size")).alias("When"), F.upper("p_brand").alias("By"), F.lit("X").alias("Cat"))
    out = sheets.mapped_sheet(sheet, [("Name", "track_name"), ("C1", "composer"), ("C2", "composer"), ("No", "seq"), ("C1", "album_artist"), ("By", "track_artist"), ("When", "release_date"), ("Cat", "catalogue"), ("Name", "unknown"), ("Gone", "isrc")])
    return out.select("ord", "track_name", "composer", "seq", "album_artist", "track_artist", "release_date")


@query("""
select l_orderkey, l_linenumber, l_partkey as match_part, row_number() over (partition by l_orderkey order by lower(l_returnflag), l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus)::int as place from lineitem
""")
def listing_places(spark, sf_dir):
    """Places of lines within their order, by flag and number."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*rollups.listing_order("l_returnflag", "l_linenumber"), *LINE_ORDER))
    return t(spark, sf_dir, "lineitem").select(*LINE_KEY, F.col("l_partkey").alias("match_part"), place.alias("place"))


@query("""
select c_custkey, array_to_string(list_filter([case when c_nationkey > 0 then 'Nation=' || c_nationkey end, 'Segment=' || c_mktsegment], lambda x: x is not null), ',') as payload from customer
""")
def payload_fields(spark, sf_dir):
    """A row as target fields, without blanks and unwanted ones."""
    customer = t(spark, sf_dir, "customer").withColumn("nation", F.when(F.col("c_nationkey") > 0, F.col("c_nationkey").cast("string")).otherwise("  "))
    held = writes.payload(customer, {"nation": "Nation", "c_mktsegment": "Segment", "c_name": "Name"}, ["Nation", "Segment"])
    return customer.select("c_custkey", F.array_join(F.transform(F.array_sort(F.map_entries(held)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("payload"))


@query("select lower(p_brand) as k, count(*) as n from (select p_brand from part union all select upper(p_type) from part) group by 1")
def merged_values(spark, sf_dir):
    """Two lists of values, each spelling once."""
    part = t(spark, sf_dir, "part")
    every = part.select("p_brand").union(part.select(F.upper("p_type")))
    merged = rollups.merged_values(part.select("p_brand"), part.select(F.upper("p_type").alias("p_brand")), "p_brand").select(F.lower("p_brand").alias("k"))
    return merged.join(every.groupBy(F.lower("p_brand").alias("k")).agg(F.count("*").alias("n")), "k")


from . import queries_fields, queries_records, queries_stored, queries_tables  # noqa: E402, F401  they register theirs
