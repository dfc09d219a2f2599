"""Registered queries of scans, searches, file listings, writes by id, upserts and orders of listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from discoforge.operators import rollups, search, writes
from discoforge.operators.cuts import new_folder
from discoforge.plans import audio, presence
from discoforge.sources import files, tables

from .queries_fields import _s
from .registry import query, t


def _customers(spark, sf_dir) -> DataFrame:
    """Customers as records of field texts."""
    k = F.col("c_custkey")
    held = F.create_map(F.lit("Name"), F.col("c_name"), F.lit("Segment"), F.col("c_mktsegment"), F.lit("Nation"), _s(F.col("c_nationkey")))
    return t(spark, sf_dir, "customer").select(_s(k).alias("recordId"), F.lit("1").alias("modId"), F.when(k % 3 == 0, F.map_filter(held, lambda n, _: n != "Nation")).otherwise(held).alias("fieldData"))


@query("""
select c_custkey::varchar as record_id, c_name as name, case when c_custkey % 3 <> 0 then c_nationkey::varchar end as nation, null::varchar as gone, (select string_agg(f, ',' order by f) from (values ('Name'), ('Nation'), ('Segment')) x(f)) as known from customer
""")
def record_fields(spark, sf_dir):
    """Fields of all records, of the first source that opens, and the names that a sample holds."""
    found = tables.load(spark, [lambda: spark.read.parquet(f"{sf_dir}/no_such_table.parquet"), lambda: _customers(spark, sf_dir)])
    known = tables.field_names(found)
    out = tables.fields(found, ["Name", "Nation", "Gone"])
    return out.select(F.col("recordId").alias("record_id"), F.col("Name").alias("name"), F.col("Nation").alias("nation"), F.col("Gone").alias("gone"), F.lit(",".join(known)).alias("known"))


@query("""
select 'point' as what, c_custkey::varchar as id from customer where c_custkey = 7
union all (select 'first', min(c_custkey)::varchar from customer where c_nationkey > 3)
union all select 'tagged', c_custkey::varchar from customer where c_custkey % 4 <> 0
union all select 'exactly', c_custkey::varchar from customer where c_nationkey = 7
union all select distinct 'value', c_mktsegment from customer
union all select 'fallback', v from (values ('Afrikaans'), ('English')) x(v)
union all select 'bounded', count(*)::varchar from (select * from customer limit 100)
""")
def record_scans(spark, sf_dir):
    """Point reads, first matches, tagged rows, value lists and bounded lists."""
    customer, k = t(spark, sf_dir, "customer"), F.col("c_custkey")
    tag = lambda df, what, c: df.select(F.lit(what).alias("what"), _s(c).alias("id"))
    marked = customer.withColumn("tag", F.when(k % 4 == 0, " ").otherwise(_s(" ", F.col("c_mktsegment"), "\t")))
    parts = [
        tag(tables.point(_customers(spark, sf_dir), "7"), "point", F.col("recordId")),
        tag(tables.first_match(customer.where("c_nationkey > 3"), ["c_custkey"]), "first", k),
        tag(tables.tagged(marked, "tag"), "tagged", k),
        tag(tables.tagged(customer.withColumn("tag", _s(" ", F.col("c_nationkey"))), "tag", "7"), "exactly", k),
        tag(tables.value_list(customer, "c_mktsegment", []), "value", F.col("c_mktsegment")),
        tag(tables.value_list(customer.select(F.lit(" ").alias("lang")), "lang", ["English", "Afrikaans"]), "fallback", F.col("lang")),
        tag(tables.bounded(customer, 100).agg(F.count("*").alias("n")), "bounded", F.col("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("""
select 'content' as what, p_partkey as id from part where contains(lower(p_name), 'red') or contains(lower(p_type), 'red')
union all select 'stream', p_partkey from part where contains(lower(p_brand), '12')
union all select 'artist', p_partkey from part where lower(p_brand) = lower('Brand#12') or contains(lower(p_brand), 'brand#1')
union all select 'artist and track', p_partkey from part where contains(lower(p_brand), 'brand#1') and contains(lower(p_name), 'e')
union all select 'short', 0 where false
union all select 'page', p_partkey from (select p_partkey from part order by p_name, p_partkey limit 200)
union all select 'sorted', p_partkey from (select p_partkey from part order by p_size desc, p_name, p_partkey limit 30)
""")
def searches(spark, sf_dir):
    """Searches over the columns there are, pages within their limits, and asked-for sorts."""
    part = t(spark, sf_dir, "part")
    songs = part.select("p_partkey", F.lit("x").alias("artist_name"), F.col("p_brand").alias("album_artist"), F.col("p_name").alias("title"))
    tag = lambda df, what: df.select(F.lit(what).alias("what"), F.col("p_partkey").alias("id"))
    return (
        tag(search.holds_any(part, " RED", ["p_name", "p_type", "gone"]), "content")
        .union(tag(search.holds_any(part, "12", ["p_brand"]), "stream"))
        .union(tag(search.artists(songs, "Brand#1"), "artist"))
        .union(tag(search.artists(songs, "brand#1", "E"), "artist and track"))
        .union(tag(search.holds_any(part, " r ", ["p_name"]), "short"))
        .union(tag(search.page(part, ["p_name", "p_partkey"], 5000, -3), "page"))
        .union(tag(search.sorted_by(part, [("p_size", "descend"), ("p_name", "ascend")], ["p_partkey"]).limit(30), "sorted"))
    )


@query("""
with s as (select p_partkey as id, p_partkey % 2 = 0 as has_audio, p_partkey % 3 <> 0 as has_artwork, p_partkey % 5 <> 0 as has_isrc from part)
select id, has_audio, has_artwork, has_isrc, has_audio and has_artwork as eligible, case when id <= 50 then case when has_audio and has_artwork then 'done' else 'skipped' end end as state, null::varchar as reason from s
union all select -1, null, null, null, null, 'failed', 'no such song'
""")
def video_batch(spark, sf_dir):
    """Which songs a video can be made of, and what becomes of those asked for, each once."""
    part, k = t(spark, sf_dir, "part"), F.col("p_partkey")
    songs = part.select(k.alias("id"), F.when(k % 2 == 0, " https://s/x.wav").otherwise("movie:x").alias("s3_url"), F.when(k % 3 != 0, "HTTP://s/x.jpg").alias("artwork_url"), F.when(k % 5 != 0, "ZA").otherwise(" ").alias("isrc"))
    asked = part.where("p_partkey <= 50").select(k.alias("id"), k.alias("n"))
    asked = asked.union(asked).union(spark.createDataFrame([(-1, 999)], "id long, n long"))
    todo = search.batch(songs, asked, "id", ["n"]).select("id", "state", F.when(F.col("state") == "failed", F.col("reason")).alias("reason"))
    flagged = search.eligible(songs).select("id", "has_audio", "has_artwork", "has_isrc", "eligible")
    return flagged.join(todo, "id", "full")


@query("""
with c as (select p_partkey as k, p_name, p_size from part)
select 'exact' as what, k from c where k % 50 = 3 union all select 'like', k from c where k % 50 = 4
""")
def catalogue_lookup(spark, sf_dir):
    """P20: the rows of a catalogue number, as spelt, else as it reads without spaces and hyphens."""
    k = F.col("p_partkey")
    cache = t(spark, sf_dir, "part").select(k.alias("ord"), k, F.when(k % 50 == 3, " ab 3 ").when(k % 50 == 4, "CD-4").otherwise(_s("x", k % 50)).alias("catalogue"), F.col("p_size").alias("seq"))
    first, second = search.lookup_tracks(cache, "AB 3"), search.lookup_tracks(cache, "c d_4")
    return first.select(F.lit("exact").alias("what"), F.col("p_partkey").alias("k")).union(second.select(F.lit("like"), "p_partkey"))


_LISTING = """
with f as (select p_partkey as k, '/masters/K' || p_partkey % 40 || '/' || case when p_partkey % 5 = 0 then 'notes' || p_partkey || '.txt' else 'Song ' || p_partkey || '.wav' end as path, p_size::bigint as size from part)
"""


def _listing(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, _s("notes", k, ".txt")).otherwise(_s("Song ", k, ".wav"))
    return t(spark, sf_dir, "part").select(k.alias("k"), _s("/masters/K", k % 40, "/", name).alias("path"), name.alias("name"), F.col("p_size").cast("long").alias("size"))


@query(_LISTING + """
select 'folder' as what, 'K' || n as name, null::bigint as size from (select distinct k % 40 as n from f)
union all select 'in folder', split_part(path, '/', 4), size from f where k % 40 = 7
union all select 'audio', split_part(path, '/', 4), size from f where k % 5 <> 0 and k % 40 in (1, 2)
union all select 'catalogue', split_part(path, '/', 4), size from f where contains(regexp_replace(lower(path), '[^a-z0-9]', '', 'g'), 'k12')
""")
def file_listings(spark, sf_dir):
    """What folders hold, audio files in scope, and the files of a catalogue."""
    listing = _listing(spark, sf_dir)
    listing = files.composed(listing)
    tag = lambda df, what: df.select(F.lit(what).alias("what"), "name", "size")
    top = tag(files.folder_view(listing, "/masters/"), "folder")
    return top.union(tag(files.folder_view(listing, "/masters/K7"), "in folder")).union(tag(files.audio_files(listing, ["/K1/", "/K2/"]), "audio")).union(tag(files.files_of_catalogue(listing, "K-12"), "catalogue"))


@query(_LISTING + """
select p_partkey as k, case when p_partkey % 7 = 0 then null when p_partkey % 3 = 0 then false else true end as "exists", case when p_partkey % 7 <> 0 and p_partkey % 3 = 0 and p_partkey % 5 <> 0 then (select path from f where f.k = p_partkey) end as found_path, case when p_partkey % 7 = 0 then 'link' else 'file' end as source
from part
""")
def located_files(spark, sf_dir):
    """Whether a record's audio is where it says, and where else in its folder it is by title."""
    listing = _listing(spark, sf_dir)
    k = F.col("k")
    said = F.when(k % 3 == 0, F.concat(F.regexp_replace("path", "[^/]+$", ""), F.lit("gone.wav"))).otherwise(F.col("path"))
    rows = listing.select("k", F.when(k % 7 != 0, said).otherwise(" ").alias("file"), F.when(k % 7 == 0, " https://h.example/x.wav").alias("url"), F.when((k % 3 == 0) & (k % 7 != 0) & (k % 5 != 0), _s("song ", k)).otherwise("-").alias("title"))
    found = audio.resolve(rows.withColumn("file", F.nullif(F.trim("file"), F.lit(""))), [("file", ["file"])], ["url"], "Mount/", ["masters"])
    out = audio.relocated(audio.verified(found, listing), listing, "title")
    return out.select("k", "exists", "found_path", F.when(F.col("audio.source") == "file", "file").otherwise("link").alias("source"))


@query("""
select 'g' || p_partkey % 40 as "group", p_partkey as track_ord, p_partkey + 7 as file_ord, 'any' as how from part where p_partkey % 6 <> 5
union all select 'g' || p_partkey % 40, p_partkey, p_partkey + 7, 'exact' from part where p_partkey % 6 in (0, 2, 4)
""")
def matched_files(spark, sf_dir):
    """Tracks and the files of their catalogue by title, exact or one holding the other; and exact ones by rank."""
    part, k = t(spark, sf_dir, "part"), F.col("p_partkey")
    number = F.lpad(k.cast("string"), 9, "0")
    tracks = part.select(_s("g", k % 40).alias("group"), k.alias("ord"), _s("Tünes ", number).alias("title"))
    named = F.when(k % 6 == 5, "---.wav").when(k % 2 == 0, _s("TUNES-", number, ".wav")).otherwise(_s("tunes ", number, " (Radio Edit).mp3"))
    listed = part.select(_s("g", k % 40).alias("group"), (k + 7).alias("ord"), named.alias("name"))
    exact = audio.match_files_by_rank(tracks, listed)
    return audio.match_files(tracks, listed).withColumn("how", F.lit("any")).unionByName(exact.withColumn("how", F.lit("exact")))


@query("""
select p_partkey, case when p_partkey % 3 = 0 then 'NEW' else p_type end as p_type, case when p_partkey % 3 = 0 and p_partkey % 2 = 0 then 99 else p_size end as p_size, p_brand from part where p_partkey % 5 <> 0
""")
def edits_by_id(spark, sf_dir):
    """Fields that the target knows, written by id, and rows deleted by id."""
    part, k = t(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_brand"), F.col("p_partkey")
    edits = part.where("p_partkey % 3 = 0").select(k, F.lit("NEW").alias("p_type"), F.when(k % 2 == 0, 99).alias("p_size"), F.lit("x").alias("unknown"))
    name = writes.first_known(["pType", "p_type"], part.columns)
    kept, dropped = writes.known_fields(edits, ["p_partkey", name, "p_size"])
    assert dropped == ["unknown"]
    return writes.delete_by_id(writes.update_by_id(part, kept, "p_partkey"), part.where("p_partkey % 5 = 0"), "p_partkey")


@query("""
with b as (select c_nationkey as k, min(c_custkey) as first from customer group by 1), n as (select n_nationkey as k, n_name as name from nation where n_nationkey % 2 = 0)
select 'K' || coalesce(b.k, n.k) as catalogue_no, coalesce(n.name, 'old ' || b.first) as title, case when n.k is null then '0' when b.k is null then '1' else '1' end as active, case when n.k is null then 'kept' when b.k is null then 'created' else 'updated' end as action, n.k is null as missing
from b full join n on b.k = n.k
""")
def album_upserts(spark, sf_dir):
    """Albums by catalogue number, and what was written and isn't stored."""
    base = t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("first")).select(_s("K", F.col("c_nationkey")).alias("catalogue_no"), _s("old ", F.col("first")).alias("title"), F.lit("0").alias("active"))
    news = t(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(_s("K", F.col("n_nationkey")).alias("catalogue_no"), F.col("n_name").alias("title"), F.lit("1").alias("active"), F.lit(1).alias("ord"))
    out = writes.upsert(base, news, ["catalogue_no"], ["ord"])
    lost = writes.missing_after(out, news, ["catalogue_no"]).select("catalogue_no", F.lit(True).alias("missing"))
    return out.join(lost, "catalogue_no", "left").withColumn("missing", F.coalesce("missing", F.lit(False)))


@query("""
select s_suppkey, 'art/' || s_suppkey || case when s_suppkey % 3 = 0 then '.jpg' else '.png' end as path from supplier where s_suppkey % 4 <> 0
union all select s_suppkey, null from supplier where s_suppkey % 4 = 0
union all select s_suppkey, 'art/' || s_suppkey || case when s_suppkey % 3 = 0 then '.jpg' else '.png' end from supplier where s_suppkey % 4 <> 0 and s_suppkey <= 5
""")
def artwork_files(spark, sf_dir):
    """The first of each cover's possible files that is there; rows that are alike each have theirs."""
    supplier, k = t(spark, sf_dir, "supplier"), F.col("s_suppkey")
    listing = supplier.where("s_suppkey % 4 <> 0 and s_suppkey % 3 = 0").select(_s("art/", k, ".jpg").alias("path")).union(supplier.where("s_suppkey % 4 <> 0").select(_s("art/", k, ".png"))).union(supplier.select(_s("art/", k, ".gif")))
    wanted = supplier.select("s_suppkey")
    wanted = wanted.union(wanted.where("s_suppkey <= 5 and s_suppkey % 4 <> 0"))
    return writes.file_state(wanted, listing, "art/", "s_suppkey").select("s_suppkey", "path")


@query("""
select p_partkey, case p_partkey % 4 when 0 then 'skipped' when 1 then 'skipped' when 2 then 'updated' else 'error' end as state,
  case p_partkey % 4 when 0 then ' ' when 1 then 'movie:a.wav' || chr(10) || 'moviemac:A/x/a.wav' || chr(10) || 'moviemac:B/x/a.wav' when 2 then 'movie:' || p_partkey || '.wav' || chr(10) || 'moviemac:A/x/' || p_partkey || '.wav' || chr(10) || 'moviemac:B/x/' || p_partkey || '.wav' else 'moviemac:C/y.wav' end as file
from part
""")
def repaired_references(spark, sf_dir):
    """Multi-line references that name one base of two."""
    k = F.col("p_partkey")
    file = F.when(k % 4 == 0, " ").when(k % 4 == 1, "movie:a.wav\nmoviemac:A/x/a.wav\nmoviemac:B/x/a.wav").when(k % 4 == 2, _s("  moviemac:B/x/", k, ".wav\r\n")).otherwise("moviemac:C/y.wav")
    return writes.repaired_paths(t(spark, sf_dir, "part").select("p_partkey", file.alias("file")), "file", ["A", "B"])


@query("""
select c_custkey as k, row_number() over (partition by c_nationkey order by lower(c_mktsegment), c_custkey % 7, lower(c_name))::int as by_people, row_number() over (partition by c_nationkey order by case when c_custkey % 4 = 0 then 999 else c_custkey % 30 end, c_custkey)::int as by_name from customer
""")
def listing_orders(spark, sf_dir):
    """Places by album and title as people sort them, and by the number in a file's name."""
    k = F.col("c_custkey")
    rows = t(spark, sf_dir, "customer").select(k.alias("k"), "c_nationkey", F.col("c_mktsegment").alias("album"), (k % 7).alias("seq"), F.when(k % 2 == 0, F.col("c_name")).otherwise(F.upper("c_name")).alias("title"), F.when(k % 4 == 0, "movie:song.wav").otherwise(_s("movie:", k % 30, " song.wav")).alias("file"))
    place = lambda order: F.row_number().over(Window.partitionBy("c_nationkey").orderBy(*order))
    return rows.select("k", place(rollups.listing_order("album", "seq", "title", locale=True)).alias("by_people"), place([rollups.by_number_in_name("file"), "k"]).alias("by_name"))


@query("""
select 'total' as what, count(*) as n from orders union all select 'succeeded', count(*) from orders where o_orderkey % 3 <> 0 union all select 'failed', count(*) from orders where o_orderkey % 3 = 0
union all select 'updated', count(*) from orders where o_orderkey % 2 = 0 union all select 'created', count(*) from orders where o_orderkey % 2 = 1 union all select 'skipped', 0
""")
def result_tallies(spark, sf_dir):
    """Results of a batch by action and outcome."""
    k = F.col("o_orderkey")
    counted = rollups.tallies(t(spark, sf_dir, "orders").select((k % 3 != 0).alias("ok"), F.when(k % 2 == 0, "updated").otherwise("created").alias("action")))
    return counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("n")) for c in counted.columns])).alias("x")).select("x.*")


@query("""
select event_id, case event_id % 4 when 0 then 'No audio field' when 1 then 'Unparseable' else 'URL-based' end as sheet from events where event_id % 4 <> 3
""")
def problem_rows(spark, sf_dir):
    """The rows of a problem report, written a folder a sheet and read back."""
    r = F.col("event_id") % 4
    rows = t(spark, sf_dir, "events").select("event_id", F.when(r == 1, "nowhere").when(r == 2, "https://h.example/x").when(r == 3, "/masters/a/x.wav").alias("file"))
    found = audio.resolve(rows, [("file", ["file"])], [], "Mount/", ["masters"])
    report = rollups.problem_report(found, audio.bucket_of(), {"no-audio-field": "No audio field", "unparseable-path": "Unparseable", "url": "URL-based"}).select("event_id", "sheet")
    return writes.save_sheets(report, new_folder(spark))


@query("""
select p_brand as "group", count(*) filter (p_size % 2 = 0) as even, count(*) filter (p_size > 10) as large from part where p_size % 2 = 0 or p_size > 10 group by p_brand
""")
def source_counts(spark, sf_dir):
    """Rows of each source by group."""
    part = t(spark, sf_dir, "part").withColumn("group", F.col("p_brand"))
    return presence.counts({"even": part.where("p_size % 2 = 0"), "large": part.where("p_size > 10")})
