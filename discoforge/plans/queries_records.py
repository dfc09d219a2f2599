"""Registered queries of records, release messages, presence and replication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from discoforge.operators import cuts, keys, writes
from discoforge.plans import messages, presence, records, release, replicate
from discoforge.sources import files, sheets

from .queries_fields import _s
from .registry import query, t


def _envelopes(spark, sf_dir) -> DataFrame:
    """Parts as records of field texts, with fields under several names, blank ones and missing ones."""
    k, n = F.col("p_partkey"), F.col("p_size")
    fields = {
        "Song Title": F.when(k % 2 == 0, " ").otherwise(F.col("p_name")),
        "Track Name": F.col("p_type"),
        "Track Artist": F.col("p_brand"),
        "Album": _s("Album ", k % 7),
        "Album Title": F.when(k % 3 == 0, "").otherwise("Titled"),
        "Filename": _s(" F", k, ".v1.wav"),
        "Sequence Number": F.when(k % 4 == 0, "0").otherwise(_s("0", n)),
        "Duration": F.when(k % 2 == 0, _s("0", k % 9 + 1, ":30:00")).otherwise(_s(n, ".4")),
        "Composer": _s("Ann ", k % 3),
        "Composer 2": F.when(k % 2 == 0, _s("ann ", k % 3)).otherwise("Bob"),
        "Producers": F.lit("Pat; Quin,Pat"),
        "Explicit": F.when(k % 5 == 0, "Yes").otherwise("No"),
        "Parental": F.when(k % 7 == 0, "Explicit").otherwise(" "),
        "Artwork URL": _s("https://h.example/i/c", k, ".jpg"),
        "ISRC": _s("za-", k),
    }
    held = F.create_map(*[x for f, c in fields.items() for x in (F.lit(f), c)])
    return t(spark, sf_dir, "part").select(k.cast("string").alias("recordId"), F.lit("1").alias("modId"), F.map_filter(held, lambda _, v: v.isNotNull()).alias("fieldData"), F.create_map().cast("map<string,string>").alias("portalData"))


@query("""
select p_partkey::varchar as record_id, case when p_partkey % 2 = 0 then p_type else p_name end as title, p_brand as artist_name, case when p_partkey % 3 <> 0 then 'Titled' end as album_title, 'F' || p_partkey || '.v1.wav' as wav_filename, 'F' || p_partkey || '.v1' as asset_number,
  'c' || p_partkey as image_asset_number, case when p_partkey % 4 <> 0 then p_size::bigint end as sequence_no, case when p_partkey % 2 = 0 then ((p_partkey % 9 + 1) * 3600 + 1800)::bigint else p_size::bigint end as duration_sec,
  p_partkey % 5 = 0 or p_partkey % 7 = 0 as explicit, case when p_partkey % 2 = 0 then 'Ann ' || p_partkey % 3 else 'Ann ' || p_partkey % 3 || '|Bob' end as composers, 'Pat|Quin|Pat' as producers, 'za-' || p_partkey as isrc
from part
""")
def catalogue_records(spark, sf_dir):
    """Records of the catalogue as tracks."""
    out = records.catalogue_tracks(_envelopes(spark, sf_dir))
    out = out.withColumns({c: F.array_join(c, "|") for c in ("composers", "producers")})
    return records.summaries(out, ["record_id", "title", "artist_name", "album_title", "wav_filename", "asset_number", "image_asset_number", "sequence_no", "duration_sec", "explicit", "composers", "producers", "isrc"])


@query("""
select p_partkey::varchar as record_id, case when p_partkey % 3 <> 0 then 'Titled' else 'Album ' || p_partkey % 7 end as album_title, ' F' || p_partkey || '.v1' as asset_number, case when p_partkey % 4 = 0 then 0 else p_size end::bigint as track_number,
  case when p_partkey % 2 = 0 then ((p_partkey % 9 + 1) * 60 + 30)::bigint else p_size::bigint end as duration_sec, case when p_partkey % 2 = 0 then 'PT' || (p_partkey % 9 + 1) || 'M30S' else 'PT' || p_size || 'S' end as duration,
  p_partkey % 5 = 0 or p_partkey % 7 = 0 as explicit, case when p_partkey % 2 = 0 then 'Ann ' || p_partkey % 3 || '|ann ' || p_partkey % 3 else 'Ann ' || p_partkey % 3 || '|Bob' end as composers, null::varchar as absent
from part
""")
def content_records(spark, sf_dir):
    """Records of the content system as tracks, narrowed to a summary."""
    out = records.content_tracks(_envelopes(spark, sf_dir)).withColumn("composers", F.array_join("composers", "|"))
    out = out.withColumn("duration", F.when(F.col("duration_sec") < 60, F.concat(F.lit("PT"), F.col("duration_sec").cast("string"), F.lit("S"))).otherwise(F.col("duration")))
    return records.summaries(out, ["record_id", "album_title", "asset_number", "track_number", "duration_sec", "duration", "explicit", "composers", "absent"])


@query("""
select conv_id, turn, role as show_title, 'Talk ' || turn as episode_title, case when turn % 2 = 0 then 'Hide' else 'Show' end as visibility, case when conv_id % 2 = 0 then 'yes' else '' end as featured, (conv_id % 3 = 0)::int as explicit, nullif(turn, 0)::bigint as number, case when turn % 2 = 1 then '05/0' || (conv_id % 9 + 1) || '/2024' end as published
from conversations
""")
def episode_rows(spark, sf_dir):
    """Podcast forms as records."""
    k, n = F.col("conv_id"), F.col("turn")
    form = t(spark, sf_dir, "conversations").select(
        _s(" ", F.col("role")).alias("show_title"), _s(k, ":", n).alias("host"), F.lit(None).cast("string").alias("artwork_url"), F.lit("c").alias("category"), F.lit("en").alias("language_code"), _s("Talk ", n, " ").alias("episode_title"), F.lit("d").alias("description"), F.lit("u").alias("audio_url"), n.alias("duration_sec"),
        F.when(n % 2 == 0, "Hide").otherwise("odd").alias("visibility"), F.when(k % 2 == 0, "yes").otherwise("no").alias("featured"), F.when(k % 3 == 0, "yes").otherwise("no").alias("explicit"), n.alias("episode_number"), F.when(n % 2 == 1, _s("2024-05-0", k % 9 + 1)).otherwise("soon").alias("publish_date"),
    )
    out = records.episode_row(form)
    host = F.split("Host", ":")
    return out.select(host[0].cast("long").alias("conv_id"), host[1].cast("long").alias("turn"), F.col("Show Title").alias("show_title"), F.col("Episode Title").alias("episode_title"), F.col("Visibility").alias("visibility"), F.col("Featured").alias("featured"), F.col("Explicit").alias("explicit"), F.col("Episode Number").cast("long").alias("number"), F.col("PublishDate").alias("published"))


@query("""
select c_custkey as ord, case when c_custkey % 2 = 0 then c_name else 'Tag ' || c_custkey end as title, case when c_custkey % 3 = 0 then 'From name' end as artist from customer
""")
def submission_fields(spark, sf_dir):
    """What a form says, else the file's tags, else its name."""
    k = F.col("c_custkey")
    form = t(spark, sf_dir, "customer").select(k.alias("ord"), F.when(k % 2 == 0, F.col("c_name")).otherwise(" ").alias("title"), _s("Tag ", k).alias("tag_title"), F.lit(" ").alias("artist"), F.when(k % 3 == 0, "From name").alias("name_artist"))
    return sheets.submission(form, ["title", "artist"])


@query("""
select c_custkey as ord, c_name as track, c_mktsegment as album_genre, c_mktsegment as track_genre, 'en' as language, 'en' as audio_language, strftime(date '2024-01-01' + c_nationkey::int, '%Y-%m-%d') as released, 'Bogus' as ignored from customer where c_custkey % 4 <> 0
""")
def intake_rows(spark, sf_dir):
    """An intake sheet in the target's columns; rows that are null throughout go."""
    k = F.col("c_custkey")
    some = lambda c: F.when(k % 4 != 0, c)
    sheet = t(spark, sf_dir, "customer").select(k.alias("ord"), some(F.col("c_name")).alias(" TRACK Name"), some(F.col("c_mktsegment")).alias("Genre "), some(F.lit("en")).alias("Language*"), some(F.date_add(F.lit("2024-01-01").cast("date"), F.col("c_nationkey"))).alias("Release Date"), some(F.lit("z")).alias("Bogus"))
    rows, ignored = sheets.intake_sheet(sheet, ["Track name", "Album genre", "Track genre", "Language", "Audio language", "Release Date"])
    return rows.select("ord", F.col("Track name").alias("track"), F.col("Album genre").alias("album_genre"), F.col("Track genre").alias("track_genre"), F.col("Language").alias("language"), F.col("Audio language").alias("audio_language"), F.col("Release Date").alias("released"), F.lit(",".join(ignored)).alias("ignored"))


@query("""
select p_partkey as ord, p_name as track_name, 'C' || p_partkey as catalogue, case when p_size % 2 = 0 then p_brand else 'A; B' end as composer, nullif(p_size % 5, 0)::bigint as seq, null::varchar as isrc from part where p_partkey % 3 <> 0
""")
def metadata_rows(spark, sf_dir):
    """A sheet's metadata fields, rows that name nothing left out, as the table's canonical columns."""
    k, n = F.col("p_partkey"), F.col("p_size")
    named = lambda c: F.when(k % 3 != 0, c)
    sheet = t(spark, sf_dir, "part").select(k.alias("ord"), F.col("p_name").alias("Track Name"), named(_s(" C", k)).alias("Cat #"), F.when(n % 2 == 0, F.col("p_brand")).alias("Composers"), F.lit("A").alias("Composer"), F.lit(" B").alias("Composer 3"), _s(n % 5).alias("#"))
    found = sheets.metadata_sheet(sheet)
    return writes.replaced(found.limit(0), writes.canonical(found, found.columns)).select("ord", "track_name", "catalogue", "composer", "seq", "isrc")


_MESSAGE_ROWS = """
with lines as (select c_custkey // 10 as release, row_number() over (partition by c_custkey // 10 order by c_custkey) as n, c_custkey as l_partkey, c_nationkey as l_suppkey, c_custkey % 50 as q, case when c_custkey % 3 = 0 then 'R' else 'N' end as l_returnflag from customer)
"""


def _lines(spark, sf_dir) -> DataFrame:
    """Customers as tracks of releases of ten."""
    k = F.col("c_custkey")
    rows = t(spark, sf_dir, "customer").select(F.floor(k / 10).alias("release"), k.alias("l_partkey"), F.col("c_nationkey").alias("l_suppkey"), (k % 50).alias("q"), F.when(k % 3 == 0, "R").otherwise("N").alias("l_returnflag"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("release").orderBy("l_partkey")))


_TRACKS_SQL = """
select release, n::int as ord, 'A' || n as ref, 'Song & ' || l_partkey as title, 'Artist ' || l_suppkey as artist_name, 'Album ' || release as album_title, 'ZAABC' || lpad((l_partkey % 10000000)::varchar, 7, '0') as isrc, '60' || release as barcode, 'CAT' || release as catalogue_no,
  (q * 60 + 7)::double as duration_sec, n::bigint as track_number, l_returnflag = 'R' as explicit, 2000 + (release % 20)::int as rights_year, 'Com ' || n || ':Composer' as credits, 't' || n || '.wav' as audio_file, case when release % 2 = 0 then '382' else '41' end as form
from lines
"""


@query(_MESSAGE_ROWS + _TRACKS_SQL)
def message_tracks(spark, sf_dir):
    """Messages in two forms as tracks."""
    return _shown(messages.tracks(_messages(_lines(spark, sf_dir)).repartition("release"), "release"))


@query("""
with lines as (select c_custkey // 500 as release, row_number() over (partition by c_custkey // 500 order by c_custkey) as n, c_custkey as l_partkey, c_nationkey as l_suppkey, c_custkey % 50 as q, case when c_custkey % 3 = 0 then 'R' else 'N' end as l_returnflag from customer)
""" + _TRACKS_SQL)
def message_files(spark, sf_dir):
    """Message files of five hundred recordings, which tasks share, as tracks."""
    folder, k = cuts.new_folder(spark), F.col("c_custkey")
    rows = t(spark, sf_dir, "customer").select(F.floor(k / 500).alias("release"), k.alias("l_partkey"), F.col("c_nationkey").alias("l_suppkey"), (k % 50).alias("q"), F.when(k % 3 == 0, "R").otherwise("N").alias("l_returnflag"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("release").orderBy("l_partkey")))
    files.written_files(_messages(rows).select(_s(F.col("release"), ".xml").alias("name"), F.col("xml").cast("binary").alias("content")), folder)
    found = messages.tracks_of_files(spark, folder).withColumn("release", F.regexp_extract("path", r"(\d+)\.xml$", 1).cast("long"))
    return _shown(found)


def _messages(rows: DataFrame) -> DataFrame:
    """release and xml: a message for each release's tracks, in the older form for even ones."""
    n, old = F.col("n").cast("string"), F.col("release") % 2 == 0
    esc = lambda tag, *content: _s(f"<{tag}>", *content, f"</{tag.split()[0]}>")
    artist = lambda who: esc("PartyName", esc("FullName", who))
    body = lambda titled: F.concat(
        esc("DisplayArtist", artist("Guest"), esc("ArtistRole", "FeaturedArtist")), esc('DisplayArtist SequenceNumber="1"', artist(_s("Artist ", F.col("l_suppkey"))), esc("ArtistRole", "MainArtist")),
        esc("ResourceContributor", artist(_s("Com ", n)), esc("ResourceContributorRole", "Composer")), esc("PLine", esc("Year", (F.lit(2000) + F.col("release") % 20).cast("string"))),
        esc("ParentalWarningType", F.when(F.col("l_returnflag") == "R", "Explicit").otherwise("NotExplicit")), titled,
        esc("TechnicalSoundRecordingDetails", esc("File", esc("FileName", _s("res/T", n, ".WAV")))),
    )
    title = _s("Song &amp; ", F.col("l_partkey"))
    start = F.concat(esc("SoundRecordingId", esc("ISRC", _s("ZAABC", F.lpad((F.col("l_partkey") % 10000000).cast("string"), 7, "0")))), esc("ResourceReference", _s("A", n)), esc("Duration", _s("PT", F.col("q"), "M7S")))
    typed = F.concat(esc('Title TitleType="AlternativeTitle"', esc("TitleText", "no")), esc('Title TitleType="FormalTitle"', esc("TitleText", title)))
    recording = F.when(old, esc("SoundRecording", start, esc("ReferenceTitle", esc("TitleText", title)), esc("SoundRecordingDetailsByTerritory", body(F.lit(""))))).otherwise(esc("SoundRecording", start, body(typed)))
    rows = rows.select("release", "n", recording.alias("x"), esc("ReleaseResourceReference", _s("A", n)).alias("r"))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", c))), lambda s: s[c]), "")
    rows = rows.groupBy("release").agg(listed("x").alias("x"), listed("r").alias("r"))
    old = F.col("release") % 2 == 0
    main = F.concat(esc("ReleaseId", esc("ICPN", _s("60", F.col("release"))), esc("CatalogNumber", _s("CAT", F.col("release")))), esc("ReferenceTitle", esc("TitleText", _s("Album ", F.col("release")))), esc("ReleaseResourceReferenceList", F.col("r")), esc("ReleaseType", "Album"))
    xml = F.concat(F.when(old, '<ern:NewReleaseMessage xmlns:ern="http://x.example/ern/382">').otherwise('<ern:NewReleaseMessage xmlns:ern="http://x.example/ern/41">'), esc("ResourceList", F.col("x")), esc("ReleaseList", esc("Release", main)), F.lit("</ern:NewReleaseMessage>"))
    return rows.select("release", xml.alias("xml"))


def _shown(found: DataFrame) -> DataFrame:
    credits = F.array_join(F.transform("credits", lambda c: F.concat_ws(":", c["name"], c["role"])), "|")
    return found.select("release", "ord", "ref", "title", "artist_name", "album_title", "isrc", "barcode", "catalogue_no", "duration_sec", "track_number", "explicit", F.col("rights_year").cast("int").alias("rights_year"), credits.alias("credits"), "audio_file", F.when(F.col("release") % 2 == 0, "382").otherwise("41").alias("form"))


_PARTIES = release.Parties("PADPIDA1", "Sender & Co", "PADPIDA2", "Store", "Label")


@query(_MESSAGE_ROWS + """
select release, n::int as ord, 'Song & ' || l_partkey as title, 'Artist ' || l_suppkey as artist_name, 'Album <' || release || '>' as album_title, 'ZAABC' || lpad((l_partkey % 10000000)::varchar, 7, '0') as isrc, lpad(release::varchar, 13, '6') as barcode, 'CAT' || release as catalogue_no,
  nullif(q * 60, 0)::double as duration_sec, l_returnflag = 'R' as explicit, 'Pub [SOC]|Com ' || n as credits, lower('CAT' || release || '_' || lpad(n::varchar, 3, '0') || '.wav') as audio_file,
  (count(*) over (partition by release))::int as recordings, 'msg' || release as message_id, 'PT' || (sum(q * 60) over (partition by release) // 3600)::bigint || 'H' || (sum(q * 60) over (partition by release) // 60 % 60)::bigint || 'M0S' as whole, (count(*) over (partition by release) + 1)::int as files
from lines
""")
def release_messages(spark, sf_dir):
    """Releases planned and rendered as messages, read back as tracks."""
    k = F.col("release")
    none = F.lit(None).cast("string")
    tracks = _lines(spark, sf_dir).select(
        "release", F.col("n").alias("ord"), F.col("n").cast("long").alias("sequence_no"), _s("Song & ", F.col("l_partkey")).alias("title"), _s("Artist ", F.col("l_suppkey")).alias("artist_name"), _s("Album <", k, ">").alias("album_title"), F.lit("Various").alias("album_artist"),
        _s("ZAABC", F.lpad((F.col("l_partkey") % 10000000).cast("string"), 7, "0")).alias("isrc"), F.lpad(k.cast("string"), 13, "6").alias("barcode"), _s("CAT", k).alias("catalogue_no"), (F.col("q") * 60).alias("duration_sec"), (F.col("l_returnflag") == "R").alias("explicit"), F.lit("2001").alias("year"), F.lit("Pop").alias("genre"), F.lit("en").alias("language"),
        F.array(_s("Com ", F.col("n"))).alias("composers"), F.array().cast("array<string>").alias("producers"), F.lit("Pub").alias("publishers"),
        *[none.alias(c) for c in ("label", "pline_text", "cline_text", "original_release_date", "release_date", "image_asset_number", "asset_number", "wav_filename", "resource_reference", "technical_resource")], F.lit("0123456789abcdef0123456789abcdef").alias("audio_hash_md5"),
    )
    parties = release.Parties("PADPIDA1", "Sender & Co", "PADPIDA2", "Store", "Label", "SOC")
    plans = cuts.written(release.plan(tracks, "release", parties, "2024-05-06"))  # planned once for messages and file lists
    xml = cuts.written(release.render(plans, parties, _s("msg", k), F.lit("2024-05-06T07:08:09+00:00"), "2024-05-06").select("release", "duration", "xml"))  # rendered once for all readers
    found = messages.tracks(xml.select("release", "xml"), "release").where(F.col("ref").startswith("A"))
    credits = F.array_join(F.transform("credits", lambda c: F.concat_ws(":", c["name"], c["role"])), "|")
    held = xml.select("release", F.size(F.split("xml", "<SoundRecording>")).alias("m"), F.regexp_extract("xml", "<MessageId>([^<]*)", 1).alias("message_id"), F.col("duration").alias("whole"))
    packed = release.files(plans, "release").groupBy("release").agg(F.count("*").cast("int").alias("files"))
    out = found.join(held, "release").join(packed, "release")
    return out.select("release", "ord", "title", "artist_name", "album_title", "isrc", "barcode", "catalogue_no", "duration_sec", "explicit", credits.alias("credits"), "audio_file", (F.col("m") - 1).alias("recordings"), "message_id", "whole", "files")


@query(_MESSAGE_ROWS + """
, placed as (select *, row_number() over (partition by release order by case when n % 3 = 0 then 999 else n end, n) as place from lines)
select release, place::int as ord, 'A' || place as ref, 'Song ' || l_partkey as title, case when n % 2 = 0 then 'Various' else 'Artist ' || l_suppkey end as artist_name, 'Album ' || release as album_title, nullif(q * 60, 0)::double as duration_sec, l_returnflag = 'R' as explicit, 'zaabc' || l_partkey || '.wav' as audio_file,
  case when release % 2 = 0 then 2 else 0 end as covers, case when release % 3 = 0 then '2024-01-01' else '1999-01-01' end as starts
from placed
""")
def short_messages(spark, sf_dir):
    """Releases rendered as short messages, read back as tracks."""
    k, n = F.col("release"), F.col("n")
    none = F.lit(None).cast("string")
    tracks = _lines(spark, sf_dir).select(
        "release", n.alias("ord"), F.when(n % 3 != 0, n).alias("sequence_no"), _s("ZAABC", F.col("l_partkey")).alias("isrc"), _s("Song ", F.col("l_partkey")).alias("title"), F.when(n % 2 == 0, "").otherwise(_s("Artist ", F.col("l_suppkey"))).alias("artist_name"), (F.col("q") * 60).alias("duration_sec"), none.alias("year"), none.alias("genre"), F.lit("en").alias("language"), F.when(F.col("l_returnflag") == "R", True).alias("explicit"), none.alias("audio_filename"),
        _s("Album ", k).alias("album_title"), F.lit("Various").alias("album_artist"), F.lit("601").alias("barcode"), F.lit("CAT").alias("catalogue_no"), F.when(k % 3 != 0, "1999").alias("album_year"), F.lit("Pop").alias("album_genre"), F.when(k % 2 == 0, "c.jpg").alias("artwork_filename"),
    )
    xml = release.render_simple(tracks, "release", _PARTIES, _s("m", k), F.lit("2024-05-06T07:08:09+00:00"), 2024).select("release", "xml")
    xml = cuts.written(xml)  # rendered once for all readers
    found = messages.tracks(xml.select("release", "xml"), "release").where("title is not null")
    held = xml.select("release", (F.size(F.split("xml", ">ARTWORK<")) - 1).alias("covers"), F.regexp_extract("xml", "<StartDate>([^<]*)", 1).alias("starts"))
    return found.join(held, "release").select("release", "ord", "ref", "title", "artist_name", "album_title", "duration_sec", "explicit", "audio_file", "covers", "starts")


@query("""
select o_orderkey as release, (o_orderkey % 4)::int as position, o_orderkey % 5 <> 0 as ok, case when o_orderkey % 5 <> 0 then 'created' else 'failed' end as action, case when o_orderkey % 5 <> 0 then 'T' || o_orderkey else '' end as title, 'Ann (Composer)' || chr(10) || 'Bob ()' as credits, case when o_orderkey % 2 = 0 then 'Yes' else 'No' end as explicit, 'Import' as by, case when o_orderkey % 3 = 0 then 10 * o_orderkey end as file_size
from orders where o_orderkey % 4 in (1, 3)
""")
def imported_tracks(spark, sf_dir):
    """The chosen tracks of messages as records to create, with the size of their files."""
    k = F.col("o_orderkey")
    credit = lambda name, role: F.struct(F.lit(name).alias("name"), F.lit(role).cast("string").alias("role"))
    rows = t(spark, sf_dir, "orders").select(k.alias("release"), (k % 4).cast("int").alias("ord"), F.when(k % 5 != 0, _s("T", k)).alias("title"), F.lit(" ").alias("isrc"), (k % 2 == 0).alias("explicit"), F.array(credit("Ann", "Composer"), credit("Bob", None)).alias("credits"), _s("f", k, ".wav").alias("audio_file"), F.create_map(F.when(k % 3 == 0, _s("f", k, ".wav")).otherwise("x"), 10 * k).alias("files"))
    out = messages.imported(messages.with_files(rows, "files", "audio_file"), [1, 3], "Import")
    return out.select("release", F.col("ord").alias("position"), "ok", "action", F.col("fields")["Title"].alias("title"), F.col("fields")["Credits"].alias("credits"), F.col("fields")["Explicit"].alias("explicit"), F.col("fields")["SubmittedBy"].alias("by"), "file_size")


@query("""
with k as (select c_custkey as k, c_name as name, 'g' || c_custkey // 40 as grp from customer)
select grp as "group", case when k % 4 <> 0 then 'C' || k when k % 5 <> 0 then 'C' || k end as isrc, name as title, (k % 40 + 1)::bigint as sequence_no, 'F' || k || '.wav' as filename, true as in_a, k % 5 <> 0 as in_b, k % 7 = 0 as in_sheet, 'a' || k as a_id, case when k % 5 <> 0 then 'b' || k end as b_id, case when k % 7 = 0 then 's' || k end as sheet_id,
  row_number() over (partition by grp order by k % 40)::int as position from k
""")
def presence_exact(spark, sf_dir):
    """Three sources met by code, by file name and by similar title of the same number, one row after another."""
    k, name = F.col("c_custkey"), F.col("c_name")
    rows = t(spark, sf_dir, "customer").select(k.alias("ord"), _s("g", F.floor(k / 40)).alias("group"), (k % 40 + 1).alias("sequence_no"), F.col("c_mktsegment").alias("artist"), "c_name")
    ord_, name = F.col("ord"), F.col("c_name")
    own = lambda df, isrc, title, filename, x: df.select("group", isrc.cast("string").alias("isrc"), title.alias("title"), "artist", "sequence_no", filename.cast("string").alias("filename"), _s(x, ord_).alias("record_id"), "ord")
    none = F.lit(None)
    a = own(rows, F.when(ord_ % 4 != 0, _s("c", ord_)), name, _s("F", ord_, ".wav"), "a")
    b = own(rows.where(ord_ % 5 != 0), F.when(ord_ % 4 != 1, _s(" c", ord_)), _s(name, "x"), F.when(ord_ % 4 == 0, _s("f", ord_, ".mp3")), "b")
    sheet = own(rows.where(ord_ % 7 == 0), F.when(ord_ % 4 == 2, _s("C", ord_)), _s(name, " y"), none, "s")
    return presence.matrix({"a": a, "b": b, "sheet": sheet}, "sheet").drop("artist")


@query("""
select o_orderkey, case when o_orderkey % 4 = 0 then 'Own' else 'cat ' || o_custkey end as title, case when o_orderkey % 4 = 1 then null when o_orderkey % 2 = 0 then 'art ' || o_custkey else 'cover' end as artwork_url,
  case o_orderkey % 4 when 0 then 'isrc' when 2 then 'filename' when 3 then 'sequence_no' end as match_via, o_orderkey % 4 = 1 as alone from orders
""")
def hydrated_tracks(spark, sf_dir):
    """Tracks filled from the catalogue by code, file name or number, the cover from the album."""
    customer = t(spark, sf_dir, "customer")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    # a catalogue a customer, with its one track, and a cover that only the even orders' match has for itself
    held = customer.select(_s("K", F.col("c_custkey")).alias("catalogue_no"), _s("I", F.col("c_custkey")).alias("isrc"), _s("F", F.col("c_custkey"), ".wav").alias("filename"), F.lit(1).alias("sequence_no"), _s("cat ", F.col("c_custkey")).alias("title"), _s("art ", F.col("c_custkey")).alias("artwork_url"), F.lit(2).alias("ord"))
    plain = customer.select(_s("K", F.col("c_custkey")).alias("catalogue_no"), F.lit(None).cast("string").alias("isrc"), F.lit(None).cast("string").alias("filename"), F.lit(9).alias("sequence_no"), _s("cat ", F.col("c_custkey")).alias("title"), F.lit(" ").alias("artwork_url"), F.lit(3).alias("ord"))
    first = customer.select(_s("K", F.col("c_custkey")).alias("catalogue_no"), F.lit(None).cast("string").alias("isrc"), F.lit(None).cast("string").alias("filename"), F.lit(8).alias("sequence_no"), F.lit("other").alias("title"), F.lit("cover").alias("artwork_url"), F.lit(1).alias("ord"))
    tracks = t(spark, sf_dir, "orders").select("o_orderkey", _s("K", c).alias("catalogue_no"), F.when(k % 4 == 0, _s(" i", c)).alias("isrc"), F.when(k % 4 == 2, _s("F", c, ".mp3")).otherwise("none").alias("filename"), F.when(k % 4 == 3, 9).otherwise(77).alias("sequence_no"), F.when(k % 4 == 0, "Own").when(k % 4 == 1, _s("cat ", c)).otherwise(" ").alias("title"), F.when(k % 2 == 0, _s("art ", c)).alias("artwork_url"))
    out = replicate.hydrated(tracks, held.union(plain).union(first), ["title"])
    return out.select("o_orderkey", "title", "artwork_url", "match_via", F.col("match_via").isNull().alias("alone"))


@query("""
with o as (select o_orderkey as k, o_custkey as c, o_orderkey % 6 as r, min(o_orderkey) over (partition by o_custkey, o_orderkey % 6 < 3, o_orderkey % 6 = 5) as first from orders)
select o.k as o_orderkey, case when r = 5 then 'failed' when c % 2 = 0 or k > first then 'updated' else 'created' end as pushed, case when r <> 5 and c % 2 = 0 then 'r' || c end as record_id, case when r <> 5 and c % 2 = 1 then first end as created_by_order, case when r = 4 then 'no asset number' end as error,
  c % 3 <> 0 as ensured, case when r = 5 then 'filename,catalogue_no' when r = 4 then 'artist_name' when r < 3 then 'filename' else '' end as missing from o
""")
def pushed_tracks(spark, sf_dir):
    """Tracks pushed to a target one after another by code or file name, new ones several times, and what keeps some from it."""
    k, c, r = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderkey") % 6
    base = t(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("ord"), _s("r", F.col("c_custkey")).alias("record_id"), _s("I", F.col("c_custkey")).alias("isrc"), _s("F", F.col("c_custkey")).alias("filename"), _s("K", F.col("c_custkey")).alias("catalogue_no"))
    tracks = t(spark, sf_dir, "orders").select("o_orderkey", F.when(r < 3, _s("I", c)).alias("isrc"), F.when(r.isin(3, 4), _s("F", c)).alias("filename"), F.when(r != 5, _s("K", c)).alias("catalogue_no"), F.when(r != 4, _s("AS", k)).alias("asset_number"), F.lit("T").alias("title"), F.when(r != 4, "A").alias("artist_name"), _s("K", c).alias("own"))
    pushed = replicate.ready(replicate.push(tracks, base, ["o_orderkey"], numbers=False))
    synced, refused = replicate.sync(tracks, base, ["o_orderkey"], numbers=False)
    both = synced.select("o_orderkey", F.lit(None).cast("string").alias("error")).union(refused.select("o_orderkey", "error"))
    held = t(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(_s("K", F.col("c_custkey")).alias("catalogue_no"))
    ensured = replicate.ensure_replicated(tracks.withColumn("catalogue_no", F.col("own")), held).select("o_orderkey", F.lit(True).alias("ensured"))
    out = pushed.join(both, "o_orderkey").join(ensured, "o_orderkey", "left")
    return out.select("o_orderkey", F.col("action").alias("pushed"), "record_id", F.col("created_by").alias("created_by_order"), "error", F.coalesce("ensured", F.lit(False)).alias("ensured"), F.array_join("missing", ",").alias("missing"))


@query("""
select s_suppkey, case s_suppkey % 3 when 0 then 'barcode' when 1 then 'filename' end as match_via, s_suppkey % 3 <> 2 as ok, case when s_suppkey % 3 <> 2 then s_name end as title, case when s_suppkey % 3 = 1 then s_name end as by_name, s_nationkey as paired
from supplier
""")
def bulk_listing(spark, sf_dir):
    """A listing of files with its metadata rows, by barcode and number, else by name; and rows by given pairs."""
    supplier, k = t(spark, sf_dir, "supplier"), F.col("s_suppkey")
    cache = supplier.select(k.alias("ord"), _s("60", k).alias("barcode"), (F.col("s_nationkey") + 1).alias("seq"), F.col("s_name").alias("title"))
    listing = supplier.select("s_suppkey", _s("C", k).alias("catalogue_no"), F.when(k % 3 == 1, _s("in/60", k, "_x_", F.lpad((F.col("s_nationkey") + 1).cast("string"), 3, "0"), ".wav")).otherwise("plain.wav").alias("filename"), F.when(k % 3 == 0, _s(" 60", k)).alias("barcode"), F.when(k % 3 == 0, F.col("s_nationkey") + 1).alias("sequence_no"))
    met = replicate.bulk_update(listing, cache)
    named = replicate.by_filename(listing, cache).select("s_suppkey", F.col("match.title").alias("by_name"))
    given = supplier.select(k.alias("left_id"), F.col("s_nationkey").alias("right_id"))
    paired = replicate.pairs(supplier.select(k.alias("id"), F.lit("l").alias("l")), t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.lit("r").alias("r")), given)
    out = met.join(named, "s_suppkey").join(paired.select(F.col("left_id").alias("s_suppkey"), F.col("right_id").alias("paired")), "s_suppkey")
    return out.select("s_suppkey", "match_via", "ok", F.col("match.title").alias("title"), "by_name", "paired")


@query("""
select p_partkey as id, case when p_partkey % 3 = 0 then 'isrc' when p_partkey % 3 = 1 then 'number' else 'left over' end as state from part
union all select -p_partkey, 'sheet left over' from part where p_partkey % 3 = 2
""")
def enriched_records(spark, sf_dir):
    """Records with their sheet row by code or number, and what is left over on both sides."""
    part, k = t(spark, sf_dir, "part"), F.col("p_partkey")
    rows = part.select(k.alias("id"), _s("K", k).alias("catalogue_no"), F.when(k % 3 == 0, _s("I", k)).alias("isrc"), F.when(k % 3 == 1, 5).alias("sequence_no"))
    sheet = part.select(k.alias("ord"), _s("K", k).alias("catalogue_no"), _s("i", k).alias("isrc"), F.lit(5).alias("sequence_no"))
    met, left, unused = replicate.enrich(rows, sheet)
    return met.select("id", F.col("match_via").alias("state")).union(left.select("id", F.lit("left over"))).union(unused.select(-F.col("ord"), F.lit("sheet left over")))


@query("""
select c_custkey, n.o as first_order, n.cats from customer join (select o_custkey, min(o_orderkey) as o, count(distinct o_orderpriority) as cats from orders group by o_custkey) n on o_custkey = c_custkey
""")
def catalogues_of_barcode(spark, sf_dir):
    """The catalogues of each barcode, as they came."""
    rows = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("barcode"), F.col("o_orderpriority").alias("catalogue"), "o_orderkey")
    found = keys.distinct_in_order(rows, ["barcode", "catalogue"], ["o_orderkey"])
    return found.groupBy(F.col("barcode").alias("c_custkey")).agg(F.min("at.o_orderkey").alias("first_order"), F.count("*").alias("cats"))


@query("""
select s.s_suppkey, p.p_partkey from supplier s join part p on starts_with('n' || p.p_partkey || '_1.wav', 'n' || s.s_suppkey)
""")
def files_of_barcode(spark, sf_dir):
    """Files whose names start with a barcode."""
    left = t(spark, sf_dir, "supplier").select("s_suppkey", _s("n", F.col("s_suppkey")).alias("barcode"))
    right = t(spark, sf_dir, "part").select("p_partkey", _s("n", F.col("p_partkey"), "_1.wav").alias("filename"))
    return keys.prefix_join(left, right, "barcode", "filename").select("s_suppkey", "p_partkey")


@query("""
select p_partkey as record_id, 'SUGGESTED TITLE:' || chr(10) || p_brand || ' – ' || p_name || ' (1999)' as head, case when p_size % 2 = 0 then p_name || ' by ' || p_brand || ' — from the album "' || p_type || '" (1999).' else p_name || ' by ' || p_brand || ' (1999).' end as line, '#Site #Pop #' || regexp_replace(p_brand, '[^a-zA-Z0-9]', '', 'g') as tags, p_brand || ', ' || p_name || ', pop, 1999' as last
from part
""")
def sidecar_texts(spark, sf_dir):
    """The texts beside videos."""
    songs = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("record_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(" ").alias("album"), F.lit("1999").alias("year"), F.lit("pop").alias("genre"), F.lit(None).cast("string").alias("p_line"))
    lines = F.split("text", "\n")
    out = release.sidecar(songs, "https://s.example", "Owner", "#Site")
    return out.select("record_id", F.concat_ws("\n", lines[0], lines[1]).alias("head"), lines[4].alias("line"), F.get(F.filter(lines, lambda x: x.startswith("#")), F.lit(0)).alias("tags"), F.element_at(lines, -1).alias("last"))
