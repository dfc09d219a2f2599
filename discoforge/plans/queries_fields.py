"""Registered queries of the column functions: keys, names, numbers, dates and flags in the forms that records hold them in."""

from __future__ import annotations

from pyspark.sql import functions as F

from discoforge.functions import text, values
from discoforge.operators import rollups, validation
from discoforge.sources import sheets

from .registry import query, t


def _s(column, *around):
    """Texts and columns end to end."""
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in (column, *around)])


@query("""
select c_custkey, case when c_custkey % 5 <> 0 then c_name end as cleaned, nullif(c_custkey % 3, 0) as number, (c_custkey % 50 + 0.5)::double as amount, 'ab' || c_custkey || 'xy' as loose,
  'ete a customer ' || right(c_name, 9) || ' mix' as words, 'big ' || lower(c_name) as search, '#Music #' || c_mktsegment || ' #Customer' || right(c_name, 9) as tags,
  case when c_custkey % 2 = 0 then c_custkey % 20 else 7 end as in_name, case when c_custkey % 4 = 0 then 'A' else 'B' end as picked,
  round(1 - (case when c_custkey % 2 = 0 then 1 else 2 end) / (case when c_custkey % 2 = 0 then 18 else 17 end)::double, 6) as alike
from customer
""")
def text_forms(spark, sf_dir):
    """Texts as they come and the keys made of them."""
    k, name = F.col("c_custkey"), F.col("c_name")
    return t(spark, sf_dir, "customer").select(
        "c_custkey",
        text.clean(F.when(k % 5 == 0, " \u00a0\t ").otherwise(_s(" \t", name, "\u00a0\n"))).alias("cleaned"),
        values.nonzero_int(_s(k % 3, " tracks")).alias("number"),
        values.leading_float(_s(" ", k % 50, ".5kg")).alias("amount"),
        text.loose_key(_s("AB-", k, "_x.Y")).alias("loose"),
        text.title_words(_s("Été  à ", name, " (Mix).WAV")).alias("words"),
        text.search_key(_s("  Big \t ", name, " ")).alias("search"),
        text.hashtags("#Music", "c_mktsegment", "c_name").alias("tags"),
        values.number_in_container(F.when(k % 2 == 0, _s("movie:", F.lpad((k % 20).cast("string"), 2, "0"), " Song.wav\rimage:x")).otherwise("https://h.example/a/7 b.wav?x=1")).alias("in_name"),
        text.pick(F.when(k % 4 == 0, "A").otherwise(" "), F.lit(None).cast("string"), F.lit("B")).alias("picked"),
        F.round(text.similarity(name, F.when(k % 2 == 0, _s(name, "x")).otherwise(_s("Qx", F.substring(name, 3, 30)))), 6).alias("alike"),
    )


@query("""
select p_partkey, (p_size * 60 + 12.5)::double as iso_length, case when p_size % 4 = 0 then '' else '05/' || lpad((p_size % 28 + 1)::varchar, 2, '0') || '/2024' end as slashed,
  case p_partkey % 3 when 0 then 'a b/' || p_partkey || '+.wav' when 1 then 'x/' || p_partkey || '.wav' end as object_key, p_partkey % 4 <> 3 as is_reference,
  case when p_partkey % 2 = 0 then 'AS' || p_partkey else 'CAT' || p_size || '_' || lpad(p_size::varchar, 3, '0') end as asset,
  case when p_partkey % 2 = 0 then 'Song.WAV' else 'CAT' || p_size || '_' || lpad(p_size::varchar, 3, '0') || '.wav' end as wave,
  p_size % 3 = 0 or p_size % 5 = 0 as either, p_size % 3 = 0 or (p_size % 3 = 1 and p_size % 5 = 0) or p_size % 5 = 0 as first_of,
  case when p_partkey % 2 = 0 then 'Owner' else nullif(p_brand, '') end as label, case when p_partkey % 2 = 0 then '℗ 2024 ' || p_brand || ' under exclusive license to Own' end as p_line,
  p_name || ' é' as decoded, case when p_partkey % 2 = 0 then upper('0123456789abcdef0123456789abcdef') else upper(md5(p_name)) end as hash,
  strftime(date '2024-01-01' + p_size::int, '%Y-%m-%d') as day, p_partkey % 2 = 0 as jpeg
from part
""")
def value_forms(spark, sf_dir):
    """Values in the forms that systems write them in."""
    k, n = F.col("p_partkey"), F.col("p_size")
    catalogue = _s("CAT", n)
    asset = values.asset_number(F.when(k % 2 == 0, _s("AS ", k)), catalogue, F.col("p_size"))
    mark = F.when(k % 3 == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode(_s(F.col("p_name"), " é"), "UTF-16LE"))).when(k % 3 == 1, F.concat(F.unhex(F.lit("FEFF")), F.encode(_s(F.col("p_name"), " é"), "UTF-16BE"))).otherwise(F.concat(F.unhex(F.lit("EFBBBF")), F.encode(_s(F.col("p_name"), " é"), "UTF-8")))
    partner = values.partner_lines(F.when(k % 2 == 0, _s(" own_", n)).otherwise(catalogue), F.col("p_brand"), F.lit(" "), F.lit(None).cast("string"), "OWN_", "Owner", "Own", 2024)
    parental, explicit = F.when(n % 3 == 0, "Explicit").when(n % 3 == 1, " "), F.when(n % 5 == 0, "Yes").otherwise("No")
    return t(spark, sf_dir, "part").select(
        "p_partkey",
        values.iso_seconds(_s("x PT", n, "M12.5S")).alias("iso_length"),
        values.slash_date(F.when(n % 4 != 0, _s(" 2024-05-", F.lpad((n % 28 + 1).cast("string"), 2, "0")))).alias("slashed"),
        values.key_of_url(F.when(k % 3 == 0, _s("https://store.s3.example/a%20b/", k, "+.wav")).when(k % 3 == 1, _s("https://s3.example/store/x/", k, ".wav")).otherwise("https://other.example/y.wav"), "store").alias("object_key"),
        values.is_reference(F.when(k % 4 == 0, "movie:x.wav").when(k % 4 == 1, "https://h/x").when(k % 4 == 2, " File:x").otherwise("Untitled")).alias("is_reference"),
        asset.alias("asset"),
        values.wave_name(F.when(k % 2 == 0, "Song.WAV").otherwise("song.mp3"), asset).alias("wave"),
        values.explicit_flag_either(parental, explicit).alias("either"),
        values.explicit_flag(parental, explicit).alias("first_of"),
        partner["label"].alias("label"),
        partner["p_line"].alias("p_line"),
        values.decoded(mark).alias("decoded"),
        values.stored_md5(F.when(k % 2 == 0, "0123456789abcdef0123456789abcdef").otherwise("none"), "p_name").alias("hash"),
        values.intake_value(F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")), "date").alias("day"),
        values.is_jpeg(F.unhex(F.when(k % 2 == 0, "FFD8FFE0").otherwise("89504E47"))).alias("jpeg"),
    )


@query("""
with s as (select *, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug, regexp_replace(p_name, ' +', '_', 'g') as part from part)
select p_partkey, 'in/' || regexp_replace(p_brand, '[^a-zA-Z0-9]', '', 'g') || '_' || part || '.wav' as audio, 'in/artwork/' || part || '_' || regexp_replace(p_brand, '[^a-zA-Z0-9]', '', 'g') || '.jpg' as artwork,
  'podcasts/audio/' || slug || '/' || case when p_size % 10 = 0 then 'ep' else lpad(p_size::varchar, 3, '0') end || '-t' || p_partkey || '.mp3' as episode,
  'artwork/podcast-' || slug || '-ep' || case when p_size % 10 = 0 then '77' || p_partkey else lpad(p_size::varchar, 3, '0') end || '.png' as episode_art, 'artwork/playlist-' || slug || '.webp' as playlist_art,
  p_name || ' x' as folder, 'a b c ' || p_name as offered, 'A_1_' || replace(p_name, ' ', '_') as asset_part
from s
""")
def object_keys(spark, sf_dir):
    """Object keys and file names made of a record's fields."""
    k, n = F.col("p_partkey"), F.when(F.col("p_size") % 10 == 0, 0).otherwise(F.col("p_size"))
    return t(spark, sf_dir, "part").select(
        "p_partkey",
        text.audio_key("in/", F.lit("C:\\x\\Some.name.WAV"), "p_brand", F.lit(" "), "p_name").alias("audio"),
        text.artwork_key("in/", F.lit("cover"), "p_name", F.lit(None).cast("string"), "p_brand").alias("artwork"),
        text.episode_audio_key("p_name", n, _s("T", k)).alias("episode"),
        text.episode_art_key("p_name", n, _s("77", k), F.lit("a.PNG")).alias("episode_art"),
        text.playlist_art_key("p_name", F.lit("x.webp")).alias("playlist_art"),
        text.folder_part(_s(" ", F.col("p_name"), " <x>?. ")).alias("folder"),
        text.download_name(_s('a:b*"c  ', F.col("p_name"))).alias("offered"),
        text.asset_part(_s("A/1 ", F.col("p_name"))).alias("asset_part"),
    )


@query("""
select o_orderkey as release, unnest(list_filter([case when o_orderkey % 3 = 0 then {'rule': 'V01', 'message': 'Release: the barcode "12" is not of 13 digits'} end, case when o_orderkey % 5 = 0 then {'rule': 'V02', 'message': 'Release: no catalogue number'} end,
  case when o_orderkey % 7 = 0 then {'rule': 'V02', 'message': 'Release: no title'} end, case when o_orderkey % 11 = 0 then {'rule': 'V02', 'message': 'Release: no artist'} end,
  case when o_orderkey % 2 = 0 then {'rule': 'V07', 'message': 'Release: original_release_date "soon" can''t be read as a date'} end, case when o_orderkey % 13 = 0 then {'rule': 'V07', 'message': 'Release: release_date "2024-13" can''t be read as a date'} end], lambda x: x is not null), recursive := true)
from orders
""")
def release_checks(spark, sf_dir):
    """Orders as releases, a row a violation."""
    k = F.col("o_orderkey")
    releases = t(spark, sf_dir, "orders").select(
        k.alias("release"),
        F.when(k % 3 == 0, " 12").otherwise("1234567890123 ").alias("barcode"),
        F.when(k % 5 != 0, _s("CAT", k)).alias("catalogue_no"),
        F.when(k % 7 != 0, "Album").otherwise("  ").alias("album_title"),
        F.lit(None).cast("string").alias("album_artist"),
        F.when(k % 11 != 0, "Artist").alias("artist_name"),
        F.when(k % 2 == 0, "soon").otherwise("2024-5-6").alias("original_release_date"),
        F.when(k % 13 == 0, "2024-13").when(k % 13 == 1, "5/6/2024").alias("release_date"),
    )
    return validation.violations(releases, validation.release_rules(), ["release"]).select("release", "rule", "message")


@query("""
with f as (select event_id, event_id % 2 = 0 as audio, case when event_id % 5 = 0 then 0 else 10 end as size, event_id % 3 = 0 as good from events),
found as (select event_id, 'V09' as rule, case when size = 0 then 'E' else 'W' end as severity from f where size = 0 or not good),
q as (select event_id, event_id % 4 as r, (event_id % 900)::bigint as sec from events)
select event_id, rule, severity, 1::bigint as n from found
union all select event_id, 'V10', 'W', n from (select event_id, ((r = 0)::int + (r = 1)::int + (r = 2)::int + (r in (1, 3))::int + (r = 1)::int + (sec > 0 and sec < 60)::int + (sec > 720)::int + (event_id % 6 = 0)::int)::bigint as n from q) where n > 0
""")
def file_checks(spark, sf_dir):
    """Files of a package and the qualities of recordings, violations of each by rule."""
    k = F.col("event_id")
    events = t(spark, sf_dir, "events")
    files = events.select("event_id", F.when(k % 2 == 0, "audio").otherwise("artwork").alias("kind"), (k % 20).alias("position"), F.when(k % 5 == 0, 0).otherwise(10).alias("size"), (k % 3 == 0).alias("looks_right"))
    r = k % 4
    audio = events.select(
        "event_id",
        F.when(r == 0, 22050).otherwise(44100).alias("sample_rate"),
        F.when(r == 2, 8).otherwise(24).alias("bit_depth"),
        F.when(r == 1, 1).otherwise(2).alias("channels"),
        F.when(r == 1, "mp3").when(r == 3, "aiff").otherwise("wav").alias("format"),
        F.when(r == 1, 128).alias("bitrate_kbps"),
        (k % 900).alias("duration_sec"),
        F.when(k % 6 != 0, "ZAABC0000001").alias("isrc"),
    )
    every = validation.violations(files, validation.file_rules(), ["event_id"]).union(validation.violations(audio, validation.audio_rules(), ["event_id"]))
    return every.groupBy("event_id", "rule", "severity").agg(F.count("*").alias("n"))


@query("""
select c_custkey as ord, case when c_custkey % 4 = 0 then 'Line ' || (c_custkey + 2) || ': no title' end as first_error, ((c_custkey % 4 = 0)::int + (c_custkey % 6 = 0)::int)::int as n_errors, 'Line ' || (c_custkey + 2) || ': columns without a meaning: Odd, Other' as warning
from customer where c_custkey % 10 <> 0
""")
def sheet_checks(spark, sf_dir):
    """A track sheet's required fields, hidden rows and unknown columns."""
    k = F.col("c_custkey")
    sheet = t(spark, sf_dir, "customer").select(k.alias("ord"), (k % 10 == 0).alias("hidden"), F.when(k % 4 == 0, " ").otherwise(F.col("c_name")).alias("TrackTitle"), F.when(k % 6 != 0, F.col("c_mktsegment")).alias("main_artist"), F.lit("x").alias("Odd"), F.lit("y").alias("Other"))
    out = sheets.track_sheet(sheet)
    return out.select("ord", F.get(F.filter("errors", lambda e: e.contains("title")), F.lit(0)).alias("first_error"), F.size("errors").alias("n_errors"), F.get("warnings", F.lit(0)).alias("warning"))


@query("""
select 'headers' as what, 'Name,No,Other,Size' as held, (select count(*) from part) as n
union all select 'status', 'p_brand', (select count(*) from part where p_size % 2 = 0)
union all select 'next ' || lower(p_brand), 'e', max(p_size) + 1 from part group by lower(p_brand)
""")
def table_counts(spark, sf_dir):
    """Headers and rows of a sheet, what a table holds, and the next number of each show."""
    part = t(spark, sf_dir, "part")
    seen = sheets.headers(part.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("Name"), F.col("p_size").alias("No"), F.lit(1).alias("Other"), F.lit(2).alias("Size")))
    first = spark.createDataFrame([("headers", ",".join(seen["headers"]), seen["row_count"])], "what string, held string, n long")
    held = rollups.status(part.withColumn("p_brand", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(" ")), ["p_brand"])
    shows = rollups.next_episode(part.select(_s(" ", F.col("p_brand"), " ").alias("show_title"), F.col("p_size").cast("long").alias("episode_number")))
    return first.union(held.select(F.lit("status"), F.lit("p_brand"), "with_p_brand")).union(shows.select(_s("next ", F.col("show_key")), F.lit("e"), "next_episode"))
