"""Registered queries of what is stored: indexes, versions, listings and drained files, workbooks and archives, payloads."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from discoforge.functions.text import basename
from discoforge.operators import cuts, keys, writes
from discoforge.plans import payloads, replicate
from discoforge.sources import files, lookups, tables
from discoforge.streaming import drain as draining

from .queries_fields import _s
from .registry import query, t


@query("""
select 'any' as what, p_partkey as id from part where contains(lower(p_name), 'wid') or contains(lower(p_type), 'wid')
union all select 'two letters', p_partkey from part where contains(lower(p_name), 'ed') or contains(lower(p_type), 'ed')
union all select 'words', page_id from pages where contains(lower(url), 'example') and contains(lower(url), 'en') and contains(lower(url), '1')
union all select 'file', page_id from pages where contains(lower(url), '12')
""")
def indexed_searches(spark, sf_dir):
    """Q01, Q03, Q04, Q07, Q08: the same searches by postings of letter runs, which are stored once and asked several times."""
    part, pages = t(spark, sf_dir, "part"), t(spark, sf_dir, "pages").select("page_id", "url")
    columns = ["p_name", "p_type"]
    of_parts, of_pages = cuts.written(lookups.text_index(part, "p_partkey", columns)), cuts.written(lookups.text_index(pages, "page_id", ["url"]))
    tag = lambda df, what, c: df.select(F.lit(what).alias("what"), F.col(c).alias("id"))
    return (
        tag(lookups.search_index(part, of_parts, "p_partkey", columns, [" WID"]), "any", "p_partkey")
        .union(tag(lookups.search_index(part, of_parts, "p_partkey", columns, ["eD"]), "two letters", "p_partkey"))
        .union(tag(lookups.search_index(pages, of_pages, "page_id", ["url"], "Example en 1".split()), "words", "page_id"))
        .union(tag(lookups.search_index(pages, of_pages, "page_id", ["url"], ["12"]), "file", "page_id"))
    )


@query("""
select o_orderkey, n.low as first_key, n.high as last_key from orders left join (select c_nationkey, min(c_custkey) as low, max(c_custkey) as high from customer group by c_nationkey) n on c_nationkey = o_orderkey % 40
""")
def persisted_lookups(spark, sf_dir):
    """Orders look up stored indexes, of the first and of the last record of a key."""
    customer, folder = t(spark, sf_dir, "customer"), cuts.new_folder(spark)
    for name, first in (("first", True), ("last", False)):
        lookups.save_lookup(customer.select("c_custkey", _s(" c", F.col("c_nationkey")).alias("isrc")), f"lookup_{folder[-32:]}_{name}", "code", F.upper(F.trim("isrc")), ["c_custkey"], 8, first, f"{folder}/{name}")
    asked = t(spark, sf_dir, "orders").select("o_orderkey", _s("C", F.col("o_orderkey") % 40).alias("code"))
    out = lookups.look_up(asked, spark, f"lookup_{folder[-32:]}_first", "code", "first_")
    out = lookups.look_up(out, spark, f"lookup_{folder[-32:]}_last", "code", "last_")
    return out.select("o_orderkey", F.col("first_c_custkey").alias("first_key"), F.col("last_c_custkey").alias("last_key"))


@query("""
with f as (select c_nationkey as n, c_name || '|' || c_custkey as line from customer),
g as (select n, sum(length(line) + 1)::bigint as size, md5(string_agg(line || chr(10), '' order by line)) as md5 from f group by n)
select 'listed' as what, n::int as n, size, null as md5, null as format from g
union all select 'waiting', null, size, null, null from g
union all select 'drained', null, size, md5, 'unknown' from g
union all select 'taken', count(*)::int, null, null, null from g
union all select 'taken again', 0, null, null, null
""")
def drained_files(spark, sf_dir):
    """Files of customers by nation, listed with their sizes, and drained once with hashes and formats."""
    folder = cuts.new_folder(spark)
    lines = t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n"), F.concat_ws("|", "c_name", F.col("c_custkey").cast("string")).alias("line"))
    lines.repartition("n").sortWithinPartitions("n", "line").write.partitionBy("n").text(f"{folder}/in")
    row = lambda df, what, n, size, md5=F.lit(None), kind=F.lit(None): df.select(F.lit(what).alias("what"), n.cast("int").alias("n"), size.cast("long").alias("size"), md5.cast("string").alias("md5"), kind.cast("string").alias("format"))
    none = F.lit(None)
    listed = row(files.listing(spark, f"{folder}/in", "*.txt"), "listed", F.regexp_extract("path", "n=([0-9]+)", 1), F.col("size"))
    waiting = cuts.written(row(draining.waiting(spark, f"{folder}/in"), "waiting", none, F.col("size")))
    args = (spark, f"{folder}/in", f"{folder}/out", f"{folder}/seen")
    taken = [draining.drain(*args, clean=False), draining.drain(*args, clean=False)]
    drained = row(spark.read.parquet(f"{folder}/out"), "drained", none, F.col("size"), F.col("md5"), F.col("format"))
    counts = spark.createDataFrame([("taken", taken[0]), ("taken again", taken[1])], "what string, n int")
    return listed.union(waiting).union(drained).union(counts.select("what", "n", none.cast("long"), none.cast("string"), none.cast("string")))


@query("""
select 1 as version, c_custkey as id, c_name as name from customer union all select 2, c_custkey, upper(c_name) from customer where c_custkey % 2 = 0
""")
def stored_versions(spark, sf_dir):
    """A table of JSON records made into Parquet, and replaced by another version, the first of which stays as a backup."""
    folder = cuts.new_folder(spark)
    t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).write.json(f"{folder}/json")
    base = spark.read.parquet(writes.save(tables.json_table(spark, f"{folder}/json", "id long, name string"), folder, 1))
    news = base.where("id % 2 = 0").select(F.upper("name").alias("name"), "id", F.lit("x").alias("unknown"))
    writes.save(writes.replaced(base, news), folder, 2)
    versions = [spark.read.parquet(f"{folder}/v{n:06d}").select(F.lit(n).alias("version"), "id", "name") for n in (1, 2)]
    return versions[0].union(versions[1])


@query("""
select 'r' || c_custkey as record_id, case when c_custkey % 5 = 0 and c_custkey % 2 = 1 then 'skipped' else 'updated' end as action, case when c_custkey % 5 <> 0 then c_name end as name, case when c_custkey % 2 = 0 then c_mktsegment end as genre, 0 as others
from customer where c_custkey % 3 <> 0
""")
def pulled_fields(spark, sf_dir):
    """Some fields of tracks pulled over the target's, of tracks met by code or number; nothing to write is skipped."""
    k, customer = F.col("c_custkey"), t(spark, sf_dir, "customer")
    target = customer.select(_s("r", k).alias("record_id"), _s("c", F.col("c_nationkey")).alias("catalogue_no"), F.when(k % 4 != 0, _s("I", k)).alias("isrc"), k.alias("sequence_no"), k.alias("ord"))
    source = customer.where("c_custkey % 3 <> 0").select(k.alias("ord"), _s("c", F.col("c_nationkey")).alias("catalogue_no"), F.when(k % 4 != 0, _s("I", k)).alias("isrc"), F.when(k % 4 == 0, k).alias("sequence_no"), F.when(k % 5 != 0, F.col("c_name")).otherwise(" ").alias("title"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("genre"), F.lit("not asked").alias("label"))
    out = replicate.replicate(source, target, ["Track Name", "Genre"])
    held = F.col("payload")
    return out.select("record_id", "action", held["Track Name"].alias("name"), held["Genre"].alias("genre"), F.size(F.map_filter(held, lambda f, _: ~f.isin("Track Name", "Genre"))).alias("others"))


@query("""
with c as (select c_custkey as k, c_name as name, c_mktsegment as seg, lpad((c_custkey // 3600)::varchar, 2, '0') || ':' || lpad((c_custkey // 60 % 60)::varchar, 2, '0') || ':' || lpad((c_custkey % 60)::varchar, 2, '0') as clock from customer)
select 'catalogue' as target, k, name as title, case when k % 2 = 1 then 'Band' end as album_artist, case when k % 3 = 0 then 'W' else 'F' end || k || '.wav' as filename, clock as duration, 'A; B' as composers, 9 + k % 2 as fields from c
union all select 'catalogue_album', k, null, case when k % 2 = 1 then 'Band' else seg end, null, null, null, 4 from c
union all select 'streamer', k, name, case when k % 2 = 1 then 'Band' end, case when k % 3 <> 0 then 'F' || k end, clock, 'A; B', 7 + k % 2 + case when k % 3 <> 0 then 1 else 0 end from c
union all select 'streamer_album', k, null, case when k % 2 = 1 then 'Band' else seg end, null, null, null, 4 from c
""")
def target_payloads(spark, sf_dir):
    """What each target takes of a track or an album."""
    k = F.col("c_custkey")
    tracks = t(spark, sf_dir, "customer").select(k.alias("k"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("artist_name"), F.when(k % 2 == 1, "Band").otherwise(" ").alias("album_artist"), F.lit("Album").alias("album_title"), _s("K", k).alias("catalogue_no"), F.lit(2001).alias("year"), F.when(k % 3 != 0, _s("F", k, ".wav")).alias("filename"), _s("W", k, ".wav").alias("wav_filename"), k.alias("duration_sec"), F.array(F.lit("A"), F.lit(" B ")).alias("composers"))
    out = None
    for target in payloads.TARGETS:
        held = F.col("payload")
        part = payloads.target_payload(tracks, target).select(F.lit(target).alias("target"), "k", *[held[f].alias(f) for f in ("title", "album_artist", "filename", "duration", "composers")], F.size(held).alias("fields"))
        out = part if out is None else out.union(part)
    return out


@query("""
select id, found_by from (select c_custkey as id, 'segment' as found_by, 0 as rank from customer where c_mktsegment = 'BUILDING' union all select c_custkey, 'nation', 1 from customer where c_nationkey < 12 union all select c_custkey, 'name', 2 from customer where c_custkey % 5 = 0)
qualify row_number() over (partition by id order by rank) = 1
""")
def union_dedupe(spark, sf_dir):
    """Results of several lookups, each record once, as the first lookup found it."""
    customer = t(spark, sf_dir, "customer")
    found = [customer.where(w).select(F.col("c_custkey").alias("id"), F.lit(name).alias("found_by"), F.lit(n).alias("rank")) for n, (name, w) in enumerate({"segment": "c_mktsegment = 'BUILDING'", "nation": "c_nationkey < 12", "name": "c_custkey % 5 = 0"}.items())]
    return keys.distinct_first(found[0].union(found[1]).union(found[2]), ["id"], ["rank"]).select("id", "found_by")


def _sheet(rows: list[list], hidden: set[int]) -> str:
    """A worksheet of inline texts; hidden: numbers of rows."""
    cell = lambda n, m, v: f'<c r="{chr(65 + m)}{n}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'
    lines = (f'<row r="{n}"{" hidden=\"1\"" if n in hidden else ""}>{"".join(cell(n, m, v) for m, v in enumerate(r) if v is not None)}</row>' for n, r in enumerate(rows, 1))
    return f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(lines)}</sheetData></worksheet>'


def _archive(entries: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in entries.items():
            z.writestr(name, text)
    return out.getvalue()


def _workbook(sheets: dict[str, str]) -> bytes:
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    listed = "".join(f'<sheet name="{name}" sheetId="{n}" r:id="r{n}"/>' for n, name in enumerate(sheets, 1))
    links = "".join(f'<Relationship Id="r{n}" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(sheets) + 1))
    parts = {"xl/workbook.xml": f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>', "xl/_rels/workbook.xml.rels": f"<Relationships>{links}</Relationships>"}
    return _archive(parts | {f"xl/worksheets/sheet{n}.xml": s for n, s in enumerate(sheets.values(), 1)})


def _books(groups: pd.DataFrame) -> pd.DataFrame:
    """A workbook for each nation: an empty first sheet, one of other things, and one named ingest; rows of every seventh customer are hidden."""
    own = groups.sort_values("c_custkey")
    rows = [["ISRC", "Track Title"], *[[f"I{k}", n] for k, n in zip(own["c_custkey"], own["c_name"])]]
    hidden = {n for n, k in enumerate(own["c_custkey"], 2) if k % 7 == 0}
    nation = own["c_nationkey"].iloc[0]
    book = _workbook({"Empty": _sheet([["ISRC"]], set()), "Other": _sheet([["Note"], ["x"]], set()), "Ingest": _sheet(rows, hidden)})
    return pd.DataFrame({"name": [f"{nation}.xlsx"], "content": [book]})


@query("""
select 'ingest' as sheet, '/in/' || c_nationkey || '.xlsx' as path, (row_number() over (partition by c_nationkey order by c_custkey) - 1)::bigint as ord, 'I' || c_custkey as isrc, c_name as title, null as note from customer where c_custkey % 7 <> 0
union all select 'first', '/in/' || c_nationkey || '.xlsx', 0, null, null, 'x' from customer group by c_nationkey
""")
def workbook_rows(spark, sf_dir):
    """Workbook files of customers by nation, the sheet asked for without its hidden rows, and the first sheet that has any."""
    folder = cuts.new_folder(spark)
    files.written_files(t(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name").groupBy("c_nationkey").applyInPandas(_books, "name string, content binary"), folder)
    read = lambda prefer=None: files.workbooks(spark, folder, prefer).withColumn("path", F.concat(F.lit("/in/"), basename("path")))
    # the place among the rows that are shown
    shown = read("ingest").where("not hidden").select("path", F.col("ord").alias("at"), F.col("cells")["ISRC"].alias("isrc"), F.col("cells")["Track Title"].alias("title"))
    seen = cuts.positions(shown, ["path", "at"], "_place")
    first = seen.groupBy("path").agg(F.min("_place").alias("_first"))
    shown = seen.join(first, "path").select(F.lit("ingest").alias("sheet"), "path", (F.col("_place") - F.col("_first")).alias("ord"), "isrc", "title", F.lit(None).cast("string").alias("note"))
    return shown.union(read().select(F.lit("first"), "path", "ord", F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("cells")["Note"]))


@query("""
select '/in/' || c_nationkey || '.zip' as path, '<m>' || count(*) || '</m>' as xml, 'a.wav:' || count(*) || ',late.xml:4,m.xml:' || length('<m>' || count(*) || '</m>') as files from customer group by c_nationkey
""")
def archive_members(spark, sf_dir):
    """Archives by nation, the first message of each and its files by their lower-case names."""

    @F.pandas_udf("binary")
    def packed(n: pd.Series) -> pd.Series:
        return n.map(lambda x: _archive({"notes/": "", "R/A.WAV": "w" * x, "M.XML": f"<m>{x}</m>", "r/late.xml": "<x/>"}))

    folder, counted = cuts.new_folder(spark), t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    files.written_files(counted.select(_s(F.col("c_nationkey"), ".zip").alias("name"), packed("n").alias("content")), folder)
    found = files.packages(spark, folder)
    listed = F.array_join(F.array_sort(F.transform(F.map_entries("files"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))), ",")
    return found.select(F.concat(F.lit("/in/"), basename("path")).alias("path"), F.col("xml").cast("string").alias("xml"), listed.alias("files"))
