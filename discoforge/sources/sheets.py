"""Spreadsheet rows to tracks and metadata: header aliases, explicit mappings, typed values.

A sheet is a DataFrame whose columns are the headers as they stand, plus ord, the row's position.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discoforge.functions.text import clean, isrc_key
from discoforge.functions.values import nonzero_int, sheet_seconds, sheet_value, track_artist, year, yes
from discoforge.operators.validation import check, sheet_rules

# Track fields and the headers that mean them, in lower case with single spaces.
TRACK_HEADERS = {
    "title": ["title", "track title", "track name", "song title", "song", "tracktitle", "trackname", "songtitle", "song name", "songname", "name"],
    "version_title": ["version", "mix", "edit", "version title", "track version", "versiontitle", "trackversion", "mix version", "mixversion"],
    "artist_name": ["artist", "artist name", "performer", "main artist", "track artist", "artistname", "mainartist", "trackartist", "act"],
    "featuring": ["featuring", "feat", "featured artist", "ft", "featuredartist", "feat.", "ft."],
    "composer": ["composer", "composers", "writer", "writers", "songwriter", "songwriters", "writers / composers", "writers/composers", "composers / writers", "composers/writers"],
    "lyricist": ["lyricist", "lyric writer"],
    "producer": ["producer", "producers"],
    "album_title": ["album", "album title", "release title", "albumtitle", "releasetitle", "album name", "albumname"],
    "album_artist": ["album artist", "albumartist"],
    "album_upc": ["upc", "barcode", "ean"],
    "catalogue": ["cat no", "catalogue", "catalogue number", "cat#", "cat. #", "album catalogue number", "album catalogue no", "cataloguenumber", "catalogno", "catno", "cat number", "catnumber", "catalog", "catalog number", "catalognumber"],
    "isrc": ["isrc", "isrc code", "isrc #", "isrc number", "isrc no", "isrc no.", "track isrc", "isrccode", "isrcnumber", "trackisrc"],
    "iswc": ["iswc"],
    "label_name": ["label", "record label", "recordlabel", "labelname"],
    "publisher": ["publisher", "publishers", "music publisher", "musicpublisher"],
    "sequence_no": ["sequence", "sequence number", "sequence no", "sequence no.", "seq", "seq no", "seq #", "seq.", "track seq", "sequencenumber", "trackseq"],
    "track_number": ["track", "track no", "track number", "#", "tracknumber", "trackno"],
    "disc_number": ["disc", "disc no", "cd"],
    "year": ["year", "release year", "date", "release date"],
    "genre": ["genre", "track genre", "album genre"],
    "subgenre": ["subgenre", "sub-genre", "style"],
    "bpm": ["bpm", "tempo"],
    "key_sig": ["key", "key sig", "musical key"],
    "mood": ["mood"],
    "language": ["language", "audio language", "language code"],
    "explicit": ["explicit", "parental advisory"],
    "duration_sec": ["duration"],
    "territories": ["territory", "territories", "rights territory"],
    "sync_licensed": ["sync", "sync licensed", "sync cleared"],
    "rights_holder": ["rights holder", "master rights"],
    "p_line": ["p line", "℗ line", "p-line", "pline", "album p line", "album ℗ line"],
    "c_line": ["c line", "© line", "c-line", "cline", "album c line", "album © line", "copyright line"],
    "rights_year": ["rights year", "copyright year", "℗ year"],
    "pro_name": ["pro", "pro name", "collecting society"],
    "pro_ipi": ["ipi", "ipi number"],
    "submitter_email": ["email", "contact email"],
    "notes": ["notes", "comments"],
}
_TRACK_OF = {alias: field for field, aliases in TRACK_HEADERS.items() for alias in aliases}

# Metadata fields and their headers, by priority.
METADATA_HEADERS = {
    "album_title": ["Album Title", "album title", "Album title"],
    "album_artist": ["Album Artist", "album artist", "Album artist"],
    "release_date": ["Release Date", "release date"],
    "original_release_date": ["Original Release Date", "Original Release date", "original release date"],
    "catalogue": ["Cat. #", "Cat #", "Catalogue", "catalogue", "Reference Catalogue Number", "reference catalogue number"],
    "barcode": ["Barcode", "barcode"],
    "language": ["Language", "language", "Language Code", "language code"],
    "isrc": ["ISRC", "isrc"],
    "label": ["Label", "label"],
    "p_line": ["Album ℗ line", "Album P line", "album ℗ line", "℗ line", "P line"],
    "c_line": ["Album © line", "Album C line", "album © line", "© line", "C line"],
    "track_name": ["Track name", "Track Name", "track name", "Track title", "title"],
    "track_artist": ["Track artist", "Track Artist", "track artist"],
    "seq": ["#", "Seq"],
    "duration": ["Duration", "duration"],
    "genre": ["Track genre", "track genre", "Genre", "genre"],
    "audio_language": ["Audio language", "audio language"],
    "composer": ["Writers / Composers", "Writers/Composers", "writers / composers", "Composers"],
    "publisher": ["Publishers", "Publisher", "publishers"],
    "producer": ["Producers", "Producer", "producers"],
    "parental": ["Parental", "parental", "Explicit", "explicit"],
    "rights_territories": ["Rights Territories", "rights territories", "Rights_Territories"],
    "featured_artist": ["Featured Artist", "featured artist", "Featured artist"],
}
METADATA_FIELDS = list(METADATA_HEADERS)
# Numbered columns that are joined where the one column is blank.
METADATA_NUMBERED = {"composer": ["Composer", "Composer 2", "Composer 3"], "producer": ["Producer", "Producer 2", "Producer 3"]}

# Intake headers in lower case and the columns of the metadata sheet that they fill.
INTAKE_HEADERS = {
    "Album title": ["album title"],
    "Album artist": ["album artist"],
    "Label": ["label"],
    "Original Release Date": ["original release date"],
    "Release Date": ["release date"],
    "Track name": ["track name"],
    "ISRC": ["isrc*", "isrc"],
    "Language": ["language*", "language"],
    "#": ["track number"],
    "Track artist": ["track artist (if different from album artist)", "track artist"],
    "Duration": ["track duration", "duration"],
    "Performing contributors": ["featuredartist (if any)", "featured artist (if any)", "featured artist"],
    "Album genre": ["genre"],
    "Writers / Composers": ["composer(s)", "composers", "writer(s)", "writers"],
    "Producers": ["producer(s)", "producers"],
    "Publishers": ["publisher(s)", "publishers"],
    "Barcode": ["upc", "barcode"],
    "Cat #": ["reference catalogue number", "cat #", "catalogue number"],
    "Album ID": ["external / client identifier", "external/client identifier"],
    "Explicit": ["lyrical content rating", "explicit"],
    "Explicit lyrics": ["explicit lyrics"],
    "Album ℗ line": ["℗ p line", "p line", "℗ line"],
    "Album © line": ["© c line", "c line", "© line"],
}
_INTAKE_OF = {alias: column for column, aliases in INTAKE_HEADERS.items() for alias in aliases}
INTAKE_SECOND = {"genre": "Track genre", "language*": "Audio language", "language": "Audio language"}


def headers(sheet: DataFrame) -> dict:
    """S05. The headers of a sheet and its number of rows."""
    return {"headers": [c for c in sheet.columns if c != "ord"], "row_count": sheet.count()}


def track_field(header: str) -> str | None:
    """P11. The track field that a header means: lower case, underscores and runs of spaces as one space; then without spaces."""
    name = re.sub(r"\s+", " ", re.sub("_+", " ", header.lower().strip()))
    return _TRACK_OF.get(name) or _TRACK_OF.get(re.sub(r"\s", "", name))


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def valid(df: DataFrame) -> DataFrame:
    """P14. Rows with a recording code, a catalogue number or an album title."""
    return df.where(" or ".join(f"coalesce({c}, '') <> ''" for c in ("isrc", "catalogue", "album_title")))


def track_sheet(sheet: DataFrame) -> DataFrame:
    """S02, V11. Typed track rows with errors and warnings, by sequence number, rows without one last.

    Rows marked hidden, if there is such a column, are skipped. Of several headers of a field the last counts.
    """
    fields = {f: c for c in sheet.columns if c not in ("ord", "hidden") and (f := track_field(c))}
    unknown = [c for c in sheet.columns if c not in ("ord", "hidden") and not track_field(c)]
    rows = sheet.where(~F.coalesce(F.col("hidden"), F.lit(False))) if "hidden" in sheet.columns else sheet
    text = {f: (_quoted(fields[f]).cast("string") if f in fields else F.lit(None).cast("string")) for f in TRACK_HEADERS}
    typed = text | {
        "duration_sec": sheet_seconds(text["duration_sec"]),
        "year": year(text["year"]),
        "isrc": isrc_key(text["isrc"]),
        "sequence_no": nonzero_int(text["sequence_no"]),
        "track_number": nonzero_int(F.split(text["track_number"], "/")[0]),
        **{f: nonzero_int(text[f]) for f in ("disc_number", "bpm", "rights_year")},
        **{f: yes(text[f]) for f in ("explicit", "sync_licensed")},
    }
    out = rows.select("ord", (F.col("ord") + 2).alias("row_number"), *[c.alias(f) for f, c in typed.items()])
    out = check(out, sheet_rules())
    if unknown:
        note = F.concat(F.lit("Line "), F.col("row_number").cast("string"), F.lit(": columns without a meaning: " + ", ".join(unknown)))
        out = out.withColumn("warnings", F.concat("warnings", F.array(note)))
    return out.orderBy(F.col("sequence_no").asc_nulls_last(), "ord")


def metadata_sheet(sheet: DataFrame) -> DataFrame:
    """S01. Rows of the 23 metadata fields with ord; a field is its first column that isn't null. Rows that name nothing go."""
    def field(name: str) -> Column:
        here = [_quoted(h).cast("string") for h in METADATA_HEADERS[name] if h in sheet.columns]
        value = F.nullif(F.coalesce(*here), F.lit("")) if here else F.lit(None).cast("string")
        if name == "seq":
            whole = [F.when(c.isNotNull() & (c != ""), c) for c in here]
            return nonzero_int(F.coalesce(*whole)) if whole else F.lit(None).cast("bigint")
        value = clean(value)
        parts = [clean(_quoted(h).cast("string")) for h in METADATA_NUMBERED.get(name, []) if h in sheet.columns]
        return F.coalesce(value, F.nullif(F.concat_ws("; ", *parts), F.lit(""))) if parts else value

    return valid(sheet.select("ord", *[field(f).alias(f) for f in METADATA_FIELDS]))


def mapped_sheet(sheet: DataFrame, mapping: list[tuple[str, str]]) -> DataFrame:
    """W02, P13, F22, F23, F45. Metadata rows by an explicit mapping of (header, field).

    Several headers of a field are joined by '; ', of seq the first number counts. Fields that aren't metadata
    and headers that the sheet lacks are ignored; duration cells may be fractions of a day, others day numbers.
    """
    asked: dict[str, list[Column]] = {}
    for header, field in mapping:
        if field in METADATA_HEADERS and header in sheet.columns:
            asked.setdefault(field, []).append(sheet_value(_quoted(header).cast("string"), duration=field == "duration"))
    none = F.lit(None).cast("string")

    def field(name: str) -> Column:
        values = asked.get(name, [])
        if name == "seq":
            return F.coalesce(*[nonzero_int(v) for v in values]) if values else F.lit(None).cast("bigint")
        return F.nullif(F.concat_ws("; ", *values), F.lit("")) if values else none

    out = sheet.select("ord", *[field(f).alias(f) for f in METADATA_FIELDS])
    return valid(out.withColumn("track_artist", track_artist("track_artist", "album_artist")))


def intake_sheet(sheet: DataFrame, target: list[str]) -> tuple[DataFrame, list[str]]:
    """S24, P12, W25, F52. Rows of an intake sheet in the target's columns, and the headers that were ignored.

    Genre and language fill a second column too. Rows that are null throughout go.
    """
    source: dict[str, str] = {}
    ignored = []
    for header in (c for c in sheet.columns if c != "ord"):
        name = header.lower().strip()
        column = _INTAKE_OF.get(name)
        if column not in target:
            ignored.append(header)
            continue
        for t in (column, INTAKE_SECOND.get(name)):
            if t in target:
                source[t] = header
    rows = sheet.dropna("all", subset=[c for c in sheet.columns if c != "ord"])
    kinds = dict(sheet.dtypes)
    cell = lambda h: F.date_format(_quoted(h), "yyyy-MM-dd") if kinds[h].startswith(("timestamp", "date")) else _quoted(h).cast("string")
    return rows.select("ord", *[(cell(source[t]) if t in source else F.lit(None).cast("string")).alias(t) for t in target]), ignored


def submission(form: DataFrame, fields: list[str]) -> DataFrame:
    """W39, P01. Fields of a submission: the form's value, else the file tag's (tag_field), else what its name says (name_field)."""
    def field(f: str) -> Column:
        tries = [clean(c) for c in (f, f"tag_{f}", f"name_{f}") if c in form.columns]
        return (F.coalesce(*tries) if tries else F.lit(None).cast("string")).alias(f)

    return form.select("ord", *[field(f) for f in fields])


