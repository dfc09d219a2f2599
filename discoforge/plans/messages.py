"""Release messages to tracks: XML text to nested columns, then recordings joined to the releases that name them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from discoforge.functions.text import basename, clean
from discoforge.functions.values import iso_seconds, leading_float, nonzero_int, year
from discoforge.operators import cuts

_PARTY = "PartyName:struct<FullName:string>"
_ARTIST = f"array<struct<_SequenceNumber:string,SequenceNumber:string,{_PARTY},ArtistRole:string>>"
_PERSON = f"array<struct<{_PARTY},Role:string,ContributorRole:string,ResourceContributorRole:string,IndirectResourceContributorRole:string,HasRightShare:string>>"
_TECHNICAL = "array<struct<File:struct<FileName:string>,AudioFile:struct<FileName:string>>>"
_LINE = "struct<Year:string,PLineText:string>"
_TITLE = "array<struct<_TitleType:string,TitleType:string,TitleText:string,SubTitle:string>>"
_COMMON = f"DisplayArtist:{_ARTIST},DisplayArtistName:string,ResourceContributor:{_PERSON},IndirectResourceContributor:{_PERSON},TechnicalSoundRecordingDetails:{_TECHNICAL},TechnicalDetails:{_TECHNICAL},PLine:{_LINE},ParentalWarningType:string,Genre:struct<GenreText:string,SubGenre:string>,LanguageOfPerformance:string,LabelName:string,ReleaseDate:string,Title:{_TITLE}"
_RECORDING = f"struct<SoundRecordingId:array<struct<ISRC:string>>,WorkId:array<struct<ISWC:string>>,ResourceReference:string,ReferenceTitle:struct<TitleText:string>,Duration:string,CreationDate:string,SequenceNumber:string,{_COMMON},SoundRecordingDetailsByTerritory:array<struct<{_COMMON}>>>"
_RELEASE = f"struct<_IsMainRelease:string,ReleaseId:array<struct<ICPN:string,CatalogNumber:string>>,ReleaseReference:string,ReferenceTitle:struct<TitleText:string>,ReleaseType:string,ReleaseResourceReferenceList:struct<ReleaseResourceReference:array<string>>,TrackReleaseList:struct<TrackRelease:array<struct<ReleaseResourceReferenceList:struct<ReleaseResourceReference:array<string>>,LinkedReleaseResourceReference:string>>>,ReleaseDate:string,DisplayArtistName:string,DisplayArtist:{_ARTIST},ParentalWarningType:string,PLine:{_LINE},ReleaseDetailsByTerritory:array<struct<{_COMMON}>>>"
_IMAGE = "struct<ImageType:string,TechnicalDetails:struct<File:struct<FileName:string>>,ImageDetailsByTerritory:array<struct<TechnicalImageDetails:struct<File:struct<FileName:string>>>>>"
#: Columns of a track.
_FIELDS = ["ref", "title", "version_title", "artist_name", "album_title", "isrc", "iswc", "barcode", "catalogue_no", "genre", "subgenre", "language", "duration_sec", "track_number", "explicit", "rights_holder", "rights_year", "year", "credits", "audio_file"]
SCHEMA = f"struct<ResourceList:struct<SoundRecording:array<{_RECORDING}>,Image:array<{_IMAGE}>>,ReleaseList:struct<Release:array<{_RELEASE}>>>"


def parsed(messages: DataFrame, xml: str = "xml") -> DataFrame:
    """S20. messages with m, the nested message, and version: 382, 383 or 41 by what its text names."""
    version = F.when(F.col(xml).contains("ern/382"), "382").when(F.col(xml).contains("ern/383"), "383").otherwise("41")
    # generated, so that a message is parsed once and not for each field that is asked of it
    return messages.select("*", version.alias("version"), F.explode(F.array(F.from_xml(F.col(xml), SCHEMA, {"ignoreNamespace": "true"}))).alias("m"))


def _first(array: Column, test, value) -> Column:
    """value of the first item of an array that meets a test; null for a null array."""
    return F.get(F.transform(F.filter(array, test), value), F.lit(0))


def _text(*values: Column) -> Column:
    return F.coalesce(*[clean(v) for v in values])


def tracks(messages: DataFrame, key: str, xml: str = "xml") -> DataFrame:
    """S20, P29-P33, J12, A10, A15. One row a recording that a release names, in order of releases and references.

    Each attribute is the first that the recording, its territory details or the album release hold. The older
    form takes a release for the album by its type or as the main one, the newer by its type alone. A recording
    named by several releases counts once, at its first.
    """
    m = parsed(messages, xml).select(key, "version", "m").repartition(key)  # releases and recordings read one shuffle, and one parse
    releases = m.select(key, "version", F.posexplode("m.ReleaseList.Release").alias("release_at", "_release"))
    recordings = m.select(key, "version", F.explode("m.ResourceList.SoundRecording").alias("sr"))
    return _named(key, releases, recordings).withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy("release_at", "ref_at"))).select(key, "ord", *_FIELDS)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """S20. Messages in files, in pieces that end with a recording: path, at (block and place), old and newer (whether
    the piece names that form), sr (the recording) and releases (those that lie in the piece).

    The text source splits a file at the end tags of recordings by byte ranges, so tasks share a message of any size; what
    is parsed at once is a recording, or a release of the text behind the last one. Element names are taken to have no
    prefix, as release messages have them, and end tags to stand in no comment.
    """
    text = spark.read.option("lineSep", "</SoundRecording>").option("recursiveFileLookup", "true").text(path)
    value, options = F.col("value"), {"ignoreNamespace": "true"}
    begin = F.regexp_instr(value, F.lit(r"<SoundRecording[\s>]"))  # 0 where the piece has none
    recording = F.when(F.col("_begin") > 0, F.concat(value.substr(F.col("_begin"), F.length(value)), F.lit("</SoundRecording>")))
    rest = F.when(F.col("_begin") > 0, value.substr(F.lit(1), F.col("_begin") - 1)).otherwise(value)
    listed = F.regexp_extract_all(F.col("_rest"), F.lit(r"(?s)<Release[\s>].*?</Release>"), F.lit(0))
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))  # a block is read by one task, in its order
    pieces = text.select(F.col("_metadata.file_path").alias("path"), at.alias("at"), "value", begin.alias("_begin")).withColumn("_rest", rest)
    return pieces.select("path", "at", value.contains("ern/382").alias("old"), value.contains("ern/383").alias("newer"), F.from_xml(recording, _RECORDING, options).alias("sr"), F.transform(listed, lambda r: F.from_xml(r, _RELEASE, options)).alias("releases"))


def tracks_of_files(spark: SparkSession, path: str) -> DataFrame:
    """S20, P29-P33, J12, A10, A15. The rows of `tracks` for the messages in a folder, path being the key, for messages of any size.

    Pieces of messages are parsed side by side and written once; recordings meet the references to them by a join,
    and places come from ranges, so no message has to fit in one task.
    """
    held = cuts.written(chunks(spark, path))
    form = held.groupBy("path").agg(F.when(F.max("old"), "382").when(F.max("newer"), "383").otherwise("41").alias("version"))
    releases = held.select("path", "at", F.posexplode("releases").alias("n", "_release")).select("path", F.struct("at.block", "at.nth", "n").alias("release_at"), "_release").join(form.hint("merge"), "path")
    recordings = held.where("sr is not null").select("path", "sr").join(form.hint("merge"), "path")
    placed = cuts.positions(_named("path", releases, recordings), ["path", "release_at", "ref_at"], "_place")
    first = placed.groupBy("path").agg(F.min("_place").alias("_first"))
    return placed.join(first.hint("merge"), "path").withColumn("ord", (F.col("_place") - F.col("_first") + 1).cast("int")).select("path", "ord", *_FIELDS)


def _named(key: str, releases: DataFrame, recordings: DataFrame) -> DataFrame:
    """A row for each recording (sr) that a release (_release at release_at) names, with release_at, ref_at and the track's fields."""
    album_like = (F.col("_release.ReleaseType") == "Album") | ((F.col("version") == "382") & (F.col("_release._IsMainRelease") == "true"))
    albums = releases.where(F.coalesce(album_like, F.lit(False))).groupBy(key).agg(F.min_by("_release", "release_at").alias("album"))
    inner = F.flatten(F.transform("_release.TrackReleaseList.TrackRelease", lambda t: F.coalesce(t["ReleaseResourceReferenceList"]["ReleaseResourceReference"], F.array(t["LinkedReleaseResourceReference"]))))
    untyped = F.coalesce(F.col("_release.ReleaseType"), F.lit("")) == ""
    nested = ((F.col("_release.ReleaseType") == "Album") | (untyped & (F.col("version") != "382"))) & (F.size(F.coalesce(inner, F.array().cast("array<string>"))) > 0)
    own = "ReleaseResourceReferenceList.ReleaseResourceReference"
    refs = F.when(nested, inner).otherwise(F.col(f"_release.{own}"))
    # rows don't carry the lists of references along: these grow with the release
    bare = lambda c: F.col(c).dropFields("ReleaseResourceReferenceList", "TrackReleaseList")
    named = releases.select(key, "release_at", bare("_release").alias("_release"), nested.alias("nested"), F.posexplode(refs).alias("ref_at", "ref")).withColumn("ref", clean("ref"))
    listed = albums.select(key, F.posexplode(f"album.{own}").alias("_at", "ref")).groupBy(key, clean("ref").alias("ref")).agg((F.min("_at") + 1).alias("album_at"))
    recordings = recordings.select(key, "version", "sr", clean("sr.ResourceReference").alias("ref"))
    met = named.join(recordings.hint("merge"), [key, "ref"]).join(listed.hint("merge"), [key, "ref"], "left")
    nth = F.row_number().over(Window.partitionBy(key, "ref").orderBy("release_at", "ref_at"))
    met = met.withColumn("_nth", nth).where("_nth = 1").join(albums.select(key, bare("album").alias("album"), F.col(f"album.{own}").isNotNull().alias("lists")).hint("merge"), key, "left")
    met = met.withColumn("rel", F.when(F.col("nested"), F.col("_release")).otherwise(F.coalesce("album", "_release")))

    sr, d, rel = F.col("sr"), F.get("sr.SoundRecordingDetailsByTerritory", F.lit(0)), F.col("rel")
    rel_d = F.get("rel.ReleaseDetailsByTerritory", F.lit(0))
    artists = F.coalesce(sr["DisplayArtist"], d["DisplayArtist"], rel["DisplayArtist"], rel_d["DisplayArtist"])
    full = lambda a: a["PartyName"]["FullName"]
    number = lambda a: F.coalesce(a["_SequenceNumber"], a["SequenceNumber"])
    main = F.when(
        F.col("version") == "382",
        _text(_first(artists, lambda a: a["ArtistRole"] == "MainArtist", full), _first(artists, lambda a: number(a) == "1", full), _first(artists, lambda a: F.lit(True), full)),
    ).otherwise(_text(_first(artists, lambda a: F.coalesce(a["ArtistRole"] == "MainArtist", F.lit(False)) | F.coalesce(number(a) == "1", F.lit(False)), full), _first(artists, lambda a: F.lit(True), full)))
    people = F.coalesce(sr["ResourceContributor"], d["ResourceContributor"], sr["IndirectResourceContributor"], d["IndirectResourceContributor"])
    credit = lambda c: F.struct(clean(full(c)).alias("name"), _text(c["Role"], c["ContributorRole"], c["ResourceContributorRole"], F.when(F.col("version") != "382", c["IndirectResourceContributorRole"])).alias("role"), leading_float(c["HasRightShare"]).alias("share_pct"))
    technical = F.coalesce(sr["TechnicalDetails"], sr["TechnicalSoundRecordingDetails"], d["TechnicalSoundRecordingDetails"])
    line = F.coalesce(sr["PLine"], d["PLine"], rel["PLine"])
    rights_year = nonzero_int(_text(line["Year"], F.regexp_extract(line["PLineText"], r"(\d{4})", 1)))
    kind = lambda t: F.coalesce(t["_TitleType"], t["TitleType"])
    titles = F.coalesce(sr["Title"], d["Title"])
    genre = F.coalesce(sr["Genre"], d["Genre"])
    release_date = _text(sr["CreationDate"], d["ReleaseDate"], rel["ReleaseDate"])
    out = met.select(
        key,
        "release_at",
        "ref_at",
        "ref",
        _text(sr["ReferenceTitle"]["TitleText"], _first(titles, lambda t: kind(t).isNull() | (kind(t) == "FormalTitle"), lambda t: t["TitleText"]), _first(titles, lambda t: F.lit(True), lambda t: t["TitleText"])).alias("title"),
        clean(_first(titles, lambda t: kind(t) == "AlternativeTitle", lambda t: t["SubTitle"])).alias("version_title"),
        _text(main, d["DisplayArtistName"], rel["DisplayArtistName"], rel_d["DisplayArtistName"]).alias("artist_name"),
        clean(rel["ReferenceTitle"]["TitleText"]).alias("album_title"),
        clean(_first(sr["SoundRecordingId"], lambda i: i["ISRC"].isNotNull(), lambda i: i["ISRC"])).alias("isrc"),
        clean(_first(sr["WorkId"], lambda i: i["ISWC"].isNotNull(), lambda i: i["ISWC"])).alias("iswc"),
        clean(_first(F.col("album.ReleaseId"), lambda i: i["ICPN"].isNotNull(), lambda i: i["ICPN"])).alias("barcode"),
        clean(_first(F.col("album.ReleaseId"), lambda i: i["CatalogNumber"].isNotNull(), lambda i: i["CatalogNumber"])).alias("catalogue_no"),
        clean(genre["GenreText"]).alias("genre"),
        clean(genre["SubGenre"]).alias("subgenre"),
        _text(sr["LanguageOfPerformance"], d["LanguageOfPerformance"]).alias("language"),
        iso_seconds(clean(sr["Duration"])).alias("duration_sec"),
        F.coalesce(nonzero_int(clean(sr["SequenceNumber"])), F.when(F.col("lists"), F.coalesce("album_at", F.lit(0))).cast("bigint"), F.when(F.col("nested"), F.col("ref_at") + 1).cast("bigint")).alias("track_number"),
        (_text(sr["ParentalWarningType"], d["ParentalWarningType"], rel["ParentalWarningType"]) == "Explicit").alias("explicit"),
        clean(line["PLineText"]).alias("rights_holder"),
        rights_year.alias("rights_year"),
        F.coalesce(year(release_date), F.when(F.col("version") == "382", rights_year)).alias("year"),
        F.coalesce(F.filter(F.transform(people, credit), lambda c: c["name"].isNotNull()), F.array().cast("array<struct<name:string,role:string,share_pct:double>>")).alias("credits"),
        F.lower(basename(_text(F.get(technical, F.lit(0))["File"]["FileName"], F.get(technical, F.lit(0))["AudioFile"]["FileName"]))).alias("audio_file"),
    )
    return out.withColumn("explicit", F.coalesce("explicit", F.lit(False)))


def artwork(messages: DataFrame, key: str, xml: str = "xml") -> DataFrame:
    """The front cover's file name of each message, else the first image's; lower case."""
    m = parsed(messages, xml)
    images = F.col("m.ResourceList.Image")
    name = lambda i: _text(F.get(i["ImageDetailsByTerritory"], F.lit(0))["TechnicalImageDetails"]["File"]["FileName"], i["TechnicalDetails"]["File"]["FileName"])
    return m.select(key, F.lower(F.coalesce(_first(images, lambda i: i["ImageType"] == "FrontCoverImage", name), _first(images, lambda i: F.lit(True), name))).alias("artwork_file"))


def with_files(rows: DataFrame, files: str = "files", wanted: str = "audio_file") -> DataFrame:
    """J13. rows with the size of the package's file that a track names, null if it isn't there."""
    return rows.withColumn("file_size", F.try_element_at(files, F.col(wanted)))


def chosen(rows: DataFrame, positions: list[int] | None) -> DataFrame:
    """P27. Rows at the chosen positions, from 1; all for None."""
    return rows if positions is None else rows.where(reduce(lambda a, b: a | b, [F.col("ord") == p for p in positions], F.lit(False)))


# Fields of the catalogue's import layout and the columns that fill them.
IMPORT_FIELDS = {"Title": "title", "ISRC": "isrc", "Artist": "artist_name", "Album": "album_title", "Label": "label", "Genre": "genre", "Year": "year", "Duration": "duration_sec", "Language": "language", "RightsHolder": "rights_holder", "RightsYear": "rights_year", "Territories": "territories"}


def import_fields(rows: DataFrame, submitter: str) -> Column:
    """P34. Map of import field to text of a parsed track: blank for what is missing, credits a line each."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    credits = F.array_join(F.transform("credits", lambda c: F.concat(c["name"], F.lit(" ("), F.coalesce(c["role"], F.lit("")), F.lit(")"))), "\n") if "credits" in rows.columns else F.lit("")
    given = {f: text(c) for f, c in IMPORT_FIELDS.items()} | {"Explicit": F.when(F.col("explicit"), "Yes").otherwise("No"), "Credits": credits, "SubmittedBy": F.lit(submitter)}
    return F.create_map(*[x for f, c in given.items() for x in (F.lit(f), c)])


def imported(rows: DataFrame, positions: list[int] | None, submitter: str) -> DataFrame:
    """W38. The chosen tracks of messages as records to create, with ok and error; a track without title and code fails."""
    named = clean("title").isNotNull() | clean("isrc").isNotNull()
    out = chosen(rows, positions).withColumn("fields", import_fields(rows, submitter))
    return out.withColumn("ok", named).withColumn("action", F.when(named, "created").otherwise("failed")).withColumn("error", F.when(~named, "neither title nor code"))
