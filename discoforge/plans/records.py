"""Records of the systems to one flat track row: ordered candidate fields, typed values, lists of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discoforge.functions.text import blank, clean, first_spellings, split_names, stem, trimmed
from discoforge.functions.values import explicit_flag, explicit_flag_either, leading_int, nonzero_int, object_stem, seconds, seconds_of_time_field, short_iso

# Fields of a track and the names that a record may hold them under, by priority.
CATALOGUE = {
    "title": ["Song Title", "Track Name", "Track Title", "Title"],
    "version_title": ["Version"],
    "artist_name": ["Track Artist", "Artist"],
    "album_artist": ["Album Artist"],
    "featured_artist": ["Featured Artist"],
    "album_title": ["Album Title"],
    "album_description": ["Album Description"],
    "catalogue_no": ["Album Cat: Number", "Album Catalogue Number", "Catalogue Number"],
    "resource_reference": ["Resource Reference"],
    "technical_resource": ["Technical Resource", "Technical Resource Reference"],
    "audio_hash_md5": ["AudioHashSum", "Audio Hash", "MD5", "Audio MD5"],
    "isrc": ["ISRC"],
    "iswc": ["ISWC"],
    "barcode": ["Barcode", "UPC", "ICPN"],
    "year": ["Year", "Year of Release"],
    "release_date": ["Release Date"],
    "original_release_date": ["Original Release date", "Original Release Date"],
    "genre": ["Genre", "Local Genre"],
    "sub_genre": ["Sub Genre", "SubGenre"],
    "language": ["Language Code", "Language"],
    "country": ["Country"],
    "label": ["Label"],
    "pline_text": ["pLine", "PLine"],
    "cline_text": ["cLine", "CLine"],
    "s3_url": ["File URL", "Audio URL", "S3 URL"],
    "audio_container_url": ["Audio File", "Audio", "WAV", "Audio Container"],
    "audio_url_ref": ["Audio_URL", "audio_Url", "Audio_Url", "audio_url"],
    "artwork_container_url": ["artwork::picture", "Artwork::picture", "Artwork::Picture", "artwork::Picture", "artwork::image", "Artwork::image", "Artwork::Image", "Artwork", "Picture"],
    "artwork_url": ["Artwork URL", "Artwork Url", "Image URL", "Artwork_S3_URL", "Artwork_URL"],
    "publishers": ["Publishers", "Publisher"],
}
CONTENT = CATALOGUE | {
    "featured_artist": ["Featured Artist", "Main Artist 2"],
    "album_title": ["Album Title", "Album"],
    "catalogue_no": ["Album Catalogue Number", "Album Cat: Number", "Reference Catalogue Number", "Catalogue Number"],
    "barcode": ["UPC", "Barcode", "ICPN"],
    "year": ["Year of Release", "Year"],
    "genre": ["Genre"],
    "local_genre": ["Local Genre"],
    "rights_territories": ["Rights Territories"],
    "technical_resource": ["Technical Resource"],
    "sound_recording_id": ["SoundRecordingId"],
    "parental": ["Parental"],
    "s3_url": ["File URL", "S3_URL", "Audio URL", "S3 URL"],
    "audio_container_url": ["Audio File", "Audio", "WAV", "Sound", "Audio Container", "Sound File"],
    "artwork_url": ["Artwork_S3_URL", "Artwork URL", "Artwork Url", "Image URL", "Artwork_URL"],
}
FILE_NAMES = {"catalogue": ["Filename", "Filename.wav", "Audio Filename"], "content": ["Filename", "File Name", "Audio Filename", "Filename.wav"]}
ASSETS = ["Asset Number", "Track Asset Number", "Asset No", "Asset #", "Filename", "File Name", "Track Catalogue Number", "Reference Catalogue Number"]
IMAGE_ASSETS = ["Artwork::Resource Reference", "Artwork::Resource reference", "Artwork Asset Number", "Image Asset Number", "Artwork::Asset Number", "Image::Asset Number", "Artwork::Filename.jpg", "Artwork::Filename", "Artwork File Name", "Image File Name", "Artwork::File Name"]


def value(name: str) -> Column:
    """A field of a record, null if it lacks it."""
    return F.try_element_at("fieldData", F.lit(name))


def picked(names: list[str]) -> Column:
    """P01. The first field that isn't blank, as it stands."""
    return F.coalesce(*[F.when(~blank(value(n)), value(n)) for n in names])


def numbered(prefix: str, most: int = 4) -> Column:
    """F26. Names in numbered fields, the first spelling of each whatever its case."""
    slots = [f"{prefix} 1", f"{prefix}1", prefix, *[f"{prefix}{gap}{n}" for n in range(2, most + 1) for gap in (" ", "")]]
    return first_spellings(F.array_compact(F.array(*[clean(value(s)) for s in slots])))


def catalogue_tracks(records: DataFrame) -> DataFrame:
    """P02, P05, P06. Records (recordId, fieldData) of the catalogue as tracks."""
    plural = lambda name: F.filter(F.transform(F.split(F.coalesce(value(name), F.lit("")), "[;,]"), lambda x: trimmed(x)), lambda x: x != "")
    names = lambda one, many: F.when(F.size(numbered(one)) > 0, numbered(one)).otherwise(plural(many))
    wav = picked(FILE_NAMES["catalogue"])
    return records.select(
        F.coalesce("recordId", F.lit("")).alias("record_id"),
        *[picked(n).alias(f) for f, n in CATALOGUE.items()],
        trimmed(wav).alias("wav_filename"),
        trimmed(F.coalesce(F.nullif(stem(trimmed(wav)), F.lit("")), picked(ASSETS))).alias("asset_number"),
        trimmed(F.coalesce(picked(IMAGE_ASSETS), object_stem(picked(CATALOGUE["artwork_url"])))).alias("image_asset_number"),
        nonzero_int(picked(["Sequence Number", "Track Number"])).alias("sequence_no"),
        seconds(picked(["Duration"])).alias("duration_sec"),
        explicit_flag(value("Parental"), value("Explicit")).alias("explicit"),
        names("Composer", "Composers").alias("composers"),
        names("Producer", "Producers").alias("producers"),
    )


def content_tracks(records: DataFrame, minutes_as_hours: bool = True) -> DataFrame:
    """P03. Records of the content system as tracks, with the record's own fields in raw."""
    slots = lambda one: [picked([one, f"{one} 1"]), *[picked([f"{one} {n}", f"{one}{n}"]) for n in (2, 3, 4)], picked([f"{one}s"])]
    name, raw = picked(FILE_NAMES["content"]), picked(["Duration"])
    sec = seconds_of_time_field(raw, minutes_as_hours)
    number = leading_int(picked(["Track Number", "Sequence Number"]))
    return records.select(
        F.coalesce("recordId", F.lit("")).alias("record_id"),
        *[picked(n).alias(f) for f, n in CONTENT.items()],
        name.alias("filename"),
        name.alias("wav_filename"),
        stem(name).alias("asset_number"),
        number.alias("sequence_no"),
        number.alias("track_number"),
        sec.alias("duration_sec"),
        F.coalesce(short_iso(sec), raw).alias("duration"),
        explicit_flag_either(picked(["Parental"]), picked(["Explicit"])).alias("explicit"),
        split_names(F.concat_ws(";", *slots("Composer"))).alias("composers"),
        split_names(F.concat_ws(";", *slots("Producer"))).alias("producers"),
        F.col("fieldData").alias("raw"),
    )


def summaries(tracks: DataFrame, columns: list[str]) -> DataFrame:
    """P04. A narrow projection; columns that tracks lack are null."""
    return tracks.select(*[F.col(c) if c in tracks.columns else F.lit(None).cast("string").alias(c) for c in columns])


def episode_row(form: DataFrame) -> DataFrame:
    """W17, W43. Podcast form rows as records: dates with slashes, flags as the target wants them."""
    from discoforge.functions.values import slash_date

    text = lambda c: trimmed(F.coalesce(c, F.lit("")))
    return form.select(
        text("show_title").alias("Show Title"),
        text("host").alias("Host"),
        text("artwork_url").alias("Artwork_S3_URL"),
        text("category").alias("Category"),
        text("language_code").alias("Language Code"),
        text("episode_title").alias("Episode Title"),
        text("description").alias("Description"),
        F.col("audio_url").alias("S3_URL"),
        F.col("duration_sec").alias("DurationSec"),
        F.when(F.col("visibility") == "Hide", "Hide").otherwise("Show").alias("Visibility"),
        F.when(F.col("featured") == "yes", "yes").otherwise("").alias("Featured"),
        F.when(F.col("explicit") == "yes", 1).otherwise(0).alias("Explicit"),
        F.nullif("episode_number", F.lit(0)).alias("Episode Number"),
        F.nullif(slash_date("publish_date"), F.lit("")).alias("PublishDate"),
    )
