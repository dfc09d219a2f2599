"""Validation rules as expressions: each gives a message or null; severities E and W."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discoforge.functions.text import blank
from discoforge.functions.values import iso_date

Rule = tuple[str, str, Column]


def check(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """df with errors and warnings, arrays of messages in the order of the rules."""
    of = lambda severity: F.array_compact(F.array(*[m for _, s, m in rules if s == severity])).cast("array<string>")
    return df.withColumns({"errors": of("E"), "warnings": of("W")})


def violations(df: DataFrame, rules: list[Rule], key: list[str]) -> DataFrame:
    """One row a message: key, rule, severity, message."""
    found = F.array_compact(F.array(*[F.when(m.isNotNull(), F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), m.alias("message"))) for r, s, m in rules]))
    return df.select(*key, F.explode(found).alias("v")).select(*key, "v.*")


def says(wrong: Column, *message: Column | str) -> Column:
    return F.when(wrong, F.concat(*[F.lit(m) if isinstance(m, str) else F.coalesce(m.cast("string"), F.lit("")) for m in message]))


def release_rules() -> list[Rule]:
    """Of a release's first track."""
    date = lambda c: says(~blank(c) & iso_date(c).isNull(), f"Release: {c} \"", F.col(c), "\" can't be read as a date")
    return [
        ("V01", "E", says(~F.coalesce(F.trim("barcode").rlike(r"^\d{13}$"), F.lit(False)), "Release: the barcode \"", F.trim("barcode"), "\" is not of 13 digits")),
        ("V02", "E", says(blank("catalogue_no"), "Release: no catalogue number")),
        ("V02", "E", says(blank("album_title"), "Release: no title")),
        ("V02", "E", says(blank("album_artist") & blank("artist_name"), "Release: no artist")),
        ("V07", "E", date("original_release_date")),
        ("V07", "E", date("release_date")),
    ]


ISRC_FORM = r"^[A-Z]{2}[A-Z0-9]{3}\d{7}$"


def with_position(tracks: DataFrame, release: str, order: list[str]) -> DataFrame:
    """tracks with position, 1 .. in its release, and again, whether a well-formed code came before in it."""
    formed = F.col("isrc").rlike(ISRC_FORM)
    out = tracks.withColumn("position", F.row_number().over(Window.partitionBy(release).orderBy(*order)))
    first = F.min(F.when(formed, F.col("position"))).over(Window.partitionBy(release, "isrc"))
    return out.withColumn("again", F.coalesce(formed & (F.col("position") > first), F.lit(False)))


def track_rules() -> list[Rule]:
    """Of tracks with position and again. Of a code one message at most."""
    at = F.concat(F.lit("Position "), F.col("position").cast("string"), F.lit(": "))
    year = F.trim(F.col("year").cast("string"))
    none = F.coalesce("duration_sec", F.lit(0)) == 0
    code = F.coalesce(
        says(blank("isrc"), at, "no recording code"),
        says(~F.col("isrc").rlike(ISRC_FORM), at, "\"", F.col("isrc"), "\" is no recording code"),
        says(F.col("again"), at, "recording code ", F.col("isrc"), " stood before"),
    )
    return [
        ("V03", "E", code),
        ("V04", "E", says(blank("title"), at, "no title")),
        ("V04", "E", says(blank("artist_name"), at, "no artist")),
        ("V04", "E", says(none, at, "no duration")),
        ("V05", "W", says(blank("language"), at, "no language")),
        ("V06", "E", F.coalesce(says(blank(F.col("year").cast("string")), at, "no year"), says(~year.rlike(r"^\d{4}$"), at, "the year \"", year, "\" is not of four digits"))),
        ("V08", "W", says(~none & (F.col("duration_sec") < 30), at, "lasts ", F.col("duration_sec"), " s, under half a minute")),
        ("V08", "W", says(F.col("duration_sec") > 1800, at, "lasts ", F.floor(F.col("duration_sec") / 60 + 0.5), " min, over half an hour")),
    ]


def file_rules() -> list[Rule]:
    """Of rows with kind (audio, artwork), position, size, looks_right."""
    empty = F.coalesce("size", F.lit(0)) == 0
    audio, at = F.col("kind") == "audio", F.concat(F.lit("Position "), F.col("position").cast("string"), F.lit(": "))
    return [
        ("V09", "E", says(audio & empty, at, "the audio file is absent or of size 0")),
        ("V09", "W", says(audio & ~empty & ~F.col("looks_right"), at, "the audio file doesn't start as wave files do")),
        ("V09", "E", says(~audio & empty, "Cover: absent or of size 0")),
        ("V09", "W", says(~audio & ~empty & ~F.col("looks_right"), "Cover: doesn't start as JPEG files do")),
    ]


def audio_rules() -> list[Rule]:
    """Of rows with format, sample_rate, bit_depth, channels, bitrate_kbps, duration_sec and isrc."""
    return [
        ("V10", "W", says((F.col("sample_rate") > 0) & (F.col("sample_rate") < 44100), "Sampled at ", F.col("sample_rate"), " Hz, under 44100")),
        ("V10", "W", says((F.col("bit_depth") > 0) & (F.col("bit_depth") < 16), "Samples of ", F.col("bit_depth"), " bits, under 16")),
        ("V10", "W", says(F.col("channels") == 1, "One channel only")),
        ("V10", "W", says(F.col("format").isin("mp3", "aiff"), "Files of format ", F.col("format"), " have to be asked for")),
        ("V10", "W", says((F.col("format") == "mp3") & (F.col("bitrate_kbps") > 0) & (F.col("bitrate_kbps") < 320), "Compressed to ", F.col("bitrate_kbps"), " kbps, under 320")),
        ("V10", "W", says((F.col("duration_sec") > 0) & (F.col("duration_sec") < 60), "Lasts ", F.col("duration_sec"), " s, under a minute")),
        ("V10", "W", says(F.col("duration_sec") > 720, "Lasts ", F.floor(F.col("duration_sec") / 60 + 0.5), " min, over twelve")),
        ("V10", "W", says(blank("isrc"), "The file holds no recording code")),
    ]


def sheet_rules() -> list[Rule]:
    """Of rows of a track sheet with row_number."""
    at = F.concat(F.lit("Line "), F.col("row_number").cast("string"), F.lit(": "))
    return [
        ("V11", "E", says(blank("title"), at, "no title")),
        ("V11", "E", says(blank("artist_name"), at, "no artist")),
    ]
