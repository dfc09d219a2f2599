"""What tracks of one system become in the fields of another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discoforge.functions.text import blank, joined
from discoforge.functions.values import clock_of
from discoforge.operators.writes import payload

# Fields that targets take from a track, under the track's own names. A name and its source stand with an equals sign.
ALBUM = "album=album_title catalogue_no barcode year release_date genre"
MORE_ALBUM = "album_description original_release_date local_genre sub_genre language country rights_territories label p_line c_line publishers"
TRACK = "title artist=artist_name album_artist isrc sequence_no language duration composers producers"
MORE_TRACK = "featured_artist iswc filename wav_filename asset_number audio_hash_md5 technical_resource resource_reference sound_recording_id parental"

#: Fields of each target, as names of the target and of the track.
TARGETS = {
    "catalogue": f"{TRACK} {ALBUM} {MORE_ALBUM} {MORE_TRACK}",
    "catalogue_album": f"album_artist {ALBUM} {MORE_ALBUM}",
    "streamer": f"{TRACK} {ALBUM} filename audio_url",
    "streamer_album": f"album_artist {ALBUM}",
}


def _prepared(tracks: DataFrame, target: str) -> DataFrame:
    """Tracks with the values that a target takes: lists as texts, durations as clocks, names of files."""
    kinds = dict(tracks.dtypes)
    have = lambda c: F.col(c) if c in kinds else F.lit(None).cast("string")
    change: dict[str, Column] = {c: joined(F.col(c)) for c in ("composers", "producers", "publishers") if kinds.get(c, "").startswith("array")}
    if "duration_sec" in kinds or "duration" in kinds:
        change["duration"] = clock_of(F.coalesce(have("duration_sec").cast("string"), have("duration").cast("string")))
    if target == "catalogue":
        change["filename"] = F.when(~blank(have("filename")), have("filename")).otherwise(have("wav_filename"))
    elif target == "streamer":
        change["filename"] = F.regexp_replace(have("filename"), r"\.[^.]+$", "")
    else:  # an album without an artist takes its first track's
        change["album_artist"] = F.when(~blank(have("album_artist")), have("album_artist")).otherwise(have("artist_name"))
    return tracks.withColumns(change)


def target_payload(tracks: DataFrame, target: str) -> DataFrame:
    """P07. tracks with payload: a map of a target's fields to texts, blank ones left out.

    target is one of TARGETS. For the album targets a row stands for an album, its first track. The catalogue's file
    name falls back on the master's; the streamer's has no extension.
    """
    names = dict(reversed(x.split("=")) if "=" in x else (x, x) for x in TARGETS[target].split())
    ready = _prepared(tracks, target)
    return ready.withColumn("payload", payload(ready, names)).select(*tracks.columns, "payload")
