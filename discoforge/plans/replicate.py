"""Replication of catalogues between systems: what to create, update or skip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discoforge.functions.text import clean, filename_key, isrc_lookup, joined
from discoforge.functions.values import clock_of
from discoforge.operators.keys import elsewhere, fill_blanks, first_wins, prioritised_join
from discoforge.operators.rollups import first_value
from discoforge.operators.writes import payload, upsert_in_order

# Columns of a track and the target's field names.
CATALOGUE_FIELDS = {
    "title": "Track Name",
    "artist_name": "Track Artist",
    "album_artist": "Album Artist",
    "album_title": "Album Title",
    "isrc": "ISRC",
    "barcode": "Barcode",
    "sequence_no": "Sequence Number",
    "year": "Year of Release",
    "release_date": "Release Date",
    "genre": "Genre",
    "language": "Language",
    "duration": "Duration",
    "composers": "Composers",
    "producers": "Producers",
    "publishers": "Publishers",
    "label": "Label",
    "p_line": "pLine",
    "c_line": "cLine",
}


def as_fields(tracks: DataFrame) -> DataFrame:
    """Tracks with lists as texts and durations as clocks, ready for a payload."""
    kinds = dict(tracks.dtypes)
    change = {c: joined(F.col(c)) for c in ("composers", "producers") if kinds.get(c, "").startswith("array")}
    if "duration_sec" in kinds:
        change["duration"] = clock_of(F.col("duration_sec").cast("string"))
    return tracks.withColumns(change) if change else tracks


def replicate(source: DataFrame, target: DataFrame, fields: list[str] | None = None, names: dict[str, str] = CATALOGUE_FIELDS, arrival: list | None = None) -> DataFrame:
    """W30, W35, J06, J07. source with action, record_id, other_catalogue and payload.

    A track updates the target's track of its catalogue with the same code, as written, else the same sequence
    number, as the target was before; without anything to write it is skipped. Others whose code stands under
    another catalogue are left there, and the rest are created. A code that an earlier track of the batch, by
    arrival, created is there for later ones: these are left to it, whatever its catalogue; tracks without a code
    don't see each other. arrival is ord if there is one, else catalogue and number. source: catalogue_no and track
    columns. target: record_id, catalogue_no, isrc, sequence_no, ord.
    """
    arrival = arrival or (["ord"] if "ord" in source.columns else ["catalogue_no", "sequence_no"])
    both = lambda c: F.when(F.nullif(F.col(c).cast("string"), F.lit("")).isNotNull(), F.struct("catalogue_no", c))
    met = prioritised_join(source, target, [("isrc", both("isrc"), both("isrc")), ("sequence_no", both("sequence_no"), both("sequence_no"))], ["ord"])
    loose = met.where("match is null and isrc <> ''")
    asked = elsewhere(loose.select("catalogue_no", "isrc").distinct(), target, "isrc", "catalogue_no").where("other_group is not null")
    asked = asked.select(F.col("catalogue_no").alias("_c"), F.col("isrc").alias("_i"), F.col("other_group").alias("_held"))
    out = met.join(asked, (F.col("catalogue_no") == F.col("_c")) & (F.col("isrc") == F.col("_i")), "left").drop("_c", "_i")
    # the first of a new code creates it; least structs are taken in each task before the shuffle
    at = F.struct(*[F.col(c) if isinstance(c, str) else c for c in arrival])
    new = out.where("match is null and _held is null and isrc <> ''").groupBy(F.col("isrc").alias("_i")).agg(F.min(F.struct(at.alias("at"), F.col("catalogue_no").alias("c"))).alias("_new"))
    out = out.join(new, F.col("isrc") == F.col("_i"), "left")
    later = F.when(F.col("match").isNull() & (at > F.col("_new.at")), F.col("_new.c"))
    out = out.withColumn("other_catalogue", F.coalesce("_held", later)).drop("_i", "_new", "_held")
    out = as_fields(out).withColumn("payload", payload(as_fields(out), names, fields))
    action = F.when(F.col("match").isNotNull(), F.when(F.size("payload") > 0, "updated").otherwise("skipped")).when(F.col("other_catalogue").isNotNull(), "exists-other-catalogue").otherwise("created")
    return out.withColumn("action", action).withColumn("record_id", F.col("match.record_id")).drop("match")


def albums_to_create(replicated: DataFrame, target: DataFrame, order: list) -> DataFrame:
    """W30, A08. Album rows of catalogues that the target lacks and for which a track was created: the first track's album fields."""
    album = F.struct("album_title", "album_artist", "barcode", "label", "release_date")
    new = replicated.groupBy("catalogue_no").agg(first_value(album, order).alias("a"), F.bool_or(F.col("action") == "created").alias("any"))
    return new.where("any").join(target.select("catalogue_no").distinct(), "catalogue_no", "left_anti").select("catalogue_no", "a.*")


def ensure_replicated(source: DataFrame, target: DataFrame, force: bool = False) -> DataFrame:
    """W32. Tracks to create in a target: of catalogues it has no track of, or of all with force; it never updates."""
    return source if force else source.join(target.select("catalogue_no").distinct(), "catalogue_no", "left_anti")


def push(tracks: DataFrame, target: DataFrame, arrival: list = ("ord",), numbers: bool = True) -> DataFrame:
    """W31, W34. tracks with record_id, created_by (a number, else the value of arrival) and action, by code, else file name, one after another by arrival; rows with neither fail."""
    return upsert_in_order(target, tracks, ["isrc", "filename"], ["ord"], list(arrival), numbers)


def sync(tracks: DataFrame, target: DataFrame, arrival: list = ("ord",), numbers: bool = True) -> tuple[DataFrame, DataFrame]:
    """W33. Tracks with record_id, created_by and action, and the rows that fail for want of an asset number."""
    named = clean("asset_number").isNotNull()
    return push(tracks.where(named), target, arrival, numbers), tracks.where(~named).withColumn("error", F.lit("no asset number"))


def hydrated(tracks: DataFrame, catalogue: DataFrame, columns: list[str], artwork: str = "artwork_url") -> DataFrame:
    """J04, J05. tracks of a catalogue with blanks filled from the catalogue's: by code, else file name as spelt, else sequence number.

    Artwork that the matched track lacks comes from the first track of the catalogue that has one. Tracks
    without a match stay as they are.
    """
    name = lambda c: F.regexp_replace(clean(c), r"\.[^.]+$", "")
    within = lambda key: F.when(key.isNotNull(), F.struct(F.col("catalogue_no"), key.alias("k")))
    keys = [("isrc", within(isrc_lookup("isrc")), within(isrc_lookup("isrc"))), ("filename", within(name("filename")), within(name("filename"))), ("sequence_no", within(F.col("sequence_no")), within(F.col("sequence_no")))]
    met = prioritised_join(tracks, catalogue, keys, ["ord"])
    covers = catalogue.where(clean(artwork).isNotNull()).groupBy("catalogue_no").agg(first_value(F.col(artwork), ["ord"]).alias("_cover"))
    out = fill_blanks(met, "match", columns).join(covers.hint("merge"), "catalogue_no", "left")
    return out.withColumn(artwork, F.when(F.col("match").isNotNull(), F.coalesce(clean(artwork), F.col("_cover"))).otherwise(F.col(artwork))).select(*tracks.columns, "match_via")


def bulk_update(listing: DataFrame, cache: DataFrame) -> DataFrame:
    """W37, J01. Rows of a listing (catalogue_no, filename, barcode, sequence_no) with their metadata row and ok: by barcode and number, else by those in the file name."""
    from discoforge.functions.values import barcode_and_number

    pair = lambda b, s: F.when(clean(b).isNotNull() & F.col(s).isNotNull(), F.struct(clean(b).alias("barcode"), F.col(s).cast("bigint").alias("seq")))
    in_name = barcode_and_number("filename")
    keys = [("barcode", pair("barcode", "sequence_no"), pair("barcode", "seq")), ("filename", in_name, pair("barcode", "seq"))]
    return prioritised_join(listing, cache, keys, ["ord"]).withColumn("ok", F.col("match").isNotNull())


def by_filename(files: DataFrame, cache: DataFrame) -> DataFrame:
    """P22. Files with their metadata row, by the barcode and number in their names; null if a name has none."""
    from discoforge.functions.values import barcode_and_number

    held = F.when(clean("barcode").isNotNull() & F.col("seq").isNotNull(), F.struct(clean("barcode").alias("barcode"), F.col("seq").cast("bigint").alias("seq")))
    return prioritised_join(files, cache, [("filename", barcode_and_number("filename"), held)], ["ord"])


def enrich(records: DataFrame, sheet: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """J02. Records with their sheet row by code, else track number; the records and the sheet rows that are left over."""
    within = lambda key: F.when(key.isNotNull(), F.struct(F.col("catalogue_no"), key.alias("k")))
    keys = [("isrc", within(isrc_lookup("isrc")), within(isrc_lookup("isrc"))), ("number", within(F.col("sequence_no").cast("bigint")), within(F.col("sequence_no").cast("bigint")))]
    met = prioritised_join(records, sheet, keys, ["ord"])
    used = met.where("match is not null").select(F.col("match.ord").alias("ord")).distinct()
    return met.where("match is not null"), met.where("match is null").select(records.columns), sheet.join(used, "ord", "left_anti")


def pairs(left: DataFrame, right: DataFrame, given: DataFrame) -> DataFrame:
    """J03. Left and right rows by given pairs (left_id, right_id)."""
    return given.join(left.withColumnRenamed("id", "left_id"), "left_id").join(right.withColumnRenamed("id", "right_id"), "right_id")


def canonical_track(tracks: DataFrame, wanted: DataFrame) -> DataFrame:
    """J20, P06. For each wanted row (id, catalogue_no, sequence_no, isrc): the first track with its catalogue and number, or its code.

    Each place and each code is one row, its first track, before wanted rows meet it, so a place of many tracks and many
    wanted rows is no product. The first by ord of both counts.
    """
    at_place = first_wins(tracks, ["catalogue_no", "sequence_no"], ["ord"])
    of_code = first_wins(tracks, ["isrc"], ["ord"])
    by_place = wanted.select("id", "catalogue_no", "sequence_no").join(at_place, ["catalogue_no", "sequence_no"]).select("id", *tracks.columns)
    by_code = wanted.select("id", "isrc").join(of_code, "isrc").select("id", *tracks.columns)
    return first_wins(by_place.unionByName(by_code), ["id"], ["ord"])


def ready(tracks: DataFrame) -> DataFrame:
    """W36. tracks with missing: what keeps a track from being pushed."""
    lacks = lambda c: F.when(clean(F.col(c).cast("string")).isNull(), F.lit(c))
    return tracks.withColumn("missing", F.array_compact(F.array(*[lacks(c) for c in ("title", "artist_name", "filename", "catalogue_no")])))


def file_column(c: str = "filename") -> Column:
    """The key that file names are compared by."""
    return filename_key(c)
