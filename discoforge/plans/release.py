"""Release messages: plan a release from its tracks, validate it, render the message."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discoforge.functions.text import asset_part, clean, split_names
from discoforge.functions.values import asset_number, full_iso, iso_date, short_iso, stored_md5, wave_name
from discoforge.operators.rollups import first_value
from discoforge.operators.validation import check, release_rules, track_rules, with_position

from .xmltree import E, Each, document


@dataclass(frozen=True)
class Parties:
    """Who sends and who receives the messages, and what a label is called by default."""

    sender_id: str
    sender_name: str
    recipient_id: str
    recipient_name: str
    label: str
    rights_society: str = ""


TRACK = ["isrc", "title", "artist_name", "language", "genre", "explicit", "year", "pline_text", "cline_text", "composers", "producers", "publishers", "sequence_no"]


def either(*values: Column) -> Column:
    """The first text that isn't empty."""
    return F.coalesce(*[F.nullif(v.cast("string"), F.lit("")) for v in values])


def plan(tracks: DataFrame, release: str, parties: Parties, today: str, overrides: dict[str, str] | None = None, artwork_ext: str = "jpg") -> DataFrame:
    """W41. One row a release: album, its tracks in order, artwork and total duration, as structs.

    Tracks have ord; a track without a sequence number stands at its position. The album's fields are those of
    the first track, unless overridden. Releases whose first track has no four-digit year have no plan.
    """
    over = overrides or {}
    place = F.coalesce(F.nullif("sequence_no", F.lit(0)), F.row_number().over(Window.partitionBy(release).orderBy("ord")))
    laid = tracks.withColumn("place", place).withColumn("position", F.row_number().over(Window.partitionBy(release).orderBy("place", "ord")))
    set_ = lambda name, *values: either(F.lit(over[name]) if name in over else F.lit(None), *values)
    year = F.trim(F.col("year").cast("string"))
    catalogue, barcode, label = set_("catalogue_no", F.col("catalogue_no")), set_("barcode", F.col("barcode")), set_("label", F.col("label"), F.lit(parties.label))
    album = F.struct(
        set_("album_title", F.col("album_title")).alias("title"),
        set_("album_artist", F.col("album_artist"), F.col("artist_name")).alias("artist"),
        barcode.alias("barcode"),
        catalogue.alias("catalogue_no"),
        label.alias("label"),
        set_("pline_text", F.col("pline_text"), F.concat(F.lit("(P) "), year, F.lit(f" {parties.label}"))).alias("pline_text"),
        set_("cline_text", F.col("cline_text"), F.concat(F.lit("(C) "), year, F.lit(f" {parties.label}"))).alias("cline_text"),
        year.alias("year"),
        set_("genre", F.col("genre")).alias("genre"),
        set_("language", F.col("language")).alias("language"),
        set_("original_release_date", iso_date("original_release_date"), F.concat(year, F.lit("-01-01"))).alias("original_release_date"),
        set_("release_date", iso_date("release_date"), F.lit(today)).alias("release_date"),
        F.lit(over.get("territory", "Worldwide")).alias("territory"),
        set_("image_asset", F.col("image_asset_number"), F.concat(F.lit("IMG_"), asset_part(either(F.col("catalogue_no"), F.col("barcode"))))).alias("image_asset"),
    )
    heads = laid.groupBy(release).agg(
        first_value(album, ["place", "ord"]).alias("album"),
        F.bool_or(F.coalesce("explicit", F.lit(False))).alias("any_explicit"),
        F.sum(F.coalesce("duration_sec", F.lit(0))).alias("seconds"),
    )
    heads = heads.where(F.col("album.year").rlike(r"^\d{4}$"))
    asset = asset_number("asset_number", "album.catalogue_no", F.coalesce(F.nullif("sequence_no", F.lit(0)), F.col("position")))
    joined = laid.join(heads, release).withColumn("asset", asset)
    track = F.struct(
        "position",
        *TRACK,
        "asset",
        wave_name(F.col("wav_filename"), F.col("asset")).alias("wav"),
        either(F.col("resource_reference"), F.concat(F.lit("A"), F.col("asset"))).alias("ref"),
        either(F.col("technical_resource"), F.concat(F.lit("T"), F.col("asset"))).alias("tech"),
        F.concat(F.lit("R"), F.col("position").cast("string")).alias("release_ref"),
        F.when(F.coalesce("duration_sec", F.lit(0)) != 0, full_iso("duration_sec")).alias("duration"),
        stored_md5("audio_hash_md5", F.col("audio") if "audio" in tracks.columns else F.lit(None).cast("binary")).alias("md5"),
    )
    out = joined.groupBy(release, "album", "any_explicit", "seconds").agg(F.array_sort(F.collect_list(track)).alias("tracks"))  # a release is an album: a few dozen tracks
    image = F.col("album.image_asset")
    art = F.struct(image.alias("asset"), F.concat(image, F.lit("." + artwork_ext.lstrip("."))).alias("filename"), F.concat(F.lit("A"), image).alias("ref"), F.concat(F.lit("T"), image).alias("tech"))
    return out.select(release, "album", F.col("any_explicit").alias("explicit"), full_iso("seconds").alias("duration"), "tracks", art.alias("artwork"))


def validate(tracks: DataFrame, release: str) -> DataFrame:
    """V01-V08. One row a release with errors and warnings in the order of its tracks."""
    place = F.coalesce(F.nullif("sequence_no", F.lit(0)), F.row_number().over(Window.partitionBy(release).orderBy("ord")))
    laid = with_position(tracks.withColumn("place", place), release, ["place", "ord"])
    of_tracks = check(laid, track_rules()).select(release, "position", "errors", "warnings")
    heads = check(laid.where("position = 1"), release_rules()).select(release, F.lit(0).alias("position"), "errors", "warnings")
    every = heads.unionByName(of_tracks.select(release, F.col("position").cast("int").alias("position"), "errors", "warnings"))
    listed = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", c))), lambda x: x[c])).alias(c)
    return every.groupBy(release).agg(listed("errors"), listed("warnings"))


def _party(tag: str, id_: str, name: str) -> E:
    return E(tag, [E("PartyId", id_), E("PartyName", [E("FullName", name)])])


def _artist(name: Column) -> E:
    return E("DisplayArtist", [E("PartyName", [E("FullName", name)]), E("ArtistRole", "MainArtist")], {"SequenceNumber": "1"})


def _line(tag: str, year: Column, text: Column) -> E:
    return E(tag, [E("Year", year), E(f"{tag}Text", text)])


def _file(name: Column, md5: Column) -> E:
    return E("File", [E("FileName", name), E("FilePath", "resources/"), E("HashSum", [E("HashSum", md5), E("HashSumAlgorithmType", "MD5")])])


def _warning(explicit: Column) -> E:
    return E("ParentalWarningType", F.when(explicit, "Explicit").otherwise("NotExplicit"))


def _genre(value: Column) -> E:
    return E("Genre", [E("GenreText", value)])


def render(plans: DataFrame, parties: Parties, message_id: Column, created: Column, today: str, artwork_md5: Column | None = None) -> DataFrame:
    """W20. plans with xml, the full message of each release. Ids and times are given, never made up here."""
    album, artwork, tracks = F.col("album"), F.col("artwork"), F.col("tracks")
    dpid = {"Namespace": f"DPID:{parties.sender_id}"}
    society = f" [{parties.rights_society}]" if parties.rights_society else ""
    own_line = lambda t, mark, text: either(t[text], F.concat(F.lit(f"({mark}) "), either(t["year"], album["year"]), F.lit(" "), album["label"]))

    def contributor(name: Column, role: str) -> E:
        return E("IndirectResourceContributor", [E("PartyName", [E("FullName", name)]), E("IndirectResourceContributorRole", role)])

    def producer(x: Column) -> E:
        return E("ResourceContributor", [E("PartyName", [E("FullName", x["name"])]), E("ResourceContributorRole", "Producer"), E("PrimaryRole", "Producer")], {"SequenceNumber": x["n"].cast("string")})

    def recording(t: Column) -> E:
        publishers = split_names(t["publishers"], "[,;]")
        publishers = F.when(F.size(publishers) > 0, publishers).otherwise(F.array(F.lit("Copyright Control")))
        producers = F.transform(F.coalesce(t["producers"], F.array().cast("array<string>")), lambda p, i: F.struct((i + 1).alias("n"), p.alias("name")))
        return E("SoundRecording", [
            E("SoundRecordingType", "MusicalWorkSoundRecording"),
            E("SoundRecordingId", [E("ISRC", t["isrc"]), E("ProprietaryId", t["asset"], dpid)]),
            E("ResourceReference", t["ref"]),
            E("ReferenceTitle", [E("TitleText", t["title"])]),
            E("LanguageOfPerformance", t["language"], shown=clean(t["language"]).isNotNull()),
            E("Duration", t["duration"]),
            E("SoundRecordingDetailsByTerritory", [
                E("TerritoryCode", album["territory"]),
                E("Title", [E("TitleText", t["title"])]),
                _artist(t["artist_name"]),
                Each(producers, producer),
                Each(publishers, lambda p: contributor(F.concat(p, F.lit(society)), "MusicPublisher")),
                Each(F.coalesce(t["composers"], F.array().cast("array<string>")), lambda c: contributor(c, "Composer")),
                E("LabelName", album["label"]),
                _line("PLine", either(t["year"], album["year"]), own_line(t, "P", "pline_text")),
                _genre(either(t["genre"], album["genre"])),
                _warning(t["explicit"]),
                E("TechnicalSoundRecordingDetails", [
                    E("TechnicalResourceDetailsReference", t["tech"]),
                    E("AudioCodecType", "PCM"), E("BitRate", "2116"), E("NumberOfChannels", "2"), E("IsPreview", "false"),
                    _file(t["wav"], t["md5"]),
                ]),
            ]),
        ])

    image = E("Image", [
        E("ImageType", "FrontCoverImage"),
        E("ImageId", [E("ProprietaryId", artwork["asset"], dpid)]),
        E("ResourceReference", artwork["ref"]),
        E("ImageDetailsByTerritory", [
            E("TerritoryCode", "Worldwide"),
            E("TechnicalImageDetails", [E("TechnicalResourceDetailsReference", artwork["tech"]), E("ImageCodecType", "JPEG"), _file(artwork["filename"], artwork_md5 if artwork_md5 is not None else F.lit(None).cast("string"))]),
        ]),
    ])
    titles = lambda text: [E("Title", [E("TitleText", text)], {"TitleType": kind}) for kind in ("FormalTitle", "DisplayTitle")]

    def item(number: Column, kind: str, ref: Column) -> E:
        return E("ResourceGroupContentItem", [E("SequenceNumber", number.cast("string")), E("ResourceType", kind), E("ReleaseResourceReference", ref)])

    main = E("Release", [
        E("ReleaseId", [E("ICPN", album["barcode"]), E("CatalogNumber", album["catalogue_no"], dpid), E("ProprietaryId", F.concat(F.lit("Vnum"), F.coalesce(album["barcode"], album["catalogue_no"], F.lit(""))), dpid)]),
        E("ReleaseReference", "R0"),
        E("ReferenceTitle", [E("TitleText", album["title"])]),
        E("ReleaseResourceReferenceList", [
            Each(tracks, lambda t: E("ReleaseResourceReference", t["ref"], {"ReleaseResourceType": "PrimaryResource"})),
            E("ReleaseResourceReference", artwork["ref"], {"ReleaseResourceType": "SecondaryResource"}),
        ]),
        E("ReleaseType", "Album"),
        E("ReleaseDetailsByTerritory", [
            E("TerritoryCode", album["territory"]),
            E("DisplayArtistName", album["artist"]),
            E("LabelName", album["label"], {"LabelNameType": "DisplayLabelName"}),
            *titles(album["title"]),
            _artist(album["artist"]),
            _warning(F.col("explicit")),
            E("ResourceGroup", [
                E("ResourceGroup", [
                    E("Title", [E("TitleText", "Disc 1")]),
                    E("SequenceNumber", "1"),
                    Each(tracks, lambda t: item(F.coalesce(F.nullif(t["sequence_no"].cast("bigint"), F.lit(0)), t["position"].cast("bigint")), "SoundRecording", t["ref"])),
                ]),
                item(F.size(tracks) + 1, "Image", artwork["ref"]),
            ]),
            _genre(album["genre"]),
            E("ReleaseDate", today),
            E("OriginalReleaseDate", album["original_release_date"]),
        ]),
        E("Duration", F.col("duration")),
        _line("PLine", album["year"], album["pline_text"]),
        _line("CLine", album["year"], album["cline_text"]),
    ], {"IsMainRelease": "true"})

    def track_release(t: Column) -> E:
        year = either(t["year"], album["year"])
        return E("Release", [
            E("ReleaseId", [E("ISRC", t["isrc"])]),
            E("ReleaseReference", t["release_ref"]),
            E("ReferenceTitle", [E("TitleText", t["title"])]),
            E("ReleaseResourceReferenceList", [E("ReleaseResourceReference", t["ref"])]),
            E("ReleaseType", "TrackRelease"),
            E("ReleaseDetailsByTerritory", [
                E("TerritoryCode", album["territory"]),
                E("DisplayArtistName", t["artist_name"]),
                E("LabelName", album["label"]),
                *titles(t["title"]),
                _artist(t["artist_name"]),
                _warning(t["explicit"]),
                E("ResourceGroup", [E("SequenceNumber", "1"), item(F.lit(1), "SoundRecording", t["ref"])]),
                _genre(either(t["genre"], album["genre"])),
            ]),
            E("Duration", t["duration"]),
            _line("PLine", year, own_line(t, "P", "pline_text")),
            _line("CLine", year, own_line(t, "C", "cline_text")),
        ])

    start = album["release_date"]

    def deal(model: str, *uses: str) -> E:
        terms = [E("CommercialModelType", model), E("Usage", [E("UseType", u) for u in uses]), E("TerritoryCode", album["territory"]), E("ValidityPeriod", [E("StartDate", start)])]
        return E("Deal", [E("DealTerms", terms)])

    subscription = deal("SubscriptionModel", "Stream", "ConditionalDownload")
    deals = E("DealList", [
        E("ReleaseDeal", [E("DealReleaseReference", "R0"), subscription, E("EffectiveDate", start)]),
        E("ReleaseDeal", [Each(tracks, lambda t: E("DealReleaseReference", t["release_ref"])), deal("AdvertisementSupportedModel", "Stream"), subscription, E("EffectiveDate", start)]),
    ], {"xmlns": ""})
    root = E("NewReleaseMessage", [
        E("MessageHeader", [
            E("MessageThreadId", message_id), E("MessageId", message_id),
            _party("MessageSender", parties.sender_id, parties.sender_name),
            _party("MessageRecipient", parties.recipient_id, parties.recipient_name),
            E("MessageCreatedDateTime", created), E("MessageControlType", "LiveMessage"),
        ], {"xmlns": ""}),
        E("UpdateIndicator", "OriginalMessage", {"xmlns": ""}),
        E("ResourceList", [Each(tracks, recording), image], {"xmlns": ""}),
        E("ReleaseList", [main, Each(tracks, track_release)], {"xmlns": ""}),
        deals,
    ], {"xmlns": "http://ddex.net/xml/ern/382", "xmlns:xsi": "http://www.w3.org/2001/XMLSchema-instance", "MessageSchemaVersionId": "ern/382"})
    return plans.select("*", F.explode(F.array(document(root))).alias("xml"))  # generated: rendered once, whatever is asked of it


def render_simple(tracks: DataFrame, release: str, parties: Parties, message_id: Column, created: Column, this_year: int) -> DataFrame:
    """W21. One row a release with xml, the short message: recordings in order of their numbers, none counting as 999, one deal.

    The album's fields, album_title, album_artist, barcode, catalogue_no, album_year, album_genre and artwork_filename,
    are those of the release's first row by ord; tracks take artist, year and genre from it where they lack them.
    """
    columns = ["isrc", "title", "artist_name", "duration_sec", "year", "genre", "language", "explicit", "audio_filename", "sequence_no"]
    place = F.coalesce(F.nullif("sequence_no", F.lit(0)), F.lit(999))
    listed = F.array_sort(F.collect_list(F.struct(place.alias("place"), "ord", *columns)))
    album = first_value(F.struct("album_title", "album_artist", "barcode", "catalogue_no", "album_year", "album_genre", "artwork_filename"), ["ord"])
    rows = tracks.groupBy(release).agg(listed.alias("listed"), album.alias("album"))
    rows = rows.withColumn("tracks", F.transform("listed", lambda t, i: F.struct((i + 1).cast("string").alias("n"), *[t[c].alias(c) for c in columns])))
    album, some = F.col("album"), lambda c: clean(c.cast("string")).isNotNull()
    has_art, label = some(album["artwork_filename"]), F.lit(parties.label)
    own = {"Namespace": parties.sender_id}
    ref = lambda t: F.concat(F.lit("A"), t["n"])
    year = lambda t: either(t["year"], album["album_year"])
    artist = lambda t: either(t["artist_name"], album["album_artist"])

    def genre(value: Column) -> E:
        return E("Genre", [E("GenreText", value)], shown=some(value))

    def recording(t: Column) -> E:
        return E("SoundRecording", [
            E("SoundRecordingType", "MusicalWorkSoundRecording"),
            E("SoundRecordingId", [E("ISRC", t["isrc"])]),
            E("ResourceReference", ref(t)),
            E("ReferenceTitle", [E("TitleText", t["title"])]),
            E("Duration", short_iso(F.coalesce(t["duration_sec"], F.lit(0)))),
            E("SoundRecordingDetailsByTerritory", [
                E("TerritoryCode", "Worldwide"),
                E("Title", [E("TitleText", t["title"])]),
                _artist(artist(t)),
                E("LabelName", label),
                _line("PLine", year(t), F.concat(F.lit("(P) "), year(t), F.lit(" "), label)),
                genre(either(t["genre"], album["album_genre"])),
                E("LanguageOfPerformance", t["language"], shown=some(t["language"])),
                _warning(F.coalesce(t["explicit"], F.lit(False))),
                E("TechnicalSoundRecordingDetails", [
                    E("TechnicalResourceDetailsReference", F.concat(F.lit("T"), t["n"])),
                    E("AudioCodecType", "PCM"),
                    E("File", [E("FileName", either(t["audio_filename"], F.concat(either(t["isrc"], ref(t)), F.lit(".wav")))), E("FilePath", "resources/")]),
                ]),
            ]),
        ])

    image = E("Image", [
        E("ImageType", "FrontCoverImage"),
        E("ImageId", [E("ProprietaryId", F.concat(F.coalesce(album["catalogue_no"], F.lit("")), F.lit("_artwork")), own)]),
        E("ResourceReference", "ARTWORK"),
        E("ReferenceTitle", [E("TitleText", F.concat(F.coalesce(album["album_title"], F.lit("")), F.lit(" Cover")))]),
        E("ImageDetailsByTerritory", [
            E("TerritoryCode", "Worldwide"),
            E("TechnicalImageDetails", [E("TechnicalResourceDetailsReference", "TART"), E("File", [E("FileName", album["artwork_filename"]), E("FilePath", "resources/")])]),
        ]),
    ], shown=has_art)
    main = E("Release", [
        E("ReleaseId", [E("ICPN", album["barcode"], shown=some(album["barcode"])), E("CatalogNumber", album["catalogue_no"], own, shown=some(album["catalogue_no"]))]),
        E("ReleaseReference", "R0"),
        E("ReferenceTitle", [E("TitleText", album["album_title"])]),
        E("ReleaseResourceReferenceList", [
            Each(F.col("tracks"), lambda t: E("ReleaseResourceReference", ref(t), {"ReleaseResourceType": "PrimaryResource"})),
            E("ReleaseResourceReference", "ARTWORK", {"ReleaseResourceType": "SecondaryResource"}, shown=has_art),
        ]),
        E("ReleaseType", "Album"),
        E("ReleaseDetailsByTerritory", [
            E("TerritoryCode", "Worldwide"),
            E("DisplayArtistName", album["album_artist"]),
            E("LabelName", label),
            genre(album["album_genre"]),
            E("ParentalWarningType", "NotExplicit"),
            E("ReleaseDate", album["album_year"], shown=some(album["album_year"])),
        ]),
    ], {"IsMainRelease": "true"})

    def track_release(t: Column) -> E:
        return E("Release", [
            E("ReleaseId", [E("ISRC", t["isrc"])]),
            E("ReleaseReference", F.concat(F.lit("R"), t["n"])),
            E("ReferenceTitle", [E("TitleText", t["title"])]),
            E("ReleaseResourceReferenceList", [E("ReleaseResourceReference", ref(t))]),
            E("ReleaseType", "TrackRelease"),
            E("ReleaseDetailsByTerritory", [
                E("TerritoryCode", "Worldwide"),
                E("DisplayArtistName", artist(t)),
                E("LabelName", label),
                genre(either(t["genre"], album["album_genre"])),
                _warning(F.coalesce(t["explicit"], F.lit(False))),
                E("SequenceNumber", t["sequence_no"].cast("string"), shown=F.coalesce(t["sequence_no"] != 0, F.lit(False))),
            ]),
        ])

    deal = E("Deal", [E("DealTerms", [
        E("CommercialModelType", "PayAsYouGoModel"),
        E("Usage", [E("UseType", "OnDemandStream"), E("UseType", "PermanentDownload")]),
        E("TerritoryCode", "Worldwide"),
        E("ValidityPeriod", [E("StartDate", F.concat(either(album["album_year"], F.lit(str(this_year))), F.lit("-01-01")))]),
    ])])
    root = E("NewReleaseMessage", [
        E("MessageHeader", [
            E("MessageThreadId", message_id), E("MessageId", message_id),
            _party("MessageSender", parties.sender_id, parties.sender_name),
            _party("MessageRecipient", parties.recipient_id, parties.recipient_name),
            E("MessageCreatedDateTime", created), E("MessageControlType", "LiveMessage"),
        ], {"xmlns": ""}),
        E("UpdateIndicator", "OriginalMessage", {"xmlns": ""}),
        E("ResourceList", [Each(F.col("tracks"), recording), image], {"xmlns": ""}),
        E("ReleaseList", [main, Each(F.col("tracks"), track_release)], {"xmlns": ""}),
        E("DealList", [E("ReleaseDeal", [E("DealReleaseReference", "R0"), deal])], {"xmlns": ""}),
    ], {"MessageSchemaVersionId": "ern/382", "xmlns": "http://ddex.net/xml/ern/382", "xmlns:xsi": "http://www.w3.org/2001/XMLSchema-instance"})
    return rows.select(release, "album", "tracks", F.explode(F.array(document(root))).alias("xml"))


def files(plans: DataFrame, release: str) -> DataFrame:
    """W41. The files of a package: path and hash, tracks first."""
    track = F.transform("tracks", lambda t: F.struct(F.concat(F.lit("resources/"), t["wav"]).alias("path"), t["md5"].alias("md5")))
    art = F.array(F.struct(F.concat(F.lit("resources/"), F.col("artwork.filename")).alias("path"), F.lit(None).cast("string").alias("md5")))
    return plans.select(release, F.posexplode(F.concat(track, art)).alias("n", "f")).select(release, "n", "f.path", "f.md5")


def sidecar(songs: DataFrame, site: str, owner: str, first_tag: str, short: bool = False) -> DataFrame:
    """W27. songs with text: suggested title, description and tags of a video."""
    from discoforge.functions.text import hashtags

    year = F.when(clean("year").isNotNull(), F.concat(F.lit(" ("), F.col("year").cast("string"), F.lit(")"))).otherwise("")
    album = F.when(clean("album").isNotNull(), F.concat(F.lit(' — from the album "'), F.col("album"), F.lit('"'))).otherwise("")
    parts = [
        F.lit("SUGGESTED TITLE:"),
        F.concat("artist", F.lit(" – "), "title", year, F.lit(" #Shorts" if short else "")),
        F.lit(""),
        F.lit("DESCRIPTION:"),
        F.concat("title", F.lit(" by "), "artist", album, year, F.lit(".")),
        F.lit(""),
        F.concat(F.lit(f"Listen: {site}/?t="), F.col("record_id").cast("string")),
        F.lit(""),
        F.lit(f"Official upload from {owner}"),
        F.lit(""),
        F.coalesce("p_line", F.lit("")),
        F.lit(""),
        hashtags(first_tag, "genre", "artist"),
        F.lit(""),
        F.lit("TAGS:"),
        F.array_join(F.filter(F.array("artist", "title", "genre", F.col("year").cast("string")), lambda x: F.coalesce(x, F.lit("")) != ""), ", "),
    ]
    return songs.withColumn("text", F.array_join(F.array(*parts), "\n"))
