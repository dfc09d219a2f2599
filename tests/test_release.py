import hashlib
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from discoforge.plans import messages, release

PARTIES = release.Parties("PA-1", "Sender & Sons", "PA-2", "Receiver", "House Label", "SOC")
SCHEMA = (
    "release string, ord long, isrc string, title string, artist_name string, album_artist string, album_title string, barcode string, catalogue_no string, label string, genre string, language string,"
    " year string, sequence_no long, duration_sec long, explicit boolean, pline_text string, cline_text string, release_date string, original_release_date string, composers array<string>,"
    " producers array<string>, publishers string, asset_number string, wav_filename string, resource_reference string, technical_resource string, audio_hash_md5 string, image_asset_number string, audio binary"
)


def track(n, **change):
    row = {
        "release": "r1", "ord": n, "isrc": f"ZAABC960000{n}", "title": f"Song {n}", "artist_name": "Band", "album_artist": None, "album_title": "Al & bum", "barcode": "1234567890123",
        "catalogue_no": "CAT 1", "label": None, "genre": "Jazz", "language": "en", "year": "1996", "sequence_no": n, "duration_sec": 61, "explicit": False, "pline_text": None, "cline_text": None,
        "release_date": "5/1/1996", "original_release_date": None, "composers": ["C"], "producers": [], "publishers": "P1, P2", "asset_number": None, "wav_filename": None,
        "resource_reference": None, "technical_resource": None, "audio_hash_md5": None, "image_asset_number": None, "audio": b"RIFF0000WAVE",
    }
    return row | change


@pytest.fixture(scope="module")
def rendered(spark):
    tracks = spark.createDataFrame([track(2, explicit=True, wav_filename="two.wav"), track(1, language=None, producers=["X", "Y"], publishers=None)], SCHEMA)
    plans = release.plan(tracks, "release", PARTIES, "2026-01-02")
    return release.render(plans, PARTIES, F.lit("12345678901234567"), F.lit("2026-01-02T03:04:05+00:00"), "2026-01-02", F.lit("F" * 32)).cache()


def test_plan(rendered):
    r = rendered.first()
    assert r["album"]["artist"] == "Band" and r["album"]["label"] == "House Label" and r["explicit"] and r["duration"] == "PT0H2M2S"
    assert r["album"]["pline_text"] == "(P) 1996 House Label" and r["album"]["release_date"] == "1996-05-01" and r["album"]["original_release_date"] == "1996-01-01"
    assert [t["asset"] for t in r["tracks"]] == ["CAT1_001", "CAT1_002"]
    assert [t["wav"] for t in r["tracks"]] == ["CAT1_001.wav", "two.wav"]
    assert r["tracks"][0]["md5"] == hashlib.md5(b"RIFF0000WAVE").hexdigest().upper()
    assert r["artwork"]["filename"] == "IMG_CAT_1.jpg"


def test_message(rendered):
    xml = rendered.first()["xml"]
    assert xml.startswith('<?xml version="1.0" encoding="UTF-8"?>\n<NewReleaseMessage ')
    root = ElementTree.fromstring(xml)
    assert [e.tag.split("}")[-1] for e in root] == ["MessageHeader", "UpdateIndicator", "ResourceList", "ReleaseList", "DealList"]
    recordings = root.findall("ResourceList/SoundRecording")
    assert [r.findtext("ResourceReference") for r in recordings] == ["ACAT1_001", "ACAT1_002"]
    assert recordings[0].find("LanguageOfPerformance") is None and recordings[1].findtext("LanguageOfPerformance") == "en"
    people = [e.findtext("PartyName/FullName") for e in recordings[1].iter("IndirectResourceContributor")]
    assert people == ["P1 [SOC]", "P2 [SOC]", "C"]
    assert [e.findtext("PartyName/FullName") for e in recordings[0].iter("IndirectResourceContributor")] == ["Copyright Control [SOC]", "C"]
    assert [e.get("SequenceNumber") for e in recordings[0].iter("ResourceContributor")] == ["1", "2"]
    main = root.find("ReleaseList/Release")
    assert main.get("IsMainRelease") == "true" and main.findtext("ReleaseId/ProprietaryId") == "Vnum1234567890123"
    assert main.findtext("ReleaseDetailsByTerritory/ReleaseDate") == "2026-01-02"
    assert [e.text for e in root.findall("DealList/ReleaseDeal/DealReleaseReference")] == ["R0", "R1", "R2"]
    assert "Al &amp; bum" in xml and "\n\n" not in xml


def test_message_reads_back(spark, rendered):
    got = messages.tracks(rendered.select("release", "xml"), "release").orderBy("ord").collect()
    assert [(r["title"], r["isrc"], r["track_number"], r["duration_sec"], r["artist_name"]) for r in got] == [("Song 1", "ZAABC9600001", 1, 61.0, "Band"), ("Song 2", "ZAABC9600002", 2, 61.0, "Band")]
    assert [r["explicit"] for r in got] == [False, True] and got[0]["barcode"] == "1234567890123" and got[0]["catalogue_no"] == "CAT 1"
    assert [r["audio_file"] for r in got] == ["cat1_001.wav", "two.wav"] and got[0]["album_title"] == "Al & bum"
    assert [c["name"] for c in got[0]["credits"]] == ["X", "Y"] and [c["name"] for c in got[1]["credits"]] == ["P1 [SOC]", "P2 [SOC]", "C"]
    assert messages.artwork(rendered.select("release", "xml"), "release").first()["artwork_file"] == "img_cat_1.jpg"


def test_newer_message(spark):
    xml = """<ern:NewReleaseMessage xmlns:ern="http://ddex.net/xml/ern/41"><ResourceList>
      <SoundRecording><ResourceReference>A1</ResourceReference><SoundRecordingId><ISRC>ZAABC9600001</ISRC></SoundRecordingId><Title TitleType="AlternativeTitle"><TitleText>Alt</TitleText><SubTitle>Live</SubTitle></Title>
        <Title><TitleText>Plain</TitleText></Title><Duration>PT3M</Duration><DisplayArtist><PartyName><FullName>First</FullName></PartyName><ArtistRole>Guest</ArtistRole></DisplayArtist>
        <DisplayArtist SequenceNumber="1"><PartyName><FullName>Second</FullName></PartyName><ArtistRole>Other</ArtistRole></DisplayArtist></SoundRecording>
      <SoundRecording><ResourceReference>A2</ResourceReference></SoundRecording></ResourceList>
      <ReleaseList><Release><ReleaseType>Single</ReleaseType><ReleaseResourceReferenceList><ReleaseResourceReference>A1</ReleaseResourceReference><ReleaseResourceReference>A1</ReleaseResourceReference></ReleaseResourceReferenceList></Release></ReleaseList></ern:NewReleaseMessage>"""
    got = messages.tracks(spark.createDataFrame([("m", xml)], "id string, xml string"), "id").collect()
    assert len(got) == 1
    assert (got[0]["title"], got[0]["version_title"], got[0]["artist_name"], got[0]["duration_sec"], got[0]["track_number"], got[0]["explicit"]) == ("Plain", "Live", "Second", 180.0, None, False)


def test_validation(spark):
    bad = track(3, isrc="bad", title="", duration_sec=0, language=None, year="12-6")
    tracks = spark.createDataFrame([track(1, barcode="12", release_date="soon"), track(2, isrc="ZAABC9600001", duration_sec=20), bad], SCHEMA)
    r = release.validate(tracks, "release").first()
    assert [m.split(" ")[0] for m in r["errors"]] == ["Release:", "Release:", *["Position"] * 5]
    assert len(r["warnings"]) == 2 and "lasts 20 s" in r["warnings"][0]


def test_files_and_sidecar(spark, rendered):
    assert [r["path"] for r in release.files(rendered, "release").orderBy("n").collect()] == ["resources/CAT1_001.wav", "resources/two.wav", "resources/IMG_CAT_1.jpg"]
    songs = spark.createDataFrame([("7", "Song", "o'band", "Al", "Jazz", 1996, None)], "record_id string, title string, artist string, album string, genre string, year int, p_line string")
    lines = release.sidecar(songs, "https://site", "the vault", "#Music").first()["text"].split("\n")
    assert lines[1] == "o'band – Song (1996)" and lines[12] == "#Music #Jazz #Oband" and lines[-1] == "o'band, Song, Jazz, 1996"


def _message(version, tracks, album=True, ref=lambda n: f"A{n}"):
    """A message with a recording a track, an album that names them in turn, and a release that names the first one again."""
    recordings = "".join(f"<SoundRecording><SoundRecordingId><ISRC>ZAABC{n:07d}</ISRC></SoundRecordingId><ResourceReference>{ref(n)}</ResourceReference><ReferenceTitle><TitleText>Song &amp; {n}</TitleText></ReferenceTitle>"
                         f"<DisplayArtist><PartyName><FullName>Artist {n}</FullName></PartyName></DisplayArtist><Duration>PT{n}M</Duration></SoundRecording>\n" for n in range(1, tracks + 1))
    refs = "".join(f"<ReleaseResourceReference>{ref(n)}</ReleaseResourceReference>" for n in range(tracks, 0, -1))
    whole = f"<Release IsMainRelease=\"true\"><ReleaseId><ICPN>60{tracks}</ICPN></ReleaseId><ReferenceTitle><TitleText>Album</TitleText></ReferenceTitle><ReleaseResourceReferenceList>{refs}</ReleaseResourceReferenceList>{'<ReleaseType>Album</ReleaseType>' if album else ''}</Release>"
    single = f"<Release><ReleaseResourceReferenceList><ReleaseResourceReference>{ref(1)}</ReleaseResourceReference></ReleaseResourceReferenceList><ReleaseType>TrackRelease</ReleaseType></Release>"
    return f'<ern:NewReleaseMessage xmlns:ern="http://x.example/ern/{version}"><ResourceList>{recordings}</ResourceList>\n<ReleaseList>{whole}{single}</ReleaseList></ern:NewReleaseMessage>'


@pytest.mark.parametrize("block", ["512b", "128m"])
def test_messages_in_files(spark, tmp_path, block):
    given = {"old": _message("382", 40), "untyped": _message("382", 3, album=False), "newer": _message("383", 7), "new": _message("41", 25, album=False), "none": _message("41", 0)}
    for name, xml in given.items():
        (tmp_path / f"{name}.xml").write_text(xml)
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        assert block != "512b" or messages.chunks(spark, str(tmp_path)).rdd.getNumPartitions() > 20
        got = messages.tracks_of_files(spark, str(tmp_path)).withColumn("path", F.regexp_extract("path", r"(\w+)\.xml", 1)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = messages.tracks(spark.createDataFrame(list(given.items()), "path string, xml string"), "path").collect()
    assert len(want) == 75 and sorted(map(str, got)) == sorted(map(str, want))


def test_recordings_count_at_their_first_release(spark):
    xml = _message("41", 4)
    got = messages.tracks(spark.createDataFrame([("m", xml)], "id string, xml string"), "id").orderBy("ord").collect()
    assert [(r["ord"], r["ref"], r["track_number"], r["album_title"]) for r in got] == [(n, f"A{5 - n}", n, "Album") for n in range(1, 5)]
