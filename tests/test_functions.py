import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from discoforge.functions import languages, text, values


def one(spark, expression, kind="string", value=None):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(expression("v").alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("function", "value", "wanted"),
    [
        (text.clean, "\t a b  ", "a b"),
        (text.clean, "   ", None),
        (text.clean, None, None),
        (text.isrc_key, " za-abc 96 00001 ", "ZA-ABC9600001"),
        (text.catalogue_key, "AB-12_3 4", "ab1234"),
        (text.loose_key, "AB/12.a", "ab12a"),
        (text.catalogue_key, "AB/12.a", "ab/12.a"),
        (text.title_key, "Café del Mar!", "cafdelmar"),
        (text.title_words, "Café (Radio Edit).wav", "cafe radio edit"),
        (text.title_words, "Café.WAV", "cafe"),
        (text.search_key, "  A   B ", "a b"),
        (text.basename, "C:\\x\\y/z.wav", "z.wav"),
        (text.title_of_filename, "Artist_My Song_CAT1.wav", "My Song"),
        (text.title_of_filename, "Artist_Song.mp3", "Song"),
        (text.title_of_filename, "Song.mp3", "Song"),
        (text.path_part, "Sipho's Band (live)", "Siphos_Band_live"),
        (text.path_part, None, "Unknown"),
        (text.folder_part, ' a<b>: "c" . ', "ab c"),
        (text.slug, "--My  Show!--", "my-show"),
        (text.slug, "!!!", "show"),
        (text.hashtag, "miriam o'makeba", "#MiriamOmakeba"),
        (text.xml_escape, "<a & 'b'>", "&lt;a &amp; &apos;b&apos;&gt;"),
        (values.leading_int, " 4/12", 4),
        (values.leading_int, "x4", None),
        (values.leading_int, "12abc", 12),
        (values.nonzero_int, "0", None),
        (values.leading_float, "1.5kg", 1.5),
        (values.seconds, "270", 270),
        (values.seconds, "PT4M30S", 270),
        (values.seconds, "04:30", 270),
        (values.seconds, "00:04:30.900", 271),
        (values.seconds, "abc", None),
        (values.seconds, "04:10:00", 15000),
        (values.seconds_of_time_field, "04:10:00", 250),
        (values.seconds_of_time_field, "01:00:00", 3600),
        (values.seconds_of_time_field, "00:04:30", 270),
        (values.sheet_seconds, "3:45", 225.0),
        (values.sheet_seconds, "1:02:03", 3723.0),
        (values.sheet_seconds, "0", None),
        (values.iso_seconds, "PT1M0.5S", 60.5),
        (values.iso_seconds, "PT0S", None),
        (values.iso_date, "2007-5-1", "2007-05-01"),
        (values.iso_date, "5/21/2007", "2007-05-21"),
        (values.iso_date, "2007-21-05", "2007-21-05"),
        (values.iso_date, "21.5.2007", None),
        (values.year, "15 March 1996", 1996),
        (values.sheet_value, "46169", "2026-05-27"),
        (values.yes, " Cleared ", True),
        (values.yes, "no", False),
        (values.number_in_container, "movie:07 Song.wav\rmoviemac:/x", 7),
        (values.number_in_container, "http://h/a/12_x.wav?y=1", 12),
        (values.mount_line, "movie:a.wav\n moviemac:/V/a.wav \nmoviemac:/W", "/V/a.wav"),
        (values.slash_date, "2024-05-06", "05/06/2024"),
        (values.slash_date, "soon", ""),
        (values.is_reference, "movie:x", True),
        (values.is_reference, "Untitled", False),
        (languages.language_code, " isiZulu ", "zu"),
        (languages.language_code, "nso", "nso"),
        (languages.language_code, "Klingon", None),
    ],
)
def test_one_value(spark, function, value, wanted):
    assert one(spark, function, value=value) == wanted


def test_durations_keep_long_hours(spark):
    df = spark.createDataFrame([(0,), (59,), (3600,), (360_000,)], "s long")
    got = df.select(values.clock("s").alias("c"), values.short_iso("s").alias("i"), values.full_iso("s").alias("f")).collect()
    assert [tuple(r) for r in got] == [("00:00:00", "PT0S", "PT0H0M0S"), ("00:00:59", "PT59S", "PT0H0M59S"), ("01:00:00", "PT1H", "PT1H0M0S"), ("100:00:00", "PT100H", "PT100H0M0S")]


def test_names(spark):
    df = spark.createDataFrame([("A", "a ", None, "B;A, C|A")], "`Composer` string, `Composer 2` string, `Composer 3` string, names string")
    r = df.select(text.numbered_names(df.columns, "Composer").alias("n"), text.split_names("names").alias("s"), text.joined(text.split_names("names")).alias("j"), text.joined(F.array().cast("array<string>")).alias("none")).first()
    assert (r["n"], r["s"], r["j"], r["none"]) == (["A"], ["B", "A", "C"], "B; A; C", None)


def test_file_names_need_three_parts(spark):
    df = spark.createDataFrame([("198704266508_011_011.wav",), ("1_2.wav",), ("a/b_c_d_7.WAV",), ("x_y_z.wav",), (None,)], "f string")
    got = [r["b"] for r in df.select(values.barcode_and_number("f").alias("b")).collect()]
    assert [g and tuple(g) for g in got] == [("198704266508", 11), None, ("b_c", 7), None, None]


def test_bytes(spark):
    wave = bytes.fromhex("524946460000000057415645")
    df = spark.createDataFrame([(wave,), (b"\xff\xfb\x90",), (b"ID3",), (b"fLaC",), (b"FORM",), (b"",), ("é".encode("utf-16"),)], "b binary")
    assert [r["f"] for r in df.select(values.audio_format("b").alias("f")).collect()] == ["wav", "mp3", "mp3", "flac", "aiff", "unknown", "mp3"]
    assert [r["w"] for r in df.select(values.is_wave("b").alias("w")).collect()][:2] == [True, False]
    marked = spark.createDataFrame([("﻿é".encode(),), ("é".encode("utf-16"),), (b"\xfe\xff" + "é".encode("utf-16-be"),)], "b binary")
    assert [r["t"] for r in marked.select(values.decoded("b").alias("t")).collect()] == ["é"] * 3


def test_places(spark):
    df = spark.createDataFrame([("/V/Mount/wavs/a b/c.wav",), ("/x/wavs/c.wav",), ("/x/wavs",), (None,)], "p string")
    got = [r["b"] for r in df.select(values.bucket_and_key("p", "Mount/", ["wavs"]).alias("b")).collect()]
    assert [g and tuple(g) for g in got] == [("wavs", "a b/c.wav"), ("wavs", "c.wav"), None, None]
    urls = spark.createDataFrame([("https://buck.s3.host/a%20b.mp3",), ("https://s3.host/buck/c.mp3",), ("https://other/x",), ("not a url",)], "u string")
    assert [r["k"] for r in urls.select(values.key_of_url("u", "buck").alias("k")).collect()] == ["a b.mp3", "c.mp3", None, None]


def test_flags_and_partner_lines(spark):
    df = spark.createDataFrame([("Clean", "Yes"), (None, "Explicit"), ("Explicit", None), (None, None)], "p string, e string")
    got = df.select(values.explicit_flag("p", "e").alias("a"), values.explicit_flag_either("p", "e").alias("b")).collect()
    assert [tuple(r) for r in got] == [(True, True), (True, False), (True, True), (False, False)]
    rows = spark.createDataFrame([("xyz_1", "Bird", None, "c"), ("abc", "Bird", None, None)], "c string, l string, p string, k string")
    got = [tuple(r["r"]) for r in rows.select(values.partner_lines("c", "l", "p", "k", "XYZ_", "Owner", "XYZ", 2024).alias("r")).collect()]
    assert got == [("Owner", "℗ 2024 Bird under exclusive license to XYZ", "c"), ("Bird", None, None)]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text("abcé ", max_size=12), st.text("abcé ", max_size=12)), min_size=1, max_size=20))
def test_similarity_is_symmetric_and_bounded(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select(text.similarity("a", "b").alias("x"), text.similarity("b", "a").alias("y"), text.may_reach("a", "b").alias("m")).collect():
        assert r["x"] == r["y"] and 0 <= r["x"] <= 1
        assert r["m"] or r["x"] < 0.7


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 80_000), min_size=1, max_size=30))
def test_seconds_survive_their_forms(spark, numbers):
    df = spark.createDataFrame([(n,) for n in numbers], "s long")
    got = df.select("s", values.seconds(values.clock("s")).alias("a"), values.seconds(values.full_iso("s")).alias("b"), values.seconds(values.short_iso("s")).alias("c")).collect()
    assert all(r["s"] == r["a"] == r["b"] == r["c"] for r in got)
