import datetime
import io
import zipfile

from discoforge.plans import records
from discoforge.sources import files, sheets, tables
from discoforge.streaming import drain as draining

_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(sheet_list):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {_MAIN}><sheets>" + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheet_list)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheet_list))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {_MAIN}><si><t>Title</t></si><si><t>Artist</t></si></sst>")
        for i, (_, rows) in enumerate(sheet_list):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {_MAIN}><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


HEAD = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'


def test_workbook(spark, tmp_path):
    body = HEAD + '<row r="2"><c r="A2" t="inlineStr"><is><t>Song</t></is></c><c r="B2"><v>42</v></c></row><row r="3" hidden="1"><c r="A3" t="inlineStr"><is><t>Hid</t></is></c></row>'
    (tmp_path / "a.xlsx").write_bytes(workbook([("Empty", HEAD), ("First", HEAD + '<row r="2"><c r="A2"><v>1</v></c></row>'), ("Ingest", body)]))
    got = files.workbooks(spark, str(tmp_path), prefer="ingest").orderBy("ord").collect()
    assert [(r["hidden"], r["cells"]) for r in got] == [(False, {"Title": "Song", "Artist": "42"}), (True, {"Title": "Hid"})]
    out = sheets.track_sheet(files.as_sheet(files.workbooks(spark, str(tmp_path), prefer="ingest"))).collect()
    assert [(r["title"], r["artist_name"], r["errors"]) for r in out] == [("Song", "42", [])]
    assert files.workbooks(spark, str(tmp_path)).first()["cells"] == {"Title": "1"}


def test_track_sheet(spark):
    rows = [(0, "a", "b", "4/12", "0", "2024-01-15", "x", False), (1, "", "b", "1", "3", None, None, False), (2, "h", "h", None, "1", None, None, True)]
    sheet = spark.createDataFrame(rows, "ord long, `Track_Name` string, Artist string, `#` string, `Seq.` string, Year string, Odd string, hidden boolean")
    got = sheets.track_sheet(sheet).collect()
    assert [(r["ord"], r["track_number"], r["sequence_no"], r["year"], r["errors"], r["warnings"]) for r in got] == [
        (1, 1, 3, None, ["Line 3: no title"], ["Line 3: columns without a meaning: Odd"]),
        (0, 4, None, 2024, [], ["Line 2: columns without a meaning: Odd"]),
    ]


def test_metadata_sheet(spark):
    rows = [(0, "\tA ", None, "c1", "0", "x", None, "C1", " C2"), (1, None, None, None, "3", None, None, None, None), (2, None, "i", None, "7", "z", "full", "n", None)]
    sheet = spark.createDataFrame(rows, "ord long, `Album Title` string, isrc string, `Cat #` string, `#` string, Genre string, Composers string, Composer string, `Composer 2` string")
    got = sheets.metadata_sheet(sheet).orderBy("ord").collect()
    assert [(r["album_title"], r["isrc"], r["catalogue"], r["seq"], r["genre"], r["composer"]) for r in got] == [("A", None, "c1", None, "x", "C1; C2"), (None, "i", None, 7, "z", "full")]


def test_intake(spark):
    rows = [(0, "Jazz", datetime.datetime(2024, 5, 6), None), (1, None, None, None)]
    sheet = spark.createDataFrame(rows, "ord long, ` Genre ` string, `Release Date` timestamp, Gender string")
    out, ignored = sheets.intake_sheet(sheet, ["Album genre", "Track genre", "Release Date", "ISRC"])
    assert [tuple(r) for r in out.collect()] == [(0, "Jazz", "Jazz", "2024-05-06", None)] and ignored == ["Gender"]


def test_records(spark):
    fields = {"Song Title": " ", "Track Name": "T ", "Filename": "G1.wav", "Composer": "A", "Composer2": "a", "Composer 3": "B", "Producers": "P; Q", "Sequence Number": "07", "Duration": "04:10:00", "Explicit": "Yes", "Artwork URL": "http://h/i.jpg"}
    df = spark.createDataFrame([("1", None, fields, None)], tables.ENVELOPE)
    r = records.catalogue_tracks(df).first()
    assert (r["title"], r["asset_number"], r["composers"], r["producers"], r["sequence_no"], r["duration_sec"], r["explicit"], r["image_asset_number"]) == ("T ", "G1", ["A", "B"], ["P", "Q"], 7, 15000, True, "i")
    c = records.content_tracks(df).first()
    assert (c["duration_sec"], c["duration"], c["composers"], c["explicit"], c["sequence_no"]) == (250, "PT4M10S", ["A", "a", "B"], True, 7)
    assert tables.field_names(df)[:2] == ["Artwork URL", "Composer"] and tables.point(df, "1").count() == 1
    assert tables.fields(df, ["Explicit", "Gone"]).first()[1:] == ("Yes", None)


def test_listing_and_packages(spark, tmp_path):
    (tmp_path / "x" / "Sub").mkdir(parents=True)
    (tmp_path / "x" / "CYL 1054" ).mkdir()
    (tmp_path / "x" / "CYL 1054" / "a.wav").write_bytes(b"1")
    (tmp_path / "x" / "b.txt").write_bytes(b"22")
    found = files.listing(spark, str(tmp_path / "x"))
    assert sorted(r["name"] for r in found.collect()) == ["a.wav", "b.txt"]
    assert files.audio_files(found).count() == 1
    plain = found.withColumn("path", found["path"].substr(6, 500))
    assert [(r["name"], r["type"]) for r in files.folder_view(plain, str(tmp_path / "x")).collect()] == [("CYL%201054", "dir"), ("b.txt", "file")] or [(r["type"]) for r in files.folder_view(plain, str(tmp_path / "x")).collect()] == ["dir", "file"]
    assert files.files_of_catalogue(spark.createDataFrame([("/m/CYL 1054a/x.wav",)], "path string"), "cyl-1054").count() == 1
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("r/message.xml", "<a/>")
        z.writestr("r/resources/One.WAV", "12345")
    r = files.packages(spark, str(tmp_path / "p.zip")).first()
    assert bytes(r["xml"]) == b"<a/>" and r["files"] == {"message.xml": 4, "one.wav": 5}
    nfd = spark.createDataFrame([("Gé",), (None,)], "path string")
    assert [x["path"] for x in files.composed(nfd).collect()] == ["Gé", None]


def test_value_lists_and_loads(spark):
    df = spark.createDataFrame([("b",), (" A ",), ("",), (None,)], "g string")
    assert [r["g"] for r in tables.value_list(df, "g", ["z"]).collect()] == ["A", "b"]
    assert [r["g"] for r in tables.value_list(df.limit(0), "g", ["z"]).collect()] == ["z"]
    assert tables.load(spark, [lambda: 1 / 0, lambda: df]) is df
    assert tables.tagged(df, "g").count() == 2 and tables.tagged(df, "g", "A").count() == 1


def test_drain_takes_each_file_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.wav").write_bytes(b"abc")
    args = (spark, str(folder), str(tmp_path / "out"), str(tmp_path / "check"))
    assert draining.waiting(spark, str(folder)).count() == 1
    assert draining.drain(*args, clean=False) == 1
    (folder / "b.wav").write_bytes(b"de")
    draining.drain(*args, clean=False)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["name"], r["size"]) for r in rows) == [("a.wav", 3), ("b.wav", 2)]


def test_long_workbooks_stream(spark, monkeypatch):
    from discoforge.plans import queries_stored

    monkeypatch.setattr(files, "ROWS_AT_ONCE", 7)
    sheet = queries_stored._sheet([["A", "B"], *[[n, None if n % 3 else "x"] for n in range(50)]], {4})
    got = list(files.sheet_rows(queries_stored._workbook({"Empty": queries_stored._sheet([], set()), "One": sheet})))
    assert [(n, hidden, cells.get("A"), cells.get("B")) for n, hidden, cells in got] == [(n, n == 2, str(n), None if n % 3 else "x") for n in range(50)]
    books = spark.createDataFrame([("p", queries_stored._workbook({"One": sheet}))], "path string, content binary")
    assert files.workbooks_of(books).count() == 50


def test_workbooks_by_ranges(spark, tmp_path, monkeypatch):
    from discoforge.plans import queries_stored

    sheet = queries_stored._sheet([["A", "B"], *[[n, None if n % 3 else "x & <row y"] for n in range(300)]], {4})
    book = queries_stored._workbook({"Empty": queries_stored._sheet([["A"]], set()), "None": queries_stored._sheet([], set()), "One": sheet})
    folder = tmp_path / "a b"
    folder.mkdir()
    (folder / "one.xlsx").write_bytes(book)
    (folder / "two.xlsx").write_bytes(queries_stored._workbook({"Empty": queries_stored._sheet([["A"]], set())}))
    whole = list(files.sheet_rows(book))
    for size in (100, 997, 1 << 20):
        monkeypatch.setattr(files, "RANGE_BYTES", size)
        got = files.workbooks(spark, str(folder)).orderBy("ord").collect()
        assert [(r["ord"], r["hidden"], r["cells"]) for r in got] == whole
    for block in (1, 7, 64):
        texts = list(files._row_texts(io.BytesIO(sheet.encode()), block))
        assert b"".join(t for _, t in texts) == sheet.encode().removesuffix(b"</sheetData></worksheet>")
        assert len(texts) == 302 and all(sheet.encode()[at:].startswith(t) for at, t in texts[1:])


def test_shared_texts_by_ranges(spark, tmp_path, monkeypatch):
    rows = HEAD + "".join(f'<row r="{n}"><c r="A{n}" t="s"><v>{n % 2}</v></c></row>' for n in range(2, 40))
    (tmp_path / "a.xlsx").write_bytes(workbook([("One", rows)]))
    monkeypatch.setattr(files, "RANGE_BYTES", 150)
    got = files.workbooks(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r["ord"], r["cells"]["Title"]) for r in got] == [(n - 2, "Artist" if n % 2 else "Title") for n in range(2, 40)]


def test_archive_members(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (("d/", ""), ("x/A.wav", "1"), ("First.XML", "<a/>"), ("y/a.WAV", "123"), ("b.xml", "<b/>")):
            z.writestr(name, text)
    (tmp_path / "one.zip").write_bytes(out.getvalue())
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("only.wav", "12")
    got = {r["path"].rsplit("/", 1)[1]: (r["xml"] and bytes(r["xml"]), r["files"]) for r in files.packages(spark, str(tmp_path)).collect()}
    assert got == {"one.zip": (b"<a/>", {"a.wav": 3, "first.xml": 4, "b.xml": 4}), "two.zip": (None, {"only.wav": 2})}
    held = files.contents(files.members(spark, str(tmp_path)).where("lower(member) like '%.wav'")).orderBy("path", "nth").collect()
    assert [(r["member"], bytes(r["content"])) for r in held] == [("x/A.wav", b"1"), ("y/a.WAV", b"123"), ("only.wav", b"12")]
