"""File listings, workbooks and packages: Spark lists and reads the files, small helpers open each one in its task."""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discoforge.functions.text import AUDIO_FILE, basename


def listing(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """S15, S16, S18, S28. path, name, size and modified of the files under a folder. Contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder)
    return files.select("path", basename("path").alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def composed(files: DataFrame, column: str = "path") -> DataFrame:
    """S16. A column of names in composed form (NFC), which object stores use; Spark has no function for it."""

    @F.pandas_udf("string")
    def nfc(names: pd.Series) -> pd.Series:
        return names.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))

    return files.withColumn(column, nfc(column))


def folder_view(files: DataFrame, folder: str) -> DataFrame:
    """S17. What a folder holds directly: folders, then files, by name whatever its case."""
    inside = files.where(F.col("path").startswith(folder.rstrip("/") + "/")).withColumn("_rest", F.substring("path", len(folder.rstrip("/")) + 2, 1 << 20))
    entries = inside.select(F.substring_index("_rest", "/", 1).alias("name"), F.when(F.col("_rest").contains("/"), "dir").otherwise("file").alias("type"), F.when(~F.col("_rest").contains("/"), F.col("size")).alias("size"))
    return entries.groupBy("name", "type").agg(F.sum("size").alias("size")).orderBy("type", F.lower("name"), "name")


def audio_files(files: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """P25. Audio files by extension, of the subtrees in scope if given."""
    out = files.where(F.col("name").rlike(AUDIO_FILE))
    if scope:
        out = out.where(" or ".join(f"contains(path, '{s}')" for s in (x.replace("'", "''") for x in scope)))
    return out


def files_of_catalogue(files: DataFrame, catalogue: str) -> DataFrame:
    """P24. Files whose path holds a catalogue number, letters and digits only; none for an empty number."""
    token = re.sub("[^a-z0-9]+", "", catalogue.lower())
    return files.where(F.regexp_replace(F.lower("path"), "[^a-z0-9]+", "").contains(token)) if token else files.limit(0)


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _cells(row, strings: list[str] | dict[int, str]) -> dict[str, str]:
    out = {}
    for cell in row.iter(f"{_NS}c"):
        column = re.match("[A-Z]+", cell.get("r", "A"))[0]
        value = cell.find(f"{_NS}v")
        text = strings[int(value.text)] if cell.get("t") == "s" and value is not None else "".join(cell.itertext()) if cell.get("t") == "inlineStr" else None if value is None else value.text
        if text not in (None, ""):
            out[column] = text
    return out


def _streamed(book: zipfile.ZipFile, name: str, tag: str) -> Iterator:
    """The elements of a tag in a part of a workbook, one at a time: each is let go when the next is asked for."""
    with book.open(name) as part:
        above = []
        for event, element in ElementTree.iterparse(part, events=("start", "end")):
            if event == "start":
                above.append(element)
                continue
            above.pop()
            if element.tag == tag:
                yield element
                above[-1].clear()


def sheet_rows(content: bytes, prefer: str | None = None) -> Iterator[tuple[int, bool, dict[str, str]]]:
    """Rows (position, hidden, header to text) of a workbook's sheet: the preferred one if it has rows, else the first that has.

    Cells keep the text that the file stores: numbers of dates and times as numbers. Sheets are read row by row;
    only the shared texts are held.
    """
    book = zipfile.ZipFile(io.BytesIO(content))
    strings = []
    if "xl/sharedStrings.xml" in book.namelist():
        strings = ["".join(s.itertext()) for s in _streamed(book, "xl/sharedStrings.xml", f"{_NS}si")]
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = [(s.get("name"), targets[s.get(_REL)].lstrip("/")) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet")]
    sheets.sort(key=lambda s: s[0].lower() != (prefer or "").lower())  # stable: others keep their order
    for _, target in sheets:
        names, any_row = None, False
        for n, row in enumerate(_streamed(book, target if target.startswith("xl/") else f"xl/{target}", f"{_NS}row"), -1):
            cells = _cells(row, strings)
            if names is None:
                names = cells
            elif held := {names[c]: v for c, v in cells.items() if c in names}:
                any_row = True
                yield n, row.get("hidden") in ("1", "true"), held
        if any_row:
            return


#: Rows of a workbook that a task hands on at once.
ROWS_AT_ONCE = 10_000


def _located(path: str) -> tuple[fs.FileSystem, str]:
    local = re.sub("^file:/+", "/", path)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)


def opened(path: str):
    """A file that a task reads by pieces: local ones and those of stores that pyarrow knows."""
    system, inner = _located(path)
    return system.open_input_file(inner)


def written_files(files: DataFrame, folder: str) -> int:
    """Write each row's content under its name in a folder that all executors share; the number of files. A task that runs again writes the same files."""

    def of_rows(batches):
        system, inner = _located(folder)
        system.create_dir(inner, recursive=True)
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                with system.open_output_stream(f"{inner.rstrip('/')}/{name}") as out:
                    out.write(content)
            yield batch[["name"]]

    return files.select("name", "content").mapInPandas(of_rows, "name string").count()


#: Text of a worksheet, unpacked, that one task parses.
RANGE_BYTES = 16 << 20
_ROW = re.compile(rb"<(?:\w+:)?row(?=[\s/>])")
_SHEET = re.compile(rb"<((?:\w+:)?worksheet)\b[^>]*>")
_ROWS_END = re.compile(rb"</(?:\w+:)?sheetData\s*>")


def _row_texts(part, block_bytes: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Place and text of each row of a worksheet that is read by blocks; what stands before the rows comes first, at -1."""
    held, at, headed = b"", 0, False
    while block := part.read(block_bytes):
        held += block
        starts = [m.start() for m in _ROW.finditer(held)]
        if starts and not headed:
            headed = True
            yield -1, held[: starts[0]]
        for start, end in zip(starts, starts[1:]):
            yield at + start, held[start:end]
        if starts:
            held, at = held[starts[-1] :], at + starts[-1]
    if headed:
        end = _ROWS_END.search(held)
        yield at, held[: end.start()] if end else held


def _parsed_rows(root: bytes, texts: list[bytes]) -> Iterator:
    """The row elements of some rows' texts, under the names that the worksheet's first tag declares."""
    name = _SHEET.match(root)[1]
    return ElementTree.fromstring(root + b"".join(texts) + b"</" + name + b">").iter(f"{_NS}row")


def _indexes(rows: list) -> set[int]:
    """Numbers of the shared texts that rows name."""
    return {int(c.find(f"{_NS}v").text) for r in rows for c in r.iter(f"{_NS}c") if c.get("t") == "s" and c.find(f"{_NS}v") is not None}


def _shared(book: zipfile.ZipFile, wanted: set[int]) -> dict[int, str]:
    """The shared texts of some numbers; the others are passed by."""
    if not wanted or "xl/sharedStrings.xml" not in book.namelist():
        return {}
    return {n: "".join(s.itertext()) for n, s in enumerate(_streamed(book, "xl/sharedStrings.xml", f"{_NS}si")) if n in wanted}


def _chosen_sheet(book: zipfile.ZipFile, prefer: str | None) -> tuple[str, bytes, dict[str, str]] | None:
    """Part, first tag and headers (column to name) of the sheet to read; rows are looked at up to the first that holds something."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    listed = [(s.get("name"), targets[s.get(_REL)].lstrip("/")) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet")]
    listed.sort(key=lambda s: s[0].lower() != (prefer or "").lower())
    for _, target in listed:
        part = target if target.startswith("xl/") else f"xl/{target}"
        with book.open(part) as sheet:
            root, names = b"", None
            for at, text in _row_texts(sheet):
                if at < 0:
                    root = _SHEET.search(text)[0]
                    continue
                rows = list(_parsed_rows(root, [text]))
                cells = _cells(rows[0], _shared(book, _indexes(rows)))
                if names is None:
                    names = cells
                elif any(c in names for c in cells):
                    return part, root, names
    return None


_RANGES = "path string, part string, root binary, names map<string,string>, at long, until long"


def _ranges_of_books(prefer: str | None):
    def of_files(batches):
        for batch in batches:
            out = []
            for path in batch["path"]:
                with opened(path) as file, zipfile.ZipFile(file) as book:
                    if sheet := _chosen_sheet(book, prefer):
                        size = book.getinfo(sheet[0]).file_size
                        out += [(path, *sheet, at, at + RANGE_BYTES) for at in range(0, size, RANGE_BYTES)]
            yield pd.DataFrame(out, columns=["path", "part", "root", "names", "at", "until"])

    return of_files


def _rows_of_ranges(batches):
    for batch in batches:
        for r in batch.itertuples(index=False):
            names = dict(r.names)
            with opened(r.path) as file, zipfile.ZipFile(file) as book:
                texts, before = [], 0
                with book.open(r.part) as sheet:
                    for place, text in _row_texts(sheet):
                        if place >= r.until:
                            break
                        if place >= r.at:
                            texts.append(text)
                        elif place >= 0:
                            before += 1
                rows = list(_parsed_rows(r.root, texts))
                strings = _shared(book, _indexes(rows))
                out = []
                for n, row in enumerate(rows, before - 1):  # the headers' row is -1
                    cells = _cells(row, strings) if n >= 0 else {}
                    if held := {names[c]: v for c, v in cells.items() if c in names}:
                        out.append((r.path, n, row.get("hidden") in ("1", "true"), held))
            yield pd.DataFrame(out, columns=["path", "ord", "hidden", "cells"])


def _spread(df: DataFrame, *by: str) -> DataFrame:
    """df over all shuffle partitions by a hash of some columns."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def workbooks(spark: SparkSession, path: str, prefer: str | None = None) -> DataFrame:
    """S01, S02, S05. path, ord, hidden and cells (header to text) of the rows of workbooks in a folder.

    One task opens a workbook to choose its sheet (the preferred one if it has rows, else the first that has) and
    reads its headers. Then the sheet's text is cut into ranges of RANGE_BYTES and each range is a row of its own:
    its task unpacks the text before it, but parses its own rows only, and keeps only the shared texts that these name.
    A row belongs to the range that it begins in. Files are read by pieces. Worksheets are taken to be in UTF-8.
    A workbook without rows gives none.
    """
    ranges = _spread(listing(spark, path).select("path"), "path").mapInPandas(_ranges_of_books(prefer), _RANGES)
    return _spread(ranges, "path", "at").mapInPandas(_rows_of_ranges, "path string, ord long, hidden boolean, cells map<string,string>")


def workbooks_of(books: DataFrame, prefer: str | None = None) -> DataFrame:
    """S01, S02. The same of workbooks that lie in a table, as path and content. One task opens each and streams its rows."""

    def of_files(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows = ((name, n, hidden, cells) for n, hidden, cells in sheet_rows(content, prefer))
                while some := list(islice(rows, ROWS_AT_ONCE)):
                    yield pd.DataFrame(some, columns=["path", "ord", "hidden", "cells"])

    return books.select("path", "content").mapInPandas(of_files, "path string, ord long, hidden boolean, cells map<string,string>")


def as_sheet(rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Workbook rows with a column for each header; headers are looked up if not given, a few dozen a workbook."""
    if names is None:
        names = sorted(r[0] for r in rows.select(F.explode(F.map_keys("cells"))).distinct().collect())
    return rows.select("ord", "hidden", *[F.try_element_at("cells", F.lit(n)).alias(n) for n in names])


def members(spark: SparkSession, path: str) -> DataFrame:
    """S19. path, nth, member and size of what archives in a folder hold, without directories: only their lists are read."""

    def of_files(batches):
        for batch in batches:
            out = []
            for name in batch["path"]:
                with opened(name) as file, zipfile.ZipFile(file) as archive:
                    out += [(name, n, e.filename, e.file_size) for n, e in enumerate(archive.infolist()) if not e.is_dir()]
            yield pd.DataFrame(out, columns=["path", "nth", "member", "size"])

    return _spread(listing(spark, path).select("path"), "path").mapInPandas(of_files, "path string, nth int, member string, size long")


def contents(listed: DataFrame) -> DataFrame:
    """S19. The listed members of archives with their content. A member is a row of its own; its task reads the archive's list and that member's bytes."""

    def of_members(batches):
        for batch in batches:
            for path, nth, member, size in batch[["path", "nth", "member", "size"]].itertuples(index=False):
                with opened(path) as file, zipfile.ZipFile(file) as archive:
                    yield pd.DataFrame({"path": [path], "nth": [nth], "member": [member], "size": [size], "content": [archive.read(archive.infolist()[nth])]})

    spread = _spread(listed.select("path", "nth", "member", "size"), "path", "nth")
    return spread.mapInPandas(of_members, "path string, nth int, member string, size long, content binary")


def packages(spark: SparkSession, path: str) -> DataFrame:
    """S19, J13. path, xml (bytes of the first .xml) and files (lower-case base name to size) of release archives in a folder.

    Only the archives' lists and the messages are read. Of two members of one base name the later counts.
    """
    every = members(spark, path)
    named = every.withColumn("_name", F.lower(F.substring_index("member", "/", -1)))
    sizes = named.groupBy("path", "_name").agg(F.max_by("size", "nth").alias("size"))
    files = sizes.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("_name", "size"))).alias("files"))
    is_message = F.lower("member").endswith(".xml")
    first = every.where(is_message).groupBy("path").agg(F.min(F.struct("nth", "member", "size")).alias("m")).select("path", "m.*")
    found = listing(spark, path).select("path").join(files, "path", "left").join(contents(first).select("path", F.col("content").alias("xml")), "path", "left")
    return found.select("path", "xml", F.coalesce("files", F.create_map().cast("map<string,bigint>")).alias("files"))


def packages_of(archives: DataFrame) -> DataFrame:
    """S19, J13. The same of archives that lie in a table, as path and content; each is opened by one task."""

    def of_files(batches):
        for batch in batches:
            out = []
            for name, content in zip(batch["path"], batch["content"]):
                archive = zipfile.ZipFile(io.BytesIO(content))
                entries = [e for e in archive.infolist() if not e.is_dir()]
                message = next((e for e in entries if e.filename.lower().endswith(".xml")), None)
                out.append((name, archive.read(message) if message else None, {e.filename.rsplit("/", 1)[-1].lower(): e.file_size for e in entries}))
            yield pd.DataFrame(out, columns=["path", "xml", "files"])

    return archives.select("path", "content").mapInPandas(of_files, "path string, xml binary, files map<string,bigint>")
