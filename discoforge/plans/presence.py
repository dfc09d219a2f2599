"""Which source holds which track: the presence matrix, exactly as tracks come in, and as one relational plan."""

from __future__ import annotations

import heapq
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from discoforge.functions.text import clean, filename_key, isrc_lookup, title_key
from discoforge.operators.cuts import in_order, linked, positions
from discoforge.operators.keys import fuzzy_matches
from discoforge.operators.rollups import first_value
from discoforge.operators.similar import Alike

THRESHOLD = 0.7
_ROW = ["isrc", "title", "artist", "sequence_no", "filename"]


def prepared(sources: dict[str, DataFrame]) -> DataFrame:
    """Rows of all sources with rank and source, and keys: code, file and title. Each gives group, isrc, title, artist, sequence_no, filename, record_id, ord."""
    rows = [df.select("group", *_ROW, "record_id", "ord", F.lit(n).alias("rank"), F.lit(name).alias("source")) for n, (name, df) in enumerate(sources.items())]
    out = reduce(DataFrame.unionByName, rows)
    return out.withColumns({"code": isrc_lookup("isrc"), "file": filename_key("filename"), "title_key": title_key("title"), "sequence_no": F.col("sequence_no").cast("long")})


class _Rows:
    """The matrix rows that tracks of one unit can join: what codes and file names point to, and titles by sequence number."""

    def __init__(self):
        self.by_code: dict[str, int] = {}
        self.by_file: dict[str, int] = {}
        self.known: dict[int, list] = {}  # sequence number and title key of each row, by the track that made it
        self.numbers: dict[int, Alike] = {}
        self.untitled: dict[int, list[int]] = {}  # heaps of rows, by sequence number

    def _file(self, row: int) -> None:
        seq, key, _ = self.known[row]
        if seq is not None:
            self.numbers.setdefault(seq, Alike(THRESHOLD)).add(key, row)
            if key == "":
                heapq.heappush(self.untitled.setdefault(seq, []), row)

    def _retitled(self, row: int, key: str) -> None:
        """A row without a title gets one: it goes from the empty key, which it may share, to its own."""
        seq, _, _ = self.known[row]
        self.known[row][1:] = [key, True]
        if seq is None or key == "":
            return
        alike, untitled = self.numbers[seq], self.untitled[seq]
        if alike.least[""] == row:
            while untitled and self.known[untitled[0]][1] != "":
                heapq.heappop(untitled)
            if untitled:
                alike.least[""] = untitled[0]
            else:
                alike.drop("")
        alike.add(key, row)

    def step(self, track, code, file, seq, title, key, sheet):
        row = self.by_code.get(code) if code else None
        if row is None and file and not sheet:
            row = self.by_file.get(file)
        if row is None and seq is not None and (title or sheet) and seq in self.numbers:
            row = self.numbers[seq].best(key)
        if row is None:
            row = track
            self.known[row] = [seq, key if title else "", bool(title)]
            self._file(row)
        else:
            if title and not self.known[row][2]:
                self._retitled(row, key)
            if self.known[row][0] is None and seq is not None:
                self.known[row][0] = seq
                self._file(row)
        if code:
            self.by_code[code] = row
        if file and not sheet:
            self.by_file[file] = row
        return [(track, row)]


def matrix(sources: dict[str, DataFrame], sheet: str | None = None) -> DataFrame:
    """J08, J09. The exact matrix of each group, a catalogue number: one row a track, with in_ and _id of each source.

    A track joins the row that its code points to, else its file name's, else the most similar title of the
    same sequence number; it then points both keys at that row, so a conflict never merges two rows. Blanks
    are filled by the first value, ids by the last. position sorts by sequence number, null as 999.
    sheet names the source that is matched by code and title only. Rows without a group form one.

    Tracks of a group that no code, file name or sequence number joins, over any others, never meet. So these
    components are the units, not the groups; a unit's tracks stream through one task in their order, which remembers
    pointers and titles of its rows only. What rows hold then is an aggregation, and places within a group are
    counted over ranges: a group may have any number of rows.
    """
    names = list(sources)
    rows = prepared(sources).withColumn("record_id", F.col("record_id").cast("string")).withColumn("sheet", F.col("source") == F.lit(sheet or ""))
    rows = positions(rows.withColumn("_g", F.coalesce(F.concat(F.lit("="), "group"), F.lit(""))), ["rank", "ord", "_g", "record_id"], "_track")
    key = lambda c, when=F.lit(True): F.when(when & (F.col(c).cast("string") != ""), F.concat("_g", F.lit("\0"), F.col(c).cast("string")))
    keyed = rows.withColumns({"_by_code": key("code"), "_by_file": key("file", ~F.col("sheet")), "_by_seq": key("sequence_no")})
    units = linked(keyed, ["_by_code", "_by_file", "_by_seq"], "_unit").where("_unit is not null")
    joined = in_order(units, "_unit", ["_track"], lambda: _Rows().step, ["_track", "code", "file", "sequence_no", "title", "title_key", "sheet"], "_track long, _row long")
    held = rows.join(joined, "_track", "left").withColumn("_row", F.coalesce("_row", "_track"))
    value = lambda c, name=None: first_value(F.col(c), ["_track"], F.col(c).cast("string") != "").alias(name or c)
    name_of_file = first_value(F.col("filename"), ["_track"], (F.col("filename") != "") & ~F.col("sheet")).alias("filename")
    out = held.groupBy("_g", "group", "_row").agg(
        value("code", "isrc"),
        *[value(c) for c in ("title", "artist", "sequence_no")],
        name_of_file,
        *[F.bool_or(F.col("source") == s).alias(f"in_{s}") for s in names],
        *[F.max(F.when(F.col("source") == s, F.struct("_track", "record_id")))["record_id"].alias(f"{s}_id") for s in names],
    )
    placed = positions(out, ["_g", F.coalesce("sequence_no", F.lit(999)), "_row"], "_place")
    first = placed.groupBy("_g").agg(F.min("_place").alias("_first"))
    placed = placed.join(first, "_g").withColumn("position", (F.col("_place") - F.col("_first") + 1).cast("int"))
    return placed.select("group", "isrc", "title", "artist", "sequence_no", "filename", *[f"in_{s}" for s in names], *[f"{s}_id" for s in names], "position")


def matrix_by_keys(sources: dict[str, DataFrame]) -> DataFrame:
    """J08 as one plan of joins and aggregations, for groups of any size.

    Rows with a code are keyed by it; rows without take the code that their file name has elsewhere in the
    group, else the file name; what is left joins, source by source, the most similar title of its sequence
    number so far, else is keyed by number and title. It differs from matrix() where a track's code and file name point to different
    rows, and where titles of one source are alike.
    """
    rows = prepared(sources)
    codes = rows.where("code is not null and file is not null").groupBy("group", "file").agg(first_value(F.col("code"), ["rank", "ord"]).alias("code_of_file"))
    rows = rows.join(codes, ["group", "file"], "left")
    rows = rows.withColumn("key", F.coalesce("code", "code_of_file", F.concat(F.lit("f:"), "file")))
    value = lambda c: first_value(F.col(c), ["rank", "ord"], clean(F.col(c).cast("string")).isNotNull()).alias(c)
    seen = rows.where("key is not null").groupBy("group", "key").agg(value("title"), value("sequence_no"), F.min(F.struct("rank", "ord")).alias("at"))
    every = rows.where("key is not null")
    own = F.concat(F.lit("seq:"), F.coalesce(F.col("sequence_no").cast("string"), F.lit("?")), F.lit(":"), "title_key")
    for rank in range(len(sources)):  # a source's rows without keys meet all keyed rows and those of the sources before
        loose = rows.where(F.col("key").isNull() & (F.col("rank") == rank))
        near = fuzzy_matches(loose.select("group", "sequence_no", "title", "rank", "ord"), seen, ["group", "sequence_no"], "title", "title", ["at"], THRESHOLD, large_blocks=False)
        near = near.select("group", "rank", "ord", F.col("r_key").alias("near_key"))
        loose = loose.join(near, ["group", "rank", "ord"], "left").withColumn("key", F.coalesce("near_key", own))
        every = every.unionByName(loose.drop("near_key"))
        fresh = loose.where("near_key is null").groupBy("group", "key").agg(value("title"), value("sequence_no"), F.min(F.struct("rank", "ord")).alias("at"))
        seen = seen.unionByName(fresh)
    names = list(sources)
    out = every.groupBy("group", "key").agg(
        F.max("code").alias("isrc"),
        *[value(c) for c in ("title", "artist", "sequence_no", "filename")],
        F.min(F.struct("rank", "ord")).alias("at"),
        *[F.bool_or(F.col("source") == s).alias(f"in_{s}") for s in names],
        *[F.max_by(F.when(F.col("source") == s, F.col("record_id")), F.when(F.col("source") == s, F.col("ord"))).alias(f"{s}_id") for s in names],
    )
    nth = F.row_number().over(Window.partitionBy("group").orderBy(F.coalesce("sequence_no", F.lit(999)), "at", "key"))
    return out.withColumn("position", nth).drop("at")


def counts(sources: dict[str, DataFrame]) -> DataFrame:
    """Rows of each source by group."""
    rows = reduce(DataFrame.unionByName, [df.select("group", F.lit(name).alias("source")) for name, df in sources.items()])
    return rows.groupBy("group").agg(*[F.count_if(F.col("source") == s).alias(s) for s in sources])
