"""Where a record's audio is: resolving references, checking them against listings, matching tracks to files."""

from __future__ import annotations

import heapq
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discoforge.functions.text import blank, title_words
from discoforge.functions.values import bucket_and_key, mount_line
from discoforge.operators.cuts import in_order, linked, written
from discoforge.operators.similar import contained


def resolve(df: DataFrame, candidates: list[tuple[str, list[str]]], urls: list[str], anchor: str, buckets: list[str]) -> DataFrame:
    """P28, P37. df with audio: struct(ok, kind, bucket, key, path, url, filename, source, reason).

    candidates: (source name, columns) by priority. The first that gives a bucket and key, or holds a URL, wins;
    then the URL columns. reason tells records without any audio field from those that can't be read.
    """
    empty = lambda: {n: F.lit(None).cast("string") for n in ("kind", "bucket", "key", "path", "url", "filename", "source", "reason")}

    def struct(ok: bool, **known: Column) -> Column:
        return F.struct(F.lit(ok).alias("ok"), *[c.alias(n) for n, c in (empty() | known).items()])

    found, first_source, columns_in = [], [], df.columns
    for n, (source, columns) in enumerate(candidates):
        here = [F.col(c) for c in columns if c in df.columns]
        if not here:
            continue
        value = F.coalesce(*[F.nullif(c, F.lit("")) for c in here])
        # a column each, so that a long expression is worked out once and not at every use
        df = df.withColumn(f"_place{n}", F.coalesce(mount_line(value), value))
        df = df.withColumn(f"_at{n}", bucket_and_key(F.col(f"_place{n}"), anchor, buckets))
        at = F.col(f"_at{n}")
        url = F.nullif(F.regexp_extract(f"_place{n}", r"(https?://\S+)", 1), F.lit(""))
        found.append(F.when(at.isNotNull(), struct(True, kind=F.lit("store"), bucket=at["bucket"], key=at["key"], path=F.concat(F.lit("/"), at["bucket"], F.lit("/"), at["key"]), filename=F.substring_index(at["key"], "/", -1), source=F.lit(source))))
        found.append(F.when(url.isNotNull(), struct(True, kind=F.lit("url"), url=url, filename=F.substring_index(url, "/", -1), source=F.lit(source))))
        first_source.append(F.when(~blank(value), F.lit(source)))
    plain = [F.col(c) for c in urls if c in df.columns]
    if plain:
        url = F.trim(F.coalesce(*[F.nullif(c, F.lit("")) for c in plain]))
        found.append(F.when(url.rlike("(?i)^https?://"), struct(True, kind=F.lit("url"), url=url, filename=F.substring_index(url, "/", -1), source=F.lit("url field"))))
    any_source = F.coalesce(*first_source) if first_source else F.lit(None).cast("string")
    missing = struct(False, source=any_source, reason=F.when(any_source.isNotNull(), "unparseable-path").otherwise("no-audio-field"))
    # a generated column: what filters and joins ask of it later is not worked out again from the fields
    return df.select(*[F.col(c) for c in columns_in if c != "audio"], F.explode(F.array(F.coalesce(*found, missing))).alias("audio"))


def bucket_of(audio: str = "audio") -> Column:
    """A04. The audit bucket of a resolved record."""
    a = F.col(audio)
    return F.when(a["ok"] & (a["kind"] == "url"), "url").when(a["ok"], "resolved").otherwise(a["reason"])


def verified(df: DataFrame, files: DataFrame) -> DataFrame:
    """J21. df with exists: true or false by the listing, null for URLs, false if unresolved."""
    listed = files.select(F.col("path").alias("_path")).distinct().withColumn("_there", F.lit(True))
    out = df.join(listed.hint("merge"), F.col("audio.path") == F.col("_path"), "left")
    return out.withColumn("exists", F.when(~F.col("audio.ok"), F.lit(False)).when(F.col("audio.kind") == "store", F.coalesce("_there", F.lit(False)))).drop("_path", "_there")


def relocated(df: DataFrame, files: DataFrame, title: str) -> DataFrame:
    """J11. df with found_path: a file of the same folder whose title is the track's, or holds it or is held by it; the exact first, then by path.

    Within a folder titles meet by an index of their runs of letters, so large folders are no product.
    """
    folder = lambda c: F.regexp_replace(c, "/[^/]+$", "")
    listed = files.select(folder(F.col("path")).alias("block"), F.col("path"), title_words("name").alias("text")).where("text <> ''").groupBy("block", "text").agg(F.min("path").alias("path"))
    asked = df.withColumn("_want", title_words(title)).withColumn("_in", folder(F.col("audio.path")))
    wanted = asked.select(F.col("_in").alias("block"), F.col("_want").alias("text")).where("block is not null")
    met = _holding(wanted, listed).join(listed.select("block", F.col("text").alias("name"), "path").hint("merge"), ["block", "name"])
    best = met.groupBy("block", "want").agg(F.min(F.struct((F.col("name") != F.col("want")).alias("loose"), "path"))["path"].alias("found_path"))
    return asked.join(best.hint("merge"), (F.col("_in") == F.col("block")) & (F.col("_want") == F.col("want")), "left").select(*df.columns, "found_path")


def _holding(wanted: DataFrame, listed: DataFrame) -> DataFrame:
    """(block, want, name): texts of a block that are equal or of which one holds the other."""
    inside = contained(wanted, listed).select("block", F.col("part").alias("want"), F.col("whole").alias("name"))
    around = contained(listed, wanted).select("block", F.col("whole").alias("want"), F.col("part").alias("name"))
    return inside.union(around).distinct()


class _Shelf:
    """Files of one unit by title, first come first, and which titles of tracks may take which. Gives each track its file."""

    def __init__(self):
        self.fitting: dict[str, list[str]] = {}
        self.files: dict[str, deque] = {}
        self.heads: dict[str, list] = {}

    def step(self, kind, group, ord_, want, name):
        if kind == 0:
            self.fitting.setdefault(want, []).append(name)
        elif kind == 1:
            self.files.setdefault(name, deque()).append(ord_)
        elif (taken := self._take(want)) is not None:
            return [(group, ord_, taken)]
        return []

    def _take(self, want: str):
        if self.files.get(want):
            return self.files[want].popleft()
        if want not in self.heads:
            self.heads[want] = [(self.files[n][0], n) for n in self.fitting.get(want, ()) if self.files.get(n)]
            heapq.heapify(self.heads[want])
        heads = self.heads[want]
        while heads:
            first, name = heads[0]
            left = self.files[name]
            if not left:
                heapq.heappop(heads)
            elif left[0] != first:
                heapq.heapreplace(heads, (left[0], name))  # others took its first ones meanwhile
            else:
                return left.popleft()
        return None


def match_files(tracks: DataFrame, files: DataFrame) -> DataFrame:
    """J10. (group, track_ord, file_ord): tracks, in order, each take a file of their catalogue by title, exact or one holding the other.

    A file serves once, so the order decides. Titles that no chain of such pairs joins don't compete: each
    component of the pairs, found by an index of letters, is a unit whose files and tracks stream through one task, which
    remembers titles and numbers of files. Files without a name match none; rows without a group form one.
    tracks: group, ord, title. files: group, ord, name.
    """
    block = F.coalesce(F.concat(F.lit("="), "group"), F.lit("")).alias("block")
    t = tracks.select("group", block, "ord", title_words("title").alias("text"))
    f = files.select("group", block, "ord", title_words("name").alias("text"))
    pairs = written(_holding(t, f))  # asked several times
    of = lambda c: F.concat("block", F.lit("\0"), c)
    pairs = linked(pairs.withColumn("_t", of("want")).withColumn("_f", of("name")), ["_t", "_f"], "_unit")
    none = lambda kind: F.lit(None).cast(kind)
    rows = pairs.select("_unit", F.lit(0).alias("kind"), none("string").alias("group"), none("long").alias("ord"), "want", "name")
    units = lambda c: pairs.select(F.col(c).alias("_k"), "_unit").distinct()
    rows = rows.unionByName(f.withColumn("_k", of("text")).join(units("_f"), "_k").select("_unit", F.lit(1).alias("kind"), "group", F.col("ord").cast("long").alias("ord"), none("string").alias("want"), F.col("text").alias("name")))
    rows = rows.unionByName(t.withColumn("_k", of("text")).join(units("_t"), "_k").select("_unit", F.lit(2).alias("kind"), "group", F.col("ord").cast("long").alias("ord"), F.col("text").alias("want"), none("string").alias("name")))
    return in_order(rows, "_unit", ["kind", "ord", "want", "name"], lambda: _Shelf().step, ["kind", "group", "ord", "want", "name"], "group string, track_ord long, file_ord long")


def match_files_by_rank(tracks: DataFrame, files: DataFrame) -> DataFrame:
    """J10 for groups of any size, exact titles only: the n-th track of a title takes its n-th file."""
    nth = lambda df: df.withColumn("n", F.row_number().over(Window.partitionBy("group", "words").orderBy("ord")))
    t = nth(tracks.select("group", "ord", title_words("title").alias("words")).where("words <> ''")).withColumnRenamed("ord", "track_ord")
    f = nth(files.select("group", "ord", title_words("name").alias("words")).where("words <> ''")).withColumnRenamed("ord", "file_ord")
    return t.join(f, ["group", "words", "n"]).select("group", "track_ord", "file_ord")
