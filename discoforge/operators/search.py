"""Finds, substring searches, paging and search over several sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discoforge.functions.text import blank, clean, isrc_lookup, search_key

from .cuts import positions
from .keys import distinct_in_order


def condition(column: str, wanted: str) -> Column:
    """P17. One field of a find: '==v' is exact, '*' any value that isn't blank, '*t*' holds t, 't*' starts with t; else exact. Case doesn't count."""
    have, w = F.lower(F.coalesce(F.col(column).cast("string"), F.lit(""))), wanted.lower()
    if w == "*":
        return ~blank(F.col(column))
    if w.startswith("=="):
        return have == w[2:]
    if w.startswith("*") and w.endswith("*"):
        return have.contains(w[1:-1])
    if w.endswith("*"):
        return have.startswith(w[:-1])
    return have == w


def find(df: DataFrame, queries: list[dict[str, str]]) -> DataFrame:
    """P16. Rows that meet all fields of any query. Fields that df lacks are left out, and queries without any left."""
    kept = [[condition(c, w) for c, w in q.items() if c in df.columns] for q in queries]
    kept = [reduce(lambda a, b: a & b, cs) for cs in kept if cs]
    return df.where(reduce(lambda a, b: a | b, kept)) if kept else df.limit(0)


def holds_any(df: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Q01-Q05. Rows of which any column holds the term, whatever the case; none for terms under two characters."""
    t = term.strip().lower()
    here = [c for c in columns if c in df.columns]
    if len(t) < 2 or not here:
        return df.limit(0)
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c).cast("string")).contains(t), F.lit(False)) for c in here]))


def holds_all_words(df: DataFrame, words: str, column: str) -> DataFrame:
    """Q07. Rows of which a column holds every word, whatever the case; all rows for no words."""
    return reduce(lambda out, w: out.where(F.lower(F.col(column)).contains(w)), words.lower().split(), df)


def page(df: DataFrame, order: list, limit: int | None = 50, offset: int | None = 0, most: int = 200) -> DataFrame:
    """Q02, Q10, O08. A page by order, with found_count, the number of all rows found. limit is at most `most`, offset at least 0."""
    limit, offset = min(limit or 50, most), max(offset or 0, 0)
    counted = df.agg(F.count("*").alias("found_count"))
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows.join(F.broadcast(counted))  # one row


def sorted_by(df: DataFrame, keys: list[tuple[str, str]], tie: list[str]) -> DataFrame:
    """O10. Rows by (column, 'ascend' or 'descend'), ties by the columns of tie."""
    return df.orderBy(*[F.col(c).desc() if way.lower().startswith("desc") else F.col(c).asc() for c, way in keys], *tie)


#: What a federated search backfills.
BACKFILLED = ("title", "artist", "album", "catalogue_no")


def federated(sources: dict[str, DataFrame]) -> DataFrame:
    """Q09. Songs found in several sources, one row a song, by number of sources, artist and title.

    Each source, in order of priority, gives isrc, title, artist, album, catalogue_no, sequence_no and ord.
    Songs meet by recording code, else by title and artist; a row without a code never meets one with it.
    Blanks are filled from the first source, then row, that has the value; sequence_no is the first row's.
    One aggregation, merged in parts before its shuffle.
    """
    rows = reduce(DataFrame.unionByName, [df.select("isrc", "title", "artist", "album", "catalogue_no", "sequence_no", "ord", F.lit(n).alias("rank"), F.lit(name).alias("source")) for n, (name, df) in enumerate(sources.items())])
    code = F.coalesce(isrc_lookup("isrc"), F.lit(""))
    rows = rows.withColumn("key", F.when(code != "", code).otherwise(F.concat(F.lit("t:"), search_key("title"), F.lit("|a:"), search_key("artist"))))
    first = F.struct("rank", "ord")
    value = lambda c: F.min(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("rank", "ord", c)))[c].alias(c)
    songs = rows.groupBy("key").agg(
        *[value(c) for c in BACKFILLED],
        F.max(F.when(code != "", code)).alias("isrc"),
        F.min(F.struct(first.alias("f"), F.col("sequence_no").alias("v")))["v"].alias("sequence_no"),
        F.transform(F.array_sort(F.collect_set(F.struct("rank", "source"))), lambda x: x["source"]).alias("sources"),
    )
    songs = songs.withColumn("n_sources", F.size("sources"))
    return positions(songs, [F.desc("n_sources"), F.lower(F.coalesce("artist", F.lit(""))), F.lower(F.coalesce("title", F.lit(""))), "key"])


def lookup_tracks(cache: DataFrame, catalogue: str) -> DataFrame:
    """P20. All rows of a catalogue number, by sequence. Equal but for case first; if none, of the first number that is equal without spaces, hyphens and underscores."""
    from discoforge.functions.text import catalogue_key, trimmed

    own = F.lower(trimmed("catalogue"))
    exact = cache.where(own == catalogue.strip().lower())
    if exact.isEmpty():
        wanted = catalogue_key(F.lit(catalogue))
        like = cache.where(catalogue_key("catalogue") == wanted)
        head = like.orderBy("ord").limit(1).select(own.alias("_c"))
        exact = like.join(F.broadcast(head), own == F.col("_c"), "left_semi")  # one row
    return exact.orderBy(F.coalesce("seq", F.lit(999)), "ord")


def artists(df: DataFrame, artist: str, track: str | None = None) -> DataFrame:
    """Q05. Rows of an artist, as track or album artist; with track, of that track too."""
    queries = [{c: f"*{artist}*"} for c in ("artist_name", "album_artist")]
    if track:
        queries = [q | {"title": f"*{track}*"} for q in queries]
    return find(df, queries)


def eligible(df: DataFrame) -> DataFrame:
    """Q06. df with flags: whether a row has audio, artwork and a code, and whether a video can be made of it."""
    url = lambda c: F.coalesce(clean(c).rlike("(?i)^https?://"), F.lit(False))
    out = df.withColumns({"has_audio": url("s3_url"), "has_artwork": url("artwork_url"), "has_isrc": ~blank("isrc")})
    return out.withColumn("eligible", F.col("has_audio") & F.col("has_artwork"))


def batch(songs: DataFrame, asked: DataFrame, key: str, order: list[str]) -> DataFrame:
    """W45. What to do with each asked song, once, in the order of asking: make its video, skip it or fail, with the reason."""
    wanted = distinct_in_order(asked, [key], order)
    met = wanted.join(eligible(songs).select(key, "eligible"), key, "left")
    state = F.when(F.col("eligible").isNull(), "failed").when(F.col("eligible"), "done").otherwise("skipped")
    reason = F.when(F.col("eligible").isNull(), "no such song").when(~F.col("eligible"), "no audio or artwork")
    return met.select(key, "at", state.alias("state"), reason.alias("reason"))
