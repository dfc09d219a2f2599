"""Rollups, audit buckets, systematic samples and the orders of listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discoforge.functions.text import clean, trimmed
from discoforge.functions.values import number_in_container

from .cuts import positions


def first_value(value: Column, order: list, when: Column | None = None) -> Column:
    """Aggregate: value of the first row by order, of those that meet a condition. Partial minima, no sort."""
    at = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order], value.alias("v"))
    return F.min(at if when is None else F.when(when, at))["v"]


def artist_rollup(songs: DataFrame, order: list[str]) -> DataFrame:
    """A01. By artist: songs, distinct albums, least and greatest id, title and URL of the first song with a URL; most songs first.

    The ids themselves are rows of artist_record_ids: an artist may have any number of them.
    """
    has_url = ~F.coalesce(F.col("url"), F.lit("")).isin("")
    out = songs.groupBy("artist").agg(
        F.count("*").alias("songs"),
        F.count_distinct(F.when(F.coalesce(F.col("album"), F.lit("")) != "", F.col("album"))).alias("albums"),
        first_value(F.struct("title", "url"), order, has_url).alias("sample"),
        F.min("record_id").alias("first_id"),
        F.max("record_id").alias("last_id"),
    )
    return out.orderBy(F.desc("songs"), "artist")


def artist_record_ids(songs: DataFrame, order: list[str]) -> DataFrame:
    """A01. (artist, record_id) of every song, by artist and then in order; ranges of the sort split an artist of any size."""
    return songs.orderBy("artist", *order, "record_id").select("artist", "record_id")


def tag_counts(df: DataFrame, tag: str) -> DataFrame:
    """A02. Rows by trimmed tag, blank ones left out, in order whatever the case."""
    return df.select(clean(tag).alias("tag")).where("tag is not null").groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.lower("tag"), "tag")


def show_rollup(episodes: DataFrame, order: list[str]) -> DataFrame:
    """A03. By show title whatever its case: attributes of its first row, episodes, highest number."""
    key = F.lower(trimmed("show_title"))
    attributes = ["show_title", "host", "artwork", "category", "language"]
    head = first_value(F.struct(*[trimmed(F.coalesce(c, F.lit(""))).alias(c) for c in attributes]), order)
    out = episodes.where(clean("show_title").isNotNull()).groupBy(key.alias("show_key")).agg(head.alias("h"), F.count("*").alias("episode_count"), F.max(F.coalesce("episode_number", F.lit(0))).alias("max_episode_number"))
    return out.select("show_key", "h.*", "episode_count", "max_episode_number")


def next_episode(episodes: DataFrame) -> DataFrame:
    """A16. By show: the highest episode number and one more."""
    return episodes.groupBy(F.lower(trimmed("show_title")).alias("show_key")).agg((F.coalesce(F.max("episode_number"), F.lit(0)) + 1).alias("next_episode"))


def audit(df: DataFrame, bucket: Column) -> DataFrame:
    """A04. Rows of each bucket and their percent of all, to one decimal."""
    counted = df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(F.lit(1)))  # over buckets, not rows
    return counted.withColumn("pct", F.round(100 * F.col("n") / whole, 1))


def systematic_sample(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """A14. Every n-th row by order, n = max(1, rows / k)."""
    step = max(1, df.count() // k)
    return positions(df, order, "_at").where((F.col("_at") - 1) % step == 0).drop("_at")


def album_totals(tracks: DataFrame, album: str, duration: str, explicit: str) -> DataFrame:
    """A05, A06. By album: the sum of its durations, null as none, and whether any track is explicit."""
    return tracks.groupBy(album).agg(F.sum(F.coalesce(duration, F.lit(0)).cast("bigint")).alias("seconds"), F.bool_or(F.coalesce(explicit, F.lit(False))).alias("explicit"))


def status(df: DataFrame, counted: list[str]) -> DataFrame:
    """A13. One row: rows of a table, and how many have each of some columns."""
    return df.agg(F.count("*").alias("rows"), *[F.count_if(clean(F.col(c).cast("string")).isNotNull()).alias(f"with_{c}") for c in counted])


def problem_report(df: DataFrame, bucket: Column, names: dict[str, str]) -> DataFrame:
    """W24. The rows that go into a report, with the sheet that each belongs on; buckets without a sheet are left out.

    A sheet is a value of the column, so writing by partitions of it gives one folder a sheet.
    """
    sheet = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return df.select("*", F.explode(F.array_compact(F.array(F.try_element_at(sheet, bucket)))).alias("sheet"))


def tallies(results: DataFrame, action: str = "action") -> DataFrame:
    """A07. One row: results by action, succeeded and failed."""
    ok = F.col("ok")
    return results.agg(F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), *[F.count_if(F.col(action) == a).alias(a) for a in ("updated", "created", "skipped")])


def merged_values(base: DataFrame, extra: DataFrame, column: str) -> DataFrame:
    """A12. Values of two lists, the first spelling of each whatever its case, in order; base goes first."""
    rows = base.select(F.lit(0).alias("side"), F.col(column)).union(extra.select(F.lit(1), F.col(column)))
    return rows.groupBy(F.lower(trimmed(column)).alias("key")).agg(F.min(F.struct("side", column))[column].alias(column)).select(column).orderBy(F.lower(column), column)


def by_sequence(seq: Column | str, missing: int | None = 999) -> Column:
    """O01, O02. Sort key of a sequence number; null counts as missing, or as last for None."""
    c = F.col(seq) if isinstance(seq, str) else seq
    return F.coalesce(c, F.lit(missing)) if missing is not None else c.asc_nulls_last()


def by_number_in_name(name: str, missing: int = 999) -> Column:
    """O06. Sort key of the track number in a container's file name; none counts as missing."""
    return F.coalesce(number_in_container(name), F.lit(missing).cast("bigint"))


def listing_order(album: str, seq: str, title: str | None = None, locale: bool = False) -> list[Column]:
    """O03, O04, O05. Album whatever its case, sequence with null last, title; locale sorts texts as people do, accents by their letters."""
    text = lambda c: F.collate(F.coalesce(F.col(c), F.lit("")), "UNICODE_CI") if locale else F.lower(F.coalesce(F.col(c), F.lit("")))
    return [text(album), F.col(seq).asc_nulls_last(), *([text(title)] if title else [])]


def latest(df: DataFrame, at: str, n: int = 200) -> DataFrame:
    """O07, O09. The n latest rows: a top-k, each task keeps n."""
    return df.orderBy(F.desc(at)).limit(n)
