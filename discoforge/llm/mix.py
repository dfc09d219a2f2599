"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, stash

#: Words of a block; a source's taken words differ from its target by about one block.
BLOCK_WORDS = 16
#: A source is cut into shards of about so many words; only a shard's documents are put in order together.
SHARD_WORDS = 1 << 20
WEIGHTS = (5, 2, 1)
#: No document is taken more often than this, and so no source either.
MOST_REPEATS = 3


def word_count(text):
    """Column: the number of words of a text; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACE), "")), F.lit(0)).cast("long")


def sainte_lague(parties: DataFrame, group: list[str], votes: str, seats: str, order: list[str]) -> DataFrame:
    """parties with quota long: each group's seats go to the highest quotients votes / 1, / 3, / 5 ...

    A group's parties share its number of seats. All seats but about two a party are certain from the totals, so
    only those few quotients become rows and are ranked, ties by the columns of order. Parties without votes get
    nothing; the quotas of a group with any votes sum to its seats.
    """
    whole = Window.partitionBy(*group)
    v, b = F.col(votes).cast("double"), F.col(seats)
    n = F.count("*").over(whole)
    total = F.sum(v).over(whole)
    known = parties.withColumn("_high", F.when(2 * b > n, total / F.nullif(2 * b - n, F.lit(0)))).withColumn("_low", total / F.nullif(2 * b + n, F.lit(0)))
    by = lambda quotient: F.floor((v / F.nullif(F.col(quotient), F.lit(0.0)) + 1) / 2)  # noqa: E731  quotients of at least that
    known = known.withColumn("_sure", F.greatest(F.lit(0), F.coalesce(by("_high") - 1, F.lit(0)))).withColumn("_most", F.when((v > 0) & (b > 0), by("_low") + 1).otherwise(0))
    known = known.withColumn("_left", b - F.sum("_sure").over(whole))
    open_ = known.select("*", F.explode_outer(F.when(F.col("_most") > F.col("_sure"), F.sequence(F.col("_sure") + 1, "_most"))).alias("_k"))
    rank = F.row_number().over(whole.orderBy(F.desc_nulls_last(v / (2 * F.col("_k") - 1)), *[F.asc_nulls_last(c) for c in order], "_k"))
    won = F.when(F.col("_k").isNotNull() & (rank <= F.col("_left")), 1).otherwise(0)
    kept = [c for c in parties.columns]
    return open_.withColumn("_won", won).groupBy(*kept, "_sure").agg(F.sum("_won").alias("_won")).select(*kept, (F.col("_sure") + F.col("_won")).cast("long").alias("quota"))


def targets(sources: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size) with target: the share of all words by weight, at most MOST_REPEATS times the source.

    Filled like water: sources in order of cap per weight; the first that its level doesn't fill, and all after
    it, get that level times their weight. One row a source, so one ordered pass over sources is small.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    out = sources.withColumn("_nth", F.row_number().over(by_name))
    out = out.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_nth") - 1, F.lit(len(weights))) + 1).cast("int")))
    out = out.withColumn("_cap", MOST_REPEATS * F.col("source_size").cast("double"))
    by_fill = Window.orderBy(F.col("_cap") / F.col("_w"), "_nth")
    before, whole = by_fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    out = out.withColumn("_level", rest / weight).withColumn("_full", F.col("_cap") / F.col("_w") <= F.col("_level"))
    level = F.min_by(F.when(~F.col("_full"), F.col("_level")), F.when(~F.col("_full"), F.col("_cap") / F.col("_w"))).over(whole)
    return out.withColumn("_final", level).select("source", "source_size", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_final") * F.col("_w")).alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: str = "mix") -> DataFrame:
    """docs' rows as (doc_id, source, size, source_size, target, taken): how many words the mix takes of each.

    All words, in blocks, are apportioned to sources by their targets, and each source's quota to its shards by
    their words. Within a shard documents stand in a seeded order, end to end; its first blocks are taken, up to
    its quota, over again for whole repeats. Only (doc_id, source, size) leaves the scan; a hot source is spread
    over its shards.

    Null text has size 0. A null source is a source of its own, the last. Rows without an id are placed by their
    texts; equal ids fall in the same shard, in order of size, and rows equal in both are alike. Empty and
    wordless tables take nothing. Other columns are ignored, whatever their names.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text")), F.lit(""))))
    sized = stash(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key")))
    sources = stash(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights))
    seats = F.round(F.sum("source_size").over(Window.partitionBy(F.lit(1))) / block_words).cast("long")
    parties = sources.withColumn("seats", seats).withColumn("all", F.lit(1))
    quotas = stash(sainte_lague(parties, ["all"], "target", "seats", ["source"]).select("source", "source_size", "target", F.col("quota").alias("blocks")))
    named = quotas.withColumnRenamed("source", "s")
    laid = sized.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    laid = laid.withColumn("shard", F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))))
    laid = stash(laid)
    shards = laid.groupBy("source", "shard", "blocks").agg(F.sum("size").alias("shard_size"))
    shards = sainte_lague(shards, ["source"], "shard_size", "blocks", ["shard"]).select(F.col("source").alias("s"), F.col("shard").alias("h"), "shard_size", (F.col("quota") * block_words).alias("quota"))
    rows = laid.join(shards, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h")))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source", "shard").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota, whole = F.least("quota", MOST_REPEATS * F.col("shard_size")), F.nullif(F.col("shard_size"), F.lit(0))
    times = F.coalesce(F.floor(quota / whole), F.lit(0))
    rest = quota - times * F.col("shard_size")
    taken = times * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
