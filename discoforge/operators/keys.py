"""First-wins and last-wins rows of a key, prioritised joins, OR-key joins and fuzzy matching within a block."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discoforge.functions.text import may_reach, similarity, title_key

from .cuts import written
from .similar import alike_pairs


def order_columns(order: list) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def first_wins(df: DataFrame, key: list, order: list) -> DataFrame:
    """P19. The first row of each key by order, which should be total. Rows with a null in the key are no one's.

    row_number = 1 lets Spark cut each task's rows to one a key before the shuffle, so hot keys stay small.
    """
    columns = [F.col(k) if isinstance(k, str) else k for k in key]
    known = reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])
    nth = F.row_number().over(Window.partitionBy(*columns).orderBy(*order_columns(order)))
    return df.where(known).withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def last_wins(df: DataFrame, key: list, order: list) -> DataFrame:
    """P18, P21. The last row of each key by order."""
    return first_wins(df, key, [c.desc() for c in order_columns(order)])


def distinct_first(df: DataFrame, key: list, order: list) -> DataFrame:
    """A10, J18. The first row of each key; nulls in a key are equal, so rows without one collapse too."""
    columns = [F.col(k) if isinstance(k, str) else k for k in key]
    nth = F.row_number().over(Window.partitionBy(*columns).orderBy(*order_columns(order)))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def duplicates(df: DataFrame, key: list, order: list) -> DataFrame:
    """A11. Every row of a key after its first."""
    columns = [F.col(k) if isinstance(k, str) else k for k in key]
    known = reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])
    nth = F.row_number().over(Window.partitionBy(*columns).orderBy(*order_columns(order)))
    return df.where(known).withColumn("_nth", nth).where("_nth > 1").drop("_nth")


def prioritised_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, Column, Column]], order: list, payload: str = "match") -> DataFrame:
    """J01, J02, J04, J06. Each left row with the right row that the first matching key finds, as a struct, or null.

    keys: (name, left expression, right expression), in order of priority. Of several right rows of a key the
    last by order wins. match_via names the key that matched. Each key is one equi-join on a right side with one
    row a key, so the left side keeps its rows. Left rows without a key are dealt by their other values, not all to one task.
    Joins are by sorting: made-up columns make right rows many times their files' size, by which Spark would broadcast them.
    """
    spread = F.pmod(F.xxhash64(F.lit(0), *[c for c, kind in left.dtypes if "map<" not in kind and "variant" not in kind]), F.lit(1 << 20))
    out = left
    for n, (_, on_left, on_right) in enumerate(keys):
        side = last_wins(right.select(on_right.alias(f"_k{n}"), F.struct(*right.columns).alias(f"_m{n}"), *[c.alias(f"_o{i}") for i, c in enumerate(order_columns(order))]), [f"_k{n}"], [f"_o{i}" for i in range(len(order))])
        known = side.select(F.struct(F.lit(0).cast("long").alias("none"), F.col(f"_k{n}").alias("k")).alias(f"_k{n}"), f"_m{n}")
        out = out.withColumn(f"_l{n}", on_left)
        own = F.struct(F.when(F.col(f"_l{n}").isNull(), spread).otherwise(F.lit(0)).alias("none"), F.col(f"_l{n}").alias("k"))
        out = out.join(known.hint("merge"), own == F.col(f"_k{n}"), "left")
    via = F.coalesce(*[F.when(F.col(f"_m{n}").isNotNull(), F.lit(name)) for n, (name, _, _) in enumerate(keys)])
    found = F.coalesce(*[F.col(f"_m{n}") for n in range(len(keys))])
    return out.select(*left.columns, found.alias(payload), via.alias("match_via"))


def fill_blanks(df: DataFrame, payload: str, columns: list[str], blank_too: bool = True) -> DataFrame:
    """J04. Columns of df, with those of the struct payload where they are null, or blank texts too."""
    kinds = dict(df.dtypes)

    def own(c: str) -> Column:
        return F.when(F.trim(c) != "", F.col(c)) if blank_too and kinds[c] == "string" else F.col(c)

    return df.withColumns({c: F.coalesce(own(c), F.col(f"{payload}.{c}")) for c in columns})


def unmatched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """J17. Left rows without a partner."""
    return left.join(right.select(*on).distinct(), on, "left_anti")


#: Parts that the rows of a key fall into in or_key_join, so that a hot key is several tasks' work.
SALTS = 8


def or_key_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """J15, J20. Pairs of rows where any of several column pairs is equal, each pair of rows once.

    A union of equi-joins: OR in one join condition would compare all rows with all. Each join leaves out what an
    earlier column pair has found, so equal rows go before the joins, and pairs, of which there may be very many,
    are neither shuffled nor remembered. Left rows of a key are dealt to SALTS parts, which meet a copy of its right rows each.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    here, there = left.distinct(), right.distinct()
    here = here.withColumn("_salt", F.pmod(F.hash(*here.columns), F.lit(SALTS)))
    there = there.withColumn("_salted", F.explode(F.array(*[F.lit(n) for n in range(SALTS)])))
    joins = []
    for n, (a, b) in enumerate(pairs):
        before = reduce(lambda x, y: x & y, [~F.coalesce(here[c] == there[d], F.lit(False)) for c, d in pairs[:n]], F.lit(True))
        laid = here.repartition(parts, a, "_salt")  # the rows are few beside their pairs: not to be put together by their size
        joins.append(laid.join(there.hint("merge"), (here[a] == there[b]) & (F.col("_salt") == F.col("_salted")) & before).drop("_salt", "_salted"))
    return reduce(DataFrame.unionByName, joins)


#: Blocks with more right rows than this are matched by an index of pieces, smaller ones by comparing their rows.
INDEXED_ROWS = 2000


def fuzzy_matches(left: DataFrame, right: DataFrame, block: list[str], left_title: str, right_title: str, order: list[str], threshold: float = 0.7, also: Column | None = None, large_blocks: bool = True) -> DataFrame:
    """J09. For each left row its best right row of the same block with title similarity of threshold or more.

    Within small blocks rows meet by an equi-join on the block, and lengths are tested before the edit distance;
    within large ones titles meet by an index of pieces. Both give all pairs of the threshold or more. also: what else
    pairs must meet. Of equal scores the first by order wins. Columns of the right side come with the prefix r_.
    score is the similarity. Nulls in the block match nothing. Finding large blocks takes a job and writes the left rows;
    large_blocks=False spares both where blocks are known to be small, and gives the same rows.
    """
    marked = left.withColumn("_row", F.monotonically_increasing_id())  # rows that are alike stay rows of their own
    marked = written(marked) if large_blocks else marked
    named = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(b) == F.col(f"r_{b}") for b in block])
    other = F.lit(True) if also is None else also
    key = lambda prefix="": F.struct(*[F.col(f"{prefix}{b}").alias(f"k{n}") for n, b in enumerate(block)])
    known = reduce(lambda a, b: a & b, [F.col(b).isNotNull() for b in block])
    few, large = named, None
    if large_blocks:
        large = right.where(known).groupBy(key().alias("_large")).agg(F.count("*").alias("_n")).where(F.col("_n") > INDEXED_ROWS).select("_large")
        few = named.withColumn("_in", key("r_")).join(large, F.col("_in") == F.col("_large"), "left_anti").drop("_in")
    met = marked.join(few, same & other & may_reach(left_title, f"r_{right_title}", round(10 * threshold)))
    scored = met.withColumn("score", similarity(left_title, f"r_{right_title}")).where(F.col("score") >= threshold)
    if large is not None and not large.isEmpty():
        keyed = lambda df, c: df.where(known).select(key().alias("block"), title_key(c).alias("text")).join(large, F.col("block") == F.col("_large")).select("block", "text")
        pairs = alike_pairs(keyed(left, left_title), keyed(right, right_title), threshold)
        pairs = pairs.select(F.col("block").alias("_in"), F.col("a").alias("_a"), F.col("b").alias("_b"))
        here = marked.join(pairs, (key() == F.col("_in")) & (title_key(left_title) == F.col("_a")))
        many = here.join(named, same & (title_key(f"r_{right_title}") == F.col("_b")) & other).drop("_in", "_a", "_b")
        scored = scored.unionByName(many.withColumn("score", similarity(left_title, f"r_{right_title}")))
    nth = F.row_number().over(Window.partitionBy("_row").orderBy(F.desc("score"), *[f"r_{c}" for c in order]))
    return scored.withColumn("_nth", nth).where("_nth = 1").drop("_nth", "_row")


def elsewhere(incoming: DataFrame, existing: DataFrame, key: str, group: str) -> DataFrame:
    """J07. incoming with other_group: the least other group in which existing holds its key, null if none.

    Of a key's groups the least two tell, so a key of any number of groups is one row; incoming keeps its rows,
    repeated ones too. A row without a key or group has no other group.
    """
    held = existing.select(F.col(key).alias("_k"), F.col(group).alias("_g")).where("_k is not null and _g is not null").distinct()
    nth = F.row_number().over(Window.partitionBy("_k").orderBy("_g"))
    two = held.withColumn("_nth", nth).where("_nth <= 2").groupBy("_k").agg(F.min("_g").alias("_g1"), F.max(F.when(F.col("_nth") == 2, F.col("_g"))).alias("_g2"))
    other = F.when(F.col(group) != F.col("_g1"), F.col("_g1")).when(F.col(group) == F.col("_g1"), F.col("_g2"))
    return incoming.join(two, F.col(key) == F.col("_k"), "left").withColumn("other_group", other).drop("_k", "_g1", "_g2")


def distinct_in_order(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """A09, P23. The distinct values of columns, nulls in them left out, with at: where each was seen first by order."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return df.where(known).groupBy(*columns).agg(F.min(F.struct(*order)).alias("at"))


def prefix_join(left: DataFrame, right: DataFrame, prefix: str, name: str, most: int = 64) -> DataFrame:
    """J16. Left rows with the right rows whose name starts with their prefix; no prefix, no rows.

    An equi-join on the name's beginnings, one for each length that prefixes have; these are `most` at most, and
    longer prefixes are tested on their first `most` characters and then whole.
    """
    asked = left.withColumn("_p", F.left(F.col(prefix), F.lit(most))).where("_p <> ''")
    lengths = sorted(r[0] for r in asked.select(F.length("_p")).distinct().collect())
    if not lengths:
        return left.join(right, F.lit(False))
    starts = F.array_distinct(F.array(*[F.left(F.col(name), F.lit(n)) for n in lengths]))
    named = right.withColumn("_p", F.explode(starts))
    return asked.join(named, "_p").where(F.col(name).startswith(F.col(prefix))).drop("_p")
