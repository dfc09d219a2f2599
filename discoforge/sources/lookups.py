"""Persisted indexes: lookup tables laid out by their keys, so that repeated lookups read and move little."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from discoforge.operators.keys import first_wins, last_wins

#: Characters of the runs that a text index holds; runs of two are for terms of two letters.
RUNS = (2, 3)


def save_lookup(df: DataFrame, table: str, key: str, value: Column, order: list[str], buckets: int, first: bool = False, path: str | None = None) -> None:
    """P18, P19, P21, S25. Save one row for each key, the last by order or the first, bucketed and sorted by the key.

    value is the normalised key of a row; rows without one are in no index. Joins on the key find the index laid
    out, so only the other side is shuffled, to as many buckets. With path the files lie there, else in the warehouse.
    """
    wins = first_wins if first else last_wins
    rows = wins(df.withColumn(key, value), [key], order)
    laid = rows.repartition(buckets, key).write.mode("errorifexists").bucketBy(buckets, key).sortBy(key)  # one file a bucket
    (laid.option("path", path) if path else laid).saveAsTable(table)


def look_up(asked: DataFrame, spark: SparkSession, table: str, key: str, prefix: str = "found_") -> DataFrame:
    """asked, which has the key, with the columns of its row in an index, null if there is none; no exchange of the index."""
    held = spark.table(table)
    named = held.select(F.col(key), *[F.col(c).alias(f"{prefix}{c}") for c in held.columns if c != key])
    return asked.join(named.hint("merge"), key, "left")


def _text(columns: list[str]) -> Column:
    """Columns in lower case with a mark between them that no term holds."""
    return F.lower(F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def text_index(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(gram, key): which rows hold which runs of two and three letters in some columns, by run, for write.parquet.

    Files hold ranges of runs in order, so a search for a few runs reads a few row groups. A run of very many rows
    spans files: keys are part of the ranges.
    """
    text = _text(columns)
    runs = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, n)))
    grams = F.array_distinct(F.flatten(F.array_compact(F.array(*[runs(n) for n in RUNS]))))
    postings = df.select(F.explode(grams).alias("gram"), key).where(~F.contains("gram", F.lit("\0")))
    return postings.repartitionByRange("gram", key).sortWithinPartitions("gram", key)


def _asked_runs(terms: list[str]) -> list[str]:
    out = set()
    for t in terms:
        n = min(max(RUNS), len(t))
        out |= {t[i : i + n] for i in range(len(t) - n + 1)} if n >= min(RUNS) else set()
    return sorted(out)


def search_index(df: DataFrame, index: DataFrame, key: str, columns: list[str], terms: list[str]) -> DataFrame:
    """Q01, Q03, Q04, Q07, Q08, P17. Rows of df whose columns hold every term, whatever the case: postings are met, then the rows tested.

    The same rows as a scan. The filter on runs reaches the index's files. A term of one letter only has no runs:
    it is tested on what the others leave, or on all rows if it is alone.
    """
    terms = [t.strip().lower() for t in terms if t.strip()]
    holds = reduce(lambda a, b: a & b, [F.contains(_text(columns), F.lit(t)) for t in terms], F.lit(True))
    runs = _asked_runs(terms)
    if not runs:
        return df.where(holds)
    found = index.where(F.col("gram").isin(runs)).groupBy(key).agg(F.count_distinct("gram").alias("_n")).where(F.col("_n") == len(runs)).select(key)
    return df.join(found, key, "left_semi").where(holds)
