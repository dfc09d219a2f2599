"""Cutting the lineage with written tables, numbers for rows in order, and passes over rows in order."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a session on one machine, as in tests, may do without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and spark.sparkContext.master.startswith("local"):
        folder = f"{tempfile.gettempdir()}/discoforge-checkpoints"
    if not folder:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return folder


def new_folder(spark: SparkSession) -> str:
    """A name for a new folder in the shared one. It goes when the application ends."""
    folder = f"{shared_folder(spark).rstrip('/')}/tables-{spark.sparkContext.applicationId}"
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(root)
    return f"{folder}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: what is drawn or numbered in it is drawn once."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_ranges(df: DataFrame, order: list, part: str, nth: str) -> DataFrame:
    """df, written, with the range of the order that each row lies in and its place there, from 0; order should be total.

    Spark draws the ranges' bounds anew for every shuffle by ranges, so sizes and places must come from one: the table is
    written once, and whatever is asked of it afterwards sees the same ranges.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(parts, *columns).sortWithinPartitions(*columns).withColumn("_id", F.monotonically_increasing_id())
    return written(laid.withColumn(part, F.shiftright("_id", 33)).withColumn(nth, F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id"))


def positions(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """df with the place of each row by order, 1 .. over the whole table; order should be total.

    A row's place is its place in its range and the sizes of the ranges before, so no task orders all rows.
    """
    laid = in_ranges(df, order, "_part", "_nth")
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over ranges, not rows
    starts = laid.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_before"))
    placed = laid.join(F.broadcast(starts), "_part")  # one row a range
    return placed.withColumn(name, F.col("_before") + F.col("_nth") + 1).drop("_part", "_nth", "_before")


def components(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The distinct combinations of keys in rows, with a number that is the same for combinations joined by equal keys, directly or over others.

    Null keys join nothing; combinations without any key are left out. Only combinations of several keys join others, so
    only these go in rounds: each round gives one the least number that any of its keys reaches and follows it
    once, so chains shorten by half; a round is written. A key alone then takes the number of those that hold it.
    Minima are taken before the shuffle, so a key of very many rows is one row a task.
    Joins are by sorting: written files are small beside what they hold, and Spark would broadcast them by their size.
    """
    held = reduce(lambda a, b: a + b, [F.col(k).isNotNull().cast("int") for k in keys])
    distinct = rows.where(held > 0).select(*keys).distinct()
    all_nodes = written(distinct.withColumn("_node", F.monotonically_increasing_id()).withColumn("_least", F.col("_node")))
    if len(keys) == 1:
        return all_nodes.select(*keys, F.col("_least").alias(name))
    nodes = all_nodes.where(held > 1)
    while True:
        reached = nodes
        for n, k in enumerate(keys):
            least = nodes.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("_least").alias(f"_low{n}")).select(F.struct(F.lit(False).alias("none"), F.col(k).cast("string").alias("k")).alias("_of"), f"_low{n}")
            own = F.struct(F.col(k).isNull().alias("none"), F.coalesce(F.col(k).cast("string"), F.col("_node").cast("string")).alias("k"))  # null keys go to as many tasks as nodes
            reached = reached.join(least.hint("merge"), own == F.col("_of"), "left").drop("_of")
        low = F.least("_least", *[F.col(f"_low{n}") for n in range(len(keys))])
        reached = written(reached.select(*keys, "_node", F.col("_least").alias("_was"), low.alias("_least")))
        further = reached.select(F.col("_node").alias("_at"), F.col("_least").alias("_next"))
        moved = reached.where("_was <> _least").isEmpty()
        if moved:
            break
        nodes = written(reached.join(further.hint("merge"), F.col("_least") == F.col("_at"), "left").select(*keys, "_node", F.least("_least", "_next").alias("_least")))
    of = F.coalesce(*[F.when(F.col(k).isNotNull(), F.struct(F.lit(n).alias("n"), F.col(k).cast("string").alias("k"))) for n, k in enumerate(keys)])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(k).cast("string").alias("k")) for n, k in enumerate(keys)]))
    ends = reached.select(each.alias("_of"), "_least").where("_of.k is not null").groupBy("_of").agg(F.min("_least").alias("_low"))
    alone = all_nodes.where(held == 1).join(ends.hint("merge"), of == F.col("_of"), "left").select(*keys, F.coalesce("_low", "_least").alias(name))
    return reached.select(*keys, F.col("_least").alias(name)).unionByName(alone)


def by_keys(rows: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the other columns of held, one row a combination of keys; null keys are equal. A join by sorting."""
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    more = [c for c in held.columns if c not in keys]
    return rows.join(held.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *more).hint("merge"), same, "left").select(*rows.columns, *more)


def linked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with a number that is the same for rows joined by equal keys, directly or over other rows; null keys join nothing.

    Rows without any key have null.
    """
    any_key = reduce(lambda a, b: a | b, [F.col(k).isNotNull() for k in keys])
    found = by_keys(rows.where(any_key), components(rows, keys, name), keys)
    return found.unionByName(rows.where(~any_key).withColumn(name, F.lit(None).cast("long")))  # not all to one task


def in_order(rows: DataFrame, unit: str, order: list, start: Callable[[], Callable], reads: list[str], schema: str, keeps: list[str] = ()) -> DataFrame:
    """Rows of each unit passed one after another, in order, through a function that start() makes for the unit.

    The function takes the columns `reads` of a row and returns a list of result rows. The columns `keeps` of a row go
    before each of its result rows, unread. A task streams its units: it holds one Arrow batch and what the function
    remembers, never a unit's rows. Spark sorts, and spills if it must.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    laid = rows.repartition(F.col(unit)).sortWithinPartitions(unit, *columns)
    kind = rows.sparkSession.createDataFrame([], schema).schema
    fields = to_arrow_schema(kind)
    kept, first = StructType([rows.schema[c] for c in keeps]), 1 + len(reads)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step = None, None
        for b in batches:
            out, at = [], []
            values = zip(*[b.column(n).to_pylist() for n in range(first)])
            for n, (u, *row) in enumerate(values):
                if step is None or u != last:
                    last, step = u, start()
                found = step(*row)
                out += found
                at += [n] * len(found)
            made = [pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(fields), fields)]
            along = [b.column(n).take(pa.array(at, pa.int32())) for n in range(first, b.num_columns)]
            yield pa.RecordBatch.from_arrays(along + made, schema=pa.schema([b.schema.field(n) for n in range(first, b.num_columns)] + list(fields)))

    return laid.select(unit, *reads, *keeps).mapInArrow(of_batches, StructType(kept.fields + kind.fields))
