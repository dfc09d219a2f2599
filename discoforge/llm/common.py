"""What several corpus operators share: written cuts of the lineage, words, and components of link graphs."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a session on one machine, as in tests, may do without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and spark.sparkContext.master.startswith("local"):
        folder = os.path.join(tempfile.gettempdir(), "discoforge-checkpoints")
    if not folder:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return folder


def stash(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: no lineage stays, and a lost executor costs no work before this point.

    All tables of an application lie in one folder, which its file system deletes when the application ends.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/stash-{spark.sparkContext.applicationId}"
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(root)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to differ from the columns of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


class WordHashes(dict):
    """64-bit hash of each word, kept for words seen before; emptied when it has grown to 400,000 words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def ascii_words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8, A-Z in lower case. bytes.lower and bytes.split touch ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scramble."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes; of the whole sequence if it is shorter; nothing for no words."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = mixed(out + hashes[k : len(hashes) - n + 1 + k] + np.uint64(k + 1))
    return out


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A few edges with the same components as the edges u-v: each end to the least end that it reaches."""
    ends, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    least = np.arange(len(ends))
    while True:
        low = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, least[a], low)
        np.minimum.at(new, least[b], low)
        new = new[new]
        if np.array_equal(new, least):
            break
        least = new
    other = least != np.arange(len(ends))
    return ends[other], ends[least[other]]


#: A node of so many links, or of a hundred-thousandth of all if that is more, is a hub: there are 200,000 at most.
HUB_LINKS, HUB_SHARE = 1000, 100_000


def _with(rows: DataFrame, key: str, up: DataFrame, name: str, least: int) -> DataFrame:
    """rows with the label that up (a, p, links) gives their key; null if it gives none.

    Hubs are looked up in a broadcast of bounded size, so the rows that name one don't meet in one task.
    """
    labels = up.select(F.col("a").alias("_a"), F.col("p").alias(name), "links")
    hubs = F.broadcast(labels.where(F.col("links") >= least).drop("links"))
    others = labels.where(F.col("links") < least).drop("links")
    of_hubs = rows.join(hubs, F.col(key) == F.col("_a")).drop("_a")
    return of_hubs.unionByName(rows.join(hubs, F.col(key) == F.col("_a"), "left_anti").join(others, F.col(key) == F.col("_a"), "left").drop("_a"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of each end of an edge; component is the least node that it reaches.

    Each round lets every node take the least label next to it, follows that label once more, and rewrites the
    edges between labels; edges within a label go. Minima are summed before the shuffle, and hubs are looked up
    apart from the other nodes, so a hot node makes no large task. Each round is written, so it survives lost
    executors.
    """
    edges = stash(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    labels = None
    while (n := edges.count()) > 0:
        least = max(HUB_LINKS, n // HUB_SHARE)
        both = edges.union(edges.select("b", "a"))
        up = stash(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("links")).select("a", F.least("a", "m").alias("p"), "links"))
        over = stash(_with(up, "p", up.select("a", "p", "links"), "next", least).select("a", F.coalesce("next", "p").alias("p"), "links"))
        step = over.select(F.col("a").alias("node"), F.col("p").alias("up"))
        labels = step.withColumnRenamed("up", "component") if labels is None else _followed(labels, over, least)
        labels = stash(labels)
        edges = _with(_with(edges, "a", over, "ua", least), "b", over, "ub", least)
        edges = stash(edges.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).where("a <> b").distinct())
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels


def _followed(labels: DataFrame, over: DataFrame, least: int) -> DataFrame:
    """labels (node, component), each component followed to the label that the round gave it.

    A component may stand for more nodes than it has links to others, so its nodes count as its links here.
    """
    sizes = labels.groupBy("component").agg(F.count("*").alias("links"))
    least = max(least, labels.count() // HUB_SHARE)
    given = over.select("a", "p").join(sizes, F.col("a") == F.col("component")).select("a", "p", "links")
    return _with(labels, "component", given, "up", least).select("node", F.coalesce("up", "component").alias("component"))
