"""MinHash near-duplicates by min-max hashing: the least and the greatest value of each permutation both count."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, ascii_words, components, forest, fresh, mixed, runs, stash

#: Permutations; each gives two signature values. 24 bands of 4 values miss a pair of similarity 0.8 about once in 300,000.
PERMUTATIONS = 48
ROWS_A_BAND = 4
#: A pair of similarity 0.8 agrees in 77 of 96 values, give or take 4. Pairs below this share go unchecked.
LEAST_AGREEMENT = 0.58
#: A bucket of more documents passes on its members as one group and no pairs.
PAIRS_UP_TO = 24
#: A block of a group holds about so many documents and shingles.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 200_000

_SEEDS = mixed(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_set(text: str | None, n: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words."""
    return np.unique(runs(words.of(ascii_words(text)), n))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least and greatest value of each permutation, side by side."""
    out = np.empty(2 * PERMUTATIONS, np.uint64)
    for k, seed in enumerate(_SEEDS):
        h = (shingles ^ seed) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        out[2 * k], out[2 * k + 1] = h.min(), h.max()
    return out


def _digest(n: int):
    def of_batch(batches):
        words = WordHashes()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                s = shingle_set(text, n, words)
                if len(s):
                    sig = signature(s)
                    bands = [int(x) for x in mixed(sig.reshape(-1, ROWS_A_BAND) @ np.array([1, 3, 5, 7], np.uint64)).view(np.int64)]
                    low, high = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                    out.append((doc_id, len(s), int(low), int(high), bands, (sig & np.uint64(255)).astype(np.uint8).tobytes()))
                else:
                    out.append((doc_id, 0, None, None, None, None))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "low", "high", "bands", "sig"]).astype({"low": "Int64", "high": "Int64"})

    return of_batch


def _confirm(n: int, percent: int):
    def of_group(group: pd.DataFrame) -> pd.DataFrame:
        """The links of the documents of a group in side 0 or 2 with those in side 1 or 2, as a forest."""
        words = WordHashes()
        sets = [shingle_set(t, n, words) for t in group["text"]]
        ids, side = group["doc_id"].to_numpy(), group["side"].to_numpy()
        size = np.array([len(s) for s in sets], np.int64)
        rows, cols = np.nonzero(side != 1)[0], np.nonzero(side != 0)[0]
        shingles, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), size)
        shared = df[column] > 1  # the rest can't be in an intersection
        owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
        both = np.zeros((len(rows), len(cols)), np.float32)
        as_row, as_col = np.full(len(sets), -1), np.full(len(sets), -1)
        as_row[rows], as_col[cols] = np.arange(len(rows)), np.arange(len(cols))
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        width = 4096
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            lo, hi = np.searchsorted(column, [at, at + width])
            o, c = owner[lo:hi], column[lo:hi] - at
            x, y = np.zeros((len(rows), width), np.float32), np.zeros((len(cols), width), np.float32)
            own = as_row[o] >= 0
            x[as_row[o[own]], c[own]] = 1
            own = as_col[o] >= 0
            y[as_col[o[own]], c[own]] = 1
            both += x @ y.T
        total = size[rows][:, None] + size[cols][None, :] - both.astype(np.int64)
        r, c = np.nonzero(100 * both.astype(np.int64) >= percent * total)
        u, v = ids[rows[r]], ids[cols[c]]
        u, v = forest(u[u != v], v[u != v])
        return pd.DataFrame({"a": u, "b": v})

    return of_group


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each document: groups of texts alike in percent of their shingles.

    Equal shingle sets fall together first by a 128-bit digest. Of the others, documents that share a band of
    the min-max signature are candidates. Small buckets give pairs, which length and signature agreement thin
    out; large buckets give one star. The texts of each group of candidates then meet in blocks of bounded size,
    and links are confirmed there on full shingle sets; only a forest of the links leaves a task (_links).

    Null and empty texts, and texts of white space, have no shingles and link with nothing. A text of fewer
    words than a shingle is one shingle. Repeated doc_ids count as one node; a null doc_id is its own component,
    null. Other columns of docs are ignored. An empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    digests = stash(docs.mapInPandas(_digest(shingle_words), f"doc_id {kind}, n_shingles long, low long, high long, bands array<long>, sig binary"))
    full = digests.where("low is not null and doc_id is not null")
    # equal sets: any of their documents stands for all
    classes = stash(full.groupBy("low", "high").agg(F.min("doc_id").alias("rep")))
    same = full.join(classes, ["low", "high"]).select("doc_id", "rep")
    reps = stash(full.join(classes.withColumnRenamed("rep", "doc_id"), ["low", "high", "doc_id"]).select("doc_id", "n_shingles", "bands", "sig"))

    keys = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
    sizes = keys.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n > 1")
    members = stash(keys.join(sizes, ["band", "key"]))
    small = members.where(F.col("n") <= PAIRS_UP_TO).groupBy("band", "key").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    pairs = small.select(F.posexplode("ids").alias("i", "a"), "ids").select("a", F.explode(F.expr("slice(ids, i + 2, size(ids))")).alias("b")).distinct()
    side = lambda s: reps.select(F.col("doc_id").alias(s), F.col("n_shingles").alias(f"n{s}"), F.col("sig").alias(f"s{s}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    met = met.mapInPandas(_agree, f"a {kind}, b {kind}")
    stars = members.where(F.col("n") > PAIRS_UP_TO).select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    grouped = components(met.union(stars)).select(F.col("node").alias("doc_id"), F.col("component").alias("candidates"))

    grouped = grouped.join(reps.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles")), "doc_id")
    links = _links(docs, stash(grouped), shingle_words, percent)
    found = components(links.union(same.where("doc_id <> rep").select("doc_id", "rep"))).withColumnRenamed("node", "doc_id")
    out = digests.select("doc_id", "n_shingles").join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _in_blocks(members: DataFrame) -> DataFrame:
    """members (doc_id, candidates, n_shingles) with the number of blocks of their group, and theirs."""
    blocks = members.groupBy("candidates").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("blocks"))
    return members.join(blocks, "candidates").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks"))


def _links(docs: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): links that join the same documents as all links within groups of candidates do.

    A group's documents meet in blocks. The blocks' documents that stand for their own links meet in blocks again,
    until one block holds them. That joins all documents of nearly every group. What is left of a group in several
    pieces is compared with all of the group, but for its largest piece with itself: no link is lost, and a large
    group of near copies costs a pass over its texts, not one for each of its blocks.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def confirm(placed: DataFrame, *keys: str) -> DataFrame:
        return stash(docs.join(placed, "doc_id").select("doc_id", "text", "side", *keys).groupBy(*keys).applyInPandas(_confirm(n, percent), f"a {kind}, b {kind}"))

    def lifted(members: DataFrame) -> DataFrame:
        """members with the document that stands for each in its block's forest."""
        up = links.withColumnRenamed("a", "doc_id").withColumnRenamed("b", "stands")
        return stash(members.join(up, "doc_id", "left").withColumn("stands", F.coalesce("stands", "doc_id")))

    placed = stash(_in_blocks(members).withColumn("side", F.lit(2)))
    links = confirm(placed, "candidates", "block")
    every, level = links, lifted(placed.where("blocks > 1").select("doc_id", "candidates", "n_shingles"))
    if level.isEmpty():
        return every
    levels = [level]
    while True:
        heads = stash(_in_blocks(level.where(F.col("stands") == F.col("doc_id")).select("doc_id", "candidates", "n_shingles")).withColumn("side", F.lit(2)))
        links = confirm(heads, "candidates", "block")
        every, level = every.union(links), lifted(heads.select("doc_id", "candidates", "n_shingles"))
        levels.append(level)
        left, before = level.where(F.col("stands") == F.col("doc_id")).count(), level.count()
        if heads.where("blocks > 1").isEmpty() or 2 * left > before:
            break
    piece = levels[-1].select("doc_id", F.col("stands").alias("piece"))
    for level in levels[-2::-1]:  # a document takes the piece of the one that stands for it; these are a block's at most
        piece = level.select("doc_id", "stands").join(piece.select(F.col("doc_id").alias("stands"), "piece"), "stands").select("doc_id", "piece")
    pieces = stash(levels[0].select("doc_id", "candidates", "n_shingles").join(piece, "doc_id"))
    sizes = pieces.groupBy("candidates", "piece").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("candidates").agg(F.max_by("piece", F.struct("n", "piece")).alias("largest"), F.count("*").alias("pieces")).where("pieces > 1").drop("pieces")
    torn = pieces.join(largest, "candidates")
    strays, whole = (stash(_in_blocks(x.select("doc_id", "candidates", "n_shingles"))) for x in (torn.where("piece <> largest"), torn))
    if strays.isEmpty():
        return every
    number = lambda df, name: df.groupBy("candidates").agg(F.first("blocks").alias(name))
    each = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    left = strays.join(number(whole, "others"), "candidates").select("doc_id", "candidates", F.lit(0).alias("side"), F.col("block").alias("bi"), each("others").alias("bj"))
    right = whole.join(number(strays, "others"), "candidates").select("doc_id", "candidates", F.lit(1).alias("side"), each("others").alias("bi"), F.col("block").alias("bj"))
    return every.union(confirm(left.union(right), "candidates", "bi", "bj"))


def _agree(batches):
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(len(batch), 2 * PERMUTATIONS) for c in ("sa", "sb"))
        keep = (x == y).mean(axis=1) >= LEAST_AGREEMENT
        yield batch.loc[keep, ["a", "b"]]


def one_of_each_group(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near-duplicates, the one with the least doc_id; the columns stay as they are.

    Rows count by id and text: rows without an id are compared like others and come last in their group, rows of one
    id with different texts are rows of their own, and of rows alike in both any one stays. Rows without words all
    stay. An empty table stays empty.
    """
    (node,) = fresh(docs, "node")
    rows = docs.withColumn(node, F.xxhash64("doc_id", "text"))
    found = stash(near_duplicates(rows.select(F.col(node).alias("doc_id"), "text"), shingle_words, percent).where("n_shingles > 0").groupBy(F.col("doc_id").alias("n")).agg(F.first("component_id").alias("component"), F.count("*").alias("times")))
    ids = rows.groupBy(F.col(node).alias("n")).agg(F.min("doc_id").alias("id"))
    first = F.struct(F.col("id").isNull(), "id", "n")
    heads = found.join(ids, "n").groupBy("component").agg(F.min(first)["n"].alias("n"))
    gone = stash(found.join(heads, "n", "left_anti").select(F.col("n").alias(node)))
    left = rows.join(gone, node, "left_anti")
    again = found.where("times > 1").select(F.col("n").alias(node))
    if again.isEmpty():
        return left.select(docs.columns)
    once = left.join(again, node, "left_semi").dropDuplicates([node])
    return left.join(again, node, "left_anti").union(once).select(docs.columns)
