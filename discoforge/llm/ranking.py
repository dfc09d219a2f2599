"""Ranked lexical search: for each term a tree of maxima over ranges of documents, searched best first.

Documents lie in shards, ranges of the scan of bounded size. In a shard each term has a tree: leaves cover LEAF
documents, every inner node FANOUT nodes, and a node holds the greatest impact of the term below it. An item's
bound on a node is the sum of its terms' weights times their maxima there. A search opens the node of the highest
bound until that is below the item's last place; nodes of just that bound are opened too, as a tie may hold an
earlier document. The shards themselves are opened best first in two rounds: a few of the highest bound for each
item, then all that can still reach the scores found.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash

TOP = 50
#: Documents of a leaf, and children of a node.
LEAF, FANOUT = 32, 8
#: A shard ends at so many documents or postings; one task holds one shard at a time.
SHARD_DOCS, SHARD_POSTINGS = 16_384, 1_000_000
#: Shards that each item opens in the first round.
FIRST_SHARDS = 2
#: Terms of items, counted once an item, that are searched at once; more items go in several passes over the documents.
TERMS_AT_ONCE = 1_000_000

#: Bytes of terms: ASCII letters, lower-cased, and digits, and all bytes of other characters; the rest separates.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | bytes | None) -> list[bytes]:
    """All terms of a text in order, as UTF-8."""
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return data.translate(TERM_BYTES).split()


class Tree:
    """Where a shard of `docs` documents has its nodes: level by level from the root, leaves last."""

    def __init__(self, docs: int):
        widths = [-(-docs // LEAF)]
        while widths[0] > 1:
            widths.insert(0, -(-widths[0] // FANOUT))
        self.starts = np.cumsum([0, *widths])
        self.leaves, self.docs = int(self.starts[-2]), docs

    def children(self, node: int) -> range:
        level = int(np.searchsorted(self.starts, node, "right")) - 1
        first = int(self.starts[level + 1]) + (node - int(self.starts[level])) * FANOUT
        return range(first, min(first + FANOUT, int(self.starts[level + 2])))

    def maxima(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(term, node, greatest impact), by term, of postings with document places."""
        leaf = docs // LEAF
        found = []
        for level in range(len(self.starts) - 2, -1, -1):
            key = terms * np.int64(self.starts[-1]) + self.starts[level] + leaf
            order = np.argsort(key, kind="stable")
            key = key[order]
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            most = np.maximum.reduceat(impacts[order], heads) if len(heads) else impacts
            terms, impacts = key[heads] // self.starts[-1], most
            nodes = key[heads] % self.starts[-1]
            found.append((terms, nodes, most))
            leaf = (nodes - self.starts[level]) // FANOUT
        terms, nodes, most = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(terms, kind="stable")
        return terms[order], nodes[order], most[order]


class Shard:
    """Postings of a shard by document, and the trees of its terms."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray):
        self.starts, self.impacts = starts, impacts  # postings of document i: starts[i] .. starts[i + 1]
        self.names, self.terms = np.unique(terms, return_inverse=True)
        self.tree = Tree(len(starts) - 1)
        places = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        owner, self.nodes, self.most = self.tree.maxima(self.terms.astype(np.int64), places, impacts)
        self.first = np.searchsorted(owner, np.arange(len(self.names) + 1))
        self.weights = np.zeros(len(self.names), np.int64)

    def _leaf(self, node: int) -> tuple[int, np.ndarray]:
        """First document of a leaf, and the scores of all of it under self.weights."""
        a = (node - self.tree.leaves) * LEAF
        b = min(a + LEAF, self.tree.docs)
        low, high = self.starts[a], self.starts[b]
        ends = np.concatenate([[0], np.cumsum(self.weights[self.terms[low:high]] * self.impacts[low:high])])
        return a, np.diff(ends[self.starts[a : b + 1] - low])

    def search(self, terms: np.ndarray, weights: np.ndarray, ids: list, least: int, top: int) -> list[tuple[int, int]]:
        """(score, place) of the documents that may be among an item's best: of score `least` or more, the `top` best of the shard. ids: sort keys of documents."""
        at = np.searchsorted(self.names, terms)
        here = (at < len(self.names)) & (self.names[np.minimum(at, len(self.names) - 1)] == terms) if len(self.names) else np.zeros(len(terms), bool)
        at, weights = at[here], weights[here]
        if not len(at):
            return []
        spans = [slice(a, b) for a, b in zip(self.first[at], self.first[at + 1])]
        bounds = np.zeros(int(self.tree.starts[-1]), np.int64)
        for span, w in zip(spans, weights):
            bounds[self.nodes[span]] += w * self.most[span]  # a term has a node once
        self.weights[at] = weights
        best: list[tuple] = []  # a heap with the worst of the best first
        open_ = [(-int(bounds[0]), 0)]
        while open_ and -open_[0][0] >= least:
            bound, node = heapq.heappop(open_)
            if node < self.tree.leaves:
                for child in self.tree.children(node):
                    if bounds[child] >= least:
                        heapq.heappush(open_, (-int(bounds[child]), child))
                continue
            start, scores = self._leaf(node)
            for i in np.flatnonzero(scores >= least):
                entry = (int(scores[i]), _Later(ids[start + i]), start + int(i))
                if len(best) < top:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if len(best) == top:
                least = max(least, best[0][0])
        self.weights[at] = 0
        return [(score, place) for score, _, place in best]


class _Later:
    """Orders ids downwards, null last of all, so that of equal scores the least id is the best."""

    def __init__(self, id_):
        self.key = (id_ is None, id_ if id_ is not None else 0)

    def __lt__(self, other):
        return self.key > other.key

    def __eq__(self, other):
        return self.key == other.key


def _counted(places, top_term: int):
    """Arrow batches of (doc_id, text) to rows of documents with terms: shard, length, and counts of the asked terms. places: broadcast of term to number."""

    def of_batches(batches):
        task = TaskContext.get().partitionId()
        known, shard, docs, postings = places.value, 0, 0, 0
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                keep, shards, lengths, terms, counts = [], [], [], [], []
                for row, text in enumerate(part.column(1)):
                    words = terms_of(text.as_py())
                    if not words:
                        continue
                    asked = np.fromiter(map(known.get, words, [top_term] * len(words)), np.int64, len(words))
                    own, tf = np.unique(asked[asked < top_term], return_counts=True)
                    if docs and (docs >= SHARD_DOCS or postings + len(own) > SHARD_POSTINGS):
                        shard, docs, postings = shard + 1, 0, 0
                    docs, postings = docs + 1, postings + len(own)
                    keep.append(row), shards.append(task << 32 | shard), lengths.append(len(words)), terms.append(own), counts.append(tf)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards, pa.int64()), part.column(0).take(pa.array(keep, pa.int64())), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))],
                    ["shard", "doc_id", "n", "terms", "counts"],
                )

    return of_batches


def _searched(items, top: int):
    """A group of a shard's documents to (item, doc_id, score). items: broadcast of (number, terms, weights, least score, shards to open or None for all, shards to leave out) of each item."""

    def of_group(key, table):
        starts = np.concatenate([[0], np.cumsum(table["terms"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        flat = lambda name: table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        shard, ids = Shard(starts, flat("terms"), flat("impacts")), table["doc_id"].to_pylist()
        out_items, out_docs, out_scores = [], [], []
        for number, terms, weights, least, only, without in items.value:
            if (only is not None and key[0].as_py() not in only) or key[0].as_py() in without:
                continue
            for score, place in shard.search(terms, weights, ids, least, top):
                out_items.append(number), out_docs.append(place), out_scores.append(score)
        return pa.table({"item": pa.array(out_items, pa.int64()), "doc_id": table["doc_id"].take(pa.array(out_docs, pa.int64())), "score": pa.array(out_scores, pa.int64())})

    return of_group


def _best(found: DataFrame, top: int) -> DataFrame:
    """The top rows of each item; Spark cuts each task's rows to the top before the shuffle."""
    nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", nth).where(F.col("rank") <= top)


def _pass(spark: SparkSession, items: list, documents: DataFrame, top: int) -> DataFrame | None:
    """(item, doc_id, score, rank) for a bounded list of (number, terms)."""
    sc = spark.sparkContext
    places = {t: n for n, t in enumerate(sorted({t for _, terms in items for t in terms}))}
    kind = documents.schema["doc_id"].dataType.simpleString()
    counted = stash(documents.mapInArrow(_counted(sc.broadcast(places), len(places)), f"shard long, doc_id {kind}, n long, terms array<long>, counts array<long>"))
    docs, length = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    if not docs:
        return None
    in_docs = np.zeros(len(places), np.int64)
    for term, df in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # the asked terms at most
        in_docs[term] = df
    weights = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1))) for df in in_docs.tolist()], np.int64)
    m = f"(50 + (50 * n * {docs}L) div {length}L)"
    indexed = counted.selectExpr("shard", "doc_id", "terms", f"transform(counts, tf -> (1000000000L * tf) div (1000L * tf + 20L * {m})) as impacts")

    asked = [(number, np.array(sorted(places[t] for t in terms), np.int64)) for number, terms in items]
    asked = [(number, own, weights[own]) for number, own in asked if len(own)]
    by_term = spark.createDataFrame([(int(t), number, int(w)) for number, own, ws in asked for t, w in zip(own, ws)], "term long, item long, w long")
    roots = indexed.select("shard", F.explode(F.arrays_zip("terms", "impacts")).alias("p")).groupBy("shard", F.col("p.terms").alias("term")).agg(F.max("p.impacts").alias("most"))
    bounds = roots.join(F.broadcast(by_term), "term").groupBy("shard", "item").agg(F.sum(F.col("w") * F.col("most")).alias("bound"))  # TERMS_AT_ONCE rows
    first = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "shard"))
    chosen: dict[int, set] = {}
    for shard, item in bounds.withColumn("nth", first).where(F.col("nth") <= FIRST_SHARDS).select("shard", "item").collect():  # FIRST_SHARDS rows an item
        chosen.setdefault(item, set()).add(shard)

    schema = f"item long, doc_id {kind}, score long"
    run = lambda rows, plan: rows.groupBy("shard").applyInArrow(_searched(sc.broadcast(plan), top), schema)
    opened = spark.createDataFrame([(s,) for s in sorted({s for own in chosen.values() for s in own})], "shard long")
    plan = [(number, own, ws, 1, chosen.get(number, set()), set()) for number, own, ws in asked]
    found = stash(_best(run(indexed.join(F.broadcast(opened), "shard", "left_semi"), plan), top))
    last = {r["item"]: r["score"] for r in found.where(F.col("rank") == top).select("item", "score").collect()}  # a row an item
    plan = [(number, own, ws, last.get(number, 1), None, chosen.get(number, set())) for number, own, ws in asked]
    return _best(found.drop("rank").union(run(indexed, plan)), top)


def search(documents: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's `top` documents with a score above 0, equal scores by doc_id.

    Scores are sums over an item's terms, each once, of integer weights by document frequency times integer
    impacts by term frequency and length; null texts have no terms. All documents are counted and indexed.
    Items without terms, or whose terms no document holds, have no rows. Repeated rows of either table are
    documents or items of their own, so ranks of repeated item_ids repeat; a null doc_id comes last among equal scores,
    a null item_id is an item like others. Texts of any length count whole, other columns are ignored, and an
    empty table on either side gives no rows.
    """
    spark = documents.sparkSession
    texts = documents.select("doc_id", F.col("text").cast("binary"))
    kind, of_doc = items.schema["item_id"].dataType.simpleString(), documents.schema["doc_id"].dataType.simpleString()
    words = items.select("item_id", F.col("text").cast("binary").alias("text")).mapInArrow(_distinct_terms, f"item_id {kind}, own array<binary>")
    numbered = stash(words.withColumn("item", F.monotonically_increasing_id()))
    passes = -(-numbered.agg(F.coalesce(F.sum(F.size("own")), F.lit(0))).head()[0] // TERMS_AT_ONCE)
    out = None
    for k in range(passes):
        asked = [(r["item"], [bytes(t) for t in r["own"]]) for r in numbered.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == k).toLocalIterator()]
        found = _pass(spark, asked, texts, top)
        if found is not None:
            out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {of_doc}, score long")
    named = out.join(numbered.select("item", "item_id"), "item")
    return named.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _distinct_terms(batches):
    for b in batches:
        own = [sorted(set(terms_of(t.as_py()))) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.list_(pa.binary()))], ["item_id", "own"])
