"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check. DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh, stash

SHINGLE_WORDS, THRESHOLD = 5, 0.8
#: Bits by which two fingerprints may differ. Windows of similarity 0.8 differ in 10 of 64 bits, give or take 3.
RADIUS = 19
#: Blocks of a fingerprint.
BLOCKS = 5
#: Longer items are cut into equal parts of at most so many words.
PART_WORDS = 512
#: The benchmark's shingles, and its fingerprints with flipped bits, are broadcast up to this many rows (about 50 MB and 150 MB), else joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: 16 sums of 4 counters, 16 bits each.
_ONES, _LANES = 0x0001000100010001, 16


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), "")


def _shingles(words: str, k: int) -> Column:
    """Hashes of the runs of k words of a column that holds words."""
    w = F.col(words)
    one = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)], F.lit(k))
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), one)).otherwise(F.array().cast("array<bigint>"))


def _fingerprint(shingles: Column) -> Column:
    """SimHash: each bit is the majority of that bit over all shingles, repeats counted."""
    zero = F.struct(*[F.lit(0).cast("long").alias(f"l{j}") for j in range(_LANES)])
    add = lambda acc, x: F.struct(*[(acc[f"l{j}"] + F.shiftrightunsigned(x, j).bitwiseAND(F.lit(_ONES))).alias(f"l{j}") for j in range(_LANES)])
    over = (F.lit(16383) - F.floor(F.size(shingles) / 2)) * F.lit(_ONES)  # a counter above half reaches bit 14

    def bits(acc):
        each = [F.shiftleft(F.shiftrightunsigned(acc[f"l{j}"] + over, 14).bitwiseAND(F.lit(_ONES)), j) for j in range(_LANES)]
        return reduce(lambda x, y: x.bitwiseOR(y), each)

    return F.aggregate(shingles, zero, add, bits)


def _blocks(fingerprint: Column) -> Column:
    """The 64 bits in BLOCKS parts."""
    at, out = 0, []
    for width in _widths():
        out.append(F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << width) - 1)).cast("int"))
        at += width
    return F.array(*out)


def _widths() -> list[int]:
    return [64 // BLOCKS + (b < 64 % BLOCKS) for b in range(BLOCKS)]


def _probes(radius: int) -> list[list[int]]:
    """For each block the values to flip its bits by: fingerprints within the radius agree in one block after one of them.

    Of BLOCKS blocks that differ in radius bits together, one differs in radius // BLOCKS bits at most.
    """
    masks = {w: [sum(1 << i for i in c) for n in range(radius // BLOCKS + 1) for c in combinations(range(w), n)] for w in set(_widths())}
    return [masks[w] for w in _widths()]


def _similarity(a: str, b: str) -> Column:
    """Weighted Jaccard of two bags of shingles: the sum of the lesser counts by that of the greater ones."""
    count = lambda c, h: F.size(F.filter(c, lambda x: x == h))
    repeats = lambda c: F.size(F.array_distinct(c)) < F.size(c)
    common = F.array_intersect(a, b)
    counted = F.aggregate(common, F.lit(0), lambda acc, h: acc + F.least(count(a, h), count(b, h)))
    both = F.when(repeats(F.col(a)) & repeats(F.col(b)), counted).otherwise(F.size(common))
    return both / (F.size(a) + F.size(b) - both)


def _starts(at: str, n: str, need: str) -> Column:
    """Starts of the windows of n that hold need or more of the sorted positions at. Each start goes with the first position it holds."""
    p = F.col(at)
    low = lambda i: F.greatest(F.coalesce(F.get(p, i - 1) + 1, F.lit(0)), F.get(p, i + F.col(need) - 1) - F.col(n) + 1)
    held = lambda i: F.when(low(i) <= F.get(p, i), F.sequence(low(i), F.get(p, i))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(p) - F.col(need)), held))


def benchmark_parts(benchmark: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(item_id, n_words, k, shingles) of each part of an item; k is the shingle's length, less in short items."""
    rows = benchmark.select("item_id", _words(F.col("text")).alias("w")).where(F.size("w") > 0)
    step = F.ceil(F.size("w") / F.ceil(F.size("w") / PART_WORDS)).cast("int")
    rows = rows.select("item_id", "w", step.alias("step")).select("item_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.col("step")), lambda i: F.slice("w", i + 1, F.col("step")))).alias("w"))
    rows = rows.withColumn("k", F.least(F.size("w"), F.lit(shingle_words)))
    by_k = reduce(lambda out, k: F.when(F.col("k") == k, _shingles("w", k)).otherwise(out), range(1, shingle_words), _shingles("w", shingle_words))
    return rows.select("item_id", F.size("w").alias("n_words"), "k", by_k.alias("shingles")).distinct()


def _rare(parts: DataFrame) -> DataFrame:
    """(k, h, part): the shingles of each part of which a window that is alike must hold one.

    A window that shares `need` of n shingles misses n - need at most, so it holds one of any n - need + 1 of them;
    the rarest in the benchmark bring up the fewest documents.
    """
    each = parts.select("part", "k", "n", "need", F.explode("shingles").alias("h"))
    common = each.groupBy("k", "h").agg(F.countDistinct("part").alias("df"))
    ranked = each.join(common, ["k", "h"]).groupBy("part", "k", "n", "need").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("s"))
    return ranked.select("part", "k", F.explode(F.expr("array_distinct(slice(s.h, 1, n - need + 1))")).alias("h"))


def _matches(docs: DataFrame, benchmark: DataFrame, threshold: float, shingle_words: int, radius: int) -> DataFrame | None:
    """(key, doc_id, item_id, start, n_words, similarity) of each window alike to an item; key is a hash of id and text. None for an empty benchmark."""
    parts = benchmark_parts(benchmark.where("item_id is not null"), shingle_words).withColumn("n", F.size("shingles")).withColumn("part", F.xxhash64("k", "shingles"))
    # a of 2n - a shingles in common, a / (2n - a) >= threshold; the small part is for rounding
    parts = stash(parts.withColumn("need", F.greatest(F.lit(1), F.ceil(2 * threshold * F.col("n") / (1 + threshold) - 1e-9)).cast("int")))
    probes, size = _probes(radius), parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("shingles"), F.count("*").alias("parts")).first()
    near = F.broadcast if size["shingles"] <= BROADCAST_ROWS else (lambda df: df)
    beside = F.broadcast if size["parts"] * sum(map(len, probes)) <= BROADCAST_ROWS else (lambda df: df)
    lengths = sorted(r["k"] for r in parts.select("k").distinct().collect())  # shingle_words numbers at most
    if not lengths:
        return None
    kinds = parts.select("part", "k", "n_words", "n", "need").distinct()
    rare = stash(_rare(parts.dropDuplicates(["part"])))
    split = docs.where("text is not null").select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", _words(F.col("text")).alias("w"))
    all_of = lambda parts: reduce(lambda x, y: x.union(y), parts)
    met = all_of([split.select("key", F.explode(F.array_distinct(_shingles("w", k))).alias("h")).join(near(rare.where(F.col("k") == k)), "h").select("key", "part") for k in lengths])
    met = stash(met.distinct())

    # where the shingles of each part that a document met stand in it
    held = split.join(met.select("key").distinct(), "key").dropDuplicates(["key", "doc_id"])
    held = stash(held.select("key", "doc_id", *[_shingles("w", k).alias(f"s{k}") for k in lengths]))
    asked = met.join(kinds, "part").join(near(parts.select("part", F.explode("shingles").alias("h")).distinct()), "part")
    at = all_of([held.select("key", F.lit(k).alias("k"), F.posexplode(f"s{k}").alias("pos", "h")) for k in lengths])
    placed = asked.join(at, ["key", "k", "h"]).groupBy("key", "part", "k", "n_words", "n", "need").agg(F.sort_array(F.collect_set("pos")).alias("at")).where("size(at) >= need")
    pairs = stash(placed.select("key", "part", "k", "n_words", "n", F.explode(_starts("at", "n", "need")).alias("start")))
    starts = pairs.select("key", "k", "n_words", "n", "start").distinct().groupBy("key", "k", "n_words", "n").agg(F.collect_list("start").alias("starts")).groupBy("key").agg(F.collect_list(F.struct("k", "n_words", "n", "starts")).alias("asked"))

    rows = held.join(starts, "key").select("key", "doc_id", F.explode("asked").alias("q"), *[f"s{k}" for k in lengths])
    of_k = reduce(lambda out, k: F.when(F.col("q.k") == k, F.col(f"s{k}")).otherwise(out), lengths, F.array().cast("array<bigint>"))
    rows = rows.select("key", "doc_id", "q.k", "q.n_words", "q.n", of_k.alias("s"), F.explode("q.starts").alias("start")).where("start >= 0 and start + n <= size(s)")
    windows = rows.select("key", "doc_id", "k", "n_words", "start", F.expr("slice(s, start + 1, n)").alias("s"))
    windows = stash(windows.withColumn("f", _fingerprint(F.col("s"))))

    items = stash(parts.dropDuplicates(["part"]).select("part", "k", "n_words", F.col("shingles").alias("t")).withColumn("g", _fingerprint(F.col("t"))))
    # a window is looked up among the blocks of the parts whose shingles it holds; equal fingerprints ask once
    at_window = ["key", "k", "n_words", "start"]
    pairs = stash(pairs.join(windows.select(*at_window, "f").distinct(), at_window).select(*at_window, "part", "f"))
    left = pairs.select("part", "f").distinct().select("*", F.posexplode(_blocks(F.col("f"))).alias("b", "v"))
    right = items.select("part", "g", F.posexplode(F.arrays_zip(_blocks(F.col("g")).alias("v"), F.array(*[F.array(*map(F.lit, m)) for m in probes]).alias("m"))).alias("b", "x"))
    right = right.select("part", "g", "b", F.explode(F.transform("x.m", lambda m: F.col("x.v").bitwiseXOR(m))).alias("v"))
    found = left.join(beside(right), ["part", "b", "v"])
    alike = F.zip_with(_blocks(F.col("f")), _blocks(F.col("g")), lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= radius // BLOCKS)
    once = F.array_position(alike, True) == F.col("b") + 1  # a pair that agrees in several blocks counts in the first
    found = found.where(once & (F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= radius)).select("part", "f")
    found = pairs.join(found, ["part", "f"]).drop("f")
    found = found.join(near(items.select("part", "t")), "part").join(windows.select("key", "doc_id", "k", "n_words", "start", "s"), ["key", "k", "n_words", "start"])
    sure = found.select("key", "doc_id", "part", "start", "n_words", _similarity("s", "t").alias("similarity")).where(F.col("similarity") >= threshold)
    return sure.join(parts.select("part", "item_id").distinct(), "part").drop("part")


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): the best window of a document for each item it holds.

    A window has as many words as the item, or as a part of a long item, and slides by a word. Every window that
    holds as many shingles of a part as the threshold asks for is fingerprinted, in whatever order they stand;
    others can't reach it. Blocks of the fingerprint, with a few bits flipped, find those of the parts whose shingles it
    holds that lie within the radius; the weighted Jaccard similarity of the shingles, threshold or more, decides. Words are runs of
    anything but ASCII white space, in lower case.

    Null, empty and wordless texts have no windows and wordless items no parts. Items of fewer words than a
    shingle are one shingle. Of equal windows the first counts. Rows count by id and text; repeated rows give one
    result, and rows of one id, or without an id, the best of theirs. A null item_id is left out. Other columns
    are ignored; an empty table gives an empty result.
    """
    sure = _matches(docs, benchmark, threshold, shingle_words, radius)
    if sure is None:
        kinds = [df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (benchmark, "item_id"))]
        return docs.sparkSession.createDataFrame([], f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, start_word long, n_words long")
    best = sure.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words")).alias("m"))
    return best.select("doc_id", "item_id", "m.similarity", (-F.col("m.back")).cast("long").alias("start_word"), F.col("m.n_words").cast("long").alias("n_words"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark item; the columns stay as they are.

    Rows count by id and text, so rows without an id go too if they hold one, and another text of the same id stays.
    Null and empty texts stay. Of an empty table, or by an empty benchmark, nothing goes.
    """
    found = _matches(docs, benchmark, THRESHOLD, SHINGLE_WORDS, RADIUS)
    if found is None:
        return docs
    key, doc = fresh(docs, "leak_key", "leak_doc")
    gone = found.select(F.col("key").alias(key), F.col("doc_id").alias(doc)).distinct()
    own = F.xxhash64("doc_id", "text")
    return docs.join(gone, (own == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(doc)), "left_anti").select(docs.columns)
