"""Candidate indexes: which texts lie in which others, and which keys are alike, without comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _grams(text: Column, n: Column | int) -> Column:
    """The runs of n characters of a text."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))


def contained(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """(block, part, whole): each text of parts with the texts of wholes, both (block, text), that hold it; each pair once. Blank texts are in none.

    A part asks for one run of its characters, half of it at least: of the runs as long as the greatest power of two in its
    length the one that the fewest wholes of its block have; what that finds is tested. So a whole is indexed under its
    runs of the lengths that some part asks for, a few, and numbers in titles don't meet by a few digits.
    Joins are by sorting: rows grow by their runs, which Spark's estimate for a broadcast leaves out.
    """
    parts_of = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    length = F.expr("cast(shiftleft(1, length(bin(length(part))) - 1) as int)")
    asked = parts.select("block", F.col("text").alias("part")).where("part <> '' and block is not null").distinct().withColumn("n", length)
    held = wholes.select("block", F.col("text").alias("whole")).where("whole <> '' and block is not null").distinct().repartition(parts_of, "block", "whole")  # small tables too: their runs are many
    lengths = [r[0] for r in asked.select("n").distinct().collect()]  # 31 at most
    keys = lambda grams: F.array_distinct(F.transform(grams, lambda g: F.xxhash64("block", g)))
    runs = F.flatten(F.array(*[F.when(F.length("whole") >= n, _grams(F.col("whole"), n)).otherwise(F.array().cast("array<string>")) for n in lengths] or [F.array().cast("array<string>")]))
    postings = held.select("block", "whole", F.explode(keys(runs)).alias("gram"))
    counts = postings.groupBy("gram").agg(F.count("*").alias("held"))
    tried = asked.repartition(parts_of, "block", "part").select("block", "part", F.explode(keys(_grams(F.col("part"), F.col("n")))).alias("gram"))
    rarest = tried.join(counts.hint("merge"), "gram").groupBy("block", "part").agg(F.min_by("gram", F.struct("held", "gram")).alias("gram"))
    found = postings.select(F.col("block").alias("_in"), "whole", "gram")
    return rarest.join(found.hint("merge"), "gram").where((F.col("block") == F.col("_in")) & F.contains("whole", "part")).select("block", "part", "whole")


def _edits(length: str, threshold: float) -> str:
    """SQL: most edits between a key of a length and one that is alike."""
    return f"cast(floor({1 - threshold:.6f}D * floor({length} / {threshold:.6f}D + 1e-9D) + 1e-9D) as int)"


def alike_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(block, a, b): keys of left and right, both (block, text), of a block with 1 - distance / longer length >= threshold; each pair once.

    A right key is cut into one piece more than it may have edits, so one piece of it stands unchanged in any
    key that is alike, as many places off as there may be edits at most. Pieces with their place are the join
    keys, and pairs that meet are measured.
    """
    pieces = f"""transform(sequence(0, {_edits('length(b)', threshold)}), i -> named_struct('l', length(b), 'i', i,
      's', substring(b, cast(i * length(b) div ({_edits('length(b)', threshold)} + 1) as int) + 1,
        cast((i + 1) * length(b) div ({_edits('length(b)', threshold)} + 1) - i * length(b) div ({_edits('length(b)', threshold)} + 1) as int))))"""
    lengths = f"sequence(cast(ceil({threshold:.6f}D * length(a) - 1e-9D) as int), cast(floor(length(a) / {threshold:.6f}D + 1e-9D) as int))"
    # a piece from `at`, of `n` letters, may stand from `low` to `high` of the other key
    shapes = f"""flatten(transform({lengths}, l -> transform(sequence(0, {_edits('l', threshold)}), i -> named_struct('l', l, 'i', i, 'far', {_edits('l', threshold)},
      'at', cast(i * l div ({_edits('l', threshold)} + 1) as int), 'n', cast((i + 1) * l div ({_edits('l', threshold)} + 1) - i * l div ({_edits('l', threshold)} + 1) as int)))))"""
    low, high = "greatest(0, x.at - x.far)", "least(length(a) - x.n, x.at + x.far)"
    probes = f"""flatten(transform(filter({shapes}, x -> {low} <= {high}), x -> transform(sequence({low}, {high}), p -> named_struct('l', x.l, 'i', x.i, 's', substring(a, p + 1, x.n)))))"""
    held = right.select("block", F.col("text").alias("b")).distinct().select("block", "b", F.explode(F.expr(pieces)).alias("piece"))
    asked = left.select("block", F.col("text").alias("a")).distinct().select("block", "a", F.explode(F.array_distinct(F.expr(probes))).alias("piece"))
    met = asked.join(held.hint("merge"), ["block", "piece"]).select("block", "a", "b").distinct()
    longest = F.greatest(F.length("a"), F.length("b"))
    return met.where((longest == 0) | (1 - F.levenshtein("a", "b") / longest >= threshold))


def distance(a: str, b: str) -> int:
    """Edit distance, a column of the table at a time as the bits of two numbers."""
    if not a:
        return len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, last, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0  # where a cell is one more, or one less, than the one above
    for c in b:
        match = at.get(c, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        more, less = down | ~(diagonal | up), diagonal & up
        score += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & full, (less << 1) & full
        up, down = (less | ~(diagonal | more)) & full, more & diagonal
    return score


class Alike:
    """Keys with members in order of number; finds the key most like another.

    Up to SCAN keys are all compared. Beyond, keys are cut into one piece more than they may have edits, so that
    one piece of any key that is alike stands unchanged in the other, not far from its place.
    """

    SCAN = 200

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.least: dict[str, int] = {}
        self.pieces: dict[tuple[int, int, str], list[str]] = {}
        self.lengths: set[int] = set()

    def _edits(self, length: int) -> int:
        """Most edits between a key of this length and one that is alike."""
        return int((1 - self.threshold) * int(length / self.threshold + 1e-9) + 1e-9)

    def _cuts(self, length: int) -> list[tuple[int, int]]:
        n = self._edits(length) + 1
        return [(i * length // n, (i + 1) * length // n) for i in range(n)]

    def add(self, key: str, number: int) -> None:
        if key in self.least:
            self.least[key] = min(self.least[key], number)
            return
        self.least[key] = number
        self.lengths.add(len(key))
        for i, (a, b) in enumerate(self._cuts(len(key))):
            self.pieces.setdefault((len(key), i, key[a:b]), []).append(key)

    def drop(self, key: str) -> None:
        del self.least[key]
        for i, (a, b) in enumerate(self._cuts(len(key))):
            self.pieces[len(key), i, key[a:b]].remove(key)

    def _candidates(self, key: str):
        if len(self.least) <= self.SCAN:
            return self.least
        out = set()
        for length in self.lengths:
            if min(length, len(key)) < self.threshold * max(length, len(key)) - 1e-9:
                continue
            far = self._edits(length)
            for i, (a, b) in enumerate(self._cuts(length)):
                for start in range(max(0, a - far), min(len(key) - (b - a), a + far) + 1):
                    out.update(self.pieces.get((length, i, key[start : start + b - a]), ()))
        return out

    def best(self, key: str) -> int | None:
        """The number of the most similar key of the threshold or more; of equal ones the least number."""
        if key in self.least:
            return self.least[key]
        found = (0.0, 0, None)
        for other in self._candidates(key):
            longest = max(len(key), len(other))
            if abs(len(key) - len(other)) <= (1 - self.threshold) * longest + 1e-9:
                score = 1 - distance(key, other) / longest
                if score >= self.threshold:
                    found = max(found, (score, -self.least[other], self.least[other]), key=lambda x: x[:2])
        return found[2]
