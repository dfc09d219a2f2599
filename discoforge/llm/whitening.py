"""Whitening of embeddings: covariances as sums of centred products, one Spark SQL expression for each pair of dimensions.

The sums of the upper triangle are one aggregation by pairs of blocks of dimensions, so that its code stays small
whatever their number: a task keeps one number for each pair of dimensions and shuffles these. The matrix is put
together and decomposed by LAPACK on the driver, where it grows with the dimensions only, and every row is
projected where it lies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

SCALE, OFFSET = 64, 1_000_000
#: Entries of this size and beyond have no exact integer form; they count like infinite ones.
LARGEST = float(1 << 40)
#: Dimensions in a block: its square is the number of sums in the aggregation, which Spark compiles as one piece up to 100 columns.
BLOCK_DIMS = 8
COMPONENTS = 16


def _integers(embedding: Column) -> Column:
    """floor(64 * c) + 1000000 of each entry; null for a vector that is null or holds a null, infinite or NaN entry."""
    whole = F.forall(embedding, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)))  # Spark ranks NaN above all numbers
    return F.when(whole, F.transform(embedding, lambda c: F.floor(c.cast("double") * SCALE) + OFFSET))


def covariance(rows: DataFrame, centred: Column, d: int, n: int) -> np.ndarray:
    """The covariance matrix, divisor n, of n rows with d numbers in an array column that is centred already."""
    blocks = -(-d // BLOCK_DIMS)
    pairs = F.array(*[F.struct(F.lit(p * BLOCK_DIMS).alias("p"), F.lit(q * BLOCK_DIMS).alias("q")) for p in range(blocks) for q in range(p, blocks)])
    padded = rows.select(F.concat(centred, F.array_repeat(F.lit(0.0), blocks * BLOCK_DIMS - d)).alias("c"))
    values = padded.select("c", F.explode(pairs).alias("at")).selectExpr("at.p", "at.q", *[f"c[at.p + {i}] as a{i}" for i in range(BLOCK_DIMS)], *[f"c[at.q + {i}] as b{i}" for i in range(BLOCK_DIMS)])
    sums = values.groupBy("p", "q").agg(*[F.expr(f"sum(a{i} * b{j})") for i in range(BLOCK_DIMS) for j in range(BLOCK_DIMS)])
    out = np.zeros((blocks * BLOCK_DIMS,) * 2)
    for p, q, *found in sums.collect():  # a row a pair of blocks
        square = np.array(found).reshape(BLOCK_DIMS, BLOCK_DIMS)
        out[p : p + BLOCK_DIMS, q : q + BLOCK_DIMS] = square
        out[q : q + BLOCK_DIMS, p : p + BLOCK_DIMS] = square.T
    return out[:d, :d] / n


class Whitener:
    """Exact sums of the fitted vectors and their leading components; picklable, it goes to the tasks with the function."""

    def __init__(self, n: int, sums: list[int], variances: np.ndarray, axes: np.ndarray):
        self.n = n
        self.whole = [round_half_up(s, n) for s in sums]  # the mean's integer part, so that differences stay small and exact
        self.rest = [s - n * w for s, w in zip(sums, self.whole)]
        self.axes, self.variances = axes, variances
        #: Components with variance beyond rounding; the others aren't whitened.
        self.live = variances > len(sums) * np.finfo(float).eps * max(variances.max(initial=0), 0)

    def centred(self, x: Column) -> Column:
        """x - mean of each dimension: first the whole part, exactly."""
        means = F.array(*[F.struct(F.lit(w).cast("long").alias("whole"), F.lit(r / self.n).alias("rest")) for w, r in zip(self.whole, self.rest)])
        return F.zip_with(x, means, lambda v, m: (v - m["whole"]).cast("double") - m["rest"])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exact; None beyond 64 bits."""
        away = x - np.array(self.whole, np.int64)
        size = ((np.abs(away).astype(float) + 1) ** 2).sum(axis=1) * float(self.n) ** 2
        small = size < 2.0**62
        out = np.empty(len(x), object)
        step = self.n * away[small] - np.array(self.rest, np.int64) if self.n < 1 << 62 else away[small]
        out[small] = (step * step).sum(axis=1)
        for i in np.flatnonzero(~small):
            exact = sum((self.n * int(a) - r) ** 2 for a, r in zip(away[i], self.rest))
            out[i] = exact if exact < 1 << 63 else None
        return list(out)

    def projected(self, x: np.ndarray) -> np.ndarray:
        away = (x - np.array(self.whole, np.int64)) - np.array(self.rest, float) / self.n
        with np.errstate(divide="ignore", invalid="ignore"):
            out = away @ self.axes / np.sqrt(np.where(self.live, self.variances, np.nan))
        return out


def round_half_up(a: int, b: int) -> int:
    return (2 * a + b) // (2 * b)


def fit(vectors: DataFrame, d: int, components: int) -> Whitener:
    """The whitener of rows with an array x of d integers, at least one row."""
    totals = vectors.select(F.posexplode("x")).groupBy("pos").agg(F.count("*"), F.sum(F.col("col").cast("decimal(20,0)"))).orderBy("pos").collect()  # a row a dimension
    n, sums = totals[0][1], [int(r[2]) for r in totals]
    whitener = Whitener(n, sums, np.zeros(d), np.zeros((d, 0)))
    values, axes = np.linalg.eigh(covariance(vectors, whitener.centred(F.col("x")), d, n))
    order = np.argsort(-values, kind="stable")
    total = float(values.sum())
    out = Whitener(n, sums, values[order][:components], axes[:, order][:, :components])
    out.explained = [float(v) / total if total > 0 else None for v in out.variances]
    return out


def _matrix(column: pa.ListArray, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _scores(whitener: Whitener):
    """Arrow batches of (x) to arrays of the live components."""

    def of_batches(batches):
        for b in batches:
            w = whitener.projected(_matrix(b.column(0), len(whitener.whole)))[:, whitener.live]
            offsets = np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, w.ravel())], ["w"])

    return of_batches


def _whitened(whitener: Whitener, error: float | None):
    def of_batches(batches):
        k = len(whitener.variances)
        explained = np.array(whitener.explained, object)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                x = _matrix(part.column(1), len(whitener.whole))
                rows = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(rows)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(rows), whitener.n)),
                        pa.array([v for v in whitener.deviations(x) for _ in range(k)], pa.int64()),
                        pa.array(whitener.projected(x).ravel(), from_pandas=True),
                        pa.array(list(np.tile(explained, len(x))), pa.float64()),
                        pa.array([error] * len(rows), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return of_batches


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row and leading component.

    Entries become integers, floor(64 * c) + 1000000; each distinct vector of them is fitted once. Covariances are
    over these, divisor n; components are numbered by falling variance. deviation is the exact sum of (n*x - S)^2
    over dimensions, null beyond 64 bits; identity_error is the largest entry of the whitened covariance less the
    identity, over the fitted vectors.

    Rows whose vector is null or holds null, infinite or NaN entries, or entries of 2^40 and beyond, are left out,
    and so are vectors of another length than most have (of equally common lengths the greatest counts) and empty ones.
    A vec_id may be null or repeated: each row gives its rows, rows that are alike are fitted once. Components
    without variance have whitened null; where no vector differs from another explained is null too, and so is
    identity_error where no component has variance. A table with fewer dimensions than components gives as many
    as there are. Variances that tie may come in any order. Other columns are ignored; no usable rows, no result rows.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    out_schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    usable = vectors.select("vec_id", _integers(F.col("embedding")).alias("x")).where("size(x) > 0")
    lengths = usable.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("d")).head(1)
    if not lengths:
        return vectors.sparkSession.createDataFrame([], out_schema)
    d = lengths[0]["d"]
    usable = usable.where(F.size("x") == d)
    fitted = stash(usable.select("x").distinct())  # copies fall together in each task before the shuffle
    whitener = fit(fitted, d, components)
    error = None
    if (live := int(whitener.live.sum())) > 0:
        scores = fitted.mapInArrow(_scores(whitener), "w array<double>")
        means = [r[1] for r in scores.select(F.posexplode("w")).groupBy("pos").agg(F.avg("col")).orderBy("pos").collect()]
        away = F.zip_with("w", F.array(*map(F.lit, means)), lambda w, m: w - m)
        error = float(np.abs(covariance(scores, away, live, whitener.n) - np.eye(live)).max())
    return usable.mapInArrow(_whitened(whitener, error), out_schema)
