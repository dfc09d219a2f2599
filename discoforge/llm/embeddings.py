"""Embedding near-duplicates by PCA-ordered tiled comparison."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forest, stash

#: Vectors that fit the axes and cells; these only decide how early a comparison stops, never its result.
SAMPLE = 4096
#: A band of a cell holds about so many bytes of vectors, less where there would be fewer bands than LEAST_BANDS;
#: two bands meet in a task and are compared tile by tile. Larger bands move less: where every direction is alike, a
#: vector moves to all of them.
BAND_BYTES, LEAST_BANDS = 32 << 20, 4
TILE = 1024
#: Axes that cells are cut along and that the first bound takes; each further bound takes twice as many.
LEADING = 16
#: How far a float32 bound may be off.
SLACK = 1e-5
#: Above this share of open pairs a tile goes on whole, below it pair by pair.
OPEN_SHARE = 0.02
#: Sampled vectors that a cell rests on at least.
CELL_SAMPLE = 8


def _usable(kind: str):
    def of_batch(batches):
        """Each vector's length, digest and bytes, of the numbers' own kind; none of these for vectors that can't link."""
        for batch in batches:
            out = []
            for vec_id, v in zip(batch["vec_id"], batch["embedding"]):
                x = None if v is None else np.asarray(v, np.float64) + 0.0
                if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                    out.append((vec_id, 0, None, None, None))
                else:
                    raw = x.astype(kind).tobytes()
                    low, high = np.frombuffer(xxhash.xxh3_128_digest(raw), np.int64)
                    out.append((vec_id, len(x), int(low), int(high), raw))
            yield pd.DataFrame(out, columns=["vec_id", "dim", "low", "high", "vector"]).astype({"low": "Int64", "high": "Int64"})

    return of_batch


def _unit(vectors, kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _axes(sample: pd.DataFrame, kind: str) -> np.ndarray:
    """Columns: the axes by falling second moment."""
    u = _unit(list(sample["vector"]), kind)
    return np.linalg.eigh(u.T @ u)[1][:, ::-1].copy()


def _steps(dim: int) -> list[int]:
    """Numbers of axes after which the bounds are drawn: LEADING, twice that and so on, below the dimension."""
    out = [min(LEADING, dim)]
    while out[-1] * 2 < dim:
        out.append(out[-1] * 2)
    return out


def _suffixes(turned: np.ndarray, steps: list[int]) -> np.ndarray:
    """Norm of what lies behind each step, a column a step."""
    so_far = np.cumsum(turned**2, axis=1)
    return np.sqrt(np.maximum(0, 1 - so_far[:, [n - 1 for n in steps]]))


def _band_vectors(n: int, dim: int) -> int:
    return max(TILE, min(BAND_BYTES // (8 * dim), -(-n // LEAST_BANDS)))


class Cells:
    """Boxes of a space: each cut at the median of a sample along its widest axis, down to `count` boxes."""

    def __init__(self, sample: np.ndarray, count: int):
        self.cuts: list[tuple[int, float, int, int]] = []  # axis, place, and what lies below and above: a cut, or a cell as ~number
        self.count = 0
        self.root = self._cut(sample, count)

    def _cut(self, points: np.ndarray, count: int) -> int:
        axis = int(np.argmax(points.max(axis=0) - points.min(axis=0))) if len(points) else 0
        if count > 1 and len(points) >= 2 * CELL_SAMPLE:
            place = float(np.median(points[:, axis]))
            low = points[:, axis] < place
            if low.any():
                me = len(self.cuts)
                self.cuts.append((axis, place, 0, 0))
                self.cuts[me] = (axis, place, self._cut(points[low], count // 2), self._cut(points[~low], count - count // 2))
                return me
        self.count += 1
        return ~(self.count - 1)

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        at = np.full(len(points), self.root)
        while (inner := at >= 0).any():
            for n in np.unique(at[inner]):
                axis, place, low, high = self.cuts[n]
                own = at == n
                at[own] = np.where(points[own, axis] < place, low, high)
        return ~at


def _coordinates(vectors, kind: str, axes: np.ndarray) -> np.ndarray:
    """Leading coordinates and the norm of the rest: no two vectors lie nearer to each other than these do."""
    turned = _unit(list(vectors), kind) @ axes
    steps = _steps(axes.shape[0])[:1]
    return np.hstack([turned[:, : steps[0]], _suffixes(turned, steps)])


def _boxes(kind: str, axes: np.ndarray, cells: Cells):
    def of_batch(batches):
        """Number and least and greatest coordinates of the vectors of each cell, batch by batch."""
        for batch in batches:
            if len(batch):
                x = _coordinates(batch["vector"], kind, axes)
                cell = cells.of(x)
                for c in np.unique(cell):
                    own = x[cell == c]
                    for k, (lo, hi) in enumerate(zip(own.min(axis=0), own.max(axis=0))):
                        yield pd.DataFrame({"cell": [c], "axis": [k], "n": [len(own)], "lo": [lo], "hi": [hi]})

    return of_batch


def _place(kind: str, axes: np.ndarray, cells: Cells, low: np.ndarray, high: np.ndarray, bands: np.ndarray, reach: float):
    """Each vector with its band, and the bands of all cells whose box holds a point within reach of it."""
    first = np.cumsum(bands) - bands

    def of_batch(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = _coordinates(batch["vector"], kind, axes)
            cell = cells.of(x)
            apart = np.zeros((len(x), len(low)))
            for k in range(x.shape[1]):
                apart += np.maximum(0, np.maximum(low[None, :, k] - x[:, k, None], x[:, k, None] - high[None, :, k])) ** 2
            met = [np.concatenate([np.arange(first[c], first[c] + bands[c]) for c in np.nonzero(row)[0]]) for row in apart <= reach**2]
            own = np.array([xxhash.xxh3_64_intdigest(v) for v in batch["vector"]], np.uint64) % bands[cell].astype(np.uint64)
            yield batch[["vec_id", "n", "vector"]].assign(at=first[cell] + own.astype(np.int64), met=met)

    return of_batch


def _linked(u: np.ndarray, turned: np.ndarray, suffix: np.ndarray, steps: list[int], p: np.ndarray, q: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the rows p and q with cosine of at least threshold.

    Products are summed over the leading axes first. What the rest can add is at most the product of the norms
    behind them; pairs that can't reach the threshold any more are given up at each step, the others are
    multiplied out in double precision.
    """
    least, before, whole = threshold - SLACK, 0, np.float32(0)
    for k, upto in enumerate(steps):
        whole = whole + turned[p, before:upto] @ turned[q, before:upto].T
        open_ = whole + np.outer(suffix[p, k], suffix[q, k]) >= least
        before = upto
        if np.count_nonzero(open_) <= OPEN_SHARE * open_.size:
            break
    else:
        return np.nonzero(u[p] @ u[q].T >= threshold)
    r, c = np.nonzero(open_)
    so_far = whole[r, c]
    for k in range(k + 1, len(steps)):
        so_far = so_far + _products(turned[:, before : steps[k]], p[r], q[c])
        on = so_far + suffix[p[r], k] * suffix[q[c], k] >= least
        r, c, so_far, before = r[on], c[on], so_far[on], steps[k]
    yes = _products(u, p[r], q[c]) >= threshold
    return r[yes], c[yes]


def _products(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows a and b of x, a few at a time."""
    out = [np.einsum("ij,ij->i", x[a[at : at + 20_000]], x[b[at : at + 20_000]]) for at in range(0, len(a), 20_000)]
    return np.concatenate([np.zeros(0, x.dtype), *out])


def _compare(kind: str, axes: np.ndarray, threshold: float):
    def of_group(group: pd.DataFrame) -> pd.DataFrame:
        """Links of one pair of bands: (a, null, n) for each vector with links, (a, b, 0) for a forest of them."""
        u = _unit(list(group["vector"]), kind)
        steps = _steps(u.shape[1])
        turned = u @ axes
        suffix = _suffixes(turned, steps).astype(np.float32)
        turned = turned.astype(np.float32)
        ids, weight, at = group["vec_id"].to_numpy(), group["n"].to_numpy(), group["at"].to_numpy()
        rows, cols = np.nonzero(at == group["bi"].iloc[0])[0], np.nonzero(at == group["bj"].iloc[0])[0]
        same = group["bi"].iloc[0] == group["bj"].iloc[0]
        links = np.zeros(len(group), np.int64)
        trees = [np.zeros((2, 0), np.int64)]
        for i in range(0, len(rows), TILE):
            for j in range(i if same else 0, len(cols), TILE):
                p, q = rows[i : i + TILE], cols[j : j + TILE]
                r, c = _linked(u, turned, suffix, steps, p, q, threshold)
                if same and i == j:
                    r, c = r[r < c], c[r < c]
                np.add.at(links, p[r], weight[q[c]])
                np.add.at(links, q[c], weight[p[r]])
                trees.append(np.array(forest(p[r], q[c]), np.int64).reshape(2, -1))
        a, b = forest(*np.hstack(trees))
        some = np.nonzero(links)[0]
        return pd.DataFrame({"a": np.concatenate([ids[some], ids[a]]), "b": pd.array(np.concatenate([ids[some], ids[b]])), "links": np.concatenate([links[some], np.zeros(len(a), np.int64)])})

    return of_group


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row: all links of cosine >= threshold, 0 < threshold <= 1.

    Vectors equal in all components fall together by a 128-bit digest and count with their number. The others
    fall into cells, boxes along the leading principal axes and the norm behind these, and large cells into bands
    by a hash. Two bands meet in a task, but for vectors whose distance to the other cell's box, as all its
    vectors draw it, is further than linked unit vectors can be. There, tile by tile, products of the leading
    axes are summed up and the norms of the rest bound every cosine, step by step; only pairs that can still reach
    the threshold are multiplied out, in double precision. Counts and a forest of the links leave a task, no list
    of pairs. How often a vector moves depends on how many cells lie within reach of it: few where vectors form
    clusters, up to all bands where every direction is alike.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
    different length don't link, each length has its own axes and a pass of its own. A row with a null vec_id is compared with nothing.
    Repeated vec_ids share a component and its link count. Other columns are ignored; no rows, no result rows.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    number = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    rows = stash(vectors.select("vec_id", "embedding").mapInPandas(_usable(number), f"vec_id {kind}, dim int, low long, high long, vector binary"))
    full = rows.where("dim > 0 and vec_id is not null")
    classes = stash(full.groupBy("dim", "low", "high").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    keyed = full.join(classes.withColumnRenamed("rep", "vec_id"), ["dim", "low", "high", "vec_id"]).dropDuplicates(["dim", "low", "high"])
    reps = stash(keyed.select("dim", "vec_id", "n", "vector"))
    found = None
    for dim, n in sorted((r["dim"], r["n"]) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()):
        own = reps.where(F.col("dim") == dim)
        sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toPandas()
        axes = _axes(sample, number)
        cells = Cells(_coordinates(sample["vector"], number, axes), -(-n // _band_vectors(n, dim)))
        boxes = own.select("vector").mapInPandas(_boxes(number, axes, cells), "cell int, axis int, n long, lo double, hi double")
        boxes = boxes.groupBy("cell", "axis").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toPandas()  # a sample's cells times LEADING + 1
        low, high, bands = np.full((cells.count, boxes["axis"].max() + 1), np.inf), np.full((cells.count, boxes["axis"].max() + 1), -np.inf), np.zeros(cells.count, np.int64)
        low[boxes["cell"], boxes["axis"]], high[boxes["cell"], boxes["axis"]] = boxes["lo"], boxes["hi"]
        bands[boxes["cell"]] = -(-2 * boxes["n"] // (3 * _band_vectors(n, dim)))  # up to half as many again, rather than two small bands
        placed = own.mapInPandas(_place(number, axes, cells, low, high, bands, float(np.sqrt(2 - 2 * threshold)) + 1e-7), f"vec_id {kind}, n long, vector binary, at long, met array<long>")
        met = placed.select("vec_id", "n", "vector", "at", F.explode("met").alias("other"))
        met = met.select("vec_id", "n", "vector", "at", F.least("at", "other").alias("bi"), F.greatest("at", "other").alias("bj"))
        links = met.groupBy("bi", "bj").applyInPandas(_compare(number, axes, threshold), f"a {kind}, b {kind}, links long")
        found = links if found is None else found.union(links)
    same = full.join(classes, ["dim", "low", "high"]).select("vec_id", "rep", "n")
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = stash(found)
    by_rep = found.where("links > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    counts = same.join(by_rep, "rep", "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")).groupBy("vec_id").agg(F.max("links").alias("links"))
    joined = components(found.where("links = 0").select("a", "b").union(same.where("vec_id <> rep").select("vec_id", "rep"))).withColumnRenamed("node", "vec_id")
    out = rows.select("vec_id").join(counts, "vec_id", "left").join(joined, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
