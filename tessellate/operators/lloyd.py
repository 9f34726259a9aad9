"""Passes over all rows for many centre models at once.

A model assigns a row to one of its cells (the nearest of k centres, or a leaf
of a binary tree of centres).  One pass is one job for all models together:
every task adds up counts, sums and squared distances by cell, and only these
cross a shuffle.  So a sweep over k and restarts costs as many jobs as its
slowest model needs rounds, not the sum over all of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .metric import matrix
from .sample import portable_hash

START_SAMPLE = 2048


@dataclass(frozen=True)
class Flat:
    """k centres; ties go to the lowest."""
    centres: np.ndarray

    @property
    def cells(self) -> int:
        return len(self.centres)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and squared distance of each row, summed in feature order."""
        best, cell = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
        for j, c in enumerate(self.centres):
            d2 = np.zeros(len(x))
            for f in range(x.shape[1]):
                diff = x[:, f] - c[f]
                d2 += diff * diff
            nearer = d2 < best
            best[nearer], cell[nearer] = d2[nearer], j
        return cell, best

    def cell(self, x: np.ndarray, at: Moved) -> np.ndarray:
        """Cell of each row as ``assign`` gives it: by one product with the
        centres; rows whose two nearest are within rounding are measured."""
        c = self.centres - at.shift
        norms = (c * c).sum(axis=1)
        score = c @ at.x
        score -= 0.5 * norms[:, None]
        best, second = score[0].copy(), np.full(len(x), -np.inf)
        cell, low = np.zeros(len(x), np.int8 if len(c) < 128 else np.int64), np.empty(len(x))
        for j in range(1, len(c)):
            np.copyto(cell, j, where=score[j] > best)
            np.minimum(best, score[j], out=low)
            np.maximum(second, low, out=second)
            np.maximum(best, score[j], out=best)
        best -= second
        unsure = np.flatnonzero(~(best > 1e-12 * (at.norms + norms.max())))
        if len(unsure):
            cell[unsure] = self.assign(x[unsure])[0]
        return cell


@dataclass(frozen=True)
class Moved:
    """Rows by feature, moved by ``shift``, and their squared norms."""
    shift: np.ndarray
    x: np.ndarray
    norms: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, shift: np.ndarray) -> Moved:
        moved = np.ascontiguousarray((x - shift).T)
        return cls(shift, moved, (moved * moved).sum(axis=0))


@dataclass(frozen=True)
class Tree:
    """A binary tree of centres: from the root to the nearer child (the left one
    on ties) until a node has none (``left`` is -1)."""
    centres: np.ndarray
    left: np.ndarray
    right: np.ndarray

    @property
    def cells(self) -> int:
        return len(self.centres)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node = np.zeros(len(x), np.int64)
        while True:
            at = np.flatnonzero(self.left[node] >= 0)
            if not len(at):
                diff = x - self.centres[node]
                return node, (diff * diff).sum(axis=1)
            a, b = self.left[node[at]], self.right[node[at]]
            da, db = (((x[at] - self.centres[c]) ** 2).sum(axis=1) for c in (a, b))
            node[at] = np.where(da <= db, a, b)

    def cell(self, x: np.ndarray, at: Moved) -> np.ndarray:
        return self.assign(x)[0]


@dataclass
class Totals:
    """Per cell: rows, squared distances to its centre, sums and squares of the features."""
    n: np.ndarray
    cost: np.ndarray
    sums: np.ndarray
    squares: np.ndarray


BLOCK_ROWS, PASS_ROWS = 256, 8192


def in_blocks(rows: DataFrame, d: int) -> DataFrame:
    """``rows`` (a column x of d features) as blocks of at most ``BLOCK_ROWS`` rows,
    their features as bytes, written once for many passes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.ascontiguousarray(matrix(b.column(0), d))
            yield pa.RecordBatch.from_arrays([pa.array([x[k:k + BLOCK_ROWS].tobytes() for k in range(0, len(x), BLOCK_ROWS)], pa.binary())], names=["x"])

    return cut_lineage(rows.select("x").mapInArrow(run, "x binary"))


def _features(column: pa.Array, d: int) -> Iterator[np.ndarray]:
    """Rows of a column of arrays or of blocks, at most ``PASS_ROWS`` at a time."""
    if pa.types.is_binary(column.type):
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
        x = np.frombuffer(column.buffers()[2])[ends[0] // 8:ends[-1] // 8].reshape(-1, d) if len(column) else np.zeros((0, d))
    else:
        x = matrix(column, d)
    for lo in range(0, len(x), PASS_ROWS):
        yield x[lo:lo + PASS_ROWS]


def totals(rows: DataFrame, models: Sequence, d: int, whole: bool = True) -> list[Totals]:
    """One pass over ``rows`` (a column x of d features, or ``in_blocks``) for all
    models; counts and sums only unless ``whole``."""
    if not models:
        return []
    width = 2 * d + 1 if whole else d + 1

    def empty(m):
        return Totals(np.zeros(m.cells, np.int64), np.zeros(m.cells), np.zeros((m.cells, d)), np.zeros((m.cells, d)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [empty(m) for m in models]
        shift = np.concatenate([m.centres for m in models]).mean(axis=0)
        for b in batches:
            for x in _features(b.column(0), d):
                if not whole:
                    at, counted = Moved.of(x, shift), np.column_stack([np.ones(len(x)), x])
                    for m, t in zip(models, found):
                        cell = m.cell(x, at)
                        part = (cell == np.arange(m.cells, dtype=cell.dtype)[:, None]).astype(np.float64) @ counted
                        t.n += part[:, 0].astype(np.int64)
                        t.sums += part[:, 1:]
                    continue
                for m, t in zip(models, found):
                    cell, d2 = m.assign(x)
                    t.n += np.bincount(cell, minlength=m.cells)
                    t.cost += np.bincount(cell, weights=d2, minlength=m.cells)
                    for f in range(d):
                        t.sums[:, f] += np.bincount(cell, weights=x[:, f], minlength=m.cells)
                        t.squares[:, f] += np.bincount(cell, weights=x[:, f] * x[:, f], minlength=m.cells)
        out = [(i, int(c), int(t.n[c]), [float(t.cost[c]), *t.sums[c].tolist(), *(t.squares[c].tolist() if whole else [])])
               for i, t in enumerate(found) for c in np.flatnonzero(t.n)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64())))],
            names=["model", "cell", "n", "v"])

    parts = rows.select("x").mapInArrow(run, "model int, cell int, n long, v array<double>")
    summed = parts.groupBy("model", "cell").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("v")[i]) for i in range(width))).alias("v"))
    out = [empty(m) for m in models]
    for r in summed.collect():  # one row per cell of each model
        t, c = out[r["model"]], r["cell"]
        t.n[c], t.cost[c], t.sums[c] = r["n"], r["v"][0], r["v"][1:d + 1]
        if whole:
            t.squares[c] = r["v"][d + 1:]
    return out


def means(t: Totals, centres: np.ndarray) -> np.ndarray:
    """Mean of each cell; an empty cell keeps its centre."""
    return np.where(t.n[:, None] > 0, t.sums / np.maximum(t.n, 1)[:, None], centres)


def lloyd_many(rows: DataFrame, d: int, starts: Sequence[np.ndarray], max_iter: int,
               least_shift: float | None = None) -> list[tuple[np.ndarray, float]]:
    """(centres, inertia) of each start after at most ``max_iter`` rounds, all in
    the same jobs.  A model stops when its centres move by no more than
    ``least_shift`` (squared, summed); None: after ``max_iter`` rounds."""
    centres, live = [np.asarray(s, dtype=np.float64) for s in starts], list(range(len(starts)))
    rows = in_blocks(rows, d)
    for _ in range(max_iter):
        if not live:
            break
        moved = []
        for i, t in zip(live, totals(rows, [Flat(centres[i]) for i in live], d, False)):
            new = means(t, centres[i])
            if least_shift is None or float(((new - centres[i]) ** 2).sum()) > least_shift:
                moved.append(i)
            centres[i] = new
        live = moved
    return [(c, float(t.cost.sum())) for c, t in zip(centres, totals(rows, [Flat(c) for c in centres], d))]


def start_sample(rows: DataFrame, d: int, seed: int, n: int = START_SAMPLE) -> np.ndarray:
    """At most ``n`` rows (with an id), those of least hash, in that order."""
    got = rows.select(portable_hash("id", seed).alias("h"), "id", "x").orderBy("h", "id").limit(n).select("x").collect()
    return np.array([r["x"] for r in got], dtype=np.float64).reshape(-1, d)


def spread_centres(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k rows of a sample, each drawn with a chance in proportion to its squared
    distance from those before (k-means++); copies only when nothing else is left."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(sample)))]
    d2 = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        total = d2.sum()
        chosen.append(int(rng.choice(len(sample), p=d2 / total)) if total > 0 else len(chosen) % len(sample))
        d2 = np.minimum(d2, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]
