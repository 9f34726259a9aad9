"""Exact neighbour search over whole tables: pivots, cells and tiles.

A bounded number of rows are pivots.  Every row belongs to the cell of its
nearest pivot, and a cell's rows, sorted by their distance to the pivot, are
packed into tiles of at most ``tile_rows`` rows (a range sort, so a cell that
holds a third of the table is spread over many tasks).  Two rows can only be
within ``r`` of each other if, by the triangle inequality, their distances to a
pivot differ by at most ``r``, and if neither lies farther than ``r`` beyond the
plane that separates their cells' pivots.  Both bounds come from the pivot
distances alone; tiles that may hold neighbours meet tiles of the rows that look
for them in an equi-join on the tile number, and a matrix kernel compares the
two.  Only the pivots, the cells' radii and the tiles' index pass the driver or
a broadcast; rows never do.

Results are exact: bounds carry a slack above rounding, and what the kernel
reports is measured by (x1-y1)^2 + (x2-y2)^2 + ... in feature order.  Rows with a
null, NaN or infinite feature are near nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import cut_lineage

MAX_PIVOTS = 4096
TILE_BYTES = 256 << 10
SLACK = 1e-6
BLOCK_CELLS = 1 << 19


def tile_size(features: int) -> int:
    return max(64, min(2048, TILE_BYTES // (8 * max(features, 1))))


def finite(features: Sequence[str]):
    """True where every feature is a finite number: one predicate, which the
    optimizer does not take apart however many features there are."""
    values = F.array(*(F.col(f).cast("double") for f in features))
    return F.forall(values, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))


def keyed(df: DataFrame, features: Sequence[str], **columns) -> DataFrame:
    """(row, the named columns, x): rows whose features are all finite, numbered
    and written once.  The predicate is written as a column and filters what was
    written: as a filter below the projection that names the features, the
    optimizer would derive 2^features constraints from it."""
    xs = [F.col(f).cast("double") for f in features]
    rows = cut_lineage(df.select(
        F.monotonically_increasing_id().alias("row"),
        *((F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()), F.array(*xs).alias("x"),
        finite(features).alias("_ok")))
    return rows.where("_ok").drop("_ok")


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of an array<double> column as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


@dataclass(frozen=True)
class Pivots:
    points: np.ndarray
    centre: np.ndarray

    @classmethod
    def of(cls, rows: DataFrame, d: int, tile_rows: int) -> Pivots:
        """As many as there are tiles, but at most twice the root of the rows and
        ``MAX_PIVOTS``: the rows of least hash, equal ones once."""
        n = rows.count()
        m = max(1, min(n // tile_rows, 2 * math.isqrt(n), MAX_PIVOTS))
        got = rows.select("row", "x").orderBy(F.xxhash64("row"), "row").limit(m).collect()
        points = np.unique(np.array([r["x"] for r in got], dtype=np.float64).reshape(-1, d), axis=0)
        return cls(points, points.mean(axis=0) if len(points) else np.zeros(d))

    def __len__(self) -> int:
        return len(self.points)

    def blocks(self, rows: int) -> Iterator[slice]:
        """Ranges of rows whose matrix of distances to the pivots stays within ``BLOCK_CELLS`` numbers."""
        step = max(1, BLOCK_CELLS // max(len(self), 1))
        return (slice(lo, min(lo + step, rows)) for lo in range(0, rows, step))

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(products(x - self.centre, self.points - self.centre))

    def scale(self) -> float:
        return float(np.sqrt(((self.points - self.centre) ** 2).sum(axis=1)).max(initial=0.0))

    def slack(self, x: np.ndarray) -> np.ndarray:
        return SLACK * (np.sqrt(((x - self.centre) ** 2).sum(axis=1)) + self.scale())

    def bounds(self, x: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances to the pivots, and a lower bound of the distance to any row
        of each cell; ``near`` and ``far`` are the cells' least and largest radius."""
        dist = self.distances(x)
        home = dist.argmin(axis=1)
        between = self.distances(self.points[home])
        at_home = np.take_along_axis(dist, home[:, None], axis=1)
        plane = np.where(between > SLACK * self.scale(), (dist ** 2 - at_home ** 2) / np.where(between > 0, 2 * between, 1.0), 0.0)
        low = np.maximum(np.maximum(dist - far, near - dist), np.maximum(plane, 0.0))
        return dist, np.maximum(low - self.slack(x)[:, None], 0.0)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances by products (rounding errors relative to the norms)."""
    d2 = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2.0 * (x @ y.T)
    return np.maximum(d2, 0.0, out=d2)


_SCRATCH: dict[tuple, np.ndarray] = {}


def scratch(name: str, rows: int, columns: int, kind=np.float64) -> np.ndarray:
    """A matrix that the next call of this name overwrites: fresh ones of some
    hundred KB for every two tiles cost more in page faults than the products."""
    held = _SCRATCH.get((name, kind))
    if held is None or held.size < rows * columns:
        held = _SCRATCH[name, kind] = np.empty(max(rows * columns, 1), kind)
    return held[:rows * columns].reshape(rows, columns)


def centred(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both about the mean of y, each with its squared norms (scratch)."""
    centre = y.mean(axis=0)
    u, v = np.subtract(x, centre, out=scratch("u", *x.shape)), np.subtract(y, centre, out=scratch("v", *y.shape))
    return u, np.einsum("ij,ij->i", u, u), v, np.einsum("ij,ij->i", v, v)


def squares(u: np.ndarray, uu: np.ndarray, v: np.ndarray, vv: np.ndarray, kind=np.float64) -> np.ndarray:
    """``products`` of rows whose squared norms are known, in one product
    (scratch); those of copies may be just below zero."""
    a, b = scratch("a", len(u), u.shape[1] + 2, kind), scratch("b", len(v), u.shape[1] + 2, kind)
    np.multiply(u, -2.0, out=a[:, :-2], casting="same_kind")
    a[:, -2], a[:, -1] = uu, 1.0
    b[:, :-2], b[:, -2], b[:, -1] = v, 1.0, vv
    return np.dot(a, b.T, out=scratch("squares", len(u), len(v), kind))


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows, summed in feature order."""
    out = np.zeros(len(x))
    for f in range(x.shape[1]):
        diff = x[:, f] - y[:, f]
        out += diff * diff
    return out


def homes(rows: DataFrame, pivots: Pivots, d: int) -> DataFrame:
    """``rows`` with ``cell`` (the nearest pivot) and ``far`` (the distance to it)."""
    schema = T.StructType([*rows.schema, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])
    at = rows.columns.index("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, cell, far = matrix(b.column(at), d), np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for part in pivots.blocks(b.num_rows):
                dist = pivots.distances(x[part])
                cell[part], far[part] = dist.argmin(axis=1), dist.min(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], names=schema.names)

    return rows.mapInArrow(run, schema)


def packed(rows: DataFrame, keys: Sequence[str], carry: Sequence[str], d: int, tile_rows: int, parts: int | None = None) -> DataFrame:
    """Tiles: (keys, tile, n, lo, hi, top, arrays of ``carry`` and of row, x as
    bytes).  A tile holds consecutive rows of equal keys in the order of
    ``far``; lo and hi bound ``far``, top is the largest ``reach`` where the rows
    have one.  The range sort, into ``parts`` ranges where given, may cut any key
    between tasks."""
    order = [*(F.col(k).asc_nulls_first() for k in keys), F.col("far"), F.col("row")]
    reach = "reach" in rows.columns
    columns = [*keys, "far", *(["reach"] if reach else []), "row", *carry, "x"]
    source = rows.select(*columns)
    kinds = {f.name: f.dataType for f in source.schema}
    schema = T.StructType([*(T.StructField(k, kinds[k]) for k in keys), T.StructField("tile", T.LongType()),
                           T.StructField("n", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in ("lo", "hi", "top")),
                           *(T.StructField(c, T.ArrayType(kinds[c])) for c in ("row", *carry)),
                           T.StructField("x", T.BinaryType())])
    arrow = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 33
        held, key, n = [], None, 0

        def tile():
            t = pa.Table.from_batches(held).combine_chunks()
            far = t.column("far").to_numpy()
            top = float(t.column("reach").to_numpy().max()) if reach else math.inf
            x = matrix(t.column("x").combine_chunks(), d)
            values = [*key, number, len(far), float(far[0]), float(far[-1]), top,
                      *(t.column(c).to_pylist() for c in ("row", *carry)), x.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], a) for v, a in zip(values, arrow)], names=schema.names)

        for b in batches:
            if not b.num_rows:
                continue
            change = np.zeros(b.num_rows, bool)
            change[0] = True
            for i in range(len(keys)):
                code = pc.fill_null(b.column(i).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
                change[1:] |= code[1:] != code[:-1]
            starts = [*np.flatnonzero(change).tolist(), b.num_rows]
            for a, z in zip(starts, starts[1:]):
                here = [b.column(i)[a].as_py() for i in range(len(keys))]
                while a < z:
                    if held and (here != key or n == tile_rows):
                        yield tile()
                        held, n, number = [], 0, number + 1
                    take = min(z - a, tile_rows - n)
                    held.append(b.slice(a, take))
                    key, n, a = here, n + take, a + take
        if held:
            yield tile()

    dealt = source.repartitionByRange(parts, *order) if parts else source.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order).mapInArrow(run, schema)


INDEX = ["tile", "lo", "hi"]


def meet(seekers: DataFrame, tiles: DataFrame, pivots: Pivots, within: bool, reach: float | None = None) -> DataFrame:
    """Pairs of tiles that may hold neighbours: same cell, same group where
    ``within``, pivot distances no further apart than the seekers reach.  The
    index (one row per tile) decides; the tiles then meet by number."""
    s = seekers.select(*(F.col(c).alias(f"s_{c}") for c in seekers.columns))
    index = tiles.select("cell", *(["grp"] if within else []), *(["only"] if "only" in tiles.columns else []), *INDEX, "n")
    far = F.lit(reach) if reach is not None else F.col("s_top")
    far = far + SLACK * (F.col("s_hi") + F.col("hi") + pivots.scale())
    on = (F.col("cell") == F.col("s_cell")) & (F.col("s_lo") - F.col("hi") <= far) & (F.col("lo") - F.col("s_hi") <= far)
    if within:
        on = on & (F.col("s_grp").isNull() | (F.col("grp") == F.col("s_grp")))
    if "only" in tiles.columns:  # tiles of one component have nothing for each other
        on = on & F.coalesce(F.col("s_only") != F.col("only"), F.lit(True))
    listed = s.join(index, on).select(*s.columns, F.col("tile").alias("with"), F.col("n").alias("with_n"))
    return listed.join(tiles.drop("cell", "grp", "only", "lo", "hi", "top", "n"), F.col("with") == F.col("tile")).drop("tile")


def seek(rows: DataFrame, d: int, pivots: Pivots, reaching: Callable[[pa.RecordBatch, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``rows`` repeated for each cell they look into: (columns, cell, far).
    ``reaching`` gives per batch the distances to the pivots and which cells."""
    schema = T.StructType([*(f for f in rows.schema if f.name not in ("cell", "far")),
                           T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])
    at = rows.columns.index("x")
    names = [f.name for f in rows.schema]
    kept = [i for i, n in enumerate(names) if n not in ("cell", "far")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in pivots.blocks(whole.num_rows):
                b = whole.slice(part.start, part.stop - part.start)
                dist, wanted = reaching(b, matrix(b.column(at), d))
                i, cell = np.nonzero(wanted)
                for a in range(0, len(i), 4096):
                    part = pa.array(i[a:a + 4096])
                    yield pa.RecordBatch.from_arrays(
                        [*(b.column(k).take(part) for k in kept), pa.array(cell[a:a + 4096], pa.int32()),
                         pa.array(dist[i[a:a + 4096], cell[a:a + 4096]])], names=schema.names)

    return rows.mapInArrow(run, schema)


def radii(cells: DataFrame, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, least and largest radius of the cells (one row per pivot)."""
    n, near, far = np.zeros(m, np.int64), np.full(m, np.inf), np.full(m, -np.inf)
    for r in cells.groupBy("cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():
        n[r["cell"]], near[r["cell"]], far[r["cell"]] = r["n"], r["lo"], r["hi"]
    return n, near, far


# ------------------------------------------------------------------ all pairs within a radius
def _pair_tiles(df: DataFrame, features: Sequence[str], eps: float, id_col: str, tile_rows: int | None) -> DataFrame:
    d = len(features)
    size = tile_rows or tile_size(d)
    rows = keyed(df.where(F.col(id_col).isNotNull()), features, id=id_col)
    pivots = Pivots.of(rows, d, size)
    tiles = cut_lineage(packed(homes(rows, pivots, d), ["cell"], ["id"], d, size))
    if not len(pivots):
        return meet(tiles, tiles, pivots, False, eps)
    n, near, far = radii(tiles, len(pivots))

    def reaching(batch, x):
        dist, low = pivots.bounds(x, near, far)
        home = dist.argmin(axis=1)
        later = np.arange(len(pivots))[None, :] > home[:, None]  # each pair of cells once
        return dist, (low <= eps) & later & (n > 0)

    away = packed(seek(rows, d, pivots, reaching), ["cell"], ["id"], d, size)
    own = meet(tiles, tiles, pivots, False, eps).where("s_tile <= with")
    if len(pivots) == 1:
        return own
    return own.union(meet(away.withColumn("tile", F.lit(-1).cast("long")), tiles, pivots, False, eps))


def near_pairs(df: DataFrame, features: Sequence[str], eps: float, id_col: str, tile_rows: int | None = None) -> DataFrame:
    """(id_a, id_b, distance), id_a < id_b: all pairs of rows within ``eps``."""
    d = len(features)
    kind = df.schema[id_col].dataType
    id_type = to_arrow_type(kind)
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("distance", T.DoubleType())])
    met = _pair_tiles(df, features, eps, id_col, tile_rows).select("s_tile", "with", "s_id", "s_x", "id", "x")
    e2 = float(eps) * float(eps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                x, y = (np.frombuffer(b.column(c)[k].as_py()).reshape(-1, d) for c in (3, 5))
                i, j = candidates(x, y, e2)
                if b.column(0)[k].as_py() == b.column(1)[k].as_py():
                    i, j = i[i < j], j[i < j]
                for lo in range(0, len(i), 65536):
                    p, q = i[lo:lo + 65536], j[lo:lo + 65536]
                    d2 = exact(x[p], y[q])
                    keep = d2 <= e2
                    yield pa.RecordBatch.from_arrays(
                        [b.column(2)[k].values.take(pa.array(p[keep])).cast(id_type), b.column(4)[k].values.take(pa.array(q[keep])).cast(id_type),
                         pa.array(np.sqrt(d2[keep]))], names=schema.names)

    pairs = met.mapInArrow(run, schema)
    return pairs.where(F.col("a") != F.col("b")).select(
        F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), "distance")


def candidates(x: np.ndarray, y: np.ndarray, e2) -> tuple[np.ndarray, np.ndarray]:
    """Indices of pairs whose squared distance may be at most ``e2`` (a number
    or one per row of x)."""
    centre = y.mean(axis=0)
    u, v = x - centre, y - centre
    most = 1e-12 * ((u * u).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None, :])
    limit = np.broadcast_to(np.asarray(e2, dtype=np.float64), (len(x),))[:, None]
    return np.nonzero(products(u, v) <= limit * (1 + 1e-9) + most)


def compared_pairs(df: DataFrame, features: Sequence[str], eps: float, id_col: str, tile_rows: int | None = None) -> int:
    """How many pairs ``near_pairs`` compares (of n * (n - 1) / 2)."""
    met = _pair_tiles(df, features, eps, id_col, tile_rows)
    pairs = F.expr("CASE WHEN s_tile = `with` THEN cast(s_n as long) * (s_n - 1) div 2 ELSE cast(s_n as long) * with_n END")
    return met.agg(F.sum(pairs).alias("p")).first()["p"] or 0


# ------------------------------------------------------------------ tiles against tiles, without a list of pairs
#: Tiles are dealt to at most MEET_PARTS parts of about MEET_TILES tiles or more, in records of CROSS_BYTES; each two parts are a task.
MEET_PARTS, MEET_TILES = 32, 12


def dealt_tiles(rows: DataFrame, pivots: Pivots, d: int, carry: Sequence[str], eps: float, size: int,
                radius: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[DataFrame, tuple]:
    """Tiles of ``rows`` dealt evenly to parts, and the radii of the cells.  What is
    written are records of several tiles: (tile, by tile n, cell, lo, hi and cells, the
    rows' ``carry``, x).  ``cells`` says per cell of ``radius`` (default: of these
    rows) whether a row of the tile may have a row of it within ``eps``."""
    made = cut_lineage(packed(homes(rows, pivots, d), ["cell"], carry, d, size).drop("row", "top"))
    radius = radius or radii(made, len(pivots))
    n, near, far = radius
    schema = T.StructType([*made.schema, T.StructField("cells", T.BinaryType())])
    at = made.columns.index("x")

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                x, cells = _tile_rows(b, k, at, d), np.zeros(len(pivots), bool)
                for part in pivots.blocks(len(x)):
                    cells |= (pivots.bounds(x[part], near, far)[1] <= eps).any(axis=0)
                yield pa.RecordBatch.from_arrays([*b.slice(k, 1).columns, pa.array([(cells & (n > 0)).tobytes()])], names=schema.names)

    listed = {"n": T.IntegerType(), "cell": T.IntegerType(), "lo": T.DoubleType(), "hi": T.DoubleType()}
    record = T.StructType([T.StructField("tile", T.LongType()), *(T.StructField(c, T.ArrayType(k)) for c, k in listed.items()),
                           T.StructField("cells", T.BinaryType()), *(made.schema[c] for c in carry), T.StructField("x", T.BinaryType())])
    arrow = [to_arrow_type(f.dataType) for f in record]

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        found = {c: t.column(c).combine_chunks() for c in t.column_names}
        columns = {"tile": found["tile"][:1], **{c: [found[c].to_pylist()] for c in listed},
                   **{c: [b"".join(found[c].to_pylist())] for c in ("cells", "x")}}
        for c in carry:
            rows = found[c].flatten()
            columns[c] = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
        return pa.RecordBatch.from_arrays([v.cast(kind) if isinstance(v := columns[f.name], pa.Array) else pa.array(v, kind)
                                           for f, kind in zip(record, arrow)], names=record.names)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            for k in range(b.num_rows):
                held.append(b.slice(k, 1))
                rows += b.column(b.schema.get_field_index("n"))[k].as_py()
                if rows * d * 8 >= CROSS_BYTES:
                    yield joined(held)
                    held, rows = [], 0
        if held:
            yield joined(held)

    parts = max(1, min(MEET_PARTS, -(-made.count() // MEET_TILES)))
    return cut_lineage(made.mapInArrow(reach, schema).repartition(parts).mapInArrow(together, record)), radius


def met_records(seekers: DataFrame, tiles: DataFrame, columns: Sequence[str], once: bool) -> DataFrame:
    """Pairs of records: (s_tile, .., s_<columns>, tile, .., columns); each pair of one
    table once where ``once``.  Parts meet parts, read from what was written:
    nothing is shuffled, and a task takes the rows of a part once per record of the other."""
    wanted = ["tile", *_Record.head, *columns]
    s = seekers.select(*(F.col(c).alias(f"s_{c}") for c in wanted)).hint("shuffle_replicate_nl")
    return s.join(tiles.select(*wanted), F.col("s_tile") <= F.col("tile")) if once else s.crossJoin(tiles.select(*wanted))


class _Record:
    """The tiles of a record as it came in a batch, from column ``at`` on."""

    head = ("n", "cell", "lo", "hi", "cells")

    def __init__(self, b: pa.RecordBatch, k: int, at: int, columns: int, d: int):
        self.number = b.column(at)[k].as_py()
        n, self.cell, self.lo, self.hi = (b.column(at + c)[k].values.to_numpy() for c in range(1, 5))
        ends = np.cumsum(n).tolist()
        self.tiles = [slice(z - m, z) for z, m in zip(ends, n.tolist())]
        self.cells = np.frombuffer(b.column(at + 5)[k].as_buffer(), bool).reshape(len(n), -1)
        self.columns = [b.column(at + 6 + c)[k].values for c in range(columns)]
        self.x = np.frombuffer(b.column(at + 6 + columns)[k].as_buffer()).reshape(-1, d)

    def meets(self, other: _Record, eps: float, scale: float) -> list[tuple[int, int]]:
        """Tiles of the two that may hold rows within ``eps``; of one record each two once."""
        far = eps + SLACK * (self.hi[:, None] + other.hi[None, :] + scale)
        near = (self.lo[:, None] - other.hi[None, :] <= far) & (other.lo[None, :] - self.hi[:, None] <= far)
        on = self.cells[:, other.cell] & ((self.cell[:, None] != other.cell[None, :]) | near)
        return np.argwhere(np.triu(on) if self.number == other.number else on).tolist()


def _record_pairs(batches: Iterator[pa.RecordBatch], columns: int, d: int) -> Iterator[tuple[_Record, _Record]]:
    for b in batches:
        for k in range(b.num_rows):
            yield _Record(b, k, 0, columns, d), _Record(b, k, 7 + columns, columns, d)


def within(x: np.ndarray, y: np.ndarray, e2: float) -> np.ndarray:
    """True where the squared distance, summed in feature order, is at most ``e2`` (scratch)."""
    u, uu, v, vv = centred(x, y)
    most = uu.max() + vv.max()
    kind, lost = np.float32, (x.shape[1] + 8) * 2.0 ** -22 * most  # single precision decides, if few pairs are that near to the radius
    if not (lost < 1e-3 * e2 and 1e-20 < most < 1e30):
        kind, lost = np.float64, 1e-12 * most + 1e-9 * e2
    d2 = squares(u, uu, v, vv, kind)
    near = np.less_equal(d2, kind(e2 + 2 * lost), out=scratch("near", *d2.shape, bool))
    band = np.greater(d2, kind(e2 - 2 * lost), out=scratch("band", *d2.shape, bool))
    at = np.flatnonzero(np.logical_and(near, band, out=band))
    for lo in range(0, len(at), 65536):
        p, q = np.divmod(at[lo:lo + 65536], len(y))
        near[p, q] = exact(x[p], y[q]) <= e2
    return near


def _held(column: pa.Array) -> pa.Array:
    """A column without the batch it came in."""
    return column.take(pa.array(np.arange(len(column))))


def _tile_rows(b: pa.RecordBatch, k: int, at: int, d: int) -> np.ndarray:
    return np.frombuffer(b.column(at)[k].as_py()).reshape(-1, d)


def near_counts(tiles: DataFrame, pivots: Pivots, d: int, eps: float) -> DataFrame:
    """(id, n): summed ``copies`` of the rows of other ids within ``eps``, by id;
    ids with none may be left out.  A task sends one count per row it holds, not its pairs."""
    met = met_records(tiles, tiles, ["id", "copies", "x"], True)
    e2, scale = float(eps) * float(eps), pivots.scale()
    kind = tiles.schema["id"].dataType.elementType
    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for one, two in _record_pairs(batches, 2, d):
            itself = one.number == two.number
            code = pa.concat_arrays([r.columns[0] for r in ((one,) if itself else (one, two))]).dictionary_encode().indices.to_numpy()
            more = np.bincount(code)[code] > 1  # ids of several rows: a row has no neighbour of its own id
            (ca, cb), (ma, mb) = ((c[:len(one.x)], c[-len(two.x):]) for c in (code, more))
            for r in (one, two):
                if r.number not in found:
                    found[r.number] = [_held(r.columns[0]), np.zeros(len(r.x), np.int64), r.columns[1].to_numpy().copy()]
            (_, na, wa), (_, nb, wb) = found[one.number], found[two.number]
            for i, j in one.meets(two, eps, scale):
                p, q = one.tiles[i], two.tiles[j]
                near = within(one.x[p], two.x[q], e2)
                if itself and i == j or ma[p].any() and mb[q].any():
                    near &= ca[p][:, None] != cb[q][None, :]
                for n, at, weight, side in ((na, p, wb[q], near), (nb, q, wa[p], near.T))[:1 if itself and i == j else 2]:
                    n[at] += np.count_nonzero(side, axis=1) if (weight == 1).all() else (side @ weight.astype(np.float64)).astype(np.int64)
        for ids, counts, _ in found.values():
            yield pa.RecordBatch.from_arrays([ids.cast(id_type), pa.array(counts)], names=["id", "n"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("n", T.LongType())])
    return met.mapInArrow(run, schema).groupBy("id").agg(F.sum("n").alias("n"))


class _Links:
    """Union-find over the rows of the tiles that a task meets."""

    def __init__(self):
        self.first: dict[int, int] = {}
        self.ids: list[pa.Array] = []
        self.parent = np.zeros(0, np.int64)

    def rows(self, tile: int, ids: pa.Array) -> np.ndarray:
        if tile not in self.first:
            self.first[tile] = len(self.parent)
            self.ids.append(_held(ids))
            self.parent = np.concatenate([self.parent, np.arange(len(self.parent), len(self.parent) + len(ids))])
        return np.arange(self.first[tile], self.first[tile] + len(ids))

    def roots(self, rows: np.ndarray) -> np.ndarray:
        found = self.parent[rows]
        while True:
            above = self.parent[found]
            if (above == found).all():
                self.parent[rows] = found
                return found
            found = above

    def root(self, row: int) -> int:
        while self.parent[row] != row:
            row = int(self.parent[row])
        return row

    def link(self, a: np.ndarray, b: np.ndarray, near: np.ndarray) -> None:
        """Joins rows ``a`` and ``b`` where ``near``: few pairs one by one; else one
        link a row at a time until none leads to another component."""
        if np.count_nonzero(near) <= 4 * (len(a) + len(b)):
            i, j = np.nonzero(near)
            for one, two in zip(a[i].tolist(), b[j].tolist()):
                one, two = self.root(one), self.root(two)
                self.parent[max(one, two)] = min(one, two)
            return
        while True:
            apart = near & (self.roots(a)[:, None] != self.roots(b)[None, :])
            at = np.flatnonzero(apart.any(axis=1))
            if not len(at):
                return
            for i, j in zip(a[at].tolist(), b[apart[at].argmax(axis=1)].tolist()):
                i, j = self.root(i), self.root(j)
                self.parent[max(i, j)] = min(i, j)


def near_links(tiles: DataFrame, pivots: Pivots, d: int, eps: float) -> DataFrame:
    """(src, dst): links between ids with the same components as all pairs of
    rows within ``eps``, each once.  A task sends at most one link per row it holds,
    to the least id of its component in its own part, so that the tasks of a part
    mostly send the same; tiles whose rows are one component already are not compared."""
    met = met_records(tiles, tiles, ["id", "x"], True)
    e2, scale = float(eps) * float(eps), pivots.scale()
    kind = tiles.schema["id"].dataType.elementType
    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, sides = _Links(), {}
        for first, second in _record_pairs(batches, 1, d):
            for side, r in enumerate((first, second)):
                sides[r.number] = sides.get(r.number, 0) | 1 << side
            one, two = (links.rows(r.number, r.columns[0]) for r in (first, second))
            for i, j in first.meets(second, eps, scale):
                p, q = first.tiles[i], second.tiles[j]
                a, b, x, y = one[p], two[q], first.x[p], second.x[q]
                roots = links.roots(np.concatenate([a, b]))
                found, n = np.unique(roots, return_counts=True)
                if len(found) == 1:
                    continue
                apart = roots != found[n.argmax()]  # the rows of the largest component have nothing for each other
                left, right = np.flatnonzero(apart[:len(a)]), np.flatnonzero(apart[len(a):])
                if len(left):
                    links.link(a[left], b, within(x[left], y, e2))
                if len(right) and len(left) < len(a):
                    rest = np.flatnonzero(~apart[:len(a)])
                    links.link(a[rest], b[right], within(x[rest], y[right], e2))
        if links.ids:
            root = links.roots(np.arange(len(links.parent)))
            ids = pa.concat_arrays(links.ids).cast(id_type)
            part = np.zeros(len(root), np.int64)  # a part that meets itself is one
            if 3 not in sides.values():
                part = np.repeat([sides[t] for t in links.first], [len(i) for i in links.ids])
            order = np.empty(len(root), np.int64)
            order[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(root))
            sort = np.lexsort((order, part, root))
            new = np.ones(len(sort), bool)
            new[1:] = (root[sort][1:] != root[sort][:-1]) | (part[sort][1:] != part[sort][:-1])
            least = np.empty(len(root), np.int64)  # the least row of the component in the part
            least[sort] = sort[np.flatnonzero(new)[np.cumsum(new) - 1]]
            heads = sort[new]
            between = heads[1:][root[heads[1:]] == root[heads[:-1]]], heads[:-1][root[heads[1:]] == root[heads[:-1]]]
            at = np.flatnonzero(least != np.arange(len(root)))
            src, dst = (np.concatenate(c) for c in ((at, between[0]), (least[at], between[1])))
            for lo in range(0, len(src), 65536):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(c[lo:lo + 65536])) for c in (src, dst)], names=["src", "dst"])

    return met.mapInArrow(run, T.StructType([T.StructField("src", kind), T.StructField("dst", kind)])).distinct()


def near_least(seekers: DataFrame, tiles: DataFrame, pivots: Pivots, d: int, eps: float, value: str) -> DataFrame:
    """(id, least): by id of ``seekers`` the least ``value`` (a long) of the rows of
    ``tiles`` within ``eps``, where there is one."""
    met = met_records(seekers, tiles.withColumn("copies", F.col(value)), ["id", "copies", "x"], False)
    e2, scale = float(eps) * float(eps), pivots.scale()
    kind = seekers.schema["id"].dataType.elementType
    id_type = to_arrow_type(kind)
    none = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for one, two in _record_pairs(batches, 2, d):
            if one.number not in found:
                found[one.number] = [_held(one.columns[0]), np.full(len(one.x), none)]
            least, values = found[one.number][1], two.columns[1].to_numpy()
            two.number = None  # of another table
            for i, j in one.meets(two, eps, scale):
                p, q = one.tiles[i], two.tiles[j]
                near = within(one.x[p], two.x[q], e2)
                at = np.flatnonzero(near.any(axis=1))
                if len(at):
                    order = np.argsort(values[q], kind="stable")
                    first = near[at][:, order].argmax(axis=1)
                    least[p.start + at] = np.minimum(least[p.start + at], values[q][order][first])
        for ids, least in found.values():
            at = np.flatnonzero(least < none)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)).cast(id_type), pa.array(least[at])], names=["id", "least"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("least", T.LongType())])
    return met.mapInArrow(run, schema).groupBy("id").agg(F.min("least").alias("least"))


# ------------------------------------------------------------------ k nearest rows
def k_nearest(queries: DataFrame, base: DataFrame, features: Sequence[str], k: int, query_id: str, base_id: str,
              group_col: str | None = None, payload: str | None = None, exclude_self: bool = False,
              tile_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(row, rank, id, payload, distance) and (row, id, grp, x): the ``k`` nearest
    rows of ``base`` to each row of ``queries`` (ties by id), and the queries with
    their numbers.

    With ``group_col`` a query sees its own group only (a null group: all rows);
    ``exclude_self`` leaves out the rows of the query's id.  The nearest cells
    that hold more than ``k`` rows give a first bound; then every other cell that
    may hold a nearer row is searched."""
    d = len(features)
    size = tile_rows or tile_size(d)
    grp = F.col(group_col) if group_col else F.lit(None).cast("int")
    rows = keyed(base.where(F.col(base_id).isNotNull()), features, id=base_id, grp=grp,
                 payload=F.col(payload) if payload else F.lit(None).cast("int"))
    asked = keyed(queries, features, id=query_id, grp=grp)
    pivots = Pivots.of(rows, d, size)
    tiles = cut_lineage(packed(homes(rows, pivots, d), ["cell", "grp"], ["id", "payload"], d, size))
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", kinds["id"]),
                           T.StructField("payload", kinds["payload"]), T.StructField("distance", T.DoubleType())])
    m = len(pivots)
    n, near, far = radii(tiles, m)
    id_type, payload_type = to_arrow_type(kinds["id"]), to_arrow_type(kinds["payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in range(b.num_rows):
                row, sid, sx, ids, extra, ys = (b.column(c)[t] for c in range(6))
                x, y = (np.frombuffer(v.as_py()).reshape(-1, d) for v in (sx, ys))
                base_ids, asked_ids = ids.values, sid.values
                rank_of = np.empty(len(y), np.int64)
                rank_of[pc.array_sort_indices(base_ids).to_numpy()] = np.arange(len(y))
                if exclude_self:
                    code = pa.concat_arrays([asked_ids.cast(id_type), base_ids.cast(id_type)]).dictionary_encode().indices
                    code = pc.fill_null(code, -1).to_numpy(zero_copy_only=False)
                    mine, theirs = code[:len(x)], code[len(x):]
                for lo in range(0, len(x), 512):
                    part = x[lo:lo + 512]
                    i, j = nearest_candidates(part, y, k + 1 if exclude_self else k)
                    if exclude_self:
                        other = mine[lo + i] != theirs[j]
                        i, j = i[other], j[other]
                    d2 = np.sqrt(exact(part[i], y[j]))
                    order = np.lexsort((rank_of[j], d2, i))
                    i, j, d2 = i[order], j[order], d2[order]
                    first = np.searchsorted(i, i)  # sorted by query: places within it
                    keep = np.arange(len(i)) - first < k
                    i, j, d2 = i[keep], j[keep], d2[keep]
                    yield pa.RecordBatch.from_arrays(
                        [row.values.take(pa.array(lo + i)), base_ids.take(pa.array(j)).cast(id_type),
                         extra.values.take(pa.array(j)).cast(payload_type), pa.array(d2)], names=schema.names)

    def search(found: DataFrame) -> DataFrame:
        sought = packed(found, ["cell", "grp"], ["id"], d, size)
        return meet(sought, tiles, pivots, group_col is not None).select("s_row", "s_id", "s_x", "id", "payload", "x").mapInArrow(run, schema)

    def best(found: DataFrame) -> DataFrame:
        from pyspark.sql import Window
        place = F.row_number().over(Window.partitionBy("row").orderBy("distance", "id"))
        return found.withColumn("rank", place).where(F.col("rank") <= k)

    if not m:
        return best(search(asked.withColumns({"cell": F.lit(0), "far": F.lit(0.0)}))), asked
    need = k + 1 if exclude_self else k

    def first_cells(x):
        dist = pivots.distances(x)
        order = np.argsort(dist, axis=1)
        held = np.cumsum(n[order], axis=1)
        wanted = np.zeros(dist.shape, bool)
        np.put_along_axis(wanted, order, held - n[order] < need, axis=1)
        return dist, wanted & (n > 0)

    first = cut_lineage(best(search(seek(asked, d, pivots, lambda b, x: first_cells(x)))))
    if m == 1:
        return first, asked
    bound = first.where(F.col("rank") == k).select(F.col("row").alias("of"), F.col("distance").alias("reach"))
    again = asked.join(bound, F.col("row") == F.col("of"), "left").drop("of").withColumn(
        "reach", F.coalesce("reach", F.lit(float("inf"))))
    at = again.columns.index("reach")

    def other_cells(b, x):
        dist, low = pivots.bounds(x, near, far)
        _, seen = first_cells(x)
        reach = b.column(at).to_numpy(zero_copy_only=False)
        return dist, (low <= reach[:, None]) & ~seen & (n > 0)

    second = search(seek(again, d, pivots, other_cells))
    return best(first.drop("rank").union(second)), asked


def nearest_candidates(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of pairs that may be among the ``k`` nearest of each row of x, sorted by row."""
    if not len(y):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    centre = y.mean(axis=0)
    u, v = x - centre, y - centre
    d2 = products(u, v)
    limit = np.partition(d2, min(k, len(y)) - 1, axis=1)[:, min(k, len(y)) - 1]
    slack = 1e-12 * ((u * u).sum(axis=1) + (v * v).sum(axis=1).max())
    return np.nonzero(d2 <= (limit * (1 + 1e-9) + 2 * slack)[:, None])


# ------------------------------------------------------------------ the nearest row of another component
#: Where all pairs may have to meet, rows are dealt to at most CROSS_PARTS parts of CROSS_TILES tiles or more, each a
#: few records of at most CROSS_BYTES; each two parts are a task, which compares their records tile by tile.
CROSS_PARTS, CROSS_TILES, CROSS_BYTES = 32, 8, 8 << 20


def shares(n: int, d: int, size: int) -> tuple[int, int]:
    """Parts, and rows of a record, for ``n`` rows of tiles of ``size`` rows."""
    parts = max(1, min(CROSS_PARTS, -(-n // (CROSS_TILES * size))))
    return parts, max(size, min(-(-n * 5 // (4 * parts)), CROSS_BYTES // (8 * max(d, 1))))


def each_two(records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every two records (column ``tile``) once, each with itself too: (one_tile,
    one_<columns>, two_tile, two_<columns>).  Parts meet parts, read from the
    written records: nothing is shuffled."""
    one, two = (records.select(*(F.col(c).alias(f"{side}_{c}") for c in ("tile", *columns))) for side in ("one", "two"))
    return one.hint("shuffle_replicate_nl").join(two, F.col("one_tile") <= F.col("two_tile"))


def pieces(rows: int, size: int) -> list[slice]:
    return [slice(lo, min(lo + size, rows)) for lo in range(0, rows, size)]


class _Seekers:
    """Rows of a record and the nearest row of another component found so far, for
    the rows outside the component ``idle``."""

    def __init__(self, ids: pa.Array, comps: pa.Array, x: np.ndarray, size: int, idle):
        n = len(x)
        self.ids, self.comps = _held(ids), _held(comps)
        self.seeks = np.ones(n, bool) if idle is None else pc.not_equal(comps, pa.scalar(idle, comps.type)).to_numpy(zero_copy_only=False)
        self.rank = np.empty(n, np.int64)
        self.rank[pc.array_sort_indices(ids).to_numpy()] = np.arange(n)
        self.pieces = [slice(lo, min(lo + size, n)) for lo in range(0, n, size)]
        self.centres = np.array([x[p].mean(axis=0) for p in self.pieces])
        self.radii = np.array([math.sqrt(((x[p] - c) ** 2).sum(axis=1).max()) for p, c in zip(self.pieces, self.centres)])
        self.least, self.record, self.place = np.full(n, np.inf), np.full(n, -1), np.zeros(n, np.int64)

    def reach(self, piece: slice) -> float:
        """Seeking rows of the piece need no row farther than this (none seeks: -1)."""
        return float(self.least[piece][self.seeks[piece]].max(initial=-1.0))

    def take(self, rows: np.ndarray, x: np.ndarray, number: int, others: _Seekers, places: np.ndarray, y: np.ndarray, d2: np.ndarray, slack: np.ndarray,
             held: dict[int, _Seekers]) -> None:
        """``rows`` (features x) meet the rows ``places`` (features y) of record
        ``number``; squared distances are right within ``slack``, infinite within a component."""
        low = d2.min(axis=1)
        near = np.flatnonzero((low <= self.least[rows] ** 2 * (1 + 1e-9) + slack) & np.isfinite(low))
        if not len(near):
            return
        i, j = np.nonzero(d2[near] <= (low[near] * (1 + 1e-9) + slack[near])[:, None])
        i = near[i]
        dist = np.sqrt(exact(x[i], y[j]))
        order = np.lexsort((others.rank[places[j]], dist, i))
        order = order[np.unique(i[order], return_index=True)[1]]
        at, place, dist = rows[i[order]], places[j[order]], dist[order]
        better = dist < self.least[at]
        for k in np.flatnonzero(dist == self.least[at]).tolist():  # ties by the ids
            better[k] = others.ids[place[k]].as_py() < held[self.record[at[k]]].ids[self.place[at[k]]].as_py()
        at = at[better]
        self.least[at], self.record[at], self.place[at] = dist[better], number, place[better]


def _meet_seekers(one: int, two: int, x: np.ndarray, y: np.ndarray, held: dict[int, _Seekers]) -> None:
    """Two records, piece by piece, the nearest pieces first; pieces that hold
    nothing nearer than what was found, or one component, are not compared."""
    a, b = held[one], held[two]
    code = pa.concat_arrays([a.comps, b.comps]).dictionary_encode().indices.to_numpy().astype(np.int32)
    mine, theirs = code[:len(x)], code[len(x):]
    gap = np.sqrt(products(a.centres, b.centres))
    lost = SLACK * (np.sqrt((a.centres ** 2).sum(axis=1))[:, None] + np.sqrt((b.centres ** 2).sum(axis=1))[None, :] + a.radii[:, None] + b.radii[None, :])
    gap -= a.radii[:, None] + b.radii[None, :] + lost
    for k in np.argsort(gap, axis=None, kind="stable").tolist():
        i, j = divmod(k, len(b.pieces))
        p, q = a.pieces[i], b.pieces[j]
        if one == two and j < i:
            continue
        first, second = gap[i, j] <= a.reach(p), gap[i, j] <= b.reach(q) and not (one == two and i == j)
        apart = len(np.intersect1d(mine[p], theirs[q])) == 0
        if not (first or second) or not apart and (mine[p.start] == mine[p]).all() and (mine[p.start] == theirs[q]).all():
            continue
        u, uu, v, vv = centred(x[p], y[q])
        left = np.flatnonzero(a.seeks[p]) if first else np.zeros(0, np.int64)
        right = np.flatnonzero(b.seeks[q]) if second else np.zeros(0, np.int64)
        # rows that seek meet all of the other piece; the rest meets the rows there that seek
        for rows, others, here in ((left, np.arange(len(v)), True), (np.setdiff1d(np.arange(len(u)), left), right, False)):
            if not len(rows) or not len(others):
                continue
            d2 = squares(u[rows], uu[rows], v[others], vv[others])
            if not apart:
                d2[mine[p][rows][:, None] == theirs[q][others][None, :]] = np.inf
            if here:
                a.take(p.start + rows, x[p][rows], two, b, q.start + others, y[q], d2, 2e-12 * (uu[rows] + vv.max()), held)
                d2 = d2[:, right] if len(right) < len(others) else d2
            if len(right):
                b.take(q.start + right, y[q][right], one, a, p.start + rows, x[p][rows], d2.T, 2e-12 * (vv[right] + uu.max()), held)


def nearest_other(rows: DataFrame, d: int, size: int, parts: int, record_rows: int, idle=None) -> DataFrame:
    """(comp, distance, a, b, other): per component of ``rows`` (row, far, id, comp, x) but
    ``idle`` the least pair (distance, smaller id, larger id) of a row in it and one
    outside, and the component of that one.

    Rows in the order of ``far`` are packed into records, and these meet once; what a task passes
    on is one pair per component that it saw.  Pieces of records are compared nearest
    first, and only where a row may find a nearer one."""
    records = cut_lineage(packed(rows, [], ["id", "comp"], d, record_rows, parts)).coalesce(parts)
    met = each_two(records, ["id", "comp", "x"])
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([T.StructField("comp", kinds["comp"]), T.StructField("distance", T.DoubleType()), T.StructField("a", kinds["id"]),
                           T.StructField("b", kinds["id"]), T.StructField("other", kinds["comp"])])
    id_type, comp_type = to_arrow_type(kinds["id"]), to_arrow_type(kinds["comp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Seekers] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                one, two = batch.column(0)[k].as_py(), batch.column(4)[k].as_py()
                x, y = _tile_rows(batch, k, 3, d), _tile_rows(batch, k, 7, d)
                for number, c, z in ((one, 1, x), (two, 5, y)):
                    if number not in held:
                        held[number] = _Seekers(batch.column(c)[k].values.cast(id_type), batch.column(c + 1)[k].values.cast(comp_type), z, size, idle)
                _meet_seekers(one, two, x, y, held)
        if not held:
            return
        start = dict(zip(held, np.cumsum([0, *(len(s.ids) for s in held.values())]).tolist()))
        ids, comps = (pa.concat_arrays([getattr(s, c) for s in held.values()]) for c in ("ids", "comps"))
        least, record, place = (np.concatenate([getattr(s, c) for s in held.values()]) for c in ("least", "record", "place"))
        own = np.flatnonzero(record >= 0)
        other = place[own] + np.array([start[r] for r in record[own].tolist()], np.int64)
        rank, by = np.empty(len(ids), np.int64), pc.array_sort_indices(ids).to_numpy()
        rank[by] = np.arange(len(ids))
        a, b = np.minimum(rank[own], rank[other]), np.maximum(rank[own], rank[other])
        code = comps.dictionary_encode().indices.to_numpy()[own]
        order = np.lexsort((b, a, least[own], code))
        order = order[np.unique(code[order], return_index=True)[1]]
        for lo in range(0, len(order), 65536):
            at = order[lo:lo + 65536]
            yield pa.RecordBatch.from_arrays([comps.take(pa.array(own[at])), pa.array(least[own[at]]), ids.take(pa.array(by[a[at]])),
                                              ids.take(pa.array(by[b[at]])), comps.take(pa.array(other[at]))], names=schema.names)

    edge = F.min(F.struct("distance", "a", "b", "other")).alias("e")
    return met.mapInArrow(run, schema).groupBy("comp").agg(edge).select("comp", "e.distance", "e.a", "e.b", "e.other")
