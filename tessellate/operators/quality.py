"""Cluster-quality metrics.

Silhouette is the plain-Euclidean one (not Spark ML's squared-distance
approximation).  It is quadratic by definition, so the caller says on how many
rows it is computed (a reproducible sample, or None for all): tiles of rows meet
in a join, and a matrix kernel sums the distances of each pair of tiles.

Davies-Bouldin and inertia are linear: two aggregate jobs over all rows plus
k x k centre arithmetic.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from ..functions.columns import bounded_broadcast, present, rnd
from .assign import _sq_dist, centroids_of, pairwise_centroids
from ..session import cut_lineage
from .lloyd import Flat, totals
from .metric import centred, each_two, exact, keyed, packed, scratch, shares, squares, tile_size
from .sample import uniform_sample

def _tile_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of the rows of two tiles; where products lose the difference
    in rounding, measured feature by feature (``scratch``)."""
    u, uu, v, vv = centred(x, y)
    d2 = squares(u, uu, v, vv)
    at = np.flatnonzero(np.less(d2, 1e-5 * (uu.max() + vv.max()), out=scratch("near", *d2.shape, bool)))
    for lo in range(0, len(at), 65536):
        p, q = np.divmod(at[lo:lo + 65536], len(y))
        lost = d2[p, q] < 1e-5 * (uu[p] + vv[q])
        p, q = p[lost], q[lost]
        d2[p, q] = exact(x[p], y[q])
    return np.sqrt(d2, out=d2)


def _numbered_tiles(tiles: DataFrame) -> tuple[DataFrame, int]:
    """Tiles numbered from 0 without gaps, and how many there are."""
    spans = [(r["part"], r["n"]) for r in tiles.groupBy(F.shiftright("tile", 33).alias("part")).agg(
        F.count(F.lit(1)).alias("n")).orderBy("part").collect()]  # one row per partition
    starts = dict(zip((part for part, _ in spans), np.cumsum([0, *(n for _, n in spans)]).tolist()))
    first = F.create_map(*(F.lit(v) for kv in starts.items() for v in kv)) if starts else F.create_map(F.lit(0), F.lit(0))
    part = F.shiftright("tile", 33)
    number = (F.col("tile") - F.shiftleft(part, 33) + first[part]).cast("long")
    return tiles.withColumn("tile", number), sum(n for _, n in spans)


def _tile_pairs(tiles: DataFrame, total: int) -> DataFrame:
    """Every pair of tiles once (one <= two): each tile is listed with the
    numbers it meets, and the others come to it by number."""
    one = tiles.select(F.col("tile").alias("one"), *(F.col(c).alias(f"one_{c}") for c in tiles.columns if c != "tile"),
                       F.explode(F.sequence(F.col("tile"), F.lit(max(total - 1, 0)).cast("long"))).alias("two"))
    return one.join(tiles, F.col("two") == F.col("tile"))


def silhouettes_of(rows: DataFrame, models: Sequence[np.ndarray], d: int, tile_rows: int | None = None) -> list[float]:
    """Mean silhouette of ``rows`` (row, x) under several sets of centres (fewer
    than two clusters with rows: -1.0).  The distances of each pair of tiles are
    computed once for all of them."""
    flats = [Flat(np.asarray(c)) for c in models]
    if not flats:
        return []
    tiles = cut_lineage(packed(rows.select("row", "x", F.lit(0.0).alias("far")), [], [], d, tile_rows or tile_size(d)).select("tile", "x"))
    sizes = [t.n for t in totals(rows, flats, d)]
    tiles, total = _numbered_tiles(tiles)
    width = sum(f.cells for f in flats)

    def members(x):
        sheet, at = np.zeros((len(x), width)), 0
        for f in flats:
            sheet[np.arange(len(x)), at + f.assign(x)[0]] = 1.0
            at += f.cells
        return sheet

    def meet(batches):
        for b in batches:
            for k in range(b.num_rows):
                one, two = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                x, y = (np.frombuffer(b.column(c)[k].as_py()).reshape(-1, d) for c in (2, 3))
                dist = _tile_distances(x, y)
                if one == two:
                    np.fill_diagonal(dist, 0.0)
                sums = [(one, dist @ members(y))] + ([(two, dist.T @ members(x))] if one != two else [])
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in sums]), pa.array([s.tobytes() for _, s in sums], pa.binary())],
                                                 names=["tile", "sums"])

    met = _tile_pairs(tiles, total).select("one", "two", "one_x", "x").mapInArrow(meet, "tile long, sums binary")
    gathered = tiles.withColumn("sums", F.lit(None).cast("binary")).unionByName(met.withColumn("x", F.lit(None).cast("binary"))) \
                    .select("tile", "x", "sums").repartition("tile").sortWithinPartitions("tile", F.col("x").isNull())

    def result(x, sums):
        at = 0
        for m, (f, n) in enumerate(zip(flats, sizes)):
            own = f.assign(x)[0]
            part = sums[:, at:at + f.cells]
            at += f.cells
            mine = np.take_along_axis(part, own[:, None], axis=1)[:, 0]
            other = np.where(n[None, :] > 0, part / np.maximum(n, 1)[None, :], np.inf)
            other[np.arange(len(x)), own] = np.inf
            a, b = mine / np.maximum(n[own] - 1, 1), other.min(axis=1)
            most = np.maximum(a, b)
            good = (n[own] > 1) & (most > 0) & np.isfinite(b)
            yield m, float(np.where(good, (b - a) / np.where(good, most, 1.0), 0.0).sum()), len(x)

    def score(batches):
        x, sums, out = None, None, []
        for b in batches:
            for k in range(b.num_rows):
                if b.column(1)[k].is_valid:
                    if x is not None:
                        out += result(x, sums)
                    x = np.frombuffer(b.column(1)[k].as_py()).reshape(-1, d)
                    sums = np.zeros((len(x), width))
                else:
                    sums += np.frombuffer(b.column(2)[k].as_py()).reshape(len(x), width)
        if x is not None:
            out += result(x, sums)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.float64()),
                                          pa.array([r[2] for r in out], pa.int64())], names=["model", "s", "n"])

    found = {r["model"]: r["s"] / r["n"] for r in gathered.mapInArrow(score, "model int, s double, n long")
             .groupBy("model").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}
    return [float(found.get(m, 0.0)) if (n > 0).sum() > 1 else -1.0 for m, n in enumerate(sizes)]


def silhouette_samples(df: DataFrame, label_col: str, features: Sequence[str], id_col: str,
                       sample_size: int | None = None, seed: int = 42,
                       drop_noise: bool = True, noise: int = -1, tile_rows: int | None = None) -> DataFrame:
    """M1: per-row silhouette on a reproducible sample of ``sample_size`` rows
    (None: all rows; also all if the table is smaller).

    Returns (id, cluster, a, b, silhouette); a excludes the point itself, a
    singleton cluster scores 0.  Rows without a label or with a null, NaN or
    infinite feature have no distances and are left out.

    The metric is quadratic in the sample.  The rows, sorted by label, are packed
    into records, these dealt to a bounded number of parts.  A task meets two
    parts, each pair of records once, read from what was written (no shuffle), and
    compares them tile by tile: a matrix kernel gives both tiles the sums of
    distances by label.  What a task passes on is one state per tile, so the rows
    are shuffled at most ``metric.CROSS_PARTS`` times as short sums, however many
    pairs they make: labels that a task saw whole leave their least mean only.  No
    row reaches the driver; a task holds two parts and the sums of their rows."""
    fs = present(df, features)
    d = len(fs)
    size = tile_rows or tile_size(d)
    src = df.where(F.col(label_col).isNotNull())
    if drop_noise:
        src = src.where(F.col(label_col) != noise)
    if sample_size is not None:
        src = uniform_sample(src.select(id_col, label_col, *fs), sample_size, id_col, seed)
    label = F.col(label_col).cast("long")
    rows = keyed(src, fs, id=id_col, label=label, far=label.cast("double"))
    parts, record_rows = shares(rows.count(), d, size)
    sizes = bounded_broadcast(rows.groupBy("label").agg(F.count(F.lit(1)).alias("of")))
    records = cut_lineage(packed(rows.join(sizes, "label"), [], ["id", "label", "of"], d, record_rows, parts).select("tile", "id", "label", "of", "x"))
    met = each_two(records.coalesce(parts), ["label", "of", "x"])
    partial = "tile long, piece int, near binary, own binary, n_own binary, labels array<long>, counts array<long>, sums binary"

    def meet(batches):
        held: dict[int, list[_Tile]] = {}
        for b in batches:
            for k in range(b.num_rows):
                one, two = b.column(0)[k].as_py(), b.column(4)[k].as_py()
                for number, c in ((one, 1), (two, 5)):
                    if number not in held:
                        held[number] = _tiles(b.column(c)[k].values, b.column(c + 1)[k].values, size)
                x, y = (np.frombuffer(b.column(c)[k].as_buffer()).reshape(-1, d) for c in (3, 7))
                for i, p in enumerate(held[one]):
                    for q in held[two][i if one == two else 0:]:
                        dist = _tile_distances(x[p.rows], y[q.rows])
                        if p is q:
                            np.fill_diagonal(dist, 0.0)
                        p.state.met(q.found, q.counts, q.of, np.add.reduceat(dist, q.at, axis=1).T)
                        if p is not q:
                            q.state.met(p.found, p.counts, p.of, _sums_down(dist, p.at))
        for number, tiles in held.items():
            for piece, t in enumerate(tiles):
                yield t.state.partial(number, piece, partial_type)

    partial_type = to_arrow_schema(T._parse_datatype_string(partial))
    empty = {name: F.lit(None).cast(kind) for name, kind in (c.split(" ", 1) for c in partial.split(", ")[1:])}
    head = records.select("tile", *(v.alias(c) for c, v in empty.items()), "id", F.col("label").alias("row_label"), F.col("of").alias("row_of"))
    rest = {c: F.lit(None).cast(head.schema[c].dataType) for c in ("id", "row_label", "row_of")}
    gathered = head.union(met.mapInArrow(meet, partial).withColumns(rest).select(head.columns)) \
                   .repartition("tile").sortWithinPartitions("tile", F.col("near").isNotNull())
    id_array = head.schema["id"].dataType
    out = T.StructType([T.StructField(id_col, id_array.elementType), T.StructField("cluster", T.LongType()),
                        *(T.StructField(c, T.DoubleType()) for c in ("a", "b", "silhouette"))])
    id_type = to_arrow_type(id_array.elementType)

    def merge(batches):
        states, ids = [], None
        for b in batches:
            for k in range(b.num_rows):
                if not b.column(2)[k].is_valid:
                    for lo, state in states:
                        yield state.result(ids[lo:lo + size], out.names, id_type)
                    ids, labels, of = (b.column(c)[k].values for c in (8, 9, 10))
                    ids = ids.take(pa.array(np.arange(len(ids))))  # the batch goes
                    states = [(lo, _TileSilhouette(labels[lo:lo + size].to_numpy(), dict(zip(labels[lo:lo + size].to_pylist(), of[lo:lo + size].to_pylist()))))
                              for lo in range(0, len(labels), size)]
                else:
                    near, own, n_own, sums = (np.frombuffer(b.column(c)[k].as_py()) for c in (2, 3, 4, 7))
                    labels, counts = (b.column(c)[k].as_py() for c in (5, 6))
                    states[b.column(1)[k].as_py()][1].merge(near, own, n_own, labels, counts, sums.reshape(len(near), len(labels)))
        for lo, state in states:
            yield state.result(ids[lo:lo + size], out.names, id_type)

    return gathered.mapInArrow(merge, out)


@dataclass
class _Tile:
    """Rows of a record, their labels (which rise) with where each begins, and what they have met."""
    rows: slice
    found: list[int]
    at: np.ndarray
    counts: list[int]
    of: list[int]
    state: _TileSilhouette


def _tiles(labels: pa.Array, of: pa.Array, size: int) -> list[_Tile]:
    labels, of, out = labels.to_numpy().copy(), of.to_numpy(), []
    for lo in range(0, len(labels), size):
        here = labels[lo:lo + size]
        found, at, counts = np.unique(here, return_index=True, return_counts=True)
        out.append(_Tile(slice(lo, lo + len(here)), found.tolist(), at, counts.tolist(), of[lo + at].tolist(), _TileSilhouette(here)))
    return out


def _sums_down(dist: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the rows from each of ``at`` to the next."""
    if len(at) > 64:
        return np.add.reduceat(dist, at, axis=0)
    return np.array([dist[a:z].sum(axis=0) for a, z in zip(at.tolist(), [*at[1:].tolist(), len(dist)])])


class _TileSilhouette:
    """Distance sums of one tile's rows by label, fed in any order.  A label
    whose rows have all come is closed: only the least mean distance to another
    label, and the sum to the own one, are kept of it."""

    def __init__(self, labels: np.ndarray, of: dict[int, int] | None = None):
        self.labels, self.of = labels, of or {}
        n = len(labels)
        self.own, self.n_own, self.near = np.zeros(n), np.zeros(n), np.full(n, np.inf)
        self.open: dict[int, list] = {}

    def add(self, labels: np.ndarray, of: np.ndarray, dist: np.ndarray) -> None:
        """Distances to the rows of a tile, whose labels rise."""
        found, at, counts = np.unique(labels, return_index=True, return_counts=True)
        self.met(found.tolist(), counts.tolist(), of[at].tolist(), np.add.reduceat(dist, at, axis=1).T)

    def met(self, labels: list[int], counts: list[int], of: list[int], sums: np.ndarray) -> None:
        for label, count, whole, s in zip(labels, counts, of, sums):
            self.put(label, count, s, whole)

    def put(self, label: int, count: int, sums: np.ndarray, of: int | None) -> None:
        held = self.open.get(label)
        if held is None:
            held = self.open[label] = [0, np.zeros(len(self.labels))]
        held[0] += count
        held[1] += sums
        if held[0] == of:
            self.close(label)

    def close(self, label: int) -> None:
        count, sums = self.open.pop(label)
        own = self.labels == label
        self.own[own], self.n_own[own] = sums[own], count
        self.near[~own] = np.minimum(self.near[~own], sums[~own] / count)

    def partial(self, tile: int, piece: int, schema: pa.Schema) -> pa.RecordBatch:
        labels = sorted(self.open)
        sums = np.array([self.open[v][1] for v in labels]).reshape(len(labels), len(self.labels)).T
        counts = [self.open[v][0] for v in labels]
        return pa.RecordBatch.from_pylist([{"tile": tile, "piece": piece, "near": self.near.tobytes(), "own": self.own.tobytes(), "n_own": self.n_own.tobytes(),
                                            "labels": labels, "counts": counts, "sums": np.ascontiguousarray(sums).tobytes()}], schema=schema)

    def merge(self, near: np.ndarray, own: np.ndarray, n_own: np.ndarray, labels: list[int], counts: list[int], sums: np.ndarray) -> None:
        self.near = np.minimum(self.near, near)
        self.own += own
        self.n_own += n_own
        for i, label in enumerate(labels):
            self.put(label, counts[i], sums[:, i], self.of.get(label))

    def result(self, ids: pa.Array, names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
        for label in list(self.open):
            self.close(label)
        several = self.n_own > 1
        a = np.where(several, self.own / np.maximum(self.n_own - 1, 1), 0.0)
        b = np.where(np.isinf(self.near), 0.0, self.near)
        most = np.maximum(a, b)
        s = np.where(several & (most > 0), (b - a) / np.where(most > 0, most, 1.0), 0.0)
        return pa.RecordBatch.from_arrays([ids.cast(id_type), pa.array(self.labels, pa.int64()), pa.array(a), pa.array(b),
                                           pa.array(s)], names=names)


def silhouette_score(df: DataFrame, label_col: str, features: Sequence[str], id_col: str,
                     sample_size: int | None = None, seed: int = 42,
                     drop_noise: bool = True) -> DataFrame:
    """M2: mean silhouette of the sample; fewer than 2 non-noise clusters -> -1.0."""
    s = silhouette_samples(df, label_col, features, id_col, sample_size, seed, drop_noise)
    k = df.where(F.col(label_col) != -1).agg(F.count_distinct(label_col).alias("k")).scalar()
    return s.agg(F.avg("silhouette").alias("_s")).select(
        F.when(k < 2, F.lit(-1.0)).otherwise(rnd(F.col("_s"))).alias("silhouette_score"))


def silhouette_by_cluster(samples: DataFrame) -> DataFrame:
    """M3: per-cluster mean silhouette, overall mean, weak flag (below overall)."""
    overall = samples.agg(F.avg("silhouette").alias("o")).scalar()
    g = samples.groupBy("cluster").agg(F.avg("silhouette").alias("_m"),
                                        F.count(F.lit(1)).alias("n"))
    return g.select("cluster", "n", rnd(F.col("_m")).alias("mean_silhouette"),
                    rnd(overall).alias("overall"), (F.col("_m") < overall).alias("weak"))


def davies_bouldin(df: DataFrame, label_col: str, features: Sequence[str],
                   noise: int = -1) -> DataFrame:
    """M4: Davies-Bouldin index (noise removed).

    S_i = mean Euclidean distance to the centroid; R_ij = (S_i + S_j) / M_ij;
    index = mean_i max_{j != i} R_ij.  Coincident centroids are skipped;
    all S_i == 0 or all M_ij == 0 -> 0.0; fewer than two clusters -> +inf
    (the JSON sink, which cannot carry it, writes null)."""
    fs = present(df, features)
    src = df.where(F.col(label_col) != noise)
    cen = cut_lineage(centroids_of(src, fs, label_col, "cid", noise=None))
    cen_c = cen.select(F.col("cid").alias(label_col), *[F.col(f).alias(f"_c_{f}") for f in fs])
    joined = src.join(bounded_broadcast(cen_c), label_col)  # one row per cluster, counted
    dist = F.sqrt(_sq_dist([F.col(f).cast("double") for f in fs], [F.col(f"_c_{f}") for f in fs]))
    intra = joined.groupBy(F.col(label_col).alias("cid")).agg(F.avg(dist).alias("s"))
    pairs = pairwise_centroids(cen, fs).where(F.col("cid_a") != F.col("cid_b"))
    ia = intra.select(F.col("cid").alias("cid_a"), F.col("s").alias("s_a"))
    ib = intra.select(F.col("cid").alias("cid_b"), F.col("s").alias("s_b"))
    r = pairs.join(ia, "cid_a").join(ib, "cid_b").where(F.col("distance") > 0).select(
        "cid_a", ((F.col("s_a") + F.col("s_b")) / F.col("distance")).alias("r"))
    per = r.groupBy("cid_a").agg(F.max("r").alias("d"))
    k = intra.agg(F.count(F.lit(1)).alias("k"), F.max("s").alias("smax")).select(
        F.struct("k", "smax").alias("x")).scalar()
    mmax = pairs.agg(F.max("distance").alias("m")).scalar()
    # a coincident centroid pair adds nothing; a cluster with no other centroid apart adds 0
    total = per.agg(F.sum("d").alias("t")).select(F.coalesce(F.col("t"), F.lit(0.0)).alias("t"))
    val = F.when(k.getField("k") < 2, F.lit(float("inf"))) \
           .when((k.getField("smax") == 0) | (F.coalesce(mmax, F.lit(0.0)) == 0), F.lit(0.0)) \
           .otherwise(F.col("t") / k.getField("k"))
    return total.select(rnd(val).alias("davies_bouldin"))


def inertia(df: DataFrame, label_col: str, features: Sequence[str],
            centres: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """M5: sum of squared distances to the assigned centre (centres default
    to the label means)."""
    fs = present(df, features)
    cen = centres if centres is not None else centroids_of(df, fs, label_col, "cid", noise=None)
    cen_c = cen.select(F.col("cid").alias(label_col), *[F.col(f).alias(f"_c_{f}") for f in fs])
    joined = df.join(bounded_broadcast(cen_c), label_col)
    d2 = _sq_dist([F.col(f).cast("double") for f in fs], [F.col(f"_c_{f}") for f in fs])
    return joined.agg(rnd(F.sum(d2)).alias("inertia"))


def evaluate(df: DataFrame, label_col: str, features: Sequence[str], id_col: str,
             algorithm: str, sample_size: int | None = None, with_inertia: bool = False,
             seed: int = 42) -> DataFrame:
    """M8: one row (algorithm, silhouette, davies_bouldin, inertia, n_clusters, n_noise)."""
    sil = silhouette_score(df, label_col, features, id_col, sample_size, seed).scalar()
    db = davies_bouldin(df, label_col, features).scalar()
    ine = inertia(df.where(F.col(label_col) != -1), label_col, features).scalar() \
        if with_inertia else F.lit(None).cast("double")
    counts = df.agg(F.count_distinct(F.when(F.col(label_col) != -1, F.col(label_col)))
                    .alias("n_clusters"),
                    F.sum(F.when(F.col(label_col) == -1, 1).otherwise(0)).cast("long")
                    .alias("n_noise"))
    return counts.select(F.lit(algorithm).alias("algorithm"), sil.alias("silhouette_score"),
                         db.alias("davies_bouldin_index"), ine.alias("inertia"),
                         "n_clusters", "n_noise")


def compare_algorithms(metrics: Sequence[DataFrame]) -> DataFrame:
    """M9: algorithm x metric table; a metric an algorithm lacks is NULL."""
    out = metrics[0]
    for m in metrics[1:]:
        out = out.unionByName(m, allowMissingColumns=True)
    return out


def recommend(comparison: DataFrame, baseline: str = "K-Means") -> DataFrame:
    """DBSCAN if its silhouette beats the baseline's and it found >= 2
    clusters, else the baseline."""
    km = comparison.where(F.col("algorithm") == baseline).agg(
        F.max("silhouette_score").alias("s")).scalar()
    db = comparison.where(F.col("algorithm") == "DBSCAN").agg(
        F.max(F.struct("silhouette_score", "n_clusters")).alias("s")).scalar()
    pick = F.when((db.getField("silhouette_score") > km) & (db.getField("n_clusters") >= 2),
                  F.lit("DBSCAN")).otherwise(F.lit(baseline))
    return comparison.sparkSession.range(1).select(pick.alias("recommended"))


def elbow_k(sweep: DataFrame, k_col: str = "k", y_col: str = "inertia",
            sensitivity: float = 1.0) -> DataFrame:
    """M6: knee of a convex, decreasing curve (Kneedle, Satopaa et al. 2011),
    falling back to the third k (a flat curve has no knee).  The sweep table
    has one row per k."""
    w = Window.orderBy(k_col)
    wall = Window.partitionBy()
    t = sweep.select(F.col(k_col).alias("k"), F.col(y_col).cast("double").alias("y"))
    t = t.withColumns({
        "_i": F.row_number().over(w) - 1,
        "_xn": F.try_divide(F.col("k") - F.min("k").over(wall), (F.max("k").over(wall) - F.min("k").over(wall)).cast("double")),
        "_yn0": F.try_divide(F.col("y") - F.min("y").over(wall), F.max("y").over(wall) - F.min("y").over(wall)),
    })
    t = t.withColumn("_yn", F.max("_yn0").over(wall) - F.col("_yn0"))
    t = t.withColumn("_yd", F.col("_yn") - F.col("_xn"))
    prev = F.coalesce(F.lag("_yd").over(w), F.col("_yd"))
    nxt = F.coalesce(F.lead("_yd").over(w), F.col("_yd"))
    t = t.withColumns({"_max": (F.col("_yd") >= prev) & (F.col("_yd") >= nxt),
                       "_min": (F.col("_yd") <= prev) & (F.col("_yd") <= nxt),
                       "_next": F.lead("_yd").over(w),
                       "_dx": F.abs(F.col("_xn") - F.lag("_xn").over(w))})
    t = t.withColumn("_step", F.avg("_dx").over(wall))
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    thr_evt = F.when(F.col("_min"), F.lit(0.0)).when(
        F.col("_max"), F.col("_yd") - sensitivity * F.col("_step"))
    t = t.withColumns({"_thr": F.last(thr_evt, ignorenulls=True).over(run),
                       "_kmax": F.last(F.when(F.col("_max"), F.col("k")), ignorenulls=True).over(run),
                       "_first_max": F.min(F.when(F.col("_max"), F.col("_i"))).over(wall)})
    hits = t.where((F.col("_i") >= F.col("_first_max")) & (F.col("_xn") < 1.0) &
                   (F.col("_next") < F.col("_thr")))
    knee = hits.agg(F.min_by("_kmax", "_i").alias("knee")).scalar()
    third = t.where(F.col("_i") <= 2).agg(F.max("k").alias("k3")).scalar()  # the last of fewer than three
    return sweep.sparkSession.range(1).select(
        knee.alias("knee"), F.coalesce(knee, third).alias("elbow_k"))
