"""Hierarchical clustering, re-aimed for scale.

A sequential agglomerative solver over raw rows is quadratic in memory and
time.  Instead:

1. Spark k-means (k-means||, distributed) summarises *all* rows into at most
   ``n_micro`` micro-clusters: (size, centroid) - a table bounded by the
   parameter, not by the data;
2. the micro-clusters are merged bottom-up by the Lance-Williams recursion
   with their sizes as weights (ward by default: the exact ward cost of
   merging two groups of points summarised by size and centroid; complete,
   average and single on the centroid distances);
3. the merge tree is cut at k clusters and every row gets its
   micro-cluster's cluster through a join with the m-row map.

The merge log is the dendrogram table (C10).  Only the m-row summary is
handled on the driver.

``bisecting`` is the other way round (SURVEY C8 b): a divisive tree over all
rows.  Each level halves the costliest leaves, all of them in the same jobs.

``single_linkage`` needs no summary: its merges are the edges of a minimum
spanning tree over all rows, grown by components that each take their least
outgoing edge (Boruvka), found through the cells of ``metric``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import present
from ..session import cut_lineage
from .lloyd import Tree, means, totals
from .metric import Pivots, finite, homes, keyed, matrix, nearest_other, shares, tile_size
from .ordered import numbered

LINKAGES = ("ward", "complete", "average", "single")


def micro_clusters(df: DataFrame, features: Sequence[str], n_micro: int = 200, seed: int = 42,
                   max_iter: int = 10) -> tuple[DataFrame, KMeansModel]:
    """Rows -> micro-cluster id (column ``micro``) by distributed k-means.

    Micro-clusters only summarise the data for the merge, so a random start
    and few rounds suffice (k-means|| with hundreds of centres costs more
    than it gains here)."""
    fs = present(df, features)
    vec = VectorAssembler(inputCols=list(fs), outputCol="_v", handleInvalid="skip").transform(df)
    model = KMeans(k=n_micro, seed=seed, maxIter=max_iter, featuresCol="_v",
                   predictionCol="micro", initMode="random").fit(vec)
    return model.transform(vec).drop("_v"), model


def merge_tree(sizes: np.ndarray, centres: np.ndarray, linkage: str = "ward") -> np.ndarray:
    """Merge log (left, right, height, size) in scipy's numbering: leaves
    0..m-1, the cluster made by merge t is m + t."""
    if linkage not in LINKAGES:
        raise ValueError(f"unknown linkage {linkage!r}")
    m = len(sizes)
    n = sizes.astype(np.float64).copy()
    diff = centres[:, None, :] - centres[None, :, :]
    d = np.sqrt((diff * diff).sum(axis=2))
    if linkage == "ward":
        w = (n[:, None] * n[None, :]) / (n[:, None] + n[None, :])
        d = np.sqrt(2.0 * w) * d
    np.fill_diagonal(d, np.inf)
    active = np.ones(m, dtype=bool)
    label = np.arange(m)
    out = np.zeros((max(m - 1, 0), 4))
    for t in range(m - 1):
        sub = np.where(active[:, None] & active[None, :], d, np.inf)
        i, j = np.unravel_index(np.argmin(sub), sub.shape)
        if label[i] > label[j]:
            i, j = j, i
        h = d[i, j]
        ni, nj = n[i], n[j]
        out[t] = (label[i], label[j], h, ni + nj)
        others = active.copy()
        others[[i, j]] = False
        k = np.flatnonzero(others)
        if linkage == "ward":
            nk = n[k]
            new = np.sqrt(((nk + ni) * d[k, i] ** 2 + (nk + nj) * d[k, j] ** 2 - nk * h ** 2)
                          / (nk + ni + nj))
        elif linkage == "complete":
            new = np.maximum(d[k, i], d[k, j])
        elif linkage == "single":
            new = np.minimum(d[k, i], d[k, j])
        else:
            new = (ni * d[k, i] + nj * d[k, j]) / (ni + nj)
        d[i, k] = d[k, i] = new
        active[j] = False
        d[j, :] = d[:, j] = np.inf
        n[i] = ni + nj
        label[i] = m + t
    return out


def cut_tree(tree: np.ndarray, m: int, k: int) -> np.ndarray:
    """Cluster of each leaf after the first m - k merges (ids 0..k-1 by the
    smallest leaf they contain)."""
    parent = np.arange(2 * m)
    for t in range(max(m - k, 0)):
        left, right = int(tree[t, 0]), int(tree[t, 1])
        parent[left] = parent[right] = m + t

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    roots = np.array([root(i) for i in range(m)])
    order = {r: c for c, r in enumerate(dict.fromkeys(roots.tolist()))}
    return np.array([order[r] for r in roots])


def hierarchical(df: DataFrame, features: Sequence[str], k: int, id_col: str,
                 linkage: str = "ward", n_micro: int = 200, seed: int = 42
                 ) -> tuple[DataFrame, DataFrame]:
    """(labels (id, cluster), dendrogram (merge_no, left, right, height,
    size)).  ``n_micro`` bounds the driver-side merge.  Rows with a null, NaN or
    infinite feature are left out; without any other row both tables are empty."""
    fs = present(df, features)
    spark = df.sparkSession
    # written once, with the predicate as a column (``keyed``): counted, fitted and labelled from there
    df = cut_lineage(df.select(id_col, *fs, finite(fs).alias("_ok"))).where("_ok").drop("_ok")
    n_rows = df.count()
    merges = "merge_no int, left long, right long, height double, size long"
    if not n_rows:
        return df.select(id_col, F.lit(0).alias("cluster")), spark.createDataFrame([], merges)
    m_target = max(min(n_micro, n_rows), k)
    micro, _ = micro_clusters(df.select(id_col, *fs), fs, m_target, seed)
    micro = micro.persist()
    summary = micro.groupBy("micro").agg(F.count(F.lit(1)).alias("n"),
                                         *[F.avg(F.col(f).cast("double")).alias(f) for f in fs]) \
                   .orderBy("micro").collect()                     # <= n_micro rows
    ids = np.array([r["micro"] for r in summary])
    sizes = np.array([r["n"] for r in summary], dtype=np.float64)
    cen = np.array([[r[f] for f in fs] for r in summary], dtype=np.float64)
    tree = merge_tree(sizes, cen, linkage)
    leaf_cluster = cut_tree(tree, len(ids), k)
    # canonical ids: order clusters by their weighted centroid coordinates
    cl_cen = np.array([np.average(cen[leaf_cluster == c], axis=0, weights=sizes[leaf_cluster == c])
                       for c in range(leaf_cluster.max() + 1)])
    order = np.lexsort(cl_cen.T[::-1])
    remap = np.empty_like(order)
    remap[order] = np.arange(len(order))
    mapping = spark.createDataFrame([(int(i), int(remap[c])) for i, c in zip(ids, leaf_cluster)],
                                    "micro int, cluster int")
    labels = cut_lineage(micro.join(F.broadcast(mapping), "micro").select(id_col, "cluster"))  # one row per micro-cluster
    micro.unpersist()
    dendro = spark.createDataFrame(
        [(t + 1, int(a), int(b), float(h), int(s)) for t, (a, b, h, s) in enumerate(tree)],
        merges)
    return labels, dendro


def bisecting(df: DataFrame, features: Sequence[str], k: int, id_col: str, n_iter: int = 20
              ) -> tuple[DataFrame, DataFrame]:
    """C8 (b): (labels (id, cluster), tree (node, parent, depth, size, cost,
    cluster, features...)).

    The root holds all rows.  Per level the costliest leaves (summed squared
    distances to their mean; ties by node) are split, as many as ``k`` allows: two
    centres start one standard deviation to either side of the mean along the
    widest feature (the first on ties) and take at most ``n_iter`` Lloyd rounds.
    One pass over all rows serves all splits of a level.  Leaves without cost (one
    row, copies) are not split, so there may be fewer than ``k`` clusters; they
    are numbered in the order of their centres.  Everything is a function of the
    rows: no random start.  Rows with a null, NaN or infinite feature are left out."""
    fs = present(df, features)
    d = len(fs)
    rows = keyed(df, fs, id=id_col)
    centres, left, right, parent, depth = [np.zeros(d)], [-1], [-1], [-1], [0]

    def tree():
        return Tree(np.array(centres), np.array(left), np.array(right))

    def counted():
        """Rows, cost about the mean, mean and variances of the leaves."""
        t = totals(rows, [tree()], d)[0]
        n = np.maximum(t.n, 1)[:, None]
        mean = t.sums / n
        return t, mean, np.maximum(t.squares / n - mean ** 2, 0.0)

    t, mean, var = counted()
    centres[0] = mean[0]
    size, cost = {0: int(t.n[0])}, {0: float(var[0].sum() * t.n[0])}
    leaves = 1
    while leaves < k:
        at = [i for i in range(len(centres)) if left[i] < 0 and size[i] > 1 and cost[i] > 1e-12 * max(cost[0], 1e-300)]
        chosen = sorted(at, key=lambda i: (-cost[i], i))[:k - leaves]
        if not chosen:
            break
        fresh = []
        for i in sorted(chosen):
            f = int(var[i].argmax())
            for side in (-1.0, 1.0):
                c = mean[i].copy()
                c[f] += side * np.sqrt(var[i][f])
                fresh.append(len(centres))
                centres.append(c)
                left.append(-1)
                right.append(-1)
                parent.append(i)
                depth.append(depth[i] + 1)
            left[i], right[i] = fresh[-2], fresh[-1]
        for _ in range(n_iter):
            t = totals(rows, [tree()], d)[0]
            new = means(t, np.array(centres))
            moved = max(float(((new[i] - centres[i]) ** 2).sum()) for i in fresh)
            for i in fresh:
                centres[i] = new[i]
            if moved == 0.0:
                break
        t, mean, var = counted()  # of the leaves; inner nodes are done
        for i in fresh:
            size[i], cost[i] = int(t.n[i]), float(var[i].sum() * t.n[i])
        leaves += len(chosen)
    final = tree()
    ends = [i for i in range(len(centres)) if left[i] < 0]
    order = sorted(ends, key=lambda i: tuple(centres[i]))
    cluster = np.full(len(centres), -1)
    cluster[order] = np.arange(len(order))
    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("cluster", T.IntegerType())])

    def label(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster[final.assign(matrix(b.column(1), d))[0]], pa.int32())],
                                             names=schema.names)

    nodes = [(i, parent[i] if parent[i] >= 0 else None, depth[i], size[i], cost[i], int(cluster[i]) if left[i] < 0 else None,
              *map(float, centres[i])) for i in range(len(centres)) if size[0]]
    columns = ", ".join(["node int", "parent int", "depth int", "size long", "cost double", "cluster int"] + [f"`{f}` double" for f in fs])
    return rows.select("id", "x").mapInArrow(label, schema), df.sparkSession.createDataFrame(nodes, columns)


def spanning_tree(df: DataFrame, features: Sequence[str], id_col: str, tile_rows: int | None = None) -> DataFrame:
    """(a, b, distance), a < b: the minimum spanning tree of the rows by
    Euclidean distance, ties by the ids.  Rows have distinct ids and finite
    features.  In each round every component but the largest takes its least
    outgoing edge, so their number halves about; labels and edges of a round are
    checkpointed."""
    from .dbscan import connected_components
    fs = present(df, features)
    d, size = len(fs), tile_rows or tile_size(len(fs))
    rows = keyed(df, fs, id=id_col)
    pivots = Pivots.of(rows, d, size)
    kind = rows.schema["id"].dataType.simpleString()
    tree = df.sparkSession.createDataFrame([], f"a {kind}, b {kind}, distance double")
    if not len(pivots):
        return tree
    # near rows stand together, by their cell
    rows = cut_lineage(homes(rows, pivots, d).select("row", "id", F.col("cell").cast("double").alias("far"), "x"))
    parts, record_rows = shares(rows.count(), d, size)
    labels = rows.select("id", F.col("id").alias("comp"))
    while True:
        comps = cut_lineage(labels.groupBy("comp").agg(F.count(F.lit(1)).alias("n")))
        top = comps.orderBy(F.desc("n"), "comp").limit(2).collect()
        if len(top) < 2:
            return tree
        idle = top[0]["comp"] if top[0]["n"] > 1 else None
        least = cut_lineage(nearest_other(rows.join(labels, "id").select("row", "id", "comp", "far", "x"), d, size, parts, record_rows, idle))
        tree = tree.union(least.select("a", "b", "distance").distinct())
        merged = connected_components(comps.select(F.col("comp").alias("id")), least.select(F.col("comp").alias("src"), F.col("other").alias("dst")))
        labels = cut_lineage(labels.join(merged.select(F.col("id").alias("comp"), F.col("comp").alias("_to")), "comp")
                             .select("id", F.col("_to").alias("comp")))


def single_linkage(df: DataFrame, features: Sequence[str], id_col: str, k: int | None = None, height: float | None = None,
                   tile_rows: int | None = None, tree: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """C8 ``single`` on raw rows: (labels (id, cluster), tree (a, b, distance)).
    A tree of an earlier call over the same rows is taken as it is.

    The tree's edges in rising order are the merges.  It is cut into ``k`` clusters
    (its k - 1 largest edges go, ties by the ids) or at ``height`` (edges beyond it
    go).  Clusters are numbered by their smallest id.  Rows of equal features are
    one point of the tree; rows with a null, NaN or infinite feature are left out."""
    from .dbscan import _distinct_points, connected_components
    if (k is None) == (height is None):
        raise ValueError("give k or height")
    fs = present(df, features)
    points, point_of = _distinct_points(df.where(F.col(id_col).isNotNull()), fs, id_col, odd=False)
    if tree is None:
        tree = cut_lineage(spanning_tree(points, fs, "p", tile_rows))
    kept = tree
    if height is not None:
        kept = tree.where(F.col("distance") <= float(height))
    elif k > 1:
        edge = F.struct("distance", "a", "b")
        cut = tree.select(edge.alias("e")).orderBy(F.desc("e")).limit(k - 1).agg(F.min("e").alias("e")).first()["e"]  # k - 1 edges
        if cut is not None:
            kept = tree.where(edge < F.struct(*(F.lit(v).cast(tree.schema[c].dataType).alias(c) for c, v in zip(("distance", "a", "b"), cut))))
    comp = connected_components(points.select(F.col("p").alias("id")), kept.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    number = numbered(comp.select("comp").distinct(), ["comp"], "cluster")
    labels = (point_of.join(comp.select(F.col("id").alias("p"), "comp"), "p").join(number, "comp")
              .select(F.col("id").alias(id_col), F.col("cluster").cast("int").alias("cluster")))
    return labels, tree


def dendrogram_table(dendro: DataFrame, last_p: int = 30, colour_ratio: float = 0.7) -> DataFrame:
    """The last ``p`` merges, flagged above ``colour_ratio`` x max height."""
    n = dendro.agg(F.max("merge_no").alias("n")).scalar()
    hmax = dendro.agg(F.max("height").alias("h")).scalar()
    return dendro.where(F.col("merge_no") > n - last_p).withColumn(
        "above_threshold", F.col("height") > F.lit(colour_ratio) * hmax)
