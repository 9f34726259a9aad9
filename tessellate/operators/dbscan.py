"""Density clustering and connected components.

eps-join (J4)
    Up to three features: points are bucketed into grid cells of side ``eps``;
    every point meets the points of its own and the 3^m neighbouring cells
    through an equi-join on the cell key, and the exact distance filters the
    candidates.  A dense cell is a skewed join key, which AQE's skew-join splits
    across tasks.  More features: the cells of ``metric`` (distances to pivot
    rows as range keys, pruned by the triangle inequality and by the planes
    between pivots), so that clustered rows meet only the cells around them.
    Rows without any structure leave nothing to prune: the join stays exact and
    approaches all pairs.

Copies
    Rows of equal features are one point with a count (more than three
    features; the grid of up to three features counts them by cell), so a group
    of copies costs one row, not its pairs.

DBSCAN (C6)
    core = neighbours (self included) >= min_samples; clusters are connected
    components of the core-core edges; a border point joins the smallest
    cluster among its core neighbours; clusters are numbered by their
    smallest core id; everything else is noise (-1).  This equals the
    sequential scan-and-expand result in row-id order.

Connected components
    min-label propagation with pointer jumping; every round is checkpointed
    to the shared checkpoint folder (reliable, lineage cut), stops when no
    label changes.  At most ``LOCAL_LINKS`` links are joined on the driver instead.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import present
from ..session import cut_lineage
from .assign import _sq_dist, propagate_nearest
from .metric import Pivots, dealt_tiles, finite, keyed, near_counts, near_least, near_links, near_pairs, tile_size
from .ordered import numbered
from .sample import uniform_sample


def eps_join(df: DataFrame, features: Sequence[str], eps: float, id_col: str,
             grid_features: Sequence[str] | None = None) -> DataFrame:
    """Unordered pairs (id_a < id_b) within distance ``eps`` (self excluded),
    with their distance.  Exact on all features."""
    fs = present(df, features)
    if len(fs) > 3 and not grid_features:
        return near_pairs(df, fs, eps, id_col)
    gf = list(grid_features or fs[:3])
    pts = df.select(F.col(id_col).alias("_id"), *[F.col(f).cast("double").alias(f) for f in fs])
    cells = {f"_g{i}": F.floor(F.col(f) / F.lit(float(eps))).cast("long") for i, f in enumerate(gf)}
    pts = pts.withColumns(cells)
    # half neighbourhood: offsets that are lexicographically >= 0 meet every
    # unordered pair of neighbouring cells exactly once (the zero offset also
    # meets same-cell pairs, kept once by the id order)
    offsets = [o for o in itertools.product((-1, 0, 1), repeat=len(gf)) if o >= (0,) * len(gf)]
    off_arr = F.array(*[F.array(*[F.lit(o) for o in off]) for off in offsets])
    a = pts.select("_id", *[F.col(c).alias(f"a_{c}") for c in cells],
                   *[F.col(f).alias(f"a_{f}") for f in fs])
    b = pts.select(F.col("_id").alias("_idb"), F.explode(off_arr).alias("_off"),
                   *list(cells), *[F.col(f).alias(f"b_{f}") for f in fs])
    zero = F.lit(True)
    for i in range(len(gf)):
        zero = zero & (F.col("_off")[i] == 0)
    b = b.select("_idb", zero.alias("_same"),
                 *[(F.col(c) + F.col("_off")[i]).alias(f"a_{c}") for i, c in enumerate(cells)],
                 *[F.col(f"b_{f}") for f in fs])
    j = a.join(b, [f"a_{c}" for c in cells]).where(
        (~F.col("_same")) | (F.col("_id") < F.col("_idb")))
    d2 = _sq_dist([F.col(f"a_{f}") for f in fs], [F.col(f"b_{f}") for f in fs])
    return j.withColumn("_d2", d2).where(F.col("_d2") <= F.lit(float(eps) * float(eps))) \
            .select(F.least("_id", "_idb").alias("id_a"), F.greatest("_id", "_idb").alias("id_b"),
                    F.sqrt("_d2").alias("distance"))


LOCAL_LINKS = 10_000


def _joined(links: list) -> dict:
    """The smallest id in the component of each id that a link names."""
    parent: dict = {}

    def root(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {v: root(v) for v in list(parent)}


def connected_components(vertices: DataFrame, edges: DataFrame, max_rounds: int | None = None
                         ) -> DataFrame:
    """(id, comp) with comp = smallest id in the component.

    ``vertices`` has column ``id``; ``edges`` has ``src``, ``dst`` (either
    direction suffices).  Rounds run until no label changes; with
    ``max_rounds`` it raises if they do not suffice."""
    once = cut_lineage(edges.where(F.col("src") != F.col("dst")).select(
        F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    kind = vertices.schema["id"].dataType
    if max_rounds is None and isinstance(kind, (T.IntegralType, T.StringType)):
        links = once.limit(LOCAL_LINKS + 1).collect()
        if len(links) <= LOCAL_LINKS:
            low = vertices.sparkSession.createDataFrame(list(_joined(links).items()), T.StructType([T.StructField("id", kind), T.StructField("comp", kind)]))
            return cut_lineage(vertices.select("id").distinct().join(F.broadcast(low), "id", "left").select(
                "id", F.coalesce("comp", "id").alias("comp")))
    e = once.unionByName(once.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    labels = cut_lineage(vertices.select("id", F.col("id").alias("comp")).distinct())
    for done in itertools.count():
        if max_rounds is not None and done >= max_rounds:
            raise RuntimeError(f"components still change after {max_rounds} rounds")
        nb = e.join(labels.withColumnRenamed("id", "dst"), "dst").select(
            F.col("src").alias("id"), "comp", F.lit(None).cast(labels.schema["id"].dataType).alias("_own"))
        own = labels.select("id", "comp", F.col("comp").alias("_own"))
        new = own.unionByName(nb).groupBy("id").agg(F.min("comp").alias("comp"),
                                                     F.max("_own").alias("_old"))
        parent = new.select(F.col("id").alias("comp"), F.col("comp").alias("_pc"))
        new = new.join(parent, "comp", "left").select(
            "id", F.least(F.col("comp"), F.coalesce(F.col("_pc"), F.col("comp"))).alias("comp"),
            "_old")
        new = cut_lineage(new)
        # the change flag travels with the round's checkpoint: no extra join
        changed = new.where(F.col("comp") != F.col("_old")).limit(1).count()
        labels = new.drop("_old")
        if changed == 0:
            break
    return labels


def _number_and_border(pts: DataFrame, comp: DataFrame, core_nb: DataFrame, id_col: str,
                       noise: int) -> DataFrame:
    """Cluster ids from components (by smallest core id) and border labels
    (smallest cluster among core neighbours).  ``pts`` (p, is_core),
    ``comp`` (id, comp), ``core_nb`` (p, q): q is a core within eps of p."""
    core_lab = _core_labels(comp)
    border = core_nb.join(core_lab.withColumnRenamed("p", "q"), "q") \
                    .groupBy("p").agg(F.min("cluster").alias("_bc"))
    return _labelled(pts, core_lab, border, id_col, noise)


def _core_labels(comp: DataFrame) -> DataFrame:
    """(p, cluster) of the cores: components numbered by their smallest id."""
    clusters = numbered(comp.select("comp").distinct(), ["comp"], "cluster")
    return comp.join(clusters, "comp").select(F.col("id").alias("p"), "cluster")


def _labelled(pts: DataFrame, core_lab: DataFrame, border: DataFrame, id_col: str, noise: int) -> DataFrame:
    """Labels of ``pts`` (p, is_core) from those of the cores (p, cluster) and of
    the border points (p, _bc)."""
    out = pts.join(core_lab, "p", "left").join(border, "p", "left")
    lab = F.when(F.col("is_core"), F.col("cluster")).otherwise(
        F.coalesce(F.col("_bc"), F.lit(noise))).cast("int")
    return out.select(F.col("p").alias(id_col), lab.alias("cluster"), "is_core")


def _dbscan_grid(df: DataFrame, fs: Sequence[str], eps: float, min_samples: int, id_col: str,
                 noise: int) -> DataFrame:
    """Exact DBSCAN for <= 3 features on cells of side eps/sqrt(d).

    A cell is *tight* when the bounding box of its points has diameter
    <= eps: all its points are then mutual neighbours.  Every (point, nearby
    cell) pair is classified by box distances as *full* (both cells tight and
    the whole box within eps: counted, no pairs), *none* (box farther than
    eps) or *partial* (exact point pairs).  A tight cell of ``min_samples``
    points holds cores only (*sure*): its points need no counts, and two such cells
    are one cell pair, linked or not; pairs are listed for the other points, the
    thin outskirts of the clusters.  Cores connect by star edges to
    their tight cell's smallest core and to the smallest core of full
    cells, plus exact core pairs - the same components as the full eps-graph
    without ever listing the pairs inside a dense cell, so a cell holding a
    third of the rows costs a group count, not a quadratic join."""
    d = len(fs)
    e2 = float(eps) * float(eps)
    side = float(eps) / math.sqrt(d)
    pts = df.select(F.col(id_col).alias("p"),
                    *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(fs)])
    pts = pts.withColumns({f"c{i}": F.floor(F.col(f"x{i}") / F.lit(side)).cast("long") for i in range(d)})
    pts = pts.persist(StorageLevel.MEMORY_AND_DISK)
    ckeys = [f"c{i}" for i in range(d)]
    cells = pts.groupBy(*ckeys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(f"x{i}").alias(f"lo{i}") for i in range(d)],
        *[F.max(f"x{i}").alias(f"hi{i}") for i in range(d)])
    diam2 = _sq_dist([F.col(f"hi{i}") for i in range(d)], [F.col(f"lo{i}") for i in range(d)])
    cells = cells.withColumn("tight", diam2 <= F.lit(e2)).withColumn("sure", F.col("tight") & (F.col("n") >= min_samples)).persist(StorageLevel.MEMORY_AND_DISK)
    # nearby cells: offsets whose cell gap can still be <= eps
    offs = [o for o in itertools.product(range(-2, 3), repeat=d)
            if sum(max(abs(v) - 1, 0) ** 2 for v in o) <= d]
    off_arr = F.array(*[F.array(*[F.lit(v) for v in o]) for o in offs])
    near = cells.select(*[F.col(c).alias(f"n{c}") for c in ckeys], "n", "tight", "sure",
                        *[F.col(f"lo{i}") for i in range(d)], *[F.col(f"hi{i}") for i in range(d)],
                        F.explode(off_arr).alias("_o"))
    near = near.select(*[(F.col(f"n{c}") + F.col("_o")[i]).alias(c) for i, c in enumerate(ckeys)],
                       *[F.col(f"n{c}") for c in ckeys], "n", F.col("tight").alias("ntight"), F.col("sure").alias("nsure"),
                       *[F.col(f"lo{i}") for i in range(d)], *[F.col(f"hi{i}") for i in range(d)])
    own = cells.select(*ckeys, F.col("tight").alias("otight"), F.col("sure").alias("osure"))
    pc = pts.join(own, ckeys).join(near, ckeys)   # point x non-empty nearby cell
    far = [F.greatest(F.abs(F.col(f"x{i}") - F.col(f"lo{i}")), F.abs(F.col(f"x{i}") - F.col(f"hi{i}")))
           for i in range(d)]
    gap = [F.greatest(F.col(f"lo{i}") - F.col(f"x{i}"), F.col(f"x{i}") - F.col(f"hi{i}"), F.lit(0.0))
           for i in range(d)]
    zero = [F.lit(0.0)] * d
    maxd2, mind2 = _sq_dist(far, zero), _sq_dist(gap, zero)
    full = F.col("otight") & F.col("ntight") & (maxd2 <= F.lit(e2))
    pc = pc.select("p", *[F.col(f"x{i}") for i in range(d)], *ckeys, *[F.col(f"n{c}") for c in ckeys],
                   "n", "osure", "nsure", F.when(full, F.lit("full")).when(mind2 > F.lit(e2), F.lit("none"))
                   .otherwise(F.lit("partial")).alias("kind")).where(F.col("kind") != "none")
    pc = pc.persist(StorageLevel.MEMORY_AND_DISK)
    # exact pairs only for partial (point, cell) combinations, listed for points whose own cell does not make them cores
    part = pc.where(F.col("kind") == "partial").select(
        "p", "osure", "nsure", *[F.col(f"x{i}").alias(f"a{i}") for i in range(d)],
        *[F.col(c).alias(f"o{c}") for c in ckeys], *[F.col(f"n{c}").alias(c) for c in ckeys])
    others = pts.select(F.col("p").alias("q"), *ckeys, *[F.col(f"x{i}").alias(f"b{i}") for i in range(d)])
    pair_d2 = _sq_dist([F.col(f"a{i}") for i in range(d)], [F.col(f"b{i}") for i in range(d)])
    pairs = part.where(~F.col("osure")).join(others, ckeys).where(F.col("p") != F.col("q")) \
                .where(pair_d2 <= F.lit(e2)).select("p", "q").persist(StorageLevel.MEMORY_AND_DISK)
    # two cells of cores: one pair within eps links them, so only the cells are kept (each two once)
    once = F.struct(*[F.col(f"o{c}").alias(c) for c in ckeys]) < F.struct(*ckeys)
    linked = part.where(F.col("osure") & F.col("nsure") & once).join(others, ckeys).where(pair_d2 <= F.lit(e2)) \
                 .select(*[f"o{c}" for c in ckeys], *ckeys).distinct()
    linked = linked.unionByName(pc.where((F.col("kind") == "full") & F.col("osure")).select(
        *[F.col(c).alias(f"o{c}") for c in ckeys], *[F.col(f"n{c}").alias(c) for c in ckeys]).distinct())
    # neighbour counts (self included): full cells by count, partial by pairs
    full_n = pc.where((F.col("kind") == "full") & ~F.col("osure")).groupBy("p").agg(F.sum("n").alias("_fn"))
    pair_n = pairs.groupBy("p").agg(F.count(F.lit(1)).alias("_pn"))
    self_in_full = pc.where((F.col("kind") == "full") & ~F.col("osure") &
                            F.expr(" AND ".join(f"n{c} = floor(x{i} / {side!r})" for i, c in enumerate(ckeys))))
    self_in_full = self_in_full.select("p").distinct().withColumn("_sf", F.lit(1))
    sure = pts.join(cells.where("sure").select(*ckeys), ckeys).select("p").distinct().withColumn("_sure", F.lit(True))
    deg = pts.select("p").join(sure, "p", "left").join(full_n, "p", "left").join(pair_n, "p", "left") \
             .join(self_in_full, "p", "left")
    deg_all = F.coalesce(F.col("_fn"), F.lit(0)) + F.coalesce(F.col("_pn"), F.lit(0)) + \
        F.when(F.col("_sf").isNull(), F.lit(1)).otherwise(F.lit(0))
    core = deg.select("p", (F.col("_sure").isNotNull() | (deg_all >= min_samples)).alias("is_core")) \
              .persist(StorageLevel.MEMORY_AND_DISK)
    # smallest core per cell; star edges and full-cell representative edges
    pcell = pts.select("p", *ckeys).join(core, "p")
    mincore = pcell.where("is_core").groupBy(*ckeys).agg(F.min("p").alias("rep"))
    tight_cells = cells.where("tight").select(*ckeys)
    star = pcell.where("is_core").join(tight_cells, ckeys).join(mincore, ckeys) \
                .select(F.col("p").alias("src"), F.col("rep").alias("dst"))
    full_rep = pc.where((F.col("kind") == "full") & ~F.col("osure")).select(
        "p", *[F.col(f"n{c}").alias(c) for c in ckeys]).join(mincore, ckeys).select("p", "rep")
    is_core_p = core.where("is_core").select("p")
    rep_edges = full_rep.join(is_core_p, "p").select(F.col("p").alias("src"), F.col("rep").alias("dst"))
    core_q = core.where("is_core").select(F.col("p").alias("q"))
    core_pairs = pairs.join(is_core_p, "p").join(core_q, "q").select(
        F.col("p").alias("src"), F.col("q").alias("dst"))
    cell_edges = linked.join(mincore, ckeys).withColumnRenamed("rep", "dst") \
                       .join(mincore.select(*[F.col(c).alias(f"o{c}") for c in ckeys], F.col("rep").alias("src")),
                             [f"o{c}" for c in ckeys]).select("src", "dst")
    comp = connected_components(is_core_p.select(F.col("p").alias("id")),
                                star.unionByName(rep_edges).unionByName(core_pairs).unionByName(cell_edges))
    # core neighbours of the points outside cells of cores: representatives of full cells, exact pairs
    core_nb = full_rep.select("p", F.col("rep").alias("q")).unionByName(
        pairs.join(core_q, "q").select("p", "q"))
    found = cut_lineage(_number_and_border(core, comp, core_nb, id_col, noise))
    for held in (pts, cells, pc, pairs, core):
        held.unpersist()
    return found


def _dbscan_tiles(df: DataFrame, fs: Sequence[str], eps: float, min_samples: int, id_col: str, noise: int) -> DataFrame:
    """DBSCAN whose pairs stay in the tasks: tiles meet tiles (``metric``) for the
    neighbour counts, then the cores' for a forest of links, then the other points'
    with the cores' for the least cluster.  What leaves a task is bounded by the
    rows it holds, so disk and shuffle grow with the rows times a constant number
    of parts, however many pairs lie within ``eps``."""
    points, point_of = _distinct_points(df, fs, id_col) if len(fs) > 3 else (
        df.select(F.col(id_col).alias("p"), F.lit(1).cast("long").alias("copies"), *fs), None)
    d, size = len(fs), tile_size(len(fs))
    rows = keyed(points.where(F.col("p").isNotNull()), fs, id="p", copies="copies")
    pivots = Pivots.of(rows, d, size)

    def tiled(found, value, radius=None):
        return dealt_tiles(found, pivots, d, ["id", value], eps, size, radius)

    none = rows.select(F.col("id").alias("p"), F.lit(0).cast("long").alias("n")).where(F.lit(False))
    deg = near_counts(tiled(rows, "copies")[0], pivots, d, eps).withColumnRenamed("id", "p") if len(pivots) else none
    pts = cut_lineage(points.select("p", "copies").join(deg, "p", "left").select(
        "p", ((F.coalesce(F.col("n"), F.lit(0)) + F.col("copies")) >= min_samples).alias("is_core")))
    cores = pts.where("is_core").select(F.col("p").alias("id")).distinct()
    core_rows = rows.join(cores, "id")
    links = cut_lineage(near_links(tiled(core_rows, "copies")[0], pivots, d, eps)) if len(pivots) else \
        none.select(F.col("p").alias("src"), F.col("p").alias("dst"))
    core_lab = cut_lineage(_core_labels(connected_components(cores, links)))
    if len(pivots):
        tiles, radius = tiled(core_rows.join(core_lab.select(F.col("p").alias("id"), F.col("cluster").cast("long")), "id"), "cluster")
        others, _ = tiled(rows.join(cores, "id", "left_anti"), "copies", radius)
        border = near_least(others, tiles, pivots, d, eps, "cluster").select(F.col("id").alias("p"), F.col("least").alias("_bc"))
    else:
        border = none.select("p", F.col("n").alias("_bc"))
    found = _labelled(pts, core_lab, border, "p", noise)
    if point_of is None:
        return found.withColumnRenamed("p", id_col)
    return point_of.join(found, "p").select(F.col("id").alias(id_col), "cluster", "is_core")


PAIR_BUDGET_PER_ROW = 64


def candidate_pairs(df: DataFrame, features: Sequence[str], eps: float,
                    grid_features: Sequence[str] | None = None) -> tuple[int, int]:
    """(rows, candidate pairs of the eps-join) from coarse cell counts only:
    one aggregate plus a join of the (much smaller) cell table."""
    gf = list(grid_features or list(features)[:3])
    cells = {f"_g{i}": F.floor(F.col(f).cast("double") / F.lit(float(eps))).cast("long")
             for i, f in enumerate(gf)}
    cnt = df.select(*[v.alias(k) for k, v in cells.items()]).groupBy(*cells).agg(
        F.count(F.lit(1)).alias("n")).persist()
    offsets = [o for o in itertools.product((-1, 0, 1), repeat=len(gf)) if o >= (0,) * len(gf)]
    near = cnt.select(*[F.col(k).alias(f"m{k}") for k in cells], F.col("n").alias("m"),
                      F.explode(F.array(*[F.array(*[F.lit(v) for v in o]) for o in offsets])).alias("_o"))
    near = near.select(*[(F.col(f"m{k}") + F.col("_o")[i]).alias(k) for i, k in enumerate(cells)],
                       "m", F.expr(" AND ".join(f"_o[{i}] = 0" for i in range(len(gf)))).alias("_same"))
    j = cnt.join(near, list(cells))
    n = F.col("n").cast("double")
    pairs = F.when(F.col("_same"), n * (n - 1) / 2).otherwise(n * F.col("m"))
    row = j.agg(F.sum(pairs).alias("p")).first()
    rows = cnt.agg(F.sum("n").alias("r")).first()["r"] or 0
    cnt.unpersist()
    return int(rows), int(row["p"] or 0)


def dbscan(df: DataFrame, features: Sequence[str], eps: float, min_samples: int, id_col: str,
           grid_features: Sequence[str] | None = None, noise: int = -1,
           method: str = "auto") -> DataFrame:
    """(id, cluster, is_core) for every row; noise is -1.

    ``auto`` is a size check: the eps-join runs while its candidate pairs
    (estimated from coarse cell counts) stay within ``PAIR_BUDGET_PER_ROW``
    per row; beyond that - dense or hot cells - inputs with <= 3 features use
    the tight-cell grid, which lists no pairs inside dense cells.  More features
    go by ``tiles``: pairs are met, not listed."""
    fs = present(df, features)
    if method == "tiles" or (method == "auto" and len(fs) > 3 and not grid_features):
        return _dbscan_tiles(df, fs, eps, min_samples, id_col, noise)
    if method == "auto" and len(fs) <= 3 and not grid_features:
        rows, cand = candidate_pairs(df, fs, eps)
        method = "grid" if cand > PAIR_BUDGET_PER_ROW * max(rows, 1) else "pairs"
    if method == "grid":
        return _dbscan_grid(df, fs, eps, min_samples, id_col, noise)
    points, point_of = _distinct_points(df, fs, id_col) if len(fs) > 3 else (
        df.select(F.col(id_col).alias("p"), F.lit(1).cast("long").alias("copies"), *fs), None)
    pairs = cut_lineage(eps_join(points, fs, eps, "p", grid_features))
    both = pairs.select(F.col("id_a").alias("p"), F.col("id_b").alias("q")).unionByName(
        pairs.select(F.col("id_b").alias("p"), F.col("id_a").alias("q")))
    near = both if point_of is None else both.join(points.select(F.col("p").alias("q"), F.col("copies").alias("_n")), "q")
    deg = near.groupBy("p").agg((F.count(F.lit(1)) if point_of is None else F.sum("_n")).alias("_deg"))
    pts = cut_lineage(points.select("p", "copies").join(deg, "p", "left").select(
        "p", ((F.coalesce(F.col("_deg"), F.lit(0)) + F.col("copies")) >= min_samples).alias("is_core")))
    cores = pts.where("is_core").select(F.col("p").alias("id"))
    core_ids = pts.where("is_core").select("p")
    cc_edges = pairs.join(core_ids.withColumnRenamed("p", "id_a"), "id_a") \
                    .join(core_ids.withColumnRenamed("p", "id_b"), "id_b") \
                    .select(F.col("id_a").alias("src"), F.col("id_b").alias("dst"))
    comp = connected_components(cores, cc_edges)
    found = _number_and_border(pts, comp, both, "p", noise)
    if point_of is None:
        return found.withColumnRenamed("p", id_col)
    return point_of.join(found, "p").select(F.col("id").alias(id_col), "cluster", "is_core")


def _distinct_points(df: DataFrame, fs: Sequence[str], id_col: str, odd: bool = True) -> tuple[DataFrame, DataFrame]:
    """Distinct feature rows (p: their smallest id, copies, features), and the
    point of every id (id, p).  A row with a null, NaN or infinite feature is a
    point of its own; without ``odd`` it is left out."""
    rows = cut_lineage(df.select(F.col(id_col).alias("id"), F.array(*(F.col(f).cast("double") for f in fs)).alias("x"),
                                 finite(fs).alias("_ok")))
    named = [F.col("x")[i].alias(f) for i, f in enumerate(fs)]
    lone = rows.where(~F.col("_ok") if odd else F.lit(False))
    whole = cut_lineage(rows.where("_ok").groupBy("x").agg(F.min("id").alias("p"), F.count(F.lit(1)).alias("copies")))
    points = cut_lineage(whole.select("p", "copies", *named).unionByName(
        lone.select(F.col("id").alias("p"), F.lit(1).cast("long").alias("copies"), *named)))
    if whole.where("copies > 1").isEmpty():
        return points, points.select(F.col("p").alias("id"), "p")
    same = rows.where("_ok").join(whole.select("p", "x"), "x").select("id", "p")
    return points, cut_lineage(same.unionByName(lone.select("id", F.col("id").alias("p"))))


def dbscan_sampled(df: DataFrame, features: Sequence[str], eps: float, min_samples: int,
                   id_col: str, sample_size: int = 15000, seed: int = 42,
                   grid_features: Sequence[str] | None = None) -> DataFrame:
    """DBSCAN on a reproducible sample, every row takes the label of its
    nearest sample point (noise spreads as noise).  (id, cluster).  The sample is
    bounded, so its tiles meet: a few matrix products, whatever its density."""
    fs = present(df, features)
    sample = cut_lineage(uniform_sample(df.select(id_col, *fs), sample_size, id_col, seed))
    lab = cut_lineage(dbscan(sample, fs, eps, min_samples, id_col, grid_features, method="auto" if grid_features else "tiles"))
    labelled = sample.join(lab, id_col)
    nn = propagate_nearest(df, labelled, fs, id_col, id_col, "cluster")
    return nn.select(id_col, F.col("nn_label").alias("cluster"))
