"""K-means family.

* ``kmeans_lloyd`` (C2) is the deterministic core: given initial centres and
  a fixed number of rounds, each round is one aggregate job (assign by a
  narrow projection, ``groupBy(cluster).avg`` with map-side partial
  aggregation - only k partial rows per task are shuffled).  An empty cluster
  keeps its centre.
* ``kmeans`` (C1) uses Spark ML's k-means|| initialisation and Lloyd
  iterations, restarted ``n_init`` times (best training cost wins), with the
  relative tolerance of the reference converted to Spark's absolute one, and
  canonical cluster ids (ordered by centre coordinates).
* The sweeps (C3, M10), their deterministic core and the mini-batch variant (C4)
  run all k and restarts in the same jobs (``lloyd``).
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import present, rnd
from ..session import scratch_path
from .assign import nearest_centroid
from .lloyd import Flat, lloyd_many, means, spread_centres, start_sample, totals
from .metric import keyed
from .sample import HASH_RANGE, portable_hash, uniform_sample

_VEC = "_features_vec"
MAX_PARALLEL_FITS = 4


def initial_centres_first_rows(df: DataFrame, features: Sequence[str], id_col: str, k: int
                               ) -> DataFrame:
    """k centres taken from the k rows with the smallest ids (cid 0..k-1)."""
    top = df.orderBy(id_col).limit(k)
    w = Window.orderBy(id_col)
    return top.select((F.row_number().over(w) - 1).cast("int").alias("cid"),
                      *[F.col(f).cast("double").alias(f) for f in features])


def _centre_rows(centres: DataFrame, features: Sequence[str], k: int) -> list[list[float]]:
    got = {int(r["cid"]): [float(r[f]) for f in features]
           for r in centres.select("cid", *features).collect()}  # k rows
    return [got[j] for j in range(k)]


def lloyd_round(df: DataFrame, centres: list[list[float]], features: Sequence[str]
                ) -> list[list[float]]:
    """One Lloyd round: assign (narrow), mean per cluster (k-row shuffle),
    collect the k new centres; an empty cluster keeps its centre."""
    a = nearest_centroid(df, centres, features, out="_cl")
    new = a.groupBy("_cl").agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features])
    got = {int(r["_cl"]): [float(r[f]) for f in features] for r in new.collect()}
    return [got.get(j, centres[j]) for j in range(len(centres))]


def kmeans_lloyd(df: DataFrame, features: Sequence[str], init_centres: DataFrame, k: int,
                 n_iter: int) -> DataFrame:
    """Centres (cid, features) after ``n_iter`` Lloyd rounds.

    Each round is one job over ``df`` (persist it first); only k rows reach
    the driver per round, and the next round's plan holds them as literals,
    so the plan does not grow with the number of rounds."""
    cen = _centre_rows(init_centres, features, k)
    for _ in range(n_iter):
        cen = lloyd_round(df, cen, features)
    rows = [(j, *c) for j, c in enumerate(cen)]
    schema = ", ".join(["cid int"] + [f"`{f}` double" for f in features])
    return df.sparkSession.createDataFrame(rows, schema)


def lloyd_sweep(df: DataFrame, features: Sequence[str], id_col: str,
                k_values: Sequence[int] = tuple(range(2, 11)), n_iter: int = 3) -> DataFrame:
    """C3, deterministic core: (k, inertia) after ``n_iter`` Lloyd rounds from
    the first k rows, for each k.  One job per round for all k together."""
    fs = present(df, features)
    rows = keyed(df, fs, id=id_col)
    first = np.array([r["x"] for r in rows.orderBy("id").limit(max(k_values)).collect()], dtype=np.float64).reshape(-1, len(fs))
    found = lloyd_many(rows, len(fs), [first[:k] for k in k_values], n_iter) if len(first) else []
    return df.sparkSession.createDataFrame([(int(k), cost) for k, (_, cost) in zip(k_values, found)], "k int, inertia double") \
             .select("k", rnd(F.col("inertia")).alias("inertia"))


def best_fits(rows: DataFrame, d: int, k_values: Sequence[int], n_init: int, max_iter: int, seed: int,
              tol: float = 1e-4) -> dict[int, tuple[np.ndarray, float]]:
    """Per k the centres (in the order of their coordinates) and inertia of the
    best of ``n_init`` Lloyd runs over ``rows`` (id, x), started from spread rows
    of a bounded sample.  All k and restarts share the jobs."""
    sample = start_sample(rows, d, seed)
    if not len(sample):
        return {}
    spread = totals(rows, [Flat(sample[:1])], d)[0]
    n = max(int(spread.n[0]), 1)
    variance = float(np.mean(spread.squares[0] / n - (spread.sums[0] / n) ** 2))
    runs = [(k, spread_centres(sample, k, seed + 1000 * r + k)) for k in k_values for r in range(max(1, n_init))]
    best: dict[int, tuple[np.ndarray, float]] = {}
    for (k, _), (centres, cost) in zip(runs, lloyd_many(rows, d, [c for _, c in runs], max_iter, tol * max(variance, 0.0))):
        if k not in best or cost < best[k][1]:
            best[k] = (centres[np.lexsort(centres.T[::-1])], cost)
    return best


def canonical_relabel(centres: DataFrame, features: Sequence[str], cid: str = "cid"
                      ) -> DataFrame:
    """(old cid, new cid): ids ordered by centre coordinates (k rows)."""
    w = Window.orderBy(*[F.col(f) for f in features], F.col(cid))
    return centres.select(F.col(cid).alias("_old"), (F.row_number().over(w) - 1).cast("int")
                          .alias("_new"))


def _assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=_VEC,
                           handleInvalid="skip").transform(df)


def kmeans(df: DataFrame, features: Sequence[str], k: int, n_init: int = 10,
           max_iter: int = 300, seed: int = 42, tol: float = 1e-4
           ) -> tuple[DataFrame, float]:
    """Best of ``n_init`` Spark ML k-means fits.

    Returns (centres (cid, features...) with canonical ids, inertia).  The
    caller persists ``df`` if it is reused (all fits read it)."""
    fs = present(df, features)
    data = _assemble(df.select(*fs), fs)
    # the reference stops when the summed squared centre shift is below
    # tol x mean feature variance; Spark stops when every centre moved less
    # than its tol (a distance), hence the square root
    var = df.agg(*[F.var_pop(F.col(f)).alias(f) for f in fs]).first()
    mean_var = sum(float(var[f] or 0.0) for f in fs) / max(len(fs), 1)
    abs_tol = (tol * mean_var) ** 0.5
    data = data.persist()

    def fit(r):
        model = KMeans(k=k, seed=seed + r, maxIter=max_iter, tol=abs_tol,
                       featuresCol=_VEC, initMode="k-means||").fit(data)
        return r, model, model.summary.trainingCost

    # restarts are independent: submit them from a few driver threads so
    # their many small iteration jobs overlap on the cluster
    with ThreadPoolExecutor(max_workers=max(1, min(n_init, MAX_PARALLEL_FITS))) as pool:
        fits = list(pool.map(fit, range(n_init)))
    data.unpersist()
    _, model, cost = min(fits, key=lambda t: (t[2], t[0]))
    rows = [(j, *[float(v) for v in c]) for j, c in enumerate(model.clusterCenters())]
    cen = df.sparkSession.createDataFrame(rows, ["cid", *fs])
    relab = canonical_relabel(cen, fs)
    cen = cen.join(relab, cen.cid == relab._old).select(F.col("_new").alias("cid"), *fs)
    return cen, float(cost)


def minibatch_kmeans(df: DataFrame, features: Sequence[str], k: int, batch_size: int = 2048,
                     n_init: int = 3, max_iter: int = 100, seed: int = 42, id_col: str = "row_id",
                     tol: float = 1e-4, starts: Sequence[np.ndarray] | None = None) -> tuple[DataFrame, float]:
    """C4: mini-batch k-means.  Returns (centres, inertia on all rows).

    The rows are written once in the order of a hash of their id; each round
    reads a fresh range of it (about ``batch_size`` rows; the file statistics
    prune the rest; after the last range the first comes again).  A centre moves
    to the mean of all rows it has been given, in this and earlier rounds: its
    step decays as one over their number.  Restarts (``n_init`` starts from spread
    rows of a bounded sample, or ``starts``) share the rounds' jobs; the one of
    least inertia over all rows wins.  A run ends after ``max_iter`` rounds or when
    its centres move by no more than ``tol`` of the mean variance."""
    fs = present(df, features)
    d = len(fs)
    spark = df.sparkSession
    rows = keyed(df, fs, id=id_col)
    path = scratch_path(spark, "minibatch")
    hashed = rows.select("id", "x", portable_hash("id", seed).alias("h"))
    hashed.repartitionByRange("h").sortWithinPartitions("h").write.parquet(path)
    table = spark.read.parquet(path)
    n = rows.count()
    schema = ", ".join(["cid int"] + [f"`{f}` double" for f in fs])
    if not n:
        return spark.createDataFrame([], schema), 0.0
    if starts is None:
        sample = start_sample(rows, d, seed)
        starts = [spread_centres(sample, k, seed + 1000 * r + k) for r in range(max(1, n_init))]
    ranges = max(1, -(-n // batch_size))
    width = -(-HASH_RANGE // ranges)
    spread = totals(rows, [Flat(np.zeros((1, d)))], d)[0]
    variance = float(np.mean(spread.squares[0] / n - (spread.sums[0] / n) ** 2))
    centres = [np.array(s, dtype=np.float64) for s in starts]
    given, live = [np.zeros(len(c)) for c in centres], list(range(len(centres)))
    for t in range(max_iter):
        if not live:
            break
        low = (t % ranges) * width
        batch = table.where((F.col("h") >= low) & (F.col("h") < low + width))
        still = []
        for i, found in zip(live, totals(batch, [Flat(centres[i]) for i in live], d)):
            given[i] += found.n
            rate = np.where(found.n > 0, found.n / np.maximum(given[i], 1), 0.0)[:, None]
            step = rate * (means(found, centres[i]) - centres[i])
            centres[i] = centres[i] + step
            if not tol or float((step ** 2).sum()) > tol * max(variance, 0.0):
                still.append(i)
        live = still
    cost, best = min((float(found.cost.sum()), i) for i, found in enumerate(totals(rows, [Flat(c) for c in centres], d)))
    c = centres[best][np.lexsort(centres[best].T[::-1])]
    return spark.createDataFrame([(j, *map(float, v)) for j, v in enumerate(c)], schema), cost


def kmeans_sweep(df: DataFrame, features: Sequence[str], id_col: str,
                 k_values: Sequence[int] = tuple(range(2, 11)), n_init: int = 3,
                 max_iter: int = 100, silhouette_sample: int | None = 5000, seed: int = 42
                 ) -> DataFrame:
    """Per k inertia and silhouette (of a sample of the given size, None:
    all rows).  All k and restarts share the jobs of the fit, all k those of the
    silhouettes."""
    from .quality import silhouettes_of
    fs = present(df, features)
    rows = keyed(df, fs, id=id_col)
    fits = best_fits(rows, len(fs), k_values, n_init, max_iter, seed)
    sample = rows if silhouette_sample is None else uniform_sample(rows, silhouette_sample, "id", seed)
    scores = silhouettes_of(sample, [fits[k][0] for k in k_values if k in fits], len(fs))
    out = [(int(k), fits[k][1], s) for k, s in zip((k for k in k_values if k in fits), scores)]
    return df.sparkSession.createDataFrame(out, "k int, inertia double, silhouette double")


def select_k(sweep: DataFrame, candidates: Sequence[int] | None = None) -> DataFrame:
    """K with the highest silhouette (first k on ties), optionally among
    candidates only."""
    s = sweep if not candidates else sweep.where(F.col("k").isin(list(candidates)))
    best = s.agg(F.min_by("k", F.struct((-F.col("silhouette")).alias("neg"), F.col("k")))
                 .alias("best_k"))
    return best


def recommend_k(sweep: DataFrame) -> DataFrame:
    """M7: elbow k, silhouette k, recommended = elbow."""
    from .quality import elbow_k
    e = elbow_k(sweep).select("elbow_k").scalar()
    s = select_k(sweep).scalar()
    return sweep.sparkSession.range(1).select(e.alias("elbow_k"), s.alias("silhouette_k"),
                                               e.alias("recommended_k"))


def k_comparison(df: DataFrame, features: Sequence[str], id_col: str, ks: Sequence[int] = (3, 6),
                 n_init: int = 5, silhouette_sample: int | None = 5000, seed: int = 42, max_iter: int = 300) -> DataFrame:
    """Silhouette, Davies-Bouldin, inertia and sizes for each k; all k and
    restarts share the jobs of the fit."""
    from .quality import davies_bouldin, silhouettes_of
    fs = present(df, features)
    d = len(fs)
    rows = keyed(df, fs, id=id_col)
    fits = best_fits(rows, d, ks, n_init, max_iter, seed)
    ks = [k for k in ks if k in fits]
    sample = rows if silhouette_sample is None else uniform_sample(rows, silhouette_sample, "id", seed)
    scores = silhouettes_of(sample, [fits[k][0] for k in ks], d)
    sizes = totals(rows, [Flat(fits[k][0]) for k in ks], d)
    flat = rows.select("id", *(F.col("x")[i].alias(f) for i, f in enumerate(fs)))
    out = None
    for k, score, t in zip(ks, scores, sizes):
        lab = nearest_centroid(flat, fits[k][0].tolist(), fs, out="cluster")
        row = davies_bouldin(lab, "cluster", fs).select(
            F.lit(k).alias("k"), F.lit(score).alias("silhouette"), "davies_bouldin",
            rnd(F.lit(fits[k][1])).alias("inertia"), F.lit("/".join(str(n) for n in t.n.tolist() if n)).alias("sizes"))
        out = row if out is None else out.unionByName(row)
    if out is None:
        return df.sparkSession.createDataFrame([], "k int, silhouette double, davies_bouldin double, inertia double, sizes string")
    return out
