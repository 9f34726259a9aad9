"""Hand-made edge tables (FIXTURES §4) and invariants for operators without
an exact SQL form."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellate.functions.scalar import GENRE_KEYWORDS, PART_KEYWORDS, cluster_name, decade, keyword_family
from tessellate.operators import assign as A
from tessellate.operators import clean as C
from tessellate.operators import dbscan as DB
from tessellate.operators import hierarchy as H
from tessellate.operators import kmeans as KM
from tessellate.operators import profile as PR
from tessellate.operators import quality as Q
from tessellate.operators import sample as SM
from tessellate.operators import search as SE
from tessellate.operators import stats as S
from tessellate.operators import transform as T
from tessellate.operators.quantiles import grouped_quantiles


# ------------------------------------------------------------------ quantiles
def test_quantiles_match_numpy(spark):
    rng = random.Random(7)
    rows = [(g, float(rng.choice([rng.random(), 0.5, 1.0]))) for g in ("a", "b", "c") for _ in range(137)]
    rows += [("d", 3.0)]  # single-value group
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = {(r.g, r.prob): r.q for r in grouped_quantiles(df, "v", probs, ["g"]).collect()}
    for g in ("a", "b", "c", "d"):
        vals = np.array([v for gg, v in rows if gg == g])
        for p in probs:
            assert got[(g, p)] == pytest.approx(float(np.quantile(vals, p)), abs=1e-12)


def test_bucketed_feature_quantiles_match_numpy(spark):
    from tessellate.operators.quantiles import feature_quantiles
    rng = np.random.default_rng(11)
    a = np.round(rng.lognormal(0, 1, 3000), 3)
    b = np.where(rng.random(3000) < 0.4, 7.0, rng.normal(0, 1, 3000))   # a hot value
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = {(r.feature, r.prob): r.q for r in feature_quantiles(df, ["a", "b"], probs).collect()}
    for name, vals in (("a", a), ("b", b)):
        for p in probs:
            assert got[(name, p)] == pytest.approx(float(np.quantile(vals, p)), abs=1e-9)


def test_quantiles_ignore_nulls_and_empty(spark):
    df = spark.createDataFrame([(None,), (1.0,), (3.0,)], "v double")
    got = grouped_quantiles(df, "v", [0.5]).collect()
    assert got[0].q == 2.0
    empty = spark.createDataFrame([], "v double")
    assert grouped_quantiles(empty, "v", [0.5]).count() == 0


# ------------------------------------------------------------------ stats
def test_constant_and_tiny_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0, 1.0), (2.0, 5.0, None), (4.0, 5.0, None)], "a double, c double, s double")
    corr = {(r.feature_1, r.feature_2): r.r for r in S.correlation_matrix(df, ["a", "c"]).collect()}
    assert corr[("a", "c")] is None and corr[("c", "c")] is None and corr[("a", "a")] == 1.0
    m = {r.feature: r for r in S.feature_moments(df, ["a", "s"]).collect()}
    assert m["s"].skew is None and m["s"].kurt is None        # n < 3 / n < 4
    z, _ = T.scale(df, ["c"], "standard")
    assert {r.c for r in z.collect()} == {0.0}
    mm, _ = T.scale(df, ["c"], "minmax")
    assert {r.c for r in mm.collect()} == {0.0}
    with pytest.raises(ValueError):
        T.scale(df, ["c"], "robust")


def test_missing_counts_nan_as_missing(spark):
    df = spark.createDataFrame([(float("nan"), "x"), (None, None), (1.0, "y")], "a double, b string")
    rep = {r.column: r.n_missing for r in S.missing_report(df).collect()}
    assert rep == {"a": 2, "b": 1}


def test_duplicates_and_clean_report(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (2, None), (3, "z")], "a int, b string")
    assert S.duplicate_count(df).first()[0] == 2
    r = C.clean_report(df).first()
    assert (r.rows_in, r.duplicates_removed, r.null_rows_removed, r.rows_out) == (5, 2, 1, 2)


def test_histogram_last_bin_closed_and_constant(spark):
    df = spark.createDataFrame([(0.0, 7.0), (0.5, 7.0), (1.0, 7.0)], "x double, k double")
    h = {(r.feature, r.bin): r["count"] for r in S.histogram(df, ["x", "k"], 2).collect()}
    assert h[("x", 0)] == 1 and h[("x", 1)] == 2
    assert sum(v for (f, _), v in h.items() if f == "k") == 3


def test_winsorize_keeps_nulls(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)] + [(None,)], "x double")
    out, rep = T.winsorize(df, ["x"], 0.95)
    vals = [r.x for r in out.collect()]
    assert None in vals and max(v for v in vals if v is not None) == pytest.approx(94.05)
    assert rep.first().n_clipped == 5


# ------------------------------------------------------------------ scalar functions
def test_keyword_family_order_and_nulls(spark):
    df = spark.createDataFrame([("trap",), ("indie pop",), ("hip hop",), ("Opera",), (None,), ("cold gear",), ("old rod",)], "g string")
    out = [r.f for r in df.select(keyword_family("g").alias("f")).collect()]
    assert out[:5] == ["Hip-Hop", "Pop", "Hip-Hop", "Classical", "Other"]
    parts = [r.f for r in df.select(keyword_family("g", PART_KEYWORDS).alias("f")).collect()]
    assert parts[5:] == ["Temperature", "Age"]
    assert len(GENRE_KEYWORDS) == 23


def test_decade_lenient_and_strict(spark):
    df = spark.createDataFrame([("1922",), ("1922-03",), ("1922-02-22",), ("bad",), (None,)], "d string")
    lenient = [r.x for r in df.select(decade("d").alias("x")).collect()]
    strict = [r.x for r in df.select(decade("d", strict=True).alias("x")).collect()]
    assert lenient == [1920, 1920, 1920, None, None]
    assert strict == [None, None, 1920, None, None]


def test_cluster_name_rules(spark):
    df = spark.createDataFrame([(0.6, 0.7, 0.8), (0.1, 0.1, 0.5), (None, 0.1, 0.5)],
                               "speechiness double, acousticness double, energy double")
    names = [r.n for r in df.select(cluster_name(df.columns).alias("n")).collect()]
    assert names == ["speech-heavy + acoustic", "balanced", "balanced"]


# ------------------------------------------------------------------ search
def test_similar_items_ties_and_self_exclusion(spark):
    pts = [(0, 0.0, 0.0, 0), (4, 1.0, 0.0, 0), (3, -1.0, 0.0, 0), (2, 0.0, 1.0, 0), (1, 0.0, -1.0, 0), (9, 5.0, 5.0, 1)]
    df = spark.createDataFrame(pts, "id long, x double, y double, c int")
    res = SE.similar_items(df, 0, ["x", "y"], "id", "c", k=3).collect()
    assert [r.id for r in res] == [1, 2, 3] and [r["rank"] for r in res] == [1, 2, 3]
    assert res[0].similarity_score == 0.5


def test_invalid_regex_raises(spark):
    df = spark.createDataFrame([("a(b",)], "name string")
    with pytest.raises(Exception):
        SE.explore(df, {}, "(", ["name"]).collect()
    assert SE.explore(df, {}, "(", ["name"], literal=True).count() == 1


# ------------------------------------------------------------------ samplers
def test_samplers_small_tables(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(10)], "id long, c int")
    assert SM.uniform_sample(df, 100, "id").count() == 10
    s = SM.stratified_sample(df, "c", 4, "id").collect()
    assert len(s) == 4 and {r.c for r in s} == {0, 1}
    assert sorted(r.id for r in SM.uniform_sample(df, 5, "id").collect()) == \
        sorted(r.id for r in SM.uniform_sample(df.repartition(3), 5, "id").collect())


# ------------------------------------------------------------------ metrics guards
def test_metric_guards(spark):
    one = spark.createDataFrame([(i, 0, float(i), 0.0) for i in range(5)], "id long, c int, x double, y double")
    assert Q.silhouette_score(one, "c", ["x", "y"], "id").first()[0] == -1.0
    assert Q.davies_bouldin(one, "c", ["x", "y"]).first()[0] == float("inf")
    same = spark.createDataFrame([(0, 0, -1.0, 0.0), (1, 0, 1.0, 0.0), (2, 1, 0.0, -1.0), (3, 1, 0.0, 1.0)],
                                 "id long, c int, x double, y double")
    assert Q.davies_bouldin(same, "c", ["x", "y"]).first()[0] == 0.0
    single = spark.createDataFrame([(0, 0, 0.0, 0.0), (1, 0, 0.0, 1.0), (2, 1, 9.0, 9.0)],
                                   "id long, c int, x double, y double")
    s = {r.id: r.silhouette for r in Q.silhouette_samples(single, "c", ["x", "y"], "id").collect()}
    assert s[2] == 0.0 and s[0] > 0.8


def test_silhouette_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    X = np.vstack([rng.normal(0, 1, (30, 3)), rng.normal(4, 1, (20, 3))])
    lab = np.array([0] * 30 + [1] * 20)
    rows = [(i, int(lab[i]), *map(float, X[i])) for i in range(len(X))]
    df = spark.createDataFrame(rows, "id long, c int, a double, b double, d double")
    got = {r.id: r.silhouette for r in Q.silhouette_samples(df, "c", ["a", "b", "d"], "id").collect()}
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    for i in range(len(X)):
        own = lab == lab[i]
        a = D[i, own].sum() / (own.sum() - 1)
        b = D[i, ~own].mean()
        assert got[i] == pytest.approx((b - a) / max(a, b), abs=1e-9)


# ------------------------------------------------------------------ k-means
def test_lloyd_invariants(spark):
    rng = np.random.default_rng(1)
    X = np.vstack([rng.normal(c, 0.3, (40, 2)) for c in (0, 3, 6)])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(X)], "id long, x double, y double")
    init = KM.initial_centres_first_rows(df, ["x", "y"], "id", 3)
    costs = []
    for it in range(4):
        cen = KM.kmeans_lloyd(df, ["x", "y"], init, 3, it)
        lab = A.nearest_centroid(df, cen, ["x", "y"], 3, out="c", dist2_col="d2")
        costs.append(lab.agg(F.sum("d2")).first()[0])
    assert all(b <= a + 1e-9 for a, b in zip(costs, costs[1:]))
    c = [[r.x, r.y] for r in cen.orderBy("cid").collect()]
    for r in lab.collect():
        d = [(r.x - cx) ** 2 + (r.y - cy) ** 2 for cx, cy in c]
        assert d[r.c] == min(d)
    shuffled = KM.kmeans_lloyd(df.repartition(5), ["x", "y"], init, 3, 3)
    flat = [v for r in shuffled.orderBy("cid").collect() for v in r]
    ref = [v for r in KM.kmeans_lloyd(df, ["x", "y"], init, 3, 3).orderBy("cid").collect() for v in r]
    assert flat == pytest.approx(ref, abs=1e-12)


def test_ml_kmeans_and_select_k(spark):
    rng = np.random.default_rng(2)
    X = np.vstack([rng.normal(c, 0.2, (30, 2)) for c in (0, 5)])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(X)], "id long, x double, y double")
    cen, cost = KM.kmeans(df, ["x", "y"], 2, n_init=2)
    assert cen.count() == 2 and cost > 0
    xs = [r.x for r in cen.orderBy("cid").collect()]
    assert xs == sorted(xs)                      # canonical ids
    sweep = spark.createDataFrame([(2, 10.0, 0.5), (3, 6.0, 0.7), (4, 5.0, 0.7)], "k int, inertia double, silhouette double")
    assert KM.select_k(sweep).first()[0] == 3


def _kneedle(x, y, S=1.0):
    x = np.asarray(x, float); y = np.asarray(y, float)
    xn = (x - x.min()) / (x.max() - x.min()); yn = (y - y.min()) / (y.max() - y.min())
    yn = yn.max() - yn
    yd = yn - xn
    n = len(x)
    mx = [i for i in range(n) if yd[i] >= yd[max(i - 1, 0)] and yd[i] >= yd[min(i + 1, n - 1)]]
    mn = [i for i in range(n) if yd[i] <= yd[max(i - 1, 0)] and yd[i] <= yd[min(i + 1, n - 1)]]
    if not mx:
        return None
    step = np.abs(np.diff(xn)).mean()
    thr, ti = None, None
    for i in range(n):
        if i < mx[0]:
            continue
        if xn[i] == 1.0:
            break
        if i in mx:
            thr, ti = yd[i] - S * step, i
        if i in mn:
            thr = 0.0
        if yd[i + 1] < thr:
            return x[ti]
    return None


@pytest.mark.parametrize("curve", [
    [100, 60, 40, 32, 28, 26, 25, 24.5, 24.2],
    [90, 50, 45, 41, 38, 36, 34, 33, 32],
    [50, 45, 40, 35, 30, 25, 20, 15, 10],
])
def test_elbow_matches_kneedle(spark, curve):
    ks = list(range(2, 11))
    sweep = spark.createDataFrame([(k, float(v)) for k, v in zip(ks, curve)], "k int, inertia double")
    got = Q.elbow_k(sweep).first()
    want = _kneedle(ks, curve)
    assert got.knee == want
    assert got.elbow_k == (want if want is not None else ks[2])


# ------------------------------------------------------------------ DBSCAN
def _dbscan_scan(X, eps, m):
    """Sequential scan-and-expand DBSCAN written from its public description."""
    n = len(X)
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    nb = [np.flatnonzero(D[i] <= eps) for i in range(n)]
    core = np.array([len(v) >= m for v in nb])
    lab = -np.ones(n, int)
    c = 0
    for i in range(n):
        if lab[i] != -1 or not core[i]:
            continue
        stack = [i]
        lab[i] = c
        while stack:
            p = stack.pop()
            if not core[p]:
                continue
            for q in nb[p]:
                if lab[q] == -1:
                    lab[q] = c
                    stack.append(q)
        c += 1
    return lab


def test_dbscan_hand_table(spark):
    pts = [(0, 0), (0.1, 0), (0, 0.1), (0.1, 0.1), (0.05, 0.05),        # dense group A
           (3, 3), (3.1, 3), (3, 3.1), (3.1, 3.1), (3.05, 3.05),        # dense group B
           (0.25, 0.05),                                                  # border of A
           (9, 9)]                                                        # noise
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id long, x double, y double")
    got = {r.id: r.cluster for r in DB.dbscan(df, ["x", "y"], 0.16, 4, "id").collect()}
    want = _dbscan_scan(np.array(pts, float), 0.16, 4)
    assert [got[i] for i in range(len(pts))] == list(want)
    assert got[11] == -1 and got[10] == 0


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_dbscan_random_tables(spark, seed):
    rng = np.random.default_rng(seed)
    X = np.round(rng.uniform(0, 1, (80, 2)), 3)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(X)], "id long, x double, y double")
    got = {r.id: r.cluster for r in DB.dbscan(df.repartition(3), ["x", "y"], 0.09, 4, "id").collect()}
    assert [got[i] for i in range(len(X))] == list(_dbscan_scan(X, 0.09, 4))


def test_connected_components_chain(spark):
    n = 40
    v = spark.createDataFrame([(i,) for i in range(n)], "id long")
    e = spark.createDataFrame([(i, i + 1) for i in range(n - 1) if i != 19], "src long, dst long")
    comp = {r.id: r.comp for r in DB.connected_components(v, e).collect()}
    assert all(comp[i] == 0 for i in range(20)) and all(comp[i] == 20 for i in range(20, n))


# ------------------------------------------------------------------ hierarchy
def test_merge_tree_ward_unit_weights_matches_naive():
    rng = np.random.default_rng(4)
    X = rng.normal(size=(12, 2))
    tree = H.merge_tree(np.ones(12), X, "ward")
    # naive ward: merge the pair with the least increase of within-group SS
    groups = {i: [i] for i in range(12)}
    nxt = 12
    for t in range(11):
        best = None
        for a in groups:
            for b in groups:
                if a < b:
                    A_, B_ = X[groups[a]], X[groups[b]]
                    inc = len(A_) * len(B_) / (len(A_) + len(B_)) * ((A_.mean(0) - B_.mean(0)) ** 2).sum()
                    if best is None or inc < best[0]:
                        best = (inc, a, b)
        inc, a, b = best
        assert tree[t, 2] == pytest.approx(math.sqrt(2 * inc))
        groups[nxt] = groups.pop(a) + groups.pop(b)
        nxt += 1
    assert all(np.diff(tree[:, 2]) >= -1e-12)


def test_hierarchical_labels_partition(spark):
    rng = np.random.default_rng(5)
    X = np.vstack([rng.normal(c, 0.2, (25, 2)) for c in (0, 4, 8)])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(X)], "id long, x double, y double")
    lab, dendro = H.hierarchical(df, ["x", "y"], 3, "id", n_micro=20)
    got = {r.id: r.cluster for r in lab.collect()}
    assert len(got) == 75 and set(got.values()) == {0, 1, 2}
    assert len({got[i] for i in range(25)}) == 1 and len({got[i] for i in range(25, 50)}) == 1
    assert H.dendrogram_table(dendro, 5).count() == 5


# ------------------------------------------------------------------ profile
def test_crosstab_and_top_columns(spark):
    df = spark.createDataFrame([(0, "a"), (0, "a"), (0, "b"), (1, "b")], "c int, v string")
    ct = {(r.row, r.value): r.pct for r in PR.crosstab_pct(df, "c", "v").collect()}
    assert ct[(0, "a")] == pytest.approx(66.666667) and ct[(1, "b")] == 100.0
    top = [(r.value, r.mean_pct) for r in PR.top_columns(PR.crosstab_pct(df, "c", "v")).orderBy("rank").collect()]
    assert top[0][0] == "b" and top[0][1] == pytest.approx((33.333333 + 100) / 2, abs=1e-5)


def test_grouped_bucket_quantiles_match_numpy(spark):
    rng = np.random.default_rng(12)
    rows = []
    for g, n in (("hot", 4000), ("x", 300), ("y", 1)):
        vals = np.where(rng.random(n) < 0.3, 5.0, np.round(rng.normal(0, 2, n), 4))
        rows += [(g, float(v)) for v in vals]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.prob): r.q for r in grouped_quantiles(df, "v", probs, ["g"]).collect()}
    for g in ("hot", "x", "y"):
        vals = np.array([v for gg, v in rows if gg == g])
        for p in probs:
            assert got[(g, p)] == pytest.approx(float(np.quantile(vals, p)), abs=1e-9)


def test_grouped_quantiles_many_groups_fallback(spark, monkeypatch):
    from tessellate.operators import quantiles as QT
    monkeypatch.setattr(QT, "bounded_broadcast", lambda t: t)      # the plain join
    rng = np.random.default_rng(13)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 5, 800), rng.normal(0, 1, 800))]
    df = spark.createDataFrame(rows, "g long, v double")
    got = {(r.g, r.prob): r.q for r in QT.grouped_quantiles(df, "v", [0.1, 0.5, 0.9], ["g"]).collect()}
    for g in range(5):
        vals = np.array([v for gg, v in rows if gg == g])
        for p in (0.1, 0.5, 0.9):
            assert got[(g, p)] == pytest.approx(float(np.quantile(vals, p)), abs=1e-9)


def test_quantiles_of_awkward_doubles(spark):
    """Every magnitude, both signs, neighbours one bit apart, a hot value, infinities, signed zeros, a null group."""
    rng = np.random.default_rng(17)
    wide = rng.choice([-1.0, 1.0], 600) * 10.0 ** rng.uniform(-300, 300, 600)
    bits = np.nextafter(1.0, 2.0) + np.arange(500) * np.spacing(1.0)
    near = 1e300 * (1 + np.arange(400) * 2e-16)
    groups = {"wide": np.concatenate([wide, [5e-324, -5e-324, 1.7976931348623157e308, -1.7976931348623157e308]]),
              "bits": np.concatenate([bits, np.full(300, bits[7])]), "near": near, "zero": np.array([0.0, -0.0, 0.0, 1e-310]),
              "inf": np.array([-np.inf, 1.0, 2.0, 3.0, np.inf]), None: rng.normal(size=50)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None)], "g string, v double").repartition(6)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(r.g, r.prob): r.q for r in grouped_quantiles(df, "v", probs, ["g"]).collect()}
    assert len(got) == len(groups) * len(probs)
    for g, vs in groups.items():
        vs = np.sort(vs)
        for p in probs:
            at = (len(vs) - 1) * p
            lo, hi = vs[int(at)], vs[min(int(at) + 1, len(vs) - 1)]
            want = lo if lo == hi else lo + (hi - lo) * (at - int(at))
            assert got[g, p] == want or abs(got[g, p] - want) <= 1e-12 * max(abs(lo), abs(hi)) or (np.isnan(want) and np.isnan(got[g, p])), (g, p)


@pytest.mark.parametrize("dims,seed", [(1, 3), (2, 4), (3, 5), (3, 6)])
def test_grid_dbscan_hot_blob_matches_scan(spark, dims, seed):
    rng = np.random.default_rng(seed)
    blob = rng.normal(0.5, 0.004, (300, dims))                 # a hot cell: most rows
    rest = rng.uniform(0, 1, (120, dims))
    grid = np.round(rng.uniform(0, 1, (40, dims)) / 0.05) * 0.05  # points on cell boundaries
    X = np.round(np.vstack([blob, rest, grid]), 6)
    cols = ", ".join(f"x{i} double" for i in range(dims))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(X)], f"id long, {cols}")
    fs = [f"x{i}" for i in range(dims)]
    for eps, m in ((0.05, 4), (0.1, 6)):
        got = {r.id: r.cluster for r in DB.dbscan(df, fs, eps, m, "id", method="grid").collect()}
        assert [got[i] for i in range(len(X))] == list(_dbscan_scan(X, eps, m))


def test_dbscan_auto_switches_to_grid_on_hot_cell(spark):
    rng = np.random.default_rng(21)
    X = np.round(np.vstack([rng.normal(0.5, 0.002, (400, 2)), rng.uniform(0, 1, (50, 2))]), 6)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(X)], "id long, x double, y double")
    rows, cand = DB.candidate_pairs(df, ["x", "y"], 0.05)
    assert rows == 450 and cand > DB.PAIR_BUDGET_PER_ROW * rows
    got = {r.id: r.cluster for r in DB.dbscan(df, ["x", "y"], 0.05, 5, "id").collect()}
    assert [got[i] for i in range(len(X))] == list(_dbscan_scan(X, 0.05, 5))
