"""K-means passes shared by many models, mini-batches and the divisive tree."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellate.operators import hierarchy as H
from tessellate.operators import kmeans as KM
from tessellate.operators import lloyd as L
from tessellate.operators import quality as Q
from tessellate.operators.metric import keyed
from tests.test_metric import plain_silhouette

FS = ["a", "b", "c"]


def points(n=400, seed=3):
    rng = np.random.default_rng(seed)
    centres = np.array([[0.0, 0, 0], [8, 0, 1], [0, 9, 2], [7, 8, -3]])
    return centres[rng.integers(0, 4, n)] + rng.normal(size=(n, 3)) * 0.5


def frame(spark, x):
    return spark.createDataFrame([(f"r{i:04d}", *map(float, r)) for i, r in enumerate(x)], "id string, a double, b double, c double").repartition(4)


def plain_lloyd(x, start, rounds, least=None):
    c = np.array(start, dtype=float)
    for _ in range(rounds):
        near = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        shift, c = ((new - c) ** 2).sum(), new
        if least is not None and shift <= least:
            break
    return c, ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_many_models_in_the_same_passes(spark, monkeypatch):
    x = points()
    rows = keyed(frame(spark, x), FS, id="id")
    starts = [x[:2], x[10:13], np.vstack([x[:3], [[99.0, 99, 99]]])]  # the last one keeps an empty cell
    jobs = []
    run = L.totals
    monkeypatch.setattr(L, "totals", lambda *a: jobs.append(len(a[1])) or run(*a))
    for (c, cost), s in zip(L.lloyd_many(rows, 3, starts, 4), starts):
        want, want_cost = plain_lloyd(x, s, 4)
        assert np.allclose(c, want) and abs(cost - want_cost) < 1e-6
    assert jobs == [3] * 5  # a job per round and one for the costs
    jobs.clear()
    starts = [*starts, plain_lloyd(x, x[:2], 50)[0]]  # the last one is settled
    for (c, cost), s in zip(L.lloyd_many(rows, 3, starts, 50, 1e-9), starts):
        want, want_cost = plain_lloyd(x, s, 50, 1e-9)
        assert np.allclose(c, want) and abs(cost - want_cost) < 1e-6
    assert len(jobs) < 50 and jobs[0] == jobs[-1] == 4 and max(jobs[1:-1]) == 3  # settled models drop out


def test_sweep_and_comparison(spark):
    x = points()
    df = frame(spark, x)
    sweep = {r["k"]: r for r in KM.kmeans_sweep(df, FS, "id", (2, 3, 4, 5), n_init=3).collect()}
    costs = [sweep[k]["inertia"] for k in (2, 3, 4, 5)]
    assert costs == sorted(costs, reverse=True) and max(sweep, key=lambda k: sweep[k]["silhouette"]) == 4
    best, cost = KM.best_fits(keyed(df, FS, id="id"), 3, (4,), 3, 100, 42)[4]
    assert abs(cost - sweep[4]["inertia"]) < 1e-9 and best.tolist() == sorted(best.tolist())
    labels = ((x[:, None] - best[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert abs(sweep[4]["silhouette"] - np.mean(plain_silhouette(x, labels))) < 1e-9
    row = KM.k_comparison(df, FS, "id", (4,), n_init=3).first()
    assert row["sizes"] == "/".join(str((labels == j).sum()) for j in range(4)) and abs(row["silhouette"] - sweep[4]["silhouette"]) < 1e-9
    assert KM.kmeans_sweep(df.where("false"), FS, "id", (2, 3)).count() == 0
    assert KM.k_comparison(df.where("false"), FS, "id", (2, 3)).count() == 0


@pytest.mark.parametrize("tile", [9, 64, None])
def test_silhouettes_of_many_models(spark, tile):
    x = points(150)
    rows = keyed(frame(spark, x), FS, id="id")
    models = [x[:2], x[[0, 0]], x[:7], x[:1]]
    got = Q.silhouettes_of(rows, models, 3, tile_rows=tile)
    for c, s in zip(models, got):
        labels = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        want = np.mean(plain_silhouette(x, labels)) if len(set(labels.tolist())) > 1 else -1.0
        assert abs(s - want) < 1e-9


def test_minibatches(spark):
    x = points(1000)
    df = frame(spark, x)
    cen, cost = KM.minibatch_kmeans(df, FS, 4, batch_size=100, n_init=2, max_iter=30, id_col="id")
    again, cost2 = KM.minibatch_kmeans(df.repartition(7), FS, 4, batch_size=100, n_init=2, max_iter=30, id_col="id")
    assert abs(cost - cost2) < 1e-6 and np.allclose(np.array(cen.collect()), np.array(again.collect()))
    _, best = plain_lloyd(x, np.array([[0.0, 0, 0], [8, 0, 1], [0, 9, 2], [7, 8, -3]]), 20)
    assert best <= cost + 1e-6 and cost < 1.05 * best
    assert KM.minibatch_kmeans(df.where("false"), FS, 4, id_col="id")[0].count() == 0
    # every row is given once in a full turn of the ranges: centres of one cell are the mean of all rows
    one, _ = KM.minibatch_kmeans(df, FS, 1, batch_size=100, n_init=1, max_iter=10, id_col="id", tol=0.0, starts=[x[:1]])
    assert np.allclose([one.first()[f] for f in FS], x.mean(axis=0))


def plain_bisecting(x, k, n_iter=20):
    leaves = [(0, np.arange(len(x)))]
    cost = lambda at: ((x[at] - x[at].mean(axis=0)) ** 2).sum()
    number = 1
    while len(leaves) < k:
        able = sorted((l for l in leaves if len(l[1]) > 1 and cost(l[1]) > 1e-12 * cost(np.arange(len(x)))), key=lambda l: (-cost(l[1]), l[0]))
        chosen = able[:k - len(leaves)]
        if not chosen:
            break
        for l in sorted(chosen, key=lambda l: l[0]):
            y = x[l[1]]
            f = int(y.var(axis=0).argmax())
            step = np.zeros(x.shape[1])
            step[f] = y.std(axis=0)[f]
            c, _ = plain_lloyd(y, [y.mean(axis=0) - step, y.mean(axis=0) + step], n_iter, 0.0)
            near = ((y[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            leaves = [m for m in leaves if m[0] != l[0]] + [(number, l[1][near == 0]), (number + 1, l[1][near == 1])]
            number += 2
    return [set(at.tolist()) for _, at in leaves]


@pytest.mark.parametrize("k", [1, 2, 4, 7])
def test_divisive_tree(spark, k):
    x = points(300)
    labels, tree = H.bisecting(frame(spark, x), FS, k, "id")
    got = {}
    rows = labels.collect()
    for r in rows:
        got.setdefault(r["cluster"], set()).add(int(r["id"][1:]))
    assert len(rows) == 300 and sorted(map(sorted, got.values())) == sorted(map(sorted, plain_bisecting(x, k)))
    nodes = tree.collect()
    assert len(nodes) == 2 * k - 1
    # sizes and costs of the leaves by SQL, given the labels
    lab = labels.join(frame(spark, x), "id").toPandas()
    con = duckdb.connect()
    con.register("lab", lab)
    want = con.execute("SELECT cluster, count(*) AS n, sum((a - ma) ** 2 + (b - mb) ** 2 + (c - mc) ** 2) AS cost FROM (SELECT *, "
                       "avg(a) OVER w AS ma, avg(b) OVER w AS mb, avg(c) OVER w AS mc FROM lab WINDOW w AS (PARTITION BY cluster)) "
                       "GROUP BY cluster ORDER BY cluster").fetchall()
    leaves = sorted((n["cluster"], n["size"], n["cost"]) for n in nodes if n["cluster"] is not None)
    assert [l[:2] for l in leaves] == [w[:2] for w in want] and all(abs(a[2] - b[2]) < 1e-6 for a, b in zip(leaves, want))
    for n in nodes:  # an inner node has the rows of its children
        children = [m["size"] for m in nodes if m["parent"] == n["node"]]
        assert not children or sum(children) == n["size"]


def test_divisive_tree_of_odd_tables(spark):
    same = frame(spark, np.ones((30, 3)))
    labels, tree = H.bisecting(same, FS, 3, "id")
    assert {r["cluster"] for r in labels.collect()} == {0} and tree.count() == 1
    labels, tree = H.bisecting(same.where("false"), FS, 3, "id")
    assert labels.count() == 0 and tree.count() == 0
    odd = frame(spark, points(50)).union(spark.createDataFrame([("null", None, 1.0, 1.0)], "id string, a double, b double, c double"))
    assert H.bisecting(odd, FS, 3, "id")[0].count() == 50
    labels, _ = H.hierarchical(odd, FS, 3, "id", n_micro=10)  # a null feature no longer fails
    assert labels.count() == 50
    assert H.hierarchical(odd.where("false"), FS, 3, "id")[0].count() == 0


def plain_tree(x):
    """Edges (distance, a, b) of the minimum spanning tree, by growing it from row 0."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    inside, edges = {0}, []
    while len(inside) < len(x):
        edge = min((d[i, j], min(i, j), max(i, j)) for i in inside for j in range(len(x)) if j not in inside)
        edges.append(edge)
        inside |= {edge[1], edge[2]}
    return sorted(edges)


def plain_cut(n, edges):
    label = list(range(n))
    for _, a, b in edges:
        low, high = sorted((label[a], label[b]))
        label = [low if v == high else v for v in label]
    order = {v: c for c, v in enumerate(sorted(set(label)))}
    return [order[v] for v in label]


def test_spanning_tree_and_single_linkage(spark):
    rng = np.random.default_rng(8)
    x = np.unique(np.vstack([points(30, 5), rng.integers(0, 3, (12, 3)) * 2.0]), axis=0)  # ties among grid points
    x = x[rng.permutation(len(x))]
    df = frame(spark, x).coalesce(2)
    want = plain_tree(x)
    labels, tree = H.single_linkage(df, FS, "id", k=4, tile_rows=6)
    got = sorted((r["distance"], int(r["a"][1:]), int(r["b"][1:])) for r in tree.collect())
    assert len(got) == len(want) and np.allclose([e[0] for e in got], [e[0] for e in want])
    assert {r["id"]: r["cluster"] for r in labels.collect()} == {f"r{i:04d}": c for i, c in enumerate(plain_cut(len(x), want[:-3]))}
    labels, _ = H.single_linkage(df, FS, "id", height=1.5, tree=tree)
    assert {r["id"]: r["cluster"] for r in labels.collect()} == {
        f"r{i:04d}": c for i, c in enumerate(plain_cut(len(x), [e for e in want if e[0] <= 1.5]))}


def test_single_linkage_of_odd_tables(spark):
    x = np.vstack([np.ones((20, 3)), np.zeros((5, 3)), [[9.0, 9, 9]]])  # copies are one point
    df = frame(spark, x).union(spark.createDataFrame([("null", None, 1.0, 1.0)], "id string, a double, b double, c double"))
    labels, tree = H.single_linkage(df, FS, "id", k=2)
    assert tree.count() == 2 and {r["id"]: r["cluster"] for r in labels.collect()} == {f"r{i:04d}": int(i == 25) for i in range(26)}
    labels, _ = H.single_linkage(df, FS, "id", k=9, tree=tree)
    assert len({r["cluster"] for r in labels.collect()}) == 3
    labels, tree = H.single_linkage(df.where("false"), FS, "id", k=2)
    assert labels.count() == 0 and tree.count() == 0
    with pytest.raises(ValueError):
        H.single_linkage(df, FS, "id")
