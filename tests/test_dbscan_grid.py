"""Dense cells are linked as cells: their pairs of points are not listed."""

import numpy as np

from tessellate.operators import dbscan as DB


def plain_dbscan(x, eps, least):
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= least
    label, n = np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = n
                    todo += np.flatnonzero(near[j] & core & (label < 0)).tolist()
            n += 1
    for i in np.flatnonzero(~core):
        at = label[near[i] & core]
        label[i] = at.min() if len(at) else -1
    return label, core


def test_grid_lists_no_pairs_between_dense_cells(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(0, 0.05, (350, 2)), rng.normal(0.6, 0.08, (250, 2)), rng.uniform(-1, 1.5, (150, 2))]).round(4)
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(x.tolist())], "id long, a double, b double")
    edges, plain = [], DB.connected_components

    def counted(vertices, found, *more):
        edges.append(found.count())
        return plain(vertices, found, *more)

    monkeypatch.setattr(DB, "connected_components", counted)
    rows = {r["id"]: (r["cluster"], r["is_core"]) for r in DB.dbscan(df, ["a", "b"], 0.06, 5, "id", method="grid").collect()}
    label, core = plain_dbscan(x, 0.06, 5)
    assert rows == {i: (int(label[i]), bool(core[i])) for i in range(len(x))}
    assert edges[0] < 6 * len(x)  # the core pairs alone are tens of a row


def test_grid_counts_an_id_once(spark):
    df = spark.createDataFrame([(i % 8, 0.001 * i, 0.0) for i in range(16)] + [(9, 5.0, 5.0), (10, None, 0.0)], "id long, a double, b double")
    rows = DB.dbscan(df, ["a", "b"], 0.5, 5, "id", method="grid").select("id", "cluster", "is_core").collect()
    assert {tuple(r) for r in rows} == {*((i, 0, True) for i in range(8)), (9, -1, False), (10, -1, False)} and len(rows) == 18
